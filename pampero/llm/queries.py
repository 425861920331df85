"""The queries of the training-data operators for language models, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pampero.functions.text import plain_digits
from pampero.llm import matching as mt
from pampero.llm.components import components, pairs_within
from pampero.llm.leaks import leaks
from pampero.llm.percentiles import from_summaries, percentiles, summaries
from pampero.llm.residue import residue
from pampero.llm.splits import assign_splits
from pampero.llm.tokenizer import encode
from pampero.operators.relational import keep_one
from pampero.operators.stats import modes, one_row
from pampero.plans.silver import consolidate
from pampero.session import table, written


def _links(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "redirecciones").where("estado = 'vigente'")
    return r.select(plain_digits(r.id_anterior).cast("bigint").alias("a"), plain_digits(r.id_actual).cast("bigint").alias("b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "modelo")
    ids = m.select(plain_digits(m.jugador_tm_id).cast("bigint").alias("id")).where("id is not null").distinct()
    cc = components(_links(spark, d))
    there = ids.join(cc, ids.id == cc.node).select("id", "component")
    return pairs_within(there, "id", "component").select(F.col("a").alias("jugador_tm_id_a"), F.col("b").alias("jugador_tm_id_b"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every operation of the model population with its split."""
    m = table(spark, d, "modelo")
    shares = {r["particion"]: r["proporcion"] for r in table(spark, d, "particion_objetivo").collect()}  # a fixed table of three rows
    return assign_splits(m, "operacion_id", plain_digits(m.jugador_tm_id), _links(spark, d), F.col("es_destino_top_20"), shares)


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows, share and share of the positive class of each split, and how many groups stand in more than one (none may)."""
    split = written(p3_splits(spark, d), "balance")
    m = table(spark, d, "modelo").select("operacion_id", F.coalesce(F.col("es_destino_top_20").cast("int"), F.lit(0)).alias("p"))
    both = split.groupBy("componente").agg(F.count_distinct("particion").alias("k")).agg(F.count_if(F.col("k") > 1).alias("grupos_partidos"))
    per = split.join(m, "operacion_id").groupBy("particion").agg(F.count("*").alias("filas"), F.round(F.avg("p"), 6).alias("positivos"))
    whole = per.agg(F.sum("filas").alias("todas"))
    return one_row(one_row(per, whole), both).select("particion", "filas", F.round(F.col("filas") / F.col("todas"), 6).alias("proporcion"), "positivos", "grupos_partidos")


def _clubs(spark: SparkSession, d: str) -> DataFrame:
    """Club names of both sources; reserve and youth sides are left out."""
    p, u = table(spark, d, "plata"), table(spark, d, "uefa")
    home = p.select(plain_digits(p.club_origen_id).alias("ent"), F.col("club_origen").alias("name"), F.col("club_origen_pais").alias("country"), F.col("club_origen_es_filial").alias("filial"))
    # the destination names the same clubs by the same ids: more forms of a name
    other = p.select(plain_digits(p.club_destino_id).alias("ent"), F.col("club_destino").alias("name"), F.col("club_destino_pais").alias("country"))
    side = home.where("ent is not null").groupBy("ent").agg(F.max(F.coalesce(F.col("filial"), F.lit(False)) | F.coalesce(F.col("name").rlike(mt.RESERVE), F.lit(False))).alias("filial"))
    a = home.drop("filial").unionByName(other).distinct().join(side.where("not filial"), "ent").select(F.lit("a").alias("side"), "ent", "name", "country")
    names = F.explode(F.array("uefa_nombre", "uefa_nombre_oficial", "uefa_nombre_internacional", "uefa_nombre_corto"))
    b = u.select(F.lit("b").alias("side"), plain_digits(u.uefa_club_id).alias("ent"), names.alias("name"), F.col("uefa_pais").alias("country")).distinct()
    return a.unionByName(b)


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """People of both sources, and which ids of plata are one person: the same name and country, birth years and heights that agree."""
    p, f = table(spark, d, "plata"), table(spark, d, "fotmob")
    tokens, same, role = mt.mapped(lambda v: " ".join(mt.person_tokens(v)), "string"), mt.mapped(mt.country, "string"), mt.mapped(mt.role_class, "string")
    born = F.substring("temporada_fichaje", 1, 4).try_cast("int") - F.when(F.col("edad_al_fichaje").between(14, 45), F.col("edad_al_fichaje"))
    cells = {"nombre": "nombre", "n1": "nacionalidad", "n2": "nacionalidad_2", "nacido": born, "altura": "altura_cm", "pie": "pie", "pos": "posicion_tm"}
    ids = p.where("jugador_tm_id is not null and nombre is not null").select(F.col("jugador_tm_id").alias("id"), *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in cells.items()])
    # most rows of an id repeat: they are counted before anything is made of them
    ids = written(ids.groupBy("id", *cells).agg(F.count("*").alias("n")), "mt-counted")
    one = modes(ids.withColumn("id", plain_digits(F.col("id"))).where("id is not null"), ["id"], list(cells))
    one = one.select("id", tokens("nombre").alias("nombre"), F.concat_ws("|", same("n1"), same("n2")).alias("paises"), "nacido", "altura", F.coalesce(F.lower("pie"), F.lit("")).alias("pie"), role("pos").alias("rol"))
    one = written(one, "mt-plata")
    # a missing birth year or height takes the only one that others of the name have
    years = one.groupBy("nombre", "paises").agg(F.min("nacido").alias("y0"), F.max("nacido").alias("y1"))
    known = one.join(years, ["nombre", "paises"]).withColumn("nacido", F.coalesce("nacido", F.when(F.col("y0") == F.col("y1"), F.col("y0"))))
    tall = known.groupBy("nombre", "paises", "nacido").agg(F.min("altura").alias("h0"), F.max("altura").alias("h1"))
    known = known.alias("k").join(tall.alias("t"), [F.col("k.nombre") == F.col("t.nombre"), F.col("k.paises") == F.col("t.paises"), F.col("k.nacido").eqNullSafe(F.col("t.nacido"))]).select("k.*", F.coalesce("altura", F.when(F.col("h0") == F.col("h1"), F.col("h0"))).alias("h"))
    keyed = known.withColumn("persona", F.when(F.col("nacido").isNull(), F.col("id")).otherwise(F.md5(F.concat_ws("|", "nombre", "paises", "nacido", "h"))))
    keyed = written(keyed, "mt-keyed")
    members = keyed.select("id", "persona")
    a = keyed.groupBy("persona").agg(F.min("nombre").alias("nombre"), F.min("paises").alias("paises"), F.max("nacido").alias("nacido"), F.max("h").alias("altura"), F.max("pie").alias("pie"), F.max("rol").alias("rol"))
    a = a.select(F.lit("a").alias("side"), F.col("persona").alias("ent"), "nombre", "paises", F.col("nacido").cast("int"), F.col("altura").cast("int"), "pie", "rol")

    b = f.select(plain_digits(f.jugador_fotmob_id).alias("ent"), tokens("nombre_fotmob").alias("nombre"), mt.profile("playerinformation").alias("x"), F.year("extraido_el").alias("y"), role(F.regexp_extract("positiondescription", r'"label"\s*:\s*"([^"]*)', 1)).alias("rol"))
    b = b.select(F.lit("b").alias("side"), "ent", "nombre", F.coalesce("x.pais", F.lit("")).alias("paises"), (F.col("y") - F.col("x.edad")).alias("nacido"), F.col("x.altura").alias("altura"), F.coalesce("x.pie", F.lit("")).alias("pie"), F.coalesce("rol", F.lit("")).alias("rol"))
    return a.unionByName(b), members


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Clubs and players tied to their counterparts, with a confidence."""
    clubs = mt.match_clubs(_clubs(spark, d)).select(F.lit("club").alias("tipo"), F.col("a").alias("plata_id"), F.col("b").alias("fuente_id"), "confianza")
    people, members = _people(spark, d)
    tied = mt.match_people(people)
    players = tied.join(members, tied.a == members.persona).select(F.lit("jugador").alias("tipo"), F.col("id").alias("plata_id"), F.col("b").alias("fuente_id"), "confianza")
    return clubs.unionByName(players)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("tipo", "plata_id", "fuente_id")


def silver(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated table with the players tied to their profiles as in p4."""
    people, members = _people(spark, d)
    tied = written(mt.match_people(people).join(members, F.col("a") == members.persona).select(F.col("id").alias("jugador_tm_id"), F.col("b").alias("jugador_fotmob_id"), "confianza"), "silver-players")

    f = table(spark, d, "fotmob").select(plain_digits(F.col("jugador_fotmob_id")).alias("jugador_fotmob_id"), mt.profile("playerinformation").alias("x"), F.nullif(F.regexp_extract("positiondescription", r'"label"\s*:\s*"([^"]*)', 1), F.lit("")).alias("posicion_fotmob"), "extraido_el", "registro_id")
    profiles = keep_one(f, ["jugador_fotmob_id"], [F.col("extraido_el"), F.col("registro_id")]).select("jugador_fotmob_id", F.col("x.altura").alias("altura_cm"), F.nullif("x.pie", F.lit("")).alias("pie"), "posicion_fotmob")
    best = keep_one(tied, ["jugador_tm_id"], [F.col("confianza"), F.col("jugador_fotmob_id")]).drop("confianza")
    return consolidate(spark, d, players=best.join(profiles, "jugador_fotmob_id", "left"))


PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of minutes by role."""
    return percentiles(table(spark, d, "modelo"), ["grupo_posicion"], "stat_minutes", PERCENTILES)


def p7_by_season(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of minutes by role and season."""
    return percentiles(table(spark, d, "modelo"), ["grupo_posicion", "temporada_fichaje"], "stat_minutes", PERCENTILES)


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by role out of the joined summaries of each season, with their bound."""
    parts = summaries(table(spark, d, "modelo"), ["grupo_posicion", "temporada_fichaje"], "stat_minutes", 0.01)
    return from_summaries(parts, ["grupo_posicion"], PERCENTILES, 0.01)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The items' own passages; the same phrasing about others is told apart by its slots."""
    return p9_passages(spark, d).where("clase = 'pasaje'").select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Own and restated passages with their length and how much of them matches."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "evaluacion"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_reasons(spark, d).select("doc_id")


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same with the reasons."""
    return residue(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_splits, p3_balance, p4_found, p4_matches, silver, p7_percentiles, p7_by_season, p7_joined, p8_ids, p9_found, p9_passages, p10_found, p10_reasons)}

_ID = r"try_cast(regexp_extract({0}, '^\D*(\d+)(?:\.\d+)?\D*$', 1) as bigint)"


def _quantiles(groups: str) -> str:
    one = "select {g}, {p}::double percentil, round(quantile_cont(stat_minutes, {p}), 6) valor, count(*) n from modelo where stat_minutes is not null and not isnan(stat_minutes) group by {g}"
    return " union all ".join(one.format(g=groups, p=p) for p in PERCENTILES)


SQL = {
    "p3_found": f"""
with recursive e as (select {_ID.format('id_anterior')} a, {_ID.format('id_actual')} b from redirecciones where estado = 'vigente'),
u as (select a, b from e union select b, a from e),
r(a, b) as (select a, b from u union select r.a, u.b from r join u on r.b = u.a),
m as (select distinct {_ID.format('jugador_tm_id')} id from modelo)
select distinct a jugador_tm_id_a, b jugador_tm_id_b from r join m x on r.a = x.id join m y on r.b = y.id where a < b""",
    "p7_percentiles": _quantiles("grupo_posicion"),
    "p7_by_season": _quantiles("grupo_posicion, temporada_fichaje"),
    "p7_joined": f"""
with r as (select grupo_posicion g, temporada_fichaje s, stat_minutes v, row_number() over (partition by g, s order by stat_minutes) rn, count(*) over (partition by g, s) n from modelo where stat_minutes is not null and not isnan(stat_minutes)),
k as (select g, s, v, rn from r where rn % greatest(1, floor(0.01 * n)::bigint) = 0 or rn = n), w as (select g, v, rn - coalesce(lag(rn) over (partition by g, s order by rn), 0) w from k),
p as (select g, v, sum(w) w from w group by 1, 2), u as (select g, v, sum(w) over (partition by g order by v) upto, sum(w) over (partition by g) n from p)
select g grupo_posicion, q::double percentil, n::bigint n, min(v) valor, 0.01::double error_rango from u, (select unnest({PERCENTILES}) q) where upto >= greatest(1, ceil(q * n)) group by 1, 2, 3""",
}

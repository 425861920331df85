"""Queries of the analytical surface over whole tables, each beside the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pampero.functions.text import fold_text
from pampero.operators import evaluation as ev, relational as rel, stats as st
from pampero.operators.quality import Check, at_least, report, rows_where, unique_key
from pampero.operators.resolve import NOISE, RESERVE, STAGES, name_tokens, resolve
from pampero.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, bigint: tuple = ()):
    """Registers a query with its SQL; ``bigint`` names counts that DuckDB gives a wider type."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"select * replace ({', '.join(f'{c}::bigint as {c}' for c in bigint)}) from ({sql})" if bigint else sql
        return f

    return add


#: Positions to roles (fixed values).
ROLE_OF = {"Goalkeeper": "Arquero", "Centre-Back": "Defensor central", "Defender": "Defensor central", "Right-Back": "Lateral", "Left-Back": "Lateral", "Defensive Midfield": "Mediocampo defensivo", "Central Midfield": "Mediocampo ofensivo", "Attacking Midfield": "Mediocampo ofensivo", "Right Midfield": "Mediocampo ofensivo", "Left Midfield": "Mediocampo ofensivo", "Midfielder": "Mediocampo ofensivo", "Centre-Forward": "Delantero centro", "Second Striker": "Delantero centro", "Striker": "Delantero centro", "Left Winger": "Delantero extremo", "Right Winger": "Delantero extremo"}
_ROLE_SQL = "case " + " ".join(f"when posicion_tm = '{k}' then '{v}'" for k, v in ROLE_OF.items()) + " end"
_G = "case when not isnan(stat_goals) then stat_goals end"
_year = lambda c="temporada_fichaje": F.substring(c, 1, 4).try_cast("int")
METRICS = ["stat_minutes", "stat_matches", "stat_goals", "stat_assists", "stat_xg", "stat_tackles", "stat_recoveries", "stat_pass_accuracy", "stat_saves"]


def _nn(c: str) -> str:
    return f"case when not isnan({c}) then {c} end"


@query("""with r as (select c_custkey, c_nationkey, row_number() over (order by c_acctbal desc, c_custkey) rk from customer)
select cast(year(o_orderdate) - (month(o_orderdate) < 7)::int as varchar) || '/' || cast(year(o_orderdate) - (month(o_orderdate) < 7)::int + 1 as varchar) temporada, n_name pais,
count(*) n, sum((rk <= 20)::int)::bigint positivos, round(avg((rk <= 20)::int), 6) tasa from orders join r on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2""")
def season_rates(spark, d):
    """Share of top-20 destinations by season and country."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", F.lit(True).alias("top"))
    o = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") - (F.month("o_orderdate") < 7).cast("int")).alias("y"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(top, "c_custkey", "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = rel.flag(F.col("top"))
    return j.groupBy(F.concat_ws("/", F.col("y").cast("string"), (F.col("y") + 1).cast("string")).alias("temporada"), F.col("n_name").alias("pais")).agg(F.count("*").alias("n"), F.count_if(t).alias("positivos"), F.round(F.avg(t.cast("double")), 6).alias("tasa"))


@query("""with l as (select * from uefa where uefa_ranking is not null and actualizacion ~ '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' qualify actualizacion = max(actualizacion) over ()),
k as (select trim(uefa_club_id) club, min(uefa_ranking) rk from l group by 1) select club, rk from k where rk <= 20""")
def top_k_catalogue(spark, d):
    """Clubs of the newest snapshot up to rank 20."""
    u = table(spark, d, "uefa").where(F.col("uefa_ranking").isNotNull() & F.col("actualizacion").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    newest = u.agg(F.max("actualizacion").alias("actualizacion"))
    return u.join(newest, "actualizacion").groupBy(F.trim("uefa_club_id").alias("club")).agg(F.min("uefa_ranking").alias("rk")).where("rk <= 20")


@query("""select 0 orden, 'todos' paso, count(*) filas from plata union all select 1, 'con historial', count(*) from plata where coalesce(tiene_historial, false)
union all select 2, 'operacion conocida', count(*) from plata where coalesce(tiene_historial, false) and coalesce(tipo_operacion <> 'desconocido', false)
union all select 3, 'con edad', count(*) from plata where coalesce(tiene_historial, false) and coalesce(tipo_operacion <> 'desconocido', false) and edad_al_fichaje is not null""")
def waterfall_counts(spark, d):
    return rel.waterfall(table(spark, d, "plata"), [("todos", F.lit(True)), ("con historial", F.col("tiene_historial")), ("operacion conocida", F.col("tipo_operacion") != "desconocido"), ("con edad", F.col("edad_al_fichaje").isNotNull())])


@query("select coalesce(tipo_operacion, 'sin dato') tipo, count(*) n from plata where (tipo_operacion is null or tipo_operacion not in ('fin_de_cesion', 'libre')) and coalesce(tiene_historial, false) group by 1")
def null_safe_exclusion(spark, d):
    """Excluding types keeps rows of unknown type; requiring a flag drops rows where it is unknown."""
    p = table(spark, d, "plata").where(rel.not_in(F.col("tipo_operacion"), ["fin_de_cesion", "libre"]) & rel.flag(F.col("tiene_historial")))
    return p.groupBy(F.coalesce("tipo_operacion", F.lit("sin dato")).alias("tipo")).agg(F.count("*").alias("n"))


@query("select temporada_fichaje temporada, count_if(coalesce(posicion_tm = 'Goalkeeper', false) <> coalesce(altura_cm >= 190, false)) discordes, count(*) n from plata where temporada_fichaje is not null group by 1", bigint=('discordes',))
def xor_mismatch(spark, d):
    a, b = rel.flag(F.col("posicion_tm") == "Goalkeeper"), rel.flag(F.col("altura_cm") >= 190)
    return table(spark, d, "plata").where("temporada_fichaje is not null").groupBy(F.col("temporada_fichaje").alias("temporada")).agg(F.count_if(a != b).alias("discordes"), F.count("*").alias("n"))


@query(f"select coalesce({_ROLE_SQL}, case when posicion_tm is null then 'sin dato' else 'sin rol' end) rol, count(*) n from plata group by 1")
def recode_roles(spark, d):
    p = F.col("posicion_tm")
    return table(spark, d, "plata").groupBy(F.coalesce(rel.recode(p, ROLE_OF), F.when(p.isNull(), "sin dato").otherwise("sin rol")).alias("rol")).agg(F.count("*").alias("n"))


@query("""select case when coste_fichaje_eur >= 10000000 then 'caro' when tipo_operacion like 'cesion%' then 'cesion' when edad_al_fichaje < 21 then 'juvenil' when club_origen_es_filial then 'filial' else 'otro' end clase,
count(*) n, round(avg(es_destino_top_20::int), 6) tasa from plata group by 1""")
def first_match_labels(spark, d):
    c = rel.first_match([(F.col("coste_fichaje_eur") >= 10_000_000, "caro"), (F.col("tipo_operacion").startswith("cesion"), "cesion"), (F.col("edad_al_fichaje") < 21, "juvenil"), (F.col("club_origen_es_filial"), "filial")], "otro")
    return table(spark, d, "plata").groupBy(c.alias("clase")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("es_destino_top_20").cast("double")), 6).alias("tasa"))


@query("""select split_part(o_orderpriority, '-', 1) nivel, starts_with(o_orderpriority, '1') urgente, lower(trim(regexp_replace(o_orderpriority, '^[0-9]-', ''))) etiqueta, count(*) n, min(o_orderstatus || ':' || o_orderpriority) clave from orders group by 1, 2, 3""")
def split_prefix_clean(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").groupBy(F.split_part(p, F.lit("-"), F.lit(1)).alias("nivel"), p.startswith("1").alias("urgente"), F.lower(F.trim(F.regexp_replace(p, "^[0-9]-", ""))).alias("etiqueta")).agg(F.count("*").alias("n"), F.min(F.concat("o_orderstatus", F.lit(":"), p)).alias("clave"))


def amount(text):
    """(number, unit) out of a written amount such as 'x12.50m' or 'x300k', in whole units; null where there is none."""
    t = F.lower(F.trim(text))
    value = F.regexp_extract(t, r"([0-9][0-9.,]*)\s*([mk]?)", 1)
    unit = F.regexp_extract(t, r"([0-9][0-9.,]*)\s*([mk]?)", 2)
    factor = F.when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    return (F.regexp_replace(value, ",", "").try_cast("double") * factor).cast("bigint")


@query("""with t as (select case o_orderkey % 5 when 0 then 'x' || cast(o_orderkey % 90 + 1 as varchar) || '.5m' when 1 then 'x' || cast(o_orderkey % 900 as varchar) || 'k' when 2 then 'free' when 3 then '-' else ' X1,250k ' end s from orders)
select s texto, min(case when regexp_extract(lower(trim(s)), '([0-9][0-9.,]*)\\s*([mk]?)', 1) = '' then null else cast(try_cast(replace(regexp_extract(lower(trim(s)), '([0-9][0-9.,]*)\\s*([mk]?)', 1), ',', '') as double) * case regexp_extract(lower(trim(s)), '([0-9][0-9.,]*)\\s*([mk]?)', 2) when 'm' then 1000000 when 'k' then 1000 else 1 end as bigint) end) importe, count(*) n from t group by 1""")
def amount_parse(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 0, F.concat(F.lit("x"), (k % 90 + 1).cast("string"), F.lit(".5m"))).when(k % 5 == 1, F.concat(F.lit("x"), (k % 900).cast("string"), F.lit("k"))).when(k % 5 == 2, "free").when(k % 5 == 3, "-").otherwise(" X1,250k ")
    return table(spark, d, "orders").select(s.alias("texto")).groupBy("texto").agg(F.count("*").alias("n")).withColumn("importe", amount(F.col("texto")))


@query(f"select coalesce(regexp_matches(club_origen, '{RESERVE}'), false) filial, count(*) n, count(distinct club_origen) clubes from plata group by 1")
def reserve_regex(spark, d):
    return table(spark, d, "plata").groupBy(rel.flag(F.col("club_origen").rlike(RESERVE)).alias("filial")).agg(F.count("*").alias("n"), F.count_distinct("club_origen").alias("clubes"))


@query("""with a as (select archivo_id, regexp_extract_all(html, '/spieler/([0-9]+)', 1) l from bronce where html is not null), i as (select archivo_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:120] ids from a)
select archivo_id, len(ids)::int jugadores, substr(sha256(array_to_string(ids, ',')), 1, 16) huella from i""")
def latest_fingerprint(spark, d):
    """A page's fingerprint by the first distinct ids in it, in the page's order."""
    ids = F.slice(F.array_distinct(F.regexp_extract_all("html", F.lit("/spieler/([0-9]+)"), F.lit(1))), 1, 120)
    return table(spark, d, "bronce").where("html is not null").select("archivo_id", F.size(ids).alias("jugadores"), F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 16).alias("huella"))


@query()
def html_arrivals(spark, d):
    """Every arrival row of every page with its fields."""
    from pampero.streaming.compactor import parsed_pages

    return parsed_pages(table(spark, d, "bronce"))


@query("select event_type, cast(json_extract_string(props, '$.k') as bigint) k, count(*) n from events group by 1, 2")
def json_flatten(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("""select user_id, round(sum(case when event_type = 'click' then value end), 4) clicks, round(avg(case when event_type = 'view' then value end), 6) vistas, round(sum(case when event_type = 'purchase' then value end), 4) compras, count(*) n from events group by 1""")
def metric_consolidate(spark, d):
    """Totals of some metrics and means of others, long to wide with a fixed list."""
    e = table(spark, d, "events")
    v = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return e.groupBy("user_id").agg(F.round(F.sum(v("click")), 4).alias("clicks"), F.round(F.avg(v("view")), 6).alias("vistas"), F.round(F.sum(v("purchase")), 4).alias("compras"), F.count("*").alias("n"))


_FOLD_SQL = "lower(strip_accents({0}))"
for _a, _b in (("ø", "o"), ("đ", "d"), ("ł", "l"), ("ß", "ss"), ("æ", "ae"), ("ı", "i"), ("þ", "th"), ("ð", "d"), ("œ", "oe")):
    _FOLD_SQL = f"replace({_FOLD_SQL}, '{_a}', '{_b}')"
_TOKENS_SQL = "list_filter(string_split(trim(regexp_replace(regexp_replace(" + _FOLD_SQL + r", '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '' and t not in (" + ", ".join(f"'{n}'" for n in NOISE) + "))"


@query(f"select array_to_string({_TOKENS_SQL.format('club_origen')}, ' ') clave, count(*) n, count(distinct club_origen) formas from plata where club_origen is not null group by 1")
def normalise_tokens(spark, d):
    p = table(spark, d, "plata").where("club_origen is not null").groupBy("club_origen").agg(F.count("*").alias("n"))
    return p.groupBy(F.array_join(name_tokens(fold_text(F.col("club_origen"))), " ").alias("clave")).agg(F.sum("n").alias("n"), F.count("*").alias("formas"))


def _resolver(spark, d, more: dict | None = None):
    """(names, aliases) of the resolver; ``more`` are aggregates of all rows of a name's id, made in the same pass."""
    p, u = table(spark, d, "plata"), table(spark, d, "uefa")
    p = p.where("club_origen_id is not null")
    names = p.groupBy(F.col("club_origen_id").alias("id")).agg(F.min("club_origen").alias("n"), F.min(F.when(F.col("club_origen").isNotNull(), F.col("club_origen_pais"))).alias("c"), *[v.alias(k) for k, v in (more or {}).items()]).where("n is not null")
    names = names.select("id", fold_text(F.col("c")).alias("block"), name_tokens(fold_text(F.col("n"))).alias("tokens"), *(more or {}))
    forms = u.select(F.col("uefa_pais").alias("c"), F.trim("uefa_club_id").alias("destino"), F.explode(F.array("uefa_nombre", "uefa_nombre_oficial", "uefa_nombre_internacional", "uefa_nombre_corto")).alias("n")).where("n is not null").distinct()
    aliases = forms.select("destino", F.lit(0).alias("pos"), fold_text(F.col("c")).alias("block"), name_tokens(fold_text(F.col("n"))).alias("tokens"))
    return names, aliases


@query(f"""with n as (select club_origen_id id, min(club_origen) n, min(club_origen_pais) c from plata where club_origen_id is not null and club_origen is not null group by 1),
a as (select distinct uefa_pais c, trim(uefa_club_id) destino, unnest([uefa_nombre, uefa_nombre_oficial, uefa_nombre_internacional, uefa_nombre_corto]) n from uefa),
nk as (select id, {_FOLD_SQL.format('c')} b, array_to_string({_TOKENS_SQL.format('n')}, ' ') k from n), ak as (select destino, {_FOLD_SQL.format('c')} b, array_to_string({_TOKENS_SQL.format('n')}, ' ') k from a where n is not null)
select id, min(destino) destino from nk join ak on nk.k = ak.k and nk.b = ak.b where nk.k <> '' group by 1""")
def resolve_exact(spark, d):
    """The exact stage of the resolver within a country."""
    names, aliases = (written(df, "exact") for df in _resolver(spark, d))
    return resolve(names.where("block is not null"), aliases, stages=STAGES[:1]).where("metodo = 'exacto'").join(aliases.select("block").distinct().join(names, "block").select("id"), "id", "left_semi").select("id", "destino")


@query()
def resolve_cascade(spark, d):
    """All stages: who was found, by which method."""
    return resolve(*(written(df, "cascade") for df in _resolver(spark, d)))


@query("""select n_nationkey pais, s_suppkey proveedor, c_custkey elegido from (select n_nationkey, s_suppkey, c_custkey, row_number() over (partition by n_nationkey, s_suppkey order by case when c_mktsegment = 'BUILDING' then 3 when c_acctbal > 5000 then 2 else 0 end desc, c_acctbal desc, c_custkey) r
from nation join supplier on s_nationkey = n_nationkey join customer on c_nationkey = n_nationkey) where r = 1""")
def homonym_pick(spark, d):
    """The best of several candidates by points, then score, then id; scored before the join, so no candidate pairs are made."""
    c = table(spark, d, "customer").withColumn("p", F.when(F.col("c_mktsegment") == "BUILDING", 3).when(F.col("c_acctbal") > 5000, 2).otherwise(0))
    best = c.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("p", "c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("elegido"))
    return table(spark, d, "supplier").join(best, F.col("s_nationkey") == F.col("c_nationkey")).select(F.col("s_nationkey").alias("pais"), F.col("s_suppkey").alias("proveedor"), "elegido")


@query("""with e as (select user_id, date_trunc('day', ts)::date dia, count(*) n from events group by 1, 2), f as (select user_id, sum(n)::bigint n, min(dia) d0 from e group by 1)
select o_orderkey, coalesce(nullif(c_name, ''), cast(o_custkey as varchar)) nombre, f.n is not null con_historial, coalesce(f.n, 0) eventos from orders left join customer on o_custkey = c_custkey left join f on f.user_id = o_custkey""")
def left_enrich(spark, d):
    f = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").join(f, F.col("o_custkey") == F.col("user_id"), "left")
    return o.select("o_orderkey", F.coalesce(F.nullif("c_name", F.lit("")), F.col("o_custkey").cast("string")).alias("nombre"), F.col("n").isNotNull().alias("con_historial"), F.coalesce("n", F.lit(0)).alias("eventos"))


@query("""with a as (select jugador_tm_id j, club_destino_id c, substr(temporada_fichaje, 1, 4)::int t from plata where jugador_tm_id is not null and club_destino_id is not null),
s as (select jugador_tm_id j, club_origen_id c, substr(temporada_fichaje, 1, 4)::int t from plata where jugador_tm_id is not null and club_origen_id is not null),
x as (select a.j, a.c, a.t, count(s.t) later from (select a.*, row_number() over () r from a) a left join s on s.j = a.j and s.c = a.c and s.t > a.t group by a.j, a.c, a.t, a.r)
select t temporada, count(*) n, count_if(later > 0) salieron, sum(later)::bigint salidas from x where t < (select max(t) from a) group by 1""", bigint=('salieron',))
def later_departure(spark, d):
    """Arrivals by season that were followed by a departure from the same club; the last season is left out."""
    p = table(spark, d, "plata")
    a = p.select(F.col("jugador_tm_id").alias("j"), F.col("club_destino_id").alias("c"), _year().alias("t")).where("j is not null and c is not null and t is not null")
    s = p.select(F.col("jugador_tm_id").alias("j"), F.col("club_origen_id").alias("c"), _year().alias("t")).where("j is not null and c is not null and t is not null")
    last = a.agg(F.max("t").alias("m"))
    got = rel.later_events(a, s, ["j", "c"], "t").groupBy(F.col("t").alias("temporada")).agg(F.count("*").alias("n"), F.count_if(F.col("later") > 0).alias("salieron"), F.sum("later").alias("salidas"))
    return got.join(last, F.col("temporada") < F.col("m")).select("temporada", "n", "salieron", "salidas")


@query("""select 'con pedido F' grupo, count(*) n from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') union all select 'sin pedido F', count(*) from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("n")).select(F.lit("con pedido F").alias("grupo"), "n").unionByName(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("sin pedido F").alias("grupo"), "n"))


@query("""select operacion_id, jugador_tm_id, club_destino_id, coste_fichaje_eur, edad_al_fichaje from (select *, row_number() over (partition by operacion_id order by extraido_el desc nulls last, coste_fichaje_eur desc nulls last, edad_al_fichaje desc nulls last, jugador_tm_id desc nulls last, club_destino_id desc nulls last) r from plata) where r = 1""")
def dedupe_keep_last(spark, d):
    p = table(spark, d, "plata").select("operacion_id", "jugador_tm_id", "club_destino_id", "coste_fichaje_eur", "edad_al_fichaje", "extraido_el")
    return rel.keep_one(p, ["operacion_id"], [F.col(c) for c in ("extraido_el", "coste_fichaje_eur", "edad_al_fichaje", "jugador_tm_id", "club_destino_id")]).drop("extraido_el")


@query("""select jugador_tm_id, string_agg(t || ' ' || c, ' · ' order by t, c) historia, bool_or(top) alguna_top from (select distinct jugador_tm_id, temporada_fichaje t, club_destino_id c, es_destino_top_20 top from plata where jugador_tm_id is not null and temporada_fichaje is not null and club_destino_id is not null) group by 1""")
def string_agg_history(spark, d):
    p = table(spark, d, "plata").where("jugador_tm_id is not null and temporada_fichaje is not null and club_destino_id is not null").select("jugador_tm_id", F.col("temporada_fichaje").alias("t"), F.col("club_destino_id").alias("c"), F.col("es_destino_top_20").alias("top")).distinct()
    rows = F.array_sort(F.collect_list(F.struct("t", "c")))
    return p.groupBy("jugador_tm_id").agg(F.array_join(F.transform(rows, lambda s: F.concat_ws(" ", s["t"], s["c"])), " · ").alias("historia"), F.bool_or("top").alias("alguna_top"))


@query("""select club_destino_id club, max_by(altura_cm, (extraido_el, operacion_id, altura_cm)) altura, count(altura_cm) con_altura from plata where club_destino_id is not null and altura_cm is not null group by 1""")
def latest_value_per_group(spark, d):
    p = table(spark, d, "plata").where("club_destino_id is not null and altura_cm is not null")
    return p.groupBy(F.col("club_destino_id").alias("club")).agg(F.max_by("altura_cm", F.struct("extraido_el", "operacion_id", "altura_cm")).alias("altura"), F.count("altura_cm").alias("con_altura"))


def _cov(c: str, by: str = "", where: str = "") -> str:
    return f"select {by}'{c}' columna, count(*) filter (where {c} is not null and not isnan({c})) no_nulos, round(count(*) filter (where {c} is not null and not isnan({c})) / count(*), 6) cobertura, count(*) filter (where {c} = 0) ceros from modelo{where}"


@query(" union all ".join(_cov(c) for c in METRICS), bigint=('ceros', 'no_nulos'))
def coverage_profile(spark, d):
    return rel.coverage(table(spark, d, "modelo"), METRICS)


@query(" union all ".join(_cov(c, "temporada_fichaje, ") + " group by 1" for c in METRICS), bigint=('ceros', 'no_nulos'))
def coverage_by_group(spark, d):
    return rel.coverage(table(spark, d, "modelo"), METRICS, ["temporada_fichaje"])


@query("select posicion_tm valor, count(*) n, round(count(*) / sum(count(*)) over (), 6) proporcion from plata where posicion_tm is not null group by 1")
def value_counts_share(spark, d):
    return rel.value_counts(table(spark, d, "plata"), "posicion_tm")


@query("select coalesce(pie, 'sin dato') pie, count_if(es_destino_top_20) top, count_if(not es_destino_top_20) resto from plata group by 1", bigint=('top', 'resto'))
def aligned_counts(spark, d):
    return table(spark, d, "plata").groupBy(F.coalesce("pie", F.lit("sin dato")).alias("pie")).agg(F.count_if("es_destino_top_20").alias("top"), F.count_if(~F.col("es_destino_top_20")).alias("resto"))


@query("""select count(*) n, count_if(tiene_historial) n_hist, round(avg(edad_al_fichaje), 6) edad, round(avg(edad_al_fichaje) filter (tiene_historial), 6) edad_hist, round(avg((coalesce(club_origen_es_europeo, false) = coalesce(traspaso_domestico, false))::int), 6) acuerdo, count(distinct jugador_tm_id) jugadores from plata""", bigint=('n_hist',))
def population_compare(spark, d):
    p, h = table(spark, d, "plata"), F.col("tiene_historial")
    same = (rel.flag(F.col("club_origen_es_europeo")) == rel.flag(F.col("traspaso_domestico"))).cast("double")
    return p.agg(F.count("*").alias("n"), F.count_if(h).alias("n_hist"), F.round(F.avg("edad_al_fichaje"), 6).alias("edad"), F.round(F.avg(F.when(h, F.col("edad_al_fichaje"))), 6).alias("edad_hist"), F.round(F.avg(same), 6).alias("acuerdo"), F.count_distinct("jugador_tm_id").alias("jugadores"))


@query(" union all ".join(f"select '{c}' columna, round(skewness({_nn(c)}), 5) asimetria, round(skewness(ln(1 + {_nn(c)})), 5) asimetria_log from modelo where {_nn(c)} >= 0" for c in ("stat_minutes", "stat_goals", "stat_assists", "stat_xg")))
def skewness_ranked(spark, d):
    m = table(spark, d, "modelo")
    cs = ("stat_minutes", "stat_goals", "stat_assists", "stat_xg")
    ok = {c: F.when(st.number(c) >= 0, st.number(c)) for c in cs}
    row = m.agg(*[f.alias(f"{p}{i}") for i, c in enumerate(cs) for p, f in (("a", st.skew_corrected(ok[c])), ("l", st.skew_corrected(F.log1p(ok[c]))))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.round(f"a{i}", 5).alias("asimetria"), F.round(f"l{i}", 5).alias("asimetria_log")) for i, c in enumerate(cs)])).alias("x")).select("x.*")


@query("""with p as (select stat_minutes x, stat_matches y from modelo where not isnan(stat_minutes) and not isnan(stat_matches)),
r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from p)
select round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman, count(*) n from r""")
def pearson_spearman(spark, d):
    p = table(spark, d, "modelo").select(st.number("stat_minutes").alias("x"), st.number("stat_matches").alias("y")).where("x is not null and y is not null")
    r = st.ranked(st.ranked(p, "x", "rx"), "y", "ry")
    return r.agg(F.round(st.corr(F.col("x"), F.col("y")), 6).alias("pearson"), F.round(st.corr(F.col("rx"), F.col("ry")), 6).alias("spearman"), F.count("*").alias("n"))


_SEP = "case when least(count(v) filter (t), count(v) filter (not t)) >= 10 then abs(avg(v) filter (t) - avg(v) filter (not t)) / sqrt((var_samp(v) filter (t) + var_samp(v) filter (not t)) / 2) end"


@query(f"select round({_SEP}, 6) separacion, case when abs({_SEP}) >= 0.8 then 'alto' when abs({_SEP}) >= 0.2 then 'medio' else 'bajo' end zona from (select club_origen_pais_coeficiente_uefa v, es_destino_top_20 t from modelo where club_origen_pais_coeficiente_uefa is not null and not isnan(club_origen_pais_coeficiente_uefa))")
def cohen_separation(spark, d):
    s = st.separation(st.number("club_origen_pais_coeficiente_uefa"), F.col("es_destino_top_20"))
    return table(spark, d, "modelo").agg(s.alias("s")).select(F.round("s", 6).alias("separacion"), st.zone(F.col("s"), 0.2, 0.8).alias("zona"))


@query(f"select g rol, round({_SEP}, 6) separacion, count(*) n from (select grupo_posicion g, stat_minutes v, es_destino_top_20 t from modelo where not isnan(stat_minutes) and grupo_posicion is not null) group by 1")
def cohen_by_group(spark, d):
    m = table(spark, d, "modelo").where("grupo_posicion is not null").withColumn("v", st.number("stat_minutes")).where("v is not null")
    return m.groupBy(F.col("grupo_posicion").alias("rol")).agg(F.round(st.separation(F.col("v"), F.col("es_destino_top_20")), 6).alias("separacion"), F.count("*").alias("n"))


@query("""with b as (select stat_tackles v, grupo_posicion g from modelo where not isnan(stat_tackles) and grupo_posicion is not null), m as (select v, avg(v) over (partition by g) m, avg(v) over () t from b)
select round(sum((m - t) * (m - t)) / sum((v - t) * (v - t)), 6) eta2, count(*) n from m""")
def eta_squared(spark, d):
    return st.eta_squared(table(spark, d, "modelo"), st.number("stat_tackles"), "grupo_posicion")


@query(f"""with z as (select grupo_posicion g, ({_nn('stat_minutes')} - avg({_nn('stat_minutes')}) over w) / nullif(stddev_samp({_nn('stat_minutes')}) over w, 0) z from modelo window w as (partition by grupo_posicion))
select g rol, count(z) n, round(sum(abs(z)), 3) suma_abs, round(max(z), 6) mayor from z where g is not null group by 1""")
def zscore_by_group(spark, d):
    m = table(spark, d, "modelo").where("grupo_posicion is not null").select("grupo_posicion", st.number("stat_minutes").alias("v"))
    return st.zscores(m, {"z": F.col("v")}, ["grupo_posicion"]).groupBy(F.col("grupo_posicion").alias("rol")).agg(F.count("z").alias("n"), F.round(F.sum(F.abs("z")), 3).alias("suma_abs"), F.round(F.max("z"), 6).alias("mayor"))


_ZC = ["stat_minutes", "stat_goals", "stat_assists", "stat_tackles"]


@query("with z as (select operacion_id, " + ", ".join(f"({_nn(c)} - avg({_nn(c)}) over w) / nullif(stddev_samp({_nn(c)}) over w, 0) z{i}" for i, c in enumerate(_ZC)) + " from modelo where grupo_posicion is not null window w as (partition by grupo_posicion)) select operacion_id, round(list_avg([x for x in [z0, z1, z2, z3] if x is not null]), 5) puntaje from z")
def role_score(spark, d):
    """Mean of the scores that a row has within its role."""
    m = table(spark, d, "modelo").where("grupo_posicion is not null").select("operacion_id", "grupo_posicion", *[st.number(c).alias(c) for c in _ZC])
    z = st.zscores(m, {f"z_{c}": F.col(c) for c in _ZC}, ["grupo_posicion"])
    return z.select("operacion_id", F.round(st.row_mean([F.col(f"z_{c}") for c in _ZC]), 5).alias("puntaje"))


@query("select n_name pais, rank() over (order by round(avg(o_totalprice), 4) desc)::int puesto, round(avg(o_totalprice), 4) media from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def rank_min_desc(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("pais")).agg(F.round(F.avg("o_totalprice"), 4).alias("media")).withColumn("puesto", F.rank().over(Window.orderBy(F.desc("media"))))


@query("""with b as (select club_origen_pais_coeficiente_uefa c, stat_minutes v, es_destino_top_20 t from modelo where club_origen_pais_coeficiente_uefa is not null and not isnan(club_origen_pais_coeficiente_uefa) and not isnan(stat_minutes)),
e as (select quantile_cont(c, 1/3.0) c1, quantile_cont(c, 2/3.0) c2, quantile_cont(v, 1/3.0) v1, quantile_cont(v, 2/3.0) v2 from b)
select case when c <= c1 then 'bajo' when c <= c2 then 'medio' else 'alto' end origen, case when v <= v1 then 'bajo' when v <= v2 then 'medio' else 'alto' end rendimiento, count(*) n, round(avg(t::int), 6) tasa from b, e group by 1, 2""")
def qcut_crosstab(spark, d):
    b = table(spark, d, "modelo").select(st.number("club_origen_pais_coeficiente_uefa").alias("c"), st.number("stat_minutes").alias("v"), F.col("es_destino_top_20").cast("double").alias("t")).where("c is not null and v is not null")
    q = st.quantile_bins(st.quantile_bins(b, "c", ["bajo", "medio", "alto"], "origen"), "v", ["bajo", "medio", "alto"], "rendimiento")
    return q.groupBy("origen", "rendimiento").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("tasa"))


@query("select case when edad_al_fichaje > 15 and edad_al_fichaje <= 19 then '16-19' when edad_al_fichaje > 19 and edad_al_fichaje <= 23 then '20-23' when edad_al_fichaje > 23 and edad_al_fichaje <= 27 then '24-27' when edad_al_fichaje > 27 and edad_al_fichaje <= 45 then '28+' end tramo, count(*) n, round(avg(es_destino_top_20::int), 6) tasa from modelo group by 1")
def cut_right_closed(spark, d):
    t = st.cut(F.col("edad_al_fichaje"), [15, 19, 23, 27, 45], ["16-19", "20-23", "24-27", "28+"])
    return table(spark, d, "modelo").groupBy(t.alias("tramo")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("es_destino_top_20").cast("double")), 6).alias("tasa"))


@query("select least(floor(stat_minutes / 250), 15)::int bin, count(*) n, round(count(*) / sum(count(*)) over () / 250, 9) densidad from modelo where stat_minutes between 0 and 4000 group by 1")
def hist_density(spark, d):
    return st.histogram(table(spark, d, "modelo").where(~F.isnan("stat_minutes")), F.col("stat_minutes"), 0.0, 4000.0, 16)


@query("select rol, q, round(v, 6) valor from (select grupo_posicion rol, unnest(range(11)) q, unnest(quantile_cont(stat_minutes, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) v from modelo where not isnan(stat_minutes) and grupo_posicion is not null group by 1)")
def quantile_table(spark, d):
    q = st.quantiles(table(spark, d, "modelo").where("grupo_posicion is not null"), ["grupo_posicion"], F.col("stat_minutes"), [i / 10 for i in range(11)])
    return q.select(F.col("grupo_posicion").alias("rol"), F.round(F.col("q") * 10).cast("bigint").alias("q"), F.round("valor", 6).alias("valor"))


@query("""with t as (select quantile_cont(c_acctbal, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) q from customer), x as (select s_suppkey, s_acctbal x, q, len([v for v in q if v <= s_acctbal]) b from supplier, t)
select s_suppkey, round(case when x <= q[1] then 0 when b >= 11 then 100 else (b - 1 + (x - q[b]) / (q[b + 1] - q[b])) * 10 end, 4) percentil from x""")
def percentile_of_score(spark, d):
    q = st.quantiles(table(spark, d, "customer"), [], F.col("c_acctbal"), [i / 10 for i in range(11)]).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "valor"))), lambda x: x["valor"]).alias("q"))
    return st.one_row(table(spark, d, "supplier"), q).select("s_suppkey", F.round(st.percentile_of(F.col("q"), F.col("s_acctbal")), 4).alias("percentil"))


@query("unpivot (select operacion_id, stat_goals, stat_assists, stat_matches from modelo) on stat_goals, stat_assists, stat_matches into name metrica value valor")
def unpivot_long(spark, d):
    m = table(spark, d, "modelo").select("operacion_id", "stat_goals", "stat_assists", "stat_matches")
    return m.unpivot(["operacion_id"], ["stat_goals", "stat_assists", "stat_matches"], "metrica", "valor").where("valor is not null")


@query("select temporada_fichaje, count_if(tipo_operacion = 'compra') compra, count_if(tipo_operacion = 'libre') libre, count_if(tipo_operacion = 'cesion') cesion from plata where temporada_fichaje is not null and tipo_operacion in ('compra', 'libre', 'cesion') group by 1", bigint=('cesion', 'compra', 'libre'))
def pivot_wide(spark, d):
    p = table(spark, d, "plata").where("temporada_fichaje is not null and tipo_operacion in ('compra', 'libre', 'cesion')")
    return p.groupBy("temporada_fichaje").pivot("tipo_operacion", ["compra", "libre", "cesion"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""select 'caso' tipo, p_type grupo, p_partkey::varchar clave, round(p_retailprice, 4) precio from part where p_partkey in (1, 7, 20) union all select 'mediana', p_type, null, round(median(p_retailprice), 4) from part group by 2""")
def union_reference_rows(spark, d):
    p = table(spark, d, "part")
    cases = p.where(F.col("p_partkey").isin(1, 7, 20)).select(F.lit("caso").alias("tipo"), F.col("p_type").alias("grupo"), F.col("p_partkey").cast("string").alias("clave"), F.round("p_retailprice", 4).alias("precio"))
    middle = st.quantiles(p, ["p_type"], F.col("p_retailprice"), [0.5]).select(F.col("p_type").alias("grupo"), F.round("valor", 4).alias("precio"), F.lit("mediana").alias("tipo"))
    return cases.unionByName(middle, allowMissingColumns=True)


@query("""with c as (select p_type t, count(*) n from part group by 1), o as (select unnest(['A', 'B', 'PROMO', 'STANDARD', 'ECONOMY']) nivel)
select nivel, coalesce(n, 0) n, (select max(n) from c where t <> nivel) mayor_otro, (select min(n) from c) minimo from o left join c on t = nivel""")
def runner_up_and_bounds(spark, d):
    """A fixed list of levels with gaps filled, the greatest count of any other level, and the bounds."""
    levels = ["A", "B", "PROMO", "STANDARD", "ECONOMY"]
    c = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    best = c.agg(F.max_by("p_type", F.struct("n", "p_type")).alias("t"), F.max("n").alias("m"), F.min("n").alias("minimo"))
    rest = st.one_row(c, best).where("p_type <> t").agg(F.max("n").alias("m2"))
    base = st.one_row(st.one_row(spark.createDataFrame([(v,) for v in levels], "nivel string"), best), rest)
    other = F.when(F.col("nivel") == F.col("t"), F.col("m2")).otherwise(F.col("m"))
    return base.join(c, base.nivel == c.p_type, "left").select("nivel", F.coalesce("n", F.lit(0)).alias("n"), other.alias("mayor_otro"), "minimo")


_FOLD = "(('0x' || substr(md5(cast({0} as varchar)), 1, 8))::bigint % 5)"


@query(f"select {_FOLD.format('jugador_tm_id')} pliegue, count(*) n, count(distinct jugador_tm_id) jugadores, round(avg(es_destino_top_20::int), 6) tasa from modelo where jugador_tm_id is not null group by 1")
def split_balance(spark, d):
    m = table(spark, d, "modelo").where("jugador_tm_id is not null")
    return m.groupBy(ev.fold_of(F.col("jugador_tm_id"), 5).alias("pliegue")).agg(F.count("*").alias("n"), F.count_distinct("jugador_tm_id").alias("jugadores"), F.round(F.avg(F.col("es_destino_top_20").cast("double")), 6).alias("tasa"))


@query("with c as (select club_origen_liga_id l, count(*) n from plata where club_origen_liga_id is not null group by 1) select case when n < 40 then 'otras' else l end liga, sum(n)::bigint n, count(*) categorias from c group by 1")
def one_hot_infrequent(spark, d):
    c = table(spark, d, "plata").where("club_origen_liga_id is not null").groupBy("club_origen_liga_id").agg(F.count("*").alias("n"))
    return c.groupBy(F.when(F.col("n") < 40, "otras").otherwise(F.col("club_origen_liga_id")).alias("liga")).agg(F.sum("n").alias("n"), F.count("*").alias("categorias"))


@query("""with l as (select operacion_id, ln(1 + club_origen_pais_coeficiente_uefa) v, (club_origen_pais_coeficiente_uefa is null)::int f from modelo), s as (select avg(coalesce(v, 0)) m, stddev_pop(coalesce(v, 0)) s from l)
select operacion_id, round((coalesce(v, 0) - m) / s, 6) v, f falta from l, s""")
def impute_indicator(spark, d):
    """Log scale, constant for missing with an indicator, scaled by mean and population deviation."""
    l = table(spark, d, "modelo").select("operacion_id", F.log1p("club_origen_pais_coeficiente_uefa").alias("v"))
    s = l.agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("m"), F.stddev_pop(F.coalesce("v", F.lit(0.0))).alias("s"))
    return st.one_row(l, s).select("operacion_id", F.round((F.coalesce("v", F.lit(0.0)) - F.col("m")) / F.col("s"), 6).alias("v"), F.col("v").isNull().cast("int").alias("falta"))


_THR = [0.1, 0.3, 0.5, 0.7]
_SCORE = "(least(stat_minutes, 3600) / 3600)"
_SCORED = f"(select jugador_tm_id j, es_destino_top_20 t, {_SCORE} s, {_FOLD.format('jugador_tm_id')} f, coalesce(grupo_posicion, 'sin dato') g from modelo where not isnan(stat_minutes) and jugador_tm_id is not null)"


def _scored(spark, d):
    m = table(spark, d, "modelo").where(F.col("stat_minutes").isNotNull() & ~F.isnan("stat_minutes") & F.col("jugador_tm_id").isNotNull())
    return m.select(F.col("jugador_tm_id").alias("j"), F.col("es_destino_top_20").alias("t"), (F.least("stat_minutes", F.lit(3600.0)) / 3600).alias("s"), ev.fold_of(F.col("jugador_tm_id"), 5).alias("f"), F.coalesce("grupo_posicion", F.lit("sin dato")).alias("g"))


@query(f"""with k as (select f, u umbral, count_if(t and s >= u)::double tp, count_if(not t and s >= u)::double fp, count_if(t and s < u)::double fn, count_if(not t and s < u)::double tn from {_SCORED}, (select unnest([0.1::double, 0.3, 0.5, 0.7]) u) group by 1, 2),
m as (select umbral, case when tp + fp = 0 then 0 else tp / (tp + fp) end p, case when tp + fn = 0 then 0 else tp / (tp + fn) end r, (tp + tn) / (tp + fp + fn + tn) a, (case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end + case when 2 * tn + fp + fn = 0 then 0 else 2 * tn / (2 * tn + fp + fn) end) / 2 f1 from k)
select umbral, round(avg(p), 6) precision_media, round(avg(r), 6) recall_media, round(avg(a), 6) accuracy_media, round(avg(f1), 6) f1_macro_media, round(stddev_pop(p), 6) precision_desvio, round(stddev_pop(r), 6) recall_desvio, round(stddev_pop(a), 6) accuracy_desvio, round(stddev_pop(f1), 6) f1_macro_desvio from m group by 1""")
def threshold_sweep(spark, d):
    s = ev.threshold_sweep(_scored(spark, d), "t", "s", "f", _THR)
    return s.select("umbral", *[F.round(c, 6).alias(c) for c in s.columns if c != "umbral"])


@query(f"""with k as (select t "real", s >= 0.5 prediccion, count(*) n from {_SCORED} group by 1, 2) select "real", prediccion, n, round(n / sum(n) over (partition by "real"), 6) por_real, round(n / sum(n) over (partition by prediccion), 6) por_prediccion from k""")
def confusion_matrix(spark, d):
    k = _scored(spark, d).groupBy(F.col("t").alias("real"), (F.col("s") >= 0.5).alias("prediccion")).agg(F.count("*").alias("n"))
    return k.withColumn("por_real", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("real")), 6)).withColumn("por_prediccion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prediccion")), 6))


@query(f"""with k as (select s, count_if(t) p, count_if(not t) n from {_SCORED} group by 1), c as (select p, n, sum(p) over (order by s desc) tp, sum(n) over (order by s desc) fp, sum(p) over () pp from k) select round(sum(p / pp * tp / (tp + fp)), 6) precision_media from c""")
def average_precision(spark, d):
    return ev.average_precision(ev.curve(_scored(spark, d), "t", "s"))


@query(f"""with r as (select t, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 r from {_SCORED}) select round((sum(r) filter (t) - count_if(t) * (count_if(t) + 1) / 2.0) / (count_if(t) * count_if(not t)::double), 6) auc from r""")
def roc_auc(spark, d):
    return ev.roc_auc(ev.curve(_scored(spark, d), "t", "s"))


@query(f"""select g nivel, count(*) n, round(avg(t::int), 6) tasa_real, round(avg(s), 6) puntaje_medio, count(*) < 20 muestra_chica from {_SCORED} group by 1""")
def level_reading(spark, d):
    return _scored(spark, d).groupBy(F.col("g").alias("nivel")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("t").cast("double")), 6).alias("tasa_real"), F.round(F.avg("s"), 6).alias("puntaje_medio"), (F.count("*") < 20).alias("muestra_chica"))


@query("""with b as (select o_orderkey k, o_totalprice x, o_orderstatus y, ('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint % 64 g from orders), o as (select k, first_value(x) over (partition by g order by k) fx, lag(x) over (partition by g order by k) px, lag(y) over (partition by g order by k) py, last_value(x) over (partition by g order by k rows between unbounded preceding and unbounded following) lx, last_value(y) over (partition by g order by k rows between unbounded preceding and unbounded following) ly, row_number() over (partition by g order by k) r, x, y from b),
s as (select x, case when r = 1 then lx else px end x2 from o) select round(avg(x), 4) media, round(avg(x2), 4) media_permutada, round(corr(x, x2), 6) correlacion from s""")
def block_importance(spark, d):
    """A block of columns moved along together: the same values, no longer tied to their rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    s = ev.shifted_block(o, "o_orderkey", ["o_totalprice", "o_orderstatus"], -1)
    j = o.select("o_orderkey", F.col("o_totalprice").alias("x")).join(s.select("o_orderkey", F.col("o_totalprice").alias("x2")), "o_orderkey")
    return j.agg(F.round(F.avg("x"), 4).alias("media"), F.round(F.avg("x2"), 4).alias("media_permutada"), F.round(st.corr(F.col("x"), F.col("x2")), 6).alias("correlacion"))


def silver_checks() -> list[Check]:
    """The gate of the consolidated table."""
    must = ["operacion_id", "jugador_tm_id", "temporada_fichaje", "nombre", "club_destino", "es_destino_top_20", "tipo_operacion"]
    return [unique_key("operacion_id"), at_least("filas_minimas", F.count("*"), 1000), *[rows_where(f"obligatoria:{c}", F.col(c).isNull()) for c in must], rows_where("edad", ~F.col("edad_al_fichaje").between(14, 45)), rows_where("altura", ~F.col("altura_cm").between(140, 220)), rows_where("coste", F.col("coste_fichaje_eur") < 0), rows_where("tipo_excluido", F.col("tipo_operacion") == "fin_de_cesion"), rows_where("historial_sin_metricas", F.col("tiene_historial") & F.coalesce(*[F.col(c) for c in ("stat_minutes", "stat_matches", "stat_goals", "stat_assists", "stat_rating")]).isNull())]


@query("""select 'clave_unica:operacion_id' control, count(*) - count(distinct coalesce(operacion_id, chr(0))) violaciones from plata union all select 'filas_minimas', greatest(1000 - count(*), 0) from plata
""" + "".join(f"union all select 'obligatoria:{c}', count_if({c} is null) from plata " for c in ("operacion_id", "jugador_tm_id", "temporada_fichaje", "nombre", "club_destino", "es_destino_top_20", "tipo_operacion")) + """union all select 'edad', count_if(edad_al_fichaje not between 14 and 45) from plata union all select 'altura', count_if(altura_cm not between 140 and 220) from plata union all select 'coste', count_if(coste_fichaje_eur < 0) from plata union all select 'tipo_excluido', count_if(tipo_operacion = 'fin_de_cesion') from plata
union all select 'historial_sin_metricas', count_if(tiene_historial and coalesce(stat_minutes, stat_matches, stat_goals, stat_assists, stat_rating) is null) from plata""", bigint=('violaciones',))
def quality_report(spark, d):
    return report(table(spark, d, "plata"), silver_checks())


@query("""with h as (select split_part(ruta_tm_altas, '/altas/', 2) r, html, sha256(coalesce(html, '')) h, archivo_id from bronce), k as (select regexp_extract(r, 'club=([0-9]+)', 1) club, regexp_extract(r, 'temporada=([0-9]+)', 1) temporada, h, count(*) n from h group by 1, 2, 3)
select club, temporada, count(*) contenidos, sum(n)::bigint entregas, sum(n - 1)::bigint repetidas from k group by 1, 2""")
def freshness_skip(spark, d):
    """Deliveries of each partition by content: how many were new, how many could be skipped."""
    r = F.split_part("ruta_tm_altas", F.lit("/altas/"), F.lit(2))
    k = table(spark, d, "bronce").groupBy(F.regexp_extract(r, "club=([0-9]+)", 1).alias("club"), F.regexp_extract(r, "temporada=([0-9]+)", 1).alias("temporada"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("h")).agg(F.count("*").alias("n"))
    return k.groupBy("club", "temporada").agg(F.count("*").alias("contenidos"), F.sum("n").alias("entregas"), F.sum(F.col("n") - 1).alias("repetidas"))


@query("select club_destino_id club, count(*) n, round(avg(es_destino_top_20::int), 6) tasa, min(edad_al_fichaje) menor from modelo where grupo_posicion in ('Lateral', 'Arquero') and edad_al_fichaje between 18 and 30 and club_origen_es_europeo group by 1")
def explore_filter(spark, d):
    m = table(spark, d, "modelo").where(F.col("grupo_posicion").isin("Lateral", "Arquero") & F.col("edad_al_fichaje").between(18, 30) & F.col("club_origen_es_europeo"))
    return m.groupBy(F.col("club_destino_id").alias("club")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("es_destino_top_20").cast("double")), 6).alias("tasa"), F.min("edad_al_fichaje").alias("menor"))


@query("select club_destino_id club, max_by(operacion_id, (stat_xg, operacion_id)) operacion, max(stat_xg) xg from modelo where not isnan(stat_xg) and club_destino_id is not null group by 1")
def best_case_lookup(spark, d):
    m = table(spark, d, "modelo").where(F.col("stat_xg").isNotNull() & ~F.isnan("stat_xg") & F.col("club_destino_id").isNotNull())
    return m.groupBy(F.col("club_destino_id").alias("club")).agg(F.max_by("operacion_id", F.struct("stat_xg", "operacion_id")).alias("operacion"), F.max("stat_xg").alias("xg"))


@query("""select operacion_id, extraido_el::varchar marca, coalesce(nacionalidad_2, 'sin dato') segunda, nacionalidad_2 is not null tiene_segunda, -altura_cm negativo, least(greatest(edad_al_fichaje, 18), 35) recortada, coalesce(lower(pie) = 'right', false) diestro, not coalesce(altura_cm between 165 and 195, true) fuera, round(coste_fichaje_eur / 1e6, 1) millones from plata""")
def scalar_suite(spark, d):
    return table(spark, d, "plata").select("operacion_id", F.col("extraido_el").cast("string").alias("marca"), F.coalesce("nacionalidad_2", F.lit("sin dato")).alias("segunda"), F.col("nacionalidad_2").isNotNull().alias("tiene_segunda"), (-F.col("altura_cm")).alias("negativo"), F.when(F.col("edad_al_fichaje").isNotNull(), F.least(F.greatest("edad_al_fichaje", F.lit(18)), F.lit(35))).otherwise(F.lit(18)).alias("recortada"), rel.flag(F.lower("pie") == "right").alias("diestro"), (~F.coalesce(F.col("altura_cm").between(165, 195), F.lit(True))).alias("fuera"), F.round(F.col("coste_fichaje_eur") / 1e6, 1).alias("millones"))


@query("""with c as (select c_custkey, c_nationkey, rank() over (order by c_acctbal desc) rk from customer), s as (select s_suppkey, s_nationkey, rank() over (order by s_acctbal desc) rk from supplier)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, c_nationkey = s_nationkey domestico, (nullif(s.rk, 0) - nullif(c.rk, 0))::bigint salto, (s.rk - c.rk) > 0 sube, s.rk <= 20 top_20 from lineitem join orders on l_orderkey = o_orderkey join c on o_custkey = c_custkey join s on l_suppkey = s_suppkey""")
def pair_derivations(spark, d):
    ranks = lambda t, v: st.running(table(spark, d, t).groupBy(v).agg(F.count("*").alias("n")), [], [F.desc(v)], ["n"]).select(F.col(v).alias("v"), (F.col("upto_n") - F.col("n") + 1).alias("rk"))
    c = table(spark, d, "customer").join(ranks("customer", "c_acctbal"), F.col("c_acctbal") == F.col("v")).select("c_custkey", "c_nationkey", F.col("rk").alias("rc"))
    s = table(spark, d, "supplier").join(ranks("supplier", "s_acctbal"), F.col("s_acctbal") == F.col("v")).select("s_suppkey", "s_nationkey", F.col("rk").alias("rs"))
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    jump = F.nullif("rs", F.lit(0)) - F.nullif("rc", F.lit(0))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("c_nationkey") == F.col("s_nationkey")).alias("domestico"), jump.alias("salto"), (jump > 0).alias("sube"), (F.col("rs") <= 20).alias("top_20"))


@query("""with p as (select club_origen_pais c, count(*) n from plata where club_origen_pais is not null group by 1), a as (select case lower(strip_accents(c)) when 'czech republic' then 'czechia' when 'bosnia-herzegovina' then 'bosnia and herzegovina' when 'ireland' then 'republic of ireland' when 'monaco' then 'france' when 'turkey' then 'turkiye' else lower(strip_accents(c)) end k, n from p),
u as (select distinct case lower(strip_accents(uefa_pais)) when 'czech republic' then 'czechia' when 'bosnia-herzegovina' then 'bosnia and herzegovina' when 'ireland' then 'republic of ireland' when 'turkey' then 'turkiye' else lower(strip_accents(uefa_pais)) end k from uefa where uefa_pais is not null)
select a.k pais, u.k is not null europeo, sum(n)::bigint n from a left join u on a.k = u.k group by 1, 2""")
def country_alias_lookup(spark, d):
    alias = {"czech republic": "czechia", "bosnia-herzegovina": "bosnia and herzegovina", "ireland": "republic of ireland", "monaco": "france", "turkey": "turkiye"}
    key = lambda c: (lambda f: F.coalesce(rel.recode(f, alias), f))(fold_text(c))
    p = table(spark, d, "plata").where("club_origen_pais is not null").groupBy("club_origen_pais").agg(F.count("*").alias("n")).select(key(F.col("club_origen_pais")).alias("pais"), "n").groupBy("pais").agg(F.sum("n").alias("n"))
    u = table(spark, d, "uefa").where("uefa_pais is not null").select("uefa_pais").distinct().select(key(F.col("uefa_pais")).alias("pais")).distinct().withColumn("e", F.lit(True))
    return p.join(u, "pais", "left").select("pais", rel.flag(F.col("e")).alias("europeo"), "n")


@query("""with t as (select p_partkey, string_split(lower(p_name), ' ') w from part) select p_partkey, array_to_string(w, ' ') completo, w[1] || ' ' || w[-1] extremos, w[-1] ultimo from t""")
def name_variants(spark, d):
    w = F.split(F.lower("p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(w, " ").alias("completo"), F.concat_ws(" ", w[0], F.element_at(w, -1)).alias("extremos"), F.element_at(w, -1).alias("ultimo"))


@query("""select c_mktsegment segmento, count(*) n, round(avg(c_acctbal), 4) media, round(median(c_acctbal), 4) mediana, round(stddev_samp(c_acctbal), 4) desvio, min(c_acctbal) menor, max(c_acctbal) mayor, count(distinct c_nationkey) paises from customer group by 1""")
def group_profile(spark, d):
    v, c = F.col("c_acctbal"), table(spark, d, "customer")
    middle = st.quantiles(c, ["c_mktsegment"], v, [0.5]).select(F.col("c_mktsegment").alias("segmento"), F.round("valor", 4).alias("mediana"))
    return c.groupBy(F.col("c_mktsegment").alias("segmento")).agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("media"), F.round(F.stddev_samp(v), 4).alias("desvio"), F.min(v).alias("menor"), F.max(v).alias("mayor"), F.count_distinct("c_nationkey").alias("paises")).join(middle, "segmento")


@query("""with s as (select p_type t, avg(p_retailprice) m, stddev_samp(p_retailprice) d from part where p_partkey % 5 <> 0 group by 1) select p_partkey, p_partkey % 5 = 0 prueba, round((p_retailprice - m) / nullif(d, 0), 5) z from part left join s on t = p_type""")
def fitted_stats_apply(spark, d):
    """Statistics learnt on one part of the rows, applied to all."""
    p = table(spark, d, "part")
    s = p.where("p_partkey % 5 <> 0").groupBy("p_type").agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("d"))
    return p.join(s, "p_type", "left").select("p_partkey", (F.col("p_partkey") % 5 == 0).alias("prueba"), F.round((F.col("p_retailprice") - F.col("m")) / F.nullif("d", F.lit(0.0)), 5).alias("z"))


@query("select * from (select s_suppkey, s_acctbal < 0 deuda, round(s_acctbal, 2) saldo from supplier order by s_acctbal, s_suppkey limit 15)")
def bottom_k_composite(spark, d):
    return table(spark, d, "supplier").orderBy("s_acctbal", "s_suppkey").limit(15).select("s_suppkey", (F.col("s_acctbal") < 0).alias("deuda"), F.round("s_acctbal", 2).alias("saldo"))


@query("select origen, count(*) n, count(distinct pais) paises, round(sum(saldo), 2) saldo from (select 'cliente' origen, c_nationkey pais, c_acctbal saldo from customer union all select 'proveedor', s_nationkey, s_acctbal from supplier) group by 1")
def append_sources(spark, d):
    a = table(spark, d, "customer").select(F.lit("cliente").alias("origen"), F.col("c_nationkey").alias("pais"), F.col("c_acctbal").alias("saldo"))
    b = table(spark, d, "supplier").select(F.lit("proveedor").alias("origen"), F.col("s_nationkey").alias("pais"), F.col("s_acctbal").alias("saldo"))
    return a.unionByName(b).groupBy("origen").agg(F.count("*").alias("n"), F.count_distinct("pais").alias("paises"), F.round(F.sum("saldo"), 2).alias("saldo"))


@query(f"""select round(count_if(not t)::double / count(*), 6) accuracy_piso, round((2.0 * count_if(not t) / (2.0 * count_if(not t) + count_if(t))) / 2, 6) f1_piso, round(count(*)::double / (2 * count_if(t)), 6) peso_positivo, round(count(*)::double / (2 * count_if(not t)), 6) peso_negativo from {_SCORED}""")
def floor_and_weights(spark, d):
    """What the constant answer scores, and the weights that balance the classes."""
    t = F.col("t")
    p, n, a = F.count_if(t), F.count_if(~t), F.count("*")
    return _scored(spark, d).agg(F.round(n / a, 6).alias("accuracy_piso"), F.round(2 * n / (2 * n + p) / 2, 6).alias("f1_piso"), F.round(a / (2 * p), 6).alias("peso_positivo"), F.round(a / (2 * n), 6).alias("peso_negativo"))


@query("""select o_custkey, count(*) pedidos, max_by(o_orderpriority, (o_orderdate, o_orderkey)) ultima, round(max(o_totalprice), 2) mayor, count_if(o_orderstatus = 'F' and o_orderpriority like '1%') buscados from orders group by 1""", bigint=('buscados',))
def serving_lookup(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("pedidos"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("ultima"), F.round(F.max("o_totalprice"), 2).alias("mayor"), F.count_if((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")).alias("buscados"))


@query(f"""with b as (select es_destino_top_20 t, edad_al_fichaje e, grupo_posicion g, stat_matches m from modelo where stat_matches is not null and not isnan(stat_matches)),
x as (select m, e, avg(m) over (partition by g) mg, avg(m) over () mt from b where g is not null)
select 'edad' columna, 'correlacion' medida, round(corr(e, m), 6) valor from b where e is not null union all select 'grupo_posicion', 'eta2', round(sum((mg - mt) * (mg - mt)) / sum((m - mt) * (m - mt)), 6) from x
union all select 'es_destino_top_20', 'separacion', round(abs(avg(m) filter (t) - avg(m) filter (not t)) / sqrt((var_samp(m) filter (t) + var_samp(m) filter (not t)) / 2), 6) from b""")
def measure_dispatch(spark, d):
    """The measure of association by the kind of each column: numeric, many-valued, two-valued."""
    b = table(spark, d, "modelo").select(F.col("es_destino_top_20").alias("t"), F.col("edad_al_fichaje").alias("e"), "grupo_posicion", st.number("stat_matches").alias("m")).where("m is not null")
    out = b.agg(F.round(st.corr(F.col("e"), F.col("m")), 6).alias("c"), F.round(st.separation(F.col("m"), F.col("t")), 6).alias("s"))
    two = out.select(F.explode(F.array(F.struct(F.lit("edad").alias("columna"), F.lit("correlacion").alias("medida"), F.col("c").alias("valor")), F.struct(F.lit("es_destino_top_20").alias("columna"), F.lit("separacion").alias("medida"), F.col("s").alias("valor")))).alias("x")).select("x.*")
    return two.unionByName(st.eta_squared(b, F.col("m"), "grupo_posicion").select(F.lit("grupo_posicion").alias("columna"), F.lit("eta2").alias("medida"), F.col("eta2").alias("valor")))


@query()
def rf_oof(spark, d):
    """Out-of-fold probabilities of a forest, all rows of a player in one fold."""
    from pampero.plans.model import out_of_fold

    return out_of_fold(spark, d)

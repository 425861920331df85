"""The consolidated table: arrivals enriched with the ranking of both clubs and the player's previous season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pampero.functions.text import fold_text, plain_date, plain_digits
from pampero.operators.nested import as_json, within_elements
from pampero.operators.quality import Check, empty_columns, report, rows_where, same_flag
from pampero.operators.relational import first_match, flag, keep_one, recode, typed
from pampero.operators.resolve import RESERVE, name_tokens, resolve
from pampero.operators.stats import modes, one_row
from pampero.plans.datasets import ARRAY_KEYS, _TREE
from pampero.session import table, written
from pampero.sources.bronze import partition_value
from pampero.streaming.compactor import parsed_pages

#: Metrics that are shares or means and are averaged over tournaments; the others are summed (fixed values).
AVERAGED = ["stat_rating", "stat_pass_accuracy", "stat_long_ball_accuracy", "stat_cross_accuracy", "stat_dribbles_success_rate", "stat_duels_won_%", "stat_aerials_won_%"]
#: A metric that the source gives a second time under another title (fixed value).
REPEATED = "stat_conceded"
#: Metrics with a column of their own, by the titles they may have; all others stay in the map (fixed values).
COLUMNS = {c: [c] for c in "stat_aerials_won_% stat_assists stat_big_chances_created stat_chances_created stat_dribbles_success_rate stat_duels_won_% stat_goals stat_goals_conceded stat_goals_prevented stat_high_claims stat_interceptions stat_matches stat_minutes stat_pass_accuracy stat_possession_won_final_3rd stat_rating stat_recoveries stat_save_percentage stat_saves stat_shots_on_target stat_successful_crosses stat_tackles stat_touches_in_opposition_box stat_xg".split()} | {"stat_minutes": ["stat_minutes", "stat_minutes_played"]}
#: Countries that the transfer site and the ranking spell differently (fixed values).
COUNTRIES = {"czech republic": "czechia", "bosnia herzegovina": "bosnia and herzegovina", "ireland": "republic of ireland", "monaco": "france", "turkey": "turkiye"}
#: Codes of the five great leagues (fixed values).
TOP5 = ["GB1", "ES1", "IT1", "L1", "FR1"]
#: Kinds of the columns that the contract names (fixed values).
KINDS = dict.fromkeys(["edad_al_fichaje", "altura_cm", "club_destino_ranking_uefa", "club_origen_ranking_uefa", "salto_ranking_uefa"], "int") | {"coste_fichaje_eur": "bigint"} | dict.fromkeys(["es_destino_top_20", "club_origen_es_europeo", "club_origen_es_top_20", "club_origen_es_top_50", "club_origen_liga_es_top5", "club_origen_es_filial", "traspaso_domestico", "tiene_historial", "cruce_dudoso"], "boolean")
#: Operations that are no signing: a player who returns to the own club (fixed values).
NO_SIGNING = ["fin_de_cesion"]


def country_key(col: Column) -> Column:
    """A country in one spelling for both sources; null and blank are unknown."""
    k = F.trim(F.regexp_replace(fold_text(col), "[^a-z]+", " "))
    return F.nullif(recode(k, COUNTRIES, k), F.lit(""))


def operation(text: Column) -> tuple[Column, Column]:
    """(euros, kind) of a written fee; a loan fee and a purchase have an amount, the other kinds none."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    kind = first_match([(t.contains("loan fee"), "cesion_con_cargo"), (t.contains("end of loan"), "fin_de_cesion"), (t.contains("loan"), "cesion"), (t.contains("free"), "libre"), (t.contains("?") | t.isin("-", ""), "desconocido")], "compra")
    unit = F.regexp_extract(t, r"€\s*([\d.,]+)\s*([mk]?)", 2)
    factor = F.when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    euros = (F.regexp_replace(F.regexp_extract(t, r"€\s*([\d.,]+)\s*([mk]?)", 1), ",", "").try_cast("double") * factor).cast("bigint")
    return F.when(kind.isin("compra", "cesion_con_cargo"), euros), kind


def arrival_rows(spark: SparkSession, d: str, seasons: list[str] | None = None) -> DataFrame:
    """Every arrival row of every page: what the page says, its destination and season, the fee and kind, and what the origin is.

    Pages of other seasons are left out before they are parsed. Rows of all kinds and repeated
    ones stay; see ``compact_arrivals`` for each operation once.
    """
    pages = table(spark, d, "bronce").withColumn("temporada", partition_value(F.col("ruta_tm_altas"), "temporada")).withColumn("club_destino_id", partition_value(F.col("ruta_tm_altas"), "club"))
    if seasons:
        pages = pages.where(F.col("temporada").isin(seasons))
    rows = parsed_pages(pages, ["temporada", "club_destino_id", "aterrizado_el"])
    euros, kind = operation(F.col("coste_fichaje_texto"))
    return rows.withColumns({
        "coste_fichaje_eur": euros, "tipo_operacion": kind,
        "club_origen_es_filial": flag(F.col("club_origen").rlike(RESERVE)), "club_origen_liga_es_top5": flag(F.col("club_origen_liga_id").isin(TOP5)),
    })


def _tournament_metrics(spark: SparkSession, d: str) -> DataFrame:
    """jugador_fotmob_id, temporada, metrica, v of every tournament in the newest fetch of a profile."""
    f = table(spark, d, "fotmob")
    newest = keep_one(f.select("registro_id", "jugador_fotmob_id", "statseasons", "extraido_el"), ["jugador_fotmob_id"], [F.col("extraido_el"), F.col("registro_id")])
    seasons = within_elements(newest, ["registro_id", "jugador_fotmob_id"], "statseasons", "statSeasons", "items", ARRAY_KEYS)
    # fields are read before the items are laid in rows: a filter on them would be pushed below and read them again
    shown = F.transform("dentro", lambda x: F.struct(x["ruta"].alias("ruta"), as_json(x["contenido"]).alias("j")))
    read = F.transform(shown, lambda x: F.struct(x["ruta"].alias("ruta"), F.get_json_object(x["j"], "$['title']").alias("titulo"), F.regexp_replace(F.get_json_object(x["j"], "$['statValue']"), "%$", "").try_cast("double").alias("v")))
    seasons = seasons.select("registro_id", "jugador_fotmob_id", F.col("elemento").alias("s"), F.get_json_object(as_json(F.col("contenido")), "$['seasonName']").alias("temporada"), F.filter(read, lambda x: x["titulo"].isNotNull() & x["v"].isNotNull()).alias("x"))
    items = seasons.select("registro_id", "jugador_fotmob_id", "s", "temporada", F.explode("x").alias("x"))
    long = items.select("registro_id", "jugador_fotmob_id", "s", "temporada", F.regexp_extract("x.ruta", r"^(statSeasons/\d+/tournaments/\d+)", 1).alias("t"), F.concat(F.lit("stat_"), F.lower(F.replace("x.titulo", F.lit(" "), F.lit("_")))).alias("metrica"), "x.v", "x.ruta")
    one = long.groupBy("registro_id", "jugador_fotmob_id", "s", "temporada", "t", "metrica").agg(F.max_by("v", F.struct(F.col("ruta").contains("/statsSection/"), "ruta")).alias("v"))
    return one.select("jugador_fotmob_id", "temporada", "metrica", "v")


def _consolidated(per: DataFrame) -> DataFrame:
    """The metrics of a player's season, summed or averaged over its tournaments."""
    return per.groupBy("jugador_fotmob_id", "temporada", "metrica").agg(F.round(F.when(F.first("metrica").isin(AVERAGED), F.avg("v")).otherwise(F.sum("v")), 6).alias("valor"))


def player_metrics(spark: SparkSession, d: str) -> DataFrame:
    """jugador_fotmob_id, temporada, metrica, valor of every profile: the newest fetch, summed or averaged over tournaments.

    Metrics are the items of a tournament's blocks that have a number; within a tournament the
    detailed section's value of a title stands before the summary's, else the last block's. Seasons
    may be labelled by one year or two.
    """
    return _consolidated(_tournament_metrics(spark, d))


def season_history(spark: SparkSession, d: str) -> DataFrame:
    """jugador_fotmob_id, temporada_stats, metricas (map): a season's metrics under its label of two years.

    A label of one year is the season that begins in it; both labels' tournaments count together.
    """
    y = F.col("temporada").cast("string")
    label = F.when(y.rlike(r"^\d{4}$"), F.concat_ws("/", y, (y.try_cast("int") + 1).cast("string"))).otherwise(y)
    per = _tournament_metrics(spark, d).where(F.col("metrica") != REPEATED).withColumn("temporada", label)
    return _consolidated(per).groupBy(plain_digits(F.col("jugador_fotmob_id")).alias("jugador_fotmob_id"), F.col("temporada").alias("temporada_stats")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metrica", "valor")))).alias("metricas"))


def consolidate(spark: SparkSession, d: str, seasons: list[str] | None = None, tope: int = 20, players: DataFrame | None = None) -> DataFrame:
    """One row per signing: what its page says, both clubs' rank, what follows from the pair, and the season before.

    Pages of other seasons are left out before they are parsed. The newest row of an operation
    stands; returns from a loan are no signing. The destination's name and country come from the
    silver history by the id in the page's path, and so do the country and league of an origin
    where its page lacks them. Both clubs go through the resolver, once a different name and
    country, against the newest snapshot; reserve sides take no rank. Misses stay null; the method
    of each match is kept, and a match by likeness makes the row doubtful.

    ``players`` ties transfer ids to profiles: jugador_tm_id (one row each), jugador_fotmob_id,
    altura_cm, pie, posicion_fotmob. A player's metrics are those of the season before the signing;
    ``metricas`` holds all of them. Without ``players`` that history is unknown (null).
    """
    signings = arrival_rows(spark, d, seasons).where(~F.col("tipo_operacion").isin(NO_SIGNING))
    kept = keep_one(signings, ["operacion_id"], [F.col("aterrizado_el"), F.col("archivo_id")])
    base = written(kept.withColumns({c: plain_digits(F.col(c)) for c in ("club_destino_id", "club_origen_id", "jugador_tm_id")}), "silver-rows")
    u = table(spark, d, "uefa").withColumn("dia", plain_date(F.col("actualizacion")))
    newest = u.agg(F.max("dia").alias("dia"))
    ranks = keep_one(u.join(newest, "dia").select(plain_digits(F.col("uefa_club_id")).alias("uefa_id"), "dia", "uefa_ranking", "uefa_coeficiente", "uefa_pais", "uefa_nombre", "uefa_nombre_oficial", "uefa_nombre_internacional", "uefa_nombre_corto", "aterrizado_el", "fila_id").where("uefa_id is not null"), ["uefa_id"], [F.col("aterrizado_el"), F.col("fila_id")])
    forms = ranks.select("uefa_id", "uefa_ranking", "uefa_pais", F.explode(F.array("uefa_nombre", "uefa_nombre_oficial", "uefa_nombre_internacional", "uefa_nombre_corto")).alias("n")).where("n is not null").distinct()
    aliases = forms.select(F.col("uefa_id").alias("destino"), F.coalesce("uefa_ranking", F.lit(10_000)).alias("pos"), country_key(F.col("uefa_pais")).alias("block"), name_tokens(fold_text(F.col("n"))).alias("tokens"))
    # neither the destination's name nor every origin's country is on a page: the silver history of the clubs has them
    p = table(spark, d, "plata")
    liga = F.when(F.col("club_origen_liga_id").isNotNull(), F.struct("club_origen_liga", "club_origen_liga_id"))
    counted = lambda raw, **cells: written(p.where(F.col(raw).isNotNull()).groupBy(raw, *[c.alias(k) for k, c in cells.items()]).agg(F.count("*").alias("n")), "silver-clubs").withColumn(raw, plain_digits(F.col(raw))).where(F.col(raw).isNotNull())
    targets = modes(counted("club_destino_id", club_destino=F.col("club_destino"), club_destino_pais=F.col("club_destino_pais")), ["club_destino_id"], ["club_destino", "club_destino_pais"])
    known = modes(counted("club_origen_id", pais=F.col("club_origen_pais"), liga=liga), ["club_origen_id"], ["pais", "liga"])
    # clubs are few beside signings: names, countries and ranks are put together a club, and each side joined to the signings once
    targets = written(targets.join(base.select("club_destino_id").distinct(), "club_destino_id", "left_semi"), "silver-targets")
    own = {"_oid": "club_origen_id", "_on": "club_origen", "_op": "club_origen_pais", "_of": "club_origen_es_filial"}
    origins = base.select(*[F.col(c).alias(k) for k, c in own.items()]).distinct().join(known, F.col("_oid") == F.col("club_origen_id"), "left").drop("club_origen_id")
    origins = written(origins.withColumn("pais", F.coalesce("_op", "pais")), "silver-origins")
    asked = targets.select(F.col("club_destino").alias("n"), F.col("club_destino_pais").alias("c")).union(origins.where("not _of").select("_on", "pais")).where("n is not null").distinct()
    asked = written(asked.select(F.struct("n", "c").alias("id"), country_key(F.col("c")).alias("block"), name_tokens(fold_text(F.col("n"))).alias("tokens")), "silver-asked")
    found = written(resolve(asked, written(aliases, "silver-aliases")), "silver-found")
    r = ranks.select(F.col("uefa_id").alias("destino"), "uefa_ranking", "uefa_coeficiente")
    matched = written(found.join(r, "destino", "left"), "silver-matched")
    side = lambda x: matched.select(F.col("id.n").alias(f"_n{x}"), F.col("id.c").alias(f"_c{x}"), F.col("uefa_ranking").alias(f"club_{x}_ranking_uefa"), F.col("uefa_coeficiente").alias(f"club_{x}_coeficiente_uefa"), F.col("metodo").alias(f"_m{x}"))
    meets = lambda x, n, c: (F.col(n) == F.col(f"_n{x}")) & F.col(c).eqNullSafe(F.col(f"_c{x}"))
    into = targets.join(side("destino"), meets("destino", "club_destino", "club_destino_pais"), "left")
    off = origins.join(side("origen"), meets("origen", "_on", "pais") & ~F.col("_of"), "left")
    same = [F.col(c).eqNullSafe(F.col(k)) for k, c in own.items()]
    out = base.join(into, "club_destino_id", "left").join(off, same, "left")
    no_league = F.col("club_origen_liga_id").isNull()
    out = out.withColumns({
        "club_origen_pais": F.col("pais"),
        "club_origen_liga": F.when(no_league, F.coalesce("club_origen_liga", "liga.club_origen_liga")).otherwise(F.col("club_origen_liga")), "club_origen_liga_id": F.coalesce("club_origen_liga_id", "liga.club_origen_liga_id"),
    }).drop("pais", "liga", *own)
    start = F.col("temporada").try_cast("int")
    label = lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    out = out.withColumn("temporada_fichaje", F.when(start.isNotNull(), label(start, start + 1))).withColumn("temporada_stats", F.when(start.isNotNull(), label(start - 1, start)))
    if players is None:
        out = out.withColumns({"jugador_fotmob_id": F.lit(None).cast("string"), "altura_cm": F.lit(None).cast("int"), "pie": F.lit(None).cast("string"), "posicion_fotmob": F.lit(None).cast("string"), "metricas": F.lit(None).cast("map<string, double>"), "tiene_historial": F.lit(None).cast("boolean")})
    else:
        history = written(players.join(season_history(spark, d), "jugador_fotmob_id"), "silver-history")
        out = out.join(history, ["jugador_tm_id", "temporada_stats"], "left").withColumn("tiene_historial", F.col("metricas").isNotNull())
    # countries of the ranking are European; a handful of rows
    lands = aliases.select(F.col("block").alias("_land")).where("_land is not null").distinct().withColumn("_eu", F.lit(True))
    out = out.withColumn("_land", country_key(F.col("club_origen_pais"))).join(lands, "_land", "left")
    stamp = F.date_format(F.coalesce("dia", F.current_date()), "yyyy-MM-dd")
    out = one_row(out, written(newest, "silver-day").select(stamp.alias("uefa_actualizado_el")))
    jump = F.col("club_origen_ranking_uefa") - F.col("club_destino_ranking_uefa")
    doubtful = lambda x: flag(F.col(f"_m{x}").startswith("aproximado"))
    method = lambda x: F.coalesce(f"_m{x}", F.lit("sin_nombre"))
    final = out.select(
        "jugador_tm_id", "jugador_fotmob_id", F.col("jugador_nombre").alias("nombre"), "temporada_fichaje", "temporada_stats", "operacion_id", "archivo_id", "coste_fichaje_eur", "tipo_operacion", "coste_fichaje_texto",
        F.coalesce("club_destino", "club_destino_id").alias("club_destino"), "club_destino_id", "club_destino_pais", "club_destino_ranking_uefa", "club_destino_coeficiente_uefa", flag(F.col("club_destino_ranking_uefa") <= tope).alias("es_destino_top_20"),
        "club_origen", "club_origen_id", "club_origen_slug", "club_origen_es_filial", "club_origen_pais", flag(F.col("_eu")).alias("club_origen_es_europeo"), "club_origen_liga", "club_origen_liga_id", flag(F.col("club_origen_liga_id").isin(TOP5)).alias("club_origen_liga_es_top5"), "club_origen_ranking_uefa", "club_origen_coeficiente_uefa", flag(F.col("club_origen_ranking_uefa") <= tope).alias("club_origen_es_top_20"), flag(F.col("club_origen_ranking_uefa") <= 50).alias("club_origen_es_top_50"),
        flag(F.col("club_origen_pais") == F.col("club_destino_pais")).alias("traspaso_domestico"), jump.alias("salto_ranking_uefa"), (jump > 0).alias("sube_de_categoria"),
        "edad_al_fichaje", "nacionalidad", "nacionalidad_2", "posicion_tm", "posicion_fotmob", "altura_cm", "pie", "tiene_historial",
        method("destino").alias("cruce_destino_metodo"), F.when(F.col("club_origen_es_filial"), "filial").otherwise(method("origen")).alias("cruce_metodo"), (doubtful("destino") | doubtful("origen")).alias("cruce_dudoso"), "uefa_actualizado_el", F.col("aterrizado_el").alias("extraido_el"),
        *[F.coalesce(*[F.col("metricas")[t] for t in titles]).alias(c) for c, titles in COLUMNS.items()], "metricas",
    )
    return typed(final, KINDS)


def gate(wanted: list[str], tope: int = 20) -> list[Check]:
    """What must hold of the consolidated table beyond its keys and ranges: its columns, its target and its history."""
    rank = F.col("club_destino_ranking_uefa")
    return [
        same_flag("objetivo_sigue_al_ranking", F.col("es_destino_top_20"), rank <= tope), rows_where("destino_sin_ranking", rank.isNull()),
        same_flag("historial_si_y_solo_si_metricas", F.col("tiene_historial"), F.size("metricas") > 0), rows_where("tipo_excluido", F.col("tipo_operacion").isin(NO_SIGNING)), *empty_columns(wanted),
    ]


def silver_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate's report on the consolidated table without players, whose history is then unknown."""
    df = consolidate(spark, d)
    return report(df, [c for c in gate(["operacion_id", "club_destino", "club_destino_ranking_uefa", "club_origen", "tipo_operacion"]) if c.name != "historial_si_y_solo_si_metricas"])


_AVERAGED = ", ".join(f"'{c}'" for c in AVERAGED)
SQL = {
    "player_metrics": rf"""{_TREE}, f as (select jugador_fotmob_id, max_by(registro_id, (extraido_el, registro_id)) registro from fotmob group by 1),
s as (select registro, ruta, v ->> '$.seasonName' temporada from t where tabla = 'fotmob' and clave = 'statSeasons' and json_type(v) = 'OBJECT'),
i as (select registro, regexp_extract(ruta, '^(statSeasons/\d+)', 1) s, regexp_extract(ruta, '^(statSeasons/\d+/tournaments/\d+)', 1) tt, ruta, 'stat_' || lower(replace(v ->> '$.title', ' ', '_')) metrica, try_cast(regexp_replace(v ->> '$.statValue', '%$', '') as double) v from t where tabla = 'fotmob' and clave = 'items' and json_type(v) = 'OBJECT' and v ->> '$.title' is not null),
o as (select registro, s, tt, metrica, max_by(v, (contains(ruta, '/statsSection/'), ruta)) v from i where v is not null group by all)
select jugador_fotmob_id, temporada, metrica, round(case when metrica in ({_AVERAGED}) then avg(v) else sum(v) end, 6) valor from o join s on s.registro = o.registro and s.ruta = o.s join f on f.registro = o.registro group by 1, 2, 3""",
}
QUERIES = {"player_metrics": player_metrics, "arrival_rows": arrival_rows, "silver": consolidate, "silver_gate": silver_gate}

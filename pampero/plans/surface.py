"""More of the analytical surface over whole tables: profiles, roles, resolution, evaluation, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pampero.functions.text import fold_text, plain_digits
from pampero.operators import evaluation as ev, relational as rel, stats as st
from pampero.operators.imputation import ROLES
from pampero.operators.quality import Check, empty_columns, report, unmapped
from pampero.operators.resolve import STAGES, catalogue, match_coverage, name_tokens, pick_homonym, resolve
from pampero.plans.datasets import _TREE
from pampero.plans.reference import METRICS, ROLE_OF, _FOLD, _FOLD_SQL, _ROLE_SQL, _SCORED, _TOKENS_SQL, _nn, _resolver, _scored, query
from pampero.session import table, written
from pampero.plans.silver import TOP5

#: Metrics that tell the level in a role, besides minutes and matches (fixed values; those that the model population has).
ROLE_METRICS = {
    "Arquero": ["stat_saves"],
    "Defensor central": ["stat_tackles", "stat_duels_won_%", "stat_recoveries"],
    "Lateral": ["stat_tackles", "stat_duels_won_%", "stat_recoveries"],
    "Mediocampo defensivo": ["stat_tackles", "stat_duels_won_%", "stat_recoveries", "stat_pass_accuracy"],
    "Mediocampo ofensivo": ["stat_pass_accuracy", "stat_assists"],
    "Delantero centro": ["stat_goals", "stat_xg"],
    "Delantero extremo": ["stat_goals", "stat_assists"],
}
BASE = ["stat_minutes", "stat_matches"]
#: All metrics of any role, each once, in order.
ALL_METRICS = BASE + sorted({c for cs in ROLE_METRICS.values() for c in cs})
_Q = [i / 100 for i in range(101)]


def _num(c: str) -> str:
    return f'case when not isnan("{c}") then "{c}" end'


# --- profiles of columns ---------------------------------------------------------------------

_PROFILED = ["operacion_id", "jugador_tm_id", "temporada_fichaje", "club_destino_id", "es_destino_top_20", "grupo_posicion", "edad_al_fichaje", "club_origen_liga_es_top5", *ALL_METRICS]


def _profile_sql(c: str) -> str:
    v = _num(c) if c.startswith("stat_") else f'"{c}"'
    kind = "numero" if c.startswith("stat_") or c == "edad_al_fichaje" else "booleano" if c in ("es_destino_top_20", "club_origen_liga_es_top5") else "texto"
    return f"select '{c}' columna, '{kind}' tipo, count({v}) no_nulos, count(distinct {v}) distintos, count({v}) = 0 vacia, count(distinct {v}) <= 1 constante, {f'min({v})::double' if kind == 'numero' else 'null::double'} minimo, {str(c.startswith('stat_')).lower()} metrica from modelo"


@query(" union all ".join(map(_profile_sql, _PROFILED)))
def column_profile(spark, d):
    """Kind, coverage, distinct values and minimum of each column in one aggregate; constant and empty columns marked."""
    return rel.profile(table(spark, d, "modelo").select(*[F.col(f"`{c}`") for c in _PROFILED]))


@query("select tipo, count(*) columnas from (" + " union all ".join(map(_profile_sql, _PROFILED)) + ") group by 1")
def dtype_census(spark, d):
    """How many columns there are of each kind."""
    return rel.profile(table(spark, d, "modelo").select(*[F.col(f"`{c}`") for c in _PROFILED])).groupBy("tipo").agg(F.count("*").alias("columnas"))


@query("with c as (" + " union all ".join(f"select count({_num(c)}) / count(*) x from modelo" for c in ALL_METRICS) + ") select case when x > 0.6 then 'mas de 60 %' when x > 0.4 then '40 a 60 %' else 'hasta 40 %' end banda, count(*) columnas, count_if(x <= 0.1)::bigint hasta_10 from c group by 1")
def coverage_bands(spark, d):
    """Columns by the share of rows that have them."""
    c = rel.coverage(table(spark, d, "modelo"), ALL_METRICS)
    band = rel.first_match([(F.col("x") > 0.6, "mas de 60 %"), (F.col("x") > 0.4, "40 a 60 %")], "hasta 40 %")
    whole = table(spark, d, "modelo").agg(F.count("*").alias("filas"))
    return st.one_row(c, whole).withColumn("x", F.col("no_nulos") / F.col("filas")).groupBy(band.alias("banda")).agg(F.count("*").alias("columnas"), F.count_if(F.col("x") <= 0.1).alias("hasta_10"))


_PRESENT = " + ".join(f"({_num(c)} is not null)::int" for c in ALL_METRICS)


@query(f"select coalesce(grupo_posicion, 'sin dato') rol, count(*) n, median({_PRESENT}) mediana from modelo group by 1")
def metrics_per_row(spark, d):
    """How many metrics a row has, and the median of that by role."""
    here = sum((st.number(c).isNotNull().cast("int") for c in ALL_METRICS), F.lit(0))
    m = table(spark, d, "modelo").select(F.coalesce("grupo_posicion", F.lit("sin dato")).alias("rol"), here.alias("k"))
    return st.quantiles(m, ["rol"], F.col("k"), [0.5]).select("rol", "n", F.col("valor").alias("mediana"))


@query("select n_filas filas, count(*) jugadores from (select jugador_tm_id, least(count(*), 5) n_filas from modelo where jugador_tm_id is not null group by 1) group by 1")
def repeated_entities(spark, d):
    """Players by their number of rows, five standing for more."""
    per = table(spark, d, "modelo").where("jugador_tm_id is not null").groupBy("jugador_tm_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.least("n", F.lit(5)).cast("bigint").alias("filas")).agg(F.count("*").alias("jugadores"))


_PAIRS = [(a, b) for i, a in enumerate(ALL_METRICS) for b in ALL_METRICS[i + 1 :]]


@query("select * from (" + " union all ".join(f"select '{a}' a, '{b}' b, round(corr({_num(a)}, {_num(b)}), 6) r, count(*) filter (where {_num(a)} is not null and {_num(b)} is not null) n from modelo" for a, b in _PAIRS) + ") where abs(r) > 0.5 and not isnan(r)")
def correlated_pairs(spark, d):
    """Pairs of metrics with a correlation over 0.5 on the rows that have both: all pairs in one aggregate."""
    return st.correlations(table(spark, d, "modelo"), ALL_METRICS).where(F.abs("r") > 0.5)


@query("""with p as (select stat_minutes x, stat_goals y from modelo where not isnan(stat_minutes) and not isnan(stat_goals)), r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from p)
select round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman, round(abs(corr(rx, ry) - corr(x, y)), 6) brecha, count(*) n from r""")
def rank_gap(spark, d):
    """Distance of the rank correlation from the linear one, and the pairs behind them."""
    p = table(spark, d, "modelo").select(st.number("stat_minutes").alias("x"), st.number("stat_goals").alias("y")).where("x is not null and y is not null")
    r = st.ranked(st.ranked(p, "x", "rx"), "y", "ry")
    a, b = st.corr(F.col("x"), F.col("y")), st.corr(F.col("rx"), F.col("ry"))
    return r.agg(F.round(a, 6).alias("pearson"), F.round(b, 6).alias("spearman"), F.round(F.abs(b - a), 6).alias("brecha"), F.count("*").alias("n"))


#: Columns that are never measured: identifiers and the target (fixed values).
NOT_MEASURED = ["operacion_id", "jugador_tm_id", "club_destino_id", "es_destino_top_20"]


def _dispatch_sql(c: str) -> str:
    if c in NOT_MEASURED:
        return f"select '{c}' columna, 'no se mide' medida, null::double valor"
    number = c.startswith("stat_") or c == "edad_al_fichaje"
    v = _num(c) if c.startswith("stat_") else f'"{c}"'
    t = "coalesce(es_destino_top_20, false)"
    sep = f"(select case when least(count({v}) filter ({t}), count({v}) filter (not {t})) >= 10 then abs(avg({v}) filter ({t}) - avg({v}) filter (not {t})) / sqrt((var_samp({v}) filter ({t}) + var_samp({v}) filter (not {t})) / 2) end from modelo)"
    eta = f"(select sum((m - w) * (m - w)) / sum((y - w) * (y - w)) from (select y, avg(y) over (partition by g) m, avg(y) over () w from (select coalesce({v}::varchar, chr(1)) g, {t}::int y from modelo)))"
    n = f"(select count(distinct {v}) from modelo)"
    first = f"when {n} > 12 then 'separacion'" if number else f"when {n} > 60 then 'demasiadas categorias'"
    value = f"case when {n} <= 1 then null when {n} > 12 then {sep} else {eta} end" if number else f"case when {n} <= 1 or {n} > 60 then null else {eta} end"
    return f"select '{c}' columna, case when {n} <= 1 then 'constante' {first} else 'eta2' end medida, round({value}, 6) valor"


@query(" union all ".join(map(_dispatch_sql, _PROFILED)))
def auto_dispatch(spark, d):
    """Each column's association with the target by the measure that its kind and number of values call for."""
    m = table(spark, d, "modelo").select(*[F.col(f"`{c}`") for c in _PROFILED])
    return st.dispatch(m, F.col("es_destino_top_20"), rel.profile(m), NOT_MEASURED)


# --- roles -----------------------------------------------------------------------------------

@query(" union all ".join(f"select grupo_posicion rol, '{c}' metrica, unnest(range(101)) q, round(unnest(quantile_cont({_num(c)}, {_Q})), 5) valor, count({_num(c)}) n from modelo where grupo_posicion is not null and {_num(c)} is not null group by 1" for c in ALL_METRICS))
def role_quantiles(spark, d):
    """The 101 percentiles of every metric in every role."""
    m = table(spark, d, "modelo").where("grupo_posicion is not null")
    long = m.select(F.col("grupo_posicion").alias("rol"), *[st.number(c).alias(c) for c in ALL_METRICS]).unpivot(["rol"], ALL_METRICS, "metrica", "v").where("v is not null")
    q = st.quantiles(long, ["rol", "metrica"], F.col("v"), _Q)
    return q.select("rol", "metrica", F.round(F.col("q") * 100).cast("bigint").alias("q"), F.round("valor", 5).alias("valor"), "n")


_Z = {c: f"({_num(c)} - avg({_num(c)}) over w) / nullif(stddev_samp({_num(c)}) over w, 0)" for c in ALL_METRICS}
_OWN = {c: [r for r, cs in ROLE_METRICS.items() if c in BASE + cs] for c in ALL_METRICS}
_MASKED = ", ".join("case when grupo_posicion in ({}) then {} end \"{}\"".format(", ".join(f"'{r}'" for r in _OWN[c]), _Z[c], "z_" + c.removeprefix("stat_")) for c in ALL_METRICS)
_ZS = ["z_" + c.removeprefix("stat_") for c in ALL_METRICS]


def _role_z(spark: SparkSession, d: str) -> DataFrame:
    """Scores within the role, each metric in the roles that it tells something of and null elsewhere."""
    m = table(spark, d, "modelo").where("grupo_posicion is not null").select("operacion_id", "grupo_posicion", "es_destino_top_20", *[st.number(c).alias(c) for c in ALL_METRICS])
    z = st.zscores(m, {f"z_{c.removeprefix('stat_')}": F.col(f"`{c}`") for c in ALL_METRICS}, ["grupo_posicion"])
    return z.select("operacion_id", "grupo_posicion", "es_destino_top_20", *[F.when(F.col("grupo_posicion").isin(_OWN[c]), F.col(f"`{n}`")).alias(n) for c, n in zip(ALL_METRICS, _ZS)])


@query(f"with z as (select operacion_id, {_MASKED} from modelo where grupo_posicion is not null window w as (partition by grupo_posicion)) select operacion_id, " + ", ".join(f'round("{n}", 5) "{n}"' for n in _ZS) + " from z")
def role_masked_z(spark, d):
    """Standard scores of a role's own metrics."""
    return _role_z(spark, d).select("operacion_id", *[F.round(F.col(f"`{n}`"), 5).alias(n) for n in _ZS])


@query(f"with z as (select operacion_id, grupo_posicion, stat_minutes, {_MASKED} from modelo where grupo_posicion is not null window w as (partition by grupo_posicion)) select operacion_id, grupo_posicion rol, case when not isnan(stat_minutes) then round(list_avg([x for x in [" + ", ".join(f'"{n}"' for n in _ZS) + "] if x is not null]), 5) end puntaje from z")
def role_specific_score(spark, d):
    """Mean of a role's own scores, only for rows with minutes."""
    m = table(spark, d, "modelo").select("operacion_id", st.number("stat_minutes").isNotNull().alias("con"))
    z = _role_z(spark, d).join(m, "operacion_id")
    return z.select("operacion_id", F.col("grupo_posicion").alias("rol"), F.when(F.col("con"), F.round(st.row_mean([F.col(f"`{n}`") for n in _ZS]), 5)).alias("puntaje"))


_SNAP = "case when hi - lo > 50 then 1.0 when hi - lo > 5 then 0.1 else 0.01 end"


@query(f"with r as (select grupo_posicion rol, min(v) lo, max(v) hi, quantile_cont(v, 0.75) q from (select grupo_posicion, {_num('stat_minutes')} v from modelo) where grupo_posicion is not null and v is not null group by 1) select rol, round_even(q / {_SNAP}, 0) * ({_SNAP})::double valor, ({_SNAP})::double paso from r")
def snapped_percentile(spark, d):
    """The upper quartile of minutes in a role at the step of a slider that its range calls for."""
    m = table(spark, d, "modelo").where("grupo_posicion is not null")
    q = st.quantiles(m, ["grupo_posicion"], F.col("stat_minutes"), [0.0, 0.75, 1.0])
    at = lambda p: F.max(F.when(F.col("q") == p, F.col("valor")))
    per = q.groupBy(F.col("grupo_posicion").alias("rol")).agg(at(0.0).alias("lo"), at(0.75).alias("v"), at(1.0).alias("hi"))
    gap = F.col("hi") - F.col("lo")
    step = F.when(gap > 50, 1.0).when(gap > 5, 0.1).otherwise(0.01)
    return per.select("rol", st.snapped(F.col("v"), step).alias("valor"), step.alias("paso"))


@query("select operacion_id, " + ", ".join(f"coalesce(grupo_posicion = '{r}', false)::int \"rol_{i}\"" for i, r in enumerate(ROLES)) + " from modelo")
def one_hot_roles(spark, d):
    """Indicator columns of the seven roles; an unknown role has none."""
    return table(spark, d, "modelo").select("operacion_id", *[c.alias(f"rol_{i}") for i, c in enumerate(rel.indicators(F.col("grupo_posicion"), ROLES))])


@query("select metrica, " + ", ".join(f"max(valor) filter (rol = '{r}') \"{r}\"" for r in ROLES) + " from (" + " union all ".join(f"select grupo_posicion rol, '{c}' metrica, round(avg({_num(c)}), 5) valor from modelo group by 1" for c in BASE) + ") group by 1")
def transposed_means(spark, d):
    """Means by role, laid with metrics as rows and roles as columns."""
    m = table(spark, d, "modelo").select("grupo_posicion", *[st.number(c).alias(c) for c in BASE])
    return rel.transposed(m.groupBy("grupo_posicion").agg(*[F.round(F.avg(c), 5).alias(c) for c in BASE]), "grupo_posicion", BASE, ROLES, "metrica")


@query(f"with x as (select median(edad_al_fichaje) m from modelo) select operacion_id, coalesce(edad_al_fichaje, m)::double edad, (edad_al_fichaje is null)::int falta from modelo, x")
def median_impute(spark, d):
    """The median age for the missing ones, with an indicator."""
    m = table(spark, d, "modelo").select("operacion_id", "edad_al_fichaje")
    middle = st.quantiles(m, [], F.col("edad_al_fichaje"), [0.5]).agg(F.max("valor").alias("m"))
    return st.one_row(m, middle).select("operacion_id", F.coalesce(F.col("edad_al_fichaje").cast("double"), "m").alias("edad"), F.col("edad_al_fichaje").isNull().cast("int").alias("falta"))


# --- filters, flags and sets -----------------------------------------------------------------

_XOR = f"(coalesce({_ROLE_SQL} = 'Arquero', false) <> coalesce(altura_cm >= 195, false))"


@query(f"select coalesce(temporada_fichaje, 'sin dato') temporada, count(*) n, count(distinct jugador_tm_id) jugadores from plata where coalesce(tiene_historial, false) and coalesce(tipo_operacion <> 'desconocido', true) and not {_XOR} group by 1")
def population_filter(spark, d):
    """Rows with a history, of no unknown kind, on which two signs of a goalkeeper agree."""
    role = rel.recode(F.col("posicion_tm"), ROLE_OF)
    broken = rel.flag(role == "Arquero") != rel.flag(F.col("altura_cm") >= 195)
    p = table(spark, d, "plata").where(rel.flag(F.col("tiene_historial")) & rel.not_in(F.col("tipo_operacion"), ["desconocido"]) & ~broken)
    return p.groupBy(F.coalesce("temporada_fichaje", F.lit("sin dato")).alias("temporada")).agg(F.count("*").alias("n"), F.count_distinct("jugador_tm_id").alias("jugadores"))


@query("select count(*) n, count(try_cast(jugador_tm_id as double)) numeros, count(jugador_tm_id) - count(try_cast(jugador_tm_id as double)) otros, min(try_cast(jugador_tm_id as double)) menor from modelo")
def coerce_numeric(spark, d):
    """Text to numbers where it is one; anything else is missing."""
    v, n = F.col("jugador_tm_id"), F.col("jugador_tm_id").try_cast("double")
    return table(spark, d, "modelo").agg(F.count("*").alias("n"), F.count(n).alias("numeros"), (F.count(v) - F.count(n)).alias("otros"), F.min(n).alias("menor"))


_TOP5_SQL = ", ".join(f"'{c}'" for c in TOP5)


@query(f"select coalesce(club_origen_liga_id in ({_TOP5_SQL}), false) top5, coalesce(club_origen_liga_es_top5, false) dicho, count(*) n from plata group by 1, 2")
def league_membership(spark, d):
    """Leagues of a fixed set against what the rows say; an unknown league is none of them."""
    p = table(spark, d, "plata")
    return p.groupBy(rel.flag(F.col("club_origen_liga_id").isin(TOP5)).alias("top5"), rel.flag(F.col("club_origen_liga_es_top5")).alias("dicho")).agg(F.count("*").alias("n"))


_RANK_SQL = "(select nullif(regexp_replace(regexp_extract(uefa_club_id, '^\\D*(\\d+)(?:\\.\\d+)?\\D*$', 1), '^0+', ''), '') club, min(uefa_ranking) rk from uefa group by 1)"


@query(f"select club, rk, coalesce(rk <= 20, false) top_20, coalesce(rk <= 50, false) top_50 from {_RANK_SQL} where club is not null")
def rank_flags(spark, d):
    """Best rank of each club with the flags of both cuts; no rank is in neither."""
    u = table(spark, d, "uefa").select(plain_digits(F.col("uefa_club_id")).alias("club"), "uefa_ranking").where("club is not null")
    return u.groupBy("club").agg(F.min("uefa_ranking").alias("rk")).select("club", "rk", rel.flag(F.col("rk") <= 20).alias("top_20"), rel.flag(F.col("rk") <= 50).alias("top_50"))


@query("select 'en ambos' grupo, count(*) n from (select club_destino_id from plata intersect select club_origen_id from plata) where club_destino_id is not null union all select 'solo destino', count(*) from (select club_destino_id from plata except select club_origen_id from plata) where club_destino_id is not null")
def set_tests(spark, d):
    """Clubs that are both, or destination only."""
    p = table(spark, d, "plata")
    a, b = p.select(F.col("club_destino_id").alias("c")).where("c is not null").distinct(), p.select(F.col("club_origen_id").alias("c")).where("c is not null").distinct()
    count = lambda x, y: x.agg(F.count("*").alias("n")).select(F.lit(y).alias("grupo"), "n")
    return count(a.join(b, "c", "left_semi"), "en ambos").unionByName(count(a.join(b, "c", "left_anti"), "solo destino"))


@query(f"select count(*) jugadores, count_if(pliegues > 1)::bigint en_varios from (select jugador_tm_id, count(distinct {_FOLD.format('jugador_tm_id')}) pliegues from modelo where jugador_tm_id is not null group by 1)")
def leak_check(spark, d):
    """Players whose rows fall in more than one fold: there may be none."""
    m = table(spark, d, "modelo").where("jugador_tm_id is not null").select("jugador_tm_id", ev.fold_of(F.col("jugador_tm_id"), 5).alias("f"))
    return m.groupBy("jugador_tm_id").agg(F.count_distinct("f").alias("k")).agg(F.count("*").alias("jugadores"), F.count_if(F.col("k") > 1).alias("en_varios"))


# --- nested statistics -----------------------------------------------------------------------

_SEASON = "2025/2026"


@query(f"""{_TREE}, s as (select registro, ruta, v ->> '$.seasonName' label from t where clave = 'statSeasons' and json_type(v) = 'OBJECT')
select t.registro, t.ruta, t.v ->> '$.name' nombre, t.v ->> '$.entryId' entrada_id from t join s on s.registro = t.registro and starts_with(t.ruta, s.ruta || '/') where t.tabla = 'fotmob' and t.clave = 'tournaments' and json_type(t.v) = 'OBJECT' and s.label in ('{_SEASON}', '{_SEASON.split('/')[0]}') and t.v ->> '$.hasDeepStats' = 'true'""")
def season_tournaments(spark, d):
    """A season's tournaments with detailed statistics, under either label of the season."""
    from pampero.operators.nested import flat_table, occurrences, stored
    from pampero.plans.datasets import ARRAY_KEYS

    f = table(spark, d, "fotmob")
    bridge, store = stored(occurrences(f, "fotmob", f.registro_id, {"statseasons": "statSeasons"}, ARRAY_KEYS))
    season = flat_table(bridge, store, F.col("clave") == "statSeasons", {"label": "seasonName"}).where(F.col("label").isin(_SEASON, _SEASON.split("/")[0]))
    deep = flat_table(bridge, store, F.col("clave") == "tournaments", {"nombre": "name", "entrada_id": "entryId", "detalle": "hasDeepStats"}).where("detalle = 'true'")
    return deep.withColumn("s", F.regexp_extract("ruta", r"^(statSeasons/\d+)", 1)).join(season.select("registro", F.col("ruta").alias("s")), ["registro", "s"]).select("registro", "ruta", "nombre", "entrada_id")


@query("select fila_id, cast(json_extract(overallranking, '$.position') as int) puesto, round(cast(json_extract(overallranking, '$.totalValue') as double), 6) total, json_extract_string(overallranking, '$.trend') tendencia from uefa where json_valid(overallranking) and json_type(overallranking) = 'OBJECT' and coalesce(json_type(overallranking, '$.position') in ('NULL', 'UBIGINT', 'BIGINT'), true) and coalesce(json_type(overallranking, '$.totalValue') in ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE'), true)")
def ranking_members(spark, d):
    """Rank, coefficient and trend out of the ranking's own JSON, where they have the kind they should."""
    o = F.col("overallranking")
    u = table(spark, d, "uefa").select("fila_id", F.try_parse_json(o).alias("j"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("j", f"$.{k}", "variant"))
    ok = lambda k, *kinds: F.coalesce(F.regexp_extract(kind(k), r"^(\w+)", 1).isin("VOID", *kinds), F.lit(True))
    whole = F.schema_of_variant("j").startswith("OBJECT")
    return u.where(F.col("j").isNotNull() & whole & ok("position", "BIGINT") & ok("totalValue", "BIGINT", "DECIMAL", "DOUBLE")).select("fila_id", F.try_variant_get("j", "$.position", "int").alias("puesto"), F.round(F.try_variant_get("j", "$.totalValue", "double"), 6).alias("total"), F.try_variant_get("j", "$.trend", "string").alias("tendencia"))


# --- resolution ------------------------------------------------------------------------------

_NAMES = f"""n as (select club_origen_id id, min(club_origen) n, min(club_origen_pais) c from plata where club_origen_id is not null and club_origen is not null group by 1),
a as (select distinct uefa_pais c, trim(uefa_club_id) destino, unnest([uefa_nombre, uefa_nombre_oficial, uefa_nombre_internacional, uefa_nombre_corto]) n from uefa),
nk as (select id, {_FOLD_SQL.format('c')} b, {_TOKENS_SQL.format('n')} k from n), ak as (select destino, {_FOLD_SQL.format('c')} b, {_TOKENS_SQL.format('n')} k from a where n is not null)"""


@query(f"""with {_NAMES}, e as (select id, min(destino) destino from nk join ak on nk.k = ak.k and nk.b = ak.b where len(nk.k) > 0 group by 1),
s as (select id, min(destino) destino from nk join ak on nk.b = ak.b and (list_has_all(nk.k, ak.k) or list_has_all(ak.k, nk.k)) where len(nk.k) > 0 and len(ak.k) > 0 and id not in (select id from e) group by 1)
select id, destino, 'exacto' metodo from e union all select id, destino, 'subconjunto' from s""")
def resolve_two_stages(spark, d):
    """The exact and the subset stage within a country."""
    names, aliases = (written(df, "two-stages") for df in _resolver(spark, d))
    got = resolve(names.where("block is not null"), aliases, stages=STAGES[:2]).where("metodo in ('exacto', 'subconjunto')")
    return got.join(aliases.select("block").distinct().join(names, "block").select("id"), "id", "left_semi").select("id", "destino", "metodo")


def _catalogue(spark: SparkSession, d: str):
    names, aliases = _resolver(spark, d, {"o": F.max("club_origen"), "orden": F.min("operacion_id")})
    sources = names.select("id", "orden", "block", "tokens", name_tokens(fold_text(F.col("o"))).alias("otros_tokens"))
    ranks = table(spark, d, "uefa").groupBy(F.trim("uefa_club_id").alias("destino")).agg(F.min("uefa_ranking").alias("puesto"))
    return catalogue(sources, written(aliases, "catalogue-aliases"), ranks, 100)


@query()
def club_catalogue(spark, d):
    """Clubs tied to the ranking one to one, in its order, up to rank 100."""
    return _catalogue(spark, d)[0].select("id", "destino", "metodo", "puesto", "lugar")


@query()
def unmatched_report(spark, d):
    """The clubs that found no place in the catalogue, and why."""
    return _catalogue(spark, d)[1]


@query()
def catalogue_coverage(spark, d):
    """Share of the clubs that found a place, repeated entries of a club left out."""
    return match_coverage(*_catalogue(spark, d))


_T = lambda c: f"coalesce({_TOKENS_SQL.format(c)}, [])"


@query(f"""with p as (select jugador_tm_id id, min(nombre) nombre, min(club_destino) cd, min(club_origen) co from plata where jugador_tm_id is not null and nombre is not null group by 1),
f as (select distinct registro_id, jugador_fotmob_id, {_FOLD_SQL.format('nombre_fotmob')} k, club_actual_fotmob e from fotmob where nombre_fotmob is not null),
c as (select id, registro_id, jugador_fotmob_id cand, case when list_has_any({_T('e')}, {_T('cd')}) then 3 when list_has_any({_T('e')}, {_T('co')}) then 2 else 0 end pts from p join f on {_FOLD_SQL.format('p.nombre')} = f.k)
select id, max_by(cand, (pts, -registro_id)) candidato, case max(pts) when 3 then 'club_destino' when 2 then 'club_origen' else case when count(distinct cand) = 1 then 'unica_sugerencia' else 'primera_sugerencia' end end metodo, count(distinct cand) candidatos from c group by 1""")
def homonym_overlap(spark, d):
    """Of the profiles with a player's name the one whose club shares a word with the destination, else with the origin, else the first."""
    p = table(spark, d, "plata").where("jugador_tm_id is not null and nombre is not null").groupBy(F.col("jugador_tm_id").alias("id")).agg(F.min("nombre").alias("nombre"), F.min("club_destino").alias("cd"), F.min("club_origen").alias("co"))
    toks = lambda c: name_tokens(fold_text(F.col(c)))
    f = table(spark, d, "fotmob").where("nombre_fotmob is not null").select(fold_text(F.col("nombre_fotmob")).alias("k"), F.col("jugador_fotmob_id").alias("candidato"), F.col("registro_id").alias("pos"), toks("club_actual_fotmob").alias("equipo"))
    c = p.select("id", fold_text(F.col("nombre")).alias("k"), toks("cd").alias("destino"), toks("co").alias("origen")).join(f, "k").withColumn("puntos_fuente", F.lit(0.0))
    return pick_homonym(c, ["id"])


@query("""with f as (select p_partkey, lower(p_name) a, lower(string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[-1]) b, lower(string_split(p_name, ' ')[-1]) c from part),
k as (select lower(p_name) x from part where p_partkey % 7 = 0 union select lower(string_split(p_name, ' ')[-1]) from part where p_partkey % 3 = 0)
select p_partkey, case when a in (select x from k) then a when b in (select x from k) then b when c in (select x from k) then c end forma from f""")
def first_variant_with_hits(spark, d):
    """The first of a name's forms (whole, ends, last word) that finds anything; later forms are not tried then."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("w"))
    known = p.where("p_partkey % 7 = 0").select(F.lower("p_name").alias("forma")).union(p.where("p_partkey % 3 = 0").select(F.lower(F.element_at("w", -1)))).distinct()
    tried = p.select("p_partkey", F.posexplode(rel.name_forms(F.col("w"))).alias("i", "forma"))
    hit = tried.join(known, "forma", "left_semi").groupBy("p_partkey").agg(F.min_by("forma", "i").alias("forma"))
    return p.select("p_partkey").join(hit, "p_partkey", "left")


# --- evaluation ------------------------------------------------------------------------------

@query(f"with r as (select f, t, rank() over (partition by f order by s) + (count(*) over (partition by f, s) - 1) / 2.0 r from {_SCORED}) select f pliegue, round((sum(r) filter (t) - count_if(t) * (count_if(t) + 1) / 2.0) / (count_if(t) * count_if(not t)::double), 6) auc from r group by 1")
def auc_by_fold(spark, d):
    """Area under the curve of each fold."""
    return ev.roc_auc(ev.curve(_scored(spark, d), "t", "s", ["f"]), ["f"]).select(F.col("f").alias("pliegue"), "auc")


_H = "('0x' || substr(md5(operacion_id), 1, 8))::bigint % 64"


@query(f"""with m as (select operacion_id k, coalesce(es_destino_top_20, false) t, {_H} b from modelo), r as (select t, (row_number() over (partition by t, b order by md5(k), k) - 1 + b) % 5 f from m)
select f::int pliegue, count(*) n, count_if(t)::bigint positivos from r group by 1""")
def stratified_split(spark, d):
    """Folds with like shares of both classes, without regard to players."""
    s = ev.stratified_rows(table(spark, d, "modelo").select("operacion_id", "es_destino_top_20"), "operacion_id", F.col("es_destino_top_20"), 5)
    return s.groupBy(F.col("fold").alias("pliegue")).agg(F.count("*").alias("n"), F.count_if(rel.flag(F.col("es_destino_top_20"))).alias("positivos"))


@query("""with b as (select o_orderkey k, o_totalprice x, o_orderstatus y, ('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint % 64 g from orders),
o as (select *, row_number() over (partition by g order by k) i, row_number() over (partition by g order by md5('7' || k::varchar), k) j from b), s as (select a.k, a.x, z.x x2, z.y y2 from o a join o z on a.g = z.g and a.i = z.j)
select round(avg(x2), 4) media, round(corr(x, x2), 6) correlacion, count(*) n, min(y2) menor from s""")
def permuted_columns(spark, d):
    """A block of columns shuffled by a seeded permutation: the same values, no longer tied to their rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    p = ev.permuted_block(o, "o_orderkey", ["o_totalprice", "o_orderstatus"], "7").select("o_orderkey", F.col("o_totalprice").alias("x2"), F.col("o_orderstatus").alias("y2"))
    return o.join(p, "o_orderkey").agg(F.round(F.avg("x2"), 4).alias("media"), F.round(st.corr(F.col("o_totalprice"), F.col("x2")), 6).alias("correlacion"), F.count("*").alias("n"), F.min("y2").alias("menor"))


_ERR = """case when not t and s >= 0.5 then 'FP' when t and s < 0.5 then 'FN' end"""


@query(f"""with x as (select jugador_tm_id, es_destino_top_20 t, least(stat_minutes, 3600) / 3600 s, stat_minutes m, edad_al_fichaje e, club_origen_liga_es_top5 l from modelo where not isnan(stat_minutes) and jugador_tm_id is not null),
k as (select {_ERR} error, case when not t and s >= 0.5 then case when l then 'liga' when e >= 28 then 'veteranos' when e <= 21 then 'jovenes' else 'casi' end when t and s < 0.5 then case when m < 900 then 'sin_minutos' when e <= 21 then 'jovenes' when not l then 'sin_peso' else 'otros' end end tipo from x)
select error, tipo, count(*) n from k where error is not null group by 1, 2""")
def error_taxonomy(spark, d):
    """False alarms and misses by the first reason that holds."""
    m = table(spark, d, "modelo").where(F.col("stat_minutes").isNotNull() & ~F.isnan("stat_minutes") & F.col("jugador_tm_id").isNotNull())
    t, p = F.col("es_destino_top_20"), F.least("stat_minutes", F.lit(3600.0)) / 3600 >= 0.5
    league, e = F.col("club_origen_liga_es_top5"), F.col("edad_al_fichaje")
    alarm = rel.first_match([(league, "liga"), (e >= 28, "veteranos"), (e <= 21, "jovenes")], "casi")
    miss = rel.first_match([(F.col("stat_minutes") < 900, "sin_minutos"), (e <= 21, "jovenes"), (~league, "sin_peso")], "otros")
    k = m.select(F.when(~t & p, "FP").when(t & ~p, "FN").alias("error"), F.when(~t & p, alarm).when(t & ~p, miss).alias("tipo")).where("error is not null")
    return k.groupBy("error", "tipo").agg(F.count("*").alias("n"))


@query("""with a as (select operacion_id o, jugador_tm_id j, club_destino_id c, temporada_fichaje t from modelo where es_destino_top_20 and jugador_tm_id is not null and club_destino_id is not null), s as (select jugador_tm_id j, club_origen_id c, temporada_fichaje t from plata),
x as (select a.o, a.c, count(s.t) later from a left join s on s.j = a.j and s.c = a.c and s.t > a.t where a.t < (select max(temporada_fichaje) from plata) group by 1, 2)
select c club, count(*) llegaron, round(avg((later > 0)::int), 6) se_fueron from x group by 1""")
def departures_by_club(spark, d):
    """Of the arrivals at each great club, the share that left it in a later season; the last season has no later one."""
    a = table(spark, d, "modelo").where("es_destino_top_20 and jugador_tm_id is not null and club_destino_id is not null").select(F.col("jugador_tm_id").alias("j"), F.col("club_destino_id").alias("c"), F.col("temporada_fichaje").alias("t")).where("t is not null")
    p = table(spark, d, "plata")
    s = p.select(F.col("jugador_tm_id").alias("j"), F.col("club_origen_id").alias("c"), F.col("temporada_fichaje").alias("t")).where("j is not null and c is not null and t is not null")
    last = p.agg(F.max("temporada_fichaje").alias("m"))
    got = st.one_row(rel.later_events(a, s, ["j", "c"], "t"), last).where("t < m")
    return got.groupBy(F.col("c").alias("club")).agg(F.count("*").alias("llegaron"), F.round(F.avg((F.col("later") > 0).cast("double")), 6).alias("se_fueron"))


@query("""select club_origen club, count(*) fichajes, max_by(club_origen_pais_coeficiente_uefa, (temporada_fichaje, operacion_id)) filter (club_origen_pais_coeficiente_uefa is not null and temporada_fichaje is not null) coeficiente, max_by(club_origen_liga_es_top5, (temporada_fichaje, operacion_id)) filter (club_origen_liga_es_top5 is not null and temporada_fichaje is not null) top5 from modelo where club_origen is not null group by 1""")
def serving_clubs(spark, d):
    """Each club's rows and its newest known values."""
    m = table(spark, d, "modelo").where("club_origen is not null")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("temporada_fichaje").isNotNull(), F.struct("temporada_fichaje", "operacion_id")))
    return m.groupBy(F.col("club_origen").alias("club")).agg(F.count("*").alias("fichajes"), newest("club_origen_pais_coeficiente_uefa").alias("coeficiente"), newest("club_origen_liga_es_top5").alias("top5"))


# --- gate ------------------------------------------------------------------------------------

_GATE = ["operacion_id", "jugador_tm_id", "club_destino", "tipo_operacion", "edad_al_fichaje", "altura_cm", "stat_minutes", "stat_rating"]


@query("select * replace (violaciones::bigint as violaciones) from (" + " union all ".join(f"select 'columna_vacia:{c}' control, (count({c}) = 0)::int violaciones from plata" for c in _GATE) + f""" union all select 'tipos_excluidos', count_if(tipo_operacion in ('fin_de_cesion', 'retiro')) from plata
union all select 'historial_si_y_solo_si_metricas', count_if(coalesce(tiene_historial, false) <> (coalesce(stat_minutes, stat_matches, stat_goals, stat_assists, stat_rating) is not null)) from plata
union all select 'columnas_minimas', greatest(30 - 34, 0) union all select 'columnas_que_faltan', 0 union all select 'posicion_sin_rol', count_if(posicion_tm is not null and {_ROLE_SQL} is null) from plata)""")
def gate_report(spark, d):
    """Empty and missing columns, excluded kinds, history in both directions, positions without a role."""
    from pampero.operators.quality import columns_at_least, missing_columns, rows_where

    p = table(spark, d, "plata")
    any_metric = F.coalesce(*[F.col(c) for c in ("stat_minutes", "stat_matches", "stat_goals", "stat_assists", "stat_rating")]).isNotNull()
    checks: list[Check] = [*empty_columns(_GATE), rows_where("tipos_excluidos", F.col("tipo_operacion").isin("fin_de_cesion", "retiro")), rows_where("historial_si_y_solo_si_metricas", rel.flag(F.col("tiene_historial")) != any_metric), columns_at_least(p, 30), missing_columns(p, _GATE), unmapped("posicion_sin_rol", F.col("posicion_tm"), ROLE_OF)]
    return report(p, checks)


@query("select count(*) filas, 34::bigint columnas, count(distinct club_destino) destinos, round(100 * avg(es_destino_top_20::int), 4) positivos_pct, count_if(not coalesce(tiene_historial, false))::bigint sin_estadisticas from plata")
def success_metrics(spark, d):
    """What a run logs of the table it publishes."""
    p = table(spark, d, "plata")
    return p.agg(F.count("*").alias("filas"), F.lit(len(p.columns)).cast("bigint").alias("columnas"), F.count_distinct("club_destino").alias("destinos"), F.round(100 * F.avg(F.col("es_destino_top_20").cast("double")), 4).alias("positivos_pct"), F.count_if(~rel.flag(F.col("tiene_historial"))).alias("sin_estadisticas"))

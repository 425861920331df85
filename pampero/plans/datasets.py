"""The general training-data queries: snapshots, nested records, small files, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pampero.functions.text import composed, plain_date, plain_digits
from pampero.operators.imputation import impute, model_plan
from pampero.operators.nested import flat_table, occurrences, stored
from pampero.operators.snapshots import snapshot_changes
from pampero.session import scratch, table
from pampero.streaming.compactor import compact_arrivals

ARRAY_KEYS = frozenset(["playerInformation", "statSeasons", "tournaments", "items", "seasonRankings", "phases"])


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    """All changes with the hashes of both sides."""
    u = table(spark, d, "uefa")
    compared = {"uefa_ranking": F.col("uefa_ranking"), "uefa_coeficiente": F.round("uefa_coeficiente", 3) + F.lit(0.0), "uefa_nombre": F.col("uefa_nombre")}
    return snapshot_changes(u, plain_date(u.actualizacion), plain_digits(u.uefa_club_id), [u.aterrizado_el, u.fila_id], compared, {"uefa_nombre": composed})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_changes(spark, d).select(F.date_format("snapshot", "yyyy-MM-dd").alias("actualizacion"), F.col("key").alias("uefa_club_id"), F.col("change").alias("cambio"))


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    f, u = table(spark, d, "fotmob"), table(spark, d, "uefa")
    a = occurrences(f, "fotmob", f.registro_id, {"playerinformation": "playerInformation", "statseasons": "statSeasons"}, ARRAY_KEYS)
    return a.union(occurrences(u, "uefa", u.fila_id, {"overallranking": "overallRanking"}, ARRAY_KEYS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d).where("es_elemento").select("tabla", "registro", "ruta")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The store: each distinct object once, with the number of its occurrences in the bridge."""
    bridge, store = stored(_bridge(spark, d))
    return store.join(bridge.groupBy("nodo").agg(F.count("*").alias("veces")), "nodo")


def p2_puente(spark: SparkSession, d: str) -> DataFrame:
    """The bridge: every occurrence of an object with its own node and its parent's."""
    return _bridge(spark, d).drop("contenido")


def _flat(key_condition: str, fields: dict[str, str], keep: str | None = None):
    def query(spark: SparkSession, d: str) -> DataFrame:
        bridge, store = stored(_bridge(spark, d))
        return flat_table(bridge, store, F.expr(key_condition), fields, F.expr(keep) if keep else None).drop("nodo", "padre_nodo")

    return query


def p2_informacion(spark: SparkSession, d: str) -> DataFrame:
    """Items of information; a value that is an object or array is ``anidado`` and stands in rows of its own."""
    got = _flat("clave = 'playerInformation'", {"titulo": "title", "valor": "value"})(spark, d)
    nested = F.coalesce(F.col("valor").rlike("^#[0-9a-f]{32}$"), F.lit(False))
    return got.withColumns({"anidado": nested, "valor": F.when(~nested, F.col("valor"))})


p2_temporadas = _flat("clave = 'statSeasons'", {"temporada": "seasonName"})
p2_torneos = _flat("clave = 'tournaments'", {"nombre": "name", "entrada_id": "entryId", "torneo_id": "tournamentId", "detalle": "hasDeepStats"})
p2_bloques = _flat("clave in ('topStatCards', 'topStatCard', 'statsSection', 'items')", {"titulo": "title"}, "clave <> 'items' or contenido like '%\"items\":#%'")
p2_metricas = _flat("clave = 'items'", {"titulo": "title", "valor": "statValue"}, "contenido not like '%\"items\":#%'")
p2_rankings = _flat("clave = 'seasonRankings'", {"anio": "seasonYear", "puntos": "points"})
p2_fases = _flat("clave = 'phases'", {"nombre": "name", "puntos": "points"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The second run takes what landed during the first; where nothing did, it publishes nothing."""
    home = scratch(spark, "compact")
    compact_arrivals(spark, f"{d}/bronce.parquet", home)
    return compact_arrivals(spark, f"{d}/bronce.parquet", home).select("operacion_id", "archivo_id")


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    """The model population with its cells filled and marked."""
    return impute(table(spark, d, "modelo"), model_plan()).select("operacion_id", "stat_goals", "grupo_posicion", "edad_al_fichaje", "stat_goals_imputado", "grupo_posicion_imputado", "edad_al_fichaje_imputado")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    fields = ["stat_goals", "grupo_posicion", "edad_al_fichaje"]
    marks = F.array(*[F.when(F.col(f"{n}_imputado"), F.lit(n)) for n in fields])
    return p6_filled(spark, d).select("operacion_id", F.explode(F.array_compact(marks)).alias("campo"))


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p2_found, p2_nodes, p2_puente, p5_found, p6_found, p6_filled)} | {n: globals()[n] for n in ("p2_informacion", "p2_temporadas", "p2_torneos", "p2_bloques", "p2_metricas", "p2_rankings", "p2_fases")}

_ID = r"nullif(regexp_replace(regexp_extract({0}, '^\D*(\d+)(?:\.\d+)?\D*$', 1), '^0+', ''), '')"
_DAY = r"case when trim({0}) ~ '^\d{{4}}-\d{{2}}-\d{{2}}([T ].*)?$' then try_cast(substr(trim({0}), 1, 10) as date) when trim({0}) ~ '^\d{{2}}/\d{{2}}/\d{{4}}$' then try_cast(substr(trim({0}), 7, 4) || '-' || substr(trim({0}), 4, 2) || '-' || substr(trim({0}), 1, 2) as date) end"
_P1 = f"""
with r as (select {_DAY.format('actualizacion')} s, {_ID.format('uefa_club_id')} k, uefa_ranking rk, round(uefa_coeficiente, 3) co,
             regexp_replace(nfc_normalize(uefa_nombre), '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200d}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+', '', 'g') nm, aterrizado_el, fila_id from uefa),
l as (select * from r where s is not null and k is not null qualify row_number() over (partition by s, k order by aterrizado_el desc nulls last, fila_id desc) = 1),
dt as (select s, lead(s) over (order by s) nx, lag(s) over (order by s) pv from (select distinct s from l)),
b as (select dt.nx s, k, rk, co, nm from l join dt using (s) where dt.nx is not null),
a as (select l.s, k, rk, co, nm from l join dt on l.s = dt.s where dt.pv is not null)
select strftime(coalesce(a.s, b.s), '%Y-%m-%d') actualizacion, coalesce(a.k, b.k) uefa_club_id,
  case when b.k is null then 'alta' when a.k is null then 'baja' else 'cambio' end cambio
from b full join a on a.s = b.s and a.k = b.k
where a.k is null or b.k is null or a.rk is distinct from b.rk or a.co is distinct from b.co or a.nm is distinct from b.nm
"""
_ARRAYS = "(" + ", ".join(f"'{k}'" for k in sorted(ARRAY_KEYS)) + ")"
#: Under an array key: the array, an array or object given as JSON text, a single object as its element 0.
_ARRAY = f"""case when not ({{k}}) in {_ARRAYS} then {{v}} when json_type({{v}}) = 'OBJECT' then json_array({{v}})
 when json_type({{v}}) = 'VARCHAR' and coalesce(json_valid({{v}} ->> '$'), false) then case json_type(({{v}} ->> '$')::json) when 'ARRAY' then ({{v}} ->> '$')::json when 'OBJECT' then json_array(({{v}} ->> '$')::json) else {{v}} end else {{v}} end"""
_ROOTS = " union all ".join(
    f"select '{t}' tabla, {r} registro, '{k}' ruta, null::varchar padre_ruta, '{k}' clave, null::int ordinal, {_ARRAY.format(k=repr(k), v=f'{c}::json')} v, false elem, '' arriba from {t} where coalesce(json_valid({c}), false)"
    for t, r, c, k in (("fotmob", "registro_id", "playerinformation", "playerInformation"), ("fotmob", "registro_id", "statseasons", "statSeasons"), ("uefa", "fila_id", "overallranking", "overallRanking"))
)
_TREE = f"""with recursive t as ({_ROOTS} union all
select t.tabla, t.registro, t.ruta || '/' || e.key, case when json_type(t.v) = 'OBJECT' then t.ruta else t.padre_ruta end, case when json_type(t.v) = 'ARRAY' then t.clave else e.key end,
 case when json_type(t.v) = 'ARRAY' then e.key::int end, case when json_type(t.v) = 'ARRAY' then e.value else {_ARRAY.format(k='e.key', v='e.value')} end, json_type(t.v) = 'ARRAY' and json_type(e.value) = 'OBJECT' and t.clave in {_ARRAYS}, json_type(t.v)
from t, json_each(t.v) e where json_type(t.v) in ('ARRAY', 'OBJECT'))
"""


def _flat_sql(condition: str, fields: dict[str, str]) -> str:
    values = ", ".join(f"v ->> '$.{k}' {c}" for c, k in fields.items())
    return f"{_TREE} select tabla, registro, ruta, padre_ruta, clave, ordinal, {values} from t where json_type(v) = 'OBJECT' and {condition}"


_NESTED = f"coalesce(json_type({_ARRAY.format(k=repr('items'), v='(v -> ' + repr('$.items') + ')')}) in ('ARRAY', 'OBJECT'), false)"
_ROLES = "('Arquero','Defensor central','Lateral','Mediocampo defensivo','Mediocampo ofensivo','Delantero extremo','Delantero centro')"
SQL = {
    "p1_found": _P1,
    "p1_changes": f"""
with r as (select {_DAY.format('actualizacion')} s, {_ID.format('uefa_club_id')} k, aterrizado_el, fila_id, sha256(concat_ws(chr(31), coalesce('=' || uefa_ranking::varchar, '~'), coalesce('=' || (round(uefa_coeficiente, 3) + 0.0)::double::varchar, '~'),
             coalesce('=' || regexp_replace(nfc_normalize(uefa_nombre), '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200d}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+', '', 'g'), '~'))) h from uefa),
l as (select * from r where s is not null and k is not null qualify row_number() over (partition by s, k order by aterrizado_el desc nulls last, fila_id desc) = 1),
dt as (select s, lead(s) over (order by s) nx, lag(s) over (order by s) pv from (select distinct s from l)),
b as (select dt.nx s, k, h from l join dt using (s) where dt.nx is not null), a as (select l.s, k, h from l join dt on l.s = dt.s where dt.pv is not null)
select coalesce(a.s, b.s) snapshot, coalesce(a.k, b.k) "key", case when b.k is null then 'alta' when a.k is null then 'baja' else 'cambio' end change, b.h hash_before, a.h hash_after
from b full join a on a.s = b.s and a.k = b.k where a.h is distinct from b.h""",
    "p2_informacion": f"{_TREE} select tabla, registro, ruta, padre_ruta, clave, ordinal, v ->> '$.title' titulo, case when coalesce(json_type(v, '$.value'), '') not in ('OBJECT', 'ARRAY') then v ->> '$.value' end valor, coalesce(json_type(v, '$.value') in ('OBJECT', 'ARRAY'), false) anidado from t where json_type(v) = 'OBJECT' and clave = 'playerInformation'",
    "p2_found": f"{_TREE} select tabla, registro, ruta from t where elem",
    "p2_temporadas": _flat_sql("clave = 'statSeasons'", {"temporada": "seasonName"}),
    "p2_torneos": _flat_sql("clave = 'tournaments'", {"nombre": "name", "entrada_id": "entryId", "torneo_id": "tournamentId", "detalle": "hasDeepStats"}),
    "p2_bloques": _flat_sql(f"clave in ('topStatCards', 'topStatCard', 'statsSection', 'items') and (clave <> 'items' or {_NESTED})", {"titulo": "title"}),
    "p2_metricas": _flat_sql(f"clave = 'items' and not {_NESTED}", {"titulo": "title", "valor": "statValue"}),
    "p2_rankings": _flat_sql("clave = 'seasonRankings'", {"anio": "seasonYear", "puntos": "points"}),
    "p2_fases": _flat_sql("clave = 'phases'", {"nombre": "name", "puntos": "points"}),
    "p6_found": f"""
select operacion_id, 'stat_goals' campo from modelo where stat_goals is null or isnan(stat_goals) or stat_goals < 0 or stat_goals <> floor(stat_goals)
union all select operacion_id, 'edad_al_fichaje' from modelo where edad_al_fichaje is null or edad_al_fichaje not between 14 and 45
union all select operacion_id, 'grupo_posicion' from modelo where grupo_posicion is null or grupo_posicion not in {_ROLES}
""",
}

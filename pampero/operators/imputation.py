"""Missing values from similar records: alternating least squares over mixed encoded cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from dataclasses import dataclass, field
from pyspark.sql import Column, DataFrame, functions as F

from pampero.session import written


@dataclass
class Numeric:
    """A numeric feature: its usable value (null where there is none), optionally on the log1p scale, and how a filled value is made valid."""

    value: Column
    log: bool = False
    low: float | None = None
    high: float | None = None
    whole: bool = False


@dataclass
class Plan:
    numeric: dict[str, Numeric]
    flags: dict[str, Column] = field(default_factory=dict)
    categorical: dict[str, tuple[Column, list[str]]] = field(default_factory=dict)
    present: list[str] = field(default_factory=list)


def _encoded(df: DataFrame, plan: Plan) -> tuple[list[str], list[Column]]:
    """Names and columns of the cells: numbers, flags as 0/1, one column per level, and 0/1 for the presence of optional metrics."""
    names, cols = [], []
    for n, spec in plan.numeric.items():
        names.append(n)
        cols.append(F.log1p(spec.value) if spec.log else spec.value.cast("double"))
    for n, c in plan.flags.items():
        names.append(n)
        cols.append(c.cast("double"))
    for n, (c, levels) in plan.categorical.items():
        for level in levels:
            names.append(f"{n}={level}")
            cols.append(F.when(c.isNotNull(), (c == level).cast("double")))
    for n in plan.present:
        names.append(f"{n}?")
        cols.append(plan.numeric[n].value.isNotNull().cast("double"))
    return names, cols


def _solve(x: np.ndarray, factors: np.ndarray, ridge: float) -> np.ndarray:
    """Row factors of a block with missing cells as NaN: one ridge system of rank k a row, all at once."""
    k = factors.shape[1]
    seen = ~np.isnan(x)
    filled = np.where(seen, x, 0.0)
    outer = (factors[:, :, None] * factors[:, None, :]).reshape(len(factors), k * k)
    left = (seen.astype(float) @ outer).reshape(-1, k, k) + ridge * np.eye(k)
    return np.linalg.solve(left, (filled @ factors)[:, :, None])[:, :, 0]


def _matrix(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(-1, width)


def impute(df: DataFrame, plan: Plan, rank: int = 4, iterations: int = 15, ridge: float = 2.0, seed: int = 7, settled: float = 0.001) -> DataFrame:
    """Every column of ``df`` with the planned numeric and categorical ones filled, and ``<name>_imputado`` beside each.

    Records and features form one matrix of standardised cells (numbers, flags, one cell per
    level). Its missing cells are estimated by ``rank`` factors found by alternating ridge
    regressions: an iteration is one pass over the encoded records, in which each task solves its
    rows and adds up, per feature, the normal equations; those sums, features x rank^2/2 numbers
    however many records there are, give the feature factors. Nothing else reaches the driver.
    It ends after ``iterations``, or once an iteration makes the squared residual less by no more
    than the share ``settled``.

    A filled number is taken back to its scale, rounded if whole and held to its bounds; a filled
    level is the one of greatest estimate. Cells with a usable value keep it. A cell counts as
    missing where the planned value is null (the plan decides what is usable, NaN and impossible
    values included). A record without any usable cell gets the means. A feature without any
    usable cell stays null and unmarked only if the table is empty. Repeated records are filled
    alike; ties go to the first level of the plan; columns that aren't in the plan pass through.
    """
    names, cols = _encoded(df, plan)
    width = len(names)
    own = next(p for p in ("_", "__", "___", "____") if not {f"{p}x", f"{p}g"} & set(df.columns))  # no name of the table's
    xs, gs = f"{own}x", f"{own}g"
    base = written(df.select("*", F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in cols]).alias(xs)), "impute-cells")
    cell = [F.nullif(F.col(xs)[i], F.lit(float("nan"))) for i in range(width)]
    sums = base.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cell) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(width)])
    std = np.array([sums[f"s{i}"] or 1.0 for i in range(width)])
    upper = np.triu_indices(rank)
    names_out = ["j", *[f"a{i}" for i in range(len(upper[0]))], *[f"b{i}" for i in range(rank)], "e"]
    schema = "j int, " + ", ".join(f"{n} double" for n in names_out[1:])
    factors = np.random.default_rng(seed).normal(0, 0.3, (width, rank))

    def sums_of(v):
        def run(batches):
            total = np.zeros((width, len(upper[0]) + rank + 1))
            for batch in batches:
                x = (_matrix(batch, 0, width) - mean) / std
                if not len(x):
                    continue
                u = _solve(x, v, ridge)
                seen = (~np.isnan(x)).astype(float)
                total[:, : len(upper[0])] += seen.T @ (u[:, upper[0]] * u[:, upper[1]])
                x = np.where(seen > 0, x, 0.0)
                total[:, len(upper[0]) : -1] += x.T @ u
                total[:, -1] += (seen * (x - u @ v.T) ** 2).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *[pa.array(total[:, i]) for i in range(total.shape[1])]], names=names_out)

        return run

    residual = float("inf")
    for _ in range(iterations):
        rows = base.select(xs).mapInArrow(sums_of(factors), schema).groupBy("j").agg(*[F.sum(n).alias(n) for n in names_out[1:]]).collect()
        for r in rows:
            left = np.zeros((rank, rank))
            left[upper] = [r[f"a{i}"] for i in range(len(upper[0]))]
            left = left + np.triu(left, 1).T + 0.1 * np.eye(rank)
            factors[r["j"]] = np.linalg.solve(left, [r[f"b{i}"] for i in range(rank)])
        now = sum(r["e"] for r in rows)
        if not rows or residual - now <= settled * residual < float("inf"):
            break
        residual = now

    def estimate(batches):
        for batch in batches:
            x = _matrix(batch, batch.schema.get_field_index(xs), width)
            guess = (_solve((x - mean) / std, factors, ridge) @ factors.T) * std + mean if len(x) else x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(guess), pa.list_(pa.float64()))], names=[*batch.schema.names, gs])

    guessed = base.mapInArrow(estimate, base.withColumn(gs, F.col(xs)).schema)
    out, at = {}, {n: i for i, n in enumerate(names)}
    for n, spec in plan.numeric.items():
        g = F.col(gs)[at[n]]
        g = F.expm1(g) if spec.log else g
        g = F.round(g) if spec.whole else g
        g = F.greatest(g, F.lit(float(spec.low))) if spec.low is not None else g
        g = F.least(g, F.lit(float(spec.high))) if spec.high is not None else g
        out[n] = (F.isnan(F.col(xs)[at[n]]), g)
    for n, (_, levels) in plan.categorical.items():
        best = F.array_max(F.array(*[F.struct(F.col(gs)[at[f"{n}={v}"]].alias("g"), F.lit(-i).alias("i")) for i, v in enumerate(levels)]))
        out[n] = (F.isnan(F.col(xs)[at[f"{n}={levels[0]}"]]), F.array(*map(F.lit, levels))[-best["i"]])
    final = []
    for c in df.columns:
        final.append(F.when(out[c][0], out[c][1].cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in out else F.col(f"`{c}`"))
    return guessed.select(*final, *[out[n][0].alias(f"{n}_imputado") for n in out if n in df.columns])


#: The seven roles (fixed values).
ROLES = ["Arquero", "Defensor central", "Lateral", "Mediocampo defensivo", "Mediocampo ofensivo", "Delantero centro", "Delantero extremo"]


def model_plan() -> Plan:
    """The plan of the model population: what is usable there, and which cells stand together."""

    def number(name: str, low: float = 0.0, high: float | None = None, whole: bool = False, log: bool = False) -> Numeric:
        c = F.col(f"`{name}`").try_cast("double")
        usable = c.isNotNull() & ~F.isnan(c) & (c >= low) & (c <= (high if high is not None else 1e12))
        return Numeric(F.when(usable & ((c == F.floor(c)) if whole else F.lit(True)), c), log, low, high, whole)

    metrics = {n: number(n, log=True) for n in ("stat_minutes", "stat_matches", "stat_assists", "stat_xg", "stat_tackles", "stat_recoveries", "stat_saves")}
    shares = {n: number(n, 0.0, 100.0) for n in ("stat_pass_accuracy", "stat_duels_won_%")}
    role = F.col("grupo_posicion")
    return Plan(
        {"stat_goals": number("stat_goals", 0.0, None, True, True), "edad_al_fichaje": number("edad_al_fichaje", 14.0, 45.0, True), **metrics, **shares, "club_origen_pais_coeficiente_uefa": number("club_origen_pais_coeficiente_uefa", log=True)},
        {n: F.col(n) for n in ("es_destino_top_20", "club_origen_liga_es_top5", "club_origen_es_filial", "club_origen_es_europeo")},
        {"grupo_posicion": (F.when(role.isin(ROLES), role), ROLES)},
        ["stat_saves", "stat_xg", "stat_tackles", "stat_duels_won_%"],
    )

"""Exact percentiles of very large groups by distributed multi-select, and summaries that can be joined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pampero.session import written


def counted_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, count) without null, NaN and infinite values: combined before the shuffle, so a hot group moves its different values only."""
    v = F.col(f"`{value}`").try_cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(usable).groupBy(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)], (v + F.lit(0.0)).alias("v")).agg(F.count("*").alias("c"))


def select_ranks(values: DataFrame, groups: list[str], wanted: DataFrame) -> DataFrame:
    """The values at given ranks (1 = smallest) of each group: columns ``groups``, rank, v.

    ``values`` holds (groups, v, c) with each v once a group; ``wanted`` holds (groups, rank).
    Open ranges (lo, hi) of a group are disjoint and know how many values lie below (base); every
    rank still sought lies in one. A round is one pass: each part of the values (a batch of rows)
    counts less than, at and above the range's pivot and proposes the weighted median of its
    values on either side. The counts settle ranks or leave two smaller ranges, of which those
    without a sought rank are discarded; the weighted median of a range's proposals is its next
    pivot. At least half of the proposals' weight lies on either side of it, and half of each
    part's own, so at least a quarter of a range goes in each round, in groups of every size. All
    ranks of a range share its pivot. A part holds as many rows as a batch, whatever its group.
    A range carries the ranks sought in it, so a caller should ask for a bounded number a group.
    """
    spark = values.sparkSession
    key = lambda: F.struct(*groups).alias("g")  # noqa: E731  equal where all its fields are, nulls included
    values = written(values.select(key(), "v", "c"), "ms-values")
    kind = values.schema["g"].dataType.simpleString()
    shape = f"id bigint, g {kind}, ranks array<bigint>, kind string, base bigint, total bigint, lo double, hi double, p double"
    names = ["id", "g", "ranks", "kind", "base", "total", "lo", "hi", "p"]
    asked = wanted.groupBy(key()).agg(F.collect_set(F.col("rank").cast("bigint")).alias("ranks"))
    first = asked.select(F.monotonically_increasing_id().alias("id"), "g", "ranks", F.lit("above").alias("kind"), F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("bigint").alias("total"), *[F.lit(float(x)).alias(n) for n, x in (("lo", "-inf"), ("hi", "inf"), ("p", "-inf"))])
    state, done = written(first, "ms-ranges"), spark.createDataFrame([], shape)
    while not (live := state.where("kind <> 'at'")).isEmpty():
        known = live.drop("kind", "total").join(_counted(values, live), "id")
        below, end = F.col("base") + F.col("less"), F.col("base") + F.col("less") + F.col("at")

        def part(name, base, upto, lo, hi, p):
            sought = F.filter("ranks", lambda r: (r > base) & (r <= upto))
            return F.struct(sought.alias("ranks"), F.lit(name).alias("kind"), base.alias("base"), (upto - base).alias("total"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(p).alias("p"))

        three = known.select("g", F.explode(F.array(part("less", F.col("base"), below, "lo", "p", "p_less"), part("at", below, end, "p", "p", "p"), part("above", end, end + F.col("above"), "p", "hi", "p_above"))).alias("x")).select("g", "x.*")
        state = written(three.where("size(ranks) > 0").select(F.monotonically_increasing_id().alias("id"), *names[1:]), "ms-ranges")
        done = done.union(state.where("kind = 'at'"))
    return done.select("g.*", F.explode("ranks").alias("rank"), F.col("p").alias("v"))


def _counted(values: DataFrame, live: DataFrame) -> DataFrame:
    """A pass: per range, the weights less than, at and above its pivot and the next pivots of both sides."""
    x, o = values.alias("x"), live.alias("o")
    inside = x.join(o, (F.col("x.g") == F.col("o.g")) & (F.col("x.v") > F.col("o.lo")) & (F.col("x.v") < F.col("o.hi"))).select("o.id", "o.p", "x.v", "x.c")
    names = ["id", "less", "at", "above", "m_less", "m_above"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, p, v, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((v, rid))
            rid, p, v, c = rid[order], p[order], v[order], c[order]
            start = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
            less, at, above = (np.add.reduceat(np.where(m, c, 0), start) for m in (v < p, v == p, v > p))
            upto = np.cumsum(c)
            before = upto[start] - c[start]
            middle = lambda base, w: v[np.searchsorted(upto, base + (w + 1) // 2)]
            lower = np.where(less > 0, middle(before, less), np.nan)
            upper = np.where(above > 0, middle(np.where(above > 0, before + less + at, before), np.maximum(above, 1)), np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(rid[start]), pa.array(less), pa.array(at), pa.array(above), pa.array(lower, from_pandas=True), pa.array(upper, from_pandas=True)], names=names)

    said = inside.mapInArrow(run, "id bigint, less bigint, at bigint, above bigint, m_less double, m_above double")
    # a side without weight has no proposal; with a single weight of 0 none is asked for
    median = lambda m, w: F.percentile(F.col(m), F.lit(0.5), F.greatest(F.col(w), F.lit(1)))
    return said.groupBy("id").agg(*[F.sum(n).alias(n) for n in ("less", "at", "above")], median("m_less", "less").alias("p_less"), median("m_above", "above").alias("p_above"))


def percentiles(df: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact percentiles of each group: ``groups``, percentil, valor, n.

    A percentile p of n values interpolates between the order statistics around 1 + p (n - 1), as
    a continuous percentile does. Null, NaN and infinite values don't count; groups without usable
    values don't come out; a null group is a group; ties and repeated rows count as they stand; an
    empty table gives no rows.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    counted = written(counted_values(df, groups, value), "pc-values")
    sizes = written(counted.groupBy(*keys).agg(F.sum("c").alias("n")), "pc-sizes")
    wanted = sizes.select(*keys, "n", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("percentil")).withColumn("x", F.lit(1.0) + F.col("percentil") * (F.col("n") - 1))
    wanted = wanted.select(*keys, "n", "percentil", F.floor("x").cast("bigint").alias("r0"), F.ceil("x").cast("bigint").alias("r1"), (F.col("x") - F.floor("x")).alias("f"))
    ranks = wanted.select(*keys, F.explode(F.array("r0", "r1")).alias("rank"))
    got = written(select_ranks(counted, keys, ranks), "pc-got")
    w, a, b = wanted.alias("w"), got.alias("a"), got.alias("b")
    on = lambda t, r: [F.col(f"w.{k}").eqNullSafe(F.col(f"{t}.{k}")) for k in keys] + [F.col(f"w.{r}") == F.col(f"{t}.rank")]
    return w.join(a, on("a", "r0")).join(b, on("b", "r1")).select(*[F.col(f"w.{k}").alias(g) for k, g in zip(keys, groups)], "percentil", F.round(F.col("a.v") + F.col("w.f") * (F.col("b.v") - F.col("a.v")), 6).alias("valor"), F.col("w.n").alias("n"))


def summaries(df: DataFrame, groups: list[str], value: str, error: float = 0.01) -> DataFrame:
    """A summary of each group that can be joined with others: ``groups``, v, w, n.

    The values at the ranks e n, 2 e n, ... n (e = ``error``), found exactly by ``select_ranks``,
    each standing for the w values up to it since the last. The rank of any number, taken from
    the weights, is off by less than e n.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    counted = written(counted_values(df, groups, value), "sm-values")
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(error) * F.col("n")).cast("bigint"))
    ranks = written(sizes.select(*keys, "n", F.explode(F.array_distinct(F.concat(F.sequence(step, F.col("n"), step), F.array("n")))).alias("rank")), "sm-ranks")
    got = select_ranks(counted, keys, ranks).alias("g")
    r = ranks.alias("r")
    joined = r.join(got, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*keys, "rank"]]).select("r.*", "g.v")
    w = F.col("rank") - F.coalesce(F.lag("rank").over(Window.partitionBy(*keys).orderBy("rank")), F.lit(0))
    return joined.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], "v", w.alias("w"), "n")


def from_summaries(parts: DataFrame, groups: list[str], at: list[float], error: float = 0.01) -> DataFrame:
    """Percentiles of any union of summaries: ``groups``, percentil, valor, n, error_rango.

    The parts' weights are laid in order of value; the value whose weights reach the rank is off
    by less than ``error`` times the joint n in rank, since each part is by that share of its own.
    A part has at most 1/error rows and one more, so a group's window holds as many a part.
    """
    per = parts.groupBy(*groups, "v").agg(F.sum("w").alias("w"))
    order, whole = Window.partitionBy(*groups).orderBy("v"), Window.partitionBy(*groups)
    run = per.select(*groups, "v", F.sum("w").over(order).alias("upto"), F.sum("w").over(whole).alias("n"))
    wanted = run.select(*groups, "v", "upto", "n", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("percentil")).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("percentil") * F.col("n"))))
    return wanted.groupBy(*groups, "percentil", "n").agg(F.min("v").alias("valor")).withColumn("error_rango", F.lit(error))

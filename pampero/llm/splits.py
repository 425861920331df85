"""Splits that keep related records together, with totals chosen by subset sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pampero.llm.components import components
from pampero.session import written


def closest_subset(counts: dict[int, int], target: float) -> dict[int, int]:
    """How many of each size to take so that the total is closest to ``target`` (the smaller total on a tie).

    Reachable totals are the bits of an integer; a size of multiplicity c enters in parts of 1, 2,
    4, ... copies, so that the shifts are logarithmic in c. The bitsets before each part are kept
    and walked back to find what was taken.
    """
    parts = []
    for size, count in sorted(counts.items()):
        step = 1
        while count > 0:
            take = min(step, count)
            parts.append((size, take))
            count -= take
            step *= 2
    reach, before = 1, []
    for size, take in parts:
        before.append(reach)
        reach |= reach << (size * take)
    below = max(0, math.floor(target))
    low = (reach & ((1 << (below + 1)) - 1)).bit_length() - 1
    rest = reach >> (below + 1)
    high = below + 1 + ((rest & -rest).bit_length() - 1) if rest else None
    total = low if high is None or target - low <= high - target else high
    taken: dict[int, int] = {}
    for (size, take), old in zip(reversed(parts), reversed(before)):
        if not old >> total & 1:
            total -= size * take
            taken[size] = taken.get(size, 0) + take
    return taken


def allot(sizes: dict[tuple[int, int], int], shares: dict[str, float]) -> dict[tuple[int, int], dict[str, int]]:
    """For groups counted by (rows, positive rows): how many of each kind go to each split.

    Of every kind each split first gets its whole proportional part, which keeps sizes and
    positives alike; the few groups left of each kind (fewer than there are splits) are shared out
    by ``closest_subset`` within two strata, groups with and without positive rows, each against
    what its split still lacks there. The work depends on the number of different sizes only.
    """
    names = list(shares)
    given = {kind: {s: int(math.floor(n * shares[s] + 1e-9)) for s in names} for kind, n in sizes.items()}
    left = {kind: n - sum(given[kind].values()) for kind, n in sizes.items()}
    for positive in (True, False):
        kinds = [k for k in sizes if (k[1] > 0) == positive]
        lack = {s: shares[s] * sum(k[0] * sizes[k] for k in kinds) - sum(k[0] * given[k][s] for k in kinds) for s in names}
        for s in sorted(names, key=lambda s: (shares[s], s))[:-1]:
            pool: dict[int, int] = {}
            for k in kinds:
                pool[k[0]] = pool.get(k[0], 0) + left[k]
            for size, n in closest_subset({a: b for a, b in pool.items() if b and a}, lack[s]).items():
                for k in sorted(k for k in kinds if k[0] == size):
                    take = min(n, left[k])
                    given[k][s] += take
                    left[k] -= take
                    n -= take
        last = max(names, key=lambda s: (shares[s], s))
        for k in kinds:
            given[k][last] += left[k]
            left[k] = 0
    return given


def assign_splits(df: DataFrame, row: str, entity: Column, links: DataFrame, positive: Column, shares: dict[str, float], seed: str = "0", buckets: int = 256) -> DataFrame:
    """``row``, ``componente`` and ``particion`` of every row: all rows of an entity, under any linked id, in one split.

    Entities are joined by ``links`` (columns a, b) into components. Groups are counted by size
    and positive rows (the histogram that reaches the driver has one row per different pair, at
    most about the two-thirds power of the rows, in practice dozens), ``allot`` says how many of
    each kind each split gets, and groups of a kind are taken in the order of a seeded hash. Their
    rank is the sum of the counts of smaller hash buckets and a rank within the bucket, so no
    window holds a whole kind, though most groups may be of one kind.

    A row without an entity is a group of its own (those without an id either are one together). Repeated rows count as often as they stand;
    an unknown flag counts as not positive; shares are scaled to 1; no rows, no result. A group
    larger than a split's part goes where the totals come closest.
    """
    whole = sum(shares.values())
    shares = {k: v / whole for k, v in shares.items()}
    rows = df.select(F.col(row).alias("_row"), entity.cast("string").alias("_e"), F.coalesce(positive.cast("int"), F.lit(0)).alias("_p"))
    cc = components(links)
    own = F.coalesce(F.col("component").cast("string"), F.col("_e"), F.concat_ws(" ", F.lit("fila"), F.col("_row").cast("string")))
    member = written(rows.join(cc.select(F.col("node").cast("string").alias("_e"), "component"), "_e", "left").select("_row", "_p", own.alias("componente")), "split-rows")
    groups = member.groupBy("componente").agg(F.count("*").alias("n"), F.sum("_p").alias("p")).withColumn("h", F.xxhash64(F.lit(seed), "componente"))
    groups = written(groups.withColumn("bucket", F.pmod("h", F.lit(buckets))), "split-groups")
    counted = groups.groupBy("n", "p", "bucket").agg(F.count("*").alias("c"))
    before = counted.select("n", "p", "bucket", (F.sum("c").over(Window.partitionBy("n", "p").orderBy("bucket")) - F.col("c")).alias("before"))
    sizes = {(r["n"], r["p"]): r["c"] for r in counted.groupBy("n", "p").agg(F.sum("c").alias("c")).collect()}
    given = allot(sizes, shares)
    bounds = []
    for (n, p), per in given.items():
        start = 0
        for split, count in per.items():
            if count:
                bounds.append((n, p, split, start, start + count))
            start += count
    plan = df.sparkSession.createDataFrame(bounds, "n bigint, p bigint, particion string, desde bigint, hasta bigint")
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("n", "p", "bucket").orderBy("h", "componente")) - 1).join(before, ["n", "p", "bucket"]).select("componente", "n", "p", (F.col("before") + F.col("r")).alias("r"))
    placed = ranked.join(plan, ["n", "p"]).where("r >= desde and r < hasta").select("componente", "particion")
    return member.join(placed, "componente").select(F.col("_row").alias(row), "componente", "particion")

"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pampero.session import written


def canonical_hash(values: list[Column]) -> Column:
    """SHA-256 of the values as text; a null has a mark of its own, so null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("~")) for v in values]), 256)


def snapshot_changes(df: DataFrame, snapshot: Column, key: Column, latest_by: list[Column], compared: dict[str, Column], derived: dict[str, callable] | None = None) -> DataFrame:
    """Additions, removals and changes of every snapshot against the one before.

    The row of a (snapshot, key) is the one with the greatest ``latest_by``, chosen by an
    aggregate with map-side combine, so that a key that holds a third of all rows costs one
    partial row a task. ``compared`` names the values whose canonical hashes are compared;
    ``derived`` maps some of them through a costlier function once per kept row.

    Snapshot i is full-outer-joined with snapshot i+1 on (snapshot, key) after moving its label
    one snapshot on; a side that is missing gives ``alta`` or ``baja``, unequal hashes ``cambio``.

    Rows without a snapshot or key belong to nothing and are left out; repeated rows and ties
    fall to the greatest ``latest_by``; an empty table gives no rows; other columns are ignored,
    whatever their names.

    Columns: snapshot, key, change, hash_before, hash_after.
    """
    names = list(compared)
    base = df.select(snapshot.alias("_s"), key.alias("_k"), F.struct(*latest_by).alias("_o"), F.struct(*[compared[n].alias(n) for n in names]).alias("_v")).where("_s is not null and _k is not null")
    kept = base.groupBy("_s", "_k").agg(F.max_by("_v", "_o").alias("_v"))
    values = [(derived or {}).get(n, lambda c: c)(F.col(f"_v.{n}")) for n in names]
    # both sides of the join read them: hashed once
    rows = written(kept.select("_s", "_k", canonical_hash(values).alias("_h")), "snapshots")
    # one row per snapshot: the window sees as many rows as there were deliveries
    whole = Window.orderBy("_s")
    dates = rows.select("_s").distinct().select("_s", F.lead("_s").over(whole).alias("_next"), F.lag("_s").over(whole).alias("_prev"))
    before = rows.join(dates.where("_next is not null").select("_s", "_next"), "_s").select(F.col("_next").alias("_s"), "_k", F.col("_h").alias("hash_before"))
    after = rows.join(dates.where("_prev is not null").select("_s"), "_s").select("_s", "_k", F.col("_h").alias("hash_after"))
    change = F.when(F.col("hash_before").isNull(), "alta").when(F.col("hash_after").isNull(), "baja").when(F.col("hash_before") != F.col("hash_after"), "cambio")
    return before.join(after, ["_s", "_k"], "full_outer").select(F.col("_s").alias("snapshot"), F.col("_k").alias("key"), change.alias("change"), "hash_before", "hash_after").where("change is not null")

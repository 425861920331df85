"""Connected components by parallel hooking and shortcutting over parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pampero.session import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b", shortcuts: int = 2) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in the links ``a``-``b``.

    The parent array is a table (node, parent). In each round every label that has a smaller
    neighbour hooks onto the smallest; the hooks are shortcut by joining the table with itself
    ``shortcuts`` times; then the labels of nodes and links are replaced and links within a
    component drop out. Labels without a smaller neighbour are at most half of those left in any
    component, so the rounds are logarithmic in its size. Every table is written to the shared
    folder, so lineage stays short and a lost executor costs a read.

    A node with very many links is a label on many link rows: the smallest neighbour is a minimum
    with map-side combine, and the joins bring one row of the parent table to a key, so adaptive
    execution can split the hot side. Links in either direction, repeated ones and links of a node
    to itself are taken; a link with a null end only names its other end; no links, no rows.
    """
    base = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = base.select(F.col("a").alias("node")).union(base.select("b")).where("node is not null").distinct()
    parent = written(nodes.select("node", F.col("node").alias("parent")), "cc-parent")
    live = written(base.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.min("b").alias("h"))
        for _ in range(shortcuts):
            up = hook.select(F.col("a").alias("h"), F.col("h").alias("hh"))
            hook = hook.join(up, "h", "left").select("a", F.coalesce("hh", "h").alias("h"))
        hook = written(hook, "cc-hook")
        was = parent, live
        parent = written(parent.join(hook, parent.parent == hook.a, "left").select("node", F.coalesce("h", "parent").alias("parent")), "cc-parent")
        left = live.join(hook, "a", "left").select(F.coalesce("h", "a").alias("a"), "b")
        right = hook.select(F.col("a").alias("b"), "h")
        moved = left.join(right, "b", "left").select("a", F.coalesce("h", "b").alias("b"))
        live = written(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
        forget(hook, *was)  # both tables are complete anew
    return parent.select("node", F.col("parent").alias("component"))


def pairs_within(members: DataFrame, node: str, component: str, block: int = 1_000) -> DataFrame:
    """Every pair of different nodes of a component, smaller first: only where pairs are the result asked for.

    A component is cut by hash into blocks of about ``block`` nodes and each pair of blocks is a
    key of its own, so the pairs of a very large one are made by many tasks.
    """
    m = members.select(F.col(node).alias("n"), F.col(component).alias("c")).distinct()
    # components of one have no pairs and needn't be shuffled twice
    many = m.groupBy("c").count().where("count > 1").select("c", F.ceil(F.col("count") / block).alias("k"))
    kept = m.join(many, "c").withColumn("own", F.pmod(F.xxhash64("n"), "k"))
    first = kept.select("c", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("k") - 1)).alias("j"), F.col("n").alias("x"))
    second = kept.select("c", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("i"), F.col("own").alias("j"), F.col("n").alias("y"))
    return first.join(second, ["c", "i", "j"]).where("i <> j or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

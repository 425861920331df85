"""Profiles, effect sizes, correlations, bins and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pampero.session import written


def running(df: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with ``upto_<name>``, the running totals of ``sums`` in an order within groups; the order must be unique in a group.

    Rows are laid in range partitions by group and order, so a group that holds most rows spreads
    over many; totals run within a partition and start from those of the partitions before, of
    which there is one row a partition and group. Null groups are groups.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(df.repartitionByRange(parts, *[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()), "running")
    per = placed.groupBy("_part", *by).agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    down = Window.partitionBy(*by).orderBy("_part")
    before = per.select("_part", *by, *[(F.sum(f"_s_{s}").over(down) - F.col(f"_s_{s}")).alias(f"_b_{s}") for s in sums]).alias("b")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = placed.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums]).alias("p")
    on = [F.col(f"p.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in ["_part", *by]]
    return p.join(before, on).select(*[F.col(f"p.`{c}`") for c in df.columns], *[(F.col(f"_i_{s}") + F.col(f"_b_{s}")).alias(f"upto_{s}") for s in sums])


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a frame of one row, an aggregate without groups, beside every row."""
    return df.crossJoin(F.broadcast(row))


def modes(counted: DataFrame, keys: list[str], values: list[str], n: str = "n") -> DataFrame:
    """``keys`` and the most frequent value of each of ``values``, rows weighing ``n``; of ties the lowest, null only where all are.

    As ``F.mode(value, True)`` over the rows that ``counted`` counts, keys without nulls. A key
    with one row has its modes there; of the others each value is counted by two aggregates with
    map-side combine, so a hot key is spread and no task holds the values of one.
    """
    one = counted.groupBy(*keys).agg(F.count("*").alias("_rows"))
    sole = counted.join(one.where("_rows = 1").select(*keys), keys, "left_semi").select(*keys, *values)
    many = counted.join(one.where("_rows > 1").select(*keys), keys, "left_semi")
    kinds = {v: counted.schema[v].dataType for v in values}
    cells = [F.struct(F.lit(i).alias("_i"), *[(F.col(v) if v == own else F.lit(None).cast(kinds[v])).alias(v) for v in values]) for i, own in enumerate(values)]
    laid = many.select(*keys, F.col(n).alias("_n"), F.explode(F.array(*cells)).alias("_x")).select(*keys, "_n", "_x.*")
    per = laid.groupBy(*keys, "_i", *values).agg(F.sum("_n").alias("_n"))
    best = [F.min_by(v, F.when((F.col("_i") == i) & F.col(v).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(v).alias("v")))).alias(v) for i, v in enumerate(values)]
    return sole.unionByName(per.groupBy(*keys).agg(*best))


def quantiles(df: DataFrame, by: list[str], value: Column, at: list[float]) -> DataFrame:
    """``by``, q, valor, n: exact quantiles with linear interpolation of the values that are neither null nor NaN.

    Equal values are counted first; the order statistics are found by running totals over the
    different values, so no task holds a whole group.
    """
    v = value.cast("double")
    counted = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*by, (F.col("_v") + F.lit(0.0)).alias("_v")).agg(F.count("*").alias("_c"))
    run = running(counted, by, [F.col("_v")], ["_c"])
    sizes = run.groupBy(*by).agg(F.sum("_c").alias("n")).alias("s")
    r = run.alias("r")
    both = (r.join(sizes, [F.col(f"r.`{b}`").eqNullSafe(F.col(f"s.`{b}`")) for b in by]) if by else one_row(r, sizes)).select(*[F.col(f"r.`{b}`") for b in by], "_v", "_c", "upto__c", "n")
    place = lambda q: q * (F.col("n") - 1)
    here = lambda rank: (rank + 1 > F.col("upto__c") - F.col("_c")) & (rank + 1 <= F.col("upto__c"))
    asked = F.filter(F.array(*[F.lit(float(q)) for q in at]), lambda q: here(F.floor(place(q))) | here(F.ceil(place(q))))
    hits = both.select("*", F.explode(asked).alias("q"))
    x = place(F.col("q"))
    low, high = F.floor(x), F.ceil(x)
    got = hits.groupBy(*by, "q", "n").agg(F.max(F.when(here(low), F.col("_v"))).alias("_lo"), F.max(F.when(here(high), F.col("_v"))).alias("_hi"))
    return got.select(*by, "q", F.when(low == high, F.col("_lo")).otherwise((high - x) * F.col("_lo") + (x - low) * F.col("_hi")).alias("valor"), "n")


def number(name: str) -> Column:
    """A numeric column with NaN as missing."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def corr(x: Column, y: Column) -> Column:
    """Linear correlation on the rows that have both; null where either has no spread."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def skew_corrected(c: Column) -> Column:
    """Skewness with the correction for small samples; null under three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def separation(c: Column, positive: Column, least: int = 10) -> Column:
    """Distance of the two groups' means over the root of their mean variance; null if either has fewer than ``least`` values."""
    a, b = F.when(positive, c), F.when(~positive, c)
    d = F.abs(F.avg(a) - F.avg(b)) / F.nullif(F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2), F.lit(0.0))
    return F.when(F.least(F.count(a), F.count(b)) >= least, d)


def zone(c: Column, low: float, high: float) -> Column:
    """Reading of an effect's size by two cut-offs."""
    return F.when(F.abs(c) >= high, "alto").when(F.abs(c) >= low, "medio").when(c.isNotNull(), "bajo")


def eta_squared(df: DataFrame, value: Column, group: str) -> DataFrame:
    """One row ``eta2``, ``n``: the share of the value's variance between groups, by squared deviations of the groups' means."""
    per = df.select(F.col(group).alias("g"), value.alias("v")).where("v is not null and g is not null").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    whole = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("middle"))
    tot = one_row(per, whole).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("s")).alias("w"), F.sum(F.col("n") * (F.col("m") - F.col("middle")) ** 2).alias("b"))
    return tot.select(F.round(F.try_divide("b", F.col("b") + F.col("w")), 6).alias("eta2"), F.col("rows").alias("n"))


def ranked(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average ranks of a column over all rows, from the running counts of its different values."""
    per = running(df.groupBy(col).agg(F.count("*").alias("_c")), [], [F.col(col)], ["_c"])
    return df.join(per.select(col, (F.col("upto__c") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out)), col)


def cut(c: Column, edges: list[float], labels: list[str], lowest: bool = False) -> Column:
    """Label of the right-closed interval (edges[i], edges[i+1]]; outside and null give null; with ``lowest`` the first edge belongs to the first."""
    out = F.when((c == edges[0]) if lowest else F.lit(False), F.lit(labels[0]))
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = out.when((c > lo) & (c <= hi), F.lit(label))
    return out


def quantile_bins(df: DataFrame, col: str, labels: list[str], out: str) -> DataFrame:
    """``df`` with a label by exact quantile edges, right-closed; null and NaN have none. The edges are one row."""
    n = len(labels)
    edges = quantiles(df, [], F.col(col), [i / n for i in range(1, n)]).agg(F.array_sort(F.collect_list(F.struct("q", "valor"))).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e["valor"] < F.col(col)))
    label = F.when(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")), F.get(F.array(*map(F.lit, labels)), below))
    return one_row(df, edges).withColumn(out, label).drop("_edges")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, densidad) of equal-width bins; the top edge belongs to the last."""
    b = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    per = df.where(value.between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return per.withColumn("densidad", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) / ((high - low) / bins), 9))


def zscores(df: DataFrame, cols: dict[str, Column], by: list[str], fitted_on: Column | None = None) -> DataFrame:
    """``df`` with standard scores within a group, null where the group has no spread.

    The groups' means and deviations are aggregates joined back, so a group that holds most rows
    is never in one task; ``fitted_on`` restricts the rows that they are learnt from.
    """
    names = list(cols)
    base = df.select("*", *[cols[n].alias(f"_v_{n}") for n in names])
    learnt = base if fitted_on is None else base.where(fitted_on)
    per = learnt.groupBy(*by).agg(*[f(f"_v_{n}").alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_samp))]).alias("g")
    x = base.alias("x")
    both = x.join(per, [F.col(f"x.`{b}`").eqNullSafe(F.col(f"g.`{b}`")) for b in by], "left")
    return both.select(*[F.col(f"x.`{c}`") for c in df.columns if c not in names], *[((F.col(f"_v_{n}") - F.col(f"_m_{n}")) / F.nullif(f"_s_{n}", F.lit(0.0))).alias(n) for n in names])


def row_mean(cols: list[Column]) -> Column:
    """Mean of the values that are there; null if none is."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / n)


def percentile_of(table: Column, x: Column) -> Column:
    """Percentile of a score on an ascending array of n quantiles, linear in between and flat outside."""
    n = F.size(table)
    below = F.size(F.filter(table, lambda q: q <= x))
    lo, hi = F.get(table, below - 1), F.get(table, below)
    step = F.lit(100.0) / (n - 1)
    return F.when(x <= table[0], F.lit(0.0)).when(below >= n, F.lit(100.0)).otherwise((below - 1 + F.try_divide(x - lo, hi - lo)) * step)


def snapped(value: Column, step: Column) -> Column:
    """The multiple of a step next to a value, the even one on a tie."""
    return F.bround(value / step) * step


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) of every pair of columns on the rows that have both, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    v = {c: number(c) for c in columns}
    row = df.agg(*[f.alias(f"{k}{i}") for i, (a, b) in enumerate(pairs) for k, f in (("r", corr(v[a], v[b])), ("n", F.count_if(v[a].isNotNull() & v[b].isNotNull())))])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 6).alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def dispatch(df: DataFrame, target: Column, profile: DataFrame, excluded: list[str], many: int = 60, few: int = 12) -> DataFrame:
    """(columna, medida, valor): every column's association with a two-valued target by the measure fit for it.

    Numbers of more than ``few`` values are measured by the separation of both classes, other
    columns by the share of the target's variance between their values (missing is a value); of
    constant, excluded and many-valued columns nothing is measured. The profile, a row a column, is
    read first; then one aggregate has all separations and one all groups.
    """
    kinds = {r["columna"]: (r["tipo"], r["distintos"]) for r in profile.collect()}
    y, said = F.coalesce(target, F.lit(False)), {}
    for c in df.columns:
        kind, n = kinds[c]
        said[c] = "no se mide" if c in excluded else "constante" if n <= 1 else "separacion" if kind == "numero" and n > few else "demasiadas categorias" if kind != "numero" and n > many else "eta2"
    schema = "columna string, medida string, valor double"
    out = df.sparkSession.createDataFrame([(c, m, None) for c, m in said.items() if m not in ("separacion", "eta2")], schema)
    apart = [c for c, m in said.items() if m == "separacion"]
    if apart:
        row = df.agg(*[separation(number(c), y).alias(f"s{i}") for i, c in enumerate(apart)])
        out = out.union(row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.lit("separacion").alias("medida"), F.round(f"s{i}", 6).alias("valor")) for i, c in enumerate(apart)])).alias("x")).select("x.*"))
    groups = [c for c, m in said.items() if m == "eta2"]
    if groups:
        long = df.select(y.cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"`{c}`").cast("string").alias("g")) for c in groups])).alias("x")).select("_y", "x.*")
        per = long.groupBy("columna", "g").agg(F.count("*").alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("s"))
        whole = per.groupBy("columna").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("middle"))
        b, w = F.sum(F.col("n") * (F.col("m") - F.col("middle")) ** 2), F.sum(F.col("n") * F.col("s"))
        out = out.union(per.join(whole, "columna").groupBy("columna").agg(F.round(F.try_divide(b, b + w), 6).alias("valor")).select("columna", F.lit("eta2"), "valor"))
    return out

"""Relational building blocks with defined null behaviour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def not_in(col: Column, values: list) -> Column:
    """True unless the value is one of ``values``; a null is not one of them, so it stays."""
    return ~F.coalesce(col.isin(values), F.lit(False))


def flag(col: Column) -> Column:
    """An unknown flag as false."""
    return F.coalesce(col, F.lit(False))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order`` of each key by a map-side combined aggregate; null keys are one key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def later_events(left: DataFrame, right: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows of ``left`` with the number of strictly later events in ``right`` of the same keys.

    Times are counted per key before the join, so a hot key joins on its different times only.
    """
    per = right.groupBy(*keys, time).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1)
    after = left.select(*keys, time).distinct().withColumn("_n", F.lit(0)).unionByName(per).groupBy(*keys, time).agg(F.sum("_n").alias("_n"))
    after = after.withColumn("later", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    return left.join(after, [*keys, time], "left")


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(paso, orden, filas) that survive each cumulative condition, all in one aggregate."""
    conds = [reduce(lambda a, b: a & b, [flag(c) for _, c in steps[: i + 1]]) for i in range(len(steps))]
    row = df.agg(*[F.count_if(c).alias(f"s{i}") for i, c in enumerate(conds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("orden"), F.lit(n).alias("paso"), F.col(f"s{i}").alias("filas")) for i, (n, _) in enumerate(steps)])).alias("x")).select("x.*")


def coverage(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, columna, no_nulos, cobertura, ceros) in one aggregate over all columns; NaN counts as missing."""
    types = dict(df.dtypes)
    known = {c: (F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) if types[c] in ("double", "float") else F.col(f"`{c}`").isNotNull()) for c in columns}
    zero = {c: flag(F.col(f"`{c}`") == 0) if types[c] in ("double", "float", "int", "bigint") else F.lit(False) for c in columns}
    row = df.groupBy(*(by or [])).agg(F.count("*").alias("_n"), *[f.alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("k", F.count_if(known[c])), ("z", F.count_if(known[c] & zero[c])))])
    cells = F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"k{i}").alias("no_nulos"), F.round(F.col(f"k{i}") / F.col("_n"), 6).alias("cobertura"), F.col(f"z{i}").alias("ceros")) for i, c in enumerate(columns)])
    return row.select(*(by or []), F.explode(cells).alias("x")).select(*(by or []), "x.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(valor, n, proporcion) of the non-null values."""
    per = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("valor")).agg(F.count("*").alias("n"))
    return per.withColumn("proporcion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def recode(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """A value's code by a literal map; values that aren't in it give ``default`` or null."""
    got = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[col]
    return F.coalesce(got, default) if default is not None else got


def first_match(branches: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds; unknown conditions don't."""
    out = F
    for cond, label in branches:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def profile(df: DataFrame) -> DataFrame:
    """(columna, tipo, no_nulos, distintos, vacia, constante, minimo, metrica) of every column in one aggregate; NaN counts as missing.

    ``metrica`` marks the columns named ``stat_``; the minimum is that of numbers only.
    """
    kinds = {c: "numero" if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") else "booleano" if t == "boolean" else "fecha" if t in ("date", "timestamp", "timestamp_ntz") else "texto" for c, t in df.dtypes}
    types = dict(df.dtypes)
    value = {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if types[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns}
    aggs = []
    for i, c in enumerate(df.columns):
        low = F.min(value[c].cast("double")) if kinds[c] == "numero" else F.max(F.lit(None).cast("double"))
        aggs += [F.count(value[c]).alias(f"n{i}"), F.count_distinct(value[c]).alias(f"d{i}"), low.alias(f"m{i}")]
    cells = [F.struct(F.lit(c).alias("columna"), F.lit(kinds[c]).alias("tipo"), F.col(f"n{i}").alias("no_nulos"), F.col(f"d{i}").alias("distintos"), (F.col(f"n{i}") == 0).alias("vacia"), (F.col(f"d{i}") <= 1).alias("constante"), F.col(f"m{i}").alias("minimo"), F.lit(c.startswith("stat_")).alias("metrica")) for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def indicators(col: Column, levels: list[str]) -> list[Column]:
    """A 0/1 column a level; unknown values have none."""
    return [F.coalesce((col == v).cast("int"), F.lit(0)) for v in levels]


def transposed(df: DataFrame, key: str, columns: list[str], levels: list[str], name: str) -> DataFrame:
    """A row for each of ``columns`` and a column for each of the ``levels`` of ``key``, which is unique."""
    return df.unpivot([key], columns, name, "_v").groupBy(name).pivot(key, levels).agg(F.max("_v"))


def name_forms(words: Column) -> Column:
    """A name's forms to try in turn: whole, first and last word, last word; folded case, each once."""
    whole, ends, last = F.array_join(words, " "), F.concat_ws(" ", words[0], F.element_at(words, -1)), F.element_at(words, -1)
    return F.array_distinct(F.transform(F.array(whole, ends, last), F.lower))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with columns in the kinds of a contract; a value that isn't of the kind is missing, columns that aren't there are passed over."""
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])

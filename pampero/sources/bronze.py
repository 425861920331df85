"""The raw layer: compressed partitions of landed pages, append-only by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from pampero.operators.relational import keep_one


def partition_value(path: Column, key: str) -> Column:
    """A ``key=value`` part of a path, null where there is none; '-' in a season stands for '/'."""
    return F.nullif(F.regexp_extract(path, rf"{key}=([^/]+)", 1), F.lit(""))


def content_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits of SHA-256; a missing text hashes as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def write_pages(pages: DataFrame, root: str, by: list[str], text: str = "html") -> None:
    """Appends pages as gzip JSON rows under ``by`` partitions."""
    pages.write.mode("append").partitionBy(*by).option("compression", "gzip").json(root)


def read_pages(spark: SparkSession, root: str, schema: str, **wanted: list) -> DataFrame:
    """Pages with their partition columns and ``_ruta``; ``wanted`` prunes partitions before a file is opened; unreadable files are skipped."""
    df = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("mode", "DROPMALFORMED").json(root).withColumn("_ruta", F.col("_metadata.file_path"))
    for key, values in wanted.items():
        df = df.where(F.col(key).isin(values))
    return df


def unreadable(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``_ruta`` of the files below ``root`` that give no row: broken, cut off or empty ones, for the log; one listing and one read."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_ruta"))
    read = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(root).select(F.col("_metadata.file_path").alias("_ruta")).distinct()
    plain = lambda df: df.withColumn("_k", F.regexp_replace("_ruta", "^[a-z0-9]+:/*", "/"))
    return plain(there).join(plain(read).select("_k"), "_k", "left_anti").select("_ruta")


def write_texts(texts: DataFrame, root: str, by: list[str], text: str = "texto") -> None:
    """Whole texts as gzip text files, one row a file in the partitions ``by``; the partition names the text."""
    rows = texts.select(*by, F.col(text).alias("value"))
    rows.write.mode("append").partitionBy(*by).option("compression", "gzip").option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(root)


def last_of_key(pages: DataFrame, key: list[str], path: str = "_ruta") -> DataFrame:
    """The row of each key in the file that comes last by its path; an aggregate with map-side combine."""
    return keep_one(pages, key, [F.col(path)])


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header: by its schema, or all text where none is given; quotes may hold line breaks."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", "false")).csv(path)


def write_table(df: DataFrame, path: str, files: int | None = None) -> None:
    """A table as CSV with a header, replacing what was there; ``files`` bounds their number."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_whole_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(ruta, texto) of whole, possibly compressed, text files."""
    return spark.read.option("ignoreCorruptFiles", "true").text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("ruta"), F.regexp_replace("value", "\x00$", "").alias("texto"))


def land(new: DataFrame, landed: DataFrame | None, key: list[str], text: str, closed: Column | None = None) -> DataFrame:
    """The pages worth writing: new keys, and open ones whose content changed; closed ones are never rewritten.

    Compared by key and content hash with an anti-join, so unchanged pages are not written again.
    """
    fresh = new.withColumn("_h", content_hash(F.col(text)))
    if landed is None:
        return fresh.drop("_h")
    old = landed.select(*key, content_hash(F.col(text)).alias("_h"))
    out = fresh.join(old, [*key, "_h"], "left_anti")
    if closed is not None:
        out = out.join(landed.select(*key).where(closed).distinct(), key, "left_anti")
    return out.drop("_h")


def latest(df: DataFrame, column: str, unknown: tuple = ("desconocida",)) -> DataFrame:
    """Rows of the greatest partition value that is not one of ``unknown``; pruned by a join on one row."""
    newest = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*unknown)).agg(F.max(column).alias(column))
    return df.join(newest, column)


def first_readable(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """The first source of a fallback chain that can be read; raises if none can."""
    for path in paths:
        try:
            return spark.read.format(fmt).option("ignoreCorruptFiles", "true").load(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(", ".join(paths))

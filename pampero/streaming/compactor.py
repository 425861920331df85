"""Checkpointed compaction of very many tiny inputs into few well-sized files."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pampero.session import checkpoint_id, drop_path, list_dir, path_bytes, rename, scratch
from pampero.sources.arrivals_html import FIELDS, arrivals

TARGET_BYTES = 128 << 20
ARRIVALS = "archivo_id bigint, " + ", ".join(f"{f} {'int' if f == 'edad_al_fichaje' else 'string'}" for f in FIELDS)


def parsed_pages(pages: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """One row per closed arrival row of each page (``archivo_id``, ``html``), with the page's ``carried`` columns; pages without any give none."""
    carried = carried or []
    kinds = [pa.int32() if f == "edad_al_fichaje" else pa.string() for f in FIELDS]

    def run(batches):
        for batch in batches:
            found = [(i, row) for i, page in enumerate(batch.column(1).to_pylist()) for row in arrivals(page)]
            if found:
                at = pa.array([i for i, _ in found], pa.int64())
                fields = [pa.array(c, t) for c, t in zip(zip(*(row for _, row in found)), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *fields, *[batch.column(2 + k).take(at) for k in range(len(carried))]], names=["archivo_id", *FIELDS, *carried])

    schema = ARRIVALS + "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in carried)
    return pages.select(F.col("archivo_id").cast("bigint"), "html", *carried).mapInArrow(run, schema)


def first_of_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` of each key; partial aggregates keep a hot key cheap. The last key may not be null."""
    rest = [c for c in df.columns if c not in keys]
    best = df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


@dataclass(frozen=True)
class Published:
    """A version of the published table: its number, the batches merged last, the number of buckets and the folder of each."""

    version: int = 0
    batches: tuple = ()
    buckets: int = 0
    parts: dict = field(default_factory=dict)


def published(spark: SparkSession, home: str, version: int | None = None) -> Published:
    """The newest version under ``home`` (or the one asked for); version 0 where nothing is published."""
    there = [int(n) for n in list_dir(spark, f"{home}/current") if n.isdigit()]
    wanted = version if version in there else max(there, default=0) if version is None else 0
    if not wanted:
        return Published()
    row = spark.read.schema("batches array<string>, buckets int, parts map<string, string>").json(f"{home}/current/{wanted:010d}").first()
    return Published(wanted, tuple(row["batches"]), row["buckets"], {int(k): v for k, v in row["parts"].items()})


def compact(spark: SparkSession, source: str, home: str, key: str, transform: Callable[[DataFrame], DataFrame], reduce: Callable[[DataFrame, list[str]], DataFrame], fmt: str = "parquet", options: dict | None = None, files_per_batch: int = 10_000, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Discovers each file of ``source`` once, stages it in batches and publishes few well-sized files.

    A file source with a checkpoint under ``home`` takes each input file once, however old it is;
    every available file is processed and then the run ends, so the next run takes only what is
    new. A batch is written under ``home/staged`` by the checkpoint's id and its own with
    overwrite: both and the batch's files are fixed in the checkpoint before the batch runs, so a
    retry replaces rather than duplicates.

    The published table is hashed by ``key`` into as many buckets as it needs files of
    ``target_bytes``. A run merges its new batches into the buckets that they touch and leaves the
    others alone; once the buckets have doubled in size all are laid out anew. ``transform`` is
    applied to a batch, ``reduce`` (frame, grouping keys) to its result and again to a bucket's
    old and new rows, so it must be idempotent and mergeable. A version is named by one rename
    after its files are complete, so there is always a whole one to read; it stays readable until
    the next but one is published, and what no later version names is deleted then.

    The driver holds the paths of the files discovered, as any file stream does: with tens of
    millions, run one compactor a prefix of the source. An empty source gives one empty file.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(source)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile():
        source = f"{source[:-1]}[{source[-1]}]"  # a file source takes a single file only as a pattern
    schema = spark.read.format(fmt).options(**(options or {})).load(source).schema
    # files landed late with an old time count too: without an age a stream forgets those a week older than the newest
    stream = spark.readStream.format(fmt).schema(schema).options(**(options or {})).option("maxFileAge", "36500d").option("maxFilesPerTrigger", files_per_batch).load(source)
    staged = f"{home}/staged"
    run: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        reduce(transform(batch), [key]).write.mode("overwrite").parquet(f"{staged}/{run[0]}-{number:010d}")

    def stage(batch: DataFrame, number: int) -> None:
        run[:] = run or [checkpoint_id(spark, f"{home}/checkpoint")]
        write(batch, number)

    stream.writeStream.foreachBatch(stage).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    now = published(spark, home)
    new = [b for b in list_dir(spark, staged) if b not in now.batches]
    if not new and not now.version:
        run[:] = ["empty"]
        write(spark.createDataFrame([], schema), 0)
        new = [f"empty-{0:010d}"]
    if new:
        now = _publish(spark, home, now, new, key, reduce, target_bytes)
    shape = reduce(transform(spark.createDataFrame([], schema)), [key]).schema
    return spark.read.schema(shape).parquet(*[f"{home}/published/{p}" for p in now.parts.values()])


def _publish(spark: SparkSession, home: str, old: Published, new: list[str], key: str, reduce: Callable, target_bytes: int) -> Published:
    """Merges staged batches into the buckets they touch and names the result as the next version."""
    fresh = spark.read.parquet(*[f"{home}/staged/{b}" for b in new])
    held = sum(path_bytes(spark, f"{home}/published/{p}") for p in old.parts.values())
    need = max(1, math.ceil((held + sum(path_bytes(spark, f"{home}/staged/{b}") for b in new)) / target_bytes))
    again = need > 2 * old.buckets
    buckets = need if again else old.buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    # as many rows as there are files
    touched = sorted(r[0] for r in fresh.select(bucket).distinct().collect()) or [0]
    before = [p for k, p in old.parts.items() if again or k in touched]
    rows = fresh.unionByName(spark.read.schema(fresh.schema).parquet(*[f"{home}/published/{p}" for p in before])) if before else fresh
    version = old.version + 1
    laid = reduce(rows.withColumn("_bucket", bucket).repartition(buckets, "_bucket"), ["_bucket", key])
    folder = f"v{version:010d}"
    drop_path(spark, f"{home}/published/{folder}")  # of a run that broke off here
    laid.write.partitionBy("_bucket").parquet(f"{home}/published/{folder}")
    made = [int(n.split("=")[1]) for n in list_dir(spark, f"{home}/published/{folder}") if n.startswith("_bucket=")]
    parts = ({} if again else {k: p for k, p in old.parts.items() if k not in made}) | {k: f"{folder}/_bucket={k}" for k in made}
    if not parts:
        laid.drop("_bucket").coalesce(1).write.parquet(f"{home}/published/{folder}/empty")
        parts = {0: f"{folder}/empty"}
    draft = f"{home}/draft-{version:010d}"
    spark.createDataFrame([(new, buckets, {str(k): v for k, v in parts.items()})], "batches array<string>, buckets int, parts map<string, string>").coalesce(1).write.mode("overwrite").json(draft)
    rename(spark, draft, f"{home}/current/{version:010d}")
    gone = published(spark, home, version - 2)
    for p in set(gone.parts.values()) - set(old.parts.values()) - set(parts.values()):
        drop_path(spark, f"{home}/published/{p}")
    for b in old.batches:
        drop_path(spark, f"{home}/staged/{b}")
    if gone.version:
        drop_path(spark, f"{home}/current/{gone.version:010d}")
    return Published(version, tuple(new), buckets, parts)


def compact_arrivals(spark: SparkSession, source: str, home: str | None = None, **how) -> DataFrame:
    """Every arrival of the pages in ``source`` exactly once, in few files, with the smallest page that holds it.

    The row kept of an operation is the first on its page of the smallest ``archivo_id``.
    Null, blank, broken and error pages give nothing; pages landed again add nothing; a page
    without an id stands only where no other holds the operation.
    """
    order = F.struct(F.col("archivo_id").isNull(), F.col("archivo_id"), F.coalesce("coste_fichaje_texto", F.lit("")), F.coalesce("jugador_tm_id", F.lit("")))
    return compact(spark, source, home or scratch(spark, "compact"), "operacion_id", parsed_pages, lambda df, keys: first_of_key(df, keys, order), **how)

"""Incremental runs: scope, fingerprint, skip, gate, publish, state."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pampero.operators.quality import Check, validate
from pampero.session import changed_at, path_bytes


@dataclass(frozen=True)
class Scope:
    """What a run covers; bounds are checked on creation."""

    top: int = 200
    seasons: int = 5
    year: int = 2027
    require_stats: bool = False
    force: bool = False

    def __post_init__(self):
        for name, low, high in (("top", 1, 560), ("seasons", 1, 10), ("year", 2020, 2035)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

    @classmethod
    def trial(cls) -> "Scope":
        return cls(top=20, seasons=1)

    def labels(self, current: int) -> list[str]:
        return [f"{y}/{y + 1}" for y in range(current, current - self.seasons, -1)]


def fingerprint(sources: dict, scope: Scope) -> str:
    """One line of sorted ``key=value`` pairs; ``force`` is no part of it."""
    whole = {**sources, **{k: v for k, v in asdict(scope).items() if k != "force"}}
    return "|".join(f"{k}={whole[k]}" for k in sorted(whole))


class State:
    """The last committed fingerprint, kept as a small JSON table on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> str | None:
        if not path_bytes(self.spark, self.path):
            return None
        row = self.spark.read.json(self.path).first()
        return row["huella"] if row else None

    def commit(self, value: str) -> None:
        self.spark.createDataFrame([(value,)], "huella string").coalesce(1).write.mode("overwrite").json(self.path)


def publish(df: DataFrame, root: str, day: str) -> str:
    """Writes the day's partition; a second run of a day replaces that day only."""
    df.withColumn("fecha", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fecha").parquet(root)
    return f"{root}/fecha={day}"


def latest_published(spark: SparkSession, root: str, fallback: str | None = None) -> DataFrame:
    """The newest published day, else the fallback; raises if there is neither."""
    if path_bytes(spark, root):
        df = spark.read.parquet(root)
        return df.join(df.agg(F.max("fecha").alias("fecha")), "fecha")
    if fallback and path_bytes(spark, fallback):
        return spark.read.parquet(fallback)
    raise FileNotFoundError(root)


class Served:
    """Frames for serving, cached until one of the paths they are made of changes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def get(self, name: str, paths: list[str], load: Callable[[], DataFrame]) -> DataFrame:
        """The cached frame, or a new one if a path was written since; the old one is let go."""
        mark = tuple((p, changed_at(self.spark, p)) for p in paths)
        if name not in self.held or self.held[name][0] != mark:
            if name in self.held:
                self.held[name][1].unpersist()
            self.held[name] = (mark, load().cache())
        return self.held[name][1]


def ready(probes: dict[str, Callable[[], bool]], tries: int = 6, wait: Callable[[], None] = lambda: None) -> dict[str, bool]:
    """Which sources answer: each probe is asked again up to ``tries`` times with a ``wait`` between; an error counts as no."""
    said = dict.fromkeys(probes, False)
    for i in range(tries):
        for name, probe in probes.items():
            if not said[name]:
                try:
                    said[name] = bool(probe())
                except Exception:
                    said[name] = False
        if all(said.values()) or i == tries - 1:
            break
        wait()
    return said


def run(spark: SparkSession, build: Callable[[Scope], DataFrame], sources: dict, scope: Scope, checks: list[Check], root: str, state: str, day: str, fallback: str | None = None) -> str:
    """'sin_cambios', 'publicado' or 'respaldo'.

    Nothing is built if the fingerprint is the committed one, unless forced. The gate raises before
    anything is published. Without sources the fallback stands in and the fingerprint is not
    committed; it is committed last, so a broken run is tried again.
    """
    store = State(spark, state)
    if not sources:
        if fallback is None:
            raise FileNotFoundError("no source is ready and there is no fallback")
        latest_published(spark, root, fallback)
        return "respaldo"
    mark = fingerprint(sources, scope)
    if store.read() == mark and not scope.force:
        return "sin_cambios"
    data = build(scope)
    validate(data, checks)
    publish(data, root, day)
    store.commit(mark)
    return "publicado"


def summary(df: DataFrame, path: str) -> dict:
    """One row of figures as JSON beside the data."""
    row = df.first().asDict(recursive=True)
    df.sparkSession.createDataFrame([(json.dumps(row, default=str),)], "json string").coalesce(1).write.mode("overwrite").text(path)
    return row

"""Data-quality checks of a table in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


class QualityError(RuntimeError):
    """Carries every check that failed."""


@dataclass
class Check:
    name: str
    violations: Column


def rows_where(name: str, bad: Column) -> Check:
    """Counts rows where a condition holds; unknown is no violation."""
    return Check(name, F.count_if(F.coalesce(bad, F.lit(False))))


def unique_key(key: str) -> Check:
    """Rows beyond the first of each key; null counts as a key."""
    return Check(f"clave_unica:{key}", F.count("*") - F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("\x00"))))


def at_least(name: str, found: Column, least: int) -> Check:
    return Check(name, F.greatest(F.lit(least) - found, F.lit(0)))


def empty_columns(columns: list[str]) -> list[Check]:
    """A violation for each column without any value."""
    return [Check(f"columna_vacia:{c}", (F.count(F.col(f"`{c}`")) == 0).cast("int")) for c in columns]


def columns_at_least(df: DataFrame, least: int) -> Check:
    return Check("columnas_minimas", F.max(F.lit(max(0, least - len(df.columns)))))


def missing_columns(df: DataFrame, wanted: list[str]) -> Check:
    """How many columns of the contract a table lacks."""
    return Check("columnas_que_faltan", F.max(F.lit(len(set(wanted) - set(df.columns)))))


def unmapped(name: str, value: Column, mapping: dict) -> Check:
    """Rows whose value stands in no entry of a mapping; a missing value needs none."""
    return rows_where(name, value.isNotNull() & ~value.isin(list(mapping)))


def same_flag(name: str, flag: Column, expected: Column) -> Check:
    """Rows where a flag is not what it follows from; unknown counts as false on both sides."""
    return rows_where(name, F.coalesce(flag, F.lit(False)) != F.coalesce(expected, F.lit(False)))


def report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(control, violaciones), all in one pass."""
    row = df.agg(*[c.violations.cast("bigint").alias(f"c{i}") for i, c in enumerate(checks)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c.name).alias("control"), F.col(f"c{i}").alias("violaciones")) for i, c in enumerate(checks)])).alias("x")).select("x.*")


def validate(df: DataFrame, checks: list[Check]) -> dict[str, int]:
    """The report as a dict; raises with the full list if any check fails."""
    got = {r["control"]: r["violaciones"] for r in report(df, checks).collect()}
    bad = {k: v for k, v in got.items() if v}
    if bad:
        raise QualityError("; ".join(f"{k}: {v}" for k, v in bad.items()))
    return got

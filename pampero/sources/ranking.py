"""Rankings: a page's table of clubs, and the members of a ranking's JSON, as rows."""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pampero.sources.arrivals_html import _plain, attributes

CLUB_FIELDS = ["tm_club_id", "tm_slug", "tm_nombre", "tm_nombre_oficial", "tm_pais"]
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TABLE = re.compile(r"<table\b([^>]*)>(.*?)</table\s*>", re.S | re.I)
_BODY = re.compile(r"<tbody\b[^>]*>(.*?)(?:</tbody\s*>|\Z)", re.S | re.I)
_ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|\Z)", re.S | re.I)
_CELL = re.compile(r"<td\b([^>]*)>(.*?)(?=<td\b|</td|\Z)", re.S | re.I)
_LINK = re.compile(r"<a\b([^>]*)>(.*?)(?:</a\s*>|\Z)", re.S | re.I)
_IMAGE = re.compile(r"<img\b([^>]*)>", re.S | re.I)


def ranking_rows(page: str | None) -> list[tuple]:
    """The clubs of a ranking page in order, each id once; see ``CLUB_FIELDS``.

    The table is the first of class ``items``; a row counts if its cell of class ``hauptlink`` has a
    link that names a club by ``verein``. Of the link's text and its title the one stands in for the
    other; the country is the title of the row's flag. A null, blank or broken page gives [].
    """
    found, seen = [], set()
    page = _COMMENT.sub("", page or "")
    table = next((m[2] for m in _TABLE.finditer(page) if "items" in attributes(m[1]).get("class", "").split()), None)
    body = _BODY.search(table) if table else None
    for row in _ROW.finditer(body[1]) if body else ():
        cell = next((c[2] for c in _CELL.finditer(row[1]) if "hauptlink" in attributes(c[1]).get("class", "").split()), None)
        link = next((a for a in _LINK.finditer(cell or "") if attributes(a[1]).get("href")), None)
        parts = attributes(link[1])["href"].split("/") if link else []
        if "verein" not in parts[:-1]:
            continue
        club = parts[parts.index("verein") + 1]
        if club in seen:
            continue
        seen.add(club)
        title, text = attributes(link[1]).get("title", "").strip(), _plain(link[2])
        flag = next((a for m in _IMAGE.finditer(row[1]) if "flaggenrahmen" in (a := attributes(m[1])).get("class", "").split()), {})
        found.append((club, _html.unescape(parts[1]) if len(parts) > 1 else None, text or title, title or text, flag.get("title")))
    return found


def parsed_rankings(pages: DataFrame) -> DataFrame:
    """One row per club of each ranking page (``pagina``, ``html``) with its place there (``pos``)."""

    def run(batches):
        for batch in batches:
            out = [(p, i, *row) for p, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, row in enumerate(ranking_rows(page))]
            cols = list(zip(*out)) if out else [()] * (2 + len(CLUB_FIELDS))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=["pagina", "pos", *CLUB_FIELDS])

    return pages.select(F.col("pagina").cast("bigint"), "html").mapInArrow(run, "pagina bigint, pos int, " + ", ".join(f"{f} string" for f in CLUB_FIELDS))


_MEMBERS = "miembros array<struct<member: struct<id: string, displayName: string, displayOfficialName: string, internationalName: string, displayNameShort: string, countryName: string, countryCode: string, associationId: string>, overallRanking: struct<position: int, totalValue: double, trend: string>>>"


def _members(raw: DataFrame, column: str) -> DataFrame:
    return raw.select(F.explode(F.from_json(column, _MEMBERS)["miembros"]).alias("m")).where("m is not null")


def club_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """The eleven fields of every club of a ranking's JSON; a member without a part has nulls there, broken JSON gives nothing."""
    names = {"uefa_club_id": "id", "uefa_nombre": "displayName", "uefa_nombre_oficial": "displayOfficialName", "uefa_nombre_internacional": "internationalName", "uefa_nombre_corto": "displayNameShort", "uefa_pais": "countryName", "uefa_pais_codigo": "countryCode", "uefa_asociacion_id": "associationId"}
    ranks = {"uefa_ranking": "position", "uefa_coeficiente": "totalValue", "uefa_tendencia": "trend"}
    return _members(raw, column).select(*[F.col(f"m.member.{k}").alias(n) for n, k in names.items()], *[F.col(f"m.overallRanking.{k}").alias(n) for n, k in ranks.items()])


def association_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """Country, code, rank and coefficient of every national association; the shown name stands in for a country without one."""
    country = F.coalesce(F.nullif("m.member.countryName", F.lit("")), "m.member.displayName")
    return _members(raw, column).select(country.alias("pais"), F.col("m.member.countryCode").alias("pais_codigo"), F.col("m.overallRanking.position").alias("pais_ranking_uefa"), F.col("m.overallRanking.totalValue").alias("pais_coeficiente_uefa"))

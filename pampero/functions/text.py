"""Text and key canonicalisation shared by the operators."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

#: Letters that NFKD leaves whole (fixed values).
FOLDS = {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "ı": "i", "þ": "th", "ð": "d", "œ": "oe"}


def _one_of(wanted) -> re.Pattern:
    """A pattern for runs of the characters that ``wanted`` holds for."""
    cps = [cp for cp in (*range(0x80, 0x20000), *range(0xE0000, 0xE0200)) if wanted(chr(cp))]
    runs, start = [], None
    for a, b in zip(cps, [*cps[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            runs.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return re.compile(f"[{''.join(runs)}]+")


COMBINING = _one_of(lambda c: unicodedata.combining(c) != 0)
FORMATS = _one_of(lambda c: unicodedata.category(c) == "Cf")


def fold(text: str) -> str:
    """Lower case without accents; the letters of ``FOLDS`` spelled out."""
    if text.isascii():
        return text.lower()
    text = COMBINING.sub("", unicodedata.normalize("NFKD", text).casefold())
    if not text.isascii():
        for letter, plain in FOLDS.items():
            if letter in text:
                text = text.replace(letter, plain)
    return text


def fold_text(col: Column) -> Column:
    """``fold`` over a column in Arrow batches; null stays null."""

    @pandas_udf("string")
    def _fold(s: pd.Series) -> pd.Series:
        known = {v: fold(v) for v in s.dropna().unique()}
        return s.map(known)

    return _fold(col)


def composed(col: Column) -> Column:
    """NFC without any white space or zero-width characters, in Arrow batches; null stays null."""

    @pandas_udf("string")
    def _composed(s: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            return unicodedata.normalize("NFC", "".join(c for c in v if not c.isspace() and unicodedata.category(c) != "Cf"))

        known = {v: one(v) for v in s.dropna().unique()}
        return s.map(known)

    return _composed(col)


def plain_digits(col: Column) -> Column:
    """An id without spaces, prefixes, decimals or leading zeros; null where there are no digits or several groups."""
    digits = F.regexp_extract(col.cast("string"), r"^\D*(\d+)(?:\.\d+)?\D*$", 1)
    return F.nullif(F.regexp_replace(digits, r"^0+(?=\d)", ""), F.lit(""))


def plain_date(col: Column) -> Column:
    """A date spelled YYYY-MM-DD (with or without a time), YYYYMMDD, YYYY/MM/DD or DD/MM/YYYY; null for anything else."""
    c = F.trim(col.cast("string"))
    iso = F.regexp_replace(c, r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:[T ].*)?$", "$1-$2-$3")
    european = F.regexp_replace(iso, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[T ].*)?$", "$3-$2-$1")
    return F.when(european.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), european).try_cast("date")

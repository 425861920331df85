"""Evaluation passages in documents: template windows, slots, and an exact check of the passage."""

from __future__ import annotations

import difflib
import html
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pampero.functions.text import FORMATS, fold
from pampero.session import list_dir, scratch

_TAG = re.compile(r"</?(?:b|i|u|em|strong|span|a|mark|small|sub|sup)\b[^<>]*>", re.I)
_BLOCK = re.compile(r"</?[A-Za-z!][^<>]*>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑­]\s*\n[\s>*|#\-]*(?=[^\W\d_])")
_NOT_WORD = re.compile(r"[^\w\s]+|_+")
#: Words for kinds of quantity (fixed values).
UNITS = frozenset("m m€ k € % euro euros million millions millon millones milhao milhoes minuto minutos minute minutes ano anos ans years year".split())
NAME, NUMBER, UNIT = "\x01n", "\x01#", "\x01u"


def words(text: str) -> list[str]:
    """The words of a text, alike for letter case, accents, punctuation, markup, line breaks, quotes and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _BLOCK.sub(" ", _TAG.sub("", text))
    text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = FORMATS.sub("", text)
    return _NOT_WORD.sub("", fold(text)).split()


def names_of(text: str) -> set[str]:
    """Words of an item written with a capital inside a sentence: names."""
    out, inside = set(), False
    for raw in text.split():
        core = raw.strip("«»“”\"'()[]{},;:.!?¿¡—-/")
        if core[:1].isupper() and (inside or not core.isalpha()):
            out.update(words(core))
        inside = not raw.endswith((".", "!", "?", ":", ")", "]", "—"))
    return out


@dataclass
class Windows:
    """The windows of a block's items of one width: hashes in order, item and place of each."""

    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def meet(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``hashes``, row here) of all equal ones."""
        lo, hi = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        n = hi - lo
        return np.repeat(np.arange(len(hashes)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


@dataclass
class Index:
    """A block of items: its short windows by template and slot values, its windows of a whole passage by template alone."""

    short: Windows
    whole: Windows
    ids: list
    words: list[list[str]]
    slot: list[list[bool]]
    template: list[np.ndarray]
    numbers: dict[str, tuple[int, int]]
    width: int
    least: int


def canonical(ws: list[str], plain: frozenset) -> list[str]:
    """The template of words: numbers, units and names as typed placeholders, the items' plain words as they are."""
    return [NUMBER if any(c.isdigit() for c in w) else UNIT if w in UNITS else w if w in plain else NAME for w in ws]


def numbered(ws: list[str], numbers: dict[str, tuple[int, int]]) -> np.ndarray:
    """Per word the number of its template and its own; a word that no item holds has the own number 0, which no item's word has."""
    name, number, unit = numbers[NAME], numbers[NUMBER], numbers[UNIT]
    pairs = [numbers.get(w) or (number if not w.isalpha() and any(map(str.isdigit, w)) else unit if w in UNITS else name) for w in ws]
    return np.array(pairs, np.uint64).reshape(-1, 2)


def rolled(columns: list[np.ndarray], width: int) -> np.ndarray:
    """A hash of every window of ``width`` places over one or more sequences: a polynomial over mixed numbers, built from windows of half the width."""
    seq = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for col, seed in zip(columns, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            x = (col + np.uint64(1)) * np.uint64(seed)
            seq += x ^ (x >> np.uint64(31))
        base, power, done, out, size = 0x100000001B3, seq, 0, None, 1
        while width >> (size.bit_length() - 1):
            if width & size:
                n = max(0, len(seq) - done - size + 1)
                out = power[:n] if out is None else out[:n] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + n]
                done += size
            n = max(0, len(power) - size)
            power = power[:n] * np.uint64(pow(base, size, 1 << 64)) + power[size : size + n]
            size *= 2
    return out


def _laid(parts: list[np.ndarray]) -> Windows:
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    item = np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)]) if parts else np.zeros(0, int)
    place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, int)
    order = np.argsort(h, kind="stable")
    return Windows(h[order], item[order], place[order])


def build_index(items: list[tuple], width: int, least: int = 15) -> Index:
    """The index of a block of items."""
    texts = [words(t or "") for _, t in items]
    names = set().union(*(names_of(t or "") for _, t in items)) if items else set()
    plain = frozenset(w for ws in texts for w in ws if w not in names and not any(c.isdigit() for c in w) and w not in UNITS)
    templates: dict[str, int] = {NAME: 1, NUMBER: 2, UNIT: 3}
    numbers: dict[str, tuple[int, int]] = {k: (v, 0) for k, v in templates.items()}
    shapes = [canonical(ws, plain) for ws in texts]
    for ws, shape in zip(texts, shapes):
        for w, t in zip(ws, shape):
            if w not in numbers:
                numbers[w] = (templates.setdefault(t, len(templates) + 1), len(numbers))
    both = [numbered(ws, numbers) for ws in texts]
    short = _laid([rolled([x[:, 0], x[:, 1]], width) for x in both])
    whole = _laid([rolled([x[:, 0]], least) for x in both])
    slot = [[c in (NAME, NUMBER) for c in shape] for shape in shapes]
    return Index(short, whole, [i for i, _ in items], texts, slot, [x[:, 0] for x in both], numbers, width, least)


def longest_passage(doc: list[str], item: list[str], share: float, slot: list[bool], least: int) -> tuple[int, float, float]:
    """Length, matched share and matched share of its slots, of the longest run of item words of which at least ``share`` stand in the document in order and close together; zeros where fewer than ``least`` words could."""
    there, words_needed = set(doc), int(np.ceil(share * least - 1e-9))
    if sum(w in there for w in item) < words_needed:
        return 0, 0.0, 0.0
    match = difflib.SequenceMatcher(None, doc, item, autojunk=False)
    at = np.full(len(item), -1)
    for a, b, n in match.get_matching_blocks():
        at[b : b + n] = np.arange(a, a + n)
    hit = np.flatnonzero(at >= 0)
    if len(hit) < words_needed:
        return 0, 0.0, 0.0
    best, best_share, best_slots = 0, 0.0, 0.0
    for i in range(len(hit)):
        for j in range(len(hit) - 1, i, -1):
            n = hit[j] - hit[i] + 1
            if n <= best:
                break
            span = at[hit[j]] - at[hit[i]] + 1
            got = j - i + 1
            if got >= share * n - 1e-9 and got >= share * span - 1e-9:
                slots = [k for k in range(hit[i], hit[j] + 1) if slot[k]]
                best, best_share, best_slots = int(n), got / n, sum(at[k] >= 0 for k in slots) / len(slots) if slots else 1.0
                break
    return best, best_share, best_slots


def _dense(item: np.ndarray, d: np.ndarray, p: np.ndarray, needed: int, least: int) -> np.ndarray:
    """Items with ``needed`` whole windows at different places close to one diagonal.

    A passage, however long, has a stretch of less than twice ``least`` words with so many; in it
    the diagonal d - p shifts by no more than the words left out there, so two sets of bands, each
    as wide as ``least`` and half a band apart, hold such a stretch whole in one of them.
    """
    out = []
    low, size = int(p.max()) + 1, int(d.max()) + 1
    bands = (size + low) // least + 2
    for shift in (0, least // 2):
        keys = np.unique((item * bands + (d - p + low + shift) // least) * size + d) // size
        band, n = np.unique(keys, return_counts=True)
        out.append(band[n >= needed] // bands)
    return np.unique(np.concatenate(out))


def consistent(pairs: list[tuple[str, str]]) -> bool:
    """Whether slots map one to one: the same value of the item always to the same value of the document and the other way."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in pairs)


def passages(ws: list[str], both: np.ndarray, index: Index, share: float, slots: float) -> dict[int, tuple]:
    """item number -> (words, share matched, windows) of the item's own passages in a document, of which half the slots hold the item's values."""
    at, row = index.short.meet(rolled([both[:, 0], both[:, 1]], index.width))
    if not len(at):
        return {}
    least = index.least
    # a passage of `least` words with a share of them changed keeps this many windows whole
    edits = least - int(np.ceil(share * least))
    needed = max(1, least - index.width + 1 - index.width * edits)
    item, place = index.short.item[row], index.short.place[row]
    counts = np.bincount(item, minlength=len(index.ids))
    often = counts[item] >= needed
    if not often.any():
        return {}
    out = {}
    for i in _dense(item[often], at[often], place[often], needed, least):
        mine = item == i
        d, p = at[mine], place[mine]
        # windows of one passage lie along a diagonal that edits shift by no more than their number
        order = np.argsort(d, kind="stable")
        d, p = d[order], p[order]
        reach = len(index.words[i]) * 2 + least
        cuts = np.flatnonzero(np.diff(d) > reach) + 1
        best = (0, 0.0, 0.0)
        for dd, pp in zip(np.split(d, cuts), np.split(p, cuts)):
            if len(np.unique(dd)) < needed or len(np.unique(pp)) < needed:
                continue
            a, b = max(0, dd[0] - least), dd[-1] + index.width + least
            # a passage spans less than `reach`, so it lies whole in one of these overlapping stretches
            for start in range(a, max(a + 1, b - reach), reach):
                best = max(best, longest_passage(ws[start : min(b, start + 2 * reach)], index.words[i], share, index.slot[i], least))
        if best[0] >= least and best[2] >= slots:
            out[int(i)] = (*best[:2], int(counts[i]))
    return out


def restated(ws: list[str], both: np.ndarray, index: Index, slots: float, plain: float) -> dict[int, tuple]:
    """item number -> (words, share of words equal, windows) of passages with the item's template whole, other values in its slots and each slot's value the same throughout."""
    at, row = index.whole.meet(rolled([both[:, 0]], index.least))
    out: dict[int, tuple] = {}
    if not len(at):
        return out
    item, place = index.whole.item[row], index.whole.place[row]
    # windows next to each other on one diagonal are one passage
    order = np.lexsort((at, at - place, item))
    at, place, item = at[order], place[order], item[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)]
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.r_[starts[1:], len(at)]):
        i, d, p, n = int(item[a]), int(at[a]), int(place[a]), int(b - a) + index.least - 1
        if not np.array_equal(both[d : d + n, 0], index.template[i][p : p + n]):
            continue  # equal hashes of unequal windows
        slot = index.slot[i][p : p + n]
        pairs = [(x, y) for x, y, s in zip(index.words[i][p : p + n], ws[d : d + n], slot) if s]
        if not pairs or len(pairs) > (1 - plain) * n or sum(x == y for x, y in pairs) >= slots * len(pairs) or not consistent(pairs):
            continue
        same = sum(x == y for x, y in zip(index.words[i][p : p + n], ws[d : d + n]))
        out[i] = max(out.get(i, (0, 0.0, 0)), (n, same / n, int(b - a)))
    return out


def matches_of(ws: list[str], index: Index, share: float = 0.8, slots: float = 0.5, plain: float = 0.5) -> list[tuple]:
    """(item number, 'pasaje' or 'reparametrizada', words, share of them equal, windows) of the items of a block that a document holds; own passages first."""
    if len(ws) < index.width or not index.words:
        return []
    both = numbered(ws, index.numbers)
    own = passages(ws, both, index, share, slots)
    other = restated(ws, both, index, slots, plain)
    return [(i, "pasaje", *m) for i, m in sorted(own.items())] + [(i, "reparametrizada", *m) for i, m in sorted(other.items()) if i not in own]


@lru_cache(1)
def _block(uri: str, width: int, least: int) -> Index:
    """The index of a block of items out of the shared folder; a worker keeps the last one."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        t = pq.read_table(f)
    return build_index(list(zip(t.column(0).to_pylist(), t.column(1).to_pylist())), width, least)


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 15, share: float = 0.8, width: int = 3, slots: float = 0.5, plain: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """Documents that hold a passage of at least ``least`` consecutive words of an item, its own or restated about others.

    Numbers, units and names become typed placeholders: the template. Two sets of template windows
    of the items are hash tables that each task holds, so no document moves. Windows of a whole
    passage are joined on the template alone; the slots of such a stretch are laid beside the
    item's. If fewer than ``slots`` of them hold the item's values and each value of the item stands
    for one and the same value throughout, the document is the item with new parameters
    (``reparametrizada``); with values that don't fit together it is nothing. At least the share
    ``plain`` of the stretch must be plain words, as a list of names is no template. Windows of
    ``width`` words are joined on template and slot values, for passages (``pasaje``) in which
    words were changed: how many of them any passage with a ``share`` of its words must keep
    follows from the q-gram bound, so none is lost before the exact check, which aligns the words
    themselves; of its slots, the share ``slots`` must hold the item's own values.

    Items stand in blocks of about ``block_words`` words in the shared folder, which the tasks read;
    the driver sees their number only. The corpus is read once, whatever the number of blocks, and
    a task holds one block at a time. Which words count as plain is settled within a block.

    Null, blank and empty texts on either side give nothing; whole texts are read; repeated rows
    come out as often as they stand; an item shorter than ``least`` words can't be found; other
    columns are ignored. Columns: key, item key, clase, palabras, proporcion, ventanas.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"{key} {kind}, {item_key} {item_kind}, clase string, palabras int, proporcion double, ventanas int"
    item_type = to_arrow_type(items.schema[item_key].dataType)
    held = items.where(F.col(item_text).isNotNull()).select(item_key, item_text)
    size = held.agg(F.sum(F.size(F.split(item_text, r"\s+")))).first()[0] or 0
    folder = scratch(spark, "leak-items")
    held.repartition(max(1, math.ceil(size / block_words))).write.parquet(folder)
    blocks = [f"{folder}/{f}" for f in list_dir(spark, folder) if f.endswith(".parquet")]

    def run(batches):
        for batch in batches:
            texts = [words(body) if body else [] for body in batch.column(1).to_pylist()]
            cols: list[list] = [[] for _ in range(6)]
            for uri in blocks:
                index = _block(uri, width, least)
                for at, ws in enumerate(texts):
                    for i, *found in matches_of(ws, index, share, slots, plain):
                        for c, v in zip(cols, (at, index.ids[i], *found)):
                            c.append(v)
            arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, item_key, "clase", "palabras", "proporcion", "ventanas"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)

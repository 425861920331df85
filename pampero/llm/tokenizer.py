"""Byte-level BPE ids of whole texts, without regular expressions.

Pre-tokenisation works on arrays: each code point gets a class, neighbours refine it, and the
automaton that knows where a piece starts is run over all code points of a batch at once. A
class is a function from states to states; functions compose associatively, and the closure of
these few functions under composition is a small table, so prefix states come from a blocked
scan over table look-ups.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White_Space of Unicode (fixed values).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that stand alone after an apostrophe (fixed values).
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE = range(4)
# automaton states: a piece is closed, in letters, in numbers, in others, in white space, after a leading blank, one or two ending letters to come
CLOSED, IN_L, IN_N, IN_O, IN_W, BLANK, END1, END2 = range(8)
# symbols: the classes with what their neighbours add
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_BLANK, S_END1, S_END2 = range(7)


def _step(state: int, symbol: int) -> int:
    if state == END2:
        return END1
    if state == END1:
        return CLOSED
    if symbol in (S_END1, S_END2) and state in (IN_O, BLANK):
        symbol = S_OTHER
    return {S_OTHER: IN_O, S_LETTER: IN_L, S_NUMBER: IN_N, S_WHITE: IN_W, S_BLANK: BLANK, S_END1: END1, S_END2: END2}[symbol]


def _starts(state: int, symbol: int) -> bool:
    """Whether a piece starts at a symbol read in a state."""
    if state in (END1, END2):
        return False
    after = _step(state, symbol)
    if symbol == S_BLANK or state == CLOSED:
        return True
    return not (after == state and after in (IN_L, IN_N, IN_O, IN_W) or state == BLANK and after in (IN_L, IN_N, IN_O))


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for start in range(0, 0x110000):
        c = unicodedata.category(chr(start))
        if c[0] == "L":
            table[start] = LETTER
        elif c[0] == "N":
            table[start] = NUMBER
    table[SPACES] = SPACE
    return table


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closure of the symbols' functions: composition table, state after each function from CLOSED, the ids of the symbols and of their text-initial forms, which forget the state."""
    plain = [tuple(_step(s, a) for s in range(8)) for a in range(7)]
    first = [(_step(CLOSED, a),) * 8 for a in range(7)]
    ids: dict[tuple, int] = {}
    for f in (*plain, *first):
        ids.setdefault(f, len(ids))
    queue, generators = list(ids), list(ids)
    for f in queue:
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in ids:
                ids[h] = len(ids)
                queue.append(h)
    fs = list(ids)
    compose = np.array([[ids[tuple(g[s] for s in f)] for g in fs] for f in fs], np.uint16)
    return compose, np.array([f[CLOSED] for f in fs], np.uint8), np.array([ids[f] for f in plain], np.uint16), np.array([ids[f] for f in first], np.uint16)


@lru_cache(1)
def _start_table() -> np.ndarray:
    return np.array([[_starts(s, a) for a in range(7)] for s in range(8)])


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions: blocks side by side, then the blocks' totals likewise, then both together."""
    n = len(f)
    if n <= 64:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    width = max(16, int(n**0.5))
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, f.dtype)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    for i in range(1, width):
        grid[i] = compose[grid[i - 1], grid[i]]
    totals = _scan(np.ascontiguousarray(grid[-1]), compose)
    grid[:, 1:] = compose[totals[:-1], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Offsets (in code points) at which pieces start, for texts laid end to end; ``text_starts`` are the texts' first offsets."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[points]
    first = np.zeros(n + 3, bool)
    first[text_starts[text_starts < n]] = True
    first[n:] = True
    # what follows within the same text; a text's end counts as white space
    white = np.append(cls == SPACE, [True] * 3)
    next_white = white[1 : n + 1] | first[1 : n + 1]
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], np.uint8)[cls]
    symbol[(points == 32) & ~next_white] = S_BLANK
    # a white run before something that isn't white ends with its last character on its own
    run_end = (cls == SPACE) & ~next_white & (points != 32)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.append(points, [0, 0, 0])
        a, b = padded[quotes + 1], padded[quotes + 2]
        in1, in2 = ~first[quotes + 1], ~first[quotes + 1] & ~first[quotes + 2]
        for e in ENDINGS:
            hit = in1 & (a == ord(e)) if len(e) == 1 else in2 & (a == ord(e[0])) & (b == ord(e[1]))
            symbol[quotes[hit]] = S_END1 if len(e) == 1 else S_END2
    compose, state_of, plain, initial = _monoid()
    f = np.where(first[:n], initial[symbol], plain[symbol])
    after = state_of[_scan(f, compose)]
    before = np.empty(n, np.uint8)
    before[0] = CLOSED
    before[1:] = after[:-1]
    before[first[:n]] = CLOSED
    starts = _start_table()[before, symbol] | run_end & ~np.isin(before, [END1, END2])
    return np.flatnonzero(starts)


class BytePairs:
    """Ids of pieces by a rank table of byte strings; pieces already merged are kept, up to a bound."""

    def __init__(self, path: str, kept: int = 200_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.kept, self.cache = kept, {}

    def merge(self, piece: bytes) -> list[int]:
        rank = self.rank
        whole = rank.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank.get(parts[i] + parts[i + 1], sys.maxsize) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == sys.maxsize:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], sys.maxsize)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], sys.maxsize)
        return [rank[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over linked parts, for pieces so long that list edits would be quadratic."""
        import heapq

        rank, n = self.rank, len(piece)
        end = list(range(1, n + 1))
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def push(i):
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n:
                r = rank.get(piece[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))

        heap: list = []
        for i in range(n):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            push(before[i])
        return [rank[piece[i : end[i]]] for i in range(n) if alive[i]]

    def ids(self, texts: list[str | None], offsets: bool = False):
        """The ids of each text ([] for empty and null), with ``offsets`` also where each piece starts and its number of ids."""
        kept = [t or "" for t in texts]
        points = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, kept), np.int64, len(kept))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        starts = piece_starts(points, begins[sizes > 0])
        whole = "".join(kept)
        bounds = np.append(starts, len(points)).tolist()
        cache, out, at = self.cache, [], 0
        share = np.searchsorted(starts, ends).tolist()
        where = []
        for stop, base in zip(share, begins.tolist()):
            mine: list[int] = []
            places = []
            while at < stop:
                piece = whole[bounds[at] : bounds[at + 1]]
                got = cache.get(piece)
                if got is None:
                    if len(cache) >= self.kept:
                        cache.clear()
                    got = self.merge(piece.encode("utf-8", "replace"))
                    if len(piece) < 64:
                        cache[piece] = got
                mine += got
                if offsets:
                    places.append((bounds[at] - base, len(got)))
                at += 1
            out.append(mine)
            where.append(places)
        return (out, where) if offsets else out

    @lru_cache(1)
    def _bytes(self) -> dict[int, bytes]:
        return {v: k for k, v in self.rank.items()}

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the exact inverse of ``ids`` for text without lone surrogates."""
        table = self._bytes()
        return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def default_vocabulary() -> str:
    """The rank file of byte_bpe_50k; PAMPERO_TOKENIZERS names another folder of public tokenizers."""
    return os.path.join(os.environ.get("PAMPERO_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


@lru_cache(2)
def _pairs(path: str) -> BytePairs:
    return BytePairs(path)


#: Code points that are laid end to end at a time.
BLOCK_POINTS = 2_000_000


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every text, in one pass without a shuffle.

    Empty and null texts have no ids: an empty list, never null. Long texts are encoded whole.
    Repeated rows come out as often as they stand; other columns are ignored. With ``offsets``,
    ``inicios`` holds for each id the code point at which its piece starts, so any id can be led
    back to its place in the text. The vocabulary file must be readable on every machine.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        pairs = _pairs(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK_POINTS):
                    size += len(texts[j] or "")
                    j += 1
                cols = [keys.slice(i, j - i)]
                if offsets:
                    ids, places = pairs.ids(texts[i:j], True)
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([[p for p, k in x for _ in range(k)] for x in places], pa.list_(pa.int32()))]
                else:
                    cols.append(pa.array(pairs.ids(texts[i:j]), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "inicios"][: len(cols)])
                i = j

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>" + (", inicios array<int>" if offsets else ""))

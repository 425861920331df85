"""Deeply nested JSON as related flat tables, with Merkle identities of the objects."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pampero.session import written

OCCURRENCES = "tabla string, registro bigint, ruta string, padre_ruta string, clave string, ordinal int, es_elemento boolean, nodo string, padre_nodo string, contenido string"


def _refuse(name: str):
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_OPEN = object()


def _parsed_deep(text: str):
    """As ``_parsed`` with a stack of its own, for texts nested deeper than the library's parser goes."""
    at, stack, key, want = 0, [], None, "value"
    done = _OPEN  # the whole value once it is closed

    def put(value):
        nonlocal done
        if not stack:
            done = value
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        else:
            stack[-1][0][stack[-1][1]] = value

    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if done is not _OPEN:
            if c:
                raise ValueError("more than one value")
            return done
        if want in ("value", "value or end") and c and c in "{[":
            stack.append([{} if c == "{" else [], None])
            want, at = ("key or end" if c == "{" else "value or end"), at + 1
            continue
        if c and c in "]}" and stack and isinstance(stack[-1][0], list) == (c == "]") and want in ("value or end", "key or end", "comma or end"):
            put_back, at = stack.pop()[0], at + 1
            put(put_back)
            want = "comma or end"
        elif want == "comma or end" and c == ",":
            want, at = ("value" if isinstance(stack[-1][0], list) else "key"), at + 1
        elif want in ("key", "key or end") and c == '"':
            key, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no value for a key")
            stack[-1][1], want, at = key, "value", at + 1
        elif want in ("value", "value or end") and c == '"':
            value, at = scanstring(text, at + 1, True)
            put(value)
            want = "comma or end"
        elif want in ("value", "value or end") and (m := _PLAIN.match(text, at)):
            put(json.loads(m[0]))
            want, at = "comma or end", m.end()
        else:
            raise ValueError(f"no JSON at {at}")


def _parsed(text: str):
    """The value of a JSON text, however deep; raises ValueError for anything that is not valid JSON."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _parsed_deep(text)


def _as_array(value):
    """Under an array key: the array itself, an array given as a JSON string, or a single object as its element 0; else None."""
    if isinstance(value, str):
        try:
            value = _parsed(value)
        except ValueError:
            return None
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else None


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _scalar(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def shred(root_key: str, value, array_keys: frozenset) -> Iterator[tuple]:
    """Yields (path, parent path, key, ordinal, is element, node, parent node, content) of every object below ``root_key``, children first.

    Objects are hashed bottom-up: a node is the hash of its sorted fields, where a nested object
    or array stands by its own hash, so equal subtrees have equal nodes wherever they occur.
    Neither the walk nor the parser recurses, so nesting has no bound.
    """
    out: list[list] = []

    # frame: kind, path, entries left to visit, digests so far, place (parent path, key, ordinal, element), objects waiting for their parent
    def frame(kind, path, entries, place):
        return [kind, path, iter(entries), [], place, []]

    def opened(key, path, child, owner):
        """What stands at ``key``: a frame for an object or an array, else the scalar's text."""
        if key in array_keys:
            array = _as_array(child)
            child = child if array is None else array
        if isinstance(child, list):
            return frame("list", f"{path}/{key}" if path else key, enumerate(child), (owner, key))
        if isinstance(child, dict):
            own = f"{path}/{key}" if path else key
            return frame("dict", own, sorted(child.items()), (owner, key, None, False))
        return _scalar(child)

    top = opened(root_key, "", value, None)
    if isinstance(top, str):
        return
    stack = [top]
    while stack:
        kind, path, entries, digests, place, waiting = stack[-1]
        if kind == "list":
            for i, child in entries:
                if isinstance(child, dict):
                    stack.append(frame("dict", f"{path}/{i}", sorted(child.items()), (place[0], place[1], i, place[1] in array_keys)))
                    break
                if isinstance(child, list):
                    stack.append(frame("list", f"{path}/{i}", enumerate(child), (place[0], place[1])))
                    break
                digests.append(_scalar(child))
            else:
                stack.pop()
                done, rows = "[" + ",".join(digests) + "]", waiting
                if stack:
                    up = stack[-1]
                    up[3].append(f"{_scalar(place[1])}:#{_digest(done)}" if up[0] == "dict" else "#" + _digest(done))
                    up[5].extend(rows)
                else:
                    out.extend(rows)
            continue
        for key, child in entries:
            below = opened(key, path, child, path)
            if isinstance(below, str):
                digests.append(f"{_scalar(key)}:{below}")
            else:
                stack.append(below)
                break
        else:
            stack.pop()
            content = "{" + ",".join(digests) + "}"
            node = _digest(content)
            for row in waiting:
                row[6] = node
            out.extend(waiting)
            row = [path, place[0], place[1], place[2], place[3], node, None, content]
            if stack:
                up = stack[-1]
                up[3].append(f"{_scalar(place[1])}:#{node}" if up[0] == "dict" else "#" + node)
                up[5].append(row)
            else:
                out.append(row)
    yield from map(tuple, out)


def occurrences(df: DataFrame, label: str, record: Column, columns: dict[str, str], array_keys: frozenset) -> DataFrame:
    """The bridge: one row per occurrence of an object in any of the JSON ``columns`` (column -> the source's field name).

    ``nodo`` is the object's Merkle identity and ``padre_nodo`` that of the object above it (null
    at the top), ``ruta`` its place and ``ordinal`` its place in the array ``clave``. ``contenido``
    holds the object's own fields, nested ones by ``#`` and hash, at the first sight of a node in
    each task and is null otherwise; ``nodes`` stores each once.

    Null, empty and invalid JSON give no rows; null elements give none but keep their position; a
    table without rows gives none; repeated records give their rows as often; other columns are
    ignored. One pass over the records, no shuffle.
    """

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            cols: list[list] = [[] for _ in range(10)]
            ids = batch.column(0).to_pylist()
            for at, root in enumerate(columns.values(), 1):
                for rid, text in zip(ids, batch.column(at).to_pylist()):
                    if not text or not text.strip():
                        continue
                    try:
                        value = _parsed(text)
                    except ValueError:
                        continue
                    for path, up, key, ordinal, element, node, parent, content in shred(root, value, array_keys):
                        if len(seen) > 200_000:
                            seen.clear()
                        new = node not in seen
                        seen.add(node)
                        for c, v in zip(cols, (label, rid, path, up, key, ordinal, element, node, parent, content if new else None)):
                            c.append(v)
                if len(cols[0]) > 20_000:
                    yield _arrow(cols)
                    cols = [[] for _ in range(10)]
            if cols[0]:
                yield _arrow(cols)

    kept = df.select(record.cast("bigint").alias("_r"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    return kept.mapInArrow(run, OCCURRENCES)


def _arrow(cols: list[list]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in OCCURRENCES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def nodes(bridge: DataFrame) -> DataFrame:
    """The store: each distinct object once, by its Merkle identity."""
    return bridge.where("contenido is not null").groupBy("nodo").agg(F.first("contenido").alias("contenido"))


def stored(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bridge, store) of ``occurrences`` as written tables: the records are parsed once for all the tables made of them."""
    once = written(found, "nested-occurrences")
    return once.drop("contenido"), written(nodes(once), "nested-store")


def within_elements(df: DataFrame, carried: list[str], column: str, root: str, item: str, array_keys: frozenset) -> DataFrame:
    """One row per object that is an element of the array ``root`` in the JSON ``column``, with the objects under a key ``item`` below it.

    ``elemento`` and ``contenido`` are the element's path and own fields, ``dentro`` the (ruta,
    contenido) of what lies in it, as ``occurrences`` names and writes them; the record's
    ``carried`` columns stay beside. Each record's objects are at hand in its walk, so neither a
    bridge nor a join on nodes is needed. Elements without such objects and items below no element
    give nothing, nor does text that is null, empty or no JSON. One pass, no shuffle.
    """
    schema = df.select(*carried).schema
    top = re.compile(rf"{re.escape(root)}/[0-9]+(?=/|$)")
    lies = pa.list_(pa.struct([("ruta", pa.string()), ("contenido", pa.string())]))

    def run(batches):
        for batch in batches:
            at, paths, contents, inside = [], [], [], []
            for i, text in enumerate(batch.column(len(carried)).to_pylist()):
                if not text or not text.strip():
                    continue
                try:
                    value = _parsed(text)
                except ValueError:
                    continue
                elements: dict[str, str] = {}
                below: dict[str, list] = {}
                for path, _, key, _, _, _, _, content in shred(root, value, array_keys):
                    m = top.match(path) if key in (root, item) else None
                    if m and key == root and m[0] == path:
                        elements[path] = content
                    if m and key == item:
                        below.setdefault(m[0], []).append({"ruta": path, "contenido": content})
                for path in below.keys() & elements.keys():
                    at.append(i)
                    paths.append(path)
                    contents.append(elements[path])
                    inside.append(below[path])
            if at:
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(len(carried))], pa.array(paths, pa.string()), pa.array(contents, pa.string()), pa.array(inside, lies)], names=[*carried, "elemento", "contenido", "dentro"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*carried, column).mapInArrow(run, f"{own}, elemento string, contenido string, dentro array<struct<ruta: string, contenido: string>>")


def as_json(content: Column) -> Column:
    """An object's stored content, whose nested objects are bare #hash marks, as JSON: the marks quoted."""
    return F.regexp_replace(content, r'(?<=[:,\[])#([0-9a-f]{32})(?=[,}\]])', '"#$1"')


def flat_table(bridge: DataFrame, store: DataFrame, where: Column, fields: dict[str, str], keep: Column | None = None) -> DataFrame:
    """The occurrences under a condition with scalar fields of their objects; each row names its parent's path and node.

    ``fields`` maps a column to a key; a value that is a nested object comes out as ``#`` and its
    node, so that it can be looked up in the store. ``where`` sees the occurrence, ``keep`` also
    the stored content of its object. Every occurrence finds its content, whatever key the object
    was first seen under: the store has each node of the bridge.
    """
    own = bridge.where(where).select("tabla", "registro", "ruta", "padre_ruta", "clave", "ordinal", "nodo", "padre_nodo")
    parts = store.select("nodo", "contenido", *[F.get_json_object(as_json(F.col("contenido")), f"$['{key}']").alias(name) for name, key in fields.items()])
    out = own.join(parts, "nodo")
    return (out if keep is None else out.where(keep)).drop("contenido")

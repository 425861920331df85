import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from pampero.operators.nested import _parsed, _parsed_deep, flat_table, nodes, occurrences, shred, stored

KEYS = frozenset(["items", "phases", "root"])


def brute(path, key, value, out):
    """Every object that is an element under an array key, by plain recursion."""
    if key in KEYS:
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                return
            if not isinstance(value, (list, dict)):
                return
        value = [value] if isinstance(value, dict) else value
    if isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, dict):
                if key in KEYS:
                    out.append(f"{path}/{i}")
                for k, x in v.items():
                    brute(f"{path}/{i}/{k}", k, x, out)
            elif isinstance(v, list):
                brute(f"{path}/{i}", None if key not in KEYS else key, v, out)
    elif isinstance(value, dict):
        for k, x in value.items():
            brute(f"{path}/{k}", k, x, out)


leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab\"\\", max_size=3))
tree = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.sampled_from(["items", "phases", "x", "y"]), c, max_size=3)), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(tree)
def test_same_paths_as_recursion(value):
    want = []
    brute("root", "root", value, want)
    got = list(shred("root", value, KEYS))
    assert sorted(r[0] for r in got if r[4]) == sorted(want)
    assert len({r[0] for r in got}) == len(got)


def test_equal_subtrees_share_a_node_and_keys_in_any_order():
    a = list(shred("root", [{"items": [{"t": 1, "u": 2}]}, {"items": {"u": 2, "t": 1}}], KEYS))
    by = {r[0]: r for r in a}
    assert by["root/0"][5] == by["root/1"][5] and by["root/0/items/0"][5] == by["root/1/items/0"][5]
    assert by["root/0/items/0"][6] == by["root/0"][5] and by["root/0/items/0"][1] == "root/0"


def test_deep_nesting_and_invalid(spark):
    deep = '{"items":[' * 300 + "]}" * 300
    data = [(1, '[{"items": [null, {"a": 1}]}]', "q"), (2, None, "q"), (3, "  ", "q"), (4, '[{"items": [', "q"), (5, '[NaN, {"a": 1}]', "q"), (6, '"[{\\"a\\": 1}]"', "q"), (1, '[{"items": [null, {"a": 1}]}]', "q"), (7, f"[{deep}]", "q")]
    df = spark.createDataFrame(data, "id bigint, doc string, nodo string")
    b = occurrences(df, "t", F.col("id"), {"doc": "root"}, KEYS)
    got = rows(b.where("es_elemento and registro < 7").select("registro", "ruta"))
    assert got == [(1, "root/0"), (1, "root/0"), (1, "root/0/items/1"), (1, "root/0/items/1"), (6, "root/0")]
    assert b.where("registro = 7").count() == 300
    assert nodes(b.where("registro < 7")).count() == 2
    flat = flat_table(*stored(b.where("registro < 7")), F.col("clave") == "items", {"valor": "a"})
    assert rows(flat, "registro", "padre_ruta", "ordinal", "valor") == [(1, "root/0", 1, "1")] * 2
    assert occurrences(df.limit(0), "t", F.col("id"), {"doc": "root"}, KEYS).count() == 0


def test_blocks_and_metrics_part_the_items(spark):
    from pampero.plans import datasets as ds

    doc = '[{"tournaments": {"statsSection": {"items": [{"title": "A", "items": [{"title": "x", "statValue": 1}, {"title": "x", "statValue": 1}]}]}}}]'
    df = spark.createDataFrame([(1, doc), (2, doc)], "id bigint, doc string")
    b = occurrences(df, "t", F.col("id"), {"doc": "statSeasons"}, ds.ARRAY_KEYS)
    b, store = stored(b)
    keep = lambda c: flat_table(b, store, F.col("clave").isin("statsSection", "items"), {"t": "title"}, F.expr(c))
    assert keep("clave <> 'items' or contenido like '%\"items\":#%'").count() == 4
    assert keep("clave = 'items' and contenido not like '%\"items\":#%'").count() == 4


def test_contents_first_seen_under_another_key(spark):
    """The same object stands first as a card, then as an item: the item has its content all the same."""
    one = '{"title": "Goals", "statValue": 3}'
    df = spark.createDataFrame([(1, f'{{"topStatCard": {one}}}'), (2, f'{{"items": [{one}]}}')], "id bigint, j string").coalesce(1)
    bridge = occurrences(df, "t", df.id, {"j": "j"}, frozenset(["items"]))
    got = flat_table(*stored(bridge), F.col("clave") == "items", {"titulo": "title", "valor": "statValue"}).collect()
    assert [(r["titulo"], r["valor"]) for r in got] == [("Goals", "3")]


@settings(max_examples=300, deadline=None)
@given(tree, st.sampled_from([None, 1]))
def test_the_deep_parser_reads_as_the_library(value, indent):
    text = json.dumps(value, indent=indent)
    assert _parsed_deep(f" {text}\n") == value
    for broken in (text[:-1] if len(text) > 1 and text[-1] in "]}\"" else "[", text + " 1", text + "]", "[,1]", "[1,]", '{"a" 1}', '{"a":}', "{1: 2}", "[1 2]", "NaN", "", "[01]", "]"):
        try:
            json.loads(broken, parse_constant=lambda n: json.loads("x"))
        except ValueError:
            try:
                _parsed_deep(broken)
            except ValueError:
                continue
            raise AssertionError(broken)


def test_a_record_nested_deeper_than_the_library_parses():
    text = '{"items":[' * 20_000 + "]}" * 20_000
    assert sum(1 for _ in shred("root", _parsed(text), KEYS)) == 20_000


@settings(max_examples=8, deadline=None)
@given(st.lists(tree, min_size=1, max_size=6))
def test_flat_tables_have_every_occurrence_of_the_bridge(spark, values):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values * 2)], "id bigint, j string").repartition(2)
    bridge, store = stored(occurrences(df, "t", df.id, {"j": "root"}, KEYS))
    for key in ("items", "phases", "x"):
        assert flat_table(bridge, store, F.col("clave") == key, {"a": "x"}).count() == bridge.where(F.col("clave") == key).count()
    assert store.count() == store.select("nodo").distinct().count() == bridge.select("nodo").distinct().count()

import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from pampero.llm import matching as mt, residue as rs, tokenizer as tk
from pampero.llm.components import components, pairs_within
from pampero.llm.leaks import build_index, leaks, matches_of, words
from pampero.llm.percentiles import from_summaries, percentiles, select_ranks, summaries
from pampero.llm.splits import allot, assign_splits, closest_subset


# --- components and splits -------------------------------------------------------------------

def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(i + 1, i) for i in range(0, 60, 2)] + [(5, 5)], [(0, i) for i in range(1, 50)], [(random.Random(3).randint(0, 80), random.Random(i).randint(0, 80)) for i in range(60)]])
def test_components_as_union_find(spark, edges):
    df = spark.createDataFrame(edges + edges[:3], "a bigint, b bigint")
    assert dict(rows(components(df))) == union_find(edges)


def test_components_edges_with_nulls_and_none(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a bigint, b bigint")
    assert rows(components(df)) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert components(df.limit(0)).count() == 0
    m = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "y"), (5, "x")], "n int, c string")
    assert rows(pairs_within(m, "n", "c")) == rows(pairs_within(m, "n", "c", 1)) == [(1, 2), (1, 5), (2, 5)]
    big = spark.range(60).select("id", F.lit("x").alias("c"))
    got = pairs_within(big, "id", "c", 7)
    assert got.count() == got.distinct().count() == got.where("a < b").count() == 60 * 59 // 2


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 4), max_size=5), st.floats(0, 60))
def test_closest_subset_is_closest(counts, target):
    items = [s for s, n in counts.items() for _ in range(n)]
    totals = {0}
    for s in items:
        totals |= {t + s for t in totals}
    got = closest_subset(counts, target)
    assert all(0 < got[s] <= counts[s] for s in got)
    assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(t - target) for t in totals)


def test_splits_keep_groups_shares_and_positives(spark):
    r = random.Random(5)
    data = [(f"r{i}", str(g), r.random() < 0.1) for i, g in enumerate(g for g in range(800) for _ in range(r.choice([1, 1, 1, 2, 5])))]
    data += [("n1", None, None), ("n2", None, True), (None, None, True), ("r0", "0", False)]
    df = spark.createDataFrame([(*x, "q") for x in data], "id string, player string, top boolean, componente string")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a bigint, b bigint")
    out = assign_splits(df, "id", F.col("player"), links, F.col("top"), {"train": 8, "val": 1, "test": 1}, buckets=8)
    assert out.count() == len(data)
    assert out.groupBy("componente").agg(F.count_distinct("particion").alias("n")).where("n > 1").count() == 0
    by = {a: (n, p) for a, n, p in rows(out.join(df.select("id", "top").distinct(), "id").groupBy("particion").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("top").cast("int"), F.lit(0))).alias("p")))}
    total = sum(n for n, _ in by.values())
    assert abs(by["train"][0] / total - 0.8) < 0.01 and abs(by["val"][0] / total - 0.1) < 0.01
    assert abs(by["val"][1] - by["train"][1]) < 0.03 and abs(by["test"][1] - by["train"][1]) < 0.03
    assert assign_splits(df.limit(0), "id", F.col("player"), links, F.col("top"), {"train": 8, "val": 1}).count() == 0


def test_a_group_with_a_third_of_the_rows():
    given_ = allot({(500, 50): 1, (1, 0): 900, (1, 1): 100}, {"train": 0.8, "val": 0.1, "test": 0.1})
    assert given_[(500, 50)]["train"] == 1
    assert sum(sum(v.values()) for v in given_.values()) == 1001


# --- percentiles -----------------------------------------------------------------------------

def test_percentiles_as_numpy_and_summaries_within_bound(spark):
    r = np.random.default_rng(2)
    data = [("a", "s1", float(v)) for v in r.integers(0, 4000, 3000)] + [("a", "s2", float(v)) for v in r.exponential(50, 2000)] + [("b", "s1", 5.0)] * 300 + [(None, "s1", 1.0), (None, "s1", 2.0), ("c", "s1", None), ("a", "s1", float("nan")), ("a", "s2", None)]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in data], "g string, season string, v double, c int, rank double")
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(g, p): (v, n) for g, p, v, n in rows(percentiles(df, ["g"], "v", at))}
    for g in ("a", "b", None):
        x = np.array([v for k, _, v in data if k == g and v is not None and v == v])
        for p in at:
            assert got[g, p][0] == pytest.approx(np.percentile(x, p * 100), abs=1e-5) and got[g, p][1] == len(x)
    assert ("c", 0.5) not in got
    joined = {(g, p): v for g, p, n, v, e in rows(from_summaries(summaries(df, ["g", "season"], "v", 0.02), ["g"], at, 0.02)) if g == "a"}
    x = np.sort([v for k, _, v in data if k == "a" and v is not None and v == v])
    for p in at:
        lo, hi = np.searchsorted(x, joined["a", p], "left") + 1, np.searchsorted(x, joined["a", p], "right")
        want = max(1, int(np.ceil(p * len(x))))
        assert lo - 0.02 * len(x) - 1 <= want <= hi + 0.02 * len(x) + 1
    assert percentiles(df.limit(0), ["g"], "v", at).count() == 0


def test_ranks_in_groups_of_every_size(spark):
    r = np.random.default_rng(8)
    data = {("a", None): np.arange(2000.0), ("a", "x"): np.array([4.0]), (None, "x"): np.array([1.0, 2.0]), ("b", "y"): np.unique(r.exponential(3, 500))}
    df = spark.createDataFrame([(*k, float(v), 1 + i % 3) for k, vs in data.items() for i, v in enumerate(vs)], "g0 string, g1 string, v double, c bigint").repartition(5)
    asked, want = [], []
    for k, vs in data.items():
        each = np.repeat(vs, [1 + i % 3 for i in range(len(vs))])
        for rank in {1, len(each), len(each) // 2 + 1, min(7, len(each))}:
            asked.append((*k, rank))
            want.append((*k, rank, float(each[rank - 1])))
    got = select_ranks(df, ["g0", "g1"], spark.createDataFrame(asked, "g0 string, g1 string, rank bigint"))
    assert rows(got, "g0", "g1", "rank", "v") == sorted(want, key=str)
    assert select_ranks(df.limit(0), ["g0", "g1"], spark.createDataFrame([], "g0 string, g1 string, rank bigint")).count() == 0


def test_a_round_discards_a_quarter(spark):
    """However the values lie in parts, the next pivots part a range's weight no worse than one to three."""
    from pampero.llm import percentiles as pc

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.range(3000).select(F.struct(F.lit("a").alias("g0")).alias("g"), F.pow("id", F.lit(3)).cast("double").alias("v"), F.lit(1).cast("bigint").alias("c"))
        live = spark.range(1).select(F.lit(5).cast("bigint").alias("id"), F.struct(F.lit("a").alias("g0")).alias("g"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1e9).alias("p"))
        row = pc._counted(df, live).first()
        assert (row["less"], row["at"], row["above"]) == (1000, 1, 1999)
        assert 250 <= round(row["p_less"] ** (1 / 3)) <= 750 and 1000 + 500 <= round(row["p_above"] ** (1 / 3)) <= 1000 + 1500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- tokenizer -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pairs():
    import os

    if not os.path.exists(tk.default_vocabulary()):
        pytest.skip("no public tokenizers")
    return tk.BytePairs(tk.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(tk.default_vocabulary()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 2  \n\t'’srevmlldDS.,-_é 　٣½́?!你​<|>"), max_size=40), max_size=6))
def test_ids_as_the_library(pairs, library, texts):
    assert pairs.ids(texts) == library(texts)
    assert [pairs.decode(i) for i in pairs.ids(texts)] == texts


def test_long_pieces_special_strings_and_offsets(pairs, library):
    texts = ["x" * 5000, "½" * 700, "<|endoftext|> a", " " * 3000 + "b", "", "it's we'll  don't"]
    assert pairs.ids(texts) == library(texts)
    ids, where = pairs.ids(["it's  ok"], True)
    assert [p for p, _ in where[0]] == [0, 2, 4, 5] and sum(n for _, n in where[0]) == len(ids[0])


def test_encode_frame(spark, pairs, library):
    df = spark.createDataFrame([(1, "hola mundo", 9), (2, None, 9), (3, "", 9), (1, "hola mundo", 9)], "doc_id bigint, text string, ids int")
    want = library(["hola mundo"])[0]
    got = sorted((r["doc_id"], r["ids"]) for r in tk.encode(df, "doc_id", "text").collect())
    assert got == [(1, want), (1, want), (2, []), (3, [])]
    assert tk.encode(df.limit(0), "doc_id", "text").count() == 0
    assert tk.encode(df, "doc_id", "text", offsets=True).where("size(ids) <> size(inicios)").count() == 0


# --- leaks -----------------------------------------------------------------------------------

ITEM = "La comisión de Nuvetáse midió 681 sprints de Fada Turubazu, 9 más que los de Vańun Mekfufisku con FC Fobaputo. En la temporada 2022/2023, Fuser Zetagora cambió Olimpia Nafaroga por Sepivure sin que nadie recibiera compensación alguna."


def found(spark, *texts, items=((7, ITEM),), clase="pasaje", **how):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    return rows(leaks(docs, "doc_id", "text", it, "item_id", "text", **how).where(F.col("clase") == clase), "doc_id", "item_id")


def test_passages_in_every_guise(spark):
    w = ITEM.split()
    part = " ".join(w[3:21])
    changed = w[2:24]
    for i in (3, 9, 15, 20):
        changed[i] = "quizá"
    texts = [ITEM, "Antes. " + part + " Después.", part.upper(), "> " + "\n> ".join(" ".join(w[i : i + 6]) for i in range(0, 24, 6)), part.replace("ó", "&oacute;").replace("681", "<b>681</b>"), " ".join(changed), part.replace("Turubazu", "Turu​ba­zu").replace(",", ""), " ".join(x for i, x in enumerate(w[:25]) if i % 6 != 3)]
    assert found(spark, *texts) == [(i, 7) for i in range(len(texts))]


OTHER = ITEM.replace("Nuvetáse", "Bativöfo").replace("681", "12").replace("Fada Turubazu", "Gipik Lorzo").replace("9 más", "4 más").replace("Vańun Mekfufisku", "Tubur Sasa").replace("Fobaputo", "Lika").replace("2022/2023", "2019/2020").replace("Fuser Zetagora", "Rulo Man").replace("Olimpia Nafaroga", "Racing Zul").replace("Sepivure", "Vop")


def test_what_is_no_passage(spark):
    w, other = ITEM.split(), OTHER
    assert found(spark, " ".join(w[2:13]), other, None, "", "  ", " ".join(w[i] for i in range(0, 30, 3))) == []
    assert found(spark, ITEM, items=()) == [] and found(spark, ITEM, items=((1, None), (2, ""))) == []


def test_the_same_question_about_others(spark):
    """Its template stands whole and each name is exchanged for one other throughout: restated; with names that don't fit together it is nothing."""
    twice = "Según el acta, Ana Ruiz marcó 3 goles con el Betis y después Ana Ruiz salió del Betis por otros 3 millones."
    fits = twice.replace("Ana Ruiz", "Eva Soto").replace("Betis", "Cádiz").replace("3", "8")
    mixed = fits.replace("Cádiz por", "Elche por").replace("y después Eva Soto", "y después Luz Vega")
    items = ((7, ITEM), (8, twice))
    assert found(spark, "Hola. " + OTHER, fits, mixed, items=items, clase="reparametrizada") == [(0, 7), (1, 8)]
    assert found(spark, "Hola. " + OTHER, fits, mixed, items=items) == []
    assert found(spark, twice, ITEM, items=items) == [(0, 8), (1, 7)] and found(spark, twice, ITEM, items=items, clase="reparametrizada") == []
    # one word of the phrasing changed: no longer the item's template
    assert found(spark, fits.replace("acta", "diario").replace("salió", "marchó"), items=items, clase="reparametrizada") == []


def test_items_in_many_blocks_and_one_scan(spark):
    items = tuple((i, ITEM.replace("Nuvetáse", f"Club{i}x").replace("Fuser", f"Nom{i}x")) for i in range(30))
    docs = [t for _, t in items[:6]] + ["nada"]
    one, many = (found(spark, *docs, items=items, block_words=n) for n in (10**9, 100))
    assert one == many and {(i, i) for i in range(6)} <= set(one)
    df = spark.createDataFrame([(1, "x")], "k int, t string")
    it = spark.createDataFrame(items, "q int, t string")
    assert leaks(df, "k", "t", it, "q", "t", block_words=100)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_windows_are_equal_where_their_words_are():
    from pampero.llm.leaks import rolled

    r = np.random.default_rng(0)
    for n, width in ((200, 3), (200, 15), (40, 8), (5, 15), (15, 15), (0, 3), (400, 1)):
        x, y = (r.integers(0, 3, n).astype(np.uint64) for _ in range(2))
        h = rolled([x, y], width)
        assert len(h) == max(0, n - width + 1)
        seen = {}
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(v, (x[i : i + width].tolist(), y[i : i + width].tolist())) == (x[i : i + width].tolist(), y[i : i + width].tolist())
        assert len(seen) == len({(*x[i : i + width].tolist(), *y[i : i + width].tolist()) for i in range(len(h))})


def test_a_document_that_repeats_an_item_many_times():
    ws = words(ITEM) * 300
    assert [m[:3] for m in matches_of(ws, build_index([(1, ITEM)], 3))] == [(0, "pasaje", len(words(ITEM)))]


def test_no_passage_is_lost_to_the_windows():
    """Any 15 words with three changed keep the windows that the bound asks for."""
    base = [f"w{i}" for i in range(15)]
    index = build_index([(1, " ".join(base))], 3)
    for spots in itertools.combinations(range(1, 14), 3):
        ws = [f"zz{i}" if i in spots else w for i, w in enumerate(base)]
        got = matches_of(["a", "b", *ws, "c"], index)
        assert got and got[0][1:3] == ("pasaje", 15), spots


def test_keys_of_other_types_and_null_keys(spark):
    docs = spark.createDataFrame([("d", ITEM), (None, ITEM), ("e", "nada")], "k string, t string")
    it = spark.createDataFrame([("i", ITEM), (None, ITEM)], "q string, t string")
    assert leaks(docs, "k", "t", it, "q", "t").count() == 4
    assert leaks(docs.where("k = 'e'"), "k", "t", it, "q", "t").count() == 0


def test_very_long_texts():
    long = ("Por fin, el club cerró la llegada del delantero por 9 millones. " * 40_000) + ITEM
    assert [m[2] for m in matches_of(words(long), build_index([(1, ITEM)], 3))] == [len(words(ITEM))]
    assert rs.reasons(long) == [] and rs.reasons(long + " {{x}}") == ["slot"] and rs.reasons("<code>" * 2000 + long[:200_000]) == []


def test_words():
    assert words("Año «nuevo», avant-centre re-\n* placé <b>Ł</b>ódź&nbsp;2019/2020 — x") == ["ano", "nuevo", "avantcentre", "replace", "lodz", "20192020", "x"]


# --- residue ---------------------------------------------------------------------------------

@pytest.mark.parametrize("text", ["Firmó {{ jugador }} ayer.", "a ${club} b", "a {% include club %} b", "a <%= club %> b", "a <?= $club ?> b", "a [[club]] b", "a @@club@@ b", "a __CLUB__ b", "a %CLUB% b", "a %(club)s b", "pagó %s por él", "a {0} b", "a #{user.name} b", "a &lt;fecha&gt; b", "a [INSERTAR CLUB] b", "a <PLAYER NAME> b", "donde jugó «NOMBRE DEL JUGADOR» 827 veces", "donde jugó 385 «INSERTAR CLUB» veces", "el [DATE TBC BY EDITOR] x", "el XXXXX club", "XX/XX/XXXX", "ficha undefined hoy", "suma NaN goles", "a [object Object] b"])
def test_slots(text):
    assert "slot" in rs.reasons(text)


@pytest.mark.parametrize("text", ["Lorem ipsum dolor sit amet tempor.", "Nota. Texto de relleno para la maqueta.", "Body copy goes here.", "bla bla bla bla", "asdf asdf asdf", "aquí texto aquí texto aquí texto", "TODO: escribir la crónica.", "CONTENIDO PENDIENTE", "Placeholder text, replace before going live."])
def test_filler(text):
    assert "filler" in rs.reasons(text)


@pytest.mark.parametrize("text", ["404 Not Found\nBack to home", "<html><body><h1>503 Not Found</h1></body></html>", "Please enable JavaScript to view this squad list.", "Acceso denegado. Su dirección ha sido bloqueada temporalmente. Código 53030f25", "Serviço indisponível. Tente mais tarde. (26996104)", "Les scripts sont désactivés dans votre navigateur.", "Estamos en mantenimiento. Volvemos en unos minutos.", "Internal error 404 while rendering transfer/385a62df\n<hr><center>srv/404</center>"])
def test_pages(text):
    assert "page" in rs.reasons(text)


ARTICLE = "Por fin, el club cerró la llegada del delantero por 9 millones de euros y lo presentó ante la grada. "


@pytest.mark.parametrize("text", [None, "", "  \n", "El dibujo {4-3-3} duró poco.", "«NO VINE A MIRAR», DIJO ANA AL LLEGAR.", "«Insertar juventud en el equipo», pidió Ana.", "«Es un error [sic] dejarlo», dijo [ver nota 2].", '{"a": [1, 2]}', "https://x.example/j?id=%20&x={id}", "_snake_case camelCase", "cobrará $ 267 por partido", ARTICLE + "La web mostró un error 404 al presentar a Ana.", ARTICLE + "El club busca un programador con JavaScript para su web.", "Access to the stand was denied to 9 fans. " + ARTICLE, "Ana was not found at the hotel on Monday, Luis said. " + ARTICLE, "La plantilla tiene 9 jugadores sin rellenar su licencia.", "Use `{{ name }}` and\n```\n{{ club }} ${fee}\n```\nin your page.", "Template syntax: write {{ name }} where the value goes, and the engine puts the value there when the page is made.", "Página 404 del informe.", "garde 25 % d'une revente", "[2019/2020, Kepilibi] contaram 3 arranques"])
def test_clean(text):
    assert rs.reasons(text) == []


def test_residue_frame(spark):
    df = spark.createDataFrame([(1, "a {{x}} b", "m"), (1, "a {{x}} b", "m"), (2, None, "m"), (3, "bien" * 100_000 + " {{x}}", "m"), (4, "bien", "m")], "doc_id bigint, text string, motivos string")
    assert rows(rs.residue(df, "doc_id", "text"), "doc_id") == [(1,), (1,), (3,)]
    assert rs.residue(df.limit(0), "doc_id", "text").count() == 0


# --- matching --------------------------------------------------------------------------------

def brute_total(gain):
    n, m = gain.shape
    best = 0.0
    for cols in itertools.product(range(-1, m), repeat=n):
        used = [c for c in cols if c >= 0]
        if len(used) == len(set(used)):
            best = max(best, sum(gain[i, c] for i, c in enumerate(cols) if c >= 0))
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10_000))
def test_the_auction_is_within_its_step_of_the_best(n, m, seed):
    r = np.random.default_rng(seed)
    gain = np.where(r.random((n, m)) < 0.6, r.integers(1, 10, (n, m)) / 10, 0.0)
    links = [(i, j, gain[i, j]) for i in range(n) for j in range(m) if gain[i, j] > 0]
    got = mt.local_auction(*map(list, zip(*links)), 0.001) if links else []
    assert len({i for i, _, _ in got}) == len(got) == len({j for _, j, _ in got})
    assert sum(g for _, _, g in got) >= brute_total(gain) - 0.001 * min(n, m) - 1e-9 and all(gain[i, j] == g for i, j, g in got)


def test_the_auction_in_tasks_and_over_tables(spark):
    r = np.random.default_rng(4)
    edges = [(f"a{i}", f"b{j}", float(r.integers(50, 100)) / 100) for i in range(7) for j in range(5) if r.random() < 0.5]
    edges += [("x" * 20_000 + str(i), "y" * 20_000 + str(j), 0.9 if i == j else 0.8) for i in range(2) for j in range(2)] + [("a0", "b0", 0.1)]
    df = spark.createDataFrame(edges, "a string, b string, confianza double")
    tasks, tables = mt.assign(df, step=0.01).collect(), mt.assign(df, step=0.01, links=0).collect()
    assert abs(sum(x["confianza"] for x in tasks) - sum(x["confianza"] for x in tables)) <= 0.01 * 9 + 1e-9
    for got in (tasks, tables):
        assert len({x["a"] for x in got}) == len(got) == len({x["b"] for x in got})
        assert sum(len(x["a"]) > 20_000 for x in got) == 2
    assert mt.assign(df.limit(0)).count() == 0


def test_neighbours_cross_block_borders_and_survive_one_hot_key(spark):
    recs = [(2 * i + k, side, ["same", f"{i:03d}"], float(i)) for i in range(60) for k, side in enumerate("ab")]
    df = spark.createDataFrame(recs, "rid bigint, side string, keys array<string>, n double")
    got = rows(mt.neighbours(df, "keys", ["n"], lambda x, y: x["n"] == y["n"], window=2, block=10), "a", "b")
    assert got == sorted([(2 * i, 2 * i + 1) for i in range(60)], key=str)
    every = mt.neighbours(df, "keys", [], None, window=3, block=7)
    want = {(x, y) for x in range(0, 120, 2) for y in range(1, 120, 2) if abs(x - y) <= 3}
    assert {tuple(r) for r in every.collect()} == want and every.count() == len(want)


def test_confidence_of_many_pairs_as_of_one():
    r = random.Random(3)

    def one(x, y):
        parts = [(0.4, 0.9), (0.16, x["l"]), *((w, None if x[k] is None or y[k] is None else s.get(abs(x[k] - y[k]), 0.0)) for k, w, s in (("nacido", 0.18, {0: 1.0, 1: 0.9, 2: 0.3}), ("altura", 0.14, {0: 1.0, 1: 0.85, 2: 0.5}))), *((w, None if x[k] is None or y[k] is None else float(x[k] == y[k])) for k, w in (("pie_c", 0.05), ("rol_c", 0.07)))]
        return sum(w * s if s is not None else w / 2 * 0.6 for w, s in parts) / sum(w if s is not None else w / 2 for w, s in parts)

    some = lambda *v: r.choice([None, *v])
    people = [[{"l": some(0.0, 1.0), "nacido": some(1990, 1991, 1994), "altura": some(180, 182, 190), "pie_c": some(1, 2), "rol_c": some(1, 2)} for _ in range(200)] for _ in range(2)]
    x, y = ({k: np.array([p[k] if p[k] is not None else np.nan for p in side], float) for k in side[0]} for side in people)
    assert mt.people_confidence(0.9, x["l"], x, y) == pytest.approx([one(a, b) for a, b in zip(*people)])


def test_clubs(spark):
    data = [("a", "1", "Wand. Goupevengul", "Belgium"), ("a", "2", "RAPID GÜPEVNGUL", "Belgium"), ("a", "3", "Kukalosi", "Uruguay"), ("a", "4", None, "Spain"), ("a", "5", "SK Nagulpěma ", "Czech Republic"), ("a", "5", "SK Nagulpěma ", None), ("a", "6", "Bafo", "Türkiye")]
    data += [("b", "11", "Wanderers Güpevengul", "Belgium"), ("b", "12", "Rapid Güpevngul", "Belgium"), ("b", "13", "Sport Klub Nagulpema 1946", "Czechia"), ("b", "14", "Bafó", "Turkey"), ("b", "15", "Zzz", "Spain")]
    df = spark.createDataFrame([(*x, 1) for x in data], "side string, ent string, name string, country string, nombre int")
    assert rows(mt.match_clubs(df, least=0.7), "a", "b") == [("1", "11"), ("2", "12"), ("5", "13"), ("6", "14")]
    assert mt.match_clubs(df.limit(0)).count() == 0


def test_people(spark):
    data = [("a", "1", "kazes govolorme", "austria|", 1999, 182, "right", "d"), ("a", "2", "kazes govolorme", "spain|", 1994, 170, "left", "a"), ("a", "3", "", "spain|", 1994, 170, "left", "a"), ("a", "4", "lusar tinmubito", "", None, None, "", "")]
    data += [("b", "11", "k govolorme", "austria", 1999, 182, "right", "d"), ("b", "12", "govolorme", "spain", 1994, 171, "left", "a"), ("b", "13", "lusar tinmubito", "france", 1990, 180, "left", "g"), ("b", "14", "otro nombre", "spain", 1994, 170, "left", "a"), ("b", "15", None, None, None, None, None, None), ("a", "5", "solo nombre", None, None, None, None, None)]
    df = spark.createDataFrame(data, "side string, ent string, nombre string, paises string, nacido int, altura int, pie string, rol string")
    assert rows(mt.match_people(df), "a", "b")[:2] == [("1", "11"), ("2", "12")]
    assert mt.match_people(df.limit(0)).count() == 0


def test_profile_fields_and_names():
    assert mt.profile_fields('[{"title":"Height","value":{"fallback":"1.84 m"}},{"title": "Age", "value": {"numberValue": 39, "fallback": "39"}}, {"title": "Country", "val') == {"height": "1.84 m", "age": "39"}
    assert mt.profile_fields('"[{\\"title\\": \\"Age\\", \\"value\\": 25}]"') == {"age": "25"}
    assert [mt.height_cm(x) for x in ("184 cm", "184cm", "1.84 m", "1,8 m", "x", None)] == [184, 184, 184, 180, None, None]
    assert mt.person_tokens("Rinovbãra, Tinvi") == ["tinvi", "rinovbara"]
    assert mt.token_similarity("shagieblu", "shagibelu") >= 0.85


def test_queries_have_their_columns(spark):
    import os

    from pampero.llm import queries as q

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    want = {"p3_found": ["jugador_tm_id_a", "jugador_tm_id_b"], "p4_found": ["tipo", "plata_id", "fuente_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, cols in want.items():
        df = q.QUERIES[name](spark, d)
        assert df.columns == cols
        assert df.count() > 0
        assert df.count() == df.distinct().count()


@pytest.mark.parametrize("text", [*(f"{o}{verb} X{c}" for o, c in ("()", '""', "‘’", "**", "__", "«»", "“”") for verb in ("INSERT CLUB", "INSERIR CLUBE", "INSÉRER LE NOM", "INSERER LE NOM", "COMPLETAR CLUB", "COMPLÉTER LE NOM", "RELLENAR CLUB", "PREENCHER CLUBE", "REMPLIR LE NOM", "FILL IN CLUB", "NOMBRE DEL CLUB", "NOME DO CLUBE", "NOM DU CLUB", "PLAYER NAME", "DATE TBC", "FEE TBD")), "xx/xx/xx", "XX/XX/XXXX"])
def test_the_marks_pass_every_stand_in(text):
    assert "slot" in rs.reasons(f"llegó {text} ayer")


@pytest.mark.parametrize("text", ["Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "Quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", *(" ".join(rs.LATIN[i : i + 5]) for i in range(len(rs.LATIN) - 4))])
def test_the_keys_pass_every_latin_run(text):
    assert rs.reasons(text) == ["filler"]


def test_recall_on_messages_that_were_not_used_in_writing_the_grammars():
    from unseen_residue import FILLER, PAGES

    assert sum("page" in rs.reasons(t) for t in PAGES) == 35 and len(PAGES) == 42
    assert sum("filler" in rs.reasons(t) for t in FILLER) == 20 and len(FILLER) == 26
    # amid an article the same messages are no page
    assert not any("page" in rs.reasons(ARTICLE * 6 + t) for t in PAGES)


@pytest.mark.parametrize("number", range(len(rs.GRAMMARS)))
def test_the_sieve_passes_whatever_a_grammar_matches(number):
    kind, pattern = rs.GRAMMARS[number]
    grammar = rs.re.compile(pattern, rs.re.I if kind == "latin" else 0)

    @settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(grammar), st.sampled_from(["", "Ana marcó. ", "İı ſ "]))
    def passes(text, before):
        assert number in rs._SIEVE.passes(rs.low_of(before + text))

    passes()


def test_required_strings():
    assert rs.required(r"(?:page|p[aá]gina)\b.*?(?:not found|no existe)") == [[frozenset({"page", "pagina", "página"}), frozenset({"not found", "no existe"})]]
    assert rs.required(r"a|bc+") == [[frozenset({"a"})], [frozenset({"b"}), frozenset({"c"})]] and rs.required(r"\w+|x") == [[], [frozenset({"x"})]]


@pytest.mark.parametrize("text", ["Serviço indisponível", "Esta página já não está disponível.", "Reconnectez-vous", "Parágrafo de exemplo", "(RELLENAR ANTES)", "(FILL IN THE BLANK)", "ola ola ola ola ola", "a <" + "b" * 500 + " href='{{x}}'> {{ jugador }}"])
def test_no_gate_keeps_a_match_out(text):
    assert rs.reasons(text)


def test_density_and_context():
    tutorial = "Template syntax: " + "write it where the value goes and the engine puts the value there " * 3
    assert rs.reasons(tutorial + "{{ name }}") == [] and rs.reasons(tutorial + "{{ name }} " * 40) == ["slot"]
    assert rs.reasons("Un gol, dos goles, gol gol gol gol gritó la grada en la tarde de Ana y de Luis.") == []
    code = "`" + "".join(f"{{{{x{i}}}}}" for i in range(60)) + "`"
    assert rs.reasons("{{ name }} `code` and " + code) == ["slot"] and rs.reasons(code) == []


def test_balance_of_the_splits_and_sql_by_value(spark):
    import os

    import duckdb

    from pampero.llm import queries as q

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    got = {r["particion"]: r for r in q.QUERIES["p3_balance"](spark, d).collect()}
    want = dict(rows(spark.read.parquet(f"{d}/particion_objetivo.parquet"), "particion", "proporcion"))
    assert set(got) == set(want) and all(abs(got[k]["proporcion"] - want[k]) < 0.03 and got[k]["grupos_partidos"] == 0 for k in want)
    con = duckdb.connect()
    for p in os.listdir(d):
        con.sql(f"create view {p[:-8]} as select * from '{d}/{p}'")
    for name, sql in q.SQL.items():
        df, want = q.QUERIES[name](spark, d), con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        value = lambda r: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)
        assert sorted((value(r[c] for c in cols) for r in df.collect()), key=str) == sorted((value(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=str), name

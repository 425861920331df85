import difflib
import math
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pampero.functions.text import fold
from pampero.operators import evaluation as ev, relational as rel, stats as st
from pampero.operators.quality import QualityError, report, rows_where, unique_key, validate
from pampero.operators.resolve import name_tokens, one_target, resolve
from pampero.plans import pipeline as pl
from pampero.plans.reference import amount
from pampero.sources import bronze


def test_amounts(spark):
    df = spark.createDataFrame([("€70.00m",), ("€300k",), ("free",), ("Loan fee: €2.00m",), ("€1,250k",), ("€2.01m",), (None,), ("",)], "a string")
    assert [r[0] for r in df.select(amount(F.col("a"))).collect()] == [70_000_000, 300_000, None, 2_000_000, 1_250_000, 2_009_999, None, None]


def test_tokens_and_resolution(spark):
    names = [("1", "aut", "Red Bull Salzburg"), ("2", "ned", "Ajax Amsterdam"), ("3", "ukr", "Zorya Lugansk"), ("4", "ger", "Bayern Munich"), ("5", "aze", "Zira FC"), ("6", "ger", "Club (- 2025)"), ("7", None, "AFC Ajax"), ("8", "ita", "Inter Milan")]
    al = [("a", 1, "aut", "FC Salzburg"), ("b", 2, "ned", "AFC Ajax"), ("c", 3, "ukr", "FC Zorya Luhansk"), ("d", 4, "ger", "FC Bayern München"), ("e", 5, "mlt", "Gżira United"), ("f", 6, "ita", "FC Internazionale Milano"), ("f", 6, "ita", "Inter")]
    n = spark.createDataFrame([(i, b, fold(x)) for i, b, x in names], "id string, block string, n string").select("id", "block", name_tokens(F.col("n")).alias("tokens"))
    a = spark.createDataFrame([(i, p, b, fold(x)) for i, p, b, x in al], "destino string, pos int, block string, n string").select("destino", "pos", "block", name_tokens(F.col("n")).alias("tokens"))
    got = {r["id"]: (r["destino"], r["metodo"]) for r in resolve(n, a).collect()}
    assert got == {"1": ("a", "subconjunto"), "2": ("b", "subconjunto"), "3": ("c", "aproximado:0.92"), "4": ("d", "aproximado:0.89"), "5": (None, "sin_match"), "6": (None, "sin_nombre"), "7": ("b", "exacto"), "8": ("f", "subconjunto")}
    assert resolve(n, a.limit(0)).where("destino is not null").count() == 0
    dup = spark.createDataFrame([("1", "x", "exacto"), ("2", "x", "exacto"), ("3", None, "sin_match"), ("4", None, "sin_match")], "id string, destino string, metodo string")
    assert rows(one_target(dup, F.col("id"))) == [("1", "x", "exacto"), ("2", None, "duplicado:exacto"), ("3", None, "sin_match"), ("4", None, "sin_match")]


def test_bins_scores_and_effects(spark):
    df = spark.createDataFrame([(float(x), x % 2 == 0) for x in [20, 21, 50, 51, 1000, 1001]] + [(None, True)], "v double, t boolean")
    assert [r[0] for r in df.select(st.cut(F.col("v"), [20, 50, 100, 1000], ["a", "b", "c"])).collect()] == [None, "a", "a", "b", "c", None, None]
    z = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None), (None, 2.0)], "g string, v double")
    z = st.zscores(z, {"z": F.col("v")}, ["g"])
    assert [None if r["z"] is None else round(r["z"], 6) for r in z.orderBy("g", "v").collect()] == [None, -0.707107, 0.707107, None, None]
    assert df.agg(st.separation(F.col("v"), F.col("t"), 3)).first()[0] > 0 and df.agg(st.separation(F.col("v"), F.col("t"))).first()[0] is None
    assert df.limit(0).agg(st.separation(F.col("v"), F.col("t")), st.skew_corrected(F.col("v"))).first()[0] is None
    s = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 9.0)], "v double")
    assert rows(st.ranked(s, "v", "r"), "r") == [(1.0,), (2.5,), (2.5,), (4.0,)]
    p = s.select(st.percentile_of(F.array(*[F.lit(float(i)) for i in range(11)]), F.col("v")))
    assert [r[0] for r in p.collect()] == [10.0, 20.0, 20.0, 90.0]


def test_later_events_and_keep_one(spark):
    a = spark.createDataFrame([("p", 1), ("p", 3), ("q", 1), ("p", 1)], "k string, t int")
    b = spark.createDataFrame([("p", 2), ("p", 3), ("p", 3), ("r", 9)], "k string, t int")
    assert rows(rel.later_events(a, b, ["k"], "t"), "k", "t", "later") == [("p", 1, 3), ("p", 1, 3), ("p", 3, 0), ("q", 1, 0)]
    d = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), (None, 1, "c"), (None, 5, "d")], "k string, o int, v string")
    assert rows(rel.keep_one(d, ["k"], [F.col("o")]), "k", "v") == [("x", "b"), (None, "d")]
    assert rows(d.where(rel.not_in(F.col("k"), ["x"])), "v") == [("c",), ("d",)]


def test_confusion_arithmetic(spark):
    row = spark.createDataFrame([(63, 97, 89, 1233)], "tp int, fp int, fn int, tn int").select(*[m.alias(n) for n, m in ev.metrics().items()]).first()
    assert (round(row["precision"], 5), round(row["recall"], 5), round(row["accuracy"], 5)) == (0.39375, 0.41447, 0.87449)
    s = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.4), (False, 0.1)], "t boolean, s double")
    assert ev.roc_auc(ev.curve(s, "t", "s")).first()[0] == 0.625
    folds = spark.range(1000).select((F.col("id") % 50).alias("g"), ev.fold_of(F.col("id") % 50, 5).alias("f"))
    assert folds.groupBy("g").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    moved = ev.shifted_block(spark.range(200).withColumn("a", F.col("id") * 2).withColumn("b", F.col("id") * 3), "id", ["a", "b"])
    assert moved.where("a * 3 = b * 2").count() == 200 and moved.where("a <> id * 2").count() > 100


def test_gate_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("1", 20), ("1", 13), (None, 45)], "k string, edad int")
    checks = [unique_key("k"), rows_where("edad", ~F.col("edad").between(14, 45))]
    assert rows(report(df, checks)) == [("clave_unica:k", 1), ("edad", 1)]
    with pytest.raises(QualityError, match="edad: 1"):
        validate(df, checks)
    root, state = str(tmp_path / "out"), str(tmp_path / "state")
    good = spark.createDataFrame([("1", 20), ("2", 30)], "k string, edad int")
    go = lambda src, data=good, scope=pl.Scope(), day="2025-01-01": pl.run(spark, lambda _: data, src, scope, checks, root, state, day)
    assert go({"a": 1}) == "publicado" and go({"a": 1}) == "sin_cambios" and go({"a": 1}, scope=pl.Scope(force=True)) == "publicado"
    with pytest.raises(QualityError):
        go({"a": 2}, df)
    assert go({"a": 2}, day="2025-01-02") == "publicado"
    assert pl.latest_published(spark, root).count() == 2 and spark.read.parquet(root).count() == 4
    with pytest.raises(FileNotFoundError):
        pl.latest_published(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError):
        pl.Scope(top=561)
    assert pl.Scope.trial().labels(2025) == ["2025/2026"] and pl.fingerprint({"b": 1, "a": 2}, pl.Scope()) == "a=2|b=1|require_stats=False|seasons=5|top=200|year=2027"


def test_serving_and_readiness(spark, tmp_path):
    path, served, loads = str(tmp_path / "t"), pl.Served(spark), []
    load = lambda: (loads.append(1), spark.read.parquet(path))[1]
    spark.range(3).write.parquet(path)
    assert served.get("t", [path], load).count() == served.get("t", [path], load).count() == 3 and len(loads) == 1
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert served.get("t", [path], load).count() == 3 and len(loads) == 2
    asked = []
    probes = {"a": lambda: True, "b": lambda: asked.append(1) or len(asked) > 2, "c": lambda: 1 / 0}
    assert pl.ready(probes, 4) == {"a": True, "b": True, "c": False} and len(asked) == 3


def test_raw_layer(spark, tmp_path):
    root = str(tmp_path / "raw")
    pages = spark.createDataFrame([("1", 2024, "x"), ("1", 2025, "y"), ("2", 2025, None)], "club string, temporada int, html string")
    bronze.write_pages(pages, root, ["club", "temporada"])
    schema = "html string, club string, temporada int"
    back = bronze.read_pages(spark, root, schema, temporada=[2025])
    assert rows(back, "club", "html") == [("1", "y"), ("2", None)]
    assert "temporada" in back._jdf.queryExecution().executedPlan().toString()
    new = spark.createDataFrame([("1", 2024, "x"), ("1", 2025, "z"), ("3", 2025, "w")], "club string, temporada int, html string")
    assert rows(bronze.land(new, pages, ["club", "temporada"], "html"), "club", "html") == [("1", "z"), ("3", "w")]
    assert rows(bronze.land(new, pages, ["club", "temporada"], "html", F.col("temporada") < 2026), "club") == [("3",)]
    with open(os.path.join(root, "club=1", "temporada=2024", "broken.json.gz"), "wb") as f:
        f.write(b"not gzip")
    assert bronze.read_pages(spark, root, schema).count() == 3
    snaps = spark.createDataFrame([("2025-01-01", 1), ("desconocida", 2), (None, 3)], "d string, v int")
    assert rows(bronze.latest(snaps, "d"), "v") == [(1,)]
    assert bronze.first_readable(spark, [str(tmp_path / "no"), root], "json").count() >= 3


def test_tables_texts_and_last_files(spark, tmp_path):
    root = str(tmp_path / "texts")
    bronze.write_texts(spark.createDataFrame([("1", "a\nb"), ("2", "ñ"), ("3", "")], "club string, texto string"), root, ["club"])
    back = bronze.read_whole_texts(spark, f"{root}/club=*/*.gz").select(bronze.partition_value(F.col("ruta"), "club").alias("club"), "texto")
    assert rows(back.where("texto <> ''")) == [("1", "a\nb"), ("2", "ñ")]
    t = spark.createDataFrame([(1, 'x, "y"\nz', None), (2, "", 1.5)], "k int, s string, v double")
    bronze.write_table(t, str(tmp_path / "csv"), 1)
    bronze.write_table(t, str(tmp_path / "csv"), 1)
    assert rows(bronze.read_table(spark, str(tmp_path / "csv"), "k int, s string, v double"), "k", "v") == [(1, None), (2, 1.5)]
    assert bronze.read_table(spark, str(tmp_path / "csv")).where("k = '1'").first()["s"] == 'x, "y"\nz'
    pages = spark.createDataFrame([("p", "/a/2", "old"), ("p", "/b/1", "new"), ("q", "/a/1", "one")], "k string, _ruta string, v string")
    assert rows(bronze.last_of_key(pages, ["k"]), "k", "v") == [("p", "new"), ("q", "one")]
    raw = str(tmp_path / "raw")
    bronze.write_pages(spark.createDataFrame([("1", "x")], "club string, html string"), raw, ["club"])
    with open(os.path.join(raw, "club=1", "broken.json.gz"), "wb") as f:
        f.write(b"not gzip")
    assert [os.path.basename(r[0]) for r in bronze.unreadable(spark, raw, "html string").collect()] == ["broken.json.gz"]


def test_ranking_pages_and_members(spark):
    from pampero.sources.ranking import CLUB_FIELDS, association_rows, club_rows, parsed_rankings, ranking_rows

    row = '<tr><td>1</td><td class="zentriert hauptlink"><a title="{t}" href="/{s}/startseite/verein/{i}">{x}</a></td><td><img class="flaggenrahmen" title="Spain"></td></tr>'
    page = '<table class="items x"><thead><tr><td class="hauptlink"><a href="/h/verein/0">H</a></td></tr></thead><tbody>' + row.format(t="Alfa FC", s="alfa", i=7, x="Alfa") + row.format(t="Beta", s="beta", i=8, x="<img>") + row.format(t="", s="alfa", i=7, x="again") + '<tr><td class="hauptlink">no link</td></tr><tr><td class="hauptlink"><a href="/x/spieler/9">p</a></td></tr>' + row.format(t="", s="gama", i=9, x="Gama &amp; Co") + "</tbody></table>"
    want = [("7", "alfa", "Alfa", "Alfa FC", "Spain"), ("8", "beta", "Beta", "Beta", "Spain"), ("9", "gama", "Gama & Co", "Gama & Co", "Spain")]
    assert ranking_rows(page) == want and ranking_rows(None) == ranking_rows("") == ranking_rows("<table class='items'>") == []
    df = spark.createDataFrame([(1, page, "q"), (2, None, "q"), (3, page, "q")], "pagina bigint, html string, pos string")
    assert rows(parsed_rankings(df), "pagina", *CLUB_FIELDS) == sorted([(p, *w) for p in (1, 3) for w in want], key=str) and parsed_rankings(df.limit(0)).count() == 0
    raw = spark.createDataFrame([('{"miembros": [{"member": {"id": "5", "displayName": "A", "countryName": "", "countryCode": "ESP"}, "overallRanking": {"position": 1, "totalValue": 9.5, "trend": "UP"}}, {"member": {"id": "6", "countryName": "Italy"}}, {}]}',), ("{broken",), (None,)], "json string")
    assert rows(club_rows(raw), "uefa_club_id", "uefa_nombre", "uefa_ranking", "uefa_coeficiente") == [("5", "A", 1, 9.5), ("6", None, None, None), (None, None, None, None)]
    assert rows(association_rows(raw), "pais", "pais_codigo", "pais_ranking_uefa") == [("A", "ESP", 1), ("Italy", None, None), (None, None, None)]


def test_the_resolver_loses_nothing_that_the_ratio_allows(spark):
    import itertools
    import random

    from pampero.operators.resolve import common_run, grams

    r = random.Random(5)
    words = ["internazionale", "deportivo alaves", "sparta praha", "olympique lyonnais", "real"]
    base = {w for x in words for w in {x, *("".join(c for i, c in enumerate(x) if i != k) for k in range(len(x))), *(x[:k] + "qx"[k % 2] + x[k + 1 :] for k in range(len(x)))}}
    base = sorted(base, key=lambda _: r.random())[:70]
    for near in (0.82, 0.93):
        n = common_run(near)
        for a, b in itertools.combinations(base, 2):
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            if m.ratio() >= near:
                assert max(x.size for x in m.get_matching_blocks()) >= n, (a, b)
    names = spark.createDataFrame([(x, None, x.split()) for x in base], "id string, block string, tokens array<string>")
    aliases = spark.createDataFrame([(x, i, "z", x.split()) for i, x in enumerate(words)], "destino string, pos int, block string, tokens array<string>")
    got = {x["id"]: x["destino"] for x in resolve(names, aliases).collect()}
    for a in base:
        best = max((difflib.SequenceMatcher(None, a, w, autojunk=False).ratio(), -i, w) for i, w in enumerate(words))
        assert got[a] == (a if a in words else best[2] if best[0] >= 0.93 else None)
    g = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,)], "t string").select(grams(F.col("t"), 3))
    assert [x[0] for x in g.collect()] == [["abc", "bca", "cab"], ["ab"], [""], [None]]  # a null meets nothing in a join


def test_nearest_is_brute_force_with_few_comparisons(monkeypatch):
    import random

    from pampero.operators import resolve as rs

    r = random.Random(3)
    name = lambda: " ".join("".join(r.choice(["ba", "ke", "zo", "mi", "tur", "los", "gra", "pe", "a", "é", "日本", "x"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3)))
    a = sorted({name() for _ in range(120)} | {"", "a", "ab"})
    b = sorted({name() for _ in range(150)} | {"b", "a", "ba"} | {x[:-1] for x in a[:50] if len(x) > 1} | {f"{x}z" for x in a[50:80]})
    real, calls = difflib.SequenceMatcher, []
    ratios = [[real(None, x, y, autojunk=False).ratio() for y in b] for x in a]
    monkeypatch.setattr(rs.difflib, "SequenceMatcher", lambda *p, **k: calls.append(1) or real(*p, **k))
    for floor, most in ((0.5, 0.5), (0.82, 0.05), (0.93, 0.02), (1.0, 0.01)):
        want = [(i, j, q) for i, row in enumerate(ratios) if a[i] for j, q in enumerate(row) if q == max(row) and q >= floor]
        for slots in (256, 8):
            assert sorted(rs.nearest(a, b, floor, slots, 7)) == want
        calls.clear()
        rs.nearest(a, b, floor)
        assert len(calls) < most * len(a) * len(b)
    assert rs.nearest([], b, 0.8) == rs.nearest(a, [], 0.8) == []


@pytest.mark.parametrize(("module", "query", "stages"), [("reference", "resolve_exact", 1), ("surface", "resolve_two_stages", 2)])
def test_queries_of_the_first_stages_run_no_other(spark, monkeypatch, module, query, stages):
    import importlib

    from pampero.operators import resolve as rs

    asked = []
    module = importlib.import_module(f"pampero.plans.{module}")
    monkeypatch.setattr(module, "resolve", lambda *a, **k: asked.append(k.get("stages", rs.STAGES)) or rs.resolve(*a, **k))
    monkeypatch.setattr(rs, "nearest", None)
    monkeypatch.setattr(rs, "_approximate", None)
    names = spark.createDataFrame([("1", "x", ["alfa"]), ("2", "x", ["beta", "norte"]), ("3", "x", ["gamma"]), ("4", "w", ["alfa"])], "id string, block string, tokens array<string>")
    aliases = spark.createDataFrame([("a", 0, "x", ["alfa"]), ("b", 0, "x", ["beta"]), ("c", 0, "x", ["gama"])], "destino string, pos int, block string, tokens array<string>")
    monkeypatch.setattr(module, "_resolver", lambda *_: (names, aliases))
    assert [tuple(r)[:2] for r in getattr(module, query)(spark, "").orderBy("id").collect()] == [("1", "a"), ("2", "b")][:stages]
    assert asked == [rs.STAGES[:stages]]


def test_tiles_of_names_and_aliases_give_what_one_tile_gives(spark):
    from pampero.operators.resolve import _approximate

    words = ["alfamar", "alfamor", "betanor", "betanar", "gamelin", "gamalin", "deltori", "deltari"]
    left = spark.createDataFrame([(b, f"{w}x", b == "x") for w in words for b in ("x", None)], "block string, k string, known boolean")
    al = spark.createDataFrame([(b, w) for w in words for b in ("x", "y", None)], "ablock string, ak string")
    whole = rows(_approximate(left, al, 0.82, 0.93), "block", "k", "ak", "ratio")
    assert len(whole) == 16 and rows(_approximate(left, al, 0.82, 0.93, 3, 2).join(spark.createDataFrame([(w,) for w in words], "ak string"), "ak").where("k = concat(ak, 'x')"), "block", "k", "ak", "ratio") == whole


def test_names_are_made_in_one_pass_and_folded_once(spark, tmp_path, monkeypatch):
    from pampero.plans import reference, surface

    d = str(tmp_path)
    rows_ = [("1", "B", None, "o2"), ("1", "A", "Spain", "o3"), ("1", None, "Aland", "o1"), ("2", None, "Spain", "o4"), (None, "C", "Spain", "o5"), *[("3", "Çelta", "Italy", f"o{i}") for i in range(6, 40)]]
    spark.createDataFrame(rows_, "club_origen_id string, club_origen string, club_origen_pais string, operacion_id string").write.parquet(f"{d}/plata.parquet")
    form = ", ".join(f"{c} string" for c in ("uefa_pais", "uefa_club_id", "uefa_nombre", "uefa_nombre_oficial", "uefa_nombre_internacional", "uefa_nombre_corto"))
    spark.createDataFrame([("Italy", " 9 ", "Celta", None, "CELTA", None)], form).selectExpr("*", "1 uefa_ranking").write.parquet(f"{d}/uefa.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    seen = []
    monkeypatch.setattr(surface, "catalogue", lambda sources, *_: seen.append(sources) or (sources, sources))
    surface._catalogue(spark, d)
    assert plan(seen[0]).count("Relation [") == 1  # names, other names and order in one pass
    assert rows(seen[0].select("id", "orden", "block", F.array_join("tokens", " "), F.array_join("otros_tokens", " "))) == [("1", "o1", "spain", "a", "b"), ("3", "o10", "italy", "celta", "celta")]
    monkeypatch.setattr(reference, "resolve", lambda names, aliases: seen.extend([names, aliases]) or resolve(names, aliases))
    assert rows(reference.resolve_cascade(spark, d)) == [("1", None, "sin_match"), ("3", "9", "exacto")]
    assert not any("_fold" in plan(df.where("block > ''")) for df in seen[1:])  # a filter above would fold once more


def test_the_catalogue_and_the_resolver_read_their_sources_once(spark):
    from pampero.operators.resolve import catalogue

    seen = spark.sparkContext.accumulator(0)
    once = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    al = spark.createDataFrame([("a", 1, "x", ["alfa"]), ("b", 2, "x", ["beta"])], "destino string, pos int, block string, tokens array<string>")
    src = spark.createDataFrame([("1", 1, "x", ["alfa"], ["otro"]), ("2", 2, "x", ["zzz"], ["beta"]), ("3", 3, "x", ["qqq"], ["www"])], "id string, orden int, block string, tokens array<string>, otros_tokens array<string>")
    cat, rest = catalogue(src.withColumn("block", once("block")), al, spark.createDataFrame([("a", 3), ("b", 2)], "destino string, puesto int"))
    assert rows(cat, "id") == [("1",), ("2",)] and rows(rest) == [("3", "sin_match")] and seen.value == 3
    names = src.select("id", "block", "tokens").withColumn("block", once("block"))
    assert rows(resolve(names, al), "id", "destino") == [("1", "a"), ("2", None), ("3", None)] and seen.value == 6


def test_catalogue_and_homonyms(spark):
    from pampero.operators.resolve import catalogue, match_coverage, pick_homonym

    al = spark.createDataFrame([("a", 1, "x", ["alfa"]), ("b", 2, "x", ["beta", "norte"]), ("c", 3, "x", ["gama"])], "destino string, pos int, block string, tokens array<string>")
    src = spark.createDataFrame([("1", 1, "x", ["alfa"], ["otro"]), ("1", 9, "x", ["gama"], ["gama"]), ("2", 2, "x", ["zzz"], ["beta", "norte"]), ("3", 3, "x", ["alfa"], []), ("4", 4, "x", ["qqq"], ["www"]), ("5", 5, "x", ["gama"], [])], "id string, orden int, block string, tokens array<string>, otros_tokens array<string>")
    ranks = spark.createDataFrame([("a", 30), ("b", 2), ("c", None)], "destino string, puesto int")
    cat, rest = catalogue(src, al, ranks)
    assert [tuple(x) for x in cat.select("id", "destino", "metodo", "lugar").collect()] == [("2", "b", "exacto", 2), ("1", "a", "exacto", 30), ("5", "c", "exacto", 10_000)]
    assert rows(rest) == [("3", "duplicado:exacto"), ("4", "sin_match")]
    assert rows(catalogue(src, al, ranks, 10)[0], "id") == [("2",)] and tuple(match_coverage(cat, rest).first()) == (3, 1, 0.75)
    c = spark.createDataFrame([("p", "x", ["a"], ["b"], ["c"], 9.0, 0), ("p", "y", ["b", "z"], ["b"], ["c"], 1.0, 1), ("q", "x", None, ["b"], None, None, 0), ("r", "x", [], ["b"], ["c"], 1.0, 0), ("r", "y", ["k"], [], ["c"], 1.0, 1), ("s", "x", ["c"], ["b"], ["c"], 0.0, 0), ("s", "y", ["k"], ["b"], ["c"], 5.0, 1)], "g string, candidato string, equipo array<string>, destino array<string>, origen array<string>, puntos_fuente double, pos int")
    assert rows(pick_homonym(c, ["g"])) == [("p", "y", "club_destino", 2), ("q", "x", "unica_sugerencia", 1), ("r", "x", "primera_sugerencia", 2), ("s", "x", "club_origen", 2)]


def test_exact_quantiles_and_running_totals(spark):
    import numpy as np

    r = np.random.default_rng(1)
    data = [(g, float(v)) for g, n in (("a", 3000), (None, 40), ("b", 1), ("c", 2)) for v in np.round(r.exponential(20, n), 1)] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    at = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = {(x["g"], x["q"]): x["valor"] for x in st.quantiles(df, ["g"], F.col("v"), at).collect()}
    for g in ("a", None, "b", "c"):
        x = [v for k, v in data if k == g and v is not None and v == v]
        for q in at:
            assert got[g, q] == pytest.approx(np.quantile(x, q))
    assert st.quantiles(df.limit(0), ["g"], F.col("v"), at).count() == 0 and st.quantiles(df.limit(0), [], F.col("v"), at).count() == 0
    n = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.lit(1).alias("c"))
    assert n.count() == st.running(n, ["g"], [F.desc("id")], ["c"]).where("upto_c = cast((499 - id) / 3 as int) + 1").count()
    bins = st.quantile_bins(df, "v", ["x", "y", "z"], "t")
    assert bins.where("v is null or isnan(v)").where("t is not null").count() == 0 and bins.where("t is null").count() == 2
    assert st.quantile_bins(df.limit(0), "v", ["x", "y"], "t").count() == 0


def test_shuffles_folds_and_gate_checks(spark):
    from pampero.operators import quality as ql

    df = spark.range(400).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"), (F.col("id") % 10 == 0).alias("t"))
    one, same, other = (sorted(map(tuple, ev.permuted_block(df, "id", ["a", "b"], s).collect())) for s in ("1", "1", "2"))
    assert one == same != other and all(x[1] * 3 == x[2] * 2 for x in one) and sorted(x[1] for x in one) == [2 * i for i in range(400)]
    per = ev.stratified_rows(df, "id", F.col("t"), 4).groupBy("fold").agg(F.count_if("t").alias("p"), F.count("*").alias("n")).collect()
    assert len(per) == 4 and all(5 <= x["p"] <= 15 and 80 <= x["n"] <= 120 for x in per)
    t = spark.createDataFrame([("x", 5, True, None), ("y", None, None, None)], "k string, r int, f boolean, e string")
    checks = [*ql.empty_columns(["k", "e"]), ql.columns_at_least(t, 6), ql.missing_columns(t, ["k", "zz"]), ql.unmapped("mapa", F.col("k"), {"x": 1}), ql.same_flag("bandera", F.col("f"), F.col("r") <= 3)]
    assert dict(rows(report(t, checks))) == {"columna_vacia:k": 0, "columna_vacia:e": 1, "columnas_minimas": 2, "columnas_que_faltan": 1, "mapa": 1, "bandera": 1}


def _values(cells):
    return tuple(None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.6g}") if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v for v in cells)


def test_every_query_equals_its_sql(spark):
    """Rows, columns and values of all queries of the core beside their SQL."""
    import duckdb
    from collections import Counter

    from pampero.plans import catalogue

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    for p in os.listdir(d):
        con.sql(f"create view {p[:-8]} as select * from '{d}/{p}'")
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.SQL) > 100
    for name, sql in catalogue.SQL.items():
        df, want = catalogue.QUERIES[name](spark, d), con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        there = [want.columns.index(c) for c in cols]
        got = Counter(_values(r[c] for c in cols) for r in df.collect())
        assert got == Counter(_values(r[i] for i in there) for r in want.fetchall()), name


def test_core_stands_without_the_llm_subpackage():
    import pampero

    root = os.path.dirname(pampero.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "pampero.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f


def test_the_catalogue_prepares_aliases_once_and_asks_again_only_for_other_tokens(spark, monkeypatch):
    from pampero.operators import resolve as rs

    al = spark.createDataFrame([("a", 1, "x", ["alfa"]), ("b", 2, "x", ["beta", "norte"]), ("c", 3, "x", ["beta", "sur"])], "destino string, pos int, block string, tokens array<string>")
    src = spark.createDataFrame([("1", 1, "x", ["alfa"], ["otro"]), ("2", 2, "x", ["zzz"], ["zzz"]), ("3", 3, "x", ["qqq"], ["norte", "beta"]), ("4", 4, "x", [], []), ("5", 5, "x", ["www"], None), ("6", 6, "x", ["vvv"], ["uuu"]), ("7", 7, "x", [], ["beta", "sur"])], "id string, orden int, block string, tokens array<string>, otros_tokens array<string>")
    made, run = {}, rs.written
    monkeypatch.setattr(rs, "written", lambda df, name: made.setdefault(name, []).append(run(df, name)) or made[name][-1])
    cat, rest = rs.catalogue(src, al, spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "destino string, puesto int"))
    assert rows(cat, "id", "destino", "metodo") == [("1", "a", "exacto"), ("3", "b", "subconjunto"), ("7", "c", "exacto")]
    assert rows(rest) == [("2", "sin_match"), ("4", "sin_nombre"), ("5", "sin_match"), ("6", "sin_match")]
    assert len(made["resolve-aliases"]) == 1 and [rows(df, "id") for df in made["resolve-names"]] == [[(str(i),) for i in range(1, 8)], [("3",), ("5",), ("6",), ("7",)]]

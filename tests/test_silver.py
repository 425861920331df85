import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from conftest import rows
from pampero.functions.text import plain_digits
from pampero.operators.nested import as_json, flat_table, occurrences, stored, within_elements
from pampero.operators.quality import report
from pampero.operators.stats import modes
from pampero.plans.datasets import ARRAY_KEYS
from pampero.plans.reference import silver_checks
from pampero.plans.silver import gate, operation

D = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver") / "t")
    __spark_entry__.queries()["silver"](spark, D).write.parquet(path)
    return spark.read.parquet(path)


def test_written_fees(spark):
    texts = ["€12.50m", "€300k", "Loan fee: €1.20m", "End of loan 30/06/2024", "loan transfer", "Free transfer", "?", "-", None]
    euros, kind = operation(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", euros.alias("e"), kind.alias("k")).orderBy("i").select("e", "k").collect()]
    assert got == [(12_500_000, "compra"), (300_000, "compra"), (1_200_000, "cesion_con_cargo"), (None, "fin_de_cesion"), (None, "cesion"), (None, "libre"), *[(None, "desconocido")] * 3]


def test_the_gate_applies_and_history_means_metrics(silver):
    got = {r["control"]: r["violaciones"] for r in report(silver, silver_checks()).collect()}
    # a profile may have other metrics than the five the gate looks at
    others = silver.where("tiene_historial and not arrays_overlap(map_keys(metricas), array('stat_minutes', 'stat_minutes_played', 'stat_matches', 'stat_goals', 'stat_assists', 'stat_rating'))").count()
    assert got.pop("historial_sin_metricas") == others and set(got.values()) == {0}
    assert silver.where("tiene_historial <> (coalesce(size(metricas), 0) > 0)").count() == 0


def test_the_gate_of_target_columns_and_history(silver):
    known = silver.where("tiene_historial").count() > 0  # players are tied by a subpackage that may be absent
    wanted = ["operacion_id", "club_destino", *(["stat_goals"] if known else [])]
    got = {r["control"]: r["violaciones"] for r in report(silver, gate(wanted)).collect()}
    assert {k: v for k, v in got.items() if k != "destino_sin_ranking"} == dict.fromkeys([k for k in got if k != "destino_sin_ranking"], 0)
    assert got["destino_sin_ranking"] == silver.where("club_destino_ranking_uefa is null").count()
    broken = {r["control"]: r["violaciones"] for r in report(silver.withColumn("es_destino_top_20", F.lit(True)).withColumn("stat_goals", F.lit(None)), gate(["stat_goals"])).collect()}
    assert broken["objetivo_sigue_al_ranking"] > 0 and broken["columna_vacia:stat_goals"] == 1
    eu = silver.where("club_origen_es_europeo").select("club_origen_pais").distinct().count()
    assert 0 < eu < silver.select("club_origen_pais").distinct().count() and dict(silver.dtypes)["salto_ranking_uefa"] == "int"


def test_arrival_rows_have_all_fields(spark):
    got = __spark_entry__.queries()["arrival_rows"](spark, "/root/testdata/sf0.001")
    assert {"club_origen_slug", "club_destino_id", "temporada", "tipo_operacion", "coste_fichaje_eur", "club_origen_es_filial", "club_origen_liga_es_top5"} <= set(got.columns)
    assert got.where("club_origen_slug is not null and club_destino_id is not null").count() > 0


def test_pair_columns_follow_from_both_clubs(silver):
    n = silver.agg(
        F.count_if(F.expr("club_destino_ranking_uefa is not null")).alias("destino"), F.count_if(F.expr("es_destino_top_20")).alias("top"), F.count_if(F.expr("traspaso_domestico")).alias("casa"), F.count_if(F.expr("tiene_historial")).alias("historial"), F.count_if(F.expr("salto_ranking_uefa is not null")).alias("salto"),
        F.count_if(F.expr("not (es_destino_top_20 <=> coalesce(club_destino_ranking_uefa <= 20, false))")).alias("mal_top"), F.count_if(F.expr("not (salto_ranking_uefa <=> (club_origen_ranking_uefa - club_destino_ranking_uefa))")).alias("mal_salto"), F.count_if(F.expr("not (sube_de_categoria <=> (salto_ranking_uefa > 0))")).alias("mal_sube"),
        F.count_if(F.expr("club_origen_es_filial and club_origen_ranking_uefa is not null")).alias("mal_filial"),
    ).first()
    assert min(n["destino"], n["top"], n["casa"], n["salto"]) > 0 and (n["historial"] > 0) == (silver.where("jugador_fotmob_id is not null").count() > 0)
    assert n["mal_top"] == n["mal_salto"] == n["mal_sube"] == n["mal_filial"] == 0


def test_destination_is_the_club_of_the_history(spark, silver):
    p = spark.read.parquet(f"{D}/plata.parquet").select(plain_digits(F.col("operacion_id")).alias("operacion_id"), F.col("es_destino_top_20").alias("dicho"), F.col("club_destino_pais").alias("pais")).where("dicho is not null").dropDuplicates(["operacion_id"])
    both = silver.join(p, "operacion_id")
    assert both.count() > 1000 and both.where("club_destino_pais <> pais").count() == 0


def test_the_detail_stands_before_the_summary(spark, tmp_path):
    import json

    from pampero.plans.silver import player_metrics

    block = lambda *kv: {"items": [{"title": k, "statValue": v} for k, v in kv]}
    doc = [{"seasonName": "2024/2025", "tournaments": [{"name": "L", "topStatCards": block(("Goals", 3), ("Rating", "7.1"), ("Bad", "x")), "statsSection": {"items": [{"title": "A", **block(("Goals", 4))}]}}, {"name": "C", "topStatCard": block(("Goals", 2), ("Rating", 6.1))}]}]
    spark.createDataFrame([(1, "9", json.dumps(doc), "2025-01-01"), (2, "9", "[]", "2024-01-01")], "registro_id bigint, jugador_fotmob_id string, statseasons string, t string").selectExpr("*", "cast(t as timestamp) extraido_el").write.parquet(str(tmp_path / "fotmob.parquet"))
    got = {r["metrica"]: r["valor"] for r in player_metrics(spark, str(tmp_path)).collect()}
    assert got == {"stat_goals": 6.0, "stat_rating": 6.6}


def test_usual_rows_are_read_whole_and_as_by_their_tags(monkeypatch):
    import glob
    import random

    import pyarrow.parquet as pq

    from pampero.sources import arrivals_html as ah

    row = """<tr class="odd">\n <td>#</td>\n <td><table class="inline-table"><tr><td class="hauptlink"><a title="Åge Ro" href="/age-ro/profil/spieler/26">x</a></td></tr>\n<tr><td>Right  Back</td></tr></table></td>\n <td>38</td>
 <td><img class="flaggenrahmen" title="Chad"></td>\n <td><table><tr><td class="hauptlink"><a title="Olimpia" href="/olim/startseite/verein/20">y</a></td></tr></table></td>\n <td><a href="/x/transfers/spieler/26/transfer_id/31">Free\n transfer</a></td>\n</tr>\n"""
    page = f'<div class="box"><h2>Arrivals</h2><table><tbody>{row * 2}</tbody></table></div>'
    parts = ["<", ">", "&amp;", "%2F", "'", '"', "=", " ", "<td>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "</div>", "<!--", "/profil/spieler/7", "/spieler/8", "/verein/9", "/wettbewerb/GB1", "/transfer_id/5", 'title=""', "flaggenrahmen"]
    draw = random.Random(5)
    pages = [page, page.replace("box", "other"), page.replace('title="Åge Ro"', 'title=""'), page.replace("<tr ", "<tr"), page.replace("td class", "tdclass"), row, *(x for f in glob.glob(f"{D}/bronce.parquet") for x in pq.read_table(f, columns=["html"])["html"].to_pylist())]
    for _ in range(6000):
        i, j = sorted(draw.randrange(len(page)) for _ in range(2))
        pages.append(draw.choice([page[:i] + draw.choice(parts) + page[i:], page[:i] + page[min(j, i + draw.randrange(12)) :], page.replace(*draw.sample(parts[:15], 2)), page[:i] + draw.choice(parts) + page[i:j] + draw.choice(parts) + page[j:]]))
    got = [ah.arrivals(p) for p in pages]
    assert got[0] == [("Åge Ro", "26", "Right Back", 38, "Chad", None, "Olimpia", "20", "olim", None, None, None, "Free transfer", "31")] * 2
    with monkeypatch.context() as m:
        m.setattr(ah, "_row", None)  # the source's own layout needs no look at single tags
        assert ah.arrivals(page) == got[0]
    monkeypatch.setattr(ah, "_usual", lambda _: None)
    assert [ah.arrivals(p) for p in pages] == got


def test_modes_of_counted_rows_are_those_of_all_rows(spark):
    data = [(i % 7, x, y) for i, (x, y) in enumerate([("b", 2), ("a", 2), (None, 1), ("b", None), ("a", 1), ("c", None), (None, None)] * 9 + [("z", 5)] * 40 + [(None, None), ("å", 3)])] + [(99, None, None), (98, "q", None), (97, "m", 1), (97, "l", 1)]
    df = spark.createDataFrame(data, "k int, x string, y int").withColumn("s", F.when(F.col("y").isNotNull(), F.struct("x", "y")))
    want = df.groupBy("k").agg(*[F.mode(c, True).alias(c) for c in ("x", "y", "s")])
    got = modes(df.groupBy("k", "x", "y", "s").agg(F.count("*").alias("n")), ["k"], ["x", "y", "s"])
    assert rows(got) == rows(want) and got.columns == want.columns


def test_items_of_a_season_are_those_of_the_bridge(spark):
    texts = [
        '[{"seasonName":"2023/2024","tournaments":[{"items":[{"title":"Goals","statValue":"3"},null,{"title":"x","statValue":{"a":1}}],"d":{"items":{"title":"Goals","statValue":"4"}}}]},null,{"seasonName":2022,"tournaments":"[{\\"items\\":[{\\"title\\":\\"Goals\\",\\"statValue\\":1.5}]}]"}]',
        '{"seasonName":"2021","items":[{"title":"one"}]}', '"[{\\"seasonName\\":\\"text\\",\\"items\\":{\\"title\\":\\"t\\"}}]"', '[[{"seasonName":"deep","items":[{"title":"lost"}]}]]', '[{"seasonName":"none"}]', "3", "{broken", " ", None,
    ]
    df = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], "r bigint, p string, j string")
    bridge, store = stored(occurrences(df, "t", F.col("r"), {"j": "statSeasons"}, ARRAY_KEYS))
    top = flat_table(bridge, store, F.col("clave") == "statSeasons", {"season": "seasonName"}).select("registro", F.col("ruta").alias("s"), "season")
    items = flat_table(bridge, store, F.col("clave") == "items", {"title": "title", "value": "statValue"})
    want = items.withColumn("s", F.regexp_extract("ruta", r"^(statSeasons/\d+)", 1)).join(top, ["registro", "s"]).select("registro", "s", "season", "ruta", "title", "value")
    got = within_elements(df, ["r", "p"], "j", "statSeasons", "items", ARRAY_KEYS)
    json = lambda c, k: F.get_json_object(as_json(F.col(c)), f"$.{k}")
    got = got.select("*", F.explode("dentro").alias("x")).select("r", F.col("elemento").alias("s"), json("contenido", "seasonName").alias("season"), "x.ruta", json("x.contenido", "title").alias("title"), json("x.contenido", "statValue").alias("value"))
    assert rows(got) == rows(want) and got.count() == 6


def test_silver_counts_before_it_takes_modes_and_makes_no_bridge(spark, monkeypatch):
    pytest.importorskip("pampero.llm.queries")
    from pampero.llm import matching, queries
    from pampero.operators import nested, resolve
    from pampero.plans import silver as plan

    seen, run = {}, plan.written
    for module in (queries, matching, nested, resolve, plan):
        monkeypatch.setattr(module, "written", lambda df, name: seen.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and run(df, name))
    __spark_entry__.queries()["silver"](spark, D)
    assert "mt-people" in seen and not any(" mode(" in p for p in seen.values())
    assert not any(name.startswith("nested") for name in seen)

import os

import pytest

from conftest import rows
from pampero.sources.arrivals_html import arrivals
from pampero.streaming.compactor import compact_arrivals, published

ROW = '<tr class="odd">\n <td>#</td>\n <td><table class="inline-table"><tr><td class="hauptlink"><a title="Ana B" href="/a/profil/spieler/{p}">Ana B</a></td></tr>\n<tr><td>Left Winger</td></tr></table></td>\n <td>28</td>\n <td><img class="flaggenrahmen" title="Colombia"></td>\n <td><table><tr><td class="hauptlink"><a title="Alfa" href="/x/startseite/verein/31">Alfa</a></td></tr></table></td>\n <td><a href="{h}">€1.00m</a></td>\n</tr>'


def row(op, link="/x/transfers/spieler/1/transfer_id/{}"):
    return ROW.format(p=op, h=link.format(op))


def page(*body, title="Arrivals", end="</tbody></table></div>"):
    return f'<div class="box"><h2>{title}</h2><table><tbody>{"".join(body)}{end}'


def ops(p):
    return [r[-1] for r in arrivals(p)]


def test_rows_that_count_and_rows_that_do_not():
    assert ops(page(row(1), row(2))) == ["1", "2"]
    assert ops(page(row(1), title=" arrivals 24/25 ")) == ["1"]
    assert ops(page(row(1), title="Departures")) == []
    assert ops(page(row(1)) + page(row(2), title="Departures")) == ["1"]
    assert ops(page(row(1), "<!-- " + row(2) + " -->", row(3))) == ["1", "3"]
    assert ops(page(row(1), row(2)[:-5], end="")) == ["1"]
    assert ops(page(row(1), row(2)[:-5], row(3))) == ["1", "3"]
    assert ops(page(row(1), "<!-- " + row(2), end="")) == ["1"]
    assert ops(page(row(5, "/x/transfer&#95;id/{}"), row(6).replace('"', "'"), row(7).replace("td>", "TD>"))) == ["5", "6", "7"]
    assert ops(None) == ops("") == ops("<html>503</html>") == ops(page()) == []


def test_fields():
    r = dict(zip(["jugador_nombre", "jugador_tm_id", "posicion_tm", "edad_al_fichaje", "nacionalidad"], arrivals(page(row(9)))[0]))
    assert r == {"jugador_nombre": "Ana B", "jugador_tm_id": "9", "posicion_tm": "Left Winger", "edad_al_fichaje": 28, "nacionalidad": "Colombia"}


def test_incremental_runs_replace_and_never_duplicate(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    schema = "archivo_id bigint, html string, extra string"
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
    put([(5, page(row(1), row(2)), "a"), (6, None, "a"), (7, "", "a"), (None, page(row(1)), "a")])
    put([(3, page(row(2), row(2)), "a")])
    got = compact_arrivals(spark, src, home, files_per_batch=1)
    assert rows(got, "operacion_id", "archivo_id") == [("1", 5), ("2", 3)]
    assert len(os.listdir(home + "/staged")) >= 2
    put([(1, page(row(1), row(4)), "a")])
    got = compact_arrivals(spark, src, home, files_per_batch=1)
    assert rows(got, "operacion_id", "archivo_id") == [("1", 1), ("2", 3), ("4", 1)]
    version = published(spark, home).version
    again = compact_arrivals(spark, src, home)
    assert rows(again, "operacion_id") == [("1",), ("2",), ("4",)]
    assert len([f for f in again.inputFiles()]) == 1
    assert published(spark, home).version == version  # nothing new, nothing published


def test_files_with_an_old_time_are_taken(spark, tmp_path):
    src, home = tmp_path / "in", str(tmp_path / "home")
    src.mkdir()
    put = lambda name, data: spark.createDataFrame(data, "archivo_id bigint, html string").toPandas().to_parquet(src / name)
    put("new.parquet", [(5, page(row(1)))])
    assert compact_arrivals(spark, str(src), home).count() == 1
    put("late.parquet", [(2, page(row(1), row(2)))])
    os.utime(src / "late.parquet", (1_000_000_000, 1_000_000_000))
    assert rows(compact_arrivals(spark, str(src), home), "operacion_id", "archivo_id") == [("1", 2), ("2", 2)]


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    put = lambda data: spark.createDataFrame(data, "archivo_id bigint, html string").coalesce(1).write.mode("append").parquet(src)
    put([(i, page(*(row(i * 100 + k) for k in range(40)))) for i in range(1, 201)])
    first = compact_arrivals(spark, src, home, target_bytes=20_000)
    one = published(spark, home)
    assert one.buckets > 3 and len(one.parts) <= one.buckets and first.count() == 8_000
    put([(999, page(row(99_999)))])
    assert compact_arrivals(spark, src, home, target_bytes=20_000).count() == 8_001
    two = published(spark, home)
    assert two.buckets == one.buckets and sum(two.parts[k] != one.parts.get(k) for k in two.parts) == 1
    assert first.count() == 8_000  # the version before can still be read
    put([(1000, page(row(99_998)))])
    assert compact_arrivals(spark, src, home, target_bytes=20_000).count() == 8_002
    assert sorted(os.listdir(home + "/current")) == ["0000000002", "0000000003"]
    # a batch that runs again replaces itself: the staged copy of the last is all there is
    assert len(os.listdir(home + "/staged")) == 1


def test_growth_lays_all_buckets_anew(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    put = lambda a, b: spark.createDataFrame([(i, page(*(row(i * 100 + k) for k in range(20)))) for i in range(a, b)], "archivo_id bigint, html string").coalesce(1).write.mode("append").parquet(src)
    put(1, 30)
    compact_arrivals(spark, src, home, target_bytes=10_000)
    small = published(spark, home).buckets
    put(30, 400)
    got = compact_arrivals(spark, src, home, target_bytes=10_000)
    assert published(spark, home).buckets > 2 * small and got.count() == got.select("operacion_id").distinct().count() == 399 * 20


def test_a_run_broken_off_before_its_version_is_named(spark, tmp_path, monkeypatch):
    from pampero.streaming import compactor as c

    src, home = str(tmp_path / "in"), str(tmp_path / "home")
    put = lambda data: spark.createDataFrame(data, "archivo_id bigint, html string").coalesce(1).write.mode("append").parquet(src)
    put([(5, page(row(1)))])
    compact_arrivals(spark, src, home)
    put([(3, page(row(1), row(2)))])
    with monkeypatch.context() as m:
        m.setattr(c, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            compact_arrivals(spark, src, home)
    assert published(spark, home).version == 1
    assert rows(compact_arrivals(spark, src, home), "operacion_id", "archivo_id") == [("1", 3), ("2", 3)]


def test_empty_source(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], "archivo_id bigint, html string").write.parquet(src)
    assert compact_arrivals(spark, src, str(tmp_path / "home")).count() == 0

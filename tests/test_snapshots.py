from pyspark.sql import functions as F

from conftest import rows
from pampero.functions.text import composed, plain_date, plain_digits
from pampero.operators.snapshots import snapshot_changes

SCHEMA = "fila_id bigint, s string, k string, v int, n string, t string, snapshot string, key string, _k string"


def changes(spark, data):
    df = spark.createDataFrame([(*r, "x", None, "y") for r in data], SCHEMA)
    return snapshot_changes(df, plain_date(F.col("s")), plain_digits(F.col("k")), [F.col("t"), F.col("fila_id")], {"v": F.col("v"), "n": F.col("n")}, {"n": composed})


def test_changes_with_spellings_late_rows_nulls_and_clashing_columns(spark):
    data = [
        (1, "2025-01-01", "007", 1, "Añ o", "1"), (2, "01/01/2025", "8.0", 2, "b", "1"), (3, "2025-01-01T04:00:00Z", " 9 ", None, "c", "1"),
        (4, "2025-02-01", "7", 1, "Añ o ", "1"), (5, "2025-02-01", "9", 3, "c", "1"), (6, "2025-02-01", "9", None, "c", "2"), (7, "2025-02-01", "10", 1, None, None),
        (8, "desconocida", "7", 5, "z", "9"), (9, "2025-02-01", None, 5, "z", "9"), (10, None, "7", 5, "z", "9"),
        (11, "2025-03-01", "7", 2, "Año", "1"), (11, "2025-03-01", "7", 2, "Año", "1"), (12, "2025-03-01", "10", 1, "", None),
    ]
    got = rows(changes(spark, data).select(F.date_format("snapshot", "MM").alias("m"), "key", "change"))
    assert got == [("02", "10", "alta"), ("02", "8", "baja"), ("03", "10", "cambio"), ("03", "7", "cambio"), ("03", "9", "baja")]


def test_one_snapshot_or_none_gives_nothing(spark):
    assert rows(changes(spark, [(1, "2025-01-01", "7", 1, "a", "1")])) == []
    assert rows(changes(spark, [])) == []


def test_ids_and_dates(spark):
    df = spark.createDataFrame([("spieler/100016",), (" 0012.0 ",), ("x",), (None,), ("0",), ("1 2",)], "a string")
    got = [r[0] for r in df.select(plain_digits(F.col("a"))).collect()]
    assert got[:4] == ["100016", "12", None, None]
    days = spark.createDataFrame([("2025-13-01",), ("31/12/2024",), ("20241231",), ("",)], "a string")
    assert [str(r[0]) for r in days.select(plain_date(F.col("a"))).collect()] == ["None", "2024-12-31", "2024-12-31", "None"]


def test_scratch_is_shared_and_can_be_cleared(spark, tmp_path):
    import os

    from pampero import session

    df = session.written(spark.range(3), "probe")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert df.count() == 3 and any(f.startswith("probe-") for f in os.listdir(folder))
    mine = spark.sparkContext.__dict__["_pampero_scratch"]
    spark.sparkContext.__dict__["_pampero_scratch"] = mine[-1:]
    assert session.clear_scratch(spark) == 1 and not any(f.startswith("probe-") for f in os.listdir(folder))
    assert session.path_bytes(spark, str(tmp_path / "no")) == 0

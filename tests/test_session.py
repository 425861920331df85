import os

from pampero.session import clear_scratch, forget, written


def test_tables_that_nothing_reads_again_are_deleted(spark):
    a, b = written(spark.range(5).toDF("x"), "one"), written(spark.range(3).toDF("x"), "two")
    pa, pb = (df._pampero_path.removeprefix("file:") for df in (a, b))
    forget(a, spark.range(2))
    assert not os.path.exists(pa) and b.count() == 3
    forget(a)
    assert clear_scratch(spark) >= 1 and not os.path.exists(pb)

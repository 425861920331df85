"""python measures/imputation.py [FOLDER]: held-out accuracy of the imputation beside simple baselines.

Cells are split by a hash of the operation: tenth 0 is for choosing the setting, tenths 1, 2 and 3
for reporting, and no cell serves both. Each run hides one tenth of one field's known cells, fills
the table and compares. The setting with the least mean error on the choosing cells, each field
measured against its baseline, is reported with the spread over the three reporting tenths. The
baselines are learnt on the cells that stay: the median by role and the overall one for numbers,
the most frequent role for roles.
"""

from __future__ import annotations

import os
import statistics
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, functions as F

from pampero.operators.imputation import ROLES, impute, model_plan
from pampero.session import table, written

SETTINGS = [{"rank": 4, "ridge": 2.0}, {"rank": 6, "ridge": 6.0}, {"rank": 8, "ridge": 2.0}, {"rank": 10, "ridge": 6.0}]
FIELDS = ["stat_goals", "grupo_posicion", "edad_al_fichaje"]


def usable(field: str):
    if field == "grupo_posicion":
        return F.col(field).isin(ROLES)
    v = F.col(field).try_cast("double")
    return F.coalesce(v.between(14, 45) if field == "edad_al_fichaje" else (v >= 0) & (v == F.floor(v)) & ~F.isnan(v), F.lit(False))


def error(field: str, truth: DataFrame, guess: str) -> float:
    off = (F.col(guess) != F.col("_truth")).cast("double") if field == "grupo_posicion" else F.abs(F.col(guess).cast("double") - F.col("_truth"))
    return truth.agg(F.avg(off)).first()[0]


def run(df: DataFrame, field: str, tenth: int, setting: dict) -> tuple[float, float, float]:
    """Error of the imputation, of the overall baseline and of the baseline by role."""
    hide = usable(field) & (F.pmod(F.xxhash64(F.lit(field), "operacion_id"), F.lit(10)) == tenth)
    marked = written(df.withColumn("_hide", hide).withColumn("_truth", F.when(hide, F.col(field))), "measure")
    rest = marked.withColumn(field, F.when(~F.col("_hide"), F.col(field)))
    known = rest.where(usable(field))
    if field == "grupo_posicion":
        overall = known.agg(F.mode(field)).first()[0]
        by_role = None
    else:
        overall = known.agg(F.percentile(field, F.lit(0.5))).first()[0]
        by_role = known.groupBy(F.col("grupo_posicion").alias("_g")).agg(F.percentile(field, F.lit(0.5)).alias("_m"))
    filled = impute(rest, model_plan(), **setting).where("_hide")
    got = written(filled.select(field, "_truth"), "measure")
    base = got.withColumn("_b", F.lit(overall))
    grouped = error(field, marked.where("_hide").join(by_role, F.col("grupo_posicion").eqNullSafe(F.col("_g")), "left").withColumn("_b", F.coalesce("_m", F.lit(overall))), "_b") if by_role is not None else error(field, base, "_b")
    return error(field, got, field), error(field, base, "_b"), grouped


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    m = table(spark, d, "modelo")
    tried = []
    for s in SETTINGS:
        each = [run(m, f, 0, s) for f in FIELDS]
        tried.append((sum(e / b for e, b, _ in each), s, each))
        print("choosing", s, [tuple(round(x, 3) for x in e) for e in each], flush=True)
    best = min(tried, key=lambda t: t[0])[1]
    print(f"{len(SETTINGS)} settings tried; chosen {best}")
    for f in FIELDS:
        each = [run(m, f, t, best) for t in (1, 2, 3)]
        for name, xs in zip(("imputed", "overall median or most frequent", "median by role"), zip(*each)):
            print(f"{f:16} {name:32} error {statistics.mean(xs):.3f} (spread {max(xs) - min(xs):.3f})", flush=True)


if __name__ == "__main__":
    main()

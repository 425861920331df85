"""python -m pampero.llm.measures [FOLDER...]: what the neighbourhood of players finds against brute force.

Every profile whose id is divisible by 100 (or 10, 1 in small tables: at least 100 profiles) is
scored against all players, without windows or keys. Of those whose best counterpart reaches the
floor, the share whose best pair (or one as good) is among the neighbourhood's pairs is its recall.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pampero.llm import matching as mt
from pampero.llm.queries import _people
from pampero.session import written

LEAST = 0.77


def best_by_brute_force(records: DataFrame, asked: DataFrame) -> DataFrame:
    """b, mejor: the greatest confidence of each asked record's entity against every record of side a; the asked ones are few and broadcast."""
    few = asked.toPandas()
    codes = {c: few[c].to_numpy(dtype=float) for c in mt.CODES}

    def run(frames):
        for f in frames:
            out: dict = {}
            for i in range(len(few)):
                y = {c: np.repeat(v[i], len(f)) for c, v in codes.items()}
                may = f[mt.possible_people({c: f[c].to_numpy(dtype=float) for c in mt.CODES}, y, LEAST)]
                if len(may):
                    pair = pd.DataFrame({**{f"x_{c}": may[c] for c in mt.PEOPLE}, **{f"y_{c}": [few[c].iloc[i]] * len(may) for c in mt.PEOPLE}})
                    got = float(mt.score_people(pair).max())
                    if got >= LEAST:
                        ent = few["ent"].iloc[i]
                        out[ent] = max(out.get(ent, 0.0), got)
            yield pd.DataFrame({"b": list(out), "mejor": list(out.values())}).astype({"b": str, "mejor": float})

    return records.where("side = 'a'").repartition(64).mapInPandas(run, "b string, mejor double").groupBy("b").agg(F.max("mejor").alias("mejor"))


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for d in sys.argv[1:] or ["/root/testdata/sf0.01", "/root/testdata/sf0.1", "/root/testdata/check_l"]:
        people, _ = _people(spark, d)
        records = mt.people_records(people)
        profiles = records.where("side = 'b'").select("ent").distinct().count()
        step = 100 if profiles >= 10_000 else 10 if profiles >= 1_000 else 1
        asked = records.where("side = 'b'").where(F.col("ent").cast("bigint") % step == 0)
        brute = written(best_by_brute_force(records, asked), "measure")
        pairs = mt.people_pairs(records, 12, LEAST).groupBy("b").agg(F.max("confianza").alias("hallada"))
        row = brute.join(pairs, "b", "left").agg(F.count("*").alias("n"), F.count_if(F.col("hallada") >= F.col("mejor") - 1e-9).alias("found")).first()
        tied = mt.match_people(people).count()
        print(f"{d}: {profiles} profiles, {asked.select('ent').distinct().count()} asked, {row['n']} with a counterpart of {LEAST}, best pair among the neighbours {row['found']} ({row['found'] / max(1, row['n']):.4f}); {tied} tied ({tied / max(1, profiles):.4f})", flush=True)


if __name__ == "__main__":
    main()

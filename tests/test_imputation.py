import random

from pyspark.sql import functions as F

from conftest import rows
from pampero.operators.imputation import ROLES, impute, model_plan

COLUMNS = "operacion_id string, stat_goals double, grupo_posicion string, edad_al_fichaje int, stat_minutes double, stat_matches double, stat_assists double, stat_xg double, stat_tackles double, stat_recoveries double, stat_saves double, stat_pass_accuracy double, `stat_duels_won_%` double, club_origen_pais_coeficiente_uefa double, es_destino_top_20 boolean, club_origen_liga_es_top5 boolean, club_origen_es_filial boolean, club_origen_es_europeo boolean, j int, `_g` string"


def data(n=600):
    r = random.Random(1)
    out, truth = [], {}
    for i in range(n):
        keeper = r.random() < 0.3
        minutes = r.uniform(200, 3000)
        xg = 0.0 if keeper else minutes / 200 * r.uniform(0.9, 1.1)
        goals = float(round(xg))
        truth[str(i)] = (goals, "Arquero" if keeper else "Delantero centro")
        out.append([str(i), goals, truth[str(i)][1], r.randint(16, 38), minutes, minutes / 90, xg / 2, xg, 5.0 if keeper else 30.0, 90.0, 60.0 if keeper else None, 70.0, 50.0, 20.0, r.random() < 0.1, False, False, True, i, None])
    return out, truth


def test_fills_close_values_marks_them_and_keeps_the_rest(spark):
    base, truth = data()
    for i in range(0, 60):
        base[i][1] = [None, float("nan"), -1.0, 2.5][i % 4]
    for i in range(60, 120):
        base[i][2] = [None, "", "N/D", "arquero?"][i % 4]
    base[120][3], base[121][3], base[122][3] = None, -1, 99
    got = {r["operacion_id"]: r for r in impute(spark.createDataFrame([tuple(x) for x in base], COLUMNS), model_plan()).collect()}
    assert [k for k, r in got.items() if r["stat_goals_imputado"]].__len__() == 60 and sum(r["grupo_posicion_imputado"] for r in got.values()) == 60
    assert sorted(k for k, r in got.items() if r["edad_al_fichaje_imputado"]) == ["120", "121", "122"]
    assert all(14 <= r["edad_al_fichaje"] <= 45 and r["grupo_posicion"] in ROLES and r["stat_goals"] >= 0 and r["stat_goals"] == int(r["stat_goals"]) for r in got.values())
    assert sum(abs(got[str(i)]["stat_goals"] - truth[str(i)][0]) for i in range(60)) / 60 < 2
    assert sum(got[str(i)]["grupo_posicion"] == truth[str(i)][1] for i in range(60, 120)) >= 55
    assert all(got[str(i)]["stat_goals"] == truth[str(i)][0] for i in range(200, 600)) and got["300"]["j"] == 300


def test_all_missing_repeated_and_empty(spark):
    none = ["x"] + [None] * 19
    df = spark.createDataFrame([tuple(none), tuple(none)] + [tuple(x) for x in data(50)[0]], COLUMNS)
    got = rows(impute(df, model_plan(), iterations=3).where("operacion_id = 'x'"), "stat_goals_imputado", "grupo_posicion_imputado", "edad_al_fichaje_imputado")
    assert got == [(True, True, True)] * 2
    assert impute(df.limit(0), model_plan(), iterations=1).count() == 0

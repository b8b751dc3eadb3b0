"""Fits of folds from one pass, scoring of later rows, and the boards on generated rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from voltmes.models import features as ft, scoring, selection, zoo
from voltmes.models.foldfits import linear_folds
from voltmes.models.forests import Forest, load_forest, score_forest
from voltmes.operators.windows import lag_features
from voltmes.plans import modelling
from voltmes.session import scratch_path, stored

NUMERIC = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    chance = np.random.default_rng(2)
    made = []
    for month in range(60):
        for region in "NS":
            a, b, c = (float(v) for v in chance.normal([2000, 5, 0], [3, 1, 1]))
            y = 1e6 + 300 * a - 2000 * b + (500.0 if region == "N" else 0.0) + float(chance.normal(0, 100))
            made.append((f"{month:02d}{region}", month, region, a, None if month % 9 == 4 else b, c, y))
    return stored(spark.createDataFrame(made, "id string, month int, regiao string, a double, b double, c double, consumo double"))


def test_linear_folds_equal_single_fits(rows):
    found = {(r.fold, round(r.consumo, 6)): r.prediction for r in linear_folds(rows, NUMERIC).collect()}
    single, failed = selection.fold_predictions(rows, {"linear": lambda: ft.sensitive_pipeline(NUMERIC, zoo.linear("consumo"))}, ["consumo"])
    single = {(r.fold, round(r.consumo, 6)): r.prediction for r in single.collect()}
    assert failed == [] and found.keys() == single.keys() and len(found) == 100
    assert np.allclose([found[k] for k in single], list(single.values()), rtol=1e-7)


def test_linear_folds_take_few_jobs(spark, rows):
    spark.sparkContext.setJobGroup("folds", "folds")
    linear_folds(rows, NUMERIC).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("folds")
    spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) < 20


def test_linear_folds_with_gaps(spark, rows):
    gaps = rows.withColumns({
        "consumo": F.when(F.col("month") % 7 != 3, F.col("consumo")), "c": F.when(F.col("month") > 40, F.col("c")),
        "regiao": F.when(F.col("month") % 11 != 5, F.col("regiao"))})
    found = linear_folds(gaps, NUMERIC, order=("month", "id")).collect()
    assert len(found) == 100 and all(np.isfinite(r.prediction) for r in found)
    whole = [abs(r.prediction - r.consumo) for r in found if r.consumo is not None]
    assert np.median(whole) < 2000
    assert linear_folds(rows.limit(0), NUMERIC).count() == 0


def test_months_scored_later_equal_a_run_over_all_rows(spark, rows):
    wanted = rows.select("month", "regiao", "consumo")
    history = wanted.where("month < 40")
    known = lag_features(history).where("lag12 is not null")
    model = Pipeline(stages=[VectorAssembler(inputCols=["lag1", "lag12", "roll3"], outputCol="features"), zoo.linear("consumo")]).fit(known)
    folder, out = scratch_path(spark, "models"), scratch_path(spark, "predictions")

    def score(lagged):
        return selection.score_rows(model, lagged)

    scoring.save_tail(history, folder)
    for low, high in ((40, 41), (41, 55), (55, 60)):
        new = wanted.where((F.col("month") >= low) & (F.col("month") < high))
        scoring.score_appended(score, new, folder, out)
    # A region that the tail doesn't know has no lags yet.
    newcomer = scoring.score_appended(lambda lagged: lagged, spark.createDataFrame([(60, "X", 1.0)], "month int, regiao string, consumo double"), folder, scratch_path(spark, "more"))
    assert [(r.regiao, r.lag1, r.lag12) for r in newcomer.collect()] == [("X", None, None)]
    tail, version = scoring.load_tail(spark, folder)
    assert version == 4 and {(r.regiao, r["count"], r.low) for r in tail.groupBy("regiao").agg(F.count("*").alias("count"), F.min("month").alias("low")).collect()} == {
        ("N", 12, 48), ("S", 12, 48), ("X", 1, 60)}
    later = {(r.month, r.regiao): r.pred_consumo for r in spark.read.parquet(out).collect()}
    at_once = {(r.month, r.regiao): r.pred_consumo for r in score(lag_features(wanted).where("month >= 40")).collect()}
    assert later.keys() == at_once.keys() and np.allclose([later[k] for k in at_once], list(at_once.values()))


def test_search_saves_the_best_and_its_parameters_are_used_again(spark, rows, monkeypatch):
    monkeypatch.setitem(selection.SEARCH_SPACE, "n_estimators", [5, 8])
    folder = scratch_path(spark, "models")
    found = selection.tune_forest(rows, NUMERIC, folder, n=5).collect()
    assert len(found) == 5 and [r.best for r in found].count(True) == 1 and found[0].best and found[0].hold_mae > 0 and found[1].hold_mae is None
    assert [r.mae_mean for r in found] == sorted(r.mae_mean for r in found)
    tuned = load_forest(spark, folder, ["missing", "rfr_tuned"])
    assert str(tuned.params["n_estimators"]) == found[0].n_estimators
    scores = {r.regiao: r for r in selection.train_tuned(rows, NUMERIC, folder).collect()}
    assert set(scores) == {"TOTAL", "N", "S"} and scores["TOTAL"].n == 120 and scores["N"].n == 60
    both = score_forest(load_forest(spark, folder, ["rfr_global"]), rows.drop("c")).collect()
    assert len(both) == 120 and all(r.pred_consumo > 1e6 for r in both)
    assert {r.regiao for r in score_forest(load_forest(spark, folder, ["rfr_region_N"]), rows).where("pred_consumo is not null").collect()} == {"N", "S"}
    with pytest.raises(FileNotFoundError):
        load_forest(spark, folder, ["other"])


def test_regions_fold_by_fold(rows):
    few = rows.where("regiao = 'N' or month < 5")
    held = selection.region_forests(few, Forest(10), NUMERIC).collect()
    assert [(r.regiao, r.n) for r in held] == [("N", 60)] and held[0].r2 > 0 and held[0].notes == ""
    folded = {r.regiao: r for r in selection.region_forest_folds(few, Forest(10), NUMERIC).collect()}
    assert set(folded) == {"N", "S"} and folded["N"].n == 60 and folded["S"].n == 5 and folded["N"].r2_mean is not None


class Broken:
    def fit(self, _):
        raise ValueError("no\nfit")


def test_whole_regression_board(rows):
    finals = {**zoo.regressors("consumo", "id", ["month", "regiao"]), "broken": Broken}
    found = {r.model: r for r in selection.board(rows, finals, lambda: ft.preparation(NUMERIC, scaler="standard"), folds=2).collect()}
    assert set(found) == set(finals) and found["broken"].notes == "ValueError: no" and found["broken"].hold_mae is None
    assert all(r.notes == "" and r.hold_mae > 0 and r.cv_mae > 0 for name, r in found.items() if name != "broken")
    assert found["linear"].hold_r2 > 0.9 and found["forest"].hold_r2 > 0.2


def test_whole_classification_board(spark):
    chance = np.random.default_rng(8)
    made = [(i, "ab"[i % 2], float(chance.normal(50 if i % 2 else 20, 8)), float(i % 2), i % 5) for i in range(120)]
    table = stored(spark.createDataFrame(made, "doc_id long, lang string, n_chars double, label double, fold int"))
    found = {r.model: r for r in modelling.classifier_folds(table, [n for n in modelling.CLASSIFIERS if n != "perceptron"]).collect()}
    assert set(found) == set(modelling.CLASSIFIERS) - {"perceptron"} and all(r.accuracy > 90 and r.notes == "" for r in found.values())

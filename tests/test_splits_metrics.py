import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmes.operators import joins, metrics, outliers, splits, windows


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(r, f"{2004 + m // 12}-{m % 12 + 1:02d}", m, float(100 * i + m)) for i, r in enumerate(["N", "S", "X"]) for m in range({"N": 30, "S": 30, "X": 4}[r])]
    return spark.createDataFrame(rows, "regiao string, mes_ano string, month int, consumo double")


def test_lags_stay_inside_the_region(panel):
    rows = windows.lag_features(panel).toPandas()
    assert (rows[rows.month == 0].lag1.isna()).all() and rows[rows.month < 12].lag12.isna().all()
    assert rows[rows.month == 0].roll3.isna().all()
    north = rows[rows.regiao == "N"].set_index("month")
    assert north.roll3[1] == 0 and north.roll3[2] == 0.5 and north.roll3[10] == 8
    leaked = windows.leaking_trailing_mean(windows.lag_features(panel)).toPandas()
    first = leaked[(leaked.regiao == "S") & (leaked.month == 1)].roll3_compat.item()
    assert first == np.mean([28, 100])


def test_holdout_is_disjoint_and_whole(panel):
    placed = splits.holdout(panel)
    train, test = placed.where("role = 'train'"), placed.where("role = 'test'")
    assert (train.count(), test.count()) == (51, 13)
    assert train.join(test, ["regiao", "mes_ano"], "left_semi").count() == 0
    assert train.agg(F.max("month")).first()[0] <= test.agg(F.min("month")).first()[0]
    down = splits.holdout(panel, ("regiao", "month"), test_rounds_down=True).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in down} == {"train": 52, "test": 12}


@pytest.mark.parametrize("n", [6, 7, 11, 30])
def test_expanding_folds(spark, n):
    rows = splits.expanding_folds(spark.range(n).withColumnRenamed("id", "i"), ["i"]).toPandas()
    size = n // 6
    for fold in range(5):
        part = rows[rows.fold == fold]
        start = n - (5 - fold) * size
        assert sorted(part[part.role == "test"].i) == list(range(start, start + size))
        assert sorted(part[part.role == "train"].i) == list(range(start))
    assert rows[rows.role == "test"].i.is_unique


def test_folds_by_group_fall_back_to_a_holdout(panel):
    rows = splits.expanding_folds_by_group(panel).toPandas()
    assert rows[rows.regiao == "X"].fold.unique().tolist() == [0]
    assert sorted(rows[(rows.regiao == "X") & (rows.role == "test")].month) == [3]
    assert sorted(rows[rows.regiao == "N"].fold.unique()) == list(range(5))


def test_random_splits(spark):
    df = spark.range(101).withColumn("c", F.col("id") % 3)
    sizes = splits.random_holdout(df, ["id"]).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in sizes} == {"test": 21, "train": 80}
    by_class = splits.random_holdout(df, ["id"], 0.35, ["c"]).where("role = 'test'").groupBy("c").count().collect()
    assert sorted((r["c"], r["count"]) for r in by_class) == [(0, 12), (1, 12), (2, 12)]
    folds = splits.random_folds(df, ["id"]).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 20, 20, 21]
    blocks = splits.contiguous_folds(df, ["id"]).groupBy("fold").agg(F.min("id"), F.count("*")).orderBy("fold").collect()
    assert [tuple(b) for b in blocks] == [(0, 0, 21), (1, 21, 20), (2, 41, 20), (3, 61, 20), (4, 81, 20)]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (8.0, 5.0), (None, 1.0), (4.0, None)], "consumo double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row.n == 3 and np.isclose(row.mae, 4 / 3) and np.isclose(row.mse, 10 / 3)
    assert np.isclose(row.r2, 1 - 10 / ((1 - 4) ** 2 + 1 + 16))
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "consumo double, prediction double")
    assert metrics.regression_metrics(flat).first().r2 == 0.0
    assert metrics.regression_metrics(flat.where("prediction = 2").union(flat.where("prediction = 2"))).first().r2 == 1.0
    assert metrics.regression_metrics(flat.limit(1)).first().r2 is None


def test_region_metrics_note_small_regions(panel):
    placed = splits.holdout(panel.withColumn("prediction", F.col("consumo") + 1), ("month",), ("regiao",))
    rows = {r.regiao: r for r in metrics.region_metrics(placed).collect()}
    assert rows["X"].mae is None and rows["X"].notes == "too_small" and rows["X"].n == 4
    assert rows["N"].mae == 1.0 and rows["N"].notes == ""


def test_best_model_ignores_missing_scores(spark):
    board = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 2.0), ("d", 1.0)], "model string, mae double")
    assert metrics.best_model(board).first().model == "d"
    assert [r.model for r in metrics.leaderboard(board).collect()][:2] == ["d", "c"]
    assert metrics.best_model(board.where("model in ('a', 'b')")).count() == 0


def by_hand(truth, predicted):
    classes = sorted(set(truth) | set(predicted))
    truth, predicted = np.array(truth), np.array(predicted)
    rows = []
    for c in classes:
        tp, fp = ((truth == c) & (predicted == c)).sum(), ((truth != c) & (predicted == c)).sum()
        fn, tn = ((truth == c) & (predicted != c)).sum(), ((truth != c) & (predicted != c)).sum()
        ratio = lambda a, b: a / b if b else 0.0
        rows.append((ratio(2 * tp, 2 * tp + fp + fn), ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)))
    f1, precision, recall, spec = np.mean(rows, axis=0)
    if len(set(truth.tolist())) <= 2:
        spec = rows[-1][3] if len(classes) == 2 else 0.0
    return [100 * v for v in ((truth == predicted).mean(), f1, precision, recall, spec)]


@pytest.mark.parametrize("truth, predicted", [
    ([0, 0, 1, 1, 1], [0, 1, 1, 1, 0]), ([0, 1, 2, 2, 2, 1], [0, 2, 2, 2, 1, 1]), ([1, 1], [1, 1]), ([0, 1, 1], [0, 2, 1]), ([0, 0, 1], [1, 1, 0]),
    ([0, 1, 2], [3, 3, 3])])
def test_classification_metrics(spark, truth, predicted):
    df = spark.createDataFrame(list(zip(truth, predicted)), "label int, prediction int")
    assert metrics.confusion(df).agg(F.sum("n")).first()[0] == len(truth)
    row = metrics.classification_metrics(df).first()
    assert np.allclose([row.accuracy, row.f1, row.precision, row.recall, row.specificity], by_hand(truth, predicted))


def test_clipping_keeps_nulls_and_learns_from_training_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)] + [(None,), (1e9,)], "x double")
    clipped = outliers.winsorize(df, "x", "w", train=df.where("x < 1000")).toPandas()
    assert clipped.w.max() == pytest.approx(994.005) and clipped.w.isna().sum() == 1 and clipped.w.min() == pytest.approx(4.995)


def test_population_falls_back_to_the_median(spark, panel):
    known = spark.createDataFrame([("N", 1000), ("S", 3000)], "regiao string, populacao long")
    rows = joins.per_thousand(joins.with_population(panel, known)).select("regiao", "pop_2022").distinct().collect()
    assert {r.regiao: r.pop_2022 for r in rows} == {"N": 1000.0, "S": 3000.0, "X": 2000.0}


def test_rollup_sums_nothing_to_zero(spark):
    df = spark.createDataFrame([("2004-01", "S", None, 1.0), ("2004-01", "S", None, None)], "mes_ano string, regiao string, a double, b double")
    row = joins.weather_by_region(df, sums=["a"], means=["b"]).first()
    assert (row.a, row.b) == (0.0, 1.0)


def test_key_coverage(spark):
    left = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b")], "mes_ano string, regiao string")
    right = spark.createDataFrame([("m", "b"), ("m", "c"), ("m", "d")], "mes_ano string, regiao string")
    assert joins.key_coverage(left, right).first()[:] == (1, 1, 2)



import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voltmes.models import features as ft, selection, zoo
from voltmes.models.ensembles import Neighbours, ScaledLabel, Stacking, Voting, mean_vote
from voltmes.models.forests import Boost, Forest, GroveBoost, GroveForest
from voltmes.models.isolation import isolation_scores
from voltmes.session import scratch_path, stored

NUMERIC = ["t", "a", "b"]


@pytest.fixture(scope="module")
def frame():
    """A generated panel whose target is linear in time and one measure, with gaps."""
    random = np.random.default_rng(1)
    rows = []
    for i, region in enumerate(["N", "S"]):
        for month in range(60):
            a, b = random.normal(10, 2), random.normal()
            rows.append((f"{region}{month:03d}", region, month, float(month), a, b, 1e6 * (5 * i + 1) + 2e4 * month + 5e4 * a + 1e3 * b))
    pdf = pd.DataFrame(rows, columns=["id", "regiao", "month", "t", "a", "b", "consumo"])
    pdf.loc[pdf.index % 13 == 0, "a"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def rows(spark, frame):
    df = spark.createDataFrame(frame).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    return stored(df)


def test_scaling_and_filling_learn_from_the_fitted_rows(rows, frame):
    stages = ft.preparation(["a"], [], "standard")
    out = Pipeline(stages=stages).fit(rows).transform(rows).toPandas()
    assert np.isclose(out.a__scaled.mean(), 0) and np.isclose(out.a__scaled.std(ddof=0), 1)
    filled = out.sort_values("id").a__filled.to_numpy()
    expected = frame.sort_values("id").a.fillna(frame.a.median()).to_numpy()
    assert np.allclose(filled, expected)
    robust = ft.RobustStandardizer(inputCols=["b"], outputCols=["b"]).fit(rows).transform(rows).toPandas().b
    assert np.isclose(robust.median(), 0) and np.isclose(robust.quantile(0.75) - robust.quantile(0.25), 1)
    train = rows.where("month < 10")
    learned = ft.MedianImputer(inputCols=["t"], outputCols=["t"]).fit(train)
    assert learned.getOrDefault("values") == [4.5]


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, None, None)], "c double, e double, s string")
    scaled = ft.Standardizer(inputCols=["c"], outputCols=["c"]).fit(df).transform(df)
    assert [r.c for r in scaled.collect()] == [0.0, 0.0]
    assert ft.MedianImputer(inputCols=["e"], outputCols=["e"]).fit(df).transform(df).first().e == 0.0
    assert ft.RobustStandardizer(inputCols=["c"], outputCols=["c"]).fit(df).transform(df).first().c == 0.0
    assert ft.ModeImputer(inputCols=["s"], outputCols=["s"]).fit(df).transform(df).first().s == ""


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    assert ft.ModeImputer(inputCols=["s"], outputCols=["s"]).fit(df).getOrDefault("words") == ["a"]


def test_unseen_category_is_all_zeros(rows):
    stages = ft.preparation([], ["regiao"])[2:]
    model = Pipeline(stages=stages).fit(rows)
    seen = model.transform(rows.where("regiao = 'S'").limit(1)).select(vector_to_array("features")).first()[0]
    unseen = model.transform(rows.limit(1).withColumn("regiao", F.lit("?"))).select(vector_to_array("features")).first()[0]
    assert seen == [0.0, 1.0] and unseen == [0.0, 0.0]


def transformed(x, power):
    with np.errstate(all="ignore"):
        up = np.log1p(x) if abs(power) < 1e-12 else ((x + 1) ** power - 1) / power
        down = -np.log1p(-x) if abs(power - 2) < 1e-12 else -((1 - x) ** (2 - power) - 1) / (2 - power)
    return np.where(x >= 0, up, down)


def test_power_is_the_most_likely_one(spark):
    random = np.random.default_rng(2)
    values = {"skewed": np.exp(random.normal(size=400)), "signed": random.normal(size=400) ** 3, "plain": random.normal(5, 1, 400)}
    df = spark.createDataFrame(pd.DataFrame(values))
    found = ft.yeo_johnson_powers(df, list(values))
    grid = np.arange(-5, 5, 0.001)
    for name, x in values.items():
        stretch = (np.sign(x) * np.log1p(np.abs(x))).sum()
        likelihood = [-len(x) / 2 * np.log(transformed(x, g).var()) + (g - 1) * stretch for g in grid]
        assert abs(found[name] - grid[int(np.argmax(likelihood))]) < 0.003
    for power in (0.0, 0.7, 2.0):
        got = df.select(ft.yeo_johnson(F.col("signed"), power)).toPandas().iloc[:, 0]
        assert np.allclose(got, transformed(values["signed"], power))


def test_saved_pipeline_scores_the_same_and_fills_missing_columns(spark, rows):
    model = ft.sensitive_pipeline(NUMERIC, zoo.linear("consumo"), "robust", power=True).fit(rows)
    folder = scratch_path(spark, "models")
    selection.save_model(model, f"{folder}/rfr_tuned")
    loaded = selection.load_model(spark, folder)
    assert isinstance(loaded, PipelineModel) and ft.required_columns(loaded) == [*NUMERIC, "regiao"]
    before, after = (
        selection.score_rows(m, rows).toPandas().sort_values("id").pred_consumo.to_numpy() for m in (model, loaded))
    assert np.allclose(before, after)
    assert selection.score_rows(loaded, rows.drop("a")).where("pred_consumo is null").count() == 0


def beats_the_mean(rows, regressor, scaler="standard"):
    placed = rows.withColumn("role", F.when(F.col("month") % 4 == 3, "test").otherwise("train"))
    model = ft.sensitive_pipeline(NUMERIC, regressor, scaler).fit(placed.where("role = 'train'"))
    tested = model.transform(placed.where("role = 'test'")).toPandas()
    assert len(tested) == 30
    return 1 - ((tested.consumo - tested.prediction) ** 2).sum() / ((tested.consumo - tested.consumo.mean()) ** 2).sum()


@pytest.mark.parametrize("name, least", [
    ("linear", 0.99), ("huber", 0.99), ("knn", 0.9), ("tree", 0.95), ("forest", 0.95), ("bagging", 0.95)])
def test_regressors(rows, name, least):
    assert beats_the_mean(rows, zoo.regressors("consumo", "id", ["month", "regiao"])[name]()) > least


def test_ensembles(rows):
    assert beats_the_mean(rows, GroveBoost("median", Boost(8, depth=3), "consumo")) > 0.95
    assert beats_the_mean(rows, Voting([zoo.linear("consumo"), zoo.tree("consumo")])) > 0.95
    stack = Stacking([zoo.tree("consumo"), Neighbours("id", labelCol="consumo")], GroveForest(Forest(10), "consumo"), ["month", "regiao"], folds=3)
    assert beats_the_mean(rows, stack) > 0.9


def test_scaled_label_answers_in_the_label_units(rows):
    assert beats_the_mean(rows, ScaledLabel(zoo.linear("_"), "consumo")) > 0.99


def test_boosted_classifier(spark):
    """A diagonal border, which one stump cannot follow."""
    data = [(float(i), float(j), 1.0 if i + j > 9 else 0.0) for i in range(10) for j in range(10)]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(data, "x double, y double, label double"))
    right = {
        rounds: GroveBoost("ballot", Boost(rounds, depth=1), "label").fit(df).transform(df).where("label = prediction").count() for rounds in (1, 20)}
    assert right[20] > 90 and right[20] > right[1] + 10


def test_mean_vote(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (None, 1.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(mean_vote(["a", "b", "c"])).collect()] == [3.0, None]


def test_comparison_keeps_a_failing_model_without_scores(rows):
    class Broken:
        def fit(self, _):
            raise ValueError("no")

    makers = {"linear": lambda: ft.tree_pipeline(NUMERIC, zoo.linear("consumo")), "broken": Broken}
    board = {r.model: r for r in selection.compare(rows, makers).collect()}
    assert board["broken"].mae_mean is None and board["linear"].r2_mean > 0.9
    both = selection.compare_with_holdout(rows, makers)
    assert [r.model for r in both.collect()] == ["linear", "broken"]
    name, model = selection.refit_best(rows, both, makers)
    assert name == "linear" and model.transform(rows).count() == 120


def test_search_draws_are_different_and_repeatable():
    first = selection.draws()
    assert first == selection.draws() and len({str(d) for d in first}) == 12
    assert all(d[k] in v for d in first for k, v in selection.SEARCH_SPACE.items())


def test_one_model_per_region(spark, rows):
    few = rows.where("regiao = 'N' or month < 5")
    found = selection.region_models(few, lambda: ft.tree_pipeline(NUMERIC, zoo.linear("consumo")), folder=scratch_path(spark, "regions")).collect()
    assert [r.regiao for r in found] == ["N"] and found[0].r2 > 0.5 and found[0].n == 60
    assert PipelineModel.load(found[0].model_path) is not None


class Failing(Estimator):
    """Does not fit the rows of region S."""

    def _fit(self, df):
        if df.where("regiao = 'S'").count():
            raise ValueError("no fit\nat all")
        return zoo.linear("consumo").fit(df)


def test_a_region_that_fails_keeps_its_row(spark, rows):
    def maker():
        return ft.tree_pipeline(NUMERIC, Failing())

    held = {r.regiao: r for r in selection.region_models(rows, maker).collect()}
    folded = {r.regiao: r for r in selection.region_folds(rows, maker, folds=2).collect()}
    assert set(held) == set(folded) == {r.regiao for r in rows.select("regiao").distinct().collect()}
    for found in (held, folded):
        assert found["S"].notes == "ValueError: no fit" and all(found[r].notes == "" for r in found if r != "S")
    assert held["S"].mae is None and held["N"].mae is not None
    with pytest.raises(ValueError, match="no fit"):
        selection.region_models(rows.where("regiao = 'S'"), maker)


class Silent(Estimator):
    """Answers with the row's month, and not at all for the first month."""

    def _fit(self, df):
        return SilentModel()

    def copy(self, extra=None):
        return Silent()


class SilentModel(Model):
    def _transform(self, df):
        return df.withColumn("prediction", F.when(F.col("month") > 0, F.col("month").cast("double")))


def test_stacking_keeps_rows_without_a_base_answer(spark):
    df = spark.createDataFrame([(m, "N", float(m % 7)) for m in range(40)], "month int, regiao string, consumo double")
    made = Stacking([Silent()], zoo.tree("consumo"), ["month", "regiao"], folds=2).fit(df).transform(df).collect()
    assert len(made) == 40 and [r.month for r in made if r.prediction is None] == [0]


def test_isolation_forest_finds_the_odd_rows(spark):
    random = np.random.default_rng(4)
    values = random.normal(size=(600, 2))
    values[:6] += 12
    df = spark.createDataFrame([(i, float(a), float(b) if i % 50 else None) for i, (a, b) in enumerate(values)], "i long, a double, b double")
    found = isolation_scores(df, ["a", "b"], ["i"], trees=40, tree_rows=64).toPandas()
    assert len(found) == 600 and found.is_outlier.sum() == 6
    assert set(found[found.is_outlier].i) <= set(range(6)) | {0}

"""Fits and boards that once did less than the whole job."""

import numpy as np
import pandas as pd

from voltmes.models import features as ft, selection, zoo
from voltmes.operators import splits
from voltmes.plans import modelling
from voltmes.session import stored


def test_power_beyond_the_first_range_is_found(spark):
    random = np.random.default_rng(3)
    values = {
        # Pressure-like: large mean, small spread, one side longer than the other.
        "left": 1010 - 3 * np.exp(random.normal(0, 0.7, 500)), "right": 1010 + 3 * np.exp(random.normal(0, 0.7, 500)),
        "below": -(1010 - 3 * np.exp(random.normal(0, 0.7, 500))), "plain": random.normal(5, 1, 500), "same": np.full(500, 3.0),
    }
    df = spark.createDataFrame(pd.DataFrame(values))
    found = ft.yeo_johnson_powers(df, list(values))

    def likelihood(x, power):
        """For values of one sign, in which constants and factors drop out of the variance."""
        power, x = (2 - power, -x) if x[0] < 0 else (power, x)
        far = np.log1p(x)
        near = far.max() if power >= 0 else far.min()
        return -len(x) / 2 * (np.log((np.exp(power * (far - near)) / power).var()) + 2 * power * near) + (power - 1) * far.sum()

    for name, low, high in (("left", 5, 2000), ("right", -2000, -5), ("below", -2000, -3)):
        assert low < found[name] < high
        there = likelihood(values[name], found[name])
        grid = np.concatenate([np.linspace(-2000, 2000, 8002), found[name] + np.linspace(-1, 1, 201)])
        assert there >= max(likelihood(values[name], g) for g in grid) - 1e-6
    assert abs(found["plain"]) < 5 and found["same"] == 1.0
    model = ft.YeoJohnson(inputCols=list(values), outputCols=list(values)).fit(df)
    out = model.transform(df).toPandas()
    for name in ("left", "right", "below", "plain"):
        z, x = out[name].to_numpy(), values[name]
        assert abs(z.mean()) < 1e-6 and abs(z.std() - 1) < 1e-6 and np.all(np.diff(z[np.argsort(x)]) >= 0)
        assert abs(((z - z.mean()) ** 3).mean()) < 0.5
    assert (out["same"] == 0).all()


def test_boards_hold_every_model(spark, monkeypatch):
    asked = {}

    def noted(name, empty):
        return lambda rows, models, *_: asked.update({name: set(models)}) or empty

    empty = spark.createDataFrame([], "model string")
    monkeypatch.setattr(modelling, "modelling_rows", lambda *_: empty)
    monkeypatch.setattr(modelling, "labelled", lambda *_: spark.createDataFrame([(1, "a", 1.0, 0.0)], "doc_id long, lang string, n_chars double, label double"))
    monkeypatch.setattr(selection, "board", noted("regressors", empty))
    monkeypatch.setattr(modelling, "classifier_folds", noted("classifiers", empty))
    modelling.model_board(spark, "")
    modelling.cls_folds(spark, "")
    assert asked == {"regressors": set(zoo.regressors("consumo", "id", ["month"])), "classifiers": set(zoo.classifiers("label", "doc_id", ["doc_id"], 2))}


def test_classifiers_share_the_folds(spark):
    rows = [(i, "ab"[i % 2], float(i % 2 * 50 + i % 7), float(i % 2)) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, n_chars double, label double")
    folds = stored(splits.random_folds(table, ["doc_id"]).select("doc_id", "lang", "n_chars", "label", "fold"))
    found = {r.model: r for r in modelling.classifier_folds(folds, ["bayes", "tree", "perceptron"]).collect()}
    assert set(found) == {"bayes", "tree", "perceptron"} and all(r.accuracy > 95 and r.notes == "" for r in found.values())

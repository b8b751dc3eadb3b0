"""Learners that fit the folds of one table together or on rows prepared once."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from voltmes.models import forests, zoo
from voltmes.models.ensembles import Neighbours, Stacking
from voltmes.models.forests import Boost, Forest, GroveBoost, GroveForest, SharedRows
from voltmes.operators import neighbors, splits
from voltmes.session import stored


@pytest.fixture(scope="module")
def table(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(a), float(b)], float(random.random() < 0.2 + 0.15 * b)) for i, (a, b) in enumerate(zip(random.integers(0, 9, 600), random.integers(0, 4, 600)))]
    return stored(spark.createDataFrame(rows, "id long, x array<double>, label double").select("id", array_to_vector("x").alias("features"), "label"))


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_one_search_passes_over_the_own_fold(spark, table, block_rows):
    rows = stored(splits.contiguous_folds(table.select("id", vector_to_array("features").alias("vector")), ["id"], 3))
    found = neighbors.nearest(rows, rows, 4, "id", "id", block_rows=block_rows, apart="fold")
    wanted = [
        tuple(r) for fold in range(3) for r in neighbors.nearest(rows.where(F.col("fold") == fold), rows.where(F.col("fold") != fold), 4, "id", "id").select(
            "query", F.lit(fold), "point", "distance", "rank").collect()]
    assert len(wanted) == 2400
    assert sorted(tuple(r) for r in found.select("query", "apart", "point", "distance", "rank").collect()) == sorted(wanted)


def test_keys_that_come_twice_are_answered_by_fold(spark):
    # Key 1 stands in both folds, with another label in each; a row without a key is answered too.
    rows = [(1, 0.0, 0.0, 0), (1, 0.0, 1.0, 1), (2, 0.1, 0.0, 0), (3, 5.0, 1.0, 1), (None, 4.9, 1.0, 0), (4, 5.1, 0.0, 1)]
    df = spark.createDataFrame(rows, "id long, x double, label double, fold int").select("id", array_to_vector(F.array("x")).alias("features"), "label", "fold")
    learner = Neighbours("id", 1, classify=True)
    found = learner.unseen(df, df, "fold")
    parts = [learner.fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f)) for f in (0, 1)]
    each = [sorted((str(r.id), r.fold, r.label, r.prediction) for r in x.collect()) for x in (found, parts[0].unionByName(parts[1]))]
    assert each[0] == each[1] and len(each[0]) == 6


def test_stacking_searches_all_folds_at_once(spark, table, monkeypatch):
    import voltmes.models.ensembles as ensembles

    searches, nearest = [], ensembles.nearest
    monkeypatch.setattr(ensembles, "nearest", lambda *a, **k: searches.append(1) or nearest(*a, **k))
    make = zoo.classifiers("label", "id", ["id"], 2)["stacking"]
    assert isinstance(make(), Stacking) and make().folds == 5
    model = make().fit(table)
    assert len(searches) == 1 and model.transform(table).where("prediction is null").count() == 0


def test_rows_are_prepared_once_for_all_trees(table, monkeypatch):
    asked, prepare = [], forests._vector_rows
    monkeypatch.setattr(forests, "_vector_rows", lambda df, *how: asked.append(df) or prepare(df, *how))
    finals = zoo.classifiers("label", "id", ["id"], 2)
    for name in ("tree", "forest", "bagging", "boosting", "gradient", "vote"):
        finals[name]().fit(table)
    assert len(asked) == 1
    finals["tree"]().fit(table.where("id > 5"))
    assert len(asked) == 2


@pytest.mark.parametrize("share", ["sqrt", None])
def test_counted_rows_grow_the_same_trees(table, share):
    models = [GroveForest(Forest(5, share=share), classify=True, local_rows=n).fit(table) for n in (50_000, 200)]
    # The cut of a leaf says nothing.
    cut = F.when(F.col("feature") >= 0, F.col("cut")).otherwise(-1)
    nodes = [sorted(map(tuple, m.nodes.select("tree", "path", "feature", cut, "n").collect())) for m in models]
    assert nodes[0] == nodes[1]


def test_rows_of_many_cells_are_counted_out_again(table):
    ready = SharedRows().of(table, "features", "label", True, 20)
    assert ready.rows.count() < 600 and ready.cells is None and ready.each().count() == 600 and ready.facts.rows[0] == 600
    whole, scanned = (GroveBoost("logistic", Boost(2, depth=2), local_rows=n).fit(table).transform(table).orderBy("id").select("prediction").collect() for n in (50_000, 20))
    assert whole == scanned

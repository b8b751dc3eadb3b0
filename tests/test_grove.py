"""Trees grown together against plain ones grown node by node."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from voltmes.models import forests, grove
from voltmes.models.forests import Boost, Forest, GroveBoost, GroveForest
from voltmes.models.grove import Tree


def table(n, seed=0, inputs=4):
    chance = np.random.default_rng(seed)
    x = np.round(chance.standard_normal((n, inputs)), 2)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 2.0, -1.0) * x[:, 2] + 0.1 * chance.standard_normal(n)
    return x, y


def plain_tree(bins, y, w, how, level=0):
    """(feature, cut, left, right) or (mean,), by trying every cut of every input."""
    n, mean = len(y), (w * y).sum() / w.sum()
    best = None
    if n >= how.min_split and level < how.depth:
        for f in range(bins.shape[1]):
            for cut in np.unique(bins[:, f])[:-1]:
                left = bins[:, f] <= cut
                if min(left.sum(), n - left.sum()) >= how.min_leaf:
                    gain = sum((w[p] * y[p]).sum() ** 2 / w[p].sum() for p in (left, ~left)) - (w * y).sum() ** 2 / w.sum()
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut
    if best is None:
        return (mean,)
    left = bins[:, best[1]] <= best[2]
    return (best[1], best[2], plain_tree(bins[left], y[left], w[left], how, level + 1), plain_tree(bins[~left], y[~left], w[~left], how, level + 1))


def plain_answer(tree, row):
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def plain_best_first(bins, y, leaves, min_leaf):
    """Leaf of each row after the leaf of greatest gain has been split again and again, and how many splits there were."""
    def split(rows):
        best = (1e-9, None)
        for f in range(bins.shape[1]):
            for cut in np.unique(bins[rows, f])[:-1]:
                left = rows[bins[rows, f] <= cut]
                right = rows[bins[rows, f] > cut]
                if min(len(left), len(right)) >= min_leaf:
                    gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[rows].sum() ** 2 / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        return best

    open_ = [(np.arange(len(y)), split(np.arange(len(y))))]
    while len(open_) < leaves:
        open_.sort(key=lambda leaf: -leaf[1][0] if leaf[1][1] else 0)
        if open_[0][1][1] is None:
            break
        _, (_, (left, right)) = open_.pop(0)
        open_ += [(left, split(left)), (right, split(right))]
    leaf = np.zeros(len(y), int)
    for i, (rows, _) in enumerate(open_):
        leaf[rows] = i
    return leaf, len(open_)


def binned(x):
    cuts = [(np.unique(x[:, i])[1:] + np.unique(x[:, i])[:-1]) / 2 for i in range(x.shape[1])]
    step = max(1, max(len(c) for c in cuts) // 200 + 1)
    return grove.Binning([c[::step] for c in cuts]).bins(x)


@pytest.mark.parametrize("how", [
    Tree("a", 0, 1, 4, bootstrap=False), Tree("a", 0, 1, 4, depth=3), Tree("a", 0, 2, 4, min_split=30), Tree("a", 0, 3, 4, min_leaf=12), Tree("a", 0, 4, 4, depth=0),
])
def test_a_tree_is_the_plain_one(how):
    x, y = table(120)
    bins = binned(x)
    w = grove.draws(np.arange(len(y)), how)
    some = np.flatnonzero(w > 0)
    centred = y - y.mean()
    found = grove.grow_rows(bins[some], (w * centred)[some][:, None], w[some], np.zeros(len(some), int), np.array([0]), grove.root_paths(np.array([0])), np.array([0]), [how])
    pack = grove.Pack(found["path"], found["feature"], found["cut"], found["value"])
    answer = pack.value[pack.leaves(bins, grove.root_paths(np.array([0])))[:, 0], 0]
    tree = plain_tree(bins[some], centred[some], w[some], how)
    assert np.allclose(answer, [plain_answer(tree, row) for row in bins])


def test_min_split_and_tries_change_a_tree():
    x, y = table(200)
    bins, counts, shapes = binned(x), {}, {}
    for name, how in {"plain": Tree("a", 0, 1, 4), "split": Tree("a", 0, 1, 4, min_split=40), "tries": Tree("a", 0, 1, 1), "shallow": Tree("a", 0, 1, 4, depth=2)}.items():
        w = grove.draws(np.arange(len(y)), how)
        some = np.flatnonzero(w > 0)
        found = grove.grow_rows(bins[some], (w * y)[some][:, None], w[some], np.zeros(len(some), int), np.array([0]), grove.root_paths(np.array([0])), np.array([0]), [how])
        counts[name], shapes[name] = len(found["path"]), dict(zip(found["path"].tolist(), found["feature"].tolist()))
        inner = found["feature"] >= 0
        assert (found["n"][inner] >= how.min_split).all()
    assert counts["split"] < counts["plain"] and counts["shallow"] <= 7 and shapes["tries"] != shapes["plain"]


@pytest.mark.parametrize("leaves", [2, 5, 31])
def test_best_first_tree_is_the_plain_one(leaves):
    x, y = table(200, 5)
    bins, y = binned(x), y - y.mean()
    how = Tree("a", 0, 1, 4, min_leaf=4, bootstrap=False, leaves=leaves)
    found = grove.grow_rows(bins, y[:, None], np.ones(len(y)), np.zeros(len(y), int), np.array([0]), grove.root_paths(np.array([0])), np.array([0]), [how])
    pack = grove.Pack(found["path"], found["feature"], found["cut"], found["value"])
    leaf, count = plain_best_first(bins, y, leaves, 4)
    own = pack.leaves(bins, grove.root_paths(np.array([0])))[:, 0]
    assert len(np.unique(own)) == count <= leaves and (found["feature"] < 0).sum() == count
    assert len(set(zip(own.tolist(), leaf.tolist()))) == count
    levels = grove.grow_rows(bins, y[:, None], np.ones(len(y)), np.zeros(len(y), int), np.array([0]), grove.root_paths(np.array([0])), np.array([0]), [how._replace(leaves=0, depth=5)])
    assert leaves < 31 or set(levels["path"].tolist()) != set(found["path"].tolist())


def grouped(spark, n=160):
    x, y = table(n, 7)
    rows = [(i, *[float(v) if (i + j) % 17 else None for j, v in enumerate(row)], "abc"[i % 3], float(t), [g for g in range(3) if i < (g + 1) * n // 4],
             [g for g in range(3) if (g + 1) * n // 4 <= i < (g + 2) * n // 4]) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, x3 double, regiao string, consumo double, groups array<int>, tested array<int>").repartition(4)


def test_scans_and_tasks_grow_the_same_trees(spark):
    df = grouped(spark)
    kinds = {"plain": Forest(6), "some": Forest(5, depth=4, min_split=8, min_leaf=3, share="sqrt", bootstrap=False), "half": Forest(3, share=0.5)}
    grown = {}
    for local_rows in (50_000, 15, 0):
        made = forests.grow_forests(df, kinds, ["x0", "x1", "x2", "x3"], 3, local_rows=local_rows)
        nodes = {(r.path): (r.tree, r.feature, r.cut if r.feature >= 0 else 0, r.n, round(r.value[0], 6)) for r in made.nodes.collect()}
        answers = {(r.id, r.group, r.model): round(r.prediction, 6) for r in forests.forest_answers(made).collect()}
        grown[local_rows] = (nodes, answers)
    assert grown[50_000] == grown[15] == grown[0]
    nodes, answers = grown[50_000]
    assert {t for t, *_ in nodes.values()} == set(range(42)) and len(answers) == 3 * 3 * 40


def test_groups_learn_from_their_own_rows(spark):
    df = grouped(spark)
    made = forests.grow_forests(df, {"one": Forest(1, bootstrap=False)}, ["x0", "x1", "x2", "x3"], 3)
    known = {r.id: r for r in df.collect()}
    assert made.facts.rows.tolist() == [40, 80, 120]
    for g in range(3):
        assert np.isclose(made.facts.means[g, 0], np.mean([r.consumo for r in known.values() if g in r.groups]))
    train = {r.consumo for r in known.values() if 0 in r.groups}
    for r in forests.forest_answers(made).where("group = 0").collect():
        # A tree without a limit answers with one row's label, where its inputs tell all rows apart.
        assert min(abs(r.prediction - t) for t in train) < 1e-6
    empty = forests.grow_forests(df.where("id < 0"), {"one": Forest(1)}, ["x0"], 3, categorical=())
    assert empty.trees == []


def vectors(spark, n=240, classes=0):
    x, y = table(n, 11)
    label = y if not classes else np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    df = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, label))], "id long, a double, b double, c double, d double, label double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df.repartition(3))


def error(model, df):
    return model.transform(df).select(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]


def test_forest_learner(spark, monkeypatch):
    df = vectors(spark)
    model = GroveForest(Forest(30)).fit(df)
    assert error(model, df) < 0.5
    first = {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}
    monkeypatch.setattr(forests, "PACKED_NODES", 0)
    second = {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}
    assert first.keys() == second.keys() and np.allclose([first[i] for i in first], [second[i] for i in first])
    classed = vectors(spark, classes=3)
    found = GroveForest(Forest(30, share="sqrt"), classify=True).fit(classed).transform(classed)
    assert found.where("prediction = label").count() > 230
    assert np.allclose([sum(r.probability) for r in found.collect()], 1)


@pytest.mark.parametrize("kind,boost,classes", [
    ("squares", Boost(rounds=25, depth=3), 0), ("squares", Boost(rounds=12, leaves=9, min_leaf=5), 0), ("median", Boost(rounds=8, depth=3), 0),
    ("logistic", Boost(rounds=10, depth=2), 2), ("ballot", Boost(rounds=8, depth=1), 3),
])
def test_boosting_in_a_task_and_in_scans(spark, kind, boost, classes):
    df = vectors(spark, 120, classes)
    answers = []
    for local_rows in (50_000, 0):
        model = GroveBoost(kind, boost._replace(rounds=4) if not local_rows else boost._replace(rounds=4), local_rows=local_rows).fit(df)
        answers.append({r.id: r.prediction for r in model.transform(df).collect()})
    assert np.allclose([answers[0][i] for i in answers[0]], [answers[1][i] for i in answers[0]])
    model = GroveBoost(kind, boost).fit(df)
    if classes:
        assert model.transform(df).where("prediction = label").count() > (100 if kind == "logistic" else 75)
    else:
        assert error(model, df) < (1.0 if boost.depth == 3 else 1.6)


def test_squares_follow_the_plain_rounds(spark):
    """Five rounds of best-first trees against the same rounds in plain Python."""
    df = vectors(spark, 100)
    model = GroveBoost("squares", Boost(rounds=5, leaves=6, min_leaf=5)).fit(df)
    rows = model.transform(df).orderBy("id").collect()
    bins = model.facts.filled(model.binning.bins(np.array([[r.a, r.b, r.c, r.d] for r in rows])), 0)
    y = np.array([r.label for r in rows])
    total = np.full(len(y), y.mean())
    for _ in range(5):
        leaf, _ = plain_best_first(bins, y - total, 6, 5)
        total = total + 0.1 * np.array([(y - total)[leaf == k].mean() for k in leaf])
    assert np.allclose([r.prediction for r in rows], total)


def crowded(spark, rows: int = 900, classes: int = 2):
    """Many rows of few different inputs."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 12, rows), rng.integers(0, 3, rows)
    y = (a + 3 * b + rng.normal(0, 3, rows) > 9).astype(float) if classes else a * 2.0 + b + rng.integers(0, 3, rows)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(y[i])) for i in range(rows)], "id long, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.repartition(5))


def no_scan(*_, **__):
    raise AssertionError("a scan per level")


@pytest.mark.parametrize("kind,boost,classes", [
    ("squares", Boost(rounds=6, depth=3, min_leaf=20), 0), ("median", Boost(rounds=6, depth=3), 0), ("logistic", Boost(rounds=12, depth=3), 2), ("ballot", Boost(rounds=8, depth=1), 2),
])
def test_boosting_of_cells_takes_no_scans(spark, monkeypatch, kind, boost, classes):
    """More rows than a task takes, but of few bins: the rounds are those of the rows, without a scan per level."""
    df = crowded(spark, classes=classes)
    whole = GroveBoost(kind, boost).fit(df)
    monkeypatch.setattr(grove, "_scan", no_scan)
    cells = GroveBoost(kind, boost, local_rows=200).fit(df)
    assert np.allclose(whole.votes, cells.votes)
    first, second = ({r.id: r.prediction for r in model.transform(df).collect()} for model in (whole, cells))
    assert np.allclose([first[i] for i in first], [second[i] for i in first])


@pytest.mark.parametrize("forest", [Forest(12, share="sqrt"), Forest(1, bootstrap=False), Forest(5, depth=3, min_split=30, min_leaf=9)])
def test_forest_of_cells_takes_no_scans(spark, monkeypatch, forest):
    df = crowded(spark)
    monkeypatch.setattr(grove, "_scan", no_scan)
    whole = GroveForest(forest, classify=True).fit(df)
    cells = GroveForest(forest, classify=True, local_rows=200).fit(df)
    first, second = ({(r.tree, r.path): r for r in model.nodes.collect()} for model in (whole, cells))
    assert first.keys() == second.keys() and len(first) > 4
    for at, node in first.items():
        assert (node.feature, node.n) == (second[at].feature, second[at].n) and np.allclose(node.value, second[at].value)
        assert node.feature < 0 or node.cut == second[at].cut

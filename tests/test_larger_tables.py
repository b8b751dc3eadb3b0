"""Steps whose time or memory grew faster than their input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltmes.models import features as ft, isolation
from voltmes.operators import correlate, neighbors


def plain_likelihood(x: np.ndarray, power: float) -> float:
    up, down = x >= 0, x < 0
    y = np.empty(len(x))
    y[up] = np.log1p(x[up]) if power == 0 else ((x[up] + 1) ** power - 1) / power
    y[down] = -np.log1p(-x[down]) if power == 2 else -((1 - x[down]) ** (2 - power) - 1) / (2 - power)
    return float(-len(x) / 2 * np.log(y.var()) + (power - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum())


@pytest.mark.parametrize("shift,scale", [(0, 3), (40, 5), (-40, 5), (1000, 2)])
def test_power_search_takes_one_scan(spark, monkeypatch, shift, scale):
    """The likelihoods of all powers come from one table of moments, and are those of the values."""
    x = shift + scale * np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    made = []
    inner = ft._binned_moments
    monkeypatch.setattr(ft, "_binned_moments", lambda values, planned: made.append(inner(values, planned)) or made[-1])
    ft.yeo_johnson_powers(df, ["x"], low=-2, high=4, points=13, passes=4)
    # Far from zero the range widens, which may ask for narrower bins.
    assert len(made) == 1 or abs(shift) == 1000 and len(made) < 6
    ends = (float(x.min()), float(x.max()))
    bins = ft._planned(*ends, 20)
    found = inner(df.select(F.lit("x").alias("feature"), F.col("x").alias("value")), {"x": bins})["x"]
    powers = [-2.0, -0.5, 0.0, 0.7, 1.0, 1.9, 2.0, 3.5]
    apart = np.array([ft._likelihood(found, bins, ends, p) - plain_likelihood(x, p) for p in powers])
    # What the two leave out is the same for all powers.
    assert np.allclose(apart, apart[0], atol=1e-5)


def test_cells_in_reach_take_little_memory():
    rng = np.random.default_rng(1)
    pivots, vectors = rng.normal(size=(512, 64)), rng.normal(size=(10_000, 64))
    cells = {c: {"n": 9, "radius": 1.0} for c in range(512)}
    lists = pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 64, pa.int32()), pa.array(vectors.reshape(-1)))
    reach = neighbors._reachable_cells(pivots, cells, 5).func
    tracemalloc.start()
    found = reach(lists, pa.array(np.full(10_000, 9.0)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 10_000 and peak < 100e6
    distance = np.sqrt(((vectors[:50, None] - pivots) ** 2).sum(2))
    assert [row.as_py() for row in found[:50]] == [np.flatnonzero(d - 1 <= min(9.0, (d + 1).min())).tolist() for d in distance]


def test_neighbours_where_the_matrix_product_rounds(spark):
    """Far from the origin a product's rounding exceeds the distances between neighbours."""
    rng = np.random.default_rng(4)
    points, queries = 1e6 + rng.integers(0, 40, (300, 2)) / 1000, 1e6 + rng.integers(0, 40, (60, 2)) / 1000
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "point long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query long, vector array<double>")
    found = {(r.query, r.rank): (r.point, r.distance) for r in neighbors.nearest(q, p, k=4, block_rows=70).collect()}
    for i, v in enumerate(queries):
        distance = np.sqrt(((points - v) ** 2).sum(axis=1))
        wanted = np.lexsort((np.arange(len(points)), distance))[:4]
        assert [found[i, k + 1] for k in range(4)] == [(w, distance[w]) for w in wanted.tolist()]


def test_isolation_walks_once(spark):
    df = spark.createDataFrame([(i, float(i % 17), float(i * i % 23)) for i in range(300)], "i long, a double, b double")
    scored = isolation.isolation_scores(df, ["a", "b"], ["i"], trees=5, tree_rows=32)
    assert "EvalPython" not in scored._jdf.queryExecution().executedPlan().toString()
    tree = {"feature": [0, -1, 1, -1, -1], "cut": [3.0, 0.0, 9.0, 0.0, 0.0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "depth": [0.0, 1.5, 0.0, 2.5, 4.0]}
    vectors = pa.array([[1.0, 5.0], [3.0, 99.0], [4.0, 9.0], [4.0, 9.5], [float("nan"), float("nan")]], pa.list_(pa.float64()))
    assert isolation._depth([tree]).func(vectors).to_pylist() == [1.5, 1.5, 2.5, 4.0, 4.0]


def test_ranks_of_large_tables_take_more_parts(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") * 7 % 31).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 3 % 19).cast("double").alias("b"))
    asked = []
    inner = correlate.average_ranks
    monkeypatch.setattr(correlate, "average_ranks", lambda *a, **o: asked.append(o["parts"]) or inner(*a, **o))
    few, many = ({(r.feature, r.other): r.r for r in correlate.spearman(df, ["a", "b"], ["id"], **o).collect()} for o in ({}, {"part_rows": 60}))
    assert asked == [None, 20] and few.keys() == many.keys() and np.allclose([few[k] for k in few], [many[k] for k in few])


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Rows of one vector are one query, and no more points of it than a query can find take part."""
    met, search = [], neighbors._closest_in_cells
    monkeypatch.setattr(neighbors, "_closest_in_cells", lambda q, p, *rest: met.append((q.count(), p.count())) or search(q, p, *rest))
    points = [(i, [float(i % 4), 0.0]) for i in range(400)] + [(400, [-0.0, 0.0])]
    queries = [(i, [float(i % 3), 0.0]) for i in range(300)]
    found = neighbors.nearest(spark.createDataFrame(queries, "query long, vector array<double>"), spark.createDataFrame(points, "point long, vector array<double>"), k=5)
    assert {(r.query, r.rank): (r.point, r.distance) for r in found.collect()} == {
        (i, rank): (i % 3 + 4 * (rank - 1), 0.0) for i in range(300) for rank in range(1, 6)}
    assert met == [(3, 20)]


def test_rows_of_one_query_key_share_its_closest_points(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (2, [1.0]), (3, [8.0]), (4, [9.0])], "point long, vector array<double>")
    queries = spark.createDataFrame([(7, [0.0]), (7, [9.0]), (8, [1.0]), (8, [1.0]), (None, [9.0])], "query long, vector array<double>")
    found = sorted(((r.query or 0), r.rank, r.point, r.distance) for r in neighbors.nearest(queries, points, k=3).collect())
    assert found == [(0, 1, 4, 0.0), (0, 2, 3, 1.0), (0, 3, 2, 8.0), (7, 1, 1, 0.0), (7, 2, 4, 0.0), (7, 3, 2, 1.0),
                     (8, 1, 2, 0.0), (8, 2, 2, 0.0), (8, 3, 2, 0.0)]


def test_a_far_point_does_not_bring_a_cell_into_reach(spark):
    """The ball around a pivot grows with its farthest point on all sides, the box on one side only."""
    pivots = np.array([[0.0, 0.0], [50.0, 0.0]])
    cells = {0: {"n": 9, "radius": 2.0}, 1: {"n": 9, "radius": 900.0}}
    boxes = np.array([[-2.0, 0.0], [40.0, 0.0]]), np.array([[2.0, 0.0], [950.0, 0.0]])
    vectors = pa.array([[0.0, 0.0], [39.5, 0.0], [float("nan"), 0.0]], pa.list_(pa.float64()))
    reach = neighbors._reachable_cells(pivots, cells, 5, boxes).func
    assert reach(vectors, pa.array([1.0, 1.0, 1.0])).to_pylist()[:2] == [[0], [1]]

"""The ways taken beyond the size limits give what the plain ways give, also with a third of all rows in one group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltmes.models.isolation import tree_samples
from voltmes.operators import correlate, ordering, outliers, quantiles, splits, windows
from voltmes.operators.neighbors import nearest

N = 3000


@pytest.fixture(scope="module")
def frame():
    random = np.random.default_rng(3)
    group = np.where(random.random(N) < 0.35, "hot", np.char.add("g", random.integers(0, 40, N).astype(str)))
    value = np.where(random.random(N) < 0.33, 7.0, np.round(random.normal(0, 100, N), 1))
    pdf = pd.DataFrame({"id": np.arange(N), "grp": group, "day": random.integers(0, 200, N), "x": value, "y": random.normal(size=N)})
    pdf.loc[pdf.index % 11 == 0, "y"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def rows(spark, frame):
    df = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(6)
    return df.persist()


@pytest.fixture
def many_parts(spark):
    """Parts of a few rows, as a large table has parts of many."""
    names = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield 23
    for n, v in old.items():
        spark.conf.set(n, v)


def same(left, right, key=("id",)):
    order = list(key)
    a, b = (d.toPandas().sort_values(order).reset_index(drop=True) for d in (left, right))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False, rtol=1e-9)


def test_positions_over_the_whole_table(rows, frame, many_parts):
    placed = ordering.with_position(rows, ["day", "id"], limit=10).toPandas()
    expected = frame.sort_values(["day", "id"]).assign(position=np.arange(1, N + 1))
    merged = placed.merge(expected[["id", "position"]], on="id")
    assert (merged.position_x == merged.position_y).all() and (placed.group_size == N).all() and len(placed) == N


def test_positions_in_groups(rows, many_parts):
    same(ordering.with_position(rows, ["day", "id"], ["grp"], limit=10), ordering.with_position(rows, ["day", "id"], ["grp"]))


def test_null_group_keeps_its_rows(spark, many_parts):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", i) for i in range(5)], "g string, i int")
    placed = ordering.with_position(df, ["i"], ["g"], limit=3).toPandas()
    assert sorted(placed[placed.g.isna()].position) == list(range(1, 31)) and len(placed) == 35


def test_running_total_of_weights(rows, many_parts):
    counted = rows.groupBy("grp", "day").count()
    same(
        ordering.running_total(counted, ["day"], ["grp"], "count", limit=3),
        ordering.running_total(counted, ["day"], ["grp"], "count"), ["grp", "day"])


def test_parts_hold_about_equally_many_rows(rows, many_parts):
    sizes = [r["count"] for r in ordering.in_parts(rows, ["x", "id"]).groupBy("_part").count().collect()]
    assert len(sizes) == many_parts and sum(sizes) == N and max(sizes) < 3 * N / many_parts


def test_positions_take_one_shuffle_of_the_rows(rows, many_parts):
    placed = ordering.with_position(rows, ["day", "id"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "rangepartitioning" not in plan and "Window" not in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange")


def test_positions_of_an_empty_table(rows):
    assert ordering.with_position(rows.where("id < 0"), ["day", "id"]).count() == 0


@pytest.mark.parametrize("chunk", [12, 40])
def test_lags_in_chunks(rows, chunk):
    options = {"value": "x", "by": ["grp"], "order": ["day", "id"]}
    same(windows.lag_features(rows, **options, limit=10, chunk=chunk), windows.lag_features(rows, **options))


def test_leaking_mean_in_chunks(rows):
    lagged = windows.lag_features(rows, value="x", by=["grp"], order=["day", "id"])
    options = {"order": ["grp", "day", "id"]}
    same(windows.leaking_trailing_mean(lagged, **options, limit=10, chunk=20), windows.leaking_trailing_mean(lagged, **options))


PROBABILITIES = [0.0, 0.005, 0.25, 0.5, 0.9, 0.999, 1.0]


def test_quantiles_by_selection(rows, frame):
    found = quantiles.quantile_values(rows, ["x", "y"], PROBABILITIES, limit=10)
    for c in ("x", "y"):
        assert np.allclose(found[c], np.nanquantile(frame[c], PROBABILITIES))


def test_quantiles_by_selection_in_groups(rows):
    same(
        quantiles.quantile_rows(rows, ["x", "y"], PROBABILITIES, ["grp"], limit=10),
        quantiles.quantile_rows(rows, ["x", "y"], PROBABILITIES, ["grp"]), ["grp", "feature", "probability"])


def test_quantiles_by_selection_with_a_narrow_sketch(rows, frame, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 100)
    found = quantiles.quantile_values(rows, ["x", "y"], PROBABILITIES, limit=10)
    for c in ("x", "y"):
        assert np.allclose(found[c], np.nanquantile(frame[c], PROBABILITIES))


def test_outliers(rows):
    for by in ([], ["grp"]):
        same(
            outliers.iqr_outliers(rows, ["x", "y"], by, limit=10), outliers.iqr_outliers(rows, ["x", "y"], by), [*by, "feature"])


def test_average_ranks(rows, frame, many_parts):
    """A third of the rows hold one value, so it spans several parts."""
    placed = ordering.in_parts(rows, ["x", "id"])
    assert placed.where("x = 7").select("_part").distinct().count() > 5
    ranked = correlate.average_ranks(rows, "x", key=["id"]).toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(ranked, frame.set_index("id")["x"].rank())


def test_average_ranks_in_groups_with_nulls(rows, frame, many_parts):
    held = rows.withColumn("y", F.when(F.col("id") % 3 == 0, F.lit(-0.0)).when(F.col("id") % 5 == 0, 0.0).otherwise(F.round("y", 1)))
    plain = held.toPandas().set_index("id").sort_index()
    ranked = correlate.average_ranks(held, "y", ["grp"]).toPandas().set_index("id")["rank"].sort_index()
    expected = plain.groupby("grp")["y"].rank()
    assert expected.isna().any() and np.allclose(ranked, expected, equal_nan=True)


def test_average_ranks_of_one_value_and_of_none(spark, many_parts):
    df = spark.range(500).select("id", F.lit(3).alias("v"), F.lit(None).cast("double").alias("none"))
    assert {r["rank"] for r in correlate.average_ranks(df, "v").collect()} == {250.5}
    assert {r["rank"] for r in correlate.average_ranks(df, "none").collect()} == {None}
    assert correlate.average_ranks(df.where("id < 0"), "v").count() == 0


def test_ranks_are_not_joined_by_value(rows, many_parts):
    plan = correlate.average_ranks(rows, "x", ["grp"], key=["id"])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "_part" in joins[0] and "x#" not in joins[0]


def test_spearman_over_complete_pairs(rows, frame, many_parts):
    found = {(r.feature, r.other): r.r for r in correlate.spearman(rows, ["x", "y", "day"], ["id"]).collect()}
    expected = frame[["x", "y", "day"]].corr(method=lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1])
    assert len(found) == 9
    assert all(np.isclose(found[a, b], expected.loc[a, b]) for a in expected for b in expected)


def test_pearson_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([(float(i), 2.0, None if i == 1 else float(-i)) for i in range(5)], "a double, b double, c double")
    found = {(r.feature, r.other): r.r for r in correlate.pearson(df, ["a", "b", "c"]).collect()}
    assert found["a", "b"] is None and found["b", "b"] is None and np.isclose(found["a", "c"], -1) and found["a", "a"] == 1


def test_splits(rows):
    for make in (
        lambda **o: splits.holdout(rows, ["day", "id"], **o), lambda **o: splits.holdout(rows, ["day", "id"], ["grp"], **o),
        lambda **o: splits.random_holdout(rows, ["id"], by=["grp"], **o), lambda **o: splits.random_folds(rows, ["id"], **o),
        lambda **o: splits.contiguous_folds(rows, ["day", "id"], **o),
    ):
        same(make(limit=10), make())


def test_tree_samples_are_exact_and_repeatable(rows):
    sampled = tree_samples(rows.select("id", "x"), ["x"], ["id"], trees=7, tree_rows=50, seed=1)
    first, second = (sorted((r.tree, r.id) for r in sampled.collect()) for _ in range(2))
    assert first == second and len(set(first)) == 350
    assert {t for t, _ in first} == set(range(7))


@pytest.mark.parametrize("block", [20, 150, 100_000])
def test_nearest_neighbours_against_brute_force(spark, block):
    random = np.random.default_rng(5)
    points = random.normal(size=(400, 3))
    points[:150] = points[0]  # a third of all points are copies of one
    points[150:250] *= 30
    queries = np.concatenate([random.normal(size=(60, 3)) * 5, np.repeat(points[:1], 40, axis=0)])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "point long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query long, vector array<double>")
    found = {}
    for r in nearest(q, p, k=4, block_rows=block).collect():
        found[r.query, r.rank] = r.point
    for i, v in enumerate(queries):
        distance = np.sqrt(((points - v) ** 2).sum(axis=1))
        wanted = np.lexsort((np.arange(len(points)), distance))[:4]
        assert [found[i, k + 1] for k in range(4)] == wanted.tolist()
    assert len(found) == 400


def test_fewer_points_than_neighbours(spark):
    p = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "point long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0])], "query long, vector array<double>")
    assert [(r.point, r.rank) for r in nearest(q, p, k=5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_facts_of_few_groups_do_not_shuffle_the_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    facts = rows.groupBy("g").agg(F.max("x").alias("top"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = ordering.join_few_facts(rows, facts, ["g"]), ordering.join_few_facts(rows, facts, ["g"], most=2)
        plans = [j._jdf.queryExecution().executedPlan().toString() for j in (few, many)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "hashpartitioning" not in plans[0] and "hashpartitioning" in plans[1]
    assert few.count() == many.count() == 1000

"""The perceptron that counts equal rows against Spark ML's own."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array

from voltmes.models.perceptron import Perceptron, loss_of


def _table(spark, rows):
    """In one partition, in whole batches of Spark ML's learner, so that its loss is the plain mean."""
    return spark.createDataFrame(rows, "x array<double>, label double").coalesce(1).select(array_to_vector("x").alias("features"), "label")


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(5)
    some = [([float(a), float(b == 0), float(b == 1)], float(random.random() < 1 / (1 + np.exp(2 - 2 * abs(a))))) for a, b in zip(random.normal(0, 1, 160).round(2), random.integers(0, 2, 160))]
    return [some[i] for i in random.integers(0, 160, 1024)]


@pytest.mark.parametrize("rounds, closeness", [(0, 1e-12), (5, 1e-9), (25, 1e-6)])
def test_counted_rows_teach_the_same_weights(spark, rows, rounds, closeness):
    df = _table(spark, rows)
    wanted = MultilayerPerceptronClassifier(layers=[3, 10, 2], maxIter=rounds, seed=42).fit(df)
    found = Perceptron([3, 10, 2], rounds, 42, local_rows=100).fit(df)
    np.testing.assert_allclose(found.weights.toArray(), wanted.weights.toArray(), rtol=closeness, atol=closeness)
    if rounds:
        same = vector_to_array("probability").alias("p")
        np.testing.assert_allclose(*[np.array([r.p for r in m.transform(df).select(same).collect()]) for m in (found, wanted)], atol=closeness * 10)


def test_gradient_is_the_slope_of_the_loss():
    random = np.random.default_rng(1)
    x, many = random.normal(0, 1, (20, 3)), random.integers(0, 5, (20, 2)).astype(float) + 0.5
    loss, at = loss_of(x, many, [3, 4, 2]), random.normal(0, 1, 26)
    value, grad = loss(at)
    each = [[loss_of(x[i:i + 1], np.eye(2)[[c]], [3, 4, 2])(at)[0] for c in range(2)] for i in range(20)]
    assert abs(value - np.average(each, weights=many)) < 1e-12
    slopes = [(loss(at + step)[0] - loss(at - step)[0]) / 2e-5 for step in np.eye(26) * 1e-5]
    np.testing.assert_allclose(grad, slopes, atol=1e-8)


def test_a_large_table_takes_no_job_per_round(spark, rows):
    df = _table(spark, rows).cache()
    spark.sparkContext.setJobGroup("perceptron", "perceptron")
    Perceptron([3, 10, 2], 60, 42, local_rows=100).fit(df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("perceptron")
    spark.sparkContext._jsc.clearJobGroup()
    df.unpersist()
    assert 0 < len(jobs) < 40


def test_rows_that_cannot_be_counted_are_left_to_spark(spark, rows):
    df = _table(spark, [*rows, ([1.0, 1.0, 0.0], 2.0)])
    with pytest.raises(Exception):
        Perceptron([3, 10, 2], 3, 42, local_rows=100).fit(df).transform(df).collect()
    three = MultilayerPerceptronClassifier(layers=[3, 10, 3], maxIter=3, seed=42).fit(df)
    assert Perceptron([3, 10, 3], 3, 42).fit(df).weights == three.weights

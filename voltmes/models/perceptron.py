"""A perceptron whose equal rows are counted once.

Spark ML's own learner walks every row in each of some 500 rounds. Rows of equal inputs pass the same hidden layer, so they are one
row with a count per class: the same layers, start, loss, steps and end of the search, which one task then takes over the different
rows. The answering model is Spark ML's. (Spark ML averages over batches, the last of a partition being shorter; here all rows weigh alike.)
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from voltmes.models.grove import LOCAL_ROWS
from voltmes.session import stored

#: Different rows that one task learns from; more are left to Spark ML's learner.
DIFFERENT_ROWS = 300_000
#: Steps that the search remembers, and rows whose hidden layer is held at once.
MEMORY, AT_ONCE = 10, 4096

#: Weights to a loss and its gradient.
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Perceptron(Estimator):
    """One hidden layer of sigmoids and a softmax; beyond ``local_rows`` rows, equal ones are counted once."""

    def __init__(self, layers: Sequence[int], rounds: int, seed: int, labelCol: str = "label", featuresCol: str = "features", local_rows: int = LOCAL_ROWS):
        super().__init__()
        self.layers, self.rounds, self.seed, self.label, self.features, self.local_rows = list(layers), rounds, seed, labelCol, featuresCol, local_rows

    def spark_learner(self) -> MultilayerPerceptronClassifier:
        return MultilayerPerceptronClassifier(labelCol=self.label, featuresCol=self.features, layers=self.layers, maxIter=self.rounds, seed=self.seed)

    def _fit(self, df: DataFrame) -> Model:
        own = self.spark_learner()
        if df.count() <= self.local_rows:
            return own.fit(df)
        known = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        classes = [float(c) for c in range(self.layers[-1])]
        whole = F.col("x").isNotNull() & F.coalesce(F.col("y").isin(classes), F.lit(False))
        counted = stored(known.groupBy("x").agg(*[F.count_if(F.col("y") == c).alias(f"n{c:.0f}") for c in classes], F.count_if(~whole).alias("odd")), "counted")
        size, odd = counted.agg(F.count("*"), F.sum("odd")).first()
        if size > DIFFERENT_ROWS or odd:
            return own.fit(df)
        # Without a round, Spark ML's learner gives the model of the weights that it starts from.
        some = counted.limit(1).select(array_to_vector("x").alias(self.features), F.lit(0.0).alias(self.label))
        still = own.copy().setMaxIter(0)
        start = still.fit(some).weights.toArray()
        layers, rounds, tolerance = self.layers, self.rounds, own.getTol()

        def learned(table: pa.Table) -> pa.Table:
            x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, layers[0])
            many = np.stack([table.column(f"n{c:.0f}").to_numpy().astype(float) for c in classes], axis=1)
            order = np.lexsort(x.T)
            found = minimum(loss_of(x[order], many[order], layers), start, rounds, tolerance)
            return pa.table({"weights": pa.array([found], pa.list_(pa.float64()))})

        weights = counted.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learned, "weights array<double>").first()[0]
        return still.setInitialWeights(Vectors.dense(weights)).fit(some)


def loss_of(x: np.ndarray, many: np.ndarray, layers: Sequence[int]) -> Objective:
    """Mean cross-entropy over all rows, ``many`` of each by class, with its gradient; weights lie as in Spark ML's model."""
    inputs, hidden, classes = layers
    middle = (inputs + 1) * hidden
    share = (many / many.sum()).T
    each = share.sum(0)
    # The last input is the bias.
    columns = np.concatenate([x.T, np.ones((1, len(x)))])

    def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
        first, last = weights[:middle].reshape(inputs + 1, hidden), weights[middle:].reshape(hidden + 1, classes)
        total, of_first, of_last = 0.0, np.zeros(first.shape), np.zeros(last.shape)
        for i in range(0, len(x), AT_ONCE):
            part, wanted = np.ascontiguousarray(columns[:, i:i + AT_ONCE]), share[:, i:i + AT_ONCE]
            inner = np.ones((hidden + 1, part.shape[1]))
            sigmoid = inner[:hidden]
            np.matmul(-first.T, part, out=sigmoid)
            with np.errstate(over="ignore"):
                np.exp(sigmoid, out=sigmoid)
            sigmoid += 1
            np.reciprocal(sigmoid, out=sigmoid)
            outer = last.T @ inner
            outer -= outer.max(0)
            odds = np.exp(outer)
            sums = odds.sum(0)
            total -= float((wanted * (outer - np.log(sums))).sum())
            delta = odds / sums * each[i:i + AT_ONCE] - wanted
            of_last += inner @ delta.T
            back = last[:hidden] @ delta
            back *= sigmoid
            np.subtract(1, sigmoid, out=sigmoid)
            back *= sigmoid
            of_first += part @ back.T
        return total, np.concatenate([of_first.reshape(-1), of_last.reshape(-1)])

    return loss


# The search of Spark ML's learner: L-BFGS with a line search for the strong Wolfe conditions.

class _Failed(Exception):
    """No step was found."""


def minimum(loss: Objective, start: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Weights where the search ends: after the rounds, at a flat place, or where 20 losses hardly differ."""
    x = np.array(start, float)
    value, grad = loss(x)
    first, seen, steps, failed, done = value, deque([np.inf], 20), deque(maxlen=MEMORY), False, 0
    while done < rounds and not (len(seen) > 1 and abs(value - max(seen)) <= tolerance * first) and np.linalg.norm(grad) > max(tolerance * value, 1e-8):
        try:
            way = _direction(steps, grad)
            step, value_there, grad_there = _step(loss, x, value, grad, way, 1.0 if done else 1 / np.linalg.norm(way))
        except _Failed:
            if failed:
                break
            failed = True
            steps.clear()
            continue
        there = x + step * way
        steps.appendleft((there - x, grad_there - grad))
        x, value, grad, failed = there, value_there, grad_there, False
        seen.append(value)
        done += 1
    return x


def _direction(steps: deque, grad: np.ndarray) -> np.ndarray:
    way, shares = grad.copy(), []
    scale = 1.0
    if steps:
        moved, turned = steps[0]
        if not moved @ turned >= 0:
            raise _Failed
        scale = (moved @ turned) / (turned @ turned)
    for moved, turned in steps:
        shares.append((moved @ way) / (moved @ turned))
        if np.isnan(shares[-1]):
            raise _Failed
        way -= shares[-1] * turned
    way *= scale
    for (moved, turned), share in zip(reversed(steps), reversed(shares)):
        way += (share - (turned @ way) / (moved @ turned)) * moved
    return -way


def _between(left: tuple, right: tuple) -> float:
    """The least of the cubic through two places (step, loss, slope), not too near to either."""
    (a, fa, da), (b, fb, db) = left, right
    with np.errstate(all="ignore"):
        one = da + db - 3 * (fa - fb) / (a - b)
        two = np.sqrt(one * one - da * db)
        found = b - (b - a) * (db + two - one) / (db - da + 2 * two)
    return float(min(max(found, a + 0.1 * (b - a)), a + 0.9 * (b - a))) if not np.isnan(found) else float("nan")


def _step(loss: Objective, x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, step: float) -> tuple[float, float, np.ndarray]:
    slope = float(grad @ way)
    if slope > 0:
        raise _Failed
    grads = {}

    def at(length: float) -> tuple[float, float, float]:
        found, grads["last"] = loss(x + length * way)
        return length, found, float(grads["last"] @ way)

    def ended(place: tuple) -> tuple[float, float, np.ndarray]:
        if place[0] * np.linalg.norm(grad) < 1e-10:
            raise _Failed
        return place[0], place[1], grads["last"]

    def zoom(low: tuple, high: tuple) -> tuple[float, float, np.ndarray]:
        for _ in range(10):
            place = at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if place[1] > value + 1e-4 * place[0] * slope or place[1] >= low[1]:
                high = place
                continue
            if abs(place[2]) <= 0.9 * abs(slope):
                return ended(place)
            if place[2] * (high[0] - low[0]) >= 0:
                high = low
            low = place
        raise _Failed

    low = (0.0, value, slope)
    for i in range(10):
        place = at(step)
        if not np.isfinite(place[1]):
            step /= 2
            continue
        if place[1] > value + 1e-4 * step * slope or (place[1] >= low[1] and i > 0):
            return zoom(low, place)
        if abs(place[2]) <= 0.9 * abs(slope):
            return ended(place)
        if place[2] >= 0:
            return zoom(place, low)
        low, step = place, step * 1.5
    raise _Failed

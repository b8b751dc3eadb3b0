"""Linear fits of all expanding folds from one pass over the rows.

A fold trains on the rows before it, so its training part is a prefix of blocks that lie between the starts of the folds.
Every row adds to the cross products of its own block once; prefix sums over the blocks give the products of every fold.
The vector that is multiplied keeps known values and missing flags apart: with a fold's medians and most frequent levels the
products of the filled inputs follow from those of the flags, without another pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.models.forests import inputs_of
from voltmes.operators import splits
from voltmes.operators.ordering import with_position
from voltmes.operators.quantiles import quantiles
from voltmes.session import stored


def _block(folds: int) -> Column:
    """How many folds start at or before a positioned row; a fold is tested on the block after its own number."""
    n, at = F.col("group_size"), F.col("position") - 1
    size = F.floor(n / (folds + 1))
    return sum((F.when(at >= n - (folds - fold) * size, 1).otherwise(0) for fold in range(folds)), F.lit(0))


def _products(rows: DataFrame, vector: Column, width: int, blocks: int) -> np.ndarray:
    """Sums of the outer products of the vector by block; each task hands on one partial sum per cell."""
    def cells(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks, width, width))
        for table in tables:
            x = table.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(table), width)
            block = table.column("block").to_numpy()
            for b in np.unique(block):
                own = x[block == b]
                total[b] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["cell", "value"])

    found = rows.select("block", vector.alias("v")).mapInArrow(cells, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    whole = np.zeros(blocks * width * width)
    whole[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return whole.reshape(blocks, width, width)


def linear_folds(
    df: DataFrame, numeric: Sequence[str], truth: str = "consumo", order: Sequence[str] = ("month", "regiao"), folds: int = splits.FOLDS,
    categorical: Sequence[str] = ("regiao",),
) -> DataFrame:
    """(model, fold, truth, prediction): least squares on filled inputs and one input per level, for every expanding fold.

    Missing numbers take the training median of the fold, missing levels its most frequent one; an unseen level has none of the inputs.
    Of equally good coefficients (levels and constant depend on each other) the smallest are taken. Rows without a truth take no part in a fit.
    """
    placed = stored(with_position(df, order).withColumn("block", _block(folds).cast("int")))
    known = placed.where(F.col(truth).isNotNull())
    inputs = inputs_of(known, numeric, categorical)
    # Any shift leaves the fits as they are; one near the middle keeps the products small.
    middle = known.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in (*numeric, truth)]).first().asDict()
    medians = {(r["fold"], r["feature"]): r["quantiles"][0] for r in quantiles(
        known.where(F.col("block") < folds).select(*numeric, F.explode(F.sequence(F.col("block"), F.lit(folds - 1))).alias("fold")), numeric, [0.5], by=["fold"]).collect()}

    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x - F.lit(float(middle[c])))

    def missing(c: str) -> Column:
        return (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")

    levels = [(c, level) for c, held in inputs.levels.items() for level in held]
    ones = [F.col(c).eqNullSafe(F.lit(level)).cast("double") for c, level in levels]
    vector = F.array(F.lit(1.0), *map(value, numeric), *map(missing, numeric), *ones, *[F.col(c).isNull().cast("double") for c in categorical], value(truth))
    p, q, k = len(numeric), len(levels), len(categorical)
    width = 1 + 2 * p + q + k + 1
    prefix = _products(known.where(F.col("block") < folds), vector, width, folds).cumsum(0)

    fitted = []
    for fold in range(folds):
        products = prefix[fold]
        # Rows of the transform: constant, filled numbers, filled levels, truth.
        fill = np.zeros((1 + p + q + 1, width))
        fill[0, 0] = fill[-1, -1] = 1
        for i, c in enumerate(numeric):
            fill[1 + i, 1 + i] = 1
            fill[1 + i, 1 + p + i] = (medians.get((fold, c)) if medians.get((fold, c)) is not None else 0.0) - middle[c]
        for i, (c, _) in enumerate(levels):
            fill[1 + p + i, 1 + 2 * p + i] = 1
        for j, c in enumerate(categorical):
            own = [i for i, (name, _) in enumerate(levels) if name == c]
            if own:
                fill[1 + p + max(own, key=lambda i: (products[0, 1 + 2 * p + i], -i)), 1 + 2 * p + q + j] = 1
        filled = fill @ products @ fill.T
        n = max(filled[0, 0], 1.0)
        mean = filled[0] / n
        spread = filled / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(spread)[1:-1], 0))
        scale[scale <= 1e-9 * np.maximum(np.abs(mean[1:-1]), 1)] = np.inf
        weights = np.linalg.pinv(spread[1:-1, 1:-1] / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (spread[1:-1, -1] / scale) / scale
        # Coefficients of the vector above, with what fills the gaps.
        own = fill[1:-1].T @ weights
        own[0] += mean[-1] - mean[1:-1] @ weights + middle[truth]
        fitted.append(own[:-1])

    fold = F.col("block") - 1
    coefficients = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in own]) for own in fitted]), fold)
    answer = F.aggregate(F.zip_with(F.slice(vector, 1, width - 1), coefficients, lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    return placed.where("block > 0").select(F.lit("linear").alias("model"), fold.alias("fold"), F.col(truth), answer.alias("prediction"))

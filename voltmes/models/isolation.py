"""Isolation forest: trees on small samples, rows scored where they are.

The sample is bounded by trees x rows per tree whatever the table's size. A tree grows in one task from its
own sample; the grown trees are a few arrays that travel with the scoring function.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.operators.ordering import GROUP_LIMIT
from voltmes.operators.outliers import fill_median
from voltmes.operators.quantiles import quantile_values
from voltmes.session import stored

# Fixed values.
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.01
SEED = 42
EULER = 0.5772156649015329


def isolation_scores(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Adds ``score``, low for odd rows and below 0 for the ``contamination`` share, and ``is_outlier``.

    Missing numbers count as the column's median.
    """
    filled = fill_median(df.select(*key, *columns), columns, limit)
    samples = tree_samples(filled, columns, key, trees, tree_rows, seed)
    grown = samples.groupBy("tree").applyInPandas(_grow(columns, seed), _NODES).collect()
    rows = max((r["rows"] for r in grown), default=0)
    # The walks cost most, so they are made once, not again for each pass of the quantile.
    scored = stored(filled.withColumn("score", -F.pow(F.lit(2.0), -_depth([r.asDict() for r in grown])(F.array(*columns)) / _average_path(rows))), "scored")
    cut = quantile_values(scored, ["score"], [contamination], limit)["score"][0]
    return scored.withColumn("score", F.col("score") - F.lit(cut)).withColumn("is_outlier", F.col("score") < 0)


def tree_samples(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int, tree_rows: int, seed: int
) -> DataFrame:
    """Exactly ``tree_rows`` random rows per tree (all rows of a smaller table), chosen by a hash of the key.

    A pool of rows is drawn first, so that only the pool is hashed once per tree.
    """
    n = df.count()
    pool_share = min(1.0, 4.0 * trees * tree_rows / max(n, 1))
    pool = df.where(_uniform(F.xxhash64(F.lit(seed), *key)) < pool_share)
    expected = max(n * pool_share, 1.0)
    near = min(1.0, (tree_rows + 10 * tree_rows ** 0.5) / expected)
    lots = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), _uniform(F.xxhash64(F.lit(seed), t, *key)).alias("lot")))
    drawn = pool.select(*key, *columns, F.inline(F.filter(lots, lambda s: s["lot"] <= near)))
    order = Window.partitionBy("tree").orderBy("lot", *key)
    return drawn.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= tree_rows).drop("_at", "lot")


def _uniform(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.pmod(hashed, F.lit(1 << 53)) / float(1 << 53)


_NODES = "tree int, rows int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def _grow(columns: Sequence[str], seed: int):
    columns = list(columns)

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        number = int(sample["tree"].iloc[0])
        values = sample[columns].to_numpy(dtype=float)
        random = np.random.default_rng([seed, number])
        deepest = ceil(log2(max(len(values), 2)))
        feature, cut, left, right, depth = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            for part, empty in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (depth, level + _average_path(len(rows)))):
                part.append(empty)
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
            varied = np.flatnonzero(high > low)
            if level >= deepest or len(rows) <= 1 or not len(varied):
                return at
            feature[at] = int(random.choice(varied))
            cut[at] = float(random.uniform(low[feature[at]], high[feature[at]]))
            below = rows[:, feature[at]] <= cut[at]
            left[at] = node(rows[below], level + 1)
            right[at] = node(rows[~below], level + 1)
            return at

        node(values, 0)
        return pd.DataFrame([{
            "tree": number, "rows": len(values), "feature": feature, "cut": cut, "left": left, "right": right, "depth": depth}])

    return grow


def _average_path(rows: int) -> float:
    """Mean depth of an unsuccessful search among that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (log(rows - 1) + EULER) - 2.0 * (rows - 1) / rows


def _depth(grown: list[dict]):
    """Mean depth at which the trees isolate a row."""
    trees = [_walkable(t) for t in grown]

    @F.arrow_udf("double")
    def depth(vector: pa.Array) -> pa.Array:
        rows = len(vector)
        # Column by column, so that the value of a row's feature is at feature * rows + row.
        values = vector.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1).T.reshape(-1)
        total, every = np.zeros(rows), np.arange(rows)
        for feature, cut, child, depths, levels in trees:
            at = np.zeros(rows, dtype=np.int64)
            for _ in range(levels):
                at = child[2 * at + (values[feature[at] * rows + every] <= cut[at])]
            total += depths[at]
        return pa.array(total / len(trees))

    return depth


def _walkable(tree: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree whose leaves lead to themselves, so that all rows take as many steps as it has levels."""
    feature, left, right = (np.array(tree[k], np.int64) for k in ("feature", "left", "right"))
    own, inner = np.arange(len(feature)), feature >= 0
    child = np.stack([np.where(inner, right, own), np.where(inner, left, own)], axis=1).reshape(-1)
    levels, at = 0, np.array([0])
    while inner[at].any():
        at, levels = np.concatenate([left[at[inner[at]]], right[at[inner[at]]]]), levels + 1
    return np.maximum(feature, 0), np.array(tree["cut"], float), child, np.array(tree["depth"], float), levels

"""Time-aware and random splits, as a ``role`` column or one row per fold."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame, functions as F

from voltmes.operators.ordering import GROUP_LIMIT, with_position

# Fixed values.
TRAIN_SHARE = 0.8
FOLDS = 5
SEED = 42


def holdout(
    df: DataFrame,
    order: Sequence[str] = ("month", "regiao"),
    by: Sequence[str] = (),
    share: float = TRAIN_SHARE,
    test_rounds_down: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """First rows ``train``, last rows ``test``, in the whole table or inside each group.

    The training part has ``floor(share * n)`` rows; with ``test_rounds_down`` the test part has
    ``max(1, floor((1 - share) * n))`` rows instead.
    """
    n = F.col("group_size")
    if test_rounds_down:
        train_rows = n - F.greatest(F.lit(1), F.floor(n * round(1 - share, 10)))
    else:
        train_rows = F.floor(n * share)
    placed = with_position(df, order, by, limit)
    return placed.withColumn("role", F.when(F.col("position") <= train_rows, "train").otherwise("test"))


def _shuffled(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """A repeatable random order that depends on the row's key only."""
    return df.withColumn("_shuffle", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])))


def random_holdout(
    df: DataFrame,
    key: Sequence[str],
    test_share: float = 0.2,
    by: Sequence[str] = (),
    seed: int = SEED,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Exactly ``ceil(test_share * n)`` random test rows, of the table or of each class in ``by``."""
    placed = with_position(_shuffled(df, key, seed), ["_shuffle", *key], by, limit)
    test_rows = F.ceil(F.col("group_size") * test_share)
    return placed.withColumn("role", F.when(F.col("position") <= test_rows, "test").otherwise("train")).drop("_shuffle")


def random_folds(
    df: DataFrame, key: Sequence[str], folds: int = FOLDS, seed: int = SEED, limit: int = GROUP_LIMIT
) -> DataFrame:
    """A random ``fold`` per row; fold sizes differ by one at most."""
    placed = with_position(_shuffled(df, key, seed), ["_shuffle", *key], limit=limit)
    return placed.withColumn("fold", F.pmod(F.col("position") - 1, F.lit(folds)).cast("int")).drop("_shuffle")


def contiguous_folds(
    df: DataFrame, order: Sequence[str], folds: int = FOLDS, limit: int = GROUP_LIMIT
) -> DataFrame:
    """``fold`` by unshuffled blocks; the first ``n % folds`` blocks have one row more."""
    placed = with_position(df, order, limit=limit)
    n, at = F.col("group_size"), F.col("position") - 1
    small = F.floor(n / folds)
    longer = n % folds
    fold = F.when(at < longer * (small + 1), F.floor(at / (small + 1))).otherwise(
        longer + F.floor((at - longer * (small + 1)) / small))
    return placed.withColumn("fold", fold.cast("int"))


def expanding_role(fold: int | Column, folds: int = FOLDS) -> Column:
    """Role of a positioned row in one fold of expanding-window validation; null if it takes no part.

    Every fold tests ``n // (folds + 1)`` rows and trains on all rows before them.
    """
    n, at = F.col("group_size"), F.col("position") - 1
    fold = F.lit(fold) if isinstance(fold, int) else fold
    size = F.floor(n / (folds + 1))
    start = n - (folds - fold) * size
    return F.when(at < start, "train").when(at < start + size, "test")


def expanding_folds(
    df: DataFrame,
    order: Sequence[str] = ("month", "regiao"),
    by: Sequence[str] = (),
    folds: int = FOLDS,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per row and fold it takes part in, with ``fold`` and ``role``."""
    placed = with_position(df, order, by, limit)
    spread = placed.select("*", F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("fold"))
    return spread.withColumn("role", expanding_role(F.col("fold"), folds)).where(F.col("role").isNotNull())


def expanding_folds_by_group(
    df: DataFrame,
    by: Sequence[str] = ("regiao",),
    order: Sequence[str] = ("month",),
    folds: int = FOLDS,
    share: float = TRAIN_SHARE,
    min_rows: int = 3,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Expanding folds in groups with more rows than folds, one holdout in the others, none below ``min_rows``."""
    placed = with_position(df, order, by, limit).where(F.col("group_size") >= min_rows)
    long = F.col("group_size") > folds
    which = F.when(long, F.sequence(F.lit(0), F.lit(folds - 1))).otherwise(F.array(F.lit(0)))
    spread = placed.select("*", F.explode(which).alias("fold"))
    held = F.when(F.col("position") <= F.floor(F.col("group_size") * share), "train").otherwise("test")
    role = F.when(long, expanding_role(F.col("fold"), folds)).otherwise(held)
    return spread.withColumn("role", role).where(F.col("role").isNotNull())


def bootstrap(df: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Rows with ``copies``, how often each is drawn with replacement; rows that are not drawn are left out.

    On many rows a bootstrap draws each row a Poisson(1) number of times, independently, so no row has to know
    of another and nothing is shuffled.
    """
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    chance = F.conv(F.substring(text, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies, below = F.lit(0), 0.0
    # Until no draw of 52 bits is above.
    for drawn in range(20):
        below += exp(-1) / factorial(drawn)
        copies = copies + F.when(chance >= below, 1).otherwise(0)
    return df.withColumn("copies", copies).where(F.col("copies") > 0)

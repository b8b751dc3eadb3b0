"""Interquartile outliers, clipping and filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voltmes.functions.numbers import MAX_MAGNITUDE, is_suspicious
from voltmes.operators.ordering import GROUP_LIMIT, join_few_facts
from voltmes.operators.quantiles import group_quantiles, quantile_values

# Fixed values.
IQR_FACTOR = 1.5
CLIP_SHARES = (0.005, 0.995)


def iqr_outliers(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), limit: int = GROUP_LIMIT
) -> DataFrame:
    """Per feature (and group): quartiles, fences, number of values beyond them and number of values.

    A feature without values gives no row.
    """
    shares = [0.25, 0.75]
    if by:
        fenced = join_few_facts(df.select(*by, *columns), group_quantiles(df, columns, shares, by, limit), by)
    else:
        found = quantile_values(df, columns, shares, limit)
        fenced = df.select(*columns, *[
            F.array(*[F.lit(v).cast("double") for v in found[c]]).alias(f"{c}__q") for c in columns])

    def fences(c: str) -> tuple[Column, Column]:
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[1]
        return q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)

    def counts(c: str) -> list[Column]:
        lower, upper = fences(c)
        outside = F.count_if((F.col(c) < lower) | (F.col(c) > upper))
        return [outside.alias(f"{c}__out"), F.count(c).alias(f"{c}__n"), F.first(f"{c}__q").alias(f"{c}__q")]

    counted = fenced.groupBy(*by).agg(*[made for c in columns for made in counts(c)])

    def row(c: str) -> Column:
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[1]
        lower, upper = fences(c)
        return F.struct(
            F.lit(c).alias("feature"), q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
            lower.alias("lower"), upper.alias("upper"), F.col(f"{c}__out").alias("n_outliers"),
            F.col(f"{c}__n").alias("total"))

    return counted.select(*by, F.inline(F.array(*[row(c) for c in columns]))).where(F.col("total") > 0)


def clip_bounds(
    df: DataFrame, column: str, shares: Sequence[float] = CLIP_SHARES, limit: int = GROUP_LIMIT
) -> tuple[float, float]:
    low, high = quantile_values(df, [column], shares, limit)[column]
    return low, high


def winsorize(
    df: DataFrame,
    column: str,
    out: str,
    train: DataFrame,
    shares: Sequence[float] = CLIP_SHARES,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Clips to the quantiles of the training rows; null stays null."""
    low, high = clip_bounds(train, column, shares, limit)
    x = F.col(column)
    return df.withColumn(out, F.when(x < low, low).when(x > high, high).otherwise(x))


def fill_median(df: DataFrame, columns: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    medians = quantile_values(df, columns, [0.5], limit)
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double")) for c in columns})


def parse_audit(df: DataFrame, text: str, loose: str, strict: str) -> DataFrame:
    """How many texts look odd, parse, are absurdly large, and survive each parse rule."""
    return df.agg(
        F.count_if(is_suspicious(F.col(text))).alias("n_weird"),
        F.count_if(F.col(loose).isNull()).alias("n_unparsed"),
        F.count_if(F.abs(F.col(loose)) > MAX_MAGNITUDE).alias("n_too_large"),
        F.count(loose).alias("kept_loose"),
        F.count(strict).alias("kept_strict"),
        (F.count(loose) - F.count(strict)).alias("n_dropped"),
    )

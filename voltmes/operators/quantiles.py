"""Exact quantiles with linear interpolation, whole or per group, at any size.

A group proven small uses ``percentile``, which keeps the group's values in one buffer. Beyond the limit a
mergeable sketch brackets each wanted rank; one more pass counts the values below each bracket by task and
shuffles only the distinct values inside the brackets, which are then ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voltmes.operators.ordering import GROUP_LIMIT, join_few_facts, largest_group, running_total
from voltmes.session import stored

SKETCH_ACCURACY = 10_000


def melted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per value: the kept columns, ``feature`` and ``value`` without nulls."""
    numbers = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot(list(keep), list(columns), "feature", "value").where(F.col("value").isNotNull())


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rows ``(*by, feature, quantiles)`` with an array in the order of the probabilities.

    A feature without values has no row.
    """
    if largest_group(df, by) <= limit:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        return melted(df, columns, by).groupBy(*by, "feature").agg(F.percentile("value", wanted).alias("quantiles"))
    return _selected(df, columns, probabilities, list(by), limit)


def quantile_rows(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), limit: int = GROUP_LIMIT
) -> DataFrame:
    """One row per group, feature and probability."""
    found = quantiles(df, columns, probabilities, by, limit)
    cells = [F.struct(F.lit(float(p)).alias("probability"), F.col("quantiles")[i].alias("value"))
             for i, p in enumerate(probabilities)]
    return found.select(*by, "feature", F.inline(F.array(*cells)))


def quantile_values(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = GROUP_LIMIT
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as plain numbers, as many as columns times probabilities."""
    found = {row["feature"]: list(row["quantiles"]) for row in quantiles(df, columns, probabilities, limit=limit).collect()}
    return {c: found.get(c, [None] * len(probabilities)) for c in columns}


def group_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str], limit: int = GROUP_LIMIT
) -> DataFrame:
    """One row per group with a ``<column>__q`` array per column."""
    found = quantiles(df, columns, probabilities, by, limit)
    return found.groupBy(*by).agg(*[
        F.first(F.when(F.col("feature") == c, F.col("quantiles")), ignorenulls=True).alias(f"{c}__q") for c in columns])


def _selected(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: list[str], limit: int
) -> DataFrame:
    # Four sketch errors around each rank, more in groups so small that this is less than a few rows.
    margins = (4.0 / SKETCH_ACCURACY, 0.05, 1.0)
    low = [max(0.0, p - margin) for margin in margins for p in probabilities]
    high = [min(1.0, p + margin) for margin in margins for p in probabilities]
    targets = range(len(probabilities))

    narrow = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    brackets = narrow.groupBy(*by).agg(*[
        F.struct(
            F.percentile_approx(c, low, SKETCH_ACCURACY).alias("low"),
            F.percentile_approx(c, high, SKETCH_ACCURACY).alias("high"),
            F.count(c).alias("n"),
        ).alias(f"{c}__bracket") for c in columns])
    marked = _with_brackets(narrow, brackets, by)

    # A value below its bracket is only counted: it leaves as a null, which sorts first.
    def cell(c: str, i: int) -> Column:
        bracket = F.col(f"{c}__bracket")
        skipped = F.when(bracket["n"] >= SKETCH_ACCURACY, 0).when(bracket["n"] >= 100, 1).otherwise(2)
        at = skipped * len(probabilities) + i
        inside = F.when(F.col(c) >= F.get(bracket["low"], at), F.col(c))
        return F.when(F.col(c) <= F.get(bracket["high"], at), F.struct(
            F.lit(c).alias("feature"), F.lit(i).alias("target"), bracket["n"].alias("n"), inside.alias("value")))

    cells = F.filter(F.array(*[cell(c, i) for c in columns for i in targets]), lambda s: s.isNotNull())
    group = [*by, "feature", "target"]
    candidates = stored(marked.select(*by, F.inline(cells)).groupBy(*group, "n", "value").count(), "quantiles")
    ranked = running_total(candidates, ["value"], group, "count", "through", "_kept", limit)

    rank = F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("target")) * (F.col("n") - 1)

    def at(wanted: Column) -> Column:
        here = (F.col("through") > wanted) & (F.col("through") - F.col("count") <= wanted)
        return F.max(F.when(here, F.col("value")))

    picked = ranked.groupBy(*group).agg(
        at(F.floor(rank)).alias("first"), at(F.ceil(rank)).alias("last"), F.max(rank - F.floor(rank)).alias("share"))
    missed = F.raise_error(F.lit("quantile sketch missed a wanted rank")).cast("double")
    value = F.when(F.col("first").isNull() | F.col("last").isNull(), missed).otherwise(
        F.col("first") + F.col("share") * (F.col("last") - F.col("first")))
    return picked.groupBy(*by, "feature").agg(
        F.array(*[F.max(F.when(F.col("target") == i, value)) for i in targets]).alias("quantiles"))


def _with_brackets(df: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the brackets of its group; those of the whole table come as literals."""
    if by:
        return join_few_facts(df, brackets, by)
    found = brackets.first()

    def literal(bracket) -> Column:
        ends = [F.array(*[F.lit(v).cast("double") for v in bracket[end] or []]).alias(end) for end in ("low", "high")]
        return F.struct(*ends, F.lit(bracket["n"]).alias("n"))

    return df.select("*", *[literal(found[name]).alias(name) for name in brackets.columns])

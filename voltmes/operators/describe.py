"""Summary statistics of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voltmes.functions.numbers import parse_ptbr
from voltmes.operators.ordering import GROUP_LIMIT, join_facts
from voltmes.operators.quantiles import melted, quantiles


def numeric_columns(df: DataFrame, skip: Sequence[str] = ("ano", "mes")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_kinds(df: DataFrame, skip: Sequence[str] = ("ano", "mes")) -> dict[str, list[str]]:
    """Numeric and categorical feature columns by type."""
    numeric = numeric_columns(df, skip)
    return {"numeric": numeric, "categorical": [c for c in df.columns if c not in numeric and c not in skip]}


def columns_with(df: DataFrame, fragments: Sequence[str]) -> list[str]:
    """Columns whose name has one of the fragments in it."""
    return [c for c in df.columns if any(f in c for f in fragments)]


def auto_numeric(df: DataFrame) -> DataFrame:
    """Text columns in which at least one value parses as a number become numeric; one pass finds them."""
    texts = text_columns(df)
    if not texts:
        return df
    parsed = df.agg(*[F.count(parse_ptbr(F.col(c))).alias(c) for c in texts]).first()
    return df.withColumns({c: parse_ptbr(F.col(c)) for c in texts if parsed[c] > 0})


def corrected_skewness(column: Column | str) -> Column:
    """Bias-corrected G1, 0 for constant values; null below three rows."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.coalesce(F.skewness(column), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(column: Column | str) -> Column:
    """Bias-corrected excess G2, 0 for constant values; null below four rows."""
    n = F.count(column).cast("double")
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6)
    return F.when(n > 3, F.coalesce(g2, F.lit(0.0)))


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes, skew and kurtosis per feature.

    Values are unpivoted first: seven aggregates over one column compile to far less code than seven per column.
    """
    value = "value"
    return melted(df, columns, by).groupBy(*by, "feature").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        corrected_skewness(value).alias("skew"), corrected_kurtosis(value).alias("kurtosis"))


def describe(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), limit: int = GROUP_LIMIT
) -> DataFrame:
    """Per feature: count, mean, sample deviation, min, quartiles, max, skew and kurtosis."""
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75], by, limit)
    both = join_facts(moments(df, columns, by), quarters, [*by, "feature"])
    names = [F.col("quantiles")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))]
    return both.select(*by, "feature", "count", "mean", "std", "min", *names, "max", "skew", "kurtosis")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_null")) for c in columns]
    return counted.select(F.inline(F.array(*cells)))


def row_and_column_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))

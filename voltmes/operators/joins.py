"""Joins that build the panel and check its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voltmes.functions.numbers import exact_mean, exact_sum
from voltmes.operators.ordering import GROUP_LIMIT
from voltmes.operators.quantiles import quantile_values

PANEL_KEYS = ("mes_ano", "regiao")


def join_panel(consumption: DataFrame, weather: DataFrame, keys: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Month x region cells known on both sides. No hint: the sizes seen at run time choose the join."""
    return consumption.join(weather, list(keys), "inner")


def with_region(stations: DataFrame, station_uf: DataFrame, uf_region: DataFrame) -> DataFrame:
    """State and region of each station row; a station without an entry keeps null."""
    return stations.join(station_uf, "codigo", "left").join(uf_region, "uf", "left")


def weather_by_region(
    station_months: DataFrame,
    by: Sequence[str] = PANEL_KEYS,
    sums: Sequence[str] = ("dias_chuva", "precip_mm"),
    means: Sequence[str] = ("pressao_mb", "temp_c", "vento_max", "vento_med"),
) -> DataFrame:
    """Rain is summed over a region's stations (0 if none reports), the rest is averaged over those that report."""
    return station_months.groupBy(*by).agg(
        *[F.coalesce(exact_sum(F.col(c)), F.lit(0.0)).alias(c) for c in sums],
        *[exact_mean(F.col(c)).alias(c) for c in means],
    )


def consumption_by_region(bills: DataFrame, value: str = "consumo", by: Sequence[str] = PANEL_KEYS) -> DataFrame:
    return bills.groupBy(*by).agg(exact_sum(F.col(value)).alias("consumo"))


def with_population(
    panel: DataFrame, population: DataFrame, limit: int = GROUP_LIMIT, out: str = "pop_2022"
) -> DataFrame:
    """Population of the row's region; the median over the known regions where it is missing."""
    middle = quantile_values(population, ["populacao"], [0.5], limit)["populacao"][0]
    known = population.select("regiao", F.col("populacao").cast("double").alias(out))
    return panel.join(known, "regiao", "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(middle).cast("double")))


def per_thousand(panel: DataFrame, value: str = "consumo", population: str = "pop_2022") -> DataFrame:
    return panel.withColumn("consumo_per_1000hab", F.try_divide(F.col(value), F.col(population) / 1000))


def key_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Distinct keys on both sides, only on the left, only on the right: one full join of distinct keys."""
    mine = left.select(*keys).distinct().withColumn("_left", F.lit(True))
    theirs = right.select(*keys).distinct().withColumn("_right", F.lit(True))
    both = mine.join(theirs, list(keys), "full")
    return both.agg(
        F.count_if(F.col("_left").isNotNull() & F.col("_right").isNotNull()).alias("n_both"),
        F.count_if(F.col("_right").isNull()).alias("n_left_only"),
        F.count_if(F.col("_left").isNull()).alias("n_right_only"),
    )


def reattach(rows: DataFrame, predictions: DataFrame, key: Sequence[str], column: str = "prediction") -> DataFrame:
    """Predictions back on the rows they belong to; a row without one gets null."""
    return rows.join(predictions.select(*key, column), list(key), "left")

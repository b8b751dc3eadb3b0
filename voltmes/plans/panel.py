"""The month x region panel of the supplied tables.

A customer is a metered household, an order its bill; a supplier is a weather station in its nation's state,
a line item one of its readings. Line items are aggregated to station months before anything is joined, so
only that aggregate and the bills of residential customers are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.functions.dates import distinct_days, first_day, month_of, month_text, season_of, year_of
from voltmes.functions.numbers import exact_mean, exact_sum
from voltmes.operators.joins import consumption_by_region, join_panel, weather_by_region, with_region

RESIDENTIAL = "HOUSEHOLD"
MEASURES = ["dias_chuva", "precip_mm", "pressao_mb", "temp_c", "vento_max", "vento_med"]
NUMBERS = ["consumo", *MEASURES]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uf_region(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("uf"), F.col("r_name").alias("regiao"), F.col("n_nationkey"))


def station_uf(spark: SparkSession, folder: str) -> DataFrame:
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("codigo"), F.col("n_name").alias("uf"))


def meters(spark: SparkSession, folder: str, segment: str | None = RESIDENTIAL) -> DataFrame:
    """Customers with their region, of one class of consumer or of all."""
    customer = table(spark, folder, "customer")
    if segment:
        customer = customer.where(F.col("c_mktsegment") == segment)
    regions = uf_region(spark, folder)
    return customer.join(regions, customer.c_nationkey == regions.n_nationkey).select(
        "c_custkey", "c_mktsegment", "uf", "regiao")


def bills(spark: SparkSession, folder: str, segment: str | None = RESIDENTIAL) -> DataFrame:
    """One row per order with meter, region and month."""
    orders = table(spark, folder, "orders")
    known = meters(spark, folder, segment)
    return orders.join(known, orders.o_custkey == known.c_custkey).select(
        F.col("o_orderkey").alias("conta"), F.col("c_custkey").alias("medidor"), "uf", "regiao",
        month_text(F.col("o_orderdate")).alias("mes_ano"), F.col("o_totalprice").alias("consumo"))


def meter_months(spark: SparkSession, folder: str) -> DataFrame:
    """Consumption per residential meter and month."""
    sums = consumption_by_region(bills(spark, folder), by=("medidor", "regiao", "mes_ano"))
    return sums.withColumn("month", first_day(F.col("mes_ano")))


def station_months(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly readings per station; pressure is missing in February."""
    lines = table(spark, folder, "lineitem")
    read = (
        lines.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(
            distinct_days(F.col("l_shipdate")).cast("double").alias("dias_chuva"),
            exact_sum(F.col("l_quantity"), 2).alias("precip_mm"),
            (exact_mean(F.col("l_extendedprice"), 2) / 100).alias("pressao_mb"),
            (20 + 100 * exact_mean(F.col("l_discount"), 2)).alias("temp_c"),
            (100 * F.max("l_tax")).alias("vento_max"),
            (100 * exact_mean(F.col("l_tax"), 2)).alias("vento_med"),
        )
        .withColumn("pressao_mb", F.when(F.month("month") != 2, F.col("pressao_mb")))
    )
    return read.select(
        F.col("l_suppkey").cast("string").alias("codigo"), month_text(F.col("month")).alias("mes_ano"),
        *[F.round(c, 9).alias(c) for c in MEASURES])


def located_station_months(spark: SparkSession, folder: str) -> DataFrame:
    regions = uf_region(spark, folder).select("uf", "regiao")
    return with_region(station_months(spark, folder), station_uf(spark, folder), regions)


def weather(spark: SparkSession, folder: str) -> DataFrame:
    return weather_by_region(located_station_months(spark, folder))


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "month": first_day(F.col("mes_ano")),
        "ano": year_of(F.col("mes_ano")),
        "mes": month_of(F.col("mes_ano")),
    }).withColumn("estacao", season_of(F.col("mes")))


def build_panel(spark: SparkSession, folder: str) -> DataFrame:
    consumption = consumption_by_region(bills(spark, folder))
    return with_calendar(join_panel(consumption, weather(spark, folder)))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel, kept for the several passes that statistics and fits make over it."""
    return build_panel(spark, folder).persist()


# The same tables in SQL.
UF_SQL = "uf AS (SELECT n_name AS uf, r_name AS regiao, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"
STATION_SQL = """
st AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS codigo, strftime(l_shipdate, '%Y-%m') AS mes_ano,
    round(CAST(count(DISTINCT CAST(l_shipdate AS DATE)) AS DOUBLE), 9) AS dias_chuva,
    round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 9) AS precip_mm,
    round(CASE WHEN max(month(l_shipdate)) <> 2
      THEN CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100 END, 9) AS pressao_mb,
    round(20 + 100 * (CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*)), 9) AS temp_c,
    round(100 * max(l_tax), 9) AS vento_max,
    round(100 * (CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*)), 9) AS vento_med
  FROM lineitem GROUP BY 1, 2),
su AS (SELECT CAST(s_suppkey AS VARCHAR) AS codigo, n_name AS uf FROM supplier JOIN nation ON s_nationkey = n_nationkey),
lst AS (SELECT st.*, su.uf, uf.regiao FROM st LEFT JOIN su ON st.codigo = su.codigo LEFT JOIN uf ON su.uf = uf.uf)
"""
BILL_SQL = """
bill AS (
  SELECT o_orderkey AS conta, c_custkey AS medidor, uf, regiao, strftime(o_orderdate, '%Y-%m') AS mes_ano, o_totalprice AS consumo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN uf ON c_nationkey = n_nationkey
  WHERE c_mktsegment = 'HOUSEHOLD')
"""


def _mean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,9))) AS DOUBLE) / count({c}) AS {c}"


WEATHER_SQL = f"""
we AS (
  SELECT mes_ano, regiao,
    coalesce(CAST(sum(CAST(dias_chuva AS DECIMAL(28,9))) AS DOUBLE), 0) AS dias_chuva,
    coalesce(CAST(sum(CAST(precip_mm AS DECIMAL(28,9))) AS DOUBLE), 0) AS precip_mm,
    {", ".join(_mean(c) for c in MEASURES[2:])}
  FROM lst GROUP BY 1, 2)
"""
CONSUMPTION_SQL = """
co AS (SELECT mes_ano, regiao, CAST(sum(CAST(consumo AS DECIMAL(28,9))) AS DOUBLE) AS consumo FROM bill GROUP BY 1, 2)
"""
PANEL_SQL = f"""
WITH {UF_SQL}, {STATION_SQL}, {BILL_SQL}, {WEATHER_SQL}, {CONSUMPTION_SQL},
panel AS (
  SELECT co.mes_ano, co.regiao, consumo, dias_chuva, precip_mm, pressao_mb, temp_c, vento_max, vento_med,
    CAST(co.mes_ano || '-01' AS DATE) AS month,
    CAST(substr(co.mes_ano, 1, 4) AS INTEGER) AS ano, CAST(substr(co.mes_ano, 6, 2) AS INTEGER) AS mes,
    CASE WHEN CAST(substr(co.mes_ano, 6, 2) AS INTEGER) IN (12, 1, 2) THEN 'Verão'
         WHEN CAST(substr(co.mes_ano, 6, 2) AS INTEGER) IN (3, 4, 5) THEN 'Outono'
         WHEN CAST(substr(co.mes_ano, 6, 2) AS INTEGER) IN (6, 7, 8) THEN 'Inverno'
         ELSE 'Primavera' END AS estacao
  FROM co JOIN we ON co.mes_ano = we.mes_ano AND co.regiao = we.regiao),
mm AS (
  SELECT medidor, regiao, mes_ano, CAST(sum(CAST(consumo AS DECIMAL(28,9))) AS DOUBLE) AS consumo,
    CAST(mes_ano || '-01' AS DATE) AS month
  FROM bill GROUP BY ALL)
"""

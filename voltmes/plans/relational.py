"""Filters, joins, roll-ups, windows, sorts and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.functions.advice import Thresholds, recommend
from voltmes.functions.dates import first_day, month_of, season_of, year_of
from voltmes.operators import joins, windows
from voltmes.operators.describe import columns_with
from voltmes.operators.ordering import top_rows
from voltmes.plans import panel as p
from voltmes.plans.panel import BILL_SQL, CONSUMPTION_SQL, PANEL_SQL, STATION_SQL, UF_SQL, WEATHER_SQL
from voltmes.plans.registry import query, r, rounded, rs
from voltmes.session import stored

# Regions of the supplied tables that stand in for the rainy ones.
WET_REGIONS = Thresholds(hydro_regions=("africa", "asia"))
# Fixed value: rows of the recommendation sample.
SAMPLE_ROWS = 200

LAG_SQL = PANEL_SQL + """,
lagged AS (
  SELECT *, lag(consumo, 1) OVER w AS lag1, lag(consumo, 12) OVER w AS lag12,
    avg(consumo) OVER (PARTITION BY regiao ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3
  FROM panel WINDOW w AS (PARTITION BY regiao ORDER BY month))
"""
METER_LAG_SQL = PANEL_SQL + """,
lagged AS (
  SELECT *, lag(consumo, 1) OVER w AS lag1, lag(consumo, 12) OVER w AS lag12,
    avg(consumo) OVER (PARTITION BY medidor ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3
  FROM mm WINDOW w AS (PARTITION BY medidor ORDER BY month))
"""
FEATURES = ["ano", "mes", "lag1", "lag12", "roll3", "temp_c", "precip_mm", "pressao_mb", "vento_med"]
WIDE_FEATURES = ["ano", "mes", "lag1", "lag12", "roll3", "precip_mm", "pressao_mb", "temp_c", "vento_max", "vento_med"]


def lagged_panel(spark: SparkSession, folder: str) -> DataFrame:
    return windows.lag_features(p.panel(spark, folder))


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose target, lags and trailing mean are all known."""
    return lagged_panel(spark, folder).na.drop(subset=["consumo", "lag1", "lag12", "roll3"])


@query("filter_segment", f"""
WITH {UF_SQL}, {BILL_SQL} SELECT conta, medidor, uf, regiao, mes_ano, {r('consumo')} FROM bill""")
def filter_segment(spark, folder):
    return rounded(p.bills(spark, folder))


@query("dropna_keys", """
SELECT c_custkey AS medidor, mes_ano, regiao FROM (
  SELECT c_custkey, strftime(o_orderdate, '%Y-%m') AS mes_ano, r_name AS regiao
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
WHERE mes_ano IS NOT NULL AND regiao IS NOT NULL""")
def dropna_keys(spark, folder):
    customer, orders = p.table(spark, folder, "customer"), p.table(spark, folder, "orders")
    known = customer.join(orders, customer.c_custkey == orders.o_custkey, "left")
    known = known.join(p.uf_region(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return known.select(
        F.col("c_custkey").alias("medidor"), F.date_format("o_orderdate", "yyyy-MM").alias("mes_ano"), "regiao",
    ).na.drop(subset=["mes_ano", "regiao"])


@query("panel_target", f"""
WITH {UF_SQL}, {BILL_SQL}, {CONSUMPTION_SQL} SELECT mes_ano, regiao, {r('consumo')} FROM co""")
def panel_target(spark, folder):
    return rounded(joins.consumption_by_region(p.bills(spark, folder)))


@query("station_month", f"""
WITH {UF_SQL}, {STATION_SQL}
SELECT codigo, mes_ano, {rs('dias_chuva precip_mm pressao_mb temp_c vento_max vento_med', 9)} FROM st""")
def station_month(spark, folder):
    return rounded(p.station_months(spark, folder), 9)


@query("dim_region", f"""
WITH {UF_SQL}, {STATION_SQL} SELECT codigo, mes_ano, uf, regiao, {r('precip_mm')} FROM lst""")
def dim_region(spark, folder):
    return rounded(p.located_station_months(spark, folder).select("codigo", "mes_ano", "uf", "regiao", "precip_mm"))


@query("weather_rollup", f"""
WITH {UF_SQL}, {STATION_SQL}, {WEATHER_SQL}
SELECT mes_ano, regiao, {rs('dias_chuva precip_mm pressao_mb temp_c vento_max vento_med')} FROM we""")
def weather_rollup(spark, folder):
    return rounded(p.weather(spark, folder))


@query("panel_join", f"""{PANEL_SQL}
SELECT mes_ano, month, ano, mes, estacao, regiao,
  {rs('consumo dias_chuva precip_mm pressao_mb temp_c vento_max vento_med')} FROM panel""")
def panel_join(spark, folder):
    return rounded(p.build_panel(spark, folder))


@query("year_month", f"""
WITH {UF_SQL}, {BILL_SQL}
SELECT conta, CAST(substr(mes_ano, 1, 4) AS INTEGER) AS ano, CAST(substr(mes_ano, 6, 2) AS INTEGER) AS mes FROM bill""")
def year_month(spark, folder):
    month = F.col("mes_ano")
    return p.bills(spark, folder).select("conta", year_of(month).alias("ano"), month_of(month).alias("mes"))


@query("month_date", """
SELECT o_orderkey AS conta, TRY_CAST(t || '-01' AS DATE) AS month FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y') || '-13'
    ELSE strftime(o_orderdate, '%Y-%m') END AS t FROM orders)""")
def month_date(spark, folder):
    """Orders in process carry a month that does not exist."""
    orders = p.table(spark, folder, "orders")
    broken = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13"))
    text = F.when(F.col("o_orderstatus") == "P", broken).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return orders.select(F.col("o_orderkey").alias("conta"), first_day(text).alias("month"))


@query("season", """
SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Verão' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Outono'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Inverno' ELSE 'Primavera' END AS estacao, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS consumo FROM orders GROUP BY 1""")
def season(spark, folder):
    orders = p.table(spark, folder, "orders")
    return orders.groupBy(season_of(F.month("o_orderdate")).alias("estacao")).agg(
        F.count("*").alias("n"), p.exact_sum(F.col("o_totalprice"), 2).alias("consumo"))


RECOMMEND_SQL = f"""
WITH {UF_SQL}, {STATION_SQL}, adv AS (
SELECT codigo, mes_ano, regiao, precip_mm, temp_c, vento_med,
  concat_ws('; ', CASE WHEN vento_med >= 6 THEN 'Eólica' END,
    CASE WHEN precip_mm >= 200 AND lower(regiao) IN ('africa', 'asia')
      THEN 'Hidrelétrica / Pequenas Centrais Hidrelétricas (PCH)' END,
    CASE WHEN precip_mm < 100 AND temp_c >= 22 THEN 'Solar fotovoltaica' END) AS rec FROM lst)
SELECT codigo, mes_ano, regiao, {rs('precip_mm temp_c vento_med')},
  CASE WHEN rec = '' THEN 'Solar fotovoltaica (padrão)' ELSE rec END AS recomendacao FROM adv"""


def _recommended(spark, folder):
    stations = p.located_station_months(spark, folder)
    advice = recommend(F.col("regiao"), F.col("precip_mm"), F.col("temp_c"), F.col("vento_med"), WET_REGIONS)
    return rounded(stations.select("codigo", "mes_ano", "regiao", "precip_mm", "temp_c", "vento_med", advice.alias("recomendacao")))


@query("recommend", RECOMMEND_SQL)
def recommended(spark, folder):
    return _recommended(spark, folder)


@query("recommend_sample", RECOMMEND_SQL + f" ORDER BY mes_ano, regiao, codigo LIMIT {SAMPLE_ROWS}")
def recommend_sample(spark, folder):
    return top_rows(_recommended(spark, folder), ["mes_ano", "regiao", "codigo"], SAMPLE_ROWS)


@query("select_fragment", f"""{PANEL_SQL} SELECT mes_ano, regiao, {rs('temp_c precip_mm')} FROM panel""")
def select_fragment(spark, folder):
    panel = p.build_panel(spark, folder)
    return rounded(panel.select("mes_ano", "regiao", *columns_with(panel, ["temp", "precip"])))


# Windows.

@query("lag1", f"{LAG_SQL} SELECT mes_ano, regiao, {rs('consumo lag1')} FROM lagged")
def lag1(spark, folder):
    return rounded(lagged_panel(spark, folder).select("mes_ano", "regiao", "consumo", "lag1"))


@query("lag12", f"{LAG_SQL} SELECT mes_ano, regiao, {rs('consumo lag12')} FROM lagged")
def lag12(spark, folder):
    return rounded(lagged_panel(spark, folder).select("mes_ano", "regiao", "consumo", "lag12"))


@query("roll3", f"{LAG_SQL} SELECT mes_ano, regiao, {r('consumo')}, {r('roll3', 4)} FROM lagged")
def roll3(spark, folder):
    return rounded(lagged_panel(spark, folder).select("mes_ano", "regiao", "consumo", "roll3"), roll3=4)


@query("roll3_compat", f"""{LAG_SQL}
SELECT mes_ano, regiao, {r('avg(lag1) OVER (ORDER BY regiao, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4, 'roll3_compat')}
FROM lagged""")
def roll3_compat(spark, folder):
    leaked = windows.leaking_trailing_mean(lagged_panel(spark, folder))
    return rounded(leaked.select("mes_ano", "regiao", "roll3_compat"), 4)


@query("lags_by_meter", f"""{METER_LAG_SQL}
SELECT medidor, mes_ano, {rs('consumo lag1 lag12')}, {r('roll3', 4)} FROM lagged""")
def lags_by_meter(spark, folder):
    lagged = windows.lag_features(stored(p.meter_months(spark, folder)), by=["medidor"])
    return rounded(lagged.select("medidor", "mes_ano", "consumo", "lag1", "lag12", "roll3"), roll3=4)


@query("features", f"""{LAG_SQL}
SELECT mes_ano, regiao, ano, mes, {rs('consumo lag1 lag12 temp_c precip_mm pressao_mb vento_med')}, {r('roll3', 4)} FROM lagged""")
def features(spark, folder):
    return rounded(lagged_panel(spark, folder).select("mes_ano", "regiao", "consumo", *FEATURES), roll3=4)


@query("features_wide", f"""{LAG_SQL}
SELECT mes_ano, regiao, ano, mes, {rs('lag1 lag12 precip_mm pressao_mb temp_c vento_max vento_med')}, {r('roll3', 4)} FROM lagged""")
def features_wide(spark, folder):
    lagged = lagged_panel(spark, folder)
    found = columns_with(lagged, ["temp", "precip", "pressao", "vento"])
    return rounded(lagged.select("mes_ano", "regiao", *[c for c in WIDE_FEATURES if c not in p.NUMBERS or c in found]), roll3=4)


@query("prepared_rows", f"""{LAG_SQL}
SELECT mes_ano, regiao, {rs('consumo lag1 lag12')}, {r('roll3', 4)} FROM lagged
WHERE consumo IS NOT NULL AND lag1 IS NOT NULL AND lag12 IS NOT NULL AND roll3 IS NOT NULL""")
def prepared_rows(spark, folder):
    return rounded(prepared(spark, folder).select("mes_ano", "regiao", "consumo", "lag1", "lag12", "roll3"), roll3=4)


# Population.

POPULATION_SQL = """
pop AS (
  SELECT r_name AS regiao, count(DISTINCT c_custkey) AS populacao FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'EUROPE' GROUP BY 1)
"""


def population(spark: SparkSession, folder: str) -> DataFrame:
    """Inhabitants per region; one region has no census."""
    everyone = p.meters(spark, folder, segment=None)
    return everyone.where(F.col("regiao") != "EUROPE").groupBy("regiao").agg(F.count_distinct("c_custkey").alias("populacao"))


def populated(spark: SparkSession, folder: str) -> DataFrame:
    return joins.with_population(p.build_panel(spark, folder), population(spark, folder))


@query("pop_join", f"""{PANEL_SQL}, {POPULATION_SQL}
SELECT mes_ano, panel.regiao, populacao FROM panel LEFT JOIN pop ON panel.regiao = pop.regiao""")
def pop_join(spark, folder):
    return p.build_panel(spark, folder).join(population(spark, folder), "regiao", "left").select("mes_ano", "regiao", "populacao")


@query("pop_fill", f"""{PANEL_SQL}, {POPULATION_SQL}
SELECT mes_ano, panel.regiao, {r('CAST(coalesce(populacao, (SELECT quantile_cont(populacao, 0.5) FROM pop)) AS DOUBLE)', 6, 'pop_2022')}
FROM panel LEFT JOIN pop ON panel.regiao = pop.regiao""")
def pop_fill(spark, folder):
    return rounded(populated(spark, folder).select("mes_ano", "regiao", "pop_2022"))


POP_FEATURES_SQL = f"""{PANEL_SQL}, {POPULATION_SQL}, filled AS (
SELECT mes_ano, panel.regiao, consumo, CAST(coalesce(populacao, (SELECT quantile_cont(populacao, 0.5) FROM pop)) AS DOUBLE) AS pop_2022
FROM panel LEFT JOIN pop ON panel.regiao = pop.regiao)
"""


@query("per_capita", f"""{POP_FEATURES_SQL}
SELECT mes_ano, regiao, {r('consumo / (pop_2022 / 1000)', 4, 'consumo_per_1000hab')} FROM filled""")
def per_capita(spark, folder):
    made = joins.per_thousand(populated(spark, folder))
    return rounded(made.select("mes_ano", "regiao", "consumo_per_1000hab"), 4)


@query("pop_features", f"""{POP_FEATURES_SQL}
SELECT mes_ano, regiao, {rs('consumo pop_2022')}, {r('consumo / (pop_2022 / 1000)', 4, 'consumo_per_1000hab')} FROM filled""")
def pop_features(spark, folder):
    made = joins.per_thousand(populated(spark, folder))
    return rounded(made.select("mes_ano", "regiao", "consumo", "pop_2022", "consumo_per_1000hab"), consumo_per_1000hab=4)


# Keys, sorts, limits, unions.

@query("key_coverage", f"""
WITH {UF_SQL}, {STATION_SQL}, {BILL_SQL}, a AS (SELECT DISTINCT mes_ano, regiao FROM bill), b AS (SELECT DISTINCT mes_ano, regiao FROM lst)
SELECT count(*) FILTER (WHERE a.mes_ano IS NOT NULL AND b.mes_ano IS NOT NULL) AS n_both,
  count(*) FILTER (WHERE b.mes_ano IS NULL) AS n_left_only, count(*) FILTER (WHERE a.mes_ano IS NULL) AS n_right_only
FROM a FULL JOIN b ON a.mes_ano = b.mes_ano AND a.regiao = b.regiao""")
def key_coverage(spark, folder):
    return joins.key_coverage(p.bills(spark, folder), p.located_station_months(spark, folder))


@query("reattach", f"""{LAG_SQL}
SELECT panel.mes_ano, panel.regiao, {r('panel.consumo', 6, 'consumo')}, {r('lag12', 6, 'prediction')}
FROM panel LEFT JOIN (SELECT * FROM lagged WHERE lag12 IS NOT NULL) x ON panel.mes_ano = x.mes_ano AND panel.regiao = x.regiao""")
def reattach(spark, folder):
    panel = p.panel(spark, folder)
    predictions = windows.lag_features(panel).where(F.col("lag12").isNotNull()).withColumnRenamed("lag12", "prediction")
    return rounded(joins.reattach(panel.select("mes_ano", "regiao", "consumo"), predictions, ["mes_ano", "regiao"]))


@query("distinct_regions", f"""
WITH {UF_SQL}, {BILL_SQL} SELECT DISTINCT regiao FROM bill WHERE regiao IS NOT NULL ORDER BY 1""")
def distinct_regions(spark, folder):
    return p.bills(spark, folder).where(F.col("regiao").isNotNull()).select("regiao").distinct().orderBy("regiao")


@query("sort_panel", f"""
WITH {UF_SQL}, {BILL_SQL}, {CONSUMPTION_SQL} SELECT regiao, mes_ano, {r('consumo')} FROM co ORDER BY regiao, mes_ano""")
def sort_panel(spark, folder):
    return rounded(joins.consumption_by_region(p.bills(spark, folder))).orderBy("regiao", "mes_ano")


@query("sort_time", f"""
WITH {UF_SQL}, {BILL_SQL}, {CONSUMPTION_SQL} SELECT mes_ano, regiao, {r('consumo')} FROM co ORDER BY mes_ano, regiao""")
def sort_time(spark, folder):
    return rounded(joins.consumption_by_region(p.bills(spark, folder))).orderBy("mes_ano", "regiao")


@query("topk", "SELECT o_orderkey AS conta, o_totalprice AS consumo FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, folder):
    orders = p.table(spark, folder, "orders").select(F.col("o_orderkey").alias("conta"), F.col("o_totalprice").alias("consumo"))
    return top_rows(orders, [F.desc("consumo"), "conta"], 20)


@query("head_n", f"""{LAG_SQL}
SELECT mes_ano, regiao, {rs('consumo lag1 lag12')}, {r('roll3', 4)} FROM lagged ORDER BY regiao, month LIMIT 10""")
def head_n(spark, folder):
    first = top_rows(lagged_panel(spark, folder), ["regiao", "month"], 10)
    return rounded(first.select("mes_ano", "regiao", "consumo", "lag1", "lag12", "roll3"), roll3=4)


@query("union_by_name", f"""
WITH {UF_SQL}, {STATION_SQL}
SELECT codigo, mes_ano, {r('dias_chuva')}, {r('precip_mm')} FROM lst WHERE regiao <> 'ASIA'
UNION ALL SELECT codigo, mes_ano, NULL AS dias_chuva, {r('precip_mm')} FROM lst WHERE regiao = 'ASIA'""")
def union_by_name(spark, folder):
    """Stations of one region do not report rain days."""
    stations = stored(p.located_station_months(spark, folder))
    full = stations.where(F.col("regiao") != "ASIA").select("codigo", "mes_ano", "dias_chuva", "precip_mm")
    short = stations.where(F.col("regiao") == "ASIA").select("precip_mm", "mes_ano", "codigo")
    return rounded(full.unionByName(short, allowMissingColumns=True))

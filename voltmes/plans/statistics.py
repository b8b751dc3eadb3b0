"""Descriptive statistics, correlations, outliers and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmes.operators import correlate, describe, histogram, outliers, quantiles
from voltmes.plans import panel as p
from voltmes.plans.panel import MEASURES, NUMBERS, PANEL_SQL, STATION_SQL, UF_SQL
from voltmes.plans.registry import query, r, rounded
from voltmes.session import stored
from voltmes.sources.census import population_by_region

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(prefix: str, source: str, columns: list[str], by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    parts = [
        f"""SELECT {lead}'{c}' AS feature, count({c}) AS count, {r(f'avg({c})', 4, 'mean')}, {r(f'stddev_samp({c})', 4, 'std')},
  {r(f'min({c})', 4, 'min')}, {r(f'quantile_cont({c}, 0.25)', 4, 'q25')}, {r(f'quantile_cont({c}, 0.5)', 4, 'q50')},
  {r(f'quantile_cont({c}, 0.75)', 4, 'q75')}, {r(f'max({c})', 4, 'max')}, {r(f'skewness({c})', 4, 'skew')},
  {r(f'kurtosis({c})', 4, 'kurtosis')} FROM {source}{group}"""
        for c in columns
    ]
    return prefix + " UNION ALL ".join(parts)


@query("describe", _describe_sql(PANEL_SQL, "panel", NUMBERS))
def describe_panel(spark, folder):
    return rounded(describe.describe(p.panel(spark, folder), NUMBERS), 4)


@query("describe_by_region", _describe_sql(PANEL_SQL, "panel", NUMBERS, "regiao"))
def describe_by_region(spark, folder):
    return rounded(describe.describe(p.panel(spark, folder), NUMBERS, by=["regiao"]), 4)


@query("describe_readings", _describe_sql("", "lineitem", LINE_NUMBERS))
def describe_readings(spark, folder):
    return rounded(describe.describe(p.table(spark, folder, "lineitem"), LINE_NUMBERS), 4)


@query("skew_kurt", PANEL_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'skewness({c})', 6, 'skew')}, {r(f'kurtosis({c})', 6, 'kurtosis')} FROM panel" for c in NUMBERS))
def skew_kurt(spark, folder):
    panel = p.build_panel(spark, folder)
    wide = panel.agg(*[
        F.struct(F.lit(c).alias("feature"), describe.corrected_skewness(c).alias("skew"), describe.corrected_kurtosis(c).alias("kurtosis")).alias(c)
        for c in NUMBERS])
    return rounded(wide.select(F.inline(F.array(*NUMBERS))))


PERCENTS = [0.5, 0.9, 0.95, 0.99, 0.999]


@query("quantiles", " UNION ALL ".join(
    f"SELECT 'o_totalprice' AS feature, {q}::DOUBLE AS probability, {r(f'quantile_cont(o_totalprice, {q})', 4, 'value')} FROM orders" for q in PERCENTS))
def quantiles_of_bills(spark, folder):
    return rounded(quantiles.quantile_rows(p.table(spark, folder, "orders"), ["o_totalprice"], PERCENTS), 4)


@query("quantiles_by_region", PANEL_SQL + " UNION ALL ".join(
    f"SELECT regiao, '{c}' AS feature, {q}::DOUBLE AS probability, {r(f'quantile_cont({c}, {q})', 4, 'value')} FROM panel GROUP BY regiao"
    for c in NUMBERS for q in PERCENTS))
def quantiles_by_region(spark, folder):
    return rounded(quantiles.quantile_rows(p.panel(spark, folder), NUMBERS, PERCENTS, by=["regiao"]), 4)


def _iqr_sql(prefix: str, source: str, columns: list[str], by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    join = f"b.{by} = s.{by}" if by else "true"
    parts = []
    for c in columns:
        bounds = f"SELECT {lead}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}{group}"
        parts.append(f"""SELECT {f's.{by} AS {by}, ' if by else ''}'{c}' AS feature, {r('max(q1)', 6, 'q1')}, {r('max(q3)', 6, 'q3')},
  {r('max(q3 - q1)', 6, 'iqr')}, {r('max(q1 - 1.5 * (q3 - q1))', 5, 'lower')}, {r('max(q3 + 1.5 * (q3 - q1))', 5, 'upper')},
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers, count({c}) AS total
  FROM {source} s JOIN ({bounds}) b ON {join} WHERE {c} IS NOT NULL{f' GROUP BY s.{by}' if by else ''}""")
    return prefix + " UNION ALL ".join(parts)


@query("iqr_global", _iqr_sql(PANEL_SQL, "panel", NUMBERS))
def iqr_global(spark, folder):
    return rounded(outliers.iqr_outliers(p.panel(spark, folder), NUMBERS), lower=5, upper=5)


@query("iqr_region", f"""{PANEL_SQL}, b AS ({' UNION ALL '.join(
    f"SELECT s.regiao, '{c}' AS feature, count({c}) AS n, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers "
    f"FROM panel s JOIN (SELECT regiao, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM panel GROUP BY 1) q ON q.regiao = s.regiao GROUP BY 1"
    for c in NUMBERS)})
SELECT * FROM b WHERE n > 0""")
def iqr_region(spark, folder):
    found = outliers.iqr_outliers(p.panel(spark, folder), NUMBERS, by=["regiao"])
    return found.select("regiao", "feature", F.col("total").alias("n"), "n_outliers")


@query("iqr_readings", _iqr_sql("", "lineitem", LINE_NUMBERS, "l_returnflag"))
def iqr_readings(spark, folder):
    found = outliers.iqr_outliers(p.table(spark, folder, "lineitem"), LINE_NUMBERS, by=["l_returnflag"])
    return rounded(found, lower=5, upper=5)


def _pairs_sql(corr) -> str:
    parts = []
    for a in NUMBERS:
        for b in NUMBERS:
            value = "1.0::DOUBLE AS r" if a == b else r(corr(a, b), 6, "r")
            parts.append(f"SELECT '{a}' AS feature, '{b}' AS other, {value} FROM panel")
    return " UNION ALL ".join(parts)


@query("corr_pearson", PANEL_SQL + " SELECT feature, other, max(r) AS r FROM (" + _pairs_sql(lambda a, b: f"corr({a}, {b}) OVER ()") + ") GROUP BY ALL")
def corr_pearson(spark, folder):
    return rounded(correlate.pearson(p.build_panel(spark, folder), NUMBERS))


def _spearman_sql(source: str, columns: list[str]) -> str:
    parts = []
    for a in columns:
        for b in columns:
            if a == b:
                parts.append(f"SELECT '{a}' AS feature, '{b}' AS other, 1.0::DOUBLE AS r")
            else:
                parts.append(f"""SELECT '{a}' AS feature, '{b}' AS other, {r('corr(ra, rb)', 6, 'r')} FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
    rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("corr_spearman", PANEL_SQL + _spearman_sql("panel", NUMBERS))
def corr_spearman(spark, folder):
    return rounded(correlate.spearman(p.panel(spark, folder), NUMBERS, key=["mes_ano", "regiao"]))


@query("corr_spearman_stations", f"WITH {UF_SQL}, {STATION_SQL} " + _spearman_sql("st", MEASURES))
def corr_spearman_stations(spark, folder):
    return rounded(correlate.spearman(stored(p.station_months(spark, folder)), MEASURES, key=["codigo", "mes_ano"]))


@query("null_counts", PANEL_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM panel" for c in NUMBERS))
def null_counts(spark, folder):
    return describe.null_counts(p.build_panel(spark, folder), NUMBERS)


@query("row_counts", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def row_counts(spark, folder):
    return describe.row_and_column_counts(p.table(spark, folder, "lineitem"))


@query("pop_pick", """
WITH y AS (
  SELECT r_name AS regiao, year(o_orderdate) AS ano, count(DISTINCT c_custkey) AS populacao
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE NOT (r_name = 'ASIA' AND year(o_orderdate) = 1998) GROUP BY 1, 2)
SELECT regiao, coalesce(max(populacao) FILTER (WHERE ano = 1998), arg_max(populacao, ano)) AS populacao FROM y GROUP BY 1""")
def pop_pick(spark, folder):
    """Active meters per year stand for the census rows; one region lacks the wanted year."""
    everyone = p.bills(spark, folder, segment=None).withColumn("ano", F.substring("mes_ano", 1, 4).cast("int"))
    rows = everyone.where((F.col("regiao") != "ASIA") | (F.col("ano") != 1998)).groupBy("regiao", "ano").agg(
        F.count_distinct("medidor").alias("populacao"))
    return population_by_region(rows.withColumn("at", F.struct("ano")), year=1998)


@query("histogram", """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 40 AS w FROM orders),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / w) AS BIGINT), 39) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT bin, """ + r("lo + bin * w", 4, "left_edge") + ", " + r("lo + (bin + 1) * w", 4, "right_edge") + ", n FROM b, e")
def histogram_of_bills(spark, folder):
    return rounded(histogram.histogram(p.table(spark, folder, "orders"), "o_totalprice", bins=40), 4)


@query("histogram_auto", PANEL_SQL + """, s AS (
  SELECT min(temp_c) AS lo, max(temp_c) AS hi, count(temp_c) AS n,
    2 * (quantile_cont(temp_c, 0.75) - quantile_cont(temp_c, 0.25)) / pow(count(temp_c), 1.0 / 3) AS fd FROM panel),
e AS (SELECT lo, hi, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), fd)) AS BIGINT) AS bins FROM s),
g AS (SELECT lo, bins, (hi - lo) / bins AS w FROM e),
b AS (SELECT least(CAST(floor((temp_c - lo) / w) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM panel, g GROUP BY 1)
SELECT bin, """ + r("lo + bin * w", 4, "left_edge") + ", " + r("lo + (bin + 1) * w", 4, "right_edge") + ", n FROM b, g")
def histogram_auto(spark, folder):
    return rounded(histogram.histogram(p.panel(spark, folder), "temp_c"), 4)


@query("density", PANEL_SQL + """, s AS (
  SELECT count(temp_c) AS n, min(temp_c) AS lo, (max(temp_c) - min(temp_c)) / 199 AS step, stddev_samp(temp_c) * pow(count(temp_c), -0.2) AS h FROM panel)
SELECT CAST(i AS INTEGER) AS point, """ + r("lo + i * step", 6, "x") + ", " + r(
    "sum(exp(-pow((lo + i * step - temp_c) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))", 6, "density") + """
FROM range(200) g(i), s, panel GROUP BY i, lo, step, n, h""")
def density(spark, folder):
    return rounded(histogram.density(p.panel(spark, folder), "temp_c"))


#: The target and the weather whose distributions are looked at first.
KEYS = ["consumo", "temp_c", "precip_mm", "vento_med"]
KEYS_SQL = PANEL_SQL + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM panel WHERE {c} IS NOT NULL" for c in KEYS) + ")"


@query("histogram_keys", KEYS_SQL + """, s AS (
  SELECT feature, min(v) AS lo, max(v) AS hi, count(v) AS n, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(v), 1.0 / 3) AS fd FROM v GROUP BY 1),
e AS (SELECT feature, lo, hi, CASE WHEN hi = lo THEN 1 ELSE CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), CASE WHEN fd > 0 THEN fd ELSE hi - lo END)) AS BIGINT) END AS bins FROM s),
g AS (SELECT feature, lo, bins, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / bins END AS w FROM e),
b AS (SELECT feature, least(CAST(floor((v - lo) / w) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM v JOIN g USING (feature) GROUP BY 1, 2)
SELECT feature, bin, """ + r("lo + bin * w", 4, "left_edge") + ", " + r("lo + (bin + 1) * w", 4, "right_edge") + ", n FROM b JOIN g USING (feature)")
def histogram_keys(spark, folder):
    """Automatic histograms of all key columns, counted in one pass."""
    return rounded(histogram.histograms(p.panel(spark, folder), KEYS), 4)


@query("density_keys", KEYS_SQL + """, s AS (
  SELECT feature, count(v) AS n, min(v) AS lo, (max(v) - min(v)) / 199 AS step, stddev_samp(v) AS sd, stddev_samp(v) * pow(count(v), -0.2) AS h FROM v GROUP BY 1)
SELECT feature, CAST(i AS INTEGER) AS point, """ + r("lo + i * step", 4, "x") + ", " + r(
    "sd * sum(exp(-pow((lo + i * step - v) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))", 6, "density") + """
FROM range(200) g(i), s JOIN v USING (feature) GROUP BY feature, i, lo, step, n, h, sd""")
def density_keys(spark, folder):
    """Densities of all key columns, per standard deviation so that they compare."""
    rows = p.panel(spark, folder)
    spreads = F.create_map(*[x for c, s in zip(KEYS, rows.agg(*[F.stddev_samp(c) for c in KEYS]).first()) for x in (F.lit(c), F.lit(s))])
    found = histogram.densities(rows, KEYS)
    return rounded(found.withColumn("density", F.col("density") * spreads[F.col("feature")]), x=4)


ORDER_KINDS = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
    "o_orderdate": "categorical", "o_orderpriority": "categorical",
}


@query("profile_types", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{kind}' AS kind, count({c}) AS n FROM orders" for c, kind in ORDER_KINDS.items()))
def profile_types(spark, folder):
    """Columns by kind, with the number of values in each."""
    orders = p.table(spark, folder, "orders")
    kinds = describe.column_kinds(orders)
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col(c).alias("n"))
        for kind, names in (("numeric", kinds["numeric"]), ("categorical", kinds["categorical"])) for c in names]
    return orders.agg(*[F.count(c).alias(c) for c in orders.columns]).select(F.inline(F.array(*cells)))

"""Splits, folds and scores, with the last month and the same month last year as predictions."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.models.ensembles import mean_vote
from voltmes.operators import metrics, splits
from voltmes.operators.windows import lag_features
from voltmes.plans import panel as p
from voltmes.plans.panel import PANEL_SQL
from voltmes.plans.registry import query, r, rounded
from voltmes.plans.relational import LAG_SQL, METER_LAG_SQL, lagged_panel, prepared
from voltmes.session import stored

NAIVE = {"last_month": "lag1", "last_year": "lag12"}


@query("holdout_time", f"""{PANEL_SQL}
SELECT mes_ano, regiao, row_number() OVER (ORDER BY month, regiao) AS position,
  CASE WHEN row_number() OVER (ORDER BY month, regiao) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS role FROM panel""")
def holdout_time(spark, folder):
    return splits.holdout(p.panel(spark, folder)).select("mes_ano", "regiao", "position", "role")


@query("holdout_region_last", f"""{LAG_SQL}, kept AS (SELECT * FROM lagged WHERE lag12 IS NOT NULL)
SELECT mes_ano, regiao,
  CASE WHEN row_number() OVER (ORDER BY regiao, month) <= count(*) OVER () - greatest(1, floor(0.2 * count(*) OVER ())) THEN 'train' ELSE 'test' END AS role
FROM kept""")
def holdout_region_last(spark, folder):
    """The compatible split: rows ordered by region first, the test part rounded down."""
    placed = splits.holdout(prepared(spark, folder), order=("regiao", "month"), test_rounds_down=True)
    return placed.select("mes_ano", "regiao", "role")


@query("holdout_region", f"""{PANEL_SQL}
SELECT mes_ano, regiao, CASE WHEN row_number() OVER w <= floor(0.8 * count(*) OVER (PARTITION BY regiao)) THEN 'train' ELSE 'test' END AS role
FROM panel WINDOW w AS (PARTITION BY regiao ORDER BY month)""")
def holdout_region(spark, folder):
    placed = splits.holdout(p.panel(spark, folder), order=("month",), by=("regiao",))
    return placed.select("mes_ano", "regiao", "role")


@query("holdout_bills", """
SELECT o_orderkey AS conta, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position,
  CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS role FROM orders""")
def holdout_bills(spark, folder):
    orders = p.table(spark, folder, "orders").select(F.col("o_orderkey").alias("conta"), "o_orderdate")
    return splits.holdout(orders, order=("o_orderdate", "conta")).select("conta", "position", "role")


@query("holdout_random", """
SELECT o_orderkey AS conta, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS role FROM orders""")
def holdout_random(spark, folder):
    orders = p.table(spark, folder, "orders").select(F.col("o_orderkey").alias("conta"))
    return splits.random_holdout(orders, ["conta"]).select("conta", "role")


@query("holdout_stratified", """
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id)
  <= ceil(0.35 * count(*) OVER (PARTITION BY quality)) THEN 'test' ELSE 'train' END AS role FROM labels""")
def holdout_stratified(spark, folder):
    labels = p.table(spark, folder, "labels")
    return splits.random_holdout(labels, ["doc_id"], 0.35, by=["quality"]).select("doc_id", "quality", "role")


@query("kfold", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def kfold(spark, folder):
    return splits.random_folds(p.table(spark, folder, "labels"), ["doc_id"]).select("doc_id", "fold")


@query("contiguous_folds", """
SELECT o_orderkey AS conta, CAST(ntile(5) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS fold FROM orders""")
def contiguous_folds(spark, folder):
    orders = p.table(spark, folder, "orders").select(F.col("o_orderkey").alias("conta"), "o_orderdate")
    return splits.contiguous_folds(orders, ["o_orderdate", "conta"]).select("conta", "fold")


_POISSON = [sum(exp(-1) / factorial(i) for i in range(drawn + 1)) for drawn in range(20)]


@query("bootstrap", """
WITH u AS (SELECT o_orderkey AS conta, CAST('0x' || substr(md5('42|' || o_orderkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM orders),
c AS (SELECT conta, """ + " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INTEGER)" for x in _POISSON) + """ AS copies FROM u)
SELECT conta, CAST(copies AS INTEGER) AS copies FROM c WHERE copies > 0""")
def bootstrap(spark, folder):
    orders = p.table(spark, folder, "orders").select(F.col("o_orderkey").alias("conta"))
    return splits.bootstrap(orders, ["conta"])


TSCV_SQL = f"""{LAG_SQL}, pos AS (
  SELECT *, row_number() OVER (ORDER BY month, regiao) - 1 AS ix, count(*) OVER () AS n FROM lagged),
cv AS (
  SELECT pos.*, CAST(i AS INTEGER) AS fold, CASE WHEN ix < n - (5 - i) * (n // 6) THEN 'train' WHEN ix < n - (4 - i) * (n // 6) THEN 'test' END AS role
  FROM pos, range(5) f(i))
"""


@query("tscv", f"{TSCV_SQL} SELECT mes_ano, regiao, fold, role FROM cv WHERE role IS NOT NULL")
def tscv(spark, folder):
    return splits.expanding_folds(p.panel(spark, folder)).select("mes_ano", "regiao", "fold", "role")


@query("tscv_region", f"""{LAG_SQL}, pos AS (
  SELECT *, row_number() OVER (PARTITION BY regiao ORDER BY month) - 1 AS ix, count(*) OVER (PARTITION BY regiao) AS n FROM lagged),
cv AS (
  SELECT pos.*, CAST(i AS INTEGER) AS fold, CASE WHEN ix < n - (5 - i) * (n // 6) THEN 'train' WHEN ix < n - (4 - i) * (n // 6) THEN 'test' END AS role
  FROM pos, range(5) f(i) WHERE n > 5
  UNION ALL SELECT pos.*, 0 AS fold, CASE WHEN ix < floor(0.8 * n) THEN 'train' ELSE 'test' END AS role FROM pos WHERE n BETWEEN 3 AND 5)
SELECT mes_ano, regiao, fold, role FROM cv WHERE role IS NOT NULL""")
def tscv_region(spark, folder):
    return splits.expanding_folds_by_group(p.panel(spark, folder)).select("mes_ano", "regiao", "fold", "role")


@query("tscv_meter", """
WITH mm AS (
  SELECT o_custkey AS medidor, strftime(o_orderdate, '%Y-%m') AS mes_ano FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY medidor ORDER BY mes_ano) - 1 AS ix, count(*) OVER (PARTITION BY medidor) AS n FROM mm),
cv AS (
  SELECT pos.*, CAST(i AS INTEGER) AS fold, CASE WHEN ix < n - (5 - i) * (n // 6) THEN 'train' WHEN ix < n - (4 - i) * (n // 6) THEN 'test' END AS role
  FROM pos, range(5) f(i) WHERE n > 5
  UNION ALL SELECT pos.*, 0 AS fold, CASE WHEN ix < floor(0.8 * n) THEN 'train' ELSE 'test' END AS role FROM pos WHERE n BETWEEN 3 AND 5)
SELECT medidor, mes_ano, fold, role FROM cv WHERE role IS NOT NULL""")
def tscv_meter(spark, folder):
    folds = splits.expanding_folds_by_group(stored(p.meter_months(spark, folder)), by=["medidor"])
    return folds.select("medidor", "mes_ano", "fold", "role")


@query("small_groups", """
WITH mm AS (
  SELECT o_custkey AS medidor, strftime(o_orderdate, '%Y-%m') AS mes_ano FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY ALL)
SELECT medidor, count(*) AS n, CASE WHEN count(*) < 12 THEN 'too_small' ELSE '' END AS notes FROM mm GROUP BY 1""")
def small_groups(spark, folder):
    sizes = p.meter_months(spark, folder).groupBy("medidor").agg(F.count("*").alias("n"))
    note = F.when(F.col("n") < metrics.MIN_REGION_ROWS, metrics.TOO_SMALL).otherwise("")
    return sizes.select("medidor", "n", note.alias("notes"))


# Scores.

def _score_sql(y: str = "consumo", e: str = "consumo - prediction") -> str:
    return f"""count(*) AS n, {r(f'avg(abs({e}))', 2, 'mae')}, {r(f'avg(pow({e}, 2))', -4, 'mse')},
  {r(f'sqrt(avg(pow({e}, 2)))', 2, 'rmse')}, {r(f'1 - avg(pow({e}, 2)) / var_pop({y})', 6, 'r2')}"""


def shown_scores(df: DataFrame) -> DataFrame:
    """Scores rounded to the digits that any order of summation agrees on."""
    return rounded(df, 2, mse=-4, r2=6, cv_r2=6, hold_r2=6, r2_mean=6)


def naive(spark: SparkSession, folder: str) -> DataFrame:
    return lagged_panel(spark, folder).withColumn("prediction", F.col("lag12"))


@query("metrics_global", f"{LAG_SQL} SELECT {_score_sql(e='consumo - lag12')} FROM lagged WHERE lag12 IS NOT NULL")
def metrics_global(spark, folder):
    return shown_scores(metrics.regression_metrics(naive(spark, folder)))


@query("metrics_region", f"""{LAG_SQL}
SELECT regiao, {_score_sql(e='consumo - lag12')} FROM lagged WHERE lag12 IS NOT NULL GROUP BY 1
UNION ALL SELECT 'TOTAL', {_score_sql(e='consumo - lag12')} FROM lagged WHERE lag12 IS NOT NULL""")
def metrics_region(spark, folder):
    return shown_scores(metrics.metrics_with_total(naive(spark, folder)))


@query("metrics_meter", f"""{METER_LAG_SQL}
SELECT {_score_sql(e='consumo - lag1')} FROM lagged WHERE lag1 IS NOT NULL""")
def metrics_meter(spark, folder):
    lagged = lag_features(stored(p.meter_months(spark, folder)), by=["medidor"])
    return shown_scores(metrics.regression_metrics(lagged.withColumn("prediction", F.col("lag1"))))


@query("region_holdout", f"""{LAG_SQL}, pos AS (
  SELECT *, lag12 AS prediction, row_number() OVER (PARTITION BY regiao ORDER BY month) AS ix, count(*) OVER (PARTITION BY regiao) AS n FROM lagged)
SELECT regiao, max(n) AS n, {_score_sql().split(',', 1)[1]}, '' AS notes FROM pos WHERE ix > floor(0.8 * n) GROUP BY 1""")
def region_holdout(spark, folder):
    placed = splits.holdout(naive(spark, folder), order=("month",), by=("regiao",))
    return shown_scores(metrics.region_metrics(placed))


def fold_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows of every fold with each naive prediction."""
    tests = splits.expanding_folds(lagged_panel(spark, folder)).where(F.col("role") == "test")
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction")) for m, c in NAIVE.items()])
    return tests.select("fold", "regiao", "mes_ano", "consumo", F.inline(each))


FOLD_SQL = f"""{TSCV_SQL}, pred AS (
  SELECT fold, consumo, 'last_month' AS model, lag1 AS prediction FROM cv WHERE role = 'test'
  UNION ALL SELECT fold, consumo, 'last_year', lag12 FROM cv WHERE role = 'test'),
pf AS (
  SELECT model, fold, avg(abs(consumo - prediction)) AS mae, avg(pow(consumo - prediction, 2)) AS mse,
    1 - avg(pow(consumo - prediction, 2)) / var_pop(consumo) AS r2 FROM pred WHERE prediction IS NOT NULL GROUP BY ALL),
board AS (
  SELECT model, {r('avg(mae)', 2, 'mae_mean')}, {r('avg(sqrt(mse))', 2, 'rmse_mean')}, {r('avg(r2)', 6, 'r2_mean')},
    {r('sqrt(avg(mse))', 2, 'rmse_of_mean_mse')} FROM pf GROUP BY 1)
"""


@query("metrics_folds", f"{FOLD_SQL} SELECT * FROM board")
def metrics_folds(spark, folder):
    return shown_scores(metrics.fold_means(fold_predictions(spark, folder)))


@query("leaderboard", f"{FOLD_SQL} SELECT * FROM board ORDER BY mae_mean")
def leaderboard(spark, folder):
    return metrics.leaderboard(shown_scores(metrics.fold_means(fold_predictions(spark, folder))), by="mae_mean")


@query("best_model", f"{FOLD_SQL} SELECT * FROM board ORDER BY mae_mean LIMIT 1")
def best_model(spark, folder):
    return metrics.best_model(shown_scores(metrics.fold_means(fold_predictions(spark, folder))), by="mae_mean")


@query("vote_mean", f"""{LAG_SQL}
SELECT mes_ano, regiao, {r('(lag1 + lag12 + roll3) / 3', 3, 'prediction')} FROM lagged
WHERE lag1 IS NOT NULL AND lag12 IS NOT NULL AND roll3 IS NOT NULL""")
def vote_mean(spark, folder):
    rows = prepared(spark, folder)
    return rounded(rows.select("mes_ano", "regiao", mean_vote(["lag1", "lag12", "roll3"]).alias("prediction")), 3)


# Classes: a document's quality judged by its length.

CLASS_SQL = """
WITH judged AS (SELECT labels.doc_id, quality AS label, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS prediction
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)
"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    documents = p.table(spark, folder, "documents").select("doc_id", "n_chars")
    return p.table(spark, folder, "labels").join(documents, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("prediction"))


@query("confusion", CLASS_SQL + "SELECT label, prediction AS predicted, count(*) AS n FROM judged GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(judged(spark, folder))


def _class_metrics_sql(classes: str) -> str:
    return f"""t AS (
  SELECT c AS class, count(*) FILTER (WHERE label = c AND prediction = c) AS tp, count(*) FILTER (WHERE label <> c AND prediction = c) AS fp,
    count(*) FILTER (WHERE label = c AND prediction <> c) AS fn, count(*) FILTER (WHERE label <> c AND prediction <> c) AS tn
  FROM judged, (SELECT DISTINCT unnest([label, prediction]) AS c FROM judged) GROUP BY c),
s AS (SELECT {classes} AS spec FROM t)
SELECT {r('100.0 * sum(tp) / sum(tp + fn)', 6, 'accuracy')}, {r('100 * avg(CASE WHEN 2*tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END)', 6, 'f1')},
  {r('100 * avg(CASE WHEN tp+fp > 0 THEN 1.0::DOUBLE*tp/(tp+fp) ELSE 0 END)', 6, 'precision')},
  {r('100 * avg(CASE WHEN tp+fn > 0 THEN 1.0::DOUBLE*tp/(tp+fn) ELSE 0 END)', 6, 'recall')},
  {r('100 * (SELECT spec FROM s)', 6, 'specificity')} FROM t"""


BINARY_SPECIFICITY = "arg_max(CASE WHEN tn+fp > 0 THEN 1.0::DOUBLE*tn/(tn+fp) ELSE 0 END, class)"
MACRO_SPECIFICITY = "avg(CASE WHEN tn+fp > 0 THEN 1.0::DOUBLE*tn/(tn+fp) ELSE 0 END)"


@query("class_metrics", CLASS_SQL + ", " + _class_metrics_sql(BINARY_SPECIFICITY))
def class_metrics(spark, folder):
    return rounded(metrics.classification_metrics(judged(spark, folder)))


GRADE_SQL = """
WITH judged AS (
  SELECT labels.doc_id, quality + 2 * toxic AS label, CASE WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS prediction
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)
"""


def graded(spark: SparkSession, folder: str) -> DataFrame:
    """Four classes, one of them never predicted."""
    documents = p.table(spark, folder, "documents").select("doc_id", "n_chars")
    size = F.when(F.col("n_chars") >= 2000, 3).when(F.col("n_chars") >= 500, 1).otherwise(0)
    return p.table(spark, folder, "labels").join(documents, "doc_id").select(
        "doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("label"), size.alias("prediction"))


@query("class_metrics_many", GRADE_SQL + ", " + _class_metrics_sql(MACRO_SPECIFICITY))
def class_metrics_many(spark, folder):
    return rounded(metrics.classification_metrics(graded(spark, folder)))


@query("specificity", CLASS_SQL + f""", t AS (
  SELECT c AS class, count(*) FILTER (WHERE label <> c AND prediction = c) AS fp, count(*) FILTER (WHERE label <> c AND prediction <> c) AS tn
  FROM judged, (SELECT DISTINCT unnest([label, prediction]) AS c FROM judged) GROUP BY c)
SELECT {r(BINARY_SPECIFICITY, 6, 'specificity')} FROM t""")
def specificity(spark, folder):
    return rounded(metrics.specificity(metrics.class_counts(metrics.confusion(judged(spark, folder)))))

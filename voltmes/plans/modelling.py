"""Feature preparation, models and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.models import features as ft, scoring, selection, zoo
from voltmes.models.foldfits import linear_folds
from voltmes.models.forests import Forest
from voltmes.models.isolation import isolation_scores
from voltmes.operators import metrics, neighbors, outliers, splits, windows
from voltmes.plans import panel as p
from voltmes.plans.panel import MEASURES, NUMBERS, PANEL_SQL
from voltmes.plans.registry import query, r, rounded, rs
from voltmes.plans.relational import FEATURES, LAG_SQL, WIDE_FEATURES, lagged_panel, prepared
from voltmes.plans.validation import shown_scores
from voltmes.session import scratch_path, stored

KEY = ["mes_ano", "regiao"]
TRUTH = "consumo"


# Estimators, learned on whole tables.

@query("impute_median", f"""{LAG_SQL}, m AS (SELECT quantile_cont(pressao_mb, 0.5) AS a, quantile_cont(lag12, 0.5) AS b FROM lagged WHERE ano < 2000)
SELECT mes_ano, regiao, {r('coalesce(pressao_mb, a)', 6, 'pressao_mb')}, {r('coalesce(lag12, b)', 4, 'lag12')} FROM lagged, m""")
def impute_median(spark, folder):
    """Medians of the rows before 2000 fill all rows."""
    rows = lagged_panel(spark, folder)
    columns = ["pressao_mb", "lag12"]
    model = ft.MedianImputer(inputCols=columns, outputCols=columns).fit(rows.where(F.col("ano") < 2000))
    return rounded(model.transform(rows).select(*KEY, *columns), lag12=4)


@query("impute_mode", """
WITH t AS (SELECT o_orderkey AS conta, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS prioridade FROM orders),
m AS (SELECT prioridade AS top FROM t WHERE prioridade IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT conta, coalesce(prioridade, top) AS prioridade FROM t, m""")
def impute_mode(spark, folder):
    rows = p.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conta"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("prioridade"))
    return ft.ModeImputer(inputCols=["prioridade"], outputCols=["prioridade"]).fit(rows).transform(rows)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS DOUBLE) AS {s.lower()}" for s in SEGMENTS) + " FROM customer")
def one_hot(spark, folder):
    """Learned without the machinery customers, who then become all zeros."""
    rows = p.table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    index = StringIndexer(inputCol="c_mktsegment", outputCol="index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(
        rows.where(F.col("c_mktsegment") != "MACHINERY"))
    indexed = index.transform(rows)
    encoded = OneHotEncoder(inputCols=["index"], outputCols=["onehot"], dropLast=True).fit(indexed).transform(indexed)
    cells = vector_to_array("onehot")
    return encoded.select("c_custkey", *[cells[i].alias(s.lower()) for i, s in enumerate(SEGMENTS)])


def _scaled_sql(center: str, spread: str) -> str:
    return f"""WITH s AS (SELECT {center} AS c, {spread} AS s FROM orders)
SELECT o_orderkey AS conta, {r('(o_totalprice - c) / s', 6, 'valor')} FROM orders, s"""


def _scaled(spark, folder, kind) -> DataFrame:
    rows = p.table(spark, folder, "orders").select(F.col("o_orderkey").alias("conta"), F.col("o_totalprice").alias("valor"))
    return rounded(kind(inputCols=["valor"], outputCols=["valor"]).fit(rows).transform(rows))


@query("standardize", _scaled_sql("avg(o_totalprice)", "stddev_pop(o_totalprice)"))
def standardize(spark, folder):
    return _scaled(spark, folder, ft.Standardizer)


@query("robust_scale", _scaled_sql("quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"))
def robust_scale(spark, folder):
    return _scaled(spark, folder, ft.RobustStandardizer)


def _power_sql(power: float) -> str:
    up = "ln(1 + x)" if power == 0 else f"(pow(x + 1, {power}) - 1) / {power}"
    down = "-ln(1 - x)" if power == 2 else f"-(pow(1 - x, {2 - power}) - 1) / {2 - power}"
    return r(f"CASE WHEN x >= 0 THEN {up} ELSE {down} END", 7, f"p{int(power * 10):02d}")


POWERS = [0.0, 0.5, 1.0, 2.0]


@query("yeo_johnson", f"SELECT c_custkey, {', '.join(_power_sql(x) for x in POWERS)} FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def yeo_johnson(spark, folder):
    x = F.col("c_acctbal") / 1000
    return rounded(p.table(spark, folder, "customer").select(
        "c_custkey", *[ft.yeo_johnson(x, power).alias(f"p{int(power * 10):02d}") for power in POWERS]), 7)


@query("yeo_johnson_fit")
def yeo_johnson_fit(spark, folder):
    """Most likely power of every reading column of the station months, and the transformed values."""
    rows = stored(p.station_months(spark, folder))
    columns = list(MEASURES)
    model = ft.YeoJohnson(inputCols=columns, outputCols=columns).fit(rows)
    return rounded(model.transform(rows).select("codigo", "mes_ano", *columns))


@query("unknown_columns", f"""{PANEL_SQL}, m AS (SELECT quantile_cont(temp_c, 0.5) AS a FROM panel)
SELECT mes_ano, regiao, {r('coalesce(temp_c, a)', 6, 'temp_c')}, 0.0::DOUBLE AS umidade FROM panel, m""")
def unknown_columns(spark, folder):
    """A column that the model wants and the rows lack is added as missing, then filled."""
    rows = p.panel(spark, folder).select(*KEY, "temp_c")
    wanted = ["temp_c", "umidade"]
    added = ft.MissingColumns(inputCols=wanted).transform(rows)
    return rounded(ft.MedianImputer(inputCols=wanted, outputCols=wanted).fit(added).transform(added))


# Nearest neighbours and the line, which SQL can follow.

NEAR = ["lag1", "lag12", "temp_c"]
SCALED_SQL = f"""{LAG_SQL}, kept AS (SELECT *, row_number() OVER (ORDER BY month, regiao) AS pos, count(*) OVER () AS n FROM lagged WHERE lag12 IS NOT NULL),
split AS (SELECT *, pos <= floor(0.8 * n) AS train FROM kept),
st2 AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NEAR)} FROM split WHERE train),
z AS (SELECT split.*, {", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in NEAR)} FROM split, st2)
"""


@query("knn_reg", f"""{SCALED_SQL}, d AS (
  SELECT q.mes_ano, q.regiao, t.consumo, row_number() OVER (PARTITION BY q.mes_ano, q.regiao ORDER BY
    {" + ".join(f"pow(q.z_{c} - t.z_{c}, 2)" for c in NEAR)}, t.mes_ano || t.regiao) AS k
  FROM z q JOIN z t ON t.train AND NOT q.train)
SELECT mes_ano, regiao, {r('avg(consumo)', 2, 'prediction')} FROM d WHERE k <= 5 GROUP BY ALL""")
def knn_reg(spark, folder):
    rows = prepared(spark, folder).withColumn("id", F.concat("mes_ano", "regiao"))
    placed = stored(splits.holdout(rows))
    train = placed.where("role = 'train'")
    scaler = ft.Standardizer(inputCols=NEAR, outputCols=NEAR).fit(train)
    points, queries = (
        scaler.transform(part).withColumn("vector", F.array(*NEAR)) for part in (train, placed.where("role = 'test'")))
    found = neighbors.nearest(queries, points, query_key="id", point_key="id")
    answer = neighbors.mean_of_neighbours(found, points, "id", TRUTH)
    return rounded(queries.join(answer, queries.id == answer.query).select(*KEY, "prediction"), 2)


EMBEDDING_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) <= floor(0.8 * count(*) OVER ()) AS train FROM embeddings),
d AS (SELECT q.vec_id, t.vec_id AS near, t.label, list_distance(q.v, t.v) AS distance FROM e q JOIN e t ON t.train AND NOT q.train),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, near) AS rank FROM d)
"""


def _embeddings(spark, folder) -> tuple[DataFrame, DataFrame]:
    vectors = p.table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    placed = splits.holdout(vectors, order=("vec_id",))
    return placed.where("role = 'train'"), placed.where("role = 'test'")


@query("knn_neighbours", EMBEDDING_SQL + f"SELECT vec_id, near, CAST(rank AS INTEGER) AS rank, {r('distance', 6)} FROM k WHERE rank <= 5")
def knn_neighbours(spark, folder):
    points, queries = _embeddings(spark, folder)
    found = neighbors.nearest(queries, points, query_key="vec_id", point_key="vec_id")
    return rounded(found.select(F.col("query").alias("vec_id"), F.col("point").alias("near"), "rank", "distance"))


@query("knn_cls", EMBEDDING_SQL + """, v AS (SELECT vec_id, label, count(*) AS n FROM k WHERE rank <= 5 GROUP BY ALL)
SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS i FROM v) WHERE i = 1""")
def knn_cls(spark, folder):
    points, queries = _embeddings(spark, folder)
    found = neighbors.nearest(queries, points, query_key="vec_id", point_key="vec_id")
    return neighbors.vote_of_neighbours(found, points, "vec_id").withColumnRenamed("query", "vec_id")


def _line(spark: SparkSession, model) -> DataFrame:
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


@query("linreg_uni", f"""{PANEL_SQL}
SELECT {r('regr_slope(consumo, precip_mm)', 4, 'slope')}, {r('regr_intercept(consumo, precip_mm)', 2, 'intercept')} FROM panel""")
def linreg_uni(spark, folder):
    panel = p.panel(spark, folder)
    rows = VectorAssembler(inputCols=["precip_mm"], outputCol="features").transform(panel)
    model = zoo.linear(TRUTH).fit(rows)
    return rounded(_line(spark, model), intercept=2, slope=4)


@query("linreg_readings", f"""
SELECT {r('regr_slope(l_extendedprice, l_quantity)', 4, 'slope')}, {r('regr_intercept(l_extendedprice, l_quantity)', 3, 'intercept')} FROM lineitem""")
def linreg_readings(spark, folder):
    lines = p.table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice")
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines)
    model = zoo.linear("l_extendedprice").fit(rows)
    return rounded(_line(spark, model), intercept=3, slope=4)


# Models over expanding folds.

def modelling_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared rows with an id, stored once: every fold of every model reads them."""
    rows = prepared(spark, folder).withColumn("id", F.concat("mes_ano", "regiao"))
    return stored(rows.select("id", "month", *KEY, TRUTH, *WIDE_FEATURES))


def _makers(names: list[str]) -> dict[str, selection.Maker]:
    every = zoo.regressors(TRUTH, "id", ["month", "regiao"])
    return {name: (lambda make=every[name]: zoo.scaled(FEATURES, make())) for name in names}


def _register_fold_scores(name: str) -> None:
    @query(f"cv_{name}")
    def scores(spark, folder):
        return shown_scores(selection.compare(modelling_rows(spark, folder), _makers([name])))


for _name in ("knn", "huber", "vote", "boosting", "stacking", "blending", "gradient", "histogram", "leafwise"):
    _register_fold_scores(_name)


@query("cv_linear")
def cv_linear(spark, folder):
    """The fits of all folds come from one pass over the rows."""
    return shown_scores(metrics.fold_means(linear_folds(modelling_rows(spark, folder), FEATURES), TRUTH))


FORESTS = {"tree": Forest(1, bootstrap=False), "forest": Forest(zoo.TREES), "bagging": Forest(zoo.BAGGED_TREES), "forest200": Forest(zoo.COMPARED_TREES)}


def _register_forest_scores(name: str) -> None:
    @query(f"cv_{name}")
    def scores(spark, folder):
        """The trees of all folds are grown together."""
        done = selection.forest_folds(modelling_rows(spark, folder), {name: FORESTS[name]}, FEATURES)
        return shown_scores(metrics.fold_means(done, TRUTH))


for _name in FORESTS:
    _register_forest_scores(_name)


@query("model_board")
def model_board(spark, folder):
    """Fold and holdout scores of every regressor side by side, best holdout first."""
    finals = zoo.regressors(TRUTH, "id", ["month", "regiao"])
    return shown_scores(selection.board(modelling_rows(spark, folder), finals, lambda: ft.preparation(FEATURES, scaler="standard")))


@query("winsor_board")
def winsor_board(spark, folder):
    """The models of the prepared table on its winsorized target, with bounds from the first four fifths."""
    rows = modelling_rows(spark, folder)
    train = splits.holdout(rows, test_rounds_down=True).where("role = 'train'")
    rows = stored(outliers.winsorize(rows, TRUTH, "consumo_wins", train))
    every = zoo.regressors("consumo_wins", "id", ["month", "regiao"])
    finals = {name: every[name] for name in ("forest200", "histogram", "leafwise", "huber")}
    return shown_scores(selection.board(rows, finals, lambda: ft.preparation(FEATURES, scaler="standard"), "consumo_wins"))


@query("feature_variants")
def feature_variants(spark, folder):
    """The same forest behind three ways to prepare its inputs."""
    rows = modelling_rows(spark, folder)
    return metrics.leaderboard(shown_scores(selection.compare(rows, zoo.pipeline_variants(FEATURES, TRUTH))), by="mae_mean")


@query("tuned_forest")
def tuned_forest(spark, folder):
    """Every draw of the search with its parameters and fold scores; the best also on the last fifth."""
    return shown_scores(selection.tune_forest(modelling_rows(spark, folder), FEATURES, scratch_path(spark, "models")))


@query("global_forest")
def global_forest(spark, folder):
    """The tuned parameters, read back from the saved forest, for one forest of all regions and one of each; all saved and scored."""
    rows, models = modelling_rows(spark, folder), scratch_path(spark, "models")
    selection.tune_forest(rows, FEATURES, models)
    return shown_scores(selection.train_tuned(rows, FEATURES, models))


@query("region_forests")
def region_forests(spark, folder):
    """One forest per region, each saved under the region's name."""
    models = selection.region_forests(modelling_rows(spark, folder), Forest(zoo.TREES), FEATURES, scratch_path(spark, "models"))
    return shown_scores(metrics.leaderboard(models.drop("model_path"), name="regiao"))


@query("region_cv")
def region_cv(spark, folder):
    return shown_scores(selection.region_forest_folds(modelling_rows(spark, folder), Forest(zoo.TREES), FEATURES))


def _saved_forest(spark, folder, rows: DataFrame) -> str:
    path = scratch_path(spark, "models")
    placed = splits.holdout(rows)
    model = ft.tree_pipeline(FEATURES, zoo.forest(TRUTH)).fit(placed.where("role = 'train'"))
    selection.save_model(model, f"{path}/rfr")
    return path


@query("saved_model_scores")
def saved_model_scores(spark, folder):
    """The best saved model in order of preference, loaded and applied to the last fifth of the rows."""
    rows = modelling_rows(spark, folder)
    model = selection.load_model(spark, _saved_forest(spark, folder, rows))
    test = splits.holdout(rows).where("role = 'test'").select(*rows.columns)
    return rounded(selection.score_rows(model, test).select(*KEY, TRUTH, "pred_consumo"), 2)


@query("saved_model_regions")
def saved_model_regions(spark, folder):
    """The saved model's scores on the last fifth of every region; rain is missing from the rows."""
    rows = modelling_rows(spark, folder)
    model = selection.load_model(spark, _saved_forest(spark, folder, rows))
    placed = splits.holdout(rows.drop("precip_mm"), order=("month",), by=("regiao",))
    return shown_scores(metrics.region_metrics(selection.score_rows(model, placed, "prediction")))


LATER = 1997


@query("predictions_sink", f"""{LAG_SQL}, line AS (SELECT regr_slope(consumo, lag12) AS slope, regr_intercept(consumo, lag12) AS base FROM lagged WHERE ano < {LATER} AND lag12 IS NOT NULL)
SELECT mes_ano, regiao, {rs('consumo lag1 lag12')}, {r('base + slope * lag12', 2, 'pred_consumo')} FROM lagged, line WHERE ano >= {LATER} AND lag12 IS NOT NULL""")
def predictions_sink(spark, folder):
    """A line on the month a year before, learned and saved up to 1996; each later year arrives alone, is scored against the stored tail and written."""
    rows = p.panel(spark, folder).select("month", "ano", *KEY, TRUTH)
    models, out = scratch_path(spark, "models"), scratch_path(spark, "predictions")
    history = rows.where(F.col("ano") < LATER)
    known = windows.lag_features(history).where("lag12 is not null")
    trained = not known.isEmpty()
    if trained:
        selection.save_model(Pipeline(stages=[VectorAssembler(inputCols=["lag12"], outputCol="features"), zoo.linear(TRUTH)]).fit(known), f"{models}/rfr")
    scoring.save_tail(history, models)

    def score(lagged: DataFrame) -> DataFrame:
        """Without any row to learn from there is no line, and no prediction."""
        asking = lagged.where("lag12 is not null")
        return selection.score_rows(selection.load_model(spark, models), asking) if trained else asking.withColumn("pred_consumo", F.lit(None).cast("double"))

    for (year,) in sorted(rows.where(F.col("ano") >= LATER).select("ano").distinct().collect()):
        scoring.score_appended(score, rows.where(F.col("ano") == year), models, out)
    written = spark.read.parquet(out)
    return rounded(written.select(*KEY, TRUTH, "lag1", "lag12", "pred_consumo"), pred_consumo=2)


@query("random_holdout_forest")
def random_holdout_forest(spark, folder):
    rows = modelling_rows(spark, folder)
    path = scratch_path(spark, "rfr")
    return shown_scores(selection.train_with_holdout(rows, lambda: ft.tree_pipeline(FEATURES, zoo.forest(TRUTH)), path, ["id"]))


@query("isolation_forest")
def isolation_forest(spark, folder):
    return rounded(isolation_scores(p.panel(spark, folder), NUMBERS, KEY).select(*KEY, "score", "is_outlier"))


@query("isolation_forest_stations")
def isolation_forest_stations(spark, folder):
    stations = stored(p.station_months(spark, folder))
    return rounded(isolation_scores(stations, MEASURES, ["codigo", "mes_ano"]).select("codigo", "mes_ano", "score", "is_outlier"))


# Classifiers: a document's quality from its length and language.

def labelled(spark: SparkSession, folder: str) -> DataFrame:
    documents = p.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    rows = p.table(spark, folder, "labels").join(documents, "doc_id").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").cast("double").alias("label"))
    return stored(splits.random_holdout(rows, ["doc_id"], 0.35, by=["label"]))


def _register_classifier(name: str) -> None:
    @query(f"cls_{name}")
    def scores(spark, folder):
        rows = labelled(spark, folder)
        train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
        inputs = 1 + train.select("lang").distinct().count()
        make = zoo.classifiers("label", "doc_id", ["doc_id"], inputs)[name]
        model = ft.sensitive_pipeline(["n_chars"], make(), categorical=["lang"]).fit(train.drop("role", "position", "group_size"))
        return rounded(metrics.classification_metrics(model.transform(test)), 4)


CLASSIFIERS = ("knn", "tree", "bayes", "perceptron", "vote", "forest", "bagging", "boosting", "stacking", "blending", "gradient")
for _name in CLASSIFIERS:
    _register_classifier(_name)


def classifier_folds(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per classifier: the mean of its scores in every ``fold``, or the reason why one of its fits failed.

    All classifiers share the prepared rows of a fold. The perceptron has as many inputs as the widest fold.
    """
    roles = {str(fold): F.when(F.col("fold") != fold, "train").otherwise("test") for fold in range(splits.FOLDS)}
    parts = selection.prepared_splits(rows, lambda: ft.preparation(["n_chars"], ["lang"], scaler="standard"), roles, ["doc_id", "label"])
    inputs = {part: train.select(F.size(vector_to_array("features"))).first()[0] for part, (train, _) in parts.items()}
    done, failed = [], {}
    # Inputs differ from fold to fold only if one lacks a language.
    for width in sorted(set(inputs.values())):
        finals = zoo.classifiers("label", "doc_id", ["doc_id"], width)
        some, reasons = selection.split_scores(
            {p: parts[p] for p in parts if inputs[p] == width}, {n: finals[n] for n in names}, metrics.classification_metrics)
        done, failed = done + some, failed | reasons
    columns = [c for c in done[0] if c not in ("model", "split")]
    scored = rows.sparkSession.createDataFrame(
        [(r["model"], *[r[c] for c in columns]) for r in done if r["model"] not in failed], f"model string, {', '.join(f'{c} double' for c in columns)}")
    means = scored.groupBy("model").agg(*[F.avg(c).alias(c) for c in columns])
    return selection.with_notes(means.withColumn("notes", F.lit("")), failed, "model")


@query("cls_folds")
def cls_folds(spark, folder):
    """Every classifier over the same five shuffled folds: the means of the fold scores."""
    rows = stored(splits.random_folds(labelled(spark, folder).drop("position", "group_size", "role"), ["doc_id"]))
    return rounded(classifier_folds(rows, CLASSIFIERS), 4)

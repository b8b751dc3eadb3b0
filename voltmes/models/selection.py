"""Fits over folds and regions, model comparison, parameter search and scoring.

A fit is a Spark job of its own. Fits of different folds, models or regions are submitted side by side from a
few driver threads; their test predictions stay DataFrames and are scored together in one aggregate.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import prod
from random import Random

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltmes.models.features import required_columns
from voltmes.models.forests import Forest, forest_answers, grow_forests, load_forest, save_forests
from voltmes.operators import metrics, splits
from voltmes.operators.ordering import with_position
from voltmes.session import stored
from voltmes.sources.ptbr_csv import first_existing

log = logging.getLogger(__name__)

Maker = Callable[[], Estimator]
PARALLEL_FITS = 4

# The parameter lists of the forest search, and how many draws are tried.
SEARCH_SPACE = {
    "n_estimators": [100, 200, 400, 800],
    "max_depth": [None, 10, 20, 40, 80],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4, 10],
    "max_features": ["sqrt", "log2", 0.2, 0.5, None],
    "bootstrap": [True, False],
}
SEARCH_DRAWS = 12
# Names under which scoring looks for a saved model, best first.
SAVED_MODELS = ("rfr_global", "rfr", "rfr_tuned")


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], parallel: int = PARALLEL_FITS) -> list:
    """Results in order; a job that fails gives its exception."""
    def safe(job: Callable):
        try:
            return job()
        except Exception as error:  # one model's failure leaves the others standing
            log.warning("fit failed: %s", error)
            return error

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(safe), jobs))


def with_notes(scores: DataFrame, failed: dict[str, str], by: str) -> DataFrame:
    """A row without scores, but with the reason, for each group whose fit failed."""
    if not failed:
        return scores
    reasons = scores.sparkSession.createDataFrame(list(failed.items()), [by, "notes"])
    return scores.unionByName(reasons, allowMissingColumns=True)


def finished(names: Sequence[str], results: Sequence) -> tuple[list, dict[str, str]]:
    """The results of the groups of which no fit failed, and the first failure of each other group.

    If every group failed, the cause is not one group's data, and the first failure is raised.
    """
    failed: dict[str, str] = {}
    for name, result in zip(names, results):
        if isinstance(result, Exception):
            failed.setdefault(name, f"{type(result).__name__}: {str(result).splitlines()[0] if str(result) else ''}")
    if results and len(failed) == len(set(names)):
        raise next(r for r in results if isinstance(r, Exception))
    return [r for name, r in zip(names, results) if name not in failed], failed


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def predicted(maker: Maker, train: DataFrame, test: DataFrame, keep: Sequence[str]) -> DataFrame:
    return maker().fit(train).transform(test).select(*keep, "prediction")


def fold_predictions(
    df: DataFrame,
    makers: dict[str, Maker],
    keep: Sequence[str],
    order: Sequence[str] = ("month", "regiao"),
    folds: int = splits.FOLDS,
    parallel: int = PARALLEL_FITS,
) -> tuple[DataFrame | None, list[str]]:
    """Test predictions of every model in every expanding fold, and the models that failed."""
    placed = stored(with_position(df, order))
    tasks = [(name, fold) for name in makers for fold in range(folds)]

    def job(name: str, fold: int) -> Callable[[], DataFrame]:
        role = splits.expanding_role(fold, folds)
        train, test = placed.where(role == "train"), placed.where(role == "test")
        return lambda: predicted(makers[name], train, test, keep).select(
            F.lit(name).alias("model"), F.lit(fold).alias("fold"), *keep, "prediction")

    done = side_by_side(df.sparkSession, [job(*task) for task in tasks], parallel)
    failed = [n for n in makers if any(isinstance(r, Exception) for (name, _), r in zip(tasks, done) if name == n)]
    parts = [r for (name, _), r in zip(tasks, done) if name not in failed]
    return (stacked(parts) if parts else None), failed


def compare(
    df: DataFrame,
    makers: dict[str, Maker],
    truth: str = "consumo",
    order: Sequence[str] = ("month", "regiao"),
    folds: int = splits.FOLDS,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Fold-mean scores per model; a model that failed keeps its row without scores."""
    done, failed = fold_predictions(df, makers, [truth], order, folds, parallel)
    names = "model string, mae_mean double, rmse_mean double, r2_mean double, rmse_of_mean_mse double"
    scores = df.sparkSession.createDataFrame([(name, None, None, None, None) for name in failed], names)
    return scores if done is None else metrics.fold_means(done, truth).unionByName(scores)


def compare_with_holdout(
    df: DataFrame,
    makers: dict[str, Maker],
    truth: str = "consumo",
    order: Sequence[str] = ("month", "regiao"),
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Fold scores on the training rows next to scores on the last fifth, sorted by holdout MAE."""
    placed = stored(splits.holdout(df, order, test_rounds_down=True).drop("position", "group_size"))
    train, test = placed.where("role = 'train'").drop("role"), placed.where("role = 'test'").drop("role")
    cv = compare(train, makers, truth, order, parallel=parallel).select(
        "model", F.col("mae_mean").alias("cv_mae"), F.col("rmse_of_mean_mse").alias("cv_rmse"), F.col("r2_mean").alias("cv_r2"))
    jobs = [lambda name=name: predicted(makers[name], train, test, [truth]).withColumn("model", F.lit(name)) for name in makers]
    done = [r for r in side_by_side(df.sparkSession, jobs, parallel) if not isinstance(r, Exception)]
    if not done:
        return cv.withColumns({c: F.lit(None).cast("double") for c in ("hold_mae", "hold_rmse", "hold_r2")})
    held = metrics.regression_metrics(stacked(done), truth, by=["model"]).select(
        "model", F.col("mae").alias("hold_mae"), F.col("rmse").alias("hold_rmse"), F.col("r2").alias("hold_r2"))
    return metrics.leaderboard(cv.join(held, "model", "left"), by="hold_mae")


def prepared_splits(
    df: DataFrame, stages: Callable[[], list], roles: dict[str, Column], keep: Sequence[str], parallel: int = PARALLEL_FITS,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(train, test) with ``features`` for each named split, whose column says ``train`` or ``test``.

    The preparation of a split is learned once, on its training rows, and its rows are stored for all models.
    """
    def job(role: Column) -> Callable[[], tuple[DataFrame, DataFrame]]:
        def run() -> tuple[DataFrame, DataFrame]:
            placed = df.withColumn("_role", role).where("_role is not null")
            ready = Pipeline(stages=stages()).fit(placed.where("_role = 'train'")).transform(placed)
            ready = stored(ready.select(*keep, "features", "_role"), "prepared")
            return ready.where("_role = 'train'").drop("_role"), ready.where("_role = 'test'").drop("_role")

        return run

    done = side_by_side(df.sparkSession, [job(role) for role in roles.values()], parallel)
    for result in done:
        if isinstance(result, Exception):
            raise result
    return dict(zip(roles, done))


def split_scores(
    parts: dict[str, tuple[DataFrame, DataFrame]], finals: dict[str, Maker], score: Callable[[DataFrame], DataFrame], parallel: int = PARALLEL_FITS,
) -> tuple[list[dict], dict[str, str]]:
    """A row of scores per model and split, and the reason why a model failed."""
    # In slanting order: fits of one model, which may all be long or keep a single task busy, start between those of others.
    placed = sorted((i + j, i, name, part) for i, name in enumerate(finals) for j, part in enumerate(parts))
    tasks = [(name, part) for _, _, name, part in placed]

    def job(name: str, part: str) -> Callable[[], dict]:
        def run() -> dict:
            train, test = parts[part]
            return {"model": name, "split": part, **score(finals[name]().fit(train).transform(test)).first().asDict()}

        return run

    done, failed = finished([name for name, _ in tasks], side_by_side(next(iter(parts.values()))[0].sparkSession, [job(*t) for t in tasks], parallel))
    return done, failed


HELD = "holdout"


def board(
    df: DataFrame, finals: dict[str, Maker], stages: Callable[[], list], truth: str = "consumo", key: str = "id", order: Sequence[str] = ("month", "regiao"),
    folds: int = splits.FOLDS, parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Scores of every model in the folds of the first four fifths next to those on the last fifth, best holdout first.

    All models share the prepared rows of a split. A failed model keeps its row, with the reason in ``notes``.
    """
    placed = stored(splits.holdout(df, order, test_rounds_down=True).withColumnRenamed("role", "_held"))
    trained = placed.where("_held = 'train'").count()
    # Positions go by the order of all rows, so the folds of the training part are a matter of its size.
    inside = F.col("_held") == "train"
    sized = placed.withColumn("group_size", F.when(F.col("_held") == "train", F.lit(trained)).otherwise(F.col("group_size")))
    roles = {str(fold): F.when(inside, splits.expanding_role(fold, folds)) for fold in range(folds)} | {HELD: F.col("_held")}
    parts = prepared_splits(sized, stages, roles, [*dict.fromkeys([key, *order, truth])], parallel)
    done, failed = split_scores(parts, finals, lambda tested: metrics.regression_metrics(tested, truth), parallel)
    scores = df.sparkSession.createDataFrame(
        [(r["model"], r["split"], r["mae"], r["mse"], r["r2"]) for r in done], "model string, split string, mae double, mse double, r2 double")
    held, folded = F.col("split") == HELD, F.col("split") != HELD
    means = scores.groupBy("model").agg(
        F.avg(F.when(folded, F.col("mae"))).alias("cv_mae"), F.sqrt(F.avg(F.when(folded, F.col("mse")))).alias("cv_rmse"), F.avg(F.when(folded, F.col("r2"))).alias("cv_r2"),
        F.max(F.when(held, F.col("mae"))).alias("hold_mae"), F.sqrt(F.max(F.when(held, F.col("mse")))).alias("hold_rmse"), F.max(F.when(held, F.col("r2"))).alias("hold_r2"))
    return metrics.leaderboard(with_notes(means.withColumn("notes", F.lit("")), failed, "model"), by="hold_mae")


def refit_best(df: DataFrame, board: DataFrame, makers: dict[str, Maker], by: str = "hold_mae", path: str | None = None) -> tuple[str, Model] | None:
    """The best model of a leaderboard fitted on all rows, saved if a path is given; None without a valid score."""
    best = metrics.best_model(board, by).collect()
    if not best:
        return None
    model = makers[best[0]["model"]]().fit(df)
    if path:
        save_model(model, path)
    return best[0]["model"], model


def train_with_holdout(df: DataFrame, maker: Maker, path: str, key: Sequence[str], truth: str = "consumo") -> DataFrame:
    """Fits on a random four fifths, saves the model and scores it on the rest."""
    placed = splits.random_holdout(df, key)
    model = maker().fit(placed.where("role = 'train'"))
    save_model(model, path)
    return metrics.regression_metrics(model.transform(placed.where("role = 'test'")), truth)


# Parameter search.

def draws(n: int = SEARCH_DRAWS, seed: int = splits.SEED) -> list[dict]:
    """Different random combinations of the search space, without building all of them."""
    sizes = [len(v) for v in SEARCH_SPACE.values()]
    chosen = []
    for number in Random(seed).sample(range(prod(sizes)), n):
        picked = {}
        for name, values in SEARCH_SPACE.items():
            number, at = divmod(number, len(values))
            picked[name] = values[at]
        chosen.append(picked)
    return chosen


def searched_forest(picked: dict) -> Forest:
    return Forest(picked["n_estimators"], picked["max_depth"], picked["min_samples_split"], picked["min_samples_leaf"], picked["max_features"], picked["bootstrap"])


def _numbered(roles: Sequence[Column], role: str) -> Column:
    """The numbers of the splits in which a row has the role."""
    return F.array_compact(F.array(*[F.when(r == role, F.lit(i)) for i, r in enumerate(roles)]))


def forest_folds(
    df: DataFrame, tried: dict[str, Forest], numeric: Sequence[str], truth: str = "consumo", key: str = "id", order: Sequence[str] = ("month", "regiao"),
    folds: int = splits.FOLDS,
) -> DataFrame:
    """(model, fold, truth, prediction) of every forest in every expanding fold, all of them grown together."""
    roles = [splits.expanding_role(fold, folds) for fold in range(folds)]
    placed = stored(with_position(df, order)).withColumns({"groups": _numbered(roles, "train"), "tested": _numbered(roles, "test")})
    grown = grow_forests(placed, tried, numeric, folds, truth=truth, key=key)
    return forest_answers(grown).select("model", F.col("group").alias("fold"), F.col("truth").alias(truth), "prediction")


def search_forest(
    df: DataFrame, numeric: Sequence[str], truth: str = "consumo", n: int = SEARCH_DRAWS, seed: int = splits.SEED, order: Sequence[str] = ("month", "regiao"),
) -> tuple[DataFrame, dict[str, dict]]:
    """Fold scores per draw and the parameters behind each name."""
    tried = {f"draw{i:02d}": picked for i, picked in enumerate(draws(n, seed))}
    return metrics.fold_means(forest_folds(df, {name: searched_forest(p) for name, p in tried.items()}, numeric, truth, order=order), truth), tried


def tune_forest(
    df: DataFrame, numeric: Sequence[str], folder: str, truth: str = "consumo", n: int = SEARCH_DRAWS, order: Sequence[str] = ("month", "regiao"),
    name: str = "rfr_tuned",
) -> DataFrame:
    """All draws with their parameters and fold scores, best first; the best is grown on the first four fifths, saved and scored on the rest."""
    scores, tried = search_forest(df, numeric, truth, n, order=order)
    scores = stored(scores, "search")
    best = metrics.best_model(scores, "mae_mean").collect()[0]["model"]
    placed = splits.holdout(df, order).withColumns({"groups": _numbered([F.col("role")], "train"), "tested": _numbered([F.col("role")], "test")})
    grown = grow_forests(stored(placed), {name: searched_forest(tried[best])}, numeric, 1, truth=truth)
    save_forests(grown, {0: name}, folder, tried[best])
    held = metrics.regression_metrics(forest_answers(grown), "truth").first()
    listed = df.sparkSession.createDataFrame([(m, *[None if v is None else str(v) for v in p.values()]) for m, p in tried.items()], ["model", *SEARCH_SPACE])
    chosen = F.col("model") == best
    return metrics.leaderboard(scores.join(F.broadcast(listed), "model").withColumn("best", chosen).withColumns(
        {f"hold_{c}": F.when(chosen, F.lit(held[c])) for c in ("mae", "rmse", "r2")}), by="mae_mean")


# Regions.

def regions_of(df: DataFrame, by: str = "regiao") -> list[str]:
    """The regions to fit models for; one model each, so there are few."""
    return [r[0] for r in df.where(F.col(by).isNotNull()).select(by).distinct().orderBy(by).collect()]


def region_models(
    df: DataFrame,
    maker: Maker,
    truth: str = "consumo",
    by: str = "regiao",
    order: Sequence[str] = ("month",),
    folder: str | None = None,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """One model per region with enough rows, fitted on its first four fifths and scored on the rest.

    A region whose fit failed keeps its row, with the reason in ``notes`` and no scores.
    """
    placed = stored(splits.holdout(df, order, (by,)).where(F.col("group_size") >= metrics.MIN_REGION_ROWS))

    def job(region: str) -> Callable[[], DataFrame]:
        mine = placed.where(F.col(by) == region)

        def run() -> DataFrame:
            model = maker().fit(mine.where("role = 'train'"))
            path = f"{folder}/rfr_region_{region.replace(' ', '_')}" if folder else None
            if path:
                save_model(model, path)
            tested = model.transform(mine.where("role = 'test'"))
            return tested.select(by, "role", "group_size", truth, "prediction", F.lit(path).alias("model_path"))

        return run

    regions = regions_of(placed, by)
    done, failed = finished(regions, side_by_side(df.sparkSession, [job(r) for r in regions], parallel))
    tested = stacked(done)
    paths = tested.groupBy(by).agg(F.max("model_path").alias("model_path"))
    return with_notes(metrics.region_metrics(tested, truth, by=by).join(paths, by), failed, by)


def region_folds(
    df: DataFrame,
    maker: Maker,
    truth: str = "consumo",
    by: str = "regiao",
    order: Sequence[str] = ("month",),
    folds: int = splits.FOLDS,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """Fold-mean scores per region, the model refitted in every fold of every region.

    A region with a failed fold has no mean over fewer folds: it keeps its row, with the reason in ``notes``.
    """
    spread = stored(splits.expanding_folds_by_group(df, (by,), order, folds))
    tasks = [(r["region"], r["fold"]) for r in spread.select(F.col(by).alias("region"), "fold").distinct().orderBy("region", "fold").collect()]

    def job(region: str, fold: int) -> Callable[[], DataFrame]:
        mine = spread.where((F.col(by) == region) & (F.col("fold") == fold))
        return lambda: predicted(
            maker, mine.where("role = 'train'"), mine.where("role = 'test'"), [by, "fold", "group_size", truth])

    done, failed = finished([region for region, _ in tasks], side_by_side(df.sparkSession, [job(*t) for t in tasks], parallel))
    tested = stacked(done)
    sizes = tested.groupBy(by).agg(F.max("group_size").alias("n"))
    means = metrics.fold_means(tested, truth, by=[by]).drop("rmse_of_mean_mse").join(sizes, by)
    return with_notes(means.withColumn("notes", F.lit("")), failed, by)


def region_forests(
    df: DataFrame, forest: Forest, numeric: Sequence[str], folder: str | None = None, truth: str = "consumo", by: str = "regiao", key: str = "id",
    order: Sequence[str] = ("month",),
) -> DataFrame:
    """One forest per region with enough rows, all grown together on the first four fifths of each, saved and scored on the rest."""
    placed = stored(splits.holdout(df, order, (by,)).where((F.col("group_size") >= metrics.MIN_REGION_ROWS) & F.col(by).isNotNull()))
    regions = regions_of(placed, by)
    number = F.create_map(*[x for i, region in enumerate(regions) for x in (F.lit(region), F.lit(i))])[F.col(by)] if regions else F.lit(0)
    none = F.array().cast("array<int>")
    ready = placed.withColumns({"groups": F.when(F.col("role") == "train", F.array(number)).otherwise(none), "tested": F.when(F.col("role") == "test", F.array(number)).otherwise(none)})
    grown = grow_forests(ready, {"forest": forest}, numeric, len(regions), truth=truth, key=key, categorical=())
    names = {i: f"rfr_region_{region.replace(' ', '_')}" for i, region in enumerate(regions)}
    if folder:
        save_forests(grown, names, folder)
    tested = forest_answers(grown).join(placed.select(F.col(key).cast("string").alias("id"), by, "role", "group_size"), "id")
    scores = metrics.region_metrics(tested, "truth", by=by)
    listed = df.sparkSession.createDataFrame([(region, f"{folder}/{names[i]}" if folder else None) for i, region in enumerate(regions)], f"{by} string, model_path string")
    return scores.join(F.broadcast(listed), by)


def train_tuned(df: DataFrame, numeric: Sequence[str], folder: str, truth: str = "consumo", by: str = "regiao", order: Sequence[str] = ("month", "regiao")) -> DataFrame:
    """With the parameters of the folder's tuned forest: ``rfr_global`` on the first four fifths of all rows, and one forest per region.

    All are saved beside it. A row per model: the regions and ``TOTAL`` for the global one.
    """
    forest = searched_forest(load_forest(df.sparkSession, folder, ["rfr_tuned"]).params)
    placed = splits.holdout(df, order).withColumns({"groups": _numbered([F.col("role")], "train"), "tested": _numbered([F.col("role")], "test")})
    grown = grow_forests(stored(placed), {"rfr_global": forest}, numeric, 1, truth=truth)
    save_forests(grown, {0: "rfr_global"}, folder)
    whole = metrics.regression_metrics(forest_answers(grown), "truth").select(
        F.lit("TOTAL").alias(by), F.lit(df.count()).alias("n"), "mae", "mse", "rmse", "r2", F.lit("").alias("notes"), F.lit(f"{folder}/rfr_global").alias("model_path"))
    return metrics.leaderboard(whole.unionByName(region_forests(df, forest, numeric, folder, truth, by)).drop("model_path"), name=by)


def region_forest_folds(
    df: DataFrame, forest: Forest, numeric: Sequence[str], truth: str = "consumo", by: str = "regiao", key: str = "id", order: Sequence[str] = ("month",),
    folds: int = splits.FOLDS,
) -> DataFrame:
    """Fold-mean scores per region; the forests of all folds of all regions are grown together."""
    spread = stored(splits.expanding_folds_by_group(df.where(F.col(by).isNotNull()), (by,), order, folds))
    regions = regions_of(spread, by)
    number = F.create_map(*[x for i, region in enumerate(regions) for x in (F.lit(region), F.lit(i * folds))])[F.col(by)] + F.col("fold")
    once = spread.groupBy(key).agg(
        *[F.first(c).alias(c) for c in spread.columns if c not in (key, "fold", "role")],
        F.collect_set(F.when(F.col("role") == "train", number)).alias("groups"), F.collect_set(F.when(F.col("role") == "test", number)).alias("tested"))
    grown = grow_forests(stored(once), {"forest": forest}, numeric, len(regions) * folds, truth=truth, key=key, categorical=())
    tested = forest_answers(grown).join(once.select(F.col(key).cast("string").alias("id"), by, "group_size"), "id").withColumn("fold", F.col("group") % folds)
    sizes = tested.groupBy(by).agg(F.max("group_size").alias("n"))
    return metrics.fold_means(tested, "truth", by=[by]).drop("rmse_of_mean_mse").join(sizes, by).withColumn("notes", F.lit(""))


# Saving and scoring.

def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, folder: str, names: Sequence[str] = SAVED_MODELS) -> PipelineModel:
    """The first saved model in order of preference."""
    return PipelineModel.load(first_existing(spark, [f"{folder}/{name}" for name in names]))


def score_rows(model: PipelineModel, df: DataFrame, out: str = "pred_consumo") -> DataFrame:
    """Input rows with their prediction; columns that the model wants and the rows lack count as missing."""
    lacking = {c: F.lit(None).cast("double") for c in required_columns(model) if c not in df.columns}
    return model.transform(df.withColumns(lacking)).select(*df.columns, F.col("prediction").alias(out))

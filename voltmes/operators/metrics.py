"""Regression and classification scores as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows a region needs for scores of its own, and the note it gets otherwise.
MIN_REGION_ROWS = 12
TOO_SMALL = "too_small"


def _scores(truth: Column, predicted: Column, counted: Column | None = None) -> list[Column]:
    """n, MAE, MSE, RMSE and R2 in one pass; a constant truth scores 0, or 1 if met exactly.

    Rows outside ``counted`` or with a side missing do not count.
    """
    valid = truth.isNotNull() & predicted.isNotNull()
    valid = valid if counted is None else valid & counted
    y = F.when(valid, truth.cast("double"))
    e = y - predicted
    mse = F.avg(e * e)
    flat = F.when(F.count(e) > 1, F.when(mse == 0, 1.0).otherwise(0.0))
    r2 = F.when(F.min(y) < F.max(y), 1 - mse / F.var_pop(y)).otherwise(flat)
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), r2.alias("r2")]


def regression_metrics(
    df: DataFrame, truth: str = "consumo", predicted: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*_scores(F.col(truth), F.col(predicted)))


def metrics_with_total(
    df: DataFrame, truth: str = "consumo", predicted: str = "prediction", by: str = "regiao", total: str = "TOTAL"
) -> DataFrame:
    """Per group and over all rows in one pass."""
    rolled = df.rollup(by).agg(F.grouping(by).alias("_all"), *_scores(F.col(truth), F.col(predicted)))
    return rolled.withColumn(by, F.when(F.col("_all") == 1, total).otherwise(F.col(by))).drop("_all")


def region_metrics(
    df: DataFrame,
    truth: str = "consumo",
    predicted: str = "prediction",
    by: str = "regiao",
    min_rows: int = MIN_REGION_ROWS,
) -> DataFrame:
    """Test-row scores per region; a region with too few rows keeps its row with a note and no scores.

    Wants the ``role`` and ``group_size`` columns of a holdout by region.
    """
    n = F.max("group_size")
    big = n >= min_rows
    scores = _scores(F.col(truth), F.col(predicted), F.col("role") == "test")[1:]
    named = dict(zip(("mae", "mse", "rmse", "r2"), scores))
    return df.groupBy(by).agg(
        n.alias("n"),
        *[F.when(big, c).alias(name) for name, c in named.items()],
        F.when(big, "").otherwise(TOO_SMALL).alias("notes"),
    )


def fold_means(
    df: DataFrame,
    truth: str = "consumo",
    predicted: str = "prediction",
    by: Sequence[str] = ("model",),
    fold: str = "fold",
) -> DataFrame:
    """Means of the fold scores, with both the mean of the fold RMSEs and the root of the mean MSE."""
    per_fold = regression_metrics(df, truth, predicted, [*by, fold])
    return per_fold.groupBy(*by).agg(
        F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"), F.avg("r2").alias("r2_mean"),
        F.sqrt(F.avg("mse")).alias("rmse_of_mean_mse"),
    )


def leaderboard(scores: DataFrame, by: str = "mae", name: str = "model") -> DataFrame:
    """Best first, missing scores last."""
    return scores.orderBy(F.isnan(by), F.col(by).asc_nulls_last(), name)


def best_model(scores: DataFrame, by: str = "mae", name: str = "model") -> DataFrame:
    """The row with the smallest score; rows without a score cannot win."""
    valid = scores.where(F.col(by).isNotNull() & ~F.isnan(by))
    return valid.orderBy(by, name).limit(1)


def confusion(
    df: DataFrame, truth: str = "label", predicted: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN and TN of every class seen as truth or prediction, from confusion cells."""
    none = F.lit(0).cast("long")
    hit = F.col("label") == F.col("predicted")
    n = F.col("n")
    as_truth = F.struct(
        F.col("label").alias("class"), F.when(hit, n).otherwise(none).alias("tp"), none.alias("fp"),
        F.when(hit, none).otherwise(n).alias("fn"), n.alias("rows"))
    as_prediction = F.struct(
        F.col("predicted").alias("class"), none.alias("tp"), F.when(hit, none).otherwise(n).alias("fp"),
        none.alias("fn"), none.alias("rows"))
    counted = cells.select(*by, F.inline(F.array(as_truth, as_prediction))).groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "rows")])
    # One row per class here, so the total over classes is a window of that many rows.
    total = F.sum("rows").over(Window.partitionBy(*by))
    return counted.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def specificity(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TN / (TN + FP): mean over classes, or of the larger label when the truth has at most two.

    A two-label truth whose confusion matrix is not 2 x 2 scores 0.
    """
    return counts.groupBy(*by).agg(_specificity().alias("specificity"))


def _specificity() -> Column:
    share = _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    true_classes = F.count_if(F.col("tp") + F.col("fn") > 0)
    return F.when(true_classes > 2, F.avg(share)).when(F.count("*") == 2, F.max_by(share, "class")).otherwise(0.0)


def classification_metrics(
    df: DataFrame, truth: str = "label", predicted: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, macro F1, precision, recall and specificity in percent; a ratio without cases counts 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counts = class_counts(confusion(df, truth, predicted, by), by)
    return counts.groupBy(*by).agg(
        (100 * F.sum("tp") / F.sum("rows")).alias("accuracy"),
        (100 * F.avg(_ratio(2 * tp, 2 * tp + fp + fn))).alias("f1"),
        (100 * F.avg(_ratio(tp, tp + fp))).alias("precision"),
        (100 * F.avg(_ratio(tp, tp + fn))).alias("recall"),
        (100 * _specificity()).alias("specificity"),
    )

"""Scoring of rows that arrive later: the last rows of each group are stored with the model, and features are made from them.

New rows are joined to the tail, lags and trailing means are computed over both, only the new rows are scored and written, and
the tail moves on. Scores of a month that arrives later are those of a run over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.operators.ordering import with_position
from voltmes.operators.windows import lag_features
from voltmes.session import stored

#: Rows of a group that the longest lag looks back.
TAIL_ROWS = 12


def _last_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    placed = with_position(df, order, by)
    return placed.where(F.col("group_size") - F.col("position") < rows).select(*df.columns)


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/tail")


def save_tail(df: DataFrame, folder: str, by: Sequence[str] = ("regiao",), order: Sequence[str] = ("month",), rows: int = TAIL_ROWS, version: int = 0) -> None:
    """The last rows of every group, as a new version beside the older ones: a run that is lost midway has changed nothing."""
    _last_rows(df, by, order, rows).write.mode("overwrite").parquet(f"{folder}/tail/version={version}")


def load_tail(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The newest tail and its version."""
    newest = _versions(spark, folder).agg(F.max("version")).first()[0]
    return _versions(spark, folder).where(F.col("version") == newest).drop("version"), newest


def score_appended(
    score: Callable[[DataFrame], DataFrame], new: DataFrame, folder: str, out: str, value: str = "consumo", by: Sequence[str] = ("regiao",),
    order: Sequence[str] = ("month",), lags: Sequence[int] = (1, 12), trailing: int = 3, rows: int = TAIL_ROWS,
) -> DataFrame:
    """Adds the lags to the new rows, scores them, appends the scores to the table ``out`` and moves the tail on.

    New rows come after those of the tail. A group that the tail doesn't know starts without lags. A column that the new rows
    lack counts as missing; others than those of the tail are kept for scoring, not in the tail.
    """
    spark = new.sparkSession
    tail, version = load_tail(spark, folder)
    both = stored(tail.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True), "appended")
    lagged = lag_features(both, value, by, order, lags, trailing).where("_new").drop("_new")
    scored = stored(score(lagged), "scores")
    scored.write.mode("append").parquet(out)
    # Scores first: a run lost in between scores the same rows again rather than skip them.
    save_tail(both.select(*tail.columns), folder, by, order, rows, version + 1)
    return scored

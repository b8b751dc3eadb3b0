"""Lags and trailing means inside ordered groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from voltmes.operators.ordering import GROUP_LIMIT, largest_group, with_position

CHUNK_ROWS = 200_000


def over_ordered(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str],
    columns: dict[str, Callable[[WindowSpec], Column]],
    reach: int,
    limit: int = GROUP_LIMIT,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds window columns that look at most ``reach`` rows back.

    ``columns`` maps a name to a function from the ordered window to a column. A group beyond the limit is cut
    into chunks by position; the last ``reach`` rows of a chunk are also handed to the next one, which gives
    the same result as one window over the group.
    """
    by = list(by)
    if largest_group(df, by) <= limit:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", *[make(window).alias(name) for name, make in columns.items()])

    chunk = max(chunk, reach)
    placed = with_position(df, order, by, limit)
    own = F.floor((F.col("position") - 1) / chunk)
    near_end = (F.col("position") - 1) % chunk >= chunk - reach
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*by, "_chunk").orderBy("position")
    return (
        spread.select("*", *[make(window).alias(name) for name, make in columns.items()])
        .where(F.col("_own") == F.col("_chunk"))
        .drop("_own", "_chunk", "position", "group_size")
    )


def lag_features(
    df: DataFrame,
    value: str = "consumo",
    by: Sequence[str] = ("regiao",),
    order: Sequence[str] = ("month",),
    lags: Sequence[int] = (1, 12),
    trailing: int = 3,
    limit: int = GROUP_LIMIT,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """``lagN`` by row offset and ``rollN``, the mean of the N rows before the current one.

    The mean skips nulls and needs one value; it never looks into another group.
    """
    columns = {f"lag{n}": _lag(value, n) for n in lags}
    columns[f"roll{trailing}"] = _trailing_mean(value, trailing)
    return over_ordered(df, order, by, columns, max(*lags, trailing), limit, chunk)


def leaking_trailing_mean(
    df: DataFrame,
    lagged: str = "lag1",
    order: Sequence[str] = ("regiao", "month"),
    trailing: int = 3,
    out: str = "roll3_compat",
    limit: int = GROUP_LIMIT,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Trailing mean of a lag column over the flat table, which lets a group see the end of the one before.

    Only for comparison with results made that way; ``lag_features`` is the right form.
    """
    columns = {out: lambda w: F.avg(lagged).over(w.rowsBetween(1 - trailing, 0))}
    return over_ordered(df, order, (), columns, trailing, limit, chunk)


def _lag(value: str, n: int):
    return lambda window: F.lag(value, n).over(window)


def _trailing_mean(value: str, n: int):
    return lambda window: F.avg(value).over(window.rowsBetween(-n, -1))

"""Pearson and Spearman matrices over complete pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.operators.ordering import join_few_facts, part_offsets
from voltmes.session import stored

#: Rows that one task ranks, about.
PART_ROWS = 1_000_000


def _correlations(df: DataFrame, sides: dict[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """Symmetric rows ``(feature, other, r)`` over the rows that have both sides; null where a side is constant.

    Each task keeps one small state per pair, so no row is shuffled. The states stay few in the generated code
    because the pair is a grouping key.
    """
    cells = [part for (a, b), (x, y) in sides.items() for part in (F.lit(a), F.lit(b), x.cast("double"), y.cast("double"))]
    pairs = df.select(F.stack(F.lit(len(sides)), *cells).alias("feature", "other", "x", "y"))
    x, y = F.col("x"), F.col("y")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    found = pairs.where(x.isNotNull() & y.isNotNull()).groupBy("feature", "other").agg(
        F.try_divide(F.covar_pop(x, y), spread).alias("r"))
    r = F.col("r")
    found = found.withColumn("r", F.when(r.isNotNull() & (F.col("feature") == F.col("other")), 1.0).when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r))
    mirrored = F.when(F.col("feature") == F.col("other"), F.array(F.struct("feature", "other", "r"))).otherwise(
        F.array(F.struct("feature", "other", "r"), F.struct(F.col("other").alias("feature"), F.col("feature").alias("other"), "r")))
    return found.select(F.inline(mirrored))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one pass."""
    return _correlations(df, {
        (a, b): (F.col(a), F.col(b)) for a, b in combinations_with_replacement(columns, 2)})


def _parts(df: DataFrame, rows: int, part_rows: int) -> int | None:
    """Parts of at most ``part_rows`` rows; none if as many as the session shuffles into are enough."""
    parts = ceil(rows / part_rows)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def average_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", key: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """Adds each value's rank in its group; ties share the mean of their ranks, a null has none.

    The rows are sorted into parts by value, equal values by ``key``, which identifies a row (all columns if
    none is given). So a value that many rows share spans parts like any other stretch of the order. Inside a
    part windows find where a value starts and how often it stands there. Only the first and the last value of a part
    can reach into another: a table of those, two rows per part and group, carries them over. A task holds a part, so
    a large table needs more ``parts`` than the session shuffles into.
    """
    by, at = list(by), F.col(value)
    if df.schema[value].dataType.typeName() in ("double", "float"):
        at = at + F.lit(0.0).cast(df.schema[value].dataType)  # a negative zero ties with zero
    spread = F.xxhash64(*(key or df.columns))
    # Which part a row falls in is decided by its own columns, and is stored with what the windows find.
    count = [parts] if parts else []
    placed = df.withColumn("_value", at).repartitionByRange(*count, *by, "_value", spread).withColumn("_part", F.spark_partition_id())
    part = ["_part", *by]
    inside = Window.partitionBy(*part).orderBy(F.col("_value").asc_nulls_last())
    placed = stored(placed.withColumn("_through", F.count("_value").over(inside)).withColumn(
        "_same", F.col("_through") - F.rank().over(inside) + 1), "ranks")

    ends = F.when(F.col("_value").isNotNull(), F.struct("_value", "_same"))
    sums = placed.groupBy(*part).agg(F.count("_value").alias("_sum"), F.min(ends).alias("_low"), F.max(ends).alias("_high"))
    ranked = join_few_facts(placed, _tied_ends(part_offsets(sums, by, "_total"), by), part)
    middle = F.col("_before") + F.col("_through") - (F.col("_same") - 1) / 2
    rank = F.when(F.col("_value") == F.col("_low"), F.col("_low_rank")).when(
        F.col("_value") == F.col("_high"), F.col("_high_rank")).when(F.col("_value").isNotNull(), middle)
    return ranked.withColumn(out, rank).select(*[c for c in df.columns if c != out], out)


def _tied_ends(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per part the sum before it, its first and its last value, and their ranks, ties of other parts included."""
    low, high = F.col("_low"), F.col("_high")
    one = low["_value"] == high["_value"]
    same = F.when(one, F.lit(0)).otherwise(high["_same"]).alias("same")
    ends = F.array(
        F.struct(low["_value"].alias("value"), low["_same"].alias("same"), F.col("_before").alias("start")),
        F.struct(high["_value"].alias("value"), same, (F.col("_before") + F.col("_sum") - high["_same"]).alias("start")))
    tied = Window.partitionBy(*by, "value")
    found = parts.select("_part", *by, "_before", F.inline(ends)).withColumn(
        "rank", F.min("start").over(tied) + (F.sum("same").over(tied) + 1) / 2)
    # The later value has the higher rank.
    return found.groupBy("_part", *by).agg(
        F.max("_before").alias("_before"), F.min("value").alias("_low"), F.max("value").alias("_high"),
        F.min("rank").alias("_low_rank"), F.max("rank").alias("_high_rank"))


def spearman(df: DataFrame, columns: Sequence[str], key: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Rank correlation, re-ranked for each pair on the rows where both are present.

    A column without nulls leaves its partner's ranks as they are, so only columns with nulls need ranks of
    their own per partner. ``key`` identifies a row. Tasks rank ``part_rows`` rows, and put as many together again.
    """
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_rows")).first()
    gappy = {c for c in columns if holes[c] > 0}

    def ranking(c: str, partner: str) -> str:
        return f"{c}__with__{partner}" if partner in gappy and partner != c else c

    pairs = list(combinations_with_replacement(columns, 2))
    needed = {ranking(a, b): (a, b) for pair in pairs for a, b in (pair, pair[::-1])}
    cells = F.array(*[
        F.struct(F.lit(number).alias("ranking"),
                 F.when(F.col(partner).isNotNull(), F.col(c).cast("double")).alias("value"))
        for number, (c, partner) in enumerate(needed.values())
    ])
    long = df.select(*key, F.inline(F.filter(cells, lambda s: s["value"].isNotNull())))
    parts = _parts(df, holes["_rows"] * len(needed), part_rows)
    ranks = average_ranks(long, "value", ["ranking"], key=key, parts=parts)
    wide = (ranks.repartition(parts, *key) if parts else ranks).groupBy(*key).agg(*[
        F.max(F.when(F.col("ranking") == number, F.col("rank"))).alias(name) for number, name in enumerate(needed)
    ])
    return _correlations(wide, {(a, b): (F.col(ranking(a, b)), F.col(ranking(b, a))) for a, b in pairs})

"""Positions and running totals that hold at any group size.

A window over a whole table, or over a group that holds a third of it, would run in one task. Groups
proven small use that plain window. All other rows are sorted once into parts, which are stored with each
row's part and place. A part is counted once, and a row's position is its place plus the counts of the parts
before, a table of one row per part and group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.session import stored

GROUP_LIMIT = 1_000_000
#: Facts of more rows than this are joined by a shuffle.
BROADCAST_FACTS = 20_000


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the biggest group; one counting pass with map-side combine."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def join_facts(df: DataFrame, facts: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Adds the columns of a frame that has one row per key; a null key matches a null key."""
    renamed = facts.withColumnsRenamed({k: f"_key_{k}" for k in by})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by])
    return df.join(renamed, same, how).drop(*[f"_key_{k}" for k in by])


def join_few_facts(df: DataFrame, facts: DataFrame, by: Sequence[str], most: int = BROADCAST_FACTS) -> DataFrame:
    """As ``join_facts`` for facts that are a few numbers per group.

    They are stored and counted first. Few of them are broadcast, so that a hot group is not shuffled onto one
    task; with many groups a shuffle spreads the rows.
    """
    facts = stored(facts, "facts")
    return join_facts(df, F.broadcast(facts) if facts.count() <= most else facts, by)


def running_total(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    weight: str | None = None,
    out: str = "position",
    total: str = "group_size",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Adds the inclusive running sum of ``weight`` (row count if none) and the group's total.

    ``by`` + ``order`` must identify a row, or ties are ordered at random. Groups of at most ``limit`` rows are
    summed by a window each; a whole table, and tables with a larger group, are sorted once into parts.
    """
    order, by = list(order), list(by)
    if by and largest_group(df, by) <= limit:
        amount = F.col(weight) if weight else F.lit(1).cast("long")
        group = Window.partitionBy(*by)
        ordered = group.orderBy(*order)
        running = F.sum(amount).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) if weight else (
            F.row_number().over(ordered).cast("long"))
        return df.withColumn(out, running).withColumn(total, F.sum(amount).over(group))
    placed = in_parts(df, order, by)
    if weight:
        inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        running, amount, start = F.sum(weight).over(inside), F.sum(weight), F.lit(0)
    else:
        # Inside a part the rows of a group follow each other without a gap.
        running, amount, start = F.col("_at"), F.count("*"), F.min("_at") - 1
    facts = part_offsets(placed.groupBy("_part", *by).agg(amount.alias("_sum"), start.alias("_start")), by, total)
    # Rows meet the facts of their own part only, so a hot group is spread over its parts.
    return (
        join_few_facts(placed.withColumn("_running", running), facts, ["_part", *by])
        .withColumn(out, F.col("_running") - F.col("_start") + F.col("_before"))
        .select(*df.columns, out, total)
    )


def in_parts(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The rows sorted by ``by`` + ``order`` into stored parts, with the part (``_part``) and the place in it (``_at``).

    Spark's range partitioner cuts the table, into as many parts as the session shuffles into. It is the only
    shuffle, and nothing is counted before. Since part and place are stored, later passes and recomputed tasks
    see the same ones.
    """
    number = F.monotonically_increasing_id()
    keys = [*by, *order]
    numbered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", number)
    # The number holds the part in its upper bits, the place in the lower 33.
    return stored(numbered, "parts").withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def part_offsets(sums: DataFrame, by: Sequence[str], total: str) -> DataFrame:
    """Sums per part and group with the sum of the group's parts before (``_before``) and of them all.

    A group has one row per part, so the window sees as many rows as there are parts.
    """
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn(
        total, F.sum("_sum").over(whole))


def with_position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), limit: int = GROUP_LIMIT) -> DataFrame:
    """1-based ``position`` in the order and ``group_size``, in the whole table or inside each group."""
    return running_total(df, order, by, limit=limit)


def top_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows of a total order; each task keeps n rows, nothing is sorted whole."""
    return df.orderBy(*order).limit(n)

"""Connected components by a union-find forest that lives in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltmes.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``a``, ``b`` that isn't its own root; a root is the smallest node it reaches.

    In each round every root with a smaller neighbour hooks onto the smallest one, the hooks are followed to
    their ends by doubling, and links are drawn again between the roots that are left, once each. Links only
    shrink, minima are taken before the shuffle, and every round is a written table, so a busy node is no more
    work than many idle ones and a lost executor costs no round. Links of a node to itself or with a null are void.
    """
    a, b = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    live = stored(links.where("a <> b").select(a, b).distinct(), "links")
    roots = None
    while not live.isEmpty():
        hooks = _followed(stored(live.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "hooks"))
        if roots is None:
            roots = hooks
        else:
            old = roots.join(hooks.toDF("root", "_next"), "root", "left")
            roots = stored(old.select("node", F.coalesce("_next", "root").alias("root")).unionByName(hooks), "roots")
        moved = live.join(hooks.toDF("high", "_high"), "high", "left").join(hooks.toDF("low", "_low"), "low", "left").select(
            F.coalesce("_high", "high").alias("high"), F.coalesce("_low", "low").alias("low"))
        live = stored(moved.where("high <> low").select(
            F.least("high", "low").alias("low"), F.greatest("high", "low").alias("high")).distinct(), "links")
    return live.toDF("root", "node").select("node", "root") if roots is None else roots


def _followed(hooks: DataFrame) -> DataFrame:
    """Each hook replaced by the end of its chain."""
    while True:
        further = hooks.toDF("root", "_next")
        longer = stored(hooks.join(further, "root", "left").select("node", F.coalesce("_next", "root").alias("root"),
                                                                 F.col("_next").isNotNull().alias("_moved")), "hooks")
        hooks = longer.select("node", "root")
        if longer.where("_moved").isEmpty():
            return hooks

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document draws u in (0, 1) from a hash of itself and has the key -ln(u) / weight; the least keys go first. The
order is kept as ln(key), which spreads evenly whatever the weights. A source's budget is spent on whole epochs
first, then on its documents in that order until the running sum of their sizes reaches the rest. Where that
happens is found by summing sizes over finer and finer ranges of keys, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.operators.ordering import with_position
from voltmes.session import stored

#: Per source one row of facts; up to so many are sent to all tasks, more are joined with a shuffle.
BROADCAST_SOURCES = 100_000
_RESULTS = ["_size", "_source_size", "_target", "_taken"]
_SYMBOLS = "#*$%&|<>{}[]^~_=+\\@0123456789"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.1 for a text of many symbols and digits."""
    plain = F.length(F.translate(text, _SYMBOLS, ""))
    return F.greatest(F.lit(0.1), 1 - 4 * (F.length(text) - plain) / F.greatest(F.length(text), F.lit(1)))


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", *, weights: Sequence[int] = (3, 1, 2),
    percent: int = 150, most: int = 2, weight: Column | None = None, seed: int = 1, broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """The rows with ``_size, _source_size, _target, _taken``; sizes are words of the text, a null text has none.

    Columns of the caller named like these four are replaced, all others come back as they are.

    Sources in code point order, null last, have the ``weights`` in turn and share ``percent`` % of all words by
    weight. No target exceeds ``most`` times its source's words; the excess goes to the others by weight. ``_taken``
    counts the words the mix takes of a document, repeats included; only the document in which a budget ends gives
    a part of its words, and rows that can't be told apart give like parts. A rerun takes the same.
    """
    options = dict(weights=weights, percent=percent, most=most, weight=weight, seed=seed, broadcast_sources=broadcast_sources)
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in _RESULTS]
    return _mixed(docs, id, text, source, **options).select(*own, *_RESULTS)


def _mixed(
    docs: DataFrame, id: str, text: str, source: str, *, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2,
    weight: Column | None = None, seed: int = 1, broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """(_row, _size, _source_size, _target, _taken): the caller's columns lie in ``_row``, where no name can meet another."""
    words = word_count(F.col(text))
    quality = F.coalesce(weight if weight is not None else quality_weight(F.col(text)), F.lit(0.1))
    drawn = F.xxhash64(F.lit(seed), F.col(id), F.col(text))
    key = F.log(-F.log((F.pmod(drawn, F.lit(1 << 52)) + 0.5) / (1 << 52))) - F.log(quality)
    marked = docs.select(
        F.struct("*").alias("_row"), words.alias("_size"), key.alias("_key"), drawn.alias("_mark"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("-")).alias("_source"))
    sized = stored(marked.select("_source", "_size", "_key", "_mark"), "sizes")
    sources = stored(_targets(sized, weights, percent, most), "sources")
    cuts = stored(_cuts(sized, sources), "cuts")
    small = cuts.count() <= broadcast_sources
    joined = marked.join(F.broadcast(cuts) if small else cuts, "_source")
    behind = F.struct("_key", "_mark") < F.struct(F.col("_cut._key"), F.col("_cut._mark"))
    at = F.struct("_key", "_mark") == F.struct(F.col("_cut._key"), F.col("_cut._mark"))
    part = F.when(F.col("_rest") == 0, 0).when(behind, F.col("_size")).when(at, F.col("_part")).otherwise(0)
    taken = F.col("_epochs") * F.col("_size") + part
    return joined.withColumn("_taken", taken.cast("long")).select("_row", *_RESULTS)


def _targets(sized: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """(source, source size, target, epochs, rest) of each source."""
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    ranked = with_position(stored(sizes.withColumn("_absent", F.col("_source") == "-"), "sums"), ["_absent", "_source"])
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int"))
    facts = stored(ranked.select("_source", "_source_size", turn.alias("_weight"), (most * F.col("_source_size")).alias("_most")), "facts")
    whole = facts.agg(F.sum("_source_size"), F.sum("_weight")).first()
    level, full, share = 0.0, -1, (whole[0] or 0) * percent / 100
    level = share / whole[1] if whole[1] else 0.0
    while True:
        above = F.col("_most") <= F.lit(level) * F.col("_weight")
        number, capped, free = facts.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0))).first()
        if number == full or not free:
            break
        full, level = number, (share - capped) / free
    target = F.least(F.col("_most").cast("double"), F.lit(level) * F.col("_weight"))
    budget = F.round(F.col("_target")).cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(0).cast("long")
    return facts.withColumn("_target", target).withColumn("_epochs", epochs).select(
        "_source", "_source_size", "_target", "_epochs", (budget - F.col("_epochs") * F.col("_source_size")).alias("_rest"))


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The facts of each source, with the key at which its rest is spent and what is left for the rows there."""
    ends = sources.where("_rest > 0").select("_source", F.col("_rest").alias("_left"))
    rows = sized.where("_size > 0")
    for step in (1 << 10, 1 << 30):
        ranged = rows.withColumn("_range", F.floor(F.col("_key") * step))
        ends = stored(_ending(ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum")), ends, "_range"), "ranges")
        rows = stored(ranged.join(ends.select("_source", "_range"), ["_source", "_range"], "left_semi").drop("_range"), "rows")
        ends = ends.drop("_range", "_sum")
    at = rows.groupBy("_source", F.struct("_key", "_mark").alias("_cut")).agg(F.sum("_size").alias("_sum"), F.max("_size").alias("_whole"))
    found = _ending(at, ends, "_cut")
    part = F.floor(F.col("_left") / (F.col("_sum") / F.col("_whole"))).cast("long").alias("_part")
    return sources.join(found.select("_source", "_cut", part), "_source", "left")


def _ending(sums: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """Of each source the row in which its running sum reaches ``_left``, and what is then left."""
    before = Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(ends, "_source")
    reached = running.where("_before < _left and _left <= _before + _sum")
    return reached.withColumn("_left", F.col("_left") - F.col("_before")).drop("_before")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Whole documents, each as often as the mix takes it; one that gives a part stays if it gives half or more."""
    copies = F.floor(F.col("_taken") / F.greatest(F.col("_size"), F.lit(1)) + 0.5).cast("int")
    repeated = _mixed(docs, id, text, source, **options).select("_row", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select("_row.*")

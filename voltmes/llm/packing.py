"""Best-fit-decreasing packing of documents into sequences of equal length.

Documents of one length are alike to the algorithm, so it runs on the counts of lengths, at most one per length up
to the sequence's, whatever the number of documents. A segment tree over the remaining capacities finds the
tightest open sequences. What comes out is where the first, second, ... document of each length goes; a document
then needs only its number among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.llm.text import blocks
from voltmes.llm.tokens import encoder, with_end
from voltmes.session import stored

SIZE = 4096
#: Documents of one length are numbered in groups of about so many.
GROUP = 10_000
_PIECES = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Capacities:
    """A segment tree over remaining capacities; a node tells whether any capacity below it is open."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        at = self.leaves + capacity
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least open capacity of at least ``length``, in logarithmic time."""
        at = self.leaves + length
        while not self.open[at]:
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first number, documents per sequence, first sequence, offset), sorted; counts are by length.

    From ``first number`` on, ``per`` documents of that length go to ``first sequence``, the next ``per`` to the one
    after it, and so on, each sequence being filled from ``offset`` on. Sequences with the same past have
    neighbouring numbers and are moved together. The result is that of placing one document after the other.
    """
    tree, runs, plan, opened = Capacities(size), {}, [], 0

    def put(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            runs.setdefault(capacity, []).append((first, number))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                first, wide, capacity = opened, -(-left // (size // length)), size
                opened += wide
            else:
                first, wide = runs[capacity].pop()
                tree.set(capacity, bool(runs[capacity]))
            per = capacity // length
            full = min(wide, left // per)
            if full:
                plan.append((length, number, per, first, size - capacity))
                put(capacity - per * length, first, full)
                number, left = number + full * per, left - full * per
            if full < wide and left:
                plan.append((length, number, per, first + full, size - capacity))
                put(capacity - left * length, first + full, 1)
                put(capacity, first + full + 1, wide - full - 1)
                left = 0
            elif full < wide:
                put(capacity, first + full, wide - full)
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def pieces(text: Column | str, tokenizer: str, end: int = 1, size: int = SIZE) -> Column:
    """array<struct<piece, start, length, ids_crc32>>: a text's ids and ``end``, cut after every ``size`` ids."""

    @F.arrow_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = []
            for block in blocks(column):
                ids, bounds = with_end(*encoder(tokenizer).encode(block), end)
                number = -(-np.diff(bounds) // size)
                first = np.concatenate([[0], np.cumsum(number)])
                piece = np.arange(first[-1]) - np.repeat(first[:-1], number)
                start = piece * size
                length = np.minimum(np.repeat(np.diff(bounds), number) - start, size)
                low = (np.repeat(bounds[:-1], number) + start).tolist()
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(low, length.tolist())]
                parts.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], fields=list(_PIECES))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_PIECES))

    return of(text)


def pack(rows: DataFrame, length: str = "length", order: tuple[str, ...] = (), size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``; lengths are 1 to ``size``. ``order`` makes reruns agree.

    The rows are read twice: give a written table. Only rows of equal ``order`` may be exchanged by a rerun.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}
    if not counts:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = best_fit(counts, size)
    keys = plan[:, 0] << 44 | plan[:, 1]

    @F.arrow_udf("struct<sequence_id long, offset long>")
    def placed(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        n, t = lengths.cast(pa.int64()).to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)
        _, start, per, first, offset = plan[np.searchsorted(keys, n << 44 | t, side="right") - 1].T
        t = t - start
        return pa.StructArray.from_arrays([pa.array(first + t // per), pa.array(offset + t % per * n)], ["sequence_id", "offset"])

    # A length with many documents is numbered in several groups, by a hash that a rerun gives again.
    groups = F.create_map(*[F.lit(x) for k, v in counts.items() if v > group for x in (k, -(-v // group))]) if max(counts.values()) > group else None
    several = F.coalesce(groups[F.col(length)], F.lit(1)) if groups is not None else F.lit(1)
    hashed = F.xxhash64(*(order or rows.columns))
    grouped = rows.withColumn("_group", F.pmod(hashed, several).cast("long"))
    before = Window.partitionBy("_length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy(F.col(length).alias("_length"), "_group").count().select(
        "_length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length, "_group").orderBy(*(order or rows.columns))
    numbered = grouped.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, (F.col(length) == F.col("_length")) & numbered["_group"].eqNullSafe(starts["_group"]))
    found = joined.select(*[numbered[c] for c in rows.columns], placed(F.col(length), F.col("_before") + F.col("_inside")).alias("_place"))
    return found.select(*rows.columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 1, size: int = SIZE) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A null text is an empty one and gives the end id alone; a null id is carried along. Repeated rows are packed as
    often as they occur. Only a text of over ``size`` ids is cut. Other columns are not read.
    """
    cut = docs.select(F.col(id).alias("id"), F.explode(pieces(F.col(text), tokenizer, end, size)).alias("p")).select("id", "p.*")
    found = pack(stored(cut, "pieces"), order=("id", "piece", "start", "length", "ids_crc32"), size=size)
    return found.withColumnRenamed("id", id)

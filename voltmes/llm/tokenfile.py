"""Token files: the ids of all documents in ascending order of their ids, as Simple-8b blocks.

A file is a Parquet table of blocks, so Spark writes and reads it in any store and a lost task leaves nothing behind.
Documents are dealt into key ranges ("shards"), sorted there, and a block holds some whole documents of a shard:
``shard``, ``start`` (ids of the shard before it), ``n_tokens``, ``ids`` and ``lengths`` of its documents, ``payload``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voltmes.llm import simple8b
from voltmes.llm.text import blocks
from voltmes.llm.tokens import encoder, with_end

BLOCK = 4 << 20
_BLOCKS = "shard int, start long, n_tokens long, ids array<long>, lengths array<long>, payload binary"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 0, shards: int | None = None,
) -> None:
    """Writes every row; a null text is an empty one and has the end id only, null ids come first.

    Rows with one id follow one another in an order that reruns give again. ``shards`` is the number of key ranges,
    by default that of shuffle partitions. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(shards, "id", "mark").sortWithinPartitions("id", "mark", "text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            done = 0
            for block in blocks(batch.column(2), BLOCK):
                ids, bounds = with_end(*encoder(tokenizer).encode(block), end)
                own = batch.column(1).slice(done, len(block))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[0].as_py()], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                    pa.array([np.diff(bounds)], pa.list_(pa.int64())), pa.array([simple8b.encode(ids)], pa.binary()),
                ], ["shard", "start", "n_tokens", "ids", "lengths", "payload"])
                start, done = start + len(ids), done + len(block)

    dealt.select(F.spark_partition_id().alias("shard"), "id", "text").mapInArrow(coded, _BLOCKS).write.parquet(path)


def _read(spark: SparkSession, path: str, out: str, kind: str, of: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """(id, start, n_tokens, ``out``) of each document; ``of`` makes a column from a block's numbers and bounds."""
    table = spark.read.schema(_BLOCKS).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard, whatever the number of documents.
    offsets = table.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                numbers = simple8b.decode(batch.column(4)[i].as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), batch.column(0)[i].as_py()), pa.int32()), ids,
                    pa.array(batch.column(1)[i].as_py() + bounds[:-1], pa.int64()), pa.array(lengths), of(numbers, bounds),
                ], ["shard", "id", "inside", "n_tokens", out])

    found = table.select("shard", "start", "ids", "lengths", "payload").mapInArrow(
        decoded, f"shard int, id long, inside long, n_tokens long, {out} {kind}")
    return found.join(offsets, "shard").select("id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) of each document; ``start`` counts the ids of all documents before it."""
    def tokens(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(numbers.astype(np.int64)))

    return _read(spark, path, "tokens", "array<long>", tokens)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, the checksum over its ids as little-endian 32-bit numbers."""
    def digests(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
        raw, low = memoryview(numbers.astype("<u4")).cast("B"), bounds.tolist()
        return pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(low[:-1], low[1:])], pa.int64())

    return _read(spark, path, "ids_crc32", "long", digests)

"""Fill-in-middle documents, cut between words by SWAR arithmetic on eight bytes at a time.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. The UTF-8 of
a text is viewed as 64-bit words, whose bytes that end a unit get their top bit by carries and shifts. ``bitwise_count``
counts them per word, a search in the running counts finds the word that holds the unit asked for, and clearing lowest
bits finds the byte inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voltmes.llm.text import SPACE, Block, blocks

#: What goes before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of 100 documents so many are rearranged, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
_EACH = 0x0101010101010101
_TOP, _LOW = np.uint64(0x80 * _EACH), np.uint64(0x7F * _EACH)
_KIND = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _from(low: np.ndarray, least: int) -> np.ndarray:
    """The top bit of each byte whose lower seven bits are ``least`` or more."""
    return low + np.uint64((0x80 - least) * _EACH) & _TOP


def unit_ends(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(marks, first): words with the top bit of every byte that ends a unit, and the index of each text's first word.

    Every text starts on a word of its own and is followed by at least one space, up to the end of its last word.
    """
    data, bounds = block
    lengths = np.diff(bounds)
    first = np.concatenate([[0], np.cumsum(lengths // 8 + 1)])
    padded = np.full(8 * int(first[-1]), 32, np.uint8)
    for at, low, high in zip((8 * first[:-1]).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        padded[at:at + high - low] = data[low:high]
    words = padded.view("<u8")
    low = words & _LOW
    other = words ^ np.uint64(32 * _EACH)
    blank = ~(((other & _LOW) + _LOW) | other)
    control = _from(low, 9) & ~_from(low, 14) & ~words
    space = (blank | control) & _TOP
    after = space >> np.uint64(8)
    after[:-1] |= space[1:] << np.uint64(56)
    marks = ~space & after & _TOP
    # White space at the end of a text.
    last = np.flatnonzero(lengths)
    last = last[SPACE[data[bounds[1:][last] - 1]]]
    at = lengths[last] - 1
    marks[first[last] + at // 8] |= np.uint64(0x80) << (at % 8 * 8).astype(np.uint64)
    return marks, first


def select(marks: np.ndarray, running: np.ndarray, first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Bytes up to the end of the unit of that rank in each text, counted from 1; 0 for rank 0."""
    wanted = running[first] + rank
    word = np.maximum(np.searchsorted(running, wanted) - 1, first)
    left, bits = wanted - running[word], marks[word]
    while (more := left > 1).any():
        bits = np.where(more, bits & bits - np.uint64(1), bits)
        left = left - more
    lowest = bits & (~bits + np.uint64(1))
    inside = np.bitwise_count(lowest - np.uint64(1)) // 8
    return np.where(rank > 0, 8 * (word - first) + inside + 1, 0)


def cuts(block: Block, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of prefix, end of middle) per text in bytes, from two draws of any size."""
    marks, first = unit_ends(block)
    running = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])
    n = running[first[1:]] - running[first[:-1]]
    one, other = one % (n + 1), other % (n + 1)
    return n, select(marks, running, first[:-1], np.minimum(one, other)), select(marks, running, first[:-1], np.maximum(one, other))


@F.arrow_udf(StructType([StructField(name, LongType()) for name in _KIND.names]))
def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, one, other in batches:
        one, other, at, parts = one.to_numpy(), other.to_numpy(), 0, []
        for block in blocks(texts):
            to = at + len(block)
            found = cuts(block, one[at:to], other[at:to])
            parts.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(_KIND)))
            at = to
        yield pa.concat_arrays(parts) if parts else pa.array([], _KIND)


def _draws(id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 that depend on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    prefix, suffix, middle = sentinels
    if len({prefix, suffix, middle}) < 3 or any(not s or other.find(s[0], 1) > 0 for s in sentinels for other in sentinels):
        raise ValueError("sentinels differ, and their first characters stand nowhere else in them")
    return prefix, suffix, middle


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. Texts with a sentinel are left plain, so each stands once."""
    parts = F.split(output, "|".join(re.escape(s) for s in _checked(sentinels)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(
        form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
    sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row; other columns are not read.

    ``n`` counts the units of the whole text. Of 100 documents about ``rate`` are cut into prefix, middle and suffix at two
    places between units, and written as prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``, in about
    ``suffix_first`` of 100), each part behind its sentinel. Any part may be empty. Empty texts and texts that hold a
    sentinel stay ``plain``; their lengths of parts are null. A null text is an empty one, a null id draws like an empty
    one. Equal rows give equal rows. Nothing is shuffled.
    """
    prefix_mark, suffix_mark, middle_mark = _checked(sentinels)
    h = _draws(F.col("i"), seed)
    rows = docs.select(F.col(id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.array(*h))
    one, other, rearranged, order = (F.col("h")[i] for i in range(4))
    # Not to be run once for each column that uses it.
    rows = rows.withColumn("c", _cut.asNondeterministic()("t", one, other))
    plain = (F.col("t") == "") | (rearranged % 100 >= rate)
    for mark in sentinels:
        plain = plain | F.contains("t", F.lit(mark))
    form = F.when(plain, "plain").when(order % 100 < suffix_first, "spm").otherwise("psm")
    low, high, raw = F.col("c.low").cast("int"), F.col("c.high").cast("int"), F.col("t").cast("binary")

    def part(start: Column, length: Column) -> Column:
        return F.substring(raw, start + 1, length).cast("string")

    rows = rows.withColumn("form", form).select(
        "i", "t", "c.n", "form", part(F.lit(0), low).alias("p"), part(low, high - low).alias("m"), part(high, F.octet_length("t") - high).alias("s"))
    prefix, suffix, middle = F.concat(F.lit(prefix_mark), "p"), F.concat(F.lit(suffix_mark), "s"), F.concat(F.lit(middle_mark), "m")
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(
        F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("t"))
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("i").alias(id), "n", "form", F.when(cut, F.length("p").cast("long")).alias("prefix_chars"),
        F.when(cut, F.length("m").cast("long")).alias("middle_chars"), output.alias("output"))

"""Quality rules on repetition inside a text, from a suffix array over its words.

Suffixes are sorted by doubling: ranks by the first h words give ranks by 2h words, for the suffixes that are not
yet alone. A repeat is an interval of neighbours in that order with a long common prefix. A suffix's longest repeat
is the prefix of its deepest interval, and the repeated part of a text is the union of those prefixes. All texts of
a block are worked on together; a text of n words costs n log n, also if it is one word n times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.llm.text import SPACE, Block, blocks, by_owner, let_go, lists, new_runs, owners, powers, span_hashes, sums, words

#: Shortest repeat in words; a repeat of a passage is a sign of junk if it covers much of the text or is long.
MIN_WORDS = 8
MAX_COVERED = 40
MAX_LONGEST = 50
MIN_TEXT = 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def suffix_order(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All positions, sorted by text and then by the suffix of the text that begins there."""
    owner, n = owners(first), len(symbol)
    stop = first[1:][owner]
    order = by_owner(owner, symbol)
    fresh = new_runs(owner[order], symbol[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    places, step = np.flatnonzero(~(fresh & np.append(fresh[1:], True))), 1
    while len(places):
        at = order[places]
        ahead = at + step
        following = np.where(ahead < stop[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 2) + following
        within = np.argsort(key)
        at, key = at[within], key[within]
        order[places] = at
        fresh = new_runs(key)
        rank[at] = np.maximum.accumulate(np.where(fresh, places, 0))
        places, step = places[~(fresh & np.append(fresh[1:], True))], 2 * step
    return order


def longest_repeats(symbol: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """At each position the length of the longest passage from there that its text holds twice; 0 if under ``least``."""
    n, owner = len(symbol), owners(first)
    if not n:
        return np.zeros(0, np.int64)
    order = suffix_order(symbol, first)
    stop = first[1:][owner]
    up, down = powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(symbol * up[:n])])

    def same(i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (total[i + length] - total[i]) * down[i] == (total[j + length] - total[j]) * down[j]

    i, j = order[:-1], order[1:]
    room = np.where(owner[i] == owner[j], stop[i] - np.maximum(i, j), 0)
    pairs = np.flatnonzero(room >= least)
    pairs = pairs[same(i[pairs], j[pairs], np.full(len(pairs), least))]
    low, high = np.full(len(pairs), least), room[pairs]
    while (low < high).any():
        middle = (low + high + 1) // 2
        fits = same(i[pairs], j[pairs], middle)
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    common = np.zeros(n + 1, np.int64)
    common[pairs + 1] = low
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(common[:-1], common[1:])
    return longest


def _repeated_lines(block: Block, starts: np.ndarray) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line."""
    data, bounds = block
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    owner = np.searchsorted(bounds, begins, side="right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begins)], bounds[1:][owner])
    real = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    owner, line = owner[real], span_hashes(data, begins[real], ends[real])
    order = by_owner(owner, line)
    return sums(owner, len(block)) - sums(owner[order][new_runs(owner[order], line[order])], len(block))


def measure(block: Block, least: int) -> dict[str, np.ndarray]:
    starts, ends, first = words(block)
    data, bounds, count, owner = block.data, block.bounds, len(block), owners(first)

    def per_text(flags: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return running[bounds[1:]] - running[bounds[:-1]]

    lead = ((data & 0xC0) != 0x80) & ~SPACE[data]
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    longest = longest_repeats(span_hashes(data, starts, ends), first, least)
    n = len(longest)
    at = np.flatnonzero(longest)
    depth = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    covered = np.cumsum(depth[:-1]) > 0
    opens = covered & (new_runs(owner) | np.concatenate([[True], ~covered[:-1]])) if n else covered
    spans = np.flatnonzero(opens)
    length = np.diff(np.append(np.cumsum(covered)[spans] - 1, covered.sum()))
    top = np.zeros(count, np.int64)
    np.maximum.at(top, owner[at], longest[at])
    return {
        "n_words": sums(owner, count), "word_chars": per_text(lead), "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": _repeated_lines(block, starts), "n_repeat_words": sums(owner[covered], count),
        "repeat_chars": sums(owner[covered], count, (chars[ends] - chars[starts])[covered]), "longest_repeat": top,
        "spans": pa.ListArray.from_arrays(
            pa.array(np.searchsorted(spans, first), pa.int32()),
            pa.StructArray.from_arrays([pa.array(spans - first[:-1][owner[spans]]), pa.array(length)], ["start", "words"])),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat")
_KIND = pa.struct([(name, pa.int64()) for name in _COUNTS] + [("spans", _SPANS)])


def repetition(text: Column | str, least: int = MIN_WORDS) -> Column:
    """struct of counts and ``spans``, the merged repeated passages as (first word, words). Null is an empty text.

    ``n_repeat_words`` are the words in passages of ``least`` words or more that the text holds twice, the first time
    included; ``repeat_chars`` are their characters, ``longest_repeat`` is the longest such passage in words.
    """

    @F.arrow_udf("struct<" + ", ".join(f"{name} long" for name in _COUNTS) + ", spans array<struct<start long, words long>>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for column in batches:
            parts = []
            for block in blocks(column):
                found = measure(block, least)
                parts.append(pa.StructArray.from_arrays(
                    [found[f.name] if f.name == "spans" else pa.array(found[f.name], f.type) for f in _KIND], fields=list(_KIND)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _KIND)

    # Not to be run once for the filter and once more for the columns.
    return of.asNondeterministic()(text)


def verdicts(measures: str = "repetition", max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, min_text: int = MIN_TEXT) -> tuple[Column, Column]:
    """(base_failed, kept) from the struct of ``repetition``.

    The base fails texts under ``min_text`` words and those whose repeated passages hold over 30 % of the words.
    The method also drops a text if they hold over ``max_covered`` % of its characters or if the longest has over
    ``max_longest`` words.
    """
    m = F.col(measures)
    failed = (m["n_words"] < min_text) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    kept = ~failed & (100 * m["repeat_chars"] <= max_covered * m["word_chars"]) & (m["longest_repeat"] <= max_longest)
    return failed, kept


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """(id, counts, spans, base_failed, kept) for every row; other columns are not read."""
    failed, kept = verdicts("r", **limits)
    measured = docs.select(F.col(id).alias("i"), repetition(F.col(text)).alias("r"))
    return measured.select(F.col("i").alias(id), "r.*", failed.alias("base_failed"), kept.alias("kept"))


def keep_unrepetitive(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """The rows that ``quality`` keeps, whole and with their own columns only."""
    name = "_repetition"
    while name in docs.columns:
        name = f"_{name}"
    return docs.withColumn(name, repetition(F.col(text))).where(verdicts(name, **limits)[1]).drop(name)

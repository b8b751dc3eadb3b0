"""Phrases of several words that stand together, found by dynamic itemset counting.

The texts are dealt into shards, which are scanned in a circle, and phrases of all lengths are counted in the same scans. Words are counted
from the first shard on. As soon as the counts so far of both subphrases of a longer phrase (all words but the last,
all but the first) reach the threshold, the longer one is counted from the next shard on, until it has been through
each shard once. So a phrase counted from step s on is complete after step s + shards - 1, and most long phrases are
complete long before as many whole scans as words have been made.

What is active follows from the steps in which subphrases reached the threshold. A task sees these steps in a table of fixed
size by hash, which lets through too much at worst; of the phrases that it counted those at places (again by hash) where one
stands often enough in any shard meet the exact steps in a join, and only counts from a phrase's own first step on are
added up.

Most pairs of words are rare. Before the scans all pairs are counted by hash alone, 4 bytes each, in ranges of hashes; a pair at a place
where too few stand in all shards together can't be frequent and is never counted by its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.llm.text import Block, blocks, mix, span_hashes, words
from voltmes.session import scratch_path, stored

LEAST, LONGEST, TOP, CONTAINED = 30, 4, 2000, 80
SHARDS = 2
#: Places of the table of steps (a power of two; a byte each), whatever the number of phrases.
SLOTS = 1 << 24
#: Places of the table of pairs of words (a power of two; a bit each), whatever the number of pairs.
PAIR_SLOTS = 1 << 27
#: Pairs of words that a task sorts at once, 4 bytes each; the ranges of hashes hold about so many.
SORTED_PAIRS = 1 << 22
#: Texts counted together before their counts leave the task, in bytes.
COUNTED_BYTES = 3 << 21
#: Parts of a language ranked apart before the best of all parts are ranked together.
PARTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13] + [ord(c) for c in ".,;:!?"]] = True
_CUT = _BREAK.copy()
_CUT[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in lower case (A-Z), text of each word, whether the next word follows in the same piece)."""
    data, bounds = block
    data = _LOWER[data]
    cut = _CUT[data]
    first, last = cut.copy(), cut.copy()
    if len(data):
        first[1:], last[:-1] = cut[:-1], cut[1:]
        first[bounds[bounds < len(data)]] = True
        last[bounds[bounds > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~cut), np.flatnonzero(last & ~cut) + 1
    text = np.repeat(np.arange(len(block)), np.diff(np.searchsorted(starts, bounds)))
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data], dtype=np.int64)])
    followed = np.zeros(len(starts), bool)
    followed[:-1] = (text[1:] == text[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return spans(data, starts, ends), text, followed


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as strings."""
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    gathered = data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(gathered))


def numbered(block: Block, lang: np.ndarray) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(lang, n, words, codes) for each language of a block: its different words, and its texts as their numbers, -1 behind each piece."""
    spelled, text, followed = pieces(block)
    spelled = spelled.dictionary_encode()
    code, lang = spelled.indices.to_numpy(), lang[text]
    for one in np.unique(lang):
        own = lang == one
        number, place = code[own], np.zeros(len(spelled.dictionary), np.int32)
        used = np.flatnonzero(np.bincount(number, minlength=len(place)))
        place[used] = np.arange(len(used))
        number, ends = place[number], ~followed[own]
        codes = np.full(len(number) + int(ends.sum()), -1, np.int32)
        codes[np.arange(len(number)) + np.cumsum(ends) - ends] = number
        yield int(one), len(number), spelled.dictionary.take(pa.array(used)).cast(pa.string()), codes


class Sequence:
    """The numbered words of texts of one language."""

    def __init__(self, lang: pa.Scalar, words_: pa.Array, codes: np.ndarray) -> None:
        lang_hash = string_hashes(pa.array([lang.as_py()]))
        self.lang, self.words, self.codes = lang, words_, codes.astype(np.int64)
        word = codes >= 0
        #: Hashes of the phrases of 1, 2, ... words from each place on, as ``slots_of`` has them.
        self.hashes = [_started(string_hashes(words_), lang_hash)[codes]]
        #: Whether that many words from each place on stand in one piece.
        self.whole = [word]
        for size in range(2, LONGEST + 1):
            self.hashes.append(_continued(self.hashes[-1][:-1], self.hashes[0][size - 1:]))
            self.whole.append(self.whole[-1][:-1] & word[size - 1:])

    def active(self, size: int, steps: np.ndarray, after: int) -> np.ndarray:
        """Where a phrase of that size starts whose subphrases have both reached the threshold, one in step ``after`` or later."""
        if size == 1:
            return np.flatnonzero(self.whole[0])
        reached = steps[_slot(self.hashes[size - 2], len(steps))]
        one, other = reached[:-1], reached[1:]
        return np.flatnonzero(self.whole[size - 1] & (np.minimum(one, other) > 0) & (np.maximum(one, other) > after))

    def pairs(self) -> np.ndarray:
        """The hashes of 4 bytes of all pairs of words."""
        return _short(self.hashes[1][self.whole[1]])

    def listed(self, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Those of the places where a pair starts that a table of pairs holds."""
        place = _short(self.hashes[1][at]) // np.uint32((1 << 32) // (8 * len(bits)))
        return at[(bits[place >> np.uint32(3)] >> (np.uint8(7) - (place & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).view(bool)]

    def grouped(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place, how often) for each different phrase of that size that starts at one of the places."""
        key = self.codes[at]
        if size == 2:
            key = key * len(self.words) + self.codes[at + 1]
        elif size > 2:
            pairs = self.codes[np.concatenate([at, at + size - 2])] * len(self.words) + self.codes[np.concatenate([at + 1, at + size - 1])]
            found, key = np.unique(pairs, return_inverse=True)
            key = key[:len(at)] * len(found) + key[len(at):]
        _, place, count = np.unique(key, return_index=True, return_counts=True)
        return at[place], count

    def phrases(self, size: int, at: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[at + i])) for i in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole string."""
    found = [span_hashes(b.data, b.bounds[:-1], b.bounds[1:]) for b in blocks(strings, COUNTED_BYTES)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _started(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word + lang * _STEP)


def _continued(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(phrase * _STEP + word)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The upper halves, which have no part in ``_slot``."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def slots_of(phrases: pa.Array, langs: pa.Array, slots: int) -> np.ndarray:
    """The place of each phrase in a table of steps."""
    langs, parts, at = langs.dictionary_encode(), [], 0
    lang_hash, code = string_hashes(langs.dictionary), langs.indices.to_numpy()
    for block in blocks(phrases, COUNTED_BYTES):
        starts, ends, first = words(block)
        lang = lang_hash[code[at:at + len(block)]]
        at += len(block)
        hashes = span_hashes(block.data, starts, ends)
        size = np.diff(first)
        found = _started(hashes[first[:-1]], lang)
        for k in range(1, int(size.max(initial=0))):
            longer = np.flatnonzero(size > k)
            found[longer] = _continued(found[longer], _started(hashes[first[:-1][longer] + k], lang[longer]))
        parts.append(_slot(found, slots))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# Scans.

_DEALT = "shard int, lang string, n long, words array<string>, codes binary"


def _dealt(docs: DataFrame, lang: str, text: str, shards: int) -> DataFrame:
    """The texts in blocks of one language, numbered word by word, dealt into shards block by block."""
    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for table in tables:
            langs, at = table.column("lang").dictionary_encode(), 0
            code = langs.indices.to_numpy()
            for block in blocks(table.column("text"), COUNTED_BYTES):
                for one, n, words_, codes in numbered(block, code[at:at + len(block)]):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard % shards], pa.int32()), langs.dictionary.take(pa.array([one])), pa.array([n], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(words_)], pa.int32()), words_), pa.array([codes.astype("<i4").tobytes()], pa.binary()),
                    ], ["shard", "lang", "n", "words", "codes"])
                at += len(block)
                shard += 1

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    path = scratch_path(docs.sparkSession, "shards")
    rows.mapInArrow(batches, _DEALT).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(_DEALT).parquet(path)


def _packed(table: np.ndarray) -> bytes:
    """A table, most of which is empty, as it travels to the tasks; Spark would write it to disks byte for byte."""
    return zlib.compress(table.tobytes(), 1)


def _frequent_pairs(texts: DataFrame, least: int, slots: int, together: int) -> np.ndarray:
    """A bit for each place of the pairs of words that stand ``least`` times or more in all shards, and for few other places."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    parts = 1 << min(slots.bit_length() - 4, max(6, (total // together).bit_length()))

    def dealt(batches: list[np.ndarray]) -> pa.RecordBatch:
        short = np.sort(np.concatenate(batches))
        # More than ``least`` of one hash tell no more than ``least``.
        keep = np.ones(len(short), bool)
        keep[least:] = short[least:] != short[:-least]
        short = short[keep].astype("<u4")
        ends = np.searchsorted(short, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 32) // parts))
        runs = [(part, own.tobytes()) for part, own in enumerate(np.split(short, ends)) if len(own)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], ["part", "hashes"])

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in _sequences(tables):
            held.append(found.pairs())
            n += len(held[-1])
            if n >= together:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    def counted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        short = np.sort(np.frombuffer(b"".join(rows.column("hashes").to_pylist()), "<u4"))
        often = short[least - 1:][short[least - 1:] == short[:max(0, len(short) - least + 1)]]
        width, own = (1 << 32) // slots, np.zeros(slots // parts, bool)
        own[often.astype(np.int64) // width - key[0].as_py() * len(own)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([_packed(np.packbits(own))], pa.binary())})

    ranges = texts.select("lang", "words", "codes").mapInArrow(batches, "part int, hashes binary").groupBy("part")
    bits = np.zeros((parts, slots // parts // 8), np.uint8)
    for part, own in zip(*ranges.applyInArrow(counted, "part int, bits binary").toArrow().to_pydict().values()):
        bits[part] = np.frombuffer(zlib.decompress(own), np.uint8)
    return bits.reshape(-1)


def _sequences(tables: Iterator[pa.RecordBatch]) -> Iterator[Sequence]:
    for table in tables:
        for row in range(table.num_rows):
            lang, words_, codes = (table.column(name)[row] for name in ("lang", "words", "codes"))
            yield Sequence(lang, words_.values, np.frombuffer(codes.as_buffer(), "<i4"))


def _counted(shard: DataFrame, sizes: list[int], steps: np.ndarray, after: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(lang, size, phrase, c): how often the active phrases of the sizes stand in the shard, some inactive ones among them.

    Pairs of words that a table ``pairs`` doesn't hold are left out.
    """
    packed, listed = _packed(steps), None if pairs is None else _packed(pairs)

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.frombuffer(zlib.decompress(packed), np.int8)
        pairs = None if listed is None else np.frombuffer(zlib.decompress(listed), np.uint8)
        for found in _sequences(tables):
            for size in sizes:
                at = found.active(size, steps, after)
                place, count = found.grouped(size, found.listed(at, pairs) if size == 2 and pairs is not None else at)
                if len(place):
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(found.lang, len(place)), pa.array(np.full(len(place), size, np.int32)), found.phrases(size, place),
                        pa.array(_slot(found.hashes[size - 1][place], len(steps)).astype(np.int32)), pa.array(count, pa.int64())],
                        ["lang", "size", "phrase", "slot", "c"])

    counted = shard.select("lang", "words", "codes").mapInArrow(batches, "lang string, size int, phrase string, slot int, c long")
    return counted.groupBy("lang", "size", "phrase", "slot").agg(F.sum("c").alias("c"))


def _at_slots(counts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The rows at the wanted places, without a join or a shuffle of the others."""
    packed = _packed(np.packbits(wanted))

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).view(bool)
        for table in tables:
            yield table.filter(pa.array(wanted[table.column("slot").to_numpy()]))

    return counts.mapInArrow(batches, counts.schema)


def _first(words_: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {words_})")


def _rest(words_: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', -({words_}))")


def frequent_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", *, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to ``longest`` (4 at most) words that stand ``least`` times or more, and (lang, n)."""
    if not 1 <= longest <= LONGEST or slots & slots - 1 or not 1 <= shards <= 30:
        raise ValueError("phrases have 1 to 4 words, slots are a power of two, shards 1 to 30")
    spark = docs.sparkSession
    texts, path = _dealt(docs, lang, text, shards), scratch_path(spark, "phrases")
    counts = "lang string, size int, phrase string, slot int, c long, step int, likely boolean"
    facts = "lang string, size int, phrase string, f long, reached boolean, complete boolean, step int"

    def table(name: str, schema: str, condition: Column) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}").where(condition)

    pairs = _frequent_pairs(texts, max(1, least), PAIR_SLOTS, SORTED_PAIRS) if longest > 1 else None
    # One more than the last step in which a phrase of that place reached the threshold; 0 for none.
    steps, last = np.zeros(slots, np.int8), {}
    for step in range(longest * shards):
        oldest = step - shards
        sizes = [size for size in range(1, longest + 1) if (oldest < 0 if size == 1 else last.get(size - 1, -1) >= max(0, oldest))]
        if not sizes:
            break
        # A phrase that stands ``least`` times in all shards stands ``least / shards`` times in one of them.
        _counted(texts.where(F.col("shard") == step % shards), sizes, steps, oldest, pairs).withColumn("likely", F.col("c") * shards >= least).write.partitionBy(
            "likely").parquet(f"{path}/counts/step={step}")
        window = table("counts", counts, (F.col("step") > oldest) & (F.col("step") <= step))
        likely = np.zeros(slots, bool)
        likely[window.where("likely").select("slot").distinct().toArrow().column("slot").to_numpy()] = True
        # Few phrases stand often enough in the whole window; only those need their first step.
        each = [F.sum(F.when(F.col("step") == s, F.col("c")).otherwise(0)).alias(f"c{s}") for s in range(max(0, oldest + 1), step + 1)]
        summed = _at_slots(window.select("lang", "size", "phrase", "slot", "c", "step"), likely).groupBy("lang", "size", "phrase").agg(F.sum("c").alias("all"), *each)
        rows = _started_at(summed.where(F.col("all") >= least), table("facts", facts, F.col("reached")) if step else None).where(F.col("start") > oldest)
        total = sum((F.when(F.col("start") <= s, F.col(f"c{s}")).otherwise(0) for s in range(max(0, oldest + 1), step + 1)), F.lit(0))
        rows.withColumn("f", total).select(
            "lang", "size", "phrase", "f", (F.col("f") - F.col(f"c{step}") < least).alias("reached"), (F.col("start") == oldest + 1).alias("complete")).where(
            (F.col("f") >= least) & (F.col("reached") | F.col("complete"))).write.parquet(f"{path}/facts/step={step}")

        new = _slots(table("facts", facts, F.col("reached") & (F.col("size") < longest) & (F.col("step") == step)), slots).distinct().toArrow()
        steps[new.column("slot").to_numpy()] = step + 1
        last.update(dict.fromkeys(new.column("size").unique().to_pylist(), step))
    return table("facts", facts, F.col("complete")).select("lang", "size", "phrase", "f"), texts.groupBy("lang").agg(F.sum("n").alias("n"))


def _started_at(rows: DataFrame, reached: DataFrame | None) -> DataFrame:
    """Adds ``start``, the step after the one in which both subphrases had reached the threshold; null if they have not."""
    if reached is None:
        return rows.withColumn("start", F.lit(0))
    reached = reached.select("lang", "phrase", "step")
    parts = rows.withColumns({"one": _first("size - 1"), "other": _rest("size - 1")}).join(
        reached.toDF("lang", "one", "_one"), ["lang", "one"], "left").join(reached.toDF("lang", "other", "_other"), ["lang", "other"], "left")
    later = F.when(F.col("_one").isNotNull() & F.col("_other").isNotNull(), F.greatest("_one", "_other") + 1)
    return parts.withColumn("start", F.when(F.col("size") == 1, 0).otherwise(later))


def _slots(phrases: DataFrame, slots: int) -> DataFrame:
    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            found = slots_of(table.column("phrase"), table.column("lang"), slots)
            yield pa.RecordBatch.from_arrays([table.column("size"), pa.array(found)], ["size", "slot"])

    return phrases.select("size", "lang", "phrase").mapInArrow(batches, "size int, slot long")


# Scores.

def phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED,
    shards: int = SHARDS, slots: int = SLOTS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or more words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs;
    phrases lie inside a piece and stand ``least`` times or more. A cut of a phrase into a first part that stands l times
    and a rest that stands r times scores 2,000,000 a / (l + r), rounded down; the lowest cut counts, the first of equal ones. Phrases
    that lie in a longer one which stands ``contained`` % as often or more are left out. ``n`` is the number of words
    of the language. Order: score and a descending, phrase ascending by bytes.

    A null language is ``und``, a null text is empty; texts without a word add nothing, an empty table gives no rows.
    Repeated rows count as often as they stand. Other columns are not read.
    """
    found, lengths = frequent_phrases(docs, lang, text, least=least, longest=longest, shards=shards, slots=slots)
    found = stored(found, "phrases")
    longer = found.where("size > 1").withColumnRenamed("f", "a")

    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"one": _first("k"), "other": _rest("size - k")})
    cut = cut.join(found.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"]).join(
        found.select("lang", F.col("phrase").alias("other"), F.col("f").alias("r")), ["lang", "other"])
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(0), F.col("size") - k), lambda i: F.array_join(F.slice(F.split("phrase", " "), i + 1, k), " ")))))
    inside = longer.where("size > 2").select("lang", "a", part.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (100 * F.col("outer").cast("decimal(20, 0)") < contained * F.col("a").cast("decimal(20, 0)")))

    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")
    best = kept.withColumn("part", shard).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(lengths, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

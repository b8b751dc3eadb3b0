"""Near-duplicate documents by SuperMinHash signatures, bands, exact verification and union-find groups.

Every shingle draws one random permutation of the signature's slots and lands in slot ``p(j)`` with rank ``j`` plus
a fraction. The slots keep the least rank. The ranks of one shingle are correlated, which lowers the variance, and
level ``j`` is the last one needed as soon as no slot of a document holds a rank above ``j``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.llm.components import components
from voltmes.llm.text import BLOCK_BYTES, Block, blocks, by_owner, draw, let_go, lists, mix, new_runs, owners, span_hashes, sums, words
from voltmes.session import stored

#: Up to so many ids (some 32 MB) are sent to all tasks to pick their texts; more are joined with a shuffle.
BROADCAST_IDS = 2_000_000
#: Classes under one band key of several components from which they are compared by their rarest shingles instead.
CROWD = 16
#: Arrow batches of this size, unless the session names another than Spark's own 64 MB: rows hold many texts here.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")
#: Classes of one component that are compared with a class of another one in one go.
CHUNK = 32
#: Counters, 4 MB in all, that tell rare shingles from frequent ones.
COUNTERS = 1 << 20
_EMPTY = np.uint64(np.iinfo(np.uint64).max)


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of A-Z-lowered words, sorted. Fewer words than ``size``: all of them as one."""
    starts, ends, first = words(block)
    hashes, owner = span_hashes(block.data, starts, ends, lower=True), owners(first)
    left = first[1:][owner] - np.arange(len(owner))
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    value = np.zeros(len(hashes), np.uint64)
    for i in range(size):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + np.where(left > i, padded[i:i + len(hashes)], np.uint64(0)))
    whole = (left >= size) | (left == np.diff(first)[owner])
    owner, value = owner[whole], value[whole]
    order = by_owner(owner, value)
    owner, value = owner[order], value[order]
    fresh = new_runs(owner, value)
    return owner[fresh], value[fresh]


def signatures(owner: np.ndarray, seed: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """One row of least ranks per text; a rank is its level in the upper, its fraction in the lower half."""
    best = np.full((texts, slots), _EMPTY)
    flat = best.reshape(-1)
    places = np.empty((0, slots), np.uint8)
    for level in range(slots):
        pick = level + ((draw(seed, 2 * level) >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(seed))
        if level:
            slot = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[rows, level]
        else:
            slot = pick
        rank = np.uint64(level << 32) | draw(seed, 2 * level + 1) >> np.uint64(32)
        np.minimum.at(flat, owner * slots + slot, rank)
        busy = np.zeros(texts, bool)
        live = owner[new_runs(owner)]
        busy[live] = best[live].max(axis=1) >= np.uint64((level + 1) << 32)
        still = busy[owner]
        if not still.any():
            break
        if not level:
            places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(still.sum()), 1))
            places[np.arange(len(places)), pick[still]] = 0
        elif not still.all():
            places = places[still]
        owner, seed = owner[still], seed[still]
    return best


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(best), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(best), np.uint64(band + 1))
        for row in range(rows):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + best[:, band * rows + row])
        keys[:, band] = key
    return keys


def sketch(text: Column | str, size: int, bands: int, rows: int) -> Column:
    """struct<n: set size, a, b: a digest of the set, bands: its band keys (null for an empty set)>."""

    @F.arrow_udf("struct<n long, a long, b long, bands array<long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for column in batches:
            parts = []
            for block in blocks(column, BLOCK_BYTES // 2):
                owner, value = shingles(block, size)
                count = len(block)
                n = sums(owner, count)
                digests = []
                for salt in (1, 2):
                    total = np.concatenate([[0], np.cumsum(draw(value, salt))]).astype(np.uint64)
                    ends = np.cumsum(n)
                    digests.append((total[ends] - total[ends - n]).view(np.int64))
                keys = band_keys(signatures(owner, value, count, bands * rows), bands, rows)[n > 0]
                bounds = np.concatenate([[0], np.cumsum((n > 0) * bands)])
                parts.append(pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(digests[0]), pa.array(digests[1]),
                     lists(keys.reshape(-1).view(np.int64), bounds, pa.int64())], ["n", "a", "b", "bands"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
                [("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64()))]))

    return of(text)


def alike(left: Column | str, right: Column | str, size: int, percent: int) -> Column:
    """Whether the full shingle sets of two texts have 100 * intersection >= percent * union, and aren't empty."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        let_go()
        for one, other in batches:
            found = [np.zeros(0, bool)]
            for at, to in steps(pc.binary_length(one).fill_null(0).to_numpy() + pc.binary_length(other).fill_null(0).to_numpy()):
                both = pa.concat_arrays([one.slice(at, to - at).cast(pa.large_string()), other.slice(at, to - at).cast(pa.large_string())])
                turns = np.arange(2 * (to - at)).reshape(2, -1).T.reshape(-1)
                owner, value = _sets(both.take(pa.array(turns)), size)
                pair = owner // 2
                order = by_owner(pair, value)
                pair, value = pair[order], value[order]
                union = sums(pair[new_runs(pair, value)], to - at)
                common = sums(pair, to - at) - union
                found.append((100 * common >= percent * union) & (union > 0))
            yield pa.array(np.concatenate(found))

    return of(left, right)


def alike_in(text: Column | str, others: Column | str, size: int, percent: int) -> Column:
    """The numbers of those of an array of texts that are ``alike`` to one."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        let_go()
        for one, many in batches:
            places, whole = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            length = np.concatenate([[0], np.cumsum(pc.binary_length(many.flatten()).fill_null(0).to_numpy())])
            offsets = many.offsets.to_numpy() - many.offsets[0].as_py()
            for at, to in steps(np.diff(length[offsets]) + pc.binary_length(one).fill_null(0).to_numpy()):
                counts = np.diff(offsets[at:to + 1])
                first = np.cumsum(counts + 1) - counts - 1
                flat = pa.concat_arrays([one.slice(at, to - at).cast(pa.large_string()), many.slice(at, to - at).flatten().cast(pa.large_string())])
                heads = np.zeros(len(flat), bool)
                heads[first] = True
                turns = np.empty(len(flat), np.int64)
                turns[heads], turns[~heads] = np.arange(to - at), np.arange(to - at, len(flat))
                rows = np.cumsum(heads) - 1
                owner, value = _sets(flat.take(pa.array(turns)), size)
                order = by_owner(rows[owner], value)
                owner, value = owner[order], value[order]
                run = np.cumsum(new_runs(rows[owner], value)) - 1
                with_head = np.zeros(run[-1] + 1 if len(run) else 0, bool)
                with_head[run[heads[owner]]] = True
                n, common = sums(owner, len(flat)), sums(owner[with_head[run]], len(flat))
                union = n + n[first][rows] - common
                hits = np.flatnonzero((100 * common >= percent * union) & (union > 0) & ~heads)
                places.append(hits - first[rows[hits]] - 1)
                whole.append(np.bincount(rows[hits], minlength=to - at))
            yield lists(np.concatenate(places), np.cumsum(np.concatenate(whole)), pa.int32())

    # Not to be run once for a filter and once more for the column.
    return of.asNondeterministic()(text, others)


def steps(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some megabytes in all, so that only those are copied at a time."""
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * BLOCK_BYTES, side="right")))
        yield at, to
        at = to


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of a whole column of a bounded number of texts."""
    found, done = [], 0
    for block in blocks(column):
        owner, value = shingles(block, size)
        found.append((owner + done, value))
        done += len(block)
    return np.concatenate([o for o, _ in found]), np.concatenate([v for _, v in found])


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
    broadcast_ids: int = BROADCAST_IDS, crowd: int = CROWD,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; rows of one component are linked by chains of verified pairs.

    Equal shingle sets are one class and enter the search once. Classes that share a band key are compared with
    the class of the smallest id there. Where a key still joins several components, classes of different components
    are compared too, so that no pair that could join two components is left out. A key of that kind with more than
    ``crowd`` classes is mostly due to a passage that many texts share: its classes are compared if they share one of
    their rarest shingles, as any two sets that are alike enough must. With 32 bands of 4 rows a pair at 0.8 shares
    no key once in 20 million; more similar ones less often.

    Null or wordless texts have an empty set and no links. A row with a null id has a null component and is kept.
    Rows with one id count as one document: what links one links all. Other columns are not read.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH[0]) == BATCH[1]:
        conf.set(BATCH[0], BATCH[2])
    rows_ = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    marks = stored(rows_.select("id", sketch("text", size, bands, rows).alias("s")).select("id", "s.*"), "sketches")
    classes = stored(marks.where("n > 0 and id is not null").groupBy("a", "b").agg(
        F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    keyed = classes.select("node", "n", F.explode("bands").alias("key"))
    heads = stored(keyed.groupBy("key").agg(F.min_by(F.struct("node", "n"), "node").alias("head"), F.max("node").alias("last"))
                   .where("last > head.node").select("key", "head"), "heads")
    members = stored(keyed.join(heads, "key").select("key", "node", "n", "head"), "members")
    texts = stored(_texts(rows_, members.select(F.col("node").alias("id")).distinct(), broadcast_ids), "texts")

    first = stored(members.where("node <> head.node").where(_sizes_allow("n", "head.n", percent)).select(
        F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(_verified(first, texts, size, percent), "links")
    roots = components(links)

    rooted = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = _mixed(rooted)
    crowded = stored(mixed.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    few = mixed.join(crowded, "key", "left_anti")
    many = stored(mixed.join(crowded, "key", "left_semi").select("node", "root").distinct(), "crowd")
    chunks = _chunks(mixed)
    meeting = _meeting(few.withColumn("short", F.lit(True)), chunks, percent)
    if not many.isEmpty():
        rarest = _mixed(_rarest(many, texts, size, percent))
        meeting = meeting.union(_meeting(rarest, chunks, percent)).distinct()
    more = stored(_linked(stored(meeting, "meeting"), chunks, texts, size, percent), "links")
    links = links.unionByName(more)
    # An id with different texts links the classes of them all.
    of_id = marks.where("id is not null").groupBy("id").agg(F.min(F.struct("n", "a", "b")).alias("low"), F.max(F.struct("n", "a", "b")).alias("high"))
    shared = stored(of_id.where("low <> high").select("id"), "shared")
    several = not shared.isEmpty()
    if several:
        own = marks.where("n > 0").join(shared, "id", "left_semi").join(classes.select("a", "b", "node"), ["a", "b"])
        links = links.unionByName(stored(own.where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct(), "links"))
    if several or not more.isEmpty():
        roots = components(links)

    named = stored(classes.select("a", "b", "node").join(roots, "node", "left").select(
        "a", "b", F.coalesce("root", "node").alias("component")), "named")
    found = marks.select("id", "n", "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    if several:
        # An empty text belongs to the component of its id's other texts.
        found = found.join(roots.join(shared, roots.node == shared.id, "left_semi").toDF("_node", "_root"), F.col("id") == F.col("_node"), "left")
        component = F.coalesce("_root", component)
    return found.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _sizes_allow(n: str, m: str, percent: int) -> Column:
    """The smaller set can be the whole intersection, the larger one the union."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _texts(rows: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """The rows with those ids."""
    ids = stored(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    one, other = texts.toDF("a", "_one"), texts.toDF("b", "_other")
    return pairs.join(other, "b").join(one, "a").where(alike("_one", "_other", size, percent)).select("a", "b").distinct()


def _mixed(rooted: DataFrame) -> DataFrame:
    """The rows (key, node, n, root) of keys with several components."""
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return stored(rooted.join(keys, "key", "left_semi"), "mixed")


def _chunks(mixed: DataFrame) -> DataFrame:
    """(node, place): each class with its component, the component's size and a chunk of some classes of it."""
    nodes = stored(mixed.select("node", "root").distinct(), "nodes")
    sizes = stored(nodes.groupBy("root").count(), "sizes")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / CHUNK))
    return stored(nodes.join(sizes, "root").select("node", F.struct("count", "root", chunk.alias("chunk")).alias("place")), "chunks")


def _meeting(keyed: DataFrame, chunks: DataFrame, percent: int) -> DataFrame:
    """(low, high): chunks of different components that share a key; ``high`` is of the larger component.

    A pair is made once, not in both orders. Of two alike sets the smaller, under one of its ``short`` keys, has ``percent`` of
    the larger at least; chunks in which no two sets can be so don't meet.
    """
    short = F.when(F.col("short"), F.col("n"))
    sides = keyed.join(chunks, "node").groupBy("key", "place").agg(
        F.min(short).alias("short_least"), F.max(short).alias("short_most"), F.min("n").alias("least"), F.max("n").alias("most"))
    r, s = sides.alias("r"), sides.alias("s")

    def fits(one: str, other: str) -> Column:
        return (F.col(f"{one}.short_least") <= F.col(f"{other}.most")) & (
            100 * F.col(f"{one}.short_most") >= percent * F.col(f"{other}.least"))

    ordered = (F.col("r.place") < F.col("s.place")) & (F.col("r.place.root") != F.col("s.place.root"))
    pairs = r.join(s, (F.col("r.key") == F.col("s.key")) & ordered & (fits("r", "s") | fits("s", "r")))
    return pairs.select(F.col("r.place").alias("low"), F.col("s.place").alias("high")).distinct()


def _linked(meeting: DataFrame, chunks: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The verified links (a, b) between the classes of chunks that meet, without a row per pair."""
    nodes = chunks.join(texts.toDF("node", "text"), "node")
    wanted = meeting.select(F.col("high").alias("place")).distinct()
    gathered = nodes.join(wanted, "place", "left_semi").groupBy(F.col("place").alias("high")).agg(F.collect_list(F.struct("node", "text")).alias("l"))
    gathered = stored(gathered.select("high", F.col("l.node").alias("nodes"), F.col("l.text").alias("texts")), "chunk-texts")
    tasks = meeting.join(nodes.toDF("b", "low", "text"), "low").join(gathered, "high")
    found = tasks.select("b", "nodes", alike_in("text", "texts", size, percent).alias("which"))
    return found.where("size(which) > 0").select(F.explode(F.transform("which", lambda i: F.col("nodes")[i])).alias("a"), "b").distinct()


def _rarest(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, node, n, root, short): each class under its rarest shingles, so many that two alike sets share one of them.

    With t = percent / 100, sets of n <= m share 2 t / (1 + t) of n at least, and t of m. So, in one order of all
    shingles, the first n - ceil(2 t n / (1 + t)) + 1 of the smaller set (its ``short`` ones) and the first
    m - ceil(t m) + 1 of the larger hold a common one. Any order will do; rare ones first makes the keys small. The
    counts behind it may mix some shingles.
    """
    rows = texts.withColumnRenamed("id", "node").join(nodes, "node").select("node", "root", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                total += np.bincount((shingles(block, size)[1] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "times"])

    counts = rows.select("text").mapInArrow(counted, "at long, times long").groupBy("at").agg(F.sum("times").alias("times"))
    times = np.zeros(COUNTERS, np.int32)
    for batch in counts.toArrow().to_batches():
        times[batch.column(0).to_numpy()] = np.minimum(batch.column(1).to_numpy(), np.iinfo(np.int32).max)

    @F.arrow_udf("struct<n long, short long, keys array<long>>")
    def rarest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for column in batches:
            sizes, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for block in blocks(column):
                owner, value = shingles(block, size)
                order = by_owner(owner, times[value % np.uint64(COUNTERS)].astype(np.uint64) << np.uint64(32) | value >> np.uint64(32))
                n = sums(owner, len(block))
                number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                wanted = number <= (n + -percent * n // 100)[owner]
                sizes.append(n)
                keys.append(value[order][wanted])
            n = np.concatenate(sizes)
            bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, n + -percent * n // 100 + 1, 0))])
            yield pa.StructArray.from_arrays(
                [pa.array(n), pa.array(n + -2 * percent * n // (100 + percent)),
                 lists(np.concatenate(keys).view(np.int64), bounds, pa.int64())], ["n", "short", "keys"])

    # Spark would run it once more, in the same task, to leave out empty lists.
    found = rows.select("node", "root", rarest.asNondeterministic()("text").alias("r"))
    return found.select(F.posexplode("r.keys").alias("at", "key"), "node", "root", "r.n", "r.short").select(
        "key", "node", "n", "root", (F.col("at") <= F.col("short")).alias("short"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS, **options: int) -> DataFrame:
    """The rows that ``near_duplicates`` keeps, with all columns; of rows with one id one stays, rows with a null id all do.

    Of rows with one id the first by text stays (ties are equal in id and text).
    """
    found = stored(near_duplicates(docs, id, text, broadcast_ids=broadcast_ids, **options).select(F.col(id).alias("_id"), "kept"), "found")
    dropped = stored(found.where("not kept").select("_id").distinct(), "ids")
    repeated = stored(found.where("kept and _id is not null").groupBy("_id").count().where("count > 1").select("_id"), "ids")

    def those(ids: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, docs[id] == ids["_id"], how)

    single = those(dropped.union(repeated), "left_anti")
    if repeated.isEmpty():
        return single
    others = [c for c in docs.columns if c != id]
    whole = F.struct(F.col(text).alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])
    first = those(repeated, "left_semi").groupBy(id).agg(F.min(whole).alias("_whole"))
    return single.unionByName(first.select(id, *[F.col(f"_whole._{i}").alias(c) for i, c in enumerate(others)]).select(*docs.columns))

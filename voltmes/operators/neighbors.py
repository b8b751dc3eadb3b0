"""Exact nearest neighbours without a cross join.

Points are grouped into cells around sampled pivots. A query first meets its own cell, which bounds its
k-th distance; by the triangle inequality only cells that reach inside that bound can hold anything closer.
A cell is also ruled out if the box around its points lies beyond the bound, which one far point widens along one axis only.
Equal queries are asked once, and of equal points only the k of the smallest keys can be found by any query.
Crowded cells are cut into blocks on both sides, so every task sees a bounded number of points and queries,
and each block hands on at most k rows per query. Distances inside a block come from a matrix product; those that its
rounding leaves among the k closest are measured again from the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.session import stored

BLOCK_ROWS = 4096
MAX_PIVOTS = 512
_SLICE_VALUES = 4_000_000


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int = 5,
    query_key: str = "query",
    point_key: str = "point",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
    apart: str | None = None,
) -> DataFrame:
    """The k closest points of each query: ``query, point, distance, rank``; ties go to the smaller point key.

    Both sides need a unique key and an array of doubles of one length. With ``apart``, a column of both sides without nulls, a query
    passes over the points of its own value, which is returned as ``apart``: the searches of all folds are one.
    """
    held = [F.col(apart).alias("apart")] if apart else []
    kept = ["apart"] if apart else []
    everyone = queries.select(F.col(query_key).alias("name"), F.col(vector).cast("array<double>").alias("vector"), *held)
    points = points.select(F.col(point_key).alias("point"), F.col(vector).cast("array<double>").alias("vector"), *held)
    queries = stored(everyone.select("vector", *kept).distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    same = Window.partitionBy("vector", *kept).orderBy(F.col("point").asc_nulls_last())
    points = stored(points.withColumn("_at", F.row_number().over(same)).where(F.col("_at") <= k).drop("_at"), "points")
    found = _nearest_of_different(queries, points, k, block_rows).drop("rank")
    # Rows of one key, if there are several, share its k closest points.
    asked = everyone.join(queries, ["vector", *kept]).select("name", "query", *kept)
    return _closest(asked.join(found, "query").drop("query").withColumnRenamed("name", "query"), k, kept)


def _nearest_of_different(queries: DataFrame, points: DataFrame, k: int, block_rows: int) -> DataFrame:
    kept = [c for c in ("apart",) if c in points.columns]
    n = points.count()
    pivots = _pivots(points, n, block_rows)

    points = stored(points.withColumn("near", _nearest_pivot(pivots)("vector")).select(
        "point", "vector", *kept, F.col("near.cell").alias("cell"), F.col("near.distance").alias("off")), "points")
    queries = stored(queries.withColumn("near", _nearest_pivot(pivots)("vector")).select(
        "query", "vector", *kept, F.col("near.cell").alias("cell")), "queries")
    places = [F.col("vector")[i] for i in range(pivots.shape[1])]
    cells = {r["cell"]: r for r in points.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("off").alias("radius"), F.array(*[F.min(x) for x in places]).alias("low"),
        F.array(*[F.max(F.when(~F.isnan(x), x)) for x in places]).alias("high")).collect()}

    home = _closest_in_cells(queries, points, cells, k, block_rows)
    if len(cells) == 1:
        return _closest(home, k)

    home = stored(home, "neighbours")
    bound = _closest(home, k).groupBy("query").agg(F.count("*").alias("found"), F.max("distance").alias("reach"))
    bound = bound.select("query", F.when(F.col("found") >= k, F.col("reach")).alias("reach"))
    boxes = tuple(np.array([cells[c][side] for c in sorted(cells)], float) for side in ("low", "high"))
    reached = cells
    if kept:
        # Any query may pass over the points of one value.
        sure = points.groupBy("cell", *kept).count().groupBy("cell").agg((F.sum("count") - F.max("count")).alias("n")).collect()
        reached = {r["cell"]: {"n": r["n"], "radius": cells[r["cell"]]["radius"]} for r in sure}
    reachable = _reachable_cells(pivots, reached, k, boxes)
    others = (
        queries.join(bound, "query", "left")
        .withColumn("home", F.col("cell"))
        .withColumn("cell", F.explode(reachable("vector", F.coalesce("reach", F.lit(float("inf"))))))
        .where(F.col("cell") != F.col("home")).select("query", "vector", *kept, "cell")
    )
    return _closest(home.unionByName(_closest_in_cells(others, points, cells, k, block_rows)), k)


def _closest(found: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy("query", *by).orderBy("distance", "point")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pivots(points: DataFrame, n: int, block_rows: int) -> np.ndarray:
    """A few sampled points; they decide how the work is cut, not what is found."""
    wanted = max(1, min(MAX_PIVOTS, ceil(n / block_rows)))
    sample = points.sample(min(1.0, 4 * wanted / max(n, 1)), seed=11).select("vector").limit(wanted).collect()
    sample = sample or points.select("vector").limit(1).collect()
    return np.unique(np.array([r["vector"] for r in sample], dtype=float), axis=0)


def _paired(vectors: np.ndarray, others: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Euclidean distances of numbered rows of both sides, a bounded number of pairs at a time."""
    step = max(1, _SLICE_VALUES // 4 // max(1, vectors.shape[1]))
    parts = [np.sqrt(((vectors[row[i:i + step]] - others[place[i:i + step]]) ** 2).sum(axis=1)) for i in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _squared(vectors: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, squared distances, what each row's may be off by) for a few rows at a time.

    They come from one matrix product, which rounds; the exact ones lie within the bound given.
    """
    size = (others ** 2).sum(axis=1)
    most = np.fmax.reduce(size, initial=0.0)
    step = max(1, _SLICE_VALUES // 4 // max(1, len(others)))
    for i in range(0, len(vectors), step):
        part = vectors[i:i + step]
        own = (part ** 2).sum(axis=1)
        found = part @ others.T
        found *= -2.0
        found += own[:, None]
        found += size[None, :]
        yield i, found, 8 * (vectors.shape[1] + 4) * np.finfo(float).eps * (own + most)


def _stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest_pivot(pivots: np.ndarray):
    @F.arrow_udf("cell int, distance double")
    def near(vector: pa.Array) -> pa.Array:
        rows = _stack(vector).reshape(len(vector), pivots.shape[1])
        cell = np.concatenate([np.zeros(0, np.int64), *[found.argmin(axis=1) for _, found, _ in _squared(rows, pivots)]])
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(_paired(rows, pivots, np.arange(len(rows)), cell))], ["cell", "distance"])

    return near


def _reachable_cells(pivots: np.ndarray, cells: dict, k: int, boxes: tuple[np.ndarray, np.ndarray] | None = None):
    """Cells that can hold a point closer than the query's bound; ``boxes`` are the lowest and highest corners around their points.

    Without a bound of its own a query takes the farthest point of the best cell that has k points.
    """
    numbers = np.array(sorted(cells), np.int32)
    radius = np.array([cells[c]["radius"] for c in numbers])
    full = np.array([cells[c]["n"] >= k for c in numbers])
    slack = 1e-9

    def beyond(part: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Distances of numbered rows from the boxes of numbered cells."""
        inside = np.clip(part[row], boxes[0][cell], boxes[1][cell])
        return np.sqrt(((part[row] - inside) ** 2).sum(axis=1))

    @F.arrow_udf("array<int>")
    def reach(vector: pa.Array, bound: pa.Array) -> pa.Array:
        rows, limits = _stack(vector).reshape(len(vector), pivots.shape[1]), bound.to_numpy(zero_copy_only=False)
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, found, off in _squared(rows, pivots[numbers]):
            limit = limits[i:i + len(found)]
            if full.any():
                limit = np.minimum(limit, (np.sqrt(np.maximum(found + off[:, None], 0)) + radius)[:, full].min(axis=1))
            limit = limit * (1 + slack) + slack
            kept = np.sqrt(np.maximum(found - off[:, None], 0)) - radius <= limit[:, None]
            row, cell = np.nonzero(kept) if boxes else ((), ())
            step = max(1, _SLICE_VALUES // 4 // max(1, rows.shape[1]))
            for j in range(0, len(row), step):
                some, those = row[j:j + step], cell[j:j + step]
                kept[some, those] = ~(beyond(rows[i:i + len(found)], some, those) > limit[some])
            parts.append(np.broadcast_to(numbers, kept.shape)[kept])
            sizes.append(kept.sum(axis=1))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))

    return reach


def _closest_in_cells(queries: DataFrame, points: DataFrame, cells: dict, k: int, block_rows: int) -> DataFrame:
    """Up to k closest points per query and block; the blocks of a cell divide its points and its queries."""
    asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    point_blocks = _per_cell({c: ceil(r["n"] / block_rows) for c, r in cells.items()})
    query_blocks = _per_cell({c: ceil(n / block_rows) for c, n in asked.items()})

    def number(key: str, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(key), blocks).cast("int")

    def every(blocks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks - 1))

    sided = [c for c in ("apart",) if c in points.columns]
    left = queries.select(
        "query", "vector", *sided, "cell", number("query", query_blocks).alias("q"), every(point_blocks).alias("p"))
    right = points.where(query_blocks.isNotNull()).select(
        "point", "vector", *sided, "cell", number("point", point_blocks).alias("p"), every(query_blocks).alias("q"))
    kind = f"query {queries.schema['query'].dataType.simpleString()}, point {points.schema['point'].dataType.simpleString()}, distance double"

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked_names, names = asked.column("query").combine_chunks(), held.column("point").combine_chunks()
        if not len(asked_names) or not len(names):
            return pa.table({"query": asked_names[:0], "point": names[:0], "distance": pa.array([], pa.float64())})
        order = pc.array_sort_indices(names)
        names, vectors, queries_of = names.take(order), _stack(held.column("vector"))[order.to_numpy()], _stack(asked.column("vector"))
        sides = [side.column("apart").to_numpy() for side in (asked, held)] if sided else []
        rows, places, distances = [], [], []
        for i, found, off in _squared(queries_of, vectors):
            barred = sides[0][i:i + len(found), None] == sides[1][None, order.to_numpy()] if sided else np.zeros((1, 1), bool)
            if sided:
                found[barred] = np.inf
            # Whatever may be among the k closest is measured again, without the product's rounding.
            cut = np.partition(found, k - 1, axis=1)[:, k - 1] if len(names) > k else np.full(len(found), np.inf)
            row, place = np.nonzero(~(found > (cut + 2 * off)[:, None]) & ~barred)
            distance = _paired(queries_of[i:i + len(found)], vectors, row, place)
            best = np.lexsort((place, distance, row))
            best = best[~np.isnan(distance[best])]
            row, place, distance = row[best], place[best], distance[best]
            first = np.searchsorted(row, np.arange(len(found)))
            kept = np.arange(len(row)) - first[row] < k
            rows.append(row[kept] + i)
            places.append(place[kept])
            distances.append(distance[kept])
        rows, places, distances = (np.concatenate(x) for x in (rows, places, distances))
        return pa.table({"query": asked_names.take(pa.array(rows)), "point": names.take(pa.array(places)), "distance": distances})

    keys = ["cell", "p", "q"]
    # Few bytes may be much work, so the blocks are not merged into few tasks by their size.
    blocks = sum(ceil(cells[c]["n"] / block_rows) * ceil(n / block_rows) for c, n in asked.items() if c in cells)
    tasks = max(1, min(blocks, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, kind)


def _per_cell(blocks: dict[int, int]) -> Column:
    """Block count of the row's cell, null for a cell that is not listed; as many entries as pivots at most."""
    if not blocks:
        return F.lit(None).cast("int")
    return F.create_map(*[F.lit(v).cast("int") for pair in blocks.items() for v in pair])[F.col("cell")]


def _labels_found(found: DataFrame, labels: DataFrame, point_key: str, label: Column, apart: str | None) -> tuple[DataFrame, list[str]]:
    """``found`` with the label of each point, and what a query is known by; rows of the query's own ``apart`` hold no label for it."""
    known = labels.select(F.col(point_key).alias("point"), label.alias("_label"), *[F.col(apart).alias("_apart")] if apart else [])
    joined = found.join(known, "point")
    return (joined.where(F.col("apart") != F.col("_apart")), ["query", "apart"]) if apart else (joined, ["query"])


def mean_of_neighbours(found: DataFrame, labels: DataFrame, point_key: str = "point", label: str = "label", apart: str | None = None) -> DataFrame:
    """Regression: the mean label of each query's neighbours."""
    joined, names = _labels_found(found, labels, point_key, F.col(label).cast("double"), apart)
    return joined.groupBy(*names).agg(F.avg("_label").alias("prediction"))


def vote_of_neighbours(found: DataFrame, labels: DataFrame, point_key: str = "point", label: str = "label", apart: str | None = None) -> DataFrame:
    """Classification: the most frequent label among the neighbours, the smallest one among equals."""
    joined, names = _labels_found(found, labels, point_key, F.col(label), apart)
    votes = joined.groupBy(*names, "_label").agg(F.count("*").alias("votes"))
    order = Window.partitionBy(*names).orderBy(F.desc("votes"), "_label")
    return votes.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == 1).select(
        *names, F.col("_label").alias("prediction"))

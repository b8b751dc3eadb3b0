"""Nearest neighbours by inner product through low-dimensional stable projections and kd-trees.

A vector x gets a further component that brings all to the largest norm M, a query q is scaled to M; then the squared
distance is 2 M^2 - 2 (M / |q|) q.x, and the nearest has the largest inner product. Gaussian projections to a few
dimensions keep distances in law: projected over true squared distance is chi-square. Projections are indexed by
kd-trees: the upper levels, fitted on a bounded sample, deal all rows into cells, and each task builds the lower
ones for its rows. A query takes leaves in the order of their projected distance r and verifies their rows on the
original vectors, until chi-square says that a vector as near as the k-th best so far would have been seen:
r^2 >= d_k^2 * quantile(confidence). Its own cell comes first; the k-th distance found there rules out other cells.
"""

from __future__ import annotations

from math import ceil, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltmes.session import stored

#: Projected dimensions (even), and the chance that a true neighbour has been seen when the search stops.
PROJECTED = 8
CONFIDENCE = 0.99
#: The upper tree is fitted on so many rows at most and has one cell per 32 of them at most.
SAMPLE = 20_000
#: Rows of a cell, and queries, that one task compares; larger cells are cut into blocks.
CELL_ROWS = 4096
QUERIES = 4096
LEAF = 256
_OUT = "query_id long, vec_id long, score double"


def chi_square_quantile(share: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def projection(width: int, projected: int) -> np.ndarray:
    """The same Gaussian matrix in every task."""
    return np.random.default_rng(width).standard_normal((width + 1, projected))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Cells:
    """The upper levels of a kd-tree: split planes by level, cells as boxes of projected space."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        boxes = [(np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf), points)]
        self.axes, self.planes = [], []
        for _ in range(depth):
            axes, planes, halves = [], [], []
            for low, high, own in boxes:
                axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
                plane = float(np.median(own[:, axis])) if len(own) else 0.0
                left, right = high.copy(), low.copy()
                left[axis] = right[axis] = plane
                halves += [(low, left, own[own[:, axis] < plane]), (right, high, own[own[:, axis] >= plane])]
                axes.append(axis)
                planes.append(plane)
            boxes = halves
            self.axes.append(np.array(axes))
            self.planes.append(np.array(planes))
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int64)
        for axes, planes in zip(self.axes, self.planes):
            cell = 2 * cell + (points[np.arange(len(points)), axes[cell]] >= planes[cell])
        return cell

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared, from each point to each cell."""
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        off = np.maximum(low[None, :, d] - points[:, d, None], points[:, d, None] - high[None, :, d])
        total += np.maximum(off, 0) ** 2
    return total


def inner(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """All inner products, added up in one order, so that equal vectors have equal scores."""
    total = np.zeros((len(one), len(other)))
    for d in range(one.shape[1]):
        total += one[:, d, None] * other[None, :, d]
    return total


def search(
    ids: np.ndarray, rows: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, starts: np.ndarray,
    bounds: np.ndarray, norm: float, quantile: float, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows of each query that the search verifies; bounds are known k-th squared distances."""
    leaves, todo = [], [np.arange(len(ids))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            leaves.append(own)
            continue
        spread = points[own].max(0) - points[own].min(0)
        order = np.argpartition(points[own, int(np.argmax(spread))], len(own) // 2)
        todo += [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
    low, high = np.array([points[x].min(0) for x in leaves]), np.array([points[x].max(0) for x in leaves])
    distance = box_distances(starts, low, high)
    order = np.argsort(distance, axis=1, kind="stable")
    scale = 2 * norm / np.sqrt((queries ** 2).sum(1))
    best = np.full((len(queries), k), -np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    for step in range(len(leaves)):
        near = distance[np.arange(len(queries)), order[:, step]]
        reach = np.minimum(2 * norm ** 2 - scale * best[:, -1], bounds)
        active = np.flatnonzero(near <= quantile * reach)
        if not len(active):
            break
        for leaf in np.unique(order[active, step]):
            asking, own = active[order[active, step] == leaf], leaves[leaf]
            scores = inner(queries[asking], rows[own])
            scores[query_ids[asking, None] == ids[None, own]] = -np.inf
            scores = np.concatenate([best[asking], scores], axis=1)
            found = np.concatenate([names[asking], np.broadcast_to(ids[own], (len(asking), len(own)))], axis=1)
            top = np.lexsort((found, -scores), axis=-1)[:, :k]
            best[asking], names[asking] = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
    at, rank = np.nonzero(np.isfinite(best))
    return query_ids[at], names[at, rank], best[at, rank]


def nearest(
    vectors: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", *, k: int = 20, projected: int = PROJECTED,
    confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where ``queries`` holds, by inner product.

    Scores are exact, in double precision; ties go to the smaller id. A row isn't its own neighbour. Rows with a null
    id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors of
    different widths are searched apart. Ids should be unique; of repeated queries one counts, repeated rows are
    repeated candidates. Other columns are not read.
    """
    x = F.col("x")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.withColumn("_asks", F.coalesce(queries, F.lit(False))).select(
        F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col("_asks").alias("asks"))
    rows = stored(rows.where(F.col("id").isNotNull() & sound).withColumn("width", F.size("x")), "vectors")
    facts = rows.groupBy("width").agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("top"), F.count("*").alias("n")).collect()
    found = [_nearest(rows.where(F.col("width") == r["width"]), r["width"], r["top"] ** 0.5, r["n"], k, projected, confidence, cell_rows)
             for r in sorted(facts, key=lambda r: r["width"])]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    return whole


def _nearest(rows: DataFrame, width: int, norm: float, count: int, k: int, projected: int, confidence: float, cell_rows: int) -> DataFrame:
    quantile = chi_square_quantile(confidence, projected)

    @F.arrow_udf("array<double>")
    def project(vectors: pa.Array, asking: pa.Array) -> pa.Array:
        x = matrix(vectors, width)
        squares = (x ** 2).sum(1)
        asks = asking.to_numpy(zero_copy_only=False).astype(bool)
        scaled = np.where(asks[:, None], x * (norm / np.sqrt(squares))[:, None], x)
        last = np.where(asks, 0.0, np.sqrt(np.maximum(norm ** 2 - squares, 0)))
        points = np.concatenate([scaled, last[:, None]], axis=1) @ projection(width, projected)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * projected, pa.int32()), pa.array(points.reshape(-1)))

    projections = rows.select("id", "x", project("x", F.lit(False)).alias("p"))
    sample = projections.orderBy(F.xxhash64("id")).limit(SAMPLE).select("p").toArrow().column("p").combine_chunks()
    points = matrix(sample, projected)
    cells = Cells(points, max(0, min(ceil(log2(max(1, count / cell_rows))), int(log2(max(1, len(points) / 32))))))

    @F.arrow_udf("long")
    def cell(p: pa.Array) -> pa.Array:
        return pa.array(cells.of(matrix(p, projected)))

    index = stored(projections.withColumn("cell", cell("p")), "index")
    blocks = {r[0]: ceil(r[1] / cell_rows) for r in index.groupBy("cell").count().collect()}
    asking = rows.where("asks").dropDuplicates(["id"]).select("id", "x", project("x", F.lit(True)).alias("p")).withColumn("home", cell("p"))
    asking = stored(asking.withColumn("bound", F.lit(float("inf"))), "queries")

    def visited(first: bool):
        @F.arrow_udf("array<long>")
        def cells_of(p: pa.Array, home: pa.Array, bound: pa.Array) -> pa.Array:
            near = cells.distances(matrix(p, projected))
            own = np.zeros(near.shape, bool)
            own[np.arange(len(near)), home.to_numpy()] = True
            wanted = own if first else ~own & (near <= quantile * bound.to_numpy(zero_copy_only=False)[:, None])
            at, cell = np.nonzero(wanted)
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(near) + 1)), pa.int32()), pa.array(cell))

        return cells_of

    def round_of(asked: DataFrame, first: bool) -> DataFrame:
        """The k best of each block that a query visits."""
        visits = stored(asked.withColumn("cell", F.explode(visited(first)("p", "home", "bound"))), "visits")
        groups = {r[0]: ceil(r[1] / QUERIES) for r in visits.groupBy("cell").count().collect()}
        if not groups:
            return visits.sparkSession.createDataFrame([], _OUT)
        # Every block of a cell meets every group of the queries that visit it.
        block_count = F.create_map(*[F.lit(v) for c in groups for v in (c, blocks.get(c, 1))])[F.col("cell")]
        group_count = F.create_map(*[F.lit(v) for c, n in groups.items() for v in (c, n)])[F.col("cell")]
        left = index.where(group_count.isNotNull()).withColumns({
            "block": F.pmod(F.xxhash64("id"), block_count).cast("int"), "part": F.explode(F.sequence(F.lit(0), group_count - 1))})
        right = visits.withColumns({
            "part": F.pmod(F.xxhash64("id"), group_count).cast("int"), "block": F.explode(F.sequence(F.lit(0), block_count - 1))})

        def compare(own: pa.Table, asked: pa.Table) -> pa.Table:
            def column(table: pa.Table, name: str) -> pa.Array:
                return table.column(name).combine_chunks()

            if not own.num_rows or not asked.num_rows:
                names, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            else:
                names, ids, scores = search(
                    column(own, "id").to_numpy(), matrix(column(own, "x"), width), matrix(column(own, "p"), projected),
                    column(asked, "id").to_numpy(), matrix(column(asked, "x"), width), matrix(column(asked, "p"), projected),
                    column(asked, "bound").to_numpy(), norm, quantile, k)
            return pa.table({"query_id": names, "vec_id": ids, "score": scores})

        keys = ["cell", "block", "part"]
        return left.select(*keys, "id", "x", "p").groupBy(*keys).cogroup(
            right.select(*keys, "id", "x", "p", "bound").groupBy(*keys)).applyInArrow(compare, _OUT)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = stored(round_of(asking, True), "near")
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    reach = F.greatest(2 * norm ** 2 - 2 * norm / length * F.col("kth"), F.lit(0.0))
    bounded = asking.join(kth, "id", "left").withColumn("bound", F.coalesce(reach, "bound")).drop("kth")
    ranked = home.unionByName(round_of(bounded, False)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

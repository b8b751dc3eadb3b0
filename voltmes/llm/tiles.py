"""Near-duplicate vectors by PCA-ordered tiles.

Unit vectors are turned into the directions of largest variance, so that their first coordinates say most. Of a pair the
products of the leading coordinates are added up first; what the others can add is at most the product of the norms
of the suffixes (Cauchy-Schwarz), and a pair whose sum cannot reach the threshold is given up. Leading coordinates with
the suffix norm are themselves a point of the unit sphere, no further from another than the whole vectors are: a kd-tree
on these points deals the rows into cells, and a row meets only cells within the distance that the threshold allows.
Pairs of blocks of cells are compared tile by tile; a task hands on counts and a spanning forest of its links, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltmes.llm.components import components
from voltmes.llm.neighbours import Cells, matrix
from voltmes.session import stored

THRESHOLD = 0.9
#: Leading coordinates of the kd-tree, and coordinates added up between two looks at the bound.
LEADING, STEP = 8, 16
#: The tree is fitted on so many rows at most and has one cell per 32 of them at most, but two levels at least.
SAMPLE, LEAST_DEPTH = 20_000, 2
#: Rows of a block; larger cells are cut into several.
BLOCK_ROWS = 16_384
#: Rows of either side of a tile, and the share of its pairs up to which they are followed one by one.
TILE, FEW = 1024, 0.02
#: More than rounding can move a bound of unit vectors.
SLACK = 1e-9
_OUT = "id long, a long, links long, root long"


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x ** 2).sum(1))[:, None]


def directions(gram: np.ndarray) -> np.ndarray:
    """Orthonormal columns, by falling variance."""
    return np.linalg.eigh(gram)[1][:, ::-1]


def points(turned: np.ndarray, leading: int) -> np.ndarray:
    """Leading coordinates and the norm of the others."""
    return np.concatenate([turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1))[:, None]], axis=1)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest member of its set, after the sets of the links are joined."""
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while (label[label] != label).any():
            label = label[label]


class Side:
    """One side of a comparison: unit vectors, the same turned, and the norms of their suffixes at each look."""

    def __init__(self, x: np.ndarray, turn: np.ndarray) -> None:
        self.unit = units(x)
        self.turned = self.unit @ turn
        looks = range(STEP, self.turned.shape[1] + STEP, STEP)
        self.suffix = [np.sqrt((self.turned[:, look:] ** 2).sum(1)) for look in looks]


def close(one: Side, rows: slice, other: Side, columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile whose cosine is ``threshold`` or more."""
    x, y, look = one.turned[rows], other.turned[columns], 0
    total, limit = np.zeros((len(x), len(y))), threshold - SLACK
    while True:
        at = slice(look * STEP, (look + 1) * STEP)
        total += x[:, at] @ y[:, at].T
        open_ = total + one.suffix[look][rows, None] * other.suffix[look][None, columns] >= limit
        look += 1
        if look == len(one.suffix) or open_.mean() <= FEW:
            break
    a, b = np.nonzero(open_)
    total = total[a, b]
    while look < len(one.suffix) and len(a):
        at = slice(look * STEP, (look + 1) * STEP)
        total = total + np.einsum("ij,ij->i", x[a, at], y[b, at])
        left = total + one.suffix[look][rows][a] * other.suffix[look][columns][b] >= limit
        a, b, total, look = a[left], b[left], total[left], look + 1
    # Sums of turned coordinates only rule out; the vectors as given decide.
    u, v, linked = one.unit[rows], other.unit[columns], np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        linked[part] = np.einsum("ij,ij->i", u[a[part]], v[b[part]]) >= threshold
    return a[linked] + rows.start, b[linked] + columns.start


def compare(x: np.ndarray, copies: np.ndarray, second: np.ndarray, apart: bool, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of each vector: linked vectors on the other side and the smallest place reached through them.

    If not ``apart``, all vectors are one block that is compared with itself.
    """
    label, links = np.arange(len(x)), np.zeros(len(x))
    own, far = (np.flatnonzero(~second), np.flatnonzero(second)) if apart else (np.arange(len(x)),) * 2
    one = Side(x[own], turn)
    other = Side(x[far], turn) if apart else one
    for i in range(0, len(own), TILE):
        for j in range(0 if apart else i, len(far), TILE):
            a, b = close(one, slice(i, i + TILE), other, slice(j, j + TILE), threshold)
            if not apart and i == j:
                a, b = a[a < b], b[a < b]
            a, b = own[a], far[b]
            links += np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
            label = unite(label, a, b)
    return np.rint(links).astype(np.int64), label


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", *, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, leading: int = LEADING,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: rows with a cosine of ``threshold`` (above 0) or more are linked.

    Cosines are taken in double precision, and no link is lost. Equal vectors are one class and enter the comparison
    once; each is a link of the others. Vectors that are null, empty, zero or hold null or non-finite components have
    no links, nor have rows with a null id, whose component is null and which are kept. Vectors of different widths
    don't link. In components the rows with one id that have a usable vector count as one: what links one links all; one
    without stands alone. An empty table gives no rows. Other columns are not read.
    """
    x = F.col("x")
    sound = F.col("id").isNotNull() & F.coalesce(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("x")).withColumn("sound", sound)
    rows = rows.select("id", F.when(F.col("sound"), F.xxhash64("x")).alias("a"), F.when(F.col("sound"), F.xxhash64(F.lit(1), "x")).alias("b"), F.when(F.col("sound"), x).alias("x"))
    classes = stored(rows.where("a is not null").groupBy("a", "b").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.first("x").alias("x")).withColumn("width", F.size("x")), "classes")
    marks = stored(rows.select("id", "a", "b"), "marks")

    found = None
    for r in sorted(classes.groupBy("width").count().collect(), key=lambda r: r["width"]):
        part = _linked(classes.where(F.col("width") == r["width"]), r["width"], r["count"], threshold, block_rows, leading)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return marks.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    # An id with different vectors links the classes of them all.
    several = marks.where("a is not null").groupBy("id").agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).where("low <> high")
    names = classes.select("a", "b", "node", "copies")
    shared = marks.join(several.select("id"), "id", "left_semi").join(names, ["a", "b"]).select("id", F.col("node").alias("root"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(shared.select(F.col("id").alias("a"), F.col("root").alias("b"))))

    counted = found.groupBy(F.col("id").alias("node"), "a").agg(F.sum("links").alias("links"))
    named = names.join(counted, ["node", "a"], "left").join(roots, "node", "left").select(
        "a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component"))
    return marks.join(named, ["a", "b"], "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _linked(rows: DataFrame, width: int, count: int, threshold: float, block_rows: int, leading: int) -> DataFrame:
    """(id, a, links, root) of classes of one width, several rows for one: its links in a comparison, and a class reached by them."""
    def grams(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for table in tables:
            u = units(matrix(table.column("x"), width).astype(float))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.reshape(-1))], ["cell", "value"])

    sums = rows.select("x").mapInArrow(grams, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros(width * width)
    gram[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    turn, leading = directions(gram.reshape(width, width)), min(leading, width)

    @F.arrow_udf("array<double>")
    def point(x: pa.Array) -> pa.Array:
        found = points(units(matrix(x, width).astype(float)) @ turn, leading)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))

    sample = rows.orderBy(F.xxhash64("node")).limit(SAMPLE).select(point("x").alias("p")).toArrow().column("p").combine_chunks()
    fitted = matrix(sample, leading + 1)
    depth = min(max(LEAST_DEPTH, ceil(log2(max(1, count / block_rows)))), max(LEAST_DEPTH, int(log2(max(1, len(fitted) / 32)))))
    cells = Cells(fitted, depth)

    @F.arrow_udf("int")
    def cell(p: pa.Array) -> pa.Array:
        return pa.array(cells.of(matrix(p, leading + 1)), pa.int32())

    index = stored(rows.select("node", "a", "copies", "x", point("x").alias("p")).withColumn("cell", cell("p")), "index")
    largest = max(1, min(block_rows, ceil(count / (1 << LEAST_DEPTH))))
    blocks = np.ones(1 << depth, np.int64)
    for r in index.groupBy("cell").count().collect():
        blocks[r["cell"]] = ceil(r["count"] / largest)
    firsts = np.concatenate([[0], np.cumsum(blocks)])
    # Squared distance of unit vectors at the threshold.
    reach = 2 - 2 * threshold + SLACK

    @F.arrow_udf("array<struct<one int, other int, second boolean>>")
    def meetings(p: pa.Array, home: pa.Array, draw: pa.Array) -> pa.Array:
        home = home.to_numpy()
        near = cells.distances(matrix(p, leading + 1)) <= reach
        near[np.arange(len(near)), home] = True
        own = firsts[home] + draw.to_numpy() % blocks[home]
        at, cell = np.nonzero(near)
        copies = blocks[cell]
        ends = np.cumsum(copies)
        at = np.repeat(at, copies)
        met = np.arange(len(at)) - np.repeat(ends - copies, copies) + np.repeat(firsts[cell], copies)
        fields = [pa.array(np.minimum(own[at], met), pa.int32()), pa.array(np.maximum(own[at], met), pa.int32()), pa.array(own[at] > met)]
        return pa.ListArray.from_arrays(
            pa.array(np.searchsorted(at, np.arange(len(near) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["one", "other", "second"]))

    met = index.select("node", "a", "copies", "x", F.explode(meetings("p", "cell", F.pmod(F.xxhash64("node"), F.lit(1 << 30)))).alias("m"))

    def links(table: pa.Table) -> pa.Table:
        def column(name: str) -> np.ndarray:
            return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)

        x = matrix(table.column("x").combine_chunks(), width).astype(float)
        apart = table.column("one")[0].as_py() != table.column("other")[0].as_py()
        found, label = compare(x, column("copies").astype(float), column("second").astype(bool), apart, turn, threshold)
        some, node = np.flatnonzero(found), column("node")
        return pa.table({"id": node[some], "a": column("a")[some], "links": found[some], "root": node[label[some]]})

    return met.select("node", "a", "copies", "x", "m.*").groupBy("one", "other").applyInArrow(links, _OUT)

"""Many trees grown in the same scans.

Rows are stored once with their inputs as bins (a byte each). Every tree belongs to a group of rows (a fold, a region, a fold of
a region), and all trees of all groups and models grow together: a scan walks each row down the trees that it trains,
adds up label sums by (tree, node, input, bin), and one aggregate per level gives the best split of every open node. A
node of at most ``local_rows`` rows is handed on to one task, which grows the rest of it from its rows; so are whole
trees of groups that small. Draws depend on the row's key, the tree's seed and the node's path alone: a lost task grows the
same tree again, and a tree is the same whether its nodes were finished early or late.

A row's weight in a tree is its Poisson(1) number of draws (1 without bootstrap). Targets have one or more
components: a regression has the label, a classification one indicator per class, whose summed variance is the Gini
impurity. A missing input takes the training median of the group, in whole bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import exp, factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltmes.session import stored

#: Bins of an input; the last number marks a missing value.
BINS, MISSING = 255, 255
#: Rows of a node that one task finishes, and rows times trees that it works on together.
LOCAL_ROWS, TOGETHER = 50_000, 1 << 17
#: Trees that meet a block of rows in one task when they answer, and rows of a block.
ANSWERING, ANSWERED = 500, 20_000
UNLIMITED = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([exp(-1) / factorial(n) for n in range(18)])
_MASK = np.uint64((1 << 63) - 1)
TREES = "tree int, path long, feature int, cut int, n long, gain double, value array<double>"


class Tree(NamedTuple):
    """How one tree is grown. ``tries`` inputs are looked at per node; with ``leaves`` it grows best first up to that many."""

    model: str
    group: int
    seed: int
    tries: int
    depth: int = UNLIMITED
    min_split: int = 2
    min_leaf: int = 1
    bootstrap: bool = True
    leaves: int = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit input."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _random(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.asarray(seed, np.uint64) + (np.asarray(number, np.uint64) + np.uint64(1)) * _STEP)


def root_paths(tree: np.ndarray) -> np.ndarray:
    """The path of each tree's root; paths of different nodes differ but for one chance in 2**63."""
    return (_random(np.uint64(7), tree) & _MASK).astype(np.int64)


def child_paths(path: np.ndarray, right: int) -> np.ndarray:
    return (_random(path.astype(np.uint64), np.uint64(right)) & _MASK).astype(np.int64)


def draws(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """How often the tree draws each row."""
    if not tree.bootstrap:
        return np.ones(len(keys))
    chance = (_random(mix(np.uint64(tree.seed)), keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, chance, side="right").astype(float)


# The best split of nodes.

def _allowed(gain: np.ndarray, path: np.ndarray, seed: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Best gains by input and node, without those of inputs that the node does not look at.

    A node looks at ``tries`` inputs that can split it at all.
    """
    inputs = len(gain)
    if (tries >= inputs).all():
        return gain
    rank = _random(mix(seed.astype(np.uint64)) ^ path.astype(np.uint64), np.arange(inputs)[:, None]).astype(float)
    place = np.argsort(np.argsort(np.where(np.isfinite(gain), rank, np.inf), axis=0), axis=0)
    return np.where(place < tries, gain, -np.inf)


def _gains(left_w: np.ndarray, left_s: np.ndarray, all_w: np.ndarray, all_s: np.ndarray) -> np.ndarray:
    """What a split explains, from weights and sums (components last) of the left part and of the node."""
    right_w, right_s = all_w - left_w, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (left_s ** 2).sum(-1) / left_w + (right_s ** 2).sum(-1) / right_w - (all_s ** 2).sum(-1) / all_w
    return np.where((left_w > 0) & (right_w > 0) & np.isfinite(found), found, -np.inf)


def _nearly(gain: np.ndarray) -> np.ndarray:
    """Gains from here on count as equal: the first input and cut among them wins, however sums were rounded."""
    return np.where(np.isfinite(gain), gain - 1e-9 * np.abs(gain), gain)


def best_first(path: np.ndarray, gain: np.ndarray, root: int, leaves: int) -> set[int]:
    """Paths of the nodes that are split if the leaf of greatest gain is always split next."""
    known = dict(zip(path.tolist(), gain.tolist()))
    queue, chosen = [root], set()
    while queue and len(chosen) < leaves - 1:
        best = max(queue, key=lambda p: (known[p], -p))
        if not np.isfinite(known[best]):
            break
        queue.remove(best)
        chosen.add(best)
        at = np.array([best])
        queue += [c for c in (int(child_paths(at, 0)[0]), int(child_paths(at, 1)[0])) if c in known]
    return chosen


class Nodes:
    """Nodes of trees as they are found, level by level."""

    def __init__(self, width: int) -> None:
        self.width, self.parts = width, []

    def add(self, **columns: np.ndarray) -> None:
        self.parts.append(columns)

    def column(self, name: str) -> np.ndarray:
        empty = np.zeros((0, self.width)) if name == "value" else np.zeros(0, float if name == "gain" else np.int64)
        return np.concatenate([empty, *[part[name] for part in self.parts]])

    def pruned(self, trees: Sequence[Tree], root: dict[int, int]) -> dict[str, np.ndarray]:
        """All nodes; of a best-first tree those that are left, the others of them made leaves."""
        found = {name: self.column(name) for name in ("tree", "path", "feature", "cut", "n", "gain", "value")}
        keep = np.ones(len(found["path"]), bool)
        for tree, start in root.items():
            if trees[tree].leaves:
                own = np.flatnonzero(found["tree"] == tree)
                chosen = best_first(found["path"][own], found["gain"][own], start, trees[tree].leaves)
                split = np.array([p in chosen for p in found["path"][own].tolist()], bool)
                parents = found["path"][own][split]
                left = np.isin(found["path"][own], np.concatenate([[start], child_paths(parents, 0), child_paths(parents, 1)]))
                found["feature"][own[~split]] = -1
                keep[own] = left
        return {name: values[keep] for name, values in found.items()}

    def splitting(self, tree: np.ndarray, path: np.ndarray, trees: Sequence[Tree], root: dict[int, int]) -> np.ndarray:
        """Which of the newest nodes are split; in a best-first tree those that could still be among its splits."""
        split = self.parts[-1]["feature"] >= 0
        for t in np.unique(tree).tolist():
            if trees[t].leaves:
                all_tree = self.column("tree") == t
                chosen = best_first(self.column("path")[all_tree], self.column("gain")[all_tree], root[t], trees[t].leaves)
                own = tree == t
                split[own] &= np.array([p in chosen for p in path[own].tolist()], bool)
        return split


def grow_rows(
    bins: np.ndarray, s: np.ndarray, w: np.ndarray, start: np.ndarray, tree: np.ndarray, path: np.ndarray, level: np.ndarray, trees: Sequence[Tree],
    many: np.ndarray | None = None,
) -> dict[str, np.ndarray]:
    """All nodes below the given ones, whose rows are at hand: ``start`` is the node of each row, ``s`` its weighted target.

    A row may stand for ``many`` rows of the same bins; ``s`` and ``w`` are then their sums.

    Each input keeps its rows sorted by node and bin; splitting a node parts its stretch in two, so nothing is sorted again.
    """
    inputs, nodes = bins.shape[1], Nodes(s.shape[1])
    root = dict(zip(tree.tolist(), path.tolist()))
    limits = np.array([(t.depth, t.min_split, t.min_leaf, t.tries, t.seed) for t in trees], np.int64)
    by_input = np.ascontiguousarray(bins.T)
    order = np.argsort(start.astype(np.int64) * 256 + by_input, axis=1, kind="stable").astype(np.int32)
    used = np.bincount(start, minlength=len(tree))
    tree, path, level = (x[used > 0] for x in (tree, path, level))
    size = used[used > 0]
    many = np.ones(len(bins), np.int64) if many is None else many
    while len(size):
        first = np.concatenate([[0], np.cumsum(size)])
        of, at = np.repeat(np.arange(len(size)), size), np.arange(first[-1])
        depth, min_split, min_leaf, tries, seed = limits[tree].T
        bin_, ww, ss = np.take_along_axis(by_input, order, 1), np.cumsum(w[order], axis=1), np.cumsum(s[order], axis=1)
        before = np.maximum(first[:-1] - 1, 0)
        none = (first[:-1] == 0)
        left_w = ww - np.where(none, 0, ww[:, before])[:, of]
        left_s = ss - np.where(none[:, None], 0, ss[:, before])[:, of]
        all_w, all_s = left_w[:, first[1:] - 1], left_s[:, first[1:] - 1]
        nn = np.cumsum(many[order], axis=1)
        left_n = nn - np.where(none, 0, nn[:, before])[:, of]
        all_n = left_n[0, first[1:] - 1]
        valid = (left_n >= min_leaf[of]) & (all_n[of] - left_n >= min_leaf[of]) & (all_n >= np.maximum(min_split, 2))[of] & (level < depth)[of]
        valid[:, first[1:] - 1] = False
        differ = np.zeros(bin_.shape, bool)
        differ[:, :-1] = bin_[:, 1:] != bin_[:, :-1]
        gain = np.where(valid & differ, _gains(left_w, left_s, all_w[:, of], all_s[:, of]), -np.inf)
        best = _allowed(np.maximum.reduceat(gain, first[:-1], axis=1), path, seed, tries)
        top = best.max(0)
        near = _nearly(top)
        feature = np.argmax(best >= near, axis=0)
        # Less than rounding explains nothing.
        top = np.where(top > 1e-10 * np.abs((s[order[0]] ** 2).sum(-1) / np.maximum(w[order[0]], 1e-300)).sum() / max(1, many[order[0]].sum()), top, -np.inf)
        hit = np.flatnonzero(gain[feature[of], at] >= near[of])
        place = np.zeros(len(size), np.int64)
        place[of[hit][::-1]] = hit[::-1]
        cut = bin_[feature, place].astype(np.int64)
        nodes.add(tree=tree, path=path, feature=np.where(np.isfinite(top), feature, -1), cut=cut, n=all_n, gain=top,
                  value=all_s[0] / np.maximum(all_w[0], 1e-300)[:, None])
        split = nodes.splitting(tree, path, trees, root)
        # The stretches of the nodes that are split, parted.
        keep = split[of]
        order, of = order[:, keep], of[keep]
        if not len(of):
            break
        right = np.zeros(len(bins), bool)
        right[order[0]] = bins[order[0], feature[of]] > cut[of]
        numbers = np.flatnonzero(split)
        small = size[numbers]
        opens = np.concatenate([[0], np.cumsum(small)])[:-1]
        of = np.repeat(np.arange(len(numbers)), small)
        side = right[order]
        lefts = np.add.reduceat(~side[0], opens)
        lefts_before = np.concatenate([[0], np.cumsum(lefts)])[:-1]
        running = np.cumsum(~side, axis=1) - lefts_before[of]
        at = np.arange(len(of))
        place = np.where(side, opens[of] + lefts[of] + (at - opens[of] - running), opens[of] + running - 1)
        parted = np.empty_like(order)
        np.put_along_axis(parted, place, order, axis=1)
        order = parted
        size = np.stack([lefts, small - lefts], axis=1).reshape(-1)
        parents = path[numbers]
        path = np.stack([child_paths(parents, 0), child_paths(parents, 1)], axis=1).reshape(-1)
        tree, level = np.repeat(tree[numbers], 2), np.repeat(level[numbers] + 1, 2)
    return nodes.pruned(trees, {t: p for t, p in root.items()})


class Pack:
    """Trees as arrays, to be walked down."""

    def __init__(self, path: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(path)
        self.path, self.feature, self.cut, self.value = path[order], feature[order].astype(np.int64), cut[order], value[order]
        self.left, self.right = (np.searchsorted(self.path, child_paths(self.path, side)) for side in (0, 1))

    def leaves(self, bins: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The leaf of each row in the tree of each root path, as a place in the arrays."""
        at = np.repeat(np.searchsorted(self.path, roots)[None, :], len(bins), axis=0)
        row = np.arange(len(bins))[:, None]
        while True:
            feature = self.feature[at]
            open_ = feature >= 0
            if not open_.any():
                return at
            right = bins[row, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(open_, np.where(right, self.right[at], self.left[at]), at)


# Rows and groups.

class Binning(NamedTuple):
    """Cuts of each input; the bin of a value is the number of cuts below it."""

    cuts: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        found = np.empty(x.shape, np.uint8)
        for i, cuts in enumerate(self.cuts):
            found[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(cuts, x[:, i]))
        return found


def learn_cuts(df: DataFrame, inputs: str, width: int) -> Binning:
    """Up to 254 cuts for each element of an array column: between all values if they are that few, else at quantiles.

    Labels have no part in it. The quantiles are mergeable sketches, all in one aggregate.
    """
    values = df.select(F.posexplode(inputs).alias("input", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    shares = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    facts = values.groupBy("input").agg(F.approx_count_distinct("value").alias("many"), F.percentile_approx("value", shares, 10_000).alias("quantiles")).collect()
    cuts = [np.zeros(0)] * width
    few = [r["input"] for r in facts if r["many"] < BINS * 0.8]
    for r in facts:
        cuts[r["input"]] = np.unique(np.array(r["quantiles"], float))
    if few:
        listed = values.where(F.col("input").isin(few)).distinct().collect()
        for i in few:
            own = np.unique([r["value"] for r in listed if r["input"] == i])
            cuts[i] = (own[1:] + own[:-1]) / 2
    # The largest value needs no cut.
    return Binning([c[:BINS - 1] for c in cuts])


def binned(df: DataFrame, inputs: str, binning: Binning, **columns) -> DataFrame:
    """The given columns and ``bins``, stored."""
    width = len(binning.cuts)

    @F.arrow_udf("binary")
    def of(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), width)
        found = binning.bins(x)
        return pa.array([row.tobytes() for row in found], pa.binary())

    cells = F.transform(inputs, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    return stored(df.select(*[c.alias(name) for name, c in columns.items()], of(cells).alias("bins")), "binned")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


class Facts(NamedTuple):
    """What all groups have learned in one scan: rows, mean targets, and the bin that a missing input takes."""

    rows: np.ndarray
    means: np.ndarray
    fills: np.ndarray

    def filled(self, bins: np.ndarray, group: int) -> np.ndarray:
        return np.where(bins == MISSING, self.fills[group], bins)


def group_facts(rows: DataFrame, groups: int, inputs: int, targets: int) -> Facts:
    """``rows`` has ``groups`` (those that the row trains), ``bins`` and ``y``, and ``many`` where a row stands for several."""
    counted = "many" in rows.columns

    def cells(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((groups, inputs, 256)), np.zeros((groups, 1 + targets))
        for table in tables:
            member, y, bins = _members(table.column("groups"), groups), _targets(table.column("y"), targets), _matrix(table.column("bins"), inputs)
            many = table.column("many").to_numpy().astype(float) if counted else np.ones(len(y))
            for g in np.flatnonzero(member.any(0)):
                own = member[:, g]
                sums[g] += [many[own].sum(), *(y[own] * many[own, None]).sum(0)]
                for i in range(inputs):
                    counts[g, i] += np.bincount(bins[own, i], many[own], minlength=256)
        whole = np.concatenate([counts.reshape(-1), sums.reshape(-1)])
        some = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(whole[some])], ["cell", "value"])

    found = rows.select("groups", "bins", "y", *["many"] if counted else []).mapInArrow(cells, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    whole = np.zeros(groups * (inputs * 256 + 1 + targets))
    whole[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    counts, sums = whole[:groups * inputs * 256].reshape(groups, inputs, 256)[:, :, :MISSING], whole[groups * inputs * 256:].reshape(groups, -1)
    running = counts.cumsum(2)
    fills = (running * 2 >= np.maximum(running[:, :, -1:], 1)).argmax(2).astype(np.uint8)
    return Facts(sums[:, 0].astype(np.int64), sums[:, 1:] / np.maximum(sums[:, :1], 1), fills)


def _members(column: pa.Array, groups: int) -> np.ndarray:
    found = np.zeros((len(column), groups), bool)
    sizes = column.value_lengths().fill_null(0).to_numpy()
    found[np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()] = True
    return found


def _targets(column: pa.Array, targets: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), targets)


# Growing.

#: (number of the tree, keys, filled bins, targets) to weighted targets and weights; rows of weight 0 take no part.
Derive = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def drawn_targets(trees: Sequence[Tree], means: np.ndarray) -> Derive:
    """Each row as often as the tree draws it; targets around the group's mean, which keeps sums of squares small."""
    def derive(tree: int, keys: np.ndarray, bins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = draws(keys, trees[tree])
        return w[:, None] * (y - means[trees[tree].group]), w

    return derive


def grow(
    rows: DataFrame, trees: Sequence[Tree], facts: Facts, *, derive: Derive | None = None, local_rows: int = LOCAL_ROWS, numbers: Sequence[int] | None = None,
    components: int | None = None,
) -> DataFrame:
    """The nodes of all trees or those of the given numbers (``TREES``), stored. Values are means of the derived targets; leaves have feature -1.

    ``rows`` has ``key``, ``groups``, ``bins`` and ``y``, of ``components`` elements where they are not as many as the derived
    targets. The driver sees one row per node of more than ``local_rows`` rows.
    """
    spark, inputs, targets = rows.sparkSession, facts.fills.shape[1], facts.means.shape[1]
    components = components or targets
    derive = derive or drawn_targets(trees, facts.means)
    every = np.arange(len(trees)) if numbers is None else np.array(numbers, np.int64)
    roots = root_paths(np.arange(len(trees)))
    big = np.array([facts.rows[t.group] > local_rows for t in trees], bool)
    nodes = Nodes(targets)
    # Nodes that tasks finish: whole trees, several of a group in one piece, or one node below the scans.
    pieces: list[tuple[int, list[tuple[int, int, int]]]] = []
    for group in sorted({trees[t].group for t in every if not big[t]}):
        own = [int(t) for t in every if trees[t].group == group and not big[t]]
        step = max(1, TOGETHER // max(1, int(facts.rows[group])))
        pieces += [(group, [(t, int(roots[t]), 0) for t in own[i:i + step]]) for i in range(0, len(own), step)]
    open_ = {int(roots[t]): (int(t), 0) for t in every if big[t]}
    while open_:
        found = _scan(rows, trees, facts, derive, nodes, roots, open_, targets, components)
        tree = found["tree"]
        nodes.add(**{name: found[name] for name in ("tree", "path", "feature", "cut", "n", "gain", "value")})
        split = nodes.splitting(tree, found["path"], trees, {int(t): int(roots[t]) for t in every})
        following = {}
        for i in np.flatnonzero(split):
            level = open_[int(found["path"][i])][1] + 1
            for side, n in ((0, found["left_n"][i]), (1, found["n"][i] - found["left_n"][i])):
                child, t = int(child_paths(found["path"][i:i + 1], side)[0]), int(tree[i])
                # Best-first trees are compared whole, so their nodes are not finished apart.
                if n <= local_rows and not trees[t].leaves:
                    pieces.append((trees[t].group, [(t, child, level)]))
                else:
                    following[child] = (t, level)
        open_ = following
    done = nodes.pruned(trees, {int(t): int(roots[t]) for t in every if big[t]})
    above = spark.createDataFrame(_table(done)) if len(done["path"]) else None
    if not pieces:
        return above
    below = stored(_finish(rows, trees, facts, derive, done, roots, pieces, targets, components), "trees")
    return below if above is None else stored(below.unionByName(above), "trees")


def _table(found: dict[str, np.ndarray]) -> pa.Table:
    value = found["value"]
    return pa.table({
        "tree": pa.array(found["tree"], pa.int32()), "path": found["path"], "feature": pa.array(found["feature"], pa.int32()),
        "cut": pa.array(found["cut"], pa.int32()), "n": pa.array(found["n"], pa.int64()), "gain": found["gain"].astype(float),
        "value": pa.ListArray.from_arrays(pa.array(np.arange(len(value) + 1) * value.shape[1], pa.int32()), pa.array(value.reshape(-1)))})


def _pack(found: dict[str, np.ndarray], roots: Sequence[int] = ()) -> Pack:
    """The nodes found so far. Children not grown yet, and roots, are leaves."""
    parents = found["path"][found["feature"] >= 0]
    ends = np.concatenate([child_paths(parents, 0), child_paths(parents, 1), np.array(list(roots), np.int64)])
    more = np.setdiff1d(ends, found["path"])
    return Pack(np.concatenate([found["path"], more]), np.concatenate([found["feature"], np.full(len(more), -1)]),
                np.concatenate([found["cut"], np.zeros(len(more), np.int64)]), np.concatenate([found["value"], np.zeros((len(more), found["value"].shape[1]))]))


def _scan(rows: DataFrame, trees: Sequence[Tree], facts: Facts, derive: Derive, nodes: Nodes, roots: np.ndarray, open_: dict[int, tuple[int, int]], targets: int, components: int) -> dict:
    """The best split of every open node."""
    inputs = facts.fills.shape[1]
    pack = _pack({name: nodes.column(name) for name in ("path", "feature", "cut", "value")}, list(open_))
    live = sorted({t for t, _ in open_.values()})
    wanted = np.array(sorted(open_), np.int64)
    sums = [f"s{k}" for k in range(targets)]

    def cells(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            member, y = _members(table.column("groups"), len(facts.rows)), _targets(table.column("y"), components)
            keys, bins = table.column("key").to_numpy(), _matrix(table.column("bins"), inputs)
            for t in live:
                own = np.flatnonzero(member[:, trees[t].group])
                filled = facts.filled(bins[own], trees[t].group)
                s, w = derive(t, keys[own], filled, y[own])
                path = pack.path[pack.leaves(filled, roots[t:t + 1])[:, 0]]
                node = np.searchsorted(wanted, path)
                some = (w > 0) & (wanted[np.minimum(node, len(wanted) - 1)] == path)
                if not some.any():
                    continue
                cell = (node[some, None] * inputs + np.arange(inputs)) * 256 + filled[some]
                place, at = np.unique(cell, return_inverse=True)
                at = at.reshape(-1)

                def total(values: np.ndarray) -> np.ndarray:
                    return np.bincount(at, np.repeat(values, inputs), len(place))

                yield pa.RecordBatch.from_arrays([
                    pa.array(wanted[place // 256 // inputs]), pa.array((place % (256 * inputs)).astype(np.int32)),
                    pa.array(np.bincount(at, minlength=len(place))), pa.array(total(w[some])), *[pa.array(total(s[some, k])) for k in range(targets)],
                ], ["path", "cell", "n", "w", *sums])

    def best(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        tree, level = open_[path]
        how = trees[tree]
        cell = table.column("cell").to_numpy()
        grid = np.zeros((inputs * 256, 2 + targets))
        for k, name in enumerate(["n", "w", *sums]):
            grid[cell, k] = table.column(name).to_numpy()
        grid = grid.reshape(inputs, 256, -1)
        left = grid.cumsum(1)
        whole = left[:, -1:]
        n, left_n = int(whole[0, 0, 0]), left[:, :, 0]
        valid = (grid[:, :, 0] > 0) & (left_n >= max(1, how.min_leaf)) & (n - left_n >= max(1, how.min_leaf)) & (n >= how.min_split) & (level < how.depth)
        gain = np.where(valid, _gains(left[:, :, 1], left[:, :, 2:], whole[:, :, 1], whole[:, :, 2:]), -np.inf)
        top = _allowed(gain.max(1)[:, None], np.array([path]), np.array([how.seed]), np.array([how.tries]))[:, 0]
        most, near = float(top.max()), _nearly(top.max())
        feature = int(np.argmax(top >= near))
        cut = int(np.argmax(gain[feature] >= near))
        most = most if most > 1e-12 * abs(float((whole[0, 0, 2:] ** 2).sum())) / max(float(whole[0, 0, 1]), 1e-300) else -np.inf
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "path": [path], "feature": pa.array([feature if np.isfinite(most) else -1], pa.int32()),
            "cut": pa.array([cut], pa.int32()), "n": [n], "gain": [most], "left_n": [int(left_n[feature, cut])],
            "value": pa.array([(whole[0, 0, 2:] / max(whole[0, 0, 1], 1e-300)).tolist()], pa.list_(pa.float64()))})

    counted = rows.select("key", "groups", "bins", "y").mapInArrow(
        cells, "path long, cell int, n long, w double, " + ", ".join(f"{c} double" for c in sums)).groupBy("path", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "w", *sums)])
    found = counted.groupBy("path").applyInArrow(best, TREES.replace("value", "left_n long, value")).toArrow()
    columns = {name: found.column(name).to_numpy() for name in found.column_names if name != "value"}
    columns["tree"], columns["feature"], columns["cut"] = (columns[c].astype(np.int64) for c in ("tree", "feature", "cut"))
    columns["value"] = np.array(found.column("value").to_pylist(), float).reshape(found.num_rows, targets)
    return columns


def _finish(rows: DataFrame, trees: Sequence[Tree], facts: Facts, derive: Derive, above: dict, roots: np.ndarray, pieces: list, targets: int, components: int) -> DataFrame:
    """The nodes of all pieces, each grown in one task from its rows."""
    inputs = facts.fills.shape[1]
    whole = {g: [i for i, (group, p) in enumerate(pieces) if group == g and all(level == 0 for _, _, level in p)] for g in {g for g, _ in pieces}}
    deep = {p[0][1]: i for i, (_, p) in enumerate(pieces) if p[0][2] > 0}
    pack = _pack(above) if deep else None
    deep_trees = sorted({p[0][0] for _, p in pieces if p[0][2] > 0})

    def dealt(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            member, bins = _members(table.column("groups"), len(facts.rows)), _matrix(table.column("bins"), inputs)
            at, piece = [], []
            for g, numbers in whole.items():
                own = np.flatnonzero(member[:, g])
                at.append(np.tile(own, len(numbers)))
                piece.append(np.repeat(np.array(numbers, np.int64), len(own)))
            for t in deep_trees:
                own = np.flatnonzero(member[:, trees[t].group])
                path = pack.path[pack.leaves(facts.filled(bins[own], trees[t].group), roots[t:t + 1])[:, 0]]
                number = np.array([deep.get(p, -1) for p in path.tolist()], np.int64)
                if trees[t].bootstrap:
                    number[draws(table.column("key").to_numpy()[own], trees[t]) == 0] = -1
                at.append(own[number >= 0])
                piece.append(number[number >= 0])
            at, piece = np.concatenate(at), np.concatenate(piece)
            for i in range(0, len(at), 10_000):
                part = table.select(["key", "bins", "y"]).take(pa.array(at[i:i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(piece[i:i + 10_000], pa.int32()), *part.columns], ["piece", "key", "bins", "y"])

    def finished(table: pa.Table) -> pa.Table:
        group, own = pieces[table.column("piece")[0].as_py()]
        # The order of rows that a shuffle leaves is not always the same, sums of them should be.
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        bins = facts.filled(_matrix(table.column("bins").combine_chunks(), inputs), group)[order]
        y, keys = _targets(table.column("y").combine_chunks(), components)[order], keys[order]
        parts = []
        for number, (t, _, _) in enumerate(own):
            s, w = derive(t, keys, bins, y)
            some = np.flatnonzero(w > 0)
            parts.append((some, s[some], w[some], np.full(len(some), number)))
        at, s, w, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
        tree, path, level = (np.array([o[i] for o in own], np.int64) for i in range(3))
        return _table(grow_rows(bins[at], s, w, start, tree, path, level, trees))

    return rows.select("key", "groups", "bins", "y").mapInArrow(dealt, "piece int, key long, bins binary, y array<double>").groupBy("piece").applyInArrow(finished, TREES)


# Rows of the same bins and targets are one cell. With few inputs there are few cells, however many rows.

#: Cells times trees whose drawn rows a task counts.
COUNTED = 1 << 23


def cells_of(rows: DataFrame, most: int) -> DataFrame | None:
    """(bins, y, many) of rows of one group, stored; None if there are more than ``most``. A row may stand for ``many``."""
    many = F.sum("many") if "many" in rows.columns else F.count("*")
    cells = stored(rows.groupBy("bins", "y").agg(many.alias("many")), "cells")
    return cells if cells.count() <= most else None


def grow_from_cells(rows: DataFrame, cells: DataFrame, trees: Sequence[Tree], facts: Facts) -> DataFrame | None:
    """The trees that ``grow`` grows for one group, from how many rows of each cell a tree draws; None beyond ``COUNTED``.

    One scan draws the rows of all trees. A task hands on an array per tree, and a tree is grown in one task from its cells.
    Rows of one key are drawn alike, so a row may stand for ``many`` of its key.
    """
    rows = rows if "many" in rows.columns else rows.withColumn("many", F.lit(1).cast("long"))
    held = cells.orderBy("bins", "y").toArrow()
    inputs, targets, size = facts.fills.shape[1], facts.means.shape[1], held.num_rows
    if size * len(trees) > COUNTED:
        return None
    bins = facts.filled(_matrix(held.column("bins").combine_chunks(), inputs), 0)
    y = _targets(held.column("y").combine_chunks(), targets)
    numbered = rows.sparkSession.createDataFrame(held.select(["bins", "y"]).append_column("cell", pa.array(np.arange(size), pa.int32())))
    roots = root_paths(np.arange(len(trees)))

    def drawn(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, many, seen = np.zeros((len(trees), size), np.int64), np.zeros((len(trees), size), np.int64), False
        for table in tables:
            keys, cell, seen = table.column("key").to_numpy(), table.column("cell").to_numpy(), True
            copies = table.column("many").to_numpy()
            for t, tree in enumerate(trees):
                w = draws(keys, tree).astype(np.int64)
                weight[t] += np.bincount(cell, w * copies, size).astype(np.int64)
                many[t] += np.bincount(cell[w > 0], copies[w > 0], size).astype(np.int64)
        for t in range(len(trees) if seen else 0):
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([weight[t].tobytes()]), pa.array([many[t].tobytes()])], ["tree", "weight", "many"])

    def grown(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        w, many = (sum(np.frombuffer(part, np.int64) for part in table.column(c).to_pylist()) for c in ("weight", "many"))
        some = np.flatnonzero(w)
        s = w[some, None] * (y[some] - facts.means[0])
        return _table(grow_rows(bins[some], s, w[some].astype(float), np.zeros(len(some), np.int64), np.array([t]), roots[t:t + 1], np.array([0]), trees, many[some]))

    found = rows.select("key", "bins", "y", "many").join(F.broadcast(numbered), ["bins", "y"]).select("key", "cell", "many")
    counted = found.mapInArrow(drawn, "tree int, weight binary, many binary")
    return stored(counted.groupBy("tree").applyInArrow(grown, TREES), "trees")


# Answers.

def answers(rows: DataFrame, nodes: DataFrame, trees: Sequence[Tree], facts: Facts) -> DataFrame:
    """(id, group, model, value): the mean over the trees of each model and group for each row that names the group.

    ``rows`` has ``id``, ``tested`` (groups whose models answer) and ``bins``. Blocks of rows meet chunks of trees.
    """
    spark, inputs, targets = rows.sparkSession, facts.fills.shape[1], facts.means.shape[1]
    chunks, place = {}, []
    for number, tree in enumerate(trees):
        if tree.group < 0:
            continue
        seen = chunks.setdefault(tree.group, 0)
        chunks[tree.group] += 1
        place.append((number, tree.group, seen // ANSWERING))
    of_tree = spark.createDataFrame(place, "tree int, group int, chunk int")
    counts = spark.createDataFrame([(g, (n - 1) // ANSWERING + 1) for g, n in chunks.items()], "group int, chunks int")
    spread = rows.select("id", "bins", F.explode("tested").alias("group")).join(F.broadcast(counts), "group")
    blocks = max(1, -(-rows.count() // ANSWERED))
    left = spread.select("id", "bins", "group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    right = nodes.join(F.broadcast(of_tree), "tree").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    roots = root_paths(np.arange(len(trees)))
    names = sorted({t.model for t in trees})
    number_of = {name: i for i, name in enumerate(names)}

    def answer(asking: pa.Table, own: pa.Table) -> pa.Table:
        if not asking.num_rows or not own.num_rows:
            return pa.table({"id": pa.array([], pa.string()), "group": pa.array([], pa.int32()), "model": pa.array([], pa.int32()),
                             "value": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.int64())})
        group = asking.column("group")[0].as_py()
        bins = facts.filled(_matrix(asking.column("bins").combine_chunks(), inputs), group)
        pack = Pack(*(own.column(c).to_numpy() for c in ("path", "feature", "cut")), _targets(own.column("value").combine_chunks(), targets))
        of_model: dict[int, list[int]] = {}
        for t in np.unique(own.column("tree").to_numpy()).tolist():
            of_model.setdefault(number_of[trees[t].model], []).append(t)
        parts = []
        for model, own_trees in of_model.items():
            value = pack.value[pack.leaves(bins, roots[own_trees])].sum(1)
            parts.append(pa.table({
                "id": asking.column("id"), "group": pa.array(np.full(len(bins), group), pa.int32()), "model": pa.array(np.full(len(bins), model), pa.int32()),
                "value": pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * targets, pa.int32()), pa.array(value.reshape(-1))),
                "n": np.full(len(bins), len(own_trees))}))
        return pa.concat_tables(parts)

    keys = ["group", "chunk", "block"]
    summed = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, "id string, group int, model int, value array<double>, n long")
    means = spark.createDataFrame([(g, [float(x) for x in m]) for g, m in enumerate(facts.means)], "group int, mean array<double>")
    models = spark.createDataFrame(list(enumerate(names)), "model int, name string")
    total = summed.groupBy("id", "group", "model").agg(*[F.sum(F.col("value")[k]).alias(f"s{k}") for k in range(targets)], F.sum("n").alias("n"))
    value = F.array(*[F.col(f"s{k}") / F.col("n") + F.col("mean")[k] for k in range(targets)])
    return total.join(F.broadcast(means), "group").join(F.broadcast(models), "model").select("id", "group", F.col("name").alias("model"), value.alias("value"))

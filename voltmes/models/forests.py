"""Forests, boosted trees and their comparison over folds and regions, grown together by ``grove``."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from math import log2, sqrt
from threading import Lock
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.models import grove
from voltmes.models.grove import Binning, Facts, Pack, Tree
from voltmes.session import stored

SEED = 42
#: Nodes of a model that every task may hold; larger forests answer through a join of rows and trees.
PACKED_NODES = 2_000_000


class Forest(NamedTuple):
    """How a forest is grown. ``share`` of the inputs is looked at per node: "sqrt", "log2", a fraction, or None for all."""

    trees: int = 100
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    share: str | float | None = None
    bootstrap: bool = True

    def planted(self, name: str, group: int, inputs: int, seed: int = SEED) -> list[Tree]:
        tries = {"sqrt": int(sqrt(inputs)), "log2": int(log2(inputs)), None: inputs}.get(self.share)
        tries = max(1, int(self.share * inputs) if tries is None else tries)
        depth = grove.UNLIMITED if self.depth is None else self.depth
        return [Tree(name, group, 1_000_003 * seed + i, tries, depth, self.min_split, self.min_leaf, self.bootstrap) for i in range(self.trees)]


# Rows of named columns, in groups.

class Inputs(NamedTuple):
    """Numeric columns and the levels of categorical ones, each level an input of its own."""

    numeric: list[str]
    levels: dict[str, list[str]]

    def column(self) -> Column:
        """All inputs of a row; those of a missing value are null."""
        ones = [F.when(F.col(c).isNotNull(), F.col(c).eqNullSafe(F.lit(level)).cast("double")) for c, levels in self.levels.items() for level in levels]
        return F.array(*[F.col(c).cast("double") for c in self.numeric], *ones)

    def __len__(self) -> int:
        return len(self.numeric) + sum(map(len, self.levels.values()))


def inputs_of(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Inputs:
    return Inputs(list(numeric), {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in categorical})


class Grown(NamedTuple):
    nodes: DataFrame
    trees: list[Tree]
    facts: Facts
    binning: Binning
    inputs: Inputs
    rows: DataFrame


def grow_forests(
    df: DataFrame, forests: dict[str, Forest], numeric: Sequence[str], groups: int, *, truth: str = "consumo", key: str = "id", categorical: Sequence[str] = ("regiao",),
    seed: int = SEED, local_rows: int = grove.LOCAL_ROWS,
) -> Grown:
    """Every forest for every group of rows, all in the same scans.

    ``df`` has a row once, ``groups`` (the numbers of the groups that it trains) and ``tested`` (those that answer for it).
    A missing level of a categorical column has none of its inputs unless most rows of the group share one.
    """
    inputs = inputs_of(df, numeric, categorical)
    named = df.withColumn("_inputs", inputs.column())
    binning = grove.learn_cuts(named, "_inputs", len(inputs))
    rows = grove.binned(named, "_inputs", binning, id=F.col(key).cast("string"), key=F.xxhash64(F.lit(seed), F.col(key)), groups=F.col("groups"),
                        tested=F.col("tested"), y=F.array(F.col(truth).cast("double")), truth=F.col(truth).cast("double"))
    known = rows.where(F.col("truth").isNotNull())
    facts = grove.group_facts(known, groups, len(inputs), 1)
    trees = [tree for g in range(groups) if facts.rows[g] for name, forest in forests.items() for tree in forest.planted(name, g, len(inputs), seed)]
    return Grown(grove.grow(known, trees, facts, local_rows=local_rows), trees, facts, binning, inputs, rows)


def forest_answers(grown: Grown) -> DataFrame:
    """(id, group, model, truth, prediction) of the rows that a group's models are tested on."""
    found = grove.answers(grown.rows.where(F.size("tested") > 0), grown.nodes, grown.trees, grown.facts)
    return found.join(grown.rows.select("id", "truth"), "id").select("id", "group", "model", "truth", F.col("value")[0].alias("prediction"))


# Saved forests: all of a folder in one table of nodes, and a line of facts for each.

_NOTES = "model string, notes string"


def save_forests(grown: Grown, names: dict[int, str], folder: str, params: dict | None = None) -> None:
    """Writes the forest of each named group; the folder may hold others already."""
    spark = grown.rows.sparkSession
    of_tree = spark.createDataFrame([(i, names[t.group]) for i, t in enumerate(grown.trees) if t.group in names], "tree int, model string")
    grown.nodes.join(F.broadcast(of_tree), "tree").write.mode("append").partitionBy("model").parquet(f"{folder}/nodes")
    notes = []
    for group, name in names.items():
        own = [(i, t.tries) for i, t in enumerate(grown.trees) if t.group == group]
        notes.append((name, json.dumps({
            "numeric": grown.inputs.numeric, "levels": grown.inputs.levels, "cuts": [c.tolist() for c in grown.binning.cuts], "fills": grown.facts.fills[group].tolist(),
            "mean": float(grown.facts.means[group, 0]), "rows": int(grown.facts.rows[group]), "trees": [i for i, _ in own], "params": params})))
    spark.createDataFrame(notes, _NOTES).coalesce(1).write.mode("append").json(f"{folder}/forests")


class SavedForest(NamedTuple):
    nodes: DataFrame
    trees: list[Tree]
    facts: Facts
    binning: Binning
    inputs: Inputs
    params: dict | None


def load_forest(spark, folder: str, names: Sequence[str]) -> SavedForest:
    """The first of the named forests that the folder holds."""
    held = {r["model"]: json.loads(r["notes"]) for r in spark.read.schema(_NOTES).json(f"{folder}/forests").collect()}
    name = next((n for n in names if n in held), None)
    if name is None:
        raise FileNotFoundError(f"{folder}: {', '.join(names)}")
    found, numbers = held[name], held[name]["trees"]
    nodes = spark.read.schema(f"{grove.TREES}, model string").parquet(f"{folder}/nodes").where(F.col("model") == name).drop("model")
    trees = [Tree(name, 0 if i in set(numbers) else -1, 0, 1) for i in range(max(numbers, default=-1) + 1)]
    facts = Facts(np.array([found["rows"]]), np.array([[found["mean"]]]), np.array([found["fills"]], np.uint8))
    return SavedForest(nodes, trees, facts, Binning([np.array(c) for c in found["cuts"]]), Inputs(found["numeric"], found["levels"]), found["params"])


def score_forest(forest: SavedForest, df: DataFrame, key: str = "id", out: str = "pred_consumo") -> DataFrame:
    """Input rows with their prediction; columns that the forest wants and the rows lack count as missing."""
    lacking = {c: F.lit(None).cast("double") for c in forest.inputs.numeric if c not in df.columns} | {
        c: F.lit(None).cast("string") for c in forest.inputs.levels if c not in df.columns}
    named = df.withColumns(lacking).withColumn("_inputs", forest.inputs.column())
    rows = grove.binned(named, "_inputs", forest.binning, id=F.col(key).cast("string"), tested=F.array(F.lit(0)))
    found = grove.answers(rows, forest.nodes, forest.trees, forest.facts).select(F.col("id").alias("_id"), F.col("value")[0].alias(out))
    return df.join(found, F.col(key).cast("string") == F.col("_id"), "left").drop("_id")


# Learners of a features vector.

class Prepared(NamedTuple):
    """The rows that trees grow on. Beyond ``local_rows`` equal ones are one row, which stands for ``many``."""

    rows: DataFrame
    binning: Binning
    facts: Facts
    cells: DataFrame | None

    def each(self) -> DataFrame:
        """A row for every row of the table."""
        return self.rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "many"))).drop("many", "col") if "many" in self.rows.columns else self.rows


def _vector_rows(df: DataFrame, features: str, label: str, classify: bool, local_rows: int) -> Prepared:
    classes = _classes(df, label) if classify else 0
    inputs = vector_to_array(features)
    labelled = df.select(inputs.alias("x"), F.col(label).cast("double").alias("label")).where("label is not null")
    first = labelled.select(F.size("x")).first()
    if first is None:
        raise ValueError("no row has a label")
    binning = grove.learn_cuts(labelled, "x", first[0])
    y = F.array(*[(F.col("label") == c).cast("double") for c in range(classes)]) if classes else F.array("label")
    many = {}
    if labelled.count() > local_rows:
        labelled, many = labelled.groupBy("x", "label").agg(F.count("*").alias("many")), {"many": F.col("many")}
    rows = grove.binned(labelled, "x", binning, key=F.xxhash64("x", "label"), groups=F.array(F.lit(0)), y=y, **many)
    return Prepared(rows, binning, grove.group_facts(rows, 1, first[0], max(1, classes)), grove.cells_of(rows, local_rows) if many else None)


def _classes(df: DataFrame, label: str) -> int:
    """Labels are 0, 1, 2, ..., two at least."""
    return max(2, int(df.agg(F.max(label)).first()[0] or 0) + 1)


class SharedRows:
    """Rows prepared once for all learners that are given this and fit the same frame, whichever comes first."""

    def __init__(self) -> None:
        self.lock, self.known = Lock(), {}

    def of(self, df: DataFrame, *how) -> Prepared:
        with self.lock:
            # The frame is held, so that its number stays its own.
            _, own, found = self.known.setdefault((id(df), how), (df, Lock(), []))
        with own:
            if not found:
                found.append(_vector_rows(df, *how))
        return found[0]


class GroveForest(Estimator):
    """A forest as a pipeline's last stage; with ``classify`` its mean class shares are the probabilities.

    More than ``local_rows`` rows that share few bins are counted by them and drawn; others are scanned level by level.
    """

    def __init__(
        self, forest: Forest, labelCol: str = "label", featuresCol: str = "features", classify: bool = False, seed: int = SEED, local_rows: int = grove.LOCAL_ROWS,
        shared: SharedRows | None = None,
    ):
        super().__init__()
        self.forest, self.label, self.features, self.classify, self.seed, self.local_rows = forest, labelCol, featuresCol, classify, seed, local_rows
        self.prepare = shared.of if shared else _vector_rows

    def setFeaturesCol(self, name: str) -> GroveForest:
        self.features = name
        return self

    def _fit(self, df: DataFrame) -> GroveForestModel:
        ready = self.prepare(df, self.features, self.label, self.classify, self.local_rows)
        binning, facts = ready.binning, ready.facts
        trees = self.forest.planted("forest", 0, len(binning.cuts), self.seed)
        nodes = None if ready.cells is None else grove.grow_from_cells(ready.rows, ready.cells, trees, facts)
        if nodes is None:
            nodes = grove.grow(ready.each(), trees, facts, local_rows=self.local_rows)
        return GroveForestModel(self, nodes, trees, facts, binning)


def _answering(features: str, binning: Binning, facts: Facts, answer) -> Column:
    """An array of numbers per row from its filled bins."""
    width = len(binning.cuts)

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
        found = answer(facts.filled(binning.bins(x), 0))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))

    return of(vector_to_array(features))


class GroveForestModel(Model):
    def __init__(self, learner: GroveForest, nodes: DataFrame, trees: list[Tree], facts: Facts, binning: Binning):
        super().__init__()
        self.learner, self.nodes, self.trees, self.facts, self.binning = learner, nodes, trees, facts, binning

    def _transform(self, df: DataFrame) -> DataFrame:
        me, out = self.learner, "_answer"
        if self.nodes.count() <= PACKED_NODES:
            pack, roots, facts = packed(self.nodes, self.facts.means.shape[1]), grove.root_paths(np.arange(len(self.trees))), self.facts

            def answer(bins: np.ndarray) -> np.ndarray:
                # A few trees at a time, so that rows times trees stay small.
                total = sum(pack.value[pack.leaves(bins, roots[i:i + 16])].sum(1) for i in range(0, len(roots), 16))
                return total / len(roots) + facts.means[0]

            answered = df.withColumn(out, _answering(me.features, self.binning, facts, answer))
        else:
            numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()))
            rows = grove.binned(numbered.withColumn("_x", vector_to_array(me.features)), "_x", self.binning, id=F.col("_row").cast("string"), tested=F.array(F.lit(0)))
            found = grove.answers(rows, self.nodes, self.trees, self.facts).select(F.col("id").cast("long").alias("_row"), F.col("value").alias(out))
            answered = numbered.join(found, "_row").drop("_row")
        if not me.classify:
            return answered.withColumn("prediction", F.col(out)[0]).drop(out)
        return answered.withColumns({"probability": array_to_vector(out), "prediction": (F.array_position(out, F.array_max(out)) - 1).cast("double")}).drop(out)


def packed(nodes: DataFrame, targets: int) -> Pack:
    found = nodes.select("path", "feature", "cut", "value").toArrow()
    value = found.column("value").combine_chunks()
    return Pack(*(found.column(c).to_numpy() for c in ("path", "feature", "cut")), value.flatten().to_numpy().reshape(found.num_rows, targets))


# Boosting: rows stay where they are, their weights and rests follow from the trees so far.

class Boost(NamedTuple):
    """Rounds of trees of at most ``depth`` levels, or of ``leaves`` leaves grown best first."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = grove.UNLIMITED
    leaves: int = 0
    min_leaf: int = 1


class Squares:
    """Each tree fits what the sum of those before leaves of the label."""

    def __init__(self, boost: Boost, means: np.ndarray):
        self.boost, self.start = boost, float(means[0])

    def begin(self, rows: int) -> np.ndarray:
        return np.full(rows, self.start)

    def targets(self, state: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (y[:, :1] - state[:, None]), np.ones(len(y))

    def after(self, state: np.ndarray, y: np.ndarray, answer: np.ndarray, judged: tuple) -> np.ndarray:
        return state + self.boost.rate * answer[:, 0]

    def measure(self, state: np.ndarray, y: np.ndarray, answer: np.ndarray, many: np.ndarray) -> np.ndarray | None:
        """(rows, greatest error, weight, weight times error), where a round has to be judged by them; ``many`` rows each."""
        return None

    def judge(self, measured: np.ndarray | None, first: bool) -> tuple[float | None, tuple | None]:
        """The tree's vote (none for a useless tree), and what ``after`` needs (none to stop)."""
        return 1.0, ()

    def combine(self, answers: np.ndarray, votes: np.ndarray) -> np.ndarray:
        return self.start + self.boost.rate * answers[:, :, 0].sum(1, keepdims=True)


class Logistic(Squares):
    """The same on log-odds of class 1, with Newton steps in the leaves."""

    def __init__(self, boost: Boost, means: np.ndarray):
        share = min(max(float(means[1]), 1e-6), 1 - 1e-6)
        super().__init__(boost, np.array([np.log(share / (1 - share))]))

    def targets(self, state, y):
        p = 1 / (1 + np.exp(-state))
        return (y[:, 1] - p)[:, None], np.maximum(p * (1 - p), 1e-12)

    def combine(self, answers, votes):
        p = 1 / (1 + np.exp(-super().combine(answers, votes)))
        return np.concatenate([1 - p, p], axis=1)


class Median(Squares):
    """AdaBoost.R2 with linear loss and a weighted-median answer; the state is a row's weight."""

    def begin(self, rows):
        return np.ones(rows)

    def targets(self, state, y):
        return state[:, None] * (y[:, :1] - self.start), state

    def error(self, y, answer):
        return np.abs(y[:, 0] - self.start - answer[:, 0])

    def after(self, state, y, answer, judged):
        beta, worst, scale = judged
        return state * beta ** (1 - self.error(y, answer) / worst) * scale

    def measure(self, state, y, answer, many):
        error = self.error(y, answer)
        return np.array([many.sum(), error.max(initial=0), (many * state).sum(), (many * state * error).sum()])

    def judge(self, measured, first):
        n, worst, total, wrong = measured
        loss = wrong / worst / total if worst else 0.0
        if loss <= 0:
            return 1.0, None
        if loss >= 0.5:
            return (1.0 if first else None), None
        # Scaled back to a mean weight near 1, so that the weights do not fade over the rounds.
        return float(np.log((1 - loss) / loss)), (loss / (1 - loss), worst, n / total)

    def combine(self, answers, votes):
        order = np.argsort(answers[:, :, 0], axis=1, kind="stable")
        running = np.cumsum(votes[order], axis=1)
        place = (running >= votes.sum() / 2 * (1 - 1e-12)).argmax(1)
        return self.start + np.take_along_axis(answers[:, :, 0], np.take_along_axis(order, place[:, None], 1), 1)


class Ballot(Squares):
    """AdaBoost for any number of classes; a tree votes for the class of the greatest share, the most votes win."""

    def __init__(self, boost: Boost, means: np.ndarray):
        self.boost, self.means = boost, means

    def begin(self, rows):
        return np.ones(rows)

    def targets(self, state, y):
        return state[:, None] * (y - self.means), state

    def missed(self, y, answer):
        return np.argmax(answer + self.means, axis=1) != np.argmax(y, axis=1)

    def after(self, state, y, answer, judged):
        factor, scale = judged
        return np.where(self.missed(y, answer), state * factor, state) * scale

    def measure(self, state, y, answer, many):
        return np.array([many.sum(), 1.0, (many * state).sum(), (many * state)[self.missed(y, answer)].sum()])

    def judge(self, measured, first):
        n, _, total, wrong = measured
        loss, classes = wrong / total, len(self.means)
        if loss <= 0:
            return 1.0, None
        if loss >= 1 - 1 / classes:
            return (1.0 if first else None), None
        vote = float(np.log((1 - loss) / loss) + np.log(classes - 1))
        return vote, (float(np.exp(vote)), n / total)

    def combine(self, answers, votes):
        chosen = np.argmax(answers + self.means, axis=2)
        tally = np.stack([(votes * (chosen == c)).sum(1) for c in range(len(self.means))], axis=1)
        return tally / max(votes.sum(), 1e-300)


KINDS = {"squares": Squares, "logistic": Logistic, "median": Median, "ballot": Ballot}


class GroveBoost(Estimator):
    """Boosted trees as a pipeline's last stage: gradients (``squares``, ``logistic``) or AdaBoost (``median``, ``ballot``).

    Up to ``local_rows`` rows, or as many cells of rows with the same bins and label, the rounds run in one task; beyond that each
    level of each tree is a scan of the stored rows, in which a task works out weights and rests from the trees so far. No round writes rows.
    """

    def __init__(self, kind: str, boost: Boost, labelCol: str = "label", featuresCol: str = "features", seed: int = SEED, local_rows: int = grove.LOCAL_ROWS,
                 shared: SharedRows | None = None):
        super().__init__()
        self.kind, self.boost, self.label, self.features, self.seed, self.local_rows = kind, boost, labelCol, featuresCol, seed, local_rows
        self.prepare = shared.of if shared else _vector_rows

    def _fit(self, df: DataFrame) -> GroveBoostModel:
        ready = self.prepare(df, self.features, self.label, self.kind in ("logistic", "ballot"), self.local_rows)
        binning, facts = ready.binning, ready.facts
        way, b, inputs = KINDS[self.kind](self.boost, facts.means[0]), self.boost, len(binning.cuts)
        trees = [Tree("boost", 0, 1_000_003 * self.seed + i, inputs, b.depth, 2, b.min_leaf, False, b.leaves) for i in range(b.rounds)]
        targets = facts.means.shape[1] if self.kind == "ballot" else 1
        # Rows of the same bins and label share weight and rest in every round: cells of them are boosted as the rows would be.
        cells = ready.cells if facts.rows[0] > self.local_rows else ready.rows.withColumn("many", F.lit(1))
        found, votes = _rounds_in_scans(ready.each(), trees, facts, way, targets) if cells is None else _rounds_in_a_task(cells, trees, facts, way, targets)
        return GroveBoostModel(self, found, votes, facts, binning, way)


def _tree_of(found: dict[str, np.ndarray]) -> Pack:
    return Pack(found["path"], found["feature"], found["cut"], found["value"])


def _rounds_in_a_task(rows: DataFrame, trees: list[Tree], facts: Facts, way: Squares, targets: int) -> tuple[Pack, np.ndarray]:
    inputs, width = facts.fills.shape[1], facts.means.shape[1]
    roots = grove.root_paths(np.arange(len(trees)))

    def rounds(table: pa.Table) -> pa.Table:
        bins, y = grove._matrix(table.column("bins").combine_chunks(), inputs), grove._targets(table.column("y").combine_chunks(), width)
        if "key" in table.column_names:
            order = np.argsort(table.column("key").to_numpy(), kind="stable")
        else:
            order = np.lexsort((*y.T, *bins.T))
        bins, y, many = facts.filled(bins, 0)[order], y[order], table.column("many").to_numpy()[order].astype(np.int64)
        state, parts, votes = way.begin(len(y)), [], []
        for i in range(len(trees)):
            s, w = way.targets(state, y)
            found = grove.grow_rows(bins, s * many[:, None], w * many, np.zeros(len(y), np.int64), np.array([i]), roots[i:i + 1], np.array([0]), trees, many)
            pack = _tree_of(found)
            answer = pack.value[pack.leaves(bins, roots[i:i + 1])[:, 0]]
            vote, judged = way.judge(way.measure(state, y, answer, many), not parts)
            if vote is not None:
                parts.append(grove._table(found))
                votes.append((i, vote))
            if judged is None:
                break
            state = way.after(state, y, answer, judged)
        whole, vote_of = pa.concat_tables(parts), dict(votes)
        return whole.append_column("vote", pa.array([vote_of[t] for t in whole.column("tree").to_pylist()], pa.float64()))

    grown = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(rounds, f"{grove.TREES}, vote double").toArrow()
    votes = np.zeros(len(trees))
    votes[grown.column("tree").to_numpy()] = grown.column("vote").to_numpy()
    value = grown.column("value").combine_chunks().flatten().to_numpy().reshape(grown.num_rows, targets)
    return Pack(*(grown.column(c).to_numpy() for c in ("path", "feature", "cut")), value), votes


def _rounds_in_scans(rows: DataFrame, trees: list[Tree], facts: Facts, way: Squares, targets: int) -> tuple[Pack, np.ndarray]:
    inputs, width = facts.fills.shape[1], facts.means.shape[1]
    roots = grove.root_paths(np.arange(len(trees)))
    parts: list[tuple[np.ndarray, ...]] = []
    votes, judgements = np.zeros(len(trees)), []
    rows = rows.select("key", "groups", "bins", "y")
    # Sums are taken of the derived targets, which may be fewer than the components of y.
    shape = Facts(facts.rows, np.zeros((1, targets)), facts.fills)

    def state_of(pack: Pack | None, done: list, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
        state = way.begin(len(y))
        if done:
            leaves = pack.leaves(bins, roots[:len(done)])
            for i, judged in enumerate(done):
                state = way.after(state, y, pack.value[leaves[:, i]], judged)
        return state

    for i in range(len(trees)):
        pack = Pack(*(np.concatenate(c) for c in zip(*parts))) if parts else None
        done = list(judgements)

        def derive(_, keys, bins, y, pack=pack, done=done):
            return way.targets(state_of(pack, done, bins, y), y)

        grown = grove.grow(rows, trees, shape, derive=derive, local_rows=0, numbers=[i], components=width).toArrow()
        value = grown.column("value").combine_chunks().flatten().to_numpy().reshape(grown.num_rows, targets)
        new = (*(grown.column(c).to_numpy() for c in ("path", "feature", "cut")), value)
        tree = Pack(*new)

        def measured(tables: Iterator[pa.RecordBatch], pack=pack, done=done, tree=tree, root=roots[i:i + 1]) -> Iterator[pa.RecordBatch]:
            for table in tables:
                bins, y = facts.filled(grove._matrix(table.column("bins"), inputs), 0), grove._targets(table.column("y"), width)
                found = way.measure(state_of(pack, done, bins, y), y, tree.value[tree.leaves(bins, root)[:, 0]], np.ones(len(y)))
                yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in found], ["n", "worst", "total", "wrong"])

        facts_of_round = None
        if way.measure(np.ones(1), np.zeros((1, width)), np.zeros((1, targets)), np.ones(1)) is not None:
            facts_of_round = np.array(rows.mapInArrow(measured, "n double, worst double, total double, wrong double").agg(
                F.sum("n"), F.max("worst"), F.sum("total"), F.sum("wrong")).first(), float)
        vote, judged = way.judge(facts_of_round, not parts)
        if vote is not None:
            parts.append(new)
            votes[i] = vote
        if judged is None:
            break
        judgements.append(judged)
    return Pack(*(np.concatenate(c) for c in zip(*parts))), votes


class GroveBoostModel(Model):
    def __init__(self, learner: GroveBoost, pack: Pack, votes: np.ndarray, facts: Facts, binning: Binning, way: Squares):
        super().__init__()
        self.learner, self.pack, self.votes, self.facts, self.binning, self.way = learner, pack, votes, facts, binning, way

    def _transform(self, df: DataFrame) -> DataFrame:
        me, pack, way, used = self.learner, self.pack, self.way, np.flatnonzero(self.votes)
        roots, votes, out = grove.root_paths(used), self.votes[used], "_answer"

        def answer(bins: np.ndarray) -> np.ndarray:
            return way.combine(pack.value[pack.leaves(bins, roots)], votes)

        answered = df.withColumn(out, _answering(me.features, self.binning, self.facts, answer))
        if me.kind in ("squares", "median"):
            return answered.withColumn("prediction", F.col(out)[0]).drop(out)
        return answered.withColumns({"probability": array_to_vector(out), "prediction": (F.array_position(out, F.array_max(out)) - 1).cast("double")}).drop(out)

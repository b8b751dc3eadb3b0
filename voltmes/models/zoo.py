"""The compared models by name, each as a pipeline from raw columns to ``prediction``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.regression import LinearRegression, RandomForestRegressor

from voltmes.models.ensembles import BOOSTED_DEPTH, ROUNDS, Neighbours, ScaledLabel, Stacking, Voting
from voltmes.models.features import sensitive_pipeline, tree_pipeline
from voltmes.models.forests import Boost, Forest, GroveBoost, GroveForest, SharedRows
from voltmes.models.perceptron import Perceptron

# Fixed values of the compared models. Spark trees go 30 levels deep at most.
SEED = 42
TREES = 100
COMPARED_TREES = 200
BAGGED_TREES = 10
DEEPEST = 30
BOOST_ROUNDS = 100
BOOST_DEPTH = 3
BOOST_STEP = 0.1
HUBER_EPSILON = 1.35
HUBER_ALPHA = 1e-4
BLEND_FOLDS = 2
PERCEPTRON_LAYER = 100
PERCEPTRON_ROUNDS = 500
# Boosters on binned inputs: leaves of 20 rows or more, 31 leaves grown best first or five levels of them.
BINNED_LEAVES, BINNED_DEPTH, BINNED_ROWS = 31, 5, 20


def forest(label: str, trees: int = TREES, depth: int = DEEPEST, **params) -> RandomForestRegressor:
    """Spark's own forest, for pipelines that are saved. Every split may look at all features unless told otherwise."""
    params = {"featureSubsetStrategy": "all", **params}
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, **params)


def tree(label: str) -> GroveForest:
    return GroveForest(Forest(1, bootstrap=False), label)


def boosted(label: str) -> GroveBoost:
    return GroveBoost("squares", Boost(BOOST_ROUNDS, BOOST_STEP, BOOST_DEPTH), label)


def levelwise(label: str) -> GroveBoost:
    return GroveBoost("squares", Boost(BOOST_ROUNDS, BOOST_STEP, BINNED_DEPTH, min_leaf=BINNED_ROWS), label)


def leafwise(label: str) -> GroveBoost:
    """The leaf of greatest gain is split next, however deep it lies."""
    return GroveBoost("squares", Boost(BOOST_ROUNDS, BOOST_STEP, leaves=BINNED_LEAVES, min_leaf=BINNED_ROWS), label)


def linear(label: str) -> LinearRegression:
    return LinearRegression(labelCol=label, solver="normal")


def huber(label: str) -> ScaledLabel:
    return ScaledLabel(LinearRegression(loss="huber", epsilon=HUBER_EPSILON, regParam=HUBER_ALPHA, maxIter=100), label)


def regressors(label: str, key: str, order: Sequence[str]) -> dict[str, Callable[[], Estimator]]:
    """Final regressors by name; ``key`` identifies a row and ``order`` sorts the rows for contiguous folds."""
    def base() -> list[Estimator]:
        return [tree(label), Neighbours(key, labelCol=label)]

    def grown(trees: int = TREES) -> GroveForest:
        return GroveForest(Forest(trees), label)

    return {
        "linear": lambda: linear(label),
        "knn": lambda: Neighbours(key, labelCol=label),
        "tree": lambda: tree(label),
        "vote": lambda: Voting([grown(), linear(label), boosted(label)]),
        "forest": grown,
        "bagging": lambda: grown(BAGGED_TREES),
        "boosting": lambda: GroveBoost("median", Boost(ROUNDS, depth=BOOSTED_DEPTH), label),
        "stacking": lambda: Stacking(base(), grown(), order),
        "blending": lambda: Stacking(base(), grown(), order, folds=BLEND_FOLDS),
        "gradient": lambda: boosted(label),
        "histogram": lambda: levelwise(label),
        "leafwise": lambda: leafwise(label),
        "huber": lambda: huber(label),
        "forest200": lambda: grown(COMPARED_TREES),
    }


def scaled(numeric: Sequence[str], regressor: Estimator, categorical: Sequence[str] = ("regiao",)) -> Pipeline:
    return sensitive_pipeline(numeric, regressor, categorical=categorical)


def pipeline_variants(numeric: Sequence[str], label: str) -> dict[str, Callable[[], Pipeline]]:
    """Three ways to prepare the same forest: filled only, power + standard scale, power + robust scale."""
    return {
        "tree": lambda: tree_pipeline(numeric, GroveForest(Forest(TREES), label)),
        "sensitive_std": lambda: sensitive_pipeline(numeric, GroveForest(Forest(TREES), label), "standard", power=True),
        "sensitive_robust": lambda: sensitive_pipeline(numeric, GroveForest(Forest(TREES), label), "robust", power=True),
    }


def classifiers(label: str, key: str, order: Sequence[str], inputs: int, classes: int = 2) -> dict[str, Callable[[], Estimator]]:
    """Final classifiers by name; the perceptron has to know its number of inputs. Those that grow trees on one frame prepare it once."""
    shared = SharedRows()

    def forest_of(trees: int = TREES, share: str | None = "sqrt") -> GroveForest:
        return GroveForest(Forest(trees, share=share), label, classify=True, shared=shared)

    def bayes() -> NaiveBayes:
        return NaiveBayes(labelCol=label, modelType="gaussian")

    def tree_of() -> GroveForest:
        return GroveForest(Forest(1, bootstrap=False), label, classify=True, shared=shared)

    def base() -> list[Estimator]:
        return [tree_of(), Neighbours(key, labelCol=label)]

    return {
        "knn": lambda: Neighbours(key, labelCol=label, classify=True),
        "tree": tree_of,
        "bayes": bayes,
        "perceptron": lambda: Perceptron([inputs, PERCEPTRON_LAYER, classes], PERCEPTRON_ROUNDS, SEED, label),
        "vote": lambda: Voting([forest_of(), bayes()], soft=True),
        "forest": forest_of,
        "bagging": lambda: forest_of(BAGGED_TREES, None),
        "boosting": lambda: GroveBoost("ballot", Boost(ROUNDS, depth=1), label, shared=shared),
        "stacking": lambda: Stacking(base(), forest_of(), order, probabilities=True),
        "blending": lambda: Stacking(base(), forest_of(), order, folds=BLEND_FOLDS, probabilities=True),
        "gradient": lambda: GroveBoost("logistic", Boost(BOOST_ROUNDS, BOOST_STEP, BOOST_DEPTH), label, shared=shared),
    }

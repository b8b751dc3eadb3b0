"""Learners that Spark ML lacks: neighbours, voting and stacking.

They follow the Estimator/Model protocol, so they end a pipeline as any regressor does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.operators.neighbors import mean_of_neighbours, nearest, vote_of_neighbours
from voltmes.operators.ordering import join_facts
from voltmes.operators.quantiles import quantile_values
from voltmes.operators.splits import FOLDS, contiguous_folds
from voltmes.session import stored

# Boosting rounds, depth of a boosted regression tree, neighbours.
ROUNDS = 50
BOOSTED_DEPTH = 3
NEIGHBOURS = 5


def mean_vote(columns: Sequence[str]) -> Column:
    """Mean of several models' predictions; null if one is missing."""
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


class Neighbours(Estimator):
    """k nearest neighbours: mean of their labels, or their most frequent one."""

    def __init__(self, key: str, k: int = NEIGHBOURS, labelCol: str = "label", featuresCol: str = "features", classify: bool = False):
        super().__init__()
        self.key, self.k, self.label, self.features, self.classify = key, k, labelCol, featuresCol, classify

    def points(self, df: DataFrame, *others: str) -> DataFrame:
        return df.select(F.col(self.key).alias("point"), vector_to_array(self.features).alias("vector"), F.col(self.label).alias("label"), *others)

    def _fit(self, df: DataFrame) -> NeighboursModel:
        return NeighboursModel(self, self.points(df))

    def unseen(self, df: DataFrame, placed: DataFrame, fold: str) -> DataFrame:
        """``df`` with the ``prediction`` that the rows of ``placed`` in all other folds give to a row: one search for all folds."""
        points = self.points(placed, fold)
        found = nearest(points, points, self.k, query_key="point", apart=fold)
        answer = (vote_of_neighbours if self.classify else mean_of_neighbours)(found, points, apart=fold)
        return join_facts(df, answer.withColumnsRenamed({"query": self.key, "apart": fold}), [self.key, fold], "left")


class NeighboursModel(Model):
    def __init__(self, learner: Neighbours, points: DataFrame):
        super().__init__()
        self.learner, self.points = learner, points

    def _transform(self, df: DataFrame) -> DataFrame:
        me = self.learner
        queries = df.select(F.col(me.key).alias("query"), vector_to_array(me.features).alias("vector"))
        found = nearest(queries, self.points, me.k)
        answer = (vote_of_neighbours if me.classify else mean_of_neighbours)(found, self.points)
        return join_facts(df, answer.withColumnRenamed("query", me.key), [me.key], "left")


class ScaledLabel(Estimator):
    """Fits the inner regressor on a label of median 0 and interquartile range 1, and answers in the label's units.

    For a solver that starts from unit scale and would not get to a label in the millions.
    """

    def __init__(self, inner: Estimator, labelCol: str = "label"):
        super().__init__()
        self.inner, self.label = inner, labelCol

    def _fit(self, df: DataFrame) -> ScaledLabelModel:
        low, middle, high = quantile_values(df, [self.label], [0.25, 0.5, 0.75])[self.label]
        spread = (high - low) or 1.0
        scaled = df.withColumn("_scaled_label", (F.col(self.label) - middle) / spread)
        return ScaledLabelModel(self.inner.copy().setLabelCol("_scaled_label").fit(scaled), middle, spread)


class ScaledLabelModel(Model):
    def __init__(self, model: Model, middle: float, spread: float):
        super().__init__()
        self.model, self.middle, self.spread = model, middle, spread

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("prediction", F.col("prediction") * self.spread + self.middle)


class Voting(Estimator):
    """Mean of the members' predictions; with ``soft`` the class of greatest mean probability."""

    def __init__(self, members: Sequence[Estimator], soft: bool = False):
        super().__init__()
        self.members, self.soft = list(members), soft

    def _fit(self, df: DataFrame) -> VotingModel:
        return VotingModel([member.fit(df) for member in self.members], self.soft)


class VotingModel(Model):
    def __init__(self, models: Sequence[Model], soft: bool):
        super().__init__()
        self.models, self.soft = list(models), soft

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        for i, model in enumerate(self.models):
            answer = vector_to_array("probability") if self.soft else F.col("prediction")
            df = model.transform(df).select(*kept, answer.alias(f"_vote{i}"))
            kept = df.columns
        votes = [c for c in kept if c.startswith("_vote")]
        if self.soft:
            summed = F.col(votes[0])
            for vote in votes[1:]:
                summed = F.zip_with(summed, F.col(vote), lambda a, b: a + b)
            prediction = (F.array_position(summed, F.array_max(summed)) - 1).cast("double")
        else:
            prediction = mean_vote(votes)
        return df.withColumn("prediction", prediction).drop(*votes)


class Stacking(Estimator):
    """A final learner on out-of-fold answers of the base learners.

    The folds are contiguous blocks in the given order. Each learner answers with its ``prediction``, or with
    the probability of class 1 where it has one and ``probabilities`` is set.
    """

    def __init__(self, members: Sequence[Estimator], final: Estimator, order: Sequence[str], folds: int = FOLDS, probabilities: bool = False):
        super().__init__()
        self.members, self.final, self.order, self.folds, self.probabilities = list(members), final, list(order), folds, probabilities

    def answers(self, models: dict[int, Model], df: DataFrame) -> DataFrame:
        """``df`` with the answers of the numbered models."""
        for i, model in models.items():
            scored = model.transform(df)
            soft = self.probabilities and "probability" in scored.columns
            answer = vector_to_array("probability")[1] if soft else F.col("prediction")
            df = scored.select(*df.columns, answer.alias(f"_base{i}"))
        return df

    def assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=[f"_base{i}" for i in range(len(self.members))], outputCol="_stacked", handleInvalid="keep")

    def complete(self) -> Column:
        """Whether every base learner has an answer."""
        bases = [F.col(f"_base{i}") for i in range(len(self.members))]
        return reduce(Column.__and__, [b.isNotNull() & ~F.isnan(b) for b in bases])

    def _fit(self, df: DataFrame) -> StackingModel:
        placed = stored(contiguous_folds(df, self.order, self.folds))
        members = dict(enumerate(self.members))
        parts = []
        for fold in range(self.folds):
            train, test = placed.where(F.col("fold") != fold), placed.where(F.col("fold") == fold)
            parts.append(self.answers({i: m.fit(train) for i, m in members.items() if not hasattr(m, "unseen")}, test))
        answered = reduce(DataFrame.unionByName, parts)
        for i, member in members.items():
            if hasattr(member, "unseen"):
                answered = member.unseen(answered, placed, "fold").withColumnRenamed("prediction", f"_base{i}")
        unseen = stored(self.assembler().transform(answered.where(self.complete())))
        final = self.final.copy().setFeaturesCol("_stacked").fit(unseen)
        return StackingModel(self, [m.fit(df) for m in self.members], final)


class StackingModel(Model):
    def __init__(self, learner: Stacking, models: Sequence[Model], final: Model):
        super().__init__()
        self.learner, self.models, self.final = learner, list(models), final

    def _transform(self, df: DataFrame) -> DataFrame:
        """A row that a base learner has no answer for keeps its place, without a prediction."""
        answered = self.learner.answers(dict(enumerate(self.models)), df).withColumn("_complete", self.learner.complete())
        bases = {f"_base{i}": F.when(F.col("_complete"), F.col(f"_base{i}")).otherwise(0.0) for i in range(len(self.models))}
        scored = self.final.transform(self.learner.assembler().transform(answered.withColumns(bases)))
        return scored.select(*df.columns, F.when(F.col("_complete"), F.col("prediction")).alias("prediction"))

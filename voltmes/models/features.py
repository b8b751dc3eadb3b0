"""Feature estimators with exact statistics, and the pipelines built from them.

Every estimator learns on the rows it is fitted on only, so inside a fold nothing leaks from the test rows.
What it learns is one or two numbers per column, kept as parameters that are saved with the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.operators.quantiles import melted, quantile_values


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols()))


class _Learner(Estimator, _Columns):
    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)


class _Learned(Model, _Columns):
    """A model whose output column is an expression of its input column and the numbers learned for it."""

    values = Param(Params._dummy(), "values", "learned numbers per column", TypeConverters.toListFloat)
    more = Param(Params._dummy(), "more", "second learned number per column", TypeConverters.toListFloat)
    shapes = Param(Params._dummy(), "shapes", "third learned number per column", TypeConverters.toListFloat)
    origins = Param(Params._dummy(), "origins", "fourth learned number per column", TypeConverters.toListFloat)
    words = Param(Params._dummy(), "words", "learned text per column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, values=None, more=None, shapes=None, origins=None, words=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def expression(self, x: Column, i: int) -> Column:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: self.expression(F.col(c), i) for i, (c, out) in enumerate(self.pairs())})


class MedianImputerModel(_Learned):
    def expression(self, x, i):
        x = x.cast("double")
        return F.coalesce(F.when(~F.isnan(x), x), F.lit(self.getOrDefault("values")[i]))


class MedianImputer(_Learner):
    """Missing numbers become the exact median of the fitted rows; 0 if the column has no value at all."""

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        medians = quantile_values(df, self.getInputCols(), [0.5])
        values = [medians[c][0] if medians[c][0] is not None else 0.0 for c in self.getInputCols()]
        return MedianImputerModel(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), values=values)


class ModeImputerModel(_Learned):
    def expression(self, x, i):
        return F.coalesce(x, F.lit(self.getOrDefault("words")[i]))


class ModeImputer(_Learner):
    """Missing text becomes the most frequent text, the smallest one among equals."""

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        words = []
        for c in self.getInputCols():
            counted = df.where(F.col(c).isNotNull()).groupBy(c).count()
            top = counted.orderBy(F.desc("count"), c).limit(1).collect()
            words.append(top[0][0] if top else "")
        return ModeImputerModel(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), words=words)


class AffineModel(_Learned):
    """``(x - value) / more``."""

    def expression(self, x, i):
        return (x - self.getOrDefault("values")[i]) / self.getOrDefault("more")[i]


def _mean_and_spread(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation; a constant column gets deviation 1."""
    found = {
        row["feature"]: row for row in melted(df, columns).groupBy("feature").agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")).collect()
    }
    means = [found[c]["mean"] if c in found else 0.0 for c in columns]
    spreads = [found[c]["spread"] if c in found and found[c]["spread"] else 1.0 for c in columns]
    return means, spreads


class Standardizer(_Learner):
    """Mean 0 and population deviation 1."""

    def _fit(self, df: DataFrame) -> AffineModel:
        means, spreads = _mean_and_spread(df, self.getInputCols())
        return AffineModel(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), values=means, more=spreads)


class RobustStandardizer(_Learner):
    """Median 0 and interquartile range 1, both exact."""

    def _fit(self, df: DataFrame) -> AffineModel:
        found = quantile_values(df, self.getInputCols(), [0.25, 0.5, 0.75])
        quarters = [found[c] if found[c][0] is not None else [0.0, 0.0, 0.0] for c in self.getInputCols()]
        return AffineModel(
            inputCols=self.getInputCols(), outputCols=self.getOutputCols(),
            values=[q[1] for q in quarters], more=[(q[2] - q[0]) or 1.0 for q in quarters])


def yeo_johnson(x: Column, power: Column | float) -> Column:
    """The Yeo-Johnson transform; the logarithmic branches take over near powers 0 and 2."""
    power = power if isinstance(power, Column) else F.lit(float(power))
    rest = 2 - power
    up = F.when(F.abs(power) < 1e-9, F.log1p(x)).otherwise(F.try_divide(F.pow(x + 1, power) - 1, power))
    down = F.when(F.abs(rest) < 1e-9, -F.log1p(-x)).otherwise(-F.try_divide(F.pow(1 - x, rest) - 1, rest))
    return F.when(x >= 0, up).otherwise(down)


def _moved(x: Column, power: Column, origin: Column) -> Column:
    """The Yeo-Johnson transform without the constant and the factor that ``origin`` has in it, which may exceed a double.

    That is ``(yeo_johnson(x) - yeo_johnson(origin)) / exp(power * log1p(origin))`` for an origin from 0 on, and the mirror image
    (powers seen from 2, signs changed) for one below.
    """
    mirror = F.when(origin < 0, -1.0).otherwise(1.0)
    x, near, power = x * mirror, F.log1p(F.abs(origin)), F.when(origin < 0, 2 - power).otherwise(power)
    rest, far = 2 - power, F.log1p(F.abs(x))
    up = F.when(F.abs(power) < 1e-9, far - near).otherwise(F.try_divide(F.expm1(power * (far - near)), power))
    zero = F.when(F.abs(power) < 1e-9, -near).otherwise(F.try_divide(F.expm1(-power * near), power))
    down = F.when(F.abs(rest) < 1e-9, far * F.exp(-power * near)).otherwise(
        F.try_divide(F.exp(rest * far - power * near) - F.exp(-power * near), rest))
    return mirror * F.when(x >= 0, up).otherwise(zero - down)


def _ends(values: DataFrame) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column that has any."""
    found = values.groupBy("feature").agg(F.min("value").alias("least"), F.max("value").alias("most")).collect()
    return {row["feature"]: (row["least"], row["most"]) for row in found}


#: Moments of a bin that the likelihood is worked out from, and bins at least over a column's range.
MOMENTS, LEAST_BINS = 10, 64


class _Bins(NamedTuple):
    """How ``log1p(|x|)`` of a column is binned: where the bins of values from 0 on and below 0 start, their width, and the greatest power it allows."""

    up: float
    down: float
    width: float
    power: float


def _planned(least: float, most: float, power: float) -> _Bins | None:
    """Bins so narrow that ``MOMENTS`` terms of a series give the transform to a double's precision; none for values too close together."""
    up, down = np.log1p(max(least, 0.0)), np.log1p(max(-most, 0.0))
    span = max(np.log1p(max(most, 0.0)) - up, np.log1p(max(-least, 0.0)) - down)
    if not 0 < span < np.inf:
        return None
    return _Bins(float(up), float(down), float(min(1 / (8 * power), span / LEAST_BINS)), power)


def _binned_moments(values: DataFrame, planned: dict[str, _Bins]) -> dict[str, dict[bool, np.ndarray]]:
    """For values from 0 on (True) and below 0: a row per bin with its number, its count and its sums of powers of the place in it, from -0.5 to 0.5."""
    def of(pick: Callable[[_Bins], float]) -> Column:
        return F.create_map(*[part for c, bins in planned.items() for part in (F.lit(c), F.lit(pick(bins)))])[F.col("feature")]

    up = F.col("value") >= 0
    at = (F.log1p(F.abs("value")) - F.when(up, of(lambda b: b.up)).otherwise(of(lambda b: b.down))) / of(lambda b: b.width)
    placed = values.where(F.col("feature").isin(list(planned))).select("feature", up.alias("up"), at.alias("at")).select(
        "feature", "up", F.floor("at").alias("bin"), (F.col("at") - F.floor("at") - 0.5).alias("d1"))
    for k in range(2, MOMENTS + 1):
        placed = placed.withColumn(f"d{k}", F.col(f"d{k - 1}") * F.col("d1"))
    found = placed.groupBy("feature", "up", "bin").agg(F.count("*").alias("n"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(1, MOMENTS + 1)]).toPandas()
    numbers = ["bin", "n", *[f"d{k}" for k in range(1, MOMENTS + 1)]]
    return {c: {bool(up): rows[numbers].sort_values("bin").to_numpy(float) for up, rows in own.groupby("up")} for c, own in found.groupby("feature")}


def _rise(t: np.ndarray, power: float) -> np.ndarray:
    return t if abs(power) < 1e-9 else np.expm1(power * t) / power


def _likelihood(moments: dict[bool, np.ndarray], bins: _Bins, ends: tuple[float, float], power: float) -> float:
    """Log-likelihood of a power for the values behind the moments, as that of ``_moved`` beside its origin; NaN without spread.

    In a bin around c the transform is its value at c plus a factor times ``(exp(p * d) - 1) / p``, whose sum and sum of
    squares are series in the sums of powers of d. Bins are then put together by their means and spreads.
    """
    origin = ends[1] if power >= 1 else ends[0]
    mirror, near, own = (-1.0, np.log1p(-origin), 2 - power) if origin < 0 else (1.0, np.log1p(origin), power)
    counts, means, spreads, logs = [], [], [], 0.0
    for up, rows in moments.items():
        start, n = bins.up if up else bins.down, rows[:, 1]
        centre = start + (rows[:, 0] + 0.5) * bins.width
        sums = rows[:, 2:] * bins.width ** np.arange(1, MOMENTS + 1)
        logs += (1 if up else -1) * float((n * centre + sums[:, 0]).sum())
        if up == (mirror > 0):
            rate, at, factor = own, _rise(centre - near, own), np.exp(own * (centre - near))
        else:
            rate = 2 - own
            factor = -np.exp(rate * centre - own * near)
            fall = centre * np.exp(-own * near) if abs(rate) < 1e-9 else (np.exp(rate * centre - own * near) - np.exp(-own * near)) / rate
            at = _rise(np.array(-near), own) - fall
        first = sum(rate ** (k - 1) / factorial(k) * sums[:, k - 1] for k in range(1, MOMENTS + 1))
        second = sum((2 ** k - 2) * rate ** (k - 2) / factorial(k) * sums[:, k - 1] for k in range(2, MOMENTS + 1))
        counts.append(n)
        means.append(at + factor * first / n)
        spreads.append(factor ** 2 * np.maximum(second - first ** 2 / n, 0))
    n, mean, spread = (np.concatenate(part) for part in (counts, means, spreads))
    total = n.sum()
    variance = float((spread + n * (mean - (n * mean).sum() / total) ** 2).sum() / total)
    if not variance > 0:
        return np.nan
    return float(-total / 2 * np.log(variance) + (power - 1) * logs - total * own * near)


def yeo_johnson_powers(
    df: DataFrame, columns: Sequence[str], low: float = -5.0, high: float = 5.0, points: int = 21, passes: int = 5
) -> dict[str, float]:
    """Power of greatest likelihood per column: an even grid, narrowed around its best point in every pass.

    As long as the best point lies on the edge of the first grid, its range is doubled. Beyond some power the
    likelihood falls for any column, so this ends; columns without two different values keep power 1.
    One scan adds up moments of narrow bins, which give the likelihood of every power; only a much wider range asks for
    narrower bins and another scan.
    """
    values = melted(df, columns)
    return _powers(values, columns, _ends(values), low, high, points, passes)


def _powers(
    values: DataFrame, columns: Sequence[str], every: dict[str, tuple[float, float]], low: float = -5.0, high: float = 5.0, points: int = 21, passes: int = 5
) -> dict[str, float]:
    ends = {c: e for c, e in every.items() if e[0] < e[1]}
    middle, reach = (low + high) / 2, (high - low) / 2
    narrower = 2 / (points - 1)
    enough = reach * narrower ** passes * (1 + 1e-9)
    powers = {c: 1.0 for c in columns}
    searched = {c: (middle, reach) for c in ends}
    widening = set(searched)
    planned: dict[str, _Bins] = {}
    moments: dict[str, dict[bool, np.ndarray]] = {}
    while searched:
        # The powers of a grid, seen from 0 and from 2.
        most = {c: max(abs(middle - 1) + reach + 1, 1.0) for c, (middle, reach) in searched.items()}
        asked = {c: _planned(*ends[c], 4 * p) for c, p in most.items() if c not in planned or planned[c].power < p}
        searched = {c: s for c, s in searched.items() if c not in asked or asked[c]}
        asked = {c: bins for c, bins in asked.items() if bins}
        if asked:
            planned |= asked
            moments |= _binned_moments(values, asked)
        following = {}
        for c, (middle, reach) in searched.items():
            grid = [middle - reach + 2 * reach * i / (points - 1) for i in range(points)]
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                likelihood = np.array([_likelihood(moments[c], planned[c], ends[c], power) for power in grid])
            if np.isnan(likelihood).all():
                continue
            found = powers[c] = grid[int(np.nanargmax(likelihood))]
            if c in widening and abs(found - middle) >= reach * (1 - 1e-9):
                following[c] = (middle, 2 * reach)
                continue
            widening.discard(c)
            if reach * narrower > enough:
                following[c] = (found, reach * narrower)
        searched = following
    return powers


class YeoJohnsonModel(_Learned):
    def expression(self, x, i):
        moved = _moved(x, F.lit(self.getOrDefault("shapes")[i]), F.lit(self.getOrDefault("origins")[i]))
        return (moved - self.getOrDefault("values")[i]) / self.getOrDefault("more")[i]


class YeoJohnson(_Learner):
    """Power transform with the most likely power, then mean 0 and deviation 1."""

    def _fit(self, df: DataFrame) -> YeoJohnsonModel:
        columns = self.getInputCols()
        values = melted(df, columns)
        ends = _ends(values)
        powers = _powers(values, columns, ends)
        origins = [float(ends[c][1 if powers[c] >= 1 else 0]) if c in ends else 0.0 for c in columns]
        moved = df.select(*[_moved(F.col(c), F.lit(powers[c]), F.lit(o)).alias(c) for c, o in zip(columns, origins)])
        means, spreads = _mean_and_spread(moved, columns)
        return YeoJohnsonModel(
            inputCols=columns, outputCols=self.getOutputCols(), values=means, more=spreads,
            shapes=[powers[c] for c in columns], origins=origins)


class MissingColumns(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the wanted columns that the input lacks, as nulls for the imputer to fill."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.lit(None).cast("double") for c in self.getInputCols() if c not in df.columns})


def preparation(
    numeric: Sequence[str], categorical: Sequence[str] = ("regiao",), scaler: str | None = None, power: bool = False
) -> list:
    """Stages from raw columns to ``features``: fill, optionally transform and scale, encode, assemble.

    Encoding keeps every level; an unseen one becomes all zeros.
    """
    numeric, categorical = list(numeric), list(categorical)

    def named(columns: Sequence[str], step: str) -> list[str]:
        return [f"{c}__{step}" for c in columns]

    stages = [MissingColumns(inputCols=numeric), MedianImputer(inputCols=numeric, outputCols=named(numeric, "filled"))]
    ready = named(numeric, "filled")
    if power:
        stages.append(YeoJohnson(inputCols=ready, outputCols=named(numeric, "power")))
        ready = named(numeric, "power")
    if scaler:
        kind = {"standard": Standardizer, "robust": RobustStandardizer}[scaler]
        stages.append(kind(inputCols=ready, outputCols=named(numeric, "scaled")))
        ready = named(numeric, "scaled")
    if categorical:
        stages += [
            ModeImputer(inputCols=categorical, outputCols=named(categorical, "filled")),
            StringIndexer(
                inputCols=named(categorical, "filled"), outputCols=named(categorical, "index"),
                handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=named(categorical, "index"), outputCols=named(categorical, "onehot"), dropLast=True),
        ]
    stages.append(VectorAssembler(inputCols=ready + named(categorical, "onehot"), outputCol="features"))
    return stages


def tree_pipeline(numeric: Sequence[str], regressor, categorical: Sequence[str] = ("regiao",)) -> Pipeline:
    """For models that scaling does not change."""
    return Pipeline(stages=[*preparation(numeric, categorical), regressor])


def sensitive_pipeline(
    numeric: Sequence[str], regressor, scaler: str = "standard", power: bool = False,
    categorical: Sequence[str] = ("regiao",),
) -> Pipeline:
    """For models that need scaled inputs."""
    return Pipeline(stages=[*preparation(numeric, categorical, scaler, power), regressor])


def required_columns(model) -> list[str]:
    """Raw columns that a fitted pipeline reads: inputs of its stages that no earlier stage makes."""
    made: set[str] = set()
    wanted: list[str] = []
    for stage in model.stages:
        names = stage.getInputCols() if stage.hasParam("inputCols") and stage.isDefined("inputCols") else []
        wanted += [c for c in names if c not in made and c not in wanted]
        if stage.hasParam("outputCols") and stage.isDefined("outputCols"):
            made.update(stage.getOutputCols())
        if stage.hasParam("outputCol") and stage.isDefined("outputCol"):
            made.add(stage.getOutputCol())
    return wanted

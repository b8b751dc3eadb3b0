"""Histogram and density data of a numeric column."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isfinite, log2, pi, sqrt

from pyspark.sql import DataFrame, functions as F

from voltmes.operators.ordering import GROUP_LIMIT
from voltmes.operators.quantiles import quantile_values

# Fixed value: points at which a density is drawn.
GRID_POINTS = 200


#: Largest error of a value's share of the density, relative to the peak of its kernel.
TOLERANCE = 1e-10
#: Bandwidths beyond which a Gaussian kernel is less than 1e-17 of its peak.
REACH = 9


def automatic_bins(df: DataFrame, column: str, limit: int = GROUP_LIMIT) -> int:
    """The larger of the Sturges and Freedman-Diaconis bin counts."""
    return _automatic(df, [column], limit)[column][2]


def _automatic(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, tuple[float, float, int]]:
    """Of each column the least and largest value and the number of bins."""
    facts = df.agg(*[F.struct(F.count(c), F.min(c), F.max(c)) for c in columns]).first()
    quarters = quantile_values(df, columns, [0.25, 0.75], limit)
    return {c: (low, high, _bins(n, low, high, *quarters[c])) for c, (n, low, high) in zip(columns, facts)}


def _bins(n: int, low: float, high: float, q1: float, q3: float) -> int:
    if not n or low == high:
        return 1
    sturges = (high - low) / (log2(n) + 1)
    diaconis = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(sturges, diaconis) if diaconis > 0 else sturges
    return ceil((high - low) / width)


def histograms(df: DataFrame, columns: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Automatic histograms of several columns, counted in one pass: (feature, bin, left_edge, right_edge, n)."""
    cells, edges = [], []
    for c, (low, high, bins) in _automatic(df, columns, limit).items():
        low = 0.0 if low is None else float(low)
        width = (float(high) - low) / bins if high is not None and high > low else 1.0
        number = F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), number).alias("bin")))
        edges += [F.lit(c), F.struct(F.lit(low).alias("low"), F.lit(width).alias("width"))]
    counted = df.select(F.inline(F.filter(F.array(*cells), lambda x: x["bin"].isNotNull()))).groupBy("feature", "bin").agg(F.count("*").alias("n"))
    edge = F.create_map(*edges)[F.col("feature")]
    left, right = (edge["low"] + (F.col("bin") + i) * edge["width"] for i in (0, 1))
    return counted.select("feature", "bin", left.alias("left_edge"), right.alias("right_edge"), "n")


def histogram(df: DataFrame, column: str, bins: int | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value; empty bins have no row."""
    bins = bins or automatic_bins(df, column, limit)
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        low, high = 0.0, 0.0
    width = (high - low) / bins if high > low else 1.0
    x = F.col(column)
    number = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return (
        df.where(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
        .select("bin", (low + F.col("bin") * width).alias("left_edge"), (low + (F.col("bin") + 1) * width).alias("right_edge"), "n")
    )


def densities(df: DataFrame, columns: Sequence[str], points: int = GRID_POINTS, tolerance: float = TOLERANCE) -> DataFrame:
    """Gaussian kernel densities with Scott's bandwidth on even grids over the value ranges: (feature, point, x, density).

    Values are binned linearly: each is split between the two ends of its fine bin, in proportion to its place. That
    moves its share of the density by at most ``width² / 8`` times the kernel's curvature, and the bin width is chosen
    so that this is ``tolerance`` of the kernel's peak. Only bins are shuffled, and a bin adds to the grid points in
    reach alone, so neither grows with the rows as such. Columns with fewer than two values or a single one are left out.
    """
    numbers = df.agg(*[F.struct(F.count(c), F.stddev_samp(c), F.min(c), F.max(c)) for c in columns]).first()
    cells, facts, names = [], [], []
    for c, (n, spread, low, high) in zip(columns, numbers):
        # Rounding may leave equal values a spread.
        if not n or low == high or not spread or not isfinite(spread):
            continue
        low, high, bandwidth = float(low), float(high), float(spread) * n ** (-1 / 5)
        width = bandwidth * sqrt(8 * tolerance)
        place = (F.col(c).cast("double") - F.lit(low)) / F.lit(width)
        for end in (0, 1):
            share = place - F.floor(place) if end else 1 - (place - F.floor(place))
            cells.append(F.struct(F.lit(c).alias("feature"), (F.floor(place) + end).alias("bin"), share.alias("weight")))
        facts += [F.lit(c), F.struct(*[F.lit(v).alias(k) for k, v in dict(
            low=low, width=width, bandwidth=bandwidth, step=(high - low) / (points - 1), scale=1 / (n * bandwidth * sqrt(2 * pi))).items()])]
        names.append(c)
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, point int, x double, density double")
    fact = F.create_map(*facts)[F.col("feature")]
    binned = df.select(F.inline(F.filter(F.array(*cells), lambda s: s["weight"] > 0))).groupBy("feature", "bin").agg(F.sum("weight").alias("weight"))
    binned = binned.select("feature", "weight", (F.col("bin") * fact["width"]).alias("beyond"), fact.alias("f"))
    reach = REACH * F.col("f.bandwidth")
    first = F.greatest(F.ceil((F.col("beyond") - reach) / F.col("f.step")), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("beyond") + reach) / F.col("f.step")), F.lit(points - 1)).cast("int")
    near = binned.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    z = (F.col("point") * F.col("f.step") - F.col("beyond")) / F.col("f.bandwidth")
    shares = near.select("feature", "point", (F.col("weight") * F.col("f.scale") * F.exp(-z * z / 2)).alias("share"))
    # Grid points out of every value's reach have a row, too.
    grid = df.sparkSession.range(points).select(F.explode(F.array(*map(F.lit, names))).alias("feature"), F.col("id").cast("int").alias("point"), F.lit(0.0).alias("share"))
    found = shares.unionByName(grid).groupBy("feature", "point").agg(F.sum("share").alias("density"))
    return found.select("feature", "point", (fact["low"] + F.col("point") * fact["step"]).alias("x"), "density")


def density(df: DataFrame, column: str, points: int = GRID_POINTS) -> DataFrame:
    """``densities`` of one column: (point, x, density)."""
    return densities(df, [column], points).drop("feature")

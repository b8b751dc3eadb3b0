"""Address filters: exact membership in lists of hosts and paths by a cascade of Bloom filters, without joins.

The first filter holds the listed keys. The second holds those keys of the corpus that pass the first without being
listed, the third those listed keys that pass the second, and so on until none is left. A key is listed if the first
filter that it fails has an even number. The first filter's rate of errors is set from the number of keys in the
corpus so that about as many pass as are listed; all sizes then follow the list. In DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


class Bloom:
    """The bits of a set of keys as a constant of the plan."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], level: int, rate: float) -> None:
        self.level, self.hashes = level, max(1, round(log2(1 / rate)))
        self.bits = 64 * ceil(max(64.0, len(keys) * log(1 / rate) / log(2) ** 2) / 64)
        frame = spark.createDataFrame([(k,) for k in keys], "key string")
        at = frame.select(F.explode(F.array(*_positions(F.col("key"), level, self.bits, self.hashes)))).distinct()
        words = [0] * (self.bits // 64)
        for (place,) in at.collect():
            words[place // 64] |= 1 << (place % 64)
        signed = [w - (1 << 64) if w >> 63 else w for w in words]
        self.words = F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        for place in _positions(key, self.level, self.bits, self.hashes):
            found = found & (F.getbit(F.get(self.words, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1)
        return found


class Cascade:
    """Exact membership of every key of ``corpus`` (a column ``key``; repeats are welcome) in a list of keys."""

    def __init__(self, listed: Sequence[str], corpus: DataFrame) -> None:
        spark, listed = corpus.sparkSession, sorted(set(listed))
        self.filters: list[Bloom] = []
        if not listed:
            return
        universe = corpus.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(0.5, len(listed) / max(1, universe - len(listed)) / sqrt(2))
        self.filters.append(Bloom(spark, listed, 1, rate))
        passing = corpus.where(self.filters[0].holds(F.col("key")) & ~F.col("key").isin(listed)).distinct()
        inside, outside = listed, [r[0] for r in passing.collect()]
        while outside:
            # The next filter holds what passed wrongly; what it wrongly holds goes into the one after it.
            level = len(self.filters) + 1
            self.filters.append(Bloom(spark, outside, level, 0.5))
            frame = spark.createDataFrame([(k,) for k in inside], "key string")
            wrong = [r[0] for r in frame.where(self.filters[-1].holds(F.col("key"))).collect()]
            inside, outside = outside, wrong

    def contains(self, key: Column) -> Column:
        found = F.lit(len(self.filters) % 2 == 1)
        for number in range(len(self.filters), 0, -1):
            held = self.filters[number - 1].holds(key)
            found = F.when(held, found).otherwise(F.lit(number % 2 == 0))
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered and path; both are empty for a null or an address without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Every host suffix of up to so many labels, followed by every beginning of the path that ends in a slash."""
    parts = F.split(host, r"\.")
    count = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), count - labels + 1), count), lambda i: F.array_join(F.slice(parts, i, count), "."))
    steps = F.split(path, "/")
    depth = F.least(F.size(steps) - 1, F.lit(slashes))
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda j: F.concat(F.array_join(F.slice(steps, 1, j), "/"), F.lit("/"))))
    return F.coalesce(F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p)))), F.array().cast("array<string>"))


def judge(
    pages: DataFrame, allow: Sequence[str], block: Sequence[str], listed: Sequence[str] = (), id: str = "page_id", url: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    Rules and listed keys are a host, then a path that begins and ends with a slash, such as ``example.com/en/``; they
    fit the host and its subdomains, on paths that start with theirs. The longest fitting rule decides; of equally
    long ones one that blocks, then the last by code points. Without a rule the verdict is ``block`` for an address
    that fits a listed key, else ``allow``. A null or an address without ``://`` fits nothing. Other columns are not read.
    """
    everything = [*allow, *block, *listed]
    if any("/" not in k or not k.endswith("/") for k in everything):
        raise ValueError("a rule is a host and a path that ends with a slash")
    labels = max((k.split("/")[0].count(".") + 1 for k in everything), default=1)
    slashes = max((k.count("/") for k in everything), default=1)
    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(id).alias("i"), F.col(url).alias("u")).withColumns({"h": host, "p": path})
    rows = rows.withColumn("k", keys_of(F.col("h"), F.col("p"), labels, slashes))
    corpus = rows.select(F.explode("k").alias("key"))
    rules, unwanted = Cascade([*allow, *block], corpus), Cascade(listed, corpus)
    both = pages.sparkSession.createDataFrame([(k,) for k in {*allow, *block}], "key string")
    blocking = Cascade(block, both)
    fitting = F.transform(F.filter("k", rules.contains), lambda k: F.struct(F.length(k).alias("n"), blocking.contains(k).alias("b"), k.alias("k")))
    judged = rows.withColumn("r", F.array_max(fitting)).withColumn("x", F.exists("k", unwanted.contains))
    verdict = F.when(F.coalesce(F.col("r.b"), F.col("x")), "block").otherwise("allow")
    return judged.select(F.col("i").alias(id), F.col("h").alias("host"), F.col("p").alias("path"), F.col("r.k").alias("rule"), verdict.alias("verdict"))

"""Language of a text by Bayesian fusion of what it says, what is declared and where it comes from.

Evidence: the likelihood of the text's byte trigrams under each language; the language that the markup or the record
declares, weighed by how often such a declaration agrees with the texts; and a prior by host, smoothed towards that of its
address suffix, which is smoothed towards the whole corpus. Declarations and priors are counts by groups of what
the texts alone say.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.llm.text import Block, blocks, let_go, lists
from voltmes.session import stored

#: Documents per declared language that the trigram model is fitted on, about; all of a language that has no more.
SAMPLE = 1000
BUCKETS = 1 << 16
#: Share in each language's model of all languages together, and as much again of any trigram; the same for all
#: languages, so that trigrams nobody wrote draw no text to a rare one.
SMOOTHED = 0.025
#: Overlapping trigrams are not independent: each counts for a third.
TEMPER = 1 / 3
#: Weight, in documents, of the suffix in a host's prior and of the corpus in a suffix's.
SMOOTHING = 10.0
#: Rejected: a posterior below this, or a mean log-likelihood per trigram this much below that of the language's own texts.
LEAST_POSTERIOR = 0.5
MARGIN = 3.0
#: A declared name whose texts hold fewer different trigrams is no language: one text of a few repeated strings would
#: vouch for itself. A sentence of seven words holds as many.
LEAST_TRIGRAMS = 30
#: Hosts whose priors are sent to all tasks, at most; more are joined with a shuffle.
BROADCAST_HOSTS = 100_000


_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)) + [9, 10, 13, 32, 39]] = True


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes from each place on, A-Z lowered; and whether they are letters and spaces of one text."""
    data, bounds = block
    n = len(data)
    lower = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint32)
    lower = np.append(lower, np.zeros(2, np.uint32))
    code = lower[:n] << 16 | lower[1:n + 1] << 8 | lower[2:n + 2]
    inside = np.ones(n, bool)
    ends = bounds[bounds > 0]
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    letter = np.append(_LETTER[data], [False, False])
    inside &= letter[:n] & letter[1:n + 1] & letter[2:n + 2]
    return (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64), inside


class Model:
    """Log-likelihoods of trigram buckets by language, smoothed towards all languages, and their mean under each language itself."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray) -> None:
        self.languages = list(languages)
        own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        pool = counts.sum(axis=0) / max(counts.sum(), 1)
        share = (1 - 2 * SMOOTHED) * own + SMOOTHED * (pool + 1 / BUCKETS)
        self.logs = np.log(share).astype(np.float32)
        self.usual = (share * np.log(share)).sum(axis=1)


def fit(docs: DataFrame, text: str, declared: Column, sample: int = SAMPLE) -> Model:
    """From about ``sample`` texts of each declared language, chosen by a hash of the text; rare languages from all theirs.

    A name with fewer than ``LEAST_TRIGRAMS`` different trigrams in its texts has no model; an empty declaration is a missing one.
    """
    rows = docs.select(F.col(text).alias("text"), declared.alias("lang")).where("text is not null and lang <> ''")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1_000_000, 1_000_000 * sample // sizes[k] + 1))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        numbers = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            names, done = np.array([numbers[x] for x in batch.column(1).to_pylist()], np.int64), 0
            for block in blocks(batch.column(0)):
                bucket, inside = trigrams(block)
                own = np.repeat(names[done:done + len(block)], np.diff(block.bounds))
                # Spark adds these up in the same task; nothing here grows with the number of languages.
                pair, n = np.unique((own * BUCKETS + bucket)[inside], return_counts=True)
                lang, bucket = np.divmod(pair, BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])
                done += len(block)

    # At most a row per language and bucket.
    summed = chosen.mapInArrow(counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[summed.column("lang").to_numpy(), summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    known = (counts > 0).sum(axis=1) >= LEAST_TRIGRAMS
    return Model([name for name, k in zip(languages, known) if k], counts[known])


def likelihoods(text: Column, model: Model) -> Column:
    """array<double>: the text's log-likelihood by language, then the number of its trigrams."""
    logs, width = model.logs, len(model.languages) + 1

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for column in batches:
            found = [np.zeros((0, width))]
            for block in blocks(column):
                bucket, inside = trigrams(block)
                bounds = block.bounds
                table = np.empty((len(block), width))
                for i in range(width):
                    value = inside.astype(np.float64) if i == width - 1 else np.where(inside, logs[i][bucket], 0.0)
                    running = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
                    table[:, i] = running[bounds[1:]] - running[bounds[:-1]]
                found.append(table)
            whole = np.concatenate(found)
            yield lists(whole.reshape(-1), np.arange(len(whole) + 1) * width, pa.float64())

    return of.asNondeterministic()(text)


def identify(
    docs: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
    model: Model | None = None, out: str = "_language", broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """The rows with ``out``: struct<language, probability, text_language, mean, accepted>.

    ``language`` has the largest posterior (ties: the first by name), ``text_language`` is the one of the text alone,
    ``mean`` the text's log-likelihood per trigram. Not accepted: texts without three letters or spaces in a row
    (null and empty ones, too), a posterior below 0.5, and texts that are far less likely than those of their language. Missing
    declarations, hosts and suffixes are groups of their own. Without any language there is no model and nothing
    is accepted. All columns stay; one named like ``out`` is replaced.
    """
    declared, host, suffix = (F.lit(None).cast("string") if c is None else c.cast("string") for c in (declared, host, suffix))
    model = model or fit(docs, text, declared)
    names = model.languages
    if not names:
        empty = "struct<language string, probability double, text_language string, mean double, accepted boolean>"
        return docs.withColumn(out, F.struct(F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(False)).cast(empty))
    seen = [F.coalesce(c, F.lit("")) for c in (declared, host, suffix)]
    # The caller's columns lie in ``_row``, where no name can meet another.
    facts = F.struct(likelihoods(F.col(text), model).alias("l"), *[c.alias(n) for c, n in zip(seen, "dhs")])
    evidence = docs.select(F.struct("*").alias("_row"), facts.alias("_evidence"))
    said = F.slice("_evidence.l", 1, len(names))
    trigram_count = F.get("_evidence.l", F.lit(len(names)))
    best = F.array_position(said, F.array_max(said)).cast("int") - 1
    groups = evidence.where(trigram_count > 0).select("_evidence.d", "_evidence.h", "_evidence.s", best.alias("t"))
    tallies = stored(groups.groupBy("d", "h", "s", "t").count(), "tallies")

    # How often each language is declared as what: a row per pair, languages and declared names only.
    agreed = {(r[0], r[1]): r[2] for r in tallies.groupBy("d", "t").agg(F.sum("count")).collect()}
    totals = [sum(v for (_, t), v in agreed.items() if t == i) for i in range(len(names))]
    kinds = sorted({d for d, _ in agreed}) or [""]
    logs = F.create_map(*[x for d in kinds for x in (F.lit(d), F.array(*[
        F.lit(float(np.log((agreed.get((d, i), 0) + 0.5) / (totals[i] + 0.5 * (len(kinds) + 1))))) for i in range(len(names))]))])
    everywhere = [(n + 1) / (sum(totals) + len(names)) for n in totals]
    priors = stored(_priors(tallies, everywhere), "priors")
    priors = F.broadcast(priors) if priors.count() <= broadcast_hosts else priors
    joined = evidence.join(priors.toDF("_h", "_s", "_prior"), (F.col("_evidence.h") == F.col("_h")) & (F.col("_evidence.s") == F.col("_s")), "left")
    fallback = F.array(*[F.lit(float(np.log(p))) for p in everywhere])
    nothing = F.array(*[F.lit(0.0) for _ in names])
    parts = F.arrays_zip(said.alias("l"), F.coalesce(logs[F.col("_evidence.d")], nothing).alias("d"), F.coalesce("_prior", fallback).alias("p"))
    posterior = F.transform(parts, lambda x: x["l"] * TEMPER + x["d"] + x["p"])
    top = F.array_max("_posterior")
    probability = 1 / F.aggregate("_posterior", F.lit(0.0), lambda a, v: a + F.exp(v - top))
    at = F.array_position("_posterior", top).cast("int") - 1
    listed, usual = F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(float(u)) for u in model.usual])
    mean = F.get("_evidence.l", at) / trigram_count
    accepted = (trigram_count > 0) & (probability >= LEAST_POSTERIOR) & (mean >= F.get(usual, at) - MARGIN)
    result = F.struct(
        F.get(listed, at).alias("language"), probability.alias("probability"), F.when(trigram_count > 0, F.get(listed, best)).alias("text_language"),
        F.when(trigram_count > 0, mean).alias("mean"), F.coalesce(accepted, F.lit(False)).alias("accepted"))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != out.lower()]
    judged = joined.withColumn("_posterior", posterior).select("_row", result.alias("_judged"))
    return judged.select(*columns, F.col("_judged").alias(out))


def _priors(tallies: DataFrame, everywhere: list[float]) -> DataFrame:
    """(host, suffix, log-prior by language): host counts smoothed by the suffix's, those by the corpus's."""
    def counts(by: Sequence[str]) -> DataFrame:
        return tallies.groupBy(*by).agg(*[F.sum(F.when(F.col("t") == i, F.col("count")).otherwise(0)).alias(f"n{i}") for i in range(len(everywhere))])

    def smoothed(number: Column, total: Column, before: Column) -> Column:
        return (number + SMOOTHING * before) / (total + SMOOTHING)

    def total(prefix: str) -> Column:
        return sum((F.col(f"{prefix}{i}") for i in range(1, len(everywhere))), F.col(f"{prefix}0"))

    suffixes = counts(["s"])
    suffixes = suffixes.select("s", *[smoothed(F.col(f"n{i}"), total("n"), F.lit(p)).alias(f"p{i}") for i, p in enumerate(everywhere)])
    hosts = counts(["h", "s"]).join(suffixes, "s")
    return hosts.select("h", "s", F.array(*[F.log(smoothed(F.col(f"n{i}"), total("n"), F.col(f"p{i}"))) for i in range(len(everywhere))]).alias("prior"))


def keep_identified(docs: DataFrame, text: str = "text", **evidence: Column) -> DataFrame:
    """The rows that ``identify`` accepts, whole and with their own columns only."""
    out = "_language"
    while out in docs.columns:
        out = f"_{out}"
    return identify(docs, text, out=out, **evidence).where(F.col(f"{out}.accepted")).drop(out)

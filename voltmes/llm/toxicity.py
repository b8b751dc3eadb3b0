"""Toxic documents by multiple-instance learning: sentences are the instances, only documents are labelled.

A sentence's logit is the sum of its words' weights; a document is toxic if one of its sentences is (noisy-or). The
weights are learned from document labels alone, and then tell which sentences are at fault. A word has the features
of its whole form and of its first letters, without case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voltmes.llm.text import Block, blocks, lists, new_runs, owners, span_hashes

#: Labelled documents of each class that the weights are learned from, at most.
SAMPLE = 2000
FEATURES = 1 << 20
PREFIXES = (3, 4, 5)
#: A feature counts if it is in one of 400 documents of the sample, in 3 at least and in 10 at most.
LEAST = (400, 3, 10)
_KIND = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())])))])
_BREAK, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_BREAK[list(b" \t\n\x0b\x0c\r.!?,;:\"()")] = True


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, its sentence) of all words; the text and the number within it of each sentence that has words."""
    data, bounds = block
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    gap = _BREAK[data]
    first, last = gap.copy(), gap.copy()
    first[1:], last[:-1] = gap[:-1], gap[1:]
    first[bounds[bounds < n]] = True
    last[bounds[bounds > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1
    text = owners(np.searchsorted(starts, bounds))
    stops = np.cumsum(_STOP[data])[starts]
    opens = new_runs(text, stops)
    sentence = np.cumsum(opens) - 1
    texts = text[opens]
    number = np.arange(len(texts)) - np.searchsorted(texts, texts)
    found = []
    for salt, end in enumerate([ends, *(np.minimum(starts + p, ends) for p in PREFIXES)]):
        found.append(((span_hashes(data, starts, end, lower=True) + np.uint64(salt)) % np.uint64(FEATURES)).astype(np.int64))
    return np.concatenate(found), np.tile(sentence, len(found)), texts, number


def learn(texts: list[str], toxic: list[int], rounds: int = 120, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that make noisy-or over sentences fit the labels of the documents."""
    parts, labels, done, said = [], np.asarray(toxic, float), 0, 0
    held_by = np.zeros(FEATURES, np.int64)
    for block in blocks(pa.array(texts, pa.string())):
        feature, sentence, text, _ = features(block)
        # A document is in one block, so its pairs with features are too.
        held_by += np.bincount(np.unique(feature * len(block) + text[sentence]) // len(block), minlength=FEATURES)
        parts.append([x.astype(np.int32) for x in (feature, sentence + said, text + done)])
        done, said = done + len(block), said + len(text)
    weights = np.zeros(FEATURES)
    if not parts or labels.min() == labels.max():
        return weights, -10.0 if not len(labels) or not labels.max() else 0.0
    common = held_by >= np.clip(len(texts) / LEAST[0], *LEAST[1:])
    usable = [common[p[0]] for p in parts]
    used, feature = np.unique(np.concatenate([p[0][u] for p, u in zip(parts, usable)]), return_inverse=True)
    sentence = np.concatenate([p[1][u] for p, u in zip(parts, usable)]).astype(np.int64)
    text = np.concatenate([p[2] for p in parts]).astype(np.int64)
    del parts, usable
    theta, moment, square = (np.zeros(len(used) + 1) for _ in range(3))
    theta[-1] = -4.0
    share = np.where(labels > 0, 0.3 / max(1, labels.sum()), 0.7 / max(1, (1 - labels).sum()))
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, theta[feature], said) + theta[-1]
        none = np.bincount(text, np.logaddexp(0, z), len(texts))
        # The chance of a toxic document is 1 - exp(-none).
        pull = np.where(labels > 0, -1 / np.expm1(np.clip(none, 1e-12, 500)), 1.0) * share
        slope = pull[text] / (1 + np.exp(np.clip(-z, -500, 500)))
        gradient = np.append(np.bincount(feature, slope[sentence], len(used)), slope.sum())
        gradient[:-1] += decay * theta[:-1]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta -= rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
    weights[used] = theta[:-1]
    return weights, float(theta[-1])


def score(text: Column | str, weights: np.ndarray, bias: float, threshold: float = 0.5) -> Column:
    """struct<score, sentences>: the chance that a text is toxic, and its sentences at fault with theirs.

    Sentences are numbered from 0, those without words left out. A null text or one without words scores 0.
    """
    weights = weights.astype(np.float32)

    @F.arrow_udf("struct<score double, sentences array<struct<sentence int, score double>>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = []
            for block in blocks(column):
                feature, sentence, texts, number = features(block)
                z = np.bincount(sentence, weights[feature], len(texts)) + bias if len(texts) else np.zeros(0)
                whole = -np.expm1(-np.bincount(texts, np.logaddexp(0, z), len(block)))
                chance = 1 / (1 + np.exp(np.clip(-z, -500, 500)))
                at = np.flatnonzero(chance >= threshold)
                places = pa.StructArray.from_arrays([pa.array(number[at], pa.int32()), pa.array(chance[at], pa.float64())], ["sentence", "score"])
                parts.append(pa.StructArray.from_arrays(
                    [pa.array(whole, pa.float64()), pa.ListArray.from_arrays(pa.array(np.searchsorted(texts[at], np.arange(len(block) + 1)), pa.int32()), places)],
                    fields=list(_KIND)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _KIND)

    return of(text)


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted, sentences) for every row; ``predicted`` is 1 from a score of 0.5.

    Weights come from up to ``sample`` documents per class, those with the least hash of the id among the labelled ones
    that aren't held out. Of repeated labels the largest counts, null labels and ids none. Without both classes
    to learn from, scores are constant. Other columns are not read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).alias("toxic"))
    known = known.where(~held_out(F.col("id")))
    chosen = None
    for toxic in (0, 1):
        # At most ``sample`` ids, whatever the number of labels.
        some = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    taught = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    rows = taught.select("text", "toxic").toArrow()
    order = np.argsort(np.array([hash_of(t) for t in rows.column("text").to_pylist()], np.uint64), kind="stable")
    weights, bias = learn(rows.column("text").take(pa.array(order)).to_pylist(), rows.column("toxic").to_numpy()[order].tolist())
    scored = docs.select(F.col(id).alias("i"), score(F.col(text), weights, bias).alias("s"))
    return scored.select(
        F.col("i").alias(id), held_out(F.col("i")).alias("held_out"), F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.sentences").alias("sentences"))


def hash_of(text: str) -> int:
    """For an order of the sample that doesn't hang on the order in which tasks end."""
    import zlib

    raw = text.encode("utf-8", "replace")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)

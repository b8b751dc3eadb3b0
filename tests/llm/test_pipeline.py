"""The pipeline stage by stage and the token queries, on a small folder, against plain Python."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voltmes.llm.mixing import mix
from voltmes.llm.queries import QUERIES
from voltmes.session import local_session

SCHEMA = "doc_id long, text string, lang string, source string, _size string, _rest string"
VOCABULARY = [f"{a}{b}{c}" for a in ("st", "br", "m", "l", "pl") for b in ("a", "e", "io", "u") for c in ("n", "rt", "ll", "se")]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def spark():
    session = local_session("8", "tests", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = [prose(i, 40 + i) for i in range(60)] + [None, "", "12 34", prose("short", 10), (prose("again", 12) + " ") * 30, prose("long", 9000)]
    texts += [texts[3], texts[3] + " tail", texts[7].replace(" ", "  "), prose("special", 30) + " <|endoftext|> " + prose("more", 30)]
    rows = [(i, t, "en" if i % 4 else None, f"s{i % 3}" if i % 5 else None, f"a{i}", f"b{i}") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def plain():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return lambda name: tokenizers.Tokenizer.from_file(public.path(name))


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def packed_as(found, wanted):
    """Whether the pieces hold the ids of the documents (a list of lists, repeats included) in sequences without gaps."""
    pieces = Counter((d, at // 4096, at, len(ids[at:at + 4096]), crc(ids[at:at + 4096])) for d, ids in wanted for at in range(0, len(ids), 4096))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing_and_token_queries_equal_the_plain_library(spark, folder, plain):
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    words, octets = plain("word_bpe_49k.json"), plain("byte_bpe_50k.json")
    packed_as(QUERIES["op5_best_fit_packing"](spark, folder).collect(), [(d, ids_of(words, t, 1)) for d, t in rows])
    found, start = {r.doc_id: r for r in QUERIES["op7_simple8b_tokens"](spark, folder).collect()}, 0
    assert len(found) == len(rows)
    for d, t in rows:
        ids = ids_of(octets, t, 0)
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_pipeline_stages(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/after-{name}"
        stage(spark, before, folder).write.parquet(path)
        before = spark.read.parquet(path)
        seen[name] = before.collect()
        if name != "packing":
            assert before.columns == docs.columns
            assert set(map(tuple, seen[name])) <= set(map(tuple, docs.collect()))
    given = {r.doc_id for r in docs.collect()}
    kept = {name: {r.doc_id for r in seen[name]} for name in ("language", "quality", "near_duplicates", "mixing")}
    # Without a text, without letters; too short and repeated; copies of documents 3 and 7.
    assert given - kept["language"] == {60, 61, 62}
    assert kept["language"] - kept["quality"] == {63, 64}
    assert kept["quality"] - kept["near_duplicates"] == {66, 67, 68}
    assert [len(seen[n]) for n in ("language", "quality", "near_duplicates")] == [len(kept[n]) for n in ("language", "quality", "near_duplicates")]
    taken = mix(spark.read.parquet(f"{folder}/after-near_duplicates")).select("doc_id", F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int"))
    assert Counter(r.doc_id for r in seen["mixing"]) == Counter({d: n for d, n in map(tuple, taken.collect()) if n})
    words = plain("word_bpe_49k.json")
    packed_as(seen["packing"], [(r.doc_id, ids_of(words, r.text, 1)) for r in seen["mixing"]])
    whole = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, spark.read.parquet(f"{folder}/after-packing").drop("sequence_id", "offset").collect()))

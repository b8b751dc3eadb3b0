"""Operators on small tables: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import re
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from voltmes.llm.components import components
from voltmes.llm.language import fit, identify, keep_identified
from voltmes.llm.minhash import drop_near_duplicates, near_duplicates
from voltmes.llm.mixing import mix, mixed_documents
from voltmes.llm.neighbours import nearest
from voltmes.llm.packing import packed_documents
from voltmes.llm.repetition import keep_unrepetitive, quality
from voltmes.llm.tokenfile import read_digests, read_tokens, write_tokens
from voltmes.llm.toxicity import toxicity
from voltmes.llm.urlfilter import Cascade, judge
from voltmes.session import local_session, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n string, root string, key string, size string, _source string, s string"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " tail"), (4, None), (5, ""), (6, "two words"), (6, "two words"), (7, "TWO  words"), (None, BASE),
    (8, BASE.replace("w30", "x")), (9, " ".join(f"v{i % 977}" for i in range(30_000))), (10, "l\nl\nl"), (11, "same " * 400),
    (12, BASE.replace("w10", "q").replace("w40", "r").replace("w50", "z")), (13, "é ü x ñ \\ # <|endoftext|>"),
]


@pytest.fixture(scope="module")
def spark():
    session = local_session("8", "tests", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 3}" if n % 5 else None, *"abcdef") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(rows, size):
    own = {}
    for i, t in rows:
        if i is not None:
            own.setdefault(i, []).append(sets(t, size))
    root = {i: i for i in own}
    links = [(a, b) for a, b in combinations(sorted(own), 2) for x in own[a] for y in own[b] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in own:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("crowd, broadcast", [(16, 1000), (0, 0)])
def test_near_duplicates(docs, crowd, broadcast):
    found = near_duplicates(docs, size=4, crowd=crowd, broadcast_ids=broadcast).collect()
    assert len(found) == len(TEXTS)
    root = groups(TEXTS, 4)
    for row in found:
        assert row.component_id == (None if row.doc_id is None else root[row.doc_id])
        assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)
    assert sorted(r.n_shingles for r in found) == sorted(len(sets(t, 4)) for _, t in TEXTS)


def test_drop_near_duplicates(docs):
    root = groups(TEXTS, 5)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({root[i] for i in root})


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (1, 2), (3, 2), (5, 3), (4, 4), (7, 9)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {9: 7, 8: 7, 2: 1, 3: 1, 5: 1}
    assert components(links.where("a > 99")).count() == 0


def test_quality(docs):
    found = quality(docs).collect()
    assert len(found) == len(TEXTS)
    by = {r.doc_id: r for r in found}
    assert not by[11].kept and by[11].n_repeat_words == 400 and by[11].longest_repeat == 399
    assert by[10].n_dup_lines == 2 and by[4].n_words == by[5].n_words == 0 and by[1].kept and not by[9].kept
    assert keep_unrepetitive(docs).columns == docs.columns


def test_packing(docs, word_bpe):
    found = packed_documents(docs, word_bpe).collect()
    assert {r.doc_id for r in found} == {i for i, _ in TEXTS}
    assert max(r.length for r in found) <= 4096 and sum(r.length == 1 for r in found) == 2
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        assert [o for o, _ in sorted(inside)] == [sum(n for _, n in sorted(inside)[:k]) for k in range(len(inside))]
    assert len(places) == -(-sum(r.length for r in found) // 4096)


def test_token_files(spark, docs, word_bpe):
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, word_bpe, shards=3)
    tokens = read_tokens(spark, path).orderBy("start").collect()
    assert [r.id for r in tokens] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    digests = {r.start: r for r in read_digests(spark, path).collect()}
    at = 0
    for r in tokens:
        assert r.start == at and r.n_tokens == len(r.tokens) and r.tokens[-1] == 0
        assert digests[at].ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in r.tokens))
        at += r.n_tokens


def test_mix(spark, docs):
    found = mix(docs).collect()
    assert len(found) == len(TEXTS) and sorted(map(tuple, found), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)
    taken, targets = {}, {}
    for r in found:
        assert 0 <= r._taken <= 2 * r._size
        key = (r.source, r._target)
        taken[key], targets[key] = taken.get(key, 0) + r._taken, r._target
    assert all(abs(taken[k] - targets[k]) <= 2 for k in taken)
    sizes = {r.source: r._source_size for r in found}
    level, free = 1.5 * sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2, 3)))
    wanted = {}
    while True:
        share = {s: level * w / sum(free.values()) for s, w in free.items()}
        full = [s for s in share if share[s] >= 2 * sizes[s]]
        if not full:
            wanted.update(share)
            break
        for s in full:
            wanted[s] = 2.0 * sizes[s]
            level -= wanted[s]
            del free[s]
        if not free:
            break
    assert all(abs(wanted[r.source] - r._target) < 1e-6 * max(1, wanted[r.source]) for r in found)
    assert mixed_documents(docs).columns == docs.columns


#: Names that the operators use within themselves.
INTERNAL = ["_source", "_key", "_size", "_mark", "_copy", "_target", "_rest", "_cut", "_part", "_epochs", "_taken", "_source_size", "_row",
            "_evidence", "_posterior", "_h", "_s", "_prior", "_language", "position", "row", "l", "a.b"]


def test_columns_named_like_internal_ones_keep_their_values(spark):
    rows = [(i, f"the quick brown fox number {i} and the lazy dog of the old house by the river", "en", f"s{i % 3}", *[f"{n}{i}" for n in INTERNAL]) for i in range(30)]
    table = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *INTERNAL]).repartition(3)
    own = {r[0]: tuple(r) for r in rows}
    repeated = mixed_documents(table)
    assert repeated.columns == table.columns
    found = [tuple(r) for r in repeated.collect()]
    assert {r[0] for r in found} <= set(own) and len(found) > 30 and all(r == own[r[0]] for r in found)
    plain = {r.doc_id: r for r in mix(table.select("doc_id", "text", "lang", "source")).collect()}
    results = ["_size", "_source_size", "_target", "_taken"]
    for r in mix(table).collect():
        assert [r[c] for c in results] == [plain[r.doc_id][c] for c in results]
        assert all(r[c] == f"{c}{r.doc_id}" for c in INTERNAL if c not in results)
    kept = keep_identified(table, declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == table.columns and {r[0]: tuple(r) for r in kept.collect()} == own
    for r in identify(table, declared=F.col("lang"), host=F.col("source")).collect():
        assert r["_language"].accepted and all(r[c] == f"{c}{r.doc_id}" for c in INTERNAL if c != "_language")


def test_a_long_passage_pasted_twice_is_dropped(spark):
    def pasted(n):
        passage = [f"p{i}" for i in range(n)]
        return " ".join([*passage, *(f"x{i}" for i in range(3000)), *passage, *(f"y{i}" for i in range(3000))])

    table = spark.createDataFrame([(n, pasted(n)) for n in (40, 50, 51, 60)], "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_unrepetitive(table).collect()) == [40, 50]


def test_junk_does_not_vouch_for_itself(spark):
    prose = "the quick brown fox and the lazy dog were sleeping in the old house by the river when a small boat came along "
    rows = [(i, prose * (1 + i % 3), "en") for i in range(30)] + [(100 + i, "qzqx jwvk " * (30 + i), "zz") for i in range(3)] + [(200, "qzqx jwvk " * 30, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(table, "text", F.col("lang")).languages == ["en"]
    assert sorted(r.doc_id for r in keep_identified(table, declared=F.col("lang")).collect()) == list(range(30))


def test_nearest(spark):
    rows = [(i, [float((i * 7 + d * 3) % 11 - 5) for d in range(6)], "c") for i in range(200)] + [
        (500, None, "c"), (501, [0.0] * 6, "c"), (502, [float("nan")] + [1.0] * 5, "c"), (503, [float("inf")] + [1.0] * 5, "c"),
        (504, [None] + [1.0] * 5, "c"), (None, [1.0] * 6, "c"), (505, [], "c"), (520, [1.0, 2.0], "c"), (521, [2.0, 1.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    for cell_rows in (4096, 64):
        found = nearest(table, F.col("vec_id") % 20 == 0, cell_rows=cell_rows, confidence=1 - 1e-12).collect()
        good = {i: v for i, v, _ in rows[:200]}
        for q in range(0, 200, 20):
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:20]
            assert [(r.rank, r.vec_id, -r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [(n + 1, i, s) for n, (s, i) in enumerate(scores)]
        assert [(r.vec_id, r.score) for r in found if r.query_id == 520] == [(521, 4.0)]
        assert {r.query_id for r in found} == {*range(0, 200, 20), 520}
    assert nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_toxicity(spark):
    rows = [(i, ("good words here. " * 5) + ("you idiot there. " if i % 4 == 0 else "") + "more words", "x") for i in range(400)] + [(900, None, "x"), (901, "", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(None, 1, 1), (900, None, 1)], "doc_id long, toxic int, text int")
    found = {r.doc_id: r for r in toxicity(table, labels).collect()}
    assert all(found[i].predicted == (i % 4 == 0) for i in range(400)) and found[900].score == found[901].score == 0
    assert [s.sentence for s in found[4].sentences] == [5]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert {r.predicted for r in toxicity(table, labels.where("false")).collect()} == {0}
    assert toxicity(table.where("false"), labels).count() == 0


def test_cascade_is_exact(spark):
    corpus = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 7)] + ["absent"]
    cascade = Cascade(listed, corpus)
    assert {r.key for r in corpus.where(cascade.contains(F.col("key"))).collect()} == set(listed) - {"absent"}
    assert corpus.where(Cascade([], corpus).contains(F.col("key"))).count() == 0


def test_judge(spark):
    urls = ["http://www.Example.com/en/x", "http://a.example.com/en/", "http://example.com/enx", "ftp://x.net/es/?q", "http://net/fr/a#b", None, "x.net/es/",
            "http://com", "http://bad.org/", "http://COM/?x", "http:///en/"]
    table = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, k string")
    found = judge(table, ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"], ["bad.org/"]).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"),
        ("example.com", "/enx", "com/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("net", "/fr/a", "net/fr/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("com", "", None, "allow"), ("bad.org", "/", None, "block"), ("com", "/", "com/", "allow"), ("", "/en/", None, "allow")]


def test_language(spark):
    english, german = "the quick brown fox and the lazy dog ", "der schnelle braune fuchs und der faule hund "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", f"h{i % 3}", "x") for i in range(80)]
    rows += [(90, None, "en", "h1", "x"), (91, "", None, None, "x"), (92, "12 345", "en", "h1", "x"), (93, german, None, "h1", "x"), (94, english, "de", None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _language string")
    found = {r.doc_id: r.z for r in identify(table, declared=F.col("lang"), host=F.col("source"), out="z").collect()}
    assert all(found[i].language == ("en" if i % 2 else "de") and found[i].accepted for i in range(80))
    assert found[93].language == "de" and found[94].language == "en" and not any(found[i].accepted for i in (90, 91, 92))
    kept = keep_identified(table, declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == table.columns and kept.count() == 82
    assert identify(table.where("false"), declared=F.col("lang")).count() == 0 and fit(table.where("false"), "text", F.col("lang")).languages == []


def test_empty_tables(spark, nothing, word_bpe):
    assert near_duplicates(nothing).count() == quality(nothing).count() == packed_documents(nothing, word_bpe).count() == mix(nothing).count() == 0
    assert drop_near_duplicates(nothing).count() == keep_unrepetitive(nothing).count() == mixed_documents(nothing).count() == 0
    path = scratch_path(spark, "tokens")
    write_tokens(nothing, path, word_bpe)
    assert read_digests(spark, path).count() == 0

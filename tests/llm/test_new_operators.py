"""Fill-in-middle, phrases and near-duplicate vectors against plain Python."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltmes.llm import middle, phrases, tiles
from voltmes.llm.queries import QUERIES
from voltmes.llm.text import blocks
from voltmes.session import local_session

TEXTS = [
    "", None, " ", "\t\n ", "a", "a b", "  two  words ", "é ü 漢字 kana   x y", "line\nbreak\r\n\x0b\x0cend ", "<P> holds a mark", "x<S", "<M>",
    "tail <", "P> head", "😀 " * 9, "w " * 3000, "long" * 5000, "word " * 8 + "\x1f \x0e", "12345678 1234567 123456789 ", "Über Straße. Straße über\talles",
]


@pytest.fixture(scope="module")
def spark():
    session = local_session("8", "tests", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    return session


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def plainly_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    found = units(text)
    n = len(found)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(found[:low]), "".join(found[low:high]), "".join(found[high:])
    if text == "" or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_unit_ends_and_select():
    chance = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(chance.choices(" \t\n\x08\x0e\x7fab é漢", k=chance.randint(0, 40))) for _ in range(400)]
    for block in blocks(pa.array(texts), 300):
        text = [bytes(block.data[a:b]).decode() for a, b in zip(block.bounds, block.bounds[1:])]
        for rank in range(4):
            draws = np.full(len(text), rank)
            n, low, high = middle.cuts(block, draws, draws)
            assert (low == high).all() and n.tolist() == [len(units(t)) for t in text]
            assert low.tolist() == [len("".join(units(t)[:rank % (len(units(t)) + 1)]).encode()) for t in text]


def test_fill_in_middle(spark):
    rows = [(i, t, i, 0) for i, t in enumerate(TEXTS * 12)] + [(None, "no id here at all", 1, 0), (7, "twice the same row", 1, 0), (7, "twice the same row", 1, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int, c int").repartition(5)
    cut = middle.fill_in_middle(table)
    found = cut.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *plainly_cut(i, t), t or "") for i, t, _, _ in rows)
    assert Counter(tuple(r) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(table.limit(0)).count() == 0
    every = middle.fill_in_middle(table, rate=100, suffix_first=0, sentinels=("[p", "{s", "(m")).where("form <> 'plain'")
    assert {r.form for r in every.collect()} == {"psm"}
    with pytest.raises(ValueError):
        middle.fill_in_middle(table, sentinels=("<P>", "<P<", "<M>"))


def plain_phrases(rows, least, top=2000, longest=4):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i:i + size])] += 1
    often = {k: c for k, c in count.items() if c >= least}
    found = []
    for lang in {lang for lang, _ in often}:
        kept = []
        for (own, phrase), a in often.items():
            if own != lang or len(phrase) < 2:
                continue
            outer = [c for (o, longer), c in often.items() if o == lang and len(longer) > len(phrase)
                     and any(longer[i:i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))]
            if any(100 * c >= 80 * a for c in outer):
                continue
            score, k = min((Fraction(2000000 * a, often[lang, phrase[:k]] + often[lang, phrase[k:]]).__floor__(), k) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), often[lang, phrase[:k]], often[lang, phrase[k:]]))
        found += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(found)


def sentences(seed, count):
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünder", "漢字", "A B", "\x1f"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return ["".join(w + chance.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for w in chance.choices(vocabulary, weights, k=chance.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("shards,slots", [(1, 1 << 10), (3, 16), (4, 1 << 12)])
def test_phrases_equal_plain_counting(spark, monkeypatch, shards, slots):
    monkeypatch.setattr(phrases, "COUNTED_BYTES", 2000)
    texts = sentences(1, 160) + ["the very same line of words " * 40, "", None, " .,; ", "Late Words Here " * 35]
    rows = [(["en", "de", None, "und"][i % 4], t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, phrase int, c int").repartition(6)
    found = sorted(tuple(r) for r in phrases.phrases(table, least=8, top=60, shards=shards, slots=slots).collect())
    assert found == plain_phrases(rows, 8, 60)
    assert {len(r[2].split(" ")) for r in found} >= {2, 3, 4}


def test_phrases_of_nothing(spark):
    table = spark.createDataFrame([("en", "one two"), ("en", None), (None, "")], "lang string, text string")
    assert phrases.phrases(table).count() == 0
    assert phrases.phrases(table.limit(0)).count() == 0
    assert sorted(tuple(r)[:5] for r in phrases.phrases(table, least=1).collect()) == [("en", 1, "one two", 1, 1)]


def plain_links(rows, threshold=0.9):
    usable = [(i, v) for i, (_, v) in enumerate(rows) if rows[i][0] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(v) / np.abs(v).max() for i, v in usable}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    linked = {i: [j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= threshold] for i in unit}
    root = {rows[i][0]: rows[i][0] for i in unit}
    changed = True
    while changed:
        changed = False
        for i in unit:
            for j in linked[i]:
                low = min(root[rows[i][0]], root[rows[j][0]])
                for k in (rows[i][0], rows[j][0]):
                    changed |= root[k] != low
                    root[k] = low
    found = []
    for i, (id_, _) in enumerate(rows):
        component = root[id_] if i in unit else id_
        found.append((id_, len(linked.get(i, [])), component, component == id_ if id_ is not None else True))
    return sorted(found, key=repr)


@pytest.mark.parametrize("block_rows,tile", [(16_384, 1024), (7, 4)])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block_rows, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    chance = np.random.default_rng(3)
    centre = chance.standard_normal((6, 24))
    # Spreads around 0.2 give cosines on both sides of the threshold; one group is large.
    near = [centre[min(i % 11, 5)] + chance.standard_normal(24) * (0.05 + 0.1 * (i % 3)) for i in range(150)]
    vectors = [v.tolist() for v in near] + [(near[0] * 3).tolist(), near[1].tolist(), near[1].tolist(), (-near[2]).tolist()]
    vectors += [[0.0] * 24, None, [], [1.0, None] * 12, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.1], [5.0], [1e200] * 24, [1e-200] * 24]
    rows = [(i * 7 % 1000, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (7, vectors[3]), (14, [0.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, links int, node string").repartition(5)
    found = sorted((tuple(r) for r in tiles.near_vectors(table, block_rows=block_rows).collect()), key=repr)
    assert found == plain_links(rows)
    assert max(r[1] for r in found) > 20


def test_near_vectors_of_nothing(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in tiles.near_vectors(table).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert tiles.near_vectors(table.limit(0)).count() == 0


def test_a_tile_stops_early_and_loses_no_link():
    chance = np.random.default_rng(1)
    x = chance.standard_normal((300, 64)) * np.linspace(3, 0.1, 64)
    x[100:140] = x[:40] + chance.standard_normal((40, 64)) * 0.05
    turn = tiles.directions(tiles.units(x).T @ tiles.units(x))
    one = tiles.Side(x, turn)
    a, b = tiles.close(one, slice(0, 150), one, slice(150, 300), 0.9)
    whole = tiles.units(x) @ tiles.units(x).T >= 0.9
    want = np.argwhere(whole[:150, 150:])
    assert sorted(zip(a, b)) == sorted((i, j + 150) for i, j in want)
    a, b = tiles.close(one, slice(0, 300), one, slice(0, 300), 0.9)
    assert len(a) == whole.sum() > 300


def test_queries_read_whole_tables(spark, tmp_path):
    texts = [t or "" for t in sentences(4, 50)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op11_swar_fill_in_middle"](spark, str(tmp_path)).collect()}
    assert len(found) == 50
    for i, text in enumerate(texts):
        n, form, p, m, output = plainly_cut(i, text)
        assert tuple(found[i]) == (i, n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(tuple(r) for r in QUERIES["op12_counted_phrases"](spark, str(tmp_path)).collect()) == plain_phrases([("en", t) for t in texts], 30)


def test_tables_of_phrases_travel_small():
    """A table of 16 million places, nearly all empty, is no file of 16 MB for every task's code."""
    from pyspark.cloudpickle import dumps

    sent = []
    rows = SimpleNamespace(schema=None, mapInArrow=lambda code, schema: sent.append(code))
    wanted = np.zeros(phrases.SLOTS, bool)
    wanted[[0, 5, phrases.SLOTS - 1]] = True
    phrases._at_slots(rows, wanted)
    assert len(dumps(sent[0])) < 1 << 20
    table = pa.table({"slot": pa.array([0, 1, 5, 7, phrases.SLOTS - 1], pa.int32())}).to_batches()
    assert [b.column("slot").to_pylist() for b in sent[0](iter(table))] == [[0, 5, phrases.SLOTS - 1]]
    counted = SimpleNamespace(select=lambda *names: rows)
    rows.mapInArrow = lambda code, schema: sent.append(code) or SimpleNamespace(groupBy=lambda *by: SimpleNamespace(agg=lambda c: None))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "F", SimpleNamespace(sum=lambda c: SimpleNamespace(alias=lambda n: None)))
        phrases._counted(counted, [1], np.zeros(phrases.SLOTS, np.int8), -1)
    assert len(dumps(sent[1])) < 1 << 20


def test_rare_pairs_of_words_are_not_counted_by_text(spark, monkeypatch):
    rows = [("en", f"one two x{i} y{i} one") for i in range(200)] + [("de", f"one two x{i} z{i} one two") for i in range(29)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    texts = phrases._dealt(table, "lang", "text", 2)
    steps = np.ones(1 << 10, np.int8)

    def pairs(listed):
        found = phrases._counted(texts, [2], steps, -1, listed).where("size = 2").collect()
        return {(r.lang, r.phrase): r.c for r in found}

    every = pairs(None)
    assert len(every) > 600
    for together in (50, phrases.SORTED_PAIRS):
        listed = phrases._frequent_pairs(texts, 30, 1 << 27, together)
        assert listed.nbytes == 1 << 24
        assert pairs(listed) == {k: c for k, c in every.items() if c >= 30} == {("en", "one two"): 200, ("de", "one two"): 58}
    assert pairs(phrases._frequent_pairs(texts, 1, 1 << 12, 50)) == every
    few = pairs(phrases._frequent_pairs(texts, 30, 1 << 7, 50))
    assert few.items() <= every.items() and {("en", "one two"), ("de", "one two")} <= set(few) and len(few) < len(every)
    found = []
    counted = phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda *a: found.append(counted(*a)) or found[-1])
    assert sorted(tuple(r) for r in phrases.phrases(table).collect()) == plain_phrases(rows, 30)
    assert sum(f.where("size = 2").count() for f in found) <= 8

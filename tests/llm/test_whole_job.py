"""Cases in which an operator or query once did less than the whole job."""

import random

import pytest
from pyspark.sql import functions as F

from voltmes.llm import minhash, queries
from voltmes.llm.language import fit, identify, keep_identified
from voltmes.llm.minhash import drop_near_duplicates, near_duplicates
from voltmes.session import local_session


@pytest.fixture(scope="module")
def spark():
    session = local_session("8", "tests", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    return session


def test_op9_blocks_listed_sites_under_each_domain_where_no_rule_fits(spark, tmp_path):
    sites = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"]
    hosts = [f"{sub}{site}.example.{top}" for sub in ("", "www.") for site in sites for top in ("com", "net", "org")] + ["fine.example.net", "fine.example.org"]
    rows = [(i, f"https://{host}/de/x") for i, host in enumerate(hosts)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    listed = [f"{site}.example.{top}/" for site in sites for top in ("com", "net", "org")]
    found = {r.host: (r.rule, r.verdict) for r in queries.QUERIES["op9_bloom_cascade_urls"](spark, str(tmp_path), unwanted=listed).collect()}
    assert found == {h: ("com/", "allow") if h.endswith("com") else (None, "allow" if h.startswith("fine") else "block") for h in hosts}
    plain = {r.host: r.verdict for r in queries.QUERIES["op9_bloom_cascade_urls"](spark, str(tmp_path)).collect()}
    assert plain == {h: verdict for h, (_, verdict) in found.items()}


def words(letters, seed, n=60):
    """A text of invented words from a vocabulary of its own."""
    vocabulary = random.Random(letters)
    vocabulary = ["".join(vocabulary.choices(letters, k=vocabulary.randint(2, 9))) for _ in range(150)]
    return " ".join(random.Random(seed).choices(vocabulary, k=n))


def test_rare_declared_languages_are_fitted(spark):
    written = {"en": ("etaoinshrdlucm", 600), "fr": ("eaisnrtolucdmp", 300), "es": ("aeosrnidlctump", 19), "el": ("αειοτνσρκπ", 1), "ru": ("оеаинтсрвл", 19), "pt": ("aeosridmntucvl", 1)}
    texts = [(words(letters, f"{lang}{i}"), lang, lang) for lang, (letters, n) in written.items() for i in range(n)]
    # Missing declarations, an empty one, a language without a letter, and junk that no language explains.
    texts += [(words(written["en"][0], "more"), None, "en"), (words(written["es"][0], "more"), "", "es"), ("12 345", "xx", None), ("qzqx jwvk " * 30, None, None)]
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string, truth string").repartition(3)
    assert fit(table, "text", F.col("lang")).languages == sorted(written)
    found = identify(table, declared=F.col("lang")).collect()
    assert [(r.doc_id, r.truth, r._language) for r in found if r.truth and (r._language.language != r.truth or not r._language.accepted)] == []
    assert [r._language.accepted for r in found if not r.truth] == [False, False]
    assert keep_identified(table, declared=F.col("lang")).count() == len(texts) - 2


def test_an_id_with_different_texts_links_them(spark):
    a, b, c, d = (" ".join(f"{letter}{i}" for i in range(40)) for letter in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, ""), (8, c), (20, d), (30, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_duplicates(table).collect()
    root = {1: 1, 5: 1, 7: 1, 9: 8, 8: 8, 20: 20, 30: 30}
    assert len(found) == len(rows)
    assert all(r.component_id == root[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in found)
    assert sorted(r.doc_id for r in drop_near_duplicates(table).collect()) == [1, 8, 20, 30]


def test_tasks_of_near_duplicates_run_each_kernel_once(spark, monkeypatch):
    """Each kernel of a task takes a worker process of its own; none runs for a filter and once more for the column."""
    plans = []

    def seen(df, name="rows"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(minhash, "stored", seen)
    texts = spark.createDataFrame([(i, f"a b c d e {i} g h i j") for i in range(40)], "id long, text string")
    nodes = texts.selectExpr("id as node", "id as root")
    minhash._mixed(minhash._rarest(nodes, texts, 5, 80))
    # Its two sides are tasks of their own.
    assert plans[-1].count("ArrowEvalPython") == 2
    chunks = nodes.selectExpr("node", "struct(1L as count, root, 0L as chunk) as place")
    meeting = spark.createDataFrame([((1, 1, 0), (1, 2, 0))], "low struct<count long, root long, chunk long>, high struct<count long, root long, chunk long>")
    seen(minhash._linked(meeting, chunks, texts, 5, 80))
    assert plans[-1].count("ArrowEvalPython") == 1

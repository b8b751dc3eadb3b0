"""The registered queries of this package and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltmes.llm.chat import digests, format_chats
from voltmes.llm.language import identify
from voltmes.llm.middle import fill_in_middle, restored
from voltmes.llm.minhash import near_duplicates
from voltmes.llm.mixing import mix
from voltmes.llm.neighbours import nearest
from voltmes.llm.packing import packed_documents
from voltmes.llm.phrases import phrases
from voltmes.llm.repetition import quality
from voltmes.llm.tiles import near_vectors
from voltmes.llm.tokenfile import read_digests, write_tokens
from voltmes.llm.toxicity import toxicity
from voltmes.llm.urlfilter import host_and_path, judge
from voltmes.session import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), size=4)


@query("op2_repetition_rules", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
g AS (SELECT r, i, w, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
             list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING) AS h FROM w),
c AS (SELECT r, i, w, count(*) OVER (PARTITION BY r, g) > 1 AND len(g) = 8 AS twice,
             len(h) = 101 AND count(*) OVER (PARTITION BY r, md5(CAST(h AS VARCHAR))) > 1 AS longer FROM g),
m AS (SELECT r, w, longer, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM c),
a AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words,
             coalesce(sum(length(w)) FILTER (inside), 0) AS repeat_chars, max(longer) AS longer FROM m GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(repeat_chars, 0) AS repeat_chars, coalesce(longer, false) AS longer
      FROM t LEFT JOIN a USING (r) LEFT JOIN d USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * repeat_chars <= 40 * word_chars AND NOT longer AS kept
FROM f""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder)).drop("repeat_chars", "longest_repeat", "spans")


@query("op3_chat_round_trip")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    written = stored(format_chats(rows.union(more)), "chats")
    return written.select("conv_id", digests("formatted", "loss").alias("d")).select("conv_id", "d.*")


@query("op4_stable_projections")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(documents(spark, folder), tokenizer_path("word_bpe_49k.json"))


@query("op6_efraimidis_spirakis_mix")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(documents(spark, folder))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), F.col("_taken").alias("taken"))


@query("op7_simple8b_tokens")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, folder), path, tokenizer_path("byte_bpe_50k.json"))
    return read_digests(spark, path).withColumnRenamed("id", "doc_id").select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@query("op8_noisy_or_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")).drop("sentences")


ALLOWED = ["com/", "www.example.com/en/"]
BLOCKED = ["example.com/en/", "net/es/", "net/fr/"]
#: Sites that are unwanted as far as no rule speaks, under each domain that the pages have them on.
UNWANTED = [
    f"{site}.example.{domain}/" for domain in ("com", "net", "org")
    for site in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
]


@query("op9_bloom_cascade_urls", r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(rh, rp, rv)),
m AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN regexp_matches(host,
    '(^|[.])(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)[.]example[.](com|net|org)$')
    AND starts_with(path, '/') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (r)""")
def op9(spark: SparkSession, folder: str, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """The SQL holds the keys of ``UNWANTED``; a caller may give other hosts."""
    return judge(spark.read.parquet(f"{folder}/pages.parquet"), ALLOWED, BLOCKED, unwanted)


@query("op10_language_fusion")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The documents: the record declares the language, the source stands for the host."""
    found = identify(documents(spark, folder), declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", "lang", "source", "_language.language", F.round("_language.probability", 9).alias("probability"),
                        "_language.text_language", F.col("_language.accepted").alias("kept"))


@query("language_pages")
def pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages: the markup declares the language, hosts and address suffixes come from the address."""
    rows = spark.read.parquet(f"{folder}/pages.parquet")
    host, _ = host_and_path(F.col("url"))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    rows = rows.select("page_id", body.alias("body"), host.alias("host"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1).alias("declared"))
    found = identify(rows, "body", declared=F.col("declared"), host=F.col("host"), suffix=F.substring_index("host", ".", -1))
    return found.select("page_id", "host", "declared", "_language.language", F.round("_language.probability", 9).alias("probability"),
                        "_language.text_language", F.col("_language.accepted").alias("kept"))


_UNITS = r"regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"


@query("op11_swar_fill_in_middle", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, {_UNITS} AS u, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS h FROM t),
k AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, folder))
    return cut.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")


_PARTS = ("SELECT lang, size, phrase, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS other, f AS a "
          "FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, size - 1)) AS k FROM f WHERE size > 1)")


@query("op12_counted_phrases", rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?
-
]+')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, w, i, unnest(generate_series(1, least(4, len(w) - i + 1))) AS size FROM i),
c AS (SELECT lang, CAST(size AS INTEGER) AS size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE size = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE f >= 30),
k AS ({_PARTS}),
s AS (SELECT k.lang, k.phrase, k.size, k.a, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score, k
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.one JOIN f r ON r.lang = k.lang AND r.phrase = k.other),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
x AS (SELECT lang, f, string_split(phrase, ' ') AS w, size, unnest(generate_series(2, size - 1)) AS m FROM f WHERE size > 2),
y AS (SELECT lang, f, w, m, unnest(generate_series(1, size - m + 1)) AS i FROM x),
z AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS outer_f FROM y GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE o = 1 AND (outer_f IS NULL OR 100 * outer_f < 80 * a))
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases(documents(spark, folder))


@query("op13_pca_tiled_vectors", """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT r, vec_id, v FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.r, a.vec_id, b.vec_id AS other FROM s a JOIN s b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
c AS (SELECT DISTINCT vec_id, vec_id AS root FROM s UNION SELECT p.other, c.root FROM c JOIN p ON p.vec_id = c.vec_id),
m AS (SELECT vec_id, min(root) AS root FROM c GROUP BY vec_id),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r)
SELECT e.vec_id, coalesce(n, 0) AS n_links, CASE WHEN s.r IS NULL THEN e.vec_id ELSE root END AS component_id,
  coalesce(e.vec_id = CASE WHEN s.r IS NULL THEN e.vec_id ELSE root END, true) AS kept
FROM e LEFT JOIN s ON s.r = e.r LEFT JOIN m ON m.vec_id = e.vec_id LEFT JOIN n ON n.r = e.r""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))

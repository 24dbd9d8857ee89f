"""Registered queries of the text operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import (
    decontaminate, filter_audit, line_dedup, mixing, ngram_join, quality, spelling, spotsigs, substring_dedup, token_counts, toxicity,
    vantage, warc,
)
from panelwright.llm.shared import documents, importable, sha256_hex

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    LLM_QUERIES[fn.__name__] = run
    return run


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a classifier fitted on the labels outside the held-out third."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.training_rows(docs, labels, "quality"))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those of keys in five documents or more dropped but in the last document."""
    docs = documents(spark, sf_dir)
    kept = line_dedup.cleaned(docs, line_dedup.built(docs, min_docs=5, min_chars=40))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


LLM_ORACLE["op4_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, i, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), keys AS (
    SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, i, l, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN keys USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and link group of every document: distinct 4-word shingles, Jaccard 0.85 and more."""
    return ngram_join.linked(documents(spark, sf_dir), width=4, percent=85)


LLM_ORACLE["op8_ngram_join"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, b FROM reached r JOIN links ON a = r.other)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, t.doc_id) AS component_id
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS root FROM reached GROUP BY doc_id) USING (doc_id)
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that benchmark items leak into, as pairs, by slot-consistent template windows."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes, with the target of its source."""
    return mixing.mixed_documents(documents(spark, sf_dir, "source"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, as the library counts them."""
    return token_counts.counted(documents(spark, sf_dir), limit=2048)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LLM_ORACLE["op7_warc"] = r"""
WITH bodies AS (
    SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last, count(*) OVER (PARTITION BY coalesce(html, '')) AS n FROM pages
), digits AS (
    SELECT *, array_to_string(list_transform(string_split(upper(sha1(html)), ''), lambda h: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
        '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789ABCDEF', h)]), '') AS bits FROM bodies
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT
        + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1)]), '') AS payload_digest,
    CASE WHEN n > 1 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM digits
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every document, by labels outside the held-out third."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.severities(docs, toxicity.fit_toxic(quality.training_rows(docs, labels, "toxic")))


@query
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot fingerprints of every document and of its edited text, their likeness, and near rows of ids divisible by 20."""
    return spotsigs.searched(documents(spark, sf_dir))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the bytes that strings of 200 bytes found elsewhere cover."""
    kept = substring_dedup.deduplicated(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of largest cosine found for every vec_id divisible by 50, among all other rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vantage.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the damaged texts with its near words, the form it varies and the root of that chain."""
    return spelling.variants(spelling.counted(spelling.damaged_words(documents(spark, sf_dir))))


LLM_ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, w, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
    GROUP BY ALL
), hashed AS (
    SELECT w, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || w, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
    FROM runs, crc
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT times, CASE WHEN h % 97 = 0 THEN w[1 : (h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2 : length(w)] ELSE w END AS word FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cuts AS (
    SELECT word, n, i, word[1 : i - 1] || word[i + 1 : length(word)] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
        CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)
), chain AS (
    SELECT word, word AS root, 0 AS step FROM forms
    UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT arg_max(c.root, c.step) FROM chain c WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM forms f
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, for every language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.outcomes(documents(spark, sf_dir, "lang"), labels))


LLM_ORACLE["op13_filter_audit"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m
    FROM texts JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), counts AS (
    SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, m
), f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
    SELECT filter_order, s AS step, bits[s] AS b, coalesce(list_sum(bits[1 : s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)
), figures AS (
    SELECT part, filter_order, step, b, sum(n) FILTER (m & (before | b) = 0) AS kept, sum(n) FILTER (m & b > 0 AND m & before = 0) AS removed,
        sum(n) FILTER (m & b > 0 AND m & before > 0) AS redundant, sum(n) FILTER (m = b) AS unique_fails,
        sum(good) FILTER (m & b > 0 AND m & before = 0) AS good_lost, sum(toxic) FILTER (m & b > 0 AND m & before = 0) AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
    coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM figures
"""

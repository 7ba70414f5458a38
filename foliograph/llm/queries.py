"""The queries of the ten operators over their whole tables, with their production parameters."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, line_dedup, ngram_join, packing, pii, quality_cnn, quality_rules, token_files, url_filter
from .common import table, work_dir


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply(docs, model, keep=["doc_id"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "probability")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/tokens"
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read_digests(spark, folder)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.apply(pages.select("page_id", "url"), url_filter.fit(pages), keep=["page_id"])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.apply(docs, net, keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from ``spark.foliograph.piiKey``; without it pseudonyms have a random one that nobody keeps."""
    key = spark.conf.get("spark.foliograph.piiKey", None)
    return pii.apply(table(spark, sf_dir, "documents"), key.encode() if key else secrets.token_bytes(32), keep=["doc_id"])


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.apply(docs, langid.fit(docs), keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts before its model has a say; SQL can express this part."""
    judged = quality_rules.apply(table(spark, sf_dir, "documents"), quality_rules.constant(), keep=["doc_id"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5's rules say of every page; SQL can express this part."""
    return url_filter.located(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "said")


_OPERATORS = (
    op1_quality_rules, op2_decontamination, op3_packing, op4_token_files, op5_url_filter,
    op6_ngram_join, op7_quality_classifier, op8_pii, op9_language, op10_line_dedup,
)
QUERIES = {f.__name__: f for f in (*_OPERATORS, quality_base_counts, url_rules)}

#: DuckDB's form of what SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "quality_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS window_ FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, window_) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "url_rules": r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t (h, start, said)),
fits AS (
  SELECT page_id, max_by(h || start, length(h || start)) AS rule, max_by(said, length(h || start)) AS said
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id)
SELECT p.page_id, host, path, rule, said FROM p LEFT JOIN fits ON fits.page_id = p.page_id""",
    "op6_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}

"""Queries over the driver's tables, one or more for each operator, and their DuckDB forms."""

from __future__ import annotations

import unicodedata
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import okf
from ..functions.paths import ancestors, classify, folder_of, glob_filter, nfd, resolve
from ..functions.text import searchable
from ..functions.where import project_field, where
from ..operators import find as finding
from ..operators import links as graph
from ..operators import lint
from ..operators.search import SearchIndex, top
from ..sources import page as pages
from ..sources.workspace import Workspace
from ..storage import shared_dir
from ..streaming.sweeps import page_links
from . import adapter as a
from .ingest import Index

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# Pieces of the DuckDB forms: the same tables as a workspace.
_FILES = """WITH files AS (
 SELECT 'region/' || r_regionkey || '.md' AS path, 'markdown' AS kind FROM region UNION ALL
 SELECT 'nation/' || n_nationkey || '.md', 'markdown' FROM nation UNION ALL
 SELECT 'customer/' || c_custkey || '.md', 'markdown' FROM customer UNION ALL
 SELECT 'supplier/' || s_suppkey || '.md', 'markdown' FROM supplier UNION ALL
 SELECT 'embeddings/' || vec_id || '.bin', 'other' FROM embeddings)"""
_GRAPH = _FILES.replace("WITH files", "WITH RECURSIVE files") + """, links AS (
 SELECT 'nation/' || n_nationkey || '.md' AS source, 2 AS line, 'frontmatter' AS kind, 'region/' || n_regionkey || '.md' AS target FROM nation UNION ALL
 SELECT 'customer/' || c_custkey || '.md', 2, 'frontmatter', 'nation/' || c_nationkey || '.md' FROM customer UNION ALL
 SELECT 'supplier/' || s_suppkey || '.md', 2, 'body', 'nation/' || s_nationkey || '.md' FROM supplier UNION ALL
 SELECT 'region/' || r_regionkey || '.md', 4, 'body', 'nation' FROM region)"""
_DOCS = """WITH docs AS (SELECT 'documents/' || d.source || '/' || d.doc_id || '.md' AS path, d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_HREFS = """WITH h AS (SELECT 'pages/' || page_id || '.md' AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages),
 t AS (SELECT source, raw, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.\\-]+:') OR starts_with(raw, '//') THEN 'url' WHEN regexp_replace(raw, '(?s)[#?].*', '') = '' THEN 'anchor' ELSE 'path' END AS type FROM h)"""


# Listings and filters.
@query(_FILES + " SELECT path, kind FROM files")
def files_listing(spark: SparkSession, d: str) -> DataFrame:
    return finding.find(a.entity_files(spark, d), None, finding.FindOptions()).select("path", "kind")


@query(_FILES + " SELECT path FROM files WHERE kind = 'other'")
def kind_filter(spark, d):
    return finding.find(a.entity_files(spark, d), None, finding.FindOptions(kind="other")).select("path")


@query(_FILES + " SELECT path FROM files WHERE regexp_matches(path, '^(nation/[^/]*[.]md|.*/1[^/]*[.]bin)$')")
def glob_matching(spark, d):
    return a.entity_files(spark, d).where(glob_filter(F.col("path_nfd"), ["nation/*.md", "**/1*.bin"])).select("path")


@query(_FILES + " SELECT path FROM files WHERE NOT starts_with(path, 'customer/') AND NOT regexp_matches(path, '^embeddings/[^/][.]bin$')")
def glob_exclude(spark, d):
    return a.entity_files(spark, d).where(glob_filter(F.col("path_nfd"), ["!customer/**", "!embeddings/?.bin"])).select("path")


@query(_FILES + " SELECT count(*) AS files, count(*) FILTER (kind = 'markdown') AS pages, count(*) FILTER (kind <> 'markdown') AS other, 0::BIGINT AS errors FROM files")
def status_counts(spark, d):
    return finding.status(a.entity_files(spark, d))


@query(_FILES + " SELECT path FROM files ORDER BY path LIMIT 21")
def listing_truncated(spark, d):
    """A limit of 20 fetches one row more: its presence is the truncation flag."""
    return finding.find(a.entity_files(spark, d), None, finding.FindOptions(limit=20)).select("path")


def _where(name: str, conditions: list[str], sql: str) -> None:
    @query(_DOCS + f" SELECT path FROM docs WHERE {sql}", name)
    def run(spark, d, conditions=conditions):
        df = a.document_files(spark, d)
        return df.where(where(conditions, F.col("frontmatter"), F.col("kind"), F.col("parse_error"))).select("path")


_where("where_eq", ["lang=de"], "lang = 'de'")
_where("where_ne", ["quality!=1"], "quality IS DISTINCT FROM 1")
_where("where_range_num", ["n_chars>=900", "n_chars<2000.5"], "n_chars >= 900 AND n_chars < 2000.5")
_where("where_range_text", ["lang>en"], "lang > 'en'")
_where("where_present", ["quality"], "quality IS NOT NULL")
_where("where_missing", ["!toxic"], "toxic IS NULL")
_where("where_list_any", ["tags=src3"], "source = 'src3'")
_where("where_list_each", ["tags[]!=fr"], "lang <> 'fr'")
_where("where_field_ref", ["quality=@toxic"], "quality = toxic")
_where("where_field_ref_range", ["n_chars>@doc_id"], "n_chars > doc_id")
_where("where_mapping_never", ["lang.code=de"], "false")


@query(_DOCS + " SELECT path, '\"' || lang || '\"' AS lang, quality::VARCHAR AS quality, '[\"' || lang || '\",\"' || source || '\"]' AS tags FROM docs")
def field_projection(spark, d):
    f = F.col("frontmatter")
    return a.document_files(spark, d).select("path", project_field(f, "lang").alias("lang"), project_field(f, "quality").alias("quality"), project_field(f, "tags[]").alias("tags"))


# The link graph.
@query(_GRAPH + """ SELECT source, line, target, CASE WHEN EXISTS (SELECT 1 FROM files f WHERE f.path = target) THEN 'file' WHEN EXISTS (SELECT 1 FROM files f WHERE starts_with(f.path, target || '/')) THEN 'directory' ELSE 'missing' END AS target_type FROM links WHERE NOT starts_with(source, 'customer')""")
def refs_typed(spark, d):
    links = a.entity_links(spark, d).where(~F.col("source").startswith("customer"))
    return graph.typed(links, a.entity_files(spark, d)).select("source", "line", "target", "target_type")


@query(_GRAPH + """, folders AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM files)))
SELECT l.source, l.line, l.target, CASE WHEN f.path IS NOT NULL THEN 'file' WHEN d.folder IS NOT NULL THEN 'directory' ELSE 'missing' END AS target_type FROM links l LEFT JOIN files f ON f.path = l.target LEFT JOIN folders d ON d.folder = l.target""")
def refs_typed_all(spark, d):
    """Every link typed; ``refs_typed`` leaves out those of customers, as its SQL form does."""
    return graph.typed(a.entity_links(spark, d), a.entity_files(spark, d)).select("source", "line", "target", "target_type")


@query(_GRAPH + " SELECT source, line FROM links WHERE source = 'nation/7.md'")
def refs(spark, d):
    return graph.refs(a.entity_links(spark, d), a.entity_files(spark, d), "nation/7.md").select("source", "line")


@query(_GRAPH + " SELECT source, line, kind FROM links WHERE target = 'nation/3.md'")
def backrefs(spark, d):
    return graph.backrefs(a.entity_links(spark, d), "nation/3.md").select("source", "line", "kind")


@query(_GRAPH + " SELECT source FROM links WHERE target = 'nation/3.md' AND kind = 'body'")
def backrefs_kind(spark, d):
    return graph.backrefs(a.entity_links(spark, d), "nation/3.md", link_kind="body").select("source")


@query(_GRAPH + " SELECT source FROM links WHERE target = 'nation/3.md' AND starts_with(source, 'customer/1')")
def backrefs_from(spark, d):
    some = a.entity_files(spark, d).where(glob_filter(F.col("path_nfd"), ["customer/1*.md"]))
    return graph.backrefs(a.entity_links(spark, d), "nation/3.md", sources=some).select("source")


@query(_GRAPH + """, reach AS (SELECT source AS path FROM links WHERE target = 'region/2.md' UNION SELECT l.source FROM reach r JOIN links l ON l.target = r.path) SELECT path FROM reach WHERE path <> 'region/2.md'""")
def backrefs_transitive(spark, d):
    return graph.transitive_backrefs(a.entity_links(spark, d), a.entity_files(spark, d), "region/2.md").select("path")


@query(_GRAPH + """, f AS (SELECT * FROM links WHERE kind = 'frontmatter'), reach AS (SELECT source AS path FROM f WHERE target = 'region/2.md' UNION SELECT l.source FROM reach r JOIN f l ON l.target = r.path) SELECT path FROM reach WHERE path <> 'region/2.md'""")
def backrefs_transitive_kind(spark, d):
    return graph.transitive_backrefs(a.entity_links(spark, d), a.entity_files(spark, d), "region/2.md", link_kind="frontmatter").select("path")


@query("SELECT 'conversations/' || conv_id || '/' || turn || '.md' AS path, turn::INT AS hops FROM conversations WHERE conv_id = 5 AND turn > 0")
def backrefs_chain(spark, d):
    return graph.transitive_backrefs(a.conversation_links(spark, d), a.conversation_files(spark, d), "conversations/5/0.md").select("path", "hops")


#: Orders that link to their customer, or a missing one, a folder, a URL, out of the workspace or to an anchor.
_ORDERS = _FILES + """, o AS (SELECT 'orders/' || o_orderkey || '.md' AS source, o_orderkey AS k, o_custkey AS c FROM orders),
 l AS (SELECT source, k, CASE WHEN k % 10 = 0 THEN '../customer/' || (c + 1000000000) || '.md' WHEN k % 10 = 1 THEN '../nation' WHEN k % 10 = 2 THEN 'https://x.org/' || c
  WHEN k % 10 = 3 THEN '../../' || c || '.md' WHEN k % 10 = 4 THEN '#' || c ELSE '/customer/' || c || '.md' END AS raw,
  CASE WHEN k % 10 = 0 THEN 'customer/' || (c + 1000000000) || '.md' WHEN k % 10 = 1 THEN 'nation' WHEN k % 10 IN (2, 3, 4) THEN NULL ELSE 'customer/' || c || '.md' END AS target FROM o),
 lost AS (SELECT l.* FROM l LEFT JOIN files f ON f.path = l.target WHERE f.path IS NULL AND k % 10 NOT IN (1, 2, 4))"""


@query(_ORDERS + " SELECT source, raw, target FROM lost")
def broken_links(spark, d):
    """Most links resolve; those to customers that are not there or out of the workspace do not."""
    return graph.broken(a.order_links(spark, d), a.entity_files(spark, d)).select("source", "raw", "target")


@query(_HREFS + " SELECT source, count(*) AS n_broken, count(DISTINCT raw) AS n_raw FROM t WHERE type = 'path' AND regexp_replace(raw, '[/#?].*', '') = '' AND NOT regexp_matches(raw, '^/([#?]|$)') GROUP BY source")
def broken_html_links(spark, d):
    lost = graph.broken(a.html_links(spark, d), a.page_files(spark, d))
    return lost.groupBy("source").agg(F.count("*").alias("n_broken"), F.countDistinct("raw").alias("n_raw"))


@query("""SELECT 'nation/' || n_nationkey || '.md' AS path, ((3 - n_nationkey + 25) % 25)::INT AS hops FROM nation WHERE n_nationkey <> 3
UNION ALL SELECT 'customer/' || c_custkey || '.md', ((3 - c_nationkey + 25) % 25 + 1)::INT FROM customer""")
def backrefs_cycle(spark, d):
    """Nations link in a ring, customers to their nation: the search ends although links never do."""
    ring = a.entity_links(spark, d).where(F.col("source").startswith("customer/")).unionByName(a.nation_ring(spark, d))
    return graph.transitive_backrefs(ring, a.entity_files(spark, d), "nation/3.md").select("path", "hops")


@query(_GRAPH + " SELECT path FROM files f WHERE NOT EXISTS (SELECT 1 FROM links l JOIN files g ON g.path = l.target WHERE l.source = f.path AND g.path <> f.path)")
def no_refs(spark, d):
    return graph.no_refs(a.entity_files(spark, d), a.entity_links(spark, d)).select("path")


@query(_GRAPH + " SELECT path FROM files f WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.target = f.path AND l.source <> f.path)")
def no_backrefs(spark, d):
    return graph.no_backrefs(a.entity_files(spark, d), a.entity_links(spark, d)).select("path")


@query(_GRAPH + " SELECT path FROM files f WHERE kind = 'markdown' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.target = f.path AND l.source <> f.path AND l.kind = 'body' AND starts_with(l.source, 'supplier/'))")
def find_no_backrefs_from(spark, d):
    options = finding.FindOptions(kind="markdown", no_backrefs=True, sources=["supplier/**"], link_kind="body")
    return finding.find(a.entity_files(spark, d), a.entity_links(spark, d), options).select("path")


@query(_GRAPH + " SELECT path FROM files f WHERE EXISTS (SELECT 1 FROM links l WHERE l.source = f.path)")
def link_sources(spark, d):
    return graph.link_sources(a.entity_files(spark, d), a.entity_links(spark, d)).select("path")


@query("""WITH x AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^https?:', '') FROM pages UNION ALL SELECT page_id, '#' || page_id FROM pages UNION ALL SELECT page_id, 'a/../b/' || page_id || '.md?x=1' FROM pages)
SELECT page_id, url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]+:') OR starts_with(url, '//') THEN 'url' WHEN regexp_replace(url, '(?s)[#?].*', '') = '' THEN 'anchor' ELSE 'path' END AS type FROM x""")
def link_classify(spark, d):
    p = a.read(spark, d, "pages").select("page_id", "url")
    n = F.col("page_id").cast("string")
    df = p.unionByName(p.withColumn("url", F.regexp_replace("url", "^https?:", ""))).unionByName(p.withColumn("url", F.concat(F.lit("#"), n))).unionByName(p.withColumn("url", F.concat(F.lit("a/../b/"), n, F.lit(".md?x=1"))))
    return df.select("page_id", "url", classify(F.col("url")).alias("type"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'orders/' || o_custkey || '.md' WHEN 1 THEN 'x/' || o_custkey || '.md' WHEN 2 THEN 'orders/deep/c/' || o_custkey || '.md' END AS target FROM orders""")
def path_resolve(spark, d):
    n = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("../"), n, F.lit(".md#top"))).when(k == 1, F.concat(F.lit("/x/./"), n, F.lit(".md?v=2"))).when(k == 2, F.concat(F.lit("b/../c//"), n, F.lit(".md"))).otherwise(F.concat(F.lit("../../../"), n, F.lit(".md")))
    return a.read(spark, d, "orders").select("o_orderkey", resolve(raw, F.lit("orders/deep")).alias("target"))


@query("SELECT 'src/' || source || '/' || lang || '/' || doc_id AS path, ['src', 'src/' || source, 'src/' || source || '/' || lang][i] AS folder FROM documents, (SELECT unnest([1, 2, 3]) AS i)")
def ancestor_folders(spark, d):
    p = F.concat_ws("/", F.lit("src"), "source", "lang", F.col("doc_id").cast("string"))
    return a.read(spark, d, "documents").select(p.alias("path")).select("path", F.explode(ancestors(F.col("path"))).alias("folder"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS body FROM documents")
def searchable_text(spark, d):
    return a.read(spark, d, "documents").select("doc_id", searchable(F.col("text")).alias("body"))


@query("SELECT doc_id, nfc_normalize(text) = text AS composed FROM documents WHERE text IS NOT NULL")
def nfd_round_trip(spark, d):
    """Decomposed text is canonically equal to its source: composing it again gives the source exactly if that is composed."""

    @F.pandas_udf("boolean")
    def back(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([unicodedata.normalize("NFC", p) == q for p, q in zip(x, y)])

    return a.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", back(nfd("text"), "text").alias("composed"))


# Search, with the unstemmed tokenizer that SQL can follow.
_TOKENS = """WITH docs AS (SELECT 'documents/' || source || '/' || doc_id || '.md' AS path, source AS title, lang AS description, text AS body FROM documents),
cols AS (SELECT path, c, list_filter(regexp_split_to_array(lower(coalesce(s, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS toks FROM (
 SELECT path, 10 AS c, title AS s FROM docs UNION ALL SELECT path, 7, description FROM docs UNION ALL SELECT path, 5, path FROM docs UNION ALL SELECT path, 1, body FROM docs)),
lens AS (SELECT path, sum(len(toks)) AS len FROM cols GROUP BY path)"""


def _hits(k: int, phrase: list[str]) -> str:
    same = " AND ".join(f"toks[i + {j}] = '{w}'" for j, w in enumerate(phrase))
    return f"f{k} AS (SELECT path, sum(c * len(list_filter(range(1, len(toks) + 1), lambda i: {same}))) AS f FROM cols GROUP BY path)"


def _bm25(phrases: list[list[str]]) -> str:
    parts = ", ".join(_hits(k, p) for k, p in enumerate(phrases))
    score = " + ".join(f"(SELECT CASE WHEN ln((n - m + 0.5) / (m + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - m + 0.5) / (m + 0.5)) END FROM (SELECT count(*) AS n, count(*) FILTER (f > 0) AS m FROM f{k})) * f{k}.f * 2.2 / (f{k}.f + 1.2 * (0.25 + 0.75 * lens.len / (SELECT avg(len) FROM lens)))" for k in range(len(phrases)))
    joins = " ".join(f"JOIN f{k} USING (path)" for k in range(len(phrases)))
    met = " AND ".join(f"f{k}.f > 0" for k in range(len(phrases)))
    return f"{_TOKENS}, {parts}, scored AS (SELECT path, round(-({score}), 6) AS score FROM lens {joins} WHERE {met})"


_INDEXES: dict[tuple, SearchIndex] = {}


def search_index(spark: SparkSession, d: str, tokenizer: str) -> SearchIndex:
    """The index of all documents, built on shared storage by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, d, tokenizer)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(a.document_pages(spark, d), shared_dir(spark, "search"), tokenizer)
    return _INDEXES[key]


@query(_TOKENS + " SELECT token, count(DISTINCT path) AS n_pages, count(*) AS n FROM (SELECT path, unnest(toks) AS token FROM cols) GROUP BY token")
def search_postings(spark, d):
    """What the index holds: of every token its pages and places."""
    return search_index(spark, d, "plain").postings.groupBy("token").agg(F.sum("n_pages").alias("n_pages"), F.sum("n").alias("n"))


@query(_bm25([["the"], ["of"]]) + " SELECT path FROM scored")
def search_all_words(spark, d):
    return search_index(spark, d, "plain").search("The of").select("path")


@query(_bm25([["of", "the"]]) + " SELECT path FROM scored")
def search_phrase(spark, d):
    return search_index(spark, d, "plain").search('"of   the"').select("path")


@query(_bm25([["src3"], ["en"]]) + " SELECT path, score FROM scored")
def search_scores(spark, d):
    return search_index(spark, d, "plain").search("src3 en").select("path", F.round("score", 6).alias("score"))


@query(_bm25([["with"], ["and", "the"]]) + " SELECT path, score FROM scored ORDER BY score, path LIMIT 20")
def bm25_topk(spark, d):
    return top(search_index(spark, d, "plain").search('with "and the"').select("path", F.round("score", 6).alias("score")))


@query("""WITH docs AS (SELECT 'documents/' || source || '/' || doc_id || '.md' AS path, source, lang, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS body FROM documents)
SELECT path FROM docs WHERE contains(lower(body), 'h the') OR contains(lower(coalesce(source, '')), 'h the') OR contains(lower(coalesce(lang, '')), 'h the') OR contains(lower(path), 'h the')""")
def search_substring(spark, d):
    """Under trigrams a phrase is a substring of any column, across words as well; its white space is collapsed."""
    return search_index(spark, d, "trigram").search('"H  the"').select("path")


@query()
def search_porter(spark, d):
    """Stemmed and diacritic-folded tokens (not expressible in SQL; tested against SQLite's own index)."""
    return top(search_index(spark, d, "porter").search("thing"))


# Lint.
@query("SELECT o_orderkey, 'status ''' || o_orderstatus || ''' is not draft, stable or deprecated' AS message FROM orders WHERE o_orderstatus NOT IN ('draft', 'stable', 'deprecated')")
def lint_status(spark, d):
    o = a.read(spark, d, "orders").withColumn("message", okf.status_message(F.col("o_orderstatus")))
    return o.where("message IS NOT NULL").select("o_orderkey", "message")


#: By order key modulo 12: lines of the frontmatter of a concept page, and the rule and message that they give.
_CONCEPTS = [
    ("type: note", None, None),
    ("title: x", "okf-type", "its frontmatter has no type"),
    ("type: ''", "okf-type", "type is empty"),
    ("type: note\nstatus: [odd]", "okf-status", "status is not draft, stable or deprecated"),
    ("type: note\nstatus: odd", "okf-status", "status 'odd' is not draft, stable or deprecated"),
    ("type: note\nusage_window: {from: 2026-01-01, to: '2026-01-01T10:00:00Z'}", "okf-timestamp", "usage_window.from '2026-01-01' is not an ISO 8601 datetime with a UTC offset"),
    ("type: note\nsources:\n- {resource: x, usage_window: {start: never, to: '2026-01-01T10:00:00'}}", "okf-timestamp", "sources[].usage_window.to '2026-01-01T10:00:00' has no UTC offset"),
    ("type: note\ngenerated: {at: '2026-01-01T10:00:00Z'}", "okf-actor", "generated has no by"),
    ("type: note\nverified: {by: me}", "okf-actor", "verified[].by 'me' is not <producer>/<version>, human:<id> or process:<id>"),
    ("type: note\nsources:\n- {id: a}", "okf-source-resource", "sources entry has no resource"),
    ("type: note\nsources:\n- {id: a, resource: x}", "okf-footnote", "footnote [^q] matches no sources[].id"),
    ("type: note\nstale_after: 2026-02-30T10:00:00Z", "okf-timestamp", "stale_after '2026-02-30T10:00:00Z' is not an ISO 8601 datetime with a UTC offset"),
]


@query("SELECT o_orderkey, " + ", ".join("CASE o_orderkey % 12 " + " ".join(f"WHEN {k} THEN '{row[at].replace(chr(39), chr(39) * 2)}'" for k, row in enumerate(_CONCEPTS) if row[at]) + f" END AS {name}" for at, name in ((1, "rule"), (2, "message"))) + " FROM orders WHERE o_orderkey % 12 <> 0")
def lint_concepts(spark, d):
    """The checks of concept pages, run by the page parser: one page an order."""
    settings = pages.Settings(("kb",), ("kb",))
    fronts = [front for front, _, _ in _CONCEPTS]

    def findings(batches):
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                note = "see[^q]\n\n[^q]: where" if key % 12 == 10 else "text"
                found = pages.parse(f"kb/{key}.md", f"---\n{fronts[key % 12]}\n---\n{note}\n", settings).findings
                out += [(key, rule, message) for rule, _, message in found]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["o_orderkey", "rule", "message"])

    # A table in few row groups would keep few cores busy; its keys alone are cheap to deal out.
    orders = a.read(spark, d, "orders").select("o_orderkey")
    orders = orders.repartition(max(orders.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    return orders.mapInArrow(findings, "o_orderkey long, rule string, message string")


@query("""WITH p AS (SELECT doc_id, 'notes/' || source || '/' || doc_id || '.md' AS source, source AS s, lang FROM documents)
SELECT source, 2 AS line, 'frontmatter' AS kind, 'path' AS type, 'notes/' || s || '/' || lang || '.md' AS target, NULL AS text FROM p UNION ALL
SELECT source, 6, 'body', 'path', 'notes/' || s || '/' || (doc_id + 1) || '.md', 'next * one' FROM p UNION ALL
SELECT source, 6, 'body', 'path', 'i/a b.png', 'img' FROM p UNION ALL
SELECT source, 7, 'body', 'url', NULL, 'https://x.org/' || doc_id FROM p UNION ALL
SELECT source, 7, 'body', 'path', NULL, 'out' FROM p UNION ALL
SELECT source, 7, 'body', 'anchor', NULL, 'top' FROM p UNION ALL
SELECT source, 14, 'body', 'path', 'notes/' || s || '/ref.md', 'by name' FROM p""")
def page_parse_links(spark, d):
    """Links of one page a document as the page parser finds them; those in HTML blocks, comments and code are none."""
    body = "# T\n[next \\* *one*]({next}.md 't') ![img](/i/a%20b.png)\n<https://x.org/{id}> [out](../../../x.md) [top](#t) `[c](c.md)`\n\n<div>\n[no](no.md)\n</div>\n\n<!-- [no](no.md) -->\n[by *name*][Ref]\n\n[ref]: ref.md\n"
    text = F.concat(F.lit("---\nsee: "), F.col("lang"), F.lit(".md\n---\n\n"), F.replace(F.replace(F.lit(body), F.lit("{next}"), (F.col("doc_id") + 1).cast("string")), F.lit("{id}"), F.col("doc_id").cast("string")))
    path = F.concat(F.lit("notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    df = a.read(spark, d, "documents").select(path.alias("path"), text.alias("text"))
    return page_links(df, pages.Settings(fields=(("see", "page"),))).select("source", "line", "kind", "type", "target", "text")


@query("SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def lint_timestamp(spark, d):
    k = F.col("event_id") % 3
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(t, F.lit("+02:00"))).when(k == 1, t).otherwise(F.concat(F.lit("2024-02-30"), F.substring(t, 11, 9), F.lit("Z")))
    return a.read(spark, d, "events").select("event_id", okf.is_datetime(text).alias("ok"))


@query("SELECT event_id, event_id % 3 <> 2 AS ok FROM events")
def lint_actor(spark, d):
    k = F.col("event_id") % 3
    user = F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("human:"), user)).when(k == 1, F.concat(F.lit("tool/"), user)).otherwise(F.concat(F.lit("robot:"), user))
    return a.read(spark, d, "events").select("event_id", okf.is_actor(text).alias("ok"))


def _entries(spark, d) -> DataFrame:
    """Index entries of regions for their nations and one that is not there, described by key."""
    n = a.read(spark, d, "nation")
    path, target = F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"), F.lit(".md")), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".md"))
    said = F.when(F.col("n_nationkey") % 5 == 0, F.lit("other")).when(F.col("n_nationkey") % 5 == 1, F.lit(None)).otherwise(F.col("n_name"))
    own = n.select(path.alias("path"), F.col("n_nationkey").cast("int").alias("ord"), F.lit(1).alias("line"), target.alias("target"), said.alias("description"))
    lost = n.select(path.alias("path"), (F.col("n_nationkey") + 1000).cast("int").alias("ord"), F.lit(2).alias("line"), F.concat(F.lit("lost/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("target"), F.lit(None).cast("string").alias("description"))
    return own.unionByName(lost).withColumn("target_nfd", F.col("target"))


@query("""SELECT 'region/' || n_regionkey || '.md' AS path, 'entry for nation/' || n_nationkey || '.md' || CASE n_nationkey % 5 WHEN 0 THEN ' does not match the page''s description ''' || n_name || '''' ELSE ' has no description; the page''s is ''' || n_name || '''' END AS message FROM nation WHERE n_nationkey % 5 < 2
UNION ALL SELECT 'region/' || n_regionkey || '.md', 'entry links to lost/' || n_nationkey || '.md, which does not exist' FROM nation""")
def index_sync(spark, d):
    docs = a.read(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), F.col("n_name").alias("description"))
    return lint.index_entries(_entries(spark, d), a.entity_files(spark, d), docs).select("path", "message")


@query("""SELECT 'documents/' || source || '/' || doc_id || '.md' AS path, 'no index above it links to it: documents/' || source || '/index.md' AS message FROM documents WHERE doc_id % 3 <> 0""")
def index_unlisted(spark, d):
    """Every source folder has an index that links to every third document."""
    files = a.document_files(spark, d).select("path", "path_nfd", "kind", "parse_error")
    index = F.concat(folder_of(F.col("path")), F.lit("/index.md"))
    indexes = files.select(index.alias("path")).distinct().select("path", F.col("path").alias("path_nfd"), F.lit("markdown").alias("kind"), F.lit(None).cast("string").alias("parse_error"))
    links = files.where(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 3 == 0).select(index.alias("source"), F.col("path_nfd").alias("target_nfd"))
    return lint.unlisted(files.unionByName(indexes), links, ["documents"]).select("path", "message")


@query("SELECT 'region/' || n_regionkey || '.md' AS path, 'nation/' || n_nationkey || '.md' AS file_path FROM nation")
def lookup_exact_first(spark, d):
    """Of canonically equal files that of the same spelling is taken: every target also has a twin that sorts before it."""
    files = a.entity_files(spark, d)
    twins = files.withColumn("path", F.concat(F.lit("A-twin-"), F.col("path")))
    entries = _entries(spark, d).where("line = 1")
    return lint.lookup_exact_first(entries, files.unionByName(twins)).select("path", "file_path")


@query(_ORDERS + """ SELECT source AS path, 'broken-link' AS rule, raw || ' -> ' || coalesce(target, 'outside the workspace') AS message FROM lost WHERE NOT starts_with(source, 'orders/1')
UNION ALL SELECT 'nation/' || n_nationkey || '.md', 'okf-type', 'it has no frontmatter' FROM nation WHERE n_nationkey >= 10""")
def lint_merged(spark, d):
    """Stored and worked findings in one report; broken links are off below ``orders/1*``, all is off for some nations."""
    path = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".md"))
    none = F.array().cast("array<string>")
    stored = a.read(spark, d, "nation").select(path.alias("path"), F.lit("okf-type").alias("rule"), F.lit(None).cast("int").alias("line"), F.lit("it has no frontmatter").alias("message"), none.alias("related"), F.lit(0).alias("ord"))
    off = [(("broken-*",), ("orders/1*",)), ((), ("nation/?.md",))]
    return lint.merged(stored, [lint.broken_links(a.order_links(spark, d), a.entity_files(spark, d))], off).select("path", "rule", "message")


@query(_ORDERS + " SELECT source AS path, raw || ' -> ' || coalesce(target, 'outside the workspace') AS message FROM lost WHERE NOT starts_with(source, 'orders/2')")
def lint_named_rule(spark, d):
    """A rule that is named is checked although it is off; what is off for whole folders stays off."""
    off = [(("broken-link",), ()), ((), ("orders/2*",)), (("okf-*",), ("orders",))]
    links = lint.broken_links(a.order_links(spark, d), a.entity_files(spark, d))
    return lint.merged(links.limit(0), [links], off, ["broken-*"]).select("path", "message")


# Incremental ingest, over a workspace on disk with one page a document.
_NOTE = """'---\nlang: ' || lang || '\n---\n' || coalesce(text, '')"""


def _workspace(spark, d, keep: str, changed: str = "false", root: str | None = None) -> str:
    """Write (or bring up to date) one page a document that is kept, on storage that all share."""
    root = root or shared_dir(spark, "notes").removeprefix("file://")
    text = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n"), F.coalesce("text", F.lit("")), F.when(F.expr(changed), "\nmore").otherwise(""))
    rows = a.read(spark, d, "documents").select(F.concat(F.lit("n/"), F.col("doc_id") % 50, F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("path"), text.cast("binary").alias("text"), F.expr(keep).alias("keep"))

    def put(batches):
        for batch in batches:
            for path, data, stays in zip(*(c.to_pylist() for c in batch.columns)):
                at = Path(root, path)
                if not stays:
                    at.unlink(missing_ok=True)
                elif not at.exists() or at.read_bytes() != data:
                    at.parent.mkdir(parents=True, exist_ok=True)
                    at.write_bytes(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    if not Path(root, ".foliograph").exists():
        Workspace.init(root)
    return root


@query(f"SELECT 'n/' || (doc_id % 50) || '/' || doc_id || '.md' AS path, sha256({_NOTE}) AS hash, octet_length(encode({_NOTE}))::BIGINT AS size, '{{\"lang\": \"' || lang || '\"}}' AS frontmatter FROM documents")
def ingest_files(spark, d):
    """Every document written as a page, swept in, and read from the index."""
    index = Index(spark, Workspace.discover(_workspace(spark, d, "true")), shared_dir(spark, "index"))
    index.sweep()
    return index.table("files").where("path LIKE 'n/%'").select("path", "hash", "size", "frontmatter")


@query("""SELECT count(*) FILTER (doc_id % 11 <> 0) AS files, count(*) FILTER (doc_id % 7 = 0 AND doc_id % 11 <> 0) AS added,
 count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0) AS updated, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 = 0) AS removed,
 count(*) FILTER (doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0)) AS hashed, 0::BIGINT AS unreadable FROM documents""")
def sweep_diff(spark, d):
    """Two sweeps of a folder, between which pages come, go and change; the counts of the second one."""
    root = _workspace(spark, d, "doc_id % 7 <> 0")
    index = Index(spark, Workspace.discover(root), shared_dir(spark, "index"))
    index.sweep(now=4e9)
    _workspace(spark, d, "doc_id % 11 <> 0", "doc_id % 5 = 0", root)
    counts = index.sweep(now=4e9)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))

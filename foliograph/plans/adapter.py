"""Tables seen as a workspace: every row a file, foreign keys and hrefs its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import classify, folder_of, resolve

LINK_COLUMNS = ("source", "ord", "line", "kind", "type", "raw", "target", "target_nfd", "text")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(folder: str, key: Column, ending: str = ".md") -> Column:
    """The path of a row: its key as a file of a folder."""
    return F.concat(F.lit(f"{folder}/"), key.cast("string"), F.lit(ending))


def _none() -> Column:
    return F.lit(None).cast("string")


def _as_files(df: DataFrame, path: Column, frontmatter: Column, kind: str = "markdown") -> DataFrame:
    columns = (path.alias("path"), path.alias("path_nfd"), F.lit(kind).alias("kind"), frontmatter.alias("frontmatter"))
    return df.select(*columns, _none().alias("parse_error"))


def _files(df: DataFrame, folder: str, key: str, *columns) -> DataFrame:
    return _as_files(df, at(folder, F.col(key)), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as pages, embeddings as other files."""
    named = lambda prefix, *more: [F.col(f"{prefix}_{c}").alias(name) for c, name in (("name", "name"), *more)]
    r = lambda n: read(spark, sf_dir, n)
    out = _files(r("region"), "region", "r_regionkey", *named("r"))
    out = out.unionByName(_files(r("nation"), "nation", "n_nationkey", *named("n", ("regionkey", "region"))))
    out = out.unionByName(_files(r("customer"), "customer", "c_custkey", *named("c", ("acctbal", "balance"), ("mktsegment", "segment"))))
    out = out.unionByName(_files(r("supplier"), "supplier", "s_suppkey", *named("s", ("acctbal", "balance"))))
    return out.unionByName(_as_files(r("embeddings"), at("embeddings", F.col("vec_id"), ".bin"), _none(), "other"))


def _fk(df: DataFrame, folder: str, key: str, target: str, fk: str, kind: str = "frontmatter") -> DataFrame:
    goal = at(target, F.col(fk))
    return _linked(df, at(folder, F.col(key)), F.concat(F.lit("/"), goal), goal, kind, 2)


def _linked(df: DataFrame, source: Column, raw: Column, target: Column, kind: str, line: int, text: str | None = None) -> DataFrame:
    """Path links from every row."""
    first = (source.alias("source"), F.lit(0).alias("ord"), F.lit(line).alias("line"), F.lit(kind).alias("kind"), F.lit("path").alias("type"))
    return df.select(*first, raw.alias("raw"), target.alias("target"), target.alias("target_nfd"), F.lit(text).cast("string").alias("text"))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region and supplier -> nation in frontmatter, region -> its folder of nations in the body."""
    r = lambda n: read(spark, sf_dir, n)
    out = _fk(r("nation"), "nation", "n_nationkey", "region", "n_regionkey")
    out = out.unionByName(_fk(r("customer"), "customer", "c_custkey", "nation", "c_nationkey"))
    out = out.unionByName(_fk(r("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", kind="body"))
    return out.unionByName(_linked(r("region"), at("region", F.col("r_regionkey")), F.lit("../nation"), F.lit("nation"), "body", 4))


def _turn(turn: Column) -> Column:
    return F.concat_ws("/", F.lit("conversations"), F.col("conv_id").cast("string"), F.concat(turn.cast("string"), F.lit(".md")))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_files(read(spark, sf_dir, "conversations"), _turn(F.col("turn")), F.to_json(F.struct("role", "turn")))


def conversation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn but the first links to the one before it."""
    c = read(spark, sf_dir, "conversations").where("turn > 0")
    before = F.col("turn") - 1
    return _linked(c, _turn(F.col("turn")), F.concat(before.cast("string"), F.lit(".md")), _turn(before), "body", 1, "prev")


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link an order: to its customer, or by key to a missing one, a folder, a URL, out of the workspace or an anchor."""
    k, c = F.col("o_orderkey") % 10, F.col("o_custkey").cast("string")
    missing = F.concat(F.lit("../customer/"), (F.col("o_custkey") + 1_000_000_000).cast("string"), F.lit(".md"))
    raw = (
        F.when(k == 0, missing)
        .when(k == 1, "../nation")
        .when(k == 2, F.concat(F.lit("https://x.org/"), c))
        .when(k == 3, F.concat(F.lit("../../"), c, F.lit(".md")))
        .when(k == 4, F.concat(F.lit("#"), c))
        .otherwise(F.concat(F.lit("/customer/"), c, F.lit(".md")))
    )
    target = F.when(classify(raw) == "path", resolve(raw, F.lit("orders")))
    out = _linked(read(spark, sf_dir, "orders"), at("orders", F.col("o_orderkey")), raw, target, "body", 1)
    return out.withColumn("type", classify(F.col("raw")))


def nation_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation links to the next one, the last to the first."""
    goal = at("nation", (F.col("n_nationkey") + 1) % 25)
    return _linked(read(spark, sf_dir, "nation"), at("nation", F.col("n_nationkey")), F.concat(F.lit("/"), goal), goal, "body", 1)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(read(spark, sf_dir, "pages"), "pages", "page_id", "url")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hrefs of web pages as body links, in order."""
    hrefs = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "raw")
    found = read(spark, sf_dir, "pages").select(at("pages", F.col("page_id")).alias("source"), hrefs)
    found = found.withColumn("type", classify(F.col("raw")))
    found = found.withColumn("target", F.when(F.col("type") == "path", resolve(F.col("raw"), folder_of(F.col("source")))))
    fixed = {"line": F.lit(1), "kind": F.lit("body"), "target_nfd": F.col("target"), "text": _none()}
    return found.withColumns(fixed).select(*LINK_COLUMNS)


def document_path() -> Column:
    return F.concat_ws("/", F.lit("documents"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with their labels; a document without labels lacks those fields."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    tags = F.array(F.col("lang"), F.col("source")).alias("tags")
    fields = F.to_json(F.struct("doc_id", "lang", "n_chars", "quality", "toxic", tags))
    return _as_files(docs.join(read(spark, sf_dir, "labels"), "doc_id", "left"), document_path(), fields)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for the search: title the source, description the language, body the text."""
    columns = (F.col("source").alias("title"), F.col("lang").alias("description"), F.col("text").alias("body"))
    return read(spark, sf_dir, "documents").select(document_path().alias("path"), *columns)

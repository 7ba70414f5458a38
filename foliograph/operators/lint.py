"""Lint rules over the stored tables: suppression, worked rules (joins) and the merged report."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, covered, folder_of
from . import links as graph

# The names of the rules, and in the functions below their messages.
STORED = (
    "okf-type", "okf-index-frontmatter", "okf-log-date", "okf-source-resource", "okf-footnote", "okf-timestamp", "okf-actor", "okf-status",
    "okf-version",
)
WORKED = ("okf-index", "broken-link", "frontmatter-syntax")
RULES = STORED + WORKED
COLUMNS = ("path", "rule", "line", "message", "related", "ord")

def match_rules(patterns: list[str] | None, rules=RULES) -> list[str]:
    """The rules that patterns (``*`` for any text) name, all without patterns. Every pattern has to name one."""
    if not patterns:
        return list(rules)
    named: set[str] = set()
    for pattern in patterns:
        own = re.compile(".*".join(re.escape(piece) for piece in pattern.split("*")))
        found = {r for r in rules if own.fullmatch(r)}
        if not found:
            raise ValueError(f"no rule matches {pattern}")
        named |= found
    return [r for r in rules if r in named]


def suppressed(rule: Column, path_nfd: Column, off, named: bool = False) -> Column:
    """Whether an entry of ``lint.off`` (rules, globs; none of either means all) covers a finding.

    A glob that matches a folder covers all that is below it. Where the rules to check are ``named``, entries with rules do
    not count: who asks for a rule gets it.
    """
    tests = []
    for rules, globs in off:
        if named and rules:
            continue
        test = rule.isin(*match_rules(list(rules))) if rules else F.lit(True)
        if globs:
            test = test & covered(path_nfd, list(globs))
        tests.append(test)
    return reduce(lambda x, y: x | y, tests) if tests else F.lit(False)


def _finding(rule: str, message: Column) -> tuple[Column, ...]:
    """The columns of a finding on no line and with no related file."""
    none = F.array().cast("array<string>")
    return (
        F.lit(rule).alias("rule"),
        F.lit(None).cast("int").alias("line"),
        message.alias("message"),
        none.alias("related"),
        F.lit(0).alias("ord"),
    )


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    lost = graph.broken(links, files)
    message = F.concat(F.col("raw"), F.lit(" -> "), F.coalesce("target", F.lit("outside the workspace")))
    related = F.when(F.col("target").isNull(), F.array().cast("array<string>")).otherwise(F.array("target"))
    return lost.select(F.col("source").alias("path"), F.lit("broken-link").alias("rule"), "line", message.alias("message"), related.alias("related"), "ord")


def frontmatter_syntax(files: DataFrame) -> DataFrame:
    bad = files.where("parse_error IS NOT NULL")
    return bad.select("path", *_finding("frontmatter-syntax", F.col("parse_error")))


def lookup_exact_first(entries: DataFrame, files: DataFrame, target: str = "target", target_nfd: str = "target_nfd") -> DataFrame:
    """Each entry's file: that of the same spelling if there is one, else the first of the canonically equal ones."""
    named = {"path": "file_path", "path_nfd": target_nfd, "kind": "file_kind", "parse_error": "file_error"}
    found = entries.join(files.select(*(F.col(c).alias(name) for c, name in named.items())), target_nfd, "left")
    order = Window.partitionBy("path", "ord").orderBy((F.col("file_path") == F.col(target)).desc_nulls_last(), "file_path")
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def index_entries(entries: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """Index entries whose file is missing or whose description is not the page's."""
    placed = lookup_exact_first(entries, files)
    dirs = graph.folders(files).withColumnRenamed("folder_nfd", "target_nfd").withColumn("__folder", F.lit(True))
    placed = placed.join(dirs, "target_nfd", "left").join(docs.select(F.col("path").alias("file_path"), F.col("description").alias("page_text")), "file_path", "left")
    name = F.regexp_extract("target", r"[^/]*\z", 0)
    compared = (F.col("file_kind") == "markdown") & F.col("file_error").isNull() & ~name.isin("index.md", "log.md")
    mine, page, t = F.col("description"), F.when(F.col("page_text") != "", F.col("page_text")), F.col("target")
    missing = F.col("file_path").isNull() & F.col("__folder").isNull() & (F.col("target_nfd") != "")
    message = (
        F.when(missing, F.concat(F.lit("entry links to "), t, F.lit(", which does not exist")))
        .when(compared & mine.isNull() & page.isNotNull(), F.concat(F.lit("entry for "), t, F.lit(" has no description; the page's is '"), page, F.lit("'")))
        .when(compared & mine.isNotNull() & page.isNull(), F.concat(F.lit("entry for "), t, F.lit(" has a description, but the page has none")))
        .when(compared & (mine != page), F.concat(F.lit("entry for "), t, F.lit(" does not match the page's description '"), page, F.lit("'")))
    )
    return placed.select("path", F.lit("okf-index").alias("rule"), "line", message.alias("message"), F.array("target").alias("related"), "ord").where("message IS NOT NULL")


def unlisted(files: DataFrame, links: DataFrame, bundles: list[str]) -> DataFrame:
    """Pages of OKF bundles that no ``index.md`` above them, up to the bundle's root, links to."""
    if not bundles:
        return files.select("path", *_finding("okf-index", F.lit(""))).where(F.lit(False))
    root = F.lit("")
    for b in sorted(bundles, key=len):
        root = F.when(F.col("path").startswith(b + "/"), F.lit(b)).otherwise(root)
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    pages = files.where((F.col("kind") == "markdown") & ~name.isin("index.md", "log.md")).withColumn("__root", root).where("__root <> ''")
    above = F.filter(ancestors(F.col("path")), lambda f: F.length(f) >= F.length("__root"))
    pairs = pages.select("path", "path_nfd", F.explode(above).alias("__folder"))
    indexes = files.where(F.col("path").endswith("/index.md")).select(F.col("path").alias("index_path"), folder_of(F.col("path")).alias("__folder"))
    covered = pairs.join(indexes, "__folder")
    listed = covered.join(links.select(F.col("source").alias("index_path"), F.col("target_nfd").alias("path_nfd")).distinct(), ["index_path", "path_nfd"], "left_semi").select("path").distinct()
    rest = covered.join(listed, "path", "left_anti").groupBy("path").agg(F.expr("transform(array_sort(collect_list(struct(-length(index_path) AS depth, index_path))), x -> x.index_path)").alias("related"))
    message = F.concat(F.lit("no index above it links to it: "), F.array_join("related", ", "))
    return rest.select("path", F.lit("okf-index").alias("rule"), F.lit(None).cast("int").alias("line"), message.alias("message"), "related", F.lit(0).alias("ord"))


def merged(stored: DataFrame, worked: list[DataFrame], off=(), rules: list[str] | None = None) -> DataFrame:
    """All findings of the wanted rules that are not turned off, by path, line (none first) and rule group."""
    from ..functions.paths import nfd

    wanted = match_rules(rules)
    out = stored.select(*COLUMNS).withColumn("__group", F.lit(0))
    for k, df in enumerate(worked, 1):
        out = out.unionByName(df.select(*COLUMNS).withColumn("__group", F.lit(k)))
    out = out.where(F.col("rule").isin(*wanted))
    if off:
        out = out.where(~suppressed(F.col("rule"), nfd("path"), off, named=bool(rules)))
    return out.orderBy("path", F.coalesce("line", F.lit(0)), "__group", "ord").select("path", "rule", "line", "message", "related")

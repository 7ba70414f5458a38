"""The link graph: typed references, back references, transitive ones, broken links and the anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, nfd_text
from ..storage import Folder, shared_dir


def folders(files: DataFrame) -> DataFrame:
    """All folders that hold a file: the distinct ancestors of the paths (one row per folder, folded map-side)."""
    return files.select(F.explode(ancestors(F.col("path_nfd"))).alias("folder_nfd")).distinct()


def _target_key() -> Column:
    """What links are joined to files by. A link without a target gets a key of its own that no path can be, so that all
    those links do not meet in one task."""
    own = F.concat(F.lit("\0"), F.xxhash64("source", "ord", "line").cast("string"))
    return F.coalesce(F.when(F.col("type") == "path", F.col("target_nfd")), own)


def typed(links: DataFrame, files: DataFrame) -> DataFrame:
    """``target_type`` of every path link: file, directory or missing. Two equi-joins instead of a prefix range join, on the
    same key, so links are dealt out once."""
    known = files.select(F.col("path_nfd").alias("__key")).distinct().withColumn("__file", F.lit(True))
    dirs = folders(files).select(F.col("folder_nfd").alias("__key"), F.lit(True).alias("__folder"))
    out = links.withColumn("__key", _target_key()).join(known, "__key", "left").join(dirs, "__key", "left")
    root = F.coalesce(F.col("target_nfd") == "", F.lit(False))
    kind = F.when(F.col("__file"), "file").when(root | F.col("__folder"), "directory").otherwise("missing")
    return out.select(*links.columns, F.when(F.col("type") == "path", kind).alias("target_type"))


def refs(links: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Links of one page, in order."""
    return typed(links.where(F.col("source") == path), files).orderBy("line", "ord")


def link_filter(links: DataFrame, link_kind: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Only links of a kind, and only from the paths in ``sources``."""
    out = links if link_kind is None else links.where(F.col("kind") == link_kind)
    return out if sources is None else out.join(sources.select(F.col("path").alias("source")).distinct(), "source", "left_semi")


def backrefs(links: DataFrame, path: str, link_kind: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    return link_filter(links, link_kind, sources).where(F.col("target_nfd") == nfd_text(path)).orderBy("source", "line", "ord")


def transitive_backrefs(
    links: DataFrame, files: DataFrame, path: str, link_kind: str | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """(path, hops): every file from which links lead to ``path``, with the least number of links; not the start itself.

    One frontier join a hop against what is not yet seen, until a hop finds nothing. The edges are written once, dealt out
    by target; every hop goes to one table on shared storage, so the plan does not grow with the hops.
    """
    spark, start = links.sparkSession, nfd_text(path)
    edges = link_filter(links, link_kind, sources).where("target_nfd IS NOT NULL").select("source", "target_nfd").distinct()
    by_nfd = files.select(F.col("path").alias("source"), F.col("path_nfd").alias("source_nfd"))
    folder = Folder(spark, shared_dir(spark))
    edges = folder.table(edges.join(by_nfd, "source").where(F.col("source_nfd") != start).repartition("target_nfd"), "edges")
    columns, hop = "path string, source_nfd string, hops int", 0
    frontier = spark.createDataFrame([(start,)], "target_nfd string")
    while True:
        hop += 1
        new = edges.join(frontier, "target_nfd", "left_semi").select(F.col("source").alias("path"), "source_nfd").distinct()
        if hop > 1:
            new = new.join(spark.read.schema(columns).parquet(folder.at("seen")).select("path"), "path", "left_anti")
        new = folder.table(new.withColumn("hops", F.lit(hop)), f"seen/hop={hop}")
        if not new.take(1):
            break
        frontier = new.select(F.col("source_nfd").alias("target_nfd")).distinct()
    return spark.read.schema(columns).parquet(folder.at("seen")).select("path", "hops").orderBy("path")


def broken(links: DataFrame, files: DataFrame) -> DataFrame:
    """Path links whose target is neither a file nor a folder, those that leave the workspace included; one scan of them."""
    return typed(links.where(F.col("type") == "path"), files).where("target_type = 'missing'").select(*links.columns)


def no_backrefs(files: DataFrame, links: DataFrame, link_kind: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Files that no other file links to. Of a target's links only the first and the last source matter: if both are the
    file itself, no other has a link to it."""
    named = link_filter(links, link_kind, sources).where("target_nfd IS NOT NULL")
    ends = named.groupBy(F.col("target_nfd").alias("__nfd")).agg(F.min("source").alias("__low"), F.max("source").alias("__high"))
    alone = F.col("__low").isNull() | ((F.col("__low") == F.col("path")) & (F.col("__high") == F.col("path")))
    return files.join(ends, files["path_nfd"] == F.col("__nfd"), "left").where(alone).select(*files.columns)


def no_refs(files: DataFrame, links: DataFrame, link_kind: str | None = None) -> DataFrame:
    """Files without a link to another indexed file."""
    known = files.select(F.col("path").alias("__path"), F.col("path_nfd").alias("target_nfd"))
    named = link_filter(links, link_kind).where("target_nfd IS NOT NULL").join(known, "target_nfd")
    out = named.where(F.col("__path") != F.col("source")).select(F.col("source").alias("path")).distinct()
    return files.join(out, "path", "left_anti")


def link_sources(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files with a link out."""
    return files.join(links.select(F.col("source").alias("path")).distinct(), "path", "left_semi")

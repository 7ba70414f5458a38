"""The engine: one workspace's queries over its index."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import glob_filter, nfd_text
from .operators import find as finding
from .operators import links as graph
from .operators import lint
from .plans.ingest import Index
from .sources.workspace import Workspace


def cache_home() -> Path:
    return Path(os.environ.get("FOLIOGRAPH_CACHE") or Path.home() / ".cache" / "foliograph")


def index_folder(root: Path) -> Path:
    """Where a workspace's index is by default: a folder named by the hash of its root. Give an ``Engine`` a URI to keep the
    index on storage that a cluster shares."""
    return cache_home() / hashlib.sha256(str(root).encode()).hexdigest()


class NotIndexed(ValueError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, workspace: Workspace, folder: str | os.PathLike | None = None):
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster an index needs a folder that the driver and all executors share")
        self.spark, self.workspace = spark, workspace
        self.index = Index(spark, workspace, folder or index_folder(workspace.root))

    @staticmethod
    def open(spark: SparkSession, start: str | os.PathLike, folder: str | os.PathLike | None = None) -> "Engine":
        return Engine(spark, Workspace.discover(start), folder)

    def sweep(self, rebuild: bool = False, now: float | None = None) -> dict:
        return self.index.sweep(rebuild, now)

    @property
    def files(self) -> DataFrame:
        return self.index.table("files")

    @property
    def links(self) -> DataFrame:
        return self.index.table("links")

    def status(self) -> dict:
        return finding.status(self.files).first().asDict() | {"links": self.links.count(), "root": str(self.workspace.root)}

    def find(self, options: finding.FindOptions = finding.FindOptions()) -> tuple[DataFrame, bool]:
        """The kept rows in order, with title (and snippet under a query), and whether the limit left some out.

        With a limit the plan runs once: its rows, one more than the limit at most, are what is decorated.
        """
        indexed = self.index.search_index() if options.query else None
        rows, truncated = finding.find(self.files, self.links, options, indexed), False
        docs = self.index.table("search_docs")
        if options.cap is not None:
            got = rows.collect()
            truncated = len(got) > options.cap
            rows = self.spark.createDataFrame(got[: options.cap], rows.schema)
            docs = docs.where(F.col("path").isin([r["path"] for r in got[: options.cap]]))
        if options.query:
            rows = indexed.with_snippets(rows, options.query)
        else:
            titles = docs.select("path", F.nullif("title", F.lit("")).alias("title"))
            rows = rows.join(titles, "path", "left").withColumn("snippet", F.lit(None).cast("string"))
        return rows.orderBy(*(["score", "path"] if options.query else ["path"])), truncated

    def _known(self, path: str) -> str:
        key = self.workspace.key_of(path)
        got = self.files.where(F.col("path_nfd") == nfd_text(key)).orderBy((F.col("path") == key).desc(), "path").limit(1).collect()
        if not got:
            raise NotIndexed(f"{path} is not indexed")
        return got[0]["path"]

    def show(self, path: str) -> dict:
        key = self._known(path)
        row = self.files.where(F.col("path") == key).first().asDict()
        doc = self.index.table("search_docs").where(F.col("path") == key).first()
        return row | {"title": (doc and doc["title"]) or None}

    def refs(self, path: str) -> DataFrame:
        return graph.refs(self.links, self.files, self._known(path))

    def _sources(self, globs) -> DataFrame | None:
        return self.files.where(glob_filter(F.col("path_nfd"), list(globs))) if globs else None

    def backrefs(self, path: str, link_kind: str | None = None, sources=(), transitive: bool = False) -> DataFrame:
        key = self.workspace.key_of(path)
        if transitive:
            return graph.transitive_backrefs(self.links, self.files, key, link_kind, self._sources(sources))
        return graph.backrefs(self.links, key, link_kind, self._sources(sources))

    def warnings(self) -> list[str]:
        """What ``lint`` warns of: bundles are listed, but none declares its version."""
        if self.workspace.config.bundles and not self.index.meta.get("okf"):
            return ["no bundle in bundles declares okf_version in its root index.md, so there is no OKF bundle to check"]
        return []

    def lint(self, rules: list[str] | None = None) -> DataFrame:
        files, links = self.files, self.links
        okf = self.index.meta.get("okf", [])
        entries = lint.index_entries(self.index.table("index_entries"), files, self.index.table("search_docs"))
        worked = [entries.unionByName(lint.unlisted(files, links, okf)), lint.broken_links(links, files), lint.frontmatter_syntax(files)]
        return lint.merged(self.index.table("findings"), worked, self.workspace.config.off, rules)

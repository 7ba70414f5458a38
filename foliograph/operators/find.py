"""``find``: one lazy plan from options to rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_filter
from ..functions.where import project_field, where
from . import links as graph
from . import search as ranked


class OptionError(ValueError):
    pass


@dataclass(frozen=True)
class FindOptions:
    query: str | None = None
    globs: list[str] = field(default_factory=list)
    kind: str | None = None
    where: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    errors: bool = False
    no_refs: bool = False
    no_backrefs: bool = False
    sources: list[str] = field(default_factory=list)
    link_kind: str | None = None
    limit: int | None = None

    def check(self) -> None:
        if self.sources and not self.no_backrefs:
            raise OptionError("--from needs --no-backrefs")
        if self.link_kind and not (self.no_refs or self.no_backrefs):
            raise OptionError("--link-kind needs --no-refs or --no-backrefs")
        if self.link_kind not in (None, "body", "frontmatter"):
            raise OptionError("--link-kind is body or frontmatter")
        if self.kind not in (None, "markdown", "other"):
            raise OptionError("--kind is markdown or other")
        if self.limit is not None and self.limit < 1:
            raise OptionError("--limit is at least 1")

    @property
    def cap(self) -> int | None:
        return self.limit if self.limit is not None else ranked.DEFAULT_LIMIT if self.query else None


def filters(files: DataFrame, links: DataFrame | None, options: FindOptions) -> DataFrame:
    """All filters as conjuncts; column conditions come first so that they reach the scan."""
    options.check()
    out = files
    if options.globs:
        out = out.where(glob_filter(F.col("path_nfd"), options.globs))
    if options.kind:
        out = out.where(F.col("kind") == options.kind)
    if options.where:
        out = out.where(where(options.where, F.col("frontmatter"), F.col("kind"), F.col("parse_error")))
    if options.errors:
        out = out.where("parse_error IS NOT NULL")
    if options.no_refs:
        # Every link counts, also those of files that other filters leave out: the whole graph is asked.
        out = out.join(graph.no_refs(files, links, options.link_kind).select("path"), "path", "left_semi")
    if options.no_backrefs:
        named = files.where(glob_filter(F.col("path_nfd"), options.sources)) if options.sources else None
        out = out.join(graph.no_backrefs(files, links, options.link_kind, named).select("path"), "path", "left_semi")
    return out


def find(files: DataFrame, links: DataFrame | None, options: FindOptions, indexed: ranked.SearchIndex | None = None) -> DataFrame:
    """The rows a search or listing keeps, one more than the limit at most: the extra row tells that it truncates."""
    kept = filters(files, links, options)
    names = [f.strip() for f in ",".join(options.fields).split(",") if f.strip()]
    shown = [F.when(F.col("parse_error").isNull(), project_field(F.col("frontmatter"), f)).alias(f"field:{f}") for f in dict.fromkeys(names)]
    if options.query:
        # Statistics come from the whole index: filters follow the ranking.
        kept = indexed.search(options.query).join(kept, "path")
        order, cap = ["score", "path"], options.cap
    else:
        order, cap = ["path"], options.cap
    out = kept.select(*kept.columns, *shown).orderBy(*order)
    return out if cap is None else out.limit(cap + 1)


def status(files: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Counts of files, pages, others and parse errors in one pass."""
    is_page = F.col("kind") == "markdown"
    kinds = (F.count("*").alias("files"), F.count_if(is_page).alias("pages"), F.count_if(~is_page).alias("other"))
    return files.agg(*kinds, F.count_if(F.col("parse_error").isNotNull()).alias("errors"))

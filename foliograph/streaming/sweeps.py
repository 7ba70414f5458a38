"""Ingest from a stream of pages: the same parse, keyed by path, applied batch by batch.

Each micro-batch's last text of a path replaces its rows in the versioned tables, as a sweep would.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import nfd_text
from ..sources import page as pages

LINKS = "source string, ord int, line int, kind string, type string, raw string, target string, target_nfd string, text string"


def page_links(df: DataFrame, settings: pages.Settings = pages.Settings()) -> DataFrame:
    """Links of pages given as (path, text); works on streams as on tables."""

    names = [c.split()[0] for c in LINKS.split(", ")]
    schema = pa.schema([(n, pa.int32() if n in ("ord", "line") else pa.string()) for n in names])

    def parse(batches):
        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, x in enumerate(pages.parse(path, text or "", settings).links):
                    rows.append(dict(zip(names, (path, k, *x[:5], nfd_text(x[4]), x[5]))))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select("path", "text").mapInArrow(parse, LINKS)


def replace_latest(current: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with the rows of the batch's keys replaced by the batch's last row of each key."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("__r")).select("__r.*")
    return last if current is None else current.join(last, key, "left_anti").unionByName(last)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start the stream: ``sink`` gets every micro-batch and its number, at least once, so it has to replace by number."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

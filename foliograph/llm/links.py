"""Connected components of a link table, without the links ever meeting on one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stored, work_dir

#: Links contracted together in a worker's memory, and the number of links that one task finishes alone (a fixed bound:
#: more of them go through the rounds).
CHUNK, ONE_TASK = 200_000, 15_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each chunk of links by stars with the same components: (node, smallest node reached in the chunk)."""

    def stars(links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in np.concatenate(links).tolist():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        for at in range(0, len(pairs), 10_000):
            a, b = zip(*pairs[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
        size += batch.num_rows
        if size >= CHUNK:
            yield from stars(held)
            held, size = [], 0
    if size:
        yield from stars(held)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``links`` (long columns a, b) the smallest node that it can reach.

    Chunks of links are contracted in the workers; alternating large and small stars join what the chunks left apart. Every
    round is written to shared storage, so the plan stays short and lost executors cost no recomputation. Loops and
    repeated links are ignored; an empty table gives no rows.
    """
    folder = work_dir(links.sparkSession)
    edges = stored(links.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), "edges0", folder)
    if edges.count() <= ONE_TASK:
        return _with_centres(edges.coalesce(1).mapInArrow(_contract, "a long, b long"), folder)
    for k in range(1, most_rounds):
        edges = stored(edges.distinct().mapInArrow(_contract, "a long, b long").distinct(), f"edges{k}", folder)
        # Settled once every node has one link and no centre has a link of its own.
        linked_twice = edges.groupBy("a").count().where("count > 1").select("a")
        centres = edges.select(F.col("b").alias("a")).distinct()
        if not linked_twice.unionByName(edges.join(centres, "a", "left_semi").select("a")).take(1):
            break
        # A centre may hold most of all links: its row is broadcast, with those of the other large centres.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_by_key(both, stored(least, f"least{k}", folder), ["a"], "n").where("b > a")
        large = stored(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"large{k}", folder)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"low{k}", folder)
        small = join_by_key(large, low, ["a"], "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
    else:
        raise RuntimeError("the components did not settle")
    return _with_centres(edges, folder)


def _with_centres(stars: DataFrame, folder: str) -> DataFrame:
    """(node, component) of settled stars (node, centre)."""
    stars = stored(stars, "stars", folder)
    centres = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))

"""N-gram Jaccard self-join with a count-vector R-tree.

A document is the set of its distinct 4-word shingles. Shingles are hashed into groups, and the number of a set's shingles in
each group makes it a point. Two sets share at most the sum over the groups of the smaller count, so an R-tree whose boxes
know the largest count of every group below them skips all that cannot reach the threshold; surviving pairs are verified on
the texts. Equal sets are one point. Every link between different texts comes out of such a tree.

Points meet by cell, the leading coordinate of the trees. In one fixed order of all shingles, two sets over the threshold
share a shingle among the first ``n - ceil(t * n) + 1`` of each, so every set enters the cells of those. In the cell of their
first common shingle they share no more than what either has from there on (``rest``), and the smaller set has enough left
for a partner of its own size: cells without such a set are dropped. The order puts shingles that are frequent in a sample
last: it decides how large cells get, not which pairs are found. A cell of more than ``TILE`` points is dealt out: its
points are salted into tiles, and every two tiles meet in a group of their own.

So that n similar texts do not cost n * n pairs, the trees are searched in rounds:

1. cells of at most ``SMALL`` points are searched in full; of larger ones every point only meets those in its own leaf, and
   goes on with its best partner and its first one. The verified pairs make components.
2. larger cells that hold points of several components are searched in full; boxes of one component are skipped by its own
   points, and of two components only the best pair of a tree goes on.
3. only if round 2 held pairs back: the same, with every pair of points that are still in different components.

So all links that join classes are found; links between texts that are connected already are not looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extend, forget, mix64, shingle_hashes, signed, stored, unused, work_dir
from .links import components as connected

WORDS, PERCENT = 4, 85
#: Groups that shingles are hashed into: the dimensions of a point.
GROUPS = 256
#: A point as stored: a byte for each group, then the scale of the bytes as a 4-byte integer.
POINT_BYTES = GROUPS + 4
#: Points in a leaf of the R-tree, and leaves or nodes under a node.
LEAF, FAN_OUT = 32, 8
#: Points of a cell that the first round searches in full, and points of a tile (a larger cell is dealt out).
SMALL, TILE = 8, 4096
#: Rows from which the finished groups of a task are indexed together.
TREE_ROWS = 8192
#: Documents sampled for the order of shingles, sampled documents from which a shingle counts as frequent, and such shingles.
ORDER_SAMPLE, FREQUENT, MOST_FREQUENT = 4000, 3, 200_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    return shingle_hashes((text or b"").lower(), words)


def point(hashes: np.ndarray) -> bytes:
    """Counts of a set's shingles by group. Counts over 255 are stored in larger units, rounded up, so that sums of minima
    stay upper bounds."""
    counts = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    scale = max(1, -(-int(counts.max(initial=0)) // 255))
    return (-(-counts // scale)).astype(np.uint8).tobytes() + scale.to_bytes(4, "little")


def counts_of(points: list[bytes]) -> np.ndarray:
    """Stored points as one array of counts, in bytes if no point is scaled."""
    raw = np.frombuffer(b"".join(points), np.uint8).reshape(-1, POINT_BYTES)
    scale = np.ascontiguousarray(raw[:, GROUPS:]).view("<i4")[:, 0]
    return raw[:, :GROUPS] if (scale == 1).all() else raw[:, :GROUPS].astype(np.int32) * scale[:, None]


def overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of pairs of points: summed coordinate minima."""
    return np.minimum(p, q).sum(1, dtype=np.int64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set in the fixed order, enough to meet every set that is similar enough."""
    n = len(hashes)
    if not n:
        return hashes
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: n - (percent * n + 99) // 100 + 1]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(n: np.ndarray, m: np.ndarray, bound: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether an overlap of ``bound`` would be enough for sets of n and m shingles."""
    return (100 + percent) * bound >= percent * (n + m)


class CountRTree:
    """A bulk-loaded R-tree over count vectors with four leading coordinates: cell, component, size and rest.

    Of a box the ranges of the leading coordinates and the upper corner of the counts matter: the corner bounds the overlap
    of anything inside by the summed coordinate minima. Points are laid out by cell, then by component (if ``settled``, that
    is if components hold several points), then by their counts from a group on that the cell names, so that the leaves of
    different cells bring different points together.
    """

    #: Pairs of a probe and a box looked at together.
    PIECE = 1 << 17

    def __init__(self, cell: np.ndarray, component: np.ndarray, size: np.ndarray, rest: np.ndarray, points: np.ndarray, settled: bool = True):
        layout = np.zeros((len(cell), GROUPS), np.uint8)
        from_group = (mix64(cell.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64)[:, None]
        for at in range(0, len(cell), 4096):
            s = slice(at, at + 4096)
            layout[s] = np.minimum(np.take_along_axis(points[s], (np.arange(GROUPS) + from_group[s]) % GROUPS, 1), 255)
        by_counts = np.argsort(layout.view(f"S{GROUPS}").ravel(), kind="stable")
        self.order = by_counts[np.lexsort(((component if settled else np.zeros_like(cell))[by_counts], cell[by_counts]))]
        self.cell, self.component, self.points = cell[self.order], component[self.order], points[self.order]
        self.size, self.rest = size[self.order].astype(np.int64), rest[self.order].astype(np.int64)
        self.levels: list[tuple[np.ndarray, ...]] = [(self.cell, self.cell, self.component, self.component, self.size, self.size, self.rest, self.points)]
        fan = LEAF
        while len(cell) and (len(self.levels) == 1 or len(self.levels[-1][0]) > FAN_OUT):
            below = self.levels[-1]
            cuts = np.arange(0, len(below[0]), fan)
            least = [np.minimum.reduceat(below[k], cuts) for k in (0, 2, 4)]
            most = [np.maximum.reduceat(below[k], cuts) for k in (1, 3, 5, 6, 7)]
            self.levels.append((least[0], most[0], least[1], most[1], least[2], most[2], most[3], most[4]))
            fan = FAN_OUT

    def _pruned(self, depth: int, q: np.ndarray, node: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, box, bound) of the pairs that may hold a link, cheap coordinates first."""
        low_cell, high_cell, low_part, high_part, low, high, rest, corner = self.levels[depth]
        keep = (low_cell[node] <= self.cell[q]) & (self.cell[q] <= high_cell[node])
        keep &= (low_part[node] != self.component[q]) | (high_part[node] != self.component[q])
        q, node = q[keep], node[keep]
        n, least = self.size[q], np.maximum(low[node], (percent * self.size[q] + 99) // 100)
        keep = (100 * n >= percent * low[node]) & (high[node] >= least) & may_link(n, least, np.minimum(self.rest[q], rest[node]), percent)
        q, node, least = q[keep], node[keep], least[keep]
        bound = np.zeros(len(q), np.int64)
        for at in range(0, len(q), 1 << 13):
            s = slice(at, at + (1 << 13))
            bound[s] = overlap(self.points[q[s]], corner[node[s]])
        keep = may_link(self.size[q], least, bound, percent)
        return q[keep], node[keep], bound[keep]

    def search(self, probes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the probe, place of the point, bound) of all pairs of a cell and of different components that pass the
        bounds, piece by piece. Probes are places in the tree's own order."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        step = max(1, self.PIECE // max(1, len(roots)))
        todo = [(top, np.repeat(probes[at : at + step], len(roots)), np.tile(roots, len(probes[at : at + step]))) for at in range(0, len(probes), step)] if len(roots) else []
        while todo:
            depth, q, node = todo.pop()
            q, node, bound = self._pruned(depth, q, node, percent)
            if not depth:
                if len(q):
                    yield q, node, bound
                continue
            fan, below = (FAN_OUT if depth > 1 else LEAF), len(self.levels[depth - 1][0])
            for at in range(0, len(q), self.PIECE // fan):
                s = slice(at, at + self.PIECE // fan)
                child = (node[s, None] * fan + np.arange(fan)).ravel()
                todo.append((depth - 1, np.repeat(q[s], fan)[child < below], child[child < below]))

    def leaf_pairs(self, wanted: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, later place, bound) of the ``wanted`` points and later ones of their leaf and cell that pass the bounds."""
        left, right, bounds = [], [], []
        i = np.flatnonzero(wanted)
        for step in range(1, LEAF):
            i = i[(i % LEAF + step < LEAF) & (i + step < len(self.size))]
            i = i[self.cell[i] == self.cell[i + step]]
            if not len(i):
                break
            found = self._pruned(0, i, i + step, percent)
            for held, new in zip((left, right, bounds), found):
                held.append(new)
        if not left:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in (left, right, bounds))


def first_round(tree: CountRTree, node: np.ndarray, count: np.ndarray, crosses: Callable, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, bound, held) of round 1, a being the larger node. Pairs of small cells have a bound of -1: all of them go on."""
    for q, p, _ in tree.search(np.flatnonzero(count <= SMALL), percent):
        q, p = q[p < q], p[p < q]
        if len(q):
            yield np.maximum(node[q], node[p]), np.minimum(node[q], node[p]), np.full(len(q), -1.0), np.zeros(len(q), np.int64)
    i, j, bound = tree.leaf_pairs(count > SMALL, percent)
    keep = crosses(i, j)
    i, j, bound = i[keep], j[keep], bound[keep]
    if len(i):
        a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
        score = bound / (tree.size[i] + tree.size[j] - bound)
        for order in (np.lexsort((b, -score, a)), np.lexsort((b, a))):  # the best partner, and the first one
            first = order[np.r_[True, a[order][1:] != a[order][:-1]]]
            yield a[first], b[first], score[first], np.zeros(len(first), np.int64)


def later_round(tree: CountRTree, node: np.ndarray, crosses: Callable, percent: int, best_only: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, bound, held) of pairs between components; with ``best_only`` one of two components' pairs goes on, and ``held``
    says how many were held back for it."""
    for q, p, bound in tree.search(np.arange(len(node)), percent):
        keep = (p < q) & crosses(p, q)
        q, p, bound = q[keep], p[keep], bound[keep]
        if not len(q):
            continue
        held = np.zeros(len(q), np.int64)
        if best_only:
            x, y = tree.component[q], tree.component[p]
            x, y, score = np.maximum(x, y), np.minimum(x, y), bound / (tree.size[q] + tree.size[p] - bound)
            order = np.lexsort((-score, y, x))
            starts = np.flatnonzero(np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
            held = np.diff(np.r_[starts, len(order)]) - 1
            q, p = q[order[starts]], p[order[starts]]
        yield np.maximum(node[q], node[p]), np.minimum(node[q], node[p]), np.zeros(len(q)), held


def _search_groups(batches: Iterator[pa.RecordBatch], percent: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows (token, i, j, salt, m, n, rest, node, component, point) that come sorted by token, i, j.

    A group (token, i, j) has at most the points of two tiles; the finished groups of ``TREE_ROWS`` rows share a tree.
    """
    names = ("token", "i", "j", "salt", "m", "n", "rest", "node", "component")

    def find(held: dict[str, np.ndarray], points: np.ndarray):
        edge = np.r_[True, (held["token"][1:] != held["token"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])]
        tree = CountRTree(np.cumsum(edge), held["component"], held["n"], held["rest"], points, turn > 1)
        salt, apart, node, count = (x[tree.order] for x in (held["salt"], held["i"] != held["j"], held["node"], held["m"]))

        def crosses(x, y):  # a group of two tiles only brings points of different tiles together
            return ~apart[x] | (salt[x] != salt[y])

        found = first_round(tree, node, count, crosses, percent) if turn == 1 else later_round(tree, node, crosses, percent, turn == 2)
        for columns in found:
            for at in range(0, len(columns[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + 10_000])) for c in columns], names=["a", "b", "score", "held"])

    held, points = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names}
        new_points = counts_of(batch.column("point").to_pylist())
        held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in names}
        points = new_points if points is None else np.concatenate([points, new_points])
        if len(points) < TREE_ROWS:
            continue
        same = (held["token"] == held["token"][-1]) & (held["i"] == held["i"][-1]) & (held["j"] == held["j"][-1])
        last = len(points) - int(same.sum())  # start of the unfinished group
        if last:
            yield from find({k: v[:last] for k, v in held.items()}, points[:last])
            held, points = {k: v[last:] for k, v in held.items()}, points[last:]
    if held is not None:
        yield from find(held, points)


def _frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the shingles found in ``FREQUENT`` sampled documents or more, the most frequent ones: a bounded list."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    some = docs.select(F.col("text").cast("binary").alias("text")).sample(False, min(1.0, ORDER_SAMPLE / total), seed=11)
    hashes = arrow_map(some, lambda cols: [np.concatenate([np.zeros(0, np.int64), *(signed(shingles(t, words)) for t in cols[0])])], "h long", most=64)
    rows = hashes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    return np.sort(rows.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def profile(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n, h1, h2, point, tokens) of every row: size and digest of the set, its point and its first shingles,
    in the order of all shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # MOST_FREQUENT longs at most

    def describe(texts):
        out: list[list] = [[] for _ in range(5)]
        for t in texts:
            h = shingles(t, words)
            with np.errstate(over="ignore"):
                h1, h2 = int(h.sum(dtype=np.uint64)), int(mix64(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            row = (len(h), h1 - (h1 >> 63 << 64), h2 - (h2 >> 63 << 64), point(h), signed(prefix(h, shared.value, percent)))
            for c, v in zip(out, row):
                c.append(v)
        return out

    columns = "n long, h1 long, h2 long, point binary, tokens array<long>"
    return extend(docs.select(F.col("doc_id").cast("long"), "text"), ["text"], describe, columns, keep=["doc_id"], most=128)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are linked."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = stored(own.join(ids, "doc_id").dropDuplicates(["doc_id", "text"]), f"{name}-texts", folder)
    x, y = (texts.select(F.col("doc_id").alias(i), F.col("text").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def check(cols):
        kept, sets = [], {}
        for a, b, x, y in zip(*cols):
            for t in (x, y):
                if t not in sets:
                    sets[t] = shingles(t, words)
            if linked(sets[x], sets[y], percent):
                kept.append((a, b))
        return [list(c) for c in zip(*kept)] if kept else None

    links = stored(arrow_map(both, check, "a long, b long", most=64).distinct(), f"{name}-links", folder)
    forget(docs.sparkSession, f"{folder}/{name}-texts")
    return links


def _candidates(cells: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b, score, held) from the trees over ``cells`` (token, m, tiles, n, rest, node, component)."""
    rows = cells.join(nodes.select("node", "point"), "node")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("token", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "m", "n", "rest", "node", "component", "point")
    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(lambda batches: _search_groups(batches, percent, turn), "a long, b long, score double, held long")


def classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Null, empty and blank texts have no shingles, are linked with nothing and stand for themselves. Rows that share a doc_id
    count as one document whose links are pooled; equal texts are one point. A row with a null id has the component of the
    equal set of an identified document, else a null one. Very long texts are taken whole (their counts are scaled). Further
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    profiles = stored(profile(docs, _frequent(docs, words), percent, words), "profiles", folder)
    own = profiles.where("doc_id IS NOT NULL AND n > 0")
    nodes = own.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "point", "tokens")).alias("x"))
    nodes = stored(nodes.select("h1", "h2", F.col("x.doc_id").alias("node"), "x.n", "x.point", "x.tokens"), "nodes", folder)

    met = nodes.select(F.posexplode("tokens").alias("at", "token"), "n", "node").select("token", "n", (F.col("n") - F.col("at")).alias("rest"), "node")
    # Counted before anything is joined: most cells have one point, two of sizes too far apart, or none with enough left.
    enough = (100 + percent) * F.col("rest") >= 2 * percent * F.col("n")
    shared = met.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.when(enough, F.col("n"))).alias("first"))
    two = (F.col("first") == F.col("low")) & (100 * F.col("low") >= percent * F.col("high"))
    shared = shared.where(F.col("first").isNotNull() & ((F.col("m") > 2) | ((F.col("m") == 2) & two)))
    shared = shared.select("token", "m", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    cells = stored(met.join(shared.hint("merge"), "token"), "cells", folder)

    found = stored(_candidates(cells.withColumn("component", F.col("node")), nodes, percent, 1), "found1", folder)
    best = found.where("score >= 0").groupBy("a").agg(F.max(F.struct("score", "b"))["b"].alias("x"), F.min("b").alias("y"))
    best = best.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
    tried = stored(found.where("score < 0").select("a", "b").unionByName(best).distinct(), "tried1", folder)
    links = _verified(tried, docs, percent, words, folder, "round1")
    large = cells.where(F.col("m") > SMALL)
    for turn in (2, 3):
        groups = stored(connected(links), f"groups{turn}", folder)
        placed = large.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        several = stored(several.select("token"), f"several{turn}", folder)
        if not several.take(1):
            break
        found = stored(_candidates(placed.join(several, "token", "left_semi"), nodes, percent, turn), f"found{turn}", folder)
        new = stored(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), f"tried{turn}", folder)
        more = _verified(new, docs, percent, words, folder, f"round{turn}")
        links, tried = links.unionByName(more), tried.unionByName(new)
        if not found.where("held > 0").take(1):
            break
    for name in ("cells", "found1", "found2", "found3"):
        forget(spark, f"{folder}/{name}")

    sets = nodes.select("h1", "h2", "node")
    placed = profiles.select("doc_id", "n", "h1", "h2").join(sets, ["h1", "h2"], "left")
    named = placed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    pooled = named.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    labels = connected(links.select("a", "b").unionByName(pooled)).withColumnRenamed("component", "least")
    out = placed.join(labels, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "node"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id.

    Of rows sharing a doc_id the smallest row stays. Rows without words are alone in their class and stay; rows with a null
    id cannot stand for a class and stay as well. Further columns are carried along, whatever their names; columns whose
    type has no order (maps) are not compared. An empty table stays empty.
    """
    id_, times = unused(docs, "id", "times")
    heads = classes(docs, percent, words).where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(times))
    heads = stored(heads, "heads")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Heads grow with the documents, so they are never broadcast: the plan is the same at every size.
    named = docs.join(heads.hint("merge"), F.col("doc_id").cast("long") == F.col(id_))
    once = named.where(F.col(times) == 1).select(*columns)
    whole, key = unused(named, "whole", "order")
    order = F.struct(*(F.col(f"`{f.name}`") for f in docs.schema if _has_order(f.dataType)))
    again = named.where(F.col(times) > 1).groupBy(id_).agg(F.min_by(F.struct(*columns), order).alias(whole)).select(f"{whole}.*")
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL").select(*columns))


def _has_order(kind) -> bool:
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text

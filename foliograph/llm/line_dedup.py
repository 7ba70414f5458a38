"""Line deduplication with levelled sorted runs.

The runs hold, sorted by line hash, every line key seen so far with the number of documents holding it and its keeper.
A batch's lines are merged with the runs: keys that the runs lack (the anti-join) make the batch's own run on level 0,
keys that they hold only add to the counts. When a level has ``FAN_OUT`` runs they are compacted into one run of the next
level. Batches are taken from the largest doc_id down, so the first batch to bring a key also has its keeper.
"""

from __future__ import annotations

from hashlib import blake2b
from struct import unpack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extend, forget, join_by_key, stored, unused, work_dir

MIN_CHARS, MIN_DOCS, BATCHES, FAN_OUT = 40, 5, 4, 3
_BLANK = b" \t\n\v\f\r"


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(_BLANK).lower()


def is_long(key: bytes, min_chars: int) -> bool:
    """Whether a key has at least so many code points (bytes are counted first: there are never fewer of them)."""
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def hash_of(key: bytes) -> tuple[int, int]:
    """128 bits of a key, as two signed longs."""
    return unpack("<qq", blake2b(key, digest_size=16).digest())


class LineRuns:
    """Sorted runs of (h1, h2, docs, keeper), by level, on shared storage."""

    def __init__(self, spark, folder: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.folder, self.fan_out = spark, folder or work_dir(spark), fan_out
        self.levels: list[list[DataFrame]] = [[]]
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        self.written += 1
        return stored(run.sortWithinPartitions("h1", "h2"), f"level{level}-run{self.written}", self.folder)

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self) -> DataFrame | None:
        """All runs as one: counts added up, the largest keeper."""
        runs = self.runs
        if not runs:
            return None
        df = runs[0]
        for r in runs[1:]:
            df = df.unionByName(r)
        return df.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Merge one batch of (h1, h2, docs, keeper), one row a key. Known keys only add to the counts: their entry has no
        keeper, the run that first brought the key has it."""
        known = None
        for r in self.runs:
            keys = r.where("keeper IS NOT NULL").select("h1", "h2")
            known = keys if known is None else known.unionByName(keys)
        if known is None:
            own = batch
        else:
            keeper = F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper")
            own = batch.join(known.withColumn("known", F.lit(True)), ["h1", "h2"], "left").select("h1", "h2", "docs", keeper)
        self.levels[0].append(self._write(own, 0))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            if level + 1 == len(self.levels):
                self.levels.append([])
            df = self.levels[level][0]
            for r in self.levels[level][1:]:
                df = df.unionByName(r)
            df = df.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
            self.levels[level + 1].append(self._write(df, level + 1))
            self.levels[level] = []
            level += 1


def _entries(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): the long line keys of every document row, once each."""

    def entries(cols):
        keys = ((doc_id, {key_of(x) for x in (text or b"").split(b"\n")}) for doc_id, text in zip(*cols))
        out = [(doc_id, *hash_of(k)) for doc_id, own in keys for k in own if is_long(k, min_chars)]
        return [list(c) for c in zip(*out)] if out else None

    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return arrow_map(named, entries, "doc_id long, h1 long, h2 long", most=256)


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keys): for each document that loses lines, the keys (h1, h2) it loses, at most as many as it has lines."""
    folder = work_dir(docs.sparkSession)
    entries = stored(_entries(docs, min_chars), "entries", folder)
    cuts = [float(k) / batches for k in range(1, batches)]
    bounds = entries.agg(F.percentile_approx("doc_id", cuts, 1000).alias("b")).first()["b"] or []
    edges = [None, *sorted(set(bounds)), None]
    runs = LineRuns(docs.sparkSession, folder)
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        own = entries
        if low is not None:
            own = own.where(F.col("doc_id") > low)
        if high is not None:
            own = own.where(F.col("doc_id") <= high)
        # equal (key, doc_id) entries count once: a document's repeated lines, or rows that share an id
        once = own.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        runs.add(once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")))
    common = stored(runs.merged().where(F.col("docs") >= min_docs), "common", folder)
    lost = join_by_key(entries, common, ["h1", "h2"], "docs").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))


def apply(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
    largest doc_id holding them. Null and empty texts are one empty line and stay as they are; a text that loses all its
    lines becomes empty; very long texts are split whole. Rows sharing a doc_id count as one document; rows with a null id
    count for nothing and keep all their lines. An empty table stays empty; further columns pass through, whatever their
    names; columns named like new ones are replaced.
    """
    id_, gone_, cleaned_ = unused(docs, "id", "lost", "cleaned")
    lost = dropped_keys(docs, min_chars, min_docs, batches).select(F.col("doc_id").alias(id_), F.col("keys").alias(gone_))
    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col(id_), "left").withColumn(cleaned_, F.col("text"))

    def clean(texts, losses):
        out, n_lines, n_dropped = [], [], []
        for text, loss in zip(texts, losses):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if loss:
                gone = {(x["h1"], x["h2"]) for x in loss}
                stay = [x for x in lines if not (is_long(k := key_of(x), min_chars) and hash_of(k) in gone)]
                n_dropped.append(len(lines) - len(stay))
                text = b"\n".join(stay)
            else:
                n_dropped.append(0)
            out.append(None if text is None else text.decode("utf-8", "replace"))
        return [out, n_lines, n_dropped]

    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    new = "text string, n_lines long, n_dropped long"
    cleaned = extend(joined.drop("text"), [cleaned_, gone_], clean, new, keep=[c for c in kept if c.lower() != "text"], most=256)
    return cleaned.select(*(F.col(f"`{c}`") for c in kept), "n_lines", "n_dropped")

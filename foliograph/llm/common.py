"""Shared plumbing: work tables, Arrow iteration, folds, labelled samples and the byte-level word kernel."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folds of ``crc32(doc_id)``; the last one named here is never learned from.
FOLDS, HELD_OUT_FOLD = 4, 2

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_TAIL_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def work_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where that is unset, a temporary folder stands in for it on a single
    machine; on a cluster, whose executors would each see a folder of their own, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            root = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="foliograph-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing will read again; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if more than one row in so many has it; so there are fewer hot keys than this (the bound of a broadcast).
HOT_SHARE = 10_000


def join_by_key(rows: DataFrame, one_each: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` with a stored table of one row a key, whose column ``times`` says how many rows have the key.

    The few hot keys are broadcast, so their rows stay where they are; the others are dealt out by key.
    """
    total = one_each.agg(F.sum(times)).first()[0] or 0
    hot = F.broadcast(one_each.where(F.col(times) * HOT_SHARE > total).drop(times))
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = one_each.where(F.col(times) * HOT_SHARE <= total).drop(times)
    return rows.join(hot, keys).unionByName(others.join(rest.hint("merge"), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id) -> "F.Column":
    """crc32 of the id's text, modulo the number of folds; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id) -> "F.Column":
    return F.coalesce(fold_of(doc_id) == HELD_OUT_FOLD, F.lit(False))


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[list[list]]:
    """Column lists of at most ``most`` rows, so that only a slice of a batch is in Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            yield [piece.column(k).to_pylist() for k in range(piece.num_columns)]


def arrow_map(df: DataFrame, fn: Callable[[list[list]], list[list] | None], schema: str, most: int = 512) -> DataFrame:
    """``mapInArrow`` over column lists: ``fn`` gets and returns lists of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for cols in rows_of(batches, most):
            out = fn(cols)
            if out is not None and len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order.

    A word is taken in blocks of eight bytes, each mixed into what the blocks before it gave, for all words at once; words of
    more than ``LONG_WORD`` bytes go through blake2b. Words of up to eight bytes cannot collide with others of their length.
    """
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_IS_SPACE[b], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    padded = text + bytes(8)
    blocks = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    out = mix64(blocks[starts] & _TAIL_MASKS[np.minimum(sizes, 8)] ^ (sizes.astype(np.uint64) << np.uint64(57)))
    more, at = np.flatnonzero(sizes > 8), 8
    while len(more) and at < LONG_WORD:
        block = blocks[starts[more] + at] & _TAIL_MASKS[np.minimum(sizes[more] - at, 8)]
        out[more] = mix64(out[more] * np.uint64(0x9E3779B97F4A7C15) ^ block)
        at += 8
        more = more[sizes[more] > at]
    for k in more.tolist():
        word_bytes = text[starts[k] : starts[k] + sizes[k]]
        out[k] = np.uint64(int.from_bytes(blake2b(word_bytes, digest_size=8).digest(), "little"))
    return out


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle, an empty one none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, np.uint64(min(len(w), size)), np.uint64)
    for k in range(min(size, len(w))):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : k + n]
    return np.unique(mix64(h))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, learnable_only: bool) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled documents of each class (smallest hashes of the id), and the class totals.

    Labels other than 0 and 1, null ids and, with ``learnable_only``, held-out ids are left out; of several labels for
    one id the lower counts. The picked ids (``2 * per_class`` rows at most, a fixed bound) are broadcast to the scan.
    """
    lab = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if learnable_only:
        lab = lab.where(~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [r for k in (0, 1) for r in lab.where(F.col("label") == k).orderBy(*order).limit(per_class).collect()]
    # As an Arrow table it is a local relation: from a list the executors would start Python workers of another kind for it.
    columns = [pa.array([r["doc_id"] for r in picked], pa.int64()), pa.array([r["label"] for r in picked], pa.int32())]
    ids = docs.sparkSession.createDataFrame(pa.table(columns, ["doc_id", "label"]))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows, totals


def class_weights(labels: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give a sample drawn per class the class shares of the whole table; their mean is 1."""
    w = np.array([totals.get(int(k), 1) / max(1, int((labels == k).sum())) for k in labels], np.float64)
    return w / w.mean() if len(w) else w


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset that turn scores into calibrated probabilities (weighted logistic fit by Newton steps)."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    a, c, ridge = 1.0, 0.0, 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + ridge * (a - 1), (weight * (p - y)).sum() + ridge * c])
        s = weight * p * (1 - p)
        h = np.array([[(s * z * z).sum() + ridge, (s * z).sum()], [(s * z).sum(), s.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step = step / max(1.0, np.abs(step).max())
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-6)), float(c)


def extend(df: DataFrame, inputs: list[str], fn: Callable[..., list], schema: str, keep: list[str] | None = None, most: int = 512) -> DataFrame:
    """Append columns computed in Arrow batches; columns of ``df`` with the same names are replaced.

    ``fn`` gets one list for each input column (strings as UTF-8 bytes) and returns one list for each new column.
    ``keep`` names the columns of ``df`` to carry along (all by default).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    out_schema = StructType([*kept, *new])
    arrow_new = to_arrow_schema(new)
    given = unused(df, *(f"in{k}" for k in range(len(inputs))))
    need = [f.name for f in kept] + given
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(x) for x, c in zip(given, inputs)])
    n_kept = len(kept)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                cols = []
                for k in range(n_kept, len(need)):
                    a = piece.column(k)
                    cols.append((a.cast(pa.binary()) if pa.types.is_string(a.type) else a).to_pylist())
                made = [pa.array(c, type=f.type) for c, f in zip(fn(*cols), arrow_new)]
                arrays = [piece.column(k) for k in range(n_kept)] + made
                yield pa.RecordBatch.from_arrays(arrays, names=need[:n_kept] + arrow_new.names)

    return source.mapInArrow(run, out_schema)


def keep_rows(df: DataFrame, inputs: list[str], fn: Callable[..., list], most: int = 512) -> DataFrame:
    """The rows of ``df``, unchanged, for which ``fn`` over the input columns (strings as UTF-8 bytes) says True."""
    at_of = {name: k for k, name in enumerate(df.columns)}
    places = [at_of[c] for c in inputs]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                cols = [(a.cast(pa.binary()) if pa.types.is_string((a := piece.column(k)).type) else a).to_pylist() for k in places]
                yield piece.filter(pa.array(fn(*cols), pa.bool_()))

    return df.mapInArrow(run, df.schema)

"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two (at most ``longest``); a piece is a sequence of its
own and goes to the bucket of its length. Buckets are filled in the tasks and emptied whole, so pieces come out in runs of
one length and training batches are drawn from one bucket at a time: nothing is padded and no sequence crosses documents.
The plan is one pass over the texts with no shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import END_ID, default_path, encoder

LONGEST = 2048
#: Pieces of a bucket, and ids of all buckets of a task, that are held before the bucket, or all of them, are emptied.
BUCKET_ROWS, HELD_IDS = 4096, 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def decompose(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: as many of ``longest`` as fit, then the binary digits of the rest."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece has to be a power of two")
    out = [(s, longest) for s in range(0, n - longest + 1, longest)]
    at = len(out) * longest
    bit = longest >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False, sparing: bool = False
) -> DataFrame:
    """One row per piece (see ``SCHEMA``), in runs of one bucket; ``with_ids`` adds the piece's ids as ``ids array<int>``.
    ``sparing`` keeps fewer words in the workers, which takes longer and gives the same rows.

    Null and empty texts give the single piece of the end id; very long ones are cut whole. Rows are independent: null or
    repeated ids, repeated texts and further columns, whatever their names, change nothing; an empty table gives no rows.
    ``sequence_id`` is unique (task number and count, as Spark's own increasing ids) and ascends within a run, ``offset`` is
    always 0 and ``bucket`` the binary logarithm of the length.
    """
    decompose(0, longest)
    path = tokenizer_path or default_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64()] * 7 + [pa.int32()]
    schema = pa.schema([*zip(names, types), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches):
        enc, sequence, held = encoder(path, sparing), TaskContext.get().partitionId() << 33, 0
        buckets: list[list[tuple]] = [[] for _ in range(longest.bit_length())]

        def emptied(bucket: int) -> pa.RecordBatch:
            nonlocal sequence
            pieces, buckets[bucket] = buckets[bucket], []
            doc_id, start, crc, doc_tokens, *ids = zip(*pieces)
            n = len(pieces)
            numbers, sequence = np.arange(sequence, sequence + n), sequence + n
            length, offset, which = np.full(n, 1 << bucket), np.zeros(n, np.int64), np.full(n, bucket, np.int32)
            columns = [doc_id, start, length, crc, doc_tokens, numbers, offset, which]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            if with_ids:
                flat = np.frombuffer(b"".join(ids[0]), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) << bucket), pa.array(flat)))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.documents(part.column(1).to_pylist(), end_id)):
                    packed = memoryview(ids.astype("<u4").tobytes())
                    for start, length in decompose(len(ids), longest):
                        piece = packed[4 * start : 4 * (start + length)]
                        bucket = length.bit_length() - 1
                        row = (doc_id, start, zlib.crc32(piece), len(ids))
                        buckets[bucket].append((*row, bytes(piece)) if with_ids else row)
                        held += length if with_ids else 0
                        if len(buckets[bucket]) >= BUCKET_ROWS:
                            held -= len(buckets[bucket]) << bucket if with_ids else 0
                            yield emptied(bucket)
                    if held > HELD_IDS:
                        yield from (emptied(k) for k, pieces in enumerate(buckets) if pieces)
                        held = 0
        yield from (emptied(k) for k, pieces in enumerate(buckets) if pieces)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces (made ``with_ids``) as one Parquet folder per length, ready to be drawn from bucket by bucket."""
    packed.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The written sequences of one length; the other buckets are not read."""
    return spark.read.parquet(path).where(F.col("bucket") == length.bit_length() - 1)

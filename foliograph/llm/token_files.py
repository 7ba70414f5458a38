"""Token ids in Arrow stream files of fixed-size lists.

A part is two files. ``part-N.tokens.arrow`` holds batches of equal-length sequences, ``ids fixed_size_list<uint16>[L]``
and ``mask fixed_size_list<bool>[L]``, uncompressed, so a memory-mapped reader hands out any sequence and its mask without
copying. ``part-N.docs.arrow`` lists the documents in it: doc_id, start (ids before it in the part) and n_tokens. The
documents' ids follow one another without gaps; only a part's last sequence is padded (mask false).
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import END_ID, default_path, encoder

LENGTH = 2048
BATCH = 64
PARTS_SCHEMA = "part int, n_docs long, n_tokens long, n_sequences long"
DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class PartWriter:
    """Writes one part. The files get their names only when complete, so a repeated task replaces them whole."""

    def __init__(self, folder: str, part: int, attempt: str, dtype: np.dtype, length: int, batch: int):
        self.fs, self.folder = _open(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.attempt, self.dtype, self.length, self.rows = part, attempt, dtype, length, batch
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sinks = {k: self.fs.open_output_stream(self._name(k, True)) for k in ("tokens", "docs")}
        self.tokens = pa.ipc.new_stream(self.sinks["tokens"], self.schema)
        self.docs = pa.ipc.new_stream(self.sinks["docs"], _DOCS)
        self.pending, self.index = bytearray(), ([], [], [])
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def _name(self, kind: str, unfinished: bool = False) -> str:
        return f"{self.folder}/{f'_{self.attempt}.' if unfinished else ''}part-{self.part:05d}.{kind}.arrow"

    def _flush(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for c, v in zip(self.index, (doc_id, self.n_tokens, len(ids))):
            c.append(v)
        self.n_docs += 1
        self.n_tokens += len(ids)
        self.pending += ids.tobytes()
        size = self.rows * self.length * self.dtype.itemsize
        if len(self.pending) >= size:
            whole = len(self.pending) // size * size
            flat = np.frombuffer(bytes(self.pending[:whole]), self.dtype)
            del self.pending[:whole]
            for at in range(0, len(flat), self.rows * self.length):
                self._flush(flat[at : at + self.rows * self.length], self.rows * self.length)
        if len(self.index[0]) >= 4096:
            self._flush_docs()

    def _flush_docs(self) -> None:
        if self.index[0]:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.index], schema=_DOCS))
            self.index = ([], [], [])

    def close(self) -> tuple[int, int, int, int]:
        rest = np.frombuffer(bytes(self.pending), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._flush(padded, len(rest))
        self._flush_docs()
        for w, s in ((self.tokens, self.sinks["tokens"]), (self.docs, self.sinks["docs"])):
            w.close()
            s.close()
        for kind in ("tokens", "docs"):
            self.fs.move(self._name(kind, True), self._name(kind))
        return self.part, self.n_docs, self.n_tokens, self.n_sequences


class PartReader:
    """Random access to a part's sequences; over a local file every array is a view of the mapped file."""

    def __init__(self, folder: str, part: int):
        fs, path = _open(folder)
        name = f"{path}/part-{part:05d}.tokens.arrow"
        source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(source))
        self.ends = list(np.cumsum([b.num_rows for b in self.batches]))

    def __len__(self) -> int:
        return int(self.ends[-1]) if self.ends else 0

    def _row(self, i: int, column: int) -> pa.Array:
        k = bisect_right(self.ends, i)
        return self.batches[k].column(column)[i - (self.ends[k - 1] if k else 0)].values

    def sequence(self, i: int) -> np.ndarray:
        return self._row(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.Array:
        return self._row(i, 1)


def stream_documents(folder: str, part: int):
    """(doc_id, start, ids) of a part's documents in order, one batch of sequences in memory at a time."""
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/part-{part:05d}.tokens.arrow") as a, fs.open_input_stream(f"{path}/part-{part:05d}.docs.arrow") as b:
        tokens, held, at = pa.ipc.open_stream(a), None, 0
        for docs in pa.ipc.open_stream(b):
            for doc_id, start, n in zip(*(c.to_pylist() for c in docs.columns)):
                got, need = [], n
                while need:
                    if held is None or at == len(held):
                        batch = tokens.read_next_batch()
                        held, at = batch.column(0).flatten().to_numpy(zero_copy_only=True), 0
                    piece = held[at : at + need]
                    got.append(piece)
                    at += len(piece)
                    need -= len(piece)
                yield doc_id, start, got[0] if len(got) == 1 else np.concatenate(got)


def write(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str | None = None,
    length: int = LENGTH,
    batch: int = BATCH,
    end_id: int = END_ID,
    parts: int | None = None,
) -> list[tuple[int, int, int, int]]:
    """Encode every text and write the parts in ascending doc_id order; returns (part, documents, ids, sequences) each.

    Null ids come first, rows with one id follow by text hash and text; null and empty texts hold the end id alone, very
    long ones cross as many sequences as they need; further columns are not read; an empty table writes only the manifest. The driver gets one row per part. ``folder`` has to be storage that all share.
    """
    path = tokenizer_path or default_path()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = parts or max(1, source.rdd.getNumPartitions())
    dealt = source.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def run(batches):
        context, writer = TaskContext.get(), None
        enc = encoder(path)
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.documents(part.column(1).to_pylist(), end_id)):
                    if writer is None:
                        writer = PartWriter(folder, context.partitionId(), f"attempt-{context.taskAttemptId()}", enc.dtype, length, batch)
                    writer.add(doc_id, ids)
        if writer:
            done = writer.close()
            columns = [pa.array([v], t) for v, t in zip(done, (pa.int32(), *[pa.int64()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n_docs", "n_tokens", "n_sequences"])

    done = sorted(tuple(r) for r in dealt.mapInArrow(run, PARTS_SCHEMA).collect())
    fs, local = _open(folder)
    fs.create_dir(local, recursive=True)
    for left in fs.get_file_info(pafs.FileSelector(local)):  # by attempts that failed or came second
        if left.base_name.startswith("_attempt-"):
            fs.delete_file(left.path)
    with fs.open_output_stream(f"{local}/manifest.json") as out:
        out.write(json.dumps({"length": length, "batch": batch, "end_id": end_id, "parts": done}).encode())
    return done


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start in the whole corpus, n_tokens and ids_crc32."""
    fs, local = _open(folder)
    with fs.open_input_stream(f"{local}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    base, rows = 0, []
    for part, _, n_tokens, _ in parts:
        rows.append((part, base))
        base += n_tokens
    listing = spark.createDataFrame(rows, "part int, base long")
    listing = listing.repartition(len(rows), "part") if rows else listing

    def listed(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cols: list[list] = [[], [], [], []]
                for doc_id, start, ids in stream_documents(folder, part):
                    for c, v in zip(cols, (doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        c.append(v)
                    if len(cols[0]) >= 10_000:
                        yield listed(cols)
                        cols = [[], [], [], []]
                yield listed(cols)

    return listing.mapInArrow(run, DIGEST_SCHEMA)

"""Chunk store and packed key exchange: how the near-duplicate operators ask corpus-wide questions.

A task packs its documents into chunks of bounded size, one compressed Arrow file each in the shared
folder, and emits a pointer row. Later passes take pointer rows, not texts, through Spark's exchanges
and open the file where they run. A retried task writes a file of a new name; only committed pointers
are followed.

A question ("does this key occur in another document?") is asked with all keys of a chunk at once: keys
are sorted and cut by hash range into buckets, one binary row per (chunk, bucket) instead of a row per
key; the bucket's task sees every chunk's keys of its range and answers each chunk by position. A key
that every document holds costs a task a few bytes a document, never a pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import new_path, release, shuffle_partitions, stage

CHUNK_BYTES, CHUNK_DOCS, POINTER = 12 << 20, 30_000, -1
BUCKET_BYTES = 32 << 20  # of input, for each bucket of keys
PACKED = "chunk string, bucket int, keys binary, vals binary"
_FIELDS = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])


def _open(path: str):
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    return fs, at


def read_chunk(path: str) -> pa.Table:
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        return pa.ipc.open_file(f).read_all()


def write_table(path: str, table: pa.Table) -> None:
    fs, at = _open(path)
    with fs.open_output_stream(at, compression=None) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table, max_chunksize=2000)


def encode_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: 32-bit steps where they fit."""
    if len(keys) > 1 and (steps := np.diff(keys)).max() < 2**32:
        return b"4" + keys[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"8" + keys.tobytes()


def decode_keys(raw: bytes) -> np.ndarray:
    if raw[:1] == b"8":
        return np.frombuffer(raw, np.uint64, offset=1)
    first = np.frombuffer(raw, np.uint64, 1, 1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw, np.uint32, offset=9), dtype=np.uint64)])


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in sorted keys; the end last."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def pack(chunk: str, keys: np.ndarray, vals: np.ndarray, buckets: int, more: bytes = b"") -> list[tuple]:
    """Rows of sorted keys and their vals (uint16); `more` goes with every row."""
    at = cuts(keys, buckets)
    return [(chunk, b, encode_keys(keys[i:j]), len(more).to_bytes(4, "little") + more + vals[i:j].tobytes()) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]


def unpack(raw_keys: bytes, raw_vals: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n = int.from_bytes(raw_vals[:4], "little")
    return decode_keys(raw_keys), np.frombuffer(raw_vals, np.uint16, offset=4 + n), raw_vals[4 : 4 + n]


def bucket_count(df: DataFrame) -> int:
    """Buckets by the planner's size of the input, so that what a bucket holds doesn't grow with it."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = planned if planned < 1 << 50 else 0  # rows made in memory have no size
    return max(8, shuffle_partitions(df.sparkSession), known // BUCKET_BYTES)


def build(docs: DataFrame, summarize: Callable, name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Staged pointer rows and packed rows of docs (doc_id, text, ...).

    summarize(ids, texts, the chunk's path) -> (keys sorted, vals uint16, summary bytes). A pointer row has the file's
    path in keys and the summary in vals.
    """
    folder, buckets = new_path(docs.sparkSession, name), bucket_count(docs)

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        held, n_bytes, n_docs = [], 0, 0

        def flush():
            chunk = uuid.uuid4().hex
            table = pa.Table.from_batches(held)
            path = f"{folder}/{chunk}.arrow"
            write_table(path, table)
            keys, vals, summary = summarize(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), path)
            rows = [(chunk, POINTER, path.encode(), summary), *pack(chunk, keys, vals, buckets)]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64], strict=True), _FIELDS, strict=True)], schema=_FIELDS)

        for batch in batches:
            at = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                fit = int(np.searchsorted(sizes, base + chunk_bytes - n_bytes, "right")) - at
                take = max(1 if not n_docs else 0, min(fit, CHUNK_DOCS - n_docs, batch.num_rows - at))
                if take:
                    held.append(batch.slice(at, take))
                    n_bytes, n_docs, at = n_bytes + int(sizes[at + take - 1] - base), n_docs + take, at + take
                if at < batch.num_rows or n_bytes >= chunk_bytes or n_docs >= CHUNK_DOCS:
                    yield from flush()
                    held, n_bytes, n_docs = [], 0, 0
                    release()
        if held:
            yield from flush()
        held = None
        release()

    store = stage(docs.mapInArrow(run, PACKED), f"{name}-packed")
    store._folder = folder
    return store


def pointers(store: DataFrame) -> DataFrame:
    """chunk, path, summary of each chunk, staged, so that the packed rows can go before the chunks do."""
    return stage(_pointers(store), "pointers")


def _pointers(store: DataFrame) -> DataFrame:
    return store.filter(F.col("bucket") == POINTER).select("chunk", F.col("keys").cast("string").alias("path"), F.col("vals").alias("summary"))


def packed(store: DataFrame) -> DataFrame:
    return store.filter(F.col("bucket") != POINTER)


def ask(rows: DataFrame, answer: Callable) -> DataFrame:
    """(chunk, bucket, answer) of packed rows.

    answer(list of (keys, vals, more)) -> list of bytes, one per chunk in the bucket.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        got = answer([unpack(k, v) for k, v in zip(pdf["keys"], pdf["vals"], strict=True)])
        out = pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "answer": got})
        release()
        return out

    return rows.groupBy("bucket").applyInPandas(run, "chunk string, bucket int, answer binary")


def _dealt(points: DataFrame, asides: DataFrame):
    # pointer rows are small and their work isn't: a stated number keeps adaptive execution from joining them into few tasks
    n = shuffle_partitions(points.sparkSession)
    return points.repartition(n, "chunk").groupBy("chunk").cogroup(asides.repartition(n, "chunk").groupBy("chunk"))


def visit(points: DataFrame, asides: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(chunk, path, summary, aside rows as pandas) -> pandas frame, per chunk. schema: "name type, ..."."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame(columns=names)
        row = p.iloc[0]
        out = fn(row["chunk"], row["path"], row["summary"], a)
        release()
        return out

    return _dealt(points, asides).applyInPandas(run, schema)


def visit_rows(points: DataFrame, asides: DataFrame, fn: Callable, schema: StructType) -> DataFrame:
    """fn(chunk, path, summary, aside rows as Arrow) -> Arrow table, per chunk: for rows of any columns and names."""
    empty = to_arrow_schema(schema)

    def run(p: pa.Table, a: pa.Table) -> pa.Table:
        if not p.num_rows:
            return empty.empty_table()
        row = p.slice(0, 1).to_pylist()[0]
        out = fn(row["chunk"], row["path"], row["summary"], a)
        release()
        return out

    return _dealt(points, asides).applyInArrow(run, schema)

"""Helpers shared by the training-data operators: shared-folder staging, words, hashes.

Conventions of every operator here:

* a null text counts as the empty text;
* input columns other than the named ones are ignored, so clashing names are harmless;
* repeated rows are rows: each gets its own result row;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one is set only where none is (tests, local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextlib.contextmanager
def collecting():
    """The list of the paths that are made in this block, so that their owner can remove them."""
    paths: list[str] = []
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; what nobody removed goes when the driver ends."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    if (paths := _owner.get()) is not None:
        paths.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends there, any executor may go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(f"{path}/rows")
    out = spark.read.schema(df.schema).parquet(f"{path}/rows")
    out._staged_path = path
    return out


def result_only(step, spark: SparkSession, name: str) -> DataFrame:
    """The staged result of step(); all else that it left in the shared folder is removed."""
    with collecting() as paths:
        out = step()
        kept = stage(out, name)
    remove(spark, [p for p in paths if p != kept._staged_path])
    if (outer := _owner.get()) is not None:
        outer.append(kept._staged_path)
    return kept


def is_staged(df: DataFrame) -> bool:
    return hasattr(df, "_staged_path")


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    remove(df.sparkSession, [df._staged_path])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8. bytes.split() cuts at exactly those six bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound; forgetting only costs time."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(word_hashes: np.ndarray, k: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of k consecutive words (uint64), order-sensitive; another odd factor gives another hash."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(factor) + word_hashes[i : i + n]
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def release() -> None:
    """Give freed memory back to the system: workers live on, and a large chunk's leftovers with them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


NAMED = ("doc_id", "text", "lang", "source", "n_chars")


def whole_rows(fn: Callable) -> Callable:
    """fn(docs, ...) -> rows of docs' columns, made safe for other columns of any names: fn sees them by number."""

    @wraps(fn)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        numbered = docs.toDF(*(c if c in NAMED else f"_{i}" for i, c in enumerate(docs.columns)))
        return fn(numbered, *args, **how).toDF(*docs.columns)

    return run


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

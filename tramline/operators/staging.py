"""Tables written once into the folder of spark.checkpoint.dir, to end the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without one, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh shared folder; what nobody has removed goes when the driver ends."""
    path = f"{shared_folder(spark)}/network/{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(f"{path}/rows")
    out = spark.read.schema(df.schema).parquet(f"{path}/rows")
    out._staged_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders of scratch."""
    for path in paths:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


def drop(*staged: DataFrame) -> None:
    """Removes staged tables that nothing reads any more, such as those of an iteration's last round."""
    for df in staged:
        discard(df.sparkSession, df._staged_path)


def size_of(spark: SparkSession, path: str) -> tuple[int, bool]:
    """(bytes, whether any is compressed) of a file, or of the files of a folder or pattern; compressed ones count eightfold."""
    fs, at = _hadoop(spark, path)
    files = [g for f in (fs.globStatus(at) or []) for g in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]
    packed = [g.getPath().getName().endswith(".gz") for g in files]
    return sum(g.getLen() * (8 if z else 1) for g, z in zip(files, packed, strict=True)), any(packed)

"""Event logs as streams: the same scan and the same columns as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scenario_xml import EVENT, event_columns


def stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """Events of the XML files that come into a folder."""
    return event_columns(spark.readStream.format("xml").option("rowTag", "event").option("maxFilesPerTrigger", files_a_batch).schema(EVENT).load(folder))


def dispatch(events: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], fallback: Callable[[DataFrame], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Each batch's rows of a type go to its handler, the rest to the fallback; handlers get DataFrames."""
    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        for kind, handle in handlers.items():
            handle(df.filter(F.col("type") == kind))
        if fallback:
            fallback(df.filter(~F.col("type").isin(*handlers)))
        df.unpersist()

    writer = events.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def typed_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows appended to folder, what has arrived by now, once: progress is kept in checkpoint."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def typed(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("type") == kind)


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def link_traversals(events: DataFrame) -> DataFrame:
    """vehicle_id, link_id, entered, left of each entry and the next leave of the same vehicle. Batch."""
    moves = events.filter(F.col("type").isin("entered_link", "left_link"))
    after = W.partitionBy("vehicle_id").orderBy("time", F.desc("type"))
    nxt = moves.withColumn("then", F.lead(F.struct("type", "time", "link_id")).over(after))
    return nxt.filter("type = 'entered_link' and then.type = 'left_link' and then.link_id = link_id").select("vehicle_id", "link_id", F.col("time").alias("entered"), F.col("then.time").alias("left"))


def windowed_counts(events: DataFrame, seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows of service-day time, with a watermark."""
    at = events.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", f"{seconds} seconds"), "type").agg(F.count("*").alias("n"))

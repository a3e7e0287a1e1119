"""Populations as streams: persons of files that come into a folder, in the columns of the batch reader.

Attributes of persons and plans aren't in a stream's elements; a missing coordinate is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scenario_xml import PLAN_TEXT, plan_elements


def stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """person_id, plan_idx, pos, kind, ... of each activity and leg."""
    scanned = spark.readStream.format("xml").option("rowTag", "person").option("maxFilesPerTrigger", files_a_batch).schema(PLAN_TEXT).load(folder)
    at = lambda c: F.when(F.col("kind") == "activity", F.coalesce(c, F.lit(0.0)))
    return plan_elements(scanned).withColumns({"x": at("x"), "y": at("y")})


def dispatch(elements: DataFrame, handler: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """The handler gets each batch's elements as a DataFrame."""
    return elements.writeStream.foreachBatch(lambda df, _: handler(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

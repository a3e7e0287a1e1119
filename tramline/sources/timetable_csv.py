"""Timetable feeds (folder or zip of csv text files) as typed tables."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import lenient_double, lenient_int, timetable_seconds
from ..operators.staging import shared_folder


def unpack(spark: SparkSession, path: str) -> str:
    """A zip's text files in the shared folder; a folder as it is."""
    if not path.lower().endswith((".zip", ".gtfs")):
        return path
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(f"{shared_folder(spark)}/feeds/{uuid.uuid4().hex}")
    fs.create_dir(root, recursive=True)
    store, at = FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    with store.open_input_file(at) as packed, zipfile.ZipFile(packed) as z:
        for name in z.namelist():
            if name.endswith(".txt"):
                with z.open(name) as src, fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[-1]}") as out:
                    while block := src.read(1 << 20):
                        out.write(block)
    return f"{shared_folder(spark)}/feeds/{root.rsplit('/', 1)[-1]}"


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """All columns as text, null as '' ; the byte order mark of the first header is dropped. None if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(f"{folder}/{name}.txt")
    except AnalysisException:
        return None
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿").strip()) for c in df.columns)).withColumn("row", F.monotonically_increasing_id())


TABLES: dict[str, list[tuple[str, str, object]]] = {
    # column, kind, default
    "agency": [("agency_id", "text", None), ("agency_name", "text", None), ("agency_url", "text", None), ("agency_timezone", "text", None)],
    "stops": [("stop_id", "text", None), ("stop_name", "text", None), ("stop_lat", "double", 0.0), ("stop_lon", "double", 0.0), ("location_type", "int", 0), ("parent_station", "text", None)],
    "routes": [("route_id", "text", None), ("agency_id", "text", None), ("route_short_name", "text", None), ("route_long_name", "text", None), ("route_type", "int", -1)],
    "trips": [("trip_id", "text", None), ("route_id", "text", None), ("service_id", "text", None), ("trip_headsign", "text", None), ("direction_id", "int", 0)],
    "stop_times": [("trip_id", "text", None), ("stop_id", "text", None), ("stop_sequence", "int", 0), ("arrival_time", "time", None), ("departure_time", "time", None), ("timepoint", "int", 1)],
    "calendar": [("service_id", "text", None), *((d, "int", 0) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")), ("start_date", "text", None), ("end_date", "text", None)],
    "calendar_dates": [("service_id", "text", None), ("date", "text", None), ("exception_type", "int", 1)],
    "frequencies": [("trip_id", "text", None), ("start_time", "time0", None), ("end_time", "time0", None), ("headway_secs", "int", 0), ("exact_times", "int", 0)],
    "shapes": [("shape_id", "text", None), ("shape_pt_sequence", "int", 0), ("shape_pt_lat", "double", 0.0), ("shape_pt_lon", "double", 0.0), ("shape_dist_traveled", "double", None)],
}


def typed(name: str, kind: str, default: object, have: bool) -> Column:
    c = F.col(f"`{name}`") if have else F.lit("")
    if kind == "text":
        return F.nullif(F.trim(c), F.lit(""))
    if kind == "int":
        return lenient_int(c, default)
    if kind == "double":
        return lenient_double(c, default)
    return F.coalesce(timetable_seconds(c), F.lit(0)) if kind == "time0" else timetable_seconds(c)


def feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables a feed has, typed; a missing route_type column means 3."""
    folder, out = unpack(spark, path), {}
    for name, columns in TABLES.items():
        if (df := scan(spark, folder, name)) is not None:
            fields = [typed(c, k, 3 if c == "route_type" and c not in df.columns else d, c in df.columns).alias(c) for c, k, d in columns]
            out[name] = df.select(*fields, "row")
    if "stop_times" in out:
        out["stop_times"] = out["stop_times"].withColumnRenamed("arrival_time", "arrival").withColumnRenamed("departure_time", "departure")
    return out

"""Trips, stop offsets, patterns, departures and vehicles of a timetable.

stop_times: trip_id, stop_sequence, stop_id, arrival, departure (seconds or null), timepoint (1 default), row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tags import route_mode, vehicle_places
from ..functions.times import compact_clock


def ordered_stop_times(stop_times: DataFrame) -> DataFrame:
    """With pos, from 0 in each trip, by sequence and then file order."""
    return stop_times.withColumn("pos", F.row_number().over(W.partitionBy("trip_id").orderBy("stop_sequence", "row")) - 1)


def usable_trips(trips: DataFrame, routes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trips with a route and at least one stop time."""
    return trips.join(routes.select("route_id", "route_type"), "route_id").join(stop_times.select("trip_id").distinct(), "trip_id", "left_semi")


def stop_offsets(stop_times: DataFrame) -> DataFrame:
    """trip_id, pos, stop_id, base, arrival_offset, departure_offset, await, valid.

    base is the first departure (0 if unknown). Times at timepoints hold; a timepoint without an arrival
    takes the arrival before it (0 right after a run without timepoint). Runs without timepoint are spread evenly between their neighbours; a
    leading run starts at base, a trailing one ends 60 seconds after its last anchor. Offsets are at
    least 0. A trip with a departure before its arrival is not valid: its offsets are the raw times,
    null as base. All windows have the order that gives pos, so a task sorts its rows once.
    """
    trip = W.partitionBy("trip_id").orderBy("stop_sequence", "row")
    before = trip.rowsBetween(W.unboundedPreceding, -1)
    upto = trip.rowsBetween(W.unboundedPreceding, 0)
    s = ordered_stop_times(stop_times).withColumn("timed", F.coalesce("timepoint", F.lit(1)) == 1)
    s = s.withColumn("base", F.coalesce(F.first("departure").over(trip), F.lit(0)).cast("double"))
    s = s.withColumn("n", F.count("*").over(W.partitionBy("trip_id")))
    # a timepoint without an arrival carries what is before it: the last known arrival of its unbroken stretch of timepoints
    s = s.withColumn("stretch", F.count_if(~F.col("timed")).over(upto))
    s = s.withColumn("known", F.when(F.col("timed"), F.col("arrival").cast("double")))
    s = s.withColumn("at", F.last(F.when(F.col("known").isNotNull(), F.struct("stretch", "known")), ignorenulls=True).over(upto))
    s = s.withColumn("carried", F.when(F.col("at.stretch") == F.col("stretch"), F.col("at.known")))
    # right after a run of other stops, whose times aren't known yet, it counts as 0
    after_run = F.col("carried").isNull() & (F.col("stretch") > 0)
    s = s.withColumn("arr", F.when(F.col("timed"), F.when(after_run, 0.0).otherwise(F.coalesce("carried", F.col("base")))))
    s = s.withColumn("dep", F.when(F.col("timed"), F.coalesce(F.col("departure").cast("double"), F.col("arr"))))
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.col("base"))
    following = lambda c: F.expr(f"lead({c}) ignore nulls over (partition by trip_id order by stop_sequence, row)")
    s = s.withColumn("prev_arr", last("arr")).withColumn("prev_dep", last("dep"))
    s = s.withColumn("next_arr", F.coalesce(following("arr"), F.col("prev_arr") + 60))
    s = s.withColumn("next_dep", F.coalesce(following("dep"), F.col("prev_dep") + 60))
    # a stop of a run stands so many places behind the timepoint before the run
    s = s.withColumn("place", F.when(F.col("timed"), F.col("pos")))
    s = s.withColumn("from", F.coalesce(F.last("place", ignorenulls=True).over(before), F.lit(-1))).withColumn("to", F.coalesce(following("place"), F.col("n")))
    s = s.withColumn("frac", (F.col("pos") - F.col("from")) / (F.col("to") - F.col("from")))
    spread = lambda a, b: F.col(a) + F.col("frac") * (F.col(b) - F.col(a))
    s = s.withColumn("arr", F.coalesce("arr", spread("prev_arr", "next_arr"))).withColumn("dep", F.coalesce("dep", spread("prev_dep", "next_dep")))
    off = lambda c: F.greatest(F.col(c) - F.col("base"), F.lit(0.0))
    s = s.withColumn("valid", ~F.coalesce(F.max(off("dep") < off("arr") - 0.001).over(W.partitionBy("trip_id")), F.lit(False)))
    raw = lambda c: F.coalesce(F.col(c).cast("double"), F.col("base")) - F.col("base")
    s = s.withColumn("arrival_offset", F.when(F.col("valid"), off("arr")).otherwise(raw("arrival"))).withColumn("departure_offset", F.when(F.col("valid"), off("dep")).otherwise(raw("departure")))
    waits = F.when(F.col("valid"), F.abs(F.col("dep") - F.col("arr")) > 0.5).otherwise(F.abs(F.col("departure_offset") - F.col("arrival_offset")) > 0.5)
    return s.select("trip_id", "pos", "stop_id", "base", "arrival_offset", "departure_offset", waits.alias("await"), "valid")


def trip_patterns(trips: DataFrame, routes: DataFrame, offsets: DataFrame, feed_id: str = "feed") -> DataFrame:
    """trip_id, route_id, line_id, pattern, pattern_route_id, mode.

    Trips of one route, direction, stop list and offsets share a pattern. Patterns are numbered over
    the feed in the order of their first trip. The stops of a trip are one array of its own length.
    """
    calls = offsets.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_id", "arrival_offset", "departure_offset"))).alias("calls"))
    t = trips.join(routes.select("route_id", "route_type"), "route_id").join(calls, "trip_id")
    t = t.withColumn("key", F.xxhash64("route_id", F.coalesce("direction_id", F.lit(0)), "calls"))
    first = t.groupBy("route_id", F.coalesce("direction_id", F.lit(0)).alias("direction"), "calls").agg(F.min("trip_id").alias("first_trip"))
    numbered = first.select("first_trip", (F.row_number().over(W.orderBy("first_trip")) - 1).alias("pattern"))
    first = first.join(numbered, "first_trip")
    t = t.withColumn("direction", F.coalesce("direction_id", F.lit(0))).join(first, ["route_id", "direction", "calls"])
    line = F.concat(F.lit(f"{feed_id}:"), "route_id")
    return t.select("trip_id", "route_id", line.alias("line_id"), "pattern", F.concat(line, F.lit("_r"), F.col("pattern")).alias("pattern_route_id"), route_mode(F.col("route_type")).alias("mode"))


def departures(trips: DataFrame, stop_times: DataFrame, frequencies: DataFrame, service_dates: DataFrame, dates: DataFrame, feed_id: str = "feed") -> DataFrame:
    """trip_id, date, departure_id, departure_time on the chosen dates.

    A trip with a positive headway departs by its frequency rows, from start to before end; any other
    departs once, at its first departure. A trip without a first departure time has none.
    """
    first = ordered_stop_times(stop_times).filter("pos = 0 and departure is not null").select("trip_id", F.col("departure").alias("first_departure"))
    active = service_dates.join(dates, "date", "left_semi")
    runs = trips.join(first, "trip_id").join(active, "service_id").select("trip_id", "date", "first_departure")
    often = frequencies.filter("headway_secs > 0")
    at = often.filter("start_time < end_time").select("trip_id", F.explode(F.sequence(F.col("start_time"), F.col("end_time") - 1, F.col("headway_secs"))).alias("departure_time"))
    day = F.date_format("date", "yyyyMMdd")
    once = runs.join(often.select("trip_id").distinct(), "trip_id", "left_anti").select("trip_id", "date", F.concat_ws(":", F.lit(feed_id), "trip_id", day).alias("departure_id"), F.col("first_departure").alias("departure_time"))
    many = runs.join(at, "trip_id").select("trip_id", "date", F.concat_ws(":", F.lit(feed_id), "trip_id", day, compact_clock(F.col("departure_time"))).alias("departure_id"), "departure_time")
    return once.unionByName(many)


def frequency_overlaps(frequencies: DataFrame) -> DataFrame:
    """Pairs of frequency rows of a trip that overlap in time, by order of the rows (trip, start, end, headway, exact)."""
    numbered = frequencies.withColumn("n", F.row_number().over(W.partitionBy("trip_id").orderBy("start_time", "end_time", "headway_secs", "exact_times")))
    a, b = numbered.alias("a"), numbered.alias("b")
    hit = F.greatest("a.start_time", "b.start_time") < F.least("a.end_time", "b.end_time")
    return a.join(b, (F.col("a.trip_id") == F.col("b.trip_id")) & (F.col("a.n") < F.col("b.n")) & hit).select("a.trip_id", F.col("a.start_time").alias("a_start"), F.col("a.end_time").alias("a_end"), F.col("b.start_time").alias("b_start"), F.col("b.end_time").alias("b_end"))


def strictest_exact_times(frequencies: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, exact_times: the least value among the frequency rows of the pattern's first trip."""
    first = patterns.groupBy("pattern").agg(F.min("trip_id").alias("trip_id"))
    return first.join(frequencies, "trip_id").groupBy("pattern").agg(F.min("exact_times").alias("exact_times"))


def vehicles(departure_rows: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types: mode, seats, standing; vehicles: vehicle_id, type_id): one vehicle a departure."""
    own = departure_rows.join(patterns.select("trip_id", "mode"), "trip_id")
    places = vehicle_places(F.col("mode"))
    types = own.select("mode").distinct().select(F.col("mode").alias("type_id"), places["seats"].alias("seats"), places["standing"].alias("standing"))
    return types, own.select(F.col("departure_id").alias("vehicle_id"), F.col("mode").alias("type_id"))


def used_vehicles(vehicles: DataFrame, departures: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The vehicles that a departure names."""
    return vehicles.join(departures.select(key), key, "left_semi")


def platforms(stops: DataFrame) -> DataFrame:
    """Stops of location type 0 with coordinates other than (0, 0)."""
    return stops.filter("coalesce(location_type, 0) = 0 and not (stop_lat = 0 and stop_lon = 0)")


def union_feeds(feeds: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several feeds, their key columns prefixed by the feed id."""
    out = None
    for feed_id, rows in feeds.items():
        named = rows.withColumns({k: F.concat_ws(":", F.lit(feed_id), k) for k in keys}).withColumn("feed_id", F.lit(feed_id))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out

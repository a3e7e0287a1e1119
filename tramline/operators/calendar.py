"""Service days of a timetable.

calendar: service_id, monday..sunday (0/1), start_date, end_date (YYYYMMDD text).
exceptions: service_id, date (YYYYMMDD text), exception_type (1 adds, 2 removes), row (file order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import service_date

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MAX_SPAN_DAYS = 36_600  # fixed limit of a calendar row


def calendar_spans(calendar: DataFrame) -> DataFrame:
    """calendar with start, end as dates and problem: null, bad-date, end-before-start or span-too-long."""
    c = calendar.withColumn("start", service_date(F.col("start_date"))).withColumn("end", service_date(F.col("end_date")))
    problem = F.when(F.col("start").isNull() | F.col("end").isNull(), "bad-date").when(F.col("end") < F.col("start"), "end-before-start").when(F.datediff("end", "start") > MAX_SPAN_DAYS, "span-too-long")
    return c.withColumn("problem", problem)


def weekday_dates(calendar: DataFrame) -> DataFrame:
    """(service_id, date) for each flagged weekday of each sound row; a row of the calendar counts by itself."""
    good = calendar_spans(calendar).filter("problem is null")
    each = good.withColumn("date", F.explode(F.sequence("start", "end")))
    return each.filter(F.get(F.array(*DAYS), F.weekday("date")) == 1).select("service_id", "date")


def last_exceptions(exceptions: DataFrame) -> DataFrame:
    """The exception that decides on (service_id, date): the last in file order of types 1 and 2."""
    e = exceptions.withColumn("date", service_date(F.col("date"))).filter("date is not null and exception_type in (1, 2)")
    last = e.groupBy("service_id", "date").agg(F.max_by("exception_type", "row").alias("exception_type"))
    return last


def active_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Distinct (service_id, date) on which a service runs; a date can be added to a service without calendar row."""
    last = last_exceptions(exceptions)
    removed = last.filter("exception_type = 2").select("service_id", "date")
    added = last.filter("exception_type = 1").select("service_id", "date")
    return weekday_dates(calendar).join(removed, ["service_id", "date"], "left_anti").unionByName(added).distinct()


def all_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Distinct dates of services with a calendar row, and dates any exception adds."""
    of_calendar = active_dates(calendar, exceptions).join(calendar.select("service_id").distinct(), "service_id", "left_semi").select("date")
    added = exceptions.filter("exception_type = 1").select(service_date(F.col("date")).alias("date")).filter("date is not null")
    return of_calendar.unionByName(added).distinct()


def trip_weights(trips: DataFrame, frequencies: DataFrame) -> DataFrame:
    """trip_id, service_id, weight: 1 plus the whole headways of its frequency rows."""
    runs = frequencies.filter("headway_secs > 0").groupBy("trip_id").agg(F.sum(F.expr("(end_time - start_time) div headway_secs")).alias("runs"))
    return trips.filter("service_id is not null").join(runs, "trip_id", "left").select("trip_id", "service_id", (1 + F.coalesce("runs", F.lit(0))).alias("weight"))


def trips_by_date(trips: DataFrame, frequencies: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """date, trips: weighted trips. Weights are summed by service before dates multiply the rows."""
    by_service = trip_weights(trips, frequencies).groupBy("service_id").agg(F.sum("weight").alias("weight"))
    return active_dates(calendar, exceptions).join(by_service, "service_id").groupBy("date").agg(F.sum("weight").alias("trips"))


def services_by_date(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """date, services: calendar rows whose service runs that day."""
    rows = calendar.groupBy("service_id").agg(F.count("*").alias("n"))
    return active_dates(calendar, exceptions).join(rows, "service_id").groupBy("date").agg(F.sum("n").alias("services"))


def earliest_maximum(counts: DataFrame, value: str) -> DataFrame:
    """The row of the largest value, of the earliest date among equals; a top-1, so no global sort."""
    return counts.orderBy(F.desc(value), "date").limit(1)


def select_dates(kind: str, trips: DataFrame, frequencies: DataFrame, calendar: DataFrame, exceptions: DataFrame, explicit: str | None = None) -> DataFrame:
    """date rows chosen by kind: all, most_trips (else most_services), most_services or explicit."""
    if kind == "all":
        return all_dates(calendar, exceptions)
    if kind == "explicit":
        if not explicit:
            raise ValueError("an explicit service date is needed")
        return calendar.sparkSession.range(1).select(service_date(F.lit(explicit)).alias("date")).filter("date is not null")
    services = services_by_date(calendar, exceptions)
    if kind == "most_services":
        return earliest_maximum(services, "services").select("date")
    if kind != "most_trips":
        raise ValueError(f"unknown date selection: {kind}")
    both = trips_by_date(trips, frequencies, calendar, exceptions).select("date", F.lit(1).alias("first"), F.col("trips").alias("n"))
    both = both.unionByName(services.select("date", F.lit(0).alias("first"), F.col("services").alias("n")))
    return both.orderBy(F.desc("first"), F.desc("n"), "date").limit(1).select("date")


def rank_dates(counts: DataFrame, value: str) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc(value), "date")))

"""Registered queries that write the files of a scenario, a feed or a map, and read them back as tables.

The oracle is the relation that went in: what a reader returns has to equal it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facilities as places
from ..operators.staging import scratch
from ..sinks import xml_files as sinks
from ..sources import lane_files, roadmap, scenario_xml, timetable_csv
from ..streaming import events, persons
from . import build
from .queries import ORACLE, QUERIES, joined, links, query


def text(c: str) -> Column:
    return F.col(c).cast("string")


def number(c: str) -> Column:
    return F.col(c).cast("double")


def folder_for(df: DataFrame) -> str:
    return scratch(df.sparkSession, "files")


def bag(**values: tuple[str, Column]) -> Column:
    """An attribute bag of name=(class, value)."""
    entries = [F.struct(F.lit(k).alias("key"), F.struct(F.lit(cls).alias("cls"), v.cast("string").alias("val")).alias("value")) for k, (cls, v) in values.items()]
    return F.map_from_entries(F.array(*entries))


def attribute(name: str) -> Column:
    return F.col("attrs")[name]


# --- network -------------------------------------------------------------------------------------------


def network_tables(r) -> dict[str, DataFrame]:
    n = r("customer").select(text("c_custkey").alias("node_id"), number("c_nationkey").alias("x"), number("c_custkey").alias("y"), bag(name=("java.lang.String", F.concat(F.lit('<&"> '), "c_name")), balance=("java.lang.Double", F.col("c_acctbal"))).alias("attrs"))
    k = links(r).select(text("link_id").alias("link_id"), text("from_id").alias("from_id"), text("to_id").alias("to_id"), *(number(c).alias(c) for c in ("length", "capacity", "freespeed", "lanes")), "modes")
    return {"nodes": n, "links": k}


def written_network(r) -> tuple[SparkSession, str]:
    t = network_tables(r)
    path = f"{folder_for(t['nodes'])}/network.xml"
    sinks.network(t, path, cap_period="01:00:00", doctype='<!DOCTYPE network SYSTEM "network_v2.dtd">')
    return t["nodes"].sparkSession, path


@query("""+ m AS (SELECT priority, string_agg(mode, ',' ORDER BY mode) AS modes FROM {d_modes} GROUP BY 1)
  SELECT CAST(link_id AS VARCHAR) AS link_id, CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, CAST(length AS DOUBLE) AS length, CAST(capacity AS DOUBLE) AS capacity, CAST(freespeed AS DOUBLE) AS freespeed, CAST(lanes AS DOUBLE) AS lanes, COALESCE(modes, '') AS modes FROM {d_links} LEFT JOIN m USING (priority)""")
def network_round_trip(r):
    return scenario_xml.network(*written_network(r))["links"].select("link_id", "from_id", "to_id", "length", "capacity", "freespeed", "lanes", joined(F.col("modes")).alias("modes"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS node_id, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y, '<&\"> ' || c_name AS name, 'java.lang.Double' AS balance_class, CAST(c_acctbal AS DOUBLE) AS balance FROM customer")
def attributes_round_trip(r):
    n = scenario_xml.network(*written_network(r))["nodes"]
    return n.select("node_id", "x", "y", attribute("name")["val"].alias("name"), attribute("balance")["cls"].alias("balance_class"), attribute("balance")["val"].cast("double").alias("balance"))


# --- population, households, facilities, vehicles ----------------------------------------------------------


@query("""SELECT CAST(person_id AS VARCHAR) AS person_id, CAST(plan_idx AS INT) AS plan_idx, CAST(ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY pos) - 1 AS INT) AS pos, kind, CASE WHEN kind = 'leg' THEN mode END AS mode, CASE WHEN kind = 'activity' THEN 'type' || pos % 4 END AS act_type,
  CASE WHEN kind = 'activity' THEN CAST(pos * 60 AS DOUBLE) END AS start_time, person_id % 4 <> 0 AS selected, CASE WHEN kind = 'leg' AND pos % 2 = 0 THEN 'network' END AS route_type, CASE WHEN kind = 'leg' AND pos % 2 = 0 THEN 'l' || pos || ' m' || person_id END AS route FROM {d_elements}""")
def population_round_trip(r):
    spark, folder = written_population(r)
    got = scenario_xml.population(spark, f"{folder}/population.xml")
    out = got["elements"].join(got["plans"].select("person_id", "plan_idx", "selected"), ["person_id", "plan_idx"])
    return out.select("person_id", "plan_idx", "pos", "kind", "mode", "act_type", "start_time", "selected", F.col("route.route_type").alias("route_type"), F.array_join("route.links", " ").alias("route"))


def written_population(r) -> tuple[SparkSession, str]:
    e = r("d_elements").select(text("person_id").alias("person_id"), "plan_idx", "pos", "kind", "mode", F.concat(F.lit("type"), (F.col("pos") % 4).cast("string")).alias("act_type"), (F.col("pos") * 60).cast("double").alias("start_time"))
    none = F.lit(None)
    route = F.struct(F.lit("network").alias("route_type"), F.lit("a").alias("start_link"), F.lit("b").alias("end_link"), F.lit(90.0).alias("travel_time"), F.lit(7.5).alias("distance"), F.concat(F.lit("l"), text("pos"), F.lit(" m"), "person_id").alias("text"))
    e = e.withColumns({c: none.cast("string") for c in ("link_id", "facility_id")} | {c: none.cast("double") for c in ("x", "y", "end_time", "max_dur")}).withColumn("route", F.when(F.col("pos") % 2 == 0, route))
    plans = e.select("person_id", "plan_idx").distinct().withColumn("selected", F.col("person_id").cast("long") % 4 != 0)
    folder = folder_for(e)
    sinks.population({"persons": e.select("person_id").distinct(), "plans": plans, "elements": e}, f"{folder}/population.xml")
    return e.sparkSession, folder


@query("SELECT CAST(person_id AS VARCHAR) AS person_id, kind, COUNT(*) AS n, CAST(MAX(CASE WHEN kind = 'activity' THEN 0.0 END) AS DOUBLE) AS x FROM {d_elements} GROUP BY 1, 2")
def persons_stream(r):
    """Each batch of persons goes to a handler, which appends it to a table."""
    spark, folder = written_population(r)
    out = scratch(spark, "persons")
    q = persons.dispatch(persons.stream(spark, folder), lambda df: df.select("person_id", "kind", "x").write.mode("append").parquet(f"{out}/rows"), f"{out}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("person_id", "kind").agg(F.count("*").alias("n"), F.max("x").alias("x"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS household_id, CAST(c_nationkey * 1000 AS VARCHAR) AS income, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS pos, CAST(c_custkey AS VARCHAR) AS person_id FROM customer")
def households_round_trip(r):
    c = r("customer").select(text("c_nationkey").alias("household_id"), F.col("c_custkey").alias("pos"), text("c_custkey").alias("person_id"))
    h = c.select("household_id").distinct().withColumn("income", (F.col("household_id").cast("long") * 1000).cast("string"))
    path = f"{folder_for(c)}/households.xml"
    sinks.households({"households": h, "household_members": c}, path)
    got = scenario_xml.households(c.sparkSession, path)
    return got["household_members"].join(got["households"], "household_id").select("household_id", "income", "pos", "person_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS facility_id, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y, CASE WHEN c_custkey % 3 = 0 THEN 'l' || c_custkey END AS link_id, c_name AS description, lower(c_mktsegment) AS type, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS capacity FROM customer")
def facilities_round_trip(r):
    c = r("customer")
    f = c.select(text("c_custkey").alias("facility_id"), number("c_nationkey").alias("x"), number("c_custkey").alias("y"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("l"), text("c_custkey"))).alias("link_id"), F.col("c_name").alias("description"))
    a = c.select(text("c_custkey").alias("facility_id"), F.lower("c_mktsegment").alias("type"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 90).cast("double")).alias("capacity"))
    path = f"{folder_for(c)}/facilities.xml"
    sinks.facilities({"facilities": f, "facility_activities": a}, path)
    got = scenario_xml.facilities(c.sparkSession, path)
    return got["facilities"].join(got["facility_activities"], "facility_id").select("facility_id", "x", "y", "link_id", "description", "type", "capacity")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS vehicle_id, n_name AS type_id, CAST(n_nationkey + 4 AS INT) AS seats, CAST(n_nationkey % 7 AS INT) AS standing, CAST(n_nationkey / 2.0 AS DOUBLE) AS length, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2.5 ELSE 1.0 END AS DOUBLE) AS access_time FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def vehicles_round_trip(r):
    n = F.col("n_nationkey")
    types = r("nation").select(F.col("n_name").alias("type_id"), (n + 4).cast("int").alias("seats"), (n % 7).cast("int").alias("standing"), (n / 2.0).alias("length"), F.when(n % 2 == 0, 2.5).alias("access_time"))
    own = r("supplier").join(r("nation"), F.col("s_nationkey") == n).select(text("s_suppkey").alias("vehicle_id"), F.col("n_name").alias("type_id"))
    path = f"{folder_for(types)}/vehicles.xml"
    sinks.vehicles({"vehicle_types": types, "vehicles": own}, path, namespace=' xmlns="http://example.org/vehicles"')
    got = scenario_xml.vehicles(types.sparkSession, path)
    return got["vehicles"].join(got["vehicle_types"], "type_id").select("vehicle_id", "type_id", "seats", "standing", "length", "access_time")


# --- schedule ----------------------------------------------------------------------------------------------


def written_schedule(r) -> dict[str, DataFrame]:
    s, o = r("supplier"), r("d_trips")
    line, route = F.concat(F.lit("line"), text("s_nationkey")), F.concat(F.lit("R"), text("s_nationkey"))
    rank = F.col("s_suppkey")
    stops = s.select(text("s_suppkey").alias("stop_id"), number("s_nationkey").alias("x"), number("s_suppkey").alias("y"), F.when(rank % 4 != 0, F.concat(F.lit("l"), text("s_suppkey"))).alias("link_id"), F.col("s_name").alias("name"), (rank % 2 == 0).alias("blocking"))
    calls = s.select(line.alias("line_id"), route.alias("route_id"), rank.alias("pos"), text("s_suppkey").alias("stop_id"), (rank * 60).cast("double").alias("arrival_offset"), (rank * 60 + 30).cast("double").alias("departure_offset"), (rank % 3 == 0).alias("await"))
    routes = r("nation").select(F.concat(F.lit("line"), text("n_nationkey")).alias("line_id"), F.concat(F.lit("R"), text("n_nationkey")).alias("route_id"), F.lower("n_name").alias("mode"))
    chain = s.select(line.alias("line_id"), route.alias("route_id"), rank.alias("pos"), F.concat(F.lit("l"), text("s_suppkey")).alias("link_id"))
    deps = o.select(F.concat(F.lit("line"), F.substring("route_id", 2, 9)).alias("line_id"), "route_id", F.col("trip_id").alias("departure_id"), (F.col("k") % 86400).cast("double").alias("departure_time"), F.concat(F.lit("v"), "trip_id").alias("vehicle_id"))
    names = r("nation").select(F.concat(F.lit("line"), text("n_nationkey")).alias("line_id"), F.col("n_name").alias("name"))
    path = f"{folder_for(s)}/schedule.xml"
    sinks.schedule({"stop_facilities": stops, "lines": names, "routes": routes, "route_stops": calls, "route_links": chain, "departures": deps}, path)
    return scenario_xml.schedule(s.sparkSession, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, CAST(s_nationkey AS DOUBLE) AS x, CAST(s_suppkey AS DOUBLE) AS y, CASE WHEN s_suppkey % 4 <> 0 THEN 'l' || s_suppkey END AS link_id, s_name AS name, s_suppkey % 2 = 0 AS blocking FROM supplier")
def schedule_stops_round_trip(r):
    return written_schedule(r)["stop_facilities"].drop("area_id", "attrs")


@query("SELECT 'line' || s_nationkey AS line_id, n_name AS name, 'R' || s_nationkey AS route_id, lower(n_name) AS mode, CAST(ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos, CAST(s_suppkey AS VARCHAR) AS stop_id, CAST(s_suppkey * 60 AS DOUBLE) AS arrival_offset, CAST(s_suppkey * 60 + 30 AS DOUBLE) AS departure_offset, s_suppkey % 3 = 0 AS waits, 'l' || s_suppkey AS link_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def schedule_profiles_round_trip(r):
    t = written_schedule(r)
    key = ["line_id", "route_id"]
    return t["route_stops"].withColumnRenamed("await", "waits").join(t["route_links"], [*key, "pos"]).join(t["routes"].drop("description"), key).join(t["lines"], "line_id")


@query("SELECT 'line' || substr(route_id, 2) AS line_id, route_id, trip_id AS departure_id, CAST(k % 86400 AS DOUBLE) AS departure_time, 'v' || trip_id AS vehicle_id FROM {d_trips}")
def schedule_departures_round_trip(r):
    return written_schedule(r)["departures"]


# --- lanes, config, signals ----------------------------------------------------------------------------------


def written_lanes(r) -> tuple[SparkSession, str]:
    k = r("orders").select(text("o_custkey").alias("link_id"), text("o_orderkey").alias("lane_id"), F.array(F.concat(F.lit("l"), text("o_orderkey")), F.lit("x")).alias("to_links"), (F.col("o_orderkey") % 1800).cast("string").alias("capacity"), (F.col("o_orderkey") % 3).cast("string").alias("alignment"))
    path = f"{folder_for(k)}/lanes.xml"
    sinks.lanes(k, path)
    return k.sparkSession, path


@query("SELECT CAST(o_custkey AS VARCHAR) AS link_id, CAST(o_orderkey AS VARCHAR) AS lane_id, 'l' || o_orderkey || ',x' AS to_links, CAST(o_orderkey % 1800 AS VARCHAR) AS capacity, CAST(o_orderkey % 3 AS VARCHAR) AS alignment FROM orders")
def lanes_round_trip(r):
    return scenario_xml.lanes(*written_lanes(r)).select("link_id", "lane_id", F.array_join("to_links", ",").alias("to_links"), "capacity", "alignment")


@query("SELECT 'v2.0' AS dialect, 'present' AS state, COUNT(*) AS lanes FROM orders")
def lane_dialect(r):
    got = lane_files.read(*written_lanes(r))
    return got["lanes"].agg(F.count("*").alias("lanes")).withColumn("dialect", F.lit(got["dialect"])).withColumn("state", F.lit(got["state"]))


@query("SELECT n_name AS module, CAST(CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 0 END AS INT) AS set_idx, CASE WHEN n_nationkey % 2 = 1 THEN 'set' END AS set_type, 'p' || r_regionkey AS name, 'v' || n_nationkey || '-' || r_regionkey AS value FROM nation, region")
def config_round_trip(r):
    odd = F.col("n_nationkey") % 2 == 1
    c = r("nation").crossJoin(F.broadcast(r("region"))).select(F.col("n_name").alias("module"), F.when(odd, 0).otherwise(-1).alias("set_idx"), F.when(odd, "set").alias("set_type"), F.concat(F.lit("p"), text("r_regionkey")).alias("name"), F.concat(F.lit("v"), text("n_nationkey"), F.lit("-"), text("r_regionkey")).alias("value"))  # 25 x 5 rows
    path = f"{folder_for(c)}/config.xml"
    sinks.config(c, path)
    return scenario_xml.config(c.sparkSession, path)


def signal_tables(r) -> dict[str, DataFrame]:
    k, s = F.col("s_suppkey"), r("supplier")
    system = text("s_nationkey").alias("system_id")
    plans = r("nation").select(text("n_nationkey").alias("system_id"), F.lit(0).alias("plan_idx"), F.concat(F.lit("plan"), text("n_nationkey")).alias("plan_id"), (F.col("n_nationkey") + 60).cast("int").alias("cycle"), (F.col("n_nationkey") % 5).cast("int").alias("offset"))
    return {
        "signals": s.select(system, text("s_suppkey").alias("signal_id"), F.concat(F.lit("l"), text("s_suppkey")).alias("link_id"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("lane_refs"), F.when(k % 3 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("to_links")),
        "groups": s.select(system, F.concat(F.lit("g"), (k % 3).cast("string")).alias("group_id"), text("s_suppkey").alias("signal_id")),
        "control": r("nation").select(text("n_nationkey").alias("system_id"), F.lit(True).alias("has_controller"), F.lit("own<controller>").alias("controller")),
        "plans": plans, "settings": s.select(system, F.lit(0).alias("plan_idx"), text("s_suppkey").alias("group_id"), (k % 30).cast("int").alias("onset"), (k % 30 + 20).cast("int").alias("dropping")),
        "amber": s.select(system, text("s_suppkey").alias("signal_id"), F.when(k % 2 == 0, 1).cast("int").alias("red_amber"), F.lit(3).alias("amber")),
        "intergreen": s.select(system, F.concat(F.lit("e"), (k % 2).cast("string")).alias("ending"), text("s_suppkey").alias("beginning"), (k % 9).cast("int").alias("sec")),
    }


def written_signals(r) -> dict[str, DataFrame]:
    t = signal_tables(r)
    folder = folder_for(t["signals"])
    sinks.signals(t, folder)
    return scenario_xml.signals(t["signals"].sparkSession, *(f"{folder}/{n}.xml" for n in ("systems", "groups", "control", "amber", "intergreen")))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS system_id, CAST(s_suppkey AS VARCHAR) AS signal_id, 'l' || s_suppkey AS link_id, CASE WHEN s_suppkey % 2 = 0 THEN 'a,b' ELSE '' END AS lane_refs, CASE WHEN s_suppkey % 3 = 0 THEN 't' ELSE '' END AS to_links FROM supplier")
def signal_systems_round_trip(r):
    return written_signals(r)["signals"].select("system_id", "signal_id", "link_id", F.array_join("lane_refs", ",").alias("lane_refs"), F.array_join("to_links", ",").alias("to_links"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS system_id, 'g' || s_suppkey % 3 AS group_id, CAST(s_suppkey AS VARCHAR) AS signal_id FROM supplier")
def signal_groups_round_trip(r):
    return written_signals(r)["groups"]


@query("SELECT CAST(s_nationkey AS VARCHAR) AS system_id, 'own<controller>' AS controller, 'plan' || s_nationkey AS plan_id, CAST(s_nationkey + 60 AS INT) AS cycle, CAST(s_nationkey % 5 AS INT) AS \"offset\", CAST(s_suppkey AS VARCHAR) AS group_id, CAST(s_suppkey % 30 AS INT) AS onset, CAST(s_suppkey % 30 + 20 AS INT) AS dropping FROM supplier")
def signal_control_round_trip(r):
    t = written_signals(r)
    return t["settings"].join(t["plans"], ["system_id", "plan_idx"]).join(t["control"], "system_id").select("system_id", "controller", "plan_id", "cycle", "offset", "group_id", "onset", "dropping")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS system_id, CAST(s_suppkey AS VARCHAR) AS signal_id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 END AS INT) AS red_amber, 3 AS amber FROM supplier")
def signal_amber_round_trip(r):
    return written_signals(r)["amber"]


@query("SELECT CAST(s_nationkey AS VARCHAR) AS system_id, 'e' || s_suppkey % 2 AS ending, CAST(s_suppkey AS VARCHAR) AS beginning, CAST(s_suppkey % 9 AS INT) AS sec FROM supplier")
def signal_intergreen_round_trip(r):
    return written_signals(r)["intergreen"]


@query("SELECT 'links' AS what, COUNT(*) AS n FROM {d_links} UNION ALL SELECT 'nodes', COUNT(*) FROM customer UNION ALL SELECT 'household_members', COUNT(*) FROM customer UNION ALL SELECT 'config', 3")
def scenario_round_trip(r):
    c = r("customer").select(text("c_nationkey").alias("household_id"), F.col("c_custkey").alias("pos"), text("c_custkey").alias("person_id"))
    t = network_tables(r) | {"household_members": c, "households": c.select("household_id").distinct().withColumn("income", F.lit("1"))}
    folder, spark = folder_for(c), c.sparkSession
    t["config"] = spark.createDataFrame([("global", -1, None, "seed", "7"), ("network", -1, None, "inputNetworkFile", "other.xml")], "module string, set_idx int, set_type string, name string, value string")
    sinks.scenario(t, folder)
    got = scenario_xml.scenario(spark, f"{folder}/config.xml")
    out = None
    for name in ("links", "nodes", "household_members", "config"):
        row = got[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- events -------------------------------------------------------------------------------------------------


def written_events(r) -> tuple[SparkSession, str]:
    """The event table as a compressed log."""
    e = r("d_events")
    text_of = sinks.element("event", {"time": F.col("time"), "type": F.when(F.col("type") == "click", "entered link").otherwise(F.col("type")), "person": F.col("person"), "link": F.col("link")})
    folder = folder_for(e)
    sinks.write_file(f"{folder}/events.xml.gz", "events", [sinks.lines(e, ["time", "event_id"], text_of)])
    return e.sparkSession, folder


@query("SELECT CAST(time AS DOUBLE) AS time, CASE WHEN type = 'click' THEN 'entered_link' ELSE type END AS type, CAST(person AS VARCHAR) AS person_id, CAST(link AS VARCHAR) AS link_id FROM {d_events}")
def events_scan(r):
    return scenario_xml.events(*written_events(r)).select("time", "type", "person_id", "link_id")


@query("SELECT CASE WHEN type = 'click' THEN 'entered_link' ELSE type END AS type, COUNT(*) AS n FROM {d_events} GROUP BY 1")
def events_xml_stream(r):
    spark, path = written_events(r)
    out = scratch(spark, "stream")
    q = events.typed_stream(events.stream(spark, path), f"{out}/rows", f"{out}/checkpoint")
    q.awaitTermination()
    return events.counts(spark.read.parquet(f"{out}/rows"))


def events_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, appended in one availableNow run, then counted by type."""
    batch, out = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "stream")
    live = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("event_type").alias("type"))
    events.typed_stream(live, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return events.counts(spark.read.parquet(f"{out}/rows"))


QUERIES["events_stream_counts"] = events_stream_counts
ORACLE["events_stream_counts"] = ORACLE["event_type_counts"]


@query("SELECT CAST(time // 900 * 900 AS BIGINT) AS start, type, COUNT(*) AS n FROM {d_events} GROUP BY 1, 2")
def event_windows(r):
    out = events.windowed_counts(r("d_events").select(F.col("time").cast("double").alias("time"), "type"))
    return out.select(F.col("window.start").cast("timestamp").cast("long").alias("start"), "type", "n")


# --- feeds, maps, stops ------------------------------------------------------------------------------------


def written_feed(r) -> dict[str, DataFrame]:
    """Stops, routes and trips as a feed's text files: quotes, commas and line breaks inside names."""
    s = r("supplier").select(text("s_suppkey").alias("stop_id"), F.concat(F.lit('"'), "s_name", F.lit('", a\nb')).alias("stop_name"), F.concat(F.lit(" "), (F.col("s_suppkey") / 100.0).cast("string")).alias("stop_lat"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise((F.col("s_nationkey") / 10.0).cast("string")).alias("stop_lon"), F.when(F.col("s_suppkey") % 3 == 0, "1").otherwise("").alias("location_type"))
    folder = folder_for(s)
    files = {"stops": s, "stop_times": r("d_calls").select("trip_id", "stop_id", "stop_sequence", F.format_string("%d:%02d:%02d", 20 + F.col("q") % 9, F.col("q"), F.col("q") % 60).alias("arrival_time"), F.lit("").alias("departure_time"))}
    for name, df in files.items():
        df.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.txt")
    return timetable_csv.feed(s.sparkSession, folder)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, '"' || s_name || '", a' || chr(10) || 'b' AS stop_name, CAST(s_suppkey / 100.0 AS DOUBLE) AS stop_lat, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE CAST(s_nationkey / 10.0 AS DOUBLE) END AS stop_lon, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS location_type FROM supplier""")
def feed_stops(r):
    return written_feed(r)["stops"].select("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type")


@query("SELECT trip_id, stop_id, stop_sequence, CAST((20 + q % 9) * 3600 + q * 60 + q % 60 AS INT) AS arrival, CAST(NULL AS INT) AS departure, 1 AS timepoint FROM {d_calls}")
def feed_stop_times(r):
    return written_feed(r)["stop_times"].select("trip_id", "stop_id", "stop_sequence", "arrival", "departure", "timepoint")


def written_map(r) -> tuple[SparkSession, str]:
    """d_nodes, d_refs and d_tags as a map file, with a relation for each nation."""
    n = r("d_nodes").select(text("node_id").alias("id"), (F.col("x") / 1000).alias("lon"), (F.col("y") / 1000).alias("lat"), F.when(F.col("node_id") % 4 == 0, F.concat(F.lit('<tag k="amenity" v="school"/><tag k="name" v="n'), text("node_id"), F.lit('"/>'))).alias("tags"))
    refs = r("d_refs").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("refs"))
    w = refs.join(r("d_tags").select("way_id", "highway"), "way_id", "left")
    nd = sinks.each(F.col("refs"), lambda p: sinks.element("nd", {"ref": p["node_id"]}))
    kind = F.coalesce(F.concat(F.lit('<tag k="highway" v="'), "highway", F.lit('"/>')), F.lit(""))
    path = f"{folder_for(n)}/map.osm"
    nodes = sinks.lines(n, ["id"], sinks.element("node", {"id": F.col("id"), "lat": F.col("lat"), "lon": F.col("lon")}, F.col("tags")))
    ways = sinks.lines(w.withColumn("id", text("way_id")), ["id"], sinks.element("way", {"id": F.col("id")}, nd, kind))
    member = sinks.element("member", {"type": F.lit("way"), "ref": F.col("n_nationkey") * 4, "role": F.lit("from")})
    relations = sinks.lines(r("nation").withColumn("id", text("n_nationkey")), ["id"], sinks.element("relation", {"id": F.col("id")}, member, F.lit('<tag k="type" v="restriction"/>')))
    sinks.write_file(path, "osm", [nodes, ways, relations])
    return n.sparkSession, path


@query("+ f AS (SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS refs FROM {d_refs} GROUP BY 1) SELECT CAST(f.way_id AS VARCHAR) AS way_id, refs, highway FROM f LEFT JOIN {d_tags} t ON t.way_id = f.way_id")
def map_ways(r):
    return roadmap.read(*written_map(r))["ways"].select("way_id", F.array_join("refs", ",").alias("refs"), F.col("tags")["highway"].alias("highway"))


@query("SELECT CAST(node_id AS VARCHAR) AS node_id, CAST(x / 1000.0 AS DOUBLE) AS lon, CAST(y / 1000.0 AS DOUBLE) AS lat, CASE WHEN node_id % 4 = 0 THEN 'school' END AS amenity FROM {d_nodes}")
def map_nodes(r):
    return roadmap.read(*written_map(r))["nodes"].select("node_id", "lon", "lat", F.col("tags")["amenity"].alias("amenity"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS relation_id, CAST(n_nationkey * 4 AS VARCHAR) AS ref, 'from' AS role, 'restriction' AS kind FROM nation")
def map_relations(r):
    t = roadmap.read(*written_map(r))
    return t["members"].join(t["relations"], "relation_id").select("relation_id", "ref", "role", F.col("tags")["type"].alias("kind"))


@query("SELECT 'n' || node_id AS facility_id, 'n' || node_id AS description, 'education' AS type FROM {d_nodes} WHERE node_id % 4 = 0")
def map_facilities(r):
    t = roadmap.read(*written_map(r))
    got = places.from_map(t["nodes"], t["ways"], lambda lon, lat: (lon, lat))
    return got["facilities"].join(got["facility_activities"], "facility_id").select("facility_id", "description", "type")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS name, CAST(s_nationkey / 10.0 AS DOUBLE) AS lon, CAST(s_suppkey / 100.0 AS DOUBLE) AS lat FROM supplier")
def geojson_round_trip(r):
    s = r("supplier").select(text("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"), (F.col("s_nationkey") / 10.0).alias("lon"), (F.col("s_suppkey") / 100.0).alias("lat"))
    path = f"{folder_for(s)}/stops.geojson"
    sinks.geojson(s, path)
    point = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<stop_id:string,name:string>>"
    f = s.sparkSession.read.schema(f"features array<{point}>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.stop_id", "f.properties.name", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("SELECT 's.xml' AS systems, CAST(NULL AS VARCHAR) AS \"groups\", 'c2.xml' AS control, CAST(NULL AS VARCHAR) AS amber, CAST(NULL AS VARCHAR) AS intergreen, CAST(NULL AS VARCHAR) AS handler, '7' AS \"offset\"")
def signal_config(r):
    spark = r("nation").sparkSession
    rows = spark.createDataFrame([("signals", -1, None, "signalSystemsPath", "s.xml"), ("signals", -1, None, "signalControlPath", "c.xml"), ("signals", -1, None, "handler", "h"), ("other", -1, None, "offset", "9")], "module string, set_idx int, set_type string, name string, value string")
    return scenario_xml.signal_config(scenario_xml.with_signal_config(rows, control="c2.xml", handler=None, offset="7"))


@query("SELECT * FROM (VALUES ('osm:source', 'map'), ('osm:license', 'open <1>'), ('osm:attribution', 'a & b'), ('osm:input', 'x.osm'), ('osm:targetCrs', 'EPSG:3857'), ('osm:geometryMode', 'contracted'), ('osm:rawTagsKept', 'false'), ('osm:importedAt', '2024-01-01T00:00:00Z')) AS t(name, val)")
def network_provenance(r):
    t, about = network_tables(r), build.provenance("map", "open <1>", "a & b", "x.osm", "EPSG:3857", "contracted", False, "2024-01-01T00:00:00Z")
    path = f"{folder_for(t['nodes'])}/network.xml"
    sinks.network(t, path, about=about)
    return scenario_xml.network_attributes(t["nodes"].sparkSession, path).select("name", "val")


@query("SELECT 'lanes.cycle' AS code, 'l' || s_suppkey || '/' || k AS object_id FROM supplier, (VALUES ('1'), ('2')) AS t(k) WHERE s_suppkey % 3 = 0")
def lane_file_cycles(r):
    """Lanes of two links that lead into each other, for every third supplier; else into a lane that leads on."""
    k, n = F.col("s_suppkey"), text("s_suppkey")
    lane = lambda i, to: F.struct(F.lit(str(i)).alias("lane_id"), to.alias("to_lanes"), F.lit(i).alias("lane_index"))
    none = F.array().cast("array<string>")
    pairs = F.array(lane(1, F.array(F.lit("2"))), lane(2, F.when(k % 3 == 0, F.array(F.lit("1"))).otherwise(F.array(F.lit("3")))), lane(3, none))
    rows = r("supplier").select(F.concat(F.lit("l"), n).alias("link_id"), F.explode(pairs).alias("x")).select("link_id", "x.*", F.lit("900").alias("capacity"))
    rows = rows.withColumn("to_links", F.when(F.size("to_lanes") == 0, F.array(F.lit("l1"))).otherwise(none))
    path = f"{folder_for(rows)}/lanes.xml"
    sinks.lanes(rows, path)
    got = lane_files.read(rows.sparkSession, path)
    return got["issues"].filter("code = 'lanes.cycle'").select("code", "object_id")


@query("SELECT feed || ':T' || k AS trip, feed || ':R' || k % 3 AS line_id, CAST(28800 + k * 60 AS INT) AS departure_time FROM (VALUES ('a_b'), ('a_b-2')) AS f(feed), (SELECT n_nationkey AS k FROM nation) AS n")
def feeds_schedule(r):
    """Two feeds of one name: trips of 25 on three lines, every day of January."""
    n, k = r("nation"), F.col("n_nationkey")
    spark, paths = n.sparkSession, []
    for at in ("x", "y"):
        folder = f"{folder_for(n)}/{at}/a b"
        paths.append(folder)
        trip = F.concat(F.lit("T"), text("n_nationkey"))
        clock = lambda s: F.format_string("%02d:%02d:00", F.floor(s / 60).cast("int"), (s % 60).cast("int"))
        calls = n.select(trip.alias("trip_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("stop_sequence"), (k + 480).alias("m"))
        calls = calls.select("trip_id", F.concat(F.lit("S"), text("stop_sequence")).alias("stop_id"), "stop_sequence", clock(F.col("m") + F.col("stop_sequence")).alias("arrival_time"), clock(F.col("m") + F.col("stop_sequence")).alias("departure_time"))
        files = {
            "trips": n.select(trip.alias("trip_id"), F.concat(F.lit("R"), (k % 3).cast("string")).alias("route_id"), F.lit("D").alias("service_id")), "stop_times": calls,
            "routes": n.select(F.concat(F.lit("R"), (k % 3).cast("string")).alias("route_id"), F.lit("r").alias("route_short_name"), F.lit("3").alias("route_type")).distinct(),
            "stops": calls.select("stop_id", F.lit("1.5").alias("stop_lat"), F.lit("2.5").alias("stop_lon")).distinct(),
            "calendar": spark.createDataFrame([("D", *["1"] * 7, "20240101", "20240131")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string"),
        }
        for name, df in files.items():
            df.write.option("header", True).csv(f"{folder}/{name}.txt")
    got = build.feeds(spark, paths, "explicit", "20240110")["departures"]
    trip = F.regexp_extract("departure_id", "^([^:]*:[^:]*):", 1)
    return got.select(trip.alias("trip"), "line_id", "departure_time")

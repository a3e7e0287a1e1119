"""Registered queries over the driver's tables: each applies a library operator to derived relations.

ORACLE holds the same result in plain SQL; operators that SQL can't express have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, ids, tags, text, times
from ..operators import calendar, facilities, mapping, network, roads, spatial, timetable, validate
from ..streaming import events
from .derived import oracle, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register under the function's name. The function takes a getter of relations."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict = {}
            return fn(lambda name: relation(spark, sf_dir, name, made))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = oracle(sql)
        return fn

    return add


# --- relations in the operators' shape ----------------------------------------------------------------


def exceptions(r) -> DataFrame:
    return r("d_exceptions").withColumnRenamed("seq_no", "row")


def stop_times(r) -> DataFrame:
    return r("d_stop_times").withColumnRenamed("seq_no", "row")


def links(r) -> DataFrame:
    """d_links with its modes; a priority without modes has none."""
    modes = r("d_modes").groupBy("priority").agg(F.array_sort(F.collect_list("mode")).alias("modes"))
    return r("d_links").join(F.broadcast(modes), "priority", "left").withColumn("modes", F.coalesce("modes", F.array().cast("array<string>")))  # four rows


def way_tags(r) -> DataFrame:
    """way_id, tags map of d_tags."""
    keys = {"highway": "highway", "railway": "railway", "route": "route", "access": "access", "bus": "bus", "psv": "psv", "motor_vehicle": "motor_vehicle", "oneway": "oneway", "junction": "junction", "maxspeed": "maxspeed", "lanes": "lanes", "lanes:forward": "lanes_forward", "lanes:backward": "lanes_backward", "lanes:both_ways": "lanes_both", "turn:lanes": "turn_lanes"}
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in keys.items())), lambda p: p["v"].isNotNull())
    return r("d_tags").select("way_id", F.map_from_entries(pairs).alias("tags"))


def joined(c):
    return F.array_join(c, ",")


# --- service days --------------------------------------------------------------------------------------

ACTIVE = """+ days AS (SELECT service_id, CAST(d AS DATE) AS date FROM (SELECT *, UNNEST(generate_series(strptime(start_date, '%Y%m%d'), strptime(end_date, '%Y%m%d'), INTERVAL 1 DAY)) AS d FROM {d_calendar} WHERE end_date >= start_date)
    WHERE CASE isodow(d) WHEN 1 THEN monday WHEN 2 THEN tuesday WHEN 3 THEN wednesday WHEN 4 THEN thursday WHEN 5 THEN friday WHEN 6 THEN saturday ELSE sunday END = 1),
  last AS (SELECT service_id, CAST(strptime(date, '%Y%m%d') AS DATE) AS date, arg_max(exception_type, seq_no) AS kind FROM {d_exceptions} GROUP BY ALL),
  active AS (SELECT * FROM days WHERE (service_id, date) NOT IN (SELECT service_id, date FROM last WHERE kind = 2) UNION SELECT service_id, date FROM last WHERE kind = 1) """
WEIGHTS = """, runs AS (SELECT trip_id, SUM((end_time - start_time) // headway_secs) AS runs FROM {d_frequencies} WHERE headway_secs > 0 AND end_time >= start_time GROUP BY 1),
  neg AS (SELECT trip_id, SUM(-((start_time - end_time) // headway_secs)) AS runs FROM {d_frequencies} WHERE headway_secs > 0 AND end_time < start_time GROUP BY 1),
  w AS (SELECT service_id, 1 + COALESCE(r.runs, 0) + COALESCE(n.runs, 0) AS weight FROM {d_trips} t LEFT JOIN runs r USING (trip_id) LEFT JOIN neg n USING (trip_id) WHERE service_id IS NOT NULL),
  per AS (SELECT date, CAST(SUM(weight) AS BIGINT) AS trips FROM active JOIN w USING (service_id) GROUP BY 1) """


@query(ACTIVE + "SELECT service_id, date FROM active")
def service_active_dates(r):
    return calendar.active_dates(r("d_calendar"), exceptions(r))


@query(ACTIVE + WEIGHTS + "SELECT date, trips FROM per ORDER BY trips DESC, date LIMIT 1")
def service_day_most_trips(r):
    return calendar.earliest_maximum(calendar.trips_by_date(r("d_trips"), r("d_frequencies"), r("d_calendar"), exceptions(r)), "trips")


@query(ACTIVE + WEIGHTS + "SELECT date, trips FROM per")
def service_trips_by_date(r):
    return calendar.trips_by_date(r("d_trips"), r("d_frequencies"), r("d_calendar"), exceptions(r))


@query(ACTIVE + ", c AS (SELECT date, COUNT(*) AS services FROM active JOIN {d_calendar} USING (service_id) GROUP BY 1) SELECT date, services FROM c ORDER BY services DESC, date LIMIT 1")
def service_day_most_services(r):
    return calendar.earliest_maximum(calendar.services_by_date(r("d_calendar"), exceptions(r)), "services")


@query(ACTIVE + "SELECT date FROM active WHERE service_id IN (SELECT service_id FROM {d_calendar}) UNION SELECT CAST(strptime(date, '%Y%m%d') AS DATE) FROM {d_exceptions} WHERE exception_type = 1")
def service_all_dates(r):
    return calendar.all_dates(r("d_calendar"), exceptions(r))


@query("SELECT service_id, start_date, CASE WHEN end_date < start_date THEN 'end-before-start' END AS problem FROM {d_calendar}")
def calendar_problems(r):
    return calendar.calendar_spans(r("d_calendar")).select("service_id", "start_date", "problem")


# --- departures, offsets, patterns --------------------------------------------------------------------

FIRST = """, f AS (SELECT trip_id, departure FROM {d_stop_times} WHERE stop_sequence = 1 AND departure IS NOT NULL),
  runs_on AS (SELECT t.trip_id, a.date, f.departure, strftime(a.date, '%Y%m%d') AS day FROM {d_trips} t JOIN f USING (trip_id) JOIN active a USING (service_id) WHERE a.date BETWEEN DATE '2024-03-01' AND DATE '2024-03-03'),
  often AS (SELECT trip_id, start_time, end_time, headway_secs FROM {d_frequencies} WHERE headway_secs > 0)"""


def three_days(r) -> DataFrame:
    return calendar.active_dates(r("d_calendar"), exceptions(r)).select("date").filter("date between date'2024-03-01' and date'2024-03-03'").distinct()


def all_departures(r) -> DataFrame:
    return timetable.departures(r("d_trips"), stop_times(r), r("d_frequencies"), calendar.active_dates(r("d_calendar"), exceptions(r)), three_days(r))


@query(ACTIVE + FIRST + "SELECT trip_id, date, 'feed:' || trip_id || ':' || day AS departure_id, departure AS departure_time FROM runs_on WHERE trip_id NOT IN (SELECT trip_id FROM often)")
def departures_scheduled(r):
    return all_departures(r).join(r("d_frequencies").filter("headway_secs > 0").select("trip_id").distinct(), "trip_id", "left_anti")


@query(ACTIVE + FIRST + """, each AS (SELECT trip_id, UNNEST(range(start_time, end_time, headway_secs)) AS t FROM often WHERE start_time < end_time)
  SELECT trip_id, date, 'feed:' || trip_id || ':' || day || ':' || printf('%02d%02d%02d', t // 3600, t % 3600 // 60, t % 60) AS departure_id, CAST(t AS INT) AS departure_time FROM runs_on JOIN each USING (trip_id)""")
def departures_frequency(r):
    return all_departures(r).join(r("d_frequencies").filter("headway_secs > 0").select("trip_id").distinct(), "trip_id", "left_semi")


@query("""+ n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY start_time, end_time, headway_secs, exact_times) AS i FROM {d_more_frequencies})
  SELECT a.trip_id, a.start_time AS a_start, a.end_time AS a_end, b.start_time AS b_start, b.end_time AS b_end FROM n a JOIN n b ON a.trip_id = b.trip_id AND a.i < b.i AND GREATEST(a.start_time, b.start_time) < LEAST(a.end_time, b.end_time)""")
def frequency_overlaps(r):
    return timetable.frequency_overlaps(r("d_more_frequencies"))


# timepoints by hand: anchors before and after, spread by position
OFFSETS = """+ s AS (SELECT *, stop_sequence - 1 AS pos, timepoint = 1 AS timed, FIRST_VALUE(departure) OVER w AS b0 FROM {d_stop_times} WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)),
  g AS (SELECT *, CAST(COALESCE(b0, 0) AS DOUBLE) AS base, SUM(CASE WHEN timed THEN 0 ELSE 1 END) OVER w AS stretch, SUM(CASE WHEN timed THEN 1 ELSE 0 END) OVER w AS run FROM s WINDOW w AS (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, LAST_VALUE(CASE WHEN timed THEN CAST(arrival AS DOUBLE) END IGNORE NULLS) OVER (PARTITION BY trip_id, stretch ORDER BY pos) AS carried FROM g),
  a AS (SELECT *, CASE WHEN timed AND carried IS NULL AND stretch > 0 THEN 0.0 WHEN timed THEN COALESCE(carried, base) END AS arr FROM k),
  d AS (SELECT *, CASE WHEN timed THEN COALESCE(CAST(departure AS DOUBLE), arr) END AS dep FROM a),
  n AS (SELECT *, COALESCE(LAST_VALUE(arr IGNORE NULLS) OVER b, base) AS pa, COALESCE(LAST_VALUE(dep IGNORE NULLS) OVER b, base) AS pd, FIRST_VALUE(arr IGNORE NULLS) OVER f AS na, FIRST_VALUE(dep IGNORE NULLS) OVER f AS nd,
    ROW_NUMBER() OVER (PARTITION BY trip_id, run, timed ORDER BY pos) / (COUNT(*) OVER (PARTITION BY trip_id, run, timed) + 1.0) AS frac FROM d
    WINDOW b AS (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  o AS (SELECT *, GREATEST(COALESCE(arr, pa + frac * (COALESCE(na, pa + 60) - pa)) - base, 0) AS ao, GREATEST(COALESCE(dep, pd + frac * (COALESCE(nd, pd + 60) - pd)) - base, 0) AS do_ FROM n),
  v AS (SELECT *, BOOL_OR(do_ < ao - 0.001) OVER (PARTITION BY trip_id) AS bad FROM o) """


@query(OFFSETS + """SELECT trip_id, CAST(pos AS INT) AS pos, stop_id, ROUND(CASE WHEN bad THEN COALESCE(arrival, base) - base ELSE ao END, 4) AS arrival_offset, ROUND(CASE WHEN bad THEN COALESCE(departure, base) - base ELSE do_ END, 4) AS departure_offset, NOT bad AS valid FROM v""")
def stop_offsets_interpolated(r):
    o = timetable.stop_offsets(stop_times(r))
    return o.select("trip_id", F.col("pos").cast("int").alias("pos"), "stop_id", F.round("arrival_offset", 4).alias("arrival_offset"), F.round("departure_offset", 4).alias("departure_offset"), "valid")


@query("""+ s AS (SELECT t.trip_id, t.route_id, t.direction_id, string_agg(c.stop_id, '|' ORDER BY c.stop_sequence) AS stops, string_agg(CAST(c.q % 4 AS VARCHAR), '|' ORDER BY c.stop_sequence) AS waits FROM {d_trips} t JOIN {d_calls} c USING (trip_id) GROUP BY ALL),
  g AS (SELECT route_id, direction_id, stops, waits, MIN(trip_id) AS first_trip FROM s GROUP BY ALL), n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY first_trip) - 1 AS pattern FROM g)
  SELECT s.trip_id, n.pattern, 'feed:' || s.route_id || '_r' || n.pattern AS pattern_route_id FROM s JOIN n USING (route_id, direction_id, stops, waits)""")
def route_patterns(r):
    """Patterns by stop list and the seconds waited at each, which stand for the offsets here."""
    o = r("d_calls").select("trip_id", (F.col("stop_sequence") - 1).alias("pos"), "stop_id", F.lit(0.0).alias("arrival_offset"), (F.col("q") % 4).cast("double").alias("departure_offset"))
    return timetable.trip_patterns(r("d_trips"), r("d_routes"), o).select("trip_id", F.col("pattern").cast("long").alias("pattern"), "pattern_route_id")


@query("""SELECT route_id, CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'subway' WHEN 2 THEN 'rail' WHEN 4 THEN 'ferry' WHEN 5 THEN 'cable_car' WHEN 6 THEN 'aerial_lift' WHEN 7 THEN 'funicular' WHEN 11 THEN 'trolleybus' ELSE 'pt' END AS mode,
  route_type IN (0, 1, 2, 3, 4, 5, 6, 7, 11, 12) AS known FROM {d_routes}""")
def gtfs_mode_map(r):
    return r("d_routes").select("route_id", tags.route_mode(F.col("route_type")).alias("mode"), F.col("route_type").isin(*tags.ROUTE_TYPES).alias("known"))


@query(ACTIVE + FIRST + """, m AS (SELECT t.trip_id, CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'subway' WHEN 2 THEN 'rail' WHEN 4 THEN 'ferry' WHEN 5 THEN 'cable_car' WHEN 6 THEN 'aerial_lift' WHEN 7 THEN 'funicular' WHEN 11 THEN 'trolleybus' ELSE 'pt' END AS mode FROM {d_trips} t JOIN {d_routes} USING (route_id)),
  d AS (SELECT trip_id FROM runs_on WHERE trip_id NOT IN (SELECT trip_id FROM often) UNION ALL SELECT trip_id FROM runs_on JOIN (SELECT trip_id FROM (SELECT trip_id, UNNEST(range(start_time, end_time, headway_secs)) AS t FROM often WHERE start_time < end_time)) USING (trip_id))
  SELECT mode AS type_id, CAST(CASE mode WHEN 'tram' THEN 60 WHEN 'subway' THEN 60 WHEN 'rail' THEN 300 WHEN 'ferry' THEN 200 WHEN 'funicular' THEN 40 ELSE 30 END AS INT) AS seats, CAST(CASE mode WHEN 'tram' THEN 90 WHEN 'subway' THEN 90 WHEN 'rail' THEN 120 WHEN 'ferry' THEN 100 WHEN 'funicular' THEN 40 ELSE 45 END AS INT) AS standing, COUNT(*) AS vehicles FROM d JOIN m USING (trip_id) GROUP BY 1, 2, 3""")
def vehicle_types_by_mode(r):
    patterns = r("d_trips").join(r("d_routes"), "route_id").select("trip_id", tags.route_mode(F.col("route_type")).alias("mode"))
    types, own = timetable.vehicles(all_departures(r), patterns)
    return types.join(own.groupBy("type_id").agg(F.count("*").alias("vehicles")), "type_id")


# --- network -------------------------------------------------------------------------------------------


@query("SELECT l.link_id, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y FROM {d_links} l JOIN {d_nodes} a ON l.from_id = a.node_id JOIN {d_nodes} b ON l.to_id = b.node_id")
def link_node_resolution(r):
    return network.resolve_ends(r("d_links"), r("d_nodes")).filter("has_from and has_to").select("link_id", "from_x", "from_y", "to_x", "to_y")


@query("SELECT l.link_id, l.to_id FROM {d_links} l WHERE l.to_id NOT IN (SELECT node_id FROM {d_nodes}) OR l.from_id NOT IN (SELECT node_id FROM {d_nodes})")
def missing_endpoints(r):
    return network.resolve_ends(r("d_links"), r("d_nodes")).filter("not has_from or not has_to").select("link_id", "to_id")


@query("""+ e AS (SELECT from_id AS node_id, 0 AS i, 1 AS o FROM {d_links} UNION ALL SELECT to_id, 1, 0 FROM {d_links})
  SELECT n.node_id, CAST(COALESCE(SUM(i), 0) AS BIGINT) AS n_in, CAST(COALESCE(SUM(o), 0) AS BIGINT) AS n_out, CAST(COALESCE(SUM(i + o), 0) AS BIGINT) AS n_all FROM {d_nodes} n LEFT JOIN e USING (node_id) GROUP BY 1""")
def node_degree(r):
    return network.degrees(r("d_nodes"), r("d_links"))


@query("SELECT node_id FROM {d_nodes} WHERE node_id NOT IN (SELECT from_id FROM {d_links}) AND node_id NOT IN (SELECT to_id FROM {d_links})")
def isolated_nodes(r):
    return network.degrees(r("d_nodes"), r("d_links")).filter("n_all = 0").select("node_id")


@query("""+ o AS (SELECT from_id AS node_id, string_agg(CAST(link_id AS VARCHAR), ',' ORDER BY link_id) AS out_links FROM {d_links} GROUP BY 1), i AS (SELECT to_id AS node_id, string_agg(CAST(link_id AS VARCHAR), ',' ORDER BY link_id) AS in_links FROM {d_links} GROUP BY 1)
  SELECT COALESCE(o.node_id, i.node_id) AS node_id, COALESCE(out_links, '') AS out_links, COALESCE(in_links, '') AS in_links FROM o FULL JOIN i ON o.node_id = i.node_id""")
def adjacency(r):
    return network.adjacency(r("d_links"))


NETWORK_ISSUES = """+ l AS (SELECT *, from_id IN (SELECT node_id FROM {d_nodes}) AS has_from, to_id IN (SELECT node_id FROM {d_nodes}) AS has_to, CAST(link_id AS VARCHAR) AS id FROM {d_links}),
  i AS (SELECT 'error' AS severity, 'nonpositive_length' AS code, id AS object_id FROM l WHERE length <= 0 UNION ALL SELECT 'error', 'nonpositive_freespeed', id FROM l WHERE freespeed <= 0 UNION ALL SELECT 'error', 'nonpositive_capacity', id FROM l WHERE capacity <= 0
    UNION ALL SELECT 'error', 'nonpositive_lanes', id FROM l WHERE lanes <= 0 UNION ALL SELECT 'error', 'link-missing-from-node', id FROM l WHERE NOT has_from UNION ALL SELECT 'error', 'link-missing-to-node', id FROM l WHERE NOT has_to
    UNION ALL SELECT 'warning', 'self_loop', id FROM l WHERE has_from AND has_to AND from_id = to_id UNION ALL SELECT 'warning', 'link_too_long', id FROM l WHERE length > 390
    UNION ALL SELECT 'info', 'isolated_node', CAST(node_id AS VARCHAR) FROM {d_nodes} WHERE node_id NOT IN (SELECT from_id FROM {d_links}) AND node_id NOT IN (SELECT to_id FROM {d_links})
    UNION ALL SELECT 'warning', 'missing_mode', NULL FROM (VALUES ('car'), ('tram'), ('ferry')) AS t(mode) WHERE mode NOT IN (SELECT mode FROM {d_modes})) """


def all_network_issues(r) -> DataFrame:
    return validate.network_issues(r("d_nodes"), links(r), max_length=390, required_modes=["car", "tram", "ferry"])


@query(NETWORK_ISSUES + "SELECT severity, code, object_id FROM i")
def network_issues(r):
    return all_network_issues(r).select("severity", "code", "object_id")


@query(NETWORK_ISSUES + "SELECT severity, COUNT(*) AS n FROM i GROUP BY 1")
def issue_severity_counts(r):
    return validate.severity_counts(all_network_issues(r))


@query("SELECT link_id FROM {d_links} WHERE from_id NOT IN (SELECT node_id FROM {d_nodes}) OR to_id NOT IN (SELECT node_id FROM {d_nodes}) OR length <= 0 OR priority NOT IN (SELECT priority FROM {d_modes})")
def invalid_links(r):
    return network.invalid_links(links(r).withColumn("length", F.col("length").cast("double")), r("d_nodes"))


@query("SELECT mode, COUNT(*) AS n FROM {d_links} JOIN {d_modes} USING (priority) GROUP BY 1")
def mode_explode_coverage(r):
    return links(r).select(F.explode("modes").alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query("""+ m AS (SELECT UNNEST(['car', 'bus', 'pt', 'tram', 'walk']) AS mode), a AS (SELECT link_id, priority, list(mode) FILTER (mode IS NOT NULL) AS modes FROM {d_links} LEFT JOIN {d_modes} USING (priority) GROUP BY 1, 2)
  SELECT mode, COUNT(*) AS n FROM a, m WHERE modes IS NULL OR list_contains(modes, mode) OR (mode = 'pt' AND (list_contains(modes, 'bus') OR list_contains(modes, 'rail'))) OR (list_contains(modes, 'pt') AND mode IN ('bus', 'tram')) GROUP BY 1""")
def mode_compatible_links(r):
    each = links(r).withColumn("mode", F.explode(F.array(*map(F.lit, ("car", "bus", "pt", "tram", "walk")))))
    return each.filter(tags.mode_compatible(F.col("modes"), F.col("mode"))).groupBy("mode").agg(F.count("*").alias("n"))


@query("SELECT priority, string_agg(mode, ',' ORDER BY mode) AS modes FROM (SELECT priority, mode FROM {d_modes} UNION SELECT priority, 'bus' FROM {d_modes} WHERE mode = 'car') GROUP BY 1")
def candidate_modes(r):
    m = r("d_modes").groupBy("priority").agg(F.array_sort(F.collect_list("mode")).alias("modes"))
    return m.select("priority", joined(tags.candidate_modes(F.col("modes"))).alias("modes"))


# --- graphs ---------------------------------------------------------------------------------------------

# a sparse graph of rings and tails: node k points to k + 1 in groups of 10, every third group closes
SPARSE = "SELECT a, b FROM (SELECT c_custkey AS a, CASE WHEN c_custkey % 10 < 9 THEN c_custkey + 1 WHEN c_custkey % 30 = 29 THEN c_custkey - 9 WHEN c_custkey % 7 = 0 THEN c_custkey - 4 END AS b FROM {customer}) AS t WHERE b IS NOT NULL AND b < (SELECT COUNT(*) FROM {customer})"


def sparse(r) -> DataFrame:
    c = r("customer")
    k, n = F.col("c_custkey"), c.count()
    b = F.when(k % 10 < 9, k + 1).when(k % 30 == 29, k - 9).when(k % 7 == 0, k - 4)
    return c.select(k.alias("a"), b.alias("b")).filter(F.col("b").isNotNull() & (F.col("b") < n))


@query(f"""+ e AS ({SPARSE}), reach(node, r) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT reach.node, CASE WHEN e.a = reach.r THEN e.b ELSE e.a END FROM reach JOIN e ON reach.r = e.a OR reach.r = e.b)
  SELECT node, MIN(r) AS component FROM reach GROUP BY 1""")
def weak_components(r):
    return network.weak_components(sparse(r))


@query(f"""+ e AS ({SPARSE}), reach(x, y) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a)
  SELECT p.x AS node, MIN(p.y) AS component FROM reach p JOIN reach q ON p.x = q.y AND p.y = q.x GROUP BY 1""")
def strong_components(r):
    return network.strong_components(sparse(r))


@query(f"""+ e AS ({SPARSE}), reach(x, y) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
  c AS (SELECT p.x AS node, MIN(p.y) AS component FROM reach p JOIN reach q ON p.x = q.y AND p.y = q.x GROUP BY 1), k AS (SELECT a.component, COUNT(*) AS n FROM e JOIN c a ON e.a = a.node JOIN c b ON e.b = b.node WHERE a.component = b.component GROUP BY 1),
  best AS (SELECT component FROM k ORDER BY n DESC, component LIMIT 1) SELECT e.a AS link_id FROM e JOIN c a ON e.a = a.node JOIN c b ON e.b = b.node WHERE a.component = b.component AND a.component = (SELECT component FROM best)""")
def largest_scc(r):
    return network.largest_strong_links(sparse(r).select(F.col("a").alias("link_id"), F.col("a").alias("from_id"), F.col("b").alias("to_id")))


# streets of 12 nodes; every fourth node of a street carries a signal, speeds change at one place
STREETS = "SELECT c_custkey AS k, c_custkey // 12 AS way, c_custkey % 12 AS idx, CASE WHEN c_custkey % 12 < 7 THEN 50 ELSE 30 END AS speed, (c_custkey * 37) % 90 + 10 AS length FROM {customer} WHERE c_custkey % 12 < 11 AND c_custkey + 1 < (SELECT COUNT(*) FROM {customer})"


def streets(r) -> tuple[DataFrame, DataFrame]:
    c = r("customer")
    k, n = F.col("c_custkey"), c.count()
    own = F.struct(F.array(F.lit("car")).alias("modes"), F.when(k % 12 < 7, 50.0).otherwise(30.0).alias("speed"), F.lit(1).alias("lanes"), F.lit("").alias("signature"), F.lit(True).alias("open"))
    name = lambda v: F.format_string("%08d", v)
    segs = c.filter((k % 12 < 11) & (k + 1 < n)).select(name(F.floor(k / 12)).alias("way_id"), (k % 12).cast("int").alias("idx"), name(k).alias("a"), name(k + 1).alias("b"), ((k * 37) % 90 + 10).cast("double").alias("length"), F.lit(600.0).alias("per_lane"), own.alias("fwd"), own.alias("bwd"))
    every = segs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    fixed = every.filter(F.col("node_id").cast("long") % 12 == 4)
    return segs, every.join(network.contractible_nodes(segs), "node_id", "left_anti").unionByName(fixed).distinct()


@query(f"+ s AS ({STREETS}) SELECT printf('%08d', p.k + 1) AS node_id FROM s p JOIN s q ON q.k = p.k + 1 AND q.way = p.way WHERE p.speed = q.speed")
def contractible_nodes(r):
    return network.contractible_nodes(streets(r)[0])


@query(f"""+ s AS ({STREETS}), t AS (SELECT *, SUM(CASE WHEN idx IN (0, 4, 7) THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY idx) AS g FROM s), c AS (SELECT way, g, MIN(k) AS a, MAX(k) + 1 AS b, SUM(length) AS length, COUNT(*) AS n, MIN(speed) AS speed FROM t GROUP BY 1, 2)
  SELECT 'sim_' || printf('%08d', way) || d || printf('%08d', a) || '_' || printf('%08d', b) AS link_id, CAST(length AS DOUBLE) AS length, CAST(speed AS DOUBLE) AS freespeed, CAST(n AS INT) AS n_segments FROM c, (VALUES ('_f_'), ('_r_')) AS t(d)""")
def contracted_links(r):
    segs, routing = streets(r)
    out = network.contracted_links(network.chains(segs, network.anchor_cycles(segs, routing)))
    return out.select("link_id", "length", "freespeed", "n_segments")


def short_pairs(r) -> DataFrame:
    e = sparse(r)
    k = F.col("a")
    return e.select(k.alias("from_link"), (k + 5).alias("to_link"), F.lit("car").alias("mode"))


def sparse_links(r) -> DataFrame:
    return sparse(r).select(F.col("a").alias("link_id"), F.col("a").alias("from_id"), F.col("b").alias("to_id"), (F.col("a") % 7 + 1).cast("double").alias("length"), F.array(F.lit("car")).alias("modes"))


WALK = f"""+ e AS ({SPARSE}), k AS (SELECT a AS link_id, a AS f, b AS t, a % 7 + 1 AS length FROM e), p AS (SELECT link_id AS s, link_id + 5 AS e FROM k WHERE link_id + 5 IN (SELECT link_id FROM k)),
  go(s, e, cur, node, cost, hops) AS (SELECT s, e, s, k.t, 0, 0 FROM p JOIN k ON k.link_id = p.s UNION ALL SELECT s, e, k.link_id, k.t, cost + k.length, hops + 1 FROM go JOIN k ON k.f = go.node WHERE hops < 12 AND cur <> e """


@query(WALK + ") SELECT s AS from_link, e AS to_link, CAST(MIN(cost) AS DOUBLE) AS cost FROM go WHERE cur = e AND cost <= 1000 GROUP BY 1, 2")
def bounded_shortest_paths(r):
    return mapping.paths(short_pairs(r), sparse_links(r)).select("from_link", "to_link", "cost")


@query(WALK + "AND NOT (cur % 10 = 2 AND cur % 3 = 0 AND k.link_id = cur + 1)) SELECT s AS from_link, e AS to_link, CAST(MIN(cost) AS DOUBLE) AS cost FROM go WHERE cur = e AND cost <= 1000 GROUP BY 1, 2")
def turn_restricted_paths(r):
    k = sparse_links(r)
    shut = k.filter("link_id % 10 = 2 and link_id % 3 = 0").select("link_id", F.lit("car").alias("mode"), F.array(F.col("link_id") + 1).alias("sequence"))
    return mapping.paths(short_pairs(r), k, shut).select("from_link", "to_link", "cost")


# --- space ----------------------------------------------------------------------------------------------


@query("""+ d AS (SELECT point_id, node_id, sqrt(CAST((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) AS DOUBLE)) AS dist FROM {d_stops} s JOIN {d_nodes} n ON abs(s.x - n.x) <= 400 AND abs(s.y - n.y) <= 400),
  k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY dist, node_id) AS r FROM d WHERE dist <= 400) SELECT point_id, node_id, ROUND(dist, 6) AS node_distance, CAST(r AS INT) AS node_rank FROM k WHERE r <= 5""")
def nearest_nodes(r):
    return spatial.nearest_nodes(r("d_stops"), r("d_nodes"), 5, 400.0).withColumn("node_distance", F.round("node_distance", 6))


@query("SELECT n.node_id AS point_id, s.point_id AS stop_id FROM {d_nodes} n JOIN {d_stops} s ON (s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) <= 90000")
def stops_near(r):
    return spatial.stops_near(r("d_nodes").withColumnRenamed("node_id", "point_id"), r("d_stops").withColumnRenamed("point_id", "stop_id"), 300.0).select("point_id", "stop_id")


# links from each node to the one 17 on, when that is close
NEAR = """+ l AS (SELECT a.node_id AS link_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.node_id % 3 AS m FROM {d_nodes} a JOIN {d_nodes} b ON b.node_id = (a.node_id + 17) % (SELECT COUNT(*) FROM {d_nodes}) WHERE abs(a.x - b.x) + abs(a.y - b.y) < 6000),
  t AS (SELECT s.*, l.*, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) = 0 THEN 0.0 ELSE GREATEST(0.0, LEAST(1.0, CAST((s.x - ax) * (bx - ax) + (s.y - ay) * (by_ - ay) AS DOUBLE) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS f FROM {d_stops} s, l),
  d AS (SELECT *, sqrt((x - (ax + f * (bx - ax))) ** 2 + (y - (ay + f * (by_ - ay))) ** 2) AS dist FROM t), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY ROUND(dist, 6), link_id) AS r FROM d WHERE dist <= 500) """


def near_links(r) -> DataFrame:
    n = r("d_nodes")
    size = n.count()
    b = n.select(F.col("node_id").alias("to_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = n.withColumn("to_id", (F.col("node_id") + 17) % size).join(b, "to_id").filter(F.abs(F.col("x") - F.col("bx")) + F.abs(F.col("y") - F.col("by")) < 6000)
    modes = F.when(F.col("node_id") % 3 == 0, F.array(F.lit("bus"))).when(F.col("node_id") % 3 == 1, F.array(F.lit("rail"), F.lit("pt"))).otherwise(F.array(F.lit("car")))
    return j.select(F.col("node_id").alias("link_id"), F.col("node_id").alias("from_id"), "to_id", modes.alias("modes"))


@query(NEAR + "SELECT point_id, link_id, ROUND(dist, 6) AS link_distance, ROUND(f, 6) AS fraction FROM d WHERE dist <= 500")
def nearest_links(r):
    return spatial.nearest_links(r("d_stops").select("point_id", "x", "y"), near_links(r), r("d_nodes"), 1_000_000, 500.0).select("point_id", "link_id", F.round("link_distance", 6).alias("link_distance"), F.round("fraction", 6).alias("fraction"))


SCORED = NEAR + """, c AS (SELECT *, -dist / 100.0 + CASE WHEN (mode = 'bus' AND m = 0) OR (mode = 'rail' AND m = 1) OR (mode = 'pt' AND m = 1) THEN 0.8 ELSE 0.0 END AS score FROM k WHERE r <= 80 AND ((mode = 'bus' AND m IN (0, 1)) OR (mode = 'rail' AND m = 1) OR (mode = 'pt' AND m IN (0, 1)))) """


@query(SCORED + "SELECT point_id, link_id, ROUND(score, 6) AS score FROM c")
def stop_candidates_scored(r):
    return spatial.stop_candidates(r("d_stops"), near_links(r), r("d_nodes"), 500.0).select("point_id", "link_id", F.round("score", 6).alias("score"))


@query(SCORED + "SELECT point_id, ROUND(MAX(score), 6) AS score FROM c GROUP BY 1")
def best_candidate(r):
    return spatial.stop_candidates(r("d_stops"), near_links(r), r("d_nodes"), 500.0).filter("candidate_rank = 1").select("point_id", F.round("score", 6).alias("score"))


@query("""+ b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM {d_nodes} WHERE node_id % 3 = 0 AND x < 6000 AND y < 7000), s AS (SELECT point_id FROM {d_stops}, b WHERE x BETWEEN x0 - 50 AND x1 + 50 AND y BETWEEN y0 - 50 AND y1 + 50),
  c AS (SELECT c.k % 25 AS line, c.k AS route, CAST(substr(stop_id, 2) AS BIGINT) AS stop FROM {d_calls} c), k AS (SELECT * FROM c WHERE stop IN (SELECT point_id FROM s)) SELECT line AS line_id, route AS route_id, COUNT(*) AS n FROM k GROUP BY 1, 2 HAVING COUNT(*) >= 2""")
def clip_to_extent(r):
    calls = r("d_calls").select((F.col("k") % 25).alias("line_id"), F.col("k").alias("route_id"), F.expr("cast(substr(stop_id, 2) as bigint)").alias("stop_id"))
    out = spatial.clip_schedule(r("d_stops").withColumnRenamed("point_id", "stop_id"), calls, r("d_nodes").filter("node_id % 3 = 0 and x < 6000 and y < 7000"), 50.0)
    return out["route_stops"].groupBy("line_id", "route_id").agg(F.count("*").alias("n"))


RING = [(1005.0, 1005.0), (7005.0, 2005.0), (6005.0, 8005.0), (4005.0, 4005.0), (2005.0, 7005.0)]
EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:] + RING[:1], strict=True))


@query(f"""+ e AS (SELECT * FROM (VALUES {EDGES}) AS t(ax, ay, bx, by_)) SELECT node_id, SUM(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM {{d_nodes}}, e GROUP BY 1""")
def point_in_polygon(r):
    ring = geometry.close_ring(F.array(*(geometry.point(F.lit(x), F.lit(y)) for x, y in RING)))
    return r("d_nodes").select("node_id", geometry.in_ring(F.col("x").cast("double"), F.col("y").cast("double"), ring).alias("inside"))


def boundary_inputs(r) -> tuple[DataFrame, DataFrame]:
    ways = r("d_refs").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("refs"))
    return ways, r("d_nodes").select("node_id", F.col("x").cast("double").alias("lon"), F.col("y").cast("double").alias("lat"))


BOUNDARY = f"""+ e AS (SELECT * FROM (VALUES {EDGES}) AS t(cx, cy, dx, dy)), p AS (SELECT way_id, pos, node_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {{d_refs}} JOIN {{d_nodes}} USING (node_id)),
  s AS (SELECT a.way_id, a.pos, a.x AS ax, a.y AS ay, COALESCE(b.x, a.x) AS bx, COALESCE(b.y, a.y) AS by_ FROM p a LEFT JOIN p b ON a.way_id = b.way_id AND b.pos = a.pos + 1),
  q AS (SELECT way_id, pos, ax, ay, bx, by_, SUM(CASE WHEN (cy > ay) <> (dy > ay) AND ax < (dx - cx) * (ay - cy) / (dy - cy) + cx THEN 1 ELSE 0 END) % 2 = 1 AS a_in, SUM(CASE WHEN (cy > (ay + by_) / 2) <> (dy > (ay + by_) / 2) AND (ax + bx) / 2 < (dx - cx) * ((ay + by_) / 2 - cy) / (dy - cy) + cx THEN 1 ELSE 0 END) % 2 = 1 AS m_in,
    MAX(CASE WHEN sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0 THEN 1 ELSE 0 END) = 1 AS crosses FROM s, e GROUP BY ALL), kept AS (SELECT DISTINCT way_id FROM q WHERE a_in OR m_in OR crosses)"""


@query(BOUNDARY + " SELECT way_id FROM kept")
def boundary_way_filter(r):
    return spatial.ways_in_boundary(*boundary_inputs(r), RING)


@query(BOUNDARY + """ SELECT n_nationkey AS relation_id FROM nation WHERE n_nationkey * 4 IN (SELECT way_id FROM kept)""")
def boundary_relations(r):
    ways, nodes = boundary_inputs(r)
    members = r("nation").select(F.col("n_nationkey").alias("relation_id"), F.lit("way").alias("type"), (F.col("n_nationkey") * 4).alias("ref"))
    return spatial.boundary_filter(ways, nodes, members, RING)["relations"]


TRIANGLES = "SELECT a.node_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM {d_nodes} a JOIN {d_nodes} b ON b.node_id = a.node_id + 1 JOIN {d_nodes} c ON c.node_id = a.node_id + 2"


def triangles(r) -> DataFrame:
    n = r("d_nodes")
    at = lambda i, p: n.select((F.col("node_id") - i).alias("node_id"), geometry.point(F.col("x"), F.col("y")).alias(p))
    return at(0, "a").join(at(1, "b"), "node_id").join(at(2, "c"), "node_id").withColumn("ring", F.array("a", "b", "c"))


@query(f"+ t AS ({TRIANGLES}) SELECT node_id, abs((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)) / 2.0 AS area FROM t")
def polygon_area(r):
    return triangles(r).select("node_id", F.abs(geometry.signed_area(geometry.close_ring(F.col("ring")))).alias("area"))


@query(f"+ t AS ({TRIANGLES}) SELECT node_id, ROUND((ax + bx + cx) / 3.0, 4) AS x, ROUND((ay + by_ + cy) / 3.0, 4) AS y FROM t")
def polygon_centroid(r):
    c = geometry.centroid(F.col("ring"))
    return triangles(r).select("node_id", F.round(c["x"], 4).alias("x"), F.round(c["y"], 4).alias("y"))


@query(f"""+ t AS ({TRIANGLES}), v AS (SELECT node_id, bx - ax AS ix, by_ - ay AS iy, cx - bx AS ox, cy - by_ AS oy FROM t), d AS (SELECT *, degrees(atan2(ix * oy - iy * ox, ix * ox + iy * oy)) AS t FROM v)
  SELECT node_id, CASE WHEN abs(t) < 20 THEN 'through' WHEN abs(t) > 150 THEN 'reverse' ELSE (CASE WHEN abs(t) < 45 THEN 'slight_' WHEN abs(t) > 120 THEN 'sharp_' ELSE '' END) || CASE WHEN t > 0 THEN 'left' ELSE 'right' END END AS turn FROM d""")
def turn_class(r):
    d = lambda p, q, k: F.col(f"{q}.{k}") - F.col(f"{p}.{k}")
    return triangles(r).select("node_id", geometry.turn_class(d("a", "b", "x"), d("a", "b", "y"), d("b", "c", "x"), d("b", "c", "y")).alias("turn"))


@query(f"""+ t AS ({TRIANGLES}) SELECT node_id, ROUND(degrees(atan2(abs(CAST((ax - bx) * (cy - by_) - (ay - by_) * (cx - bx) AS DOUBLE)), CAST((ax - bx) * (cx - bx) + (ay - by_) * (cy - by_) AS DOUBLE))), 6) AS angle FROM t""")
def bend_angles(r):
    c = lambda p, k: F.col(f"{p}.{k}")
    return triangles(r).select("node_id", F.round(geometry.bend_angle(c("a", "x"), c("a", "y"), c("b", "x"), c("b", "y"), c("c", "x"), c("c", "y")), 6).alias("angle"))


@query("""+ p AS (SELECT way_id, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {d_refs} JOIN {d_nodes} USING (node_id)), s AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY way_id ORDER BY pos))
  SELECT way_id, ROUND(COALESCE(SUM(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) AS length FROM s GROUP BY 1""")
def polyline_length(r):
    p = r("d_refs").join(r("d_nodes"), "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts"))
    return p.select("way_id", F.round(geometry.polyline_length(F.transform("pts", lambda q: geometry.point(q["x"], q["y"]))), 4).alias("length"))


# --- road tags ---------------------------------------------------------------------------------------------

RULE_VALUES = ", ".join(f"('{k}', '{v}', {rank}, '{','.join(m)}', {lanes}, {speed}, {cap}, {str(o).lower()})" for k, v, rank, m, lanes, speed, cap, o, _ in roads.RULES)
RULED = f"""+ rules AS (SELECT * FROM (VALUES {RULE_VALUES}) AS t(key, value, rank, modes, lanes, speed, cap, oneway_rule)),
  ruled AS (SELECT t.*, COALESCE(h.key, y.key, f.key) AS key, COALESCE(h.value, y.value, f.value) AS value, COALESCE(h.modes, y.modes, f.modes) AS rule_modes, COALESCE(h.speed, y.speed, f.speed) AS rule_speed, COALESCE(h.oneway_rule, y.oneway_rule, f.oneway_rule) AS oneway_rule, CAST(COALESCE(h.lanes, y.lanes, f.lanes) AS DOUBLE) AS rule_lanes
    FROM {{d_tags}} t LEFT JOIN rules h ON h.key = 'highway' AND h.value = t.highway LEFT JOIN rules y ON y.key = 'railway' AND y.value = t.railway LEFT JOIN rules f ON f.key = 'route' AND f.value = t.route WHERE COALESCE(t.highway, '') <> 'service' AND COALESCE(h.key, y.key, f.key) IS NOT NULL) """


def ruled(r) -> DataFrame:
    t = way_tags(r)
    return roads.with_rule(t, roads.rule_table(t.sparkSession), ("service",))


@query(RULED + "SELECT way_id, key AS rule_key, value AS rule_value, rule_modes, CAST(rule_speed AS DOUBLE) AS rule_speed FROM ruled")
def way_rule_lookup(r):
    return ruled(r).select("way_id", "rule_key", "rule_value", joined(F.col("rule_modes")).alias("rule_modes"), "rule_speed")


DIRECTION = "CASE WHEN oneway IN ('yes') THEN 'forward' WHEN oneway = '-1' THEN 'reverse' WHEN oneway IN ('no', 'reversible') THEN 'both' WHEN junction = 'roundabout' OR highway = 'motorway' OR oneway_rule THEN 'forward' ELSE 'both' END"


@query(RULED + f"SELECT way_id, {DIRECTION} AS direction FROM ruled")
def oneway_resolution(r):
    return ruled(r).select("way_id", tags.oneway(F.col("tags"), F.col("rule_oneway")).alias("direction"))


STATE = lambda v: f"CASE WHEN {v} IN ('no', 'never') THEN 'forbidden' WHEN {v} IN ('private', 'destination') THEN 'restricted' WHEN {v} IN ('yes', 'designated') THEN 'allowed' END"
ACCESS = RULED + f""", m AS (SELECT r.*, mode FROM ruled r, (SELECT UNNEST(['bus', 'car', 'ferry', 'pt', 'rail', 'tram']) AS mode) WHERE list_contains(string_split(rule_modes, ','), mode) OR (mode = 'bus' AND list_contains(string_split(rule_modes, ','), 'car'))),
  a AS (SELECT *, COALESCE(CASE WHEN mode = 'bus' THEN {STATE('bus')} END, CASE WHEN mode IN ('bus', 'pt') THEN {STATE('psv')} END, CASE WHEN mode IN ('bus', 'pt', 'car') THEN {STATE('motor_vehicle')} END, {STATE('access')}, 'none') AS state FROM m),
  k AS (SELECT way_id, mode FROM a WHERE CASE WHEN access = 'no' THEN (mode = 'bus' AND COALESCE(bus, '') = 'designated') OR (mode IN ('bus', 'pt') AND COALESCE(psv, '') = 'yes') ELSE state <> 'forbidden' END) """


@query(ACCESS + f"""SELECT r.way_id, CASE WHEN {DIRECTION} = 'reverse' THEN '' ELSE COALESCE(string_agg(k.mode, ',' ORDER BY k.mode), '') END AS forward, CASE WHEN {DIRECTION} = 'forward' THEN '' ELSE COALESCE(string_agg(k.mode, ',' ORDER BY k.mode), '') END AS backward
  FROM ruled r LEFT JOIN k USING (way_id) GROUP BY r.way_id, r.oneway, r.junction, r.highway, r.oneway_rule""")
def access_resolution(r):
    t = tags.travel_modes(F.col("tags"), tags.candidate_modes(F.col("rule_modes")), F.col("rule_oneway"), roads.KNOWN_MODES)
    return ruled(r).select("way_id", joined(t["forward"]).alias("forward"), joined(t["backward"]).alias("backward"))


@query(RULED + """SELECT way_id, ROUND(CAST(CASE trim(maxspeed) WHEN '50' THEN 50 / 3.6 WHEN '30 mph' THEN 30 * 1.609344 / 3.6 WHEN 'walk' THEN 5 / 3.6 WHEN '80 km/h' THEN 80 / 3.6 WHEN '60' THEN 60 / 3.6 ELSE rule_speed END AS DOUBLE), 6) AS speed FROM ruled""")
def speed_parse(r):
    return ruled(r).select("way_id", F.round(tags.speed(F.col("tags"), "forward", F.col("rule_speed")), 6).alias("speed"))


@query(RULED + """, n AS (SELECT way_id, TRY_CAST(lanes AS DOUBLE) AS t, CAST(lanes_forward AS DOUBLE) AS f, CAST(lanes_backward AS DOUBLE) AS b, CAST(lanes_both AS DOUBLE) AS w, rule_lanes AS d FROM ruled),
  c AS (SELECT *, COALESCE(w, 0) AS sh, CASE WHEN t IS NULL THEN TRUE WHEN f IS NOT NULL AND b IS NOT NULL THEN f + b + COALESCE(w, 0) = t WHEN f IS NULL AND b IS NULL THEN TRUE ELSE COALESCE(f, b) + COALESCE(w, 0) <= t AND t - COALESCE(f, b) - COALESCE(w, 0) >= 1 END AS good FROM n),
  s AS (SELECT *, t IS NOT NULL AND (NOT good OR (f IS NULL AND b IS NULL)) AS split, t - sh AS rest FROM c), v AS (SELECT *, rest >= 1 AND CAST(rest AS BIGINT) % 2 = 0 AS even FROM s)
  SELECT way_id, CAST(CASE WHEN split AND even THEN rest / 2 WHEN split THEN GREATEST(1, floor(rest / 2 + 0.5)) WHEN t IS NULL THEN COALESCE(f, d) WHEN f IS NULL THEN t - b - sh ELSE f END AS INT) AS lanes,
    CASE WHEN split AND even THEN 'even_split' WHEN split THEN 'undetermined_split' WHEN t IS NULL AND f IS NULL THEN 'absent' ELSE 'present' END AS confidence FROM v""")
def lane_count_resolve(r):
    c = tags.lane_count(F.col("tags"), True, F.lit(False), F.col("rule_lanes"))
    return ruled(r).select("way_id", c["lanes"].alias("lanes"), c["confidence"].alias("confidence"))


@query("""+ c AS (SELECT way_id, CAST(UNNEST(range(len(string_split(turn_lanes, '|')))) AS INT) AS lane, string_split(lower(turn_lanes), '|') AS cells FROM {d_tags} WHERE turn_lanes IS NOT NULL), x AS (SELECT way_id, lane, cells[lane + 1] AS raw FROM c)
  SELECT way_id, lane, raw, CASE raw WHEN 'left' THEN 'left' WHEN 'through;right' THEN 'through,right' WHEN 'through' THEN 'through' WHEN 'slight_left;foo' THEN 'slight_left' ELSE '' END AS turns, CASE WHEN raw = 'slight_left;foo' THEN 'foo' ELSE '' END AS unsupported FROM x""")
def turn_lane_cells(r):
    t = way_tags(r).select("way_id", F.posexplode(tags.turn_lane_cells(F.col("tags")["turn:lanes"])).alias("lane", "c"))
    return t.select("way_id", "lane", F.col("c.raw").alias("raw"), joined(F.col("c.turns")).alias("turns"), joined(F.col("c.unsupported")).alias("unsupported"))


@query("""SELECT way_id, a.pos AS idx, a.node_id AS a, b.node_id AS b, ROUND(sqrt(CAST((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS DOUBLE)), 4) AS length FROM {d_refs} a JOIN {d_refs} b USING (way_id) JOIN {d_nodes} p ON p.node_id = a.node_id JOIN {d_nodes} q ON q.node_id = b.node_id WHERE b.pos = a.pos + 1""")
def segments_from_ways(r):
    ways = r("d_refs").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("refs"))
    w = ways.select("way_id", "refs", F.lit(600.0).alias("rule_capacity"), F.lit(1).alias("fwd"), F.lit(1).alias("bwd"))
    return roads.segments(w, r("d_nodes")).select("way_id", "idx", "a", "b", F.round("length", 4).alias("length"))


# --- restrictions and movements --------------------------------------------------------------------------


def small_links(r) -> DataFrame:
    """All links, their ends spread over as many nodes as there are; three ways."""
    k = r("d_links").crossJoin(F.broadcast(r("d_size")))  # one row
    ident = F.concat(F.lit("L"), F.col("link_id").cast("string"))
    node = lambda v: F.concat(F.lit("osm_node_"), (v % F.col("n")).cast("string"))
    return k.select(ident.alias("link_id"), node(F.col("from_id")).alias("from_id"), node(F.col("link_id") * 7).alias("to_id"), F.when(F.col("link_id") % 3 == 0, F.array(F.lit("bus"), F.lit("car"))).otherwise(F.array(F.lit("car"))).alias("modes"), F.array((F.col("link_id") % 3).cast("string")).alias("ways"))


SMALL = "+ l AS (SELECT 'L' || link_id AS link_id, from_id % n AS f, (link_id * 7) % n AS t, link_id % 3 = 0 AS bus, CAST(link_id % 3 AS VARCHAR) AS way FROM {d_links}, {d_size}), rel AS (SELECT n_nationkey AS id, CAST(n_nationkey % 3 AS VARCHAR) AS fw, CAST((n_nationkey + 1) % 3 AS VARCHAR) AS tw, CASE WHEN n_nationkey % 5 = 3 THEN 7 ELSE n_nationkey % 2 * 20 + 1 END AS via, n_nationkey % 2 = 1 AS only_, n_nationkey % 5 = 0 AS ex FROM {nation})"


def relations(r) -> tuple[DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.cast("string").alias("ref"), F.lit(role).alias("role"))
    every = F.array(member("way", n % 3, "from"), member("node", F.when(n % 5 == 3, 7).otherwise(n % 2 * 20 + 1), "via"), member("way", (n + 1) % 3, "to"))
    rows = r("nation").select(n.alias("relation_id"), F.posexplode(every).alias("pos", "m")).select("relation_id", "pos", "m.*")
    tag = F.create_map(F.lit("type"), F.lit("restriction"), F.lit("restriction"), F.when(n % 2 == 1, "only_straight_on").otherwise("no_left_turn"), F.lit("except"), F.when(n % 5 == 0, "psv").otherwise(""))
    return rows, r("nation").select(n.alias("relation_id"), tag.alias("tags"))


RESTRICTED = SMALL + """, fr AS (SELECT id, link_id AS from_link, bus, only_, ex, via FROM rel JOIN l ON l.way = fw AND l.t = via), tl AS (SELECT id, link_id AS to_link FROM rel JOIN l ON l.way = tw AND l.f = via),
  md AS (SELECT DISTINCT id, mode FROM (SELECT id, 'car' AS mode, ex FROM fr UNION ALL SELECT id, 'bus', ex FROM fr WHERE bus) WHERE NOT (ex AND mode = 'bus')),
  pr AS (SELECT fr.id, from_link, to_link FROM fr JOIN tl USING (id) WHERE NOT only_ UNION SELECT fr.id, from_link, l.link_id FROM fr JOIN l ON l.f = fr.via WHERE only_ AND fr.id IN (SELECT id FROM tl) AND (fr.id, l.link_id) NOT IN (SELECT id, to_link FROM tl)),
  fb AS (SELECT DISTINCT from_link, to_link, mode FROM pr JOIN md USING (id)) """


@query(RESTRICTED + "SELECT from_link, to_link, mode FROM fb")
def turn_restrictions(r):
    return roads.turn_restrictions(*relations(r), small_links(r))[0]


@query(RESTRICTED + "SELECT CASE WHEN id NOT IN (SELECT id FROM fr) THEN 'restriction-from-unresolved' ELSE 'restriction-to-unresolved' END AS code, id AS relation_id FROM rel WHERE id NOT IN (SELECT id FROM fr) OR id NOT IN (SELECT id FROM tl)")
def restriction_issues(r):
    return roads.turn_restrictions(*relations(r), small_links(r))[1]


@query(RESTRICTED + """, mv AS (SELECT a.t AS via, a.link_id AS from_link, b.link_id AS to_link, a.bus AND b.bus AS bus FROM l a JOIN l b ON a.t = b.f WHERE a.link_id <> b.link_id), s AS (SELECT from_link, to_link, bool_or(mode = 'car') AS car, bool_or(mode = 'bus') AS bus FROM fb GROUP BY 1, 2)
  SELECT 'osm_node_' || via AS via, from_link, to_link, CASE WHEN mv.bus THEN 'bus,car' ELSE 'car' END AS controlled, concat_ws(',', CASE WHEN mv.bus AND NOT COALESCE(s.bus, FALSE) THEN 'bus' END, CASE WHEN NOT COALESCE(s.car, FALSE) THEN 'car' END) AS legal FROM mv LEFT JOIN s USING (from_link, to_link)""")
def movements(r):
    k = small_links(r)
    m = roads.movements(k, roads.turn_restrictions(*relations(r), k)[0])
    return m.select("via", "from_link", "to_link", joined(F.col("controlled")).alias("controlled"), joined(F.col("legal")).alias("legal"))


# --- validators ---------------------------------------------------------------------------------------------


@query("""+ e AS (SELECT *, LEAD(kind) OVER (PARTITION BY person_id, plan_idx ORDER BY pos) AS nk FROM {d_elements})
  SELECT 'error' AS severity, 'activity-end-before-start' AS code, facility_id AS object_id FROM e WHERE kind = 'activity' AND end_time < start_time UNION ALL SELECT 'error', 'activity-negative-max-duration', facility_id FROM e WHERE kind = 'activity' AND max_dur < 0
  UNION ALL SELECT 'error', 'leg-missing-mode', CAST(person_id AS VARCHAR) || '-leg-' || pos FROM e WHERE kind = 'leg' AND mode IS NULL UNION ALL SELECT 'error', 'plan-consecutive-legs', CAST(person_id AS VARCHAR) FROM e WHERE kind = 'leg' AND nk = 'leg'
  UNION ALL SELECT 'warning', 'activity-link-not-in-network', facility_id FROM e WHERE kind = 'activity' AND link_id NOT IN (SELECT link_id FROM {d_links})
  UNION ALL SELECT 'warning', 'person-no-selected-plan', CAST(person_id AS VARCHAR) FROM (SELECT DISTINCT person_id FROM e) WHERE person_id % 4 = 0 UNION ALL SELECT 'error', 'person-no-plans', CAST(-1 - n_nationkey AS VARCHAR) FROM {nation}""")
def population_issues(r):
    e = r("d_elements")
    persons = e.select("person_id").distinct()
    plans = persons.select("person_id", F.lit(0).alias("plan_idx"), (F.col("person_id") % 4 != 0).alias("selected"))
    lonely = r("nation").select((-1 - F.col("n_nationkey")).cast("long").alias("person_id"))
    return validate.population_issues(persons.unionByName(lonely), plans, e, r("d_links")).select("severity", "code", "object_id")


@query("""SELECT 'warning' AS severity, 'vehicle-type-missing' AS code, CAST(s_suppkey AS VARCHAR) AS object_id FROM supplier WHERE s_nationkey % 4 = 3 UNION ALL SELECT 'warning', 'departure-vehicle-missing', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 500 NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'warning', 'facility-link-not-in-network', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey * 30 NOT IN (SELECT link_id FROM {d_links}) UNION ALL SELECT 'error', 'scenario-no-config', NULL""")
def scenario_issues(r):
    t = {
        "links": r("d_links"), "facilities": r("customer").select(F.col("c_custkey").alias("facility_id"), (F.col("c_custkey") * 30).alias("link_id")), "vehicles": r("supplier").select(F.col("s_suppkey").alias("vehicle_id"), F.col("s_nationkey").alias("type_id")),
        "vehicle_types": r("nation").filter("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("type_id")), "departures": r("orders").select(F.col("o_orderkey").alias("departure_id"), (F.col("o_orderkey") % 500).cast("string").alias("vehicle_id")),
    }
    t["vehicles"] = t["vehicles"].withColumn("vehicle_id", F.col("vehicle_id").cast("string"))
    return validate.scenario_issues(t).select("severity", "code", "object_id")


@query("""SELECT 'error' AS severity, 'LINK_REF_NOT_IN_NETWORK' AS code, 's' || s_suppkey AS object_id FROM supplier WHERE s_suppkey * 211 NOT IN (SELECT link_id FROM {d_links}) UNION ALL SELECT 'warning', 'LANE_REF_LINK_MISMATCH', s_suppkey || '_0' FROM supplier WHERE s_suppkey <> s_suppkey * 211
  UNION ALL SELECT 'error', 'DANGLING_SIGNAL_REF', 's' || (s_suppkey + 1) FROM supplier a WHERE s_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier b WHERE b.s_nationkey = a.s_nationkey) UNION ALL SELECT 'error', 'NEGATIVE_SECONDS', 'g' || s_suppkey FROM supplier WHERE s_suppkey % 9 = 4
  UNION ALL SELECT 'error', 'DANGLING_GROUP_REF', 'g' || s_suppkey FROM supplier WHERE s_suppkey % 6 = 1""")
def signals_issues(r):
    s = r("supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    t = {
        "signals": s.select(n.alias("system_id"), name("s", k).alias("signal_id"), (k * 211).alias("link_id"), F.array(F.concat(k.cast("string"), F.lit("_0"))).alias("lane_refs"), F.array().cast("array<bigint>").alias("to_links")),
        "groups": s.select(n.alias("system_id"), name("g", F.when(k % 6 == 1, k + 1_000_000).otherwise(k)).alias("group_id"), name("s", k + 1).alias("signal_id")),
        "settings": s.select(n.alias("system_id"), name("g", k).alias("group_id"), F.when(k % 9 == 4, -1).otherwise(0).alias("onset"), F.lit(30).alias("dropping")),
    }
    return validate.signal_issues(t, r("d_links")).select("severity", "code", "object_id")


# --- events -----------------------------------------------------------------------------------------------


@query("SELECT type, COUNT(*) AS n FROM {d_events} GROUP BY 1")
def event_type_counts(r):
    return events.counts(r("d_events"))


@query("SELECT event_id, person, time FROM {d_events} WHERE type = 'click'")
def events_typed_projection(r):
    return events.typed(r("d_events"), "click").select("event_id", "person", "time")


def crossings(r) -> DataFrame:
    e = r("d_events")
    kind = F.when(F.col("event_id") % 3 == 0, "entered_link").when(F.col("event_id") % 3 == 1, "left_link").otherwise("other")
    return e.select(F.col("person").alias("vehicle_id"), (F.col("event_id") % 4).alias("link_id"), (F.col("event_id") * 10).alias("time"), kind.alias("type"))


@query("""+ m AS (SELECT person AS v, event_id % 4 AS l, event_id * 10 AS t, event_id % 3 AS k FROM {d_events} WHERE event_id % 3 < 2), n AS (SELECT *, LEAD(k) OVER w AS nk, LEAD(l) OVER w AS nl, LEAD(t) OVER w AS nt FROM m WINDOW w AS (PARTITION BY v ORDER BY t))
  SELECT v AS vehicle_id, l AS link_id, t AS entered, nt AS left FROM n WHERE k = 0 AND nk = 1 AND nl = l""")
def link_enter_leave_pairs(r):
    return events.link_traversals(crossings(r))


# --- scalars ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, replace(p_brand || '.' || p_partkey, '.', '..') || '.' || replace(p_type, '.', '..') AS id, p_brand || '.' || p_partkey AS first_part, p_type AS second_part FROM part")
def id_compose_roundtrip(r):
    ident = ids.compose(".", F.concat("p_brand", F.lit("."), F.col("p_partkey").cast("string")), F.col("p_type"))
    p = r("part").withColumn("id", ident).withColumn("parts", ids.decompose(F.col("id"), "."))
    return p.select("p_partkey", "id", F.get("parts", F.lit(0)).alias("first_part"), F.get("parts", F.lit(1)).alias("second_part"))


@query(r"SELECT p_partkey, replace(replace(p_name || ',' || p_brand, '\', '\\'), ',', '\,') || ',' || p_type AS encoded, p_name || ',' || p_brand AS first_item, CAST(2 AS INT) AS n FROM part")
def list_codec_roundtrip(r):
    p = r("part").withColumn("encoded", ids.encode_list(F.array(F.concat("p_name", F.lit(","), "p_brand"), F.col("p_type")))).withColumn("back", ids.decode_list(F.col("encoded")))
    return p.select("p_partkey", "encoded", F.get("back", F.lit(0)).alias("first_item"), F.size("back").alias("n"))


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN time WHEN 1 THEN time // 60 * 60 WHEN 2 THEN time + 0.5 END AS DOUBLE) AS seconds FROM {d_events}""")
def clock_parse(r):
    t = F.col("time")
    hms = F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)
    written = F.when(F.col("event_id") % 4 == 0, hms).when(F.col("event_id") % 4 == 1, F.format_string("%d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60))).when(F.col("event_id") % 4 == 2, F.concat(t.cast("string"), F.lit(".5"))).otherwise("25:99")
    return r("d_events").select("event_id", times.clock_or_seconds(written).alias("seconds"))


@query("SELECT event_id, printf('%02d:%02d:%02d', time // 3600, time % 3600 // 60, time % 60) AS clock, printf('%02d%02d%02d', time // 3600, time % 3600 // 60, time % 60) AS compact FROM {d_events}")
def clock_format(r):
    return r("d_events").select("event_id", times.format_clock(F.col("time")).alias("clock"), times.compact_clock(F.col("time")).alias("compact"))


@query("SELECT way_id, sha256(string_agg(CAST(node_id AS VARCHAR) || chr(0), '' ORDER BY pos)) AS digest FROM {d_refs} GROUP BY 1")
def chain_sha256(r):
    p = r("d_refs").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"].cast("string")).alias("nodes"))
    return p.select("way_id", ids.chain_digest(F.col("nodes")).alias("digest"))


@query("""+ n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_type || ' ' || split_part(p_name, ' ', 1)), '[^a-z0-9]+', ' ', 'g')) AS b FROM part),
  t AS (SELECT *, list_filter(list_distinct(string_split(a, ' ')), lambda x: len(x) >= 3) AS ta, list_filter(list_distinct(string_split(b, ' ')), lambda x: len(x) >= 3) AS tb FROM n)
  SELECT p_partkey, ROUND(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 0.75 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE len(list_intersect(ta, tb)) / CAST(GREATEST(len(ta), len(tb)) AS DOUBLE) END, 6) AS similarity FROM t""")
def name_similarity(r):
    b = F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return r("part").select("p_partkey", F.round(text.similarity(F.col("p_name"), b), 6).alias("similarity"))


@query("SELECT p_partkey, CAST(floor(p_size * 40.0 * GREATEST(1, p_partkey % 5) / 30.0) AS BIGINT) AS capacity FROM part")
def household_capacity(r):
    return r("part").select("p_partkey", geometry.household_capacity(F.col("p_size") * 40.0, (F.col("p_partkey") % 5).cast("int")).alias("capacity"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS number, CASE WHEN p_partkey % 3 = 1 THEN p_size % 2 = 0 END AS flag FROM part")
def osm_attribute_typed(r):
    k = F.col("p_partkey") % 3
    cls = F.when(k == 0, "java.lang.Integer").when(k == 1, "java.lang.Boolean").otherwise("java.lang.String")
    value = F.when(k == 1, F.when(F.col("p_size") % 2 == 0, " True").otherwise("no")).otherwise(F.col("p_size").cast("string"))
    v = tags.typed_value(cls, value)
    return r("part").select("p_partkey", v["number"].alias("number"), v["flag"].alias("flag"))


@query("SELECT s_suppkey, replace(s_name, '.', '..') || '.link:' || s_nationkey AS child FROM supplier")
def child_stop_ids(r):
    return r("supplier").select("s_suppkey", ids.child_stop_id(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("child"))


@query("""+ t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'cafe' WHEN 1 THEN 'taxi' WHEN 2 THEN 'bank' END AS amenity, CASE WHEN p_partkey % 7 = 0 THEN 'bakery' END AS shop, CASE p_partkey % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'school' ELSE 'garage' END AS building FROM part),
  k AS (SELECT *, CASE WHEN amenity IS NOT NULL AND amenity <> 'taxi' THEN 'amenity' WHEN shop IS NOT NULL THEN 'shop' WHEN building <> 'garage' THEN 'building' END AS key FROM t)
  SELECT p_partkey, key, CASE key WHEN 'amenity' THEN amenity WHEN 'shop' THEN shop ELSE building END AS value, CASE WHEN key = 'building' THEN CASE building WHEN 'house' THEN 'home' ELSE 'education' END WHEN key = 'amenity' AND amenity = 'cafe' THEN 'leisure' ELSE 'work' END AS activity FROM k WHERE key IS NOT NULL""")
def facility_classification(r):
    k = F.col("p_partkey")
    amenity = F.when(k % 5 == 0, "cafe").when(k % 5 == 1, "taxi").when(k % 5 == 2, "bank")
    pairs = F.array(F.struct(F.lit("amenity").alias("k"), amenity.alias("v")), F.struct(F.lit("shop").alias("k"), F.when(k % 7 == 0, "bakery").alias("v")), F.struct(F.lit("building").alias("k"), F.when(k % 3 == 0, "house").when(k % 3 == 1, "school").otherwise("garage").alias("v")))
    t = r("part").select("p_partkey", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"))
    f = t.withColumn("f", facilities.classify(F.col("tags"))).filter("f is not null")
    return f.select("p_partkey", F.col("f.key").alias("key"), F.col("f.value").alias("value"), facilities.activity(F.col("f.key"), F.col("f.value")).alias("activity"))


@query("""+ e AS (SELECT *, LEAD(kind) OVER (PARTITION BY person_id, plan_idx ORDER BY pos) AS nk FROM {d_elements}) SELECT kind, nk AS next_kind, COUNT(*) AS n FROM e GROUP BY 1, 2""")
def plan_element_pairs(r):
    from pyspark.sql import Window as W

    after = F.lead("kind").over(W.partitionBy("person_id", "plan_idx").orderBy("pos"))
    return r("d_elements").select("kind", after.alias("next_kind")).groupBy("kind", "next_kind").agg(F.count("*").alias("n"))


@query(RULED + "SELECT way_id, 'dynamic-oneway' AS code FROM ruled WHERE oneway = 'reversible'")
def dynamic_oneways(r):
    return ruled(r).filter(tags.dynamic_oneway(F.col("tags"))).select("way_id", F.lit("dynamic-oneway").alias("code"))


@query("""+ s AS (SELECT way_id, COUNT(*) AS n FROM {d_refs} GROUP BY 1) SELECT CAST(n AS BIGINT) AS refs, COUNT(*) AS ways, CAST(SUM(n) AS BIGINT) AS total FROM s GROUP BY 1""")
def way_sizes(r):
    return r("d_refs").groupBy("way_id").agg(F.count("*").alias("refs")).groupBy("refs").agg(F.count("*").alias("ways"), F.sum("refs").alias("total"))


@query("SELECT link_id FROM {d_links} WHERE from_id = to_id AND from_id IN (SELECT node_id FROM {d_nodes})")
def self_loops(r):
    return validate.network_issues(r("d_nodes"), links(r)).filter("code = 'self_loop'").select(F.col("object_id").cast("long").alias("link_id"))


@query("""+ p AS (SELECT way_id, pos, node_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {d_refs} JOIN {d_nodes} USING (node_id)), a AS (SELECT *, LAG(x) OVER w AS ax, LAG(y) OVER w AS ay, LEAD(x) OVER w AS cx, LEAD(y) OVER w AS cy FROM p WINDOW w AS (PARTITION BY way_id ORDER BY pos))
  SELECT DISTINCT node_id FROM a WHERE degrees(atan2(abs((ax - x) * (cy - y) - (ay - y) * (cx - x)), (ax - x) * (cx - x) + (ay - y) * (cy - y))) < 145""")
def sharp_bends(r):
    ways = r("d_refs").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("refs"))
    return roads.sharp_bends(ways, r("d_nodes").select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), 35.0)


@query(RESTRICTED + "SELECT DISTINCT pr.from_link, pr.to_link, md.mode FROM pr JOIN md USING (id) JOIN rel USING (id) WHERE only_")
def only_turn_complement(r):
    members, relation_tags = relations(r)
    only = relation_tags.filter(F.col("tags")["restriction"].startswith("only_"))
    return roads.turn_restrictions(members, only, small_links(r))[0]


@query(ACTIVE + FIRST + """, m AS (SELECT t.trip_id, CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'subway' WHEN 2 THEN 'rail' WHEN 4 THEN 'ferry' WHEN 5 THEN 'cable_car' WHEN 6 THEN 'aerial_lift' WHEN 7 THEN 'funicular' WHEN 11 THEN 'trolleybus' ELSE 'pt' END AS mode FROM {d_trips} t JOIN {d_routes} USING (route_id)),
  each AS (SELECT trip_id, UNNEST(range(start_time, end_time, headway_secs)) AS t FROM often WHERE start_time < end_time)
  SELECT 'feed:' || trip_id || ':' || day AS vehicle_id, mode AS type_id FROM runs_on JOIN m USING (trip_id) WHERE trip_id NOT IN (SELECT trip_id FROM often)
  UNION ALL SELECT 'feed:' || trip_id || ':' || day || ':' || printf('%02d%02d%02d', t // 3600, t % 3600 // 60, t % 60), mode FROM runs_on JOIN m USING (trip_id) JOIN each USING (trip_id)""")
def vehicle_per_departure(r):
    patterns = r("d_trips").join(r("d_routes"), "route_id").select("trip_id", tags.route_mode(F.col("route_type")).alias("mode"))
    return timetable.vehicles(all_departures(r), patterns)[1]


@query(f"""+ e AS ({SPARSE}), reach(x, y) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
  c AS (SELECT p.x AS node, MIN(p.y) AS component FROM reach p JOIN reach q ON p.x = q.y AND p.y = q.x GROUP BY 1), k AS (SELECT a.component, COUNT(*) AS n FROM e JOIN c a ON e.a = a.node JOIN c b ON e.b = b.node WHERE a.component = b.component GROUP BY 1),
  best AS (SELECT component FROM k ORDER BY n DESC, component LIMIT 1), gone AS (SELECT e.a, e.b FROM e JOIN c a ON e.a = a.node JOIN c b ON e.b = b.node WHERE NOT (a.component = b.component AND a.component = (SELECT component FROM best))),
  weak(node, r) AS (SELECT a, a FROM gone UNION SELECT b, b FROM gone UNION SELECT weak.node, CASE WHEN gone.a = weak.r THEN gone.b ELSE gone.a END FROM weak JOIN gone ON weak.r = gone.a OR weak.r = gone.b), w AS (SELECT node, MIN(r) AS g FROM weak GROUP BY 1)
  SELECT gone.a AS link_id, w.g AS "group" FROM gone JOIN w ON w.node = gone.a""")
def quarantine_groups(r):
    k = sparse_links(r).withColumns({"freespeed": F.lit(1.0), "capacity": F.lit(1.0), "lanes": F.lit(1.0)})
    nodes = k.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct().withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return network.clean(nodes, k, ["car"])["quarantined"]

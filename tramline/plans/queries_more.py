"""Registered queries of junctions, lanes, stops, mapping and the scalar functions that builds use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, ids, tags, times
from ..operators import calendar, lanes, mapping, network, roads, signals, spatial, timetable, validate
from ..operators.staging import stage
from .queries import joined, links, query, triangles, way_tags


def text(c: str) -> Column:
    return F.col(c).cast("string")


# --- junctions of two signals ----------------------------------------------------------------------------
# For each supplier i two signals a, b: a link leads from a to b, every second time one back; every fifth pair is too far apart.

JUNCTION = """+ l AS (SELECT s_suppkey AS i, k.*, s_suppkey % 3 = 0 AND k.name IN ('in', 'ib', 'oa') AS bus, k.name <> 'out' OR s_suppkey % 4 <> 0 AS car FROM supplier, (VALUES ('in', 'x', 'a'), ('ab', 'a', 'b'), ('ba', 'b', 'a'), ('out', 'b', 'y'), ('oa', 'a', 'z'), ('ib', 'w', 'b')) AS k(name, f, t) WHERE k.name <> 'ba' OR s_suppkey % 2 = 0),
  n AS (SELECT i, name, f, t, bus OR NOT car AS bus, car FROM l), c AS (SELECT s_suppkey AS i, s_suppkey % 5 <> 0 AS one FROM supplier),
  inn AS (SELECT n.*, CASE WHEN one THEN 'a' ELSE t END AS cl FROM n JOIN c USING (i) WHERE t IN ('a', 'b') AND NOT (one AND name IN ('ab', 'ba'))), outt AS (SELECT n.*, CASE WHEN one THEN 'a' ELSE f END AS cl FROM n JOIN c USING (i) WHERE f IN ('a', 'b') AND NOT (one AND name IN ('ab', 'ba'))),
  mv AS (SELECT p.i, p.cl, p.name AS fl, q.name AS tl, p.bus AND q.bus AS bus, p.car AND q.car AS car, p.t AS via, q.f AS via_out FROM inn p JOIN outt q ON p.i = q.i AND p.cl = q.cl AND p.name <> q.name
    WHERE (p.t = q.f OR (p.t = 'a' AND q.f = 'b') OR (p.t = 'b' AND q.f = 'a' AND p.i % 2 = 0)) AND ((p.bus AND q.bus) OR (p.car AND q.car))) """


def junction_links(r) -> DataFrame:
    i = F.col("s_suppkey")
    kinds = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).alias("f"), F.lit(t).alias("t")) for n, f, t in (("in", "x", "a"), ("ab", "a", "b"), ("ba", "b", "a"), ("out", "b", "y"), ("oa", "a", "z"), ("ib", "w", "b"))))
    k = r("supplier").select(i.alias("i"), F.explode(kinds).alias("k")).select("i", "k.*").filter("name <> 'ba' or i % 2 = 0")
    ident = lambda c: F.concat(F.col(c), text("i"))
    car = (F.col("name") != "out") | (F.col("i") % 4 != 0)
    bus = ((F.col("i") % 3 == 0) & F.col("name").isin("in", "ib", "oa")) | ~car
    inner = F.col("name").isin("ab", "ba")
    return k.select(ident("name").alias("link_id"), ident("f").alias("from_id"), ident("t").alias("to_id"), F.when(inner & (F.col("i") % 5 == 0), 80.0).otherwise(20.0).alias("length"), F.when(inner, "primary_link").otherwise("primary").alias("link_class"), F.array_compact(F.array(F.when(bus, "bus"), F.when(car, "car"))).alias("modes"))


def junction_parts(r) -> dict[str, DataFrame]:
    k = stage(junction_links(r), "junction-links")
    lit = r("supplier").select(F.explode(F.array(F.concat(F.lit("a"), text("s_suppkey")), F.concat(F.lit("b"), text("s_suppkey")))).alias("node_id"))
    clusters, witnesses = (stage(x, "junction-clusters") for x in signals.junction_clusters(lit, k, 50.0))
    none = k.limit(0).select(F.col("link_id").alias("from_link"), F.col("link_id").alias("to_link"), F.lit("car").alias("mode"))
    shut = r("supplier").filter("s_suppkey % 7 = 0").select(F.concat(F.lit("in"), text("s_suppkey")).alias("from_link"), F.concat(F.lit("oa"), text("s_suppkey")).alias("to_link"), F.lit("car").alias("mode"))
    moves = signals.cluster_movements(k, none.unionByName(shut), clusters, witnesses)
    return {"links": k, "clusters": clusters, "witnesses": witnesses, "moves": stage(moves, "junction-moves")}


@query(JUNCTION + "SELECT cl || i AS cluster, fl || i AS from_link, tl || i AS to_link, concat_ws(',', CASE WHEN bus THEN 'bus' END, CASE WHEN car THEN 'car' END) AS controlled, CASE WHEN car AND i % 7 = 0 AND fl = 'in' AND tl = 'oa' THEN 'car' ELSE '' END AS restricted, via <> via_out AS across FROM mv")
def cluster_movements(r):
    m = junction_parts(r)["moves"]
    return m.select("cluster", "from_link", "to_link", joined(F.col("controlled")).alias("controlled"), joined(F.col("restricted")).alias("restricted"), (F.col("via") != F.col("via_out")).alias("across"))


@query(JUNCTION + """, d AS (SELECT i, cl, COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT (i % 7 = 0 AND fl = 'in' AND tl = 'oa' AND NOT bus)) AS legal FROM mv GROUP BY 1, 2), m AS (SELECT i, CASE WHEN one THEN 'a' ELSE k END AS cl, COUNT(*) AS members FROM c, (VALUES ('a'), ('b')) AS t(k) GROUP BY 1, 2)
  SELECT 'signal_' || m.cl || m.i AS junction_id, CAST(members AS INT) AS members, COALESCE(n, 0) AS n_movements, COALESCE(legal, 0) AS n_legal, CAST(CASE m.i % 4 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS INT) AS confidence,
    'osm_node=' || m.cl || m.i || ';clusterSize=' || members || ';tag=' || CASE m.i % 4 WHEN 0 THEN 'traffic_signals=signal' WHEN 1 THEN 'highway=traffic_signals' WHEN 2 THEN 'traffic_signals=no' ELSE 'inferred' END AS provenance FROM m LEFT JOIN d USING (i, cl)""")
def junction_descriptors(r):
    p, i = junction_parts(r), F.col("s_suppkey")
    headings = p["links"].select("link_id", F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"))
    tag = F.when(i % 4 == 0, F.create_map(F.lit("traffic_signals"), F.lit("signal"))).when(i % 4 == 1, F.create_map(F.lit("highway"), F.lit("traffic_signals"))).when(i % 4 == 2, F.create_map(F.lit("highway"), F.lit("traffic_signals"), F.lit("traffic_signals"), F.lit("no"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    nodes = r("supplier").select(F.explode(F.array(F.concat(F.lit("a"), text("s_suppkey")), F.concat(F.lit("b"), text("s_suppkey")))).alias("node_id"), tag.alias("tags"))
    _, d = signals.junctions(p["moves"], p["links"], p["clusters"], p["witnesses"], headings, nodes)
    return d.select("junction_id", F.size("members").alias("members"), "n_movements", "n_legal", "confidence", "provenance")


@query("SELECT way_id, CAST(CASE WHEN way_id % 5 < 3 THEN 3 WHEN way_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS confidence FROM {d_tags}")
def signal_confidence(r):
    k = F.col("way_id")
    named = F.when(k % 5 < 3, "traffic_lights").when(k % 5 == 3, "none")
    entries = F.filter(F.array(F.struct(F.lit("traffic_signals").alias("k"), named.alias("v")), F.struct(F.lit("highway").alias("k"), F.when(k % 2 == 0, "traffic_signals").alias("v"))), lambda e: e["v"].isNotNull())
    return r("d_tags").select("way_id", signals.confidence(F.map_from_entries(entries)).alias("confidence"))


READY = JUNCTION + """, iss AS (SELECT 'warning' AS severity, 'approach-no-legal-outgoing' AS code, name || i AS object_id FROM inn p WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.i = p.i AND mv.fl = p.name AND NOT (mv.i % 7 = 0 AND mv.fl = 'in' AND mv.tl = 'oa' AND NOT mv.bus))
  UNION ALL SELECT DISTINCT 'info', 'ambiguous-lane-tags', cl || i FROM inn WHERE i % 9 = 0 AND name = 'in') """


def junction_diagnosis(r) -> dict[str, DataFrame]:
    p = junction_parts(r)
    headings = p["links"].select("link_id", F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"))
    nodes = p["clusters"].select("node_id", F.create_map(F.lit("highway"), F.lit("traffic_signals")).alias("tags"))
    _, d = signals.junctions(p["moves"], p["links"], p["clusters"], p["witnesses"], headings, nodes)
    on_lanes = r("supplier").filter("s_suppkey % 9 = 0").select(F.concat(F.lit("in"), text("s_suppkey")).alias("link_id"))
    return p | {"junctions": d, "on_lanes": on_lanes}


@query(READY + "SELECT * FROM iss")
def junction_diagnostics(r):
    p = junction_diagnosis(r)
    return signals.junction_issues(p["junctions"], p["moves"], p["links"], p["clusters"], p["on_lanes"])


@query(JUNCTION + """, j AS (SELECT i, one FROM c) SELECT SUM(CASE WHEN one THEN 1 ELSE 2 END) AS candidate_junctions, SUM(CASE WHEN one THEN 1 ELSE 2 END) AS confirmed_junctions, CAST(2 * COUNT(*) AS BIGINT) AS preserved_signal_nodes, CAST(30 AS BIGINT) AS collapsed_geometry_nodes, CAST(70 AS BIGINT) AS preserved_semantic_nodes,
  CAST(0 AS BIGINT) AS high_degree_non_signalized, (SELECT COUNT(*) FROM mv WHERE i % 9 = 0 AND cl = 'a') AS movements_without_lane_info, (SELECT COUNT(*) FROM nation WHERE n_nationkey % 2 = 0) AS via_way_restrictions FROM j""")
def readiness_report(r):
    p = junction_diagnosis(r)
    problems = r("nation").select(F.when(F.col("n_nationkey") % 2 == 0, "restriction-via-way-unsupported").otherwise("restriction-incomplete").alias("code"))
    return signals.readiness(p["junctions"], p["links"], p["clusters"], p["on_lanes"], 100, 70, r("supplier").count() * 2, problems)


# --- lanes and road attributes ----------------------------------------------------------------------------


@query("SELECT CAST(link_id AS VARCHAR) AS link_id, CAST(link_id AS VARCHAR) || '-' || k AS lane_id FROM {d_links}, (VALUES (1), (2)) AS t(k) WHERE (link_id % 6 = 0) OR (link_id % 6 = 1 AND k = 2)")
def lane_cycles(r):
    k = F.col("link_id")
    lane = lambda n: F.concat(text("link_id"), F.lit(f"-{n}"))
    # 0: a cycle of two; 1: a lane into a lane that follows itself; 2 and 3: a chain; else nothing
    nxt = F.array(F.struct(lane(1).alias("lane_id"), F.when(k % 6 < 4, lane(2)).alias("next")), F.struct(lane(2).alias("lane_id"), F.when(k % 6 == 0, lane(1)).when(k % 6 == 1, lane(2)).alias("next")))
    rows = r("d_links").select(text("link_id").alias("link_id"), F.explode(nxt).alias("l")).select("link_id", "l.*")
    return roads.lane_cycles(rows)


@query("SELECT way_id, CAST(CASE way_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS DOUBLE) AS n FROM {d_tags}")
def dedicated_lanes(r):
    k = F.col("way_id")
    m = F.when(k % 4 == 0, F.create_map(F.lit("bus:lanes"), F.lit("designated| yes |no"))).when(k % 4 == 1, F.create_map(F.lit("bus:lanes:forward"), F.lit("yes|none"), F.lit("bus:lanes"), F.lit("yes|yes"))).otherwise(F.create_map(F.lit("lanes"), F.lit("2")))
    return r("d_tags").select("way_id", tags.dedicated_lanes(m, "bus", "forward").alias("n"))


@query("SELECT way_id, concat_ws('', 'lanes:forward=' || lanes_forward || ';', 'turn:lanes=' || turn_lanes || ';') AS signature FROM {d_tags}")
def lane_signatures(r):
    return way_tags(r).select("way_id", tags.lane_signature(F.col("tags"), "forward").alias("signature"))


@query("SELECT way_id, CASE WHEN way_id % 3 = 0 THEN 'bus' WHEN way_id % 3 = 1 THEN 'bus,car' ELSE 'bus,car' END AS forward, CASE WHEN way_id % 3 = 2 THEN 'bus' ELSE 'bus,car' END AS backward FROM {d_tags}")
def directional_access(r):
    k, modes = F.col("way_id"), F.array(F.lit("bus"), F.lit("car"))
    m = F.when(k % 3 == 0, F.create_map(F.lit("motor_vehicle:forward"), F.lit("no"), F.lit("bus:forward"), F.lit("yes"))).when(k % 3 == 2, F.create_map(F.lit("motor_vehicle:backward"), F.lit("no"), F.lit("bus:backward"), F.lit("yes"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    one = lambda way: joined(F.array_sort(tags.direction_modes(m, modes, way, ("bus", "car"))))
    return r("d_tags").select("way_id", one("forward").alias("forward"), one("backward").alias("backward"))


@query("SELECT link_id, CASE link_id % 5 WHEN 0 THEN 'u_turn' WHEN 1 THEN 'through' WHEN 2 THEN 'left' WHEN 3 THEN 'right' ELSE 'unknown' END AS type FROM {d_links}")
def movement_types(r):
    k = F.col("link_id") % 5
    x = F.when(k == 0, -3.0).when(k == 1, 2.0).when(k == 2, 0.1).when(k == 3, -0.1).otherwise(0.0)
    y = F.when(k == 0, 0.1).when(k == 1, 0.1).when(k == 2, 5.0).when(k == 3, -5.0).otherwise(0.0)
    return r("d_links").select("link_id", geometry.movement_type(F.lit(2.0), F.lit(0.0), x, y).alias("type"))


@query("SELECT way_id, CASE WHEN way_id % 7 < 2 THEN 'signalized' WHEN way_id % 7 = 2 THEN 'semantic_node_tag' ELSE '' END AS reasons FROM {d_tags}")
def node_reasons(r):
    """Every node is the middle of a way of three nodes in a line, with tags by its id."""
    k = F.col("way_id")
    ident = text("way_id")
    ways = r("d_tags").select(ident.alias("way_id"), F.array(F.concat(F.lit("p"), ident), F.concat(F.lit("q"), ident)).alias("refs"))
    tag = F.when(k % 7 == 0, F.create_map(F.lit("highway"), F.lit("traffic_signals"))).when(k % 7 == 1, F.create_map(F.lit("traffic_signals"), F.lit("signal"))).when(k % 7 == 2, F.create_map(F.lit("highway"), F.lit("give_way"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    nodes = r("d_tags").select(F.concat(F.lit("p"), ident).alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), tag.alias("tags"))
    none = nodes.limit(0).select("node_id")
    got = roads.classify_nodes(ways, nodes, none).filter(F.col("node_id").startswith("p"))
    return got.select(F.substring("node_id", 2, 20).cast("long").alias("way_id"), joined(F.col("reasons")).alias("reasons"))


@query("SELECT DISTINCT from_link, to_link, 'bus,car' AS modes FROM (SELECT CAST(o_custkey AS VARCHAR) AS from_link, CAST(o_orderkey % 10 AS VARCHAR) AS to_link FROM orders)")
def restriction_index(r):
    f = r("orders").select(text("o_custkey").alias("from_link"), (F.col("o_orderkey") % 10).cast("string").alias("to_link"), F.explode(F.array(F.lit("car"), F.lit("bus"))).alias("mode"))
    return roads.restriction_index(f).withColumn("modes", joined(F.col("modes")))


# --- chains ---------------------------------------------------------------------------------------------


def chain_rows(r) -> DataFrame:
    """The calls of a trip as the segments of one road, 100 m for each unit of quantity."""
    c = r("d_calls")
    side = F.struct(F.array(F.lit("car")).alias("modes"))
    return c.select(F.col("trip_id").alias("chain"), F.col("stop_sequence").alias("pos"), F.concat("trip_id", F.lit("-"), text("stop_sequence")).alias("head"), (F.col("q") * 100.0).alias("length"), side.alias("own"), side.alias("other"))


@query("""+ w(trip_id, seq, total, kept) AS (SELECT trip_id, stop_sequence, CASE WHEN q * 100 > 3000 THEN 0 ELSE q * 100 END, q * 100 > 3000 FROM {d_calls} WHERE stop_sequence = 1 UNION ALL SELECT c.trip_id, c.stop_sequence, CASE WHEN w.total + c.q * 100 > 3000 THEN 0 ELSE w.total + c.q * 100 END, w.total + c.q * 100 > 3000 FROM w JOIN {d_calls} c ON c.trip_id = w.trip_id AND c.stop_sequence = w.seq + 1)
  SELECT w.trip_id || '-' || seq AS node_id FROM w WHERE kept AND seq < (SELECT MAX(stop_sequence) FROM {d_calls} c WHERE c.trip_id = w.trip_id)""")
def length_cap(r):
    return network.cap_length(chain_rows(r), 3000.0)


# --- stops, feeds, schedules ----------------------------------------------------------------------------


@query("SELECT CAST(CASE s_suppkey % 5 WHEN 0 THEN 'stop_position' WHEN 1 THEN 'bus_stop' WHEN 2 THEN 'rail_halt' WHEN 3 THEN 'ferry_terminal' END AS VARCHAR) AS kind, CAST(s_suppkey AS VARCHAR) AS ref, CASE s_suppkey % 5 WHEN 0 THEN 'tram' WHEN 1 THEN 'bus' WHEN 2 THEN 'rail' ELSE 'ferry' END AS modes, CASE WHEN s_suppkey BETWEEN 1 AND 25 THEN 'r' || s_suppkey ELSE '' END AS relations FROM supplier WHERE s_suppkey % 5 < 4")
def stop_hints(r):
    k, one = F.col("s_suppkey") % 5, lambda *kv: F.create_map(*map(F.lit, kv))
    tag = F.when(k == 0, one("public_transport", "stop_position", "tram", "yes")).when(k == 1, one("highway", "bus_stop")).when(k == 2, one("railway", "halt")).when(k == 3, one("amenity", "ferry_terminal")).otherwise(one("x", "y"))
    nodes = r("supplier").select(text("s_suppkey").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), tag.alias("tags"))
    ways = nodes.limit(0).select(F.col("node_id").alias("way_id"), F.array("node_id").alias("refs"), "tags")
    n = F.col("n_nationkey") + 1
    members = r("nation").select(F.concat(F.lit("r"), n.cast("string")).alias("relation_id"), F.lit(0).alias("pos"), F.lit("node").alias("type"), n.cast("string").alias("ref"), F.lit("stop").alias("role"))
    kinds = r("nation").select(F.concat(F.lit("r"), n.cast("string")).alias("relation_id"), one("type", "route").alias("tags"))
    return roads.stop_hints(nodes, ways, members, kinds).select("kind", "ref", joined(F.col("modes")).alias("modes"), joined(F.col("relations")).alias("relations"))


@query("SELECT 'way' AS source, CAST(way_id AS VARCHAR) AS ref, ROUND(AVG(x), 4) AS x, ROUND(AVG(y), 4) AS y FROM {d_refs} JOIN {d_nodes} USING (node_id) GROUP BY way_id")
def way_stop_places(r):
    nodes = r("d_nodes").select(text("node_id").alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.create_map(F.lit("x"), F.lit("y")).alias("tags"))
    ways = r("d_refs").groupBy(text("way_id").alias("way_id")).agg(F.collect_list(text("node_id")).alias("refs")).withColumn("tags", F.create_map(F.lit("public_transport"), F.lit("platform")))
    none = nodes.limit(0)
    hints = roads.stop_hints(nodes, ways, none.select(F.col("node_id").alias("relation_id"), F.lit("way").alias("type"), F.col("node_id").alias("ref")), none.select(F.col("node_id").alias("relation_id"), "tags"))
    return hints.select("source", "ref", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT feed || ':' || route_id AS route_id, route_type, feed AS feed_id FROM {d_routes}, (VALUES ('north'), ('south-2')) AS t(feed)")
def feeds_union(r):
    return timetable.union_feeds({"north": r("d_routes").drop("route_no"), "south-2": r("d_routes").drop("route_no")}, ["route_id"])


@query("+ p AS (SELECT route_id AS pattern, MIN(trip_id) AS trip_id FROM {d_trips} GROUP BY 1) SELECT pattern, MIN(exact_times) AS exact_times FROM p JOIN {d_more_frequencies} USING (trip_id) GROUP BY 1")
def exact_times_of_patterns(r):
    return timetable.strictest_exact_times(r("d_more_frequencies"), r("d_trips").select(F.col("route_id").alias("pattern"), "trip_id"))


@query("SELECT s_suppkey AS stop_id FROM supplier WHERE s_suppkey % 3 <> 1 AND s_nationkey <> 0")
def platform_stops(r):
    k = F.col("s_suppkey")
    stops = r("supplier").select(k.alias("stop_id"), F.when(k % 3 == 1, 1).when(k % 3 == 2, 0).alias("location_type"), F.col("s_nationkey").cast("double").alias("stop_lat"), F.lit(0.0).alias("stop_lon"))
    return timetable.platforms(stops).select("stop_id")


@query("+ x AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, LAG(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) SELECT o_custkey AS route_id, o_orderkey AS pos, p AS link_id FROM x WHERE b IS NULL OR b <> p")
def repeats_collapsed(r):
    rows = r("orders").select(F.lit("l").alias("line_id"), F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("link_id"))
    return mapping.collapse_repeats(rows).select("route_id", "pos", "link_id")


@query("""SELECT 'R' || s_suppkey AS route_id, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN 'ab' || s_suppkey WHEN 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'connector' ELSE 'bc' || s_suppkey END WHEN 2 THEN 'cd' || s_suppkey WHEN 3 THEN 'connector' ELSE 'loop' END AS link_id FROM supplier, (VALUES (0), (1), (2), (3), (4)) AS t(p)""")
def mapped_routes(r):
    """A route a supplier: two stops on links with a third between (missing for every third), and one off the network."""
    s, n = r("supplier"), text("s_suppkey")
    link = lambda name, a, b: F.struct(F.concat(F.lit(name), n).alias("link_id"), F.concat(F.lit(a), n).alias("from_id"), F.concat(F.lit(b), n).alias("to_id"))
    k = s.select(F.explode(F.array(link("ab", "a", "b"), F.when(F.col("s_suppkey") % 3 != 0, link("bc", "b", "c")), link("cd", "c", "d"))).alias("k")).filter("k is not null").select("k.*", F.lit(10.0).alias("length"), F.array(F.lit("bus")).alias("modes"))
    stop = lambda i: F.concat(F.lit(f"s{i}-"), n)
    stops = s.select(F.explode(F.array(stop(0), stop(1), stop(2))).alias("stop_id")).select("stop_id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    calls = s.select(F.lit("line").alias("line_id"), F.concat(F.lit("R"), n).alias("route_id"), F.posexplode(F.array(stop(0), stop(1), stop(2))).alias("pos", "stop_id")).withColumn("mode", F.lit("bus"))
    cand = s.select(F.explode(F.array(F.struct(stop(0).alias("point_id"), F.concat(F.lit("ab"), n).alias("link_id")), F.struct(stop(1).alias("point_id"), F.concat(F.lit("cd"), n).alias("link_id")))).alias("c")).select("c.*", F.lit("bus").alias("mode"), F.lit(1).alias("candidate_rank"))
    out = mapping.map_routes(calls, stops, cand, k)["route_links"]
    shown = F.when(F.col("link_id").startswith("pt_loop_"), "loop").when(F.col("link_id").startswith("pt_"), "connector").otherwise(F.col("link_id"))
    return out.select("route_id", "pos", shown.alias("link_id"))


@query("SELECT s_suppkey * 2 + 1 AS way_id FROM supplier WHERE s_suppkey % 3 <> 0")
def parallel_tracks(r):
    """Two rail ways a supplier, 10 m apart; every third pair 90 m."""
    s, k = r("supplier"), F.col("s_suppkey")
    far = F.when(k % 3 == 0, 90.0).otherwise(10.0)
    at = lambda name, x, y: F.struct(F.concat(F.lit(name), text("s_suppkey")).alias("node_id"), x.alias("x"), y.alias("y"))
    nodes = s.select(F.explode(F.array(at("a", k * 1000.0, F.lit(0.0)), at("b", k * 1000.0 + 200, F.lit(0.0)), at("c", k * 1000.0, far), at("d", k * 1000.0 + 200, far))).alias("n")).select("n.*")
    refs = lambda a, b: F.array(F.concat(F.lit(a), text("s_suppkey")), F.concat(F.lit(b), text("s_suppkey")))
    ways = s.select((k * 2).alias("way_id"), F.lit("rail").alias("railway"), refs("a", "b").alias("refs")).unionByName(s.select((k * 2 + 1).alias("way_id"), F.lit("rail").alias("railway"), refs("d", "c").alias("refs")))
    return spatial.parallel_tracks(ways, nodes)


@query("+ u AS (SELECT 'x' || s_suppkey % 20 AS departure_id FROM supplier) SELECT s_suppkey AS vehicle_id FROM supplier WHERE 'x' || s_suppkey IN (SELECT departure_id FROM u)")
def pruned_vehicles(r):
    v = r("supplier").select(F.col("s_suppkey").alias("vehicle_id"), F.concat(F.lit("x"), text("s_suppkey")).alias("key"))
    used = r("supplier").select(F.concat(F.lit("x"), (F.col("s_suppkey") % 20).cast("string")).alias("key"))
    return timetable.used_vehicles(v, used, "key").select("vehicle_id")


# --- network guards -------------------------------------------------------------------------------------


@query("SELECT l.link_id FROM {d_links} l WHERE l.from_id % 10 <> 3 AND l.to_id % 10 <> 3 OR l.to_id = -1 AND l.from_id % 10 <> 3")
def nodes_removed(r):
    k = links(r)
    return network.remove_nodes(r("d_nodes"), k, r("d_nodes").filter("node_id % 10 = 3"))[1].select("link_id")


@query("+ g AS (SELECT node_id FROM {d_nodes}) SELECT l.link_id, a.x AS from_x, b.y AS to_y FROM {d_links} l JOIN {d_nodes} a ON l.from_id = a.node_id JOIN {d_nodes} b ON l.to_id = b.node_id")
def required_ends(r):
    n = r("d_nodes").select("node_id")
    k = r("d_links").join(n.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(n.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return network.require_ends(k, r("d_nodes")).select("link_id", "from_x", "to_y")


@query("SELECT 'error' AS severity, 'duplicate_id' AS code, CAST(o_custkey AS VARCHAR) AS object_id FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def duplicate_ids(r):
    return validate.duplicate_ids(r("orders").select(text("o_custkey").alias("id")), "id", "network").select("severity", "code", "object_id")


LANES = """+ x AS (SELECT o_orderkey AS k, 'l' || o_custkey AS link_id FROM orders)"""


@query(LANES + """ SELECT 'lanes.no_leads_to' AS code, COUNT(*) AS n FROM x WHERE k % 11 = 0 HAVING COUNT(*) > 0 UNION ALL SELECT 'lanes.malformed_value', COUNT(*) FROM x WHERE k % 13 = 0 HAVING COUNT(*) > 0 UNION ALL SELECT 'lanes.missing_parent_link', COUNT(DISTINCT link_id) FROM x WHERE link_id NOT IN (SELECT 'l' || c_custkey FROM customer WHERE c_custkey % 2 = 0) HAVING COUNT(*) > 0""")
def lane_issue_counts(r):
    o, k = r("orders"), F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("l"), text("o_custkey")).alias("link_id"), text("o_orderkey").alias("lane_id"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("l2"))).alias("to_links"), F.array().cast("array<string>").alias("to_lanes"), F.when(k % 13 == 0, "many").otherwise("900").alias("capacity"), F.lit("1").alias("starts_at"), F.lit("0").alias("alignment"), F.col("o_custkey").alias("assignment"))
    known = r("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("l"), text("c_custkey")).alias("link_id"))
    return validate.lane_issues(rows, known).groupBy("code").agg(F.count("*").alias("n"))


# --- scalar functions -----------------------------------------------------------------------------------


@query("""+ t AS (SELECT a.node_id, a.x / 1000.0 AS ax, a.y / 1000.0 AS ay, b.x / 1000.0 AS bx, b.y / 1000.0 AS by_, c.x / 1000.0 AS cx, c.y / 1000.0 AS cy FROM {d_nodes} a JOIN {d_nodes} b ON b.node_id = a.node_id + 1 JOIN {d_nodes} c ON c.node_id = a.node_id + 2)
  SELECT node_id, ROUND(abs(radians(bx - ax) * (2 + sin(radians(ay)) + sin(radians(by_))) + radians(cx - bx) * (2 + sin(radians(by_)) + sin(radians(cy))) + radians(ax - cx) * (2 + sin(radians(cy)) + sin(radians(ay)))) * 6371000.0 * 6371000.0 / 2 / 1000000, 3) AS km2 FROM t""")
def spherical_areas(r):
    ring = F.transform("ring", lambda p: geometry.point(p["x"] / 1000, p["y"] / 1000))
    return triangles(r).select("node_id", F.round(geometry.spherical_area(ring) / 1000000, 3).alias("km2"))


@query("SELECT node_id, CAST(2 AS INT) AS n, CAST(x + 0.5 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {d_nodes}")
def wkt_round_trip(r):
    line = F.array(geometry.point(F.col("x") + 0.5, F.col("y").cast("double")), geometry.point(F.lit(1.25), F.lit(-3.0)))
    got = geometry.from_wkt(geometry.to_wkt(line))
    return r("d_nodes").select("node_id", F.size(got).alias("n"), got[0]["x"].alias("x"), got[0]["y"].alias("y"))


@query("SELECT link_id, '{\"bus\":[[\"a\",\"' || link_id || '\"]],\"car\":[[\"b\"]]}' AS json, CAST(link_id AS VARCHAR) AS last FROM {d_links}")
def disallowed_json(r):
    by = F.create_map(F.lit("car"), F.array(F.array(F.lit("b"))), F.lit("bus"), F.array(F.array(F.lit("a"), text("link_id"))))
    out = r("d_links").select("link_id", ids.disallowed_to_json(by).alias("json"))
    return out.withColumn("last", ids.disallowed_from_json(F.col("json"))["bus"][0][1])


@query("SELECT link_id, sha256(CAST(link_id AS VARCHAR) || chr(0) || CAST(from_id AS VARCHAR)) AS key FROM {d_links}")
def lane_keys(r):
    return r("d_links").select("link_id", F.sha2(ids.scoped_lane_key(text("link_id"), text("from_id")).cast("binary"), 256).alias("key"))


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 30 * 3600 + 5 * 60 + 9 ELSE time END AS INT) AS seconds FROM {d_events}")
def timetable_times(r):
    t, k = F.col("time"), F.col("event_id") % 5
    said = F.when(k == 0, " ").when(k == 1, "30:05:09").otherwise(F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60))
    return r("d_events").select("event_id", times.timetable_seconds(said).alias("seconds"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 7 END AS INT) AS whole, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 3 THEN 7.0 ELSE 0.5 END AS real FROM {d_events}")
def lenient_numbers(r):
    k = F.col("event_id") % 4
    said = F.when(k == 0, text("event_id")).when(k == 1, "x1").when(k == 2, "").otherwise(" 7 ")
    return r("d_events").select("event_id", times.lenient_int(said, -1).alias("whole"), times.lenient_double(said, 0.5).alias("real"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a_b' || s_suppkey WHEN 1 THEN 'feed' ELSE 'x-' || s_suppkey END AS feed_id FROM supplier")
def feed_ids(r):
    k, n = F.col("s_suppkey") % 3, text("s_suppkey")
    path = F.when(k == 0, F.concat(F.lit("/in/__a é b"), n, F.lit(".zip"))).when(k == 1, "/in/--.gtfs").otherwise(F.concat(F.lit("dir/x-"), n, F.lit(".ZIP")))
    return r("supplier").select("s_suppkey", ids.feed_id_of_path(path).alias("feed_id"))


@query("SELECT way_id, CASE WHEN way_id % 2 = 0 THEN '4326' ELSE '3857' END AS crs, CAST(way_id % 160 - 80 AS DOUBLE) AS lon, CAST(way_id % 120 - 60 AS DOUBLE) AS lat FROM {d_tags}")
def projection_round_trip(r):
    lon, lat = (F.col("way_id") % 160 - 80).cast("double"), (F.col("way_id") % 120 - 60).cast("double")
    x, y = geometry.to_mercator(lon, lat)
    a, b = geometry.from_mercator(x, y)
    even = F.col("way_id") % 2 == 0
    return r("d_tags").select("way_id", F.when(even, "4326").otherwise("3857").alias("crs"), F.round(F.when(even, lon).otherwise(a), 6).alias("lon"), F.round(F.when(even, lat).otherwise(b), 6).alias("lat"))


@query("SELECT way_id, 'osm_way_' || way_id || '_3_f' AS link_id, 'osm_node_' || way_id AS node_id, 'sim_' || way_id || '_r_1_2' AS chain_id FROM {d_tags}")
def generated_ids(r):
    way = text("way_id")
    return r("d_tags").select("way_id", ids.way_link_id(way, F.lit(3), F.lit(True)).alias("link_id"), ids.node_id(way).alias("node_id"), ids.contracted_link_id(way, F.lit(False), F.lit("1"), F.lit("2")).alias("chain_id"))


@query("SELECT way_id, 'link' AS first, CASE WHEN way_id % 2 = 0 THEN 'a.b' ELSE 'c' END AS last FROM {d_tags}")
def ids_decomposed(r):
    parts = ids.decompose(ids.compose(".", F.lit("link"), text("way_id"), F.when(F.col("way_id") % 2 == 0, "a.b").otherwise("c")), ".")
    return r("d_tags").select("way_id", parts[0].alias("first"), parts[2].alias("last"))


@query("+ c AS (SELECT o_orderdate AS date, COUNT(*) AS trips FROM orders GROUP BY 1) SELECT CAST(date AS DATE) AS date, trips, CAST(ROW_NUMBER() OVER (ORDER BY trips DESC, date) AS INT) AS rank FROM c")
def ranked_dates(r):
    counts = r("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("trips"))
    return calendar.rank_dates(counts, "trips")


# --- lane hints, lookups, streams of persons, where a network comes from -----------------------------------


def hinted(r) -> tuple[DataFrame, DataFrame]:
    """(d_links as links of way link id in forward direction, lane hints of those on a car road)."""
    k = links(r).select(text("link_id").alias("link_id"), text("from_id").alias("from_id"), text("to_id").alias("to_id"), "lanes", F.col("link_id").alias("way_id"), F.lit(True).alias("forward"), "modes")
    i = F.col("way_id") % 3
    tag = F.when(i == 0, F.create_map(F.lit("bus:lanes:forward"), F.lit("designated|yes|no"), F.lit("turn:lanes"), F.lit("left|right"))).when(i == 1, F.create_map(F.lit("psv:lanes"), F.lit(" 2 "), F.lit("turn:lanes:forward"), F.lit(" "))).otherwise(F.create_map(F.lit("bus"), F.lit("designated")))
    count = lambda n: F.struct(n.alias("lanes"))
    ways = r("d_tags").filter("highway is not null").select("way_id", tag.alias("tags"), count((F.col("way_id") % 4 + 1).cast("int")).alias("fwd_count"), count(F.lit(1)).alias("bwd_count"))
    return k, lanes.lane_hints(k, ways)


HINTS = "+ h AS (SELECT CAST(way_id AS VARCHAR) AS link_id, way_id, CAST(way_id % 4 + 1 AS DOUBLE) AS total_lanes, CASE WHEN way_id % 3 = 0 THEN 2.0 ELSE 0.0 END AS bus_lanes, CASE WHEN way_id % 3 = 1 THEN 2.0 ELSE 0.0 END AS psv_lanes, CASE WHEN way_id % 3 = 0 THEN 'left|right' END AS turn_lanes FROM {d_tags} WHERE highway IS NOT NULL) "


@query(HINTS + "SELECT link_id, way_id, total_lanes, CAST(bus_lanes AS DOUBLE) AS bus_lanes, CAST(psv_lanes AS DOUBLE) AS psv_lanes, turn_lanes, TRUE AS dedicated FROM h")
def lane_hints(r):
    return hinted(r)[1].select("link_id", "way_id", "total_lanes", "bus_lanes", "psv_lanes", "turn_lanes", "dedicated")


@query(HINTS + """, i AS (SELECT l.to_id AS node_id, string_agg(CAST(l.link_id AS VARCHAR) || '=' || CAST(COALESCE(total_lanes, lanes) AS INT), ',' ORDER BY CAST(l.link_id AS VARCHAR)) AS approaches, COUNT(turn_lanes) AS n_turn_lanes FROM {d_links} l LEFT JOIN h ON h.way_id = l.link_id GROUP BY 1), o AS (SELECT from_id AS node_id, COUNT(*) AS n_out FROM {d_links} GROUP BY 1)
  SELECT CAST(n.node_id AS VARCHAR) AS node_id, COALESCE(approaches, '') AS approaches, CAST(COALESCE(n_turn_lanes, 0) AS INT) AS n_turn_lanes, CAST(COALESCE(n_out, 0) AS INT) AS n_out, n.node_id % 5 = 0 AS traffic_signal FROM {d_nodes} n LEFT JOIN i USING (node_id) LEFT JOIN o USING (node_id) WHERE i.node_id IS NOT NULL OR o.node_id IS NOT NULL""")
def intersection_hints(r):
    k, hints = hinted(r)
    nodes = r("d_nodes").select(text("node_id").alias("node_id"))
    out = lanes.intersection_hints(nodes, k, hints, nodes.filter("node_id % 5 = 0"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("approach_lanes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ",")
    return out.select("node_id", pairs.alias("approaches"), F.size("turn_lanes").alias("n_turn_lanes"), F.size("outgoing").alias("n_out"), "traffic_signal")


@query(HINTS + "SELECT link_id, total_lanes FROM h WHERE way_id % 10 = 1")
def lane_hint_lookup(r):
    k, hints = hinted(r)
    index = spatial.NetworkIndex(r("d_nodes"), k, lane_hints=hints)
    return index.hints_of(k.filter("way_id % 10 = 1")).select("link_id", "total_lanes")


@query("""+ d AS (SELECT s.point_id, n.node_id, sqrt(CAST((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) AS DOUBLE)) AS dist FROM {d_stops} s, {d_nodes} n WHERE abs(s.x - n.x) <= 400 AND abs(s.y - n.y) <= 400), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY dist, node_id) AS k FROM d WHERE dist <= 400) SELECT point_id, node_id FROM k WHERE k <= 3""")
def network_index(r):
    return spatial.NetworkIndex(r("d_nodes"), links(r)).nearest_nodes(r("d_stops").select("point_id", "x", "y"), 3, 400.0).select("point_id", "node_id")

"""Graph, spatial, mapping, source and stream operators against brute force and round trips."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tramline.operators import mapping, network, roads, signals, spatial, validate
from tramline.sinks import xml_files
from tramline.sources import roadmap, scenario_xml
from tramline.streaming import events


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    while True:
        new = {n: set().union(*(out[b] for a, b in edges if a == n), out[n]) for n in nodes}
        if new == out:
            return out
        out = new


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(14), rng.randrange(14)) for _ in range(16)})
    nodes = {x for e in edges for x in e}
    df = spark.createDataFrame(edges, "a int, b int")
    both = reach(edges + [(b, a) for a, b in edges], nodes)
    for local in (network.LOCAL_EDGES, 0):
        assert {r["node"]: r["component"] for r in network.weak_components(df, local_edges=local).collect()} == {n: min(both[n]) for n in nodes}
    go = reach(edges, nodes)
    for local in (network.LOCAL_EDGES, 5, 0):
        assert {r["node"]: r["component"] for r in network.strong_components(df, local).collect()} == {n: min(m for m in go[n] if n in go[m]) for n in nodes}


def test_rings_are_anchored(spark):
    own = F.struct(F.array(F.lit("car")).alias("modes"), F.lit(1.0).alias("speed"), F.lit(1).alias("lanes"), F.lit("").alias("signature"), F.lit(True).alias("open"))
    ring = spark.createDataFrame([("w", i, f"n{i}", f"n{(i + 1) % 4}", 10.0, 600.0) for i in range(4)], "way_id string, idx int, a string, b string, length double, per_lane double").withColumns({"fwd": own, "bwd": own})
    contractible = network.contractible_nodes(ring)
    assert contractible.count() == 4
    routing = network.anchor_cycles(ring, contractible.limit(0))
    assert [r[0] for r in routing.collect()] == ["n0"]
    links = network.contracted_links(network.chains(ring, routing)).collect()
    assert len(links) == 2 and {r["length"] for r in links} == {40.0} and all(r["from_id"] == r["to_id"] == "osm_node_n0" for r in links)
    assert len({r["link_id"] for r in links}) == 2


def test_nearest_links_equal_brute_force(spark):
    rng = random.Random(3)
    nodes = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(30)]
    links = [(i, rng.randrange(30), rng.randrange(30)) for i in range(40)]
    points = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(15)]
    at = {i: (x, y) for i, x, y in nodes}

    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        s = dx * dx + dy * dy
        t = 0 if s == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / s))
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    want = set()
    for i, x, y in points:
        near = [(distance((x, y), at[a], at[b]), k) for k, a, b in links]
        want |= {(i, k) for d, k in sorted(near)[:3] if d <= 120}
    got = spatial.nearest_links(spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(links, "link_id int, from_id int, to_id int"), spark.createDataFrame(nodes, "node_id int, x double, y double"), 3, 120.0)
    assert {(r["point_id"], r["link_id"]) for r in got.collect()} == want


def test_parallel_tracks_are_greedy(spark):
    nodes = spark.createDataFrame([(f"{w}{i}", 100.0 * i, 20.0 * n) for n, w in enumerate("abcd") for i in range(3)], "node_id string, x double, y double")
    ways = spark.createDataFrame([(w, "rail" if w != "d" else "tram", [f"{w}{i}" for i in range(3)]) for w in "abcd"], "way_id string, railway string, refs array<string>")
    # a takes b; c is near b only, which is gone, so it stays
    assert [r[0] for r in spatial.parallel_tracks(ways, nodes).collect()] == ["b"]


def test_forbidden_turns_and_mapping(spark, rows):
    links = spark.createDataFrame([("ab", "a", "b", 10.0), ("bc", "b", "c", 10.0), ("bd", "b", "d", 5.0), ("dc", "d", "c", 7.0), ("cz", "c", "z", 1.0), ("xx", "x", "y", 1.0)], "link_id string, from_id string, to_id string, length double").withColumn("modes", F.array(F.lit("car")))
    pairs = spark.createDataFrame([("ab", "cz", "car"), ("ab", "ab", "car"), ("ab", "xx", "car")], "from_link string, to_link string, mode string")
    assert rows(mapping.paths(pairs, links).select("from_link", "to_link", "cost", F.array_join("path", ">"))) == [("ab", "ab", 0.0, "ab"), ("ab", "cz", 11.0, "ab>bc>cz")]
    shut = spark.createDataFrame([("ab", "car", ["bc"]), ("ab", "car", ["bd", "dc", "cz"])], "link_id string, mode string, sequence array<string>")
    assert rows(mapping.paths(pairs, links, shut.filter("size(sequence) = 1")).select("to_link", "cost", F.array_join("path", ">"))) == [("ab", 0.0, "ab"), ("cz", 13.0, "ab>bd>dc>cz")]
    assert rows(mapping.paths(pairs, links, shut).select("to_link")) == [("ab",)]
    assert rows(mapping.paths(pairs, links, None, 10.5).select("to_link")) == [("ab",)]
    stops = spark.createDataFrame([("s1", 0.0, 0.0), ("s2", 1.0, 1.0), ("s3", 9.0, 9.0)], "stop_id string, x double, y double")
    calls = spark.createDataFrame([("l", "r", i, s, "car") for i, s in enumerate(["s1", "s1", "s2", "s3"])], "line_id string, route_id string, pos int, stop_id string, mode string")
    cand = spark.createDataFrame([("s1", "car", "ab", 1), ("s2", "car", "cz", 1)], "point_id string, mode string, link_id string, candidate_rank int")
    out = mapping.map_routes(calls, stops, cand, links)
    path = [r["link_id"] for r in out["route_links"].orderBy("pos").collect()]
    assert path == ["ab", "bc", "cz", "pt_r_cz_pt_loop_s3_r_1_2", "pt_loop_s3_r_1"]
    assert {r["child_id"] for r in out["child_stops"].collect()} == {"s1.link:ab", "s2.link:cz", "s3.link:pt_loop_s3_r_1"}
    assert out["artificial_links"].count() == 2


def test_signal_clusters_and_lane_cycles(spark, rows):
    sig = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    links = spark.createDataFrame([("a", "m", 10.0, "primary_link"), ("m", "b", 10.0, "primary_link"), ("b", "c", 15.0, "primary_link")], "from_id string, to_id string, length double, link_class string")
    assert rows(signals.cluster_signals(sig, links, 0.0)) == [("a", "a"), ("b", "b"), ("c", "c")]
    # b-c is shorter and joins first; a-c has no path of its own, so a stays alone
    assert rows(signals.cluster_signals(sig, links, 30.0)) == [("a", "a"), ("b", "b"), ("c", "b")]
    lanes = spark.createDataFrame([("k", "1", "2"), ("k", "2", "3"), ("k", "3", "2"), ("k", "4", None), ("j", "1", "1")], "link_id string, lane_id string, next string")
    assert rows(roads.lane_cycles(lanes)) == [("j", "1"), ("k", "2"), ("k", "3")]


def test_movements_of_a_junction_of_two_signals(spark, rows):
    link = "link_id string, from_id string, to_id string, length double, link_class string, modes array<string>"
    car, both = ["car"], ["bus", "car"]
    links = spark.createDataFrame([("in", "x", "a", 9.0, "primary", both), ("ab", "a", "m", 5.0, "primary_link", car), ("mb", "m", "b", 5.0, "primary_link", car), ("out", "b", "y", 9.0, "primary", car), ("side", "z", "b", 9.0, "primary", car), ("back", "a", "x", 9.0, "primary", both), ("bus", "b", "q", 9.0, "primary", ["bus"])], link)
    sig = spark.createDataFrame([("a",), ("b",)], "node_id string")
    clusters, witnesses = signals.junction_clusters(sig, links, 30.0)
    assert rows(clusters) == [("a", "a"), ("b", "a")] and rows(witnesses) == [("a", ["a", "m", "b"])]
    assert rows(signals.witness_reach(clusters, witnesses)) == [("a", "a", "a"), ("a", "a", "b"), ("a", "b", "b")]  # one way
    forbidden = spark.createDataFrame([("in", "back", "car")], "from_link string, to_link string, mode string")
    moves = signals.cluster_movements(links, forbidden, clusters, witnesses)
    assert {(r["from_link"], r["to_link"]): (r["controlled"], r["legal"]) for r in moves.collect()} == {("in", "back"): (both, ["bus"]), ("in", "out"): (car, car), ("in", "bus"): (["bus"], ["bus"]), ("side", "out"): (car, car)}
    _, _, internal = signals.boundary_links(links, clusters, witnesses)
    assert rows(internal) == [("a", "ab"), ("a", "mb")]


def test_components_of_a_long_cycle():
    n = 50_000  # deeper than any recursion
    a, b = list(range(n)), [*range(1, n), 0]
    assert set(network._strong(a, b).values()) == {0} and set(network._weak(a, b).values()) == {0}
    assert network._strong(a[:-1], b[:-1]) == {i: i for i in range(n)}


def test_cells_of_a_long_link(spark):
    p = spark.createDataFrame([(0.0, 0.0, 100_000.0, 100_000.0), (5.0, 90_000.0, 5.0, -3.0), (7.0, 7.0, 7.0, 7.0)], "ax double, ay double, bx double, by double")
    got = p.select("ax", spatial._segment_cells(*(F.col(c) for c in ("ax", "ay", "bx", "by")), 100.0).alias("c")).groupBy("ax").count().collect()
    assert all(r["count"] < 7000 for r in got) and len(got) == 3


def test_nearest_links_equal_brute_force(spark):
    rng = random.Random(3)
    nodes = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(60)]
    links = [(i, rng.randrange(60), rng.randrange(60)) for i in range(80)]
    points = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(40)]
    df = lambda rows, names: spark.createDataFrame(rows, names)
    got = spatial.nearest_links(df(points, "point_id long, x double, y double"), df(links, "link_id long, from_id long, to_id long"), df(nodes, "node_id long, x double, y double"), 3, 150.0)

    def away(p, k):
        (ax, ay), (bx, by) = nodes[k[1]][1:], nodes[k[2]][1:]
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((p[1] - ax) * (bx - ax) + (p[2] - ay) * (by - ay)) / size)) if size else 0.0
        return ((ax + t * (bx - ax) - p[1]) ** 2 + (ay + t * (by - ay) - p[2]) ** 2) ** 0.5

    want = {(p[0], k) for p in points for d, k in sorted((away(p, k), k[0]) for k in links)[:3] if d <= 150.0}
    assert {(r["point_id"], r["link_id"]) for r in got.collect()} == want and want


def test_lane_rules(spark):
    lanes = spark.createDataFrame([("L", "a", ["M"], [], "900", "1", 1), ("L", "a", [], [], "x", "1", 1), ("N", None, ["Z"], [], "1", "1", 2), ("N", "b", ["M"], [], "1", "1", 3)], "link_id string, lane_id string, to_links array<string>, to_lanes array<string>, capacity string, starts_at string, assignment int")
    links = spark.createDataFrame([("L",), ("M",)], "link_id string")
    codes = {r["code"] for r in validate.lane_issues(lanes, links).collect()}
    assert codes == {"lanes.missing_lane_id", "lanes.no_leads_to", "lanes.malformed_value", "lanes.duplicate_lane", "lanes.duplicate_assignment", "lanes.missing_parent_link", "lanes.unresolved_link_ref"}
    with pytest.raises(ValueError):
        validate.require_none(validate.lane_issues(lanes, links))


PLANS = """<population><person id="p&amp;1"><attributes><attribute name="age" class="java.lang.Integer">40</attribute></attributes>
<plan selected="yes"><activity type="home" link="1" x="1.5" y="2" end_time="08:00:00"/><leg mode="car"><route type="links" start_link="1" end_link="3" trav_time="00:10:00" distance="12.5">1 2 3</route></leg>
<activity type="work" x="3" y="4" start_time="30000" maximumDuration="60"></activity><leg mode="walk"/><activity type="home" x="0" y="0"/></plan><plan selected="no"/></person></population>"""


def test_population_keeps_the_order_of_elements(spark, tmp_path):
    (tmp_path / "plans.xml").write_text(PLANS)
    t = scenario_xml.population(spark, str(tmp_path / "plans.xml"))
    got = t["elements"].orderBy("pos").collect()
    assert [r["kind"] for r in got] == ["activity", "leg", "activity", "leg", "activity"]
    assert got[1]["route"]["links"] == ["1", "2", "3"] and got[1]["route"]["travel_time"] == 600 and got[2]["start_time"] == 30000 and got[0]["end_time"] == 28800
    assert t["persons"].collect()[0]["attrs"]["age"]["val"] == "40" and t["plans"].count() == 2
    xml_files.population(t, str(tmp_path / "again.xml"))
    back = scenario_xml.population(spark, str(tmp_path / "again.xml"))
    assert [tuple(r) for r in back["elements"].orderBy("pos").collect()] == [tuple(r) for r in got]


def test_scenario_round_trip(spark, tmp_path, rows):
    c = spark.createDataFrame([("global", -1, None, "seed", "1"), ("score", 0, "activity", "type", "home")], "module string, set_idx int, set_type string, name string, value string")
    types = spark.createDataFrame([("t1", 4, 0, 7.5, 2.0, 1.0, 1.5)], "type_id string, seats int, standing int, length double, width double, access_time double, egress_time double")
    homes = spark.createDataFrame([("h", "100")], "household_id string, income string")
    members = spark.createDataFrame([("h", 0, "p1"), ("h", 1, "p2")], "household_id string, pos int, person_id string")
    vehicles = spark.createDataFrame([("v<1>", "t1")], "vehicle_id string, type_id string")
    xml_files.scenario({"config": c, "vehicle_types": types, "vehicles": vehicles, "households": homes, "household_members": members}, str(tmp_path))
    t = scenario_xml.scenario(spark, str(tmp_path / "config.xml"))
    assert rows(t["vehicles"]) == [("v<1>", "t1")] and rows(t["household_members"]) == [("h", 0, "p1"), ("h", 1, "p2")]
    r = t["vehicle_types"].collect()[0]
    assert (r["seats"], r["length"], r["egress_time"]) == (4, 7.5, 1.5)
    assert ("score", 0, "activity", "type", "home") in rows(t["config"])
    with pytest.raises(ValueError):
        xml_files.scenario({"vehicles": vehicles}, str(tmp_path))


def test_signal_files_round_trip(spark, tmp_path, rows):
    t = {
        "signals": spark.createDataFrame([("s", "1", "L", ["L_0"], ["M"])], "system_id string, signal_id string, link_id string, lane_refs array<string>, to_links array<string>"),
        "groups": spark.createDataFrame([("s", "g", "1")], "system_id string, group_id string, signal_id string"),
        "control": spark.createDataFrame([("s", "fixed", True)], "system_id string, controller string, has_controller boolean"),
        "plans": spark.createDataFrame([("s", 0, "p", 60, 5)], "system_id string, plan_idx int, plan_id string, cycle int, offset int"),
        "settings": spark.createDataFrame([("s", 0, "g", 0, 30)], "system_id string, plan_idx int, group_id string, onset int, dropping int"),
        "amber": spark.createDataFrame([(None, None, 1, 3), ("s", None, 1, 4), ("s", "1", None, 5)], "system_id string, signal_id string, red_amber int, amber int"),
        "intergreen": spark.createDataFrame([("s", "g", "h", 4)], "system_id string, ending string, beginning string, sec int"),
    }
    xml_files.signals(t, str(tmp_path))
    back = scenario_xml.signals(spark, *(str(tmp_path / f"{n}.xml") for n in ("systems", "groups", "control", "amber", "intergreen")))
    for name in ("signals", "groups", "control", "settings", "amber", "intergreen"):
        assert rows(back[name].select(t[name].columns)) == rows(t[name]), name
    links = spark.createDataFrame([("L",)], "link_id string")
    assert {r["code"] for r in validate.signal_issues(back, links).collect()} == {"TO_LINK_NOT_IN_NETWORK", "DANGLING_INTERGREEN_GROUP_REF"}


def event_file(path, rows):
    path.write_text("<events>" + "".join(f'<event time="{t}" type="{k}" vehicle="{v}" link="{n}"/>' for t, k, v, n in rows) + "</events>")


def test_event_stream_equals_batch(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    event_file(folder / "a.xml", [(1.0, "entered link", "v", "1"), (5.0, "left link", "v", "1"), (6.0, "entered link", "v", "2")])
    event_file(folder / "b.xml", [(7.0, "departure", "w", "9")])
    batch = scenario_xml.events(spark, str(folder))
    assert rows(events.link_traversals(batch)) == [("v", "1", 1.0, 5.0)]
    seen: dict[str, int] = {}
    add = lambda k: lambda df: seen.__setitem__(k, seen.get(k, 0) + df.count())
    q = events.dispatch(events.stream(spark, str(folder), 1), {"entered_link": add("entered")}, add("rest"))
    q.awaitTermination(60)
    assert seen == {"entered": 2, "rest": 2}
    q = events.counts(events.stream(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("event_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("event_counts")) == rows(events.counts(batch))


def vi(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def ln(field, body):
    return vi(field << 3 | 2) + vi(len(body)) + body


def zz(n):
    return vi(n << 1 if n >= 0 else (-n << 1) - 1)


def test_pbf(spark, tmp_path):
    strings = [b"", b"highway", b"primary", b"from", b"type", b"restriction"]
    table = b"".join(ln(1, s) for s in strings)
    dense = ln(1, zz(1) + zz(1) + zz(1)) + ln(8, zz(500000000) + zz(10) + zz(2000000000)) + ln(9, zz(-100000000) + zz(10) + zz(0)) + ln(10, vi(1) + vi(2) + vi(0) + vi(0) + vi(0))
    broken = ln(1, zz(1) + zz(1)) + ln(8, zz(1)) + ln(9, zz(1) + zz(1))
    way = vi(8) + vi(7) + ln(2, vi(1)) + ln(3, vi(2)) + ln(8, zz(1) + zz(1))
    rel = vi(8) + vi(9) + ln(2, vi(4)) + ln(3, vi(5)) + ln(8, vi(3)) + ln(9, zz(7)) + ln(10, vi(1))
    block = ln(1, table) + ln(2, ln(2, dense)) + ln(2, ln(3, way)) + ln(2, ln(4, rel)) + ln(2, ln(2, broken))
    data = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = vi(2 << 3) + vi(len(body)) + ln(3, zlib.compress(body))
        head = ln(1, kind) + vi(3 << 3) + vi(len(blob))
        data += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.osm.pbf").write_bytes(data)
    t = roadmap.read(spark, str(tmp_path / "x.osm.pbf"))
    nodes = {r["node_id"]: r for r in t["nodes"].collect()}
    assert set(nodes) == {"1", "2"} and abs(nodes["1"]["lat"] - 50) < 1e-9 and abs(nodes["2"]["lon"] + 9.999999) < 1e-9  # the third is beyond the pole
    assert nodes["1"]["tags"] == {"highway": "primary"} and nodes["2"]["tags"] == {}
    assert [tuple(r) for r in t["ways"].collect()] == [("7", ["1", "2"], {"highway": "primary"})]
    assert [tuple(r) for r in t["members"].collect()] == [("9", 0, "way", "7", "from")]
    assert [r["code"] for r in t["issues"].collect()] == ["pbf-malformed-dense-block"]


def test_smallest_region(spark):
    r = spark.createDataFrame([("world", -180.0, -90.0, 180.0, 90.0), ("small", 0.0, 0.0, 10.0, 10.0), ("near", 9.0, 9.0, 30.0, 30.0)], "name string, w double, s double, e double, n double")
    assert roadmap.smallest_region(r, (1, 1, 2, 2)).collect()[0]["name"] == "small"
    assert roadmap.smallest_region(r.filter("name <> 'world'"), (9.5, 9.5, 20, 20)).collect()[0]["name"] == "near"


@pytest.mark.parametrize(
    ("xml", "state", "dialect", "code"),
    [
        ('<laneDefinitions><lanesToLinkAssignment linkIdRef="L"><lane id="1"><leadsTo><toLink refId="M"/></leadsTo></lane></lanesToLinkAssignment></laneDefinitions>', "present", "v2.0", None),
        ('<laneDefinitions><lanesToLinkAssignment linkIdRef="L"><lane id="1"><toLink idRef="M"/></lane></lanesToLinkAssignment></laneDefinitions>', "present", "v1.1", None),
        ('<lanes><assignment linkId="L"><lane id="1" toLinkIds="M, L"/></assignment></lanes>', "present", "model-1.0", None),
        ('<laneDefinitions><lanesToLinkAssignment linkIdRef="L"><lane id="1"><toLink idRef="M"/></lane><lane id="2"><leadsTo><toLink refId="M"/></leadsTo></lane></lanesToLinkAssignment></laneDefinitions>', "invalid", None, "lanes.mixed_dialect"),
        ("<laneDefinitions/>", "unsupported", None, "lanes.ambiguous_dialect"),
        ('<laneDefinitions version="2.0"/>', "present", "v2.0", None),
        ("<network/>", "unsupported", None, "lanes.unsupported_root"),
        ('<laneDefinitions><lanesToLinkAssignment linkIdRef="L"><lane id="1"><leadsTo><toLink refId="Z"/></leadsTo></lane></lanesToLinkAssignment></laneDefinitions>', "invalid", "v2.0", "lanes.unresolved_link_ref"),
    ],
)
def test_lane_dialects(spark, tmp_path, xml, state, dialect, code):
    from tramline.sources import lane_files

    (tmp_path / "lanes.xml").write_text(f'<?xml version="1.0"?>\n<!-- a <comment> -->\n{xml}')
    got = lane_files.read(spark, str(tmp_path / "lanes.xml"), spark.createDataFrame([("L",), ("M",)], "link_id string"))
    assert (got["state"], got["dialect"]) == (state, dialect)
    assert [r["code"] for r in got["issues"].collect()] == ([code] if code else [])
    if dialect == "model-1.0":
        assert got["lanes"].collect()[0]["to_links"] == ["M", "L"]


def test_facilities_of_a_map(spark, tmp_path):
    from tests.fixtures import osm_xml
    from tramline.functions.geometry import projector
    from tramline.operators import facilities

    extra = '<node id="50" lat="0.01" lon="0.01"><tag k="amenity" v="taxi"/><tag k="shop" v="kiosk"/><tag k="name" v="K"/><tag k="addr:city" v="C"/></node>'
    corners = "".join(f'<node id="{60 + i}" lat="{0.001 * y}" lon="{0.001 * x}"/>' for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]))
    house = '<way id="70"><nd ref="60"/><nd ref="61"/><nd ref="62"/><nd ref="63"/><nd ref="60"/><tag k="building" v="apartments"/><tag k="building:levels" v="3"/></way>'
    (tmp_path / "m.osm").write_text(osm_xml().replace('<way id="100">', extra + corners + house + '<way id="100">', 1))
    t = roadmap.read(spark, str(tmp_path / "m.osm"))
    out = facilities.from_map(t["nodes"], t["ways"], projector("EPSG:3857")[0])
    acts = {r["facility_id"]: (r["type"], r["capacity"]) for r in out["facility_activities"].collect()}
    assert set(acts) == {"n50", "w70"} and acts["n50"] == ("work", None)
    area = (6_371_000 * 3.141592653589793 / 180 * 0.001) ** 2
    assert acts["w70"][0] == "home" and abs(acts["w70"][1] - area * 3 // 30) <= 1
    rows = {r["facility_id"]: r for r in out["facilities"].collect()}
    assert rows["n50"]["description"] == "K" and rows["n50"]["attrs"]["addr:city"]["val"] == "C"
    xml_files.facilities(out, str(tmp_path / "f.xml"))
    assert scenario_xml.facilities(spark, str(tmp_path / "f.xml"))["facility_activities"].count() == 2

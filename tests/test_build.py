import json
from datetime import date

from pyspark.sql import functions as F

from tests.fixtures import osm_xml, write_feed
from tramline.functions.geometry import projector
from tramline.operators import calendar, roads, timetable
from tramline.plans import build
from tramline.sources import roadmap, scenario_xml, timetable_csv


def test_feed_dates_offsets_and_departures(spark, rows, tmp_path):
    feed = timetable_csv.feed(spark, write_feed(tmp_path))
    assert feed["stops"].columns[0] == "stop_id"
    active = calendar.active_dates(feed["calendar"], feed["calendar_dates"])
    assert rows(active.filter("service_id = 'WD'")) == [("WD", date(2024, 1, d)) for d in range(2, 6)]
    assert rows(active.filter("service_id = 'WE'")) == [("WE", date(2024, 1, d)) for d in (3, 6, 7)]
    assert rows(calendar.all_dates(feed["calendar"], feed["calendar_dates"])) == [(date(2024, 1, d),) for d in range(2, 8)]
    by_date = calendar.trips_by_date(feed["trips"], feed["frequencies"], feed["calendar"], feed["calendar_dates"])
    # T1 1, T2 1 + 3 + 1, T4 1 on weekdays; T3 on the 3rd too
    assert {r["date"].day: r["trips"] for r in by_date.collect()} == {2: 7, 3: 8, 4: 7, 5: 7, 6: 1, 7: 1}
    assert rows(calendar.select_dates("most_trips", feed["trips"], feed["frequencies"], feed["calendar"], feed["calendar_dates"])) == [(date(2024, 1, 3),)]
    offsets = {(r["trip_id"], r["pos"]): (r["arrival_offset"], r["departure_offset"], r["await"]) for r in timetable.stop_offsets(feed["stop_times"]).collect()}
    assert offsets["T1", 1] == (600.0, 630.0, True)  # halfway, departures between 0 and 1260
    assert offsets["T1", 2] == (1200.0, 1260.0, True)
    s = build.schedule(feed, "f", "most_trips")
    deps = {r["departure_id"]: r["departure_time"] for r in s["departures"].collect()}
    assert deps["f:T1:20240103"] == 8 * 3600
    assert {k: v for k, v in deps.items() if ":T2:" in k} == {"f:T2:20240103:090000": 32400, "f:T2:20240103:092000": 33600, "f:T2:20240103:094000": 34800, "f:T2:20240103:093500": 34500, "f:T2:20240103:094500": 35100}
    assert rows(timetable.frequency_overlaps(feed["frequencies"])) == [("T2", 32400, 36000, 34500, 35400)]
    assert {(r["route_id"], r["mode"]) for r in s["routes"].collect()} == {("f:R1_r0", "pt"), ("f:R1_r1", "pt"), ("f:R2_r2", "tram")}
    assert rows(s["vehicle_types"]) == [("pt", 30, 45), ("tram", 60, 90)]


def test_road_network_contracts_and_cleans(spark, rows, tmp_path):
    (tmp_path / "map.osm").write_text(osm_xml())
    tables = roadmap.read(spark, str(tmp_path / "map.osm"))
    out = build.road_network(tables)
    ids = {r["link_id"]: r for r in out["links"].collect()}
    # nodes 3, 4, 7, 8 and 5, 1 don't end anything; the attributes change at 4, 8, 5 and 1
    assert "sim_100_f_2_4" in ids and "sim_100_r_2_4" in ids
    assert ids["sim_100_f_2_4"]["ways"] == ["100"] and ids["sim_100_f_2_4"]["n_segments"] == 2
    assert ids["sim_104_f_2_6"]["modes"] == ["bus", "car"] and "sim_104_r_2_6" not in ids
    assert abs(ids["sim_103_f_1_5"]["freespeed"] - 30 * 1.609344 / 3.6) < 1e-9 or abs(ids["sim_103_r_1_5"]["freespeed"] - 30 * 1.609344 / 3.6) < 1e-9
    assert not any(r["way_id"] == "105" for r in ids.values())  # the island
    codes = {r["code"] for r in out["issues"].collect()}
    assert "quarantined-component" in codes
    full = build.road_network(tables, roads.MATERIALIZED)
    assert full["links"].count() == 2 * (3 + 1 + 3 + 1 + 1) + 1
    # the length cap keeps nodes inside a chain
    short = build.road_network(tables, roads.RoadConfig(max_length=150.0, clean=False))
    assert short["links"].count() > build.road_network(tables, roads.RoadConfig(clean=False))["links"].count()


def test_signal_ready(spark, rows, tmp_path):
    (tmp_path / "map.osm").write_text(osm_xml())
    out = build.signal_ready(roadmap.read(spark, str(tmp_path / "map.osm")))
    assert rows(out["restriction_issues"]) == [("restriction-via-way-unsupported", "901")]
    # only_right_turn onto way 102 forbids no exit but those off way 102: there is none left at node 6
    assert out["forbidden"].count() == 0
    lanes = {(r["link_id"], r["lane_index"]): r for r in out["lanes"].collect()}
    assert lanes["sim_104_f_2_6", 0]["confidence"] == "present" and lanes["sim_104_f_2_6", 0]["raw"] == "left"
    assert len(lanes["sim_104_f_2_6", 0]["to_links"]) == 1
    ready = out["readiness"].collect()[0]
    assert ready["preserved_signal_nodes"] == ready["candidate_junctions"] == ready["confirmed_junctions"] == 1 and ready["via_way_restrictions"] == 1
    assert ready["preserved_semantic_nodes"] == out["nodes"].count() and ready["collapsed_geometry_nodes"] > 0
    junction = out["junctions"].collect()[0]
    assert junction["n_movements"] == out["movements"].count() > 0 and junction["provenance"].startswith("osm_node=") and junction["confidence"] == 2
    assert {r["type"] for r in out["movements"].collect()} >= {"u_turn", "through", "left"}


def test_bundle_round_trip(spark, rows, tmp_path):
    (tmp_path / "map.osm").write_text(osm_xml())
    feed, out = tmp_path / "feed", tmp_path / "out"
    feed.mkdir()
    out.mkdir()
    counts = build.bundle(spark, str(tmp_path / "map.osm"), write_feed(feed), str(out))
    assert counts["errors"] == 0 and counts["departures"] == 8 and counts["vehicles"] == 8
    net = scenario_xml.network(spark, str(out / "network.xml"))
    assert net["links"].count() == counts["links"] and net["nodes"].count() == counts["nodes"]
    sched = scenario_xml.schedule(spark, str(out / "schedule.xml"))
    calls = sched["route_stops"].join(sched["stop_facilities"], "stop_id")
    assert calls.count() == sched["route_stops"].count()
    links = {r["link_id"]: r for r in net["links"].collect()}
    for key in {(r["line_id"], r["route_id"]) for r in sched["routes"].collect()}:
        path = [r["link_id"] for r in sched["route_links"].filter((F.col("line_id") == key[0]) & (F.col("route_id") == key[1])).orderBy("pos").collect()]
        assert path and all(links[a]["to_id"] == links[b]["from_id"] for a, b in zip(path, path[1:], strict=False))
    assert len(json.loads((out / "stops.geojson").read_text())["features"]) == sched["stop_facilities"].count()
    assert projector("EPSG:3857")[1](F.lit(0.0), F.lit(0.0)) is not None


def test_feed_zip_equals_folder(spark, rows, tmp_path):
    import os
    import zipfile

    folder = write_feed(tmp_path)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name in os.listdir(folder):
            if name.endswith(".txt"):
                z.write(f"{folder}/{name}", f"inner/{name}")
    a, b = timetable_csv.feed(spark, folder), timetable_csv.feed(spark, f"file://{tmp_path}/feed.zip")
    assert a.keys() == b.keys() and all(rows(a[k].drop("row")) == rows(b[k].drop("row")) for k in a)

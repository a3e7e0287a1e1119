"""Scalar functions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import geometry, ids, tags, text, times


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).collect()[0]


def lit_tags(**kv):
    pairs = [x for k, v in kv.items() for x in (F.lit(k.replace("__", ":")), F.lit(v))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def test_ids(spark):
    r = one(spark, c=ids.compose(".", F.lit("a.b"), F.lit("c")), d=ids.decompose(F.lit("a..b.c"), "."), e=ids.encode_list(F.array(F.lit("a,b"), F.lit("c\\d"))), f=ids.decode_list(F.lit("a\\,b, ,c\\\\d")), g=ids.feed_id_of_path(F.lit("/x/My feed (1).zip")), h=ids.child_stop_id(F.lit("s.1"), F.lit("L")), i=ids.decode_list(F.lit(" ")))
    assert r["c"] == "a..b.c" and r["d"] == ["a.b", "c"] and r["e"] == "a\\,b,c\\\\d" and r["f"] == ["a,b", "c\\d"] and r["g"] == "My_feed_1" and r["h"] == "s..1.link:L" and r["i"] == []
    with pytest.raises(Exception, match="blank"):
        one(spark, x=ids.compose(".", F.lit("a"), F.lit(" ")))
    with pytest.raises(Exception, match="blank part"):
        one(spark, x=ids.decompose(F.lit("a."), "."))
    assert ids.unique_feed_ids(["a b", "a_b", "a-b", "a b", ""]) == ["a_b", "a_b-2", "a-b", "a_b-3", "feed"]
    m = F.create_map(F.lit("car"), F.array(F.array(F.lit("1"), F.lit("2"))), F.lit("bus"), F.array(F.array(F.lit("3"))))
    r = one(spark, j=ids.disallowed_to_json(m), b=ids.disallowed_from_json(ids.disallowed_to_json(m)))
    assert r["j"] == '{"bus":[["3"]],"car":[["1","2"]]}' and r["b"] == {"car": [["1", "2"]], "bus": [["3"]]}


def test_times(spark):
    r = one(spark, a=times.timetable_seconds(F.lit(" 25:01:02 ")), b=times.timetable_seconds(F.lit("")), c=times.clock_or_seconds(F.lit("26:00:30.5")), d=times.clock_or_seconds(F.lit("90.5")), e=times.clock_or_seconds(F.lit("1:60")), f=times.format_clock(F.lit(90061.0)), g=times.format_clock(F.lit(float("nan"))), h=times.compact_clock(F.lit(3723)), i=times.service_date(F.lit("20240230")), j=times.lenient_int(F.lit("4.5"), 7))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"], r["i"], r["j"]) == (90062, None, 93630.5, 90.5, None, "25:01:01", None, "010203", None, 7)
    with pytest.raises(Exception, match="not a time"):
        one(spark, x=times.clock_or_seconds(F.lit("soon"), strict=True))


def test_geometry(spark):
    p = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    square = F.array(p(0.0, 0.0), p(4.0, 0.0), p(4.0, 2.0), p(0.0, 2.0))
    closed, bow = geometry.close_ring(square), F.array(p(0.0, 0.0), p(2.0, 2.0), p(2.0, 0.0), p(0.0, 2.0), p(0.0, 0.0))
    r = one(
        spark, area=geometry.signed_area(closed), c=geometry.centroid(square), inside=geometry.in_ring(F.lit(1.0), F.lit(1.0), closed), out=geometry.in_ring(F.lit(5.0), F.lit(1.0), closed), x=geometry.self_intersects(bow), y=geometry.self_intersects(closed),
        s=geometry.to_segment(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)), z=geometry.to_segment(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), w=geometry.to_wkt(square), back=geometry.from_wkt(geometry.to_wkt(square)), bad=geometry.from_wkt(F.lit("POINT (1 2)")),
        earth=geometry.spherical_area(F.array(p(0.0, 0.0), p(1.0, 0.0), p(1.0, 1.0), p(0.0, 1.0))), crossing=geometry.crosses_ring(p(-1.0, 1.0), p(5.0, 1.0), closed),
    )
    assert r["area"] == 8 and (r["c"]["x"], r["c"]["y"]) == (2, 1) and r["inside"] and not r["out"] and r["x"] and not r["y"] and r["crossing"]
    assert (r["s"]["distance"], r["s"]["x"], r["s"]["fraction"]) == (math.hypot(1, 4), 2, 1) and (r["z"]["distance"], r["z"]["fraction"]) == (5, 0)
    assert r["w"].startswith("LINESTRING (0.0 0.0, 4.0 0.0") and len(r["back"]) == 4 and r["bad"] == []
    assert abs(r["earth"] / 12.36e9 - 1) < 0.01
    x, y = geometry.to_mercator(F.lit(13.4), F.lit(52.5))
    lon, lat = geometry.from_mercator(x, y)
    r = one(spark, x=x, y=y, lon=lon, lat=lat)
    assert abs(r["x"] - 1491681.18) < 0.5 and abs(r["lon"] - 13.4) < 1e-9 and abs(r["lat"] - 52.5) < 1e-9
    with pytest.raises(ValueError):
        geometry.projector("EPSG:25832")
    turns = {k: one(spark, t=geometry.turn_class(F.lit(1.0), F.lit(0.0), F.lit(math.cos(math.radians(k))), F.lit(math.sin(math.radians(k)))))["t"] for k in (0, 30, -30, 90, -90, 130, 170)}
    assert turns == {0: "through", 30: "slight_left", -30: "slight_right", 90: "left", -90: "right", 130: "sharp_left", 170: "reverse"}


def test_similarity(spark):
    s = lambda a, b: one(spark, s=text.similarity(F.lit(a), F.lit(b)))["s"]
    assert s("Main St.", "main  st") == 1 and s("Main Street", "Main Street West") == 0.75 and s("Old Main Road", "Main Avenue Road") == pytest.approx(2 / 3) and s("", "x") == 0 and s("ab cd", "ef gh") == 0


@pytest.mark.parametrize(
    ("kv", "modes", "want"),
    [
        ({}, ["car"], (["car"], ["car"])),
        ({"access": "no", "psv": "yes"}, ["bus", "car"], (["bus"], ["bus"])),
        ({"motor_vehicle": "no", "bus": "designated"}, ["bus", "car"], (["bus"], ["bus"])),
        ({"vehicle__backward": "no"}, ["car"], (["car"], [])),
        ({"oneway": "-1"}, ["car"], ([], ["car"])),
        ({"oneway": "reversible"}, ["car"], (["car"], ["car"])),
        ({"junction": "roundabout"}, ["car"], (["car"], [])),
        ({"access": "private"}, ["car"], (["car"], ["car"])),
    ],
)
def test_access(spark, kv, modes, want):
    t = tags.travel_modes(lit_tags(**kv), F.array(*map(F.lit, modes)), F.lit(False), ("bus", "car", "pt"))
    r = one(spark, t=t)["t"]
    assert (r["forward"], r["backward"]) == want


@pytest.mark.parametrize(
    ("kv", "one_way", "lanes", "confidence"),
    [
        ({}, False, 1, "absent"), ({"lanes": "4"}, False, 2, "even_split"), ({"lanes": "3"}, False, 2, "undetermined_split"), ({"lanes": "3", "lanes__forward": "2"}, False, 2, "present"), ({"lanes": "3", "lanes__backward": "1"}, False, 2, "present"),
        ({"lanes": "2", "lanes__forward": "2", "lanes__backward": "2"}, False, 1, "even_split"), ({"lanes": "2"}, True, 2, "present"), ({"lanes": "x"}, True, 1, "absent"), ({"lanes": "3", "lanes__forward": "2"}, True, 3, "present"), ({"lanes__forward": "2"}, False, 2, "present"),
    ],
)
def test_lane_counts(spark, kv, one_way, lanes, confidence):
    r = one(spark, c=tags.lane_count(lit_tags(**kv), True, F.lit(one_way), F.lit(1.0)))["c"]
    assert (r["lanes"], r["confidence"]) == (lanes, confidence)


def test_speed_and_cells(spark):
    speed = lambda **kv: one(spark, s=tags.speed(lit_tags(**kv), "forward", F.lit(9.0)))["s"]
    assert speed() == 9 and speed(maxspeed="36") == 10 and speed(maxspeed="none") == 9 and speed(maxspeed="400") == 9 and speed(maxspeed="72", maxspeed__forward="36 km/h") == 10 and speed(maxspeed="10 mph") == pytest.approx(4.4704) and speed(maxspeed="walk") == pytest.approx(5 / 3.6)
    cells = one(spark, c=tags.turn_lane_cells(F.lit("left;Through||none|merge_to_left|huh")))["c"]
    assert [c["turns"] for c in cells] == [["left", "through"], [], [], [], []] and cells[1]["empty"] and cells[2]["none"] and cells[3]["merge"] == "left" and cells[4]["unsupported"] == ["huh"]
    assert one(spark, c=tags.turn_lane_cells(F.lit(None).cast("string")))["c"] == []
    assert one(spark, d=tags.dedicated_lanes(lit_tags(bus__lanes="|designated|yes"), "bus", "forward"))["d"] == 2

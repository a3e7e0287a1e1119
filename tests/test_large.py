"""Steps that have to stay whole when tables and files are large: each is held against its definition on small input."""

import gzip

import pytest
from pyspark.sql import functions as F

from tramline.operators import lanes, roads
from tramline.sinks import xml_files as sinks
from tramline.sources import scenario_xml


def to_driver(spark, run) -> int:
    """Rows that jobs of run hand to the driver's Python one by one."""
    from pyspark.sql import DataFrame

    seen, real = 0, DataFrame.toLocalIterator

    def counted(self, *a, **k):
        nonlocal seen
        for r in real(self, *a, **k):
            seen += 1
            yield r

    DataFrame.toLocalIterator = counted
    try:
        run()
    finally:
        DataFrame.toLocalIterator = real
    return seen


@pytest.mark.parametrize("name", ["a.xml", "a.xml.gz"])
def test_a_file_is_written_by_executors(spark, tmp_path, name):
    rows = spark.range(1000).select((999 - F.col("id")).alias("k"))
    path = str(tmp_path / name)
    assert to_driver(spark, lambda: sinks.write_file(path, "t", ["<a>", sinks.lines(rows, ["k"], sinks.element("e", {"k": F.col("k")})), "</a>", sinks.lines(rows.limit(0), ["k"], F.lit("x"))])) == 0
    text = (gzip.open if name.endswith(".gz") else open)(path, "rt").read()
    assert text == '<?xml version="1.0" encoding="UTF-8"?>\n<t>\n<a>\n' + "".join(f'<e k="{i}"/>\n' for i in range(1000)) + "</a>\n</t>\n"


FILES = {
    "plain": '<t><e id="1" n="a&amp;b"/>\n<e id="2">x<v r="1"/><v r="2"/></e><es><e id="3"/></es></t>',
    "comment inside": '<t><e id="1"><!-- </e> --><v r="1"/></e><e id="2"/></t>',
    "comment around": '<t><!-- <e id="0"/> --><e id="1"/></t>',
    "cdata": '<t><e id="1"><v r="1"/><w><![CDATA[ <e id="0"/> ]]></w></e><e id="2"/></t>',
    "other space": '<t><e\nid="1"/><e id="2"/><e/></t>',
    "nested": '<t><e id="1"><v r="1"/><e id="2"/></e><e id="3"/></t>',
    "none": "<t><es/></t>",
    "leading space": '\n <t><e id="1"/></t>',
}


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("packed", [False, True])
def test_split_scan_equals_whole(spark, rows, tmp_path, name, packed):
    path = str(tmp_path / ("a.xml.gz" if packed else "a.xml"))
    with (gzip.open if packed else open)(path, "wt") as f:
        f.write(FILES[name])
    schema = "_id string, _n string, v array<struct<_r:string>>"
    whole = rows(scenario_xml.scan(spark, path, "e", schema, whole_bytes=1 << 30))
    assert rows(scenario_xml.scan(spark, path, "e", schema, whole_bytes=0)) == whole


def test_a_large_file_is_read_in_splits(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<t>" + "".join(f'<e id="{i}"><v r="{i}"/></e>\n' for i in range(5000)) + "</t>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = scenario_xml.scan(spark, str(tmp_path / "a.xml"), "e", "_id long", whole_bytes=0)
        assert got.rdd.getNumPartitions() > 4 and sorted(r[0] for r in got.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_children_apart_equal_the_parents_array(spark, rows, tmp_path, monkeypatch):
    lines = "".join(f'<transitLine id="l{i}"><transitRoute id="r{i}"><departures>' + "".join(f'<departure id="d{i}-{j}" departureTime="08:00:{j:02d}"/>' for j in range(50)) + "</departures></transitRoute><transitRoute id='x'/></transitLine>\n" for i in range(40))
    homes = "".join(f'<household id="h{i}"><members>' + "".join(f'<personId refId="p{j}"/>' for j in range(i % 7)) + "</members></household>\n" for i in range(40))
    (tmp_path / "s.xml").write_text(f"<transitSchedule>{lines}</transitSchedule>")
    (tmp_path / "h.xml").write_text(f"<households>{homes}</households>")
    read = lambda: (rows(scenario_xml.schedule(spark, str(tmp_path / "s.xml"))["departures"]), rows(scenario_xml.households(spark, str(tmp_path / "h.xml"))["household_members"]))
    whole = read()
    assert len(whole[0]) == 2000
    monkeypatch.setattr(scenario_xml.children, "__defaults__", (0,))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert read() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lane_cycles_end_when_nothing_changes(spark, rows, monkeypatch):
    from tramline.operators import staging

    staged, real = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: staged.append(name) or real(df, name))
    # a ring of 3 with a way of 10 into it, a way of 20 out, a lane that follows itself, a lane into nothing, many pairs
    pairs = [("a", "r0", "r1"), ("a", "r1", "r2"), ("a", "r2", "r0"), *[("a", f"t{i}", f"t{i + 1}") for i in range(9)], ("a", "t9", "r0"), *[("b", f"o{i}", f"o{i + 1}") for i in range(20)], ("b", "o20", None), ("c", "s", "s"), ("d", "n", "gone"), *[(f"k{i}", "1", "2") for i in range(500)], *[(f"k{i}", "2", "1") for i in range(500)]]
    got = rows(roads.lane_cycles(spark.createDataFrame(pairs, "link_id string, lane_id string, next string")))
    assert got == sorted([("a", "r0"), ("a", "r1"), ("a", "r2"), ("c", "s"), *[(f"k{i}", k) for i in range(500) for k in "12"]], key=repr)
    assert len(staged) <= 8


def test_links_that_share_lane_names_do_not_meet(spark, rows):
    n = 3000
    t = spark.range(n).select(F.concat(F.lit("l"), F.lpad("id", 5, "0")).alias("link_id"), F.explode(F.array(F.struct(F.lit("1").alias("lane_id"), F.array(F.lit("2")).alias("to_lanes")), F.struct(F.lit("2").alias("lane_id"), F.array(F.lit("1")).alias("to_lanes")), F.struct(F.lit("3").alias("lane_id"), F.array(F.lit("x")).alias("to_lanes")))).alias("x")).select("link_id", "x.*")
    t = t.unionByName(spark.createDataFrame([("z", "x", ["3"])], t.schema))
    plan = lanes.cycles_of(t)
    # lane 3 of all links leads to x of z, x to 3 of the least link: those two are a cycle
    assert rows(plan.filter("lane_id in ('3', 'x')")) == [("l00000", "3"), ("z", "x")] and plan.count() == 2 * n + 2


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_length_cap_walks_all_chains_of_a_task_in_one_pass(spark):
    from tramline.operators import network

    n, cap = 300, 250.0
    side = F.struct(F.array(F.lit("car")).alias("modes"))
    t = spark.range(n).select(F.col("id").cast("string").alias("chain"), F.explode(F.sequence(F.lit(0), (F.col("id") % 50).cast("int"))).alias("pos"))
    t = t.select("chain", "pos", F.concat_ws("-", "chain", "pos").alias("head"), (F.pmod(F.xxhash64("chain", "pos"), F.lit(100)) + 1).cast("double").alias("length"), side.alias("own"), side.alias("other")).orderBy("head")
    got = network.cap_length(t, cap)
    want = []
    for chain in {r["chain"] for r in t.collect()}:
        total, own = 0.0, sorted((r for r in t.filter(F.col("chain") == chain).collect()), key=lambda r: r["pos"]) if int(chain) < 60 else []
        for r in own:
            total += r["length"]
            if total > cap and r is not own[-1]:
                want.append(r["head"])
                total = 0.0
    assert sorted(r[0] for r in got.collect() if int(r[0].split("-")[0]) < 60) == sorted(want) and want
    assert "FlatMapGroupsInPandas" not in plan_of(got)  # a call for each chain


def test_stop_offsets_sort_once(spark):
    from tramline.operators import timetable

    t = spark.createDataFrame([("T", 1, 1, "a", 0, 0, 1), ("T", 2, 2, "b", None, None, 0)], "trip_id string, stop_sequence int, row long, stop_id string, arrival int, departure int, timepoint int")
    assert plan_of(timetable.stop_offsets(t)).split("== Initial Plan ==")[-1].count("Sort [") == 1


def crowd(spark, n, seed):
    """A dense place, an even spread and repeated coordinates."""
    h = lambda m, k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(m))
    x = lambda k: F.when(F.col("id") % 3 == 0, 500 + h(8, k) / 4).otherwise(h(1000, k).cast("double"))
    return spark.range(n).select(F.col("id").alias("i"), x(1).alias("x"), x(2).alias("y"))


def brute(spark, points, nodes, radius):
    p, m = points.collect(), nodes.collect()
    return {r["i"]: sorted((((r["x"] - q["x"]) ** 2 + (r["y"] - q["y"]) ** 2) ** 0.5, q["i"]) for q in m if ((r["x"] - q["x"]) ** 2 + (r["y"] - q["y"]) ** 2) ** 0.5 <= radius) for r in p}


def test_nearest_nodes_and_stops_near_equal_all_pairs(spark, rows, monkeypatch):
    from tramline.operators import spatial

    met, real = [], spatial._meet
    monkeypatch.setattr(spatial, "_meet", lambda many, few, reach, **k: met.append(reach) or real(many, few, reach, **k))
    points, nodes = crowd(spark, 150, 1), crowd(spark, 1500, 7)
    near = brute(spark, points, nodes, 200.0)
    got = spatial.nearest_nodes(points.withColumnRenamed("i", "point_id"), nodes.withColumnRenamed("i", "node_id"), 3, 200.0)
    assert sorted((r["point_id"], r["node_rank"], r["node_id"]) for r in got.collect()) == sorted((i, k + 1, q) for i, qs in near.items() for k, (_, q) in enumerate(qs[:3]))
    assert len(met) > 3 and max(met) <= 200.0  # it begins near and goes on only as far as it has to
    pairs = spatial.stops_near(points.withColumnRenamed("i", "point_id"), nodes.withColumnRenamed("i", "stop_id"), 200.0)
    assert sorted((r["point_id"], r["stop_id"]) for r in pairs.collect()) == sorted((i, q) for i, qs in near.items() for _, q in qs)
    assert "Window" not in plan_of(pairs)  # all pairs have no ranks


def test_nearest_nodes_of_repeated_points(spark):
    from tramline.operators import spatial

    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (1, 50.0, 0.0), (2, 9.0, 9.0), (2, None, 1.0), (None, 0.0, 1.0)], "point_id int, x double, y double")
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(40)] + [(99, None, 0.0)], "node_id int, x double, y double")
    got = {(r["point_id"], r["node_rank"]): r["node_id"] for r in spatial.nearest_nodes(points, nodes, 2, 20.0).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 9, (2, 2): 8, (None, 1): 0, (None, 2): 1}


def staged_plans(monkeypatch, module) -> list[str]:
    plans, real = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: plans.append(plan_of(df)) or real(df, name))
    return plans


def test_rounds_broadcast_no_staged_table(spark, rows, monkeypatch):
    from tramline.operators import network

    plans = staged_plans(monkeypatch, network)
    e = spark.range(300).filter("id % 10 < 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert rows(network.weak_components(e, local_edges=0)) == sorted([(i, i - i % 10) for i in range(300)], key=repr)
    ring = e.unionByName(spark.range(300).filter("id % 30 = 29").select(F.col("id").alias("a"), (F.col("id") - 9).alias("b")))
    assert rows(network.strong_components(ring, local_edges=0)) == sorted([(i, i - i % 10 if i % 30 >= 20 else i) for i in range(300)], key=repr)
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def test_complete_linkage_takes_all_groups_of_a_task_in_one_pass(spark, rows, monkeypatch):
    from tramline.operators import signals

    plans = staged_plans(monkeypatch, signals)
    # groups of three in a row, the second step longer: the ends are too far apart, so the first two are one cluster
    g = spark.range(200).select(F.lpad("id", 3, "0").alias("g"))
    lit = g.select(F.explode(F.array(*(F.concat("g", F.lit(n)) for n in "abc"))).alias("node_id"))
    step = F.explode(F.array(F.struct(F.lit("a").alias("f"), F.lit("b").alias("t"), F.lit(20.0).alias("length")), F.struct(F.lit("b").alias("f"), F.lit("c").alias("t"), F.lit(30.0).alias("length"))))
    links = g.select("g", step.alias("s")).select(F.concat("g", "s.f").alias("from_id"), F.concat("g", "s.t").alias("to_id"), "s.length", F.lit("a_link").alias("link_class"))
    clusters, _ = signals.junction_clusters(lit, links, 40.0)
    assert rows(clusters) == sorted([(f"{i:03d}{n}", f"{i:03d}{c}") for i in range(200) for n, c in ("aa", "ba", "cc")], key=repr)
    assert "MapInArrow" in plans[-1]  # not a call for each group

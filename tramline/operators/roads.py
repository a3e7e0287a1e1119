"""Road map to segments: rules, access, restrictions, node classes, lanes.

ways: way_id, refs (array), tags (map). nodes: node_id, x, y, tags. members: relation_id, pos, type, ref, role.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geometry import bend_angle, polyline_length, turn_class

# Default way rules. key, value, rank, modes, lanes a direction, speed m/s, capacity a lane, one-way, transit only.
RULES = [
    ("highway", "motorway", 1, ["car"], 3.0, 47.22, 1200.0, True, False),
    ("highway", "trunk", 2, ["car"], 3.0, 41.67, 1200.0, False, False),
    ("highway", "primary", 3, ["car"], 2.0, 38.89, 900.0, False, False),
    ("highway", "secondary", 4, ["car"], 2.0, 33.33, 900.0, False, False),
    ("highway", "tertiary", 5, ["car"], 1.0, 27.78, 600.0, False, False),
    ("highway", "unclassified", 6, ["car"], 1.0, 13.89, 600.0, False, False),
    ("highway", "residential", 7, ["car"], 1.0, 13.89, 600.0, False, False),
    ("highway", "living_street", 8, ["car"], 1.0, 8.33, 300.0, False, False),
    ("highway", "service", 9, ["car"], 1.0, 11.11, 600.0, False, False),
    ("highway", "motorway_link", 1, ["car"], 3.0, 44.44, 1200.0, True, False),
    ("highway", "trunk_link", 2, ["car"], 3.0, 38.89, 1200.0, False, False),
    ("highway", "primary_link", 3, ["car"], 2.0, 33.33, 900.0, False, False),
    ("highway", "secondary_link", 4, ["car"], 2.0, 27.78, 900.0, False, False),
    ("highway", "tertiary_link", 5, ["car"], 1.0, 22.22, 600.0, False, False),
    ("highway", "link", 6, ["car"], 1.0, 13.89, 600.0, False, False),
    ("highway", "busway", 3, ["bus", "pt"], 1.0, 13.89, 600.0, False, True),
    ("railway", "rail", 1, ["rail", "pt"], 1.0, 83.33, 3000.0, False, True),
    ("railway", "light_rail", 2, ["light_rail", "pt"], 1.0, 27.78, 1200.0, False, True),
    ("railway", "subway", 3, ["subway", "pt"], 1.0, 27.78, 1200.0, False, True),
    ("railway", "tram", 4, ["tram", "pt"], 1.0, 16.67, 600.0, False, True),
    ("railway", "monorail", 5, ["monorail", "pt"], 1.0, 27.78, 1200.0, False, True),
    ("railway", "funicular", 6, ["funicular", "pt"], 1.0, 8.33, 300.0, False, True),
    ("route", "ferry", 10, ["ferry", "car"], 1.0, 13.89, 300.0, True, True),
]
RULE_COLUMNS = "rule_key string, rule_value string, rule_rank int, rule_modes array<string>, rule_lanes double, rule_speed double, rule_capacity double, rule_oneway boolean, transit_only boolean"
KNOWN_MODES = tuple(sorted({m for r in RULES for m in r[3]} | {"bus"}))


@dataclass(frozen=True)
class RoadConfig:
    """How a network is built. Presets below; `rules` are parameters, a handful of rows."""

    keep_geometry_nodes: bool = False
    sharp_bend_degrees: float = 35.0
    preserve_bends: bool = False
    preserve_crossings: bool = False
    preserve_barriers: bool = True
    clean: bool = True
    excluded: tuple[str, ...] = ()
    routable: tuple[str, ...] = ("bus", "car")
    max_length: float = 0.0
    bus_on_roads: bool = True
    collapse_tracks: bool = True
    keep_nodes: tuple[str, ...] = ()
    rules: list = field(default_factory=lambda: RULES)

    def __post_init__(self):
        if self.max_length < 0:
            raise ValueError("max_length must be >= 0")


DEFAULT = RoadConfig()
COLLAPSED = RoadConfig()
MATERIALIZED = RoadConfig(keep_geometry_nodes=True, clean=False, collapse_tracks=False)
MATERIALIZED_CLEAN = RoadConfig(keep_geometry_nodes=True)
FAITHFUL = RoadConfig(clean=False, routable=(), bus_on_roads=False, collapse_tracks=False)
COMPACT = replace(DEFAULT, excluded=("service",), max_length=500.0)


def rule_table(spark: SparkSession, rules: list | None = None) -> DataFrame:
    return spark.createDataFrame(rules or RULES, RULE_COLUMNS)


def with_rule(ways: DataFrame, rules: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """ways with the columns of their rule: by highway, else railway, else route. Ways without one go.

    An excluded highway class is out whatever its other tags; an unknown one falls through.
    """
    keys = F.array(*(F.struct(F.lit(k).alias("rule_key"), F.col("tags")[k].alias("rule_value"), F.lit(i).alias("turn")) for i, k in enumerate(("highway", "railway", "route"))))
    w = ways.filter(~F.coalesce(F.col("tags")["highway"].isin(*excluded), F.lit(False))) if excluded else ways
    each = w.select("way_id", F.explode(keys).alias("k")).select("way_id", "k.*").filter("rule_value is not null")
    hit = each.join(F.broadcast(rules), ["rule_key", "rule_value"])  # the rules are a parameter of about twenty rows
    names = [c for c in rules.columns]
    best = hit.groupBy("way_id").agg(F.min_by(F.struct(*names), "turn").alias("rule"))
    return w.join(best, "way_id").select(*w.columns, *(F.col(f"rule.{c}") for c in names))


def resolve_ways(ways: DataFrame, config: RoadConfig = DEFAULT) -> DataFrame:
    """with_rule plus fwd and bwd: structs (modes, speed, lanes, signature, open), lane counts, one_way."""
    w = with_rule(ways, rule_table(ways.sparkSession, config.rules), config.excluded)
    tags = F.col("tags")
    modes = T.travel_modes(tags, T.candidate_modes(F.col("rule_modes"), config.bus_on_roads), F.col("rule_oneway"), KNOWN_MODES)
    w = w.withColumn("travel", modes).filter("size(travel.forward) > 0 or size(travel.backward) > 0")
    w = w.withColumn("one_way", ~((F.size("travel.forward") > 0) & (F.size("travel.backward") > 0)))
    for name, direction, forward in (("fwd", "forward", True), ("bwd", "backward", False)):
        w = w.withColumn(f"{name}_count", T.lane_count(tags, forward, F.col("one_way"), F.col("rule_lanes")))
        own = F.col(f"travel.{direction}")
        w = w.withColumn(name, F.struct(own.alias("modes"), T.speed(tags, direction, F.col("rule_speed")).alias("speed"), F.col(f"{name}_count.lanes").alias("lanes"), T.lane_signature(tags, direction).alias("signature"), (F.size(own) > 0).alias("open")))
    return w


def way_issues(ways: DataFrame, nodes: DataFrame, config: RoadConfig = DEFAULT) -> DataFrame:
    """code, way_id, message of accepted ways: dynamic one-way, missing node, lane tags."""
    w = resolve_ways(ways, config)
    dynamic = w.filter(T.dynamic_oneway(F.col("tags"))).select(F.lit("dynamic-oneway").alias("code"), "way_id")
    missing = w.select("way_id", F.explode("refs").alias("node_id")).join(nodes, "node_id", "left_anti").select(F.lit("missing-node").alias("code"), "way_id").distinct()
    lanes = w.select(F.explode(F.array_distinct(F.concat("fwd_count.issues", "bwd_count.issues"))).alias("code"), "way_id")
    return dynamic.unionByName(missing).unionByName(lanes).withColumn("message", F.concat(F.lit("way "), "way_id", F.lit(": "), "code"))


def segments(resolved: DataFrame, nodes: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """way_id, idx, a, b, length, per_lane, fwd, bwd of consecutive nodes that both exist. skip: way_id to leave out."""
    w = resolved if skip is None else resolved.join(skip, "way_id", "left_anti")
    pairs = F.arrays_zip(F.slice("refs", F.lit(1), F.size("refs") - 1).alias("a"), F.slice("refs", F.lit(2), F.size("refs") - 1).alias("b"))
    s = w.filter("size(refs) >= 2").select("way_id", "fwd", "bwd", F.col("rule_capacity").alias("per_lane"), F.posexplode(pairs).alias("idx", "ab"))
    s = s.select("way_id", "idx", F.col("ab.a").alias("a"), F.col("ab.b").alias("b"), "per_lane", "fwd", "bwd")
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    s = s.join(at("a"), "a").join(at("b"), "b")
    return s.select("way_id", "idx", "a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("length"), "per_lane", "fwd", "bwd")


def segment_links(segs: DataFrame) -> DataFrame:
    """One link a segment and open direction, for networks that keep every geometry node."""
    from ..functions.ids import node_id, way_link_id
    from .network import directed_segments

    d = directed_segments(segs).filter("own.open and length > 0")
    lanes = F.col("own.lanes").cast("double")
    return d.select(way_link_id(F.col("way_id"), F.col("idx"), F.col("forward")).alias("link_id"), node_id(F.col("tail")).alias("from_id"), node_id(F.col("head")).alias("to_id"), "length", F.col("own.speed").alias("freespeed"), lanes.alias("lanes"), (lanes * F.col("per_lane")).alias("capacity"), F.col("own.modes").alias("modes"), "way_id", "forward", F.array("way_id").alias("ways"))


# --- node classes -----------------------------------------------------------------------------------


def sharp_bends(ways: DataFrame, nodes: DataFrame, degrees: float) -> DataFrame:
    """node_id where a way turns by more than degrees."""
    p = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id", "left")
    order = W.partitionBy("way_id").orderBy("pos")
    p = p.select("node_id", "x", "y", *(f(c).over(order).alias(n + c) for n, f in (("a", F.lag), ("c", F.lead)) for c in ("x", "y")))
    return p.filter(bend_angle(F.col("ax"), F.col("ay"), F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) < 180 - degrees).select("node_id").distinct()


def via_nodes(ways: DataFrame, members: DataFrame, relation_tags: DataFrame) -> DataFrame:
    """node_id of via members of restriction relations, and of the nodes of via ways."""
    r = relation_tags.filter(F.col("tags")["type"].startswith("restriction")).select("relation_id")
    via = members.filter("role = 'via'").join(r, "relation_id", "left_semi")
    of_ways = via.filter("type = 'way'").select(F.col("ref").alias("way_id")).join(ways, "way_id").select(F.explode("refs").alias("node_id"))
    return via.filter("type = 'node'").select(F.col("ref").alias("node_id")).unionByName(of_ways).distinct()


def classify_nodes(ways: DataFrame, nodes: DataFrame, via: DataFrame, stops: DataFrame | None = None, config: RoadConfig = DEFAULT) -> DataFrame:
    """node_id, reasons: why a node of the ways has to stay. No reason: it may be contracted."""
    tags = F.col("tags")
    used = ways.filter("size(refs) >= 2").select(F.explode("refs").alias("node_id")).distinct()
    flag = lambda df, name: df.select("node_id", F.lit(True).alias(name)).distinct()
    none = via.limit(0)
    n = used.join(nodes.select("node_id", "tags"), "node_id", "left").join(flag(via, "via"), "node_id", "left").join(flag(stops if stops is not None else none, "stop"), "node_id", "left")
    n = n.join(flag(sharp_bends(ways, nodes, config.sharp_bend_degrees) if config.preserve_bends else none, "bend"), "node_id", "left")
    semantic = tags["highway"].isin("stop", "give_way", "bus_stop", "tram_stop") | tags["public_transport"].isNotNull() | tags["railway"].isNotNull()
    rules = [
        ("signalized", T.is_signalized(tags)),
        ("turn_restriction_via", F.col("via")),
        ("transit_stop", F.col("stop")),
        ("barrier", (tags["barrier"].isNotNull() | tags["bollard"].isNotNull()) if config.preserve_barriers else F.lit(False)),
        ("crossing", tags["crossing"].isNotNull() if config.preserve_crossings else F.lit(False)),
        ("semantic_node_tag", semantic),
        ("sharp_bend", F.col("bend")),
        ("explicit_preserve", F.col("node_id").isin(*config.keep_nodes) if config.keep_nodes else F.lit(False)),
    ]
    return n.select("node_id", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules))).alias("reasons"))


def stop_nodes(nodes: DataFrame) -> DataFrame:
    tags = F.col("tags")
    return nodes.filter(tags["highway"].isin("bus_stop", "tram_stop") | tags["public_transport"].isNotNull() | tags["railway"].isNotNull()).select("node_id")


# --- stop hints -------------------------------------------------------------------------------------


def stop_hints(nodes: DataFrame, ways: DataFrame, members: DataFrame, relation_tags: DataFrame) -> DataFrame:
    """source, ref, kind, modes, x, y, relations of stops on the map; a way is at the mean of its vertices."""
    tags = F.col("tags")
    kind = F.when(tags["public_transport"] == "stop_position", "stop_position").when(tags["public_transport"].isin("platform", "station", "stop_area"), tags["public_transport"]).when(tags["highway"] == "bus_stop", "bus_stop").when((tags["highway"] == "tram_stop") | (tags["railway"] == "tram_stop"), "tram_stop").when(tags["railway"].isin("station", "halt", "platform"), F.concat(F.lit("rail_"), tags["railway"])).when(tags["amenity"] == "ferry_terminal", "ferry_terminal")
    flags = [(m, F.coalesce(tags[m] == "yes", F.lit(False))) for m in ("bus", "ferry", "light_rail", "monorail", "subway", "tram", "trolleybus")]
    implied = [("bus", tags["highway"] == "bus_stop"), ("tram", (tags["highway"] == "tram_stop") | (tags["railway"] == "tram_stop")), ("rail", tags["railway"].isin("station", "halt", "platform") | (tags["train"] == "yes")), ("ferry", tags["amenity"] == "ferry_terminal")]
    modes = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in flags + implied)))))
    of_nodes = nodes.select(F.lit("node").alias("source"), F.col("node_id").alias("ref"), kind.alias("kind"), modes.alias("modes"), "x", "y").filter("kind is not null")
    named = ways.select("way_id", "refs", kind.alias("kind"), modes.alias("modes")).filter("kind is not null")
    mean = named.select("way_id", F.explode("refs").alias("node_id")).join(nodes.select("node_id", "x", "y"), "node_id").groupBy("way_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    of_ways = named.join(mean, "way_id").select(F.lit("way").alias("source"), F.col("way_id").alias("ref"), "kind", "modes", "x", "y")
    parents = members.join(relation_tags.filter(F.col("tags")["type"].isin("route", "route_master", "stop", "public_transport")).select("relation_id"), "relation_id", "left_semi")
    parents = parents.groupBy(F.col("type").alias("source"), "ref").agg(F.array_sort(F.collect_set("relation_id")).alias("relations"))
    return of_nodes.unionByName(of_ways).join(parents, ["source", "ref"], "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


# --- turn restrictions ------------------------------------------------------------------------------


def restriction_roles(members: DataFrame, relation_tags: DataFrame) -> DataFrame:
    """relation_id, restriction, except, from_way, via_node, to_way, via_way of restriction relations; last member of a role wins."""
    tags = F.col("tags")
    r = relation_tags.filter(tags["type"].isin("restriction", "keep_right", "keep_left") & tags["restriction"].isNotNull()).select("relation_id", "tags")
    last = lambda role, kind: F.max_by(F.when((F.col("role") == role) & (F.col("type") == kind), F.col("ref")), F.when((F.col("role") == role) & (F.col("type") == kind), F.col("pos")))
    m = members.groupBy("relation_id").agg(last("from", "way").alias("from_way"), last("via", "node").alias("via_node"), last("to", "way").alias("to_way"), F.max((F.col("role") == "via") & (F.col("type") == "way")).alias("via_way"))
    return r.join(m, "relation_id", "left").select("relation_id", tags["restriction"].alias("restriction"), "tags", "from_way", "via_node", "to_way", F.coalesce("via_way", F.lit(False)).alias("via_way"))


def turn_restrictions(members: DataFrame, relation_tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forbidden: from_link, to_link, mode; issues: code, relation_id).

    links: link_id, from_id, to_id, modes, ways. only_* forbids every other exit of the via node. Modes are
    those of all from-links, without the ones the relation excepts. Via ways are reported, not enforced.
    """
    from ..functions.ids import node_id

    r = restriction_roles(members, relation_tags)
    complete = F.col("from_way").isNotNull() & F.col("to_way").isNotNull() & F.col("via_node").isNotNull()
    issue = lambda df, code: df.select(F.lit(code).alias("code"), "relation_id")
    good = r.filter(~F.col("via_way") & complete).withColumn("via", node_id(F.col("via_node")))
    by_way = links.select("link_id", "from_id", "to_id", "modes", F.explode("ways").alias("way"))
    enter = good.join(by_way.select(F.col("way").alias("from_way"), F.col("to_id").alias("via"), F.col("link_id").alias("from_link"), "modes"), ["from_way", "via"])
    leave = good.join(by_way.select(F.col("way").alias("to_way"), F.col("from_id").alias("via"), F.col("link_id").alias("to_link")), ["to_way", "via"]).select("relation_id", "to_link").distinct()
    entered = enter.select("relation_id").distinct()
    no_from = good.join(entered, "relation_id", "left_anti")
    no_to = good.join(entered, "relation_id", "left_semi").join(leave, "relation_id", "left_anti")
    issues = issue(r.filter("via_way"), "restriction-via-way-unsupported").unionByName(issue(r.filter(~F.col("via_way") & ~complete), "restriction-incomplete")).unionByName(issue(no_from, "restriction-from-unresolved")).unionByName(issue(no_to, "restriction-to-unresolved"))
    listed = F.transform(F.split(F.coalesce(F.col("tags")["except"], F.lit("")), ";"), lambda m: F.trim(m))
    keyed = F.transform(F.filter(F.map_entries("tags"), lambda e: e["key"].startswith("except:") & (e["value"] == F.substring(e["key"], F.lit(8), F.length(e["key"])))), lambda e: e["value"])
    excepted = F.flatten(F.transform(F.concat(listed, keyed), T.excluded_modes))
    modes = enter.groupBy("relation_id").agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("modes") > 0, F.col("modes")).otherwise(F.array(F.lit("car")))))).alias("all_modes"), F.first(excepted).alias("excepted"))
    modes = modes.select("relation_id", F.explode(F.array_except("all_modes", "excepted")).alias("mode"))
    starts = enter.select("relation_id", "restriction", "via", "from_link").join(leave.select("relation_id").distinct(), "relation_id", "left_semi")
    exits = links.select(F.col("from_id").alias("via"), F.col("link_id").alias("to_link"))
    only = starts.filter(F.col("restriction").startswith("only_")).join(exits, "via").join(leave, ["relation_id", "to_link"], "left_anti")
    other = starts.filter(~F.col("restriction").startswith("only_")).join(leave, "relation_id")
    pairs = only.select("relation_id", "from_link", "to_link").unionByName(other.select("relation_id", "from_link", "to_link"))
    return pairs.join(modes, "relation_id").select("from_link", "to_link", "mode").distinct(), issues


def restriction_index(forbidden: DataFrame) -> DataFrame:
    """from_link, to_link, modes: the forbidden modes of each pair of links, one row a pair."""
    return forbidden.groupBy("from_link", "to_link").agg(F.array_sort(F.collect_set("mode")).alias("modes"))


def movements(links: DataFrame, forbidden: DataFrame) -> DataFrame:
    """via, from_link, to_link, controlled, restricted, legal of each pair of two links that share a mode at a node."""
    a = links.select(F.col("to_id").alias("via"), F.col("link_id").alias("from_link"), F.col("modes").alias("in_modes"))
    b = links.select(F.col("from_id").alias("via"), F.col("link_id").alias("to_link"), F.col("modes").alias("out_modes"))
    return controlled_modes(a.join(b, "via").filter("from_link <> to_link"), forbidden).select("via", "from_link", "to_link", "controlled", "restricted", "legal")


def controlled_modes(pairs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """pairs (from_link, to_link, in_modes, out_modes) that share a mode, with the modes controlled, restricted, legal."""
    shut = forbidden.groupBy("from_link", "to_link").agg(F.array_sort(F.collect_set("mode")).alias("shut"))
    m = pairs.withColumn("controlled", F.array_sort(F.array_intersect("in_modes", "out_modes"))).filter("size(controlled) > 0").join(shut, ["from_link", "to_link"], "left")
    m = m.withColumn("restricted", F.array_intersect("controlled", F.coalesce("shut", F.array().cast("array<string>"))))
    return m.withColumn("legal", F.array_except("controlled", "restricted"))


# --- lanes ------------------------------------------------------------------------------------------


def lane_table(links: DataFrame, nodes: DataFrame, resolved: DataFrame, classify=turn_class) -> tuple[DataFrame, DataFrame]:
    """(lanes, issues). lanes: link_id, lane_id, lane_index, to_links, capacity, confidence, merge, raw, shared.

    links: link_id, from_id, to_id, way_id, forward. resolved: resolve_ways. A lane takes the exits of its
    turn indications (sharp ones fall back on plain ones), all exits if it says nothing usable. classify names the
    turn from one heading into another.
    """
    w = resolved.select("way_id", "tags", "one_way", "rule_capacity", "fwd_count", "bwd_count")
    at = links.join(w, "way_id", "left")
    count = F.when(F.col("forward"), F.col("fwd_count")).otherwise(F.col("bwd_count"))
    own = F.when(F.col("forward"), F.col("tags")["turn:lanes:forward"]).otherwise(F.col("tags")["turn:lanes:backward"])
    own = F.when(F.trim(own) != "", own)
    bare = F.col("tags")["turn:lanes"]
    at = at.withColumn("count", count).withColumn("applies", F.col("one_way") | (F.col("count.confidence") == "even_split"))
    at = at.withColumn("cells", T.turn_lane_cells(F.coalesce(own, F.when(F.col("applies"), bare))))
    issue = lambda df, code: df.select(F.lit(code).alias("code"), "link_id")
    issues = issue(at.filter("tags is null"), "lane-unresolved-way")
    at = at.filter("tags is not null")
    issues = issues.unionByName(at.select(F.explode("count.issues").alias("code"), "link_id")).unionByName(issue(at.filter(own.isNull() & ~F.col("applies") & (F.trim(bare) != "")), "ambiguous-turn-lanes"))
    ends = nodes.select("node_id", "x", "y")
    vec = links.join(ends.select(F.col("node_id").alias("from_id"), F.col("x").alias("fx"), F.col("y").alias("fy")), "from_id").join(ends.select(F.col("node_id").alias("to_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), "to_id")
    vec = vec.select("link_id", "from_id", "to_id", (F.col("tx") - F.col("fx")).alias("vx"), (F.col("ty") - F.col("fy")).alias("vy"))
    out = vec.select(F.col("from_id").alias("to_id"), F.col("link_id").alias("out_link"), F.col("vx").alias("ox"), F.col("vy").alias("oy"))
    turns = vec.join(out, "to_id").withColumn("turn", classify(F.col("vx"), F.col("vy"), F.col("ox"), F.col("oy")))
    exits = turns.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("out_link", "turn"))).alias("exits"))
    at = at.join(exits, "link_id", "left")
    issues = issues.unionByName(issue(at.filter("exits is null"), "lane-no-outgoing"))
    at = at.filter("exits is not null")
    vague = F.col("count.confidence").isin("undetermined_split", "absent")
    mismatch = (F.size("cells") > 0) & (F.size("cells") != F.col("count.lanes"))
    issues = issues.unionByName(issue(at.filter(mismatch), "lane-count-mismatch"))
    n = F.when(mismatch & vague, F.size("cells")).otherwise(F.col("count.lanes"))
    lanes = at.withColumn("lane_index", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("cell", F.get("cells", F.col("lane_index")))
    every = F.transform("exits", lambda e: e["out_link"])
    of = lambda turn: F.transform(F.filter("exits", lambda e: e["turn"] == turn), lambda e: e["out_link"])
    plain = lambda t: F.when(t == "sharp_left", "left").when(t == "sharp_right", "right").otherwise("unknown")
    asked = F.array_distinct(F.flatten(F.transform("cell.turns", lambda t: F.when(F.size(of(t)) > 0, of(t)).otherwise(of(plain(t))))))
    says = F.when(F.col("cell").isNull() | F.col("cell.empty"), "nothing").when(F.size("cell.unsupported") > 0, "unsupported").when(F.col("cell.none"), "none").when(F.size("cell.turns") > 0, "turns").otherwise("nothing-usable")
    lanes = lanes.withColumn("says", says).withColumn("asked", F.when(F.col("says") == "turns", asked))
    found = F.coalesce(F.size("asked") > 0, F.lit(False))
    confidence = F.when(F.col("cell.merge").isNotNull(), "merge").when(F.col("says") == "unsupported", "unsupported").when(F.col("says") == "none", "none_observed").when((F.col("says") == "turns") & ~found, "partial").when((F.col("says") == "turns") & vague, "turn_lanes_authoritative").when(F.col("says") == "turns", F.col("count.confidence")).otherwise("absent")
    to = F.when(found & F.col("cell.merge").isNotNull(), F.array_union("asked", every)).when(found, F.col("asked")).otherwise(every)
    issues = issues.unionByName(issue(lanes.filter("cell.empty"), "empty-turn-cell")).unionByName(issue(lanes.filter("says = 'unsupported'"), "unsupported-turn-token"))
    lanes = lanes.select("link_id", F.concat("link_id", F.lit("_l"), F.col("lane_index").cast("string")).alias("lane_id"), "lane_index", to.alias("to_links"), F.col("rule_capacity").alias("capacity"), confidence.alias("confidence"), F.col("cell.merge").alias("merge"), F.col("cell.raw").alias("raw"), (F.size(to) > 1).alias("shared"))
    return lanes, issues


def lane_cycles(lane_to_lane: DataFrame, rounds: int = 64) -> DataFrame:
    """(link_id, lane_id) of lanes that come back to themselves along their first successor.

    lane_to_lane: link_id, lane_id, next (first successor or null). Pointer jumping doubles the reach a round; lanes
    that lead nowhere any more leave. The rounds end when one loses neither a lane nor a lane reached: a way out
    of 2^r steps or more would have lost one of just so many, and so would a way into a cycle.
    """
    from .staging import drop, stage

    once = lambda rows, lane: rows.groupBy("link_id", lane).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    jump = stage(lane_to_lane.filter("next is not null and link_id is not null").select("link_id", "lane_id", "next").distinct(), "lanes")
    n, lanes = once(jump, "lane_id")
    several = n > lanes  # a lane with several rows: ways are counted once, lanes by name

    def ahead(rows: DataFrame) -> tuple[int, int]:
        n, reached = once(rows, "next")
        return (once(rows, "lane_id")[1] if several else n), reached

    counts = ahead(jump)
    while rounds:
        far = jump.select("link_id", F.col("lane_id").alias("next"), F.col("next").alias("far"))
        new = jump.join(far, ["link_id", "next"]).select("link_id", "lane_id", F.col("far").alias("next"))
        new = stage(new.distinct() if several else new, "lanes")
        drop(jump)
        jump, before, counts = new, counts, ahead(new)
        if counts == before:
            break
        rounds -= 1
    return jump.select("link_id", F.col("next").alias("lane_id")).distinct()

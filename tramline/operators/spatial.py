"""Grid joins: nearest links and nodes, stops near a point, candidate scores, clipping.

A cell is as wide as the search radius. The stored side is entered into every cell its box reaches
within the radius, a query point into its one cell, so a pair meets once and joins on equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import crosses_ring, distance, in_ring, point, to_segment
from ..functions.tags import mode_compatible
from ..functions.text import best_similarity
from .network import extent, resolve_ends
from .staging import drop, stage


def _cells(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, reach: float) -> Column:
    axis = lambda lo, hi: F.sequence(F.floor((lo - reach) / reach), F.floor((hi + reach) / reach))
    return F.explode(F.flatten(F.transform(axis(lo_x, hi_x), lambda i: F.transform(axis(lo_y, hi_y), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def _cell(x: Column, y: Column, reach: float) -> Column:
    return F.struct(F.floor(x / reach).alias("i"), F.floor(y / reach).alias("j"))


def _segment_cells(ax: Column, ay: Column, bx: Column, by: Column, reach: float) -> Column:
    """Cells within reach of a segment, column by column along it: as many as it is long, not as its box is large."""
    at = lambda v: F.floor(v / reach).cast("long")
    lo, hi = F.least(ax, bx), F.greatest(ax, bx)
    y = lambda x: F.when(ax == bx, ay).otherwise(ay + (by - ay) * (x - ax) / F.nullif(bx - ax, F.lit(0.0)))

    def column(i: Column) -> Column:
        x0, x1 = F.greatest(lo, F.least(hi, (i - 1) * reach)), F.least(hi, F.greatest(lo, (i + 2) * reach))
        y0, y1 = F.when(ax == bx, F.least(ay, by)).otherwise(F.least(y(x0), y(x1))), F.when(ax == bx, F.greatest(ay, by)).otherwise(F.greatest(y(x0), y(x1)))
        return F.transform(F.sequence(at(y0 - reach), at(y1 + reach)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.explode(F.flatten(F.transform(F.sequence(at(lo - reach), at(hi + reach)), column)))


def nearest_links(points: DataFrame, links: DataFrame, nodes: DataFrame, n: int, radius: float) -> DataFrame:
    """points with link_id, link_distance, link_x, link_y, fraction, link_rank of the n nearest links within radius.

    points: point_id, x, y. Ties by link_id.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    stored = resolve_ends(links.select("link_id", "from_id", "to_id"), nodes).filter("has_from and has_to")
    c = {k: F.col(k).cast("double") for k in ("from_x", "from_y", "to_x", "to_y")}
    stored = stored.select("link_id", *(v.alias(k) for k, v in c.items()))
    stored = stored.withColumn("cell", _segment_cells(*(F.col(k) for k in ("from_x", "from_y", "to_x", "to_y")), radius))
    q = points.withColumn("cell", _cell(F.col("x"), F.col("y"), radius))
    at = to_segment(F.col("x").cast("double"), F.col("y").cast("double"), *(F.col(k) for k in ("from_x", "from_y", "to_x", "to_y")))
    near = q.join(stored, "cell").withColumn("at", at).filter(F.col("at.distance") <= radius)
    rank = F.row_number().over(W.partitionBy("point_id").orderBy("at.distance", "link_id"))
    near = near.withColumn("link_rank", rank).filter(F.col("link_rank") <= n)
    return near.select(*points.columns, "link_id", F.col("at.distance").alias("link_distance"), F.col("at.x").alias("link_x"), F.col("at.y").alias("link_y"), F.col("at.fraction").alias("fraction"), "link_rank")


DEALT = 500  # rows of a cell that one key holds
DENSE = 8  # times n nodes in a cell, as a node sees it: from there on a search begins in smaller cells


def _meet(many: DataFrame, few: DataFrame, reach: float, spread: bool = False) -> DataFrame:
    """Rows of many (ax, ay) and few (bx, by) at most reach apart, with their distance. A full cell is dealt over several keys.

    spread: tasks are as many as the session's shuffles have, however small the tables, since pairs are far more than rows.
    """
    a = many.withColumn("cell", _cell(F.col("ax"), F.col("ay"), reach))
    b = few.withColumn("cell", _cells(F.col("bx"), F.col("by"), F.col("bx"), F.col("by"), reach))
    held = a.groupBy("cell").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    a = a.withColumn("h", F.xxhash64(*many.columns)).join(held, "cell").withColumn("part", F.pmod("h", "parts").cast("int")).drop("h", "parts")
    b = b.join(held, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    if spread:
        spark = a.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        a, b = a.repartition(tasks, "cell", "part").hint("merge"), b.repartition(tasks, "cell", "part")
    c = {k: F.col(k).cast("double") for k in ("ax", "ay", "bx", "by")}
    return a.join(b, ["cell", "part"]).withColumn("distance", distance(c["bx"], c["by"], c["ax"], c["ay"])).filter(F.col("distance") <= reach).drop("cell", "part")


def _first_reach(stored: DataFrame, n: int, radius: float) -> float:
    """radius, halved while a cell that wide holds many more than n nodes, in the mean over nodes; none narrower than 2^-20 of it."""
    for _ in range(20):
        held = stored.groupBy(_cell(F.col("ax"), F.col("ay"), radius).alias("cell")).agg(F.count("*").cast("double").alias("c"))
        if (held.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 0.0) <= DENSE * n:
            break
        radius /= 2
    return radius


def nearest_nodes(points: DataFrame, nodes: DataFrame, n: int, radius: float) -> DataFrame:
    """point_id, node_id, node_distance, node_rank of the n nearest nodes within radius; ties by node_id.

    A search begins in cells that hold few nodes. A point that finds n within the reach has its nearest; the others
    go on with twice the reach, up to radius. So pairs grow with points and n, not with the nodes around.
    """
    if n < 1 or radius <= 0:
        raise ValueError("n and radius must be positive")
    # of nodes at one place only the n of least id can be among the nearest
    place = F.row_number().over(W.partitionBy("ax", "ay").orderBy("node_id"))
    stored = stage(nodes.select("node_id", F.col("x").alias("ax"), F.col("y").alias("ay")).filter("ax is not null and ay is not null").withColumn("place", place).filter(F.col("place") <= n).drop("place"), "near-nodes")
    once = points.groupBy("point_id", F.col("x").alias("bx"), F.col("y").alias("by")).agg(F.count("*").cast("int").alias("times"))
    left = stage(once.filter("bx is not null and by is not null").withColumn("p", F.monotonically_increasing_id()), "near-points")
    rank = F.row_number().over(W.partitionBy("p").orderBy("distance", "node_id"))
    reach, found = _first_reach(stored, n, radius), []
    while True:
        near = _meet(stored, left, reach).withColumn("rank", rank).filter(F.col("rank") <= n)
        near = stage(near.select("p", "point_id", "times", "node_id", "distance", "rank"), "near")
        if reach >= radius:
            found.append(near)
            break
        done = near.filter(F.col("rank") == n).select("p")
        found.append(near.join(done, "p", "left_semi"))
        before, left = left, stage(left.join(done, "p", "left_anti"), "near-points")
        drop(before)
        if left.isEmpty():
            break
        reach = min(radius, reach * 2)
    every = reduce(DataFrame.unionByName, found).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rank = F.row_number().over(W.partitionBy("point_id").orderBy("distance", "node_id"))
    return every.select("point_id", "node_id", F.col("distance").alias("node_distance"), rank.alias("node_rank")).filter(F.col("node_rank") <= n)


def stops_near(points: DataFrame, stops: DataFrame, radius: float) -> DataFrame:
    """point_id, stop_id, stop_distance of all stops within radius: as many rows as there are pairs."""
    many = points.select("point_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    few = stops.select("stop_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    return _meet(many, few, radius, spread=True).select("point_id", "stop_id", F.col("distance").alias("stop_distance"))


#: Candidate search: links kept by distance before the mode filter, and score weights.
LINK_THRESHOLD, DISTANCE_MULTIPLIER = 10, 4.0
WEIGHTS = {"distance": 1.0, "mode": 0.8, "name": 0.5}


class NetworkIndex:
    """The spatial and lane lookups of one network together; each takes and gives DataFrames."""

    def __init__(self, nodes: DataFrame, links: DataFrame, stops: DataFrame | None = None, lane_hints: DataFrame | None = None):
        self.nodes, self.links, self.stops, self.lane_hints = nodes, links, stops, lane_hints

    def nearest_links(self, points: DataFrame, n: int, radius: float = 100.0) -> DataFrame:
        return nearest_links(points, self.links, self.nodes, n, radius)

    def nearest_nodes(self, points: DataFrame, n: int, radius: float = 100.0) -> DataFrame:
        return nearest_nodes(points, self.nodes, n, radius)

    def stops_near(self, points: DataFrame, radius: float = 100.0) -> DataFrame:
        return stops_near(points, self.stops, radius)

    def hints_of(self, links: DataFrame) -> DataFrame:
        """Lane hints of the links (link_id) that have one."""
        return self.lane_hints.join(links.select("link_id"), "link_id", "left_semi")


def stop_candidates(stops: DataFrame, links: DataFrame, nodes: DataFrame, radius: float, n: int = int(LINK_THRESHOLD * DISTANCE_MULTIPLIER * 2), weights: dict | None = None) -> DataFrame:
    """point_id, mode, link_id, link_distance, score, candidate_rank.

    stops: point_id, x, y, name, mode. links may have names (array). The n nearest links are taken before
    the mode filter, so a near link of another mode can crowd out a far one. weights may hold a map of
    its own for a mode, under the mode's name.
    """
    weights = weights or WEIGHTS
    if radius == 0:
        return stops.select("point_id", "mode", F.lit(None).cast("string").alias("link_id"), F.lit(0.0).alias("link_distance"), F.lit(0.0).alias("score"), F.lit(1).alias("candidate_rank")).limit(0)

    def weight(k: str) -> Column:
        out = F.lit(float(weights[k]))
        for mode, own in weights.items():
            if isinstance(own, dict):
                out = F.when(F.col("mode") == mode, float(own.get(k, weights[k]))).otherwise(out)
        return out

    places = stops.select("point_id", "x", "y").distinct()
    near = nearest_links(places, links, nodes, n, radius).drop("x", "y")
    names = F.col("names") if "names" in links.columns else F.array().cast("array<string>")
    own = links.select("link_id", "modes", names.alias("names"))
    c = near.join(stops.select("point_id", "mode", "name").distinct(), "point_id").join(own, "link_id").filter(mode_compatible(F.col("modes"), F.col("mode")))
    score = -weight("distance") * F.col("link_distance") / 100.0 + F.when(F.array_contains("modes", F.col("mode")), weight("mode")).otherwise(0.0) + weight("name") * best_similarity(F.col("name"), F.coalesce("names", F.array().cast("array<string>")))
    c = c.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("point_id", "mode").orderBy(F.desc("score"), "link_id"))
    return c.withColumn("candidate_rank", rank).select("point_id", "mode", "link_id", "link_distance", "score", "candidate_rank")


def clip_schedule(stops: DataFrame, route_stops: DataFrame, nodes: DataFrame, margin: float = 0.0) -> dict[str, DataFrame]:
    """stops, route_stops and routes (line_id, route_id) inside the network's box; routes keep two stops or more."""
    box = extent(nodes)  # one row
    inside = (F.col("x") >= F.col("min_x") - margin) & (F.col("x") <= F.col("max_x") + margin) & (F.col("y") >= F.col("min_y") - margin) & (F.col("y") <= F.col("max_y") + margin)
    kept = stops.join(F.broadcast(box), inside).select(stops.columns)
    calls = route_stops.join(kept.select("stop_id"), "stop_id", "left_semi")
    routes = calls.groupBy("line_id", "route_id").agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    return {"stops": kept, "routes": routes, "route_stops": calls.join(routes, ["line_id", "route_id"], "left_semi")}


def ways_in_boundary(ways: DataFrame, nodes: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """way_id of ways with a node inside the ring, a segment across it, or the middle of a segment inside.

    ways: way_id, refs. nodes: node_id, lon, lat. The ring is a parameter, closed here.
    """
    ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    r = F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y in ring))
    at = nodes.select("node_id", "lon", "lat", in_ring(F.col("lon"), F.col("lat"), r).alias("inside"))
    refs = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id")).join(at, "node_id")
    order = W.partitionBy("way_id").orderBy("pos")
    b = F.lead(F.struct("lon", "lat", "pos")).over(order)
    seg = refs.withColumn("b", b)
    a, e = point(F.col("lon"), F.col("lat")), point(F.col("b.lon"), F.col("b.lat"))
    consecutive = F.col("b.pos") == F.col("pos") + 1
    middle = in_ring((F.col("lon") + F.col("b.lon")) / 2, (F.col("lat") + F.col("b.lat")) / 2, r)
    hit = F.col("inside") | (consecutive & (crosses_ring(a, e, r) | middle))
    return seg.filter(hit).select("way_id").distinct()


def boundary_filter(ways: DataFrame, nodes: DataFrame, members: DataFrame, ring: list[tuple[float, float]]) -> dict[str, DataFrame]:
    """ways, nodes and relation ids kept: ways of the boundary, all their nodes, relations with any kept member."""
    inside = ways_in_boundary(ways, nodes, ring)
    kept = ways.join(inside, "way_id", "left_semi")
    used = kept.select(F.explode("refs").alias("node_id")).distinct()
    kept_nodes = nodes.join(used, "node_id", "left_semi")
    have = inside.select(F.lit("way").alias("type"), F.col("way_id").alias("ref")).unionByName(used.select(F.lit("node").alias("type"), F.col("node_id").alias("ref")))
    return {"ways": kept, "nodes": kept_nodes, "relations": members.join(have, ["type", "ref"], "left_semi").select("relation_id").distinct()}


def parallel_tracks(ways: DataFrame, nodes: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """way_id of rail ways that run along one of lesser id: same railway value, ends and vertices within tolerance.

    ways: way_id, railway, refs. A duplicate doesn't claim others: pairs whose lesser way is itself one
    are settled in rounds, least ids first.
    """
    own = ways.filter("railway is not null and size(refs) >= 2")
    pts = own.select("way_id", "railway", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id")
    lines = pts.groupBy("way_id", "railway", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts")).filter(F.size("pts") == F.col("n"))
    lines = lines.select("way_id", "railway", "pts", F.get("pts", F.lit(0)).alias("s"), F.element_at("pts", -1).alias("e"))
    q = lambda v: F.round(v / tolerance).cast("long")
    ends = lines.withColumn("at", F.explode(F.array(F.struct(q(F.col("s.x")).alias("i"), q(F.col("s.y")).alias("j")), F.struct(q(F.col("e.x")).alias("i"), q(F.col("e.y")).alias("j")))))
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.col("at.i") + i).alias("i"), (F.col("at.j") + j).alias("j"))))))
    a = ends.select(F.col("way_id").alias("a"), "railway", F.col("pts").alias("ap"), F.col("s").alias("as"), F.col("e").alias("ae"), around.alias("cell")).dropDuplicates(["a", "cell"])
    b = ends.select(F.col("way_id").alias("b"), "railway", F.col("pts").alias("bp"), F.col("s").alias("bs"), F.col("e").alias("be"), F.col("at").alias("cell")).dropDuplicates(["b", "cell"])
    near = lambda p, r: F.hypot(p["x"] - r["x"], p["y"] - r["y"]) <= tolerance
    ends_close = (near(F.col("as"), F.col("bs")) & near(F.col("ae"), F.col("be"))) | (near(F.col("as"), F.col("be")) & near(F.col("ae"), F.col("bs")))
    every = lambda ps, rs: F.forall(ps, lambda p: F.exists(rs, lambda r: near(p, r)))
    pairs = a.join(b, ["railway", "cell"]).filter((F.col("a") < F.col("b")) & ends_close & every(F.col("ap"), F.col("bp")) & every(F.col("bp"), F.col("ap"))).select("a", "b").distinct()
    left = stage(pairs, "tracks")
    gone = None
    while not left.isEmpty():
        # a way that no remaining pair could make a duplicate surely stays, and takes its partners
        sure = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = stage(left.join(sure, "a", "left_semi").select(F.col("b").alias("way_id")).distinct(), "tracks-gone")
        gone = new if gone is None else gone.unionByName(new)
        rest = left.join(sure, "a", "left_anti").join(new.select(F.col("way_id").alias("a")), "a", "left_anti").join(new.select(F.col("way_id").alias("b")), "b", "left_anti")
        left = stage(rest, "tracks")
    return pairs.select(F.col("b").alias("way_id")).limit(0) if gone is None else gone.distinct()

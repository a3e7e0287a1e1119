"""Timetable routes onto a network: best link a stop, turn-restricted paths, connectors, child stops.

links: link_id, from_id, to_id, length, modes. forbidden: link_id, mode, sequence (links that may not
follow). route_stops: line_id, route_id, pos, stop_id, mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import child_stop_id
from ..functions.tags import TRANSIT_MODES, mode_compatible
from .staging import stage

COMPACT = 8  # rounds after which the states seen so far are one table again
MAX_SEQUENCE = 4  # longest forbidden sequence that is enforced
# Length, capacity, speed and lanes of a connector, and the length of a loop.
CONNECTOR = {"length": 50.0, "capacity": 900.0, "freespeed": 13.9, "lanes": 1.0}
LOOP_LENGTH = 1.0


def paths(pairs: DataFrame, links: DataFrame, forbidden: DataFrame | None = None, max_distance: float = 1000.0) -> DataFrame:
    """from_link, to_link, mode, cost, path of the shortest path of each pair (from_link, to_link, mode).

    cost sums the links after the first, the target included, and is at most max_distance. A path may not
    hold a forbidden sequence after its link. All pairs are searched at once: a frontier of states (pair,
    last links) is joined with the links that leave its end, only the cheapest of a state goes on, and
    only while it undercuts the pair's best so far. Ties: the lesser path. from = to is that one link.
    """
    modes_of = F.when(F.col("mode") == "pt", F.array(*map(F.lit, TRANSIT_MODES))).otherwise(F.array("mode"))
    p = pairs.select("from_link", "to_link", F.coalesce(F.when(F.trim("mode") != "", F.col("mode")), F.lit("car")).alias("mode")).distinct()
    same = p.filter("from_link = to_link").join(links.select(F.col("link_id").alias("from_link")), "from_link", "left_semi").select("from_link", "to_link", "mode", F.lit(0.0).alias("cost"), F.array("from_link").alias("path"))
    ends = links.select(F.col("link_id").alias("from_link"), F.col("to_id").alias("node"))
    exists = links.select(F.col("link_id").alias("to_link"))
    start = p.filter("from_link <> to_link").join(ends, "from_link").join(exists, "to_link", "left_semi").withColumn("modes_of", modes_of)
    front = stage(start.withColumn("cost", F.lit(0.0)).withColumn("path", F.array("from_link")), "path-front")
    step = links.select(F.col("from_id").alias("node"), F.col("link_id").alias("next"), F.col("to_id").alias("after"), "length", "modes")
    rules = None
    if forbidden is not None:
        rules = forbidden.filter(F.size("sequence") <= MAX_SEQUENCE).select(F.element_at("sequence", -1).alias("next"), F.concat(F.array("link_id"), "sequence").alias("shut"), F.col("mode").alias("rule_mode"))
        rules = rules.groupBy("next").agg(F.collect_list(F.struct("shut", "rule_mode")).alias("rules"))
    keys = ["from_link", "to_link", "mode"]
    done = stage(same.limit(0), "path-done")
    settled, rounds = front.select(*keys, "node", F.col("path").alias("window"), "cost"), 0
    while not front.isEmpty():
        ahead = front.join(step, "node").filter(mode_compatible(F.col("modes"), F.col("mode"))).withColumn("cost", F.col("cost") + F.col("length")).filter(F.col("cost") <= max_distance)
        ahead = ahead.withColumn("path", F.concat("path", F.array("next")))
        if rules is not None:
            tail = lambda s: F.slice("path", F.greatest(F.size("path") - F.size(s) + 1, F.lit(1)), F.size(s))
            hit = F.exists("rules", lambda r: F.array_contains("modes_of", r["rule_mode"]) & (tail(r["shut"]) == r["shut"]))
            ahead = ahead.join(rules, "next", "left").filter(~F.coalesce(hit, F.lit(False)))
        ahead = ahead.select(*keys, F.col("after").alias("node"), "modes_of", "cost", "path", "next")
        ahead = stage(ahead.withColumn("window", F.slice("path", F.greatest(F.size("path") - MAX_SEQUENCE, F.lit(1)), F.lit(MAX_SEQUENCE + 1))), "path-ahead")
        found = ahead.filter("next = to_link").select(*keys, "cost", "path").unionByName(done)
        done = stage(found.groupBy(*keys).agg(F.min(F.struct("cost", "path")).alias("best")).select(*keys, "best.cost", "best.path"), "path-done")
        go = ahead.filter("next <> to_link").join(done.select(*keys, F.col("cost").alias("bound")), keys, "left").filter("bound is null or cost < bound")
        best = go.groupBy(*keys, "node", "window").agg(F.min(F.struct("cost", "path")).alias("best"), F.first("modes_of").alias("modes_of")).select(*keys, "node", "window", "best.cost", "best.path", "modes_of")
        seen = settled.groupBy(*keys, "node", "window").agg(F.min("cost").alias("old"))
        best = stage(best.join(seen, [*keys, "node", "window"], "left").filter("old is null or cost < old").drop("old"), "path-best")
        rounds += 1
        settled = settled.unionByName(best.select(*keys, "node", "window", "cost"))
        if rounds % COMPACT == 0:
            settled = stage(settled.groupBy(*keys, "node", "window").agg(F.min("cost").alias("cost")), "path-settled")
        front = best.select(*keys, "node", "modes_of", "cost", "path")
    return same.unionByName(done)


def collapse_repeats(stop_links: DataFrame) -> DataFrame:
    """stop_links without a link equal to the one before it in its route."""
    before = F.lag("link_id").over(W.partitionBy("line_id", "route_id").orderBy("pos"))
    return stop_links.withColumn("_before", before).filter("_before is null or _before <> link_id").drop("_before")


def map_routes(route_stops: DataFrame, stops: DataFrame, candidates: DataFrame, links: DataFrame, forbidden: DataFrame | None = None, max_distance: float = 1000.0) -> dict[str, DataFrame]:
    """route_links, artificial_links, artificial_nodes, child_stops, route_stops of mapped routes.

    Every stop takes its best candidate; one without any gets a loop link at its place. Consecutive links
    are joined by the shortest allowed path, else by a connector between their ends. Artificial links are
    never part of a path. Each used (stop, link) is a child stop that the route's stop refers to.
    """
    best = candidates.filter("candidate_rank = 1").select(F.col("point_id").alias("stop_id"), "mode", "link_id")
    known = route_stops.join(stops.select("stop_id", "x", "y"), "stop_id")
    calls = known.join(best, ["stop_id", "mode"], "left")
    lost = calls.filter("link_id is null").groupBy("line_id", "route_id", "stop_id", "mode", "x", "y").agg(F.min("pos").alias("pos"))
    lost = lost.withColumn("n", 2 * (F.row_number().over(W.orderBy("line_id", "route_id", "pos")) - 1))
    context = F.concat_ws("_", "stop_id", "route_id")
    loops = stage(lost.select("line_id", "route_id", "stop_id", "mode", "x", "y", F.concat(F.lit("pt_loop_node_"), context, F.lit("_"), F.col("n").cast("string")).alias("node_id"), F.concat(F.lit("pt_loop_"), context, F.lit("_"), (F.col("n") + 1).cast("string")).alias("loop_id")), "loops")
    calls = calls.join(loops.select("line_id", "route_id", "stop_id", "loop_id", "node_id"), ["line_id", "route_id", "stop_id"], "left")
    calls = stage(calls.withColumn("link_id", F.coalesce("link_id", "loop_id")), "calls")
    order = W.partitionBy("line_id", "route_id").orderBy("pos")
    hops = collapse_repeats(calls).withColumn("from_link", F.lag("link_id").over(order)).withColumn("hop", F.row_number().over(order) - 1)
    hops = stage(hops.select("line_id", "route_id", "mode", "hop", "from_link", F.col("link_id").alias("to_link")), "hops")
    found = stage(paths(hops.filter("from_link is not null").select("from_link", "to_link", "mode"), links, forbidden, max_distance), "paths")
    j = hops.join(found.select("from_link", "to_link", "mode", "path"), ["from_link", "to_link", "mode"], "left")
    broken = j.filter("from_link is not null and path is null")
    used = loops.count() * 2
    numbered = broken.withColumn("n", F.row_number().over(W.orderBy("line_id", "route_id", "hop")) - 1 + used)
    every = links.select("link_id", "from_id", "to_id").unionByName(loops.select(F.col("loop_id").alias("link_id"), F.col("node_id").alias("from_id"), F.col("node_id").alias("to_id")))
    connectors = numbered.join(every.select(F.col("link_id").alias("from_link"), F.col("to_id").alias("a")), "from_link").join(every.select(F.col("link_id").alias("to_link"), F.col("from_id").alias("b")), "to_link")
    connectors = stage(connectors.select("line_id", "route_id", "hop", "mode", "a", "b", F.concat(F.lit("pt_"), F.concat_ws("_", "route_id", "from_link", "to_link"), F.lit("_"), F.col("n").cast("string")).alias("connector")), "connectors")
    j = j.join(connectors.select("line_id", "route_id", "hop", "connector"), ["line_id", "route_id", "hop"], "left")
    piece = F.when(F.col("from_link").isNull(), F.array("to_link")).when(F.col("path").isNotNull(), F.slice("path", F.lit(2), F.size("path"))).otherwise(F.array("connector", "to_link"))
    route_links = j.select("line_id", "route_id", "hop", F.posexplode(piece).alias("i", "link_id"))
    route_links = route_links.withColumn("pos", F.row_number().over(W.partitionBy("line_id", "route_id").orderBy("hop", "i")) - 1).select("line_id", "route_id", "pos", "link_id")
    fixed = [F.lit(v).alias(k) for k, v in CONNECTOR.items() if k != "length"]
    artificial = connectors.select(F.col("connector").alias("link_id"), F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit(CONNECTOR["length"]).alias("length"), *fixed, F.array("mode").alias("modes"))
    artificial = artificial.unionByName(loops.select(F.col("loop_id").alias("link_id"), F.col("node_id").alias("from_id"), F.col("node_id").alias("to_id"), F.lit(LOOP_LENGTH).alias("length"), *fixed, F.array("mode").alias("modes")))
    child = child_stop_id(F.col("stop_id"), F.col("link_id"))
    children = calls.select(child.alias("child_id"), F.col("stop_id").alias("parent_id"), "link_id", "x", "y").dropDuplicates(["child_id"])
    return {"route_links": route_links, "artificial_links": artificial, "artificial_nodes": loops.select("node_id", "x", "y"), "child_stops": children, "route_stops": calls.withColumn("child_id", child)}

"""Networks: referential joins, degrees, contraction, components, cleaning.

nodes: node_id, x, y. links: link_id, from_id, to_id, length, capacity, freespeed, lanes, modes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import drop, stage

ARTIFICIAL = "pt_"


def apart(rows: DataFrame) -> DataFrame:
    """For a join of rows with another growing table: both are dealt by key.

    A staged table's file is a fraction of its rows, so planned by size it would be broadcast, through the driver.
    """
    return rows.hint("merge")


def resolve_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links with the coordinates of both ends; null where the node is missing."""
    a = nodes.select(F.col("node_id").alias("from_id"), F.col("x").alias("from_x"), F.col("y").alias("from_y"), F.lit(True).alias("has_from"))
    b = nodes.select(F.col("node_id").alias("to_id"), F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.lit(True).alias("has_to"))
    return apart(apart(links).join(a, "from_id", "left")).join(b, "to_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_from", "has_to")})


def require_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """resolve_ends, raising if a link has a missing end."""
    out = resolve_ends(links, nodes)
    if bad := out.filter("not has_from or not has_to").select("link_id").take(1):
        raise ValueError(f"link {bad[0][0]} refers to a missing node")
    return out


def remove_nodes(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in gone, and links without those that touch one."""
    ends = lambda c: gone.select(F.col("node_id").alias(c))
    return nodes.join(gone.select("node_id"), "node_id", "left_anti"), links.join(ends("from_id"), "from_id", "left_anti").join(ends("to_id"), "to_id", "left_anti")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, n_in, n_out, n_all (a loop counts in both)."""
    ends = links.select(F.col("from_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("to_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = ends.groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_in", "n_out")}
    return nodes.select("node_id").join(n, "node_id", "left").withColumns(zero).withColumn("n_all", F.col("n_in") + F.col("n_out"))


def adjacency(links: DataFrame) -> DataFrame:
    """node_id, out_links, in_links: comma-joined sorted link ids (a node's own links only)."""
    out = links.groupBy(F.col("from_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("link_id")), ",").alias("out_links"))
    into = links.groupBy(F.col("to_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("link_id")), ",").alias("in_links"))
    return out.join(into, "node_id", "full").select("node_id", F.coalesce("out_links", F.lit("")).alias("out_links"), F.coalesce("in_links", F.lit("")).alias("in_links"))


def extent(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def missing_modes(links: DataFrame, required: list[str]) -> DataFrame:
    """mode rows of required that no link allows."""
    have = links.select(F.explode("modes").alias("mode")).distinct()
    return links.sparkSession.createDataFrame([(m,) for m in required], "mode string").join(have, "mode", "left_anti")


def invalid_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """link_id of links that cleaning removes first; artificial ones are exempt."""
    finite = lambda c: F.coalesce((F.abs(F.col(c)) < float("inf")) & ~F.isnan(c), F.lit(False))
    sound = F.col("has_from") & F.col("has_to") & (F.size("modes") > 0) & F.coalesce(F.col("length") > 0, F.lit(False))
    for c in ("length", "freespeed", "capacity", "lanes"):
        sound = sound & finite(c)
    return resolve_ends(links, nodes).filter(~F.col("link_id").cast("string").startswith(ARTIFICIAL) & ~sound).select("link_id")


LOCAL_EDGES = 500_000  # a graph, or the rest of one, of so many edges at most is finished in one task


def _in_one_task(edges: DataFrame, solve) -> DataFrame:
    """solve(list of a, list of b) -> {node: component} over few edges (a, b)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = solve(pdf["a"].tolist(), pdf["b"].tolist())
        return pd.DataFrame({"node": list(found), "component": list(found.values())}, dtype=pdf["a"].dtype)

    kind = dict(edges.dtypes)["a"]
    return edges.select("a", "b").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"node {kind}, component {kind}")


def _weak(a: list, b: list) -> dict:
    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def _strong(a: list, b: list) -> dict:
    """Components by two depth-first passes: finishing order forward, then trees against the edges."""
    ahead: dict = {}
    behind: dict = {}
    for x, y in zip(a, b, strict=True):
        ahead.setdefault(x, []).append(y)
        behind.setdefault(y, []).append(x)
    order, seen = [], set()
    for root in ahead.keys() | behind.keys():
        if root not in seen:
            seen.add(root)
            todo = [(root, iter(ahead.get(root, ())))]
            while todo:
                x, rest = todo[-1]
                for y in rest:
                    if y not in seen:
                        seen.add(y)
                        todo.append((y, iter(ahead.get(y, ()))))
                        break
                else:
                    order.append(x)
                    todo.pop()
    out: dict = {}
    for root in reversed(order):
        if root not in out:
            out[root] = root
            tree, todo = [root], [root]
            while todo:
                for y in behind.get(todo.pop(), ()):
                    if y not in out:
                        out[y] = root
                        tree.append(y)
                        todo.append(y)
            least = min(tree)
            for x in tree:
                out[x] = least
    return out


def weak_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component: the least node connected to it.

    Minimum labels with pointer jumping, a table a round; up to local_edges, in one task.
    """
    e = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    if e.count() <= local_edges:
        return _in_one_task(e, _weak)
    both = stage(e.union(e.select("b", "a")).filter("a <> b").distinct(), "edges")
    loops = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stage(apart(loops).join(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "node", "left").select("node", F.least("node", F.coalesce("m", F.col("node"))).alias("component")), "labels")
    while True:
        seen = apart(both).join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        met = apart(labels).join(seen, "node", "left").select("node", "component", F.least("component", F.coalesce("seen", F.col("component"))).alias("met"))
        jump = labels.select(F.col("node").alias("met"), F.col("component").alias("far"))
        new = stage(apart(met).join(jump, "met", "left").select("node", F.least("met", F.coalesce("far", F.col("met"))).alias("component"), F.col("component").alias("old")), "labels")
        changed = new.filter("component <> old").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "component")


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component of directed edges (a, b): the least node of its strongly connected component.

    Colouring: nodes that no cycle can pass are trimmed; the least node that reaches each is found by
    forward propagation; those it is reached from inside its colour are its component and leave. A rest of
    local_edges at most is finished in one task. Rounds of a larger one go a hop each, so they grow with the
    longest way to a least node; a round keeps only its frontier.
    """
    left = stage(edges.select("a", "b").distinct(), "scc-edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = None

    def settle(rows: DataFrame) -> None:
        nonlocal out
        rows = stage(rows.select("node", "component"), "scc-done")
        out = rows if out is None else out.unionByName(rows)

    def inner(ends: DataFrame) -> DataFrame:
        """Edges between the nodes of ends, in place of left's."""
        keep = lambda c: ends.select(F.col("node").alias(c))
        got = stage(apart(apart(left).join(keep("a"), "a", "left_semi")).join(keep("b"), "b", "left_semi"), "scc-edges")
        drop(left)
        return got

    rest = stage(nodes, "scc-nodes")
    while True:
        if left.count() <= local_edges:
            found = stage(_in_one_task(left, _strong), "scc-done")
            settle(apart(rest).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
            return out
        # trim
        real = left.filter("a <> b")
        good = apart(apart(rest).join(real.select(F.col("a").alias("node")).distinct(), "node", "left_semi")).join(real.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
        good = stage(good, "scc-nodes")
        gone = stage(apart(rest).join(good, "node", "left_anti"), "scc-trim")
        if not gone.isEmpty():
            settle(gone.withColumn("component", F.col("node")))
            drop(rest)
            rest = good
            left = inner(rest)
            continue
        colour = front = stage(rest.withColumn("colour", F.col("node")), "scc-colour")
        while not front.isEmpty():  # only those that changed push their colour on
            got = apart(left).join(front, left["a"] == front["node"]).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("in"))
            new = stage(apart(colour).join(got, "node", "left").select("node", F.least("colour", F.coalesce("in", F.col("colour"))).alias("colour"), F.coalesce(F.col("in") < F.col("colour"), F.lit(False)).alias("moved")), "scc-colour")
            if colour is not front:
                drop(colour)
            colour, front = new, new.filter("moved").select("node", "colour")
        colour = colour.select("node", "colour")
        ends = apart(apart(left).join(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a")).join(colour.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b")
        inside = stage(ends.filter("ca = cb").select("a", "b", F.col("ca").alias("colour")), "scc-inside")
        found = front = stage(colour.filter("node = colour"), "scc-found")
        while not front.isEmpty():
            back = apart(inside).join(front.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
            front = stage(apart(back).join(found, ["node", "colour"], "left_anti"), "scc-front")
            found = found.unionByName(front)
        drop(inside)
        settle(found.withColumnRenamed("colour", "component"))
        rest = stage(apart(rest).join(found, "node", "left_anti"), "scc-nodes")
        left = inner(rest)


def largest_strong_links(links: DataFrame) -> DataFrame:
    """link_id of the links inside the strongly connected component with the most links (ties: the least node)."""
    comp = strong_components(links.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    c = stage(comp, "scc")
    inside = apart(apart(links).join(c.select(F.col("node").alias("from_id"), F.col("component").alias("component")), "from_id")).join(c.select(F.col("node").alias("to_id"), F.col("component").alias("other")), "to_id").filter("component = other").select("link_id", "component")
    inside = stage(inside, "scc-links")
    best = inside.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return inside.join(F.broadcast(best), "component", "left_semi").select("link_id")  # one row


def clean(nodes: DataFrame, links: DataFrame, routable: list[str], source_ways: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, links, invalid (link_id), quarantined (link_id, group) of a cleaned network.

    Invalid links go first. Of the links that allow a routable mode, those inside no such mode's largest
    strongly connected component go; they are grouped by the nodes they share. Links of other modes stay.
    """
    invalid = stage(invalid_links(links, nodes), "invalid")
    left = stage(apart(links).join(invalid, "link_id", "left_anti"), "valid")
    kept, touched = None, left.filter(F.arrays_overlap("modes", F.array(*map(F.lit, routable)))).select("link_id")
    for mode in sorted(set(routable)):
        own = left.filter(F.array_contains("modes", mode))
        if not own.isEmpty():
            best = largest_strong_links(own)
            kept = best if kept is None else kept.unionByName(best)
    gone = touched if kept is None else apart(touched).join(kept.distinct(), "link_id", "left_anti")
    gone = stage(gone, "gone")
    lost = apart(left).join(gone, "link_id", "left_semi")
    groups = weak_components(lost, "from_id", "to_id")
    quarantined = apart(lost).join(groups, lost["from_id"] == groups["node"]).select("link_id", F.col("component").alias("group"))
    if source_ways is not None:  # link_id, way_id: what a quarantined link was built from
        quarantined = apart(quarantined).join(source_ways.groupBy("link_id").agg(F.array_sort(F.collect_set("way_id")).alias("ways")), "link_id", "left")
    final = stage(apart(left).join(gone, "link_id", "left_anti"), "clean-links")
    used = final.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    return {"nodes": apart(nodes).join(used, "node_id", "left_semi"), "links": final, "invalid": invalid, "quarantined": quarantined}


# --- contraction ------------------------------------------------------------------------------------

#: Attributes of a segment's direction that must match across a contracted node.
DIRECTED = ("modes", "speed", "lanes", "signature", "open")


def directed_segments(segments: DataFrame) -> DataFrame:
    """Two rows a segment, one for each travel direction, with the attributes of both.

    segments: way_id, idx, a, b, length, per_lane, and fwd/bwd structs of DIRECTED. Rows: way_id, idx,
    forward, tail, head, length, per_lane, own, other.
    """
    keep = ["way_id", "idx", "length", "per_lane"]
    f = segments.select(*keep, F.lit(True).alias("forward"), F.col("a").alias("tail"), F.col("b").alias("head"), F.col("fwd").alias("own"), F.col("bwd").alias("other"))
    r = segments.select(*keep, F.lit(False).alias("forward"), F.col("b").alias("tail"), F.col("a").alias("head"), F.col("bwd").alias("own"), F.col("fwd").alias("other"))
    return f.unionByName(r)


def contractible_nodes(segments: DataFrame) -> DataFrame:
    """node_id of nodes a chain runs through: two segments to two other nodes, alike in both directions, open in one."""
    into = directed_segments(segments).filter("tail <> head")
    loops = segments.filter("a = b").select(F.col("a").alias("head"))
    at = into.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("way_id", "idx", "tail", "own", "other", "per_lane"))).alias("s")).filter(F.size("s") == 2)
    p, q = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    # into the node along p is like out of it along q, and the other way round
    alike = p["own"].eqNullSafe(q["other"]) & p["other"].eqNullSafe(q["own"]) & (p["per_lane"] == q["per_lane"])
    through = (p["own"]["open"] & q["other"]["open"]) | (q["own"]["open"] & p["other"]["open"])
    return at.filter(alike & through & (p["tail"] != q["tail"])).join(loops, "head", "left_anti").select(F.col("head").alias("node_id"))


def chains(segments: DataFrame, routing: DataFrame) -> DataFrame:
    """Directed segments (see directed_segments) with chain (way_id, idx, forward of its first) and pos in it.

    routing: node_id of nodes where chains end. Successors are joined by pointer jumping, so a chain of n
    segments takes log2 n rounds. A ring without a routing node has to be anchored first.
    """
    d = directed_segments(segments).filter("own.open").withColumn("key", F.struct("way_id", "idx", "forward"))
    ends = routing.select(F.col("node_id").alias("tail"), F.lit(True).alias("stop"))
    d = stage(d.join(ends, "tail", "left").withColumn("stop", F.coalesce("stop", F.lit(False))), "directed")
    before = d.select(F.col("head").alias("tail"), F.col("key").alias("prev"))
    same = (F.col("prev.way_id") == F.col("way_id")) & (F.col("prev.idx") == F.col("idx"))
    up = d.filter("not stop").join(before, "tail").filter(~same).groupBy("key").agg(F.min("prev").alias("prev"))
    # up to the chain's start: (ancestor, distance); a start is its own ancestor
    at = stage(d.select("key").join(up, "key", "left").select("key", F.coalesce("prev", F.col("key")).alias("up"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("pos")), "chain")
    while True:
        far = at.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("more"))
        new = stage(at.join(far, "up").select("key", F.col("up2").alias("up"), (F.col("pos") + F.col("more")).alias("pos"), (F.col("up2") != F.col("up")).alias("moved")), "chain")
        at = new.select("key", "up", "pos")
        if new.filter("moved").limit(1).count() == 0:
            return d.join(at.withColumnRenamed("up", "chain"), "key")


def anchor_cycles(segments: DataFrame, routing: DataFrame) -> DataFrame:
    """routing, and the least node of every component that has none."""
    comp = stage(weak_components(segments, "a", "b"), "anchors")
    served = comp.join(routing, comp["node"] == routing["node_id"], "left_semi").select("component").distinct()
    least = comp.join(served, "component", "left_anti").select(F.col("component").alias("node_id")).distinct()
    return routing.select("node_id").unionByName(least).distinct()


def cap_length(chain_rows: DataFrame, cap: float) -> DataFrame:
    """node_id of nodes inside car chains to keep so that no stretch passes cap: the running length restarts where it does.

    The restart depends on the stretch before it, so a chain is walked in order; a chain is one road. A task walks
    all its chains in one pass over their sorted rows.
    """
    import pyarrow as pa

    def walk(batches):
        total = 0.0
        for batch in batches:
            out = []
            length = batch.column("length").cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            for i, (more, first, last) in enumerate(zip(length, batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)):
                total = more if first else total + more
                if total > cap and not last:
                    out.append(i)
                    total = 0.0
            yield pa.record_batch([batch.column("node_id").take(pa.array(out, pa.int64()))], names=["node_id"])

    car = F.array_contains("own.modes", "car") | F.array_contains("other.modes", "car")
    chain = W.partitionBy("chain")
    rows = chain_rows.filter(car).select("chain", "pos", F.col("head").cast("string").alias("node_id"), "length").withColumn("first", F.row_number().over(chain.orderBy("pos")) == 1)
    rows = rows.withColumn("last", F.coalesce(F.col("pos") == F.max("pos").over(chain), F.lit(False)))
    return rows.select("node_id", "length", "first", "last").mapInArrow(walk, "node_id string").distinct()


def repeated_spans(chain_rows: DataFrame) -> DataFrame:
    """way_id, n of the spans that a way runs along more than once in one direction: all but one of them go."""
    whole = chain_rows.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "tail", "head", "way_id", "length"))).alias("p")).filter(F.aggregate("p", F.lit(0.0), lambda t, x: t + x["length"]) > 0)
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    way = F.when(first["tail"] <= last["head"], first["way_id"]).otherwise(last["way_id"])
    path = F.concat(F.array(first["tail"]), F.transform("p", lambda x: x["head"]))
    return whole.groupBy(way.alias("way_id"), path.alias("path")).agg((F.count("*") - 1).alias("n")).filter("n > 0").select("way_id", "n")


def contracted_links(chain_rows: DataFrame) -> DataFrame:
    """One link a chain: link_id, from_id, to_id, length, freespeed, lanes, capacity, modes, way_id, n_segments, ways, path.

    Attributes are the first segment's. The id names the way at the end with the lesser node; equal ids
    get a digest of the chain's nodes, then a number. Chains without length are dropped; a chain that
    repeats another's nodes and way is one link.
    """
    from ..functions.ids import chain_digest, contracted_link_id, node_id

    parts = F.array_sort(F.collect_list(F.struct("pos", "tail", "head", "way_id", "length", "own", "per_lane")))
    c = chain_rows.groupBy("chain").agg(parts.alias("p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    c = c.select("chain", "p", first["tail"].alias("s"), last["head"].alias("e"), F.aggregate("p", F.lit(0.0), lambda t, x: t + x["length"]).alias("length"), first["own"].alias("own"), first["per_lane"].alias("per_lane"), first["way_id"].alias("w1"), last["way_id"].alias("w2"))
    c = c.filter("length > 0").withColumn("forward", F.col("s") <= F.col("e"))
    c = c.withColumn("path", F.concat(F.array("s"), F.transform("p", lambda x: x["head"]))).withColumn("way_id", F.when(F.col("forward"), F.col("w1")).otherwise(F.col("w2")))
    c = c.withColumn("n", F.row_number().over(W.partitionBy("way_id", "path").orderBy("chain"))).filter("n = 1").drop("n")
    base = contracted_link_id(F.col("way_id"), F.col("forward"), F.least("s", "e"), F.greatest("s", "e"))
    canonical = F.when(F.col("forward"), F.col("path")).otherwise(F.reverse("path"))
    c = c.withColumn("base", base).withColumn("full", F.concat("base", F.lit("_c"), chain_digest(canonical)))
    order = W.partitionBy("base").orderBy("s", "chain")
    c = c.withColumn("nth", F.row_number().over(order))
    again = F.row_number().over(W.partitionBy("full", F.col("nth") > 1).orderBy("s", "chain"))
    c = c.withColumn("again", again)
    ident = F.when(F.col("nth") == 1, F.col("base")).when(F.col("again") == 1, F.col("full")).otherwise(F.concat("full", F.lit("_"), (F.col("again") - 1).cast("string")))
    ways = F.array_distinct(F.transform("p", lambda x: x["way_id"]))
    lanes = F.col("own.lanes").cast("double")
    return c.select(ident.alias("link_id"), node_id(F.col("s")).alias("from_id"), node_id(F.col("e")).alias("to_id"), "length", F.col("own.speed").alias("freespeed"), lanes.alias("lanes"), (lanes * F.col("per_lane")).alias("capacity"), F.col("own.modes").alias("modes"), "way_id", F.size("p").alias("n_segments"), F.when(F.col("forward"), ways).otherwise(F.reverse(ways)).alias("ways"), "path", "forward")


def same_modes(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))

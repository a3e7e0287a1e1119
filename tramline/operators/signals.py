"""Signalized junctions: clusters, descriptors, readiness counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import movement_type
from .network import weak_components
from .roads import controlled_modes
from .staging import stage


def internal_paths(signals: DataFrame, links: DataFrame, threshold: float, max_hops: int) -> DataFrame:
    """a, b, length, path of the shortest path from one signal node to another over internal links, not through a signal.

    A recursion of max_hops joins; only the shortest to a node goes on.
    """
    steps = links.filter(F.col("link_class").endswith("_link") | (F.col("link_class") == "link")).select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), "length")
    front = signals.select(F.col("node_id").alias("a"), F.col("node_id").alias("at"), F.lit(0.0).alias("length"), F.array("node_id").alias("path"))
    stop = signals.select(F.col("node_id").alias("next"), F.lit(True).alias("signal"))
    out = None
    for _ in range(max_hops):
        far = front.withColumnRenamed("length", "so_far").join(steps, "at").filter(~F.array_contains("path", F.col("next"))).withColumn("length", F.col("so_far") + F.col("length")).filter(F.col("length") <= threshold)
        far = far.select("a", "next", "length", F.concat("path", F.array("next")).alias("path")).join(stop, "next", "left")
        far = stage(far.groupBy("a", "next", "signal").agg(F.min(F.struct("length", "path")).alias("best")).select("a", "next", "signal", "best.length", "best.path"), "signal-paths")
        hit = far.filter("signal and a <> next").select("a", F.col("next").alias("b"), "length", "path")
        out = hit if out is None else out.unionByName(hit)
        front = far.filter("signal is null").select("a", F.col("next").alias("at"), "length", "path")
    return out.groupBy("a", "b").agg(F.min(F.struct("length", "path")).alias("best")).select("a", "b", "best.length", "best.path")


def cluster_signals(signals: DataFrame, links: DataFrame, threshold: float = 0.0, max_hops: int = 4) -> DataFrame:
    """node_id, cluster; see junction_clusters."""
    return junction_clusters(signals, links, threshold, max_hops)[0]


def junction_clusters(signals: DataFrame, links: DataFrame, threshold: float = 0.0, max_hops: int = 4) -> tuple[DataFrame, DataFrame]:
    """(node_id, cluster of the signals; cluster, path of the directed paths inside clusters).

    Signals joined by internal paths are one cluster if every pair of it is within the threshold. Threshold 0
    leaves each signal alone. Complete linkage, shortest edges first, inside each connected group of paths;
    such a group is one interchange.
    """
    import pyarrow as pa

    alone = signals.select("node_id", F.col("node_id").alias("cluster"))
    if threshold <= 0:
        return alone, alone.limit(0).select("cluster", F.array("node_id").alias("path"))
    paths = stage(internal_paths(signals, links, threshold, max_hops), "signal-edges")
    edges = paths.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("length").alias("length"))
    groups = weak_components(edges)
    rows = edges.join(groups.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "length")

    def clustered(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
        near = set(edges)
        member = {n: {n} for e in edges for n in e}
        for a, b in edges:
            x, y = member[a], member[b]
            if x is not y and all((min(p, q), max(p, q)) in near for p in x for q in y):
                x |= y
                for n in y:
                    member[n] = x
        return [(n, min(s)) for n, s in member.items()]

    def link(batches):
        """All groups of a task in one pass over its sorted edges."""
        frame = lambda found: pa.record_batch([pa.array([n for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["node_id", "cluster"])
        own, edges = None, []
        for batch in batches:
            found = []
            for component, a, b in zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b")), strict=True):
                if component != own:
                    found += clustered(edges)
                    own, edges = component, []
                edges.append((a, b))
            yield frame(found)
        yield frame(clustered(edges))

    ordered = rows.repartition("component").sortWithinPartitions("component", "length", "a", "b").select("component", "a", "b")
    joined = ordered.mapInArrow(link, "node_id string, cluster string")
    clusters = stage(alone.join(joined.withColumnRenamed("cluster", "c"), "node_id", "left").select("node_id", F.coalesce("c", "cluster").alias("cluster")), "signal-clusters")
    end = lambda name, cluster: clusters.select(F.col("node_id").alias(name), F.col("cluster").alias(cluster))
    return clusters, paths.join(end("a", "cluster"), "a").join(end("b", "other"), "b").filter("cluster = other").select("cluster", "path")


def witness_reach(clusters: DataFrame, witnesses: DataFrame) -> DataFrame:
    """cluster, a, b: the members b that a reaches along steps of its cluster's witness paths, a itself included."""
    steps = witnesses.select("cluster", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("at"), F.slice("path", F.lit(2), F.size("path") - 1).alias("next"))).alias("s"))
    steps = stage(steps.select("cluster", "s.at", "s.next").distinct(), "witness-steps")
    seen = front = stage(clusters.select("cluster", F.col("node_id").alias("a"), F.col("node_id").alias("at")), "witness-reach")
    while not front.isEmpty():
        far = front.join(steps, ["cluster", "at"]).select("cluster", "a", F.col("next").alias("at")).distinct()
        front = stage(far.join(seen, ["cluster", "a", "at"], "left_anti"), "witness-reach")
        seen = seen.unionByName(front)
    return seen.select("cluster", "a", F.col("at").alias("node_id")).join(clusters, ["cluster", "node_id"], "left_semi").select("cluster", "a", F.col("node_id").alias("b"))


def boundary_links(links: DataFrame, clusters: DataFrame, witnesses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incoming: cluster, via, link_id, modes; outgoing alike; internal: cluster, link_id) of each junction.

    A link with both ends inside, at members or on a witness path, is internal: no approach and no exit.
    """
    inside = clusters.select("cluster", "node_id").unionByName(witnesses.select("cluster", F.explode("path").alias("node_id"))).distinct()
    at = lambda end: inside.select("cluster", F.col("node_id").alias(end))
    internal = links.select("link_id", "from_id", "to_id").join(at("from_id"), "from_id").join(at("to_id"), ["cluster", "to_id"]).select("cluster", "link_id")
    side = lambda end: links.select("link_id", F.col(end).alias("via"), "modes").join(clusters.select(F.col("node_id").alias("via"), "cluster"), "via").join(internal, ["cluster", "link_id"], "left_anti")
    return side("to_id"), side("from_id"), internal


def cluster_movements(links: DataFrame, forbidden: DataFrame, clusters: DataFrame, witnesses: DataFrame) -> DataFrame:
    """cluster, via, via_out, from_link, to_link, controlled, restricted, legal.

    Approaches of a junction against its exits, where the exit's member is reached from the approach's along the
    witnesses and the two share a mode.
    """
    incoming, outgoing, _ = boundary_links(links, clusters, witnesses)
    a = incoming.select("cluster", "via", F.col("link_id").alias("from_link"), F.col("modes").alias("in_modes"))
    b = outgoing.select("cluster", F.col("via").alias("via_out"), F.col("link_id").alias("to_link"), F.col("modes").alias("out_modes"))
    reach = witness_reach(clusters, witnesses).select("cluster", F.col("a").alias("via"), F.col("b").alias("via_out"))
    m = a.join(reach, ["cluster", "via"]).join(b, ["cluster", "via_out"]).filter("from_link <> to_link")
    return controlled_modes(m, forbidden).select("cluster", "via", "via_out", "from_link", "to_link", "controlled", "restricted", "legal")


def confidence(tags: Column) -> Column:
    """3 for a usable traffic_signals tag, 2 for highway=traffic_signals, else 1."""
    named = tags["traffic_signals"].isNotNull() & ~tags["traffic_signals"].isin("no", "0", "none")
    return F.when(named, 3).when(tags["highway"] == "traffic_signals", 2).otherwise(1)


def provenance(primary: Column, size: Column, tags: Column) -> Column:
    """Where a junction comes from, as text."""
    tag = F.when(tags.isNull(), "none").when(tags["traffic_signals"].isNotNull(), F.concat(F.lit("traffic_signals="), tags["traffic_signals"])).when(tags["highway"] == "traffic_signals", "highway=traffic_signals").otherwise("inferred")
    return F.concat(F.lit("osm_node="), primary, F.lit(";clusterSize="), size.cast("string"), F.lit(";tag="), tag)


def junctions(moves: DataFrame, links: DataFrame, clusters: DataFrame, witnesses: DataFrame, headings: DataFrame, nodes: DataFrame, classify=movement_type) -> tuple[DataFrame, DataFrame]:
    """(movements of junctions with type; one descriptor a junction).

    moves: cluster_movements. headings: link_id, vx, vy. nodes: node_id, tags of the map. A movement that arrives at
    one node and leaves another has no angle; classify names the turn of two headings. A descriptor has the junction's members, approaches, exits and internal
    links in order, counts legal and prohibited movements and joins the modes they control.
    """
    h = lambda link, a, b: headings.select(F.col("link_id").alias(link), F.col("vx").alias(a), F.col("vy").alias(b))
    kind = F.when(F.col("via") != F.col("via_out"), "unknown").otherwise(classify(F.col("ix"), F.col("iy"), F.col("ox"), F.col("oy")))
    m = moves.join(h("from_link", "ix", "iy"), "from_link", "left").join(h("to_link", "ox", "oy"), "to_link", "left")
    m = m.select("cluster", "via", "via_out", "from_link", "to_link", kind.alias("type"), "controlled", "restricted", "legal")
    legal = F.size("legal") > 0
    d = m.groupBy("cluster").agg(F.count("*").alias("n_movements"), F.count_if(legal).alias("n_legal"), F.count_if(~legal).alias("n_prohibited"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("controlled")))).alias("modes"))
    listed = lambda df, name: df.groupBy("cluster").agg(F.array_sort(F.collect_set("link_id")).alias(name))
    incoming, outgoing, internal = boundary_links(links, clusters, witnesses)
    primary = clusters.join(nodes.select("node_id", "tags"), "node_id", "left").groupBy("cluster").agg(F.array_sort(F.collect_list("node_id")).alias("members"), F.min_by("tags", "node_id").alias("tags"))
    out = primary.join(d, "cluster", "left").join(listed(incoming, "incoming"), "cluster", "left").join(listed(outgoing, "outgoing"), "cluster", "left").join(listed(internal, "internal"), "cluster", "left")
    none = F.array().cast("array<string>")
    first = F.regexp_replace(F.col("members")[0], "^osm_node_", "")
    return m, out.select(
        F.concat(F.lit("signal_"), first).alias("junction_id"), "cluster", "members", confidence(F.col("tags")).alias("confidence"), provenance(first, F.size("members"), F.col("tags")).alias("provenance"),
        *(F.coalesce(c, none).alias(c) for c in ("incoming", "outgoing", "internal", "modes")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_movements", "n_legal", "n_prohibited")),
    )


def approach_turn_lanes(descriptors: DataFrame, turn_lane_links: DataFrame) -> DataFrame:
    """cluster of the junctions of which an approach is on a way with turn:lanes tags. turn_lane_links: link_id."""
    return descriptors.select("cluster", F.explode("incoming").alias("link_id")).join(turn_lane_links, "link_id", "left_semi").select("cluster").distinct()


def high_degree(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """node_id of nodes with at least four links in and out that no junction has."""
    ends = links.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return ends.filter("degree >= 4").join(clusters, "node_id", "left_anti").select("node_id")


def junction_issues(descriptors: DataFrame, moves: DataFrame, links: DataFrame, clusters: DataFrame, turn_lane_links: DataFrame) -> DataFrame:
    """severity, code, object_id: junctions without entry or exit, approaches without a legal exit, approaches whose
    turn:lanes aren't decomposed, and busy nodes that aren't signalized."""
    issue = lambda df, severity, code, ident: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(ident).alias("object_id"))
    usable = moves.filter("size(legal) > 0").select("cluster", F.col("from_link").alias("link_id")).distinct()
    stuck = descriptors.select("cluster", F.explode("incoming").alias("link_id")).join(usable, ["cluster", "link_id"], "left_anti")
    parts = [
        issue(descriptors.filter("size(incoming) = 0"), "warning", "signalized-no-incoming", "cluster"), issue(descriptors.filter("size(outgoing) = 0"), "warning", "signalized-no-outgoing", "cluster"),
        issue(stuck, "warning", "approach-no-legal-outgoing", "link_id"), issue(approach_turn_lanes(descriptors, turn_lane_links), "info", "ambiguous-lane-tags", "cluster"),
        issue(high_degree(links, clusters), "info", "non-signalized-high-degree", "node_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def readiness(descriptors: DataFrame, links: DataFrame, clusters: DataFrame, turn_lane_links: DataFrame, n_graph_nodes: int, n_routing_nodes: int, n_signal_nodes: int, restriction_issues: DataFrame) -> DataFrame:
    """One row: the eight counters of a network's readiness for signals."""
    size = lambda df, name: df.agg(F.count("*").alias(name))
    lanes = descriptors.join(approach_turn_lanes(descriptors, turn_lane_links), "cluster", "left_semi").agg(F.coalesce(F.sum("n_movements"), F.lit(0)).alias("movements_without_lane_info"))
    out = size(descriptors, "candidate_junctions").withColumn("confirmed_junctions", F.col("candidate_junctions")).withColumn("preserved_signal_nodes", F.lit(n_signal_nodes).cast("long"))
    out = out.withColumn("collapsed_geometry_nodes", F.lit(n_graph_nodes - n_routing_nodes).cast("long")).withColumn("preserved_semantic_nodes", F.lit(n_routing_nodes).cast("long"))
    one_row = (size(high_degree(links, clusters), "high_degree_non_signalized"), lanes, size(restriction_issues.filter("code = 'restriction-via-way-unsupported'"), "via_way_restrictions"))
    for part in one_row:
        out = out.crossJoin(part)  # one row each
    return out

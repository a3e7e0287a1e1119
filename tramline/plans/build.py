"""Whole builds: road map to network, timetable to schedule, both to a mapped bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, lanes, mapping, network, roads, signals, spatial, timetable, validate
from ..operators.staging import stage


def road_network(tables: dict[str, DataFrame], config: roads.RoadConfig = roads.DEFAULT, keep: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, links, issues, and what cleaning removed, of a road map (nodes, ways, members, relations).

    keep: node_id of further nodes to keep, such as transit stops.
    """
    nodes = stage(tables["nodes"], "nodes")
    resolved = stage(roads.resolve_ways(tables["ways"].filter("size(refs) >= 2"), config), "ways")
    tracks = None
    if config.collapse_tracks:
        rail = resolved.select("way_id", "refs", F.col("tags")["railway"].alias("railway"))
        tracks = spatial.parallel_tracks(rail, nodes)
    segs = stage(roads.segments(resolved, nodes, tracks), "segments")
    issues = roads.way_issues(tables["ways"], nodes, config)
    if config.keep_geometry_nodes:
        links = roads.segment_links(segs)
    else:
        via = roads.via_nodes(tables["ways"], tables["members"], tables["relations"])
        classes = roads.classify_nodes(resolved, nodes, via, keep, config)
        fixed = classes.filter("size(reasons) > 0").select("node_id")
        every = segs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
        routing = fixed.unionByName(every.join(network.contractible_nodes(segs), "node_id", "left_anti")).distinct()
        routing = stage(routing, "routing")
        if config.max_length > 0:
            routing = stage(routing.unionByName(network.cap_length(network.chains(segs, network.anchor_cycles(segs, routing)), config.max_length)).distinct(), "routing")
        routing = stage(network.anchor_cycles(segs, routing), "routing")
        spans = stage(network.chains(segs, routing), "chains")
        links = network.contracted_links(spans)
    links = stage(links, "links")
    if not config.keep_geometry_nodes:
        ends = links.select(F.explode(F.array("from_id", "to_id")).alias("at")).distinct()
        lonely = routing.join(ends, F.concat(F.lit("osm_node_"), "node_id") == F.col("at"), "left_anti")
        none = F.lit(None).cast("string")
        issues = issues.unionByName(network.repeated_spans(spans).select(F.lit("degenerate-span").alias("code"), "way_id", F.col("n").cast("string").alias("message")))
        issues = issues.unionByName(lonely.select(F.lit("isolated-routing-node").alias("code"), none.alias("way_id"), F.col("node_id").alias("message")))
    used = links.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    places = nodes.select(F.concat(F.lit("osm_node_"), "node_id").alias("node_id"), "x", "y").join(used, "node_id", "left_semi")
    graph = segs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    out = {"nodes": places, "links": links, "issues": issues, "resolved": resolved, "n_graph_nodes": graph.count()}
    if config.clean:
        cleaned = network.clean(places, links, list(config.routable))
        removed = cleaned["invalid"].select(F.lit("removed-invalid-link").alias("code"), F.col("link_id").alias("way_id"), F.lit("").alias("message"))
        groups = cleaned["quarantined"].groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("link_id")), ",").alias("message"))
        out |= {"nodes": cleaned["nodes"], "links": cleaned["links"], "quarantined": cleaned["quarantined"]}
        out["issues"] = issues.unionByName(removed).unionByName(groups.select(F.lit("quarantined-component").alias("code"), F.lit(None).cast("string").alias("way_id"), "message"))
    return out


def provenance(source: str, licence: str, attribution: str, input_name: str, crs: str, geometry: str, tags_kept: bool, imported_at: str) -> dict[str, str]:
    """The attributes that tell where a network comes from."""
    return {
        "osm:source": source, "osm:license": licence, "osm:attribution": attribution, "osm:input": input_name, "osm:targetCrs": crs, "osm:geometryMode": geometry,
        "osm:rawTagsKept": str(tags_kept).lower(), "osm:importedAt": imported_at,
    }


def signal_ready(tables: dict[str, DataFrame], config: roads.RoadConfig = roads.DEFAULT, threshold: float = 0.0) -> dict[str, DataFrame]:
    """road_network with stops kept, plus restrictions, lanes, movements, junctions and their readiness."""
    out = road_network(tables, config, roads.stop_nodes(tables["nodes"]))
    links, nodes = out["links"], out["nodes"]
    forbidden, problems = roads.turn_restrictions(tables["members"], tables["relations"], links)
    out["forbidden"] = forbidden
    out["restriction_issues"] = problems
    out["lanes"], out["lane_issues"] = roads.lane_table(links, nodes, out["resolved"])
    out["lane_hints"] = lanes.lane_hints(links, out["resolved"])
    out["restrictions_by_pair"] = roads.restriction_index(forbidden)
    ident = F.concat(F.lit("osm_node_"), "node_id").alias("node_id")
    lit = tables["nodes"].filter(roads.T.is_signalized(F.col("tags"))).select(ident).join(nodes.select("node_id"), "node_id", "left_semi")
    kinds = links.join(out["resolved"].select("way_id", F.col("tags")["highway"].alias("link_class")), "way_id", "left")
    clusters, witnesses = signals.junction_clusters(lit, kinds, threshold)
    clusters, witnesses = stage(clusters, "clusters"), stage(witnesses, "witnesses")
    moves = stage(signals.cluster_movements(links, forbidden, clusters, witnesses), "moves")
    ends = nodes.select("node_id", "x", "y")
    at = links.join(ends.select(F.col("node_id").alias("from_id"), F.col("x").alias("fx"), F.col("y").alias("fy")), "from_id").join(ends.select(F.col("node_id").alias("to_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), "to_id")
    headings = at.select("link_id", (F.col("tx") - F.col("fx")).alias("vx"), (F.col("ty") - F.col("fy")).alias("vy"))
    found, described = signals.junctions(moves, links, clusters, witnesses, headings, tables["nodes"].select(ident, "tags"))
    signals_at = tables["nodes"].filter(F.col("tags")["highway"] == "traffic_signals").select(ident)
    out["intersection_hints"] = lanes.intersection_hints(nodes, links, out["lane_hints"], signals_at)
    out["movements"], out["junctions"] = found, stage(described, "junctions")
    turn_lanes = F.size(F.filter(F.map_keys("tags"), lambda k: k.startswith("turn:lanes"))) > 0
    on_lanes = links.select("link_id", F.explode("ways").alias("way_id")).join(out["resolved"].filter(turn_lanes).select("way_id"), "way_id", "left_semi").select("link_id").distinct()
    out["junction_issues"] = signals.junction_issues(out["junctions"], moves, links, clusters, on_lanes)
    out["readiness"] = signals.readiness(out["junctions"], links, clusters, on_lanes, out["n_graph_nodes"], nodes.count(), lit.count(), problems)
    return out


def feeds(spark: SparkSession, paths: list[str], dates: str = "most_trips", explicit: str | None = None) -> dict[str, DataFrame]:
    """The schedule of several feeds: each feed's ids begin with its own id, made from its name; types of vehicles are shared."""
    from ..functions.ids import unique_feed_ids
    from ..sources import timetable_csv

    names = unique_feed_ids([p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".zip").removesuffix(".gtfs") for p in paths])
    each = [schedule(timetable_csv.feed(spark, p), name, dates, explicit) for name, p in zip(names, paths, strict=True)]
    out = each[0]
    for more in each[1:]:
        out = {k: v.unionByName(more[k], allowMissingColumns=True) for k, v in out.items()}
    return out | {k: out[k].distinct() for k in ("vehicle_types", "dates")}


def schedule(feed: dict[str, DataFrame], feed_id: str = "feed", dates: str = "most_trips", explicit: str | None = None) -> dict[str, DataFrame]:
    """stop_facilities, lines, routes, route_stops, departures, vehicle types and vehicles of a feed on the chosen days."""
    spark = feed["trips"].sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    days = ", ".join(f"{d} int" for d in calendar.DAYS)
    cal = feed.get("calendar", empty(f"service_id string, {days}, start_date string, end_date string, row long"))
    exceptions = feed.get("calendar_dates", empty("service_id string, date string, exception_type int, row long"))
    frequencies = feed.get("frequencies", empty("trip_id string, start_time int, end_time int, headway_secs int, exact_times int, row long"))
    stop_times, trips = feed["stop_times"], timetable.usable_trips(feed["trips"], feed["routes"], feed["stop_times"])
    active = stage(calendar.active_dates(cal, exceptions), "active")
    chosen = stage(calendar.select_dates(dates, feed["trips"], frequencies, cal, exceptions, explicit), "chosen")
    offsets = stage(timetable.stop_offsets(stop_times), "offsets")
    patterns = stage(timetable.trip_patterns(trips.drop("route_type"), feed["routes"], offsets, feed_id), "patterns")
    deps = stage(timetable.departures(trips, stop_times, frequencies, active, chosen, feed_id), "departures")
    if bad := deps.join(offsets.filter("not valid").select("trip_id").distinct(), "trip_id").take(1):
        raise ValueError(f"trip {bad[0]['trip_id']} departs before it arrives")
    if twice := deps.groupBy("departure_id").count().filter("count > 1").take(1):
        raise ValueError(f"duplicate departure id {twice[0][0]}")
    stops = timetable.platforms(feed["stops"])
    ident = lambda c: F.concat_ws(":", F.lit(feed_id), c)
    facilities = stops.select(ident("stop_id").alias("stop_id"), F.col("stop_lon").alias("x"), F.col("stop_lat").alias("y"), F.lit(None).cast("string").alias("link_id"), F.col("stop_name").alias("name"), F.lit(False).alias("blocking"), F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))
    first = patterns.groupBy("line_id", F.col("pattern_route_id").alias("route_id"), "mode").agg(F.min("trip_id").alias("trip_id"))
    calls = first.join(offsets, "trip_id").join(stops.select("stop_id"), "stop_id", "left_semi").select("line_id", "route_id", "mode", "pos", ident("stop_id").alias("stop_id"), "arrival_offset", "departure_offset", "await")
    own = deps.join(patterns.select("trip_id", "line_id", F.col("pattern_route_id").alias("route_id")), "trip_id")
    types, vehicles = timetable.vehicles(deps, patterns)
    names = feed["routes"].select(ident("route_id").alias("line_id"), F.coalesce("route_short_name", "route_long_name").alias("name"))
    return {
        "stop_facilities": facilities, "lines": patterns.select("line_id").distinct().join(names, "line_id"), "routes": first.select("line_id", "route_id", "mode"), "route_stops": calls,
        "route_links": empty("line_id string, route_id string, pos int, link_id string"), "departures": own.select("line_id", "route_id", "departure_id", "departure_time", F.col("departure_id").alias("vehicle_id")),
        "vehicle_types": types, "vehicles": vehicles, "dates": chosen,
    }


def mapped(net: dict[str, DataFrame], sched: dict[str, DataFrame], project, radius: float = 100.0, max_distance: float = 1000.0, margin: float = 0.0) -> dict[str, DataFrame]:
    """The schedule clipped to the network and mapped onto it, vehicles pruned, all tables of a bundle."""
    x, y = project(F.col("lon"), F.col("lat"))
    stops = sched["stop_facilities"].withColumn("_x", x).withColumn("_y", y).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})
    clip = spatial.clip_schedule(stops, sched["route_stops"], net["nodes"], margin)
    calls = stage(clip["route_stops"], "calls")
    wanted = calls.select("stop_id", "mode").distinct().join(clip["stops"].select("stop_id", "x", "y", "name"), "stop_id").withColumnRenamed("stop_id", "point_id")
    cand = stage(spatial.stop_candidates(wanted, net["links"], net["nodes"], radius), "candidates")
    forbidden = None
    if "forbidden" in net:
        forbidden = net["forbidden"].select(F.col("from_link").alias("link_id"), "mode", F.array("to_link").alias("sequence"))
    m = mapping.map_routes(calls, clip["stops"], cand, net["links"], forbidden, max_distance)
    children = m["child_stops"].join(clip["stops"].select(F.col("stop_id").alias("parent_id"), "name", "blocking", "lon", "lat"), "parent_id")
    deps = sched["departures"].join(clip["routes"], ["line_id", "route_id"], "left_semi")
    columns = ["link_id", "from_id", "to_id", "length", "capacity", "freespeed", "lanes", "modes"]
    return {
        "nodes": net["nodes"].select("node_id", "x", "y").unionByName(m["artificial_nodes"]), "links": net["links"].select(columns).unionByName(m["artificial_links"].select(columns)),
        "stop_facilities": children.select(F.col("child_id").alias("stop_id"), "x", "y", "link_id", "name", "blocking", "lon", "lat"), "lines": sched["lines"].join(clip["routes"].select("line_id").distinct(), "line_id", "left_semi"),
        "routes": sched["routes"].join(clip["routes"], ["line_id", "route_id"], "left_semi"), "route_stops": m["route_stops"].drop("stop_id").withColumnRenamed("child_id", "stop_id"), "route_links": m["route_links"],
        "departures": deps, "vehicles": timetable.used_vehicles(sched["vehicles"], deps), "vehicle_types": sched["vehicle_types"], "candidates": cand,
    }


def bundle(spark: SparkSession, roadmap: str, timetable_path: str, folder: str, crs: str = "EPSG:3857", config: roads.RoadConfig = roads.DEFAULT, dates: str = "most_trips") -> dict[str, int]:
    """Reads both inputs, writes network, schedule, vehicles, lanes and GeoJSON under folder; counters."""
    from ..functions.geometry import projector
    from ..sinks import xml_files
    from ..sources import roadmap as maps
    from ..sources import timetable_csv

    net = signal_ready(maps.read(spark, roadmap, crs), config)
    out = mapped(net, schedule(timetable_csv.feed(spark, timetable_path), dates=dates), projector(crs)[0])
    out = {k: stage(v, k) for k, v in out.items()}
    lane_rows = stage(net["lanes"], "lanes")
    xml_files.network(out, f"{folder}/network.xml")
    xml_files.schedule(out, f"{folder}/schedule.xml")
    xml_files.vehicles(out, f"{folder}/vehicles.xml")
    xml_files.lanes(lane_rows, f"{folder}/lanes.xml")
    xml_files.geojson(out["stop_facilities"], f"{folder}/stops.geojson")
    issues = validate.network_issues(out["nodes"], out["links"], loop_info_prefix="pt_loop_")
    return {k: out[k].count() for k in ("nodes", "links", "lines", "routes", "departures", "vehicles")} | {"lanes": lane_rows.count(), "errors": issues.filter("severity = 'error'").count()}

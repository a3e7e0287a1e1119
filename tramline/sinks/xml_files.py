"""Scenario files: rows become XML text on the executors, and reach one file in id order, streamed.

Texts are sorted and written as part files; one task joins those into the file, so the driver holds none. The
file's path, like the shared folder, has to be one that executors reach. An attribute that is null isn't
written. A DOCTYPE or namespace is a parameter (the whole declaration, or the attribute with its leading
space). `write_parts` leaves the texts as part files instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import discard, scratch

COPY_BYTES = 8 << 20


def escape(c: Column) -> Column:
    out = c.cast("string")
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def element(name: str, attributes: dict[str, Column], *body: Column) -> Column:
    """<name a="..">body</name>, or <name a=".."/> without one; null attributes and bodies are left out."""
    head = F.concat(F.lit(f"<{name}"), *(F.coalesce(F.concat(F.lit(f' {k}="'), escape(v), F.lit('"')), F.lit("")) for k, v in attributes.items()))
    inner = F.concat(*(F.coalesce(b, F.lit("")) for b in body)) if body else F.lit("")
    return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>")))


def each(array: Column, body) -> Column:
    return F.array_join(F.transform(array, body), "")


def bag(attrs: Column) -> Column:
    """<attributes> of a map<name, struct<cls, val>>, by name; nothing if it is empty."""
    items = each(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit('<attribute name="'), escape(e["key"]), F.lit('" class="'), escape(e["value"]["cls"]), F.lit('">'), escape(e["value"]["val"]), F.lit("</attribute>")))
    return F.when(F.coalesce(F.size(attrs), F.lit(0)) > 0, F.concat(F.lit("<attributes>"), items, F.lit("</attributes>")))


def wrapped(name: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>")))


def lines(rows: DataFrame, key: list[str], text: Column) -> DataFrame:
    """Texts in key order."""
    return rows.select(*key, text.alias("_text")).orderBy(*key).select("_text")


def _join_files(path: str, pieces: list[tuple[str, str]], between: str) -> None:
    """One file of texts and of folders of part files, in order. The last between of a folder is left out; gzip members follow each other."""
    import gzip
    import uuid

    from pyarrow.fs import FileSelector, FileSystem

    at_uri = lambda p: FileSystem.from_uri(p if "://" in p else f"file://{p}")
    fs, at = at_uri(path)
    new = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new, compression=None) as out:
        for kind, value in pieces:
            if kind == "text":
                out.write(gzip.compress(value.encode()) if path.endswith(".gz") else value.encode())
                continue
            source, folder = at_uri(value)
            parts = sorted((f for f in source.get_file_info(FileSelector(folder)) if f.base_name.startswith("part-") and f.size), key=lambda f: f.base_name)
            for i, f in enumerate(parts):
                left = f.size - (len(between.encode()) if i == len(parts) - 1 else 0)
                with source.open_input_stream(f.path, compression=None) as part:
                    while left > 0:
                        block = part.read(min(left, COPY_BYTES))
                        if not block:
                            raise OSError(f"{f.path} ends early")
                        out.write(block)
                        left -= len(block)
    fs.move(new, at)


def _write(path: str, pieces: list[str | DataFrame], between: str = "") -> None:
    """Texts as they are; those of DataFrames each with between behind it (but the last), or with a line break."""
    spark = next((p.sparkSession for p in pieces if isinstance(p, DataFrame)), None) or SparkSession.active()
    placed = []
    for p in pieces:
        if isinstance(p, str):
            placed.append(("text", p))
        else:
            folder = f"{scratch(spark, 'texts')}/rows"
            p.write.option("compression", "gzip" if path.endswith(".gz") else "none").option("lineSep", between or "\n").text(folder)
            placed.append(("folder", folder))
    spark.sparkContext.parallelize([0], 1).foreach(lambda _: _join_files(path, placed, between))
    discard(spark, *(folder.removesuffix("/rows") for kind, folder in placed if kind == "folder"))


def write_file(path: str, root: str, parts: list[str | DataFrame], attributes: str = "", doctype: str = "") -> None:
    head = "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', *([doctype] if doctype else []), f"<{root}{attributes}>"])
    _write(path, [f"{head}\n", *(f"{p}\n" if isinstance(p, str) else p for p in parts), f"</{root}>\n"])


def write_parts(rows: DataFrame, text: Column, folder: str) -> None:
    rows.select(text.alias("value")).write.mode("errorifexists").text(folder)


def of(t: DataFrame, name: str) -> Column:
    return F.col(name) if name in t.columns else F.lit(None).cast("map<string,struct<cls:string,val:string>>" if name == "attrs" else "string")


def _parent(rows: DataFrame, keys: list[str], order: list[str], text: Column, name: str) -> DataFrame:
    """keys, name: the children's texts of each parent, in order."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda s: s["_t"]), "").alias(name))


def node_text(n: DataFrame) -> Column:
    return element("node", {"id": F.col("node_id"), "x": F.col("x"), "y": F.col("y")}, bag(of(n, "attrs")))


def link_text(k: DataFrame) -> Column:
    return element("link", {"id": F.col("link_id"), "from": F.col("from_id"), "to": F.col("to_id"), "length": F.col("length"), "freespeed": F.col("freespeed"), "capacity": F.col("capacity"), "permlanes": F.col("lanes"), "modes": F.array_join(F.array_sort("modes"), ",")}, bag(of(k, "attrs")))


def network(t: dict[str, DataFrame], path: str, cap_period: str | None = None, doctype: str = "", about: dict[str, str] | None = None) -> None:
    """about: attributes of the network itself, such as build.provenance."""
    n, k = t["nodes"], t["links"]
    links = f'<links capperiod="{cap_period}">' if cap_period else "<links>"
    one = n.sparkSession.range(1).select(bag(F.map_from_entries(F.array(*(F.struct(F.lit(a).alias("key"), F.struct(F.lit("java.lang.String").alias("cls"), F.lit(v).alias("val")).alias("value")) for a, v in about.items())))).alias("t")).first()[0] if about else None
    write_file(path, "network", [*([one] if one else []), "<nodes>", lines(n, ["node_id"], node_text(n)), "</nodes>", links, lines(k, ["link_id"], link_text(k)), "</links>"], doctype=doctype)


def population(t: dict[str, DataFrame], path: str, doctype: str = "") -> None:
    from ..functions.times import format_clock

    e = t["elements"]
    r = F.col("route")
    route = F.when(r.isNotNull(), element("route", {"type": F.when(r["route_type"] == "network", "links").when(r["route_type"] == "transit", "default_pt").otherwise(F.lit(None)), "start_link": r["start_link"], "end_link": r["end_link"], "trav_time": format_clock(r["travel_time"]), "distance": r["distance"]}, escape(r["text"])))
    act = element("activity", {"type": F.col("act_type"), "link": F.col("link_id"), "facility": F.col("facility_id"), "x": F.col("x"), "y": F.col("y"), "start_time": format_clock(F.col("start_time")), "end_time": format_clock(F.col("end_time")), "maximumDuration": F.col("max_dur")})
    inner = _parent(e, ["person_id", "plan_idx"], ["pos"], F.when(F.col("kind") == "leg", element("leg", {"mode": F.col("mode")}, route)).otherwise(act), "_e")
    plans = t["plans"].join(inner, ["person_id", "plan_idx"], "left")
    plan = element("plan", {"selected": F.when(F.col("selected"), "yes").otherwise("no")}, F.col("_e"))
    p = t["persons"].join(_parent(plans, ["person_id"], ["plan_idx"], plan, "_p"), "person_id", "left")
    write_file(path, "population", [lines(p, ["person_id"], element("person", {"id": F.col("person_id")}, bag(of(p, "attrs")), F.col("_p")))], doctype=doctype)


def schedule(t: dict[str, DataFrame], path: str, doctype: str = "") -> None:
    from ..functions.times import format_clock

    s = t["stop_facilities"]
    stops = lines(s, ["stop_id"], element("stopFacility", {"id": F.col("stop_id"), "x": F.col("x"), "y": F.col("y"), "linkRefId": F.col("link_id"), "stopAreaId": of(s, "area_id"), "name": F.col("name"), "isBlocking": F.coalesce(F.col("blocking"), F.lit(False))}, bag(of(s, "attrs"))))
    key = ["line_id", "route_id"]
    numbered = lambda df, by, n: df.withColumn(n, F.row_number().over(W.partitionBy(*by).orderBy(*by)))
    own = numbered(t["routes"], key, "_n").join(numbered(t["lines"], ["line_id"], "_m").select("line_id", "_m"), "line_id")
    none = F.lit(None)

    def part(df: DataFrame, section: int, text: Column, k1: Column = none, k2: Column = none) -> DataFrame:
        return df.select("line_id", "_m", F.lit(1).alias("level"), "route_id", "_n", F.lit(section).alias("section"), k1.cast("double").alias("k1"), k2.cast("string").alias("k2"), text.alias("_t"))

    def children(rows: DataFrame, section: int, name: str, text: Column, *order: Column) -> list[DataFrame]:
        """Rows of their own, so that no text of a route is ever whole in memory."""
        rows = rows.join(own.select(*key, "_m", "_n"), key)
        have = rows.select(*key, "_m", "_n").distinct()
        return [part(have, section, F.lit(f"<{name}>")), part(rows, section + 1, text, *order), part(have, section + 2, F.lit(f"</{name}>"))]

    head = F.concat(F.lit('<transitRoute id="'), F.coalesce(escape(F.col("route_id")), F.lit("")), F.lit('">'), *(F.coalesce(x, F.lit("")) for x in (wrapped("description", escape(of(t["routes"], "description"))), wrapped("transportMode", escape(F.col("mode"))))))
    line = lambda level, text: numbered(t["lines"], ["line_id"], "_m").select("line_id", "_m", F.lit(level).alias("level"), none.cast("string").alias("route_id"), none.cast("int").alias("_n"), none.cast("int").alias("section"), none.cast("double").alias("k1"), none.cast("string").alias("k2"), text.alias("_t"))
    opening = F.regexp_replace(element("transitLine", {"id": F.col("line_id"), "name": F.col("name")}), "/>$", ">")
    rows = [
        line(0, opening), line(2, F.lit("</transitLine>")), part(own, 0, head), part(own, 10, F.lit("</transitRoute>")),
        *children(t["route_stops"], 1, "routeProfile", element("stop", {"refId": F.col("stop_id"), "arrivalOffset": format_clock(F.col("arrival_offset")), "departureOffset": format_clock(F.col("departure_offset")), "awaitDeparture": F.col("await")}), F.col("pos")),
        *children(t["route_links"], 4, "route", element("link", {"refId": F.col("link_id")}), F.col("pos")),
        *children(t["departures"], 7, "departures", element("departure", {"id": F.col("departure_id"), "departureTime": format_clock(F.col("departure_time")), "vehicleRefId": F.col("vehicle_id")}), F.col("departure_time"), F.col("departure_id")),
    ]
    texts = reduce(DataFrame.unionByName, rows)
    write_file(path, "transitSchedule", ["<transitStops>", stops, "</transitStops>", lines(texts, [c for c in texts.columns if c != "_t"], F.col("_t"))], doctype=doctype)


def facilities(t: dict[str, DataFrame], path: str) -> None:
    options = _parent(t["facility_activities"], ["facility_id"], ["type"], element("activity", {"type": F.col("type")}, F.when(F.col("capacity").isNotNull(), element("capacity", {"value": F.col("capacity")}))), "_a")
    f = t["facilities"].join(options, "facility_id", "left")
    write_file(path, "facilities", [lines(f, ["facility_id"], element("facility", {"id": F.col("facility_id"), "x": F.col("x"), "y": F.col("y"), "linkId": F.col("link_id"), "desc": of(f, "description")}, F.col("_a"), bag(of(f, "attrs"))))])


def households(t: dict[str, DataFrame], path: str) -> None:
    members = _parent(t["household_members"], ["household_id"], ["pos"], element("personId", {"refId": F.col("person_id")}), "_m")
    h = t["households"].join(members, "household_id", "left")
    write_file(path, "households", [lines(h, ["household_id"], element("household", {"id": F.col("household_id"), "income": F.col("income")}, wrapped("members", F.col("_m")), bag(of(h, "attrs"))))])


def vehicles(t: dict[str, DataFrame], path: str, namespace: str = "") -> None:
    v = t["vehicle_types"]
    one = lambda name, attribute, c: F.when(F.col(c).isNotNull(), element(name, {attribute: F.col(c)})) if c in v.columns else F.lit(None).cast("string")
    text = element("vehicleType", {"id": F.col("type_id")}, bag(of(v, "attrs")), element("capacity", {"seats": F.col("seats"), "standingRoomInPersons": F.col("standing")}), one("length", "meter", "length"), one("width", "meter", "width"), one("accessTime", "secondsPerPerson", "access_time"), one("egressTime", "secondsPerPerson", "egress_time"))
    write_file(path, "vehicleDefinitions", [lines(v, ["type_id"], text), lines(t["vehicles"], ["vehicle_id"], element("vehicle", {"id": F.col("vehicle_id"), "type": F.col("type_id")}))], attributes=namespace)


def lanes(rows: DataFrame, path: str, namespace: str = "") -> None:
    """link_id, lane_id, to_links, capacity, ...; a lane that leads nowhere raises."""
    order = "lane_index" if "lane_index" in rows.columns else "lane_id"
    to = each(F.col("to_links"), lambda k: element("toLink", {"refId": k}))
    other = each(F.col("to_lanes"), lambda k: element("toLane", {"refId": k})) if "to_lanes" in rows.columns else F.lit("")
    leads = F.when(F.concat(to, other) == "", F.raise_error(F.concat(F.lit("lane leads nowhere: "), "lane_id")).cast("string")).otherwise(F.when(to != "", to).otherwise(other))
    text = element("lane", {"id": F.col("lane_id")}, wrapped("leadsTo", leads), element("capacity", {"vehiclesPerHour": F.col("capacity")}), wrapped("alignment", F.coalesce(of(rows, "alignment"), F.lit("0"))), bag(of(rows, "attrs")))
    a = _parent(rows, ["link_id"], [order], text, "_l")
    write_file(path, "laneDefinitions", [lines(a, ["link_id"], element("lanesToLinkAssignment", {"linkIdRef": F.col("link_id")}, F.col("_l")))], attributes=namespace)


def config(rows: DataFrame, path: str) -> None:
    p = element("param", {"name": F.col("name"), "value": F.col("value")})
    s = _parent(rows, ["module", "set_idx", "set_type"], ["name"], p, "_p")
    text = F.when(F.col("set_idx") < 0, F.col("_p")).otherwise(element("parameterset", {"type": F.col("set_type")}, F.col("_p")))
    m = _parent(s, ["module"], ["set_idx"], text, "_m")
    write_file(path, "config", [lines(m, ["module"], element("module", {"name": F.col("module")}, F.col("_m")))])


def signals(t: dict[str, DataFrame], folder: str) -> None:
    """systems.xml, groups.xml, control.xml, amber.xml, intergreen.xml for the tables there are."""
    ref = lambda name, c: element(name, {"refId": F.col(c)})
    system = lambda df, body, key="refId": element("signalSystem", {key: F.col("system_id")}, body)
    if "signals" in t:
        s = element("signal", {"id": F.col("signal_id"), "linkIdRef": F.col("link_id")}, each(F.col("lane_refs"), lambda k: element("lane", {"refId": k})), wrapped("turningMoveRestrictions", each(F.col("to_links"), lambda k: element("toLink", {"refId": k}))))
        d = _parent(t["signals"], ["system_id"], ["signal_id"], s, "_s")
        write_file(f"{folder}/systems.xml", "signalSystems", [lines(d, ["system_id"], system(d, wrapped("signals", F.col("_s")), "id"))])
    if "groups" in t:
        g = _parent(t["groups"], ["system_id", "group_id"], ["signal_id"], ref("signal", "signal_id"), "_s")
        d = _parent(g, ["system_id"], ["group_id"], element("signalGroup", {"id": F.col("group_id")}, F.col("_s")), "_g")
        write_file(f"{folder}/groups.xml", "signalGroups", [lines(d, ["system_id"], system(d, F.col("_g")))])
    if "control" in t:
        key = ["system_id", "plan_idx"]
        sec = lambda name, c: F.when(F.col(c).isNotNull(), element(name, {"sec": F.col(c)}))
        settings = _parent(t["settings"], key, ["group_id"], element("signalGroupSettings", {"refId": F.col("group_id")}, sec("onset", "onset"), sec("dropping", "dropping")), "_t")
        p = t["plans"].join(settings, key, "left")
        plan = element("signalPlan", {"id": F.col("plan_id")}, sec("cycleTime", "cycle"), sec("offset", "offset"), F.col("_t"))
        d = t["control"].join(_parent(p, ["system_id"], ["plan_idx"], plan, "_p"), "system_id", "left")
        write_file(f"{folder}/control.xml", "signalControl", [lines(d, ["system_id"], system(d, F.when(F.col("has_controller"), element("signalSystemController", {}, wrapped("controllerIdentifier", escape(F.col("controller"))), F.col("_p")))))])
    if "amber" in t:
        a = t["amber"]
        both = F.concat(*(F.coalesce(F.when(F.col(c).isNotNull(), element(n, {"seconds": F.col(c)})), F.lit("")) for n, c in (("redAmber", "red_amber"), ("amber", "amber"))))
        own = _parent(a.filter("system_id is not null"), ["system_id"], ["signal_id"], F.when(F.col("signal_id").isNull(), F.concat(F.lit("<systemDefaults>"), both, F.lit("</systemDefaults>"))).otherwise(element("signal", {"refId": F.col("signal_id")}, both)), "_a")
        write_file(f"{folder}/amber.xml", "amberTimes", [lines(a.filter("system_id is null"), ["red_amber"], F.concat(F.lit("<globalDefaults>"), both, F.lit("</globalDefaults>"))), lines(own, ["system_id"], system(own, F.col("_a")))])
    if "intergreen" in t:
        b = _parent(t["intergreen"], ["system_id", "ending"], ["beginning"], element("beginningSignalGroup", {"refId": F.col("beginning"), "timeSeconds": F.col("sec")}), "_b")
        d = _parent(b, ["system_id"], ["ending"], element("endingSignalGroup", {"refId": F.col("ending")}, F.col("_b")), "_e")
        write_file(f"{folder}/intergreen.xml", "intergreenTimes", [lines(d, ["system_id"], system(d, F.col("_e")))])


def geojson(stops: DataFrame, path: str, candidates: DataFrame | None = None) -> None:
    """A feature collection of stops (stop_id, lon, lat, name, link_id), a point each, by id; candidates: stop_id, link_id."""
    s = stops
    if candidates is not None:
        s = s.join(candidates.groupBy("stop_id").agg(F.array_sort(F.collect_set("link_id")).alias("candidates")), "stop_id", "left")
    have = [c for c in ("stop_id", "name", "link_id", "candidates") if c in s.columns]
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*have).alias("properties")))
    _write(path, ['{"type":"FeatureCollection","features":[\n', lines(s, ["stop_id"], feature), "\n]}\n"], between=",\n")


def scenario(t: dict[str, DataFrame], folder: str) -> None:
    """network.xml, schedule.xml, vehicles.xml, households.xml and config.xml naming them; a config is required."""
    from ..sources.scenario_xml import INPUT_FILES

    if t.get("config") is None:
        raise ValueError("a scenario needs a config")
    writers = {"network": ("links", network), "schedule": ("routes", schedule), "vehicles": ("vehicle_types", vehicles), "households": ("households", households)}
    named = []
    for kind, (needs, write) in writers.items():
        if needs in t:
            write(t, f"{folder}/{kind}.xml")
            named.append((*INPUT_FILES[kind], f"{kind}.xml"))
    c = t["config"]
    spark = c.sparkSession
    files = spark.createDataFrame([(m, -1, None, n, v) for m, n, v in named], "module string, set_idx int, set_type string, name string, value string")
    config(c.join(files.select("module", "set_idx", "name"), ["module", "set_idx", "name"], "left_anti").select(files.columns).unionByName(files), f"{folder}/config.xml")

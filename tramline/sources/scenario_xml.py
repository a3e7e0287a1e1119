"""Scenario files as tables: network, population, schedule, facilities, households, vehicles, lanes, config, events, signals.

Each is one scan of Spark's xml source with an explicit schema; .gz is read as it is. Optional attributes
are null. Attribute bags are map<name, struct<cls, val>>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import clock_or_seconds
from ..operators.staging import size_of

ATTRIBUTES = "attributes struct<attribute:array<struct<_name:string,_class:string,_VALUE:string>>>"


WHOLE_BYTES = 32 << 20  # a smaller file (an eighth of it, compressed) is one task; a larger one is read in splits
CHILDREN_BYTES = 1 << 20  # the same for elements read apart from their parent: the parser copies a parent's array at each child


def scan(spark: SparkSession, path: str, row_tag: str, schema: str, xsd: str | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    if not xsd and size_of(spark, path)[0] > whole_bytes:
        rows = split_rows(spark, path, row_tag)
        if rows is not None:
            return rows.select(F.from_xml("row", schema, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema)
    return (reader.option("rowValidationXSDPath", xsd) if xsd else reader).load(path)


def cut(spark: SparkSession, path: str, before: str) -> DataFrame:
    """value: the text up to the first occurrence of before, and after each one; without comments that end in the same value.

    A plain file is read in splits. Spark's text source keeps the order inside a block: path, block, i.
    """
    v = F.col("value")
    parts = spark.read.option("lineSep", before).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return parts.withColumn("value", F.when(F.contains(v, F.lit("<!--")), F.regexp_replace(v, "(?s)<!--.*?-->", "")).otherwise(v))


ATTRS = r"""(?:\s*[^\s=<>/"']+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*"""


def checked(spark: SparkSession, path: str, tag: str) -> tuple[DataFrame, bool]:
    """(cut at the element's start, with head, its start tag, and row, its text; whether the cut isn't certain)."""
    v, head, end = F.col("value"), F.col("head"), F.lit(f"</{tag}>")
    parts = cut(spark, path, f"<{tag} ").withColumn("head", F.regexp_extract(v, rf"^{ATTRS}\s*/?>", 0))
    parts = parts.withColumn("row", F.when(head.endswith("/>"), head).when((head != "") & F.contains(v, end), F.concat(F.substring_index(v, f"</{tag}>", 1), end)))
    odd = reduce(Column.__or__, (F.contains(v, F.lit(x)) for x in ("<!--", "<![CDATA[", *(f"<{tag}{c}" for c in "\t\r\n/>")))) | ((head != "") & F.col("row").isNull())
    got = parts.agg(F.count_if(odd).alias("odd"), F.count_if(head == "").alias("outside"), F.count_distinct("path").alias("files")).first()
    return parts, bool(got["odd"]) or got["outside"] != got["files"]  # only what is before the first element is outside


def split_rows(spark: SparkSession, path: str, tag: str, inside: tuple[str, ...] = ()) -> DataFrame | None:
    """row: the text of each element of the name, found between occurrences of its start, and its place (path, block, i).
    For each name of inside: place and start tag (as an empty element) of the last such element that begins before the row.

    None if the cut isn't certain: comments or CDATA across elements, elements of the name inside each other,
    a start tag that isn't followed by a space or isn't well-formed. Spark's xml source reads those, in one task.
    """
    parts, odd = checked(spark, path, tag)
    if odd:
        return None
    v = F.col("value")
    start = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(v, rf"(?s)^.*(<{p}\b{ATTRS}\s*/?>)", 1), F.lit("")), r"\s*/?>$", "/>")
    found = lambda p: F.when(F.contains(v, F.lit(f"<{p}")) & start(p).isNotNull(), F.struct("path", "block", "i", start(p).alias("tag")))
    rows = parts.select(F.concat(F.lit(f"<{tag} "), "row").alias("row"), "path", "block", "i", *(found(p).alias(p) for p in inside))
    if inside:
        # what a block begins inside is what the blocks before it ended in: a row a block
        ends = rows.groupBy("path", "block").agg(*(F.max_by(p, F.when(F.col(p).isNotNull(), F.col("i"))).alias(p) for p in inside))
        earlier = W.orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select("path", "block", *(F.last(p, ignorenulls=True).over(earlier).alias(f"_{p}") for p in inside))
        before = W.partitionBy("path", "block").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumns({p: F.last(p, ignorenulls=True).over(before) for p in inside}).join(F.broadcast(ends), ["path", "block"]).withColumns({p: F.coalesce(p, f"_{p}") for p in inside})
    rows = rows.select("row", "path", "block", "i", *inside).filter("row is not null")
    return rows.repartition(spark.sparkContext.defaultParallelism) if size_of(spark, path)[1] else rows


def children(spark: SparkSession, path: str, tag: str, schema: str, inside: dict[str, str], whole_bytes: int = CHILDREN_BYTES) -> DataFrame | None:
    """x: each element of the name; the ids of its parents by inside (name: column) as columns; place, and that of each parent (at_name).

    None for a small file, or one that can't be cut: there they are read as the parent's array.
    """
    if size_of(spark, path)[0] <= whole_bytes or (rows := split_rows(spark, path, tag, tuple(inside))) is None:
        return None
    ident = lambda p: F.from_xml(F.col(f"{p}.tag"), "_id string", {"mode": "PERMISSIVE"})["_id"]
    return rows.select(F.from_xml("row", schema, {"mode": "PERMISSIVE"}).alias("x"), "path", "block", "i", *(ident(p).alias(c) for p, c in inside.items()), *(F.struct(f"{p}.path", f"{p}.block", f"{p}.i").alias(f"at_{p}") for p in inside))


def attrs(column: str = "attributes") -> Column:
    """The attribute bag; an attribute without a value isn't there, the last of a name counts."""
    items = F.filter(F.coalesce(F.col(f"{column}.attribute"), F.array().cast("array<struct<_name:string,_class:string,_VALUE:string>>")), lambda a: a["_name"].isNotNull() & a["_VALUE"].isNotNull())
    last = F.filter(items, lambda a, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda b: b["_name"] == a["_name"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["_name"], F.struct(F.coalesce(a["_class"], F.lit("java.lang.String")).alias("cls"), a["_VALUE"].alias("val")))))


def modes_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda m: F.trim(m)), lambda m: m != ""))


def number(c: str) -> Column:
    return F.trim(F.col(c)).cast("double")


def unescape(text: Column) -> Column:
    out = text
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def network(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, links. A missing or bad required number fails the scan."""
    n = scan(spark, path, "node", f"_id string, _x string, _y string, {ATTRIBUTES}")
    k = scan(spark, path, "link", f"_id string, _from string, _to string, _length string, _capacity string, _freespeed string, _permlanes string, _modes string, {ATTRIBUTES}")
    need = lambda c: F.coalesce(number(c), F.raise_error(F.lit(f"{c[1:]} is missing")).cast("double"))
    return {
        "nodes": n.select(F.col("_id").alias("node_id"), need("_x").alias("x"), need("_y").alias("y"), attrs().alias("attrs")),
        "links": k.select(F.col("_id").alias("link_id"), F.col("_from").alias("from_id"), F.col("_to").alias("to_id"), need("_length").alias("length"), need("_capacity").alias("capacity"), need("_freespeed").alias("freespeed"), need("_permlanes").alias("lanes"), modes_of(F.col("_modes")).alias("modes"), attrs().alias("attrs")),
    }


ELEMENT = r"(?s)<(activity|act|leg)\b[^>]*?(?:/>|(?<!/)>.*?</\1>)"


def network_attributes(spark: SparkSession, path: str) -> DataFrame:
    """name, cls, val of the network's own attributes, which stand before its nodes; the file's beginning is read."""
    import re
    from html import unescape as plain

    from .lane_files import head

    start = re.search(r"(?s)<network\b[^>]*>(.*?)<(?:nodes|links)\b", head(path))
    block = re.search(r"(?s)<attributes>(.*?)</attributes>", start[1]) if start else None
    found = re.findall(r'(?s)<attribute\b[^>]*?name="([^"]*)"[^>]*?class="([^"]*)"[^>]*>(.*?)</attribute>', block[1]) if block else []
    return spark.createDataFrame([tuple(map(plain, f)) for f in found], "name string, cls string, val string")


PERSON = f"_id string, {ATTRIBUTES}, plan array<struct<_selected:string,_score:string,_type:string>>"
PLAN_TEXT = "_id string, plan array<string>"


def population(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """persons, plans, elements. Plans are read as inner text too, since activities and legs interleave."""
    p = scan(spark, path, "person", PERSON)
    plans, elements = plans_of(p), plan_elements(scan(spark, path, "person", PLAN_TEXT))
    return {"persons": p.select(F.col("_id").alias("person_id"), attrs().alias("attrs")), "plans": plans, "elements": elements}


def plans_of(p: DataFrame) -> DataFrame:
    """person_id, plan_idx, selected, type, score of scanned persons."""
    plans = p.select(F.col("_id").alias("person_id"), F.posexplode("plan").alias("plan_idx", "q"))
    return plans.select("person_id", "plan_idx", F.coalesce(F.lower("q._selected").isin("yes", "true"), F.lit(False)).alias("selected"), F.col("q._type").alias("type"), F.col("q._score").try_cast("double").alias("score"))


def plan_elements(scanned: DataFrame) -> DataFrame:
    """person_id, plan_idx, pos, kind, ... of persons scanned with their plans' inner text, batch or stream."""
    raw = scanned.select(F.col("_id").alias("person_id"), F.posexplode("plan").alias("plan_idx", "inner"))
    e = raw.select("person_id", "plan_idx", F.posexplode(F.regexp_extract_all("inner", F.lit(ELEMENT), F.lit(0))).alias("pos", "x"))
    head = F.regexp_extract("x", r"(?s)^<[^>]*>", 0)
    at = lambda *names: F.coalesce(*(F.when(F.regexp_extract(head, rf'\b{n}\s*=\s*"([^"]*)"', 1) != "", unescape(F.regexp_extract(head, rf'\b{n}\s*=\s*"([^"]*)"', 1))) for n in names))
    route = F.regexp_extract("x", r"(?s)(<route\b[^>]*?(?:/>|>.*?</route>))", 1)
    of_route = lambda n: F.when(F.regexp_extract(route, rf'^<[^>]*\b{n}\s*=\s*"([^"]*)"', 1) != "", unescape(F.regexp_extract(route, rf'^<[^>]*\b{n}\s*=\s*"([^"]*)"', 1)))
    body = F.trim(unescape(F.regexp_replace(F.regexp_extract(route, r"(?s)^<route\b[^>]*>(.*)</route>", 1), "<[^>]*>", "")))
    kind = of_route("type")
    route_type = F.when(route == "", F.lit(None)).when(kind.isin("links", "network") | (kind.isNull() & of_route("start_link").isNotNull() & (body != "")), "network").when(kind.isin("default_pt", "pt", "experimentalPt1"), "transit").otherwise("unknown")
    return e.select(
        "person_id", "plan_idx", "pos", F.when(F.col("x").startswith("<leg"), "leg").otherwise("activity").alias("kind"), at("type").alias("act_type"), at("x").try_cast("double").alias("x"), at("y").try_cast("double").alias("y"),
        at("link").alias("link_id"), at("facility").alias("facility_id"), clock_or_seconds(at("start_time")).alias("start_time"), clock_or_seconds(at("end_time")).alias("end_time"), at("maximumDuration").try_cast("double").alias("max_dur"), at("mode").alias("mode"),
        F.when(route != "", F.struct(route_type.alias("route_type"), of_route("start_link").alias("start_link"), of_route("end_link").alias("end_link"), F.filter(F.split(body, r"\s+"), lambda v: v != "").alias("links"), clock_or_seconds(of_route("trav_time")).alias("travel_time"), of_route("distance").try_cast("double").alias("distance"), body.alias("text"))).alias("route"),
    )


def schedule(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """stop_facilities, lines, routes, route_stops, route_links, departures."""
    s = scan(spark, path, "stopFacility", f"_id string, _x string, _y string, _linkRefId string, _linkId string, _stopAreaId string, _parentId string, _name string, _isBlocking boolean, {ATTRIBUTES}")
    stops = s.select(F.col("_id").alias("stop_id"), number("_x").alias("x"), number("_y").alias("y"), F.coalesce("_linkRefId", "_linkId").alias("link_id"), F.coalesce("_stopAreaId", "_parentId").alias("area_id"), F.col("_name").alias("name"), F.coalesce("_isBlocking", F.lit(False)).alias("blocking"), attrs().alias("attrs"))
    stop = "struct<_refId:string,_arrivalOffset:string,_departureOffset:string,_awaitDeparture:boolean>"
    leaves = "_id string, _departureTime string, _vehicleRefId string"
    apart = children(spark, path, "departure", leaves, {"transitLine": "line_id", "transitRoute": "route_id"})
    route = f"_id string, _mode string, transportMode string, description string, routeProfile struct<stop:array<{stop}>>, route struct<link:array<struct<_refId:string>>>"
    if apart is None:
        route += ", departures struct<departure:array<struct<_id:string,_departureTime:string,_vehicleRefId:string>>>"
    t = scan(spark, path, "transitLine", f"_id string, _name string, transitRoute array<struct<{', '.join(f'{k}:{v}' for k, v in (x.split(' ', 1) for x in _split(route)))}>>")
    r = t.select(F.col("_id").alias("line_id"), F.explode("transitRoute").alias("r")).select("line_id", F.col("r._id").alias("route_id"), "r")
    departures = r.select("line_id", "route_id", F.explode("r.departures.departure").alias("x")) if apart is None else apart
    calls = r.select("line_id", "route_id", F.posexplode("r.routeProfile.stop").alias("pos", "s"))
    off = lambda c: F.coalesce(clock_or_seconds(F.col(c)), F.lit(None).cast("double"))
    return {
        "stop_facilities": stops,
        "lines": t.select(F.col("_id").alias("line_id"), F.col("_name").alias("name")),
        "routes": r.select("line_id", "route_id", F.coalesce("r._mode", "r.transportMode").alias("mode"), F.col("r.description").alias("description")),
        "route_stops": calls.select("line_id", "route_id", "pos", F.col("s._refId").alias("stop_id"), F.coalesce(off("s._arrivalOffset"), off("s._departureOffset"), F.lit(0.0)).alias("arrival_offset"), F.coalesce(off("s._departureOffset"), off("s._arrivalOffset"), F.lit(0.0)).alias("departure_offset"), F.coalesce("s._awaitDeparture", F.lit(False)).alias("await")),
        "route_links": r.select("line_id", "route_id", F.posexplode("r.route.link._refId").alias("pos", "link_id")),
        "departures": departures.select("line_id", "route_id", F.col("x._id").alias("departure_id"), clock_or_seconds(F.col("x._departureTime")).alias("departure_time"), F.col("x._vehicleRefId").alias("vehicle_id")),
    }


def _split(ddl: str) -> list[str]:
    """Fields of a DDL string, commas inside <> kept."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def facilities(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    f = scan(spark, path, "facility", f"_id string, _x string, _y string, _linkId string, _desc string, activity array<struct<_type:string,capacity:struct<_value:string>,_capacity:string>>, {ATTRIBUTES}")
    options = f.select(F.col("_id").alias("facility_id"), F.explode("activity").alias("a"))
    return {
        "facilities": f.select(F.col("_id").alias("facility_id"), number("_x").alias("x"), number("_y").alias("y"), F.col("_linkId").alias("link_id"), F.col("_desc").alias("description"), attrs().alias("attrs")),
        "facility_activities": options.select("facility_id", F.col("a._type").alias("type"), F.coalesce("a._capacity", "a.capacity._value").try_cast("double").alias("capacity")),
    }


def households(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    apart = children(spark, path, "personId", "_refId string, _ref string", {"household": "household_id"})
    listed = ", members struct<personId:array<struct<_refId:string,_ref:string>>>" if apart is None else ""
    h = scan(spark, path, "household", f"_id string, _income string, income struct<_VALUE:string>{listed}, {ATTRIBUTES}")
    if apart is None:
        members = h.select(F.col("_id").alias("household_id"), F.posexplode("members.personId").alias("pos", "x"))
    else:
        pos = F.row_number().over(W.partitionBy("at_household").orderBy("path", "block", "i")) - 1
        members = apart.select("household_id", pos.alias("pos"), "x")
    return {
        "households": h.select(F.col("_id").alias("household_id"), F.coalesce("_income", "income._VALUE").alias("income"), attrs().alias("attrs")),
        "household_members": members.select("household_id", "pos", F.coalesce("x._refId", "x._ref").alias("person_id")),
    }


def vehicles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    size = "struct<_meter:string,_meters:string>"
    t = scan(spark, path, "vehicleType", f"_id string, capacity struct<_seats:string,_standingRoomInPersons:string,_standingRoom:string>, length {size}, width {size}, accessTime struct<_secondsPerPerson:string>, egressTime struct<_secondsPerPerson:string>, {ATTRIBUTES}")
    v = scan(spark, path, "vehicle", "_id string, _type string")
    d = lambda *cs: F.coalesce(*(F.trim(F.col(c)).try_cast("double") for c in cs))
    return {
        "vehicle_types": t.select(F.col("_id").alias("type_id"), d("capacity._seats").cast("int").alias("seats"), d("capacity._standingRoomInPersons", "capacity._standingRoom").cast("int").alias("standing"), d("length._meter", "length._meters").alias("length"), d("width._meter", "width._meters").alias("width"), F.coalesce(d("accessTime._secondsPerPerson"), F.lit(1.0)).alias("access_time"), F.coalesce(d("egressTime._secondsPerPerson"), F.lit(1.0)).alias("egress_time"), attrs().alias("attrs")),
        "vehicles": v.select(F.col("_id").alias("vehicle_id"), F.col("_type").alias("type_id")),
    }


def lanes(spark: SparkSession, path: str) -> DataFrame:
    """link_id, lane_id, to_links, to_lanes, capacity, starts_at, alignment, attrs, assignment of the v2 and v1.1 dialects."""
    ref, to = "array<struct<_refId:string>>", "array<struct<_idRef:string,_refId:string>>"
    lane = f"_id string, leadsTo struct<toLink:{ref},toLane:{ref}>, toLink {to}, capacity struct<_vehiclesPerHour:string>, startsAt struct<_meterFromLinkEnd:string>, alignment string, {ATTRIBUTES}"
    fields = ", ".join(f"{k}:{v}" for k, v in (x.split(" ", 1) for x in _split(lane)))
    a = scan(spark, path, "lanesToLinkAssignment", f"_linkIdRef string, _linkId string, lane array<struct<{fields}>>").withColumn("assignment", F.monotonically_increasing_id())
    x = a.select(F.coalesce("_linkIdRef", "_linkId").alias("link_id"), "assignment", F.explode("lane").alias("l")).select("link_id", "assignment", "l.*")
    refs = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(ref)), lambda r: r["_refId"])
    old = F.transform(F.coalesce(F.col("toLink"), F.array().cast(to)), lambda r: F.coalesce(r["_idRef"], r["_refId"]))
    return x.select("link_id", F.col("_id").alias("lane_id"), F.concat(refs("leadsTo.toLink"), old).alias("to_links"), refs("leadsTo.toLane").alias("to_lanes"), F.col("capacity._vehiclesPerHour").alias("capacity"), F.col("startsAt._meterFromLinkEnd").alias("starts_at"), F.col("alignment").alias("alignment"), attrs().alias("attrs"), "assignment")


def config(spark: SparkSession, path: str) -> DataFrame:
    """module, set_idx, set_type, name, value of parameters; the last of a name counts. set_idx -1: the module itself."""
    p = "struct<_name:string,_value:string>"
    m = scan(spark, path, "module", f"_name string, param array<{p}>, parameterset array<struct<_type:string,param:array<{p}>>>")
    own = m.select(F.col("_name").alias("module"), F.lit(-1).alias("set_idx"), F.lit(None).cast("string").alias("set_type"), F.posexplode("param").alias("pos", "p"))
    sets = m.select(F.col("_name").alias("module"), F.posexplode("parameterset").alias("set_idx", "s")).select("module", "set_idx", F.col("s._type").alias("set_type"), F.posexplode("s.param").alias("pos", "p"))
    return own.unionByName(sets).groupBy("module", "set_idx", "set_type", F.col("p._name").alias("name")).agg(F.max_by("p._value", "pos").alias("value"))


#: Other names of event types.
EVENT_ALIASES = {"entered link": "entered_link", "left link": "left_link", "vehicle enters traffic": "vehicle_enters_traffic", "vehicle leaves traffic": "vehicle_leaves_traffic", "actstart": "act_start", "actend": "act_end"}
EVENT = "_time double, _type string, _person string, _link string, _vehicle string, _facility string, _actType string, _legMode string"


def event_columns(e: DataFrame) -> DataFrame:
    kind = F.lower(F.trim(F.col("_type")))
    names = F.create_map(*(F.lit(x) for kv in EVENT_ALIASES.items() for x in kv))
    return e.select(F.coalesce("_time", F.lit(0.0)).alias("time"), F.coalesce(names[kind], kind).alias("type"), F.col("_person").alias("person_id"), F.col("_link").alias("link_id"), F.col("_vehicle").alias("vehicle_id"), F.col("_facility").alias("facility_id"), F.col("_actType").alias("act_type"), F.col("_legMode").alias("leg_mode"))


def events(spark: SparkSession, path: str) -> DataFrame:
    return event_columns(scan(spark, path, "event", EVENT))


def signals(spark: SparkSession, systems: str | None = None, groups: str | None = None, control: str | None = None, amber: str | None = None, intergreen: str | None = None) -> dict[str, DataFrame]:
    """The tables of validate.signal_issues for the families given."""
    out = {}
    if systems:
        s = scan(spark, systems, "signalSystem", "_id string, signals struct<signal:array<struct<_id:string,_linkIdRef:string,lane:array<struct<_refId:string,_idRef:string>>,turningMoveRestrictions:struct<toLink:array<struct<_refId:string,_idRef:string>>>>>>")
        x = s.select(F.col("_id").alias("system_id"), F.explode("signals.signal").alias("s"))
        ids = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<_refId:string,_idRef:string>>")), lambda r: F.coalesce(r["_refId"], r["_idRef"]))
        out["signals"] = x.select("system_id", F.col("s._id").alias("signal_id"), F.col("s._linkIdRef").alias("link_id"), ids("s.lane").alias("lane_refs"), ids("s.turningMoveRestrictions.toLink").alias("to_links"))
    if groups:
        g = scan(spark, groups, "signalSystem", "_refId string, signalGroup array<struct<_id:string,signal:array<struct<_refId:string>>>>")
        out["groups"] = g.select(F.col("_refId").alias("system_id"), F.explode("signalGroup").alias("g")).select("system_id", F.col("g._id").alias("group_id"), F.explode("g.signal._refId").alias("signal_id"))
    if control:
        plan = "struct<_id:string,start:struct<_daytime:string>,stop:struct<_daytime:string>,cycleTime:struct<_sec:int>,offset:struct<_sec:int>,signalGroupSettings:array<struct<_refId:string,onset:struct<_sec:int>,dropping:struct<_sec:int>>>>"
        c = scan(spark, control, "signalSystem", f"_refId string, signalSystemController struct<controllerIdentifier:string,signalPlan:array<{plan}>>")
        out["control"] = c.select(F.col("_refId").alias("system_id"), F.col("signalSystemController.controllerIdentifier").alias("controller"), F.col("signalSystemController").isNotNull().alias("has_controller"))
        p = c.select(F.col("_refId").alias("system_id"), F.posexplode("signalSystemController.signalPlan").alias("plan_idx", "p"))
        out["plans"] = p.select("system_id", "plan_idx", F.col("p._id").alias("plan_id"), clock_or_seconds(F.col("p.start._daytime")).alias("start"), clock_or_seconds(F.col("p.stop._daytime")).alias("stop"), F.col("p.cycleTime._sec").alias("cycle"), F.col("p.offset._sec").alias("offset"))
        out["settings"] = p.select("system_id", "plan_idx", F.explode("p.signalGroupSettings").alias("g")).select("system_id", "plan_idx", F.col("g._refId").alias("group_id"), F.col("g.onset._sec").alias("onset"), F.col("g.dropping._sec").alias("dropping"))
    if amber:
        sec = "struct<_seconds:int>"
        both = f"redAmber:{sec},amber:{sec}"
        a = scan(spark, amber, "signalSystem", f"_refId string, systemDefaults struct<{both}>, signal array<struct<_refId:string,{both}>>")
        g = scan(spark, amber, "globalDefaults", both.replace(":", " ", 1).replace(",amber:", ", amber "))
        row = lambda df, system, signal, at: df.select(system.alias("system_id"), signal.alias("signal_id"), F.col(f"{at}redAmber._seconds").alias("red_amber"), F.col(f"{at}amber._seconds").alias("amber"))
        none = F.lit(None).cast("string")
        each = a.select("_refId", F.explode("signal").alias("s"))
        out["amber"] = row(g, none, none, "").unionByName(row(a.filter("systemDefaults is not null"), F.col("_refId"), none, "systemDefaults.")).unionByName(row(each, F.col("_refId"), F.col("s._refId"), "s."))
    if intergreen:
        i = scan(spark, intergreen, "signalSystem", "_refId string, endingSignalGroup array<struct<_refId:string,beginningSignalGroup:array<struct<_refId:string,_timeSeconds:int>>>>")
        e = i.select(F.col("_refId").alias("system_id"), F.explode("endingSignalGroup").alias("e")).select("system_id", F.col("e._refId").alias("ending"), F.explode("e.beginningSignalGroup").alias("b"))
        out["intergreen"] = e.select("system_id", "ending", F.col("b._refId").alias("beginning"), F.col("b._timeSeconds").alias("sec"))
    return out


#: Parameters of the signals module of a config.
SIGNAL_PARAMETERS = {"systems": "signalSystemsPath", "groups": "signalGroupsPath", "control": "signalControlPath", "amber": "signalAmberTimesPath", "intergreen": "signalIntergreenTimesPath", "handler": "handler", "offset": "offset"}


def signal_config(rows: DataFrame) -> DataFrame:
    """One row: the parameters of the signals module of a config by our names, null if not set."""
    own = rows.filter("module = 'signals' and set_idx = -1")
    return own.agg(*(F.max_by(F.when(F.col("name") == p, F.col("value")), F.when(F.col("name") == p, F.lit(1))).alias(k) for k, p in SIGNAL_PARAMETERS.items()))


def with_signal_config(rows: DataFrame, **values: str | None) -> DataFrame:
    """A config with parameters of the signals module set, or removed if None."""
    named = {SIGNAL_PARAMETERS[k]: v for k, v in values.items()}
    kept = rows.filter(~((F.col("module") == "signals") & (F.col("set_idx") == -1) & F.col("name").isin(*named)))
    new = [("signals", -1, None, k, v) for k, v in named.items() if v is not None]
    return kept.unionByName(rows.sparkSession.createDataFrame(new, "module string, set_idx int, set_type string, name string, value string"))


#: Config module and parameter that name each input file.
INPUT_FILES = {"network": ("network", "inputNetworkFile"), "population": ("plans", "inputPlansFile"), "schedule": ("transit", "transitScheduleFile"), "vehicles": ("transit", "vehiclesFile"), "facilities": ("facilities", "inputFacilitiesFile"), "households": ("households", "inputFile"), "lanes": ("network", "laneDefinitionsFile")}


def scenario(spark: SparkSession, config_path: str) -> dict[str, DataFrame]:
    """All tables of the files a config names, relative to its folder; config itself too."""
    c = config(spark, config_path)
    named = {(r["module"], r["name"]): r["value"] for r in c.filter(F.col("name").isin(*{n for _, n in INPUT_FILES.values()})).collect()}  # a few parameters
    folder, out = config_path.rsplit("/", 1)[0], {"config": c}
    readers = {"network": network, "population": population, "schedule": schedule, "vehicles": vehicles, "facilities": facilities, "households": households, "lanes": lambda s, p: {"lanes": lanes(s, p)}}
    for kind, key in INPUT_FILES.items():
        if (value := named.get(key)) and value != "null":
            out |= readers[kind](spark, value if "://" in value or value.startswith("/") else f"{folder}/{value}")
    return out

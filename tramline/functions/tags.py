"""Road-map tags to modes, directions, speeds and lanes, as Column expressions over map<string,string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers of access tags.
FORBIDDEN = ("no", "never")
RESTRICTED = ("private", "destination", "customers", "delivery")
ALLOWED = ("yes", "designated", "permissive", "permitted")

# Modes that public transport may use.
TRANSIT_MODES = ("bus", "tram", "rail", "light_rail", "subway", "metro", "trolleybus", "cable_car", "aerial_lift", "funicular", "gondola", "monorail", "ferry", "taxi", "pt")

# What an exclusion names, in our modes.
EXCLUSIONS = {"motorcar": ("car",), "car": ("car",), "motor_vehicle": ("car", "bus", "pt"), "vehicle": ("car", "bus", "pt"), "psv": ("bus", "pt"), "bus": ("bus", "pt")}

# Timetable route types and the seats and standing places of their vehicles.
ROUTE_TYPES = {0: "tram", 1: "subway", 2: "rail", 3: "pt", 4: "ferry", 5: "cable_car", 6: "aerial_lift", 7: "funicular", 11: "trolleybus", 12: "pt"}
SEATS = {"bus": 30, "tram": 60, "light_rail": 60, "subway": 60, "rail": 300, "ferry": 200, "trolleybus": 30, "funicular": 40, "monorail": 60}
STANDING = {"bus": 45, "tram": 90, "light_rail": 90, "subway": 90, "rail": 120, "ferry": 100, "trolleybus": 45, "funicular": 40, "monorail": 60}
DEFAULT_SEATS, DEFAULT_STANDING = 30, 45

WALK_KPH, MILE_KM = 5.0, 1.609344


def _states(tags: Column):
    """key -> 'forbidden', 'restricted', 'allowed' or null; each Column is built once."""
    made: dict[str, Column] = {}

    def of(key: str) -> Column:
        if key not in made:
            v = tags[key]
            made[key] = F.when(v.isin(*FORBIDDEN), "forbidden").when(v.isin(*RESTRICTED), "restricted").when(v.isin(*ALLOWED), "allowed")
        return made[key]

    return of


def _forbidden(state, keys: list[str]) -> Column:
    """Is the first known answer of the keys that it's forbidden?"""
    return F.coalesce(*map(state, keys), F.lit("")) == "forbidden"


def access_keys(mode: str) -> list[str]:
    """Tag keys that decide on a mode, strongest first."""
    wide = ["motor_vehicle", "vehicle"] if mode in ("bus", "pt", "car") else []
    return [mode, *(["psv"] if mode in ("bus", "pt") else []), *wide, "access"]


def _modes_where(known: tuple[str, ...], condition) -> Column:
    """The known modes for which condition(mode) holds."""
    return F.array_compact(F.array(*(F.when(condition(m), F.lit(m)) for m in known)))


def base_modes(tags: Column, modes: Column, known: tuple[str, ...]) -> Column:
    """Modes the access tags leave; under access=no only those allowed by their own tag (or psv)."""
    state = _states(tags)
    allowed = lambda k: F.coalesce(state(k), F.lit("")) == "allowed"
    explicit = _modes_where(known, lambda m: allowed(m) | allowed("psv") if m in ("bus", "pt") else allowed(m))
    shut = _modes_where(known, lambda m: _forbidden(state, access_keys(m)))
    closed = F.coalesce(state("access"), F.lit("")) == "forbidden"
    return F.when(closed, F.array_intersect(modes, explicit)).otherwise(F.array_except(modes, shut))


def direction_modes(tags: Column, modes: Column, direction: str, known: tuple[str, ...]) -> Column:
    """Modes that <key>:forward or <key>:backward doesn't forbid."""
    state = _states(tags)
    return F.array_except(modes, _modes_where(known, lambda m: _forbidden(state, [f"{k}:{direction}" for k in access_keys(m)])))


def oneway(tags: Column, default: Column) -> Column:
    """'forward', 'reverse' or 'both'."""
    v = tags["oneway"]
    implied = F.coalesce(tags["junction"] == "roundabout", F.lit(False)) | F.coalesce(tags["highway"] == "motorway", F.lit(False)) | F.coalesce(default, F.lit(False))
    return F.when(v.isin("yes", "true", "1"), "forward").when(v.isin("-1", "reverse"), "reverse").when(v.isin("no", "false", "0", "alternating", "reversible"), "both").when(implied, "forward").otherwise("both")


def dynamic_oneway(tags: Column) -> Column:
    return F.coalesce(tags["oneway"].isin("alternating", "reversible"), F.lit(False))


def travel_modes(tags: Column, modes: Column, default_oneway: Column, known: tuple[str, ...]) -> Column:
    """Struct (forward, backward): sorted modes of each direction."""
    base = base_modes(tags, modes, known)
    way = oneway(tags, default_oneway)
    none = F.array().cast("array<string>")
    side = lambda direction, closed: F.when(way == closed, none).otherwise(F.array_sort(direction_modes(tags, base, direction, known)))
    return F.struct(side("forward", "reverse").alias("forward"), side("backward", "forward").alias("backward"))


def candidate_modes(modes: Column, add_bus: bool = True) -> Column:
    """Rule modes, with bus on car roads if asked for."""
    return F.when(F.array_contains(modes, "car"), F.array_sort(F.array_union(modes, F.array(F.lit("bus"))))).otherwise(modes) if add_bus else modes


def excluded_modes(value: Column) -> Column:
    """Our modes of one value of an except tag."""
    out = F.array(value)
    for k, modes in EXCLUSIONS.items():
        out = F.when(value == k, F.array(*map(F.lit, modes))).otherwise(out)
    return out


def mode_compatible(allowed: Column, mode: Column) -> Column:
    """No modes: anything goes. pt goes with any transit mode, either way."""
    transit = F.array(*map(F.lit, TRANSIT_MODES))
    return (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.array_contains(allowed, mode) | ((mode == "pt") & F.arrays_overlap(allowed, transit)) | (F.array_contains(allowed, "pt") & mode.isin(*TRANSIT_MODES))


def speed(tags: Column, direction: str, rule_speed: Column) -> Column:
    """Metres a second of maxspeed:<direction>, else maxspeed, else the rule's."""
    blank = lambda v: F.when(F.trim(v) != "", v)
    v = F.trim(F.coalesce(blank(tags[f"maxspeed:{direction}"]), blank(tags["maxspeed"])))
    number = lambda suffix: F.trim(F.substring(v, F.lit(1), F.length(v) - len(suffix))).try_cast("double")
    plain = v.try_cast("double")
    kph = F.when(v == "walk", F.lit(WALK_KPH)).when(v.endswith(" mph"), number(" mph") * MILE_KM).when(v.endswith("km/h"), number("km/h")).when((plain > 0) & (plain <= 300), plain)
    return F.coalesce(F.when(v != "none", kph / 3.6), rule_speed)


def lane_number(value: Column) -> Column:
    """A whole number of lanes, at least 1, else null."""
    d = F.trim(value).try_cast("double")
    return F.when((d >= 1) & (d < float("inf")) & (F.abs(d - F.rint(d)) <= 1e-9), d)


def lane_count(tags: Column, forward: bool, one_way: Column, default: Column) -> Column:
    """Struct (lanes, confidence, undetermined_total, both_ways, issues) of a direction.

    confidence: present, even_split, undetermined_split or absent.
    """
    keys = ("lanes", "lanes:forward", "lanes:backward", "lanes:both_ways")
    total, ahead, back, both = (lane_number(tags[k]) for k in keys)
    own, other = (ahead, back) if forward else (back, ahead)
    shared = F.coalesce(both, F.lit(0.0))
    malformed = [F.when(tags[k].isNotNull() & lane_number(tags[k]).isNull(), F.lit("malformed-lane-count")) for k in keys]
    known = F.coalesce(ahead, back)
    consistent = F.when(ahead.isNotNull() & back.isNotNull(), F.abs(ahead + back + shared - total) < 1e-9).when(known.isNull(), True).otherwise((known + shared <= total) & (total - known - shared >= 1.0))
    agree = total.isNull() | (F.abs(own + shared - total) < 1e-9)
    rest = total - shared
    even = (rest >= 1.0) & (F.abs(rest / 2 - F.rint(rest / 2)) < 1e-9)
    split = ~F.coalesce(one_way, F.lit(False)) & total.isNotNull() & (~consistent | (own.isNull() & other.isNull()))
    whole = lambda c: F.floor(c + 0.5).cast("int")  # noqa: E731  halves go up
    single = F.when(own.isNotNull(), F.when(agree, own).otherwise(total)).otherwise(total)
    two_way = F.when(total.isNull(), own).when(own.isNull(), total - other - shared).otherwise(own)
    lanes = F.when(one_way, whole(F.coalesce(single, default))).when(split, F.when(even, whole(rest / 2)).otherwise(F.greatest(F.lit(1), whole(rest / 2)))).otherwise(whole(F.coalesce(two_way, default)))
    confidence = F.when(one_way, F.when(single.isNull(), "absent").otherwise("present")).when(split, F.when(even, "even_split").otherwise("undetermined_split")).otherwise(F.when(two_way.isNull(), "absent").otherwise("present"))
    uneven = split & ~even
    issues = F.array_compact(F.array(*malformed, F.when((one_way & own.isNotNull() & ~agree) | (split & ~consistent), F.lit("inconsistent-lane-tags")), F.when(uneven, F.lit("undetermined-lane-split"))))
    return F.struct(lanes.alias("lanes"), confidence.alias("confidence"), F.when(uneven, rest).alias("undetermined_total"), both.alias("both_ways"), issues.alias("issues"))


# Turn indications of a lane.
TURNS = ("left", "slight_left", "sharp_left", "through", "right", "slight_right", "sharp_right", "reverse")


def turn_lane_cells(value: Column) -> Column:
    """Cells (raw, turns, merge, empty, none, unsupported) of a turn:lanes value, left to right; blank has none."""
    def cell(raw: Column) -> Column:
        tokens = F.transform(F.split(raw, ";"), lambda t: F.trim(t))
        empty = raw == ""
        keep = lambda *words: F.filter(tokens, lambda t: t.isin(*words) & ~empty)
        merges = keep("merge_to_left", "merge_to_right")
        return F.struct(
            raw.alias("raw"), keep(*TURNS).alias("turns"), F.when(F.size(merges) > 0, F.replace(F.element_at(merges, -1), F.lit("merge_to_"), F.lit(""))).alias("merge"),
            empty.alias("empty"), (F.size(keep("none")) > 0).alias("none"), F.filter(tokens, lambda t: ~t.isin(*TURNS, "merge_to_left", "merge_to_right", "none") & ~empty).alias("unsupported"),
        )

    cells = F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), r"\|", -1), lambda c: cell(F.trim(c)))
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.slice(cells, F.lit(1), F.lit(0))).otherwise(cells)


def dedicated_lanes(tags: Column, kind: str, direction: str) -> Column:
    """The number in <kind>:lanes:<direction>, else <kind>:lanes, or how many of its cells are designated or yes."""
    v = F.coalesce(*(F.when(F.trim(tags[k]) != "", tags[k]) for k in (f"{kind}:lanes:{direction}", f"{kind}:lanes")))
    cells = F.size(F.filter(F.split(v, r"\|"), lambda c: F.trim(c).isin("designated", "yes"))).cast("double")
    return F.coalesce(F.trim(v).try_cast("double"), cells, F.lit(0.0))


def lane_signature(tags: Column, direction: str) -> Column:
    """Text equal for two ways exactly if their lane tags of a direction are equal."""
    keys = [f"{k}:{direction}" for k in ("lanes", "turn:lanes", "bus:lanes", "psv:lanes")] + ["turn:lanes", "bus:lanes", "psv:lanes"]
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{k}="), tags[k], F.lit(";")), F.lit("")) for k in keys))


def is_signalized(tags: Column) -> Column:
    return F.coalesce(tags["highway"] == "traffic_signals", F.lit(False)) | F.coalesce(~tags["traffic_signals"].isin("no", "none", "0"), F.lit(False))


def route_mode(route_type: Column) -> Column:
    """Mode of a timetable route type; unknown types are pt."""
    out = F.lit("pt")
    for k, v in ROUTE_TYPES.items():
        out = F.when(route_type == k, v).otherwise(out)
    return out


def vehicle_places(mode: Column) -> Column:
    """Struct (seats, standing) of the vehicle type of a mode."""
    seats, standing = F.lit(DEFAULT_SEATS), F.lit(DEFAULT_STANDING)
    for m in SEATS:
        seats, standing = F.when(mode == m, SEATS[m]).otherwise(seats), F.when(mode == m, STANDING[m]).otherwise(standing)
    return F.struct(seats.alias("seats"), standing.alias("standing"))


def typed_value(cls: Column, text: Column) -> Column:
    """Struct (text, number, flag) of an attribute with a Java class hint; what doesn't parse stays text."""
    numeric = cls.rlike(r"(Double|Integer|Long)$")
    return F.struct(text.alias("text"), F.when(numeric, F.trim(text).try_cast("double")).alias("number"), F.when(cls.endswith("Boolean"), F.lower(F.trim(text)) == "true").alias("flag"))

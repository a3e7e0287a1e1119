"""Identifier and list codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x00"  # never part of an id


def escape(part: Column, delimiter: str) -> Column:
    """Double every delimiter."""
    return F.replace(part, F.lit(delimiter), F.lit(delimiter * 2))


def compose(delimiter: str, *parts: Column) -> Column:
    """Escaped parts joined by the delimiter; a null or blank part raises."""
    checked = [F.when(F.coalesce(F.trim(p), F.lit("")) == "", F.raise_error(F.lit("id part must not be blank"))).otherwise(escape(p, delimiter)) for p in parts]
    return F.concat_ws(delimiter, *checked)


def decompose(ident: Column, delimiter: str) -> Column:
    """The parts of a composed id; an empty part raises."""
    marked = F.replace(ident, F.lit(delimiter * 2), F.lit(MARK))
    parts = F.transform(F.split(marked, f"\\Q{delimiter}\\E", -1), lambda p: F.replace(p, F.lit(MARK), F.lit(delimiter)))
    return F.when(F.exists(parts, lambda p: p == ""), F.raise_error(F.concat(F.lit("id contains a blank part: "), ident)).cast("array<string>")).otherwise(parts)


def encode_list(values: Column) -> Column:
    """Comma-joined, with comma and backslash escaped by a backslash."""
    return F.array_join(F.transform(values, lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"([,\\])", r"\\$1")), ",")


def decode_list(value: Column) -> Column:
    """Inverse of encode_list; items are trimmed and blank ones dropped."""
    items = F.regexp_extract_all(value, F.lit(r"((?:[^,\\]|\\.)+)"), F.lit(1))
    plain = F.transform(items, lambda v: F.trim(F.regexp_replace(v, r"\\(.)", "$1")))
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(plain, lambda v: v != ""))


def sanitize_feed_id(raw: Column) -> Column:
    """Letters, digits, _ and - only; runs of _ joined, ends trimmed; 'feed' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9_-]", "_"), "_+", "_"), r"(^[_-]+|[_-]+$)", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("feed")).otherwise(clean)


def feed_id_of_path(path: Column) -> Column:
    return sanitize_feed_id(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(zip|gtfs)$", ""))


def unique_feed_ids(names: list[str]) -> list[str]:
    """Sanitized names in order; a repeated one gets -2, -3, ... A feed list is a few names."""
    import re

    used: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"(^[_-]+|[_-]+$)", "", re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_-]", "_", name or ""))) or "feed"
        ident = next(c for c in (base if n == 1 else f"{base}-{n}" for n in range(1, len(names) + 2)) if c not in used)
        used.add(ident)
        out.append(ident)
    return out


def way_link_id(way: Column, index: Column, forward: Column) -> Column:
    return F.concat(F.lit("osm_way_"), way, F.lit("_"), index.cast("string"), F.when(forward, "_f").otherwise("_r"))


def node_id(osm_node: Column) -> Column:
    return F.concat(F.lit("osm_node_"), osm_node)


def contracted_link_id(way: Column, forward: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("sim_"), way, F.lit("_"), F.when(forward, "f").otherwise("r"), F.lit("_"), first, F.lit("_"), last)


def chain_digest(nodes: Column) -> Column:
    """SHA-256 of the node ids, each ended by a NUL."""
    return F.sha2(F.array_join(F.transform(nodes, lambda n: F.concat(n, F.lit(MARK))), "").cast("binary"), 256)


def child_stop_id(stop: Column, link: Column) -> Column:
    """The stop's id with dots doubled, then .link: and the link's id."""
    return F.concat(F.replace(stop, F.lit("."), F.lit("..")), F.lit(".link:"), link)


def scoped_lane_key(link: Column, lane: Column) -> Column:
    return F.concat(link, F.lit(MARK), lane)


def disallowed_to_json(by_mode: Column) -> Column:
    """map<mode, array<array<link>>> as JSON with sorted modes."""
    entries = F.array_sort(F.map_entries(by_mode))
    body = F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(e["value"])))
    return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))


def disallowed_from_json(text: Column) -> Column:
    """Inverse of disallowed_to_json; a value of another shape is null."""
    return F.from_json(text, "map<string,array<array<string>>>", {"mode": "PERMISSIVE"})

"""Lane definition files of several dialects, and networks with lanes inside.

The dialect is found from the structure: leadsTo elements (v2.0), direct toLink elements (v1.1), or
assignments with reference attributes (model 1.0). A mixture is invalid, an empty file without a hint
unsupported: nothing is guessed. `read` gives state (present, invalid, unsupported), dialect, lanes and
issues.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lanes as lane_graph
from ..operators import validate
from ..operators.staging import stage
from . import scenario_xml

HEAD_BYTES = 64 << 10
V2, V1, MODEL = "v2.0", "v1.1", "model-1.0"


def head(path: str) -> str:
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(at, compression="gzip" if path.endswith(".gz") else None) as f:
        return f.read(HEAD_BYTES).decode("utf-8", "replace")


def root_of(path: str) -> tuple[str, str]:
    """(local name, start tag) of the root element, past declaration, comments and DOCTYPE."""
    text = re.sub(r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", head(path))
    m = re.search(r"<([\w:.-]+)[^>]*>", text)
    return (m[1].rpartition(":")[2], m[0]) if m else ("", "")


def hint(tag: str) -> str | None:
    """Dialect that the root names by version or schema location."""
    m = re.search(r"laneDefinitions_v(\d)\.(\d)|\bversion\s*=\s*\"(\d)\.(\d)\"", tag)
    return {"2.0": V2, "1.1": V1}.get(".".join(x for x in m.groups() if x)) if m else None


def cycle_issues(lanes: DataFrame) -> DataFrame:
    return validate.issue(lane_graph.cycles_of(lanes), validate.ERROR, "lanes", "lanes.cycle", F.concat_ws("/", "link_id", "lane_id"))


def _model(spark: SparkSession, path: str) -> DataFrame:
    lane = "_id string, _toLinkIds string, _toLaneIds string, _capacity string, _startsAt string, _alignment string"
    a = scenario_xml.scan(spark, path, "assignment", f"_linkId string, _linkIdRef string, lane array<struct<{lane.replace(' string', ':string')}>>").withColumn("assignment", F.monotonically_increasing_id())
    x = a.select(F.coalesce("_linkId", "_linkIdRef").alias("link_id"), "assignment", F.explode("lane").alias("l")).select("link_id", "assignment", "l.*")
    csv = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    none = F.create_map().cast("map<string,struct<cls:string,val:string>>")
    return x.select("link_id", F.col("_id").alias("lane_id"), csv(F.col("_toLinkIds")).alias("to_links"), csv(F.col("_toLaneIds")).alias("to_lanes"), F.col("_capacity").alias("capacity"), F.col("_startsAt").alias("starts_at"), F.col("_alignment").alias("alignment"), none.alias("attrs"), "assignment")


def read(spark: SparkSession, path: str, links: DataFrame | None = None) -> dict:
    name, tag = root_of(path)
    hinted = hint(tag)
    rows = scenario_xml.lanes(spark, path)
    shape = scenario_xml.scan(spark, path, "lane", "_id string, _toLinkIds string, _toLaneIds string, leadsTo string, toLink array<string>")
    shapes = shape.agg(F.coalesce(F.max(F.col("leadsTo").isNotNull()), F.lit(False)), F.coalesce(F.max(F.size("toLink") > 0), F.lit(False)), F.coalesce(F.max(F.col("_toLinkIds").isNotNull() | F.col("_toLaneIds").isNotNull()), F.lit(False))).first()
    own = not scenario_xml.scan(spark, path, "lanesToLinkAssignment", "_linkIdRef string, _linkId string, lane array<string>").isEmpty()
    model = not scenario_xml.scan(spark, path, "assignment", "_linkId string, _linkIdRef string, lane array<string>").isEmpty()

    def end(state, dialect=None, code=None, lanes=None):
        lanes = rows.limit(0) if lanes is None else stage(lanes, "lane-file")  # the rules below read it several times
        issues = validate.lane_issues(lanes, links) if state == "present" else validate.issue(spark.range(1), validate.ERROR, "lanes", code, F.lit(None), name)
        if state == "present":
            issues = issues.unionByName(cycle_issues(lanes))
        if state == "present" and not issues.filter("severity = 'error'").isEmpty():
            state = "invalid"
        return {"state": state, "dialect": dialect, "lanes": lanes, "issues": issues}

    if name not in ("laneDefinitions", "lanes"):
        return end("unsupported", code="lanes.unsupported_root")
    if (shapes[2] and own) or (shapes[0] and shapes[1]) or (model and (own or hinted)):
        return end("invalid", hinted, "lanes.mixed_dialect")
    if model or name == "lanes":
        return end("present", MODEL, lanes=_model(spark, path))
    if own:
        dialect = V1 if shapes[1] else V2
        return end("invalid", hinted, "lanes.mixed_dialect") if hinted and hinted != dialect else end("present", dialect, lanes=rows)
    return end("present", hinted) if hinted else end("unsupported", code="lanes.ambiguous_dialect")


def read_bundle(spark: SparkSession, path: str) -> dict:
    """nodes, links, and the lanes inside a network file; issues of each kept apart. Two lane blocks compete."""
    net = scenario_xml.network(spark, path)
    blocks = scenario_xml.scan(spark, path, "laneDefinitions", "lanesToLinkAssignment array<string>").count()
    out = net | {"network_issues": validate.network_issues(net["nodes"], net["links"])}
    lanes = scenario_xml.lanes(spark, path)
    if blocks > 1:
        return out | {"lanes": lanes.limit(0), "lane_issues": validate.issue(spark.range(1), validate.ERROR, "lanes", "lanes.competing_blocks", F.lit(None))}
    return out | {"lanes": lanes, "lane_issues": validate.lane_issues(lanes, net["links"]).unionByName(cycle_issues(lanes))}

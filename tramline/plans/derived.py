"""Transport-shaped relations derived from the driver's tables, in SQL that both engines run alike.

Templates name tables in braces; integer arithmetic throughout, so results can be compared exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "nation")

SQL: dict[str, str] = {
    "d_nodes": "SELECT c_custkey AS node_id, (c_custkey * 7919 % 1009) * 10 AS x, (c_custkey * 6121 % 1013) * 10 AS y FROM {customer}",
    "d_size": "SELECT COUNT(*) AS n FROM {customer}",
    # every 50th link is a loop, every 97th has no length, every 101st ends nowhere
    "d_links": """SELECT o_orderkey AS link_id, o_custkey AS from_id,
        CASE WHEN o_orderkey % 50 = 0 THEN o_custkey WHEN o_orderkey % 101 = 0 THEN -1 ELSE (o_orderkey * 31 + 17) % n END AS to_id,
        CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey % 400 + 1 END AS length,
        CASE WHEN o_orderkey % 89 = 0 THEN -1 ELSE 600 END AS capacity, CASE WHEN o_orderkey % 83 = 0 THEN 0 ELSE 14 END AS freespeed,
        CAST(o_orderkey % 3 AS INT) AS lanes, o_orderpriority AS priority FROM {orders} CROSS JOIN {d_size}""",
    "d_modes": "SELECT * FROM (VALUES ('1-URGENT', 'car'), ('1-URGENT', 'bus'), ('2-HIGH', 'car'), ('3-MEDIUM', 'rail'), ('3-MEDIUM', 'pt'), ('4-NOT SPECIFIED', 'bus')) AS t(priority, mode)",
    "d_routes": "SELECT n_nationkey AS route_no, CONCAT('R', CAST(n_nationkey AS STRING)) AS route_id, CAST(n_nationkey % 14 AS INT) AS route_type FROM {nation}",
    "d_trips": "SELECT CONCAT('T', CAST(o_orderkey AS STRING)) AS trip_id, CONCAT('R', CAST(o_custkey % 25 AS STRING)) AS route_id, CASE WHEN o_orderkey % 200 = 7 THEN NULL ELSE o_orderpriority END AS service_id, CAST(o_orderkey % 2 AS INT) AS direction_id, o_orderkey AS k FROM {orders}",
    "d_calendar": """SELECT * FROM (VALUES ('1-URGENT', 1, 1, 1, 1, 1, 0, 0, '20240101', '20240331'), ('2-HIGH', 0, 0, 0, 0, 0, 1, 1, '20240101', '20240630'), ('3-MEDIUM', 1, 0, 1, 0, 1, 0, 0, '20240210', '20240520'),
        ('4-NOT SPECIFIED', 1, 1, 1, 1, 1, 1, 1, '20240301', '20240201'), ('5-LOW', 1, 1, 1, 1, 1, 1, 1, '20240215', '20240301'), ('1-URGENT', 0, 0, 0, 0, 0, 1, 0, '20240401', '20240420')) AS t(service_id, monday, tuesday, wednesday, thursday, friday, saturday, sunday, start_date, end_date)""",
    "d_exceptions": "SELECT o_orderpriority AS service_id, CONCAT('20240', CAST(o_orderkey % 6 + 1 AS STRING), CAST(o_orderkey % 18 + 10 AS STRING)) AS date, CAST(o_orderkey % 2 + 1 AS INT) AS exception_type, o_orderkey AS seq_no FROM {orders} WHERE o_orderkey % 97 = 0",
    "d_frequencies": "SELECT CONCAT('T', CAST(o_orderkey AS STRING)) AS trip_id, CAST(21600 + o_orderkey % 7 * 600 AS INT) AS start_time, CAST(25200 + o_orderkey % 11 * 900 AS INT) AS end_time, CAST(o_orderkey % 5 * 300 AS INT) AS headway_secs, CAST(o_orderkey % 2 AS INT) AS exact_times FROM {orders} WHERE o_orderkey % 50 < 2",
    "d_more_frequencies": "SELECT * FROM {d_frequencies} UNION ALL SELECT trip_id, start_time + 1800, end_time + 600, 600, 1 FROM {d_frequencies} WHERE start_time % 1200 = 0",
    "d_calls": """SELECT CONCAT('T', CAST(l_orderkey AS STRING)) AS trip_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS stop_sequence,
        CONCAT('S', CAST(l_suppkey AS STRING)) AS stop_id, l_orderkey AS k, l_returnflag AS flag, CAST(l_quantity AS INT) AS q FROM {lineitem}""",
    # 600 seconds a stop; a third of the calls are no timepoints, some timepoints lack a time
    "d_stop_times": """SELECT trip_id, stop_id, stop_sequence, CAST(stop_sequence AS BIGINT) AS seq_no, CASE WHEN q = 13 AND stop_sequence > 1 THEN NULL ELSE CAST(20000 + k % 3600 + stop_sequence * 600 AS INT) END AS arrival,
        CASE WHEN q = 17 AND stop_sequence > 1 THEN NULL ELSE CAST(20000 + k % 3600 + stop_sequence * 600 + q % 4 * 30 AS INT) END AS departure, CASE WHEN flag = 'A' THEN 0 ELSE 1 END AS timepoint FROM {d_calls}""",
    "d_events": "SELECT event_id, user_id AS person, event_type AS type, (event_id * 37) % 86400 AS time, user_id % 40 AS link FROM {events}",
    "d_elements": "SELECT conv_id AS person_id, CAST(0 AS INT) AS plan_idx, turn AS pos, CASE WHEN role = 'user' OR conv_id % 5 = 1 THEN 'leg' ELSE 'activity' END AS kind, CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE 'car' END AS mode, CASE WHEN conv_id % 7 = 0 THEN turn * 100 END AS start_time, CASE WHEN conv_id % 7 = 0 THEN 150 END AS end_time, CASE WHEN conv_id % 11 = 0 THEN -5 END AS max_dur, CONCAT('f', CAST(conv_id AS STRING)) AS facility_id, (conv_id * 13 + turn) % 400 * 50 AS link_id FROM {conversations}",
    "d_stops": "SELECT s_suppkey AS point_id, (s_suppkey * 7919 % 1009) * 10 + 3 AS x, (s_suppkey * 6121 % 1013) * 10 + 4 AS y, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'bus' WHEN 1 THEN 'rail' ELSE 'pt' END AS mode FROM {supplier}",
    "d_ways": "SELECT l_orderkey AS way_id, l_linenumber AS pos0, l_partkey, l_suppkey % n AS node_id, l_extendedprice, l_shipdate, l_quantity, l_tax, l_discount FROM {lineitem} CROSS JOIN {d_size}",
    "d_refs": "SELECT way_id, CAST(ROW_NUMBER() OVER (PARTITION BY way_id ORDER BY pos0, l_partkey, node_id, l_extendedprice, l_shipdate, l_quantity, l_tax, l_discount) - 1 AS INT) AS pos, node_id FROM {d_ways}",
    "d_tags": """SELECT o_orderkey AS way_id, CASE o_orderkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'busway' WHEN 4 THEN 'footway' WHEN 5 THEN 'service' END AS highway,
        CASE o_orderkey % 5 WHEN 0 THEN 'rail' WHEN 1 THEN 'tram' END AS railway, CASE o_orderkey % 11 WHEN 0 THEN 'ferry' END AS route,
        CASE o_orderkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'private' WHEN 2 THEN 'yes' END AS access, CASE o_orderkey % 17 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' WHEN 2 THEN 'never' END AS bus, CASE o_orderkey % 19 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS psv,
        CASE o_orderkey % 23 WHEN 0 THEN 'no' WHEN 1 THEN 'destination' END AS motor_vehicle, CASE o_orderkey % 8 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' WHEN 3 THEN 'reversible' END AS oneway, CASE WHEN o_orderkey % 29 = 0 THEN 'roundabout' END AS junction,
        CASE o_orderkey % 10 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN 'none' WHEN 3 THEN 'walk' WHEN 4 THEN '80 km/h' WHEN 5 THEN 'fast' WHEN 6 THEN '400' WHEN 7 THEN ' 60 ' END AS maxspeed,
        CASE o_orderkey % 6 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN 'x' WHEN 3 THEN '4' END AS lanes, CASE o_orderkey % 31 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS lanes_forward, CASE o_orderkey % 37 WHEN 0 THEN '1' WHEN 1 THEN '3' END AS lanes_backward, CASE WHEN o_orderkey % 41 = 0 THEN '1' END AS lanes_both,
        CASE o_orderkey % 9 WHEN 0 THEN 'left|through;right' WHEN 1 THEN 'none||merge_to_left' WHEN 2 THEN 'Through|slight_Left;foo' END AS turn_lanes FROM {orders}""",
}


def _names(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def relation(spark: SparkSession, sf_dir: str, name: str, made: dict | None = None) -> DataFrame:
    """A derived relation (or a driver's table) as a DataFrame."""
    made = {} if made is None else made
    if name not in made:
        if name not in SQL:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            made[name] = spark.sql(SQL[name], **{n: relation(spark, sf_dir, n, made) for n in _names(SQL[name])})
    return made[name]


def ctes(names: list[str]) -> str:
    """WITH clause that defines the named relations and what they need, for DuckDB."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in SQL and n not in order:
            for m in _names(SQL[n]):
                need(m)
            order.append(n)

    for n in names:
        need(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).replace("AS STRING)", "AS VARCHAR)")
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({plain(SQL[n])})" for n in order)


def oracle(body: str) -> str:
    """body with {relation} names resolved and their definitions in front; a body may begin with further CTEs after '+'."""
    names = [n for n in _names(body) if n in SQL]
    sql = re.sub(r"\{(\w+)\}", r"\1", body).strip()
    head = ctes(names) if names else ""
    if sql.startswith("+"):
        return (head + ", " if head else "WITH RECURSIVE ") + sql[1:].strip()
    return f"{head} {sql}".strip()

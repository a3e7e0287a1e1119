"""Facilities of a road map: shops, offices and buildings as places of activities.

tags: map column. A node or way counts if it has a business key that isn't a transit amenity, or is a
building of a known type; the first business key in alphabetical order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centroid, household_capacity, point, spherical_area

# Keys and values that make a facility, and the activity of each.
BUSINESS_KEYS = ("amenity", "leisure", "office", "shop", "tourism")
EXCLUDED_AMENITIES = ("bus_station", "bus_stop", "tram_station", "railway_station", "ferry_terminal", "taxi")
HOMES = ("house", "detached", "semidetached_house", "terrace", "apartments", "residential")
BUSINESSES = ("commercial", "retail", "industrial", "office")
SCHOOLS = ("school", "university", "college")
CLINICS = ("hospital", "clinic", "healthcare")
VALUE_ACTIVITY = {
    "leisure": ("restaurant", "cafe", "bar", "fast_food", "pub", "attraction"),
    "education": ("school", "university", "college", "kindergarten"),
    "health": ("hospital", "clinic", "pharmacy", "doctors", "dentist"),
    "work": ("bank",),
}
KEY_ACTIVITY = {"shop": "work", "office": "work", "tourism": "leisure", "leisure": "leisure", "amenity": "work"}


def business_key(tags: Column) -> Column:
    """The first business key there is, passing over excluded amenities; null if none."""
    have = lambda k: tags[k].isNotNull() & (~tags[k].isin(*EXCLUDED_AMENITIES) if k == "amenity" else F.lit(True))
    return F.coalesce(*(F.when(have(k), F.lit(k)) for k in BUSINESS_KEYS))


def classify(tags: Column) -> Column:
    """Struct (key, value, home) of a facility, null for anything else."""
    key, building = business_key(tags), tags["building"]
    shop = F.struct(key.alias("key"), tags[key].alias("value"), F.lit(False).alias("home"))
    house = F.struct(F.lit("building").alias("key"), building.alias("value"), building.isin(*HOMES).alias("home"))
    return F.when(key.isNotNull(), shop).when(building.isin(*HOMES, *BUSINESSES, *SCHOOLS, *CLINICS), house)


def activity(key: Column, value: Column) -> Column:
    """Activity at a facility: by building type, else by value, else by key, else work."""
    of_building = F.when(value.isin(*HOMES), "home").when(value.isin(*SCHOOLS), "education").when(value.isin(*CLINICS), "health").otherwise("work")
    other = F.coalesce(*(F.when(value.isin(*vs), F.lit(a)) for a, vs in VALUE_ACTIVITY.items()), *(F.when(key == k, F.lit(a)) for k, a in KEY_ACTIVITY.items()), F.lit("work"))
    return F.when(key == "building", of_building).otherwise(other)


def from_map(nodes: DataFrame, ways: DataFrame, project) -> dict[str, DataFrame]:
    """facilities and facility_activities of a map (nodes, ways with lon, lat, tags, refs).

    A way is at the centroid of the nodes it has; homes among ways hold people by floor space.
    """
    tags = F.col("tags")
    of_nodes = nodes.withColumn("f", classify(tags)).filter("f is not null").select(F.concat(F.lit("n"), "node_id").alias("facility_id"), "lon", "lat", "tags", "f", F.lit(0.0).alias("area"))
    w = ways.withColumn("f", classify(tags)).filter("f is not null")
    closed = (F.size("refs") >= 2) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1))
    w = w.withColumn("ring_refs", F.when(closed, F.slice("refs", F.lit(1), F.size("refs") - 1)).otherwise(F.col("refs")))
    corner = w.select("way_id", F.posexplode("ring_refs").alias("pos", "node_id")).join(nodes.select("node_id", "lon", "lat"), "node_id")
    rings = corner.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("ring"))
    ring = F.transform("ring", lambda p: point(p["lon"], p["lat"]))
    w = w.join(rings, "way_id").withColumn("ring", ring).withColumn("c", centroid(F.col("ring")))
    area = F.when(F.col("f.home") & (F.size("ring") >= 3), spherical_area(F.col("ring"))).otherwise(0.0)
    of_ways = w.select(F.concat(F.lit("w"), "way_id").alias("facility_id"), F.col("c.x").alias("lon"), F.col("c.y").alias("lat"), "tags", "f", area.alias("area"))
    every = of_nodes.unionByName(of_ways)
    x, y = project(F.col("lon"), F.col("lat"))
    kept = F.filter(F.map_entries("tags"), lambda e: e["key"].startswith("addr:") | (e["key"] == "opening_hours"))
    bag = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], F.struct(F.lit("java.lang.String").alias("cls"), e["value"].alias("val")))))
    levels = F.coalesce(F.trim(tags["building:levels"]).try_cast("double").cast("int"), F.lit(0))
    return {
        "facilities": every.select("facility_id", x.alias("x"), y.alias("y"), F.lit(None).cast("string").alias("link_id"), tags["name"].alias("description"), bag.alias("attrs")),
        "facility_activities": every.select("facility_id", activity(F.col("f.key"), F.col("f.value")).alias("type"), F.when(F.col("f.home"), household_capacity(F.col("area"), levels).cast("double")).alias("capacity")),
    }

"""Name similarity of stops and streets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 if equal after normalizing, 0.75 if one holds the other, else shared tokens of 3 letters or more over the larger set."""
    x, y = normalize(a), normalize(b)
    tokens = lambda s: F.filter(F.array_distinct(F.split(s, " ")), lambda t: F.length(t) >= 3)
    larger = F.greatest(F.size(tokens(x)), F.size(tokens(y)))
    shared = F.size(F.array_intersect(tokens(x), tokens(y)))
    overlap = F.when(F.least(F.size(tokens(x)), F.size(tokens(y))) > 0, shared / larger).otherwise(0.0)
    none = (F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == "")
    return F.when(none, 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.75).otherwise(overlap)


def best_similarity(name: Column, names: Column) -> Column:
    """Largest similarity of name with any of names."""
    return F.coalesce(F.array_max(F.transform(names, lambda n: similarity(name, n))), F.lit(0.0))

"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame operations only.

* Targets: sources weigh 3, 1, 2, repeating, by code point with null last, and share `share` of all
  words. A target stops at `most` times its source's size; the excess is reshared by weight until none is
  above. That fixed point is a water level: sources ordered by cap / weight are capped up to a point, the
  level is the largest of the levels with 0, 1, 2, ... of them capped.
* Schedule: slot k of the mixture draws the golden-ratio point frac((k + 1/2) phi); the cumulative targets
  map it to a source. The n-th slot of a source takes the n-th of its blocks.
* Blocks: a source's documents are shuffled by hash and laid end to end, `most` times over; its slots
  cut that stretch, up to its target, into equal blocks. So the taken words meet the target to a
  rounded word, and no document is taken more than `most` times.

Words of a text: [^\\x20\\x09-\\x0D]+. Null text: size 0, never taken. Repeated rows are rows; rows equal in id
and size follow each other in any order. Null ids and a null source are values like others. Other columns,
whatever their names, are ignored by mix and carried by mixture. An empty table gives an empty mixture.
Nothing large is gathered: within a source, ranks and running sums go through hash buckets and chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, whole_rows

WEIGHTS = (3, 1, 2)
PHI = 0.6180339887498949
CHUNK, CELLS, BUCKET_ROWS = 1 << 10, 1 << 10, 20_000
BROADCAST_SOURCES, SALT = 20_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source_no, source, source_size, target of each source of rows (source, size)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("double"))
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double"))
    before = W.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    s = s.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every)))
    return s.select("source_no", "source", "source_size", "target")


def _with_source(rows: DataFrame, sources: DataFrame, n_sources: int, on: str = "source_no") -> DataFrame:
    """rows with what sources (a row for each) has on theirs. A source is never one task: few sources go to every
    task, many are dealt over SALT parts each."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), on)
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")


def _running(df: DataFrame, keys: list[str], part: str, order: list, value: Column, name: str) -> DataFrame:
    """Exclusive running sum of value within keys, in the order of (part, order), without one task per key."""
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("_n"))
    base = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_base", base).drop("_n")
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(parts, [*keys, part]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def source_slots(targets: DataFrame, n_slots: int) -> DataFrame:
    """source_no, rank (from 0), slot: the schedule. A source with a target but no slot gets one at the end."""
    spark = targets.sparkSession
    total = F.sum("target").over(W.partitionBy())
    t = targets.filter("target > 0").withColumn("lo", F.coalesce(F.sum("target").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / total)
    t = t.withColumn("hi", F.lead("lo", 1, 1.0).over(W.orderBy("source_no")))
    cell = lambda x: F.least(F.lit(CELLS - 1), F.floor(x * CELLS)).cast("int")
    ranges = t.select("source_no", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 0.5) * PHI, F.lit(1.0)).alias("u"))
    slots = slots.withColumn("cell", cell(F.col("u"))).join(ranges, "cell").filter("u >= lo and u < hi").select("source_no", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    ranked = _running(slots, ["source_no"], "chunk", ["slot"], F.lit(1), "rank").select("source_no", "rank", "slot")
    extra = targets.filter("target > 0").join(ranked.select("source_no").distinct(), "source_no", "left_anti").select("source_no", F.lit(0).alias("rank"), (F.lit(n_slots) + F.col("source_no")).alias("slot"))
    return ranked.unionByName(extra)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 7, slot_words: int | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, schedule).

    rows: row, doc_id, source_no, size of each document; targets: see source_targets; schedule: slot,
    row, pass, from_word, n_words - the mixture in slot order, each piece of one document.
    whole: rows also hold each document itself, in doc.
    """
    rows = docs.select(*([F.struct("*").alias("doc")] if whole else []), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    targets = stage(source_targets(rows, weights, share, most), "mix-targets")
    n_rows, words, planned, n_sources = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first() + targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    slot_words = slot_words or max(1, words // max(1, n_rows))
    slots = stage(source_slots(targets, -(-int(planned) // slot_words)), "mix-slots")
    per_source = slots.groupBy("source_no").agg(F.count("*").alias("n_slots"))
    plan = targets.join(per_source, "source_no").withColumn("block", F.col("target") / F.col("n_slots"))
    # null is a source like any other: it gets a name that no source has
    name = lambda: F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("_name")
    rows = _with_source(rows.withColumn("_name", name()), targets.select("source_no", name()), n_sources, "_name").select("row", "doc_id", "source_no", "size", *(["doc"] if whole else []))
    all_rows, rows = rows, rows.drop("doc")

    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    laid = rows.filter("size > 0").withColumn("h", h).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(max(16, n_rows // BUCKET_ROWS))))
    laid = _running(laid, ["source_no"], "bucket", ["h", "doc_id", "size", "row"], F.col("size"), "start")
    laid = _with_source(laid, plan.drop("source"), n_sources).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    laid = laid.filter("start < target")
    first = F.greatest(F.lit(0), F.floor(F.col("start") / F.col("block")) - 1)
    last = F.least(F.col("n_slots") - 1, F.floor((F.col("start") + F.col("size")) / F.col("block")) + 1)
    edge = lambda r: F.round(r * F.col("block")).cast("long")
    pieces = laid.withColumn("rank", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("a", F.greatest("start", edge(F.col("rank")))).withColumn("b", F.least(F.col("start") + F.col("size"), edge(F.col("rank") + 1))).filter("b > a")
    schedule = pieces.join(slots, ["source_no", "rank"]).select("slot", "row", "pass", (F.col("a") - F.col("start")).alias("from_word"), (F.col("b") - F.col("a")).alias("n_words"))
    return all_rows, targets, schedule


def taken(rows: DataFrame, targets: DataFrame, schedule: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row."""
    per_row = schedule.groupBy("row").agg(F.sum("n_words").alias("taken"))
    out = _with_source(rows, targets.drop("source"), targets.count()).join(per_row, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@whole_rows
def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, all columns of docs: a row for each pass in which words of it are taken.

    A document of which a pass takes a part has those words, joined by one space; n_chars follows.
    """
    rows, _, schedule = mix(docs, whole=True, **how)
    part = schedule.groupBy("row", "pass").agg(F.min("from_word").alias("first"), F.sum("n_words").alias("n"))
    out = rows.join(part, "row")
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ")
    text = F.when(F.col("n") == F.col("size"), F.col("doc.text")).otherwise(cut)
    kinds = dict(docs.dtypes)
    new = {"text": text, "n_chars": F.length(text).cast(kinds.get("n_chars", "long"))}
    return out.select(*(new.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))

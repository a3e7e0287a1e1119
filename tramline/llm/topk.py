"""Exact top-k search by term-at-a-time accumulation.

A dimension is a term: each block of candidates becomes postings (dimension -> positions, weights). A
query row walks its non-zero dimensions and scatters weight x weight into a dense array of the block's
scores; the block's k best leave it, and the blocks' lists are merged by rank.

Queries and candidates meet in cells (query block, candidate block), both of bounded size; queries are
not broadcast, since their number grows with the table. Each candidate is sent once per query block.

A row whose vector is null, or holds a null or non-finite component, takes no part. Vectors of other
lengths count as zero where they end. Rows with the query's own id are the query's own. Repeated
candidate rows are separate candidates; ties go to the smaller id. A null id takes no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null unless all components are finite."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def postings(rows: list) -> tuple[list, int]:
    """[(positions or None if all, weights)] by dimension."""
    width = max(map(len, rows), default=0)
    dense = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        dense[i, : len(v)] = v
    largest = int(np.abs(dense).max(initial=0))
    out = []
    for j in range(width):
        at = np.flatnonzero(dense[:, j])
        out.append((None if len(at) == len(rows) else at, dense[at, j]))
    return out, largest


def search_block(query_ids, query_rows, ids: np.ndarray, rows: list, k: int):
    """(query number, vec_id, score) of each query's k best in the block; ids ascending."""
    lists, largest = postings(rows)
    top = max((int(np.abs(q).max(initial=0)) for q in query_rows), default=0)
    kind = np.int32 if largest * top * max(1, len(lists)) < 2**31 else np.int64
    lists = [(at, w.astype(kind)) for at, w in lists]
    scores = np.zeros(len(ids), kind)
    for n, (own, q) in enumerate(zip(query_ids, query_rows, strict=True)):
        scores[:] = 0
        for (at, weights), x in zip(lists, q, strict=False):
            if x:
                if at is None:
                    scores += weights * kind(x)
                else:
                    scores[at] += weights * kind(x)
        lo, hi = np.searchsorted(ids, [own, own + 1]) if own < np.iinfo(np.int64).max else (np.searchsorted(ids, own), len(ids))
        want = k + hi - lo
        if want < len(ids):
            least = np.partition(scores, len(ids) - want)[len(ids) - want]
            over = np.flatnonzero(scores > least)
            best = np.concatenate([over, np.flatnonzero(scores == least)[: want - len(over)]])
        else:
            best = np.arange(len(ids))
        best = best[(best < lo) | (best >= hi)]
        best = best[np.lexsort((ids[best], -scores[best].astype(np.int64)))][:k]
        for i in best:
            yield n, int(ids[i]), int(scores[i])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; vectors has vec_id and embedding."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantize(F.col("embedding"), scale).alias("v")).filter("vec_id is not null and v is not null")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks = max(-(-n // candidate_block), min(shuffle_partitions(spark), -(-n // 512)), 1)
    q_blocks = max(1, -(-n_queries // query_block))
    copy = F.row_number().over(W.partitionBy("vec_id").orderBy("v"))
    queries = rows.filter(is_query).withColumn("copy", copy).withColumn("qb", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(q_blocks)).cast("int"))
    queries = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    mine = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(q) and len(c):
            q = q.sort_values(["vec_id", "copy"])
            c = c.sort_values("vec_id", kind="stable")
            own, copies = q["vec_id"].to_numpy(), q["copy"].to_numpy()
            out = [(own[i], copies[i], v, s) for i, v, s in search_block(own, list(q["v"]), c["vec_id"].to_numpy(), list(c["v"]), k)]
        return pd.DataFrame(out, columns=["query_id", "copy", "vec_id", "score"])

    found = queries.groupBy("qb", "cb").cogroup(mine.groupBy("qb", "cb")).applyInPandas(cell, "query_id long, copy int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

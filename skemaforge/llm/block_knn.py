"""Exact nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale each. Tiles of candidates times queries give approximate distances from
integer products; the triangle inequality with both vectors' quantisation errors (residual norms) bounds the true ones.
A pair survives where its lower bound isn't above the k-th smallest upper bound of its query; survivors are
recomputed in double precision on the original vectors, and each query's tiles are merged by a heap. The bounds hold for
every pair, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged


def usable(vec: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _quantise(x: np.ndarray):
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)), np.sqrt(((q * scale[:, None]) ** 2).sum(1))


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, step: int = 256):
    """(query id, vec id, distance) of the k nearest of each query within a tile, ids equal to the query's left out."""
    with np.errstate(over="ignore", invalid="ignore"):
        c8, cs, cr, cn = _quantise(c)
        kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of int8 exact in it
        ct = c8.astype(kind).T
        for lo in range(0, len(q), step):
            ids, x = qid[lo : lo + step], q[lo : lo + step]
            x8, xs, xr, xn = _quantise(x)
            dot = (x8.astype(kind) @ ct).astype(np.float64) * xs[:, None] * cs
            near = np.sqrt(np.maximum(xn[:, None] ** 2 + cn**2 - 2 * dot, 0))
            slack = xr[:, None] + cr + 1e-7 * (xn[:, None] + cn)
            own = ids[:, None] == cid
            upper = np.where(own, np.inf, near + slack)
            lower = np.where(own, np.inf, near - slack)
            worst = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(x), np.inf)
            keep = ~own & ~(lower > worst[:, None])  # not a number: keep
            for i in range(len(x)):
                at = np.flatnonzero(keep[i])
                if len(at):
                    d = np.sqrt(((c[at] - x[i]) ** 2).sum(1))
                    for j in np.lexsort((cid[at], d))[:k]:
                        yield ids[i], cid[at[j]], d[j]


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vec: str = "embedding", k: int = 10, block_rows: int = 4096, slice_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row under ``is_query`` its k nearest other rows by Euclidean distance.

    Vectors that are null, zero or hold null or non-finite components take no part; neither do null ids. Rows of one id
    count once (the smallest vector). A vector of another length than the query's is no candidate of it. With fewer
    candidates than k all are returned; ties go to the smaller id. An empty table gives an empty result. Other columns don't matter.
    Candidates are dealt into hash blocks and queries into hash slices; a tile is one block with one slice, so no task
    holds more than block_rows + slice_rows vectors (on average), and both numbers follow the row counts.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    rows = staged(rows, "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    blocks, slices = max(1, -(-n // block_rows)), max(1, -(-asked // slice_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    left = rows.select("id", "v", deal(blocks).alias("block"), every(slices).alias("slice"))
    right = rows.where("asked").select(F.col("id").alias("qid"), F.col("v").alias("qv"), deal(slices).alias("qslice"), every(blocks).alias("qblock"))

    def tiles(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(q):
            cl, ql = c["v"].map(len).to_numpy(), q["qv"].map(len).to_numpy()
            for dim in np.intersect1d(cl, ql):
                cc, qq = c[cl == dim], q[ql == dim]
                out.extend(tile(qq["qid"].to_numpy(), np.stack(qq["qv"].to_numpy()), cc["id"].to_numpy(), np.stack(cc["v"].to_numpy()), k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def merged(key, found: pd.DataFrame) -> pd.DataFrame:
        top = heapq.nsmallest(k, zip(found["score"], found["vec_id"]))
        return pd.DataFrame({"query_id": key[0], "rank": range(1, len(top) + 1), "vec_id": [v for _, v in top], "score": [s for s, _ in top]})

    found = left.groupBy("block", "slice").cogroup(right.groupBy("qblock", "qslice")).applyInPandas(tiles, "query_id long, vec_id long, score double")
    return found.groupBy("query_id").applyInPandas(merged, "query_id long, rank int, vec_id long, score double")


def op10_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH ok AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
      FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM d)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10
"""

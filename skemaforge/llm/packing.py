"""Best-fit packing of token pieces by hierarchical residual packing.

Each partition packs its own pieces best-fit (longest first) while they are tokenised, so no text is shuffled. Full and
nearly full bins are final. The underfull rest become items of a tree: groups of partitions pack them again, eight groups
into one, until one group is left. A group passes on its bins that are at most half full (best-fit leaves one at most) and
its ``receivers`` emptiest others, so what climbs the tree is bounded; every other bin is final as it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .token_ids import ROWS, task_encoder, tokenizer_path

CAPACITY = 2048
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, used long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill. Longest first, each into the bin that it leaves least room in."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            if not room[r - n]:
                free |= 1 << (r - n)
            room[r - n].append(b)
    return bins, offsets, np.array(fill, np.int64)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pack(documents: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY, receivers: int = 64, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null text is empty: its end id alone. ``special_tokens`` as in ``write_tokens``. Repeated rows are packed each. Very long texts are cut into pieces of the
    capacity. An empty table gives an empty result; other columns aren't read.
    """
    path = path or tokenizer_path()
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def local(batches):
        part = TaskContext.get().partitionId()
        who, rows = [], []
        with task_encoder(path, special_tokens) as encoder:
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    some = b.slice(lo, ROWS)
                    ids, ends = encoder.batch(some.column("text"), end)
                    raw, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), ends.tolist()
                    for doc, i, j in zip(some.column("doc_id").to_pylist(), [0, *ends], ends):
                        for k, (s, n) in enumerate(cut(j - i, capacity)):
                            who.append(doc)
                            rows.append((k, s, n, zlib.crc32(raw[4 * (i + s) : 4 * (i + s + n)])))
        if not rows:
            return
        piece, start, length, crc = np.array(rows, np.int64).T
        bins, offsets, fill = best_fit(length, capacity)
        cols = [pa.array(who, pa.int64()), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, (part << 32) + bins, offsets, fill[bins]))]
        for b in pa.Table.from_arrays(cols, names=[c.split()[0] for c in PIECES.split(", ")]).to_batches(16384):
            yield b

    pieces = staged(docs.mapInArrow(local, PIECES), "pieces")
    residual = pieces.where(F.col("used") < capacity).groupBy("bin").agg(F.max("used").alias("used"))
    residual = residual.select("bin", "used", F.shiftright("bin", 32).alias("node"))

    def passed_on(bins: pd.DataFrame) -> pd.DataFrame:
        """The bins of a node that climb: all that are half full at most, and the emptiest of the others."""
        bins = bins.sort_values(["used", "bin"])
        small = bins["used"] <= capacity // 2
        return pd.concat([bins[small], bins[~small & (bins["used"] < capacity)].head(receivers)])

    def merged(key, items: pd.DataFrame) -> pd.DataFrame:
        items = pd.concat([passed_on(own) for _, own in items.groupby("node")]).sort_values(["used", "bin"], ascending=[False, True])
        to, at, fill = best_fit(items["used"].to_numpy(), capacity)
        name = items["bin"].to_numpy()
        first = np.zeros(len(fill), np.int64)
        first[to[::-1]] = name[::-1]  # a merged bin takes the name of its first item
        return pd.DataFrame({"node": key[0], "item": name, "bin": first[to], "delta": at, "used": fill[to]})

    top = residual.agg(F.max("node")).first()[0]
    moves = None
    level = residual
    while top is not None and top > 0:
        level = level.withColumn("up", F.expr(f"node div {FAN_IN}"))
        step = staged(level.groupBy("up").applyInPandas(merged, "node long, item long, bin long, delta long, used long"), "merge")
        changed = step.where("item <> bin").select(F.col("item"), F.col("bin").alias("to"), F.col("delta").alias("by"))
        if moves is None:
            moves = changed.select(F.col("item"), "to", "by")
        else:  # what moved before moves on with its bin
            on = changed.select(F.col("item").alias("via"), F.col("to").alias("to2"), F.col("by").alias("by2"))
            further = moves.join(on, F.col("to") == F.col("via"), "left").select("item", F.coalesce("to2", "to").alias("to"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by"))
            moves = staged(further.unionByName(changed), "moves")
        level = step.select("bin", "used", "node").where(F.col("used") < capacity).distinct()
        top //= FAN_IN
    if moves is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return pieces.join(moves, F.col("bin") == F.col("item"), "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("by", F.lit(0))).alias("offset"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

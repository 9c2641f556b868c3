"""Ranks and running sums over a whole table without a single task: rows are dealt into ranges, and each range begins where those before end."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.sources.catalog import named


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that ``spark.checkpoint.dir`` names, which outlives executors. Only a local session may do without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def _ranged(df: DataFrame, order: list[str], descending: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part`` and ``_at`` (their place within it), settled; and each part's number of rows."""
    by = [named(c).desc() if descending else named(c).asc() for c in order]
    rows = settled(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_at")))
    return rows, rows.groupBy("_part").agg(F.count("*").alias("_n"))


def _before(parts: DataFrame, *sums: str) -> DataFrame:
    """Each part's sums over the parts before it: a row a part, so that one small window does."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return F.broadcast(parts.select("_part", *(F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_before{s}") for s in sums)))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with ``name``: each row's place in the order, from 0. Equal rows get different numbers, in any order."""
    rows, parts = _ranged(df, order, False)
    return rows.join(_before(parts, "_n"), "_part").withColumn(name, F.col("_before_n") + F.col("_at")).drop("_part", "_at", "_before_n")


def running_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``df`` with each of ``sums`` replaced by its sum up to and with the row, in the order of a column of distinct values."""
    rows, _ = _ranged(df, [order], descending)
    parts = rows.groupBy("_part").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("_part", *(F.sum(c).over(within).alias(c) if c in sums else named(c) for c in df.columns))
    return local.join(_before(parts, *(f"_{s}" for s in sums)), "_part").select(*((F.col(c) + F.col(f"_before_{c}")).alias(c) if c in sums else named(c) for c in df.columns))

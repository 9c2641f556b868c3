"""How well edges and rows refer to each other, counted from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemaforge.functions.naming import collection_of
from skemaforge.sources.catalog import Catalog, union_all


def referential_health(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """collection, rows, connected, orphaned, dangling_from, dangling_to: for each collection that has rows or that an edge end names.

    edges: _from, _to; vertices: _id (distinct) of the collections asked about. An orphaned row has no edge; a dangling end names no row. One pass: ends and
    rows meet by id in one aggregation with partial counts, so that a hub is one row a task.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    met = union_all([
        vertices.select(F.col("_id").alias("id"), one.alias("row"), none.alias("f"), none.alias("t")),
        edges.select(F.col("_from").alias("id"), none.alias("row"), one.alias("f"), none.alias("t")),
        edges.select(F.col("_to").alias("id"), none.alias("row"), none.alias("f"), one.alias("t")),
    ]).where("id is not null").groupBy("id").agg(F.max("row").alias("row"), F.sum("f").alias("f"), F.sum("t").alias("t"))
    there = F.col("row") == 1
    ends = F.col("f") + F.col("t")
    return met.groupBy(collection_of(F.col("id")).alias("collection")).agg(
        F.sum("row").alias("rows"), F.count_if(there & (ends > 0)).alias("connected"), F.count_if(there & (ends == 0)).alias("orphaned"),
        F.coalesce(F.sum(F.when(~there, F.col("f"))), F.lit(0)).alias("dangling_from"), F.coalesce(F.sum(F.when(~there, F.col("t"))), F.lit(0)).alias("dangling_to"),
    )


def catalog_health(catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """``referential_health`` of each edge collection (``edges``) against the document collections ``names`` (all by default)."""
    docs = [c for c in catalog.user_collections() if c.kind == "document" and (names is None or c.name in names)]
    empty = catalog.spark.createDataFrame([], "edges string, collection string, rows long, connected long, orphaned long, dangling_from long, dangling_to long")
    if not docs:
        return empty
    vertices = union_all([c.df.select("_id") for c in docs])
    parts = [referential_health(c.df, vertices).select(F.lit(c.name).alias("edges"), "*") for c in catalog.user_collections() if c.kind == "edge"]
    return union_all([empty, *parts])


def summary(health: DataFrame) -> DataFrame:
    """edges, rows, connectivity, consistency (4 places, null on nothing) of ``catalog_health``: shares of connected rows and of ends that name a row."""
    g = health.groupBy("edges").agg(F.sum("rows").alias("rows"), F.sum("connected").alias("c"), F.sum(F.col("dangling_from") + F.col("dangling_to")).alias("bad"))
    return g.select("edges", "rows", F.round(F.col("c") / F.nullif(F.col("rows"), F.lit(0)), 4).alias("connectivity"), F.col("bad").alias("dangling"))

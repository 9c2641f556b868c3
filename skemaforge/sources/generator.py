"""Deterministic rows for a gold model, in dedicated or shared collections: what the quality benchmark analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Collection, Graph, union_all


def collection_name(entity: str, plural: bool = False) -> str:
    return f"{entity.lower()}s" if plural else entity


def edge_name(relation: str) -> str:
    return relation.lower()


def _entity(spark: SparkSession, name: str, properties: list[str], scale: int, collection: str, typed: bool) -> DataFrame:
    rows = spark.range(scale)
    key = F.concat(F.lit(f"{name}-" if typed else ""), F.col("id").cast("string"))
    out = rows.select(key.alias("_key"), F.concat_ws("/", F.lit(collection), key).alias("_id"), *(F.concat(F.lit(f"{p}-"), F.col("id").cast("string")).alias(p) for p in properties[:2]))
    return out.withColumn("type", F.lit(name)) if typed else out


def _relation(spark: SparkSession, r: dict, scale: int, seed: int, end, typed: bool) -> DataFrame:
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(r["type"]), F.lit(salt), "id"), F.lit(scale)).cast("string")
    out = spark.range(2 * scale).select(F.concat(F.lit(end(r["from"])), pick("a")).alias("_from"), F.concat(F.lit(end(r["to"])), pick("b")).alias("_to"), *(F.concat(F.lit(f"{p}-"), F.col("id").cast("string")).alias(p) for p in r.get("properties", [])[:1]))
    return out.withColumn("relation", F.lit(r["type"])) if typed else out


def materialize(spark: SparkSession, model: dict, shared: bool, scale: int = 5, seed: int = 1, plural: bool = False) -> Catalog:
    """model: entities (name, properties), relationships (type, from, to, properties). ``plural`` names dedicated collections in small plurals."""
    entities, relations = model["entities"], model["relationships"]
    if shared:
        end = lambda n: f"entities/{n}-"
        docs = [Collection("entities", lambda: union_all([_entity(spark, e["name"], e["properties"], scale, "entities", True) for e in entities]))]
        edges = [Collection("relationships", lambda: union_all([_relation(spark, r, scale, seed, end, True) for r in relations]), "edge")]
        graphs = [Graph("g", [("relationships", ["entities"], ["entities"])])]
    else:
        own = lambda n: collection_name(n, plural)
        end = lambda n: f"{own(n)}/"
        docs = [Collection(own(e["name"]), lambda e=e: _entity(spark, e["name"], e["properties"], scale, own(e["name"]), False)) for e in entities]
        edges = [Collection(edge_name(r["type"]), lambda r=r: _relation(spark, r, scale, seed, end, False), "edge") for r in relations]
        graphs = [Graph("g", [(edge_name(r["type"]), [own(r["from"])], [own(r["to"])]) for r in relations])]
    return Catalog(spark, docs + edges, graphs)

"""The driver's star-schema tables as collections and graphs, in three layouts: one collection a type, one shared, and mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Collection, Graph, keyed, union_all

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return keyed(table(spark, sf_dir, name), name, KEYS[name])


#: Shared vertex collection: type and its key and name columns.
TYPES = {"Region": ("region", "r_regionkey", "r_name"), "Nation": ("nation", "n_nationkey", "n_name"), "Customer": ("customer", "c_custkey", "c_name"), "Supplier": ("supplier", "s_suppkey", "s_name")}
#: Shared edge collection: relation, source table, and the two ends as (table, column).
RELATIONS = [("IN_REGION", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")), ("CUSTOMER_IN", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")), ("SUPPLIER_IN", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"))]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_key, _id, type, name, balance: four types in one collection (``entities/region-1``)."""
    parts = []
    for kind, (name, key, title) in TYPES.items():
        df = table(spark, sf_dir, name)
        k = F.concat_ws("-", F.lit(name), F.col(key).cast("string"))
        balance = {"customer": "c_acctbal", "supplier": "s_acctbal"}.get(name)
        parts.append(df.select(k.alias("_key"), F.concat_ws("/", F.lit("entities"), k).alias("_id"), F.lit(kind).alias("type"), F.col(title).alias("name"), (F.col(balance) if balance else F.lit(None)).cast("double").alias("balance")))
    return union_all(parts)


def relationships(spark: SparkSession, sf_dir: str, shared: bool = True) -> DataFrame:
    """_from, _to, relation in one edge collection; its ends lie in ``entities`` or (not shared) in the types' own collections."""
    parts = []
    for relation, name, (a, ka), (b, kb) in RELATIONS:
        df = table(spark, sf_dir, name)
        end = lambda t, c: F.concat(F.lit(f"entities/{t}-" if shared else f"{t}/"), F.col(c).cast("string"))
        parts.append(df.select(end(a, ka).alias("_from"), end(b, kb).alias("_to"), F.lit(relation).alias("relation")))
    return union_all(parts)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dedicated edge collection: customers to their orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("_from"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("_to"), F.col("o_orderstatus").alias("status"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    docs = [Collection(n, lambda n=n: vertices(spark, sf_dir, n), indexes=[{"type": "primary", "fields": ["_key"], "unique": True}]) for n in KEYS]
    edges = [
        Collection("placed", lambda: placed(spark, sf_dir), "edge", [{"type": "persistent", "fields": ["_from", "status"], "unique": False}]),
        Collection("relationships", lambda: relationships(spark, sf_dir, shared=False), "edge", [{"type": "persistent", "fields": ["_to", "relation"], "unique": False}]),
    ]
    graphs = [
        Graph("sales", [("placed", ["customer"], ["orders"])], ["part"]),
        Graph("geography", [("relationships", ["customer", "nation", "supplier"], ["nation", "region"])]),
    ]
    return Catalog(spark, docs + edges, graphs, {"name": "star"})


def shared_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Four types in one vertex collection, linked by one edge collection."""
    return Catalog(spark, [Collection("entities", lambda: entities(spark, sf_dir)), Collection("links", lambda: relationships(spark, sf_dir), "edge")], [], {"name": "shared"})


#: The relational layout's collections: fields with their categories, and the unique ones.
RELATIONAL = {
    "regions": {"name": "string"},
    "nations": {"name": "string", "regionId": "integer", "region_name": "string"},
    "customers": {"name": "string", "nation_id": "integer", "segment": "string"},
    "suppliers": {"name": "string", "nationid": "integer"},
    "parts": {"name": "string", "region_id": "integer"},
    "purchases": {"customerId": "integer", "status": "string"},
    "items": {"purchase_id": "integer", "part_key": "integer", "supplier_id": "integer", "quantity": "float"},
    "visits": {"visitor": "string", "kind": "string"},
}
UNIQUE = {"regions": "name", "nations": "name"}


def relational(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables with references as plain columns, of every kind of name. ``parts.region_id`` only looks like one: no region has such a key."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").select("r_regionkey", F.col("r_name").alias("region_name"))
    rows = {
        "regions": lambda: t("region").select("r_regionkey", F.col("r_name").alias("name")),
        "nations": lambda: t("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionId"), "region_name"),
        "customers": lambda: t("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment")),
        "suppliers": lambda: t("supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationid")),
        "parts": lambda: t("part").select("p_partkey", F.col("p_name").alias("name"), (F.col("p_size") + 1000).alias("region_id")),
        "purchases": lambda: t("orders").select("o_orderkey", F.col("o_custkey").alias("customerId"), F.col("o_orderstatus").alias("status")),
        "items": lambda: t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.col("l_orderkey").alias("purchase_id"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").alias("quantity")),
        "visits": lambda: t("events").select("event_id", F.concat(F.lit("customers/"), F.col("user_id").cast("string")).alias("visitor"), F.col("event_type").alias("kind")),
    }

    def load(name: str):
        def read() -> DataFrame:
            df = rows[name]()
            return keyed(df, name, df.columns[0]).drop(df.columns[0])

        return read

    index = lambda n: [{"type": "primary", "fields": ["_key"], "unique": True}, *({"type": "persistent", "fields": [f], "unique": True} for f in [UNIQUE.get(n)] if f)]
    return Catalog(spark, [Collection(n, load(n), indexes=index(n)) for n in rows], [], {"name": "relational"})

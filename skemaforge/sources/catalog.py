"""Databases, collections and graphs as DataFrames and small metadata tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemaforge.functions import naming

SYSTEM_FIELDS = ("_key", "_id", "_rev", "_from", "_to")


@dataclass
class Collection:
    """A document or edge collection: rows come from ``load`` when asked for; indexes and properties are declared."""

    name: str
    load: Callable[[], DataFrame]
    kind: str = "document"
    indexes: list[dict] = field(default_factory=list)
    properties: dict = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        return self.load()


@dataclass
class Graph:
    name: str
    edge_definitions: list[tuple[str, list[str], list[str]]]
    orphans: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)

    def members(self) -> set[str]:
        return set(self.orphans).union(*({e, *a, *b} for e, a, b in self.edge_definitions))

    @classmethod
    def from_dict(cls, props: Mapping) -> Graph:
        """Accepts both spellings of edge definitions and orphans; sorts what has no order of its own."""
        first = lambda d, *names: next((d[n] for n in names if n in d), None)
        edges = [(first(e, "edge_collection", "collection"), sorted(first(e, "from_vertex_collections", "from") or []), sorted(first(e, "to_vertex_collections", "to") or [])) for e in first(props, "edge_definitions", "edgeDefinitions") or []]
        known = {"name", "edge_definitions", "edgeDefinitions", "orphan_collections", "orphanCollections"}
        return cls(props["name"], sorted(edges), sorted(first(props, "orphan_collections", "orphanCollections") or []), {k: v for k, v in sorted(props.items()) if k not in known})


class Catalog:
    """A named set of collections and graphs."""

    def __init__(self, spark: SparkSession, collections: Iterable[Collection], graphs: Iterable[Graph] = (), properties: Mapping | None = None):
        self.spark, self.properties = spark, dict(properties or {})
        self.collections = {c.name: c for c in collections}
        self.graphs = {g.name: g for g in graphs}

    @classmethod
    def from_dir(cls, spark: SparkSession, path: str, tables: Mapping[str, str], edges: Iterable[str] = ()) -> Catalog:
        """One collection a Parquet table; ``tables`` names each table's key column, from which ``_key`` and ``_id`` are made."""

        def load(name: str, key: str) -> Callable[[], DataFrame]:
            return lambda: keyed(spark.read.parquet(f"{path}/{name}.parquet"), name, key)

        return cls(spark, [Collection(n, load(n, k), "edge" if n in set(edges) else "document") for n, k in tables.items()])

    def user_collections(self, exclude: Iterable[str] = (), graph: str | None = None) -> list[Collection]:
        """By name, without ``_``-prefixed and excluded ones; of one graph if named."""
        if graph is not None and graph not in self.graphs:
            raise ValueError(f"INVALID_ARGUMENT: no graph named {graph!r}")
        scope = self.graphs[graph].members() if graph is not None else self.collections.keys()
        return [self.collections[n] for n in sorted(self.collections) if not n.startswith("_") and n not in set(exclude) and n in scope]

    def listing(self) -> DataFrame:
        """collection, kind: the snapshot without any scan."""
        return self.spark.createDataFrame([(c.name, c.kind) for c in self.user_collections()], "collection string, kind string")

    def counts(self) -> DataFrame:
        """collection, rows: one job; Parquet footers or narrow scans are all it reads."""
        parts = [c.df.agg(F.count("*").alias("rows")).select(F.lit(c.name).alias("collection"), "rows") for c in self.user_collections()]
        return union_all([self.spark.createDataFrame([], "collection string, rows long"), *parts])

    def fields(self) -> DataFrame:
        """collection, field, category of all columns: from the schemas alone."""
        rows = [(c.name, f.name, type_category(f.dataType.typeName())) for c in self.user_collections() for f in c.df.schema.fields]
        return self.spark.createDataFrame(rows, "collection string, field string, category string")

    def graph_table(self) -> DataFrame:
        """graph, edge_collection, side (from, to, edge, orphan), collection."""
        rows = []
        for g in self.graphs.values():
            for e, a, b in g.edge_definitions:
                rows += [(g.name, e, "edge", e), *((g.name, e, "from", x) for x in a), *((g.name, e, "to", x) for x in b)]
            rows += [(g.name, None, "orphan", x) for x in g.orphans]
        return self.spark.createDataFrame(rows, "graph string, edge_collection string, side string, collection string")


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(df: DataFrame, collection: str, key: str) -> DataFrame:
    k = named(key).cast("string")
    return df.withColumns({"_key": k, "_id": naming.document_id(collection, k)})


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sample(df: DataFrame, n: int, by: str = "_key") -> DataFrame:
    """The first n rows by key: a sampling operator with a fixed answer (top-n, no full sort)."""
    return df.orderBy(by).limit(n)


def type_category(spark_type: str) -> str:
    """The coarse category of a column type; lists, structures and nulls are unknown."""
    if spark_type in ("byte", "short", "integer", "long", "bigint", "int", "tinyint", "smallint"):
        return "integer"
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return "float"
    if spark_type in ("string", "boolean"):
        return spark_type
    return "string" if spark_type.startswith(("varchar", "char")) else "unknown"


def compatible(a: str, b: str) -> bool:
    """Equal categories, two numbers, or anything with an unknown."""
    return a == b or "unknown" in (a, b) or {a, b} <= {"integer", "float", "number"}


def write_collection(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)

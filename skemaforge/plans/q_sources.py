"""Queries of sources, projections, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.functions import naming
from skemaforge.operators import relational
from skemaforge.sources import star
from skemaforge.sources.catalog import Graph, Catalog, sample, union_all

from .registry import query, values

ENTITIES = """entities AS (
SELECT 'region-' || r_regionkey AS _key, 'entities/region-' || r_regionkey AS _id, 'Region' AS type, r_name AS name, NULL::DOUBLE AS balance FROM region
UNION ALL SELECT 'nation-' || n_nationkey, 'entities/nation-' || n_nationkey, 'Nation', n_name, NULL FROM nation
UNION ALL SELECT 'customer-' || c_custkey, 'entities/customer-' || c_custkey, 'Customer', c_name, c_acctbal FROM customer
UNION ALL SELECT 'supplier-' || s_suppkey, 'entities/supplier-' || s_suppkey, 'Supplier', s_name, s_acctbal FROM supplier)"""


def relationships(prefix: str) -> str:
    """The shared edge collection; prefix ``entities/`` and ``-`` or each type's own collection and ``/``."""
    end = lambda t, c: f"'entities/{t}-' || {c}" if prefix else f"'{t}/' || {c}"
    return f"""relationships AS (
SELECT {end("nation", "n_nationkey")} AS _from, {end("region", "n_regionkey")} AS _to, 'IN_REGION' AS relation FROM nation
UNION ALL SELECT {end("customer", "c_custkey")}, {end("nation", "c_nationkey")}, 'CUSTOMER_IN' FROM customer
UNION ALL SELECT {end("supplier", "s_suppkey")}, {end("nation", "s_nationkey")}, 'SUPPLIER_IN' FROM supplier)"""


PLACED = "placed AS (SELECT 'customer/' || o_custkey AS _from, 'orders/' || o_orderkey AS _to, o_orderstatus AS status FROM orders)"
COLLECTIONS = [("customer", "document"), ("events", "document"), ("nation", "document"), ("orders", "document"), ("part", "document"), ("placed", "edge"), ("region", "document"), ("relationships", "edge"), ("supplier", "document")]
GRAPH_ROWS = [("sales", "placed", "edge", "placed"), ("sales", "placed", "from", "customer"), ("sales", "placed", "to", "orders"), ("sales", None, "orphan", "part"), ("geography", "relationships", "edge", "relationships"), ("geography", "relationships", "from", "customer"), ("geography", "relationships", "from", "nation"), ("geography", "relationships", "from", "supplier"), ("geography", "relationships", "to", "nation"), ("geography", "relationships", "to", "region")]


@query(f"WITH {values('c', 'collection, kind', COLLECTIONS)} SELECT * FROM c")
def list_collections(spark, d):
    return star.catalog(spark, d).listing()


@query(f"WITH {values('c', 'collection, kind', COLLECTIONS)} SELECT * FROM c WHERE collection NOT IN ('events', 'part') AND NOT starts_with(collection, '_')")
def user_collections_excluded(spark, d):
    cat = star.catalog(spark, d)
    keep = [(c.name, c.kind) for c in cat.user_collections(exclude=["events", "part"])]
    return spark.createDataFrame(keep, "collection string, kind string")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, p_partkey::VARCHAR AS _key, 'part/' || p_partkey AS _id FROM part")
def collection_scan(spark, d):
    return star.vertices(spark, d, "part")


@query("SELECT c_custkey::VARCHAR AS _key, c_name FROM customer ORDER BY c_custkey::VARCHAR LIMIT 1")
def one_row_sample(spark, d):
    return sample(star.vertices(spark, d, "customer"), 1).select("_key", "c_name")


@query("SELECT o_orderkey::VARCHAR AS _key, o_orderstatus FROM orders ORDER BY o_orderkey::VARCHAR LIMIT 50")
def n_row_sample(spark, d):
    return sample(star.vertices(spark, d, "orders"), 50).select("_key", "o_orderstatus")


@query("SELECT 'customer' AS collection, count(*) AS rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'placed', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'relationships', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'supplier', count(*) FROM supplier")
def collection_counts(spark, d):
    return star.catalog(spark, d).counts()


@query(f"WITH {values('g', 'graph, edge_collection, side, collection', GRAPH_ROWS)} SELECT * FROM g")
def graph_listing(spark, d):
    return star.catalog(spark, d).graph_table()


@query(f"WITH {values('g', 'graph, edge_collection, side, collection', [('g', 'e', 'edge', 'e'), ('g', 'e', 'from', 'a'), ('g', 'e', 'from', 'b'), ('g', 'e', 'to', 'c'), ('g', None, 'orphan', 'o'), ('g', None, 'orphan', 'p')])} SELECT * FROM g")
def graph_normalised(spark, d):
    g = Graph.from_dict({"name": "g", "edgeDefinitions": [{"collection": "e", "from": ["b", "a"], "to": ["c"]}], "orphanCollections": ["p", "o"]})
    return Catalog(spark, [], [g]).graph_table()


@query(f"WITH {values('g', 'graph, edge_collection, side, collection', GRAPH_ROWS)} SELECT DISTINCT collection FROM g WHERE graph = 'sales'")
def graph_scope(spark, d):
    return spark.createDataFrame([(c.name,) for c in star.catalog(spark, d).user_collections(graph="sales")], "collection string")


FIELDS = [
    *(("customer", *x) for x in (("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"), ("c_mktsegment", "string"), ("_key", "string"), ("_id", "string"))),
    *(("nation", *x) for x in (("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer"), ("_key", "string"), ("_id", "string"))),
    *(("orders", *x) for x in (("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"), ("o_orderdate", "unknown"), ("o_orderpriority", "string"), ("_key", "string"), ("_id", "string"))),
]


@query(f"WITH {values('f', 'collection, field, category', FIELDS)} SELECT * FROM f")
def collection_shapes(spark, d):
    return star.catalog(spark, d).fields().where(F.col("collection").isin("customer", "nation", "orders"))


@query(f"WITH {ENTITIES} SELECT _key, name FROM entities WHERE type = 'Nation'")
def label_filter(spark, d):
    return relational.labelled(star.entities(spark, d), "type", "Nation").select("_key", "name")


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n FROM entities WHERE type IN ('Nation', 'Region') GROUP BY type")
def label_list_filter(spark, d):
    return relational.labelled(star.entities(spark, d), "type", "Nation", "Region").groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n FROM entities WHERE balance IS NOT NULL GROUP BY type")
def non_null_filter(spark, d):
    return star.entities(spark, d).where(F.col("balance").isNotNull()).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS value, count(*) AS n, length(o_orderpriority) <= 64 AND regexp_matches(o_orderpriority, '^[A-Za-z0-9_-]+$') AND regexp_matches(o_orderpriority, '[A-Za-z]') AS is_label FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*), length(o_orderstatus) <= 64 AND regexp_matches(o_orderstatus, '^[A-Za-z0-9_-]+$') AND regexp_matches(o_orderstatus, '[A-Za-z]') FROM orders GROUP BY 1")
def label_shape(spark, d):
    o = star.table(spark, d, "orders")
    one = lambda c: o.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).withColumn("is_label", naming.is_label(F.col("value")))
    return one("o_orderpriority").unionByName(one("o_orderstatus"))


#: Columns whose values serve as names.
NAME_SOURCES = {"part": ("p_type", "p_brand"), "nation": ("n_name",), "customer": ("c_mktsegment", "c_name"), "events": ("event_type",), "orders": ("o_orderpriority",), "conversations": ("role",), "documents": ("lang", "source")}


def names_sql(rows: list[tuple]) -> str:
    """A common table expression n(name) of the tables' names and some odd ones."""
    found = " UNION ".join(f"SELECT {c} FROM {t} WHERE {c} IS NOT NULL" for t, cs in NAME_SOURCES.items() for c in cs)
    return f"{values('odd', 'name', rows)}, n AS (SELECT name FROM odd UNION {found})"


def table_names(spark, d, rows: list[tuple]):
    """The same names as a frame: one scan a table."""
    parts = [spark.createDataFrame(rows, "name string")]
    for t, cs in NAME_SOURCES.items():
        df = star.table(spark, d, t)
        parts.append(df.select(F.explode(F.array(*cs)).alias("name")).where("name is not null"))
    return union_all(parts).distinct()


NAMES = [("type",), ("_type",), ("kind",), ("user_id",), ("relType",), ("uuid",), ("event_kind",), ("key",), ("userid",), ("paid",), ("grid",), ("a_very_long_name_that_exceeds_the_limit",)]


@query(f"WITH {names_sql(NAMES)} SELECT name, regexp_matches(name, '^[a-z][a-z0-9_]{{0,31}}$') AND NOT regexp_matches(name, '(id|key|uuid|guid)$') AND NOT starts_with(name, '_') AS may FROM n")
def discriminator_names(spark, d):
    return table_names(spark, d, NAMES).select("name", naming.may_discriminate(F.col("name")).alias("may"))


@query(f"WITH {names_sql(NAMES)} SELECT name, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AS ok FROM n")
def identifier_guard(spark, d):
    return table_names(spark, d, NAMES).select("name", naming.is_identifier(F.col("name")).alias("ok"))


MAPPED = [("Customer", "customer"), ("Ghost", "ghosts"), ("Part", "part")]


@query(f"WITH {values('m', 'entity, collection', MAPPED)}, {relationships('')}, {PLACED}, c AS (SELECT DISTINCT split_part(unnest([_from, _to]), '/', 1) AS collection FROM (SELECT _from, _to FROM relationships UNION ALL SELECT _from, _to FROM placed)) SELECT entity, m.collection FROM m ANTI JOIN c ON m.collection = c.collection")
def unknown_collections_stripped(spark, d):
    """Of what is mapped, the collections that no edge's end lies in."""
    mapped = spark.createDataFrame(MAPPED, "entity string, collection string")
    ends = union_all([df.select(F.explode(F.array("_from", "_to")).alias("id")) for df in (star.relationships(spark, d, shared=False), star.placed(spark, d))])
    return mapped.join(ends.select(naming.collection_of(F.col("id")).alias("collection")).distinct(), "collection", "left_anti").select("entity", "collection")


# -- set operations ---------------------------------------------------------------------------------------------


@query(f"WITH {ENTITIES} SELECT 'entities' AS collection, type AS label, count(*) AS n FROM entities WHERE type IN ('Customer', 'Supplier') GROUP BY type UNION ALL SELECT 'part', NULL, count(*) FROM part")
def class_extent_union(spark, d):
    e = star.entities(spark, d)
    out = relational.class_extent([("entities", e, "type", ("Customer",)), ("entities", e, "type", ("Supplier", "Customer")), ("part", star.vertices(spark, d, "part").select("_key", "_id"), None, ())])
    return out.groupBy(F.col("_collection").alias("collection"), F.col("type").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES} SELECT count(*) AS n, count(DISTINCT _id) AS ids FROM entities")
def class_extent_subsumed(spark, d):
    e = star.entities(spark, d)
    out = relational.class_extent([("entities", e, None, ()), ("entities", e, "type", ("Nation",))])
    return out.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("ids"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH' GROUP BY 1) b FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' GROUP BY 1) a ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def snapshot_diff(spark, d):
    o = star.table(spark, d, "orders")
    side = lambda s, skip: o.where((F.col("o_orderstatus") == s) & (F.col("o_orderpriority") != skip)).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return relational.differences(side("F", "2-HIGH"), side("O", "1-URGENT"), "k", ["n"])


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49")
def set_difference(spark, d):
    k = star.table(spark, d, "lineitem")
    a = k.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"))
    return a.distinct().join(k.where("l_returnflag = 'A' and l_quantity > 49").select(F.col("l_suppkey").alias("k")), "k", "left_anti")


# -- scalar functions -------------------------------------------------------------------------------------------

WORDS = [("movies",), ("cities",), ("classes",), ("people",), ("glass",), ("s",), ("Cookies",), ("USER_ROLES",), ("order-items",), ("ies",), ("",)]


def _named(spark, d, rows=WORDS):
    return table_names(spark, d, rows)


_SINGULAR = "CASE WHEN ends_with({0}, 'ies') AND length({0}) > 3 THEN CASE WHEN lower({0}[:-2]) IN ('movie','zombie','cookie','brownie','rookie','selfie','genie','smoothie','collie','magpie','birdie','calorie','prairie','reverie','sortie','lingerie') THEN {0}[:-2] ELSE {0}[:-4] || 'y' END WHEN ends_with({0}, 'sses') AND length({0}) > 4 THEN {0}[:-3] WHEN ends_with({0}, 's') AND NOT ends_with({0}, 'ss') AND length({0}) > 1 THEN {0}[:-2] ELSE {0} END"
_PASCAL = "coalesce(nullif(list_aggregate(list_transform(list_filter(regexp_split_to_array({0}, '[-_ ]'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), 'string_agg', ''), ''), 'Unknown')"


@query(f"WITH {names_sql(WORDS)} SELECT name, {_SINGULAR.format('name')} AS singular FROM n")
def singular_names(spark, d):
    return _named(spark, d).select("name", naming.singularize(F.col("name")).alias("singular"))


@query(f"WITH {names_sql(WORDS)} SELECT name, {_PASCAL.format('name')} AS pascal FROM n")
def pascal_names(spark, d):
    return _named(spark, d).select("name", naming.pascal_case(F.col("name")).alias("pascal"))


@query(f"WITH {names_sql(WORDS)}, s AS (SELECT name, {_SINGULAR.format('name')} AS s FROM n) SELECT name, {_PASCAL.format('s')} AS entity, upper(replace(name, '-', '_')) AS relation FROM s")
def entity_and_relation_names(spark, d):
    return _named(spark, d).select("name", naming.entity_name(F.col("name")).alias("entity"), naming.relationship_name(F.col("name")).alias("relation"))


@query(f"WITH {names_sql(WORDS)}, s AS (SELECT name, {_SINGULAR.format('name')} AS s FROM n), b AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS b, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS o FROM s) SELECT DISTINCT name, v FROM (SELECT name, unnest([b, o, o || 's', o || 'es']) AS v FROM b)")
def name_variants(spark, d):
    return _named(spark, d).select("name", F.explode(naming.name_variants(F.col("name"))).alias("v"))


@query(f"WITH {names_sql(WORDS)}, g AS (SELECT name, replace(lower(regexp_replace(name, '[^A-Za-z0-9_-]', '', 'g')), '-', '_') AS g FROM n) SELECT name, {_SINGULAR.format('g')} AS gold FROM g")
def gold_names(spark, d):
    return _named(spark, d).select("name", naming.gold_name(F.col("name")).alias("gold"))


REFERENCES = [("accountId",), ("userKEY",), ("ID",), ("order_id",), ("aKey",), ("userId2",)]


@query(f"WITH {names_sql(REFERENCES)} SELECT name, regexp_extract(name, '^(.*[a-z0-9])(?:Id|ID|Key|KEY)$', 1) AS reference FROM n")
def camel_references(spark, d):
    return _named(spark, d, REFERENCES).select("name", naming.camel_reference(F.col("name")).alias("reference"))


@query("SELECT 'orders/' || o_orderkey AS id, 'orders' AS collection, sha256('orders/' || o_orderkey) AS digest FROM orders WHERE o_orderpriority = '1-URGENT'")
def id_functions(spark, d):
    i = naming.document_id("orders", F.col("o_orderkey"))
    return star.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(i.alias("id"), naming.collection_of(i).alias("collection"), F.sha2(i, 256).alias("digest"))


IDS = [("users/1",), ("users",), ("a b/1",), ("a/b c",), ("a/b/c",), ("x-y_z/k:1",)]


@query(f"WITH {values('odd', 'value', IDS)}, {PLACED}, n AS (SELECT value FROM odd UNION SELECT _from FROM placed UNION SELECT _to FROM placed UNION SELECT url FROM pages WHERE url IS NOT NULL) SELECT value, regexp_matches(value, '^[A-Za-z0-9_\\-]+/[^/\\s]+$') AS is_id FROM n")
def id_shapes(spark, d):
    ends, urls = star.placed(spark, d), star.table(spark, d, "pages").select(F.col("url").alias("value")).where("value is not null")
    found = union_all([spark.createDataFrame(IDS, "value string"), ends.select(F.explode(F.array("_from", "_to")).alias("value")), urls]).distinct()
    return found.select("value", naming.is_id_shaped(F.col("value")).alias("is_id"))


OWL = [("sales_orders",), ("ship_date",), ("STORED_AT",), ("taxes",), ("duties",), ("_tag",), ("glass",), ("boxes_of_matches",)]
_OWL = r"""w AS (SELECT name, regexp_extract_all(name, '[A-Z][a-z0-9]+|[A-Z]+|[a-z0-9]+') AS l FROM n), x AS (SELECT name, l, l[-1] AS z, lower(l[-1]) AS y FROM w),
s AS (SELECT name, l, list_append(l[:-2], CASE WHEN ends_with(y, 'ies') AND length(z) > 3 THEN z[:-4] || 'y' WHEN regexp_matches(y, '(ses|ches|shes|xes|zes)$') THEN z[:-3] WHEN ends_with(y, 's') AND NOT ends_with(y, 'ss') THEN z[:-2] ELSE z END) AS o FROM x)"""


@query(f"WITH {names_sql(OWL)}, {_OWL} SELECT name, coalesce(array_to_string(list_transform(o, lambda p: upper(p[1]) || lower(p[2:])), ''), '') AS class, regexp_extract(name, '^(_*)', 1) || array_to_string(list_transform(l, lambda p, i: CASE WHEN i = 1 THEN lower(p) ELSE upper(p[1]) || lower(p[2:]) END), '') AS property FROM s")
def ontology_names(spark, d):
    return table_names(spark, d, OWL).select("name", naming.owl_class(F.col("name")).alias("class"), naming.owl_property(F.col("name")).alias("property"))


@query("SELECT DISTINCT token FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(p_type), '[-_]'), lambda x: x <> '')) AS token FROM part)")
def domain_token_set(spark, d):
    return star.table(spark, d, "part").select(F.explode(naming.domain_tokens(F.col("p_type"))).alias("token")).distinct()


@query("WITH v AS (SELECT p_brand AS name FROM part UNION ALL SELECT p_size || ' ' || p_brand FROM part UNION ALL SELECT ''), s AS (SELECT name, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS s FROM v) SELECT name, CASE WHEN s = '' THEN '_Unknown' WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END AS iri, count(*) AS n FROM s GROUP BY 1, 2")
def iri_names(spark, d):
    p = star.table(spark, d, "part")
    names = p.select(F.col("p_brand").alias("name")).union(p.select(F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand"))).union(spark.createDataFrame([("",)], "name string"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", naming.iri_local(F.col("name")).alias("iri"), "n")


@query("SELECT collection, sum(n)::BIGINT AS n FROM (SELECT 'region' AS collection, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation) GROUP BY 1")
def union_of_collections(spark, d):
    return union_all([star.vertices(spark, d, t).select(naming.collection_of(F.col("_id")).alias("collection")) for t in ("region", "nation")]).groupBy("collection").agg(F.count("*").alias("n"))

"""Queries of the compiled dataflow: traversals, foreign keys, junctions, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.operators import inference, profile, relational
from skemaforge.sources import star
from skemaforge.sources.catalog import keyed, union_all

from .mapping import PhysicalMapping
from .q_sources import ENTITIES, PLACED, relationships
from .registry import query, values


@query("SELECT c_custkey, o_orderkey, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey")
def traverse_dedicated(spark, d):
    """Customers to orders over a dedicated edge collection."""
    c, o = star.vertices(spark, d, "customer"), star.vertices(spark, d, "orders")
    out = relational.traverse(c.select("_id", "c_custkey"), star.placed(spark, d), o.select("_id", "o_orderkey"))
    return out.select(F.col("s_c_custkey").alias("c_custkey"), F.col("t_o_orderkey").alias("o_orderkey"), F.col("e_status").alias("status"))


@query("SELECT c_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def traverse_dangling(spark, d):
    """Far rows of the low priority are missing: their edges stay with a null."""
    c, o = star.vertices(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), star.vertices(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    out = relational.traverse(c.select("_id", "c_custkey"), star.placed(spark, d), o.select("_id", "o_orderkey"))
    return out.select(F.col("s_c_custkey").alias("c_custkey"), F.col("t_o_orderkey").alias("o_orderkey"))


@query(f"WITH {ENTITIES}, {relationships('entities/')} SELECT s.name AS supplier, t.name AS nation FROM entities s JOIN relationships r ON s._id = r._from AND relation = 'SUPPLIER_IN' LEFT JOIN entities t ON r._to = t._id WHERE s.type = 'Supplier'")
def traverse_typed(spark, d):
    e = star.entities(spark, d).select("_id", "type", "name")
    out = relational.traverse(relational.labelled(e, "type", "Supplier"), star.relationships(spark, d), e, type_field="relation", type_value="SUPPLIER_IN")
    return out.select(F.col("s_name").alias("supplier"), F.col("t_name").alias("nation"))


@query(f"WITH {ENTITIES}, {relationships('entities/')} SELECT s.name AS nation, count(*) AS customers FROM entities s JOIN relationships r ON s._id = r._to AND relation = 'CUSTOMER_IN' WHERE s.type = 'Nation' GROUP BY 1")
def traverse_inbound(spark, d):
    e = star.entities(spark, d).select("_id", "type", "name")
    out = relational.traverse(relational.labelled(e, "type", "Nation"), star.relationships(spark, d), e, "inbound", "relation", "CUSTOMER_IN")
    return out.groupBy(F.col("s_name").alias("nation")).agg(F.count("*").alias("customers"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey")
def foreign_key_outbound(spark, d):
    out = relational.foreign_key(star.table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], star.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    return out.select(F.col("s_o_orderkey").alias("o_orderkey"), F.col("t_c_name").alias("c_name"))


@query("SELECT c_custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey IS NOT DISTINCT FROM c_custkey GROUP BY 1")
def foreign_key_inbound(spark, d):
    out = relational.foreign_key(star.table(spark, d, "orders").select("o_custkey"), ["o_custkey"], star.table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "inbound")
    return out.groupBy(F.col("s_c_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))


_REFS = "a AS (SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS ref, CASE WHEN l_quantity < 45 THEN l_linestatus END AS part FROM lineitem), b AS (SELECT DISTINCT CASE WHEN l_linenumber > 2 THEN l_returnflag END AS code, CASE WHEN l_quantity < 40 THEN l_linestatus END AS part FROM lineitem)"


@query(f"WITH {_REFS} SELECT ref, b.code, b.part, count(*) AS n FROM a JOIN b ON a.ref IS NOT DISTINCT FROM b.code AND a.part IS NOT DISTINCT FROM b.part GROUP BY ALL")
def foreign_key_composite_nulls(spark, d):
    """Composite keys; null matches null."""
    line = star.table(spark, d, "lineitem")
    a = line.select("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("ref"), F.when(F.col("l_quantity") < 45, F.col("l_linestatus")).alias("part"))
    b = line.select(F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("code"), F.when(F.col("l_quantity") < 40, F.col("l_linestatus")).alias("part")).distinct()
    out = relational.foreign_key(a, ["ref", "part"], b, ["code", "part"])
    return out.groupBy(F.col("s_ref").alias("ref"), F.col("t_code").alias("code"), F.col("t_part").alias("part")).agg(F.count("*").alias("n"))


_PLACES = "places AS (SELECT n_nationkey::VARCHAR AS _key, n_name AS name FROM nation UNION ALL SELECT r_name, r_name FROM region)"


def _places(spark, d):
    """A collection whose keys are numbers of nations and names of regions, all text."""
    n, r = star.table(spark, d, "nation"), star.table(spark, d, "region")
    rows = n.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")).union(r.select("r_name", "r_name"))
    return keyed(rows, "places", "k").select("_key", "name")


@query(f"WITH {_PLACES} SELECT c_custkey, name AS place FROM customer JOIN places ON c_nationkey::VARCHAR = _key")
def foreign_key_number_to_text(spark, d):
    """A number refers to a document's key, which is text; most keys can't be read as numbers."""
    out = relational.foreign_key(star.table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], _places(spark, d), ["_key"])
    return out.select(F.col("s_c_custkey").alias("c_custkey"), F.col("t_name").alias("place"))


@query(f"WITH {_PLACES}, u AS (SELECT user_id, CASE WHEN user_id % 3 > 0 THEN user_id % 40 END AS home FROM events) SELECT name AS place, count(*) AS events FROM places JOIN u ON home::VARCHAR = _key GROUP BY 1")
def foreign_key_nulls_and_text(spark, d):
    """Inbound over a reference that is null in a third of the rows: an identity key matches no null, so those rows aren't shuffled."""
    u = star.table(spark, d, "events").select(F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 40).alias("home"))
    return relational.foreign_key(u, ["home"], _places(spark, d), ["_key"], "inbound").groupBy(F.col("s_name").alias("place")).agg(F.count("*").alias("events"))


def _located(spark, d, labelled: bool) -> PhysicalMapping:
    """One relationship whose ends lie in several collections, or in several labels of a shared one; customers of one segment are no entity."""
    cat = star.catalog(spark, d)
    names = {"Customer": "customer", "Nation": "nation", "Region": "region", "Supplier": "supplier"}
    if not labelled:
        ends = {"from_entity": "Any", "to_entity": "Any", "from_entities": ["Customer", "Nation", "Supplier"], "to_entities": ["Nation", "Region"]}
        return PhysicalMapping(cat, {e: {"style": "COLLECTION", "collection": c} for e, c in names.items()}, {"LOCATED": {"style": "DEDICATED_COLLECTION", "collection": "relationships", **ends}})
    cat = star.shared_catalog(spark, d)
    entities = {e: {"style": "LABEL", "collection": "entities", "type_field": "type", "type_value": e} for e in ("Nation", "Region", "Supplier")}
    return PhysicalMapping(cat, entities, {"LOCATED": {"style": "DEDICATED_COLLECTION", "collection": "links", "from_entity": "Any", "to_entity": "Any"}})


def _shown(df, *columns):
    return df.select(F.col("s_entity").alias("source"), F.col("s__key").alias("source_key"), F.col("t_entity").alias("target"), *columns)


_NAMES = "names AS (SELECT 'nation/' || n_nationkey AS _id, 'Nation' AS entity, n_nationkey::VARCHAR AS _key, n_name AS name FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'Region', r_regionkey::VARCHAR, r_name FROM region UNION ALL SELECT 'customer/' || c_custkey, 'Customer', c_custkey::VARCHAR, c_name FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier', s_suppkey::VARCHAR, s_name FROM supplier)"


@query(f"WITH {relationships('')}, {_NAMES} SELECT s.entity AS source, s._key AS source_key, t.entity AS target, t.name AS target_name FROM names s JOIN relationships r ON r._from = s._id LEFT JOIN names t ON t._id = r._to")
def traverse_any_collection(spark, d):
    """Outbound over a relationship from three collections to two: one join, each collection scanned once."""
    return _shown(_located(spark, d, False).traverse("LOCATED"), F.coalesce("t_n_name", "t_r_name").alias("target_name"))


@query(f"WITH {relationships('')}, {_NAMES} SELECT s.entity AS source, s._key AS source_key, t.entity AS target, t._key AS target_key FROM names s JOIN relationships r ON r._to = s._id LEFT JOIN names t ON t._id = r._from WHERE s.entity IN ('Nation', 'Region')")
def traverse_any_collection_inbound(spark, d):
    return _shown(_located(spark, d, False).traverse("LOCATED", "inbound"), F.col("t__key").alias("target_key"))


@query(f"WITH {ENTITIES}, {relationships('entities/')}, e AS (SELECT * FROM entities WHERE type <> 'Customer') SELECT s.type AS source, s._key AS source_key, t.type AS target, t.name AS target_name FROM e s JOIN relationships r ON r._from = s._id LEFT JOIN e t ON t._id = r._to")
def traverse_any_label(spark, d):
    """The ends are labels of one collection; rows of other labels are no far rows."""
    return _shown(_located(spark, d, True).traverse("LOCATED"), F.col("t_name").alias("target_name"))


@query(f"WITH {ENTITIES}, {relationships('entities/')}, e AS (SELECT * FROM entities WHERE type <> 'Customer') SELECT s.type AS source, s._key AS source_key, t.type AS target, t._key AS target_key FROM e s JOIN relationships r ON r._to = s._id LEFT JOIN e t ON t._id = r._from")
def traverse_any_label_inbound(spark, d):
    """Customers aren't an entity here: their edges stay with a null far row."""
    return _shown(_located(spark, d, True).traverse("LOCATED", "inbound"), F.col("t__key").alias("target_key"))


def _junction(spark, d, direction):
    o, l, p = star.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), star.table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), star.table(spark, d, "part").select("p_partkey", "p_brand")
    return relational.junction(o, ["o_orderkey"], l, ["l_orderkey"], ["l_partkey"], p, ["p_partkey"], direction)


@query("SELECT o_orderpriority, p_brand, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def junction_two_hop(spark, d):
    return _junction(spark, d, "outbound").groupBy(F.col("s_o_orderpriority").alias("o_orderpriority"), F.col("t_p_brand").alias("p_brand")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def junction_inbound(spark, d):
    return _junction(spark, d, "inbound").groupBy(F.col("s_p_brand").alias("p_brand")).agg(F.count_distinct("t_o_orderkey").alias("orders"))


def _contained(child, key):
    return f"SELECT count(*) AS \"values\", count(k) AS hits, count(k) / nullif(count(*), 0) AS ratio FROM (SELECT DISTINCT {child[1]}::VARCHAR AS v FROM {child[0]} WHERE {child[1]} IS NOT NULL) LEFT JOIN (SELECT DISTINCT {key[1]}::VARCHAR AS k FROM {key[0]} WHERE {key[1]} IS NOT NULL) ON v = k"


@query(_contained(("orders", "o_custkey"), ("customer", "c_custkey")))
def containment_full(spark, d):
    return relational.containment(star.table(spark, d, "orders"), "o_custkey", star.vertices(spark, d, "customer"), "_key")


@query("SELECT count(*) AS \"values\", count(k) AS hits, count(k) / nullif(count(*), 0) AS ratio FROM (SELECT v FROM (SELECT DISTINCT l_suppkey::VARCHAR AS v FROM lineitem) ORDER BY md5(v) LIMIT 50) LEFT JOIN (SELECT DISTINCT s_suppkey::VARCHAR AS k FROM supplier) ON v = k")
def containment_sampled(spark, d):
    return relational.containment(star.table(spark, d, "lineitem"), "l_suppkey", star.vertices(spark, d, "supplier"), "_key", sampled=50)


@query("SELECT 0::BIGINT AS \"values\", 0::BIGINT AS hits, NULL::DOUBLE AS ratio")
def containment_empty(spark, d):
    return relational.containment(star.table(spark, d, "orders").where("o_custkey < 0"), "o_custkey", star.vertices(spark, d, "customer"), "_key")


@query("WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT k, count(*) AS n FROM k GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (n > 1) AS in_multiple, count(*) FILTER (n IS NULL) AS in_none FROM customer LEFT JOIN n ON c_custkey = k")
def specialisation_counts(spark, d):
    o = star.table(spark, d, "orders")
    child = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("_key"))
    return relational.specialisation_counts(star.vertices(spark, d, "customer"), [child("F"), child("O")])


ENTITY_OF = [("Customer", "customer"), ("Order", "orders"), ("Supplier", "supplier"), ("Nation", "nation")]
_ENDS = f"{relationships('')}, {PLACED}, x AS (SELECT relation, _from, _to FROM relationships UNION ALL SELECT 'PLACED', _from, _to FROM placed UNION ALL SELECT 'IN', _from, _to FROM relationships WHERE relation <> 'IN_REGION'), e AS (SELECT DISTINCT relation, 'from' AS side, split_part(_from, '/', 1) AS collection FROM x UNION SELECT relation, 'to', split_part(_to, '/', 1) FROM x)"


@query(f"WITH {_ENDS}, {values('n', 'entity, collection', ENTITY_OF)}, s AS (SELECT relation, side, CASE WHEN count(DISTINCT entity) = 1 THEN min(entity) ELSE 'Any' END AS entity FROM e LEFT JOIN n ON e.collection = n.collection GROUP BY ALL) SELECT relation, max(entity) FILTER (side = 'from') AS from_entity, max(entity) FILTER (side = 'to') AS to_entity FROM s GROUP BY relation")
def endpoint_entities(spark, d):
    """The entity of each relation's ends, as the edges show; ``IN`` has two at one end, regions are no entity."""
    r = star.relationships(spark, d, shared=False)
    edges = union_all([r, star.placed(spark, d).select("_from", "_to", F.lit("PLACED").alias("relation")), r.where("relation <> 'IN_REGION'").withColumn("relation", F.lit("IN"))])
    ends = profile.endpoints_by_relation(edges, "relation")
    sides = union_all([ends.select("relation", F.lit(side).alias("side"), F.col(f"{side}_collection").alias("collection")) for side in ("from", "to")]).distinct()
    return inference.resolved_endpoints(sides, spark.createDataFrame(ENTITY_OF, "entity string, collection string"))


@query(f"WITH {_ENDS}, {values('m', 'entity, collection', ENTITY_OF)} SELECT DISTINCT collection FROM e WHERE collection NOT IN (SELECT collection FROM m)")
def uncovered_collections(spark, d):
    """Collections that edges lead to and no entity covers."""
    covered = spark.createDataFrame(ENTITY_OF, "entity string, collection string")
    ends = union_all([profile.endpoints(star.relationships(spark, d, shared=False)), profile.endpoints(star.placed(spark, d))])
    return ends.select(F.explode(F.array("from_collection", "to_collection")).alias("collection")).distinct().join(covered, "collection", "left_anti")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def semi_join(spark, d):
    r = star.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return star.table(spark, d, "orders").join(r, "o_orderkey", "left_semi").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW') GROUP BY 1")
def anti_join(spark, d):
    o = star.table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return star.table(spark, d, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))

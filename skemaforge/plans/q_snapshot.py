"""Queries of the physical snapshot's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.sources import star
from skemaforge.sources.catalog import Catalog, Collection

from . import snapshot
from .q_foreign_keys import _ROWS
from .q_sources import ENTITIES, relationships
from .registry import query


@query(f"WITH {_ROWS}, c AS (SELECT collection, field, v AS value, count(*) AS count FROM r WHERE (collection, field) IN (('regions', 'name'), ('nations', 'name'), ('nations', 'region_name'), ('customers', 'name'), ('customers', 'segment'), ('suppliers', 'name'), ('parts', 'name'), ('purchases', 'status'), ('visits', 'visitor'), ('visits', 'kind')) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY collection, field ORDER BY count DESC, value)::INTEGER AS rank FROM c) SELECT * FROM k WHERE rank <= 70")
def snapshot_values(spark, d):
    return snapshot.value_table(star.relational(spark, d))


@query("SELECT 'customers' AS collection, unnest(['name', 'nation_id', 'segment']) AS field, count(*) AS present FROM customer UNION ALL SELECT 'items', unnest(['purchase_id', 'part_key', 'supplier_id', 'quantity']), count(*) FROM lineitem UNION ALL SELECT 'regions', 'name', count(*) FROM region UNION ALL SELECT 'visits', unnest(['visitor', 'kind']), count(*) FROM events")
def snapshot_fields(spark, d):
    return snapshot.field_table(star.relational(spark, d)).where(F.col("collection").isin("customers", "items", "regions", "visits"))


@query("SELECT DISTINCT 'placed' AS collection, 'customer' AS from_collection, 'orders' AS to_collection FROM orders UNION ALL SELECT DISTINCT 'relationships', 'nation', 'region' FROM nation UNION ALL SELECT DISTINCT 'relationships', 'customer', 'nation' FROM customer UNION ALL SELECT DISTINCT 'relationships', 'supplier', 'nation' FROM supplier")
def snapshot_endpoints(spark, d):
    return snapshot.endpoint_table(star.catalog(spark, d))


@query(f"WITH {ENTITIES}, f AS (SELECT type, 'name' AS field, count(name) AS present FROM entities GROUP BY type UNION ALL SELECT type, 'balance', count(balance) FROM entities GROUP BY type) SELECT 'entities' AS collection, type, field, present FROM f WHERE present > 0")
def snapshot_fields_by_type(spark, d):
    """Fields of each type of a shared collection; which field tells types apart is found from its values."""
    c = star.shared_catalog(spark, d)
    return snapshot.typed_field_table(c, snapshot.type_fields(c)).where("collection = 'entities'")


@query(f"WITH {relationships('')} SELECT 'relationships' AS collection, relation, split_part(_from, '/', 1) AS from_collection, split_part(_to, '/', 1) AS to_collection, count(*) AS edges FROM relationships GROUP BY ALL")
def snapshot_endpoints_by_relation(spark, d):
    c = star.catalog(spark, d)
    types = snapshot.type_fields(c)
    return snapshot.relation_table(c, {n: f for n, f in types.items() if n == "relationships"})


@query(f"WITH {ENTITIES}, {relationships('entities/')} SELECT 'links' AS collection, relation, f.type AS from_type, t.type AS to_type, count(*) AS edges FROM relationships JOIN entities f ON _from = f._id JOIN entities t ON _to = t._id GROUP BY ALL")
def snapshot_types_by_relation(spark, d):
    c = star.shared_catalog(spark, d)
    return snapshot.entity_type_table(c, snapshot.type_fields(c))


@query(f"WITH c AS (SELECT replace(p_type, ' ', '_') AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT value FROM c WHERE regexp_full_match(value, '[A-Za-z0-9_-]{{1,64}}')) SELECT 'parts' AS collection, CASE WHEN (SELECT count(*) FROM c) = (SELECT count(*) FROM k) AND (SELECT count(*) FROM c) BETWEEN 2 AND 10000 AND (SELECT sum(n) FROM c) >= 0.8 * (SELECT count(*) FROM part) THEN 'type' END AS field, (SELECT count(DISTINCT p_type) FROM part) AS labels")
def snapshot_label_floor(spark, d):
    """A field with more labels than the usual 32 tells types apart where full label sets are asked for."""
    part = lambda: star.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_key"), F.translate("p_type", " ", "_").alias("type"))
    found = snapshot.type_fields(Catalog(spark, [Collection("parts", part)]), label_floor=3)
    return part().agg(F.count_distinct("type").alias("labels")).select(F.lit("parts").alias("collection"), F.lit(found.get("parts")).cast("string").alias("field"), "labels")

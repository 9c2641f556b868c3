"""Queries of the evaluation's scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.operators import evaluation, foreign_keys, profile
from skemaforge.sources import star

from . import q_detectors
from .q_foreign_keys import _ROWS, _SHAPES, _SINGLE, _VOTES
from .q_sources import relationships
from .registry import ORACLES, query, values

TRUTH = [("visits", "visitor", "customers"), ("customers", "nation_id", "nations"), ("items", "part_key", "parts"), ("items", "purchase_id", "purchases"), ("items", "supplier_id", "suppliers"), ("nations", "regionId", "regions"), ("nations", "region_name", "regions"), ("purchases", "customerId", "customers"), ("suppliers", "nationid", "nations"), ("parts", "name", "regions")]
_PRF = "round(CASE WHEN f > 0 THEN b / f WHEN t = 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN t > 0 THEN b / t WHEN f = 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN b > 0 THEN 2 * b / (f + t) WHEN f + t = 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS f1"


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE}, {values('g', 'collection, field, target', TRUTH)}, h AS (SELECT unnest([0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 0.85])::DOUBLE AS threshold), p AS (SELECT DISTINCT threshold, collection, fields[1] AS field, target FROM single, h WHERE confidence >= threshold), n AS (SELECT threshold, (SELECT count(*) FROM p WHERE p.threshold = h.threshold) AS f, (SELECT count(*) FROM p JOIN g USING (collection, field, target) WHERE p.threshold = h.threshold) AS b, (SELECT count(*) FROM g) AS t FROM h) SELECT threshold, {_PRF}, f - b AS false_positives, t - b AS false_negatives FROM n")
def foreign_key_threshold_sweep(spark, d):
    c = star.relational(spark, d)
    found = foreign_keys.single_candidates(foreign_keys.shapes(c), foreign_keys.id_shape_votes(c))
    return evaluation.threshold_sweep(found.withColumn("field", F.element_at("fields", 1)), spark.createDataFrame(TRUTH, "collection string, field string, target string"))


GOLD = [("in_region", "nations", "regions"), ("Customer_In", "Customer", "Nations"), ("SUPPLIER_IN", "Supplier", "Region"), ("FILLS", "Firm", "Crate")]
_SAID = f"{relationships('')}, p AS (SELECT DISTINCT relation AS r, split_part(_from, '/', 1) AS a, split_part(_to, '/', 1) AS b FROM relationships)"


@query(f"WITH {_SAID}, {values('g', 'r, a, b', GOLD)}, pn AS (SELECT DISTINCT rtrim(lower(r), 's') AS r, rtrim(lower(a), 's') AS a, rtrim(lower(b), 's') AS b FROM p WHERE a IS NOT NULL), gn AS (SELECT DISTINCT rtrim(lower(r), 's') AS r, rtrim(lower(a), 's') AS a, rtrim(lower(b), 's') AS b FROM g), n AS (SELECT (SELECT count(*) FROM pn JOIN gn USING (r, a, b)) AS b, (SELECT count(*) FROM pn) AS f, (SELECT count(*) FROM gn) AS t) SELECT {_PRF} FROM n")
def signature_scores(spark, d):
    """Relations with both ends as the edges show them, against given ones."""
    said = profile.endpoints_by_relation(star.relationships(spark, d, shared=False), "relation").select("relation", F.col("from_collection").alias("from_entity"), F.col("to_collection").alias("to_entity"))
    return evaluation.signature_scores(said, spark.createDataFrame(GOLD, "relation string, from_entity string, to_entity string"))


EXPECTED = [("entity", "Customer", "LABEL", "entities", "type", "Customer"), ("entity", "Supplier", "LABEL", "entities", "kind", "Supplier"), ("entity", "Ghost", "COLLECTION", "ghosts", None, None), ("relationship", "CUSTOMER_IN", "GENERIC_WITH_TYPE", "relationships", "relation", "CUSTOMER_IN"), ("relationship", "LOCATED", "DEDICATED_COLLECTION", "located", None, None)]
_MAPPED = f"p AS (SELECT 'entity' AS kind, entity AS name, style, collection, type_field AS f, type_value AS v FROM ({ORACLES['baseline_entities']}) UNION ALL SELECT 'relationship', relation, style, collection, type_field, type_value FROM ({ORACLES['baseline_relationships']}))"
_MAP = "kind string, name string, style string, collection string, type_field string, type_value string"


@query(f"WITH {values('e', 'kind, name, style, collection, f, v', EXPECTED)}, {_MAPPED}, k AS (SELECT e.kind, (e.style = p.style AND e.collection = p.collection AND e.f IS NOT DISTINCT FROM p.f AND e.v IS NOT DISTINCT FROM p.v) AS ok FROM e LEFT JOIN p ON e.kind = p.kind AND e.name = p.name) SELECT kind, count(*) FILTER (ok) AS ok, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM k GROUP BY 1")
def mapping_accuracy(spark, d):
    """What is inferred from the rows, against a given mapping."""
    inferred = q_detectors.baseline_entities(spark, d).select(F.lit("entity").alias("kind"), F.col("entity").alias("name"), "style", "collection", "type_field", "type_value").unionByName(q_detectors.baseline_relationships(spark, d).select(F.lit("relationship").alias("kind"), F.col("relation").alias("name"), "style", "collection", "type_field", "type_value"))
    return evaluation.mapping_accuracy(spark.createDataFrame(EXPECTED, _MAP), inferred)

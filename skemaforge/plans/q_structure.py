"""Queries of the operators on a model's parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.operators import inference, metrics, profile, structure
from skemaforge.sources import star
from skemaforge.sources.catalog import union_all

from . import q_detectors
from .q_sources import ENTITIES, relationships
from .registry import query, values

INDEXES = [("goods", 1, "primary", "_key", True, "a"), ("goods", 2, "persistent", "sku,depot", False, "z"), ("goods", 3, "persistent", "sku", True, "b"), ("goods", 4, "fulltext", "title", False, "t"), ("goods", 5, "persistent", "depot", False, "d"), ("moves", 1, "persistent", "_from,at", False, "m"), ("moves", 2, "vector", "shape", False, "v"), ("moves", 3, "persistent", "at", False, "n")]
_INDEXES = values("i", "collection, place, type, f, uniq, name", INDEXES)


def _indexes(spark):
    i = spark.createDataFrame(INDEXES, "collection string, place int, type string, f string, unique boolean, name string")
    return i.withColumn("fields", F.split("f", ",")).drop("f")


@query(f"WITH {_INDEXES} SELECT collection, type, f AS fields, name, row_number() OVER (PARTITION BY collection ORDER BY type, f, name)::INTEGER AS place FROM i")
def ordered_indexes(spark, d):
    return structure.ordered_indexes(_indexes(spark))


@query(f"""WITH {_INDEXES}, s AS (SELECT *, string_split(f, ',') AS l FROM i WHERE type <> 'primary' AND NOT regexp_matches(f, '^_(from|to),')), e AS (SELECT *, unnest(range(len(l)))::INTEGER AS position FROM s),
k AS (SELECT *, l[position + 1] AS field, row_number() OVER (PARTITION BY collection, l[position + 1] ORDER BY uniq DESC, place, position) AS k FROM e) SELECT collection, field, type, uniq AS "unique", CASE WHEN len(l) > 1 THEN f END AS compound, position FROM k WHERE k = 1""")
def index_flags(spark, d):
    return structure.index_flags(_indexes(spark))


@query(f"WITH {_INDEXES} SELECT collection, f AS field FROM i WHERE type = 'vector'")
def vector_indexes(spark, d):
    return structure.vector_indexes(_indexes(spark))


@query("WITH c AS (SELECT 'orders' AS collection, 'o_orderdate' AS field, o_orderdate::VARCHAR AS value, count(*) AS count FROM orders GROUP BY ALL UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS k FROM c) SELECT collection, field, value, count FROM k WHERE k <= 4")
def bounded_values(spark, d):
    o = star.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate") if dict(star.table(spark, d, "orders").dtypes)["o_orderdate"] == "date" else F.col("o_orderdate").cast("string"), "o_orderpriority")
    counts = profile.value_counts(o, ["o_orderdate", "o_orderpriority"]).select(F.lit("orders").alias("collection"), "field", "value", "count")
    return structure.bounded_values(counts, 4)


@query(f"WITH {ENTITIES}, f AS (SELECT 'name' AS f FROM entities WHERE name IS NOT NULL UNION SELECT 'balance' FROM entities WHERE balance IS NOT NULL UNION SELECT 'type' UNION SELECT 'kind') SELECT 'entities' AS collection, string_agg(f, ',' ORDER BY f) AS properties FROM f")
def property_union(spark, d):
    by_type = profile.observed_fields_by_type(star.entities(spark, d).select("type", "name", "balance"), "type").select(F.lit("entities").alias("collection"), "field")
    candidates = spark.createDataFrame([("entities", "type"), ("entities", "kind")], "collection string, field string")
    return structure.property_union(by_type, candidates)


@query(f"WITH {ENTITIES}, {relationships('')}, x AS (SELECT 'LPG_LABEL' AS pattern FROM (SELECT DISTINCT type FROM entities) UNION ALL SELECT 'LPG_LABEL' FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT unnest(['PG_ENTITY_COLLECTION', 'PG_ENTITY_COLLECTION']) UNION ALL SELECT 'LPG_GENERIC_EDGE' FROM (SELECT DISTINCT relation FROM relationships) UNION ALL SELECT 'LPG_GENERIC_EDGE' FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT unnest(['PG_DEDICATED_EDGE', 'PG_DEDICATED_EDGE'])) SELECT pattern, count(*) AS mappings FROM x GROUP BY 1")
def detected_patterns(spark, d):
    """How the entities and relationships inferred from the rows are stored."""
    return structure.detected_patterns(q_detectors.baseline_entities(spark, d).select("style").union(q_detectors.baseline_relationships(spark, d).select("style")))


_FACTS = "v AS (SELECT 'facts' AS collection, 'p' AS field, CASE n_nationkey % 3 WHEN 0 THEN 'rdf:type' WHEN 1 THEN 'knows' ELSE 'RDF:Type' END AS value FROM nation UNION ALL SELECT 'facts', 'note', 'a' FROM nation UNION ALL SELECT 'links', 'relType', CASE WHEN c_nationkey > 10 THEN 'Type' ELSE 'near' END FROM customer UNION ALL SELECT 'moves', 'relation', o_orderstatus FROM orders)"


@query(f"WITH {_FACTS} SELECT collection, string_agg(DISTINCT value, ',' ORDER BY value) AS values FROM v WHERE field IN ('predicate', 'p', 'rel', 'relation', 'relType') AND lower(value) IN ('rdf:type', 'type', 'a', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type') GROUP BY 1")
def type_assertions(spark, d):
    """Triples made of the tables: predicates of two collections state types, a third's don't."""
    n, c, o = (star.table(spark, d, t) for t in ("nation", "customer", "orders"))
    k = F.col("n_nationkey") % 3
    parts = {"facts": n.select(F.when(k == 0, "rdf:type").when(k == 1, "knows").otherwise("RDF:Type").alias("p"), F.lit("a").alias("note")), "links": c.select(F.when(F.col("c_nationkey") > 10, "Type").otherwise("near").alias("relType")), "moves": o.select(F.col("o_orderstatus").alias("relation"))}
    return structure.type_assertions(union_all([profile.value_counts(df, df.columns).select(F.lit(name).alias("collection"), "field", "value") for name, df in parts.items()]))


_CASES = f"{q_detectors._ROLES}, k AS (SELECT 'whole' AS case_name, role, 1 AS vectors FROM r UNION ALL SELECT 'bare', role, 0 FROM r UNION ALL SELECT 'vectors', role, 1 FROM r WHERE role <> 'entity' UNION ALL SELECT 'edges', role, 1 FROM r WHERE role IN ('similarity', 'mention') UNION ALL SELECT 'one', role, 1 FROM r WHERE role = 'chunk'), s AS (SELECT case_name, max(vectors) AS v, count(DISTINCT role) AS n, bool_or(role = 'chunk') AS ch, bool_or(role = 'entity') AS en, bool_or(role IN ('similarity', 'mention')) AS ed FROM k GROUP BY 1)"


@query(f"WITH {_CASES} SELECT case_name, n >= 2 AS detected, CASE WHEN n >= 2 THEN CASE WHEN ch AND ed AND (en OR v = 1) THEN 'high' ELSE 'medium' END END AS confidence FROM s")
def retrieval_confidence(spark, d):
    """Roles of the tables and of edges made of them; vectors are what ``embeddings`` holds, or none."""
    roles = inference.retrieval_roles(q_detectors._corpus_fields(spark, d))
    vectors = star.table(spark, d, "embeddings").where("embedding is not null").limit(1).select(F.lit("embeddings").alias("collection"))
    cases = {"whole": (roles, vectors), "bare": (roles, vectors.where("false")), "vectors": (roles.where("role <> 'entity'"), vectors), "edges": (roles.where("role in ('similarity', 'mention')"), vectors), "one": (roles.where("role = 'chunk'"), vectors)}
    return union_all([structure.retrieval_confidence(r, v).select(F.lit(n).alias("case_name"), "detected", "confidence") for n, (r, v) in cases.items()])


@query(f"WITH d AS ({q_detectors.DOMAIN_SQL}) SELECT * FROM (SELECT 'found' AS case_name, domain, confidence FROM d ORDER BY confidence DESC, domain LIMIT 1) UNION ALL SELECT 'given', 'freight', 1.0::DOUBLE")
def domain_choice(spark, d):
    s = q_detectors.domain_scores(spark, d)
    case = lambda df, name: df.select(F.lit(name).alias("case_name"), "domain", "confidence")
    return case(structure.domain_choice(s, " "), "found").unionByName(case(structure.domain_choice(s, " freight "), "given"))


DECLARED = [("parts", "denormalised"), ("ghosts", "root")]


@query(f"WITH s AS ({q_detectors.SCOPES_SQL}), {values('e', 'entity, scope', DECLARED)} SELECT s.entity, coalesce(e.scope, s.scope) AS scope FROM s LEFT JOIN e ON s.entity = e.entity")
def explicit_tenant_scopes(spark, d):
    """What is declared goes before what the inferred links say."""
    return structure.explicit_scopes(q_detectors.tenant_scopes_inferred(spark, d), spark.createDataFrame(DECLARED, "entity string, scope string"))


def _model(where, balance):
    return f"SELECT 'entity' AS kind, type AS name, 'name' || CASE WHEN count({balance}) > 0 THEN ',balance' ELSE '' END AS definition, CASE WHEN type = 'Nation' THEN '{'COLLECTION' if where == 'TRUE' else 'LABEL'}' ELSE 'LABEL' END AS style FROM entities WHERE {where} GROUP BY type"


@query(f"""WITH {ENTITIES}, a AS ({_model("type <> 'Region'", "balance")}), b AS ({_model("TRUE", "CASE WHEN type <> 'Supplier' THEN balance END")}), k AS (SELECT kind, name FROM a INTERSECT SELECT kind, name FROM b)
SELECT kind, name, 'added' AS change FROM b WHERE (kind, name) NOT IN (SELECT (kind, name) FROM k) UNION ALL SELECT kind, name, 'removed' FROM a WHERE (kind, name) NOT IN (SELECT (kind, name) FROM k)
UNION ALL SELECT a.kind, a.name, 'changed' FROM a JOIN b ON a.kind = b.kind AND a.name = b.name WHERE a.definition IS DISTINCT FROM b.definition UNION ALL SELECT a.kind, a.name, 'restyled' FROM a JOIN b ON a.kind = b.kind AND a.name = b.name WHERE a.style IS DISTINCT FROM b.style""")
def model_changes(spark, d):
    """Models of two states of the rows: one type more, one with fewer fields, one stored in another way."""
    rows = star.entities(spark, d)

    def model(df, style):
        found = profile.observed_fields_by_type(df, "type").groupBy(F.col("type").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("definition"))
        return found.select(F.lit("entity").alias("kind"), "name", "definition", F.when(F.col("name") == "Nation", style).otherwise("LABEL").alias("style"))

    after = rows.withColumn("balance", F.when(F.col("type") != "Supplier", F.col("balance")))
    return structure.model_changes(model(rows.where("type <> 'Region'"), "LABEL"), model(after, "COLLECTION"))


TRUTH_E, TRUTH_R = [("Customer",), ("Nation",), ("Jar",), ("Depot",)], [("IN_REGION",), ("SUPPLIER_IN",)]


@query(f"WITH {ENTITIES}, {relationships('')}, pe AS (SELECT DISTINCT type AS n FROM entities), {values('ge', 'n', TRUTH_E)}, pr AS (SELECT DISTINCT relation AS n FROM relationships), {values('gr', 'n', TRUTH_R)}, f AS (SELECT 2.0 * (SELECT count(*) FROM pe JOIN ge USING (n)) / ((SELECT count(*) FROM pe) + (SELECT count(*) FROM ge)) AS e, 2.0 * (SELECT count(*) FROM pr JOIN gr USING (n)) / ((SELECT count(*) FROM pr) + (SELECT count(*) FROM gr)) AS r) SELECT round((e + r) / 2, 4)::DOUBLE AS overlap FROM f")
def gold_overlap(spark, d):
    """Types and relations that the rows have against those of a given model."""
    t = lambda rows: spark.createDataFrame(rows, "name string")
    types, relations = star.entities(spark, d).select(F.col("type").alias("name")).distinct(), star.relationships(spark, d).select(F.col("relation").alias("name")).distinct()
    return structure.gold_overlap(metrics.precision_recall(types, t(TRUTH_E)), metrics.precision_recall(relations, t(TRUTH_R)))


NAMED = [("entity", "sales_depots", "SalesDepot"), ("entity", "Crate", None), ("property", "_key", None), ("property", "Net_Weight", "netWeight"), ("property", "sku", None), ("relationship", "SHIPS_TO", "shipsTo"), ("relationship", "holds", None)]


@query(f"WITH {values('n', 'kind, name, proposed', NAMED)} SELECT kind, name, proposed FROM n WHERE (kind = 'entity' AND NOT regexp_full_match(name, '[A-Z][A-Za-z0-9]*')) OR (kind <> 'entity' AND NOT starts_with(name, '_') AND NOT regexp_full_match(name, '[a-z][A-Za-z0-9]*'))")
def naming_issues(spark, d):
    return structure.naming_issues(spark.createDataFrame([n[:2] for n in NAMED], "kind string, name string"))


@query("SELECT case_name, reason FROM (SELECT 'bare' AS case_name, 'no user collections' AS reason, (SELECT count(*) FROM orders WHERE o_orderkey < 0) AS n UNION ALL SELECT 'bare', 'properties of a graph could not be read', 0 UNION ALL SELECT 'whole', 'no user collections', (SELECT count(*) FROM orders)) WHERE n = 0")
def degraded_reasons(spark, d):
    """Collections are those that have rows: none, or all."""
    graphs, counts = spark.createDataFrame([("g", None), ("h", "timeout")], "graph string, error string"), star.catalog(spark, d).counts()
    bare = structure.degraded_reasons(counts.where("rows < 0"), graphs).select(F.lit("bare").alias("case_name"), "reason")
    whole = structure.degraded_reasons(counts.where("rows > 0"), graphs.where("error is null")).select(F.lit("whole").alias("case_name"), "reason")
    return bare.unionByName(whole)


_OBJECT = """'{{"name": "' || {0} || ' }} \\" {{", "in": {{"key": ' || {1} || '}}}}'"""


@query(f"SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE {_OBJECT.format('c_name', 'c_custkey')} END AS found FROM customer")
def first_json_objects(spark, d):
    """Texts around an object; every fourth has no object, every fourth one that doesn't end."""
    c = star.table(spark, d, "customer")
    made = F.concat(F.lit('{"name": "'), "c_name", F.lit(' } \\" {", "in": {"key": '), F.col("c_custkey").cast("string"), F.lit("}}"))
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("no object } in "), "c_name")).when(k == 1, F.concat(F.lit('"so: '), F.left(made, F.length(made) - 1))).when(k == 2, F.concat(F.lit('Here "it" is }\n'), made, F.lit(" and {more} }"))).otherwise(made)
    return c.select(F.col("c_custkey").alias("k"), structure.first_json_object(text).alias("found"))

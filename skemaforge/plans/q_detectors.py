"""Queries of inference rules and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.functions import naming
from skemaforge.operators import foreign_keys, inference, profile, taxonomy
from skemaforge.sources import star
from skemaforge.sources.catalog import union_all

from .q_foreign_keys import _PROBED, _ROWS, _SHAPES, _SINGLE, _VOTES
from .q_sources import COLLECTIONS, ENTITIES, GRAPH_ROWS, PLACED, relationships
from .registry import query, values


def _order_counts(spark, d):
    o = star.table(spark, d, "orders")
    counts = profile.value_counts(o, ["o_orderstatus", "o_orderpriority"]).withColumn("collection", F.lit("orders"))
    e = profile.value_counts(star.entities(spark, d), ["type"]).withColumn("collection", F.lit("entities"))
    totals = o.agg(F.count("*").alias("rows")).select(F.lit("orders").alias("collection"), "rows").unionByName(star.entities(spark, d).agg(F.count("*").alias("rows")).select(F.lit("entities").alias("collection"), "rows"))
    return counts.unionByName(e), totals


_LABEL = "length(value) <= 64 AND regexp_matches(value, '^[A-Za-z0-9_-]+$') AND regexp_matches(value, '[A-Za-z]')"
_DISC = f"""{ENTITIES}, c AS (SELECT 'orders' AS collection, 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 3
UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 3 UNION ALL SELECT 'entities', 'type', type, count(*) FROM entities GROUP BY 3),
t AS (SELECT 'orders' AS collection, count(*) AS rows FROM orders UNION ALL SELECT 'entities', count(*) FROM entities),
s AS (SELECT collection, field, count(*) AS "distinct", sum(count) AS covered, bool_and({_LABEL}) AS labels FROM c GROUP BY ALL),
p AS (SELECT s.*, row_number() OVER (PARTITION BY s.collection ORDER BY "distinct" DESC, CASE field WHEN 'type' THEN 1 ELSE 1000 END, field) AS k FROM s JOIN t ON s.collection = t.collection WHERE labels AND "distinct" BETWEEN 2 AND 32 AND covered >= 0.8 * rows),
disc AS (SELECT collection, field, "distinct" FROM p WHERE k = 1)"""


@query(f"WITH {_DISC} SELECT * FROM disc")
def discriminator_choice(spark, d):
    counts, totals = _order_counts(spark, d)
    return inference.choose_discriminator(counts, totals)


@query(f"WITH {_DISC} SELECT value AS entity, 'LABEL' AS style, disc.collection, disc.field AS type_field, value AS type_value FROM disc JOIN c ON disc.collection = c.collection AND disc.field = c.field UNION ALL SELECT 'Region', 'COLLECTION', 'region', NULL, NULL UNION ALL SELECT 'Nation', 'COLLECTION', 'nation', NULL, NULL")
def baseline_entities(spark, d):
    counts, totals = _order_counts(spark, d)
    names = spark.createDataFrame([(n,) for n in ("orders", "entities", "region", "nation")], "collection string")
    return inference.baseline_entities(names, inference.choose_discriminator(counts, totals), counts)


_EDGE_COUNTS = f"{relationships('')}, {PLACED}, c AS (SELECT 'relationships' AS collection, 'relation' AS field, relation AS value, count(*) AS count FROM relationships GROUP BY 3 UNION ALL SELECT 'placed', 'status', status, count(*) FROM placed GROUP BY 3 UNION ALL SELECT 'located', 'relation', 'IN_REGION', count(*) FROM relationships WHERE relation = 'IN_REGION' UNION ALL SELECT 'in-region', 'type', 'IN_REGION', count(*) FROM relationships WHERE relation = 'IN_REGION')"


def _edge_counts(spark, d):
    """Values of edge fields: two collections of several relations, two of one, one of which is named after it."""
    r, p = star.relationships(spark, d, shared=False), star.placed(spark, d)
    one = r.where("relation = 'IN_REGION'")
    named = [("relationships", r, "relation"), ("placed", p, "status"), ("located", one, "relation"), ("in-region", one.withColumnRenamed("relation", "type"), "type")]
    return union_all([profile.value_counts(df, [f]).select(F.lit(n).alias("collection"), "field", "value", "count") for n, df, f in named])


@query(f"WITH {_EDGE_COUNTS} SELECT collection, field, min(value) AS value FROM c GROUP BY ALL HAVING count(*) = 1 AND upper(replace(min(value), '-', '_')) <> upper(replace(collection, '-', '_'))")
def single_value_edges(spark, d):
    return inference.single_value_edges(_edge_counts(spark, d))


@query(f"""WITH {_EDGE_COUNTS}, disc AS (SELECT collection, field FROM c GROUP BY ALL HAVING count(*) > 1)
SELECT value AS relation, 'GENERIC_WITH_TYPE' AS style, c.collection, c.field AS type_field, value AS type_value FROM c JOIN disc USING (collection, field)
UNION ALL SELECT upper(replace(collection, '-', '_')), 'DEDICATED_COLLECTION', collection, NULL, NULL FROM (SELECT DISTINCT collection FROM c) WHERE collection NOT IN (SELECT collection FROM disc)""")
def baseline_relationships(spark, d):
    counts = _edge_counts(spark, d)
    disc = counts.groupBy("collection", "field").agg(F.count("*").alias("n")).where("n > 1").select("collection", "field")
    return inference.baseline_relationships(counts.select("collection").distinct(), disc, counts)


#: Collections that the tables' rows make: their names and fields.
_MADE = """made AS (SELECT c.c AS collection, k.k AS field FROM (SELECT unnest(['returnedItem', 'shippedItem', 'open_Item']) AS c) c, (SELECT unnest(['l_orderkey', 'l_partkey', 'repo']) AS k) k WHERE EXISTS (SELECT 1 FROM lineitem)
UNION ALL SELECT c.c, 'n_name' FROM (SELECT unnest(['x_Thing', 'y_Thing']) AS c) c WHERE EXISTS (SELECT 1 FROM nation) UNION ALL SELECT c.c, 'r_name' FROM (SELECT unnest(['ab', 'cb']) AS c) c WHERE EXISTS (SELECT 1 FROM region))"""


def _made_fields(spark, d):
    line, n, r = star.table(spark, d, "lineitem"), star.table(spark, d, "nation").select("n_name"), star.table(spark, d, "region").select("r_name")
    item = lambda where: line.where(where).select("l_orderkey", "l_partkey", F.col("l_linestatus").alias("repo"))
    made = {"returnedItem": item("l_returnflag = 'R'"), "shippedItem": item("l_linestatus = 'F'"), "open_Item": item("l_linestatus = 'O'"), "x_Thing": n, "y_Thing": n, "ab": r, "cb": r}
    return union_all([profile.observed_fields(df).select(F.lit(name).alias("collection"), "field") for name, df in made.items()])


@query(f"""WITH {_MADE}, sets AS (SELECT collection, list(field ORDER BY field) AS l FROM made GROUP BY 1), sizes AS (SELECT l, count(*) AS members FROM sets GROUP BY 1 HAVING count(*) >= 2),
cuts AS (SELECT collection, l, unnest(range(1, length(collection) + 1)) AS i FROM sets), suffixes AS (SELECT l, collection[i::INT:] AS suffix FROM cuts WHERE i = 1 OR regexp_matches(collection[i::INT], '[A-Z]') OR collection[i::INT - 1] IN ('_', '-')),
common AS (SELECT x.l, suffix, members, row_number() OVER (PARTITION BY x.l ORDER BY length(suffix) DESC, suffix) AS k FROM (SELECT l, suffix, count(*) AS n FROM suffixes WHERE length(suffix) >= 4 GROUP BY ALL) x JOIN sizes ON x.l = sizes.l AND n = members)
SELECT suffix AS family, members, CASE WHEN list_contains(l, 'repo') THEN 'repo' ELSE 'collection_prefix' END AS discriminator FROM common WHERE k = 1""")
def shard_families(spark, d):
    """Collections made of the tables, with the fields that their rows show: two families; short names don't count."""
    return inference.shard_families(_made_fields(spark, d))


SHARDS = [("a", False, False, True), ("b", False, True, True), ("_c", False, False, False), ("d", False, False, False), ("e", True, True, False)]


@query(f"WITH {values('s', 'collection, is_system, is_satellite, is_smart', SHARDS)} SELECT CASE WHEN is_system OR starts_with(collection, '_') THEN 'system' WHEN is_satellite THEN 'satellite' WHEN is_smart THEN 'smartgraph' ELSE 'regular' END AS kind, count(*) AS n FROM s GROUP BY 1")
def sharding_kinds(spark, d):
    s = spark.createDataFrame(SHARDS, "collection string, is_system boolean, is_satellite boolean, is_smart boolean")
    return inference.sharding_kinds(s).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'DisjointSmartGraph' AS style UNION ALL SELECT 'SatelliteGraph' UNION ALL SELECT 'OneShard' UNION ALL SELECT 'Sharded'")
def sharding_styles(spark, d):
    g = lambda rows: spark.createDataFrame(rows, "graph string, is_smart boolean, is_disjoint boolean, is_satellite boolean")
    smart, sat = g([("a", True, True, False), ("b", False, False, True)]), g([("a", False, False, True)])
    no = F.lit(False)
    return inference.sharding_style(smart, no).union(inference.sharding_style(sat, no)).union(inference.sharding_style(sat, F.lit(True))).union(inference.sharding_style(g([]), no))


_TENANT_FIELDS = "f AS (SELECT DISTINCT * FROM (SELECT unnest(['accounts', 'bills', 'mails']) AS collection, unnest(['accountId', 'ACCOUNTID', 'account_id']) AS field UNION ALL SELECT unnest(['accounts', 'bills', 'goods']), unnest(['orgId', 'orgid', 'name'])) WHERE EXISTS (SELECT 1 FROM orders))"


@query(f"WITH {_TENANT_FIELDS} SELECT lower(field) AS field, count(DISTINCT collection) AS collections, count(DISTINCT collection) / (SELECT count(DISTINCT collection) FROM f) AS share FROM f WHERE lower(field) IN ('tenantid', 'tenant_id', 'tenant', 'orgid', 'org_id', 'organizationid', 'accountid', 'account_id', 'customerid', 'workspaceid') GROUP BY 1 HAVING count(DISTINCT collection) / (SELECT count(DISTINCT collection) FROM f) >= 0.5")
def tenant_fields(spark, d):
    """Fields with a value in collections made of customers, orders, events and parts."""
    c, o, e, p = (star.table(spark, d, t) for t in ("customer", "orders", "events", "part"))
    made = {"accounts": c.select(F.col("c_custkey").alias("accountId"), F.col("c_nationkey").alias("orgId")), "bills": o.select(F.col("o_custkey").alias("ACCOUNTID"), F.col("o_orderkey").alias("orgid")), "mails": e.select(F.col("user_id").alias("account_id")), "goods": p.select(F.col("p_name").alias("name"))}
    return inference.tenant_fields(union_all([profile.observed_fields(df).select(F.lit(n).alias("collection"), "field") for n, df in made.items()]))


_TENANT_NAMES = "c AS (SELECT DISTINCT 'Orders__' || o_orderstatus || '1' AS collection FROM orders UNION SELECT DISTINCT lower(r_name) || '_Stock' FROM region UNION SELECT DISTINCT lower(c_mktsegment) || '-2_Staff' FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT DISTINCT n_name FROM nation)"
_BASES = r"""s AS (SELECT CASE WHEN regexp_matches(collection, '^[A-Za-z][A-Za-z0-9]+__[A-Za-z0-9][A-Za-z0-9_-]+$') THEN regexp_extract(collection, '^([A-Za-z][A-Za-z0-9]+)__', 1) ELSE regexp_extract(collection, '^[A-Za-z0-9][A-Za-z0-9_-]+?_([A-Z][A-Za-z0-9]+)$', 1) END AS base,
CASE WHEN regexp_matches(collection, '^[A-Za-z][A-Za-z0-9]+__[A-Za-z0-9][A-Za-z0-9_-]+$') THEN regexp_extract(collection, '__([A-Za-z0-9][A-Za-z0-9_-]+)$', 1) ELSE regexp_extract(collection, '^([A-Za-z0-9][A-Za-z0-9_-]+?)_[A-Z][A-Za-z0-9]+$', 1) END AS tenant FROM c)"""


@query(f"WITH {_TENANT_NAMES}, {_BASES} SELECT base, count(DISTINCT tenant) AS tenants FROM s WHERE base <> '' GROUP BY 1 HAVING count(DISTINCT tenant) >= 2")
def collections_per_tenant(spark, d):
    """Names made of the tables' values: of a kind and a tenant in either order, one kind of a single tenant, and plain ones."""
    o, r, c, n = (star.table(spark, d, t) for t in ("orders", "region", "customer", "nation"))
    names = [o.select(F.concat(F.lit("Orders__"), "o_orderstatus", F.lit("1")).alias("collection")), r.select(F.concat(F.lower("r_name"), F.lit("_Stock"))), c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lower("c_mktsegment"), F.lit("-2_Staff"))), n.select("n_name")]
    return inference.collections_per_tenant(union_all([x.toDF("collection") for x in names]).distinct())


_VERDICT = "SELECT * FROM (VALUES ('a', 'disjoint_smartgraph', TRUE), ('b', 'shard_key', TRUE), ('c', 'discriminator_field', FALSE), ('d', 'collection_per_tenant', TRUE), ('e', 'unknown_single_db', TRUE), ('f', 'none', FALSE)) t(case_name, style, enforced)"


@query(_VERDICT)
def tenancy_verdicts(spark, d):
    """One case a signal; each also has the signals of all later cases."""
    order, out = "abcdef", []
    for k, case in enumerate(order):
        style = spark.createDataFrame([("DisjointSmartGraph" if k < 1 else "Sharded",)], "style string")
        keys = ["tenantId"] if k < 2 else ["_key"]
        names = ["Stock__north", "Stock__south"] if k < 4 else ["stock", "staff"]
        collections = spark.createDataFrame([(n, keys) for n in names], "collection string, shard_keys array<string>")
        fields = spark.createDataFrame([(n, "ORG_ID" if k < 3 else "name") for n in names], "collection string, field string")
        out.append(inference.tenancy_verdict(collections, fields, style, "tenant_7" if k < 5 else "main").select(F.lit(case).alias("case_name"), "style", "enforced"))
    return union_all(out)


_ENDS = f"{relationships('')}, {PLACED}, e AS (SELECT DISTINCT split_part(_from, '/', 1) AS a, split_part(_to, '/', 1) AS b FROM (SELECT _from, _to FROM relationships UNION ALL SELECT _from, _to FROM placed))"
_NEAR = "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(entity, hops) AS (SELECT 'orders', 0 UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.entity WHERE r.hops < 2), near AS (SELECT entity, min(hops)::INTEGER AS hops FROM r GROUP BY entity)"


def _end_links(spark, d):
    """from_entity, to_entity: which collections the edges link."""
    return union_all([profile.endpoints(star.relationships(spark, d, shared=False)), profile.endpoints(star.placed(spark, d))]).toDF("from_entity", "to_entity")


@query(f"WITH RECURSIVE {_ENDS}, {_NEAR} SELECT entity, hops FROM near")
def tenant_reachable(spark, d):
    """What is at most two links from the orders."""
    return inference.reachable(_end_links(spark, d), spark.createDataFrame([("orders",)], "entity string"), hops=2)


@query(f"WITH RECURSIVE {_ENDS}, {_NEAR}, c AS (SELECT table_name AS entity, max((column_name LIKE '%_suppkey')::INT) AS own FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'orders', 'part', 'region', 'supplier') GROUP BY 1) SELECT c.entity, CASE WHEN c.entity = 'orders' THEN 'root' WHEN own = 1 THEN 'denormalised' WHEN hops IS NOT NULL THEN 'reachable' ELSE 'global' END AS scope FROM c LEFT JOIN near USING (entity)")
def tenant_scopes(spark, d):
    """Scopes by what the edges link and which fields have values, with the orders as the tenant."""
    parts = [profile.observed_fields(star.table(spark, d, t)).select(F.lit(t).alias("entity"), "field") for t in ("customer", "nation", "orders", "part", "region", "supplier")]
    entities = union_all(parts).groupBy("entity").agg(F.collect_list("field").alias("properties"))
    return inference.tenant_scope(entities, _end_links(spark, d), roots=("Tenant", "orders"), pattern="_suppkey$", hops=2)


_REACH = """links AS (SELECT DISTINCT collection AS a, target AS b FROM ranked), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(entity, hops) AS (SELECT 'customers', 0 UNION SELECT w.b, reach.hops + 1 FROM reach JOIN both_ways w ON w.a = reach.entity WHERE reach.hops < 5), near AS (SELECT entity, min(hops)::INTEGER AS hops FROM reach GROUP BY 1)"""
_INFERRED = f"{_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE}, {_PROBED}, {_REACH}"


def _inferred_links(spark, d):
    found = foreign_keys.infer(star.relational(spark, d))[0].select(F.col("collection").alias("from_entity"), F.col("target").alias("to_entity")).distinct()
    return spark.createDataFrame(found.collect(), found.schema)  # metadata: a row a link


_COUNTS_OF = "counts AS (SELECT 'regions' AS entity, count(*) AS rows FROM region UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'suppliers', count(*) FROM supplier UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'purchases', count(*) FROM orders UNION ALL SELECT 'items', count(*) FROM lineitem UNION ALL SELECT 'visits', count(*) FROM events)"


def _with_rows(spark, d, found):
    return found.join(star.relational(spark, d).counts().withColumnRenamed("collection", "entity"), "entity")


@query(f"WITH RECURSIVE {_INFERRED}, {_COUNTS_OF} SELECT entity, hops, rows FROM near JOIN counts USING (entity)")
def tenant_reach_inferred(spark, d):
    """What links found by values lead to from a tenant, here the customers, and how many rows are there."""
    return _with_rows(spark, d, inference.reachable(_inferred_links(spark, d), spark.createDataFrame([("customers",)], "entity string")))


SCOPES_SQL = f"WITH RECURSIVE {_INFERRED}, {_COUNTS_OF}, e AS (SELECT DISTINCT collection AS entity, max((lower(field) = 'customerid')::INT) OVER (PARTITION BY collection) AS own FROM f) SELECT e.entity, CASE WHEN e.entity = 'customers' THEN 'root' WHEN own = 1 THEN 'denormalised' WHEN hops IS NOT NULL THEN 'reachable' ELSE 'global' END AS scope, rows FROM e LEFT JOIN near USING (entity) JOIN counts USING (entity)"


@query(SCOPES_SQL)
def tenant_scopes_inferred(spark, d):
    cat = star.relational(spark, d)
    entities = cat.fields().groupBy(F.col("collection").alias("entity")).agg(F.collect_list("field").alias("properties"))
    return _with_rows(spark, d, inference.tenant_scope(entities, _inferred_links(spark, d), roots=("Tenant", "customers"), pattern="^customer[_-]?id$"))


@query("SELECT 'nation_id' AS field, 1::BIGINT AS collections, 1 / 8 AS share, count(*) AS rows, count(c_nationkey) AS present, count(DISTINCT c_nationkey) AS tenants FROM customer UNION ALL SELECT 'nationid', 1, 1 / 8, count(*), count(s_nationkey), count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'name', 5, 5 / 8, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part), (SELECT count(r_name) FROM region) + (SELECT count(n_name) FROM nation) + (SELECT count(c_name) FROM customer) + (SELECT count(s_name) FROM supplier) + (SELECT count(p_name) FROM part), NULL")
def tenant_field_coverage(spark, d):
    """Which collections carry a field and how many values it has in all, from sketches; the number of names (beyond what a sketch tells exactly) is left out."""
    out = inference.tenant_coverage(star.relational(spark, d), ("nation_id", "nationid", "name"))
    return out.withColumn("tenants", F.when(F.col("field") != "name", F.col("tenants")))


@query("SELECT * FROM (VALUES ('follows', 'both', 'tier,type,validFrom'), ('likes', 'in-edge', 'at')) t(collection, access, extra)")
def vertex_centric_indexes(spark, d):
    rows = [("follows", "persistent", ["_from", "type", "validFrom"]), ("follows", "persistent", ["_to", "type", "tier"]), ("likes", "persistent", ["_to", "at"]), ("likes", "hash", ["_from", "x"]), ("rates", "persistent", ["_from"])]
    return inference.vertex_centric(spark.createDataFrame(rows, "collection string, type string, fields array<string>"))


_SHARED_FIELDS = "e AS (SELECT 'sold' AS collection, column_name AS field FROM duckdb_columns() WHERE table_name = 'orders' AND column_name IN ('o_custkey', 'o_totalprice', 'o_orderpriority') UNION SELECT 'sold', '_from' UNION SELECT 'lives_in', 'c_mktsegment'), v AS (SELECT table_name AS collection, column_name AS field FROM duckdb_columns() WHERE table_name IN ('orders', 'customer', 'part') UNION SELECT 'orders', '_from')"


@query(f"WITH {_SHARED_FIELDS} SELECT e.collection AS edge, v.collection AS vertex, e.field FROM e JOIN v ON e.field = v.field WHERE e.field NOT IN ('_key', '_id', '_rev', '_from', '_to')")
def denormalised_fields(spark, d):
    """Fields with a value both in edges made of the orders and customers and in the tables themselves."""
    o, c = star.table(spark, d, "orders"), star.table(spark, d, "customer")
    of = lambda n, df: profile.observed_fields(df, exclude=()).select(F.lit(n).alias("collection"), "field")
    edges = of("sold", o.select(F.col("o_custkey").cast("string").alias("_from"), "o_custkey", "o_totalprice", "o_orderpriority")).union(of("lives_in", c.select("c_mktsegment")))
    vertices = of("orders", o.withColumn("_from", F.col("o_orderkey"))).union(of("customer", c)).union(of("part", star.table(spark, d, "part")))
    return inference.denormalised_fields(edges, vertices)


_TRIPLES = "f AS (SELECT 'my_triples' AS collection, 'r_name' AS field UNION ALL SELECT 'facts', unnest(['Subject', 'predicate', 'object', 'note']) UNION ALL SELECT 'tiny', unnest(['s', 'p']) UNION ALL SELECT 'spo', 'n_name' UNION ALL SELECT 'users', unnest(['subject', 'object']))"


@query(f"WITH {_TRIPLES}, g AS (SELECT collection, list(lower(field)) AS l FROM f GROUP BY 1) SELECT collection, CASE WHEN regexp_matches(collection, '(?i)^_?triples?$|_triples?$|^s?p?o?_?quads?$|^quads?$|^statements?$|^spo$') THEN 'name' ELSE 'fields' END AS reason FROM g WHERE regexp_matches(collection, '(?i)^_?triples?$|_triples?$|^s?p?o?_?quads?$|^quads?$|^statements?$|^spo$') OR list_has_all(l, ['subject', 'predicate', 'object']) OR list_has_all(l, ['s', 'p', 'o'])")
def triple_collections(spark, d):
    """Collections made of nations and regions, by name or by the fields that have values."""
    n, r = star.table(spark, d, "nation"), star.table(spark, d, "region")
    triple = n.select(F.col("n_nationkey").alias("Subject"), F.lit("in").alias("predicate"), F.col("n_regionkey").alias("object"), F.col("n_name").alias("note"))
    made = {"my_triples": r.select("r_name"), "facts": triple, "tiny": n.select(F.col("n_name").alias("s"), F.col("n_regionkey").alias("p"), F.lit(None).cast("string").alias("o")), "spo": n.select("n_name"), "users": triple.select(F.col("Subject").alias("subject"), "object")}
    return inference.triple_collections(union_all([profile.observed_fields(df).select(F.lit(name).alias("collection"), "field") for name, df in made.items()]))


_CORPUS = ("benchmark", "conversations", "customer", "documents", "embeddings", "nation", "pages")
#: Edge collections that the tables' rows make: turns of one conversation in a row, near vectors, regions' mentions.
_EDGE_FIELDS = "SELECT 'next_turns' AS collection, 'edge' AS kind, 'turn' AS field FROM conversations UNION SELECT 'vectors', 'edge', 'distance' FROM embeddings UNION SELECT 'mentions_of_nations', 'edge', 'n_name' FROM nation"
_FIELDS_OF = f"f AS (SELECT table_name AS collection, 'document' AS kind, column_name AS field FROM duckdb_columns() WHERE table_name IN {_CORPUS} UNION {_EDGE_FIELDS})"
_ROLES = f"""{_FIELDS_OF}, g AS (SELECT collection, kind, list(lower(field)) AS l FROM f GROUP BY ALL), r AS (SELECT * FROM (SELECT collection, CASE WHEN kind = 'document' THEN CASE
WHEN list_has_any(l, ['embedding', 'embeddings', 'vector', 'vectors', 'embedding_vector', 'dense_vector']) OR (regexp_matches(collection, '(?i)(chunks?|passages?|embeddings?)$|^text_?units?$') AND list_has_any(l, ['text', 'content', 'body', 'passage', 'chunk', 'chunk_text', 'page_content', 'document'])) THEN 'chunk'
WHEN regexp_matches(collection, '(?i)^entit(y|ies)$|_entit(y|ies)$|^nodes?$|^concepts?$') OR (list_contains(l, 'name') AND list_has_any(l, ['type', 'description', 'entity_type', 'category'])) THEN 'entity' END
WHEN regexp_matches(collection, '(?i)similar|^knn$|neighbou?rs?$|related') OR list_has_any(l, ['score', 'similarity', 'distance', 'cosine', 'weight']) THEN 'similarity' WHEN regexp_matches(collection, '(?i)mention|has_?entit|refers?_?to|appears_?in|contains_?entit') THEN 'mention' END AS role FROM g) WHERE role IS NOT NULL)"""


def _corpus_fields(spark, d):
    """collection, kind, field: what the tables' rows hold."""
    t = lambda n: star.table(spark, d, n)
    edges = {"next_turns": t("conversations").select("turn"), "vectors": t("embeddings").select(F.col("label").alias("distance")), "mentions_of_nations": t("nation").select("n_name")}
    parts = [profile.observed_fields(t(n)).select(F.lit(n).alias("collection"), F.lit("document").alias("kind"), "field") for n in _CORPUS]
    return union_all([*parts, *(profile.observed_fields(df).select(F.lit(n).alias("collection"), F.lit("edge").alias("kind"), "field") for n, df in edges.items())])


@query(f"WITH {_ROLES} SELECT * FROM r")
def retrieval_graph_roles(spark, d):
    return inference.retrieval_roles(_corpus_fields(spark, d))


@query(f"WITH {_ROLES} SELECT count(DISTINCT role) AS categories, count(DISTINCT role) >= 2 AS detected FROM r")
def retrieval_graph_gate(spark, d):
    return inference.is_retrieval_graph(inference.retrieval_roles(_corpus_fields(spark, d)))


@query(f"WITH {values('g', 'graph, edge_collection, side, collection', GRAPH_ROWS)}, {_ENDS}, c AS (SELECT a AS collection FROM e UNION SELECT b FROM e UNION SELECT 'events' WHERE EXISTS (SELECT 1 FROM events)) SELECT c.collection, coalesce(string_agg(DISTINCT graph, ',' ORDER BY graph), '') AS graphs FROM c LEFT JOIN g ON c.collection = g.collection GROUP BY 1")
def graph_membership(spark, d):
    """Graphs of the collections that edges lead to, and of one that has rows and no edge."""
    ends = _end_links(spark, d).select(F.explode(F.array("from_entity", "to_entity")).alias("collection"))
    alone = star.table(spark, d, "events").limit(1).select(F.lit("events").alias("collection"))
    return inference.graph_membership(star.catalog(spark, d).graph_table(), ends.union(alone).distinct())


SUFFIXES = [("_Documents",), ("_Chunks",), ("_Sub_Chunks",), ("_Entities",)]
_SUFFIXED = "c AS (SELECT DISTINCT lower(c_mktsegment) || '_Documents' AS collection FROM customer UNION SELECT DISTINCT lower(c_mktsegment) || '_Sub_Chunks' FROM customer UNION SELECT DISTINCT r_name || '_Chunks' FROM region UNION SELECT DISTINCT n_name FROM nation)"


@query(f"WITH {_SUFFIXED}, {values('s', 'suffix', SUFFIXES)} SELECT collection, arg_max(suffix, length(suffix)) AS suffix FROM c JOIN s ON ends_with(collection, suffix) GROUP BY 1")
def product_suffixes(spark, d):
    c, r, n = (star.table(spark, d, t) for t in ("customer", "region", "nation"))
    low = F.lower("c_mktsegment")
    names = [c.select(F.concat(low, F.lit("_Documents"))), c.select(F.concat(low, F.lit("_Sub_Chunks"))), r.select(F.concat("r_name", F.lit("_Chunks"))), n.select("n_name")]
    return inference.product_suffixes(union_all([x.toDF("collection") for x in names]).distinct(), spark.createDataFrame(SUFFIXES, "suffix string"))


_STAR = ("customer", "nation", "orders", "part", "region", "supplier")
VOCABULARY = [("shop", w) for w in ("customer", "orders", "supplier", "part", "price", "cart", "building", "mktsegment")] + [("film", w) for w in ("movie", "actor", "director", "region", "title", "rating", "roles", "film")] + [("world", w) for w in ("region", "nation", "asia", "europe", "city")]


DOMAIN_SQL = f"WITH {values('v', 'domain, keyword', VOCABULARY)}, w AS (SELECT DISTINCT table_name AS w FROM duckdb_columns() WHERE table_name IN {_STAR} UNION SELECT column_name FROM duckdb_columns() WHERE table_name IN {_STAR} UNION SELECT c_mktsegment FROM customer UNION SELECT r_name FROM region), s AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(w), '[-_]'), lambda x: x <> '')) AS t FROM w), m AS (SELECT domain, count(t) AS matched, count(*) AS keywords FROM v LEFT JOIN s ON keyword = t GROUP BY 1) SELECT domain, matched, keywords, round(least(2 * (matched / keywords), 1.0), 2)::DOUBLE AS confidence FROM m WHERE matched / keywords >= 0.15"


@query(DOMAIN_SQL)
def domain_scores(spark, d):
    """Signals are the names of tables, their observed fields, and values of label-like fields."""
    fields = union_all([profile.observed_fields(star.table(spark, d, t)).select(F.explode(F.array(F.lit(t), "field")).alias("name")) for t in _STAR])
    labels = star.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).union(star.table(spark, d, "region").select("r_name"))
    signals = fields.union(labels).select(F.explode(naming.domain_tokens(F.col("name"))).alias("token")).distinct()
    return inference.domain_scores(signals, spark.createDataFrame(VOCABULARY, "domain string, keyword string"))


GIVEN, BASE = [("Customer", "customer"), ("Ghost", "ghosts")], [("Customer2", "customer"), ("Part", "part"), ("Region", "region")]


@query(f"WITH {values('g', 'entity, collection', GIVEN)}, {values('b', 'entity, collection', BASE)}, {relationships('')}, c AS (SELECT DISTINCT split_part(unnest([_from, _to]), '/', 1) AS collection FROM relationships), k AS (SELECT * FROM g WHERE collection IN (SELECT collection FROM c)) SELECT entity, collection, 'given' AS source FROM k UNION ALL SELECT entity, collection, 'baseline' FROM b WHERE collection NOT IN (SELECT collection FROM k)")
def reconciled_entities(spark, d):
    """Known are the collections that edges lead to."""
    s = "entity string, collection string"
    ends = profile.endpoints(star.relationships(spark, d, shared=False)).select(F.explode(F.array("from_collection", "to_collection")).alias("collection")).distinct()
    return inference.reconciled(spark.createDataFrame(GIVEN, s), spark.createDataFrame(BASE, s), ends).select("entity", "collection", "source")


PRIOR = [("Region", "2020-01-01"), ("Ghost", "2021-01-01"), ("Nation", None)]


@query(f"WITH {ENTITIES}, n AS (SELECT DISTINCT type AS name FROM entities), {values('p', 'name, first_seen', PRIOR)} SELECT n.name, coalesce(first_seen, '2024-05-05') AS first_seen, '2024-05-05' AS last_validated FROM n LEFT JOIN p ON n.name = p.name")
def provenance_carried(spark, d):
    now = star.entities(spark, d).select(F.col("type").alias("name")).distinct()
    return inference.carried_forward(now, spark.createDataFrame(PRIOR, "name string, first_seen string"), "2024-05-05")


_NUMBERED = "v AS (SELECT c_mktsegment AS value FROM customer UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation), k AS (SELECT value, '<redacted>:' || (row_number() OVER (ORDER BY value) - 1) AS token FROM v)"


def _values(spark, d):
    c, n = star.table(spark, d, "customer"), star.table(spark, d, "nation")
    return union_all([c.select(F.col("c_mktsegment").alias("value")), c.select(F.col("c_name").alias("value")), n.select(F.col("n_name").alias("value"))])


def _tokens(spark, d):
    return inference.redaction_tokens(_values(spark, d))


@query(f"WITH {_NUMBERED}, x AS (SELECT c_mktsegment AS value FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation) SELECT value, token, count(*) AS n FROM k JOIN x USING (value) GROUP BY ALL")
def redaction_tokens(spark, d):
    """Tokens numbered in order of all values, by ranges; and how often each value occurs."""
    return _tokens(spark, d).join(_values(spark, d), "value").groupBy("value", "token").agg(F.count("*").alias("n"))


@query(f"WITH {_NUMBERED} SELECT k.token AS masked, c_mktsegment AS shown, count(*) AS n FROM customer JOIN k ON value = c_mktsegment GROUP BY ALL")
def redacted_and_unmasked(spark, d):
    c, tokens = star.table(spark, d, "customer").select(F.col("c_mktsegment").alias("masked")), _tokens(spark, d)
    hidden = inference.masked(c, ["masked"], tokens).select("masked", F.col("masked").alias("shown"))
    return inference.unmasked(hidden, ["shown"], tokens).groupBy("masked", "shown").agg(F.count("*").alias("n"))


_KEY = b"a key of the tests"
_PAD = {b: bytes(x ^ b for x in _KEY.ljust(64, b"\0")).hex() for b in (0x36, 0x5C)}


@query(f"SELECT '<redacted>:' || sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode(c_mktsegment)))) AS segment, '<redacted>:' || sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode(c_nationkey::VARCHAR)))) AS nation, count(*) AS n FROM customer GROUP BY ALL")
def redaction_keyed(spark, d):
    """Tokens under a key: equal in every table, and nobody without the key can tell which value is behind one."""
    c = star.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return inference.redacted(c, ["segment", "nation"], _KEY).groupBy("segment", "nation").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS field, (SELECT count(*) FROM customer) AS present UNION ALL SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']), (SELECT count(*) FROM nation)) SELECT field, 'redacted_field_' || (row_number() OVER (ORDER BY field) - 1) AS token, present FROM f")
def redaction_field_names(spark, d):
    """Tokens for fields that have a value, numbered in order."""
    seen = union_all([profile.observed_fields(star.table(spark, d, t)) for t in ("customer", "nation")])
    return inference.field_tokens(seen).join(seen, "field")


ASKED = [("label", "Nation"), ("label", "Ghost"), ("type", "IN_REGION"), ("type", "Nation")]


@query(f"WITH {values('a', 'kind, name', ASKED)}, {ENTITIES}, {relationships('entities/')} SELECT * FROM a EXCEPT (SELECT 'label', type FROM entities UNION SELECT 'type', relation FROM relationships)")
def unknown_pattern_parts(spark, d):
    """Labels and types of a pattern that no row has."""
    known = star.entities(spark, d).select(F.lit("label").alias("kind"), F.col("type").alias("name")).union(star.relationships(spark, d).select(F.lit("type"), "relation")).distinct()
    return inference.unknown_pattern_parts(spark.createDataFrame(ASKED, "kind string, name string"), known)


_INCIDENCE = f"""f AS (SELECT table_name AS entity, regexp_replace(column_name, '^[a-z]+_', '') AS property FROM duckdb_columns() WHERE table_name IN {_STAR}), e AS (SELECT entity, (1 << (row_number() OVER (ORDER BY entity) - 1)::INT) AS bit FROM (SELECT DISTINCT entity FROM f)),
m AS (SELECT property, sum(bit)::BIGINT AS mask FROM f JOIN e USING (entity) GROUP BY 1), c(x) AS (SELECT DISTINCT mask FROM m UNION SELECT c.x & m.mask FROM c, m), counts AS (SELECT 'customer' AS entity, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier)"""


def _covering(found, counts):
    """Concepts as text with the number of rows that their members have. counts: entity, n."""
    rows = found.select(F.array_join("extent", ",").alias("extent"), F.explode("extent").alias("entity")).join(counts, "entity").groupBy("extent").agg(F.sum("n").alias("rows"))
    return taxonomy.joined(found).join(rows, "extent")


@query(f"""WITH RECURSIVE {_INCIDENCE}, s AS (SELECT x FROM c WHERE bit_count(x) >= 2), p AS (SELECT x, property, string_agg(entity, '+' ORDER BY entity) AS present FROM s, m, e WHERE mask & x > 0 AND mask & x <> x AND mask & x & bit > 0 GROUP BY ALL)
SELECT (SELECT string_agg(entity, ',' ORDER BY entity) FROM e WHERE bit & s.x > 0) AS extent, (SELECT string_agg(property, ',' ORDER BY property) FROM m WHERE mask & s.x = s.x) AS intent, (SELECT coalesce(string_agg(property || ':' || present, ',' ORDER BY property), '') FROM p WHERE p.x = s.x) AS partial, (SELECT sum(n)::BIGINT FROM e JOIN counts USING (entity) WHERE bit & s.x > 0) AS rows FROM s""")
def taxonomy_concepts(spark, d):
    """Groups of tables that share properties: fields with a value in some row, without the tables' prefixes."""
    fields = union_all([profile.observed_fields(star.table(spark, d, t)).select(F.lit(t).alias("entity"), F.regexp_replace("field", "^[a-z]+_", "").alias("property")) for t in _STAR])
    counts = union_all([star.table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("entity"), "n") for t in _STAR])
    return _covering(taxonomy.concepts(fields), counts)


@query(f"WITH {ENTITIES}, f AS (SELECT DISTINCT type AS entity, 'name' AS property FROM entities UNION SELECT DISTINCT type, 'balance' FROM entities WHERE balance IS NOT NULL) SELECT string_agg(entity, ',' ORDER BY entity) AS extent, CASE WHEN count(*) = 2 THEN 'balance,name' ELSE 'name' END AS intent, CASE WHEN count(*) = 2 THEN '' ELSE 'balance:Customer+Supplier' END AS partial, sum(n)::BIGINT AS rows FROM (SELECT entity, property FROM f WHERE entity <> 'Region') JOIN (SELECT type AS entity, count(*) AS n FROM entities GROUP BY 1) USING (entity) GROUP BY property")
def taxonomy_of_labels(spark, d):
    """Labels of a shared collection, one of which is left out as a member of a family."""
    fields = profile.observed_fields_by_type(star.entities(spark, d), "type").select(F.col("type").alias("entity"), F.col("field").alias("property"))
    return _covering(taxonomy.concepts(fields, without=("Region",)), star.entities(spark, d).groupBy(F.col("type").alias("entity")).agg(F.count("*").alias("n")))


_LABELS = f"{ENTITIES}, e AS (SELECT DISTINCT type AS entity, 'LABEL' AS style, 'entities' AS collection FROM entities UNION SELECT DISTINCT o_orderstatus, 'LABEL', 'orders' FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'Thing', 'COLLECTION', 'entities' UNION SELECT 'Order', 'COLLECTION', 'orders')"


@query(f"WITH {_LABELS}, m AS (SELECT collection FROM e WHERE style = 'LABEL' GROUP BY 1 HAVING count(*) >= 2) SELECT l.entity AS child, p.entity AS parent FROM e l JOIN m ON l.collection = m.collection JOIN e p ON p.collection = l.collection AND p.style = 'COLLECTION' WHERE l.style = 'LABEL'")
def taxonomy_by_discriminator(spark, d):
    """Labels that rows have go under their collection's entity, where there are several."""
    e = star.entities(spark, d).select(F.col("type").alias("entity"), F.lit("LABEL").alias("style"), F.lit("entities").alias("collection")).distinct()
    o = star.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderstatus", F.lit("LABEL"), F.lit("orders")).distinct()
    whole = spark.createDataFrame([("Thing", "COLLECTION", "entities"), ("Order", "COLLECTION", "orders")], "entity string, style string, collection string")
    return inference.discriminator_taxonomy(e.union(o).union(whole))

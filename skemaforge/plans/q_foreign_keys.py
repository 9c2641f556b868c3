"""Queries of foreign-key inference, over a relational layout of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.operators import foreign_keys
from skemaforge.sources import star

from .registry import query, values

FIELDS = [(c, f, kind, f == star.UNIQUE.get(c)) for c, fields in star.RELATIONAL.items() for f, kind in fields.items()]
SYSTEM = [(c, f, "string", f == "_key") for c in star.RELATIONAL for f in ("_key", "_id")]
_SHAPES = values("f", "collection, field, category, is_unique", FIELDS + SYSTEM)

#: All values that may refer or be referred to, in long form.
_ROWS = """r AS (SELECT 'regions' AS collection, 'name' AS field, r_name AS v FROM region UNION ALL SELECT 'regions', '_key', r_regionkey::VARCHAR FROM region UNION ALL SELECT 'nations', 'name', n_name FROM nation
UNION ALL SELECT 'nations', '_key', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'nations', 'regionId', n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'nations', 'region_name', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customers', '_key', c_custkey::VARCHAR FROM customer UNION ALL SELECT 'customers', '_id', 'customers/' || c_custkey FROM customer UNION ALL SELECT 'customers', 'nation_id', c_nationkey::VARCHAR FROM customer
UNION ALL SELECT 'customers', 'name', c_name FROM customer UNION ALL SELECT 'customers', 'segment', c_mktsegment FROM customer UNION ALL SELECT 'suppliers', '_key', s_suppkey::VARCHAR FROM supplier UNION ALL SELECT 'suppliers', 'name', s_name FROM supplier
UNION ALL SELECT 'suppliers', 'nationid', s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'parts', '_key', p_partkey::VARCHAR FROM part UNION ALL SELECT 'parts', 'name', p_name FROM part UNION ALL SELECT 'parts', 'region_id', (p_size + 1000)::VARCHAR FROM part
UNION ALL SELECT 'purchases', '_key', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'purchases', 'customerId', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'purchases', 'status', o_orderstatus FROM orders
UNION ALL SELECT 'items', 'purchase_id', l_orderkey::VARCHAR FROM lineitem UNION ALL SELECT 'items', 'part_key', l_partkey::VARCHAR FROM lineitem UNION ALL SELECT 'items', 'supplier_id', l_suppkey::VARCHAR FROM lineitem
UNION ALL SELECT 'visits', 'visitor', 'customers/' || user_id FROM events UNION ALL SELECT 'visits', 'kind', event_type FROM events), u AS (SELECT DISTINCT * FROM r),
sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, field ORDER BY md5(v)) AS k FROM u) WHERE k <= 50)"""
_VOTES = r"""text AS (SELECT sample.*, CASE WHEN regexp_matches(v, '^[A-Za-z0-9_\-]+/[^/\s]+$') THEN split_part(v, '/', 1) END AS target FROM sample JOIN f USING (collection, field) WHERE category = 'string' AND NOT starts_with(field, '_')),
each AS (SELECT collection, field, target, count(*) AS n FROM text GROUP BY collection, field, target), hits AS (SELECT *, sum(n) OVER (PARTITION BY collection, field) AS total FROM each),
votes AS (SELECT collection, field, target, n / total AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY collection, field ORDER BY n DESC, target) AS k FROM hits WHERE target IS NOT NULL) WHERE k = 1 AND target IN (SELECT collection FROM f))"""
#: Collection names of the layout are regular plurals.
_SINGLE = r"""low AS (SELECT *, lower(field) AS l, regexp_extract(field, '^(.*[a-z0-9])(Id|ID|Key|KEY)$', 1) AS camel FROM f WHERE NOT starts_with(field, '_')),
asked AS (SELECT *, 'name_suffix' AS method, regexp_extract(l, '^(.+)_id$', 1) AS ref, 0.75::DOUBLE AS base, NULL AS suffix FROM low WHERE regexp_matches(l, '._id$')
UNION ALL SELECT *, 'name_suffix', regexp_extract(l, '^(.+)_key$', 1), 0.75, NULL FROM low WHERE regexp_matches(l, '._key$') UNION ALL SELECT *, 'camel_suffix', lower(camel), 0.75, NULL FROM low WHERE length(camel) >= 2
UNION ALL SELECT *, 'name_suffix', regexp_extract(l, '^(.+)_([^_]{2,})$', 1), 0.6, regexp_extract(l, '^(.+)_([^_]{2,})$', 2) FROM low WHERE regexp_matches(l, '^(.+)_([^_]{2,})$') AND NOT regexp_matches(l, '_(id|key)$')
UNION ALL SELECT *, 'name_no_underscore', l[:-3], 0.45, NULL FROM low WHERE regexp_matches(l, '..id$') AND NOT ends_with(l, '_id') AND camel = '' AND l <> 'uuid'),
targets AS (SELECT collection AS target, field AS target_field, category AS target_category, CASE field WHEN '_key' THEN 0 ELSE 0.05 END::DOUBLE AS penalty, unnest([collection, collection[:-2]]) AS ref FROM f WHERE field = '_key' OR is_unique),
found AS (SELECT a.collection, a.field, category, is_unique, method, base - penalty AS base, target, target_field, target_category FROM asked a JOIN targets t ON regexp_replace(a.ref, '[^a-z0-9]', '', 'g') = t.ref AND collection <> target AND CASE WHEN suffix IS NULL THEN target_field = '_key' ELSE suffix = target_field END
UNION ALL SELECT collection, field, category, is_unique, 'id_shape', 0.6 + 0.35 * ratio, target, '_id', 'string' FROM f JOIN votes USING (collection, field)),
scored AS (SELECT *, round(CASE WHEN target_field IN ('_key', '_id') THEN base ELSE base + CASE WHEN category = target_category THEN 0.1 ELSE 0 END + CASE WHEN is_unique THEN 0.05 ELSE 0 END END, 3) AS confidence FROM found WHERE target_field IN ('_key', '_id') OR category = target_category),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, field ORDER BY confidence DESC, target, target_field) AS k FROM scored) WHERE k <= 3),
single AS (SELECT collection, [field] AS fields, target, [target_field] AS target_fields, method, confidence FROM best),
groups AS (SELECT collection, target, list(field ORDER BY field) AS fields, list(target_field ORDER BY field) AS target_fields, round(min(confidence) + 0.05, 3) AS confidence FROM best WHERE method <> 'id_shape' GROUP BY ALL HAVING count(*) > 1),
composite AS (SELECT collection, fields, target, target_fields, 'composite' AS method, confidence FROM groups), every AS (SELECT * FROM single UNION ALL SELECT * FROM composite)"""
_PROBED = """asked_pairs AS (SELECT DISTINCT collection, target, unnest(fields) AS field, unnest(target_fields) AS target_field FROM every),
ratios AS (SELECT p.collection, p.field, p.target, p.target_field, count(u.v) / count(*) AS ratio FROM asked_pairs p JOIN sample s ON s.collection = p.collection AND s.field = p.field LEFT JOIN u ON u.collection = p.target AND u.field = p.target_field AND u.v = s.v GROUP BY ALL),
parts AS (SELECT collection, fields, target, target_fields, method, confidence, unnest(fields) AS field, unnest(target_fields) AS target_field FROM every),
met AS (SELECT p.collection, fields, p.target, target_fields, method, confidence, avg(ratio) AS mean, min(ratio) AS least FROM parts p LEFT JOIN ratios r ON r.collection = p.collection AND r.field = p.field AND r.target = p.target AND r.target_field = p.target_field GROUP BY ALL),
folded AS (SELECT collection, fields, target, target_fields, method, round(least(confidence + CASE WHEN mean >= 0.9 THEN 0.15 WHEN mean >= 0.5 THEN 0.05 ELSE 0 END, 1), 3) AS confidence FROM met WHERE least IS NULL OR least > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, collection, fields, target, target_fields)::INTEGER AS rank FROM folded WHERE confidence >= 0.4)"""
_SHOWN = "collection, array_to_string(fields, ',') AS fields, target, array_to_string(target_fields, ',') AS target_fields, method, confidence::DOUBLE AS confidence"


def _shown(df, *more):
    return df.select("collection", F.array_join("fields", ",").alias("fields"), "target", F.array_join("target_fields", ",").alias("target_fields"), "method", "confidence", *more)


def _single(spark, d):
    c = star.relational(spark, d)
    return foreign_keys.single_candidates(foreign_keys.shapes(c), foreign_keys.id_shape_votes(c))


@query(f"WITH {_SHAPES} SELECT * FROM f")
def relational_shapes(spark, d):
    return foreign_keys.shapes(star.relational(spark, d))


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES} SELECT collection, field, target, ratio::DOUBLE AS ratio FROM votes")
def id_shape_votes(spark, d):
    return foreign_keys.id_shape_votes(star.relational(spark, d))


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE} SELECT {_SHOWN} FROM single")
def foreign_key_candidates(spark, d):
    return _shown(_single(spark, d))


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE} SELECT {_SHOWN} FROM composite")
def foreign_key_composites(spark, d):
    return _shown(foreign_keys.composites(_single(spark, d)))


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE}, {_PROBED} SELECT {_SHOWN}, rank FROM ranked")
def foreign_key_ranking(spark, d):
    return _shown(foreign_keys.infer(star.relational(spark, d))[0], "rank")


KNOWN = [("customers", "nations"), ("nations", "customers")]


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE}, {values('k', 'a, b', KNOWN)} SELECT {_SHOWN} FROM single WHERE (collection, target) NOT IN (SELECT (a, b) FROM k)")
def foreign_keys_not_yet_known(spark, d):
    c = star.relational(spark, d)
    known = spark.createDataFrame(KNOWN, "from_collection string, to_collection string")
    return _shown(foreign_keys.single_candidates(foreign_keys.shapes(c), foreign_keys.id_shape_votes(c), known))


ENTITIES = [(n[:-1].title(), "COLLECTION", n) for n in star.RELATIONAL if n != "suppliers"] + [("Firm", "LABEL", "suppliers")]
TAKEN = [("HAS_NATION",), ("HAS_REGION_VIA_REGION_NAME",)]
_MERGED = """m AS (SELECT r.*, a.entity AS from_entity, b.entity AS to_entity, 'HAS_' || upper(b.entity) AS name FROM ranked r JOIN e a ON a.collection = r.collection AND a.style = 'COLLECTION' JOIN e b ON b.collection = r.target AND b.style = 'COLLECTION'),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank) + (name IN (SELECT relation FROM t))::INT AS nth FROM m),
o AS (SELECT *, CASE WHEN nth > 1 THEN name || '_VIA_' || upper(fields[1]) END AS via FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY via ORDER BY rank) + (via IN (SELECT relation FROM t))::INT AS mth FROM o)"""


@query(f"WITH {_SHAPES}, {_ROWS}, {_VOTES}, {_SINGLE}, {_PROBED}, {values('e', 'entity, style, collection', ENTITIES)}, {values('t', 'relation', TAKEN)}, {_MERGED} SELECT CASE WHEN via IS NULL THEN name WHEN mth > 1 THEN via || '_' || mth ELSE via END AS relation, from_entity, to_entity, {_SHOWN} FROM p")
def foreign_keys_merged(spark, d):
    ranked, _ = foreign_keys.infer(star.relational(spark, d))
    out = foreign_keys.merged(ranked, spark.createDataFrame(ENTITIES, "entity string, style string, collection string"), spark.createDataFrame(TAKEN, "relation string"))
    return out.select("relation", "from_entity", "to_entity", "collection", F.array_join("fields", ",").alias("fields"), "target", F.array_join("target_fields", ",").alias("target_fields"), "method", "confidence")


@query("WITH v AS (SELECT 'customer/' || o_custkey AS v FROM orders UNION ALL SELECT 'plain' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'x/1'), h AS (SELECT split_part(v, '/', 1) AS prefix, count(*) AS hits FROM v WHERE regexp_matches(v, '^[A-Za-z0-9_\\-]+/[^/\\s]+$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT prefix, hits, (SELECT count(*) FROM v) AS total, hits / (SELECT count(*) FROM v) AS ratio FROM h")
def id_prefix_votes(spark, d):
    o = star.table(spark, d, "orders")
    v = star.placed(spark, d).select(F.col("_from").alias("v")).union(o.where("o_orderstatus = 'F'").select(F.lit("plain"))).union(spark.createDataFrame([("x/1",)], "v string"))
    return foreign_keys.id_prefix_votes(v, "v")


#: collection, fields, target, target fields, confidence before.
CANDIDATES = [("customers", "nation_id", "nations", "_key", 0.75), ("suppliers", "nationid", "parts", "_key", 0.45), ("parts", "region_id", "regions", "_key", 0.75), ("nations", "region_name,regionId", "regions", "name,_key", 0.6), ("items", "part_key", "suppliers", "_key", 0.75), ("purchases", "status", "regions", "name", 0.75)]


@query(f"""WITH {values('c', 'collection, fields, target, target_fields, confidence', CANDIDATES)}, {_ROWS},
p AS (SELECT *, unnest(string_split(fields, ',')) AS field, unnest(string_split(target_fields, ',')) AS target_field FROM c),
q AS (SELECT p.collection, p.field, p.target, p.target_field, count(t.v) / count(*) AS ratio FROM (SELECT DISTINCT collection, field, target, target_field FROM p) p JOIN u s ON s.collection = p.collection AND s.field = p.field LEFT JOIN u t ON t.collection = p.target AND t.field = p.target_field AND t.v = s.v GROUP BY ALL),
m AS (SELECT p.collection, fields, p.target, target_fields, confidence, avg(ratio) AS mean, min(ratio) AS least FROM p LEFT JOIN q r ON r.collection = p.collection AND r.field = p.field AND r.target = p.target AND r.target_field = p.target_field GROUP BY ALL)
SELECT collection, fields, target, round(least(confidence + CASE WHEN mean >= 0.9 THEN 0.15 WHEN mean >= 0.5 THEN 0.05 ELSE 0 END, 1), 3)::DOUBLE AS confidence FROM m WHERE least IS NULL OR least > 0""")
def foreign_key_probe_fold(spark, d):
    """Candidates after probes of all their values: contained ones, partly contained ones and vetoed ones."""
    c = spark.createDataFrame(CANDIDATES, "collection string, fields string, target string, target_fields string, confidence double").withColumns({"fields": F.split("fields", ","), "target_fields": F.split("target_fields", ","), "method": F.lit("name_suffix")})
    out = foreign_keys.with_probes(c, foreign_keys.probes(star.relational(spark, d), c, sampled=None)[0])
    return out.select("collection", F.array_join("fields", ",").alias("fields"), "target", "confidence")


KEYED = ["region", "nation", "supplier", "part", "customer"]
_KEYS = "k AS (SELECT 'region' AS c, r_regionkey AS k FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'customer', c_custkey FROM customer)"
_CONTAINED = f"{_KEYS}, n AS (SELECT c, count(*) AS n FROM k GROUP BY 1), h AS (SELECT a.c AS child, b.c AS parent, count(*) AS hits FROM k a JOIN k b ON a.k = b.k AND a.c <> b.c GROUP BY 1, 2), x AS (SELECT child, parent, hits / n AS ratio FROM h JOIN n ON c = child WHERE hits / n >= 0.99)"


@query(f"WITH {_CONTAINED} SELECT child, parent, ratio FROM x")
def key_containments(spark, d):
    return foreign_keys.key_containments(star.catalog(spark, d), KEYED, sampled=None)


@query(f"WITH {_CONTAINED}, many AS (SELECT parent FROM x GROUP BY 1 HAVING count(*) > 1), p AS (SELECT k.c AS parent, k.k, (SELECT count(*) FROM x JOIN k j ON j.c = x.child AND j.k = k.k WHERE x.parent = k.c) AS m FROM k JOIN many ON k.c = many.parent) SELECT parent, count(*) AS total, count(*) FILTER (m > 1) AS in_multiple, count(*) FILTER (m = 0) AS in_none FROM p GROUP BY 1")
def key_specialisations(spark, d):
    c = star.catalog(spark, d)
    return foreign_keys.specialisations(c, foreign_keys.key_containments(c, KEYED, sampled=None))

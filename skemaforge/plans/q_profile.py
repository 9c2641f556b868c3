"""Queries of profiling: counts, top values, fields, endpoints, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.operators import partials, profile, shapes
from skemaforge.sources import star
from skemaforge.sources.catalog import union_all

from .q_sources import COLLECTIONS, ENTITIES, relationships
from .registry import query, values

#: Candidate type fields of each collection.
CANDIDATES = {"customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type"], "part": ["p_brand", "p_type"], "nation": ["n_name"]}

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS collection, '{f}' AS field, {f}::VARCHAR AS value, count(*) AS count FROM {t} WHERE {f} IS NOT NULL GROUP BY {f}" for t, fs in CANDIDATES.items() for f in fs)


@query(_COUNTS)
def snapshot_value_counts(spark, d):
    """The flagship: every collection's candidate fields, one scan a collection."""
    return union_all([profile.value_counts(star.table(spark, d, t), fs).select(F.lit(t).alias("collection"), "field", "value", "count") for t, fs in CANDIDATES.items()])


def _line(spark, d):
    return profile.value_counts(star.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


_LINE = "c AS (SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2)"
_PART = "c AS (SELECT 'p_type' AS field, p_type AS value, count(*) AS count FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2)"
_RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value)::INTEGER AS rank FROM c)"


def _part(spark, d):
    return profile.value_counts(star.table(spark, d, "part"), ["p_type", "p_brand"])


@query(f"WITH {_LINE} SELECT * FROM c")
def value_counts(spark, d):
    return _line(spark, d)


@query(f"WITH {_LINE} SELECT field, count(*) AS \"distinct\", sum(count)::BIGINT AS rows FROM c GROUP BY field")
def distinct_totals(spark, d):
    return profile.distinct_totals(_line(spark, d))


@query(f"WITH {_PART}, {_RANK} SELECT * FROM r WHERE rank <= 20")
def top_values(spark, d):
    return profile.top_values(_part(spark, d))


@query(f"WITH {_PART}, {_RANK} SELECT * FROM r WHERE rank > 20 AND rank <= 70")
def overflow_values(spark, d):
    return profile.overflow_values(_part(spark, d))


@query(f"WITH {_PART}, f AS (SELECT * FROM c WHERE count >= 3 AND length(value) <= 64 AND regexp_matches(value, '^[A-Za-z0-9_-]+$') AND regexp_matches(value, '[A-Za-z]')), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value)::INTEGER AS rank FROM f) SELECT * FROM r WHERE rank <= 10000")
def full_label_set(spark, d):
    return profile.label_set(_part(spark, d), floor=3)


@query(f"WITH {_PART}, f AS (SELECT * FROM c WHERE count < 90), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value)::INTEGER AS rank FROM f) SELECT * FROM r WHERE rank <= 50")
def labels_below_floor(spark, d):
    return profile.below_floor(_part(spark, d), floor=90)


@query(f"WITH {_PART} SELECT field, count(*) AS \"distinct\", least(count(*), 20) AS captured, count(*) - least(count(*), 20) AS dropped, count(*) > 20 AS truncated FROM c GROUP BY field")
def type_cap_report(spark, d):
    return profile.cap_report(_part(spark, d), 20).withColumns({c: F.col(c).cast("long") for c in ("captured", "dropped")})


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= 100")
def count_floor(spark, d):
    return star.table(spark, d, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("count")).where("count >= 100")


@query(f"WITH {ENTITIES} SELECT 'type' AS field, count(type) AS present FROM entities UNION ALL SELECT 'name', count(name) FROM entities UNION ALL SELECT 'balance', count(balance) FROM entities")
def observed_fields(spark, d):
    return profile.observed_fields(star.entities(spark, d))


@query(f"WITH {ENTITIES} SELECT type, 'name' AS field, count(name) AS present FROM entities GROUP BY type UNION ALL SELECT type, 'balance', count(balance) FROM entities GROUP BY type HAVING count(balance) > 0")
def observed_fields_by_type(spark, d):
    return profile.observed_fields_by_type(star.entities(spark, d), "type")


@query(f"WITH {ENTITIES}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY _key) AS n FROM entities) WHERE n <= 10) SELECT type, 'name' AS field, count(name) AS present FROM s GROUP BY type UNION ALL SELECT type, 'balance', count(balance) FROM s GROUP BY type HAVING count(balance) > 0")
def observed_fields_sampled(spark, d):
    return profile.observed_fields_by_type(star.entities(spark, d), "type", sampled=profile.FIELD_SAMPLE)


@query("SELECT field, count(*) AS present FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field")
def observed_json_fields(spark, d):
    return profile.observed_json_fields(star.table(spark, d, "events"), "props")


@query(f"WITH {relationships('')} SELECT DISTINCT split_part(_from, '/', 1) AS from_collection, split_part(_to, '/', 1) AS to_collection FROM relationships")
def edge_endpoints(spark, d):
    return profile.endpoints(star.relationships(spark, d, shared=False))


@query(f"WITH {relationships('')} SELECT relation, split_part(_from, '/', 1) AS from_collection, split_part(_to, '/', 1) AS to_collection, count(*) AS edges FROM relationships GROUP BY ALL")
def endpoints_by_relation(spark, d):
    return profile.endpoints_by_relation(star.relationships(spark, d, shared=False), "relation")


@query(f"WITH {ENTITIES}, {relationships('entities/')} SELECT relation, f.type AS from_type, t.type AS to_type, count(*) AS edges FROM relationships r LEFT JOIN entities f ON r._from = f._id LEFT JOIN (SELECT * FROM entities WHERE type <> 'Region') t ON r._to = t._id GROUP BY ALL")
def endpoint_types(spark, d):
    """Regions are left out, so that some edges dangle."""
    vertices = star.entities(spark, d).where("type <> 'Region'")
    return profile.endpoint_types(star.relationships(spark, d), vertices, "relation", "type")


_BOUNDED = """c AS (SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'row', l_orderkey || '-' || l_linenumber, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'skewed', CASE WHEN l_orderkey % 3 = 0 THEN 'most' ELSE l_orderkey::VARCHAR END, count(*) FROM lineitem GROUP BY 2),
s AS (SELECT *, count(*) OVER (PARTITION BY field) AS n, sum(count) OVER (PARTITION BY field) AS rows FROM c)"""


@query(f"WITH {_BOUNDED} SELECT field, value, count FROM s WHERE n <= 250 OR count > 7.0 / 16384 * rows")
def heavy_value_counts(spark, d):
    """All values of label-like fields; of a unique field none, of a skewed one its heavy value: the sketch tells which can be frequent, and they are counted again."""
    line = star.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), F.when(F.col("l_orderkey") % 3 == 0, "most").otherwise(F.col("l_orderkey").cast("string")).alias("skewed"))
    return profile.bounded_counts(line, line.columns, cap=250)


@query("WITH c AS (SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2) SELECT field, value, count FROM c")
def merged_value_counts(spark, d):
    """Counts of each month of shipping, merged."""
    return partials.merged_values(partials.partial_values(star.table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], F.date_trunc("month", "l_shipdate")))


@query("SELECT 'l_returnflag' AS field, count(*) AS rows, count(l_returnflag) AS present, count(DISTINCT l_returnflag) AS \"distinct\" FROM lineitem UNION ALL SELECT 'l_linenumber', count(*), count(l_linenumber), count(DISTINCT l_linenumber) FROM lineitem UNION ALL SELECT 'big', count(*), count(*) FILTER (l_quantity > 40), count(DISTINCT l_quantity) FILTER (l_quantity > 40) FROM lineitem")
def merged_statistics(spark, d):
    """Rows, values and distinct values (of sketches small enough to be exact) of each month of shipping, merged."""
    line = star.table(spark, d, "lineitem").withColumn("big", F.when(F.col("l_quantity") > 40, F.col("l_quantity")))
    return partials.merged_stats(partials.partial_stats(line, ["l_returnflag", "l_linenumber", "big"], F.date_trunc("month", "l_shipdate")))


def _documents(spark, d):
    """Events and turns of conversations as documents without a schema: nested and dotted names, nulls, one field of several types."""
    e, c = star.table(spark, d, "events"), star.table(spark, d, "conversations")
    detail = F.struct(F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("user.id"), F.parse_json("props").alias("props"))
    events = e.select(F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("event_id") % 2 == 0).alias("even"), detail.alias("detail"), F.col("event_id").alias("n")), {"ignoreNullFields": "false"}).alias("doc"))
    turns = c.select(F.to_json(F.struct(F.col("role").alias("kind"), (F.col("turn") + 0.5).alias("n"), F.array("role").alias("tags")), {"ignoreNullFields": "false"}).alias("doc"))
    return events.union(turns)


_DOCUMENTS = """p AS (
SELECT 'kind' AS path, 'string' AS kind, event_type AS value FROM events UNION ALL SELECT 'even', 'boolean', (event_id % 2 = 0)::VARCHAR FROM events UNION ALL SELECT 'detail', 'object', NULL FROM events
UNION ALL SELECT 'detail.`user.id`', CASE WHEN event_id % 3 > 0 THEN 'integer' END, CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR END FROM events UNION ALL SELECT 'detail.props', 'object', NULL FROM events
UNION ALL SELECT 'detail.props.k', 'integer', props->>'k' FROM events UNION ALL SELECT 'n', 'integer', event_id::VARCHAR FROM events
UNION ALL SELECT 'kind', 'string', role FROM conversations UNION ALL SELECT 'n', 'float', turn || '.5' FROM conversations UNION ALL SELECT 'tags', 'array', NULL FROM conversations)"""


@query(f"WITH {_DOCUMENTS}, k AS (SELECT path, kind, count(*) AS n FROM p GROUP BY ALL) SELECT path, coalesce(sum(n) FILTER (kind IS NOT NULL), 0)::BIGINT AS present, coalesce(sum(n) FILTER (kind IS NULL), 0)::BIGINT AS nulls, coalesce(string_agg(kind || ':' || n, ',' ORDER BY kind) FILTER (kind IS NOT NULL), '') AS kinds, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) WHEN bool_and(kind IN ('integer', 'float')) THEN 'float' ELSE 'unknown' END AS category FROM k GROUP BY path")
def schemaless_shapes(spark, d):
    return shapes.shapes(_documents(spark, d), "doc")


@query(f"WITH {_DOCUMENTS}, v AS (SELECT DISTINCT path, value FROM p WHERE kind NOT IN ('object', 'array') AND value IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY md5(value), value) AS k FROM v) SELECT path, value FROM k WHERE k <= 50")
def schemaless_samples(spark, d):
    return shapes.sampled(_documents(spark, d), "doc")


_HUB = "hub AS (SELECT 'user/' || user_id AS _from, CASE WHEN event_id % 10 > 0 THEN 'type/click' ELSE 'type/' || event_type END AS _to, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS relation FROM events), ends AS (SELECT DISTINCT 'user/' || user_id AS _id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS type FROM events WHERE user_id % 7 > 0 UNION ALL SELECT 'type/' || event_type, 'kind' FROM (SELECT DISTINCT event_type FROM events))"


def _hub_edges(spark, d):
    e = star.table(spark, d, "events")
    edges = e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("_from"), F.when(F.col("event_id") % 10 > 0, "type/click").otherwise(F.concat(F.lit("type/"), F.col("event_type"))).alias("_to"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("relation"))
    users = e.where("user_id % 7 > 0").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("_id"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("type")).distinct()
    return edges, users.union(e.select(F.concat(F.lit("type/"), F.col("event_type")), F.lit("kind")).distinct())


@query(f"WITH {_HUB} SELECT relation, f.type AS from_type, t.type AS to_type, count(*) AS edges FROM hub LEFT JOIN ends f ON _from = f._id LEFT JOIN ends t ON _to = t._id GROUP BY ALL")
def endpoint_types_of_hubs(spark, d):
    """Nine in ten edges lead to one vertex."""
    return profile.endpoint_types(*_hub_edges(spark, d), "relation", "type")


@query("SELECT 'c_mktsegment' AS field, count(*) AS rows, count(c_mktsegment) AS present, count(DISTINCT c_mktsegment) AS \"distinct\" FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey), count(DISTINCT c_nationkey) FROM customer")
def field_coverage(spark, d):
    return profile.field_coverage(star.table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


INDEXES = [("placed", "persistent:_from+status"), ("relationships", "persistent:_to+relation"), ("relationships", "hash:relation")]
_SHAPE = f"{values('l', 'collection, kind', COLLECTIONS)}, {values('i', 'collection, index', INDEXES)}, o AS (SELECT collection, string_agg(index, ',' ORDER BY index) AS x FROM i GROUP BY 1), s AS (SELECT sha256(string_agg(r, '|' ORDER BY r)) AS fingerprint FROM (SELECT l.collection || ':' || kind || ':' || coalesce(x, '') AS r FROM l LEFT JOIN o ON l.collection = o.collection))"


def _shape(spark, d):
    return profile.shape_fingerprint(star.catalog(spark, d).listing(), spark.createDataFrame(INDEXES, "collection string, index string"))


@query(f"WITH {_SHAPE} SELECT * FROM s")
def shape_fingerprint(spark, d):
    return _shape(spark, d)


@query(f"WITH {_SHAPE}, c AS (SELECT 'nation' AS collection, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'lost', NULL) SELECT sha256(fingerprint || '#' || (SELECT string_agg(collection || '=' || coalesce(rows, -1), '|' ORDER BY collection || '=' || coalesce(rows, -1)) FROM c)) AS fingerprint FROM s")
def counts_fingerprint(spark, d):
    counts = star.catalog(spark, d).counts().where(F.col("collection").isin("nation", "region")).unionByName(spark.createDataFrame([("lost", None)], "collection string, rows long"))
    return profile.counts_fingerprint(_shape(spark, d), counts)


def _states(where):
    return f"SELECT o_orderpriority AS id, max(o_orderstatus) AS shape, count(*)::VARCHAR AS counts FROM orders WHERE {where} GROUP BY 1"


_OLD, _NEW = "o_orderpriority NOT LIKE '1%' AND (o_orderpriority <> '2-HIGH' OR o_orderstatus = 'F') AND (o_orderpriority <> '3-MEDIUM' OR o_orderkey % 2 = 0)", "o_orderpriority NOT LIKE '5%'"


@query(f"WITH b AS ({_states(_OLD)}), a AS ({_states(_NEW)}) SELECT a.id, CASE WHEN b.shape IS NULL THEN 'no_cache' WHEN a.shape <> b.shape THEN 'shape_changed' WHEN a.counts <> b.counts THEN 'stats_changed' ELSE 'unchanged' END AS state FROM a LEFT JOIN b ON a.id = b.id")
def change_states(spark, d):
    """Orders of each priority before and after: new, with another status, more of them, or the same."""
    states = lambda where: star.table(spark, d, "orders").where(where).groupBy(F.col("o_orderpriority").alias("id")).agg(F.max("o_orderstatus").alias("shape"), F.count("*").cast("string").alias("counts"))
    return profile.change_state(states(_OLD), states(_NEW))


@query("SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name))")
def grouping_sets_profile(spark, d):
    """Two discriminators' counts in one pass over the join."""
    j = star.table(spark, d, "customer").join(star.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupingSets([["c_mktsegment"], ["n_name"]], "c_mktsegment", "n_name").agg(F.count("*").alias("n"))



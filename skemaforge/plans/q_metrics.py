"""Queries of statistics, quality, calibration and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from skemaforge.operators import health, metrics, profile
from skemaforge.sources import star
from skemaforge.sources.catalog import union_all

from .q_sources import ENTITIES, PLACED, relationships
from .registry import query, values

_EDGES = "e AS (SELECT 'PLACED' AS relation, 'Customer' AS from_entity, 'Order' AS to_entity, count(*) AS edges FROM orders UNION ALL SELECT 'CONTAINS', 'Order', 'Part', count(*) FROM lineitem UNION ALL SELECT 'IN_REGION', 'Nation', 'Region', count(*) FROM nation UNION ALL SELECT 'LOST', 'Ghost', 'Part', 0)"
_ROWS = "n AS (SELECT 'Customer' AS entity, count(*) AS rows FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region)"


def _counts(spark, d, names):
    parts = [star.table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(n).alias("entity"), "rows") for n, t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_EDGES}, {_ROWS}, j AS (SELECT e.*, coalesce(s.rows, 0) AS sources, coalesce(t.rows, 0) AS targets FROM e LEFT JOIN n s ON s.entity = from_entity LEFT JOIN n t ON t.entity = to_entity), r AS (SELECT *, coalesce(round(edges / nullif(sources, 0), 2), 0.0) AS avg_out, coalesce(round(edges / nullif(targets, 0), 2), 0.0) AS avg_in, coalesce(round(edges / nullif(sources * targets, 0), 6), 1.0) AS selectivity FROM j) SELECT *, CASE WHEN avg_out > 1.5 AND avg_in > 1.5 THEN 'N:M' WHEN avg_out > 1.5 THEN '1:N' WHEN avg_in > 1.5 THEN 'N:1' ELSE '1:1' END AS cardinality FROM r")
def relationship_statistics(spark, d):
    rel = [("PLACED", "Customer", "Order", "orders"), ("CONTAINS", "Order", "Part", "lineitem"), ("IN_REGION", "Nation", "Region", "nation")]
    counts = _counts(spark, d, [(r, t) for r, _, _, t in rel]).withColumnRenamed("entity", "relation").withColumnRenamed("rows", "edges")
    ends = spark.createDataFrame([*((r, a, b) for r, a, b, _ in rel), ("LOST", "Ghost", "Part")], "relation string, from_entity string, to_entity string")
    edges = ends.join(counts, "relation", "left").fillna(0, ["edges"])
    return metrics.relationship_statistics(edges, _counts(spark, d, [("Customer", "customer"), ("Order", "orders"), ("Part", "part"), ("Nation", "nation"), ("Region", "region")]))


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n FROM entities GROUP BY type")
def label_counts(spark, d):
    """The filtered counts of all labels in one pass."""
    return star.entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


_PRESENT = ", ".join(f"('{t}', (SELECT {' + '.join(f'(count({c}) > 0)::INT' for c in cs)} FROM {t}))" for t, cs in (("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("nation", ("n_nationkey", "n_name", "n_regionkey")), ("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")), ("region", ("r_regionkey", "r_name")), ("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))))
_LINKED = f"{relationships('')}, {PLACED}, l AS (SELECT DISTINCT relation, split_part(_from, '/', 1) AS from_entity, split_part(_to, '/', 1) AS to_entity FROM relationships UNION SELECT DISTINCT 'PLACED', split_part(_from, '/', 1), split_part(_to, '/', 1) FROM placed)"


def _links(spark, d):
    ends = profile.endpoints_by_relation(star.relationships(spark, d, shared=False), "relation").unionByName(profile.endpoints_by_relation(star.placed(spark, d).withColumn("relation", F.lit("PLACED")), "relation"))
    return ends.select("relation", F.col("from_collection").alias("from_entity"), F.col("to_collection").alias("to_entity"))


@query(f"WITH {_LINKED}, m(entity, properties) AS (VALUES {_PRESENT}), a AS (SELECT count(*) AS entities, count(*) FILTER (entity IN (SELECT from_entity FROM l UNION SELECT to_entity FROM l)) AS connected, count(*) FILTER (properties > 0) AS described FROM m), b AS (SELECT count(*) AS relationships, count(*) FILTER (from_entity NOT IN (SELECT entity FROM m) OR to_entity NOT IN (SELECT entity FROM m)) AS dangling FROM l) SELECT entities, connected, entities - connected AS orphans, relationships, dangling, round(connected / nullif(entities, 0), 4) AS connectivity, round((relationships - dangling) / nullif(relationships, 0), 4) AS consistency, round(described / nullif(entities, 0), 4) AS richness FROM a, b")
def structural_metrics(spark, d):
    """Of the entities and relationships that the rows show; orders are left out, so what leads to them dangles."""
    names = ["customer", "nation", "part", "region", "supplier"]
    fields = union_all([profile.observed_fields(star.table(spark, d, n)).select(F.lit(n).alias("entity"), "field") for n in names])
    entities = spark.createDataFrame([(n,) for n in names], "entity string").join(fields.groupBy("entity").agg(F.count("*").alias("properties")), "entity", "left").fillna(0)
    return metrics.structural_metrics(entities, _links(spark, d))


_HEALTH = f"""{PLACED}, {relationships('')}, e AS (SELECT 'placed' AS edges, _from, _to FROM placed UNION ALL SELECT 'relationships', _from, _to FROM relationships),
v AS (SELECT 'customer/' || c_custkey AS id FROM customer UNION ALL SELECT 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'part/' || p_partkey FROM part UNION ALL SELECT 'region/' || r_regionkey FROM region),
x AS (SELECT edges, _from AS id, 1 AS f, 0 AS t FROM e UNION ALL SELECT edges, _to, 0, 1 FROM e UNION ALL SELECT k.edges, id, 0, 0 FROM v, (SELECT DISTINCT edges FROM e) k),
y AS (SELECT edges, id, sum(f) AS f, sum(t) AS t, id IN (SELECT id FROM v) AS there FROM x GROUP BY edges, id),
h AS (SELECT edges, split_part(id, '/', 1) AS collection, count(*) FILTER (there) AS rows, count(*) FILTER (there AND f + t > 0) AS connected, count(*) FILTER (there AND f + t = 0) AS orphaned, coalesce(sum(f) FILTER (NOT there), 0)::BIGINT AS dangling_from, coalesce(sum(t) FILTER (NOT there), 0)::BIGINT AS dangling_to FROM y GROUP BY 1, 2)"""
_HEALTHY = ["customer", "nation", "part", "region"]


@query(f"WITH {_HEALTH} SELECT * FROM h")
def referential_health(spark, d):
    """Rows of four collections and both edge collections; orders and suppliers are left out, so that edges dangle, and no part has an edge."""
    return health.catalog_health(star.catalog(spark, d), _HEALTHY)


@query(f"WITH {_HEALTH} SELECT edges, sum(rows)::BIGINT AS rows, round(sum(connected) / nullif(sum(rows), 0), 4) AS connectivity, sum(dangling_from + dangling_to)::BIGINT AS dangling FROM h GROUP BY 1")
def referential_summary(spark, d):
    return health.summary(health.catalog_health(star.catalog(spark, d), _HEALTHY))


MAPPING = [("Customer", "customer"), ("Wagon", "wagons"), ("Part", "part"), ("Idea", None), ("Order", "orders"), ("Nation", "nation")]
NAMED = [("Customer",), ("Part",), ("Wagon",), ("Idea",), ("Spare",)]
#: Collections that hold an end of some edge.
_REACHED = f"{relationships('')}, {PLACED}, c AS (SELECT DISTINCT split_part(unnest([_from, _to]), '/', 1) AS c FROM (SELECT _from, _to FROM relationships UNION ALL SELECT _from, _to FROM placed))"


def _reached(spark, d):
    ends = union_all([profile.endpoints(star.relationships(spark, d, shared=False)), profile.endpoints(star.placed(spark, d))])
    return ends.select(F.explode(F.array("from_collection", "to_collection")).alias("collection")).distinct()


@query(f"WITH {values('m', 'name, collection', MAPPING)}, {_REACHED} SELECT count(collection) AS mapped, count(c) AS grounded, round(count(c) / nullif(count(collection), 0), 4) AS ratio FROM m LEFT JOIN c ON m.collection = c.c")
def grounding(spark, d):
    return metrics.grounding(spark.createDataFrame(MAPPING, "name string, collection string"), _reached(spark, d))


@query(f"WITH {values('m', 'name, collection', MAPPING)}, {values('e', 'name', NAMED)}, {_REACHED} SELECT name, 'ungrounded' AS why FROM m WHERE collection IS NOT NULL AND collection NOT IN (SELECT c FROM c) UNION ALL SELECT name, 'unmapped' FROM e WHERE name NOT IN (SELECT name FROM m WHERE collection IS NOT NULL)")
def ungrounded_names(spark, d):
    e = spark.createDataFrame(NAMED, "entity string")
    return metrics.ungrounded(e, spark.createDataFrame(MAPPING, "name string, collection string"), _reached(spark, d))


_SCORED = f"{_HEALTH}, s AS (SELECT edges AS name, CASE WHEN edges = 'placed' THEN 0.75::DOUBLE END AS confidence, round(sum(connected) / nullif(sum(rows), 0), 4) AS connectivity, sum(dangling_from + dangling_to) / 1000.0::DOUBLE AS bad, NULL::DOUBLE AS grounding FROM h GROUP BY 1), t AS (SELECT name, confidence, connectivity, round(1 / (1 + bad), 4) AS consistency, grounding FROM s)"


@query(f"WITH {_SCORED} SELECT *, round(100 * (coalesce(confidence, 0) * 0.4 + coalesce(connectivity, 0) * 0.2 + coalesce(consistency, 0) * 0.2) / (0.4::DOUBLE * (confidence IS NOT NULL)::INT + 0.4::DOUBLE)) AS health FROM t")
def health_score(spark, d):
    """Of what the rows show: confidence is told for one edge collection, grounding for none."""
    found = health.summary(health.catalog_health(star.catalog(spark, d), _HEALTHY))
    return metrics.health_score(found.select(F.col("edges").alias("name"), F.when(F.col("edges") == "placed", 0.75).alias("confidence"), "connectivity", F.round(1 / (1 + F.col("dangling") / 1000.0), 4).alias("consistency"), F.lit(None).cast("double").alias("grounding")))


GOLD = [("Customers",), ("supplier",), ("in_regions",), ("Studio",), ("REGION",)]
_PREDICTED = f"{ENTITIES}, {relationships('')}, p AS (SELECT DISTINCT type AS name FROM entities UNION SELECT DISTINCT relation FROM relationships)"


def _predicted(spark, d):
    """Names of the types and relations that the rows have."""
    return star.entities(spark, d).select(F.col("type").alias("name")).union(star.relationships(spark, d).select("relation")).distinct()

_NORM = "CASE WHEN ends_with(x, 'ies') AND length(x) > 3 THEN CASE WHEN x = 'movies' THEN 'movie' ELSE x[:-4] || 'y' END WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') AND length(x) > 1 THEN x[:-2] ELSE x END"


@query(f"WITH {_PREDICTED}, {values('g', 'name', GOLD)}, pn AS (SELECT DISTINCT {_NORM} AS n FROM (SELECT replace(lower(name), '-', '_') AS x FROM p)), gn AS (SELECT DISTINCT {_NORM} AS n FROM (SELECT replace(lower(name), '-', '_') AS x FROM g)), c AS (SELECT (SELECT count(*) FROM pn) AS predicted, (SELECT count(*) FROM gn) AS gold, (SELECT count(*) FROM pn JOIN gn USING (n)) AS common) SELECT *, common / predicted AS precision, common / gold AS recall, 2 * (common / predicted) * (common / gold) / (common / predicted + common / gold) AS f1 FROM c")
def gold_comparison(spark, d):
    return metrics.precision_recall(_predicted(spark, d), spark.createDataFrame(GOLD, "name string"))


@query(f"WITH {_PREDICTED} SELECT 0::BIGINT AS predicted, count(*) FILTER (name = 'Ghost') AS gold, 0::BIGINT AS common, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM p")
def gold_comparison_empty(spark, d):
    """Nothing is predicted and nothing is gold: no row has such a name."""
    none = _predicted(spark, d).where("name = 'Ghost'")
    return metrics.precision_recall(none, none)


_RUNS = """r AS (SELECT doc_id::VARCHAR AS run, n_chars / (n_chars + 800.0)::DOUBLE AS confidence, quality::DOUBLE AS entity_f1, (1 - toxic)::DOUBLE AS relationship_f1, CASE WHEN doc_id % 3 > 0 THEN 0.25::DOUBLE END AS domain_range_f1, CASE WHEN doc_id % 5 > 0 THEN quality * 0.5::DOUBLE END AS mapping_accuracy FROM labels JOIN documents USING (doc_id)),
q AS (SELECT *, (coalesce(entity_f1, 0) + coalesce(relationship_f1, 0) + coalesce(domain_range_f1, 0) + coalesce(mapping_accuracy, 0)) / nullif((entity_f1 IS NOT NULL)::INT + (relationship_f1 IS NOT NULL)::INT + (domain_range_f1 IS NOT NULL)::INT + (mapping_accuracy IS NOT NULL)::INT, 0) AS quality_ FROM r)"""
_BINS = "b AS (SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS rows, avg(confidence) AS mean_confidence, avg(quality_) AS mean_quality FROM q WHERE quality_ IS NOT NULL GROUP BY 1)"


def _runs(spark, d):
    """A run a labelled document: how sure a guess by its length is, and how good the document is."""
    j = star.table(spark, d, "labels").join(star.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    when = lambda n, v: F.when(F.col("doc_id") % n > 0, v)
    runs = j.select(F.col("doc_id").cast("string").alias("run"), (F.col("n_chars") / (F.col("n_chars") + 800.0)).alias("confidence"), F.col("quality").cast("double").alias("entity_f1"), (1 - F.col("toxic")).cast("double").alias("relationship_f1"), when(3, F.lit(0.25)).alias("domain_range_f1"), when(5, F.col("quality") * 0.5).alias("mapping_accuracy"))
    return metrics.observed_quality(runs)


@query(f"WITH {_RUNS} SELECT run, round(confidence, 9) AS confidence, round(quality_, 9) AS quality FROM q")
def observed_quality(spark, d):
    return _runs(spark, d).select("run", F.round("confidence", 9).alias("confidence"), F.round("quality", 9).alias("quality"))


@query(f"WITH {_RUNS}, {_BINS} SELECT i::INTEGER AS bin, coalesce(rows, 0) AS rows, round(mean_confidence, 6) AS mean_confidence, round(mean_quality, 6) AS mean_quality FROM range(10) t(i) LEFT JOIN b ON b.bin = i")
def reliability_bins(spark, d):
    out = metrics.reliability_bins(_runs(spark, d), "confidence", "quality")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_confidence", "mean_quality")})


@query(f"WITH {_RUNS}, {_BINS} SELECT round((SELECT sum(rows * abs(mean_confidence - mean_quality)) / sum(rows) FROM b), 6) AS ece, round((SELECT max(abs(mean_confidence - mean_quality)) FROM b), 6) AS mce, round(avg((confidence - quality_) * (confidence - quality_)), 6) AS brier, round(avg(confidence) - avg(quality_), 6) AS gap FROM q WHERE quality_ IS NOT NULL")
def calibration_errors(spark, d):
    out = metrics.calibration_errors(_runs(spark, d).where("quality is not null"), "confidence", "quality")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"WITH {_RUNS}, g AS (SELECT confidence AS t, count(*) FILTER (quality_ >= 0.5) AS g, count(*) FILTER (quality_ < 0.5) AS b FROM q WHERE quality_ IS NOT NULL GROUP BY 1), j AS (SELECT t, sum(g) OVER (ORDER BY t DESC) / (SELECT sum(g) FROM g) - sum(b) OVER (ORDER BY t DESC) / (SELECT sum(b) FROM g) AS j FROM g) SELECT t AS threshold, round(j, 6) AS j FROM j ORDER BY j DESC, t DESC LIMIT 1")
def youden_threshold(spark, d):
    """Scores aren't rounded: there are about as many as rows."""
    good = _runs(spark, d).where("quality is not null").withColumn("good", F.col("quality") >= 0.5)
    return metrics.youden(good, "confidence", "good").select("threshold", F.round("j", 6).alias("j"))


@query("SELECT o_orderpriority AS series, count(o_totalprice) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, arg_max(o_totalprice, o_orderkey) AS latest, round(avg(o_totalprice), 4) AS mean, round(arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey), 4) AS delta FROM orders GROUP BY 1")
def history_summary(spark, d):
    h = star.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderkey", "o_totalprice")
    return metrics.history_summary(h, "series", "o_orderkey", "o_totalprice").select("series", "n", "least", "most", "latest", F.round("mean", 4).alias("mean"), F.round("delta", 4).alias("delta"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def history_last_n(spark, d):
    return metrics.last_n(star.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


def _half(k):
    return f"SELECT o_orderpriority AS domain, 'half' AS variant, count(*) FILTER (o_orderstatus = 'F') / count(*) AS f1, count(*) FILTER (o_totalprice > 100000) / count(*) AS accuracy FROM orders WHERE o_orderkey % 2 = {k} GROUP BY 1"


@query(f"WITH o AS ({_half(0)}), n AS ({_half(1)}), j AS (SELECT o.domain, o.variant, 'f1' AS metric, o.f1 AS before, n.f1 AS after FROM o JOIN n USING (domain, variant) UNION ALL SELECT o.domain, o.variant, 'accuracy', o.accuracy, n.accuracy FROM o JOIN n USING (domain, variant)) SELECT *, round(after - before, 6) AS delta FROM j WHERE round(after - before, 6) < -0.005")
def regression_gate(spark, d):
    """Two halves of the orders as two runs; what fell from one to the other."""

    def half(k):
        o = star.table(spark, d, "orders").where(F.col("o_orderkey") % 2 == k)
        return o.groupBy(F.col("o_orderpriority").alias("domain"), F.lit("half").alias("variant")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("f1"), (F.count_if(F.col("o_totalprice") > 100000) / F.count("*")).alias("accuracy"))

    return metrics.regressions(half(0), half(1), ["domain", "variant"], ["f1", "accuracy"])


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 10")
def deterministic_order(spark, d):
    j = star.table(spark, d, "nation").join(star.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_name", "r_name").orderBy("n_name").limit(10)



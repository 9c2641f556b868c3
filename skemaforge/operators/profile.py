"""Profiling: value counts of all candidate fields in one scan, top values, fields, endpoints, fingerprints."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.functions.naming import collection_of, is_label
from skemaforge.operators.inclusion import flat
from skemaforge.sources.catalog import SYSTEM_FIELDS, named

TOP_K, OVERFLOW_K, HARD_CAP, FIELD_SAMPLE = 20, 50, 10_000, 10


#: Values that the sketch of frequent ones follows, and those that it tells at most, a field.
TRACKED, TOLD = 10_000, 5_000


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, count of the non-null values of all ``fields``: one scan, one shuffle of partial counts."""
    return flat(df, fields).groupBy("field", F.col("v").alias("value")).agg(F.count("*").alias("count"))


def frequent(df: DataFrame, fields: list[str], told: int = TOLD, tracked: int = TRACKED) -> DataFrame:
    """field, rows, distinct (about), items (value and about how often): a row a field, from mergeable sketches of one scan. No value is shuffled but those told."""
    each = [F.struct(F.lit(f).alias("field"), F.count(named(f)).alias("rows"), F.approx_count_distinct(named(f), 0.02).alias("distinct"), F.call_function("approx_top_k", named(f).cast("string"), F.lit(min(told, tracked)), F.lit(tracked)).alias("items")) for f in fields]
    out = df.agg(F.array(*each).alias("a")).select(F.inline("a"))
    return out.withColumn("items", F.filter("items", lambda x: x["item"].isNotNull()))


def certain_share(tracked: int = TRACKED) -> float:
    """Values with more than this share of the rows are all among the sketch's: twice its error, 3.5 over the size of its table."""
    return 7.0 / 2 ** ceil(log2(tracked / 0.75))


def bounded_counts(df: DataFrame, fields: list[str], cap: int = HARD_CAP, tracked: int = TRACKED) -> DataFrame:
    """As ``value_counts``, but of fields with more than about ``cap`` distinct values only those that make up over ``certain_share`` of the rows.

    A sketch finds which fields are label-like and which values can be frequent; one more scan counts those exactly. The distinct values of
    a unique text column are never shuffled.
    """
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, value string, count long")
    seen = frequent(df, fields, TOLD, tracked).collect()  # a row a field
    wide = {r["field"]: r for r in seen if r["distinct"] > 1.1 * cap}
    if not wide:
        return value_counts(df, fields)
    spark = df.sparkSession
    rows = flat(df, fields).withColumnRenamed("v", "value")
    hits = F.broadcast(spark.createDataFrame([(f, x["item"], 1) for f, r in wide.items() for x in r["items"]], "field string, value string, known int"))  # at most TOLD a field
    narrow = [f for f in fields if f not in wide]
    counts = rows.join(hits, ["field", "value"], "left").where(F.col("field").isin(*narrow) | F.col("known").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("count"))
    least = F.lit(0.0)
    for f, r in wide.items():
        least = F.when(F.col("field") == f, certain_share(tracked) * r["rows"]).otherwise(least)
    return counts.where(F.col("count") > least)


def ranked(counts: DataFrame) -> DataFrame:
    """With rank by field: most frequent first, ties by value."""
    w = Window.partitionBy("field").orderBy(F.col("count").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w))


def top_values(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    return ranked(counts).where(F.col("rank") <= k)


def overflow_values(counts: DataFrame, k: int = TOP_K, more: int = OVERFLOW_K) -> DataFrame:
    return ranked(counts).where((F.col("rank") > k) & (F.col("rank") <= k + more))


def distinct_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("field").agg(F.count("*").alias("distinct"), F.sum("count").alias("rows"))


def label_set(counts: DataFrame, floor: int, cap: int = HARD_CAP) -> DataFrame:
    """The full label set of each field: label-shaped values at or above the floor, at most ``cap`` of them a field."""
    return ranked(counts.where((F.col("count") >= floor) & is_label(F.col("value")))).where(F.col("rank") <= cap)


def below_floor(counts: DataFrame, floor: int, more: int = OVERFLOW_K) -> DataFrame:
    return ranked(counts.where(F.col("count") < floor)).where(F.col("rank") <= more)


def cap_report(counts: DataFrame, k: int) -> DataFrame:
    """field, distinct, captured, dropped, truncated."""
    d = distinct_totals(counts)
    captured = F.least(F.col("distinct"), F.lit(k))
    return d.select("field", "distinct", captured.alias("captured"), (F.col("distinct") - captured).alias("dropped"), (F.col("distinct") > k).alias("truncated"))


def observed_fields(df: DataFrame, exclude: tuple[str, ...] = SYSTEM_FIELDS) -> DataFrame:
    """field, present: fields with a value in some row (one aggregation, no shuffle of rows)."""
    fields = [c for c in df.columns if c not in exclude]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, present long")
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.count(named(f)).alias("present")) for f in fields))
    return df.agg(each.alias("a")).select(F.inline("a")).where("present > 0")


def observed_fields_by_type(df: DataFrame, type_field: str, exclude: tuple[str, ...] = SYSTEM_FIELDS, sampled: int | None = None) -> DataFrame:
    """type, field, present; ``sampled`` looks at so many rows a type (by key) as a cheap probe."""
    fields = [c for c in df.columns if c not in (*exclude, type_field)]
    if not fields:
        return df.sparkSession.createDataFrame([], "type string, field string, present long")
    if sampled is not None:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(named(type_field)).orderBy("_key"))).where(F.col("_n") <= sampled)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.count(named(f)).alias("present")) for f in fields))
    return df.where(named(type_field).isNotNull()).groupBy(named(type_field).alias("type")).agg(each.alias("a")).select("type", F.inline("a")).where("present > 0")


def observed_json_fields(df: DataFrame, column: str) -> DataFrame:
    """field, present: top-level keys of a JSON column."""
    return df.select(F.explode(F.json_object_keys(column)).alias("field")).groupBy("field").agg(F.count("*").alias("present"))


def endpoints(edges: DataFrame) -> DataFrame:
    """from_collection, to_collection: distinct pairs."""
    return edges.select(collection_of(F.col("_from")).alias("from_collection"), collection_of(F.col("_to")).alias("to_collection")).distinct()


def endpoints_by_relation(edges: DataFrame, relation: str) -> DataFrame:
    """relation, from_collection, to_collection, edges."""
    return edges.groupBy(F.col(relation).alias("relation"), collection_of(F.col("_from")).alias("from_collection"), collection_of(F.col("_to")).alias("to_collection")).agg(F.count("*").alias("edges"))


#: An id at the ends of more than one in so many edges is a hub.
HUB = 1000


def hubs(edges: DataFrame, *sides: str) -> dict[str, list[str]]:
    """The ids that stand at more than one in ``HUB`` of the edges' ends, by side: fewer than 2 * ``HUB``, from one pass of sketches."""
    found = frequent(edges, list(sides), told=2 * HUB).collect()
    return {r["field"]: [x["item"] for x in r["items"] if x["count"] * HUB > r["rows"]] for r in found}


def with_end(edges: DataFrame, side: str, vertices: DataFrame, name: str, often: list[str]) -> DataFrame:
    """``edges`` with ``name``: what ``vertices`` (id, value) says of the end ``side``; null where there is no such row.

    Edges of hubs (``often``) meet their rows by broadcast where they are; the others' are joined by id, which then is even.
    """
    v = vertices.select(F.col("id").alias("_end"), F.col("value").alias(name))
    if not often:
        return edges.join(v, F.col(side) == F.col("_end"), "left").drop("_end")
    ids = F.broadcast(edges.sparkSession.createDataFrame([(i,) for i in often], "_hub string"))
    known = F.broadcast(ids.join(v.where(F.col("_end").isin(*often)), F.col("_hub") == F.col("_end"), "left").drop("_end"))  # a row a hub
    hot = edges.join(known, F.col(side) == F.col("_hub")).drop("_hub")
    cold = edges.join(ids, F.col(side) == F.col("_hub"), "left_anti").join(v, F.col(side) == F.col("_end"), "left").drop("_end")
    return hot.unionByName(cold)


def endpoint_types(edges: DataFrame, vertices: DataFrame, relation: str, type_field: str) -> DataFrame:
    """relation, from_type, to_type, edges: both ends looked up in a shared collection; a dangling end has type null. Hubs don't gather in a task."""
    v = vertices.select(F.col("_id").alias("id"), named(type_field).alias("value"))
    often = hubs(edges, "_from", "_to")
    rows = edges.select(named(relation).alias("relation"), "_from", "_to")
    rows = with_end(rows, "_from", v, "from_type", often["_from"])
    rows = with_end(rows, "_to", v, "to_type", often["_to"])
    return rows.groupBy("relation", "from_type", "to_type").agg(F.count("*").alias("edges"))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, rows, present, distinct."""
    aggregates = [F.struct(F.lit(f).alias("field"), F.count("*").alias("rows"), F.count(named(f)).alias("present"), F.count_distinct(named(f)).alias("distinct")) for f in fields]
    return df.agg(F.array(*aggregates).alias("a")).select(F.inline("a"))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat_ws(":", *columns), 256)


def shape_fingerprint(listing: DataFrame, indexes: DataFrame) -> DataFrame:
    """fingerprint of collections (collection, kind) and their indexes (collection, index), independent of order."""
    own = indexes.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_list("index")), ",").alias("indexes"))
    rows = listing.join(own, "collection", "left").select(F.concat_ws(":", "collection", "kind", F.coalesce("indexes", F.lit(""))).alias("row"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "|"), 256).alias("fingerprint"))


def counts_fingerprint(shape: DataFrame, counts: DataFrame) -> DataFrame:
    """The shape's fingerprint with each collection's count (-1 where it failed)."""
    rows = counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "collection", F.coalesce("rows", F.lit(-1)).cast("string")))), "|").alias("c"))
    return shape.crossJoin(rows).select(F.sha2(F.concat_ws("#", "fingerprint", "c"), 256).alias("fingerprint"))  # one row each


def change_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """state from (id, shape, counts) of two runs: no_cache, shape_changed, stats_changed or unchanged."""
    b = before.select(F.col("id"), F.col("shape").alias("shape0"), F.col("counts").alias("counts0"))
    state = F.when(F.col("shape0").isNull(), "no_cache").when(F.col("shape0") != F.col("shape"), "shape_changed").when(F.col("counts0") != F.col("counts"), "stats_changed").otherwise("unchanged")
    return after.join(b, "id", "left").select("id", state.alias("state"))

"""Set operations on a model's own parts: indexes, patterns, triples, retrieval graphs, differences, names. Inputs are metadata tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.functions import naming

# Fields that hold a triple's predicate, and the predicates that state a type.
PREDICATE_FIELDS = ("predicate", "p", "rel", "relation", "relType")
TYPE_PREDICATES = ("rdf:type", "type", "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
# What a model with mappings of each style is called.
PATTERNS = {"LABEL": "LPG_LABEL", "COLLECTION": "PG_ENTITY_COLLECTION", "GENERIC_WITH_TYPE": "LPG_GENERIC_EDGE", "DEDICATED_COLLECTION": "PG_DEDICATED_EDGE", "FOREIGN_KEY": "attribute_foreign_key"}
# How names in an interchange document look.
CLASS_NAME, PROPERTY_NAME = r"^[A-Z][A-Za-z0-9]*$", r"^[a-z][A-Za-z0-9]*$"


def ordered_indexes(indexes: DataFrame) -> DataFrame:
    """collection, type, fields (comma-joined), name, place: a collection's indexes by type, fields and name. indexes: collection, type, fields (array), name."""
    text = indexes.select("collection", F.coalesce("type", F.lit("")).alias("type"), F.array_join("fields", ",").alias("fields"), F.coalesce("name", F.lit("")).alias("name"))
    return text.withColumn("place", F.row_number().over(Window.partitionBy("collection").orderBy("type", "fields", "name")))


def index_flags(indexes: DataFrame) -> DataFrame:
    """collection, field, type, unique, compound (comma-joined, null for one field), position: how each field is indexed.

    Primary and vertex-centric indexes don't count; a unique index goes before others, then the collection's first. indexes: collection,
    place, type, fields (array), unique.
    """
    centric = F.try_element_at("fields", F.lit(1)).isin("_from", "_to") & (F.size("fields") > 1)
    each = indexes.where((F.col("type") != "primary") & ~centric).select("collection", "place", "type", "unique", F.when(F.size("fields") > 1, F.array_join("fields", ",")).alias("compound"), F.posexplode("fields").alias("position", "field"))
    first = Window.partitionBy("collection", "field").orderBy(F.col("unique").desc(), "place", "position")
    return each.withColumn("k", F.row_number().over(first)).where("k = 1").select("collection", "field", "type", "unique", "compound", "position")


def bounded_values(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` highest counts of each field (collection, field, value, count); ties by value."""
    field = Window.partitionBy("collection", "field").orderBy(F.col("count").desc(), "value")
    return counts.withColumn("k", F.row_number().over(field)).where(F.col("k") <= most).drop("k")


def property_union(by_type: DataFrame, candidates: DataFrame) -> DataFrame:
    """collection, properties (sorted, comma-joined): of a whole collection's entity, what any of its types has and the candidate fields. Both: collection, field."""
    both = by_type.select("collection", "field").unionByName(candidates.select("collection", "field"))
    return both.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("properties"))


def detected_patterns(mappings: DataFrame) -> DataFrame:
    """pattern, mappings: how often a model uses each way of storing. mappings: style."""
    name = reduce(lambda c, p: c.when(F.col("style") == p[0], p[1]), list(PATTERNS.items())[1:], F.when(F.col("style") == next(iter(PATTERNS)), next(iter(PATTERNS.values()))))
    return mappings.select(name.alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("mappings"))


def type_assertions(counts: DataFrame) -> DataFrame:
    """collection, values (sorted, comma-joined): predicates in edge-like fields that state a type. counts: collection, field, value."""
    hits = counts.where(F.col("field").isin(*PREDICATE_FIELDS) & F.lower("value").isin(*(t.lower() for t in TYPE_PREDICATES)))
    return hits.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))


def vector_indexes(indexes: DataFrame) -> DataFrame:
    """collection, field of vector indexes. indexes: collection, type, fields (array)."""
    return indexes.where(F.lower("type").contains("vector")).select("collection", F.explode("fields").alias("field")).distinct()


def retrieval_confidence(roles: DataFrame, vectors: DataFrame) -> DataFrame:
    """detected, confidence (null if not detected). Vector indexes support a finding and never make one. roles: collection, role; vectors: collection."""
    has = lambda *r: F.coalesce(F.bool_or(F.col("role").isin(*r)), F.lit(False))
    seen = roles.agg(has("chunk").alias("chunks"), has("entity").alias("entities"), has("similarity", "mention").alias("edges"), F.count_distinct("role").alias("n"))
    both = seen.crossJoin(vectors.agg((F.count("*") > 0).alias("vectors")))  # one row each
    high = F.col("chunks") & F.col("edges") & (F.col("entities") | F.col("vectors"))
    return both.select((F.col("n") >= 2).alias("detected"), F.when(F.col("n") >= 2, F.when(high, "high").otherwise("medium")).alias("confidence"))


def domain_choice(scores: DataFrame, given: str | None = None) -> DataFrame:
    """domain, confidence: the caller's word, else the best score; ties by name. scores: domain, confidence."""
    if given and given.strip():
        return scores.sparkSession.createDataFrame([(given.strip(), 1.0)], "domain string, confidence double")
    return scores.orderBy(F.col("confidence").desc(), "domain").limit(1).select("domain", "confidence")


def explicit_scopes(scopes: DataFrame, declared: DataFrame) -> DataFrame:
    """entity, scope: what is declared goes before what was found. Both: entity, scope."""
    own = declared.select(F.col("entity").alias("e"), F.col("scope").alias("said"))
    return scopes.join(own, F.col("entity") == F.col("e"), "left").select("entity", F.coalesce("said", "scope").alias("scope"))


def model_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, name, change (added, removed, changed, restyled). Both: kind, name, definition (what must be equal), style.

    Equal parts have no row; a part with another definition and another style has two.
    """
    a = before.select("kind", "name", F.col("definition").alias("d0"), F.col("style").alias("s0"), F.lit(1).alias("old"))
    b = after.select("kind", "name", F.col("definition").alias("d1"), F.col("style").alias("s1"), F.lit(1).alias("new"))
    j = a.join(b, ["kind", "name"], "full")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    found = F.array(
        F.when(F.col("old").isNull(), "added"), F.when(F.col("new").isNull(), "removed"),
        F.when(both & ~F.col("d0").eqNullSafe(F.col("d1")), "changed"), F.when(both & ~F.col("s0").eqNullSafe(F.col("s1")), "restyled"),
    )
    return j.select("kind", "name", F.explode(F.array_compact(found)).alias("change"))


def gold_overlap(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """overlap: the mean of two F1 scores. Both: f1, one row."""
    return entities.select(F.col("f1").alias("e")).crossJoin(relationships.select(F.col("f1").alias("r"))).select(F.round((F.col("e") + F.col("r")) / 2, 4).alias("overlap"))


def naming_issues(names: DataFrame) -> DataFrame:
    """kind, name, proposed: what isn't named as an interchange document wants it. names: kind (entity, property, relationship), name."""
    entity = F.col("kind") == "entity"
    wrong = F.when(entity, ~F.col("name").rlike(CLASS_NAME)).when(F.col("kind") == "property", ~F.col("name").startswith("_") & ~F.col("name").rlike(PROPERTY_NAME)).otherwise(~F.col("name").rlike(PROPERTY_NAME))
    return names.where(wrong).select("kind", "name", F.when(entity, naming.owl_class(F.col("name"))).otherwise(naming.owl_property(F.col("name"))).alias("proposed"))


def degraded_reasons(collections: DataFrame, graphs: DataFrame) -> DataFrame:
    """reason: why a sharding profile rests on less than the whole. collections: collection; graphs: graph, error."""
    empty = collections.agg(F.when(F.count("*") == 0, "no user collections").alias("reason"))
    failed = graphs.agg(F.when(F.count("error") > 0, "properties of a graph could not be read").alias("reason"))
    return empty.unionByName(failed).where("reason is not null")


def first_json_object(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, braces in JSON strings aside; null if there is none or it doesn't end.

    One fold over the tokens that matter (strings, braces), not over characters.
    """
    start = F.instr(text, "{")
    rest = F.substr(text, start, F.length(text))
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)"(?:[^"\\]|\\.)*"?|[{}]|[^"{}]+'), F.lit(0))
    step = lambda s, t: F.when(s["over"], s).otherwise(
        F.struct(
            (s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).alias("depth"),
            (s["size"] + F.length(t)).alias("size"),
            ((t == "}") & (s["depth"] == 1)).alias("over"),
        )
    )
    found = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("over")), step)
    return F.when((start > 0) & found["over"], F.substr(rest, F.lit(1), found["size"]))

"""Rules over metadata tables: discriminators, foreign keys, families, tenancy, topology and domain detectors.

Inputs are small tables (a row a field or a collection) which profiling produced; every rule is a set operation on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.functions import naming
from skemaforge.operators.numbering import numbered
from skemaforge.sources.catalog import Catalog, named, union_all

# Fixed values of discriminator selection.
PREFERRED = {"document": ("type", "_type", "kind", "entityType", "label"), "edge": ("relation", "relType", "type")}
MIN_DISTINCT, MAX_DISTINCT, COVERAGE = 2, 32, 0.80


def choose_discriminator(counts: DataFrame, totals: DataFrame, kind: str = "document", most: int = MAX_DISTINCT) -> DataFrame:
    """collection, field. counts: collection, field, value, count; totals: collection, rows.

    A field passes if all its values are labels, it has 2 to ``most`` of them (32, or 10,000 with full label sets), and they cover 80 % of the rows. Of the passing ones the most
    distinct wins; ties go to the preferred names in order, then by name.
    """
    shape = counts.groupBy("collection", "field").agg(F.count("*").alias("distinct"), F.sum("count").alias("covered"), F.bool_and(naming.is_label(F.col("value"))).alias("labels"))
    passing = shape.join(totals, "collection").where(F.col("labels") & F.col("distinct").between(MIN_DISTINCT, most) & (F.col("covered") >= COVERAGE * F.col("rows")))
    preferred = F.coalesce(F.array_position(F.array(*map(F.lit, PREFERRED[kind])), F.col("field")), F.lit(0))
    order = F.when(preferred > 0, preferred).otherwise(1000)
    w = Window.partitionBy("collection").orderBy(F.col("distinct").desc(), order, "field")
    return passing.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("collection", "field", "distinct")


def single_value_edges(counts: DataFrame) -> DataFrame:
    """collection, field, value of edge fields with one value that isn't the collection's own name."""
    one = counts.groupBy("collection", "field").agg(F.count("*").alias("n"), F.min("value").alias("value")).where("n = 1")
    norm = lambda c: F.upper(F.translate(c, "-", "_"))
    return one.where(norm(F.col("value")) != norm(F.col("collection"))).select("collection", "field", "value")


def baseline_entities(collections: DataFrame, discriminators: DataFrame, counts: DataFrame) -> DataFrame:
    """entity, style, collection, type_field, type_value: one LABEL entity a value of a discriminator, else one COLLECTION entity."""
    by_label = discriminators.join(counts, ["collection", "field"]).select(naming.pascal_case(F.trim("value")).alias("entity"), F.lit("LABEL").alias("style"), "collection", F.col("field").alias("type_field"), F.col("value").alias("type_value"))
    whole = collections.join(discriminators, "collection", "left_anti").select(naming.entity_name(F.col("collection")).alias("entity"), F.lit("COLLECTION").alias("style"), "collection", F.lit(None).cast("string").alias("type_field"), F.lit(None).cast("string").alias("type_value"))
    return by_label.unionByName(whole)


def baseline_relationships(edges: DataFrame, discriminators: DataFrame, counts: DataFrame) -> DataFrame:
    """relation, style, collection, type_field, type_value: GENERIC_WITH_TYPE a value, else DEDICATED_COLLECTION."""
    typed = discriminators.join(counts, ["collection", "field"]).select(F.trim("value").alias("relation"), F.lit("GENERIC_WITH_TYPE").alias("style"), "collection", F.col("field").alias("type_field"), F.col("value").alias("type_value"))
    own = edges.join(discriminators, "collection", "left_anti").select(naming.relationship_name(F.col("collection")).alias("relation"), F.lit("DEDICATED_COLLECTION").alias("style"), "collection", F.lit(None).cast("string").alias("type_field"), F.lit(None).cast("string").alias("type_value"))
    return typed.unionByName(own)


def resolved_endpoints(endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """relation, from_entity, to_entity: the one entity of all ends of a side, else Any. endpoints: relation, side, collection; entities: entity, collection."""
    named = endpoints.join(entities.select("collection", "entity"), "collection", "left")
    side = named.groupBy("relation", "side").agg(F.collect_set("entity").alias("found"))
    one = side.select("relation", "side", F.when(F.size("found") == 1, F.try_element_at("found", F.lit(1))).otherwise("Any").alias("entity"))
    return one.groupBy("relation").agg(F.max(F.when(F.col("side") == "from", F.col("entity"))).alias("from_entity"), F.max(F.when(F.col("side") == "to", F.col("entity"))).alias("to_entity"))


SHARD_FIELDS = ("repo", "source", "stream", "upstream")


def shard_families(fields: DataFrame, min_size: int = 2, min_suffix: int = 4) -> DataFrame:
    """family, members, discriminator: collections of equal field sets whose names share a suffix at a word boundary. fields: collection, field."""
    sets = fields.groupBy("collection").agg(F.array_sort(F.collect_set("field")).alias("fields")).withColumn("bucket", F.sha2(F.array_join("fields", "\0"), 256))
    boundary = F.expr("filter(sequence(1, length(collection)), i -> i = 1 or substr(collection, i, 1) rlike '[A-Z]' or substr(collection, i - 1, 1) in ('_', '-'))")
    suffixes = sets.select("bucket", "collection", "fields", F.explode(F.transform(boundary, lambda i: F.substr("collection", i, F.length("collection")))).alias("suffix"))
    sizes = sets.groupBy("bucket").agg(F.count("*").alias("members"), F.min("fields").alias("fields")).where(F.col("members") >= min_size)
    common = suffixes.where(F.length("suffix") >= min_suffix).groupBy("bucket", "suffix").agg(F.count("*").alias("n")).join(sizes, "bucket").where("n = members")
    w = Window.partitionBy("bucket").orderBy(F.length("suffix").desc(), "suffix")
    by = F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, SHARD_FIELDS)), lambda x: F.array_contains("fields", x)), F.lit(1)), F.lit("collection_prefix"))
    return common.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("suffix").alias("family"), "members", by.alias("discriminator"))


def sharding_kinds(collections: DataFrame) -> DataFrame:
    """Adds kind. collections: collection, is_system, is_satellite, is_smart."""
    kind = F.when(F.col("is_system") | F.col("collection").startswith("_"), "system").when(F.col("is_satellite"), "satellite").when(F.col("is_smart"), "smartgraph").otherwise("regular")
    return collections.withColumn("kind", kind)


def sharding_style(graphs: DataFrame, one_shard: Column) -> DataFrame:
    """style of the database. graphs: graph, is_smart, is_disjoint, is_satellite."""
    g = graphs.agg(F.coalesce(F.bool_or(F.col("is_smart") & F.col("is_disjoint")), F.lit(False)).alias("dis"), F.coalesce(F.bool_or("is_smart"), F.lit(False)).alias("smart"), F.coalesce(F.bool_and("is_satellite"), F.lit(False)).alias("sat"))
    return g.select(F.when(one_shard, "OneShard").when(F.col("dis"), "DisjointSmartGraph").when(F.col("smart"), "SmartGraph").when(F.col("sat"), "SatelliteGraph").otherwise("Sharded").alias("style"))


# Fixed values of tenancy detection.
TENANT_FIELDS = ("tenantId", "tenant_id", "TENANT_ID", "tenant", "orgId", "org_id", "organizationId", "accountId", "account_id", "customerId", "workspaceId")
TENANT_SCOPE = r"^tenant[_-]?(id|key)$"
MAX_HOPS = 5


def tenant_fields(fields: DataFrame, least: float = 0.5) -> DataFrame:
    """field, collections, share: tenant-like fields which at least half of the collections have. fields: collection, field."""
    total = fields.agg(F.count_distinct("collection").alias("total"))
    low = F.lower("field")
    hits = fields.where(F.lower("field").isin(*sorted({f.lower() for f in TENANT_FIELDS}))).groupBy(low.alias("field")).agg(F.count_distinct("collection").alias("collections"))
    return hits.crossJoin(total).withColumn("share", F.col("collections") / F.col("total")).where(F.col("share") >= least).drop("total")  # one row of totals


# How a collection's name tells its base and its tenant.
PER_TENANT = ((r"^([A-Za-z][A-Za-z0-9]+)__([A-Za-z0-9][A-Za-z0-9_-]+)$", 1, 2), (r"^([A-Za-z0-9][A-Za-z0-9_-]+?)_([A-Z][A-Za-z0-9]+)$", 2, 1))


def collections_per_tenant(collections: DataFrame) -> DataFrame:
    """base, tenants: names ``Base__tenant`` (or else ``tenant_Base``) with several tenants for a base."""
    (a, *first), (b, *second) = PER_TENANT
    part = lambda i: F.when(F.col("collection").rlike(a), F.regexp_extract("collection", a, first[i])).otherwise(F.regexp_extract("collection", b, second[i]))
    return collections.select(part(0).alias("base"), part(1).alias("tenant")).where("base <> ''").groupBy("base").agg(F.count_distinct("tenant").alias("tenants")).where("tenants >= 2")


#: What a tenant's shard key has in its name.
TENANT_TOKENS = ("tenant", "org", "account", "customer", "workspace")


def shard_keys(collections: DataFrame) -> DataFrame:
    """field, collections: tenant-like first shard keys that at least two collections share. collections: collection, shard_keys (array)."""
    first = F.try_element_at(F.filter("shard_keys", lambda k: (k != "") & (k != "_key")), F.lit(1))
    each = collections.select("collection", first.alias("field")).where(F.lower("field").rlike("|".join(TENANT_TOKENS)))
    return each.groupBy("field").agg(F.count_distinct("collection").alias("collections")).where("collections >= 2")


#: Names of databases that belong to one tenant.
TENANT_DATABASE = r"^tenant[_-]?[A-Za-z0-9]+$|^[A-Za-z0-9]+[_-]tenant$"


def tenancy_verdict(collections: DataFrame, fields: DataFrame, style: DataFrame, database: str = "") -> DataFrame:
    """style, enforced: the first signal that holds.

    In order: a disjoint smart graph, a tenant key first among the shard keys of two collections, a tenant field in half of the collections, collections named by tenant, a
    database named by tenant, none. collections: collection, shard_keys; fields: collection, field; style: as of ``sharding_style``.
    """
    any_of = lambda df, name: df.agg((F.count("*") > 0).alias(name))
    signals = any_of(style.where("style = 'DisjointSmartGraph'"), "smart").crossJoin(any_of(shard_keys(collections), "keys")).crossJoin(any_of(tenant_fields(fields), "field")).crossJoin(any_of(collections_per_tenant(collections), "named"))  # one row each
    own = F.lit(bool(database)) & F.lit(database).rlike(TENANT_DATABASE)
    order = [("smart", "disjoint_smartgraph", True), ("keys", "shard_key", True), ("field", "discriminator_field", False), ("named", "collection_per_tenant", True)]
    verdict = enforced = None
    for flag, name, hard in order:
        verdict = F.when(F.col(flag), name) if verdict is None else verdict.when(F.col(flag), name)
        enforced = F.when(F.col(flag), hard) if enforced is None else enforced.when(F.col(flag), hard)
    return signals.select(verdict.when(own, "unknown_single_db").otherwise("none").alias("style"), enforced.when(own, True).otherwise(False).alias("enforced"))


def reachable(edges: DataFrame, roots: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """entity, hops: what is at most ``hops`` undirected links from a root (entity). Breadth-first; each step joins the frontier only."""
    both = edges.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b")).union(edges.select("to_entity", "from_entity")).distinct()
    seen = roots.select("entity", F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        frontier = seen.where(F.col("hops") == k - 1).select(F.col("entity").alias("a"))
        new = both.join(frontier, "a").select(F.col("b").alias("entity")).distinct().join(seen, "entity", "left_anti")
        seen = seen.unionByName(new.withColumn("hops", F.lit(k)))
    return seen


#: Names of entities that are a tenant.
TENANT_ROOTS = ("Tenant",)


def tenant_scope(entities: DataFrame, edges: DataFrame, roots: tuple[str, ...] = TENANT_ROOTS, pattern: str = TENANT_SCOPE, hops: int = MAX_HOPS) -> DataFrame:
    """entity, scope: root, denormalised (a tenant id among its properties), reachable from the root, or global; nothing where there is no root.

    The first of ``roots`` that is an entity is the root. entities: entity, properties (array); edges: from_entity, to_entity.
    """
    order = F.array_position(F.array(*map(F.lit, roots)), F.col("entity"))
    root = entities.where(order > 0).orderBy(order).limit(1).select("entity")
    near = reachable(edges, root, hops).where("hops > 0").select(F.col("entity").alias("n"))
    own = F.exists("properties", lambda p: F.lower(p).rlike(pattern))
    both = entities.crossJoin(root.select(F.col("entity").alias("_root"))).join(near, F.col("entity") == F.col("n"), "left")  # one row of the root
    scope = F.when(F.col("entity") == F.col("_root"), "root").when(own, "denormalised").when(F.col("n").isNotNull(), "reachable").otherwise("global")
    return both.select("entity", scope.alias("scope"))


def tenant_coverage(catalog: Catalog, fields: tuple[str, ...] = TENANT_FIELDS) -> DataFrame:
    """field (lower case), collections, share (of all collections), rows, present, tenants (about): fields that may name a tenant, from one scan of each collection that has one.

    Numbers of tenants are unions of the collections' sketches, so tenants that several collections name count once.
    """
    wanted, docs = {f.lower() for f in fields}, catalog.user_collections()
    parts = []
    for c in docs:
        if own := [f for f in c.df.columns if f.lower() in wanted]:
            each = F.array(*(F.struct(F.lit(f.lower()).alias("field"), F.count("*").alias("rows"), F.count(named(f)).alias("present"), F.hll_sketch_agg(named(f).cast("string")).alias("sketch")) for f in own))
            parts.append(c.df.agg(each.alias("a")).select(F.lit(c.name).alias("collection"), F.inline("a")))
    empty = catalog.spark.createDataFrame([], "collection string, field string, rows long, present long, sketch binary")
    merged = union_all([empty, *parts]).groupBy("field").agg(F.count_distinct("collection").alias("collections"), F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("tenants"))
    return merged.select("field", "collections", (F.col("collections") / F.lit(max(len(docs), 1))).alias("share"), "rows", "present", "tenants")


def vertex_centric(indexes: DataFrame) -> DataFrame:
    """collection, access, extra: persistent indexes rooted at an edge's end with a field behind. indexes: collection, type, fields (array)."""
    vci = indexes.where((F.col("type") == "persistent") & F.try_element_at("fields", F.lit(1)).isin("_from", "_to") & (F.size("fields") > 1))
    ends = vci.groupBy("collection").agg(F.collect_set(F.try_element_at("fields", F.lit(1))).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("slice(fields, 2, size(fields))"))))).alias("extra"))
    access = F.when(F.size("ends") == 2, "both").when(F.array_contains("ends", "_from"), "out-edge").otherwise("in-edge")
    return ends.select("collection", access.alias("access"), F.array_join("extra", ",").alias("extra"))


def denormalised_fields(edge_fields: DataFrame, vertex_fields: DataFrame) -> DataFrame:
    """edge, vertex, field: fields that an edge collection shares with a vertex collection, system fields aside. Both: collection, field."""
    e = edge_fields.select(F.col("collection").alias("edge"), "field")
    v = vertex_fields.select(F.col("collection").alias("vertex"), "field")
    return e.join(v, "field").where(~F.col("field").isin("_key", "_id", "_rev", "_from", "_to")).select("edge", "vertex", "field")


# Fixed values of triple-store detection.
TRIPLE_NAMES = ("(?i)^_?triples?$", "(?i)_triples?$", "(?i)^s?p?o?_?quads?$", "(?i)^quads?$", "(?i)^statements?$", "(?i)^spo$")
TRIPLE_FIELDS = (("subject", "predicate", "object"), ("s", "p", "o"))


def triple_collections(fields: DataFrame) -> DataFrame:
    """collection, reason (name or fields) of RDF-like collections. fields: collection, field."""
    sets = fields.groupBy("collection").agg(F.collect_set(F.lower("field")).alias("f"))
    by_name = F.col("collection").rlike("|".join(TRIPLE_NAMES))
    by_fields = F.lit(False)
    for sig in TRIPLE_FIELDS:
        by_fields = by_fields | (F.size(F.array_except(F.array(*map(F.lit, sig)), F.col("f"))) == 0)
    return sets.select("collection", F.when(by_name, "name").when(by_fields, "fields").alias("reason")).where("reason is not null")


# Fixed values of retrieval-graph detection.
TEXT_FIELDS = ("text", "content", "body", "passage", "chunk", "chunk_text", "page_content", "document")
VECTOR_FIELDS = ("embedding", "embeddings", "vector", "vectors", "embedding_vector", "dense_vector")
SIMILARITY_FIELDS = ("score", "similarity", "distance", "cosine", "weight")
CHUNK_NAMES = ("(?i)chunks?$", "(?i)^text_?units?$", "(?i)passages?$", "(?i)embeddings?$")
ENTITY_NAMES = ("(?i)^entit(y|ies)$", "(?i)_entit(y|ies)$", "(?i)^nodes?$", "(?i)^concepts?$")
SIMILARITY_NAMES = ("(?i)similar", "(?i)^knn$", "(?i)neighbou?rs?$", "(?i)related")
MENTION_NAMES = ("(?i)mention", "(?i)has_?entit", "(?i)refers?_?to", "(?i)appears_?in", "(?i)contains_?entit")
DESCRIBING_FIELDS = ("type", "description", "entity_type", "category")


def retrieval_roles(fields: DataFrame) -> DataFrame:
    """collection, role. fields: collection, kind, field.

    A document collection with vectors, or with texts and a chunk's name, is chunk; one with an entity's name, or with names and a
    describing field, is entity. An edge collection is similarity by its name or a field, else mention by its name.
    """
    c = fields.groupBy("collection", "kind").agg(F.collect_set(F.lower("field")).alias("f"))
    has = lambda names: F.arrays_overlap("f", F.array(*map(F.lit, names)))
    called = lambda patterns: F.col("collection").rlike("|".join(patterns))
    doc = F.when(has(VECTOR_FIELDS) | (called(CHUNK_NAMES) & has(TEXT_FIELDS)), "chunk").when(called(ENTITY_NAMES) | (has(("name",)) & has(DESCRIBING_FIELDS)), "entity")
    edge = F.when(called(SIMILARITY_NAMES) | has(SIMILARITY_FIELDS), "similarity").when(called(MENTION_NAMES), "mention")
    return c.select("collection", F.when(F.col("kind") == "edge", edge).otherwise(doc).alias("role")).where("role is not null")


def is_retrieval_graph(roles: DataFrame) -> DataFrame:
    """categories, detected: two of the four roles make a retrieval graph."""
    return roles.agg(F.count_distinct("role").alias("categories")).withColumn("detected", F.col("categories") >= 2)


def graph_membership(graph_table: DataFrame, collections: DataFrame) -> DataFrame:
    """collection, graphs (comma-joined; empty for none)."""
    m = graph_table.select("graph", F.col("collection").alias("c")).distinct().groupBy("c").agg(F.array_join(F.array_sort(F.collect_set("graph")), ",").alias("graphs"))
    return collections.join(m, F.col("collection") == F.col("c"), "left").select("collection", F.coalesce("graphs", F.lit("")).alias("graphs"))


def product_suffixes(collections: DataFrame, suffixes: DataFrame) -> DataFrame:
    """collection, suffix: the longest known suffix of each name. suffixes: suffix."""
    j = collections.join(suffixes, F.expr("endswith(collection, suffix)"))
    w = Window.partitionBy("collection").orderBy(F.length("suffix").desc())
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("collection", "suffix")


def domain_scores(signals: DataFrame, vocabulary: DataFrame, least: float = 0.15) -> DataFrame:
    """domain, matched, keywords, confidence: the share of a domain's keywords among the signals, doubled, at most 1. signals: token; vocabulary: domain, keyword."""
    s = signals.select(F.col("token").alias("keyword"), F.lit(1).alias("hit")).distinct()
    score = vocabulary.distinct().join(s, "keyword", "left").groupBy("domain").agg(F.count("hit").alias("matched"), F.count("*").alias("keywords"))
    share = F.col("matched") / F.col("keywords")
    return score.withColumn("confidence", F.round(F.least(2 * share, F.lit(1.0)), 2)).where(share >= least)


def reconciled(entities: DataFrame, baseline: DataFrame, collections: DataFrame) -> DataFrame:
    """Entities (entity, collection) of known collections, completed by baseline ones for collections that none covers; with source."""
    kept = entities.join(collections.select("collection"), "collection", "left_semi").withColumn("source", F.lit("given"))
    missing = baseline.join(kept.select("collection"), "collection", "left_anti").withColumn("source", F.lit("baseline"))
    return kept.unionByName(missing)


def carried_forward(current: DataFrame, prior: DataFrame, now: str) -> DataFrame:
    """name, first_seen, last_validated: known names keep their first date. Both: name; prior: first_seen."""
    p = prior.select("name", F.col("first_seen").alias("was"))
    return current.join(p, "name", "left").select("name", F.coalesce("was", F.lit(now)).alias("first_seen"), F.lit(now).alias("last_validated"))


def redaction_tokens(values: DataFrame, value: str = "value") -> DataFrame:
    """value, token: ``<redacted>:i`` for the distinct values of the column in order, from 0. Numbers come from ranges of the values, not from one task."""
    distinct = values.select(named(value).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(distinct, ["value"]).select("value", F.concat(F.lit("<redacted>:"), F.col("n").cast("string")).alias("token"))


def field_tokens(fields: DataFrame) -> DataFrame:
    """field, token: ``redacted_field_i`` for the distinct field names in order, system fields aside. fields: field (metadata)."""
    names = fields.select("field").where(~F.col("field").startswith("_")).distinct()
    return numbered(names, ["field"]).select("field", F.concat(F.lit("redacted_field_"), F.col("n").cast("string")).alias("token"))


def masked(df: DataFrame, columns: list[str], tokens: DataFrame) -> DataFrame:
    """``df`` with the values of ``columns`` replaced by their tokens (value, token); a value without one becomes null rather than stay."""
    return _replaced(df, columns, tokens.select(F.col("value").alias("_old"), F.col("token").alias("_new")), keep=False)


def unmasked(df: DataFrame, columns: list[str], tokens: DataFrame) -> DataFrame:
    """The tokens in ``columns`` turned back by a table of tokens (value, token); what it lacks stays."""
    return _replaced(df, columns, tokens.select(F.col("token").alias("_old"), F.col("value").alias("_new")), keep=True)


def _replaced(df: DataFrame, columns: list[str], pairs: DataFrame, keep: bool) -> DataFrame:
    for c in columns:
        joined = df.join(pairs, named(c).cast("string") == F.col("_old"), "left")
        new = F.coalesce("_new", named(c).cast("string")) if keep else F.col("_new")
        df = joined.select(*(new.alias(x) if x == c else named(x) for x in df.columns))
    return df


def keyed_token(value: Column, key: bytes) -> Column:
    """``<redacted>:`` and the value's HMAC-SHA256 under a key (64 bytes at most): equal values have equal tokens, and without the key none can be guessed and checked."""
    if not 0 < len(key) <= 64:
        raise ValueError("INVALID_ARGUMENT: a key has 1 to 64 bytes")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), value.cast("string").cast("binary")), 256))
    return F.when(value.isNotNull(), F.concat(F.lit("<redacted>:"), F.sha2(F.concat(pad(0x5C), inner), 256)))


def redacted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """``df`` with its ``columns`` replaced by keyed tokens: no table of tokens and no join."""
    return df.select(*(keyed_token(named(c), key).alias(c) if c in columns else named(c) for c in df.columns))


def unknown_pattern_parts(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Labels and types of a pattern that the model lacks. Both: kind, name."""
    return asked.join(known, ["kind", "name"], "left_anti")


def discriminator_taxonomy(entities: DataFrame) -> DataFrame:
    """child, parent: LABEL entities of one collection under its whole-collection entity. entities: entity, style, collection."""
    parent = entities.where("style = 'COLLECTION'").select("collection", F.col("entity").alias("parent"))
    labels = entities.where("style = 'LABEL'")
    many = labels.groupBy("collection").agg(F.count("*").alias("n")).where("n >= 2")
    return labels.join(many, "collection").join(parent, "collection").select(F.col("entity").alias("child"), "parent")

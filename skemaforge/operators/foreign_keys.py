"""Foreign keys that no edge collection states: found from names, index flags and id-shaped values, checked on values, merged into a model.

Inputs are metadata tables (a row a field); the only work on rows is the index of values (``inclusion``): a scan of each collection as the one that
refers, and one as the one referred to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.functions import naming
from skemaforge.operators import inclusion, relational
from skemaforge.sources.catalog import Catalog, union_all

# Fixed values of foreign-key inference.
GENERIC_KEYS = ("id", "uuid", "pk", "key")
IDENTITY_FIELDS = ("_key", "_id")
MIN_CONFIDENCE, CANDIDATES, PROBED_VALUES, PROBES = 0.4, 3, 50, 200
FOUND = ("collection", "fields", "target", "target_fields", "method", "confidence")
PROBE = "collection string, field string, target string, target_field string, ratio double"


def shapes(catalog: Catalog) -> DataFrame:
    """collection, field, category, is_unique of all document collections, from schemas and indexes alone."""
    docs = [c for c in catalog.user_collections() if c.kind == "document"]
    unique = [(c.name, i["fields"][0]) for c in docs for i in c.indexes if i.get("unique") and len(i["fields"]) == 1]
    flags = catalog.spark.createDataFrame(unique, "collection string, field string").distinct().withColumn("is_unique", F.lit(True))
    own = catalog.fields().join(catalog.listing().where("kind = 'document'"), "collection", "left_semi")
    return own.join(flags, ["collection", "field"], "left").withColumn("is_unique", F.coalesce("is_unique", F.lit(False)))


def text_fields(catalog: Catalog) -> dict[str, list[str]]:
    """The text columns of document collections, whose values may be ids."""
    return {c.name: [f for f, kind in c.df.dtypes if kind == "string" and not f.startswith("_")] for c in catalog.user_collections() if c.kind == "document"}


def id_shape_votes(catalog: Catalog, sampled: int = PROBED_VALUES, sample: DataFrame | None = None) -> DataFrame:
    """collection, field, target, ratio: where most of a text field's sampled values are ids of one collection, over all of them. One scan a collection; ``sample`` saves it."""
    fields = text_fields(catalog)
    sample = sample if sample is not None else inclusion.sampled(catalog, fields, sampled)
    texts = catalog.spark.createDataFrame([(c, f) for c, own in fields.items() for f in own], "collection string, field string")
    return most_voted(sample.join(texts, ["collection", "field"], "left_semi").select("collection", "field", F.col("prefix").alias("target")), catalog.listing())


def votes(values: DataFrame, collections: DataFrame) -> DataFrame:
    """As ``id_shape_votes`` from values: collection, field, v. Ties go to the first name; a target must be one of ``collections``."""
    prefix = F.when(naming.is_id_shaped(F.col("v")), naming.collection_of(F.col("v")))
    return most_voted(values.select("collection", "field", prefix.alias("target")), collections)


def most_voted(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """The target with the most rows of each field (collection, field, target; null counts against all), if it is one of ``collections``."""
    hits = rows.groupBy("collection", "field", "target").agg(F.count("*").alias("hits"))
    field = Window.partitionBy("collection", "field")
    best = hits.withColumn("total", F.sum("hits").over(field)).where("target is not null").withColumn("k", F.row_number().over(field.orderBy(F.col("hits").desc(), "target")))
    known = collections.select(F.col("collection").alias("target"))
    return best.where("k = 1").join(known, "target", "left_semi").select("collection", "field", "target", (F.col("hits") / F.col("total")).alias("ratio"))


def id_prefix_votes(values: DataFrame, field: str) -> DataFrame:
    """prefix, hits, total, ratio: the most frequent collection of one field's id-shaped values, over all values."""
    v = values.where(F.col(field).isNotNull())
    hits = v.where(naming.is_id_shaped(F.col(field))).groupBy(naming.collection_of(F.col(field)).alias("prefix")).agg(F.count("*").alias("hits"))
    top = hits.orderBy(F.col("hits").desc(), "prefix").limit(1)
    return top.crossJoin(v.agg(F.count("*").alias("total"))).withColumn("ratio", F.col("hits") / F.col("total"))  # one row each


def single_candidates(fields: DataFrame, id_votes: DataFrame, known: DataFrame | None = None, key: str = "_key") -> DataFrame:
    """FOUND columns of one-field candidates. fields: as ``shapes``; known: from_collection, to_collection that edges link already.

    Rules and bases: id-shaped values (0.6 + 0.35 x ratio, target ``_id``); ``xxx_id`` and ``xxx_key`` (0.75); ``xxxId`` and ``xxxKey`` (0.75);
    ``xxx_field`` where field is the target's key or a unique field of it (0.6); ``xxxid`` (0.45); the name of another's key (0.55). A
    unique field as target costs 0.05. Types must be compatible, equal ones add 0.1 and a unique referring field 0.05, except for
    ``_key`` and ``_id``, which are text whatever they stand for. At most three a field, the best of equal targets.
    """
    f = fields.where(~F.col("field").startswith("_")).select("collection", "field", "category", "is_unique")
    low, camel = F.lower("field"), naming.camel_reference(F.col("field"))
    head, tail = F.regexp_extract(low, r"^(.+)_([^_]{2,})$", 1), F.regexp_extract(low, r"^(.+)_([^_]{2,})$", 2)
    cut = lambda k: F.left(low, F.length(low) - k)
    rule = lambda method, ref, base, suffix=None: F.struct(F.lit(method).alias("method"), naming.normalized(F.coalesce(ref, F.lit(""))).alias("ref"), F.lit(base).alias("base"), (F.lit(None).cast("string") if suffix is None else naming.normalized(suffix)).alias("suffix"))
    rules = F.array(
        rule("name_suffix", F.when(low.endswith("_id") & (F.length(low) > 3), cut(3)), 0.75),
        rule("name_suffix", F.when(low.endswith("_key") & (F.length(low) > 4), cut(4)), 0.75),
        rule("camel_suffix", F.when(F.length(camel) >= 2, camel), 0.75),
        rule("name_suffix", F.when((head != "") & ~tail.isin("id", "key"), head), 0.6, tail),
        rule("name_no_underscore", F.when(low.endswith("id") & ~low.endswith("_id") & (camel == "") & (F.length(low) > 3) & (low != "uuid"), cut(2)), 0.45),
    )
    asked = f.select("*", F.explode(rules).alias("r")).select("collection", "field", "category", "is_unique", "r.*").where("ref <> ''")
    targets = fields.where((F.col("field") == key) | F.col("is_unique")).where((F.col("field") == key) | (naming.normalized(F.col("field")) != naming.normalized(F.lit(key)))).where(~F.col("field").isin("_id"))
    targets = targets.select(F.col("collection").alias("target"), F.col("field").alias("target_field"), F.col("category").alias("target_category"), F.when(F.col("field") == key, 0.0).otherwise(0.05).alias("penalty"))
    named = targets.withColumn("ref", F.explode(naming.name_variants(F.col("target"))))
    fits = F.when(F.col("suffix").isNull(), F.col("target_field") == key).otherwise(F.col("suffix") == naming.normalized(F.col("target_field")))
    by_name = asked.join(named, "ref").where(fits).withColumn("base", F.col("base") - F.col("penalty"))
    by_key = f.where(~low.isin(*GENERIC_KEYS)).withColumn("same", naming.normalized(F.col("field"))).join(targets.where(F.col("target_field") == key).withColumn("same", naming.normalized(F.col("target_field"))), "same").withColumns({"method": F.lit("key_name_match"), "base": F.lit(0.55)})
    by_value = f.join(id_votes, ["collection", "field"]).withColumns({"target_field": F.lit("_id"), "target_category": F.lit("string"), "method": F.lit("id_shape"), "base": 0.6 + 0.35 * F.col("ratio")})
    cols = ["collection", "field", "category", "is_unique", "method", "base", "target", "target_field", "target_category"]
    found = by_name.select(*cols).unionByName(by_key.select(*cols)).where(F.col("collection") != F.col("target")).unionByName(by_value.select(*cols))
    if known is not None:
        found = found.join(known, (F.col("collection") == F.col("from_collection")) & (F.col("target") == F.col("to_collection")), "left_anti")
    identity = F.col("target_field").isin(*IDENTITY_FIELDS)
    number = lambda c: F.col(c).isin("integer", "float", "number")
    equal = F.col("category") == F.col("target_category")
    compatible = identity | equal | (F.col("category") == "unknown") | (F.col("target_category") == "unknown") | (number("category") & number("target_category"))
    score = F.col("base") + F.when(identity, 0.0).otherwise(F.when(equal, 0.1).otherwise(0.0) + F.when(F.col("is_unique"), 0.05).otherwise(0.0))
    scored = found.where(compatible).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("collection", "field").orderBy(F.col("confidence").desc(), "target", "target_field", "method"))).where(F.col("k") <= CANDIDATES)
    once = best.withColumn("k", F.row_number().over(Window.partitionBy("collection", "field", "target", "target_field").orderBy(F.col("confidence").desc(), "method"))).where("k = 1")
    return once.select("collection", F.array("field").alias("fields"), "target", F.array("target_field").alias("target_fields"), "method", "confidence")


def composites(single: DataFrame) -> DataFrame:
    """FOUND columns: several fields of a collection that point at one target, id-shaped values aside; 0.05 above the weakest."""
    part = F.struct(F.element_at("fields", 1).alias("f"), F.element_at("target_fields", 1).alias("t"))
    g = single.where("method <> 'id_shape'").groupBy("collection", "target").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("confidence").alias("least")).where(F.size("parts") > 1)
    return g.select("collection", F.col("parts.f").alias("fields"), "target", F.col("parts.t").alias("target_fields"), F.lit("composite").alias("method"), F.round(F.least(F.lit(1.0), F.col("least") + 0.05), 3).alias("confidence"))


def pairs(candidates: DataFrame) -> DataFrame:
    """position, and the pairs of fields of each candidate."""
    return candidates.select("collection", "target", "confidence", F.explode(F.arrays_zip(F.col("fields").alias("field"), F.col("target_fields").alias("target_field"))).alias("p")).select("collection", F.col("p.field").alias("field"), "target", F.col("p.target_field").alias("target_field"), "confidence")


def probes(catalog: Catalog, candidates: DataFrame, limit: int = PROBES, sampled: int | None = PROBED_VALUES, sample: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Containment of each pair of fields, the most confident first, at most ``limit``; and whether some had to be left out.

    One index answers all pairs: a scan of each collection that is referred to, and one of those that refer unless their ``sample`` is given.
    """
    asked = pairs(candidates).groupBy("collection", "field", "target", "target_field").agg(F.max("confidence").alias("c")).orderBy(F.col("c").desc(), "collection", "field", "target", "target_field").limit(limit + 1).collect()
    wanted = [(r["collection"], r["field"], r["target"], r["target_field"]) for r in asked[:limit]]
    if sampled is not None and sample is None:
        sample = inclusion.held(inclusion.sampled(catalog, {c: sorted({f for x, f, *_ in wanted if x == c}) for c in {x[0] for x in wanted}}, sampled))
    return inclusion.contained(catalog, wanted, sample if sampled is not None else None), len(asked) > limit


def with_probes(candidates: DataFrame, probed: DataFrame, veto: bool = True) -> DataFrame:
    """Ratios (as of ``probes``) folded into confidences: a mean of 0.9 adds 0.15, of 0.5 adds 0.05; no value contained at all vetoes (or takes 0.25). Pairs without a ratio change nothing."""
    own = candidates.withColumn("n", F.monotonically_increasing_id())
    at = own.select("n", "collection", "target", F.explode(F.arrays_zip(F.col("fields").alias("field"), F.col("target_fields").alias("target_field"))).alias("p")).select("n", "collection", "target", "p.*")
    met = at.join(probed, ["collection", "field", "target", "target_field"]).where("ratio is not null").groupBy("n").agg(F.avg("ratio").alias("mean"), F.min("ratio").alias("least"))
    add = F.when(F.col("mean").isNull(), 0.0).when(F.col("mean") >= 0.9, 0.15).when(F.col("mean") >= 0.5, 0.05).when(F.col("mean") <= 0, -0.25).otherwise(0.0)
    out = own.join(met, "n", "left").withColumn("confidence", F.round(F.least(F.greatest(F.col("confidence") + add, F.lit(0.0)), F.lit(1.0)), 3))
    if veto:
        out = out.where(F.col("least").isNull() | (F.col("least") > 0))
    return out.select(*FOUND)


def accepted(candidates: DataFrame) -> DataFrame:
    """Those of enough confidence, with rank: most confident first, then by collection and fields."""
    order = Window.orderBy(F.col("confidence").desc(), "collection", "fields", "target", "target_fields")  # metadata: a row a candidate
    return candidates.where(F.col("confidence") >= MIN_CONFIDENCE).withColumn("rank", F.row_number().over(order))


def infer(catalog: Catalog, known: DataFrame | None = None, limit: int = PROBES, sampled: int | None = PROBED_VALUES, probe: Callable[..., tuple[DataFrame, bool]] = probes) -> tuple[DataFrame, bool]:
    """Ranked candidates of a catalog after their probes, and whether the probes' budget ran out. ``probe`` may be another function like ``probes``.

    Text fields and those whose name refers to something are sampled together, so each collection is scanned once before the probes.
    """
    fields = shapes(catalog)
    none = catalog.spark.createDataFrame([], "collection string, field string, target string, ratio double")
    columns = {c: set(own) for c, own in text_fields(catalog).items()}
    for r in single_candidates(fields, none, known).select("collection", F.element_at("fields", 1).alias("field")).distinct().collect():
        columns[r["collection"]].add(r["field"])
    sample = inclusion.held(inclusion.sampled(catalog, {c: sorted(f) for c, f in columns.items()}, sampled or PROBED_VALUES))
    single = single_candidates(fields, id_shape_votes(catalog, sample=sample), known)
    both = single.unionByName(composites(single))
    both = catalog.spark.createDataFrame(both.collect(), both.schema)  # metadata: a few rows a field
    probed, short = probe(catalog, both, limit, sampled, **({"sample": sample} if probe is probes else {}))
    return accepted(with_probes(both, probed)), short


def merged(ranked: DataFrame, entities: DataFrame, taken: DataFrame) -> DataFrame:
    """relation, from_entity, to_entity with the candidate's columns; an endpoint that is no whole-collection entity drops it.

    entities: entity, style, collection; taken: relation. Names are HAS_ and the target's singular; further ones and taken ones also name the
    first field, and then a number.
    """
    whole = entities.where("style = 'COLLECTION'")
    a, b = whole.select(F.col("collection").alias("ca"), F.col("entity").alias("from_entity")), whole.select(F.col("collection").alias("cb"), F.col("entity").alias("to_entity"))
    j = ranked.join(a, F.col("collection") == F.col("ca")).join(b, F.col("target") == F.col("cb")).drop("ca", "cb")
    j = j.withColumn("name", F.concat(F.lit("HAS_"), F.upper(naming.singularize(F.col("to_entity")))))
    used = taken.select(F.col("relation").alias("name")).distinct().withColumn("used", F.lit(1))
    j = j.join(used, "name", "left").withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("rank")) + F.coalesce("used", F.lit(0)))
    j = j.withColumn("via", F.when(F.col("nth") > 1, F.concat(F.col("name"), F.lit("_VIA_"), F.upper(F.element_at("fields", 1)))))
    again = used.withColumnRenamed("name", "via").withColumnRenamed("used", "again")
    j = j.join(again, "via", "left").withColumn("mth", F.row_number().over(Window.partitionBy("via").orderBy("rank")) + F.coalesce("again", F.lit(0)))
    relation = F.when(F.col("via").isNull(), F.col("name")).when(F.col("mth") > 1, F.concat("via", F.lit("_"), F.col("mth").cast("string"))).otherwise(F.col("via"))
    return j.select(relation.alias("relation"), "from_entity", "to_entity", *FOUND, "rank")


#: Fixed values of the search for specialisations by keys.
KEY_CONTAINED, KEY_SAMPLE = 0.99, 200


def key_containments(catalog: Catalog, names: list[str] | None = None, sampled: int | None = KEY_SAMPLE) -> DataFrame:
    """child, parent, ratio of document collections whose keys are (nearly) all keys of another. All pairs come out of one index of the keys."""
    keys = {n: ["_key"] for n in (names if names is not None else [c.name for c in catalog.user_collections() if c.kind == "document"])}
    if sampled is None:
        children = parents = inclusion.hashes(catalog, keys)
    else:
        children = inclusion.held(inclusion.sampled(catalog, keys, sampled)).select("collection", "field", "h")
        parents = inclusion.looked_up(catalog, keys, children)
    found = inclusion.matches(children, parents).select(F.col("collection").alias("child"), F.col("target").alias("parent"), (F.col("hits") / F.col("values")).alias("ratio"))
    return found.where(F.col("ratio") >= KEY_CONTAINED)


def specialisations(catalog: Catalog, contained: DataFrame) -> DataFrame:
    """parent, total, in_multiple, in_none for each parent of several children in ``contained`` (child, parent: metadata)."""
    children: dict[str, list[str]] = {}
    for r in contained.select("child", "parent").orderBy("child").collect():
        children.setdefault(r["parent"], []).append(r["child"])
    df = lambda n: catalog.collections[n].df
    parts = [relational.specialisation_counts(df(p), [df(c) for c in own]).select(F.lit(p).alias("parent"), "total", "in_multiple", "in_none") for p, own in sorted(children.items()) if len(own) > 1]
    return union_all([catalog.spark.createDataFrame([], "parent string, total long, in_multiple long, in_none long"), *parts])

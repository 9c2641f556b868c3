"""From a catalog to a conceptual model with its mapping and statistics: a few jobs a collection, then rules on metadata."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemaforge.functions import naming
from skemaforge.operators import foreign_keys, inference, metrics, profile, structure, taxonomy
from skemaforge.sources.catalog import SYSTEM_FIELDS, Catalog, Collection, named, type_category, union_all

from .mapping import PhysicalMapping

COUNTS = "collection string, kind string, field string, value string, count long"


@dataclass
class Analysis:
    """Metadata only; rows stay in Spark."""

    conceptual: dict
    mapping: dict
    statistics: list[dict]
    shape: str
    counts: dict[str, int]
    extra: dict = field(default_factory=dict)

    def physical(self, catalog: Catalog) -> PhysicalMapping:
        return PhysicalMapping(catalog, self.mapping["entities"], self.mapping["relationships"])

    def to_json(self) -> str:
        return json.dumps({"conceptualSchema": self.conceptual, "physicalMapping": self.mapping, "statistics": self.statistics, "shape": self.shape, "counts": self.counts} | self.extra, sort_keys=True, separators=(",", ":"))


def candidate_fields(c: Collection) -> list[str]:
    """Preferred names in order, then the other string fields whose name may discriminate. Their sketches tell which are worth counting."""
    strings = [f.name for f in c.df.schema.fields if type_category(f.dataType.typeName()) == "string" and f.name not in SYSTEM_FIELDS]
    preferred = [n for n in inference.PREFERRED[c.kind] if n in strings]
    spark = c.df.sparkSession
    rest = [n for n in strings if n not in preferred]
    ok = {r["n"] for r in spark.createDataFrame([(n,) for n in rest], "n string").where(naming.may_discriminate(F.col("n"))).collect()} if rest else set()
    return preferred + [n for n in rest if n in ok]


def shape_of(catalog: Catalog) -> str:
    """A digest of collections, kinds, fields and indexes; no scan."""
    rows = sorted(f"{c.name}:{c.kind}:{sorted(c.df.dtypes)}:{sorted(json.dumps(i, sort_keys=True) for i in c.indexes)}" for c in catalog.user_collections())
    return hashlib.sha256("|".join(rows).encode()).hexdigest()


def _counted(catalog: Catalog, collections: list[Collection], fields_of, most: int = inference.MAX_DISTINCT) -> tuple[DataFrame, DataFrame]:
    """Row totals and value counts of all collections: of label-like fields all values, of others only those that most rows can have."""
    spark = catalog.spark
    totals, counts = [spark.createDataFrame([], "collection string, kind string, rows long")], [spark.createDataFrame([], COUNTS)]
    for c in collections:
        name, kind = F.lit(c.name).alias("collection"), F.lit(c.kind).alias("kind")
        totals.append(c.df.agg(F.count("*").alias("rows")).select(name, kind, "rows"))
        if fields := fields_of(c):
            counts.append(profile.bounded_counts(c.df, fields, cap=max(most, profile.TOP_K + profile.OVERFLOW_K)).select(name, kind, "field", "value", "count"))
    local = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  a row a collection, or a value of a label-like field
    return local(union_all(totals)), union_all(counts).cache()


def _named(rows: list[dict], key: str) -> dict[str, dict]:
    """By name; of equal names the later ones (by collection) also carry their collection's name."""
    out: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r[key], r["collection"])):
        name = r[key] if r[key] not in out else f"{r[key]}_{r['collection']}"
        out[name] = {k: v for k, v in r.items() if k != key and v is not None}
    return out


def analyze(catalog: Catalog, graph: str | None = None, foreign: bool = True, label_floor: int = 0, domains: DataFrame | None = None, prior: Analysis | None = None, abstract: bool = False) -> Analysis:
    """The model of a catalog: value counts, entities, relationships by edges and (``foreign``) by columns, statistics, detectors, quality.

    ``label_floor``: label sets of up to 10,000 values, of those with at least so many rows. ``domains`` (domain, keyword): vocabularies by which the model's domain is
    told. ``prior``: since when each part is known. ``abstract``: groups of entities that share properties become their abstract parents. An empty catalog gives an
    empty model and says so among its reasons.
    """
    collections = catalog.user_collections(graph=graph)
    spark = catalog.spark
    most = profile.HARD_CAP if label_floor > 0 else inference.MAX_DISTINCT
    totals, counts = _counted(catalog, collections, candidate_fields, most)
    if label_floor > 0:
        counts = counts.where(F.col("count") >= label_floor)
    chosen = {k: inference.choose_discriminator(counts.where(F.col("kind") == k), totals, k, most) for k in ("document", "edge")}
    one = inference.single_value_edges(counts.where("kind = 'edge'").where(F.col("field").isin(*inference.PREFERRED["edge"])))
    covers = one.join(totals, "collection").join(counts.select("collection", "field", "value", "count"), ["collection", "field", "value"]).where(F.col("count") >= inference.COVERAGE * F.col("rows"))
    first = covers.groupBy("collection").agg(F.min("field").alias("field")).join(chosen["edge"], "collection", "left_anti").withColumn("distinct", F.lit(1).cast("long"))
    typed_edges = chosen["edge"].unionByName(first)
    docs, edges = ([c.name for c in collections if c.kind == k] for k in ("document", "edge"))
    table = lambda names: spark.createDataFrame([(n,) for n in names], "collection string")
    entities = _named([r.asDict() for r in inference.baseline_entities(table(docs), chosen["document"], counts).collect()], "entity")
    relationships = _named([r.asDict() for r in inference.baseline_relationships(table(edges), typed_edges, counts).collect()], "relation")
    linked = _linked(catalog, entities, relationships)
    for name, m in relationships.items():
        for side in ("from", "to"):
            found = {r[f"{side}_entity"] for r in linked if r["relation"] == name} - {None} or _by_graph(catalog, m["collection"], side, entities)
            m[f"{side}_entity"] = next(iter(found)) if len(found) == 1 else "Any"
            if len(found) > 1:
                m[f"{side}_entities"] = sorted(found)
    _describe(catalog, collections, entities)
    statistics = _statistics(catalog, entities, relationships, linked, totals, counts)
    properties = _properties(catalog, entities)
    extra = {}
    if foreign and docs:
        extra["foreignKeys"] = _add_foreign_keys(catalog, entities, relationships, linked)
    conceptual = {
        "entities": [{"name": n, "properties": properties[n]} for n in sorted(entities)],
        "relationships": [{"type": n, "fromEntity": m["from_entity"], "toEntity": m["to_entity"]} for n, m in sorted(relationships.items())],
    }
    extra["detected"] = _detected(catalog, collections, entities)
    extra |= _enriched(catalog, collections, conceptual, extra["detected"], counts, domains, prior)
    if abstract:
        conceptual = taxonomy.merged(conceptual, extra["taxonomy"]["abstractClasses"])
    extra["quality"] = _quality(spark, conceptual, entities, catalog)
    styles = [(m["style"],) for part in (entities, relationships) for m in part.values()]
    extra["patterns"] = sorted(r["pattern"] for r in structure.detected_patterns(spark.createDataFrame(styles, "style string")).collect())
    counts.unpersist()
    return Analysis(conceptual, {"entities": entities, "relationships": relationships}, statistics, shape_of(catalog), {r["collection"]: r["rows"] for r in totals.collect()}, extra)


def _linked(catalog: Catalog, entities: dict, relationships: dict) -> list[dict]:
    """relation, from_entity, to_entity, from_c, to_c, edges: one pass over each edge collection, whatever its number of types."""
    spark, out = catalog.spark, []
    whole = [m["collection"] for m in entities.values() if m["style"] == "COLLECTION"]
    shared = {m["collection"]: m["type_field"] for m in entities.values() if m["style"] == "LABEL"}
    names = spark.createDataFrame([(m["collection"], m.get("type_value", ""), n) for n, m in entities.items()], "c string, v string, e string")
    typed = union_all([catalog.collections[c].df.select(F.col("_id").alias("id"), named(f).cast("string").alias("value")) for c, f in shared.items()]) if shared else None
    by_edges: dict[str, list[str]] = {}
    for n, m in relationships.items():
        by_edges.setdefault(m["collection"], []).append(n)
    for collection, own in by_edges.items():
        field_ = relationships[own[0]].get("type_field")
        kind = named(field_).cast("string") if field_ else F.lit("")
        rows = catalog.collections[collection].df.select("_from", "_to", kind.alias("kind"))
        for side in ("from", "to"):
            rows = rows.withColumn(f"{side}_c", naming.collection_of(F.col(f"_{side}")))
        if typed is None:
            rows = rows.withColumns({"from_v": F.lit(""), "to_v": F.lit("")})
        else:
            often = profile.hubs(rows, "_from", "_to")
            for side in ("from", "to"):
                rows = profile.with_end(rows, f"_{side}", typed, f"{side}_v", often[f"_{side}"])
        g = rows.groupBy("kind", "from_c", "from_v", "to_c", "to_v").agg(F.count("*").alias("edges"))
        for side in ("from", "to"):
            known = names.select(F.col("c").alias("nc"), F.col("v").alias("nv"), F.col("e").alias(f"{side}_entity"))
            value = F.when(F.col(f"{side}_c").isin(*whole), F.lit("")).otherwise(F.coalesce(f"{side}_v", F.lit("")))
            g = g.join(known, (F.col(f"{side}_c") == F.col("nc")) & (value == F.col("nv")), "left").drop("nc", "nv")
        relation = {relationships[n].get("type_value", ""): n for n in own}
        out += [r.asDict() | {"relation": relation[r["kind"]]} for r in g.collect() if r["kind"] in relation]
    return out


def _by_graph(catalog: Catalog, edges: str, side: str, entities: dict) -> set[str]:
    """Entities that the graphs' definitions name as an edge collection's ends: what an empty collection's rows can't tell."""
    ends = {c for g in catalog.graphs.values() for e, a, b in g.edge_definitions if e == edges for c in (a if side == "from" else b)}
    return {n for n, m in entities.items() if m["style"] == "COLLECTION" and m["collection"] in ends}


def _statistics(catalog: Catalog, entities: dict, relationships: dict, linked: list[dict], totals: DataFrame, counts: DataFrame) -> list[dict]:
    if not relationships:
        return []
    spark = catalog.spark
    names = spark.createDataFrame([(n, m["collection"], m.get("type_field", ""), m.get("type_value", "")) for n, m in entities.items()], "entity string, c string, f string, v string")
    whole = names.where("f = ''").join(totals, F.col("c") == F.col("collection")).select("entity", "rows")
    labelled = names.where("f <> ''").join(counts, (F.col("c") == F.col("collection")) & (F.col("f") == F.col("field")) & (F.col("v") == F.col("value"))).select("entity", F.col("count").alias("rows"))
    ends = [(n, m["from_entity"], m["to_entity"], sum(r["edges"] for r in linked if r["relation"] == n)) for n, m in relationships.items() if "collection" in m]
    found = metrics.relationship_statistics(spark.createDataFrame(ends, "relation string, from_entity string, to_entity string, edges long"), whole.unionByName(labelled))
    return [r.asDict() for r in found.orderBy("relation").collect()]


def _properties(catalog: Catalog, entities: dict) -> dict[str, list[str]]:
    """Fields with a value, by entity: one pass a collection, shared or not."""
    out, parts = {n: [] for n in entities}, []
    by_place = {(m["collection"], m.get("type_value", "")): n for n, m in entities.items()}
    for collection, field_ in {(m["collection"], m.get("type_field", "")) for m in entities.values()}:
        rows = catalog.collections[collection].df
        found = profile.observed_fields_by_type(rows, field_) if field_ else profile.observed_fields(rows).withColumn("type", F.lit(""))
        parts.append(found.select(F.lit(collection).alias("collection"), F.col("type").cast("string").alias("type"), "field"))
    for r in union_all(parts).collect() if parts else []:
        if (place := (r["collection"], r["type"])) in by_place:
            out[by_place[place]].append(r["field"])
    return {n: sorted(f) for n, f in out.items()}


def _add_foreign_keys(catalog: Catalog, entities: dict, relationships: dict, linked: list[dict]) -> dict:
    """Adds what columns refer to, and tells how many there were, how many were probed in vain of a budget, and what has no entity."""
    spark = catalog.spark
    known = spark.createDataFrame(sorted({(r["from_c"], r["to_c"]) for r in linked}), "from_collection string, to_collection string")
    ranked, short = foreign_keys.infer(catalog, known)
    names = spark.createDataFrame([(n, m["style"], m["collection"]) for n, m in entities.items()], "entity string, style string, collection string")
    taken = spark.createDataFrame([(n,) for n in relationships], "relation string")
    ranked = spark.createDataFrame(ranked.collect(), ranked.schema)  # metadata
    found = foreign_keys.merged(ranked, names, taken).orderBy("rank").collect()
    for r in found:
        relationships[r["relation"]] = {
            "style": "FOREIGN_KEY", "from_collection": r["collection"], "from_fields": list(r["fields"]), "to_collection": r["target"], "to_key_fields": list(r["target_fields"]),
            "from_entity": r["from_entity"], "to_entity": r["to_entity"], "confidence": r["confidence"], "method": r["method"], "enforced": False,
        }
    n = ranked.count()
    return {"status": "degraded" if short else "ok", "candidates": n, "added": len(found), "unmapped": n - len(found), "budget": foreign_keys.PROBES}


def _describe(catalog: Catalog, collections: list[Collection], entities: dict) -> None:
    """Adds to entities what their label was where the name lost it, and their collection's indexes: all but the primary one, and the fields that they serve."""
    spark = catalog.spark
    rows = [(c.name, k, i.get("type", ""), list(i.get("fields", [])), bool(i.get("unique"))) for c in collections for k, i in enumerate(c.indexes)]
    flags: dict[str, dict] = {}
    for r in structure.index_flags(spark.createDataFrame(rows, "collection string, place int, type string, fields array<string>, unique boolean")).collect() if rows else []:
        flags.setdefault(r["collection"], {})[r["field"]] = {"indexed": r["position"] == 0, "unique": bool(r["unique"] and not r["compound"])} | ({"compound": r["compound"].split(",")} if r["compound"] else {})
    for name, m in entities.items():
        if m["style"] == "LABEL" and m["type_value"] != name:
            m["aliases"] = [m["type_value"]]
        if own := [{k: v for k, v in i.items() if v is not None} for i in catalog.collections[m["collection"]].indexes if i.get("type") != "primary"]:
            m["indexes"] = own
            m["properties"] = flags.get(m["collection"], {})


def _enriched(catalog: Catalog, collections: list[Collection], conceptual: dict, detected: dict, counts: DataFrame, domains: DataFrame | None, prior: Analysis | None) -> dict:
    """What follows from the model as a whole: sharding, reach of tenants, domain, taxonomy, provenance, and why some of it may be missing. Metadata only."""
    spark, out = catalog.spark, {}
    props = lambda c, n: bool(c.properties.get(n))
    kinds = inference.sharding_kinds(spark.createDataFrame([(c.name, props(c, "is_system"), props(c, "is_satellite"), props(c, "is_smart")) for c in collections], "collection string, is_system boolean, is_satellite boolean, is_smart boolean"))
    graphs = spark.createDataFrame([(g.name, *(bool(g.properties.get(n)) for n in ("is_smart", "is_disjoint", "is_satellite"))) for g in catalog.graphs.values()], "graph string, is_smart boolean, is_disjoint boolean, is_satellite boolean")
    style = inference.sharding_style(graphs, F.lit(catalog.properties.get("sharding") == "single"))
    failed = spark.createDataFrame([(g.name, g.properties.get("error")) for g in catalog.graphs.values()], "graph string, error string")
    reasons = [r["reason"] for r in structure.degraded_reasons(spark.createDataFrame([(c.name,) for c in collections], "collection string"), failed).collect()]
    out["sharding"] = {"style": style.first()["style"], "kinds": {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}, "status": "degraded" if reasons else "ok", "reasons": reasons}
    entities = spark.createDataFrame([(e["name"], e["properties"]) for e in conceptual["entities"]], "entity string, properties array<string>")
    links = spark.createDataFrame([(r["fromEntity"], r["toEntity"]) for r in conceptual["relationships"] if "Any" not in (r["fromEntity"], r["toEntity"])], "from_entity string, to_entity string")
    out["tenantScope"] = {r["entity"]: r["scope"] for r in inference.tenant_scope(entities, links).collect()}
    families: set[str] = set()
    for f in detected["families"]:
        alike: dict[frozenset, list[str]] = {}
        for c in collections:
            if c.name.endswith(f["family"]):
                alike.setdefault(frozenset(c.df.columns), []).append(c.name)
        families |= {n for names in alike.values() if len(names) > 1 for n in names}
    fields = spark.createDataFrame([(e["name"], p) for e in conceptual["entities"] for p in e["properties"]], "entity string, property string")
    without = tuple(r["entity"] for r in spark.createDataFrame([(f,) for f in sorted(families)], "collection string").select(naming.entity_name(F.col("collection")).alias("entity")).collect())
    out["taxonomy"] = {"abstractClasses": taxonomy.abstract_classes(taxonomy.concepts(fields, without=without), {e["name"] for e in conceptual["entities"]})}
    if domains is not None:
        words = [(x,) for c in collections for x in (c.name, *c.df.columns)] + [(e["name"],) for e in conceptual["entities"]] + [(r["type"],) for r in conceptual["relationships"]]
        signals = spark.createDataFrame(words, "name string").union(counts.select("value")).select(F.explode(naming.domain_tokens(F.col("name"))).alias("token")).distinct()
        scores = inference.domain_scores(signals, domains)
        out["domain"] = next((r.asDict() for r in structure.domain_choice(scores, catalog.properties.get("domain")).collect()), None)
    now = {e["name"] for e in conceptual["entities"]} | {r["type"] for r in conceptual["relationships"]}
    seen = dict((prior.extra.get("provenance") or {}) if prior else {})
    stamp = str(catalog.properties.get("time", ""))
    current, before = spark.createDataFrame([(n,) for n in sorted(now)], "name string"), spark.createDataFrame([(n, p["first_seen"]) for n, p in seen.items()], "name string, first_seen string")
    out["provenance"] = {r["name"]: {"first_seen": r["first_seen"], "last_validated": r["last_validated"]} for r in inference.carried_forward(current, before, stamp).collect()}
    return out


def _detected(catalog: Catalog, collections: list[Collection], entities: dict) -> dict:
    """What the detectors find in names, fields, indexes and graphs: no scan."""
    spark, kinds = catalog.spark, {c.name: c.kind for c in collections}
    fields = [(c.name, c.kind, f) for c in collections for f in c.df.columns]
    named = spark.createDataFrame(fields, "collection string, kind string, field string")
    indexes = spark.createDataFrame([(c.name, k, i.get("type", ""), list(i.get("fields", [])), bool(i.get("unique"))) for c in collections for k, i in enumerate(c.indexes)], "collection string, place int, type string, fields array<string>, unique boolean")
    vectors = structure.vector_indexes(indexes)
    roles = inference.retrieval_roles(named)
    listed = spark.createDataFrame([(c.name, list((getattr(c, "properties", None) or {}).get("shard_keys", []))) for c in collections], "collection string, shard_keys array<string>")
    style = spark.createDataFrame([(str(catalog.properties.get("sharding_style", "Sharded")),)], "style string")
    taxonomy = spark.createDataFrame([(n, m["style"], m["collection"]) for n, m in entities.items()], "entity string, style string, collection string")
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=str)
    return {
        "families": rows(inference.shard_families(named.where("kind = 'document'"))),
        "triples": rows(inference.triple_collections(named)),
        "retrieval": rows(roles) if len({r["role"] for r in roles.collect()}) >= 2 else [],
        "retrievalConfidence": structure.retrieval_confidence(roles, vectors).first()["confidence"],
        "indexed": rows(structure.index_flags(indexes)),
        "vertexCentric": rows(inference.vertex_centric(indexes)),
        "membership": rows(inference.graph_membership(catalog.graph_table(), spark.createDataFrame([(n,) for n in kinds], "collection string"))),
        "tenancy": inference.tenancy_verdict(listed, named, style, str(catalog.properties.get("name", ""))).first().asDict(),
        "taxonomy": rows(inference.discriminator_taxonomy(taxonomy)),
    }


def _quality(spark, conceptual: dict, entities: dict, catalog: Catalog) -> dict:
    e = spark.createDataFrame([(x["name"], len(x["properties"])) for x in conceptual["entities"]], "entity string, properties int")
    r = spark.createDataFrame([(x["type"], x["fromEntity"], x["toEntity"]) for x in conceptual["relationships"]], "relation string, from_entity string, to_entity string")
    structure = metrics.structural_metrics(e, r)
    ground = metrics.grounding(spark.createDataFrame([(n, m["collection"]) for n, m in entities.items()], "name string, collection string"), catalog.listing())
    both = structure.crossJoin(ground.withColumnRenamed("ratio", "grounding"))  # one row each
    return metrics.health_score(both).first().asDict()


def change(prior: Analysis | None, catalog: Catalog) -> str:
    """no_cache, shape_changed, stats_changed or unchanged, from the shape and the counts."""
    if prior is None:
        return "no_cache"
    if prior.shape != shape_of(catalog):
        return "shape_changed"
    return "unchanged" if prior.counts == {r["collection"]: r["rows"] for r in catalog.counts().collect()} else "stats_changed"


def refreshed(catalog: Catalog, prior: Analysis) -> Analysis:
    """The prior model with its statistics anew: counts of rows, of the model's own labels, and of edges; no field is inferred again."""
    entities, relationships = prior.mapping["entities"], prior.mapping["relationships"]
    labels = {m["collection"]: m["type_field"] for m in (*entities.values(), *relationships.values()) if "type_field" in m}
    totals, counts = _counted(catalog, catalog.user_collections(), lambda c: [labels[c.name]] if c.name in labels else [])
    edges = {n: m for n, m in relationships.items() if "collection" in m}
    statistics = _statistics(catalog, entities, edges, _linked(catalog, entities, edges), totals, counts)
    counts.unpersist()
    return Analysis(prior.conceptual, prior.mapping, statistics, shape_of(catalog), {r["collection"]: r["rows"] for r in totals.collect()}, prior.extra)


def analyze_incremental(catalog: Catalog, prior: Analysis | None) -> tuple[str, Analysis]:
    """Does again only what changed: nothing, the statistics where only counts did, or all."""
    state = change(prior, catalog)
    if state == "unchanged":
        return state, prior
    return state, refreshed(catalog, prior) if state == "stats_changed" else analyze(catalog)

"""Text forms of an analysis: property-graph bundle, ontology (Turtle, JSON-LD), interchange document, Markdown."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from skemaforge.operators import structure

from .analysis import Analysis

BASE = "http://example.org/schema#"
_FUNCTIONAL = {"N:1": ("functional",), "1:N": ("inverse",), "1:1": ("functional", "inverse")}


def _local(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def graph_bundle(a: Analysis) -> dict:
    """Labels and types with where they are stored."""
    return {
        "labels": {e["name"]: {"properties": e["properties"], "mapping": a.mapping["entities"][e["name"]]} for e in a.conceptual["entities"]},
        "types": {r["type"]: {"from": r["fromEntity"], "to": r["toEntity"], "mapping": a.mapping["relationships"][r["type"]]} for r in a.conceptual["relationships"]},
    }


def vocabulary(a: Analysis, base: str = BASE) -> dict:
    """Prefixes, classes and predicates for SPARQL users."""
    return {"prefix": base, "classes": [base + _local(e["name"]) for e in a.conceptual["entities"]], "predicates": [base + _local(r["type"]) for r in a.conceptual["relationships"]]}


def subclasses(a: Analysis) -> list[tuple[str, str]]:
    """(class, its parent): entities and abstract classes under the nearest abstract class, and collections of a family under the family."""
    out = set()
    classes = a.extra.get("taxonomy", {}).get("abstractClasses", [])
    for c in sorted(classes, key=lambda c: -len(c["members"])):
        out = {(x, y) for x, y in out if x not in c["members"]} | {(m, c["name"]) for m in c["members"]}
    out |= {(c["name"], c["parent"]) for c in classes if c.get("parent")}
    for f in a.extra.get("detected", {}).get("families", []):
        family = _local(f["family"])
        out |= {(n, family) for n, m in a.mapping["entities"].items() if m["style"] == "COLLECTION" and m["collection"].endswith(f["family"]) and n != family}
    return sorted(out)


def turtle(a: Analysis, base: str = BASE) -> str:
    """Classes with their parents, properties, relationships; where each is stored stands in annotations (``phys:``)."""
    cardinality = {s["relation"]: s["cardinality"] for s in a.statistics}
    above = subclasses(a)
    lines = [f"@prefix : <{base}> .", f"@prefix phys: <{base}physical/> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", ""]

    def physical(name: str, m: dict) -> list[str]:
        shown = {"mappingStyle": "style", "collection": "collection", "typeField": "type_field", "typeValue": "type_value", "fromCollection": "from_collection", "toCollection": "to_collection"}
        return [f":{_local(name)} phys:{k} {json.dumps(m[f])} ." for k, f in shown.items() if m.get(f)]

    for e in a.conceptual["entities"]:
        lines.append(f':{_local(e["name"])} a owl:Class ; rdfs:label {json.dumps(e["name"])} .')
        lines += [f':{_local(p)} a owl:DatatypeProperty ; rdfs:domain :{_local(e["name"])} .' for p in e["properties"]]
        lines += physical(e["name"], a.mapping["entities"].get(e["name"], {}))
    known = {e["name"] for e in a.conceptual["entities"]}
    lines += [f':{_local(p)} a owl:Class ; rdfs:label {json.dumps(p)} .' for p in sorted({p for _, p in above} - known)]
    lines += [f":{_local(c)} rdfs:subClassOf :{_local(p)} ." for c, p in above]
    for r in a.conceptual["relationships"]:
        extra = "".join({"functional": ", owl:FunctionalProperty", "inverse": ", owl:InverseFunctionalProperty"}[k] for k in _FUNCTIONAL.get(cardinality.get(r["type"]), ()))
        ends = "".join(f" ; rdfs:{side} :{_local(r[key])}" for side, key in (("domain", "fromEntity"), ("range", "toEntity")) if r[key] != "Any")
        lines.append(f':{_local(r["type"])} a owl:ObjectProperty{extra}{ends} .')
        lines += physical(r["type"], a.mapping["relationships"].get(r["type"], {}))
        if r["type"] in cardinality:
            lines.append(f':{_local(r["type"])} phys:observedCardinality {json.dumps(cardinality[r["type"]])} .')
    return "\n".join(lines) + "\n"


def json_ld(a: Analysis, base: str = BASE) -> dict:
    above = dict(subclasses(a))
    names = [e["name"] for e in a.conceptual["entities"]]
    names += sorted(set(above.values()) - set(names))
    graph = [{"@id": base + _local(n), "@type": "owl:Class", "rdfs:label": n} | ({"rdfs:subClassOf": {"@id": base + _local(above[n])}} if n in above else {}) for n in names]
    end = lambda name: {"@id": base + _local(name)}
    graph += [{"@id": base + _local(r["type"]), "@type": "owl:ObjectProperty"} | {k: end(r[f]) for k, f in (("rdfs:domain", "fromEntity"), ("rdfs:range", "toEntity")) if r[f] != "Any"} for r in a.conceptual["relationships"]]
    return {"@context": {"owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}, "@graph": graph}


def interchange(a: Analysis) -> dict:
    return {"version": "1", "conceptualModel": a.conceptual, "physicalMapping": a.mapping, "provenance": {"shape": a.shape}}


def from_interchange(doc: dict) -> Analysis:
    return Analysis(doc["conceptualModel"], doc["physicalMapping"], [], doc.get("provenance", {}).get("shape", ""), {})


def parts(spark: SparkSession, a: Analysis) -> DataFrame:
    """kind, name, definition, style of a model's entities and relationships."""
    rows = [("entity", e["name"], ",".join(sorted(e["properties"])), a.mapping["entities"].get(e["name"], {}).get("style")) for e in a.conceptual["entities"]]
    rows += [("relationship", r["type"], f'{r["fromEntity"]}>{r["toEntity"]}', a.mapping["relationships"].get(r["type"], {}).get("style")) for r in a.conceptual["relationships"]]
    return spark.createDataFrame(rows, "kind string, name string, definition string, style string")


def diff(spark: SparkSession, before: Analysis, after: Analysis) -> dict:
    """What two analyses differ in, in fixed order, and the change of their health."""
    rows = sorted((r["kind"], r["name"], r["change"]) for r in structure.model_changes(parts(spark, before), parts(spark, after)).collect())
    out = {kind: {c: [n for k, n, x in rows if (k, x) == (kind, c)] for c in ("added", "removed", "changed", "restyled")} for kind in ("entity", "relationship")}
    old, new = (x.extra.get("quality", {}).get("health") for x in (before, after))
    return {"differs": bool(rows), **out, "health": {"before": old, "after": new, "delta": None if old is None or new is None else new - old}}


def issues(spark: SparkSession, doc: dict) -> list[str]:
    """What is wrong with an interchange document: missing parts, ends without an entity, names. Empty for a valid one."""
    model = doc.get("conceptualModel") or {}
    entities, relations = model.get("entities") or [], model.get("relationships") or []
    out = [f"{k} is missing" for k in ("version", "conceptualModel", "physicalMapping") if k not in doc]
    known = {e["name"] for e in entities} | {"Any"}
    out += [f"{r['type']}: no entity {r[end]}" for r in relations for end in ("fromEntity", "toEntity") if r[end] not in known]
    names = [("entity", e["name"]) for e in entities] + [("property", p) for e in entities for p in e.get("properties", [])] + [("relationship", r["type"]) for r in relations]
    found = structure.naming_issues(spark.createDataFrame(names, "kind string, name string").distinct()).collect()
    return out + sorted(f"{r['kind']} {r['name']}: {r['proposed']}" for r in found)


def conformed(spark: SparkSession, doc: dict, entity_names: dict[str, str] | None = None, other_names: dict[str, str] | None = None) -> dict:
    """A copy of an interchange document with names as it wants them: classes in singular with raised words, properties and relationships with a small first word.

    Keys of the mapping follow, and each renamed property tells the field that it stands for. The caller's names go before the rules (for irregular words).
    Names that conform stay, so a second pass changes nothing; system fields stay.
    """
    doc = json.loads(json.dumps(doc))
    model, mapping = doc["conceptualModel"], doc["physicalMapping"]
    fields = sorted({p for e in model["entities"] for p in e.get("properties", [])})
    rows = [("entity", e["name"]) for e in model["entities"]] + [("property", p) for p in fields] + [("relationship", r["type"]) for r in model["relationships"]]
    found = {(r["kind"], r["name"]): r["proposed"] for r in structure.naming_issues(spark.createDataFrame(rows, "kind string, name string").distinct()).collect()}
    given = {("entity", k): v for k, v in (entity_names or {}).items()} | {(kind, k): v for k, v in (other_names or {}).items() for kind in ("property", "relationship")}
    new = lambda kind, name: given.get((kind, name)) or found.get((kind, name)) or name
    classes = {e["name"]: new("entity", e["name"]) for e in model["entities"]}
    for e in model["entities"]:
        own = mapping["entities"].get(e["name"])
        if own is not None:
            was = own.get("properties", {})
            own["properties"] = {new("property", p): {"field": p} | was.get(p, was.get(new("property", p), {})) for p in e.get("properties", [])}
        e["name"], e["properties"] = classes[e["name"]], [new("property", p) for p in e.get("properties", [])]
        if "parent" in e:
            e["parent"] = classes.get(e["parent"], e["parent"])
    for r in model["relationships"]:
        r |= {"type": new("relationship", r["type"]), **{k: classes.get(r[k], r[k]) for k in ("fromEntity", "toEntity")}}
    mapping["entities"] = {classes.get(n, n): m for n, m in mapping["entities"].items()}
    mapping["relationships"] = {new("relationship", n): m | {k: classes.get(m[k], m[k]) for k in ("from_entity", "to_entity") if k in m} for n, m in mapping["relationships"].items()}
    return doc


def markdown(a: Analysis) -> str:
    lines = ["# Schema", "", "## Entities", "", "| entity | style | collection | properties |", "|-|-|-|-|"]
    for e in a.conceptual["entities"]:
        m = a.mapping["entities"][e["name"]]
        lines.append(f'| {e["name"]} | {m["style"]} | {m["collection"]} | {", ".join(e["properties"])} |')
    lines += ["", "## Relationships", "", "| type | from | to | edges | cardinality |", "|-|-|-|-|-|"]
    stats = {s["relation"]: s for s in a.statistics}
    for r in a.conceptual["relationships"]:
        s = stats.get(r["type"], {})
        lines.append(f'| {r["type"]} | {r["fromEntity"]} | {r["toEntity"]} | {s.get("edges", "")} | {s.get("cardinality", "")} |')
    return "\n".join(lines) + "\n"

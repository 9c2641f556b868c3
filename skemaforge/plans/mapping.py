"""A conceptual model's mapping onto collections, compiled into lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemaforge.functions.naming import collection_of
from skemaforge.operators import relational
from skemaforge.sources.catalog import Catalog

#: What each style needs.
ENTITY_STYLES = {"COLLECTION": ("collection",), "LABEL": ("collection", "type_field", "type_value")}
RELATIONSHIP_STYLES = {
    "DEDICATED_COLLECTION": ("collection",),
    "GENERIC_WITH_TYPE": ("collection", "type_field", "type_value"),
    "FOREIGN_KEY": ("from_collection", "from_fields", "to_collection", "to_key_fields"),
    "JOIN_TABLE": ("collection", "from_collection", "from_keys", "near_fields", "far_fields", "to_collection", "to_keys"),
}


def _checked(kind: str, name: str, m: dict, styles: dict) -> dict:
    if m.get("style") not in styles:
        raise ValueError(f"INVALID_ARGUMENT: {kind} {name} has style {m.get('style')!r}")
    if lacking := [p for p in styles[m["style"]] if not m.get(p)]:
        raise ValueError(f"INVALID_ARGUMENT: {kind} {name} lacks {', '.join(lacking)}")
    return m


@dataclass
class PhysicalMapping:
    """entities: name to style and parameters; relationships also name ``from_entity`` and ``to_entity``."""

    catalog: Catalog
    entities: dict[str, dict] = field(default_factory=dict)
    relationships: dict[str, dict] = field(default_factory=dict)

    def _rows(self, collection: str) -> DataFrame:
        if collection not in self.catalog.collections:
            raise ValueError(f"INVALID_ARGUMENT: no collection named {collection!r}")
        return self.catalog.collections[collection].df

    def entity(self, name: str) -> DataFrame:
        """All rows of an entity: a scan, with a filter that reaches it for a LABEL."""
        if name not in self.entities:
            raise ValueError(f"INVALID_ARGUMENT: no entity named {name!r}")
        m = _checked("entity", name, self.entities[name], ENTITY_STYLES)
        rows = self._rows(m["collection"])
        return rows if m["style"] == "COLLECTION" else relational.labelled(rows, m["type_field"], m["type_value"])

    def extent(self, names: list[str]) -> DataFrame:
        """Rows of several entities, each once; slices of one collection share a scan."""
        parts = []
        for n in names:
            m = _checked("entity", n, self.entities[n], ENTITY_STYLES)
            label = m["style"] == "LABEL"
            parts.append((m["collection"], self._rows(m["collection"]), m["type_field"] if label else None, (m["type_value"],) if label else ()))
        return relational.class_extent(parts)

    def traverse(self, relation: str, direction: str = "outbound", source: DataFrame | None = None) -> DataFrame:
        """s_*, e_*, t_*: from an entity's rows (or ``source``, some of them) over a relationship."""
        if relation not in self.relationships:
            raise ValueError(f"INVALID_ARGUMENT: no relationship named {relation!r}")
        m = _checked("relationship", relation, self.relationships[relation], RELATIONSHIP_STYLES)
        if m["style"] == "FOREIGN_KEY":
            a, b = self._rows(m["from_collection"]), self._rows(m["to_collection"])
            a, b = (source if source is not None and direction == "outbound" else a), (source if source is not None and direction == "inbound" else b)
            return relational.foreign_key(a, m["from_fields"], b, m["to_key_fields"], direction)
        if m["style"] == "JOIN_TABLE":
            a, b = self._rows(m["from_collection"]), self._rows(m["to_collection"])
            a, b = (source if source is not None and direction == "outbound" else a), (source if source is not None and direction == "inbound" else b)
            return relational.junction(a, m["from_keys"], self._rows(m["collection"]), m["near_fields"], m["far_fields"], b, m["to_keys"], direction)
        if direction not in ("outbound", "inbound"):
            raise ValueError("INVALID_ARGUMENT: direction is outbound or inbound")
        near, far = (self.ends(relation, side) for side in (("from", "to") if direction == "outbound" else ("to", "from")))
        typed = {"type_field": m["type_field"], "type_value": m["type_value"]} if m["style"] == "GENERIC_WITH_TYPE" else {}
        if len(near) == len(far) == 1:
            return relational.traverse(source if source is not None else self.entity(near[0]), self._rows(m["collection"]), self.entity(far[0]), direction, **typed)
        starts = [self._end(n) for n in near]
        if source is not None:
            starts = [relational.End(e.entity, e.collection, source.where(collection_of(F.col("_id")) == e.collection), e.type_field, e.type_value) for e in starts]
        return relational.traverse_any(starts, self._rows(m["collection"]), [self._end(n) for n in far], direction, **typed)

    def ends(self, relation: str, side: str) -> list[str]:
        """The entities at an end (``from`` or ``to``): those listed as ``from_entities``, else the one named; ``Any`` is every entity."""
        m = self.relationships[relation]
        found = m.get(f"{side}_entities") or ([m[f"{side}_entity"]] if m[f"{side}_entity"] != "Any" else sorted(self.entities))
        return found if len(found) > 1 or m[f"{side}_entity"] == "Any" else [m[f"{side}_entity"]]

    def _end(self, name: str) -> relational.End:
        if name not in self.entities:
            raise ValueError(f"INVALID_ARGUMENT: no entity named {name!r}")
        m = _checked("entity", name, self.entities[name], ENTITY_STYLES)
        label = (m["type_field"], m["type_value"]) if m["style"] == "LABEL" else (None, None)
        return relational.End(name, m["collection"], self._rows(m["collection"]), *label)

    def resolve(self) -> dict[str, dict]:
        """For each label and relationship the columns of its DataFrame, or why there is none."""
        out = {}
        for kind, names, build in (("entity", self.entities, self.entity), ("relationship", self.relationships, self.traverse)):
            for n in sorted(names):
                try:
                    out[n] = {"kind": kind, "columns": build(n).columns}
                except ValueError as e:
                    out[n] = {"kind": kind, "error": str(e)}
        return out

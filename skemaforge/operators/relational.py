"""The compiled dataflow: what a mapping's entities and relationships mean as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemaforge.functions.naming import collection_of
from skemaforge.sources.catalog import named, union_all


def labelled(df: DataFrame, type_field: str, *values: str) -> DataFrame:
    """The slice of a shared collection with one label, or any of several: a filter that reaches the scan."""
    return df.where(named(type_field) == values[0]) if len(values) == 1 else df.where(named(type_field).isin(*values))


def class_extent(parts: list[tuple[str, DataFrame, str | None, tuple[str, ...]]]) -> DataFrame:
    """The union of realisations (collection, rows, type field, labels), each row once.

    Slices of one collection become one filter and so one scan; a whole collection takes in its slices. One collection under two type fields is an error.
    """
    whole: dict[str, DataFrame] = {}
    slices: dict[str, tuple[DataFrame, str, list[str]]] = {}
    for name, df, type_field, labels in parts:
        if type_field is None:
            whole[name] = df
        elif name in slices and slices[name][1] != type_field:
            raise ValueError(f"INVALID_ARGUMENT: {name} has two type fields")
        else:
            slices.setdefault(name, (df, type_field, []))[2].extend(labels)
    frames = [whole[n].withColumn("_collection", F.lit(n)) for n in sorted(whole)]
    frames += [labelled(df, tf, *sorted(set(labels))).withColumn("_collection", F.lit(n)) for n, (df, tf, labels) in sorted(slices.items()) if n not in whole]
    return union_all(frames)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(named(c).alias(f"{prefix}{c}") for c in df.columns))


def traverse(source: DataFrame, edges: DataFrame, target: DataFrame, direction: str = "outbound", type_field: str | None = None, type_value: str | None = None) -> DataFrame:
    """s_*, e_*, t_*: source rows, their edges, and the far rows; a dangling edge has a null far row.

    Typed edges are filtered before the join. ``inbound`` swaps the ends.
    """
    if direction not in ("outbound", "inbound"):
        raise ValueError("INVALID_ARGUMENT: direction is outbound or inbound")
    near, far = ("_from", "_to") if direction == "outbound" else ("_to", "_from")
    if type_field is not None:
        edges = labelled(edges, type_field, type_value)
    s, e, t = _prefixed(source, "s_"), _prefixed(edges, "e_"), _prefixed(target, "t_")
    return s.join(e, s["s__id"] == e[f"e_{near}"]).join(t, e[f"e_{far}"] == t["t__id"], "left")


@dataclass
class End:
    """Rows at one end of a relationship: a whole collection's entity, or those of one label of a shared collection."""

    entity: str
    collection: str
    rows: DataFrame
    type_field: str | None = None
    type_value: str | None = None


def _tagged(ends: list[End], prefix: str) -> DataFrame:
    """Rows of all ends with their entity's name: one scan a collection; columns that only some have are null in the others."""
    frames = []
    for collection in sorted({e.collection for e in ends}):
        own = [e for e in ends if e.collection == collection]
        rows, whole = own[0].rows, [e for e in own if e.type_field is None]
        name = F.lit(whole[0].entity) if whole else F.lit(None).cast("string")
        for e in own:
            if e.type_field is not None:
                name = F.when(named(e.type_field) == e.type_value, e.entity).otherwise(name)
        if not whole:
            rows = reduce(lambda a, b: a.where(b), [reduce(lambda a, b: a | b, (named(e.type_field) == e.type_value for e in own))], rows)
        frames.append(rows.select(name.alias(f"{prefix}entity"), *(named(c).alias(f"{prefix}{c}") for c in rows.columns)))
    return union_all(frames)


def reached(edges: DataFrame, side: str) -> set[str]:
    """The collections that an edge collection's ends lie in: one aggregation over one column."""
    return {r["c"] for r in edges.select(collection_of(F.col(side)).alias("c")).distinct().collect()} - {None}


def traverse_any(sources: list[End], edges: DataFrame, targets: list[End], direction: str = "outbound", type_field: str | None = None, type_value: str | None = None, ends: tuple[set[str], set[str]] | None = None) -> DataFrame:
    """s_entity, s_*, e_*, t_entity, t_*: as ``traverse`` over a relationship whose ends lie in several collections or labels.

    An id holds its collection, so one join reaches them all. Collections that no edge reaches aren't scanned: ``ends`` names those at the
    near and the far end, else one pass over the edges finds them. An edge whose far row is missing, or isn't of any target, stays with a null far row.
    """
    if direction not in ("outbound", "inbound"):
        raise ValueError("INVALID_ARGUMENT: direction is outbound or inbound")
    near, far = ("_from", "_to") if direction == "outbound" else ("_to", "_from")
    if type_field is not None:
        edges = labelled(edges, type_field, type_value)
    at_near, at_far = ends or (reached(edges, near), reached(edges, far))
    some = lambda parts, at: [e for e in parts if e.collection in at] or parts[:1]
    s, e, t = _tagged(some(sources, at_near), "s_"), _prefixed(edges, "e_"), _tagged(some(targets, at_far), "t_")
    return s.join(e, s["s__id"] == e[f"e_{near}"]).join(t, e[f"e_{far}"] == t["t__id"], "left")


def keys_match(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], identity: list[bool] | None = None) -> Column:
    """Composite keys in order; null matches null, as in the document model, but a document's own key (``identity``) is never null and matches none.

    Such keys, and any pair of a text with something else, are compared as text.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("INVALID_ARGUMENT: key lists differ in length or are empty")
    pairs = []
    for x, y, own in zip(left_keys, right_keys, identity or [False] * len(left_keys)):
        a, b = left[f"`{x}`"], right[f"`{y}`"]
        if own or ("string" in (kinds := {left.schema[x].dataType.typeName(), right.schema[y].dataType.typeName()}) and len(kinds) > 1):
            a, b = a.cast("string"), b.cast("string")
        pairs.append(a == b if own else a.eqNullSafe(b))
    return reduce(lambda a, b: a & b, pairs)


#: A document's own keys, which are text and never null.
IDENTITY = ("_key", "_id")


def foreign_key(source: DataFrame, source_keys: list[str], target: DataFrame, target_keys: list[str], direction: str = "outbound") -> DataFrame:
    """s_*, t_*: rows with the rows they refer to; ``inbound``: referred rows with all that refer to them."""
    own = [k in IDENTITY for k in target_keys]
    if direction == "inbound":
        source, source_keys, target, target_keys = target, target_keys, source, source_keys
    s, t = _prefixed(source, "s_"), _prefixed(target, "t_")
    return s.join(t, keys_match(s, [f"s_{k}" for k in source_keys], t, [f"t_{k}" for k in target_keys], own))


def junction(source: DataFrame, source_keys: list[str], links: DataFrame, near_keys: list[str], far_keys: list[str], target: DataFrame, target_keys: list[str], direction: str = "outbound") -> DataFrame:
    """s_*, e_*, t_*: two rows and the junction row that links them."""
    if direction == "inbound":
        source, source_keys, near_keys, far_keys, target, target_keys = target, target_keys, far_keys, near_keys, source, source_keys
    s, e, t = _prefixed(source, "s_"), _prefixed(links, "e_"), _prefixed(target, "t_")
    one = s.join(e, keys_match(s, [f"s_{k}" for k in source_keys], e, [f"e_{k}" for k in near_keys], [k in IDENTITY for k in source_keys]))
    return one.join(t, keys_match(one, [f"e_{k}" for k in far_keys], t, [f"t_{k}" for k in target_keys], [k in IDENTITY for k in target_keys]))


def containment(child: DataFrame, field: str, parent: DataFrame, key: str, sampled: int | None = None) -> DataFrame:
    """values, hits, ratio: the share of the child's distinct values that the parent's key holds, compared as text; null without values.

    ``sampled`` takes so many distinct values, the first in hash order, as a cheap probe.
    """
    values = child.where(named(field).isNotNull()).select(named(field).cast("string").alias("v")).distinct()
    if sampled is not None:
        values = values.orderBy(F.md5("v")).limit(sampled)
    keys = parent.where(named(key).isNotNull()).select(named(key).cast("string").alias("k")).distinct()
    matched = values.join(keys, F.col("v") == F.col("k"), "left")
    return matched.agg(F.count("*").alias("values"), F.count("k").alias("hits"), (F.count("k") / F.nullif(F.count("*"), F.lit(0))).alias("ratio"))


def specialisation_counts(parent: DataFrame, children: list[DataFrame], key: str = "_key") -> DataFrame:
    """total, in_multiple, in_none: how many of the parent's keys lie in several children, or in none."""
    keys = union_all([c.select(F.col(key).cast("string").alias("k")).distinct() for c in children]).groupBy("k").agg(F.count("*").alias("n"))
    p = parent.select(F.col(key).cast("string").alias("p"))
    return p.join(keys, F.col("p") == F.col("k"), "left").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 1).alias("in_multiple"), F.count_if(F.col("n").isNull()).alias("in_none"))


def differences(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, change (added, removed, changed): a full outer join on the key."""
    b, a = before.select(F.col(key).alias("_b"), F.struct(*compared).alias("_old")), after.select(F.col(key).alias("_a"), F.struct(*compared).alias("_new"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return b.join(a, F.col("_b") == F.col("_a"), "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")

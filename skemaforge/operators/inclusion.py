"""Which columns' values lie in which others: one index of value hashes for all columns of a catalog.

Each collection is scanned once for what its columns hold and once for what others may refer to, however many pairs are asked. Columns are compared
as text, by 64-bit hashes of it. A sample has, for each of k slots of the hash, the smallest one: an aggregation of longs with partial sums of at
most k rows a column and task, no distinct. All columns then meet in one aggregation by hash: what it gives is, for each set of columns that
share values, how many they share; counts of pairs come out of these sets, not out of pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skemaforge.functions import naming
from skemaforge.sources.catalog import Catalog, named, union_all

HASHES = "collection string, field string, h long"
MATCHES = "collection string, field string, target string, target_field string, hits long, values long"
#: Low bits of a sampled hash that carry which collection's id a value is (0: none).
TARGET_BITS = 16


def flat(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, v: the non-null values of all ``fields`` as text, in one scan."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), named(f).cast("string").alias("v")) for f in fields))
    return df.select(F.inline(pairs)).where("v is not null")


def _hashed(catalog: Catalog, columns: dict[str, list[str]]) -> list[tuple[str, DataFrame]]:
    return [(c, flat(catalog.collections[c].df, fields).select("field", F.xxhash64("v").alias("h"), "v")) for c, fields in sorted(columns.items()) if fields]


def hashes(catalog: Catalog, columns: dict[str, list[str]]) -> DataFrame:
    """HASHES of all distinct values of the columns (collection to fields)."""
    parts = [rows.select("field", "h").distinct().select(F.lit(c).alias("collection"), "field", "h") for c, rows in _hashed(catalog, columns)]
    return union_all([catalog.spark.createDataFrame([], HASHES), *parts])


def sampled(catalog: Catalog, columns: dict[str, list[str]], k: int) -> DataFrame:
    """HASHES of at most ``k`` distinct values a column, and ``prefix``: the collection whose id the value is (null: none).

    The last bits of a hash give way to the number of the collection, so that all that is aggregated is one long.
    """
    names = [c.name for c in catalog.user_collections()]
    parts = []
    for c, rows in _hashed(catalog, columns):
        numbers = F.create_map(*(x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))))
        prefix = F.coalesce(F.try_element_at(numbers, F.when(naming.is_id_shaped(F.col("v")), naming.collection_of(F.col("v")))), F.lit(0)).cast("long")
        kept = F.shiftleft(F.shiftright("h", TARGET_BITS), TARGET_BITS)
        least = rows.select("field", F.pmod("h", F.lit(k)).alias("slot"), kept.bitwiseOR(prefix).alias("h")).groupBy("field", "slot").agg(F.min("h").alias("h"))
        number = F.col("h").bitwiseAND(F.lit((1 << TARGET_BITS) - 1)).cast("int")
        told = F.when(number > 0, F.element_at(F.array(*map(F.lit, names)), F.greatest(number, F.lit(1))))
        parts.append(least.select(F.lit(c).alias("collection"), "field", F.shiftleft(F.shiftright("h", TARGET_BITS), TARGET_BITS).alias("h"), told.alias("prefix")))
    return union_all([catalog.spark.createDataFrame([], f"{HASHES}, prefix string"), *parts])


def held(sample: DataFrame) -> DataFrame:
    """A sample taken once: k rows a column, so it may stay with the driver."""
    return sample.sparkSession.createDataFrame(sample.collect(), sample.schema)


def looked_up(catalog: Catalog, columns: dict[str, list[str]], asked: DataFrame) -> DataFrame:
    """HASHES (as of ``sampled``) of the columns' values that are among ``asked`` (h: a sample, broadcast to each scan)."""
    wanted = F.broadcast(asked.select("h").distinct())
    parts = []
    for c, rows in _hashed(catalog, columns):
        kept = rows.select("field", F.shiftleft(F.shiftright("h", TARGET_BITS), TARGET_BITS).alias("h")).join(wanted, "h", "left_semi")
        parts.append(kept.distinct().select(F.lit(c).alias("collection"), "field", "h"))
    return union_all([catalog.spark.createDataFrame([], HASHES), *parts])


def matches(children: DataFrame, parents: DataFrame) -> DataFrame:
    """MATCHES of each pair of columns that share a value. Both: HASHES, each value once a column; a column doesn't meet itself."""
    column = F.struct("collection", "field")
    rows = children.select(column.alias("child"), F.lit(None).cast("struct<collection:string,field:string>").alias("parent"), "h").unionByName(parents.select(F.lit(None).cast("struct<collection:string,field:string>").alias("child"), column.alias("parent"), "h"))
    sets = rows.groupBy("h").agg(F.array_sort(F.collect_set("child")).alias("children"), F.array_sort(F.collect_set("parent")).alias("parents")).where(F.size("children") > 0)
    sets = sets.groupBy("children", "parents").agg(F.count("*").alias("n")).select(F.explode("children").alias("child"), "parents", "n")
    each = sets.groupBy("child", "parents").agg(F.sum("n").alias("n"))
    totals = each.groupBy(F.col("child").alias("c")).agg(F.sum("n").alias("values"))
    hits = each.select("child", F.explode("parents").alias("parent"), "n").where(F.col("child") != F.col("parent")).groupBy("child", "parent").agg(F.sum("n").alias("hits"))
    return hits.join(totals, F.col("child") == F.col("c")).select("child.collection", "child.field", F.col("parent.collection").alias("target"), F.col("parent.field").alias("target_field"), "hits", "values")


def contained(catalog: Catalog, asked: list[tuple[str, str, str, str]], sample: DataFrame | None) -> DataFrame:
    """collection, field, target, target_field, ratio of the pairs asked (child, its field, parent, its field); no row where a child has no values.

    ``sample`` (of ``sampled``, best ``held``) stands for the children's values; without it all of them count.
    """
    by = lambda i: {c: sorted({p[i + 1] for p in asked if p[i] == c}) for c in sorted({p[i] for p in asked})}
    children = hashes(catalog, by(0)) if sample is None else sample.select("collection", "field", "h")
    parents = hashes(catalog, by(2)) if sample is None else looked_up(catalog, by(2), children)
    pairs = catalog.spark.createDataFrame(sorted(set(asked)), "collection string, field string, target string, target_field string")
    keys = ["collection", "field", "target", "target_field"]
    found = matches(children, parents)
    # children without any hit have values all the same
    totals = children.groupBy("collection", "field").agg(F.count("*").alias("all_values"))
    return pairs.join(totals, ["collection", "field"]).join(found, keys, "left").select(*keys, (F.coalesce("hits", F.lit(0)) / F.col("all_values")).alias("ratio"))

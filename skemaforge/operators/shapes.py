"""Shapes of schemaless rows: which fields JSON documents have, of what types, with some of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.sources.catalog import named

SAMPLED, DEPTH = 50, 4


def category(variant_type: Column) -> Column:
    """The coarse category of a variant's type."""
    return (
        F.when(variant_type.startswith("OBJECT"), "object").when(variant_type.startswith("ARRAY"), "array").when(variant_type == "BIGINT", "integer").when(variant_type.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(variant_type == "STRING", "string").when(variant_type == "BOOLEAN", "boolean").when(variant_type == "VOID", None).otherwise("unknown")
    )


def paths(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """path, kind, value of every field of the JSON objects in ``column``, nested ones too (``a.b``; a name with a dot stands in backticks). Objects are unfolded ``depth`` deep.

    A field that is null has a null kind and value; text that is no JSON object has no fields.
    """
    spark, out = df.sparkSession, None
    level = df.select(F.try_parse_json(named(column)).alias("v"), F.lit("").alias("above")).where("v is not null")
    for k in range(depth):
        each = spark.sql("SELECT above, key, value, schema_of_variant(value) AS type FROM {t}, LATERAL variant_explode(v) WHERE key IS NOT NULL", t=level)
        quoted = F.when(F.col("key").rlike("[.`]"), F.concat(F.lit("`"), F.replace("key", F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(F.col("key"))
        each = each.select(F.concat("above", quoted).alias("path"), category(F.col("type")).alias("kind"), "value")
        found = each.select("path", "kind", F.when(F.col("kind").isNotNull(), F.try_variant_get("value", "$", "string")).alias("value"))
        out = found if out is None else out.unionByName(found)
        level = each.where("kind = 'object'").select(F.col("value").alias("v"), F.concat("path", F.lit(".")).alias("above"))
    return out


def shapes(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """path, present, nulls, kinds (how often each category occurs, as ``kind:n``), category (the one of all values, ``float`` for integers and floats, else unknown)."""
    rows = paths(df, column, depth)
    by = rows.groupBy("path", "kind").agg(F.count("*").alias("n"))
    found = by.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)).alias("present"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.concat_ws(":", "kind", F.col("n").cast("string"))))), ",").alias("kinds"), F.array_sort(F.collect_set("kind")).alias("set"),
    )
    both = F.size(F.array_except("set", F.array(F.lit("float"), F.lit("integer")))) == 0
    return found.select("path", "present", "nulls", "kinds", F.when(F.size("set") == 1, F.col("set")[0]).when((F.size("set") > 1) & both, "float").otherwise("unknown").alias("category"))


def sampled(df: DataFrame, column: str, k: int = SAMPLED, depth: int = DEPTH) -> DataFrame:
    """path, value: at most ``k`` distinct scalar values a field, the first in order of their MD5."""
    values = paths(df, column, depth).where("kind not in ('object', 'array') and value is not null").select("path", "value").distinct()
    first = Window.partitionBy("path").orderBy(F.md5("value"), "value")
    return values.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).select("path", "value")

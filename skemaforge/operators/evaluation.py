"""Scores of inferred models against known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skemaforge.functions.naming import gold_name

THRESHOLDS = (0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 0.85)


def _scores(both: Column, found: Column, true: Column) -> list[Column]:
    """precision, recall, f1 from counts; 1 where there is nothing to find or to miss and nothing was found, else 0 on nothing."""
    share = lambda n: F.when(n > 0, both / n).otherwise(F.when((found == 0) & (true == 0), 1.0).otherwise(0.0))
    p, r = share(found), share(true)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]


def threshold_sweep(candidates: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, precision, recall, f1, false_positives, false_negatives. Both: collection, field, target; candidates: confidence."""
    spark, key = candidates.sparkSession, ["collection", "field", "target"]
    best = candidates.groupBy(*key).agg(F.max("confidence").alias("confidence"))
    j = best.join(truth.select(*key).distinct().withColumn("true", F.lit(1)), key, "full")
    levels = spark.createDataFrame([(t,) for t in thresholds], "threshold double")
    kept = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    n = j.join(F.broadcast(levels), F.lit(True), "inner").groupBy("threshold").agg(F.count_if(kept & F.col("true").isNotNull()).alias("both"), F.count_if(kept).alias("found"), F.count("true").alias("true"))  # a handful of levels
    return n.select("threshold", *_scores(F.col("both"), F.col("found"), F.col("true")), (F.col("found") - F.col("both")).alias("false_positives"), (F.col("true") - F.col("both")).alias("false_negatives"))


def signature_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """precision, recall, f1 of relationships with both ends. Both: relation, from_entity, to_entity; names are compared as gold names."""
    sign = lambda df, flag: df.where("relation is not null and from_entity is not null and to_entity is not null").select(*(gold_name(F.col(c)).alias(c) for c in ("relation", "from_entity", "to_entity"))).distinct().withColumn(flag, F.lit(1))
    j = sign(predicted, "p").join(sign(gold, "g"), ["relation", "from_entity", "to_entity"], "full")
    n = j.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("both"), F.count("p").alias("found"), F.count("g").alias("true"))
    return n.select(*_scores(F.col("both"), F.col("found"), F.col("true")))


def mapping_accuracy(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """kind, ok, total, accuracy. Both: kind, name, style, collection, type_field, type_value: all must agree (nulls too)."""
    p = predicted.select("kind", "name", *(F.col(c).alias(f"p_{c}") for c in ("style", "collection", "type_field", "type_value")))
    same = F.lit(True)
    for c in ("style", "collection", "type_field", "type_value"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    j = expected.join(p, ["kind", "name"], "left")
    return j.groupBy("kind").agg(F.count_if(same & F.col("p_style").isNotNull()).alias("ok"), F.count("*").alias("total")).withColumn("accuracy", F.round(F.col("ok") / F.col("total"), 6))

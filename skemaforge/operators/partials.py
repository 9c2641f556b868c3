"""Profiles that can be merged: counts and sketches of parts (files, batches), so that what was seen needn't be read again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skemaforge.sources.catalog import named

STATS = "part string, field string, rows long, present long, sketch binary"
VALUES = "part string, field string, value string, count long"


def partial_stats(df: DataFrame, fields: list[str], part: Column) -> DataFrame:
    """STATS: rows, values and a sketch of the distinct values of each field and part; one scan, a row a part and field."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.count("*").alias("rows"), F.count(named(f)).alias("present"), F.hll_sketch_agg(named(f).cast("string")).alias("sketch")) for f in fields))
    return df.groupBy(part.cast("string").alias("part")).agg(each.alias("a")).select("part", F.inline("a"))


def partial_values(df: DataFrame, labels: list[str], part: Column) -> DataFrame:
    """VALUES: how often each part has each value of label-like fields."""
    if not labels:
        return df.sparkSession.createDataFrame([], VALUES)
    rows = df.select(part.cast("string").alias("_part"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), named(f).cast("string").alias("value")) for f in labels))))
    return rows.where("value is not null").groupBy(F.col("_part").alias("part"), "field", "value").agg(F.count("*").alias("count"))


def merged_stats(parts: DataFrame) -> DataFrame:
    """field, rows, present, distinct (about) of all parts together."""
    return parts.groupBy("field").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def merged_values(parts: DataFrame) -> DataFrame:
    """field, value, count of all parts together."""
    return parts.groupBy("field", "value").agg(F.sum("count").alias("count"))


class FileProfiles:
    """Partial profiles of a table's files, kept in a folder: each file is read once, whatever is added later.

    A file that has gone from the table no longer counts; one that was replaced under its own name would be taken for the old one (Spark's writers never do that).
    """

    def __init__(self, spark: SparkSession, table: str, store: str, fields: list[str], labels: list[str]):
        self.spark, self.table, self.store, self.fields, self.labels = spark, table, store, fields, labels

    def _kept(self, kind: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{kind}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.store}/{kind}") if there else self.spark.createDataFrame([], schema)

    def new_files(self) -> list[str]:
        known = {r["part"] for r in self._kept("stats", STATS).select("part").distinct().collect()}  # a row a file
        return sorted(set(self._files()) - known)

    def _files(self) -> list[str]:
        return [re.sub("^file:/+", "file:///", f) for f in self.spark.read.parquet(self.table).inputFiles()]

    def update(self) -> list[str]:
        """Profiles the files that weren't there before, and tells which."""
        new = self.new_files()
        if new:
            rows, file = self.spark.read.parquet(*new), F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")
            # values first: a file counts as known once its statistics are there, so a job that fails between is made up for by the next
            values = partial_values(rows, self.labels, file)
            values.write.mode("append").parquet(f"{self.store}/values")
            partial_stats(rows, self.fields, file).write.mode("append").parquet(f"{self.store}/stats")
        return new

    def _current(self, kind: str, schema: str) -> DataFrame:
        files = self.spark.createDataFrame([(f,) for f in self._files()], "part string")
        return self._kept(kind, schema).dropDuplicates([c.split()[0] for c in schema.split(", ")][: 3 if kind == "values" else 2]).join(files, "part", "left_semi")

    def stats(self) -> DataFrame:
        return merged_stats(self._current("stats", STATS))

    def values(self) -> DataFrame:
        return merged_values(self._current("values", VALUES))

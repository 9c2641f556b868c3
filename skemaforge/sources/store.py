"""Results kept between runs: an analysis cache and a metric history."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class FileCache:
    """JSON documents by key, each a file that only the owner reads; entries end after ``ttl`` seconds."""

    folder: str
    ttl: float = 86_400
    version: int = 1

    def _path(self, key: str) -> str:
        if not key.isalnum():
            raise ValueError("INVALID_ARGUMENT: a key is a digest")
        return os.path.join(self.folder, f"{key}.json")

    def get(self, key: str) -> dict | None:
        try:
            with open(self._path(key)) as f:
                entry = json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            return None
        fresh = entry.get("version") == self.version and time.time() - entry.get("at", 0) <= self.ttl
        return entry["value"] if fresh else None

    def set(self, key: str, value: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        temporary = self._path(key) + ".new"
        with os.fdopen(os.open(temporary, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump({"version": self.version, "at": time.time(), "value": value}, f)
        os.replace(temporary, self._path(key))

    def invalidate(self, key: str) -> None:
        if os.path.exists(self._path(key)):
            os.remove(self._path(key))


def append_history(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Gold models: domain, entity, properties, from JSON files of one document each."""
    from pyspark.sql import functions as F

    packs = spark.read.option("multiLine", True).json(folder)
    return packs.select("domain", F.explode("entities").alias("e")).select("domain", F.col("e.name").alias("entity"), F.col("e.properties").alias("properties"))


def read_domain_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """domain, relation, from_entity, to_entity of the gold models in ``folder``."""
    from pyspark.sql import functions as F

    packs = spark.read.option("multiLine", True).json(folder)
    return packs.select("domain", F.explode("relationships").alias("r")).select("domain", F.col("r.type").alias("relation"), F.col("r.from").alias("from_entity"), F.col("r.to").alias("to_entity"))

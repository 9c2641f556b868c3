"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns that it got. ``run``
writes each stage's result as a table in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemaforge.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from skemaforge.llm.common import drop_staged, named, scratch, staged, without_ids


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null or letterless texts, and texts far from every language."""
    with scratch(spark) as keep:
        model = language_id.fit(docs, by=F.col("doc_id"))
        judged = keep(staged(language_id.predict(docs.select("doc_id", "text"), model).where("rejected").select("doc_id").distinct(), "unknown-language"))
    return without_ids(docs, "doc_id", judged)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, and ``n_chars`` follows the text. Copies are still there, so a line that a page shares with one other may be its copy's: a third page is asked for."""
    return line_dedup.drop_boilerplate(docs, host="source", min_pages=3).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar 5-word shingle sets (0.8 or more) the one with the smallest id stays."""
    return jaccard_join.representatives(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Learned languages and tokenization can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_staged(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

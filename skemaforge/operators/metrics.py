"""Statistics, quality and calibration as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skemaforge.functions.naming import gold_name
from skemaforge.operators.numbering import running_sums

CARDINALITY_THRESHOLD = 1.5
REGRESSION = 0.005
QUALITY_COLUMNS = ("entity_f1", "relationship_f1", "domain_range_f1", "mapping_accuracy")


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    out = a / F.nullif(b, F.lit(0))
    return out if digits is None else F.round(out, digits)


def cardinality(avg_out: Column, avg_in: Column) -> Column:
    many_out, many_in = avg_out > CARDINALITY_THRESHOLD, avg_in > CARDINALITY_THRESHOLD
    return F.when(many_out & many_in, "N:M").when(many_out, "1:N").when(many_in, "N:1").otherwise("1:1")


def relationship_statistics(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges: relation, from_entity, to_entity, edges; entities: entity, rows. Adds counts of both ends, degrees, selectivity and cardinality."""
    s = entities.select(F.col("entity").alias("from_entity"), F.col("rows").alias("sources"))
    t = entities.select(F.col("entity").alias("to_entity"), F.col("rows").alias("targets"))
    j = edges.join(s, "from_entity", "left").join(t, "to_entity", "left").fillna(0, ["sources", "targets"])
    j = j.withColumns({"avg_out": F.coalesce(ratio(F.col("edges"), F.col("sources"), 2), F.lit(0.0)), "avg_in": F.coalesce(ratio(F.col("edges"), F.col("targets"), 2), F.lit(0.0)), "selectivity": F.coalesce(ratio(F.col("edges"), F.col("sources") * F.col("targets"), 6), F.lit(1.0))})
    return j.withColumn("cardinality", cardinality(F.col("avg_out"), F.col("avg_in"))).select("relation", "from_entity", "to_entity", "edges", "sources", "targets", "avg_out", "avg_in", "selectivity", "cardinality")


def structural_metrics(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """entities: entity, properties (a number); relationships: relation, from_entity, to_entity.

    One row: entities, connected, orphans, dangling (relationships with an unknown end), described (entities with properties), and their ratios (4 places, null on nothing).
    """
    ends = relationships.select(F.col("from_entity").alias("end")).union(relationships.select("to_entity")).distinct()
    e = entities.join(ends, F.col("entity") == F.col("end"), "left").agg(F.count("*").alias("entities"), F.count("end").alias("connected"), F.count_if(F.col("properties") > 0).alias("described"))
    known = entities.select(F.col("entity").alias("k"))
    bad = relationships.join(known, F.col("from_entity") == F.col("k"), "left").withColumnRenamed("k", "kf").join(known, F.col("to_entity") == F.col("k"), "left").agg(F.count("*").alias("relationships"), F.count_if(F.col("kf").isNull() | F.col("k").isNull()).alias("dangling"))
    return e.crossJoin(bad).select(  # one row each
        "entities",
        "connected",
        (F.col("entities") - F.col("connected")).alias("orphans"),
        "relationships",
        "dangling",
        ratio(F.col("connected"), F.col("entities"), 4).alias("connectivity"),
        ratio(F.col("relationships") - F.col("dangling"), F.col("relationships"), 4).alias("consistency"),
        ratio(F.col("described"), F.col("entities"), 4).alias("richness"),
    )


def grounding(mapping: DataFrame, collections: DataFrame) -> DataFrame:
    """mapping: name, collection; collections: collection. One row: mapped, grounded, ratio."""
    c = collections.select(F.col("collection").alias("_c")).distinct()
    return mapping.join(c, F.col("collection") == F.col("_c"), "left").agg(F.count("collection").alias("mapped"), F.count("_c").alias("grounded"), ratio(F.count("_c"), F.count("collection"), 4).alias("ratio"))


def ungrounded(entities: DataFrame, mapping: DataFrame, collections: DataFrame) -> DataFrame:
    """name, why: entities (entity) without a mapping (``unmapped``), and mapped names (name, collection) whose collection isn't there (``ungrounded``)."""
    c = collections.select("collection").distinct()
    lost = mapping.where("collection is not null").join(c, "collection", "left_anti").select("name", F.lit("ungrounded").alias("why"))
    bare = entities.select(F.col("entity").alias("name")).join(mapping.where("collection is not null").select("name"), "name", "left_anti").select("name", F.lit("unmapped").alias("why"))
    return lost.unionByName(bare)


#: Weights of the health score.
HEALTH_WEIGHTS = {"confidence": 0.40, "connectivity": 0.20, "consistency": 0.20, "grounding": 0.20, "gold": 0.20}


def health_score(metrics: DataFrame) -> DataFrame:
    """The weighted mean of the columns that are there and not null, of 100."""
    have = [c for c in HEALTH_WEIGHTS if c in metrics.columns]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * HEALTH_WEIGHTS[c] for c in have), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), HEALTH_WEIGHTS[c]).otherwise(0.0) for c in have), F.lit(0.0))
    return metrics.withColumn("health", F.round(100 * total / F.nullif(weight, F.lit(0.0))))


def precision_recall(predicted: DataFrame, gold: DataFrame, name: str = "name", normalise=gold_name) -> DataFrame:
    """One row: predicted, gold, common, precision, recall, f1 of distinct normalised names; two empty sets agree."""
    p = predicted.select(normalise(F.col(name)).alias("n")).distinct().withColumn("p", F.lit(1))
    g = gold.select(normalise(F.col(name)).alias("n")).distinct().withColumn("g", F.lit(1))
    c = p.join(g, "n", "full").agg(F.count("p").alias("predicted"), F.count("g").alias("gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("common"))
    both = (F.col("predicted") == 0) & (F.col("gold") == 0)
    pr = F.when(both, 1.0).when(F.col("predicted") == 0, 1.0).otherwise(F.coalesce(ratio(F.col("common"), F.col("predicted")), F.lit(0.0)))
    rc = F.when(both, 1.0).when(F.col("gold") == 0, 0.0).when(F.col("predicted") == 0, 0.0).otherwise(ratio(F.col("common"), F.col("gold")))
    pr = F.when((F.col("gold") == 0) & (F.col("predicted") > 0), 0.0).otherwise(pr)
    out = c.withColumns({"precision": pr, "recall": rc})
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def observed_quality(df: DataFrame, columns: tuple[str, ...] = QUALITY_COLUMNS) -> DataFrame:
    """Adds quality: the mean of the metrics that a row has; null if none."""
    have = F.array_compact(F.array(*(F.col(c).cast("double") for c in columns)))
    return df.withColumn("quality", F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(have), F.lit(0)))


def reliability_bins(df: DataFrame, confidence: str, quality: str, bins: int = 10) -> DataFrame:
    """bin, rows, mean_confidence, mean_quality of ``bins`` equal widths; 1.0 is in the last, empty bins have 0 rows."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    got = df.where(F.col(confidence).isNotNull() & F.col(quality).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.avg(confidence).alias("mean_confidence"), F.avg(quality).alias("mean_quality"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0, ["rows"])


def calibration_errors(df: DataFrame, confidence: str, quality: str, bins: int = 10) -> DataFrame:
    """One row: ece, mce, brier, gap."""
    t = reliability_bins(df, confidence, quality, bins)
    gap = F.abs(F.col("mean_confidence") - F.col("mean_quality"))
    binned = t.agg((F.sum(F.col("rows") * gap) / F.sum("rows")).alias("ece"), F.max(gap).alias("mce"))
    direct = df.agg(F.avg(F.pow(F.col(confidence) - F.col(quality), 2)).alias("brier"), (F.avg(confidence) - F.avg(quality)).alias("gap"))
    return binned.crossJoin(direct)  # one row each


def youden(df: DataFrame, score: str, good: str) -> DataFrame:
    """threshold, j: the score at which (true - false positive rate) of ``score >= threshold`` is largest, ties to the higher.

    Rows are first summed a score; the running sums over scores are made in ranges, so any number of different scores will do. All good: the least score; all bad: the largest plus 0.01.
    """
    by = df.groupBy(F.col(score).alias("t")).agg(F.count_if(good).alias("tp"), F.count_if(~F.col(good)).alias("fp"))
    sums = running_sums(by, "t", ["tp", "fp"], descending=True)
    total = by.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    j = F.coalesce(F.col("tp") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)) - F.coalesce(F.col("fp") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    best = sums.crossJoin(total).withColumn("j", j).orderBy(F.col("j").desc(), F.col("t").desc()).limit(1)  # one row of totals
    return best.select(F.when(F.col("p") == 0, F.col("hi") + 0.01).when(F.col("n") == 0, F.col("lo")).otherwise(F.col("t")).alias("threshold"), "j")


def history_summary(history: DataFrame, series: str, position: str, value: str) -> DataFrame:
    """series, n, least, most, mean, latest, delta (latest less first)."""
    return history.groupBy(series).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.max_by(value, position).alias("latest"), (F.max_by(value, position) - F.min_by(value, position)).alias("delta"))


def last_n(history: DataFrame, series: str, position: str, n: int) -> DataFrame:
    """The last n rows of each series: a top-k a series."""
    w = Window.partitionBy(series).orderBy(F.col(position).desc())
    return history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def regressions(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str], threshold: float = REGRESSION) -> DataFrame:
    """keys, metric, before, after, delta of metrics that fell by more than the threshold."""
    flat = lambda df, as_: df.unpivot(keys, metrics, "metric", as_)
    j = flat(before, "before").join(flat(after, "after"), [*keys, "metric"])
    return j.withColumn("delta", F.round(F.col("after") - F.col("before"), 6)).where(F.col("delta") < -threshold)

"""Benchmark decontamination by a positional inverted index. DataFrame functions only.

The index is a stored table of postings (term, row, position) of the terms that the tests use, built in one pass over the corpus
without a shuffle. A query takes each window's rarest terms: the two rarest terms' lists, each shifted by the term's offset
in the window, are intersected; what is left is intersected with the lists of all its other terms. So common words' lists are read
only for the few rows that survive, and a match is exact, position by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, staged, without_ids

#: Words are runs of digits, lower-case letters and all characters from U+0080 on.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows of a test-side table (a few dozen bytes each) up to which it is broadcast: some 64 MB; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table if its count is within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


@dataclass
class Tests:
    """windows: window, size, item. places: window, size, place (from 0), term. terms: term, word."""

    windows: DataFrame
    places: DataFrame
    terms: DataFrame


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> Tests:
    """Every ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. Equal windows are one."""
    w = words(F.col(text))
    n = F.size(w)
    cut = F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.slice(w, i + 1, size))).when(n > 0, F.array(w))
    parts = items.select(F.col(item_id).alias("item"), F.explode(cut).alias("words")).distinct()
    named = staged(parts.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    terms = staged(named.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    places = named.select("window", F.size("words").alias("size"), F.posexplode("words").alias("place", "word")).join(terms, "word").drop("word")
    windows = parts.join(named, "words").select("window", F.size("words").alias("size"), "item")
    return Tests(staged(windows, "window-items"), staged(places, "places"), terms)


@dataclass
class Index:
    """postings: term, row, pos. rows: row, doc_id, n_words."""

    postings: DataFrame
    rows: DataFrame


def build_index(documents: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Postings of ``terms`` in every whole text, and every row's length, in one stored table.

    Each row of ``documents`` has a number of its own, so repeated ids don't mix. The empty word at a text's end is the
    row's own posting; its position is the number of words.
    """
    ended = F.concat(words(F.col(text)), F.array(F.lit("")))
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), ended.alias("words"))
    listed = numbered.select("row", "doc_id", F.posexplode("words").alias("pos", "word"))
    wanted = staged(terms.select("word", "term").unionByName(terms.sparkSession.createDataFrame([("", -1)], "word string, term long")), "vocabulary")
    found = listed.join(_small(wanted), "word").select("term", "row", "pos", F.when(F.col("term") == -1, F.col("doc_id")).alias("doc_id"))
    stored = staged(found, "postings")
    return Index(stored.where("term >= 0").select("term", "row", "pos"), stored.where("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words")))


def phrase_matches(index: Index, tests: Tests) -> DataFrame:
    """row, start, size, window of every exact occurrence."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    by_rarity = Window.partitionBy("window").orderBy("n", "place")
    ranked = tests.places.join(counts, "term")  # a window with a term that the corpus lacks loses that place, and with it all
    ranked = ranked.withColumn("rank", F.row_number().over(by_rarity)).withColumn("have", F.count("*").over(Window.partitionBy("window")))
    ranked = staged(ranked.where("have = size").select("window", "size", "place", "term", "rank"), "ranked")

    def shifted(rank: int) -> DataFrame:
        anchors = ranked.where(F.col("rank") == rank).select("term", "window", "size", "place")
        return index.postings.join(_small(anchors), "term").select("row", (F.col("pos") - F.col("place")).alias("start"), "size", "window")

    first = shifted(1)
    both = first.where("size > 1").join(shifted(2).drop("size"), ["row", "start", "window"], "left_semi")
    candidates = staged(first.where("size = 1").unionByName(both), "candidates")
    rest = ranked.where("rank > 2").select("window", "place", "term")
    asked = candidates.join(_small(rest), "window").select("row", "start", "size", "window", (F.col("start") + F.col("place")).alias("pos"), "term")
    in_rows = index.postings.join(_small(staged(candidates.where("size > 2").select("row").distinct(), "candidate-rows")), "row", "left_semi")
    full = asked.join(in_rows, ["row", "pos", "term"]).groupBy("row", "start", "size", "window").agg(F.count("*").alias("n")).where("n = size - 2").drop("n")
    return full.unionByName(candidates.where("size <= 2"))


def proximity_matches(index: Index, tests: Tests, within: int) -> DataFrame:
    """row, pos, window: positions of a window's rarest term with every other term of the window at most ``within`` words away, in any order."""
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    distinct = tests.places.select("window", "term").distinct().join(counts, "term", "left")
    w = Window.partitionBy("window")
    ranked = distinct.withColumn("rank", F.row_number().over(w.orderBy("n", "term"))).withColumn("terms", F.count("*").over(w)).withColumn("have", F.count("n").over(w)).where("have = terms")
    ranked = staged(ranked.select("window", "term", "rank", "terms"), "ranked")
    anchors = index.postings.join(_small(ranked.where("rank = 1").select("term", "window", "terms")), "term").select("row", "window", "terms", F.col("pos").alias("at"))
    asked = anchors.where("terms > 1").join(_small(ranked.where("rank > 1").select("window", "term")), "window")
    asked = asked.withColumn("cell", F.explode(F.sequence(F.expr(f"(at - {within}) div {within + 1}"), F.expr(f"(at + {within}) div {within + 1}"))))
    near = asked.join(index.postings.withColumn("cell", F.expr(f"pos div {within + 1}")), ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    full = near.groupBy("row", "at", "window", "terms").agg(F.count_distinct("term").alias("n")).where("n = terms - 1")
    return full.select("row", F.col("at").alias("pos"), "window").unionByName(anchors.where("terms = 1").select("row", F.col("at").alias("pos"), "window"))


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of ``documents``.

    n_hit: words inside any occurrence of a window. Null and wordless texts have no words and no hits; repeated rows count each;
    items without words have no window; an empty table on either side gives no hits. Other columns aren't read.
    """
    tests = windows_of(items, item_id, text, size)
    index = build_index(documents, tests.terms, doc_id, text)
    hits = staged(phrase_matches(index, tests), "hits")
    hit_words = hits.select("row", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    hit_items = hits.select("row", "window").distinct().join(tests.windows.select("window", F.col("item").cast("string").alias("item")), "window")
    hit_items = hit_items.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))  # at most all items
    found = hit_words.join(hit_items, "row")
    none = F.array().cast("array<string>")
    return index.rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` whose id has no contaminated text; a null id counts as an id."""
    with scratch(documents.sparkSession) as keep:
        bad = keep(staged(contamination(documents, items, doc_id, text, item_id, size).where("contaminated").select("doc_id"), "contaminated"))
    return without_ids(documents, doc_id, bad)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS k
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

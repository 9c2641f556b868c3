"""Spelling variants: words of a vocabulary that differ by one letter, and the more frequent form that each one leads to.

Anagram hashing: a word's key is the sum of its letters' values (a power of the code point), the same for all orders of its letters. A letter
added or removed changes the key by one value, a letter exchanged by the difference of two. Words that are one exchange apart have equal
keys once each has lost its own letter, and a word that lost a letter has the key of the shorter word; so all pairs come out of one
equi-join on keys. Since one change leaves the first or the second half of a word as it is, that half is part of the join's key; the
order of all letters is verified on the pairs that meet.

All joins are merges by hint: Spark sizes a staged table by its compressed files, and a vocabulary of a few MB makes keyed rows of hundreds,
which it would otherwise send through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_staged, staged

RUN = "[A-Za-zÀ-ÿ]+"
#: A prime, which keeps the fifth powers of all code points apart (5 doesn't divide it less one) and sums within 64 bits.
PRIME = (1 << 31) - 1


def runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (text) and run of every run of letters in the texts, A-Z lower-cased. Null and empty texts have none; a null id is the text ``null``."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (id_col, text_col)]
    return documents.select(F.coalesce(quoted[0].cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(quoted[1], F.lit(RUN), F.lit(0))).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n of the distinct values of the column ``word``; nulls are passed over."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_values(word: Column) -> Column:
    """The values of a word's letters."""

    def value(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        square = code * code % PRIME
        return square * square % PRIME * code % PRIME

    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), value)


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """k, word, n: what a word has in common with its near words. Two rows (for each half) for its own key and for each letter that it may lose."""
    size, left = F.col("size"), F.col("left")
    rest = F.explode(F.concat(F.array(F.struct(F.lit(1).alias("more"), F.col("key").alias("rest"))), F.transform(F.array_distinct("values"), lambda v: F.struct(F.lit(0).alias("more"), (F.col("key") - v).alias("rest")))))
    rows = (
        vocabulary.select("word", "n", letter_values(F.col("word")).alias("values"))
        .select("word", "n", "values", F.size("values").alias("size"), F.aggregate("values", F.lit(0).cast("long"), lambda s, v: s + v).alias("key"))
        .select("word", "n", "size", rest.alias("x"))
        .select("word", "n", (size + F.col("x.more")).alias("size"), F.col("x.rest").alias("rest"))  # with its own key the word stands for one that is a letter longer
        .withColumn("left", F.expr("size div 2").cast("int"))
    )
    halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), left).alias("half")), F.struct(F.lit(1).alias("side"), F.right("word", size - left).alias("half"))))
    return rows.select("word", "n", "rest", halves.alias("h")).select(F.xxhash64("rest", "h.side", "h.half").alias("k"), "word", "n")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n (a < b): every pair of words that differ by exactly one inserted, deleted or replaced code point, once."""
    keyed = _keyed(vocabulary)
    a, b = keyed.toDF("k", "a", "a_n"), keyed.toDF("k2", "b", "b_n")
    met = a.join(b.hint("merge"), (F.col("k") == F.col("k2")) & (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def group_variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``vocabulary`` (distinct non-null ``word``, positive ``n``).

    A word's form is its near word with the largest n (ties: the smallest in code-point order), if that n is at least ``ratio`` (2 or more)
    times the word's; else null. ``root`` is where following forms ends. Since n doubles at least from form to form, chains have at
    most 62 steps and six rounds of doubling reach every root. Other columns aren't read; an empty vocabulary gives an empty table.
    """
    if ratio < 2:
        raise ValueError("a form has at least twice its variant's count: ratio must be 2 or more")
    words = staged(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_words(words)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m"))))
    best = pairs.select(sides.alias("x")).groupBy(F.col("x.word").alias("near_of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.m")).alias("m"), F.col("x.other").alias("other"))).alias("best"))
    takes = -F.col("best.m") >= ratio * F.col("n")
    formed = staged(
        words.join(best.hint("merge"), F.col("word") == F.col("near_of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")), "forms"
    )
    reached = formed.where("form is not null").select("word", F.col("form").alias("root"))
    before = None
    while True:
        step = reached.join(reached.toDF("of", "further").hint("merge"), F.col("root") == F.col("of"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open"))
        step = staged(step, "roots")
        if before is not None:
            drop_staged(words.sparkSession, before)
        before, reached = step, step.select("word", "root")
        if step.where("open").isEmpty():
            break
    drop_staged(words.sparkSession, words)
    return formed.join(reached.toDF("of", "reached").hint("merge"), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("reached", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return group_variants(vocabulary(runs(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(word.alias("word"))))


#: The checksum table is computed by its rule; near words are found through exact deletions at each place.
SQL = """
WITH RECURSIVE steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, run, count(*) AS n FROM found GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, steps),
worded AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM worded WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, p, substr(word, 1, p::INT - 1) || substr(word, p::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS ahead FROM formed UNION ALL SELECT c.word, c.ahead, f.form FROM chain c JOIN formed f ON f.word = c.ahead)
SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""

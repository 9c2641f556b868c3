import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from brute import ASCII_LOWER
from skemaforge.llm import spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [u for u in counts if is_near(w, u)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def words_of(rows):
    """The words that the query counts, of (doc_id, text) rows."""
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def by_sql(rows=None, path=None):
    c = duckdb.connect()
    if path:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    else:
        c.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
        if rows:
            c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({spelling_variants.SQL})").fetchall())


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    got = result(spelling_variants.op12_spelling_variants(spark, sf_dir))
    assert got == by_sql(path=sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(words_of(rows))


def texts(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéÀÿ×") for _ in range(rnd.randint(4, 8))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "Straße", "straße"]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randint(0, 60)):
            x = rnd.choice(base[: 1 + int(len(base) * rnd.random() ** 3)])
            if rnd.random() < 0.4:
                k = rnd.randrange(len(x))
                x = x[:k] + rnd.choice(["", rnd.choice("abcdeé"), x[k] + rnd.choice("abé")]) + x[k + 1 :]
            w.append(x.upper() if rnd.random() < 0.1 else x)
        rows.append((rnd.choice([None, i, i]), rnd.choice([" ", "-", ", "]).join(w)))
    return rows + [(1, None), (2, ""), (3, "12 中文 Ж"), (3, "abcde " * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_match_sql_and_brute_force(spark, tmp_path, seed):
    rows = texts(seed)
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1)}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(spelling_variants.op12_spelling_variants(spark, str(tmp_path)))
    assert got == brute(words_of(rows)) == by_sql(rows)
    assert any(r[1] for r in got)


def test_any_letters_and_long_chains(spark):
    """Words of any code points, also beyond 16 bits; a chain of nine forms."""
    counts = {"abc\U0001f600": 5, "abc\U0001f601": 50, "ab\U0001f601": 2, "": 1, "x": 9, "xy": 1, "中文": 4, "中": 8, "q" * 4000: 3, "q" * 4001: 7}
    counts |= {"abcdefghi"[: i + 1] + "mnopqrstu"[i + 1 :]: 2**i for i in range(9)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumns({"k": F.lit(0), "x.y": F.lit(1)})
    got = result(spelling_variants.group_variants(df))
    assert got == brute(counts)
    assert dict((r[0], r[2]) for r in got)["anopqrstu"] == "abcdefghi"
    with pytest.raises(ValueError):
        spelling_variants.group_variants(df, 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    counts = spelling_variants.vocabulary(spelling_variants.runs(df).withColumnRenamed("run", "word"))
    assert spelling_variants.group_variants(counts).count() == 0
    dotted = spark.createDataFrame([(None, "abcde Abcde abcde"), (7, None)], "`a.b` long, `c``d` string")
    counts = spelling_variants.vocabulary(spelling_variants.runs(dotted, "a.b", "c`d").withColumnRenamed("run", "word"))
    assert [tuple(r) for r in counts.collect()] == [("abcde", 3)]


def test_nothing_is_broadcast(spark):
    """A staged table's files may be far smaller than the rows made of it; Spark must not gather these in the driver on account of the files' size."""
    counts = {"abcdefghi"[: i + 1] + "mnopqrstu"[i + 1 :]: 2**i for i in range(9)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # the size from which a broadcast fails
    try:
        got = result(spelling_variants.group_variants(df))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == brute(counts)

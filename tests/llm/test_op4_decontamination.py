import hashlib

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import decontaminate


def want(docs, items, size=10):
    wins, out = brute.windows(items, size), []
    for i, t in docs:
        n, hit, found = brute.hits(t, wins)
        out.append((i, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = rows(decontaminate.op4_decontamination(spark, sf_dir))
    assert got == want(docs, items) and any(r[-1] for r in got)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(c.sql(decontaminate.SQL).fetchall(), key=str) == got


def test_odd_rows(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(14))
    items = [("b", passage), ("a", passage), ("s", "Tiny"), ("two", "x y"), ("n", None), ("e", "-- !"), ("r", "a a a a a a a a a a a")]
    docs = [(1, passage.upper() + "."), (1, passage), (2, None), (3, ""), (4, "tiny, TINY"), (5, "a " * 4000), (6, "x-y y x"), (None, passage), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (8, ("n%d " * 9 % tuple(range(9))) * 500 + passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "term": F.lit("x"), "n_hit": F.lit(None).cast("int"), "word": F.lit("w"), "gone": F.lit(1), "bad": F.lit(2)})
    b = spark.createDataFrame(items, "item_id string, text string").withColumn("window", F.lit(1))
    expected = want(docs, items)
    assert rows(decontaminate.contamination(d, b)) == expected
    assert rows(decontaminate.contamination(d, b.limit(0))) == want(docs, [])
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7] and {(r.gone, r.bad) for r in kept.collect()} == {(1, 2)}
    monkeypatch.setattr(decontaminate._small, "__defaults__", (0,))  # joins by shuffle
    assert rows(decontaminate.contamination(d, b)) == expected


@pytest.mark.parametrize("within", [1, 3, 8])
def test_proximity(spark, within):
    texts = ["p q r", "q x x p x r", "p x x x x x x x q r", "r q", "p p q r r p", "q r p q"]
    tests = decontaminate.windows_of(spark.createDataFrame([("i", "p q r"), ("j", "q")], "item_id string, text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontaminate.build_index(docs, tests.terms)
    got = decontaminate.proximity_matches(index, tests, within).join(index.rows, "row").join(tests.windows, "window").select("doc_id", "item", "pos")
    counts = {w: sum(t.split().count(w) for t in texts) for w in "pqr"}
    terms = {r.term: r.word for r in tests.terms.collect()}
    first = min(terms, key=lambda k: (counts[terms[k]], k))
    expected = {(i, "j", k) for i, t in enumerate(texts) for k, w in enumerate(t.split()) if w == "q"}
    for i, t in enumerate(texts):
        w = t.split()
        expected |= {(i, "i", k) for k in range(len(w)) if w[k] == terms[first] and {"p", "q", "r"} <= set(w[max(0, k - within) : k + within + 1])}
    assert {tuple(r) for r in got.collect()} == expected

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import jaccard_join


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.jaccard_components(rows, 4, 85)
    assert got(jaccard_join.op7_jaccard_join(spark, sf_dir)) == want
    assert sum(i != c for i, (_, c) in want.items()) > 3


def test_sql_matches_brute_force(sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = c.sql("SELECT doc_id, text FROM documents").fetchall()
    assert {i: (n, k) for i, n, k in c.sql(f"SELECT doc_id, n_shingles, component_id FROM ({jaccard_join.SQL})").fetchall()} == brute.jaccard_components(rows, 4, 85)


def family(rnd, n, words, edits, vocab):
    base = [rnd.choice(vocab) for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        yield " ".join(w)


@pytest.mark.parametrize("seed,hot,percent,size", [(1, 50, 85, 4), (2, 3, 85, 4), (3, 2, 80, 5), (4, 1, 60, 2), (5, 8, 80, 5)])
def test_families(spark, seed, hot, percent, size):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    texts = [t for n, words, edits in ((40, 120, 5), (25, 60, 3), (12, 30, 2), (30, 90, 12), (6, 8, 1)) for t in family(rnd, n, words, edits, vocab)]
    texts += [passage + " " + t for t in family(rnd, 20, 12, 6, vocab)] + [passage] * 5 + texts[:7]
    texts += [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 100))) for _ in range(40)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard_join.join_components(df, size=size, percent=percent, hot=hot)) == brute.jaccard_components(rows, size, percent)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \t\n"), (9, "one two"), (4, "ONE\ttwo "), (5, "one"), (6, "a b c d e f g " * 5000), (7, "a b c d e f g " * 5001), (8, "\u00c9 b c d e"), (10, "\u00e9 b c d e")]
    df = spark.createDataFrame([*rows, rows[3], (None, "one two")], "doc_id long, text string").withColumns({"n": F.lit(1), "sig": F.lit("x"), "doc": F.lit(2), "pool": F.lit(3), "gone": F.lit(4)})
    out = jaccard_join.join_components(df).collect()
    assert len(out) == 12 and [r.component_id for r in out if r.doc_id is None] == [None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id} == brute.jaccard_components(rows, 4, 85)
    assert jaccard_join.join_components(df.limit(0)).count() == 0
    left = jaccard_join.representatives(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted("1 2 3 4 5 6 8 10 None".split())
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert jaccard_join.representatives(df).count() == 9


@pytest.mark.parametrize("times", [(2, 1), (2, 2), (1, 3)])
def test_repeated_rows_make_no_links(spark, times):
    words = [f"v{i}" for i in range(103)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:97], "y", *words[98:102], "w"]))]
    rows += [(3, " ".join(f"u{i}" for i in range(103))), (4, " ".join([*(f"u{i}" for i in range(102)), "z"]))]
    share = [len(a & b) / len(a | b) for a, b in [[{tuple(t.split()[i : i + 4]) for i in range(100)} for _, t in rows[:2]]]]
    assert 0.8 < share[0] < 0.85  # somewhat below the threshold
    again = [r for r, n in zip(rows, [*times, *times]) for _ in range(n)]
    df = spark.createDataFrame(again, "doc_id long, text string").repartition(3)
    assert got(jaccard_join.join_components(df)) == brute.jaccard_components(rows, 4, 85) == {1: (100, 1), 2: (100, 2), 3: (100, 3), 4: (100, 3)}
    assert sorted(r.doc_id for r in jaccard_join.representatives(df).collect()) == sorted(i for i, _ in again if i != 4)


@pytest.mark.parametrize("fragments", [1, 5, 6, 8])
def test_fragments_hold_every_shingle(spark, fragments):
    docs = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(203)))], "doc_id long, text string")
    sets = jaccard_join._whole_sets(docs, spark.createDataFrame([(1,)], "doc long"), 4, fragments).collect()
    assert sum(len(r.hashes) for r in sets) == 200 and {r.fragment for r in sets} == set(range(fragments))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)], "a long, b long")
    found = {r.doc: r.comp for r in jaccard_join.components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 90, 90: 90, 95: 90}


def test_words_of_equal_polynomials_stay_apart(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert got(jaccard_join.join_components(df, size=4, percent=85)) == {1: (1, 1), 2: (1, 2)}

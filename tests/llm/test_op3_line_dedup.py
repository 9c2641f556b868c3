from collections import Counter

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import line_dedup


@pytest.mark.parametrize("lines", [500_000, 0])
def test_matches_brute_force(spark, sf_dir, lines):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = sorted(map(tuple, docs.collect()))
    want = brute.drop_lines([(s, t) for _, s, t in rows], line_dedup.RATIO, line_dedup.MIN_PAGES)
    got = line_dedup.drop_boilerplate(docs, broadcast_lines=lines).orderBy("doc_id").collect()
    assert [(r.doc_id, r.source, r.text) for r in got] == [(i, s, w) for (i, s, _), w in zip(rows, want)]


def test_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(f"SELECT doc_id, source, text FROM ({line_dedup.SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in line_dedup.op3_line_dedup(spark, sf_dir).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("lines", [500_000, 0])
def test_odd_rows(spark, lines):
    rows = [("h", "menu\nown %d\n  menu " % i) for i in range(6)] + [("h", None), ("h", ""), ("h", "menu")] + [(None, "menu\nx")] * 6 + [("g", "menu\nkept")] + [("h", "\n".join(f"line {i}" for i in range(20000)))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, text string").withColumns({"own_host": F.lit(1), "OWN_row": F.lit("y"), "gone_lines": F.lit(2), "host": F.lit(3), "line": F.lit(4), "n": F.lit(5), "pages": F.lit(6)})
    got = line_dedup.drop_boilerplate(df, broadcast_lines=lines)
    assert got.columns == df.columns
    assert {r[3:] for r in got.collect()} == {(1, "y", 2, 3, 4, 5, 6)}
    out = {r.doc_id: r.text for r in got.collect()}
    assert [out[i] for i in range(len(rows))] == brute.drop_lines(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert out[0] == "own 0" and out[6] is None and out[8] == "" and out[9] == "" and out[15] == "menu\nkept"
    twice = line_dedup.drop_boilerplate(df.unionByName(df), broadcast_lines=lines).collect()
    assert set(Counter(r.doc_id for r in twice).values()) == {2}
    assert line_dedup.drop_boilerplate(df.limit(0), broadcast_lines=lines).count() == 0


@pytest.mark.parametrize("lines", [500_000, 0])
def test_planted_rates_and_small_hosts(spark, lines):
    # numbers of the test's own, not the module's: lines on so many of a large host's 1000 pages, and small hosts
    planted = {"all": 1000, "often": 132, "tenth": 86, "section": 40, "corner": 20, "rare": 3}
    rows = [("big", i, [k for k, n in planted.items() if i * 7 % 1000 < n]) for i in range(1000)]
    rows += [(f"small{n}", i, ["menu"]) for n in (1, 2, 3, 4) for i in range(n)]
    texts = [(h, "\n".join([*held, f"own {h} {i}"])) for h, i, held in rows]
    want = ["\n".join([*(k for k in held if k == "rare" or h == "small1"), f"own {h} {i}"]) for h, i, held in rows]
    texts += [("copies", "one\ntwo")] * 2
    want += [""] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, source string, text string")
    assert [r.text for r in line_dedup.drop_boilerplate(df, broadcast_lines=lines).orderBy("doc_id").collect()] == want
    kept = line_dedup.drop_boilerplate(df.where("source in ('small2', 'small3', 'copies')"), broadcast_lines=lines, min_pages=3)  # a third page is asked for
    assert [r.text for r in kept.orderBy("doc_id").collect()] == [t for (h, _, _), (_, t) in zip(rows, texts) if h == "small2"] + [f"own small3 {i}" for i in range(3)] + ["one\ntwo"] * 2


def test_odd_column_names(spark):
    df = spark.createDataFrame([("h", "a\nb", 1), ("h", "a\nc", 2)], "`x.y` string, `t``t` string, `z.z` int")
    got = line_dedup.drop_boilerplate(df, host="x.y", text="t`t")
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [("h", "b", 1), ("h", "c", 2)]

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import block_knn


def plain(rows, queries, k=10):
    out = []
    for q, x in rows:
        if q in queries:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(x))[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [r[:3] for r in got] == [tuple(r[:3]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-12)


def test_query_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    same(block_knn.op10_block_knn(spark, sf_dir).collect(), sorted(c.sql(block_knn.SQL).fetchall()))


@pytest.mark.parametrize("rows,slices", [(4096, 4096), (37, 5), (10, 100)])
def test_blocks_match_brute_force(spark, rows, slices):
    rnd = np.random.default_rng(rows)
    v = np.round(rnd.normal(size=(300, 12)), 2)
    v[200:260] = v[:60]  # ties
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = block_knn.nearest(df, F.col("vec_id") % 7 == 0, block_rows=rows, slice_rows=slices)
    same(found.collect(), plain(data, set(range(0, 300, 7))))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1e-30, 0.0]), (4, [1e20, -1e20]), (5, [3.0, 2.0]), (10, [1.0, 1.0, 1.0]), (11, [2.0, 1.0, 1.0])]
    bad = [(20, None), (21, [0.0, 0.0]), (22, [nan, 1.0]), (23, [inf, 1.0]), (24, [None, 1.0]), (None, [1.0, 1.0]), (30, [])]
    df = spark.createDataFrame(good + bad + good[:2], "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "block": F.lit(2), "score": F.lit(3)})
    same(block_knn.nearest(df, F.col("vec_id") % 10 == 0).collect(), plain(good, {0, 10}))
    assert block_knn.nearest(df.limit(0), F.lit(True)).count() == 0
    assert block_knn.nearest(df, F.lit(False)).count() == 0
    assert block_knn.nearest(df, F.lit(None).cast("boolean")).count() == 0

from collections import defaultdict

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from skemaforge.llm import language_id, line_dedup
from skemaforge.llm.common import staged


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    key = lambda df: {r.doc_id: tuple(r) for r in df.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "best_fit_packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = key(docs), staged(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        after = key(out)
        i, s, t = (docs.columns.index(c) for c in ("doc_id", "source", "text"))
        if name == "language_id":
            model = language_id.fit(docs, by=F.col("doc_id"))
            gone = {r.doc_id for r in language_id.predict(docs, model).collect() if r.rejected}
            assert after == {k: v for k, v in before.items() if k not in gone}
        elif name == "line_dedup":
            rows = list(before.values())
            want = dict(zip((r[i] for r in rows), brute.drop_lines([(r[s], r[t]) for r in rows], line_dedup.RATIO, 3)))
            assert {k: v[t] for k, v in after.items()} == want
            assert all(v[docs.columns.index("n_chars")] == len(v[t]) for v in after.values())
        elif name == "jaccard_join":
            found = brute.jaccard_components([(k, v[t]) for k, v in before.items()], 5, 80)
            assert after == {k: v for k, v in before.items() if found[k][1] == k}
        else:
            wins = brute.windows(items)
            assert after == {k: v for k, v in before.items() if not brute.hits(v[t], wins)[1]}
        sizes.append(len(after))
        docs = out
    assert sizes[0] >= sizes[1] and sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0.5 * sizes[0]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in final} == set(key(docs))
    bins = defaultdict(int)
    for r in final:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in final)


def test_clashing_columns_and_null_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({c: F.lit(c) for c in ("gone", "bad", "own_host", "found", "node", "bin")})
    docs = staged(docs, "odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {(r.gone, r.own_host) for r in out.collect()} == {("gone", "own_host")}
    assert stage(spark, docs, sf_dir).count() > 0


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import language_id


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id")
    judged = found.where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = judged.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 50 and right / n >= 0.95
    assert found.where("score < 0 or score > 1 or lang_pred is null").isEmpty()
    letterless = ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    assert found.where((F.col("lang_pred") == "und") != letterless).isEmpty()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return language_id.fit(docs, by=F.col("doc_id"))


def test_several_centroids_a_language(model):
    assert max(np.unique(model.langs, return_counts=True)[1]) > 1
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(1, abs=1e-5)


def test_clusters_hold_a_share_of_the_rows(spark):
    rng = np.random.default_rng(1)
    groups = [language_id.unit(np.abs(rng.normal(m, 0.05, (n, 30)))).astype(np.float32) for m, n in ((np.eye(30)[0], 60), (np.eye(30)[1], 30), (np.eye(30)[2], 2))]
    c, near = language_id.cluster(np.concatenate(groups), 4)
    sizes = np.bincount(near)
    assert len(c) == len(sizes) >= 2 and sizes.min() >= 0.05 * 92
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and n_chars > 500")
    texts = [r.text for r in docs.where("lang = 'de'").orderBy("doc_id").limit(300).collect()]
    x = language_id.weighted(language_id.counts(pa.array(texts)), np.ones(language_id.DIMENSIONS, np.float32))
    c, near = language_id.cluster(x, language_id.CENTROIDS)
    assert np.bincount(near, minlength=len(c)).min() >= 0.05 * len(x)
    assert len(language_id.cluster(np.repeat(x[:1], 5, 0), 4)[0]) == 1


def test_odd_column_names(spark, model):
    df = spark.createDataFrame([("la maison de la rue", 1)], "`a.b` string, `c``d` int")
    assert language_id.predict(df, model, text="a.b").columns == ["a.b", "c`d", "lang_pred", "score", "rejected"]
    assert language_id.predict(df, model, text="a.b").count() == 1
    assert language_id.fit(df.withColumn("x.lang", F.lit("fr")), text="a.b", lang="x.lang").langs == ["fr"]


def test_nearest_centroid_matches_brute_force(spark, sf_dir, model):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(r"text rlike '\\p{L}'").limit(50).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.lang_pred, r.score) for r in language_id.predict(df, model).orderBy("doc_id").collect()]
    for (lang, score), text in zip(got, texts, strict=True):
        v = np.log1p(language_id.counts(pa.array([text]))[0]) * model.idf
        cos = [float(v @ c) / float(np.sqrt(v @ v)) for c in model.centroids]
        assert lang == model.langs[int(np.argmax(cos))] and score == pytest.approx(max(cos), abs=1e-4)


def test_far_texts_are_rejected(spark, sf_dir, model):
    far = ["\u8fd9\u662f\u4e00\u4e2a\u6d4b\u8bd5 " * 60, "zqxj vkwz qqxz jxkv " * 40]
    assert all(r.rejected for r in language_id.predict(spark.createDataFrame([(t,) for t in far], "text string"), model).collect())
    clean = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and n_chars > 300")
    n, gone = language_id.predict(clean, model).agg(F.count("*"), F.count_if("rejected")).first()
    assert gone <= 0.02 * n


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "a"), (5, "the house of the people " * 20000), (5, "the house of the people " * 20000), (6, "\u00e9"), (None, "la maison")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "lang": F.lit("de")})
    out = language_id.predict(df, model).collect()
    assert [r.lang_pred == "und" for r in out] == [True, True, True, False, False, False, False, False]
    assert all(r.rejected and r.score == 0 for r in out[:3]) and out[4] == out[5]
    assert language_id.predict(df.limit(0), model).count() == 0
    none = language_id.fit(df.limit(0))
    assert all(r.lang_pred == "und" and r.rejected for r in language_id.predict(df, none).collect())

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import space_words
from pyspark.sql import functions as F

from skemaforge.llm import katz


class Plain:
    """Katz backoff in dictionaries."""

    def __init__(self, texts):
        docs = [space_words(t) + ["\n"] for t in texts]
        self.c1 = Counter(w for d in docs for w in d)
        self.c2 = defaultdict(Counter)
        for d in docs:
            for h, w in zip(["\0", *d[:-1]], d):
                self.c2[h][w] += 1
        self.n = sum(self.c1.values())
        self.d1, self.d2 = self.discounts(self.c1.values()), self.discounts(c for x in self.c2.values() for c in x.values())
        self.free = sum((1 - self.d1[c]) * c for c in self.c1.values() if c <= 5)

    @staticmethod
    def discounts(counts):
        n = np.zeros(8, np.int64)
        for c in counts:
            n[min(c, 7)] += 1
        return katz.discounts(n[:7])

    def p1(self, w):
        c = self.c1[w]
        whole = self.n + (self.free == 0)
        return ((self.d1[c] * c if c <= 5 else c) if c else (self.free or 1.0)) / whole

    def p2(self, h, w):
        seen = self.c2.get(h)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        low = {x: c for x, c in seen.items() if c <= 5 and self.d2[c] < 1}
        free = sum((1 - self.d2[c]) * c for c in low.values()) if low else 1.0
        total += not low
        if c := seen[w]:
            return (self.d2[c] * c if c <= 5 else c) / total
        return free / total / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        t = space_words(text) + ["\n"]
        base = sum(math.log10((self.c1[w] + 0.1) / (self.n + 0.1 * (len(self.c1) + 1))) for w in t)
        return len(t), sum(self.c1[w] > 0 for w in t), self.n, base, sum(math.log10(self.p2(h, w)) for h, w in zip(["\0", *t[:-1]], t))


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def compare(found, rows, is_held=held):
    model = Plain([t for i, t in rows if not is_held(i)])
    want = sorted((i, is_held(i), *model.score(t)) for i, t in rows)
    got = sorted(tuple(r) for r in found.collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return model


def test_probabilities_sum_to_one(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    model = Plain([t for _, t in rows])
    words = [*model.c1, "never seen"]
    assert math.fsum(map(model.p1, words)) == pytest.approx(1)
    for h in ["\0", "unknown", *list(model.c2)[:40]]:
        assert math.fsum(model.p2(h, w) for w in words) == pytest.approx(1)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    compare(katz.op1_katz(spark, sf_dir), rows)


def test_many_batches_buckets_and_split_histories(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    found = katz.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, batch_tokens=3000, bucket_words=400, bucket_pairs=5000, hot=200)
    compare(found, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a  b\tB"), (3, "A a  b\tB"), (4, "a b c " * 3000), (5, "Ä ä  x"), (6, "z" * 50000), (7, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"held": F.lit(1), "score": F.lit("x"), "size": F.lit(None).cast("string")})
    compare(katz.score_texts(df, F.col("doc_id") == 5, batch_tokens=100), rows, lambda i: i == 5)
    assert katz.score_texts(df.limit(0), F.lit(False)).count() == 0
    nothing = katz.score_texts(df, F.lit(True)).where("doc_id = 3").first()
    assert (nothing.n_known, nothing.train_tokens, nothing.score) == (0, 0, 0)


def test_discounts():
    n = np.array([0, 100, 40, 20, 12, 8, 5])
    d, r = katz.discounts(n), np.arange(1, 6)
    tail = 6 * 5 / 100
    assert d[1:] == pytest.approx([((k + 1) * n[k + 1] / (k * n[k]) - tail) / (1 - tail) for k in r])
    assert katz.discounts(np.zeros(7, np.int64))[1:] == pytest.approx((r - 0.5) / r)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_polynomials_stay_apart(spark):
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other)]
    df = spark.createDataFrame([(i, t, i == 2) for i, t in rows], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in katz.score_texts(df, F.col("held_out")).collect()}
    assert got[1].n_known == 2 and got[2].n_known == 1

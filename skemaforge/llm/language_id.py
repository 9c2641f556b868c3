"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (1 to 3 bytes of its UTF-8 form; A-Z folded, every other ASCII byte that
is no letter a space): log term frequency times inverse document frequency, of unit length. Each language's training vectors are
clustered by spherical k-means into several centroids. The nearest centroid by cosine names the language; a text that lies further
from it than nearly all training rows of its cluster do, by a margin, is rejected.

Learning takes a sample of at most about ``sample_rows`` labelled rows a language, chosen by a hash of the id (the one bounded
sample; whole texts). Prediction reads whole texts of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, numbered_names, staged, text_bytes

DIMENSIONS = 4096
SAMPLE_ROWS = 400
CENTROIDS = 4
#: A cluster holds at least this share of its language's rows.
LEAST_SHARE = 0.05
#: A text is rejected below this share of a low cosine of its cluster's training rows: the one that a hundredth of them lies below.
MARGIN = 0.5
LOW = 0.01
#: Short texts lie further from any centroid: the bound is taken times size / (size + 200) of their n-grams. Of rows of four languages cut
#: short, the median cosine was 0.40 of the whole rows' at 145 n-grams, 0.39 to 0.51 at 300, 0.62 to 0.68 at 1,200 and 0.78 to 0.80 at
#: 3,000; with MARGIN the bound stays under these medians at every size.
SHORT = 200
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts of each text, a row each. Blank n-grams don't count."""
    data, at = text_bytes(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for lo in range(0, len(texts), 32):
        hi = min(lo + 32, len(texts))
        b = _FOLD[data[at[lo] : at[hi]]].astype(np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.int64) * DIMENSIONS, np.diff(at[lo : hi + 1]))
        h = np.zeros(len(b), np.uint32)
        blank = b == 32
        seen = np.ones(len(b), bool)
        for n in range(1, 4):
            m = len(b) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(2654435761) + b[n - 1 :] * np.uint32(40503) + np.uint32(n)
            seen = seen[:m] & blank[n - 1 :]
            slot = (((h ^ (h >> 15)) * np.uint32(2246822519)) >> 20).astype(np.int64)
            use = ~seen & (row[:m] == row[n - 1 :])  # within one text
            out[lo:hi] += np.bincount((row[:m] + slot)[use], minlength=(hi - lo) * DIMENSIONS).reshape(hi - lo, DIMENSIONS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(tf) * idf)


def cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from rows drawn by their distance from those drawn before; centroids (unit length) and each row's cluster.

    A cluster with less than ``least`` of the rows is dissolved into the others, the smallest first, so that no centroid stands for a few odd rows.
    """
    rng, picks = np.random.default_rng(len(x)), [0]
    while len(picks) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[picks].T).max(1), 0) ** 2
        if far.sum() <= 0:
            break
        picks.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[picks].copy()
    while True:
        for _ in range(rounds):
            near = np.argmax(x @ c.T, 1)
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = x[near == j].mean(0)
            c = unit(c)
        near = np.argmax(x @ c.T, 1)
        sizes = np.bincount(near, minlength=len(c))
        if len(c) == 1 or sizes.min() >= least * len(x):
            return c, near
        c = np.delete(c, sizes.argmin(), 0)


@dataclass
class CentroidModel:
    """Languages and low cosines (``least``) of the centroids, a row of ``centroids`` each."""

    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", by: Column | None = None, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> CentroidModel:
    """Learn from rows with a text and a language; ``by`` orders the sample (a hash of the text by default).

    What comes to the driver is k centroids a language and one vector of document frequencies.
    """
    rows = labelled.select(named(text).alias("text"), named(lang).alias("lang"), (F.xxhash64(named(text)) if by is None else F.xxhash64(by)).alias("h")).where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return CentroidModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS, np.float32))
    share = rows.sparkSession.createDataFrame([(k_, min(1.0, sample_rows / n)) for k_, n in sizes.items()], "lang string, share double")
    mod = 1 << 20
    sample = rows.join(F.broadcast(share), "lang").where((F.pmod("h", F.lit(mod)) < F.col("share") * mod) | (F.col("share") >= 1))  # one row a language
    sample = staged(sample.select("lang", "text"), "labelled")

    def frequencies(batches):
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                df += (counts(b.column("text").slice(lo, 256)) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])

    parts = sample.select("text").mapInArrow(frequencies, "df binary, n long").collect()  # a vector a task
    n = sum(p["n"] for p in parts)
    idf = np.log((1 + n) / (1 + sum(np.frombuffer(p["df"], np.int64) for p in parts))).astype(np.float32) + np.float32(0.1)

    def centroids(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("text")
        x = weighted(counts(pa.array(own["text"])), idf)
        c, near = cluster(x, k)
        return pd.DataFrame({"lang": own["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "least": [float(np.quantile(x[near == j] @ c[j], LOW)) for j in range(len(c))]})

    found = sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, least double").orderBy("lang", "centroid").collect()
    return CentroidModel([r["lang"] for r in found], np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), np.array([r["least"] for r in found]), idf)


def predict(df: DataFrame, model: CentroidModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score (cosine, 0 to 1) and rejected; columns of these names are replaced.

    Null, empty and letterless texts are ``und`` with score 0, and rejected; so are all where nothing was learned. Equal texts get
    equal answers, ties go to the first language by name. Empty tables give empty results; very long texts are read whole.
    """
    out = df.drop("lang_pred", "score", "rejected")
    names = out.columns
    at = names.index(text) if text in names else [c.lower() for c in names].index(text.lower())
    plain = numbered_names(out)
    headers = [*plain.columns, "lang_pred", "score", "rejected"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # k vectors a language

    def answer(batches):
        m = shared.value
        for b in batches:
            texts = b.column(at)
            lang, score, rejected = [], [], []
            for lo in range(0, b.num_rows, 256):
                part = texts.slice(lo, 256)
                lettered = [t is not None and any(map(str.isalpha, t)) for t in part.to_pylist()]
                tf = counts(part)
                cos = weighted(tf, m.idf) @ m.centroids.T if m.langs else np.zeros((len(part), 1))
                best, size = cos.argmax(1), tf.sum(1)
                for i, ok in enumerate(lettered):
                    ok = ok and bool(m.langs)
                    s = float(min(1.0, max(0.0, cos[i, best[i]]))) if ok else 0.0
                    lang.append(m.langs[best[i]] if ok else UNKNOWN)
                    score.append(s)
                    rejected.append(not ok or s < margin * m.least[best[i]] * size[i] / (size[i] + SHORT))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=headers)

    schema = plain.limit(0).select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    return plain.mapInArrow(answer, schema).toDF(*names, "lang_pred", "score", "rejected")


def remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % mod


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out), by=F.col("doc_id"))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")

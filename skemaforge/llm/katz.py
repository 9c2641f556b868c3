"""Katz backoff scoring of texts with a bigram, unigram and zerogram model.

Tokens are words (ASCII white space between them, A-Z folded) and one end a text. Good-Turing discounts apply to counts up to five,
at both orders; what they set free goes to unseen tokens, in proportion to the lower order, by weights that make each history's
distribution sum to one exactly: p(w | h) = d(c) c / c(h) if h w was seen, else a(h) p(w); p(w) = d(c) c / N if w was seen, else the
mass of the one unknown token.

Work follows the corpus: texts become batches of packed token numbers (one stored row a batch). A batch asks for each of its distinct words
or word pairs once, so a hot word or pair costs one entry a batch, however frequent it is. Requests are dealt into buckets; a bucket sums the
counts of all batches, stores its part of the count table, and answers each batch. Histories that make up a large share of all tokens are split over the
buckets by the next word, and their sums are added afterwards. Scores are evaluated in the batch, token by token from pairs down.

Everything that is stored lies in the shared folder: ``order=1`` and ``order=2`` hold the count tables, partitioned by kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, mix, stage_path, staged, text_bytes, word_hashes

#: Tokens of a batch, distinct words and pairs of a bucket (means).
BATCH_TOKENS = 500_000
BUCKET_WORDS = 500_000
BUCKET_PAIRS = 1_500_000
DISCOUNTED = 5
END = np.uint64(0x656E64)
START_ID = np.uint64(1 << 62)


def pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost nothing."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack(blob, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def discounts(n: np.ndarray) -> np.ndarray:
    """d[1..5] from the counts of counts n[1..6]; d[0] is unused.

    Good-Turing ratios in Katz's form for counts up to the largest k <= 5 for which all lie between 0 and 1 (larger counts keep d = 1);
    where there is none, as in very small corpora, (r - 1/2) / r.
    """
    r = np.arange(1, DISCOUNTED + 1)
    for k in range(DISCOUNTED, 0, -1):
        with np.errstate(all="ignore"):
            tail = (k + 1) * n[k + 1] / n[1]
            good = ((r[:k] + 1) * n[2 : k + 2] / (r[:k] * n[1 : k + 1]) - tail) / (1 - tail)
        if tail < 1 and ((good > 0) & (good < 1)).all():
            return np.concatenate(([np.nan], good, np.ones(DISCOUNTED - k)))
    return np.concatenate(([np.nan], (r - 0.5) / r))


@dataclass
class Unigrams:
    tokens: int
    types: int
    d: np.ndarray
    free: float  # tokens set free for the unknown one

    @classmethod
    def of(cls, tokens: int, types: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        r = np.arange(1, DISCOUNTED + 1)
        return cls(tokens, types, d, float(((1 - d[1:]) * r * n[1 : DISCOUNTED + 1]).sum()))

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word of count c; of the unknown word for 0. Without a discounted word one token more is assumed."""
        whole = self.tokens + (self.free == 0)
        weight = np.where(c <= DISCOUNTED, self.d[np.minimum(c, DISCOUNTED)] * c, c)
        return np.where(c > 0, weight, self.free or 1.0) / whole


def _split(keys: np.ndarray, n: int):
    """(number, slice) of the runs of sorted bucket numbers."""
    cuts = np.searchsorted(keys, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(cuts[b], cuts[b + 1])


def batches_of(documents: DataFrame, limit: int) -> DataFrame:
    """batch, docs, held, lens, vocab (sorted word hashes), tokens (places in vocab), size: a row a batch. documents: doc_id, text, held."""

    def encode(batches):
        part, k = TaskContext.get().partitionId(), 0
        docs, held, lens, words, n = [], [], [], [], 0

        def row():
            vocab, tokens = np.unique(np.concatenate(words), return_inverse=True)
            cols = [[(part << 32) + k], [docs], [held], [pack(np.concatenate(lens).astype(np.uint32))], [vocab.tobytes()], [pack(tokens.astype(np.uint32))], [n], [len(vocab)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["batch", "docs", "held", "lens", "vocab", "tokens", "size", "words"])

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                rows = b.slice(lo, 512)
                data, at = text_bytes(rows.column("text"))
                h, starts = word_hashes(data)
                ends = np.searchsorted(starts, at[1:])
                words.append(np.insert(h, ends, END))
                lens.append(np.diff(ends, prepend=0) + 1)
                docs += rows.column("doc_id").to_pylist()
                held += rows.column("held").to_pylist()
                n += len(words[-1])
                if n >= limit:
                    yield row()
                    docs, held, lens, words, n, k = [], [], [], [], 0, k + 1
        if docs:
            yield row()

    return documents.mapInArrow(encode, "batch long, docs array<long>, held array<boolean>, lens binary, vocab binary, tokens binary, size long, words long")


def _training(row: dict, lens: np.ndarray) -> np.ndarray:
    return np.repeat(~np.array(row["held"], bool), lens)


def _word_requests(corpus: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                lens, vocab, tokens = unpack(row["lens"], np.uint32), np.frombuffer(row["vocab"], np.uint64), unpack(row["tokens"], np.uint32)
                count = np.bincount(tokens[_training(row, lens)], minlength=len(vocab)).astype(np.uint64)
                # hashes are even over their range, so equal ranges make even buckets, and slices of the sorted vocabulary
                parts = [(k, vocab[s].tobytes(), pack(count[s])) for k, s in _split(((vocab >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), buckets)]
                cols = [pa.array([p[0] for p in parts], pa.int32()), pa.array([row["batch"]] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "batch", "keys", "counts"])

    return corpus.select("batch", "held", "lens", "vocab", "tokens").mapInArrow(ask, "bucket int, batch long, keys binary, counts binary")


ANSWER = "kind string, bucket int, batch long, a binary, b binary, c binary, d binary"
_ANSWER_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("batch", pa.int64()), *((x, pa.binary()) for x in "abcd")])


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ANSWER_ARROW)}, schema=_ANSWER_ARROW)


def _count_words(requests: DataFrame, buckets: int) -> DataFrame:
    """Answers (ids and counts of a batch's words of the bucket), the table (hashes, ids, counts) and statistics."""

    def bucket(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        k = rows[0]["bucket"]
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        words, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["counts"], np.uint64) for r in rows]), len(words)).astype(np.uint64)
        ids = np.empty(len(words), np.uint64)
        ids[np.argsort(total, kind="stable")[::-1]] = np.arange(len(words), dtype=np.uint64) * np.uint64(buckets) + np.uint64(k)  # frequent words get small numbers
        out, at = [], 0
        for r, own in zip(rows, keys):
            p = place[at : at + len(own)]
            at += len(own)
            out.append(("answer", k, r["batch"], pack(ids[p]), pack(total[p]), None, None))
        seen = total > 0
        out.append(("table", k, None, words[seen].tobytes(), pack(ids[seen]), pack(total[seen]), None))
        n = np.bincount(np.minimum(total, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
        n[0] = seen.sum()
        out.append(("stats", k, None, np.array([total.sum(), *n], np.int64).tobytes(), None, None, None))
        return _answers(out)

    return requests.groupBy("bucket").applyInArrow(bucket, ANSWER)


def _summed(stats: DataFrame) -> np.ndarray:
    """A few numbers a bucket, summed in the driver."""
    return sum((np.frombuffer(r["a"], np.int64) for r in stats.select("a").toLocalIterator()), np.zeros(DISCOUNTED + 3, np.int64))


def _with_words(corpus: DataFrame, answers: DataFrame) -> DataFrame:
    """The batches with each word's id and count in place of its hash."""

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        ids, counts = (np.concatenate([unpack(r[x], np.uint64) for r in parts]) for x in "ab")
        t = left.select(["batch", "docs", "held", "lens", "tokens"])
        return t.append_column("ids", pa.array([pack(ids)], pa.binary())).append_column("counts", pa.array([pack(counts)], pa.binary()))

    left = corpus.select("batch", "docs", "held", "lens", "tokens").groupBy("batch")
    right = answers.select(F.col("batch").alias("to"), "bucket", "a", "b").groupBy("to")
    return left.cogroup(right).applyInArrow(fill, "batch long, docs array<long>, held array<boolean>, lens binary, tokens binary, ids binary, counts binary")


class Pairs:
    """A batch's distinct (history, word) pairs, in the order in which they are dealt to buckets."""

    def __init__(self, row: dict, buckets: int, hot: int):
        self.lens, self.tokens = unpack(row["lens"], np.uint32), unpack(row["tokens"], np.uint32)
        ids, counts = unpack(row["ids"], np.uint64), unpack(row["counts"], np.uint64)
        self.word_counts = counts
        n = len(ids)
        starts = np.cumsum(self.lens, dtype=np.int64) - self.lens
        self.starts = starts
        before = np.concatenate(([n], self.tokens[:-1])).astype(np.uint64)
        before[starts] = n
        keys, self.of_token = np.unique(before * np.uint64(n + 1) + self.tokens, return_inverse=True)
        h, w = (keys // np.uint64(n + 1)).astype(np.int64), (keys % np.uint64(n + 1)).astype(np.int64)
        ends = counts[self.tokens[starts[0] + self.lens[0] - 1]]  # as many starts as ends
        hid, ch = np.append(ids, START_ID)[h], np.append(counts, ends)[h]
        wid = ids[w]
        with np.errstate(over="ignore"):
            salt = np.where(ch > hot, mix(wid + np.uint64(1)), np.uint64(0))
            bucket = (mix(hid ^ salt) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((wid, hid, bucket))
        self.bucket, self.hid, self.wid, self.ch, self.cw = bucket[self.order], hid[self.order], wid[self.order], ch[self.order], counts[w][self.order]

    def runs(self, s: slice) -> tuple[np.ndarray, np.ndarray]:
        """First places and lengths of the histories within a bucket's slice."""
        h = self.hid[s]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return first, np.diff(np.append(first, len(h))).astype(np.uint32)


def _pair_requests(corpus: DataFrame, buckets: int, hot: int) -> DataFrame:
    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                p = Pairs(row, buckets, hot)
                mask = _training(row, p.lens)
                count = np.bincount(p.of_token[mask], minlength=len(p.order)).astype(np.uint32)[p.order]
                parts = []
                for k, s in _split(p.bucket, buckets):
                    first, runs = p.runs(s)
                    parts.append((k, row["batch"], pack(p.hid[s][first]), pack(p.ch[s][first]), pack(runs), pack(p.wid[s]), pack(p.cw[s]), pack(count[s])))
                names = ["bucket", "batch", "hid", "ch", "runs", "wid", "cw", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in parts], pa.int32() if i == 0 else pa.int64() if i == 1 else pa.binary()) for i in range(8)], names=names)

    return corpus.select("batch", "held", "lens", "tokens", "ids", "counts").mapInArrow(ask, "bucket int, batch long, hid binary, ch binary, runs binary, wid binary, cw binary, counts binary")


def _count_pairs(requests: DataFrame, words: Unigrams, hot: int) -> DataFrame:
    """Answers: a = counts of the pairs asked; b = for each history asked twice its least count of a pair (6 for more), plus 1 if a pair asked is unseen; c, d = sums of the histories with an unseen pair.

    Sums of a history: discounted pairs by count (T1..T5) and the words' lower-order mass. Rows ``hot`` hold the partial sums of split histories.
    """

    def bucket(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        k = rows[0]["bucket"]
        runs = [unpack(r["runs"], np.uint32) for r in rows]
        h = np.concatenate([np.repeat(unpack(r["hid"], np.uint64), n) for r, n in zip(rows, runs)])
        ch = np.concatenate([np.repeat(unpack(r["ch"], np.uint64), n) for r, n in zip(rows, runs)])
        w, cw = (np.concatenate([unpack(r[x], np.uint64) for r in rows]) for x in ("wid", "cw"))
        c = np.concatenate([unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new_h = np.concatenate(([True], hs[1:] != hs[:-1]))
        new = new_h | np.concatenate(([True], ws[1:] != ws[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(c[order], first)
        pair = np.empty(len(h), np.int64)
        pair[order] = np.cumsum(new) - 1
        h_first = np.flatnonzero(new_h[first])  # of each history, its first pair
        history = np.cumsum(new_h[first]) - 1
        seen = total > 0
        sums = np.stack([np.add.reduceat((total == r).astype(np.int64), h_first) for r in range(1, DISCOUNTED + 1)])
        mass = np.add.reduceat(np.where(seen, words.p(cw[order][first].astype(np.int64)), 0.0), h_first)
        least = np.where(sums.any(0), (sums > 0).argmax(0) + 1, DISCOUNTED + 1)
        out, at = [], 0
        for r, n in zip(rows, runs):
            got = total[pair[at : at + int(n.sum())]]
            heads = at + np.concatenate(([0], np.cumsum(n[:-1], dtype=np.int64)))
            own = history[pair[heads]]
            unseen = np.add.reduceat((got == 0).astype(np.int64), heads - at) > 0
            out.append(("answer", k, r["batch"], pack(got.astype(np.uint32)), pack((least[own] * 2 + unseen).astype(np.uint8)), pack(sums[:, own[unseen]].T.ravel().astype(np.uint64)), mass[own[unseen]].tobytes()))
            at += len(got)
        ids, big = hs[first][h_first], ch[order][first][h_first] > hot
        if big.any():
            out.append(("hot", k, None, ids[big].tobytes(), sums[:, big].T.astype(np.int64).tobytes(), mass[big].tobytes(), None))
        held = history[seen]
        out.append(("table", k, None, pack(ids), pack(np.bincount(held, minlength=len(ids)).astype(np.uint32)), pack(ws[first][seen]), pack(total[seen].astype(np.uint32))))
        n = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
        out.append(("stats", k, None, np.array([total.sum(), *n], np.int64).tobytes(), None, None, None))
        return _answers(out)

    return requests.groupBy("bucket").applyInArrow(bucket, ANSWER)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(corpus: DataFrame, answers: DataFrame, words: Unigrams, d: np.ndarray, large: dict, buckets: int, hot: int) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(large)
    r = np.arange(1, DISCOUNTED + 1)
    last = int((d[1:] < 1).sum())  # counts up to this are discounted

    def weights(sums: np.ndarray, mass: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Backoff weights: what the discounts set free over the lower order's mass of what wasn't seen."""
        free = ((1 - d[1:]) * r * sums).sum(1)
        plain = sums[:, :last].sum(1) == 0
        return np.where(plain, 1.0, free) / (ch + plain) / np.maximum(1 - mass, 1e-12)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, parts = left.to_pylist()[0], {x["bucket"]: x for x in right.to_pylist()}
        p = Pairs(row, buckets, hot)
        p1 = words.p(p.cw.astype(np.int64))
        logp = np.empty(len(p.order))
        for k, s in _split(p.bucket, buckets):
            got, flags = unpack(parts[k]["a"], np.uint32).astype(np.int64), unpack(parts[k]["b"], np.uint8)
            first, n = p.runs(s)
            ids, ch = p.hid[s][first], p.ch[s][first].astype(np.float64)
            plain, unseen = flags // 2 > last, flags % 2 == 1
            sums, mass = unpack(parts[k]["c"], np.uint64).reshape(-1, DISCOUNTED).astype(np.float64), np.frombuffer(parts[k]["d"], np.float64)
            back = np.ones(len(ids))
            back[unseen] = np.where(ch[unseen] > 0, weights(sums, mass, np.maximum(ch[unseen], 1)), 1.0)
            for i in np.flatnonzero(ch > hot):  # split histories have their sums in whole elsewhere
                whole_sums, whole_mass = shared.value[int(ids[i])]
                plain[i] = not whole_sums[:last].any()
                back[i] = weights(whole_sums[None].astype(np.float64), np.array([whole_mass]), ch[i : i + 1])[0]
            given = np.repeat(ch + (plain & (ch > 0)), n)
            kept = np.where(got <= DISCOUNTED, d[np.minimum(got, DISCOUNTED)] * got, got)
            with np.errstate(divide="ignore", invalid="ignore"):
                logp[s] = np.log10(np.where(got > 0, kept / given, np.repeat(back, n) * p1[s]))
        of_key = np.empty(len(logp))
        of_key[p.order] = logp
        c = p.word_counts[p.tokens].astype(np.float64)
        base = np.log10((c + 0.1) / (words.tokens + 0.1 * (words.types + 1)))
        total = lambda x: np.add.reduceat(x, p.starts)
        cols = [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(p.lens.astype(np.int64)), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(p.lens), words.tokens, np.int64)), pa.array(total(base)), pa.array(total(of_key[p.of_token]))]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    left = corpus.groupBy("batch")
    right = answers.select(F.col("batch").alias("to"), "bucket", "a", "b", "c", "d").groupBy("to")
    return left.cogroup(right).applyInArrow(score, RESULT)


def _kinds(df: DataFrame, path: str) -> DataFrame:
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that are over: it acts when the driver's JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def score_texts(documents: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS, bucket_words: int = BUCKET_WORDS, bucket_pairs: int = BUCKET_PAIRS, hot: int | None = None, path: str | None = None) -> DataFrame:
    """Learn from the rows where ``held_out`` isn't true and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: its end alone. Repeated rows count and are scored each; a null id trains and stays null. Very long texts are
    read whole. An empty table gives an empty result; with nothing to learn from, every token is the unknown one, of probability one. Other
    columns aren't read. ``path`` keeps the count tables.
    """
    spark = documents.sparkSession
    path = path or stage_path(spark, "katz")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    raw = staged(batches_of(docs, batch_tokens), "batches")
    size, vocab = raw.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    buckets = max(1, -(-vocab // bucket_words))
    first = _kinds(_count_words(_word_requests(raw, buckets), buckets), f"{path}/order=1")
    stats = _summed(first.where("kind = 'stats'"))
    words = Unigrams.of(int(stats[0]), int(stats[1]), stats[1:])
    corpus = staged(_with_words(raw, first.where("kind = 'answer'")), "batches")
    drop_staged(spark, raw)
    _settle(spark)

    buckets = max(1, -(-size // bucket_pairs))
    hot = hot if hot is not None else max(1, words.tokens // (4 * buckets))
    second = _kinds(_count_pairs(_pair_requests(corpus, buckets, hot), words, hot), f"{path}/order=2")
    d = discounts(_summed(second.where("kind = 'stats'"))[1:])
    large: dict = {}
    for r in second.where("kind = 'hot'").select("a", "b", "c").toLocalIterator():  # histories with over 1 / (4 buckets) of all tokens: a few a bucket
        ids, sums, mass = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.int64).reshape(-1, DISCOUNTED), np.frombuffer(r["c"], np.float64)
        for i, s, m in zip(ids.tolist(), sums, mass.tolist()):
            had = large.get(i, (0, 0.0))
            large[i] = (had[0] + s, had[1] + m)
    _settle(spark)
    return _scores(corpus, second.where("kind = 'answer'"), words, d, large, buckets, hot)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)

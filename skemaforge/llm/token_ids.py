"""Token ids by a public tokenizer, and their Parquet file format.

Files hold one row a document in ascending id order: ``doc_id``, ``part`` (number of the file's range), ``local_start`` (ids
before it within the range), ``n_tokens`` and ``tokens`` (list of int, dictionary-encoded). Small row groups and pages with
column and offset indexes let a reader take a range of documents, or the metadata alone, without reading the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import span_hashes, stage_path, text_bytes

#: Rows and bytes of text that are encoded at a time (a longer text is encoded in parts).
ROWS = 1024
STEP = 2 << 20
#: Bytes that the kept pieces of a task may take before they are dropped and learned afresh.
CACHE_BYTES = 48 << 20
#: Writer settings: dictionary pages, 8 MB row groups, 64 KB pages (each with its entry in the page index).
FORMAT = {"compression": "zstd", "parquet.enable.dictionary": "true", "parquet.block.size": str(8 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "1000", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "v2"}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Classes of bytes. Cuts are made only beside characters whose class is certain.
LETTER, DIGIT, OTHER, QUOTE, SPACE, ODD = range(1, 7)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[33:127] = OTHER
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[39] = QUOTE
_CLASS[[*range(9, 14), 32]] = SPACE
#: Lead bytes of U+00C0 to U+027F and U+0400 to U+047F: letters all (but two signs), with any byte that follows.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
#: A piece with one of these may be several words.
_MIXED = np.isin(np.arange(ODD + 1), (QUOTE, ODD))


def byte_classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    lead = np.flatnonzero(_LEAD[data])
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]  # the signs for times and divided by
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def cut_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where byte-level pre-tokenization cuts for certain whatever stands around, and the bytes' classes. ``ends``: where texts end.

    Its pattern takes contractions, then runs of letters, of digits and of other signs (each with one space before), then white
    space; the last white space before a non-space stands alone or, if it is a space, goes with what follows.
    """
    kind = byte_classes(data)
    space, known = kind == SPACE, (kind != SPACE) & (kind != ODD)
    blank = data == 32
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        told = known[:-1] & known[1:]
        # runs of one class end; what follows an apostrophe may be a contraction
        cut[1:-1] = told & (before != after) & (before != QUOTE) & ~((before == OTHER) & (after == QUOTE))
        cut[1:-1] |= known[:-1] & space[1:]
        cut[1:-1] |= space[:-1] & ~blank[:-1] & known[1:]
        last = np.zeros(len(data), bool)  # white space before a certain non-space of the same text
        last[:-1] = space[:-1] & known[1:]
        last[ends[(ends > 0) & (ends <= len(data))] - 1] = False
        cut[:-1] |= last & blank
        cut[1:-1] |= last[1:] & space[:-1]
    cut[ends] = True
    cut[0] = True
    return np.flatnonzero(cut), kind


def byte_alphabet() -> np.ndarray:
    """The character that a byte-level vocabulary writes for each byte: itself if it can be seen, else the next from U+0100 on."""
    seen = [33 <= b < 127 or 161 <= b < 173 or b >= 174 for b in range(256)]
    return np.where(seen, np.arange(256), 255 + np.cumsum(~np.array(seen))).astype("<u4")


class WordEncoder:
    """A byte-level BPE tokenizer from its file, which asks the tokenizers library once for each distinct piece.

    Texts are cut at the places of ``cut_places``; a text's ids are those of its pieces. Pieces are found by 64-bit hashes and
    confirmed on their bytes. A new piece of one class of characters is one word of the library's BPE model; any other goes through
    the whole tokenizer. Whole texts do where they hold an added token's string (with ``special_tokens`` such a string is its
    one id, which is the library's default; else ordinary text), and all texts where the file's pre-tokenization is of another kind.
    """

    def __init__(self, path: str, special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special_tokens
        form = json.loads(self.library.to_str())
        pre = form["pre_tokenizer"] or {}
        other = form["normalizer"] or form["truncation"] or form["padding"] or form["model"].get("dropout")
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and form["model"]["type"] == "BPE" and not other
        added = [t["content"].encode() for t in form["added_tokens"] if special_tokens or not t["special"]]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        """Drop the kept pieces."""
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)  # sorted hashes, and each one's piece
        self.pieces, self.piece_at = np.empty(0, np.uint8), np.zeros(1, np.int32)  # bytes
        self.ids, self.ids_at = np.empty(0, np.uint32), np.zeros(1, np.int32)

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Take up new pieces; returns their numbers."""
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        where = np.repeat((starts - at[:-1]).astype(np.int32), sizes) + np.arange(at[-1], dtype=np.int32)
        raw = data[where]
        mixed = np.logical_or.reduceat((_MIXED[kind[where]]), at[:-1])
        text, word = self.alphabet[raw].tobytes().decode("utf-32-le"), self.library.model.tokenize  # a character a byte
        flat, count = [], []
        whole = iter(self._each([raw[at[k] : at[k + 1]].tobytes().decode() for k in np.flatnonzero(mixed).tolist()]))
        i = 0
        for j, m in zip(at[1:].tolist(), mixed.tolist()):
            flat += next(whole) if m else [t.id for t in word(text[i:j])]
            count.append(len(flat))
            i = j
        number = np.arange(len(self.piece_at) - 1, len(self.piece_at) - 1 + len(sizes), dtype=np.int32)
        self.pieces, self.piece_at = np.concatenate((self.pieces, raw)), np.concatenate((self.piece_at, self.piece_at[-1] + at[1:]))
        self.ids, self.ids_at = np.concatenate((self.ids, np.array(flat, np.uint32))), np.concatenate((self.ids_at, self.ids_at[-1] + np.array(count, np.int32)))
        by = np.argsort(hashes)
        to = np.searchsorted(self.keys, hashes[by])
        self.keys, self.place = np.insert(self.keys, to, hashes[by]), np.insert(self.place, to, number[by])
        return number

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that end at ``ends``, and where each one's end."""
        if 12 * len(self.keys) + 8 * len(self.piece_at) + len(self.pieces) + 4 * len(self.ids) > CACHE_BYTES:
            self.forget()
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(ends), np.int64)
        at, kind = cut_places(data, ends)
        starts, sizes = at[:-1], np.diff(at)
        code, distinct = pd.factorize(span_hashes(data, starts, at[1:]))
        number = np.full(len(distinct), -1, np.int32)
        if len(self.keys):
            seen = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            number = np.where(self.keys[seen] == distinct, self.place[seen], -1)
        new = np.flatnonzero(number < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            number[new] = self._learn(data, kind, starts[first[new]], sizes[first[new]], distinct[new])
        piece = number[code]
        from_ = self.piece_at[piece]
        same = np.array_equal(self.piece_at[piece + 1] - from_, sizes)
        if not same or not np.array_equal(self.pieces[np.repeat(from_ - starts.astype(np.int32), sizes) + np.arange(len(data), dtype=np.int32)], data):
            # two pieces of one hash: these texts by the library
            got = self._each([data[i:j].tobytes().decode() for i, j in zip([0, *ends.tolist()], ends.tolist())])
            return np.array(list(chain.from_iterable(got)), np.uint32), np.cumsum([len(x) for x in got])
        n = self.ids_at[piece + 1] - self.ids_at[piece]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.ids_at[piece] - total[:-1].astype(np.int32), n) + np.arange(total[-1], dtype=np.int32)]
        return ids, total[np.searchsorted(at, ends)]

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of the texts, each with the end id, and where each one's end; null is empty."""
        data, at = text_bytes(texts)
        out, sizes = [], np.zeros(len(texts), np.int64)
        ends = np.array([end], np.uint32)
        whole = set()
        if not self.plain:
            whole = set(range(len(texts)))
        elif self.added and len(data):
            whole = set(np.searchsorted(at, [m.start() for m in self.added.finditer(data.tobytes())], "right") - 1)
        lo = 0
        while lo < len(texts):
            if lo in whole:
                got = np.array(self._each([data[at[lo] : at[lo + 1] - 1].tobytes().decode()])[0], np.uint32)
                out += [got, ends]
                sizes[lo] = len(got) + 1
                lo += 1
                continue
            hi = lo + 1
            while hi < len(texts) and hi not in whole and at[hi + 1] - at[lo] <= STEP:
                hi += 1
            for part, own in self._parts(data, at, lo, hi):
                ids, stops = self._cut(part, own)
                if hi - lo == 1:
                    out.append(ids)
                    sizes[lo] += len(ids)
                else:
                    n = np.diff(stops, prepend=0)
                    out.append(np.insert(ids, stops, end))
                    sizes[lo:hi] = n + 1
            if hi - lo == 1:
                out.append(ends)
                sizes[lo] += 1
            lo = hi
        return np.concatenate(out) if out else np.empty(0, np.uint32), np.cumsum(sizes)

    @staticmethod
    def _parts(data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bytes without the newlines between texts, and where texts end. One long text comes in parts that end at certain cuts."""
        if hi - lo > 1:
            own = np.ones(at[hi] - at[lo], bool)
            own[at[lo + 1 : hi + 1] - at[lo] - 1] = False
            yield data[at[lo] : at[hi]][own], at[lo + 1 : hi + 1] - at[lo] - np.arange(1, hi - lo + 1)
            return
        i, j = int(at[lo]), int(at[hi]) - 1
        while j - i > STEP:
            near = data[i + STEP - 1 : min(j, i + 2 * STEP)].tobytes()
            m = re.search(rb"[A-Za-z](?= [A-Za-z])", near)
            if not m:
                break
            k = i + STEP - 1 + m.end()
            yield data[i:k], np.array([k - i])
            i = k
        yield data[i:j], np.array([j - i])


@cache
def _encoder(path: str, special_tokens: bool) -> WordEncoder:
    """One a worker process."""
    return WordEncoder(path, special_tokens)


@contextmanager
def task_encoder(path: str, special_tokens: bool = True) -> Iterator[WordEncoder]:
    """The worker's encoder; what a task makes it learn goes with the task."""
    own = _encoder(path, special_tokens)
    try:
        yield own
    finally:
        own.forget()


def write_tokens(documents: DataFrame, out: str, path: str | None = None, end: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True) -> None:
    """Encode every whole text and write the files in ascending id order (null ids first; equal ids by a hash of the text, null first). Null text is empty.

    A special token's string in a text becomes that token's id, as in the library by default; without ``special_tokens`` it is ordinary
    text. Rows are dealt by ranges of the id and a hash of the text, so ranges follow the rows' number, not one key's; other
    columns aren't read.
    """
    path = path or tokenizer_path()
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("tie"))
    n = partitions or max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = docs.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        with task_encoder(path, special_tokens) as encoder:
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    rows = b.slice(lo, ROWS)
                    ids, ends = encoder.batch(rows.column("text"), end)
                    sizes = np.diff(ends, prepend=0)
                    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int32)), tokens], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
                    start += int(ends[-1])

    ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(out)


SCHEMA = "doc_id long, part int, local_start long, n_tokens int, tokens array<int>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens without reading a token: the ranges' totals (a row each) give each range's first place."""
    meta = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return _placed(meta, meta).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of the documents from ``first`` to ``last``: the bounds reach row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    meta = rows.select("part", "n_tokens")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return _placed(rows, meta).select("doc_id", "start", "n_tokens", "tokens")


def _placed(rows: DataFrame, meta: DataFrame) -> DataFrame:
    totals = meta.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("local_start"))  # as many rows as files: bounded


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stage_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)

    def digest(batches):
        for b in batches:
            tokens = b.column("tokens")
            ids, at = tokens.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), tokens.offsets.to_numpy()
            crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, out).select("doc_id", "start", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

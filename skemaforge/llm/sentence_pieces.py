"""SentencePiece ids with the bytes of the original text that each piece stands for, and the way back.

A text is normalised by the model's own rules: at each place the longest key of the compiled character map is replaced, and every
byte of the result keeps the place in the original where it came from. White space becomes U+2581, in front as well where the
model says so. The result is cut between characters that no piece of the model has side by side, so that a text's ids are those
of its cuts; the library merges each distinct cut once. A piece's bytes, followed back, are its span.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes

#: Bytes of text that are encoded at a time (a longer text is encoded in parts where its model allows it).
STEP = 1 << 20
#: Distinct cuts that a task keeps before it learns afresh.
KEPT = 400_000
MARK = "▁".encode()
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6  # kinds of pieces in a model file
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharMap:
    """The compiled character map: a double-array trie of keys, whose values are places of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        first = self._next(0)
        self.starts = np.array([self.units[first ^ b] & 0x800000FF == b if first ^ b < len(self.units) else False for b in range(256)])

    def _next(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at a place, and its replacement."""
        node, found = self._next(0), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            ends_here, node = self.units[node] >> 8 & 1, self._next(node)
            if ends_here:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found:
            return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]
        return None

    def replace(self, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """The text with every longest key replaced, the place that each byte came from, and the first place that gave none."""
        out, places, done, none = [], [], 0, len(data)
        for i in np.flatnonzero(self.starts[np.frombuffer(data, np.uint8)]).tolist():
            if i < done or not (got := self.longest(data, i)):
                continue
            out += [data[done:i], got[1]]
            places += [np.arange(done, i), np.full(len(got[1]), i)]
            done = i + got[0]
            if not got[1]:
                none = min(none, i)
        out.append(data[done:])
        places.append(np.arange(done, len(data)))
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate(places), none


class PieceEncoder:
    """A BPE model of the sentencepiece library, which merges each distinct cut of normalised text once a task."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        rules = model.normalizer_spec
        kinds = np.array([p.type for p in model.pieces])
        if model.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces or (kinds == USER_DEFINED).any():
            raise ValueError("models with user-defined symbols, or with white space kept or put behind words, aren't supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.charmap = CharMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        texts = [p.piece.encode() for p in model.pieces]
        self.sizes = np.array([1 if k == BYTE else len(t) for k, t in zip(kinds.tolist(), texts)], np.int32)
        self.is_byte, self.unknown = kinds == BYTE, int(np.flatnonzero(kinds == UNKNOWN)[0])
        merged = [t for t, k in zip(texts, kinds.tolist()) if k in (NORMAL, UNUSED)]
        # pairs of bytes at which two characters meet in a piece: no merge spans any other pair
        # (without byte pieces unknown characters side by side are one piece, so then only marks cut)
        self.met = np.full(1 << 16, not model.trainer_spec.byte_fallback)
        for t in merged:
            for x, y in zip(t, t[1:]):
                if y & 0xC0 != 0x80:
                    self.met[x << 8 | y] = True
        self.by_mark = all(MARK not in t.lstrip(MARK) for t in merged)  # and none spans a character and a mark behind it
        table = self.met.reshape(256, 256)
        self.apart = MARK in texts and not table[10].any() and not table[:, 10].any()  # nothing merges with a line end
        rules.Clear()
        rules.name, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces = "identity", False, False, True
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.forget()

    def forget(self) -> None:
        self.kept: dict[bytes, bytes] = {}

    def normalise(self, data: np.ndarray, ends: np.ndarray, first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of the texts that end at ``ends``; the original places where each byte begins and where it ends; the texts' new ends.

        Without ``first`` the texts are later parts of one, and get no mark in front.
        """
        if self.charmap is not None or self.squeeze:
            raw, got, lo = data.tobytes(), [], 0
            for hi in ends.tolist():
                text, back, last = self._one(raw[lo:hi], first)
                got.append((text, back + lo, np.append(back[1:], last)[: len(back)] + lo))
                lo = hi
            out, back, after = (np.concatenate(x) for x in zip(*got)) if got else (data, *[np.empty(0, np.int64)] * 2)
            return out, back, after, np.cumsum([len(x[0]) for x in got], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        full = ends > starts
        space = np.flatnonzero(data == 32)
        copies = np.ones(len(data), np.int64)
        copies[space] = 3
        front = starts[full] if self.prefix and first else starts[:0]
        copies[front] += 3
        sums = np.concatenate(([0], np.cumsum(copies)))
        out, back = np.repeat(data, copies), np.repeat(np.arange(len(data), dtype=np.int32), copies)
        marks = np.concatenate((sums[front], sums[space + 1] - 3))
        for k in range(3):
            out[marks + k] = MARK[k]
        stops = sums[ends]
        after = np.append(back[1:], 0)[: len(back)]
        after[stops[full] - 1] = ends[full]
        return out, back, after, stops

    def _one(self, raw: bytes, first: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Normalised bytes of one text, their places and the place where the last one ends."""
        text, back, front = self.charmap.replace(raw) if self.charmap is not None else (np.frombuffer(raw, np.uint8), np.arange(len(raw)), len(raw))
        space, last = text == 32, len(raw)
        if self.squeeze:
            words = np.flatnonzero(~space)
            front = min(front, int(back[words[0]]) if len(words) else last)  # white space before the first word, or before a gap, is passed over
            if front == last:
                return text[:0], back[:0], 0
            kept = ~(space & np.concatenate(([True], space[:-1]))[: len(text)])
            text, back, space = text[kept], back[kept], space[kept]
        else:
            front = 0
        copies = np.where(space, 3, 1)
        sums = np.cumsum(copies)
        text, back = np.repeat(text, copies), np.repeat(back, copies)
        for k in range(3):
            text[sums[space] - 3 + k] = MARK[k]
        if self.prefix and first and raw:
            text, back = np.concatenate((np.frombuffer(MARK, np.uint8), text)), np.concatenate((np.full(3, front), back))
        if self.squeeze:
            whole = text.tobytes()
            while whole.endswith(MARK):
                whole, last = whole[:-3], int(back[len(whole) - 3])
            text, back = text[: len(whole)], back[: len(whole)]
        return text, back, last

    def _merge(self, cuts: list[bytes]) -> list[bytes]:
        """Ids (32-bit, little-endian) of each cut."""
        if len(self.kept) + len(cuts) > KEPT:
            self.forget()
        new = [c for c in cuts if c not in self.kept]
        if new and self.apart:  # one call for all of them, with line ends between
            ids = self.merger.encode(b"\n".join(new).decode(), return_type="numpy")
            at, size = np.cumsum(self.sizes[ids]), np.array([len(c) for c in new])
            last = np.cumsum(size + 1) - 1
            if not (ids == self.unknown).any():
                blob = ids.astype("<i4").tobytes()
                first, last = (4 * np.searchsorted(at, last - size, "right")).tolist(), (4 * np.searchsorted(at, last) + 4).tolist()
                self.kept.update((c, blob[i:j]) for c, i, j in zip(new, first, last))
                new = []
        for c in new:
            self.kept[c] = self.merger.encode(c.decode(), return_type="numpy").astype("<i4").tobytes()
        return [self.kept[c] for c in cuts]

    def _sizes(self, cut: bytes) -> list[int]:
        """Lengths of a cut's pieces, for cuts with unknown pieces, which ids alone don't give."""
        return [p.end - p.begin for p in self.merger.encode(cut, return_type="proto").pieces]

    def encode(self, data: np.ndarray, ends: np.ndarray, first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends (original places in ``data``) of all texts, and where each text's ids end."""
        text, back, after, stops = self.normalise(data, ends, first)
        if not len(text):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(ends), np.int64)
        starts = np.zeros(len(text), bool)
        starts[np.concatenate(([0], stops[:-1]))[np.diff(stops, prepend=0) > 0]] = True
        starts[1:] |= ~self.met[text[:-1].astype(np.uint16) << 8 | text[1:]] & (text[1:] & 0xC0 != 0x80)
        if self.by_mark and len(text) >= 3:
            mark = np.zeros(len(text), bool)
            mark[:-2] = (text[:-2] == MARK[0]) & (text[1:-1] == MARK[1]) & (text[2:] == MARK[2])
            follows = np.zeros(len(text), bool)
            follows[3:] = mark[:-3]
            starts |= mark & ~follows
        at = np.append(np.flatnonzero(starts), len(text))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
        code, cuts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        merged = self._merge(cuts)
        count = np.array([len(m) // 4 for m in merged], np.int64)
        own = np.frombuffer(b"".join(merged), "<i4")
        from_ = np.cumsum(count) - count
        sizes = self.sizes[own]
        for k in np.unique(np.repeat(np.arange(len(cuts)), count)[own == self.unknown]).tolist():
            sizes[from_[k] : from_[k] + count[k]] = self._sizes(cuts[k])
        n = count[code]
        total = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(from_[code] - total[:-1], n) + np.arange(total[-1])
        ids, piece_ends = own[take], np.cumsum(sizes[take])
        piece_starts = piece_ends - sizes[take]
        begins, finals = back[piece_starts], after[piece_ends - 1]
        if (odd := np.flatnonzero(self.is_byte[ids])).size:  # of a character's bytes only the last has its span
            lead = piece_starts[odd]
            for _ in range(3):
                lead = lead - (text[lead] & 0xC0 == 0x80)
            begins[odd] = back[lead]
            inner = odd[(piece_ends[odd] < len(text)) & (text[np.minimum(piece_ends[odd], len(text) - 1)] & 0xC0 == 0x80)]
            finals[inner] = begins[inner]
        return ids, begins, finals, total[np.searchsorted(at, stops)]

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends, how many ids each text has) of some texts after the others; null is empty. Places count from a text's first byte."""
        data, at = text_bytes(texts)
        lo = 0
        while lo < len(texts):
            hi = lo + 1
            while hi < len(texts) and at[hi + 1] - at[lo] <= STEP:
                hi += 1
            own = np.ones(at[hi] - at[lo], bool)
            own[at[lo + 1 : hi + 1] - at[lo] - 1] = False  # without the newlines between texts
            some, ends = data[at[lo] : at[hi]][own], at[lo + 1 : hi + 1] - at[lo] - np.arange(1, hi - lo + 1)
            if hi - lo == 1:
                got = [(ids, begins + i, finals + i) for i, j in self._parts(some) for ids, begins, finals, _ in [self.encode(some[i:j], np.array([j - i]), i == 0)]]
                ids, begins, finals = (np.concatenate(x) for x in zip(*got))
                yield ids, begins, finals, np.array([len(ids)])
            else:
                ids, begins, finals, stops = self.encode(some, ends)
                n = np.diff(stops, prepend=0)
                base = np.repeat(np.concatenate(([0], ends[:-1])), n)
                yield ids, begins - base, finals - base, n
            lo = hi

    def _parts(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """A long text's parts: they end where a space follows another character, which is a cut whatever stands around."""
        i = 0
        if self.by_mark and self.charmap is None and not self.squeeze:
            while len(data) - i > STEP:
                near = data[i + STEP - 1 : i + 3 * STEP]
                places = np.flatnonzero((near[1:] == 32) & (near[:-1] > 32) & (near[:-1] < 128))
                if not len(places):
                    break
                j = i + STEP + int(places[0])
                yield i, j
                i = j
        yield i, len(data)


@cache
def _encoder(path: str) -> PieceEncoder:
    """One a worker process."""
    return PieceEncoder(path)


def _pieces(path: str) -> Callable:
    """Batches of (doc_id, text) to batches of SCHEMA."""

    def encode(batches):
        own = _encoder(path)
        for b in batches:
            done = 0
            for ids, begins, ends, n in own.batch(b.column("text")):
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(n)), *(pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, begins, ends))], names=["doc_id", "ids", "begins", "ends"])
                done += len(n)
        own.forget()  # what a task makes it learn goes with the task

    return encode


def _texts(path: str) -> Callable:
    """Batches with ``ids`` to the same with ``text`` behind; null ids give a null text."""

    def decode(batches):
        own = _encoder(path).library
        for b in batches:
            ids, at = b.column("ids").flatten().to_numpy(), np.cumsum([0, *pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_pylist()]).tolist()
            texts = [own.decode(ids[i:j].tolist()) if known else None for known, i, j in zip(b.column("ids").is_valid().to_pylist(), at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return decode


def _columns(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (id_col, text_col)]
    return documents.select(quoted[0].cast("long").alias("doc_id"), quoted[1].alias("text"))


def encode(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends of every row: a whole text's ids, and the bytes of the text that each piece stands for.

    Ids and spans are those of the library's ``encode``: the mark put in front stands for no bytes; of the byte pieces of one character
    the last has its span. Null and empty texts have empty lists. Rows with null or repeated ids are rows like others; other
    columns aren't read, whatever they are called. An empty table gives an empty one.
    """
    return _columns(documents, id_col, text_col).mapInArrow(_pieces(path or model_path()), SCHEMA)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row's ``ids``; null ids give a null text, empty ones an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path or model_path()), "doc_id long, ids array<int>, text string").select("doc_id", "text")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, of the spans (pairs of unsigned 32-bit integers) and of the decoded text; encoding and decoding run in one pass of a worker."""
    path = model_path()
    pieces, texts = _pieces(path), _texts(path)

    def digest(batches):
        for b in texts(pieces(batches)):
            at = b.column("ids").offsets.to_numpy()
            ids = b.column("ids").values.to_numpy().tolist()
            spans = np.stack((b.column("begins").values.to_numpy(), b.column("ends").values.to_numpy()), 1).astype("<u4").tobytes()
            bounds = list(zip(at[:-1].tolist(), at[1:].tolist()))
            sha = [hashlib.sha256(",".join(map(str, ids[i:j])).encode()).hexdigest() for i, j in bounds]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in b.column("text").to_pylist()]
            crc = [zlib.crc32(spans[8 * i : 8 * j]) for i, j in bounds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return _columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")

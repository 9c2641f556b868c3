import hashlib
import random
import struct
import zlib

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from skemaforge.llm import sentence_pieces

ODD = [None, "", " ", "  ", "a", " a  b ", "▁", "▁a▁ b", "a ▁b▁", "\x00\x01x中\U0001fabf\U0001f600", "\U0001fabf" * 3, "a\tb\n\n c\r\n", "ﬁ ½ ①", "é ệ が ｶﾞ", "　x　", "x​ y﻿", "中文 été。 naïve.", "q" * 3000, "word " * 2000, " " * 40 + "x" + " " * 17, "x  y", "¨a", "İǅß"]
SIGNS = [*"aZéßЖ \n\t\r'.,!|19 中̣́×²\x00\x1f▁ﬁ½①㎏ｶﾞ　​¨", "  ", " b", "the ", "\U0001f600", "\U0001fabf"]


def model(rule=None, prefix=True, squeeze=False):
    """The public model, with another normalisation where one is named."""
    with open(sentence_pieces.model_path(), "rb") as f:
        m = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if rule:
        m.normalizer_spec.MergeFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = prefix, squeeze, True
    return m.SerializeToString()


def library(proto, text):
    pieces = sentencepiece.SentencePieceProcessor(model_proto=proto).encode((text or "").encode(), return_type="proto").pieces
    return [p.id for p in pieces], [(p.begin, p.end) for p in pieces]


def own(encoder, texts):
    out = []
    for ids, begins, ends, n in encoder.batch(pa.array(texts, pa.string())):
        i = 0
        for k in n.tolist():
            out.append((ids[i : i + k].tolist(), list(zip(begins[i : i + k].tolist(), ends[i : i + k].tolist()))))
            i += k
    return out


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("prefix", "squeeze"), [(True, False), (True, True), (False, False), (False, True)])
@pytest.mark.parametrize("step", [11, 1 << 20])
def test_ids_and_spans_match_the_library(monkeypatch, rule, prefix, squeeze, step):
    monkeypatch.setattr(sentence_pieces, "STEP", step)
    monkeypatch.setattr(sentence_pieces, "KEPT", 300)
    rnd, proto = random.Random(step), model(rule, prefix, squeeze)
    texts = ODD + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
    encoder = sentence_pieces.PieceEncoder(proto=proto)
    for lo in range(0, len(texts), 200):
        some = texts[lo : lo + 200]
        for t, got in zip(some, own(encoder, some), strict=True):
            pieces = processor.encode((t or "").encode(), return_type="proto").pieces
            assert got == ([p.id for p in pieces], [(p.begin, p.end) for p in pieces]), repr(t)


def test_without_byte_pieces():
    m = sentencepiece_model_pb2.ModelProto.FromString(model())
    m.trainer_spec.byte_fallback = False
    for p in m.pieces:
        if p.type == sentence_pieces.BYTE:
            p.type, p.piece = sentence_pieces.UNUSED, f"unused{p.piece}"
    proto = m.SerializeToString()
    texts = ["x \U0001fabf y", "\U0001fabf\U0001fabf", "a\U0001fabfb \U0001fabf \U0001fabf"]
    assert own(sentence_pieces.PieceEncoder(proto=proto), texts) == [library(proto, t) for t in texts]


def test_query_matches_the_library(spark, sf_dir):
    p = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    want = []
    for i, t in sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        pieces = p.encode((t or "").encode(), return_type="proto").pieces
        ids = [x.id for x in pieces]
        assert ids == p.encode(t or "")
        crc = zlib.crc32(b"".join(struct.pack("<II", x.begin, x.end) for x in pieces))
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest(), crc))
    got = sentence_pieces.op11_sentence_pieces(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_frames(spark):
    """Nulls, repeated rows, clashing and dotted names; spans cover each text; texts come back."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (1, "x y"), (1, "x y")]
    df = spark.createDataFrame(rows, "`doc.id` long, `the.text` string").withColumns({"ids": F.lit(1), "doc_id": F.lit("z"), "text": F.lit(2)})
    encoded = sentence_pieces.encode(df, id_col="doc.id", text_col="the.text").collect()
    p = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    assert [(r.doc_id, r.ids) for r in encoded] == [(i, p.encode(t or "")) for i, t in rows]
    for r, (_, t) in zip(encoded, rows):
        assert b"".join((t or "").encode()[i:j] for i, j in zip(r.begins, r.ends)) == (t or "").encode()
    frame = spark.createDataFrame([(i, r.ids) for i, r in enumerate(encoded)] + [(-1, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentence_pieces.decode(frame).collect()} == {i: p.decode(r.ids) for i, r in enumerate(encoded)} | {-1: None}
    assert sentence_pieces.encode(df.limit(0), id_col="doc.id", text_col="the.text").count() == 0


def test_long_text_in_parts():
    text = "one two, three " * 120_000 + "x" * 1000
    p = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    ((ids, spans),) = own(sentence_pieces.PieceEncoder(sentence_pieces.model_path()), [text])
    assert ids == p.encode(text) and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skemaforge.llm import token_ids

ODD = [None, "", " ", "a", " a ", "x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "x<|endoftext", "don't 'tis 's're ''s x'S", "a\u00a0 b \u00a0\u00a0c\u3000 d", "\u00d7\u00f7 3\u00d74 \u00aa1\u00b2", "\u0416\u0438 \u0482\u0301x e\u0301 a\u0301", "a  b\n\n c\t d", "x,y. z|w", "it's we'll", "<|endoftext|> a", "1234 12,5 a1.b2", "中文 été。 naïve.", "a\r\nb\n", "\U0001f600 ok.\nNext|line, end.", "..., ,,, a.. b||", "q" * 30000, "word " * 20000, "\x00 \x1f  x y"]


def library(end, special_tokens=True):
    t = Tokenizer.from_file(token_ids.tokenizer_path())
    if not special_tokens:
        t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_matches_the_library(spark, sf_dir):
    encode, start, want = library(2), 0, []
    for i, t in sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        ids = encode(t)
        want.append((i, start, len(ids), digest(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_ids.op2_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_round_trip_and_selective_reads(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tokens": F.lit("x"), "start": F.lit(1)})
    out, encode = f"file://{tmp_path}/tokens", library(2)
    token_ids.write_tokens(df.repartition(3), out, partitions=4)
    got = token_ids.read_tokens(spark, out).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = encode(t)
        assert (r.doc_id, r.start, r.n_tokens, r.tokens) == (i, start, len(ids), ids)
        start += len(ids)
    some = token_ids.read_tokens(spark, out, 5, 9)
    assert [(r.doc_id, r.start, r.tokens) for r in some.orderBy("doc_id").collect()] == [(r.doc_id, r.start, r.tokens) for r in got[5:10]]
    meta = token_ids.read_metadata(spark, out)
    assert sorted(map(tuple, meta.collect())) == [(r.doc_id, r.start, r.n_tokens) for r in got]
    assert "tokens" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0].replace("n_tokens", "")
    file = next(f for f in sorted(tmp_path.glob("tokens/*.parquet")) if pq.read_metadata(f).num_rows)
    columns = [pq.read_metadata(file).row_group(0).column(k) for k in range(5)]
    assert all(c.has_offset_index and c.has_column_index for c in columns[:4])
    assert any("DICTIONARY" in e for e in columns[4].encodings)


@pytest.mark.parametrize("special_tokens", [True, False])
@pytest.mark.parametrize("step", [7, 60, 1 << 20])
def test_encoder_matches_the_library(monkeypatch, step, special_tokens):
    monkeypatch.setattr(token_ids, "STEP", step)
    rnd = random.Random(step)
    signs = [*"aZ\u00e9\u00df\u0416 \n\t\r'.,!|<>19\u00a0\u4e2d\u0301\u00d7\u00b2\x00\x1f", "  ", " b", "'s", "'ll", "<|endoftext|>", "end of text ", "\U0001f600"]
    texts = ODD[:-4] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    encode, own = library(7, special_tokens), token_ids.WordEncoder(token_ids.tokenizer_path(), special_tokens)
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        ids, ends = own.batch(pa.array(some), 7)
        assert [ids[i:j].tolist() for i, j in zip([0, *ends], ends)] == [encode(t) for t in some]


def test_encoder_survives_equal_hashes_and_forgets(monkeypatch):
    encode, texts = library(7), ["one two three", "three two one two", "", "four"]
    monkeypatch.setattr(token_ids, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    own = token_ids.WordEncoder(token_ids.tokenizer_path())
    ids, ends = own.batch(pa.array(texts), 7)
    assert [ids[i:j].tolist() for i, j in zip([0, *ends], ends)] == [encode(t) for t in texts]
    monkeypatch.undo()
    monkeypatch.setattr(token_ids, "CACHE_BYTES", 50)
    with token_ids.task_encoder(token_ids.tokenizer_path()) as own:
        for _ in range(3):
            ids, ends = own.batch(pa.array(texts), 7)
            assert [ids[i:j].tolist() for i, j in zip([0, *ends], ends)] == [encode(t) for t in texts]
    assert not len(own.keys) and not len(own.pieces)


def test_other_kinds_of_tokenizer_encode_whole_texts():
    path = token_ids.tokenizer_path("word_bpe_49k.json")
    own, library = token_ids.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["One  Two\nthree", None, "<|startoftext|> x"]
    ids, ends = own.batch(pa.array(texts), 3)
    assert not own.plain
    assert [ids[i:j].tolist() for i, j in zip([0, *ends], ends)] == [[*library.encode(t or "", add_special_tokens=False).ids, 3] for t in texts]


def test_special_tokens_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "x <|endoftext|> y")], "doc_id long, text string")
    token_ids.write_tokens(df, f"file://{tmp_path}/a", special_tokens=False)
    assert token_ids.read_tokens(spark, f"file://{tmp_path}/a").first().tokens == library(2, False)("x <|endoftext|> y")


def test_empty_table_repeated_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    token_ids.write_tokens(df, f"file://{tmp_path}/a")
    assert [r.n_tokens for r in token_ids.read_tokens(spark, f"file://{tmp_path}/a").orderBy("start").collect()] == [1, 2, 2, 2]
    token_ids.write_tokens(df.limit(0), f"file://{tmp_path}/b")
    assert token_ids.read_tokens(spark, f"file://{tmp_path}/b").count() == 0

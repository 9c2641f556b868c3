import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skemaforge.llm import packing
from skemaforge.llm.token_ids import tokenizer_path


def library(end):
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


def checked(found, texts, capacity):
    """Every id lies in one place; sequences are gapless. Returns the sequences' fills."""
    encode, pieces, bins = library(0), defaultdict(list), defaultdict(list)
    for r in found.collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = encode(text), 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(pieces[i]) == 1)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return [sum(r.length for r in own) for own in bins.values()]


def fewest(fills, capacity):
    return -(-sum(fills) // capacity)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fills = checked(packing.op8_best_fit_packing(spark, sf_dir), texts, 2048)
    assert len(fills) <= fewest(fills, 2048) + 1


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_tree_of_partitions(spark, parts):
    rnd = random.Random(parts)
    texts = {i: "word " * rnd.choice([rnd.randint(0, 30), rnd.randint(20, 60), rnd.randint(60, 300)]) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    fills = checked(packing.pack(df, capacity=64), texts, 64)
    assert len(fills) <= 1.03 * fewest(fills, 64) + 1


def test_best_fit_matches_a_plain_one():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 101, 500)
    bins, offsets, fill = packing.best_fit(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - sizes[i])
        else:
            room.append(100 - sizes[i])
    assert sorted(100 - np.array(room)) == sorted(fill)
    assert all(sizes[bins == b].sum() == fill[b] for b in range(len(fill)))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 9000), (4, "a" * 20000), (5, "x <|endoftext|> y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bin": F.lit(1), "used": F.lit("x"), "piece": F.lit(2), "node": F.lit(3)})
    checked(packing.pack(df), dict(rows), 2048)
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and sorted(r.offset for r in twice) == [0, 2, 4] or sorted(r.offset for r in twice) == [0, 2, 5] or sorted(r.offset for r in twice) == [0, 3, 6]

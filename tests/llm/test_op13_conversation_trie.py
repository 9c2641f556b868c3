import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """{conv_id: [(role, text)]} of (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [x[3] for x in sorted(t)] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
    ends = {k: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def by_sql(path):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    return sorted(c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({conversation_trie.SQL})").fetchall())


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    got = result(conversation_trie.op13_conversation_trie(spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == by_sql(f"{sf_dir}/conversations.parquet") == brute(rebuilt(ordered(rows)))


def odd_rows(seed):
    """Nulls, ties, repeated rows, shared beginnings, copies, a long conversation, absent bases, negative ids."""
    rnd, rows = random.Random(seed), [(None, 1, "user", "lost")]
    for c in [*range(0, 70, 1 + seed), 100, 101, 103, -1, -40, -39]:
        n = rnd.choice([0, 1, 1, 2, 3, 5, 8])
        for t in range(n):
            rows.append((c, rnd.choice([None, t, t, t // 2]), rnd.choice([None, "", "user"]), rnd.choice([None, "", "a b", " c ", "d\te f"])))
    rows += [(7, 3, "user", "same")] * 5 + [(200, i, "user", f"long {i % 7}") for i in range(30)] + [(201, i, "user", f"long {i % 7}") for i in range(25)]
    rows += [(c, i, "user", f"hot {i}") for c in range(300, 330) for i in range(3 + c % 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_odd_rows_match_sql_and_brute_force(spark, monkeypatch, tmp_path, seed):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    monkeypatch.setattr(conversation_trie, "PIECE", 4)
    monkeypatch.setattr(conversation_trie, "HOT", 5)
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("pos", "depth", "prefix", "owner", "a.b")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(rebuilt(ordered(rows)))
    assert result(conversation_trie.op13_conversation_trie(spark, str(tmp_path))) == want
    assert by_sql(f"{tmp_path}/conversations.parquet/*.parquet") == want
    assert result(conversation_trie.prefix_trie(df)) == brute(ordered(rows))


def test_chain_of_chains(spark):
    """Each conversation branches off the one before, one turn deeper; and the other way round."""
    for n, down in ((40, False), (40, True)):
        rows = []
        for c in range(n):
            k = n - 1 - c if down else c
            rows += [(c, t, "r", f"t {t}") for t in range(k)] + [(c, k, "r", f"end {k}")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert result(conversation_trie.prefix_trie(df)) == brute(ordered(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(df).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "r", "t")], df.schema)).count() == 0

import duckdb
import pytest
from pyspark.sql import functions as F

from skemaforge.llm import url_filter

SCHEMA = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "nope", "http://", "HTTP://A.Example.COM/en/7?x", "https://example.com/en/71#f", "ftp://com/en/", "http://example.com?q=/en/", "x://y://example.net/de/8", "http://a.b.example.net/de/81/x", "http://notexample.net/de/8", "http://org/es/\n?", "http://xorg/es/", "://org/es/", "http://\u00c4.org/es/", "http://h/" + "p" * 50000, "http://" + "s." * 300 + "org/es/"]


def test_query_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = sorted(map(tuple, url_filter.op6_url_filter(spark, sf_dir).collect()), key=str)
    assert got == sorted(c.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.SQL})").fetchall(), key=str)
    assert {r[-1] for r in got} == {"allow", "block"}


@pytest.mark.parametrize("most", [64 << 20, 40])
def test_odd_rows(spark, most):
    rules = [*url_filter.RULES, ("b.example.net", "", "block"), ("example.com", "", "block"), ("h", "/ppp", "block")]
    table = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("", "/", "block"), ("net", "/x", None)], SCHEMA)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2), "rule_length": F.lit(3), "RULE_found": F.lit(4), "slice": F.lit(5)})
    got = url_filter.judge_urls(pages, table, max_bytes=most).collect()
    assert {(r.rule_length, r.RULE_found, r.slice) for r in got} == {(3, 4, 5)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u, rules) for i, u in enumerate(URLS * 2)}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    path = str(tmp_path / "digests")
    entries = [(f"host{i}/{'x' * (i % 5)}", i % 2) for i in range(40)]
    url_filter.write_digest_array(path, entries)
    array = url_filter.DigestArray(path)
    assert array.probe([k for k, _ in entries]).tolist() == [v for _, v in entries]
    assert array.probe(["absent/", "host1/xx", ""]).tolist() == [-1, -1, -1]


def test_very_long_hosts_and_rules(spark):
    long = "l" * 600_000
    rules = [("h", "/" + long, "block"), ("a." * 3000 + "org", "", "block"), ("org", "/" + "y" * 100, "allow")]
    urls = [f"http://h/{long}z", f"http://x.{'a.' * 3000}org/{'y' * 200}", f"http://b.org/{'y' * 200}"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, SCHEMA)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [plain(u, rules) for u in urls]


def test_odd_column_names(spark):
    df = spark.createDataFrame([("http://a.example.com/en/1", 1)], "`u.rl` string, `c``d` int")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(df, rules, url="u.rl")
    assert got.columns[:2] == ["u.rl", "c`d"] and got.first().verdict == "block"

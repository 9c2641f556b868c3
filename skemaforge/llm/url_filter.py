"""URL filter by a sorted digest array.

A rule is a host and a path prefix. The rules' 64-bit xxhash digests stand sorted in one file, beside
the full strings; Spark sends the file to each executor, whose Python workers map it into memory, probe it
by vectorised binary search, and confirm each hit against the stored string, so that a collision of digests
never decides. A list beyond ``max_bytes`` is cut into digest ranges, each its own bounded file and probe.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, named, numbered_names, stage_path, unused

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Between host and path in a key: no host has a slash.
SEP = "/"
#: Fixed values of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def write_digest_array(path: str, entries: list[tuple[str, int]]) -> None:
    """entries: (full string, verdict number). Equal digests stay side by side, each with its own string."""
    rows = sorted((xxhash.xxh64_intdigest(k), k.encode(), v) for k, v in entries)
    ends = np.cumsum([0, *(len(k) for _, k, _ in rows)], dtype=np.uint64)
    with open(path, "wb") as f:
        f.write(np.array([len(rows)], np.uint64).tobytes())
        f.write(np.array([r[0] for r in rows], np.uint64).tobytes())
        f.write(ends.tobytes())
        f.write(np.array([r[2] for r in rows], np.uint8).tobytes())
        f.write(b"".join(r[1] for r in rows))


class DigestArray:
    """A digest array mapped from its file; nothing is read before it is probed."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.uint64)[0])
        at = 8 + 8 * n
        self.keys, self.ends = raw[8:at].view(np.uint64), raw[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.values, self.blob = raw[at : at + n], raw[at + n :]

    def probe(self, strings: list[str]) -> np.ndarray:
        """The value of each string, or -1."""
        out = np.full(len(strings), -1, np.int16)
        if not len(self.keys) or not strings:
            return out
        digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        at = np.searchsorted(self.keys, digests, "left")
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            k, want = int(at[i]), strings[i].encode()
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.blob[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == want:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: native, null or no ``://`` gives two empty strings."""
    u = F.coalesce(named(url), F.lit(""))
    return df.withColumns({"host": ascii_lower(F.regexp_extract(u, URL, 1)), "path": F.regexp_extract(u, URL, 2)})


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_bytes: int = 64 << 20) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; columns of these names are replaced.

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path starts with its path;
    the longest host + path wins (of equal length the longer host). A rule given twice counts once, ``allow`` before
    ``block``; rules with a null or an empty host are void. No rule: null and ``default``. Null or malformed urls have an
    empty host and path and so no rule. Empty tables give empty results.
    """
    spark = pages.sparkSession
    clean = rules.where("host is not null and host <> '' and verdict is not null").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    shape = clean.agg(F.coalesce(F.sum(F.octet_length(F.concat("host", "path")) + 24), F.lit(0)).alias("bytes"), F.collect_set(F.length("path")).alias("lengths"), F.sort_array(F.collect_set("verdict")).alias("verdicts")).first()
    slices = max(1, -(-shape["bytes"] // max_bytes))
    out = split_url(pages, url).drop("rule", "verdict")
    names = out.columns
    found = unused(out, "rule_length", "rule_host_length", "rule_found", "rule_verdict")
    out = out.withColumns(dict(zip(found, (F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string")))))
    cut = clean.withColumn("slice", F.pmod(F.xxhash64("host", "path"), F.lit(slices)))
    for k in range(slices):  # one slice holds a bounded part of the list
        out = _probe(spark, out, cut.where(F.col("slice") == k), found, sorted(shape["lengths"]), list(shape["verdicts"]))
    return out.select(*map(named, names), F.col(found[2]).alias("rule"), F.coalesce(found[3], F.lit(default)).alias("verdict"))


def _probe(spark: SparkSession, df: DataFrame, rules: DataFrame, found: list[str], lengths: list[int], verdicts: list[str]) -> DataFrame:
    """The columns ``found`` (length of the best rule, of its host, the rule, its verdict) brought up to date by a slice of the rules."""
    shared = f"{stage_path(spark, 'digests')}.bin"
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(folder, "digests")
        write_digest_array(file, [(r["host"] + SEP + r["path"], verdicts.index(r["verdict"])) for r in rules.collect()])
        path = spark._jvm.org.apache.hadoop.fs.Path
        path(shared).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(path(f"file://{file}"), path(shared))
    spark.sparkContext.addFile(shared)  # Spark takes it to each executor, also to one that replaces a lost one
    name, plain, at = os.path.basename(shared), numbered_names(df), {c: i for i, c in enumerate(df.columns)}

    def best(batches):
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            hosts, paths = b.column(at["host"]).to_pylist(), b.column(at["path"]).to_pylist()
            keys, of, size = [], [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                while h:
                    for n in lengths:
                        if n <= len(p):
                            keys.append(h + SEP + p[:n])
                            of.append(i)
                            size.append((len(h) + n, len(h)))
                    h = h.partition(".")[2]
            hit = array.probe(keys)
            now = [list(x) for x in zip(*(b.column(at[c]).to_pylist() for c in found))]
            for j in np.flatnonzero(hit >= 0).tolist():
                if size[j] > tuple(now[of[j]][:2]):
                    now[of[j]] = [*size[j], keys[j].replace(SEP, "", 1), verdicts[hit[j]]]
            new = dict(zip((at[c] for c in found), (pa.array([x[i] for x in now], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))))
            yield pa.RecordBatch.from_arrays([new.get(i, c) for i, c in enumerate(b.columns)], names=b.schema.names)

    return plain.mapInArrow(best, plain.schema).toDF(*df.columns)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")]))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'),
       ('net','/de/','allow'), ('example.net','/de/8','block'), ('org','/es/','block')),
p AS (SELECT page_id,
        translate(regexp_extract(coalesce(url,''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url,''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT page_id, rhost || rpath AS rule, rverdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rverdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""

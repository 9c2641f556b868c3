"""Site-relative line frequency: drop the lines that too many of a site's pages hold. DataFrame functions only.

A page counts once for each of its distinct lines (white space at the ends aside), so the shuffle carries a digest and a
partial count for each host and line, never a text. A flagged line is in more than ``ratio`` of its host's pages, so a host has
at most its mean number of lines a page over ``ratio`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, named, staged, unused

#: A template often serves one section of a site only, so a line on few in a hundred pages of a large host is boilerplate already;
#: that unrelated pages share an own sentence that often isn't chance. One in a hundred leaves a margin to both.
RATIO = 0.01
#: A line must be shared at all. Two pages with a line in common may be one page and its copy: 3 asks for a third page first.
MIN_PAGES = 2
#: Flagged digests (16 bytes each) up to which they are broadcast: 8 MB; beyond, a join by page.
BROADCAST_LINES = 500_000


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with each text's boilerplate lines gone; other lines stay as they are and in order. Same rows and columns.

    Boilerplate: a non-blank line which at least ``min_pages`` and more than ``ratio`` of the host's pages hold. All pages of
    the host count, also those with a null text. A null text stays null; a text of boilerplate alone becomes empty; a null host is
    a host of its own. Repeated rows count each. Empty tables give empty results.
    """
    lines = F.split(named(text), "\n")
    h = F.coalesce(F.concat(F.lit("h"), named(host).cast("string")), F.lit(""))
    digests = F.array_distinct(F.transform(F.filter(lines, lambda x: _trimmed(x) != ""), lambda x: _digest(_trimmed(x))))
    # the empty digest stands for the page itself, so one aggregation counts lines and pages
    seen = pages.select(h.alias("host"), F.explode(F.concat(F.array(F.unhex(F.lit(""))), F.coalesce(digests, F.array().cast("array<binary>")))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | (F.octet_length("line") == 0))
    counts = staged(counts, "line-counts")
    totals = counts.where(F.octet_length("line") == 0).select("host", F.col("n").alias("pages"))
    if totals.count() <= broadcast_lines:  # a row a host: then a large host's lines aren't gathered for the join
        totals = F.broadcast(totals)
    flagged = counts.where(F.octet_length("line") > 0).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    flagged = staged(flagged.select("host", "line"), "boilerplate")
    drop_staged(pages.sparkSession, counts)
    own_host, row, gone = unused(pages, "own_host", "own_row", "gone_lines")
    dropped = F.col(gone)
    kept = F.array_join(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(dropped, _digest(_trimmed(x))), F.lit(False))), "\n")
    clean = F.when(dropped.isNull(), named(text)).otherwise(kept).alias(text)
    out = [clean if c == text else named(c) for c in pages.columns]
    if flagged.count() <= broadcast_lines:
        listed = flagged.groupBy(F.col("host").alias(own_host)).agg(F.collect_list("line").alias(gone))
        return pages.withColumn(own_host, h).join(F.broadcast(listed), own_host, "left").select(*out)
    # too many for a broadcast: hand each page the flagged lines it holds, joined by host and line
    keyed = staged(pages.withColumn(own_host, h).withColumn(row, F.monotonically_increasing_id()), "pages")
    own = keyed.select(F.col(row).alias("row"), F.col(own_host).alias("host"), F.explode(digests).alias("line")).join(flagged, ["host", "line"], "left_semi")
    listed = own.groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(gone))
    return keyed.join(listed, row, "left").select(*out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs)


SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
n AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM t WHERE k <> '' GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
bad AS (SELECT n.source, n.k FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n.n >= {MIN_PAGES} AND n.n > {RATIO} * p.pages),
kept AS (SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.pos) AS text FROM t LEFT JOIN bad ON t.source IS NOT DISTINCT FROM bad.source AND t.k = bad.k
         WHERE bad.k IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept USING (doc_id)
"""

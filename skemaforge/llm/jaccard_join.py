"""Jaccard similarity join of word n-gram sets by vertical partitioning, and its connected components.

A document's set is that of its distinct n-word shingles, as 64-bit hashes. The global order of shingles is
(hot, hash), where a shingle is hot if more than a bound of documents have it among their first ones: any fixed order is right
for prefix filtering, and this one keeps frequent passages out of prefixes.

1. Documents of equal sets are one class; the smallest id stands for it. All that follows is between classes.
2. Linked documents share a shingle of their prefixes (the first n - ceil(t n) + 1 in the global order). Of each list of documents
   with a prefix shingle, only lists of two or more matter. Documents with too few shingles that aren't hot (members of large
   families of copies) are crowded: their whole sets are taken. Between two crowded documents, a shingle that only one crowded document has can't be common, so
   each keeps the rest of its set, in order of frequency among the crowded, and a prefix that is as much shorter; a document that is left with
   too little links with none of them.
3. Lists are not expanded into pairs. Each member is first compared with one leader (a member of the most
   widely shared shingles), then with all its lists' leaders, each time leaving out what is already connected. Only pairs of
   different components that remain are compared each, so no link between components is lost and a group of copies costs a
   comparison a member.
4. A pair is compared fragment by fragment: the order is cut into fragments, the overlap within each is counted
   separately, and the counts are summed a pair. The first fragment's overlap bounds the sum and drops most false pairs early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, scratch, staged, text_bytes, without_ids, word_hashes

SHINGLE = 4
PERCENT = 85
FRAGMENTS = 8
#: Documents with a shingle among their first ones above which it is hot, and the most hot shingles there may be (8 bytes each are broadcast).
HOT = 50
HOT_SHINGLES = 1_000_000
#: Rows of a table of ids up to which it is broadcast (8 MB).
BROADCAST_ROWS = 1_000_000

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each text; a text of fewer words, but not none, has its whole sequence as one."""
    data, at = text_bytes(texts)
    h, starts = word_hashes(data)
    ends = np.searchsorted(starts, at)
    with np.errstate(over="ignore"):
        m = max(0, len(h) - size + 1)
        mixed = np.full(m, size, np.uint64)
        for k in range(size):
            mixed += mix(h[k : k + m] * _PLACES[k] + np.uint64(k))
        mixed = mix(mixed)
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if j - i >= size:
                yield np.unique(mixed[i : j - size + 1])
            elif j > i:
                short = np.full(1, j - i, np.uint64)
                for k in range(j - i):
                    short += mix(h[i + k : i + k + 1] * _PLACES[k] + np.uint64(k))
                yield mix(short)
            else:
                yield np.empty(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def pool_size(n: int, percent: int) -> int:
    """Of so many smallest hashes a document's list is kept: its prefix and room for hot ones."""
    return min(n, prefix_size(n, percent) * 8 // 5 + 16)


def in_order(hashes: np.ndarray, n: int, hot: np.ndarray, percent: int, whole: bool = False) -> np.ndarray | None:
    """A document's prefix from its smallest hashes, or None if they hold too few that aren't hot; of a whole set, those that aren't hot."""
    p = prefix_size(n, percent)
    if len(hot) and len(hashes):
        hashes = hashes[hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes]
        if len(hashes) < p and not whole:
            return None
    return hashes[:p]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, sig (128 bits of the whole set), pool (the smallest hashes)."""

    def rows(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, sig, pool = [], [], []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(part.column("text"), size):
                        n.append(len(s))
                        sig.append(np.array([mix(s + np.uint64(1)).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes())
                        pool.append(s[: pool_size(len(s), percent)].tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(pool, pa.binary())], names=["doc_id", "n", "sig", "pool"])

    return docs.mapInArrow(rows, "doc_id long, n long, sig binary, pool binary")


def _listed(df: DataFrame, hot: np.ndarray | None, percent: int) -> DataFrame:
    """s, doc, rank, n: a row for each hash of the pool (hot None) or of the prefix; a document whose pool doesn't determine its prefix has one row with rank -1."""
    shared = df.sparkSession.sparkContext.broadcast(hot) if hot is not None else None

    def rows(batches):
        for b in batches:
            s, doc, rank, size = [], [], [], []
            for d, n, pool in zip(b.column("doc").to_pylist(), b.column("n").to_pylist(), b.column("pool")):
                own = np.frombuffer(pool.as_buffer(), np.uint64)
                if shared is not None:
                    own = in_order(own, n, shared.value, percent)
                got = np.zeros(1, np.uint64) if own is None else own
                s.append(got.view(np.int64))
                doc.append(np.full(len(got), d, np.int64))
                rank.append(np.full(1, -1, np.int32) if own is None else np.arange(len(got), dtype=np.int32))
                size.append(np.full(len(got), n, np.int64))
            for lo in range(0, len(s), 512):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[lo : lo + 512])) for x in (s, doc, rank, size)], names=["s", "doc", "rank", "n"])

    return df.mapInArrow(rows, "s long, doc long, rank int, n long")


def _whole_sets(docs: DataFrame, ids: DataFrame, size: int, fragments: int) -> DataFrame:
    """doc, fragment, hashes (array of long) of the documents in ``ids`` (doc): fragments cut the hash order evenly."""
    texts = docs.join(_small(ids), F.col("doc_id") == F.col("doc"), "left_semi")

    def rows(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                doc, fragment, sets = [], [], []
                for d, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), size)):
                    of = ((s >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                    cuts = np.searchsorted(of, np.arange(fragments + 1))
                    for f in range(fragments):
                        if cuts[f + 1] > cuts[f]:
                            doc.append(d)
                            fragment.append(f)
                            sets.append(s[cuts[f] : cuts[f + 1]].view(np.int64))
                at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(fragment, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc", "fragment", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(rows, "doc long, fragment int, hashes array<long>")


def _fragment_bound(pairs: DataFrame, pools: DataFrame, percent: int) -> DataFrame:
    """The pairs that the order's first fragment (up to the smaller pool's end) doesn't rule out."""
    a = pools.select(F.col("doc").alias("a"), F.col("pool").alias("pa"))
    b = pools.select(F.col("doc").alias("b"), F.col("pool").alias("pb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "pa", "pb")

    def rows(batches):
        for t in batches:
            keep = []
            for na, nb, x, y in zip(t.column("na").to_pylist(), t.column("nb").to_pylist(), t.column("pa"), t.column("pb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ends = [v[-1] for v, n in ((x, na), (y, nb)) if len(v) < n]
                if ends:
                    x, y = x[: np.searchsorted(x, min(ends), "right")], y[: np.searchsorted(y, min(ends), "right")]
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(na - len(x), nb - len(y))
                keep.append((100 + percent) * most >= percent * (na + nb))
            t = t.filter(pa.array(keep, pa.bool_()))
            yield t.select(["a", "b", "na", "nb"])

    return both.mapInArrow(rows, "a long, b long, na long, nb long")


def linked(pairs: DataFrame, docs: DataFrame, pools: DataFrame, size: int, percent: int, fragments: int) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) whose sets link: 100 * intersection >= percent * union."""
    long_enough = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    with scratch(docs.sparkSession) as keep:
        left = staged(_fragment_bound(pairs.where(long_enough), pools, percent), "candidates")
        ids = staged(left.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "candidate-ids")
        sets = staged(_whole_sets(docs, ids, size, fragments), "fragments")
        x = sets.select(F.col("doc").alias("a"), "fragment", F.col("hashes").alias("ha"))
        y = sets.select(F.col("doc").alias("b"), "fragment", F.col("hashes").alias("hb"))
        partial = left.join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("common"))
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return keep(staged(summed.where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "links"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """doc, comp (the smallest id reachable) of every id in ``links``: labels spread over links and jump to their label's label until none changes."""
    both = staged(links.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(links.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct(), "graph")
    labels = staged(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("comp")).select(F.col("src").alias("doc"), "comp"), "labels")
    while True:
        heard = both.join(labels, F.col("dst") == F.col("doc")).groupBy("src").agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, F.col("doc") == F.col("src"), "left").select("doc", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("doc").alias("via"), F.col("comp").alias("further"))
        new = staged(nearer.join(jump, F.col("comp") == F.col("via"), "left").select("doc", "old", F.least("comp", "further").alias("comp")), "labels")
        labels = new.select("doc", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def join_components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. Null, empty and wordless texts have no shingles and
    link with nothing, so their component is their own id. Ids identify documents: repeated rows give equal rows. A row without
    an id has component null. Empty tables give empty results; other columns aren't read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = staged(signatures(docs, size, percent), "signatures")
    if not sigs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id"])  # whole sets are read again by id: each once, or overlaps count several times
    classes = staged(sigs.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.min_by("pool", "doc_id").alias("pool"), F.min("doc_id").alias("doc")), "classes")
    pools = classes.select("doc", "n", "pool")

    counts = _listed(pools, None, percent).groupBy("s").agg(F.count("*").alias("docs")).where(F.col("docs") > hot)
    counts = staged(counts, "hot")
    while counts.where(F.col("docs") > hot).count() > HOT_SHINGLES:  # the order may be any: keep what is broadcast bounded
        hot *= 2
    hot_list = np.sort(np.array([r["s"] for r in counts.where(F.col("docs") > hot).select("s").collect()], np.int64).view(np.uint64))

    first = staged(_listed(pools, hot_list, percent), "prefixes")
    crowded = staged(first.where("rank < 0").select("doc").distinct(), "crowded")
    sizes = pools.select(F.col("doc").alias("d"), "n")
    full = _whole_sets(docs, crowded, size, 1).dropDuplicates(["doc"]).join(sizes, F.col("doc") == F.col("d")).select("doc", "n", F.col("hashes").alias("pool"))
    full = staged(full, "crowded-sets")
    # part 0: pairs with a document that isn't crowded; part 1: pairs of crowded ones
    prefixes = first.where("rank >= 0").withColumn("crowded", F.lit(False)).unionByName(_prefix_of_arrays(full, hot_list, percent).withColumn("crowded", F.lit(True)))
    prefixes = prefixes.select(F.lit(0).alias("part"), "s", "doc", "rank", "n", F.col("n").alias("usable"), "crowded")
    prefixes = prefixes.unionByName(_crowded_prefixes(full, percent).withColumn("crowded", F.lit(False)))
    shared = prefixes.groupBy("part", "s").agg(F.count("*").alias("docs"), F.count_if(~F.col("crowded")).alias("free")).where("docs > 1 and free > 0")
    lists = staged(prefixes.join(shared, ["part", "s"]).select("part", "s", "doc", "rank", "n", "usable", "crowded"), "lists")

    standing = lists.groupBy("doc").agg((F.max(F.col("part") * F.col("usable")) / F.first("n") + F.count("*") / F.first("n")).alias("score"))
    ranked = lists.join(standing, "doc")
    leaders = ranked.groupBy("part", "s").agg(F.max(F.struct("score", (-F.col("doc")).alias("minus"), "n")).alias("lead"))
    leaders = leaders.select("part", "s", (-F.col("lead.minus")).alias("leader"), F.col("lead.n").alias("nl"), F.col("lead.score").alias("lscore"))
    led = staged(lists.join(leaders, ["part", "s"]).where("doc <> leader").groupBy("doc", "n", "leader", "nl", "lscore").agg(F.count("*").alias("common")), "led")
    best = led.groupBy("doc", "n").agg(F.max(F.struct("lscore", "common", (-F.col("leader")).alias("minus"), "nl")).alias("x"))
    pair = lambda df, a, b, na, nb: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col(a) < F.col(b), F.col(na)).otherwise(F.col(nb)).alias("na"), F.when(F.col(a) < F.col(b), F.col(nb)).otherwise(F.col(na)).alias("nb")).distinct()
    pairs = pair(best.select("doc", "n", (-F.col("x.minus")).alias("leader"), F.col("x.nl").alias("nl")), "doc", "leader", "n", "nl")
    links = linked(pairs, docs, pools, size, percent, fragments)

    def apart(df: DataFrame, a: str, b: str, comp: DataFrame) -> DataFrame:
        ca, cb = comp.select(F.col("doc").alias("_a"), F.col("comp").alias("_ca")), comp.select(F.col("doc").alias("_b"), F.col("comp").alias("_cb"))
        df = df.join(ca, F.col(a) == F.col("_a"), "left").join(cb, F.col(b) == F.col("_b"), "left")
        return df.where(F.coalesce("_ca", a) != F.coalesce("_cb", b)).drop("_a", "_ca", "_b", "_cb")

    comp = components(links)
    pairs = pair(apart(led, "doc", "leader", comp), "doc", "leader", "n", "nl")
    links = links.unionByName(linked(pairs, docs, pools, size, percent, fragments))
    comp = components(links)

    labelled = lists.join(comp, "doc", "left").select("part", "s", "doc", "rank", "n", "usable", "crowded", F.coalesce("comp", "doc").alias("comp"))
    mixed_lists = labelled.groupBy("part", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("part", "s")
    open_rows = staged(labelled.join(mixed_lists, ["part", "s"], "left_semi"), "open")
    side = lambda k: open_rows.select("part", "s", F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("comp").alias(f"c{k}"), (F.col("usable") - F.col("rank")).alias(f"r{k}"), F.col("crowded").alias(f"x{k}"))
    # a linked pair's first common shingle leaves room for the rest of the overlap (positional filter)
    room = (100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & room
    rest = side("a").join(side("b"), ["part", "s"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~(F.col("xa") & F.col("xb")) & near).select("a", "b", "na", "nb").distinct()
    tried = pair(led, "doc", "leader", "n", "nl").select("a", "b")
    more = linked(rest.join(tried, ["a", "b"], "left_anti"), docs, pools, size, percent, fragments)
    comp = components(links.unionByName(more))

    final = classes.join(comp, "doc", "left").select("sig", F.col("n").alias("_n"), F.coalesce("comp", "doc").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    out = out.join(final, (out["sig"] == final["sig"]) & (F.col("n_shingles") == F.col("_n")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _crowded_prefixes(full: DataFrame, percent: int) -> DataFrame:
    """The crowded documents' lists among themselves (part 1), from whole sets (doc, n, pool)."""
    rows = full.select("doc", "n", F.explode("pool").alias("s"))
    common = rows.join(rows.groupBy("s").agg(F.count("*").alias("docs")).where("docs > 1"), "s")
    own = Window.partitionBy("doc")
    placed = common.withColumn("usable", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("docs", "s")) - 1)
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    return placed.where(F.col("rank") < F.col("usable") - need + 1).select(F.lit(1).alias("part"), "s", "doc", "rank", "n", "usable")


def _prefix_of_arrays(df: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """As ``_listed``, from whole sets as arrays: what isn't hot."""
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def rows(batches):
        for b in batches:
            flat, at = b.column("pool").values.to_numpy().view(np.uint64), b.column("pool").offsets.to_numpy()
            for i, (d, n) in enumerate(zip(b.column("doc").to_pylist(), b.column("n").to_pylist())):
                own = in_order(flat[at[i] : at[i + 1]], n, shared.value, percent, whole=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), d)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(np.full(len(own), n))], names=["s", "doc", "rank", "n"])

    return df.mapInArrow(rows, "s long, doc long, rank int, n long")


def representatives(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` whose id is the smallest of its component; rows without an id stay."""
    with scratch(documents.sparkSession) as keep:
        found = join_components(documents, doc_id, text, **options)
        gone = keep(staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))
    return without_ids(documents, doc_id, gone, gone.count() <= BROADCAST_ROWS)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join_components(docs)


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), {SHINGLE}) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE}, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r(doc, comp) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.doc WHERE r.comp < l.b),
m AS (SELECT doc, min(comp) AS comp FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc = d.doc_id
"""

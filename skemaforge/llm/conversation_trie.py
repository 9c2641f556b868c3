"""The prefix trie of conversations: what each shared beginning is worth.

Every prefix has a digest, and each digest the smallest conversation that begins with it: its owner. A conversation owns its prefixes from
one depth on, since longer prefixes have fewer members; that depth is found by binary search for all conversations at a time. What a
conversation owns is a chain, which hangs on a prefix that another one owns: chains form a tree, and their totals go up it.

Positions, running sums and lists are taken in blocks, so that a conversation with any share of the rows isn't one task's: ranks by ranges of the
sorted rows, sums within blocks of ``BLOCK`` turns and then over the blocks. A prefix's digest is that of the sums of its turns' digests,
each taken with its depth (256 bits in eight words), since sums can be made in blocks and chains of digests can't.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, stage_path, staged

BLOCK = 1024
#: Ids in one piece of a list of ids: conversations whose ids agree but for the last twelve bits.
PIECE = 4096
#: Keys with at least one in so many rows are joined by broadcast: they are fewer than this number.
HOT = 1000
LANES = 8
WORD = "[^\\x20\\x09-\\x0D]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, content, words: turns without their texts. Null roles and texts are empty; rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), content, words, in order of turn (null first; equal turns by the digest of role and text)."""
    order = ["conv_id", "turn", "content", "row"]
    rows = turns_of(conversations).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))  # so that equal rows can be parted
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.select("conv_id", "content", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # as many a conversation as it has partitions
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(parts.select("conv_id", "part", "first", before.alias("before")), ["conv_id", "part"])
    out = staged(placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "content", "words"), "numbered")
    drop_staged(out.sparkSession, rows)
    return out


def running(df: DataFrame, key: str, order: str, sums: list[str], down: bool = False) -> DataFrame:
    """``df`` with each of ``sums`` replaced by its running sum a key, in order of a dense number (``down``: from the highest)."""

    def by(c: str) -> Column:
        return F.col(c).desc() if down else F.col(c).asc()

    rows = df.withColumn("block", F.expr(f"{order} div {BLOCK}"))
    within = Window.partitionBy(key, "block").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(by("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "block").agg(*(F.sum(s).alias(s) for s in sums)).select(key, "block", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"before_{s}") for s in sums))
    local = rows.select(*(F.sum(c).over(within).alias(c) if c in sums else F.col(c) for c in rows.columns))
    return local.join(totals, [key, "block"]).select(*((F.col(c) + F.col(f"before_{c}")).alias(c) if c in sums else F.col(c) for c in df.columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, prefix (digest), words, upto (words of the prefix) of turns (conv_id, depth from 1, content, words)."""
    lanes = [f"lane{i}" for i in range(LANES)]
    tagged = turns.withColumn("tagged", F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "content"), 256))
    rows = tagged.select("conv_id", "depth", "words", F.col("words").alias("upto"), *(F.conv(F.substring("tagged", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(lanes)))
    rows = running(rows, "conv_id", "depth", ["upto", *lanes])
    return rows.select("conv_id", "depth", F.unhex(F.sha2(F.concat_ws(",", "depth", *lanes), 256)).alias("prefix"), "words", "upto")


def bucketed(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """A table in the shared folder that joins on ``keys`` without another shuffle."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    name, n = path.rsplit("/", 1)[1].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, weight: str, total: int) -> DataFrame:
    """Inner join with a table of distinct keys. Weights sum up to ``total`` at most, so fewer than ``HOT`` + 1 keys have one in ``HOT``; their rows aren't shuffled."""
    on, heavy = F.col(key) == F.col(table_key), F.col(weight) * HOT >= max(total, 1)
    hot = table.where(heavy)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(table_key)), on, "left_anti").join(table.where(~heavy), on))


def first_owned(lengths: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """conv_id, length and ``first``, the first depth that a conversation owns (length + 1: none), by binary search against the minima.

    ``nodes`` holds each prefix's owner; a conversation has one prefix of a depth, so a row for it at that depth means that it owns it.
    """
    found = lengths.select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"))
    owners = nodes.select(F.col("owner").alias("o"), F.col("depth").alias("d"))
    for _ in range(int(longest).bit_length() + 1):
        found = found.withColumn("mid", F.expr("(lo + hi) div 2"))
        found = found.join(owners, (F.col("conv_id") == F.col("o")) & (F.col("mid") == F.col("d")), "left")
        owned, open_ = F.col("o").isNotNull(), F.col("lo") < F.col("hi")
        found = found.select("conv_id", "length", F.when(open_ & ~owned, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & owned, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return found.select("conv_id", "length", F.col("lo").alias("first"))


def totals_up(chains: DataFrame, sums: list[str], total: int) -> DataFrame:
    """``chains`` (conv_id, parent) with each of ``sums`` replaced by its sum over the chain and all below it.

    Links double in length each round, so that a tree of height h takes about log2(h) rounds; a round reaches twice as far down as the one before.
    """
    state, last = chains.withColumn("up", F.col("parent")), None
    while True:
        given = state.where("up is not null").groupBy(F.col("up").alias("to")).agg(*(F.sum(s).alias(f"given_{s}") for s in sums), F.count("*").alias("n_given"))
        added = state.join(given, F.col("conv_id") == F.col("to"), "left")
        others = [c for c in state.columns if c not in sums]
        added = staged(added.select(*others, *((F.col(s) + F.coalesce(f"given_{s}", F.lit(0))).alias(s) for s in sums), F.coalesce("n_given", F.lit(0)).alias("n_given")), "chain-totals")
        if last is not None:
            drop_staged(added.sparkSession, last)
        last = added
        above = added.select(F.col("conv_id").alias("to"), F.col("up").alias("further"), F.col("n_given").alias("weight"))
        moved = looked_up(added.where("up is not null"), "up", above, "to", "weight", total).withColumn("up", F.col("further"))
        state = added.where("up is null").select(*state.columns).unionByName(moved.select(*state.columns))
        if added.where("up is not null").isEmpty():
            return added.select(*chains.columns)


def list_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the digest of the ascending, comma-joined ids of each (owner, depth).

    Ids come in pieces of at most ``PIECE`` and pass through the hash one after the other; a list is never held whole.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / F.lit(PIECE)).alias("piece")).agg(text.alias("text"))
    pieces = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece")

    def hashed(batches):
        at, state = None, None
        for b in batches:
            done = []
            for owner, depth, text in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "text"))):
                if (owner, depth) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (owner, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield _rows(done)
        if at is not None:
            yield _rows([(*at, state.hexdigest())])

    return pieces.select("owner", "depth", "text").mapInArrow(hashed, "owner long, depth long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    owner, depth, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], names=["owner", "depth", "ends_sha256"])


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of numbered turns (conv_id, depth, content, words) of conversations (distinct conv_id, length; 0 where there are no turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 as ``prefix_trie`` says.
    """
    spark = turns.sparkSession
    lengths = staged(lengths.select("conv_id", "length"), "lengths")
    n_convs, n_turns, longest, root = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0)), F.min("conv_id")).first()
    rows = staged(prefixes(turns), "prefixes")
    nodes = rows.groupBy("depth", "prefix").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first("upto").alias("upto"))
    nodes = bucketed(nodes, "prefix-minima", "owner", "depth")
    chains = first_owned(lengths, nodes, longest)
    # where each chain hangs: the prefix before its first; the root's chain hangs nowhere
    tops = staged(chains.withColumn("at", F.col("first") - 1), "chain-tops")
    deep = tops.where("at > 0").join(rows.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "prefix", "upto"), (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("d")))
    owners = nodes.select(F.col("prefix").alias("known"), "owner", F.col("n_convs").alias("weight"))
    deep = looked_up(deep, "prefix", owners, "known", "weight", n_turns).select("conv_id", "length", "first", "at", F.col("owner").alias("parent"), F.col("upto").alias("shared"))
    flat = tops.where("at = 0").select("conv_id", "length", "first", "at", F.when(F.col("conv_id") != root, F.lit(root)).alias("parent"), F.lit(0).cast("long").alias("shared"))
    hung = staged(deep.unionByName(flat), "chains")
    drop_staged(spark, lengths, rows, tops)
    owning = (F.col("first") <= F.col("length")) | F.col("parent").isNull()
    # a chain's end is a leaf where no chain that owns anything hangs on it
    busy = hung.where(owning & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("p"), F.col("at").alias("a")).agg(F.count("*").alias("n"))
    marked = hung.join(busy, (F.col("conv_id") == F.col("p")) & (F.col("length") == F.col("a")), "left").select(hung["*"], F.when(owning & F.col("n").isNull(), 1).otherwise(0).cast("long").alias("leaf"), owning.cast("long").alias("owning"))
    marked = marked.withColumns({"leaves": F.col("leaf"), "gone": F.col("shared")})
    summed = totals_up(marked, ["leaves", "gone"], n_convs)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    below = summed.where("parent is not null").select(F.col("parent").alias("owner"), F.col("at").alias("depth"), F.col("owning").alias("n_chains"), "leaves", "gone", zero.alias("is_end"), none.alias("above"))
    ends = summed.where("owning = 1").select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"), zero.alias("n_chains"), F.col("leaf").alias("leaves"), zero.alias("gone"), F.lit(1).cast("long").alias("is_end"), none.alias("above"))
    starts = summed.where("owning = 1 and parent is not null").select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), zero.alias("n_chains"), zero.alias("leaves"), zero.alias("gone"), zero.alias("is_end"), F.col("parent").alias("above"))
    told = below.unionByName(ends).unionByName(starts).groupBy("owner", "depth").agg(*(F.sum(c).alias(c) for c in ("n_chains", "leaves", "gone", "is_end")), F.max("above").alias("above"))
    every = nodes.select("owner", "depth", "n_convs", "words", "upto")
    if n_convs:
        every = every.unionByName(spark.range(1).select(F.lit(root).alias("owner"), zero.alias("depth"), F.lit(n_convs).alias("n_convs"), zero.alias("words"), zero.alias("upto")))
    every = every.join(told, ["owner", "depth"], "left").na.fill(0, ["n_chains", "leaves", "gone", "is_end"])
    every = running(every, "owner", "depth", ["leaves", "gone"], down=True)
    listed = list_digests(summed.select(F.when(F.col("owning") == 1, F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv_id"))
    return every.join(listed, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"), "n_convs", (F.col("n_chains") + 1 - F.col("is_end")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("gone") - (F.col("n_convs") - 1) * (F.col("upto") - F.col("words"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text): a row for each distinct sequence of first turns, and for the root (depth 0).

    conv_id: the smallest conversation that begins with it (with depth, the node's key); parent_conv_id: the parent's (root: null); n_convs: how
    many begin with it; n_children; n_leaves: childless nodes in its subtree; saved_tokens: words of turns that needn't be stored or computed again,
    summed over its subtree; ends_sha256: SHA-256 of the ascending, comma-joined ids of the conversations that are it whole.

    Turns are ordered by ``turn`` (null first), equal ones by the SHA-256 of role and text; repeated rows are turns of their own. Null role and text
    are empty; rows without conv_id are left out; other columns aren't read. An empty table gives an empty one.
    """
    turns = numbered(conversations)
    return trie(turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv_id").agg(F.count("*").alias("length")))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and lengths of conversations that begin with h turns of conversation c - c mod ``every``, then go on with their own after the first h.

    h is the CRC-32 of the decimal id modulo ``most`` + 1. Multiples of ``every`` are taken downwards (also below 0).
    """
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(every))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = turns.where((F.pmod("conv_id", F.lit(every)) == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), "pos", "content", "words")
    at_hand = heads.groupBy(F.col("base").alias("b")).agg(F.count("*").alias("there"))
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    convs = own.select("conv_id", "own", h.alias("h"), base.alias("base")).join(at_hand, F.col("base") == F.col("b"), "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = staged(convs.select("conv_id", "own", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "rebuilt-lengths")
    first = convs.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("pos")).join(heads, ["base", "pos"]).select("conv_id", F.col("pos").alias("depth"), "content", "words")
    # a long conversation's row is given once a block of its turns
    blocks = convs.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {BLOCK}"))).alias("block"))
    rest = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv_id", "block"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "content", "words")
    return first.unionByName(rest), convs.select("conv_id", "length")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The checksum table is computed by its rule; prefixes are lists of turns, and each node meets all its ancestors.
SQL = """
WITH steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
cleaned AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM cleaned),
convs AS (SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), steps),
sized AS (SELECT c.conv_id, c.base, c.h, count(t.pos) AS taken FROM convs c LEFT JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h GROUP BY ALL),
built AS (
  SELECT s.conv_id, t.pos AS depth, t.role, t.text FROM sized s JOIN turns t ON t.conv_id = s.base AND t.pos <= s.h
  UNION ALL SELECT s.conv_id, t.pos - s.h + s.taken, t.role, t.text FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.pos > s.h),
members AS (
  SELECT conv_id, depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM built
  UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM members GROUP BY depth, key),
above AS (SELECT n.conv_id AS c, n.depth AS d, n.n_convs, n.words, a.conv_id, a.depth FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth JOIN nodes a ON a.depth = m.depth AND a.key = m.key),
kids AS (SELECT conv_id, depth, count(*) AS n_children FROM above WHERE d = depth + 1 GROUP BY ALL),
sums AS (SELECT a.conv_id, a.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((a.n_convs - 1) * a.words) AS saved FROM above a LEFT JOIN kids k ON k.conv_id = a.c AND k.depth = a.d GROUP BY ALL),
ends AS (SELECT n.conv_id, n.depth, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS h FROM nodes n JOIN members m ON m.depth = n.depth AND m.key = n.key JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth) LEFT JOIN above p ON p.c = n.conv_id AND p.d = n.depth AND p.depth = n.depth - 1
"""

"""What the operators of this subpackage share: shared storage, ASCII folding, byte-level words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session (tests) may do without: it gets a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` which ``df`` doesn't have (Spark's names don't tell cases apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def without_ids(df: DataFrame, id_col: str, gone: DataFrame, small: bool = False) -> DataFrame:
    """The rows of ``df`` whose id isn't in the one column of ``gone``; a null id counts as an id."""
    (name,) = unused(df, "gone")
    gone = gone.toDF(name).distinct()
    return df.join(F.broadcast(gone) if small else gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


def staged(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it outlives executors and cuts lineage."""
    path = stage_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables staged so far that nobody has taken charge of.
_staged: list[str] = []


def stage_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was staged within it, but for the tables that frames given to ``keep`` read: for steps whose result is staged whole."""
    before, kept = len(_staged), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 2)[1] for f in df.inputFiles())
        return df

    yield keep
    own = _staged[before:]
    _staged[before:] = [p for p in own if p.rsplit("/", 1)[1] in kept]
    for p in own:
        if p.rsplit("/", 1)[1] not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables which nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered_names(df: DataFrame) -> DataFrame:
    """``df`` with plain names: Python functions can't be given columns whose names have dots or backticks."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LENGTH = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection, so equal only where the inputs are."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at a time; what is kept between calls are the powers up to it (2 MB).
_CHUNK = 1 << 17


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= _CHUNK."""
    tables = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        with np.errstate(over="ignore"):
            tables.append(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_CHUNK, b, np.uint64))), dtype=np.uint64))
    return tables[0], tables[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes in ascending order that don't overlap.

    A span's hash is a polynomial in its bytes modulo 2**64, from differences of prefix sums, then mixed with its length, so
    it doesn't depend on where the span stands. Vectorised: no step per span. Equal hashes can be constructed: confirm on bytes.
    """
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = int(np.searchsorted(ends, lo + _CHUNK, "right"))
            if j <= i:  # longer than a chunk: chunk by chunk
                n, total = int(ends[i]) - lo, 0
                for k in range(0, n, _CHUNK):
                    some = data[lo + k : min(lo + k + _CHUNK, lo + n)].astype(np.uint64) + np.uint64(1)
                    total += int((some * up[: len(some)]).sum()) * pow(_BASE, k, 1 << 64)
                out[i] = mix(np.array([(total + n * _LENGTH) & _MASK], np.uint64))[0]
                i += 1
                continue
            terms = (data[lo : ends[j - 1]].astype(np.uint64) + np.uint64(1)) * up[: ends[j - 1] - lo]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(_LENGTH))
            i = j
    return out


#: Seed of the words' hashes.
WORD_SEED = 0x5DEECE66D1CE4E5B


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes, A-Z folded. The caller puts white space between texts.

    Distinct words are found on their bytes, and each is hashed once (xxh3, 64 bits, seeded).
    """
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(_FOLD[data[~space]])]).dictionary_encode()
    hashes = np.fromiter((xxh3_64_intdigest(w, WORD_SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()], starts


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column with a newline after each text, and where each text starts (n + 1 places)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_string()
    column = pc.binary_join_element_wise(pc.fill_null(column.cast(kind), pa.scalar("", kind)), pa.scalar("", kind), pa.scalar("\n", kind))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]

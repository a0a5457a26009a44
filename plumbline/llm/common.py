"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+, as Spark/Java regex text and as characters.
WS_CLASS = "[\\x20\\x09-\\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch between Spark and a Python worker, where the session sets no bound.
ARROW_BYTES = 8 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to ARROW_BYTES, unless it was given a bound: rows of any length, bounded memory."""
    if _ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(_ARROW_BYTES, str(ARROW_BYTES))


def returned() -> None:
    """Give back to the system what Arrow's pool and the C allocator of this Python worker keep but don't use."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(batches):
    """The batches, for tasks that run beside a full JVM: a worker is used again by the next stage, and Arrow keeps the pages
    of batches that are gone, so they are given back before the first batch, after each, and at the end."""
    import pyarrow as pa

    returned()
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    returned()


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as long and the text, whatever other columns there are. Their session's Arrow batches are bounded."""
    bounded(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes a finished query's shuffle files at once under this setting.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; its shuffle files go when it is complete."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def dropped(*dfs: DataFrame) -> None:
    """Delete tables that written() made and nothing will read again."""
    for df in dfs:
        path = getattr(df, "_plumbline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that written() made."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._plumbline_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind value once: a lambda variable is not inlined by the optimizer, a projected column may be."""
    return F.transform(F.array(value), body)[0]


# --- vectorised hashing -------------------------------------------------------

# Well-known mixing constants (fixed values).
P64 = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of P64 modulo 2**64.
I64 = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A second, independent base.
Q64 = np.uint64(0xD6E8FEB86659FD93)
J64 = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POW: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POW.get((int(base), 0))
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length() if n > 1 else 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _POW[int(base), 0] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place on its own copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


SEGMENT = 1 << 17


def rolling(values: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Mixed 64-bit hashes of values[i:i+width] for every i; work memory is bounded by SEGMENT."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    up, down = powers(Q64 if second else P64, SEGMENT + width), powers(J64 if second else I64, SEGMENT)
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        part = values[lo : hi + width - 1].astype(np.uint64) + np.uint64(1)
        part *= up[: len(part)]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        out[lo:hi] = mix((total[width:] - total[:-width]) * down[: hi - lo])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end in buf (uint8), text k at bounds[k]:bounds[k+1].

    Returns start and end byte of each word, its mixed 64-bit hash, and the first word of each text
    (one entry more than texts).
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = bounds[:-1][bounds[:-1] < len(buf)]
    first[cut] = word[cut]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = cut[cut > 0] - 1
    last[before] = word[before]
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    lens = ends - starts
    at = np.flatnonzero(word)
    # offset of each byte inside its word
    begin = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=begin[1:])
    off = np.arange(len(at)) - np.repeat(begin, lens)
    terms = (buf[at].astype(np.uint64) + np.uint64(1)) * powers(P64, int(lens.max()))[off]
    hashes = mix(np.add.reduceat(terms, begin) + lens.astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, bounds)


def packed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def text_slices(batches, limit: int):
    """(ids, texts as bytes or None) slices of Arrow batches with at most about limit bytes, one text at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo, done = 0, 0
        while lo < len(ends):  # one slice at a time becomes Python objects
            hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.column(0).slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist()
            lo, done = hi, int(ends[hi - 1])

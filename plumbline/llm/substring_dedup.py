"""Substring deduplication over windows of WIDTH words with sorted fingerprint runs, once or batch by batch.

Each batch of documents makes sorted immutable runs of its windows' fingerprints, with the words of those windows.
FingerprintIndex keeps the runs of earlier documents on disk: the runs of new ones are merge-joined with them bucket by
bucket, what meets is verified word by word, and the new runs join the history, which is compacted when it has many.
dedup_words() without an index does the same within one table, where only fingerprints that occur twice are sent.

Words are runs of anything but ASCII white space, unchanged. Null texts have no words; texts under WIDTH words lose
nothing. Every row gives one row, repeated ones too; an empty table gives none. Only id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, rolling, shuffle_partitions, words_of
from .window_dedup import RUN, Anchors, Records, _alike, _bucketed, _packed, _received, _shared, covered, out_ids, search

WIDTH, STRETCH = 20, 8
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Words:
    """A batch's texts as words, each followed by one space."""

    def __init__(self, batch, q: int):
        starts, ends, hashes, self.bounds = words_of(batch.buf, batch.bounds)
        self.hashes = rolling(hashes, q)
        counts = np.diff(self.bounds)
        self.rows, self.ends = np.repeat(np.arange(len(counts)), counts), np.repeat(self.bounds[1:], counts)
        data = b" ".join(batch.data.split())
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=at[1:])
        if at[-1] != len(data) + bool(len(starts)):  # words at the edges of two texts are split() as one
            data = b" ".join(batch.data[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
        self.slice = lambda a, b: data[at[a] : at[b] - 1]


class WordWindows:
    own, judge = True, staticmethod(_shared)
    #: Anchors a byte, about.
    density = 2 / (WIDTH - STRETCH + 2) / 6

    def __init__(self, width: int = WIDTH, q: int = STRETCH):
        if not 0 < q <= width <= q + 63:
            raise ValueError("a stretch of a window is at most 63 words shorter")
        self.width, self.q = width, q

    def prepare(self, batch):
        return _Words(batch, self.q)

    def anchors(self, batch, state) -> Anchors:
        return Anchors(state.hashes, state.ends, self.width, self.q)

    @staticmethod
    def units(texts) -> np.ndarray:
        """Words as numbers of a dictionary of these texts."""
        words = []
        for lens, data in texts:
            end = 0
            for n in lens.tolist():
                words += data[end : end + n].split(b" ")
                end += n
        return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)


def dedup_words(docs: DataFrame, width: int = WIDTH, with_text: bool = False, q: int = STRETCH, **sizes) -> DataFrame:
    """OUT per row; with_text adds what is left. sizes: of search()."""

    def finish(batch, state, starts):
        bounds = state.bounds
        gone = covered(int(bounds[-1]), starts, width)
        edge = np.zeros(len(gone) + 1, np.int64)
        edge[1:] = np.cumsum(gone)
        removed = edge[bounds[1:]] - edge[bounds[:-1]]
        shas, kept = [], []
        for k, (lo, hi) in enumerate(zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist())):
            words = batch.data[lo:hi].split()
            if removed[k]:
                words = itertools.compress(words, (~gone[bounds[k] : bounds[k + 1]]).tolist())
            left = b" ".join(words)
            shas.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode())
        cols = [out_ids(batch), pa.array(np.diff(bounds)), pa.array(removed), pa.array(shas)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return search(docs, WordWindows(width, q), finish, OUT + ", kept string" * with_text, **sizes)


class FingerprintIndex:
    """The windows of all documents added so far, as sorted immutable runs in a folder that all executors share.

    A run is a table of (bucket, batch, run), complete or not there at all; a bucket is a range of anchors' hashes, and
    their number is fixed when the index is made. With more than `fanout` runs they are compacted into one, in which
    every distinct record is once.
    """

    def __init__(self, spark, path: str, width: int = WIDTH, q: int = STRETCH, buckets: int = 1024, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.kind, self.buckets = WordWindows(width, q), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def runs(self) -> list[str]:
        """Names of the complete runs, oldest first. A compacted run says up to which it has all: those before it are over."""
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._at("")) if self._fs.exists(self._at(f"{x.getPath().getName()}/_SUCCESS")))
        whole = [n for n in names if n.endswith("-all")]
        return [n for n in names if n >= whole[-1]] if whole else names

    def _next(self, kind: str) -> str:
        last = self.runs()[-1:] or ["000000-run"]
        return f"{int(last[0].split('-')[0]) + 1:06d}-{kind}"

    def _read(self, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN)
        for name in names:
            out = out.unionByName(self.spark.read.schema(RUN).parquet(f"{self.path}/{name}"))
        return out.select("bucket", F.lit(-1).cast("long").alias("batch"), "run")

    def add(self, docs: DataFrame, with_text: bool = False, **sizes) -> DataFrame:
        """dedup_words() of docs, after all documents added before; their runs become part of the history."""
        if len(self.runs()) > self.fanout:
            self.compact()
        name = self._next("run")

        def keep(runs: DataFrame) -> DataFrame:
            runs.write.parquet(f"{self.path}/{name}")
            return self.spark.read.schema(RUN).parquet(f"{self.path}/{name}")

        return dedup_words(docs, self.kind.width, with_text, self.kind.q, history=self._read(self.runs()), buckets=self.buckets, keep=keep, **sizes)

    def compact(self) -> None:
        """One run of all; older ones are deleted once it is complete."""
        kind, old = self.kind, self.runs()

        def merged(held, now):
            got = [_received(run) for _, run in held]
            ids, before, count, lens = (np.concatenate([g[i] for g in got]) for i in range(4))
            records = Records(ids, before, count, kind.units([(g[3], g[4]) for g in got]), kind.width, kind.q)
            rows = np.flatnonzero(_alike(records, np.zeros(len(ids), np.uint64)) == np.arange(len(ids)))
            data, begin = b"".join(g[4] for g in got), np.concatenate([[0], np.cumsum(lens)])
            texts = [data[begin[i] : begin[i + 1]] for i in rows.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([-1], pa.int64()), pa.array([_packed(ids[rows], before[rows], count[rows], texts)], pa.binary())], names=["bucket", "batch", "run"])

        one = _bucketed(self._read(old), shuffle_partitions(self.spark), merged, RUN, "compacted")
        one.write.parquet(f"{self.path}/{self._next('all')}")
        dropped(one)
        for name in old:
            self._fs.delete(self._at(name), True)


def op2(spark, sf_dir):
    from .common import table

    return dedup_words(table(spark, sf_dir, "documents"))

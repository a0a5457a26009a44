"""Suffix deduplication: bytes covered by a WIDTH-byte string that also starts in a smaller doc_id.

Difference-cover blockwise construction. The sample is a difference cover of period 31, counted from a text's start:
six of 31 suffixes, by the residues of which any two equal strings, wherever they start, have a member at one same place
within them. Members are first ranked by STRETCH bytes, one bucket of their hashes at a time; one whose rank is its own
is tied with nothing. Of tied ones, as far as they are needed (see Cover), the bytes around go to the bucket of their
rank, and of one bucket at a time the suffixes are sorted: two strings are compared by the bytes ahead of their common member and then by its suffix's rank.
Only strings of WIDTH bytes matter, so no suffix is sorted any deeper.

Null texts are empty; texts under WIDTH bytes lose nothing. Every row gives one row, repeated ones too; an empty table
gives none. Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rolling
from .window_dedup import Cover, _tied, cover_of, covered, out_ids, search

WIDTH, STRETCH = 50, 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Bytes:
    """A batch's text as bytes."""

    def __init__(self, batch, q: int):
        lens = np.diff(batch.bounds)
        self.hashes = rolling(batch.buf, q)
        self.rows = np.repeat(np.arange(len(lens)), lens)
        self.slice = lambda a, b: batch.data[a:b]


class Suffixes:
    own, judge = False, staticmethod(_tied)

    def __init__(self, width: int = WIDTH, q: int = STRETCH):
        if not 0 < q <= width <= q + 63:
            raise ValueError("a stretch of a window is at most 63 bytes shorter")
        self.width, self.q = width, q
        period, members = cover_of(width, q)
        #: Anchors a byte.
        self.density = len(members) / period

    def prepare(self, batch):
        return _Bytes(batch, self.q)

    def anchors(self, batch, state) -> Cover:
        return Cover(state.hashes, batch.bounds, self.width, self.q)

    @staticmethod
    def units(texts) -> np.ndarray:
        return np.frombuffer(b"".join(data for _, data in texts), np.uint8)


def dedup_bytes(docs: DataFrame, width: int = WIDTH, with_text: bool = False, **sizes) -> DataFrame:
    """OUT per row; with_text adds what is left, as binary."""

    def finish(batch, _, starts):
        gone = covered(len(batch.buf), starts, width)
        edge = np.zeros(len(gone) + 1, np.int32)
        edge[1:] = np.cumsum(gone)
        removed = edge[batch.bounds[1:]] - edge[batch.bounds[:-1]]
        spans, shas, kept = [], [], []
        for k, (lo, hi) in enumerate(zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist())):
            if removed[k]:
                m = gone[lo:hi]
                spans.append(int(m[0]) + int((m[1:] & ~m[:-1]).sum()))
                left = batch.buf[lo:hi][~m].tobytes()
            else:
                spans.append(0)
                left = batch.data[lo:hi]
            shas.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left)
        cols = [out_ids(batch), pa.array(np.diff(batch.bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_text, names=names + ["kept"] * with_text)

    sizes = {"bucket_records": 1 << 20} | sizes  # members, of which those that are tied are sent, with 80 bytes each
    return search(docs, Suffixes(width), finish, OUT + ", kept binary" * with_text, **sizes)


def op1(spark, sf_dir):
    from .common import table

    return dedup_bytes(table(spark, sf_dir, "documents"))

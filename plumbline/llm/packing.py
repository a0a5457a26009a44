"""Best-fit packing by exact-complement hashing.

Only the counts of pieces per length (at most `capacity` of them) reach the driver. There a plan is made: the largest
length left opens a sequence; indexes of single, pair and triple length sums, under the counts still available, give a
combination that fills the gap exactly; where there is none, the largest piece that fits goes in (best fit) and the
rest of the gap is tried again. Each pattern is used as often as the counts allow, so a plan has few patterns however
many pieces there are. Pieces find their place by their rank among the pieces of their length.

Null and empty texts are one piece of the end id alone; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, lean, written
from .tokens import LIMIT, default_path, encoder


class SumIndex:
    """Sums of one, two or three available lengths, hashed by the sum.

    Counts only fall, so a sum that once had no combination never gets one again; a remembered combination is tried
    first and looked for anew when its pieces have run out.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.triples: dict[int, tuple[int, int, int] | None] = {}

    def _there(self, combo) -> bool:
        return all(self.left[x] >= k for x, k in Counter(combo).items())

    def pair(self, total: int):
        have = self.pairs.get(total, ())
        if have is None or have and self._there(have):
            return have
        a = np.arange((total + 1) // 2, total)
        ok = (self.left[a] > 0) & (self.left[total - a] > 0)
        if total % 2 == 0 and len(ok):
            ok[0] = self.left[total // 2] >= 2
        found = np.flatnonzero(ok)
        self.pairs[total] = (int(a[found[-1]]), int(total - a[found[-1]])) if len(found) else None
        return self.pairs[total]

    def triple(self, total: int):
        have = self.triples.get(total, ())
        if have is None or have and self._there(have):
            return have
        partial = False
        for a in (np.flatnonzero(self.left[1 : max(1, total - 1)])[::-1] + 1).tolist():
            if 3 * a < total:
                break
            rest = self.pair(total - a)
            if rest:
                if self._there((a, *rest)):
                    self.triples[total] = (a, *rest)
                    return self.triples[total]
                partial = True  # it needs one length more often than there is; another pair may do
        if not partial:
            self.triples[total] = None
        return None

    def exact(self, gap: int, most: int):
        if self.left[gap]:
            return (gap,)
        return most >= 2 and self.pair(gap) or most >= 3 and self.triple(gap) or None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), using up counts[length] exactly.

    Of the plans with combinations of up to three, two and one lengths, the one with the fewest sequences.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = counts.astype(np.int64).copy()
    index, out = SumIndex(left), []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        items, gap = [top], capacity - top
        left[top] -= 1
        while gap:
            combo = index.exact(gap, most)
            if not combo:
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                combo = (int(fits[-1]) + 1,)
            for x in combo:
                left[x] -= 1
                gap -= x
                items.append(x)
        times = 1 + min(int(left[x]) // k for x, k in Counter(items).items())
        for x in items:
            left[x] -= times - 1
        out.append((tuple(items), times))


class Places:
    """By length: from which rank on which sequences and offset hold."""

    def __init__(self, patterns, capacity: int):
        self.first = [[] for _ in range(capacity + 1)]
        self.seq = [[] for _ in range(capacity + 1)]
        self.off = [[] for _ in range(capacity + 1)]
        used, sequence = [0] * (capacity + 1), 0
        for items, times in patterns:
            offset = 0
            for x in items:
                self.first[x].append(used[x])
                self.seq[x].append(sequence)
                self.off[x].append(offset)
                used[x] += times
                offset += x
            sequence += times
        self.sequences = sequence
        for part in (self.first, self.seq, self.off):
            part[:] = [np.array(x, np.int64) for x in part]

    def of(self, lengths: np.ndarray, ranks: np.ndarray):
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            m = lengths == x
            k = np.searchsorted(self.first[x], ranks[m], side="right") - 1
            seq[m] = self.seq[x][k] + ranks[m] - self.first[x][k]
            off[m] = self.off[x][k]
        return seq, off


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, chunks: int = LIMIT) -> DataFrame:
    """Pieces of the encoded documents, with their task and their rank there among pieces of that length."""

    def run(batches):
        encode, seen = encoder(path, chunks), np.zeros(capacity + 1, np.int64)
        task, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for batch in lean(batches):
            cols = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc, p, lo // 4, n, zlib.crc32(part), task, int(seen[n]))):
                        c.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return id_text(docs).mapInArrow(run, PIECE + ", task int, nth long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, chunks: int = LIMIT) -> DataFrame:
    """PIECE with sequence_id and offset; sequences have at most capacity ids and no gaps.

    chunks: how many chunks between white space a worker keeps the ids of; fewer take less memory and more time.
    """
    parts = written(pieces(docs, path or default_path(), capacity, end_id, chunks), "pieces")
    counts = parts.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    total = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        total[row.length] = row.n
    places = Places(plan(total, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = parts.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def placed(batches):
        for b in batches:
            seq, off = places.of(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, PIECE + ", sequence_id long, offset long")


def op3(spark, sf_dir):
    from .common import table

    return pack(table(spark, sf_dir, "documents"))

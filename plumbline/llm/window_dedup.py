"""Distributed search for repeated windows of a corpus: named by hashes, decided on their bytes or words.

Texts are kept as compressed batches. Every window has anchors, stretches of q of its units, such that two equal windows
share one at the same place: the members of a difference cover (Cover), or the stretch with the least hash, which
depends on the window alone (Anchors). An anchor's record is the text of all windows that it anchors. Within a batch
equal records are one, and windows are resolved there first.

Round 1 finds anchors that occur more than once, by sorted runs of their hashes. Round 2 sends the records of such
anchors to the bucket of their hash. A task takes one bucket at a time, lays its records side by side along their
anchors, and sorts the suffixes that start at anchors and, backwards, what is ahead of them. These ranks then decide
which windows are equal, without another look at their units: a window is repeated if the very same one has a smaller
id. Memory is bounded by a batch on one side and a bucket on the other; a record that is in a third of all texts is one
record a batch.

Rows that repeat a doc_id are judged each on its own against smaller ids, a null doc_id being the smallest; null and
empty texts have no windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix, shuffle_partitions, text_slices, written

NULL_ID = np.iinfo(np.int64).min
BATCH = "batch long, ids binary, lens binary, blob binary"
RUN = "bucket int, batch long, run binary"


def _zip(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bytes(data))


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which compress where high bytes are small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_run(keys: np.ndarray, ids: np.ndarray | None = None) -> bytes:
    """Sorted keys as differences; ids per key by way of a table of the distinct ones."""
    out = _zip(_planes(np.diff(keys, prepend=np.uint64(0))))
    head = np.array([len(out), 0], "<u8")
    if ids is None:
        return head.tobytes() + out
    names, at = np.unique(ids, return_inverse=True)
    more = _zip(_planes(np.diff(names, prepend=np.int64(0))))
    head[1] = len(more)
    return head.tobytes() + out + more + _zip(_planes(at.astype(np.uint32)))


def unpack_run(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    a, b = (int(x) for x in np.frombuffer(data, "<u8", 2))
    keys = np.cumsum(_unplanes(_unzip(data[16 : 16 + a]), np.uint64), dtype=np.uint64)
    if not b:
        return keys, None
    names = np.cumsum(_unplanes(_unzip(data[16 + a : 16 + a + b]), np.int64), dtype=np.int64)
    return keys, names[_unplanes(_unzip(data[16 + a + b :]), np.uint32)]


def batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """BATCH rows of about batch_bytes of text, in each the rows by ascending id."""

    def run(it):
        task, k = TaskContext.get().partitionId(), 0
        for ids, texts in text_slices(it, batch_bytes):
            key = np.array([NULL_ID if i is None else i for i in ids], np.int64)
            order = np.argsort(key, kind="stable")
            texts = [texts[i] for i in order]
            lens = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k]), pa.array([key[order].tobytes()]), pa.array([lens.tobytes()]), pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(t or b"" for t in texts))])],
                names=["batch", "ids", "lens", "blob"],
            )
            k += 1

    return written(id_text(docs).mapInArrow(run, BATCH), "batches")


class Batch:
    def __init__(self, ids: bytes, lens: bytes, blob: bytes):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.data = _unzip(blob)
        self.buf = np.frombuffer(self.data, np.uint8)
        self.bounds = np.zeros(len(self.ids) + 1, np.int64)
        np.cumsum(np.maximum(self.lens, 0), out=self.bounds[1:])


def each(it, *more):
    """(batch number, Batch, further columns) of Arrow batches with the columns of BATCH first."""
    for b in it:
        cols = [b.column(k) for k in range(b.num_columns)]
        for r in range(b.num_rows):
            yield cols[0][r].as_py(), Batch(*(c[r].as_py() for c in cols[1:4])), *(c[r].as_py() for c in cols[4:])


#: Low bits of a key that may say more than its name.
CODE = 4
LOW = np.uint64((1 << CODE) - 1)


def edges(buckets: int) -> np.ndarray:
    """First key of each bucket, a multiple of 1 << CODE."""
    return np.array([-(-(k << 64) // buckets) for k in range(buckets)], np.uint64) & ~LOW


class Grouped:
    """Keys in position order, grouped: distinct ones ascending, with the first position of each."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        s = keys[self.order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.at = np.flatnonzero(new)
        self.keys = s[self.at]
        self.first = self.order[self.at]
        self.sizes = np.diff(np.append(self.at, len(s)))

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Per group to per position."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.sizes)
        return out


def _runs(batch: int, keys: np.ndarray, buckets: int, ids: np.ndarray | None = None):
    cut = np.append(np.searchsorted(keys, edges(buckets)), len(keys))
    rows = [(k, batch, pack_run(keys[a:b], None if ids is None else ids[a:b])) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
    names = ["bucket", "batch", "run"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=names)


def _answered(runs: DataFrame, parts: int, judge, name: str) -> DataFrame:
    """judge(keys, ids) gives a row of bits per key, of one bucket at a time. batch, bucket, bits."""

    def run(it):
        now, held = None, []

        def flush():
            keys = np.concatenate([k for _, k, _ in held])
            ids = None if held[0][2] is None else np.concatenate([i for _, _, i in held])
            bits = judge(keys, ids)
            ends = np.cumsum([len(k) for _, k, _ in held])
            out = [np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([now] * len(held), pa.int32()), pa.array(out, pa.binary())], names=["batch", "bucket", "bits"])

        for b in it:
            for r in range(b.num_rows):
                bucket = b.column(0)[r].as_py()
                if bucket != now and held:
                    yield flush()
                    held = []
                now = bucket
                held.append((b.column(1)[r].as_py(), *unpack_run(b.column(2)[r].as_py())))
        if held:
            yield flush()

    sent = runs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return written(sent.mapInArrow(run, "batch long, bucket int, bits binary"), name)


def _with_answers(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """A batch's answers, as many bits as it has keys, beside it."""
    mine = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))
    return texts.join(mine, "batch", "left")


def _bits(answers, keys: np.ndarray, buckets: int, width: int = 1) -> np.ndarray:
    """The answers, of width bits each, in the order of the sorted keys."""
    counts = np.diff(np.append(np.searchsorted(keys, edges(buckets)), len(keys)))
    out = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=width * int(counts[a["bucket"]])) for a in answers or ()]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _shared(keys: np.ndarray, ids) -> np.ndarray:
    """Round 1: keys that another run has too."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _tied(keys: np.ndarray, ids) -> np.ndarray:
    """Round 1 for coded keys: whether another run has the name too, and whether it has more than one code, or MIXED."""
    order = np.argsort(keys)
    s = keys[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] & ~LOW != s[:-1] & ~LOW]))
    sizes = np.diff(np.append(start, len(s)))
    most = s[start + sizes - 1]
    out = np.empty((len(keys), 2), bool)
    out[order] = np.repeat(np.stack([sizes > 1, (s[start] != most) | (most & LOW == MIXED)], axis=1), sizes, axis=0)
    return out


# --- records ---------------------------------------------------------------------


class Anchors:
    """Each window's anchor in a batch: the leftmost of its stretches of q units with the least hash.

    at: positions of anchors; first, count: the windows that each anchors, which are consecutive starts.
    """

    def __init__(self, hashes: np.ndarray, ends: np.ndarray, width: int, q: int):
        """hashes: of the stretch at each position; ends: of the text around each position."""
        n, r = len(ends), width - q + 1
        valid = np.flatnonzero(np.arange(n) + width <= ends)
        if not len(valid):
            self.at = self.first = self.count = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            return
        low = _leftmost_least(hashes, r)[valid]
        new = np.ones(len(valid), bool)
        # consecutive starts with the same anchor
        new[1:] = (low[1:] != low[:-1]) | (np.diff(valid) != 1)
        edge = np.flatnonzero(new)
        self.at, self.first = low[edge], valid[edge]
        self.count = np.diff(np.append(edge, len(valid)))
        self.keys = mix(hashes[self.at])  # the least ones are all small; keys are spread again

    def take(self, m: np.ndarray) -> None:
        self.at, self.first, self.count, self.keys = self.at[m], self.first[m], self.count[m], self.keys[m]

    def asked(self) -> np.ndarray:
        """Keys for round 1, ascending."""
        return Grouped(self.keys).keys

    def answered(self, answers, buckets: int) -> None:
        """Only those anchors stay that another text may have."""
        g = Grouped(self.keys)
        self.take(g.spread(_bits(answers, g.keys, buckets) | (g.sizes > 1)))


#: Difference covers by their period: of any two residues, a pair of members has the same difference (fixed values).
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_of(width: int, q: int) -> tuple[int, tuple[int, ...]]:
    """The widest period of which every window has a whole turn of stretches, and its members."""
    period = max(v for v in COVERS if v <= width - q + 1)
    return period, COVERS[period]


#: The code of an anchor that a batch has at more than one residue.
MIXED = LOW


class Cover(Anchors):
    """The members of a difference cover, each with the windows in which it has a place less than the period.

    Two equal windows, wherever they start, have members at one same place, so one pair of their records meets; where
    they start at the same residue, all their members meet. A member's key carries its residue, so that round 1 tells
    which strings occur at more than one, and are mixed. A window is sent with its mixed members: an equal one has the
    same string there. If it has none, whatever equals it starts at its residue, and it is sent with one member only,
    that of residue 0, if all its members are tied.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, width: int, q: int):
        """bounds: of the texts; their members are counted from their own starts."""
        period, members = cover_of(width, q)
        lens = np.diff(bounds)
        row = np.flatnonzero(lens >= width)
        turns = -(-(lens[row] - q + 1) // period)
        row, turn = np.repeat(row, turns), np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns)
        at = (turn[:, None] * period + np.array(members)).ravel()
        begin, last = np.repeat(bounds[row], len(members)), np.repeat(lens[row] - width, len(members))
        first, stop = np.maximum(at - (period - 1), 0), np.minimum(at, last) + 1
        m = (stop > first) & (at <= last + (width - q))
        self.at, self.first, self.count = (at + begin)[m], (first + begin)[m], (stop - first)[m]
        self.codes = np.tile(np.arange(len(members), dtype=np.uint64), len(row))[m]
        self.keys = mix(hashes[self.at]) & ~LOW
        self.size, self.members = int(bounds[-1]), len(members)

    def take(self, m: np.ndarray) -> None:
        super().take(m)
        self.codes = self.codes[m]

    def _coded(self) -> tuple[Grouped, np.ndarray]:
        g = Grouped(self.keys)
        if not len(g.keys):
            return g, g.keys
        codes = self.codes[g.order]
        least, most = np.minimum.reduceat(codes, g.at), np.maximum.reduceat(codes, g.at)
        return g, np.where(least == most, least, MIXED)

    def asked(self) -> np.ndarray:
        s = np.sort(self.keys | self.codes)
        start = np.flatnonzero(np.concatenate([[True], s[1:] & ~LOW != s[:-1] & ~LOW])[: len(s)])
        most = s[np.append(start[1:], len(s))[: len(start)] - 1]
        return np.where(s[start] == most, most, most | MIXED)

    def _windows(self, m: np.ndarray) -> np.ndarray:
        """How many of the members m each window has."""
        step = np.bincount(self.first[m], minlength=self.size + 1) - np.bincount(self.first[m] + self.count[m], minlength=self.size + 1)
        return np.cumsum(step)

    def answered(self, answers, buckets: int) -> None:
        g, codes = self._coded()
        if not len(g.keys):
            return
        bits = _bits(answers, g.keys, buckets, 2).reshape(-1, 2)
        tied, mixed = g.spread(bits[:, 0] | (g.sizes > 1)), g.spread(bits[:, 1] | (codes == MIXED))
        alone = np.flatnonzero((self._windows(tied) == self.members) & (self._windows(mixed) == 0))
        one = np.flatnonzero(tied & ~mixed & (self.codes == 0))
        low, high = np.searchsorted(alone, self.first[one]), np.searchsorted(alone, self.first[one] + self.count[one])
        one, low, high = (x[high > low] for x in (one, low, high))
        self.first[one], self.count[one] = alone[low], alone[high - 1] - alone[low] + 1
        mixed[one] = True
        self.take(mixed)


#: Positions whose least hashes are looked for at a time; they fit into the low 16 bits.
PIECE = 1 << 15


def _leftmost_least(hashes: np.ndarray, r: int) -> np.ndarray:
    """Position of the leftmost least value among hashes[i:i+r], for every i; beyond the end, values are the greatest.

    Compared are the upper 48 bits with the position below them, so of equal values the leftmost is the least; what is
    least depends on the stretches alone either way.
    """
    n, out = len(hashes), np.empty(len(hashes), np.int64)
    low = np.uint64(0xFFFF)
    place = np.arange(PIECE + r, dtype=np.uint64)
    for lo in range(0, n, PIECE):
        value = np.full(min(PIECE, n - lo) + r, ~low)
        value[: n - lo] = hashes[lo : lo + len(value)] & ~low
        value |= place[: len(value)]
        span = 1
        while span < r:  # of spans of a power of two, two overlapping ones make the last
            step = min(span, r - span)
            value = np.minimum(value[step:], value[:-step])
            span += step
        end = min(n, lo + PIECE)
        out[lo:end] = (value[: end - lo] & low).astype(np.int64) + lo
    return out


class Records:
    """Records of one bucket or batch, laid side by side along their anchors.

    units: their windows' units; before: units ahead of the anchor; count: windows, of which the first starts there.
    """

    def __init__(self, ids: np.ndarray, before: np.ndarray, count: np.ndarray, units: list | np.ndarray, width: int, q: int):
        self.ids, self.before, self.count, self.width, self.left = ids, before, count, width, width - q
        lens = count + (width - 1)
        begin = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=begin[1:])
        across = 2 * width - q
        self.table = np.zeros((len(lens), across), units.dtype)
        at = np.arange(len(lens)) * across + self.left - before - begin
        self.table.ravel()[np.arange(len(units)) + np.repeat(at, lens)] = units

    def some(self, rows: np.ndarray) -> Records:
        out = object.__new__(Records)
        out.ids, out.before, out.count, out.table = self.ids[rows], self.before[rows], self.count[rows], self.table[rows]
        out.width, out.left = self.width, self.left
        return out

    def repeated(self, own: tuple[np.ndarray, np.ndarray] | None = None, old: np.ndarray | None = None) -> np.ndarray:
        """Per record the windows that come after an equal one, with a smaller id, as bits by their place ahead of the anchor.

        own: (text, start of the first window) of each record; an earlier window of the same text counts too.
        old: records that come before all others.

        Anchors' suffixes are sorted once, and what is ahead of them too; a window is then its rank on either side.
        """
        n = len(self.ids)
        out = np.zeros(n, np.uint64)
        if n < 2:
            return out
        order = (self.ids,) if own is None else (own[1] + self.before, own[0], self.ids)
        by = np.lexsort(order if old is None else (*order, ~old))  # the first of equal windows is the one that stays
        ids, before, after = self.ids[by], self.before[by], (self.before - self.count)[by]
        text = None if own is None else own[0][by]
        old = None if old is None else old[by]
        behind, ahead = Ranks(self.table[by, self.left :]), Ranks(self.table[by, : self.left][:, ::-1])
        for place in range(self.left + 1):
            # windows that have the anchor at this place
            rows = np.flatnonzero((place <= before) & (place > after))
            if len(rows) < 2:
                continue
            rows, same = _sorted(behind.first(self.width - place)[rows], ahead.first(place)[rows], rows)
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            lead = np.repeat(rows[start], np.diff(np.append(start, len(rows))))
            hit = ids[rows] > ids[lead]
            if text is not None:
                hit[1:] |= same & (text[rows[1:]] == text[rows[:-1]])
            if old is not None:
                hit = (hit | old[lead]) & ~old[rows]
            out[by[rows[hit]]] |= np.uint64(1 << place)
        return out


class Ranks:
    """Rows of units sorted once, to tell for any length which rows begin alike."""

    def __init__(self, rows: np.ndarray):
        rows = np.ascontiguousarray(rows)
        n, across = rows.shape
        self.by, self.lcp = np.arange(n), np.zeros(n, np.int64)
        if n and across:
            # as byte strings of one length; only the grouping by beginnings matters, not the order of units
            self.by = np.argsort(rows.view(f"S{across * rows.itemsize}").ravel(), kind="stable")
            s = rows[self.by]
            differ = s[1:] != s[:-1]
            self.lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), across)
        self.lcp[:1] = -1

    def first(self, k: int) -> np.ndarray:
        """Per row the number of its first k units among all rows'."""
        out = np.empty(len(self.by), np.int64)
        out[self.by] = np.cumsum(self.lcp < k)
        return out


def _sorted(a: np.ndarray, b: np.ndarray, rows: np.ndarray, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Ascending rows by (a, b, row), and whether each but the first has the a and b of the one before."""
    if max(a.max(), b.max(), rows[-1]) >> bits == 0:  # all in one number
        key = (a << 2 * bits | b << bits | rows)
        key.sort()
        return key & (1 << bits) - 1, key[1:] >> bits == key[:-1] >> bits
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    return rows[by], (a[1:] == a[:-1]) & (b[1:] == b[:-1])


def _cells(windows: np.ndarray) -> np.ndarray:
    """The windows' bytes as rows of 64-bit cells."""
    data = np.ascontiguousarray(windows).view(np.uint8).reshape(len(windows), -1)
    wide = np.zeros((len(data), -(-data.shape[1] // 8) * 8), np.uint8)
    wide[:, : data.shape[1]] = data
    return wide.view(np.uint64)


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def hashed(cells: np.ndarray) -> np.ndarray:
    return mix((cells * _FACTORS[: cells.shape[1]]).sum(axis=1, dtype=np.uint64))


def _neighbours(cells: np.ndarray, key: np.ndarray, by: np.ndarray) -> np.ndarray | None:
    """Whether sorted neighbours are equal; None if some have the same hash and are not."""
    alike = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    if len(alike) and not (cells[by[alike + 1]] == cells[by[alike]]).all():
        return None
    same = np.zeros(max(0, len(by) - 1), bool)
    same[alike] = True
    return same


def _alike(records: Records, keys: np.ndarray) -> np.ndarray:
    """For each record the first one, by id, that is the same in all."""
    shape = (records.before << 32 | records.count).astype(np.uint64)
    cells = np.concatenate([_cells(records.table), shape[:, None], keys[:, None]], axis=1)
    by = np.lexsort((records.ids, hashed(cells)))
    same = _neighbours(cells, hashed(cells), by)
    if same is None:
        by = np.lexsort((records.ids, *cells.T))
        same = (cells[by[1:]] == cells[by[:-1]]).all(axis=1)
    start = np.ones(len(by), bool)
    start[1:] = ~same
    lead = np.empty(len(by), np.int64)
    lead[by] = by[start][np.cumsum(start) - 1]
    return lead


def _packed(ids: np.ndarray, before: np.ndarray, count: np.ndarray, texts: list[bytes]) -> bytes:
    lens = np.array([len(x) for x in texts], "<u4")
    return np.array([len(ids)], "<u4").tobytes() + _zip(b"".join([_planes(ids.astype("<i8")), before.astype("u1").tobytes(), count.astype("u1").tobytes(), _planes(lens), b"".join(texts)]))


def _sent(batch: int, rows: np.ndarray, keys: np.ndarray, records: Records, texts: list, buckets: int):
    """Records `rows`, sorted by key, as a run for each bucket."""
    cut = np.append(np.searchsorted(keys, edges(buckets)), len(keys))
    out = []
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if b > a:
            r = rows[a:b]
            out.append((k, batch, _packed(records.ids[r], records.before[r], records.count[r], [texts[i] for i in r.tolist()])))
    names = ["bucket", "batch", "run"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=names)


def _received(run: bytes):
    """(ids, before, count, length of each text, texts end to end) of a run."""
    n = int(np.frombuffer(run, "<u4", 1)[0])
    data = _unzip(run[4:])
    ids = _unplanes(data[: 8 * n], np.int64)
    before, count = (np.frombuffer(data, np.uint8, n, 8 * n + k * n).astype(np.int64) for k in (0, 1))
    return ids, before, count, _unplanes(data[10 * n : 14 * n], np.uint32).astype(np.int64), data[14 * n :]


def _judged(kind, held, now: int):
    """Answers of one bucket: for each batch its records' bits, in the order they came."""
    got = [_received(run) for _, run in held]
    ids, before, count = (np.concatenate([g[i] for g in got]) for i in range(3))
    records = Records(ids, before, count, kind.units([(g[3], g[4]) for g in got]), kind.width, kind.q)
    sizes = [len(g[0]) for g in got]
    old = np.repeat([batch < 0 for batch, _ in held], sizes)
    bits = records.repeated(old=old if old.any() else None)
    out = [(batch, _zip(x.astype("<u8").tobytes())) for (batch, _), x in zip(held, np.split(bits, np.cumsum(sizes)[:-1])) if batch >= 0]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([now] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["batch", "bucket", "bits"])


def _bucketed(runs: DataFrame, parts: int, judge, schema: str, name: str) -> DataFrame:
    """judge([(batch, run)], bucket) as a RecordBatch, one bucket at a time."""

    def run(it):
        now, held = None, []
        for b in it:
            for r in range(b.num_rows):
                bucket = b.column(0)[r].as_py()
                if bucket != now and held:
                    yield judge(held, now)
                    held = []
                now = bucket
                held.append((b.column(1)[r].as_py(), b.column(2)[r].as_py()))
        if held:
            yield judge(held, now)

    return written(runs.repartition(parts, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, schema), name)


def search(docs: DataFrame, kind, finish, schema: str, batch_bytes: int = 1 << 20, bucket_keys: int = 1 << 21, bucket_records: int = 1 << 17, history: DataFrame | None = None, buckets: int | None = None, keep=None) -> DataFrame:
    """finish(batch, state, unit starts of windows repeated from a smaller id or, of kind.own, from before).

    kind.prepare(batch) -> state with .rows (the text of each unit) and .slice(a, b) of a record's text;
    kind.anchors(batch, state) -> Anchors or Cover, and kind.judge, theirs; kind.units(texts) -> their units as numbers that are equal if they are.
    history: runs (bucket, batch < 0, run) of records that come before all of docs, for so many buckets; records are
    then sent whether or not docs have them twice, and keep() gets the table of their runs.
    """
    spark = docs.sparkSession
    texts = batches(docs, batch_bytes)
    total = texts.select(F.sum(F.length("blob"))).first()[0] or 0
    n_anchors = max(1, total * 4 * kind.density)  # compressed text, so an estimate; it only sets sizes
    parts = shuffle_partitions(spark)
    first_buckets = max(math.ceil(n_anchors / bucket_keys), 4 * parts)
    n_buckets = buckets or max(math.ceil(n_anchors / bucket_records), 4 * parts)

    every = history is not None  # the functions below are sent to executors, a DataFrame can't be

    def local(n: int, batch, got):
        """The batch's state, anchors to be asked about, their windows resolved within the batch, and who stands for whom."""
        state = kind.prepare(batch)
        anchors = kind.anchors(batch, state)
        if not every and len(anchors.keys):
            anchors.answered(got, first_buckets)
        if not len(anchors.keys):
            return state, anchors, None, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        row = state.rows[anchors.at]
        pieces = [state.slice(a, b) for a, b in zip(anchors.first.tolist(), (anchors.first + anchors.count + (kind.width - 1)).tolist())]
        lens = np.array([len(x) for x in pieces], np.int64)
        records = Records(batch.ids[row], anchors.at - anchors.first, anchors.count, kind.units([(lens, b"".join(pieces))]), kind.width, kind.q)
        bits, lead = np.zeros(len(row), np.uint64), np.arange(len(row))
        g = Grouped(anchors.keys)
        twice = np.flatnonzero(g.spread(g.sizes > 1))  # all others are alone in the batch
        if len(twice):
            mine = records.some(twice)
            bits[twice] = mine.repeated((row[twice], anchors.first[twice]) if kind.own else None)
            lead[twice] = twice[_alike(mine, anchors.keys[twice])]
        return state, anchors, records, bits, lead, pieces

    def standing(anchors, lead):
        """The records that are sent, by key."""
        rows = np.flatnonzero(lead == np.arange(len(lead)))
        return rows[np.argsort(anchors.keys[rows], kind="stable")]

    if not every:

        def ask(it):
            for n, batch in each(it):
                yield _runs(n, kind.anchors(batch, kind.prepare(batch)).asked(), first_buckets)

        answers = _answered(texts.mapInArrow(ask, RUN), parts, kind.judge, "shared-anchors")
        asked = _with_answers(texts, answers)
    else:
        asked = texts.withColumn("answers", F.lit(None).cast("array<struct<bucket:int,bits:binary>>"))

    def send(it):
        for n, batch, got in each(it):
            _, anchors, records, _, lead, pieces = local(n, batch, got)
            if records is not None:
                rows = standing(anchors, lead)
                yield _sent(n, rows, anchors.keys[rows], records, pieces, n_buckets)

    runs = asked.mapInArrow(send, RUN)
    if every:
        runs = keep(runs).unionByName(history)
    judged = _bucketed(runs, parts, lambda held, now: _judged(kind, held, now), "batch long, bucket int, bits binary", "repeated")
    mine = judged.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("found"))

    def apply(it):
        for n, batch, got, found in each(it):
            state, anchors, records, bits, lead, _ = local(n, batch, got)
            starts = np.zeros(0, np.int64)
            if records is not None:
                rows = standing(anchors, lead)
                more = np.zeros(len(lead), np.uint64)
                more[rows] = np.concatenate([np.frombuffer(_unzip(x["bits"]), "<u8") for x in found])
                bits = bits | more[lead]
                starts = np.concatenate([anchors.at[hit] - place for place in range(kind.width - kind.q + 1) if len(hit := np.flatnonzero(bits >> np.uint64(place) & np.uint64(1)))] or [starts])
            yield finish(batch, state, np.sort(starts))

    return asked.join(mine, "batch", "left").mapInArrow(apply, schema)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Units that windows of that width at starts, ascending, cover."""
    apart = starts[1:] > starts[:-1] + width
    step = np.zeros(n + 1, np.int8)
    step[starts[np.append(len(starts) > 0, apart)[: len(starts)]]] = 1
    step[starts[np.append(apart, len(starts) > 0)[: len(starts)]] + width] = -1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def out_ids(batch: Batch) -> pa.Array:
    return pa.array(batch.ids, pa.int64(), mask=batch.ids == NULL_ID)

"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word has a 4-bit selector and 60 bits of ids of one width; the selector says how many ids and how wide.
Selector 0 is 240 zeros; selector 1 is the escape, and the next word is one id of any 64 bits. Ids are coded in blocks
of BLOCK; each block starts on a word whose place is in the file, so blocks decode independently and vectorised.

File: magic, then uint64 counts (documents, ids, blocks, words, escape flag), then doc ids (int64), null flags (uint8),
ids per document (uint64), first word per block (uint64), words (uint64); all little-endian.

Null and empty texts are the end id alone. Files are in ascending doc_id order (nulls first); rows that repeat a
doc_id follow each other.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh_path, id_text, shuffle_partitions, written
from .tokens import default_path, encoder

MAGIC = b"PLS8B001"
BLOCK = 4096
#: A block and as much room as one word's ids take.
ROW = BLOCK + 240
ESCAPE = 1
#: (ids, bits) by selector (fixed values of the coding).
SELECTORS = ((240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([n for n, _ in SELECTORS])
#: Widths of the ids that tokenizers have.
_BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)
_FROM = np.array([1 << b for b in range(64)], np.uint64)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(words, first word of each block, whether escapes occur)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), False
    # each block is followed by as many zeros as a word can hold, so that words need not look for its end
    grid = np.zeros((blocks, ROW), np.uint64)
    full = n // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : n - full * BLOCK] = ids[full * BLOCK :]
    flat = grid.ravel()
    top = int(flat.max())
    bits = _BITS[flat] if top < len(_BITS) else np.searchsorted(_FROM, flat, side="right").astype(np.uint8)
    # the narrowest width that holds every id fits everywhere; narrower ones are looked for where they can be
    common = max((s for s, (_, w) in enumerate(SELECTORS) if s != ESCAPE and 1 << w > top), key=lambda s: SELECTORS[s][0], default=None)
    choice = np.full(len(flat), ESCAPE if common is None else common, np.uint8)
    at = np.flatnonzero(bits <= 60) if common is None else None
    for s in range(15 if common is None else common - 1, -1, -1):  # from few wide ids to many narrow ones: the last that fits wins
        if s != ESCAPE:
            count, width = SELECTORS[s]
            at = np.flatnonzero(bits <= width) if at is None else at[bits[at] <= width]
            if len(at) >= count:
                choice[at[: len(at) - count + 1][at[count - 1 :] - at[: len(at) - count + 1] == count - 1]] = s
    lens = np.full(blocks, BLOCK)
    lens[-1] = n - (blocks - 1) * BLOCK
    choice = choice.reshape(blocks, ROW)
    row, pos = np.arange(blocks), np.zeros(blocks, np.int64)
    rows, starts = [], []
    while len(row):  # one word of every block at a time
        rows.append(row)
        starts.append(pos)
        pos = pos + _COUNT[choice[row, pos]]
        more = pos < lens[row]
        row, pos = row[more], pos[more]
    rows = np.concatenate(rows)
    order = np.argsort(rows.astype(np.uint16) if blocks < 1 << 16 else rows, kind="stable")
    rows, starts = rows[order], np.concatenate(starts)[order]
    begin = rows * ROW + starts
    chosen = choice.ravel()[begin]
    size = np.where(chosen == ESCAPE, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        m = chosen == s
        if s == ESCAPE:
            words[where[m]] = np.uint64(ESCAPE) << np.uint64(60)
            words[where[m] + 1] = flat[begin[m]]
            continue
        count, width = SELECTORS[s]
        word = np.full(int(m.sum()), np.uint64(s) << np.uint64(60), np.uint64)
        from_ = begin[m]
        for k in range(count if width else 0):
            word |= flat[from_ + k] << np.uint64(k * width)
        words[where[m]] = word
    return words, where[np.searchsorted(rows, np.arange(blocks))].astype(np.uint64), bool((chosen == ESCAPE).any())


def decode(words: np.ndarray, first: np.ndarray, n: int, escapes: bool) -> np.ndarray:
    """The ids. All blocks decode together; where there are escapes, raw words are told apart first."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.uint8)
    at = np.arange(len(words))
    if escapes:
        head, k = np.ones(len(words), bool), 0
        while k < len(words):
            if sel[k] == ESCAPE:
                head[k + 1] = False
                k += 1
            k += 1
        at = np.flatnonzero(head)
        sel = sel[at]
    first = first.astype(np.int64)
    lead = np.searchsorted(at, first)
    block = np.repeat(np.arange(len(first)), np.diff(np.append(lead, len(at))))
    counts = _COUNT[sel]
    total = np.cumsum(counts) - counts
    start = total - total[lead][block] + block * ROW
    out = np.zeros(len(first) * ROW, np.uint64)
    for s in np.unique(sel).tolist():
        m = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[m]] = words[at[m] + 1]
            continue
        count, width = SELECTORS[s]
        mask, word, to = np.uint64((1 << width) - 1), words[at[m]], start[m]
        for k in range(count if width else 0):
            out[to + k] = (word >> np.uint64(k * width)) & mask
    return out.reshape(-1, ROW)[:, :BLOCK].ravel()[:n]


def file_bytes(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    words, first, escapes = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(first), len(words), int(escapes)], "<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), nulls.tobytes(), np.array(counts, "<u8").tobytes(), first.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def parse(data: bytes):
    """(doc ids with None for null, ids per document, ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, words, escapes = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
    at = 48
    keys = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, at := at + docs)
    first = np.frombuffer(data, "<u8", blocks, at := at + 8 * docs)
    body = np.frombuffer(data, "<u8", words, at + 8 * blocks)
    return [None if z else int(k) for k, z in zip(keys, nulls)], counts.astype(np.int64), decode(body, first, n, bool(escapes))


def _put(where: str, name: str, data: bytes) -> None:
    """Under another name first, so that a file is whole or not there, whichever attempt wrote it."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(where)
    system.create_dir(root, recursive=True)
    part = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{root}/{name}")


def _ordered(d: DataFrame) -> DataFrame:
    """Ranges of ids, sorted. The ranges are found from the ids alone; only if an id fills a range, rows that repeat it
    are split by their texts, which takes a pass over these."""
    parts, keys = shuffle_partitions(d.sparkSession), ["doc_id", F.xxhash64("text")]
    cuts = d.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    if not cuts or len(set(cuts)) < len(cuts):
        return d.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at, steps = F.array(*map(F.lit, cuts)), [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    # by halving: the number of cuts below the id; nulls come first
    below = lambda n, s: F.when((n + s <= len(cuts)) & (F.get(at, n + s - 1) < F.col("doc_id")), n + s).otherwise(n)
    return d.repartitionById(parts, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), below)).sortWithinPartitions(*keys)


def write_files(docs: DataFrame, where: str, path: str | None = None, end_id: int = 2, ids_per_file: int = 1 << 21) -> list:
    """Write the ids of all documents to files in `where`; (task, ids) of each task that wrote, in order.

    A file's name has its task, its number there and the ids of that task before it; so the order of all files, and
    where each starts, follow from the totals of the tasks, of which there are as many as shuffle partitions.
    """
    spark, path = docs.sparkSession, path or default_path()

    def run(batches):
        enc, end, task, made = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        docs_, counts, parts, size, base = [], [], [], 0, 0

        def put():
            nonlocal made, size, base
            name = f"{task:08d}-{made:06d}-{base:015d}.s8b"
            _put(where, name, file_bytes(docs_, counts, np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)))
            out = pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([size], pa.int64())], names=["task", "n"])
            made, size, base = made + 1, 0, base + size
            for x in (docs_, counts, parts):
                x.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc(text.as_py()) + end
                docs_.append(doc)
                counts.append(len(ids) // 4)
                parts.append(ids)
                size += len(ids) // 4
                if size >= ids_per_file:
                    yield put()
        if docs_:
            yield put()

    made = written(_ordered(id_text(docs)).mapInArrow(run, "task long, n long"), "token-counts")
    totals = sorted((r.task, r.n) for r in made.groupBy("task").agg(F.sum("n").alias("n")).collect())
    dropped(made)
    return totals


def read_files(spark, where: str, totals: list) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    base, starts = 0, {}
    for task, n in totals:
        starts[task] = base
        base += n
    if not totals:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, counts, ids = parse(data.as_py())
                task, _, before = os.path.basename(name).removesuffix(".s8b").split("-")
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - counts + starts[int(task)] + int(before)), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(where).select("path", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark, sf_dir):
    from .common import table

    where = fresh_path(spark, "token-files")
    return read_files(spark, where, write_files(table(spark, sf_dir, "documents"), where))

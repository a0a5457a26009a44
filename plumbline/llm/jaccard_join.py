"""N-gram Jaccard join by a token-group matrix.

Texts with the same words are one entry; so are texts with the same set of fewer than LEAST shingles, which link with
nothing else. Shingles have one global order, rare ones first, by a count sketch over all documents (its errors change
the order's quality, not the result). An entry's prefix is its first n - ceil(0.8 n) + SHARE shingles in that order;
two sets that link share SHARE shingles of both prefixes, so only prefix shingles that several entries have matter. Of
those the matrix says which groups of entries hold them.

First, each such shingle's most central entry is a group of its own, opened by the entries that meet it at SHARE
shingles or more: this links most of every cluster in as many checks as there are entries. Then groups are chunks of
the large components found and, where components are small, chunks of entries with the same most frequent shingle,
always alike in size; so a shingle that very many entries have is in few groups. An entry is a query to a group only
where the group's shingle union has SHARE shingles of its prefix, the sizes admit a link, and the group has an entry of
a component that comes later in one order of all components, by size; so of two entries in different components one
asks, at every shingle that they share. No pair of entries in different components that could link goes unchecked.

Groups hold the entries' words. In an opened one, 64-bit names of shingles tell which pairs may link, and a link is made
only after the shingles themselves are compared; where names deceive, the next pair of the same component is tried.
Entries are named by digests of their words, and read again under another salt should two names be alike. What rests on
names alone is that two shingles of one text have different ones (odds of n * n / 2^65 in a text of n shingles).

Words are lower-cased A-Z; a set is the distinct 5-word shingles, of a shorter text the whole sequence. Texts without
words, null ones among them, are empty and alone; a text of any length is read whole. Rows that repeat a doc_id are rows
of their own; a null id is never a component's id unless all are null. An empty table gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, powers, mix, P64, rolling, shuffle_partitions, words_of, written
from .components import connected
from .window_dedup import Grouped, NULL_ID, _answered, _bits, _runs, _shared, _unzip, _with_answers, _zip, batches, each

SHINGLE = 5
PERCENT = 80
#: Shingles that the prefixes of linked sets have in common, and the least size of a set that links with another.
SHARE, LEAST = 3, 4
#: Cells of the sketch, whatever the corpus: 4 MB where it is read.
CELLS, CELL_ROWS = 1 << 22, 64
GROUP = 512
#: Shingles of a group, about, where its entries are long.
HEAVY = 1 << 20
#: Queries of a shingle's most central entry that are checked together.
QUERIES = 512


def named(words: bytes, salt: int) -> bytes:
    """24 bytes that tell words apart; the first eight are an entry's name."""
    return hashlib.blake2b(words, digest_size=24, salt=salt.to_bytes(8, "little")).digest()


def word_names(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit names of words, as they come; tests make some alike."""
    return hashes


#: (size of a shingle, salt of names, named, word_names): how texts are read, the same in every stage.
Reading = tuple[int, int, Callable, Callable]


def _grams(data: bytes, bounds: np.ndarray, how: Reading) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text in data."""
    size, _, _, word = how
    _, _, hashes, first = words_of(np.frombuffer(data, np.uint8), bounds)
    hashes = word(hashes)
    grams, out = rolling(hashes, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * powers(P64, size)[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(words: bytes, size: int) -> set[bytes]:
    """The shingles themselves of words joined by one space."""
    at = [0, *(i + 1 for i, c in enumerate(words) if c == 32)] if len(words) < 64 else [0, *(np.flatnonzero(np.frombuffer(words, np.uint8) == 32) + 1).tolist()]
    if len(at) <= size:
        return {words} if words else set()
    ends = [i - 1 for i in at[size:]] + [len(words)]
    return {words[a:b] for a, b in zip(at, ends)}


class Sets:
    """The shingle names of each text of a batch, and the words and name of its entry."""

    def __init__(self, batch, how: Reading):
        size, salt, name, _ = how
        data = batch.data.lower()  # of bytes: A-Z only
        self.sets = _grams(data, batch.bounds, how)
        self.words, self.names = [], []
        for s, a, b in zip(self.sets, batch.bounds[:-1].tolist(), batch.bounds[1:].tolist()):
            words = b" ".join(data[a:b].split())
            self.words.append(words)
            self.names.append(name(words if len(s) >= LEAST else b"\n".join(sorted(shingles(words, size))), salt) if len(s) else None)
        self.keys = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in self.names]

    def distinct(self):
        """(key, set, words) of each distinct entry here that isn't empty."""
        return [(k, s, w) for k, (s, w) in {k: (s, w) for k, s, w in zip(self.keys, self.sets, self.words) if k is not None}.items()]


def _cells(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(CELLS - 1)).astype(np.int64)


def _read(texts: DataFrame, how: Reading) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, k and the rest of the name of every row; the sketch as a coarse logarithm of counts per cell)."""

    names = ["doc_id", "n", "k", "rest", "part", "cells"]

    def run(it):
        cells = np.zeros(CELLS, np.uint32)
        for _, batch in each(it):
            s = Sets(batch, how)
            for x in s.sets:
                at = _cells(x)
                cells[at] += cells[at] < np.uint32(0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(batch.ids, pa.int64(), mask=batch.ids == NULL_ID), pa.array([len(x) for x in s.sets], pa.int64()), pa.array(s.keys, pa.int64()), pa.array([x and x[8:] for x in s.names], pa.binary()), pa.nulls(len(s.sets), pa.int32()), pa.nulls(len(s.sets), pa.binary())], names=names)
        if cells.any():
            parts = [_zip(x.tobytes()) for x in np.split(cells, CELL_ROWS)]
            z = pa.nulls(CELL_ROWS, pa.int64())
            yield pa.RecordBatch.from_arrays([z, z, z, pa.nulls(CELL_ROWS, pa.binary()), pa.array(range(CELL_ROWS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    both = written(texts.mapInArrow(run, "doc_id long, n long, k long, rest binary, part int, cells binary"), "sets-read")

    def add(it):
        held: dict[int, np.ndarray] = {}
        for b in it:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(_unzip(data.as_py()), np.uint32)
                held[part] = held[part] + x if part in held else x.astype(np.uint64)
        for part, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(2 * np.log2(1.0 + x)).astype(np.uint8).tobytes()])], names=["part", "log"])

    log = np.zeros((CELL_ROWS, CELLS // CELL_ROWS), np.uint8)
    for r in both.where("part is not null").select("part", "cells").repartition(CELL_ROWS, "part").mapInArrow(add, "part int, log binary").collect():  # 4 MB
        log[r.part] = np.frombuffer(r.log, np.uint8)
    return both.where("part is null").select("doc_id", "n", "k", "rest"), log.ravel()


def _prefix(s: np.ndarray, log: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Prefix of a set in the global order, and how common its shingles are on the whole."""
    often = log[_cells(s)]
    size = len(s) - -(-percent * len(s) // 100) + SHARE
    return s[np.lexsort((s, often))[:size]], int(100 * often.mean())


def _entries(texts: DataFrame, log: np.ndarray, how: Reading, percent: int) -> DataFrame:
    """Rows (token, k, n, score) for prefix shingles seen elsewhere too, and a row (k, n, words) for each such entry."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(log)
    parts = shuffle_partitions(spark)
    buckets = 4 * parts

    def prefixes(batch):
        out = [(k, s, w, *_prefix(s, sent.value, percent)) for k, s, w in Sets(batch, how).distinct() if len(s) >= LEAST]
        return out, (np.concatenate([p for _, _, _, p, _ in out]) if out else np.zeros(0, np.uint64))

    def ask(it):
        for n, batch in each(it):
            yield _runs(n, Grouped(prefixes(batch)[1]).keys, buckets)

    answers = _answered(texts.mapInArrow(ask, "bucket int, batch long, run binary"), parts, _shared, "prefix-shingles")

    def emit(it):
        for _, batch, got in each(it):
            out, keys = prefixes(batch)
            if not len(keys):
                continue
            g = Grouped(keys)
            flags = g.spread(_bits(got, g.keys, buckets) | (g.sizes > 1))
            at, token, owner, rest = 0, [], [], []
            for k, s, w, p, score in out:
                hit = p[flags[at : at + len(p)]]
                at += len(p)
                if len(hit) >= SHARE:  # with fewer there is no link
                    token.append(hit)
                    owner.append(np.full(len(hit), len(rest)))
                    rest.append((k, len(s), score, _zip(w)))
            if not rest:
                continue
            token, owner = np.concatenate(token).view(np.int64), np.concatenate(owner)
            ks, ns, scores, members = (list(c) for c in zip(*rest))
            k, n, score = (np.array(x, np.int64) for x in (ks, ns, scores))
            names = ["token", "k", "n", "score", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(k[owner]), pa.array(n[owner]), pa.array(score[owner]), pa.nulls(len(token), pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ks), pa.int64()), pa.array(k), pa.array(n), pa.array(score), pa.array(members, pa.binary())], names=names)

    return written(_with_answers(texts, answers).mapInArrow(emit, "token long, k long, n long, score long, words binary"), "entries")


#: Bytes of words that are made into shingle names at a time.
SLICE = 1 << 19


def _sliced(batches):
    """The rows of Arrow batches, the last column unpacked, in lists of about SLICE bytes of words."""
    held, size = [], 0
    for b in batches:
        columns = [c.to_pylist() for c in b.columns[:-1]]
        for row, words in zip(zip(*columns), b.columns[-1]):
            held.append((*row, _unzip(words.as_py())))
            size += len(held[-1][-1])
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


class Group:
    """An opened group: its entries by the names of their shingles."""

    def __init__(self, inside, size: int):
        self.keys, self.words = [k for k, _, _, _ in inside], [w for _, _, _, w in inside]
        self.roots, self.sizes = np.array([r for _, r, _, _ in inside]), np.array([len(s) for _, _, s, _ in inside])
        tokens = np.concatenate([s for _, _, s, _ in inside])
        owner = np.repeat(np.arange(len(inside)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.size, self.sets = size, {}

    def links(self, s: np.ndarray, root: int, words: bytes, percent: int):
        """The key of one entry of each other root that links with words: names propose, shingles decide."""
        lo, hi = np.searchsorted(self.tokens, s), np.searchsorted(self.tokens, s, side="right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        common = np.bincount(self.owner[at], minlength=len(self.keys))
        ok = np.flatnonzero((100 * common >= percent * (self.sizes + len(s) - common)) & (self.roots != root))
        if not len(ok):
            return
        own, done = shingles(words, self.size), set()
        for i in ok.tolist():
            r = int(self.roots[i])
            if r not in done:
                if i not in self.sets:
                    self.sets[i] = shingles(self.words[i], self.size)
                both = len(own & self.sets[i])
                if 100 * both >= percent * (len(own) + len(self.sets[i]) - both):
                    done.add(r)
                    yield self.keys[i]


def _opened(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int, how: Reading, name: str) -> DataFrame:
    """members and queries are (g, k, root): check each query of a group against the group's entries; links (a, b).

    One link of a query to each root is enough, as what has one root belongs together already.
    """

    def run(it):
        now, inside, group = None, [], None
        for rows in _sliced(it):
            bounds = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(r[-1]) for r in rows], out=bounds[1:])
            a, c = [], []
            for (g, asks, k, root, words), s in zip(rows, _grams(b"".join(r[-1] for r in rows), bounds, how)):
                if g != now:
                    now, inside, group = g, [], None
                if not asks:
                    inside.append((k, root, s, words))
                elif inside:
                    group = group or Group(inside, how[0])
                    for other in group.links(s, root, words, percent):
                        a.append(k)
                        c.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    rows = members.withColumn("asks", F.lit(False)).union(queries.withColumn("asks", F.lit(True)))
    # the same join at every size: words go to where they are asked for
    full = rows.hint("merge").join(sets, "k").select("g", "asks", "k", "root", "words")
    return written(full.repartition("g").sortWithinPartitions("g", "asks").mapInArrow(run, "a long, b long"), name)


def _roots(entries: DataFrame, how: Reading, percent: int) -> DataFrame:
    """(k, root) of the entries that link with another."""
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    sets = written(entries.where("words is not null").groupBy("k").agg(F.first("words").alias("words")), "entry-sets")
    tokens = entries.where("words is null").select("token", "k", "n", "score").distinct()
    held = tokens.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max(F.struct("score", "k", "n")).alias("p")).where("lo <> hi")
    tokens = written(tokens.hint("merge").join(held.select("token", F.col("p.k").alias("p"), F.col("p.n").alias("pn")), "token"), "matrix")
    dropped(entries)
    # groups of one: the most central entry at each shingle
    meet = tokens.where((F.col("k") != F.col("p")) & fits(F.col("n"), F.col("pn"))).groupBy("p", "k").agg(F.count(F.lit(1)).alias("c"))
    ask = written(meet.where(F.col("c") >= SHARE).select("p", "k"), "first-queries")
    # a table of its own, so that the join below may split a shingle's queries where they are many
    shares = written(ask.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares")), "shares")
    members = shares.select(F.col("p"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("p").alias("k"))
    queries = ask.hint("merge").join(shares, "p").select("p", F.pmod(F.xxhash64("k"), F.col("shares")).cast("int").alias("share"), "k")
    named = lambda d: d.select(F.xxhash64("p", "share").alias("g"), "k", F.col("k").alias("root"))
    first = _opened(named(members), named(queries), sets, percent, how, "first-links")
    roots = written(connected(first), "first-roots")
    dropped(ask, shares)
    # groups of many: chunks of components
    rooted = written(tokens.hint("merge").join(roots, "k", "left").select("token", "k", "n", F.coalesce("root", "k").alias("root")), "rooted")
    per = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("often")).where("lo <> hi").select("token", "often")
    mixed = written(rooted.hint("merge").join(per, "token"), "mixed")
    dropped(rooted)
    alike = written(mixed.groupBy("k").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.max(F.struct("often", "token")).alias("lead")), "alike")
    sizes = alike.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    large = F.col("c") >= GROUP
    parted = alike.join(sizes, "root").select("k", "n", "c", F.struct(large.alias("large"), F.when(large, F.col("root")).otherwise(F.col("lead.token")).alias("x")).alias("by"))
    # by entries and, where these are long, by shingles
    slots = parted.groupBy("by").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / HEAVY)).alias("slots"))
    band = F.floor(F.log(1.25, F.col("n")))
    held = written(parted.join(slots, "by").select("k", "c", F.xxhash64("by", band, F.pmod(F.xxhash64("k"), F.col("slots"))).alias("g")), "groups")
    grouped = written(mixed.hint("merge").join(held, "k").select("token", "k", "n", "root", "c", "g"), "grouped")
    dropped(mixed)
    unions = grouped.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.struct("c", "root")).alias("top"))
    asking = grouped.select("token", "k", F.col("n").alias("qn"), "root", "c")
    later = (F.col("top.c") > F.col("c")) | ((F.col("top.c") == F.col("c")) & (F.col("top.root") > F.col("root")))
    open_ = asking.hint("merge").join(unions, "token").where(later & (100 * F.col("most") >= percent * F.col("qn")) & (100 * F.col("qn") >= percent * F.col("least")))
    queries = written(open_.groupBy("g", "k", "root").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= SHARE).select("g", "k", "root"), "queries")
    members = grouped.select("g", "k", "root").distinct().join(queries.select("g").distinct(), "g", "left_semi")
    rest = _opened(members, queries, sets, percent, how, "links")
    out = connected(first.union(rest))
    dropped(sets, tokens, roots, alike, held, grouped, queries, first, rest)
    return out


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, batch_bytes: int = 1 << 20, name: Callable = named, words: Callable = word_names) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id. percent must be over 75, for LEAST to hold."""
    if not 75 < percent <= 100:
        raise ValueError("percent must be over 75 and at most 100")
    texts = batches(docs, batch_bytes)
    for salt in itertools.count():
        how = (size, salt, name, words)
        rows, log = _read(texts, how)
        if rows.where("k is not null").groupBy("k").agg(F.min("rest").alias("x"), F.max("rest").alias("y")).where("x <> y").isEmpty():
            break
        dropped(rows)
    entries = _entries(texts, log, how, percent)
    dropped(texts)
    roots = _roots(entries, how, percent)
    each_set = rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"))
    each_set = each_set.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    ids = each_set.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(each_set.join(ids, "root").select("k", "component_id"), "components")
    return rows.join(of, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6(spark, sf_dir):
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"))

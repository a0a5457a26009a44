"""Benchmark decontamination, in DataFrame functions only.

A document leaks an item if some window of it, as many words long as the item, has a weighted-shingle similarity of
THRESHOLD or more: the weight of the item's five-word shingles that are in the window over the weight of all its
shingles. Shingles that fewer items share weigh more. Words are runs of letters and digits, in lower case.

Windows are laid where a document has a shingle of an item (without one no similarity is reached, so none is missed).
Each window has a 64-bit SimHash. Item fingerprints are indexed in 8 blocks of 8 bits with every value up to 2 bits
away: of any two fingerprints at most RADIUS = 23 bits apart some block is at most 2 apart, so the equality join on
(block, value) finds all fingerprints within the radius. A SimHash counts all shingles alike, so where items share
many, a window of high weighted similarity can be further away. No radius is safe then; such windows are found by the
item's rarest shingles, RARE in items(): those that leave too little weight for a leak if a document has none of them.
Exact similarity then decides; hamming is what the fingerprints differ by, and may be over RADIUS.

Null and empty texts, on either side, leak nothing; an item of fewer than five words is one shingle. Rows are
judged by their texts; leaks() has a row for each id and item, with the best window of all rows of that id, and a null
id is an id like others. leak_rows() tells the texts of one id apart. Of a document's windows on an item the most
similar one is reported, of those the one fewest bits apart, then the first; a window that begins before its document
starts at 0. Texts are read whole; an empty table on either side gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, id_text, let, table_bytes, written

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bytes on disk up to which a table is broadcast; most are hashes, which don't compress. Beyond, it is shuffled.
BROADCAST_BYTES = 8 << 20
_MASKS = [0] + [1 << a for a in range(8)] + [1 << a | 1 << b for a in range(8) for b in range(a)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """64-bit hashes of the 5-word shingles in order; the whole sequence as one if there are fewer words."""
    return let(words, _shingles_of)


def _shingles_of(words: Column) -> Column:
    n = F.size(words)
    return F.when(n == 0, F.expr("cast(array() as array<bigint>)")).when(
        n < SHINGLE, F.array(F.xxhash64(F.concat_ws(" ", words)))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)]))))


def _cut(words: Column, m: int) -> Column:
    """Every window of m words, m under five, as (pos, h, m)."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - m, F.lit(0))),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(m)])).alias("h"), F.lit(m).alias("m")),
    )


def _simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in more than half of the hashes."""
    return let(hashes, _simhash_of)


def _simhash_of(hashes: Column) -> Column:
    return F.aggregate(
        F.array(*[F.struct(F.lit(b).alias("b"), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long").alias("v")) for b in range(64)]),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.when(2 * F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(h.bitwiseAND(x["v"]) != 0, 1).otherwise(0)) > F.size(hashes), x["v"]).otherwise(F.lit(0).cast("long"))),
    )


def _sized(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast only if it has few bytes."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per item: its words, shingles, their weights and its fingerprint.

    rare are its heaviest shingles, of which any window with the threshold's share of the weight has one at least.
    """
    b = id_text(benchmark, id_col, text_col).withColumnRenamed("doc_id", "item_id").withColumn("_w", _words(F.col("text")))
    b = b.select("item_id", F.size("_w").alias("m"), _shingles(F.col("_w")).alias("hs")).where("m > 0")
    b = written(b.select("item_id", "m", "hs", _simhash(F.col("hs")).alias("fp")), "items")
    h = b.select("item_id", F.explode(F.array_distinct("hs")).alias("h"))
    # the rarer a shingle among the items, the more it weighs: 1000 for one item's, less by its number of items
    weight = h.groupBy("h").agg(F.countDistinct("item_id").alias("n")).select("h", F.greatest(F.lit(1), F.floor(1000 / F.col("n"))).cast("long").alias("w"))
    rows = b.select("item_id", "m", "fp", "hs", F.explode(F.array_distinct("hs")).alias("h")).join(weight, "h")
    per = rows.groupBy("item_id", "m", "fp", "hs").agg(F.sort_array(F.collect_list(F.struct("w", "h")), asc=False).alias("by"), F.sum("w").alias("total"))
    # what is left without the first ones; as soon as that is too little, they are enough
    left = F.aggregate("by", F.struct(F.col("total").alias("left"), F.lit(0).alias("n")), lambda a, x: F.when(a["left"] / F.col("total") >= threshold, F.struct((a["left"] - x["w"]).alias("left"), (a["n"] + 1).alias("n"))).otherwise(a))
    rare = F.transform(F.slice("by", F.lit(1), left["n"]), lambda x: x["h"])
    return written(per.select("item_id", "m", "fp", "hs", F.transform("by", lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("ws"), "total", rare.alias("rare")), "weighted-items")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _best(found: DataFrame, *by: str) -> DataFrame:
    best = found.groupBy(*by, "item_id").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"))).alias("x"))
    return best.select(*by, "item_id", (-F.col("x.s")).alias("start"), (-F.col("x.h")).alias("hamming"), "x.similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best window of each document and item that leak: doc_id, item_id, start (word), hamming, similarity."""
    return _best(leak_rows(docs, benchmark, threshold), "doc_id")


def leak_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same for each doc_id and text: doc_id, text_hash (of the text), item_id, start, hamming, similarity."""
    it = items(benchmark, threshold=threshold)
    keys = it.select("item_id", "m", "rare", F.posexplode("hs").alias("q", "h")).withColumn("rare", F.array_contains("rare", F.col("h")))
    keys = written(keys, "item-shingles")
    known = _sized(written(keys.select("h").distinct(), "known-shingles"))
    texts = id_text(docs).withColumn("text_hash", text_hash(F.col("text")))
    of_text = _shingles(_words(F.col("text")))
    # short items are one shingle of fewer words; a window of that many words has to be cut for them
    short = sorted(r.m for r in it.where(F.col("m") < SHINGLE).select("m").distinct().collect())  # 4 at most
    if short:
        cut = let(_words(F.col("text")), lambda w: F.concat(*[_cut(w, m) for m in short]))
        tiny = texts.select("doc_id", "text_hash", F.explode(cut).alias("x")).select("doc_id", "text_hash", "x.*")
        tiny = tiny.join(it.where(F.col("m") < SHINGLE).select("item_id", "m", F.col("hs")[0].alias("h")), ["h", "m"]).groupBy("doc_id", "text_hash", "item_id").agg(F.min("pos").cast("long").alias("start"))
        tiny = tiny.select("doc_id", "text_hash", "item_id", "start", F.lit(0).alias("hamming"), F.lit(1.0).alias("similarity"))
    # texts with any item shingle, found without carrying them along; from there on each row has a number of its own
    some = written(texts.select("text_hash", F.explode(of_text).alias("h")).join(known, "h", "left_semi").select("text_hash").distinct(), "touched")
    near = texts.join(_sized(some), "text_hash", "left_semi").select("doc_id", "text_hash", of_text.alias("hs"), F.monotonically_increasing_id().alias("row"))
    near = written(near, "touched-docs")
    place = near.select("row", F.posexplode("hs").alias("pos", "h")).join(_sized(keys), "h")
    starts = place.select("row", "m", (F.col("pos") - F.col("q")).alias("start")).where(f"m >= {SHINGLE}").distinct()
    # the part of the window that is in the document
    lo, hi = F.greatest(F.col("start"), F.lit(0)), F.col("start") + F.col("m") - SHINGLE + 1
    part = F.slice("hs", lo + 1, F.greatest(F.least(hi, F.size("hs")) - lo, F.lit(1)))
    windows = starts.join(near, "row").select("row", "doc_id", "text_hash", "m", "start", part.alias("win"))
    windows = written(windows.withColumn("fp", _simhash(F.col("win"))), "windows")
    # documents and items that have a rare shingle in common; their windows are laid by all that they have in common
    met = written(place.where(F.col("rare") & (F.col("m") >= SHINGLE)).select("row", "item_id").distinct(), "rare-pairs")
    laid = place.join(_sized(met), ["row", "item_id"], "left_semi").select("row", "item_id", "m", (F.col("pos") - F.col("q")).alias("start")).distinct()
    block = lambda fp, k: F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")
    index = it.select("item_id", "m", F.col("fp").alias("item_fp"), F.explode(F.array(*[F.struct(F.lit(k).alias("block"), block(F.col("fp"), k).alias("at")) for k in range(BLOCKS)])).alias("b"))
    index = index.select("item_id", "m", "item_fp", "b.block", F.explode(F.array(*[F.col("b.at").bitwiseXOR(F.lit(x)) for x in _MASKS])).alias("value"))
    place_of = ["row", "m", "start"]
    cut = windows.select(*place_of, "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), block(F.col("fp"), k).alias("value")) for k in range(BLOCKS)])).alias("b")).select(*place_of, "fp", "b.*")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    found = cut.join(_sized(written(index, "simhash-index")), ["m", "block", "value"]).withColumn("hamming", apart).where(F.col("hamming") <= RADIUS)
    # a pair that agrees in several blocks counts in the first of them
    agree = lambda k: F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("item_fp")), 8 * k).bitwiseAND(F.lit(255))) <= NEAR
    first = F.coalesce(*[F.when(agree(k), F.lit(k)) for k in range(BLOCKS)])
    pairs = found.where(F.col("block") == first).select(*place_of, "item_id", "hamming")
    prints = _sized(written(it.select("item_id", F.col("fp").alias("item_fp")), "item-prints"))
    far = laid.join(windows.select(*place_of, "fp"), place_of).join(prints, "item_id").withColumn("hamming", apart).where(F.col("hamming") > RADIUS)
    pairs = pairs.union(far.select(*pairs.columns)).join(windows.drop("fp"), place_of).join(_sized(written(it.select("item_id", "ws", "total"), "item-weights")), "item_id")
    got = F.aggregate("ws", F.lit(0).cast("long"), lambda a, x: a + F.when(F.array_contains("win", x["h"]), x["w"]).otherwise(F.lit(0).cast("long")))
    sure = pairs.select("doc_id", "text_hash", "item_id", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start"), "hamming", (got / F.col("total")).alias("similarity")).where(F.col("similarity") >= threshold)
    out = written(_best(sure, "doc_id", "text_hash"), "leaks")
    dropped(near, windows, met, some)
    return out.unionByName(tiny) if short else out


def op7(spark, sf_dir):
    from .common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

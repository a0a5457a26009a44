"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Nulls and empty texts count no words and fail; null ids stay null. Every input row gives one output row, so repeated
rows and ids stay, and an empty table gives none. Texts of any length are judged whole. Columns of the input don't
meet those of the output: only id and text are read, and kept_rows() carries the rest along in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, let

#: Regular expressions of runs: symbols, ASCII capitals, and ASCII digits and punctuation.
SYMBOLS, UPPER, MARKS = "[#*$%&|<>]+", "[A-Z]+", "[!-@\\x5b-\\x60{-~]+"

#: Common function words of some languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by at this have from or are an but not "
    "de la le les et des un une en du que qui dans pour par sur au avec plus est ce il elle "
    "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es zu "
    "el los las se del por con una su para al lo como más o pero sus ha"
).split()


@dataclass(frozen=True)
class Threshold:
    """Keep a document only if low <= metric <= high; None leaves that side open. Waived where `unless` holds."""

    metric: str
    low: float | None = None
    high: float | None = None
    unless: Threshold | None = None

    def holds(self) -> Column:
        sides = [F.col(self.metric) >= F.lit(self.low)] * (self.low is not None) + [F.col(self.metric) <= F.lit(self.high)] * (self.high is not None)
        out = F.lit(True)
        for side in sides:
            out = out & side
        return out | self.unless.holds() if self.unless else out


#: The table: metrics are the columns of metrics(). Wide enough for clean prose in any script: a text without known stop
#: words may be of another language, so their share counts only where much of it is digits and punctuation as well.
TABLE = (
    Threshold("n_words", low=50),
    Threshold("mean_word_chars", low=2.0, high=14.0),
    Threshold("symbol_ratio", high=0.10),
    Threshold("stop_word_ratio", low=0.02, unless=Threshold("mark_ratio", high=0.20)),
    Threshold("upper_ratio", high=0.60),
    Threshold("bang_ratio", high=0.30),
    Threshold("dup_line_ratio", high=0.50),
    Threshold("repeat_word_ratio", high=0.50),
)


def _count(text: Column, runs: str) -> Column:
    """Characters of text in these runs."""
    return (F.length(text) - F.length(F.regexp_replace(text, runs, ""))).cast("long")


def names_of(a: Column, b: Column, c: Column) -> Column:
    """The 64-bit name of a window of three words."""
    return F.xxhash64(a, b, c)


def repeat_words(words: Column, name=names_of) -> Column:
    """Words inside 3-word windows found twice or more.

    Where all windows' names differ, the windows do. Elsewhere windows are sorted by name and then by their words, so
    that equal ones are neighbours, and neighbours are compared by their words.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0)))
    window = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    names = F.when(F.size(words) > 2, F.transform(at, lambda i: name(*window(i))))
    full = F.transform(at, lambda i: F.struct(name(*window(i)).alias("g"), *[w.alias(n) for w, n in zip(window(i), "abc")], i.alias("p")))

    def covered(s: Column) -> Column:
        same = lambda x, y: (x["g"] == y["g"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        again = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(1))), lambda x, y: F.when(same(x, y), F.array(x["p"], y["p"])))
        starts = F.sort_array(F.flatten(F.filter(again, lambda x: x.isNotNull())))
        return F.aggregate(
            starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    differ = let(names, lambda x: x.isNull() | (F.size(F.array_distinct(x)) == F.size(x)))
    return F.when(differ, F.lit(0).cast("long")).otherwise(let(F.array_sort(full), covered))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = (), name=names_of) -> DataFrame:
    """One row per document: the base counts and the ratios that TABLE names.

    Line equality is exact; a line counts if it has a word. Null text counts as no text.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    also = d.columns[2:]
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WS_CLASS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    d = d.select("doc_id", "text", *also, words.alias("_w"), lines.alias("_l"))
    d = d.select(
        "doc_id", *also,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        let(F.col("_w"), lambda w: repeat_words(w, name)).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("stop_words"),
        _count(text, UPPER).alias("_upper"), _count(text, MARKS).alias("_marks"), _count(text, "!+").alias("_bangs"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")

    return d.withColumn("_letters", F.col("word_chars") - F.col("_marks")).select(
        "doc_id", *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_words",
        ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("stop_words", "n_words").alias("stop_word_ratio"), ratio("_marks", "word_chars").alias("mark_ratio"),
        ratio("_upper", "_letters").alias("upper_ratio"), ratio("_bangs", "n_words").alias("bang_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def compiled(rules=TABLE) -> Column:
    """The whole table as one boolean Column over the metrics."""
    out = F.lit(True)
    for r in rules:
        out = out & r.holds()
    return out


def quality(docs: DataFrame, rules=TABLE, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """Base counts, base_failed and kept for every document, in one narrow projection; carry columns come along."""
    m = metrics(docs, id_col, text_col, carry)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def kept_rows(docs: DataFrame, rules=TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows to keep, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return quality(docs, rules, id_col, text_col, (row,)).where("kept").select("_row.*")


def op9(spark, sf_dir):
    from .common import table

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

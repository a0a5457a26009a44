"""Secret scans by one combined deterministic automaton.

All rule regexes are compiled, by subset construction and minimisation, into one transition table; a single pass over
a text's bytes tells which rules occur in it. Only in texts where a rule occurs are its spans resolved, by the same
construction for that rule alone: first end forward, leftmost start backward, longest end forward.

Null and empty texts have no spans; null ids stay null. Every input row gives one output row, repeated ones too, and an
empty table none. Where rules match at one start, spans are in the rules' order. Offsets are code points, ends exclusive.
A text's cost grows with its length. scan() reads id and text alone; redact() keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .automaton import Automaton, compiled
from .common import bounded, id_text, lean


@dataclass(frozen=True)
class Rule:
    """min_chars counts the whole match, or what follows head if there is one. Shorter matches are consumed and dropped.

    A match runs on over tail, as far as that goes; tail must match the empty text too and end on ASCII.
    """

    kind: str
    pattern: str
    min_chars: int = 1
    head: str | None = None
    fold: bool = False
    tail: str = ""


_ASSIGN = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"

#: hex and access say their least length in the pattern: a maximal run is the match either way.
BASE = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 8, _ASSIGN, True),
    Rule("access", "AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
)

#: A PEM key's body. Line ends may be written as \n or \r; lines may be indented, quoted or joined by + or commas.
_EOL = "(\\x0d|\\x0a|\\\\r|\\\\n)"
_GAP = "\\x20\\x09\"'>#*+,;|"
_B64 = "[A-Za-z0-9+/=]"
_FIELD = "[A-Za-z][A-Za-z0-9-]*:[\\x09\\x20-\\x5b\\x5d-\\x7e\\x80-\\xff]*"
#: Up to an END line, all that is base64, header fields and space. Without one, the base64 that begins each line and
#: runs of 40 or more behind a gap with what follows them: a word after the key may go too, but no part of it stays.
_PEM_TAIL = (
    f"(([A-Za-z0-9/={_GAP}]|{_EOL}|{_EOL}[{_GAP}]*{_FIELD})*-----END( [A-Z0-9]+)* PRIVATE KEY-----"
    f"|(([{_GAP}]*{_EOL})+[{_GAP}]*({_FIELD}({_EOL}[{_GAP}]*)+)*{_B64}+|[{_GAP}]*{_B64}{{40,}}([{_GAP}]*{_B64}+)?)*)"
)

#: Published shapes of keys and tokens (fixed values).
MORE = (
    Rule("private_key", "-----BEGIN( [A-Z0-9]+)* PRIVATE KEY-----", tail=_PEM_TAIL),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30),
)

RULES = BASE + MORE


class Scanner:
    """Rules compiled once on the driver; what is shipped to executors is arrays."""

    def __init__(self, rules=RULES):
        self.rules = tuple(rules)
        self.all: Automaton = compiled([(r.pattern, r.fold) for r in self.rules], search=True)
        one = [(r.pattern, r.fold) for r in self.rules]
        self.search = [compiled([p], search=True) for p in one]
        self.back = [compiled([p], search=False, backward=True) for p in one]
        self.run = [compiled([(r.pattern + r.tail, r.fold)], search=False) for r in self.rules]
        self.head = [compiled([(r.head, r.fold)], search=False) if r.head else None for r in self.rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start byte, rule, end byte) of every match kept, sorted."""
        hits = self.all.hits(data)
        out = []
        for k, rule in enumerate(self.rules):
            if not hits >> k & 1:
                continue
            lo, classes = 0, self.search[k].classes(data)
            while (end := self.search[k].first_end(classes, lo)) >= 0:
                start = self.back[k].furthest_start(data, lo, end)
                end = self.run[k].longest(data, start)
                body = self.head[k].longest(data, start) if self.head[k] else start
                if end - body >= rule.min_chars:
                    out.append((start, k, end))
                lo = end
        return sorted(out)

    def text_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """The same in code points."""
        if not text:
            return []
        data = text.encode()
        found = self.spans(data)
        if not found or len(data) == len(text):
            return found
        cuts, chars, done = {}, 0, 0
        for b in sorted({x for a, _, b in found for x in (a, b)}):  # matches start and end at ASCII, between characters
            chars += len(data[done:b].decode())
            cuts[b], done = chars, b
        return [(cuts[a], k, cuts[b]) for a, k, b in found]


def _scanned(scanner: Scanner, n_base: int):
    kinds = [r.kind for r in scanner.rules]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            counts, shas, spans = [[] for _ in range(n_base)], [], []
            for t in texts:
                found = scanner.text_spans(t.as_py())
                say = [f"{kinds[k]}:{a}:{b}" for a, k, b in found]
                base = [s for s, (_, k, _) in zip(say, found) if k < n_base]
                for k in range(n_base):
                    counts[k].append(sum(f[1] == k for f in found))
                shas.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                spans.append(",".join(say))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in kinds[:n_base]), "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, rules=RULES, n_base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the first n_base kinds, the digest of their spans, and all spans, for every document."""
    scanner = Scanner(rules)
    fields = "".join(f", n_{r.kind} long" for r in scanner.rules[:n_base])
    return id_text(docs, id_col, text_col).mapInArrow(_scanned(scanner, n_base), f"doc_id long{fields}, base_sha256 string, spans string")


def redact(docs: DataFrame, rules=RULES, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The same columns with each secret replaced by [kind]; overlapping spans merge under the first one's kind.

    Documents without secrets come through unchanged, null text stays null. count_col, if there is such a column and it
    has a type of whole numbers, is kept true for the texts changed; any other column of that name is left as it is.
    """
    bounded(docs.sparkSession)
    scanner = Scanner(rules)
    kinds = [r.kind for r in scanner.rules]
    at = docs.columns.index(text_col)
    whole = [f.name for f in docs.schema.fields if isinstance(f.dataType, IntegralType)]
    chars = docs.columns.index(count_col) if count_col in whole else None

    def run(batches):
        for batch in lean(batches):
            arrays = list(batch.columns)
            texts, changed = arrays[at].to_pylist(), {}
            for i, t in enumerate(texts):
                if t and (found := scanner.text_spans(t)):
                    out, done, last = [], 0, -1
                    for a, k, b in found:
                        if a >= last:
                            out += [t[done:a], f"[{kinds[k]}]"]
                        last = done = max(last, b)
                    changed[i] = texts[i] = "".join(out) + t[done:]
            if changed:
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                if chars is not None:
                    n = arrays[chars].to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    arrays[chars] = pa.array(n, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op8(spark, sf_dir):
    from .common import table

    return scan(table(spark, sf_dir, "documents")).withColumn("n_spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long"))

"""Each operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns; and the queries against their SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import chat, decontaminate, jaccard_join, licenses, packing, quality, queries, secrets, substring_dedup, suffix_dedup, token_files

SF = "/root/testdata/sf0.001"
#: Columns named like those that the operators make or read.
CLASH = "doc_id long, text string, n_chars string, batch int, row int, k long, _row string, h long, n_words string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, None) for i, t in rows], CLASH)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    long = prose(rng, 60_000)
    return [(1, long), (2, long), (3, None), (3, None), (None, ""), (None, prose(rng, 80)), (4, "\n \t"), (5, "é" * 3000), (6, prose(rng, 90)), (6, prose(rng, 70)), (7, "password=abcdefgh12 " * 2000), (8, "one two")]


def bench(spark, rows=((1, "the quick brown fox jumps over the lazy dog and then some"), (2, None), (3, ""), (3, "one two"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "op1": suffix_dedup.dedup_bytes,
    "op2": substring_dedup.dedup_words,
    "op3": packing.pack,
    "op4": licenses.scan_licenses,
    "op6": jaccard_join.jaccard_components,
    "op7": lambda d: decontaminate.leaks(d, bench(d.sparkSession)),
    "op8": secrets.scan,
    "op8 redact": secrets.redact,
    "op9": quality.quality,
    "op9 rows": quality.kept_rows,
    "op10": lambda d: token_files.read_files(d.sparkSession, (w := token_files.fresh_path(d.sparkSession, "files")), token_files.write_files(d, w)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_in_rows_out(spark, rows, name):
    f = OPERATORS[name]
    assert f(table(spark, [])).collect() == []
    got = f(table(spark, rows))
    out = got.collect()
    ids = Counter(r.doc_id for r in out)
    if name in ("op1", "op2", "op6", "op8", "op8 redact", "op9", "op10"):  # a row each
        assert ids == Counter(i for i, _ in rows)
    if name == "op7":
        assert {(r.doc_id, r.item_id, r.start) for r in out} == {(8, 3, 0)}
    if name == "op4":
        assert not out
    if name == "op3":
        assert set(ids) == {i for i, _ in rows} and ids[3] == 2 and ids[1] == ids[2] > 5
    if name == "op1":
        assert {r.doc_id: r.n_removed for r in out if r.doc_id in (1, 2)} == {1: 0, 2: len(rows[1][1])}
    if name == "op8 redact":
        assert got.columns == [c.split()[0] for c in CLASH.split(", ")] and {r.n_chars for r in out} == {"x"}
        assert next(r.text for r in out if r.doc_id == 7) == "[assign] " * 2000


def test_chat_corners(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, place int, p1 string")
    assert chat.format_chats(empty).collect() == []
    rows = [(1, 1, "user", "a" * 100_000, 9, "z"), (1, 1, "user", "a" * 100_000, 9, "z"), (2, None, None, None, 9, "z"), (None, 1, "user", "", 9, "z")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, p1 string")).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(1, 2), (2, 1), (None, 1)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, rows, name, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, table(spark, []), str(tmp_path)).collect() == []
    docs = table(spark, rows)
    out = stage(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    want = {i for i, _ in rows}
    assert ids == {"quality_rules": {1, 2, None, 6}, "ngram_jaccard_join": want - {2}, "benchmark_decontamination": want - {8}}.get(name, want)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def test_secret_columns(spark):
    """The query's counts and digests against the rules as regular expressions."""
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8), ("access", re.compile("AKIA[A-Z0-9]+"), 16), ("hex", re.compile("[0-9a-f]+"), 32)]
    rng = random.Random(5)
    parts = ["password=", "Token: ", "'", "é", "AKIA", "0123456789ABCDEF", "0123456789abcdef", " ", "x.y/z", "\n", "secret"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(900, None)]
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(table(spark, rows)).collect()}
    for d, t in rows:
        spans = [(m.start(), k, m.end()) for k, (_, r, n) in enumerate(rules) for m in r.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= n]
        text = ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[d] == (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())


def test_quality_verdict_in_any_language(spark):
    rng = random.Random(2)
    russian = " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(2, 9))) for _ in range(120))
    polish = " ".join("".join(rng.choice("abcdeęłńośz") for _ in range(rng.randint(2, 9))) for _ in range(120))
    codes = " ".join(f"{rng.randint(0, 10**6)}-{rng.randint(0, 99)}" for _ in range(120))
    docs = [(1, russian), (2, polish), (3, codes), (4, russian + " #" * 40), (5, prose(rng, 100).upper()), (6, "the of and " + prose(rng, 60) + " 12-3" * 10)]
    assert {r.doc_id: r.kept for r in quality.quality(table(spark, docs)).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_repeats_are_told_apart_by_words(spark):
    from pyspark.sql import functions as F

    docs = [(1, "a b c x y z a b c"), (2, "a b c d e f g"), (3, "q w e q w e r"), (4, ""), (5, "one two")]
    name = lambda a, b, c: F.lit(7).cast("long")  # noqa: E731  all windows named alike
    got = {r.doc_id: r.n_repeat_words for r in quality.metrics(table(spark, docs), name=name).collect()}
    assert got == {1: 6, 2: 0, 3: 6, 4: 0, 5: 0}


def test_licenses_against_all_shared_runs(spark):
    """Every diagonal on which template and text share GRAM + WINDOW - 1 words is aligned, not only winnowed ones."""
    rng = random.Random(14)
    names = sorted(licenses.TEMPLATES)
    docs = []
    for n in range(60):
        words = prose(rng, 12).split()
        for name in rng.sample(names, rng.randint(0, 2)):
            notice = licenses.TEMPLATES[name].split()
            for _ in range(rng.randint(0, len(notice) // 10)):
                notice[rng.randrange(len(notice))] = "changed"
            words += notice + prose(rng, rng.randint(0, 9)).split()
        docs.append((n, " ".join(words)))
    index = licenses.Index(licenses.TEMPLATES)
    got = Counter((r.doc_id, r.license, r.n_matched) for r in licenses.scan_licenses(table(spark, docs)).collect())
    want = Counter()
    for d, t in docs:
        words = licenses._WORD.findall(licenses._flat(t.encode()))
        runs, found = licenses.GRAM + licenses.WINDOW - 1, []
        for k, a in enumerate(index.words):
            shifts = {i - j for i in range(len(words) - runs + 1) for j in range(len(a) - runs + 1) if words[i : i + runs] == a[j : j + runs]}
            found += [(k, n, n / len(a), i, j) for n, i, j in licenses.places(a, words, shifts, licenses.COVERAGE)]
        want += Counter((d, index.names[k], n) for k, n, _, _, _ in licenses._foremost(found))
    assert want and not want - got, want - got


def test_packing_stage_keeps_few_chunks(spark, monkeypatch):
    """The pipeline's last stage, beside a full JVM: fewer chunks than op3's and no long ones are kept, with the same pieces."""
    import corpus_pipeline
    from plumbline.llm import packing, tokens

    asked, real = [], packing.pieces
    monkeypatch.setattr(packing, "pieces", lambda *a: asked.append(a[-1]) or real(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}x{j}" for j in range(300)) + " " + "ab" * 500) for i in range(20)], "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.packing_stage(spark, docs, None).collect()))
    assert asked == [corpus_pipeline.CHUNKS] and asked[0] <= tokens.LIMIT // 4
    few = sorted(map(tuple, packing.pack(docs, chunks=40).select(*packing.PIECE.replace(" long", "").replace(" int", "").split(", ")).collect()))
    assert [r[:5] for r in got] == few

    enc = tokens.encoder(tokens.default_path(), 50)
    for i in range(1000):
        text = f"w{i}x " + "ab" * (100 + i)
        assert enc(text) == enc._library(text)
    kept = [*enc.chunks, *enc.chunks.older]
    assert 0 < len(kept) <= 100 and max(map(len, kept)) <= 64


def test_lean_batches_all_come():
    import pyarrow as pa

    from plumbline.llm.common import lean

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (3, 0, 5)]
    assert list(lean(iter(batches))) == batches and list(lean(iter([]))) == []

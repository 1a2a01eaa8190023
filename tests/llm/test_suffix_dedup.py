import hashlib
import random

import pytest

from tessera.llm import queries
from tessera.llm import suffix_dedup as sd


def brute(docs):
    """docs: (order, text) in order; removed bytes, runs and rest of each, by all strings of LENGTH bytes."""
    first, out = {}, []
    for order, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - sd.LENGTH + 1):
            if first.setdefault(data[i : i + sd.LENGTH], (order, i)) != (order, i):
                gone[i : i + sd.LENGTH] = [True] * sd.LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


def test_query_matches_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_suffix_dedup(spark, sf_dir).collect()}
    assert got == {d: x for (d, _), x in zip(docs, brute(docs), strict=True)}


def test_periodic_nested_and_shared_strings(spark):
    random.seed(3)
    word = lambda n: "".join(random.choice("abcdeé") for _ in range(n))
    shared, line = word(260), word(75)
    texts = [None, "", "x" * 99, "x" * 500, "x" * 100, shared, "y" + shared, shared[:150] + word(30) + shared[120:], shared[40:139], shared[40:140] + shared[41:141], "ab" * 300, line * 4, word(3000)]
    texts += [word(60) + line + word(60) for _ in range(40)] + [texts[12][:1500] + word(9) + texts[12][1490:], shared + shared]
    texts += [texts[12]] * 3
    rows = [(i * 7_000_000_000 - 20, t, "old", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_bytes int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.dedup(df).collect()}
    want = brute([(r[0], r[1]) for r in rows])
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}


def test_repeated_rows_and_null_ids(spark):
    text, other = "".join(map(str, range(200))), "".join(map(str, range(150, 350)))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, other), (7, other + "!")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.dedup(df).collect())
    assert got[0] == (0, len(text), 0)
    assert got[1] == got[2] == (5, len(text), len(text))
    assert sorted(r[2] for r in got[3:])[1] >= len(other) - 1


def test_thousands_of_texts_under_one_null_id(spark):
    random.seed(11)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    shared = [word(130) for _ in range(20)]
    texts = [word(40) + random.choice(shared) + word(40) if i % 2 else word(220) for i in range(4000)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string").repartition(3)
    ordered = [r.text for r in df.selectExpr("text", "xxhash64(text, 3) AS tie").orderBy("tie").collect()]
    got = {r.text: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.dedup(df).collect()}
    assert got == dict(zip(ordered, brute(list(enumerate(ordered))), strict=True))


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("rows_sorted,strings,gathered", [(2, 8, 300), (5, 60, 4000), (1 << 14, 1 << 17, 1 << 23)])
def test_boundaries_of_buckets_and_of_what_is_sorted_at_once(spark, monkeypatch, rows_sorted, strings, gathered):
    for name, value in (("SORTED", rows_sorted), ("STRINGS", strings), ("GATHERED", gathered), ("HELD", gathered // 10), ("KNOWN", 3)):
        monkeypatch.setattr(sd, name, value)
    random.seed(21)
    word = lambda n: "".join(random.choice("abcde \n") for _ in range(n))
    common, pieces = word(140), [word(random.randint(60, 240)) for _ in range(12)]
    texts = [word(random.randint(0, 90)) + random.choice(pieces)[random.randint(0, 30) :] + word(random.randint(0, 30)) + random.choice([common, common[3:], ""]) + word(5) for _ in range(300)]
    texts += [word(130) + common + word(3)] * 3 + ["ab" * 200, "x" * 260 + common, "\x00" * 130, "\x00" * 131 + "é" * 80]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.dedup(df).collect()}
    assert got == dict(enumerate(brute(list(enumerate(texts)))))


def test_text_ids_very_long_texts_and_columns_of_the_operator(spark):
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    long = word(1_000_000)
    rows = [("b10", long, "r"), ("a9", long[300_000:600_000] + word(50), "s"), (None, long[:5000], None), ("c", "short", "t")]
    df = spark.createDataFrame([(i, t, x, 1, 2, True, "m", b"k") for i, t, x in rows], "doc_id string, text string, row string, doc int, tie int, Hit boolean, _block string, KEPT binary")
    out = sd.dedup(df)
    assert out.columns == ["doc_id", "text", "row", "doc", "tie", "Hit", "_block", "n_bytes", "n_removed", "n_spans", "kept"]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    got = {(r.doc_id, r.row, r.doc, r._block): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    assert got == {(r[0], r[2], 1, "m"): b for r, b in zip(ordered, brute([(k, r[1]) for k, r in enumerate(ordered)]), strict=True)}

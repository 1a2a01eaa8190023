import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "Don't  stop\n\n it's", "x<|endoftext|>y <s> </s>", "a▁b has a mark", "tabs\tand\x0bmore \x00 end", "日本語 テキスト です", "é ́x ﬁ ①", "　wide  spaces\u0085here a b c", "naïve café 12 345", "word " * 400, "z" * 3000]


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    """Result of each text by the libraries on whole texts and all pairs of overlapping tokens."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    table = ta.byte_values()
    found, counts = [], Counter()
    for text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        bytes_a = [bytes(table[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            a, b, bytes_a, bytes_b = [], [], [], []
        sa, sb = spans(bytes_a), spans(bytes_b)
        links, first = [], 0
        for i, (x, y) in enumerate(sa):
            while first < len(sb) and sb[first][1] <= x:
                first += 1
            j = first
            while j < len(sb) and sb[j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s in zip(a, sa) if lo < s[1] <= c) + "|" + ",".join(str(i) for i, s in zip(b, sb) if lo < s[1] <= c))
            lo = c
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), g) for na, nb, ng, ls, g in found], counts, most


@pytest.mark.parametrize("shard,remembered,gathered,call", [(1 << 20, 150_000, 1 << 20, 4096), (40, 30, 60, 50)])
def test_equals_all_pairs_of_whole_encodings(spark, monkeypatch, shard, remembered, gathered, call):
    for name, value in (("SHARD", shard), ("REMEMBERED", remembered), ("GATHERED", gathered), ("CALL", call)):
        monkeypatch.setattr(ta, name, value)
    random.seed(4)
    words = ["the", "of", "naïve", "tokens", "Überraschung", "x1", "don't", "42", "日本", "\n", "", "\t", "a"]
    texts = TEXTS + [" ".join(random.choice(words) for _ in range(random.randint(1, 120))) for _ in range(60)] + TEXTS[8:10]
    df = spark.createDataFrame([(i, t, "g", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, GROUPS string, row int").repartition(5)
    out = ta.align(df, A, B)
    assert out.columns == ["doc_id", "text", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want, counts, most = brute(texts)
    got = {r.doc_id: tuple(r)[3:] for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == want[i], (i, t)
    pairs = {(r.a_id, r.b_id): (r.n, r.best) for r in ta.pair_counts(df, A, B).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_query_matches_all_pairs(spark, sf_dir):
    import hashlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs])[0]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, sf_dir).collect()}
    assert got == {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(docs, want, strict=True)}


def test_texts_that_units_do_not_reproduce_are_encoded_whole(monkeypatch):
    aligner = ta.Aligner(Path(A).read_text(), Path(B).read_bytes(), 1)
    assert aligner.cuts
    at, first = aligner.units(pa.array(["one two", "a▁b c d", None, "three"]), True)
    assert first.tolist() == [0, 2, 2, 2, 3]
    monkeypatch.setattr(aligner, "cuts", False)
    whole, first = aligner.units(pa.array(["one two", "a▁b c d", None, "three"]), True)
    assert first.tolist() == [0, 1, 1, 1, 2]
    assert aligner.n_links[at].sum() == aligner.n_links[whole].sum()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ta.align(df, A, B).count() == 0
    assert ta.pair_counts(df, A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [tuple(r)[2:] for r in ta.align(nothing, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_texts_are_encoded_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(row):
        rows.add(1)
        return row

    texts = [*TEXTS, *(f"some more of them, {i}" for i in range(30))]
    made = spark.sparkContext.parallelize(list(enumerate(texts)), 3).map(counted)
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    out = ta.align(df, A, B, keep_text=False)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = brute(texts)[0]
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == dict(enumerate(want))
    assert rows.value == len(texts)  # twice as many when each pass read them
    assert {r.doc_id: tuple(r)[1:] for r in ta.align(df, A, B).drop("text").collect()} == dict(enumerate(want))

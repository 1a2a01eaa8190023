import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", " \n\t", "a\x0bb\x0cc\rd", "Don't  stop", "x<|endoftext|>y <|startoftext|>", "é ́x", " 　 z", "日本語" * 900, "ab'" * 2000, "'" * 3001 + "s", "É" * 2500, "<|endoftext|>" * 400, "word " * 3000]


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="abcxyz'st<|>é́İ9!", max_size=300), st.sampled_from([2, 5, 16]))
def test_tree_equals_whole_encoding(text, leaf):
    assert [t[0] for t in bpe.encode_tree(text, LIBRARY, leaf)] == want(text)[0]


def test_long_runs(spark):
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("etaoinshrdlu'13") for _ in range(n)) for n in (1023, 1025, 5000, 40_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        assert (got[i].ids, got[i].decoded) == want(t)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_byte_level_decoder(spark, name):
    path = public_tokenizers.path(name)
    rows = spark.createDataFrame([([464, 3290],), ([],), (None,)], "ids array<int>")
    library = Tokenizer.from_file(path)
    assert [r.decoded for r in bpe.decode(rows, path).collect()] == [library.decode([464, 3290]), "", ""]


def test_query_matches_library(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, sf_dir).collect():
        ids, text = want(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_runs_dealt_to_many_tasks(spark):
    random.seed(2)
    run = "".join(random.choice("etaoinshrdlu'13é") for _ in range(3 * bpe.SPREAD + 77))
    texts = [f"ab {run} cd\t{run[::-1]}", run, "short", None, f"{run}\n{run}", run[: bpe.SPREAD], run[: bpe.SPREAD + 1]]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, runs string")
    got = {(r.doc_id, r.runs): r.ids for r in bpe.encode(df, PATH).collect()}
    assert got == {(i, "m"): want(t)[0] for i, t in enumerate([*texts, texts[0]])}


def test_tokenizer_that_keeps_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert not bpe.drops_white_space(library) and bpe.drops_white_space(LIBRARY)
    texts = ["hello big world", " two  spaces\n\nand lines ", "", None, "x" * 5000]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_structured_words_are_told_apart(spark):
    words = ["a"]
    while len(words[-1]) < 4096:
        words.append(words[-1] + words[-1].translate(str.maketrans("ab", "ba")))
    texts = [w + " " + w.translate(str.maketrans("ab", "ba")) + " " + w for w in words[9:]]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PATH).collect()}
    assert got == {i: want(t)[0] for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip_by_one_worker(spark, name):
    path, run = public_tokenizers.path(name), "xy'z" * (bpe.SPREAD // 4 + 9)
    library, texts = Tokenizer.from_file(path), [*TEXTS, f"ab {run} cd"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, IDS string, `row` string")
    out = bpe.round_trip(df, path)
    assert out.columns == ["doc_id", "row", "ids", "decoded_sha256"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].row, got[i].ids, got[i].decoded_sha256) == ("y", ids, hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == len(texts)


def test_tokens_stage_has_one_worker_a_task(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = corpus_pipeline.tokens(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1

"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import line_dedup, queries
from tests.llm.test_edge_cases import brute_lines


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows of the input and of what each stage returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [(docs.columns, docs.collect())]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(found[-1][1], docs.schema), sf_dir)
        found.append((out.columns, out.collect()))
    return found


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_return_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "decontamination", "tokens"]
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    assert all(0 < len(b[1]) <= len(a[1]) for a, b in zip(stages, stages[1:], strict=False))


def test_quality(spark, sf_dir, stages):
    kept = {r.doc_id for r in queries.op8_quality_classifier(spark, sf_dir).where("predicted = 1").collect()}
    assert set(texts(stages[1][1])) == kept
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept) > 0.95 * len(good)


def test_lines(stages):
    docs = sorted(texts(stages[1][1]).items())
    want = {d: t for d, t in brute_lines(docs, line_dedup.MIN_WORDS).items() if t == dict(docs)[d] or t.strip()}
    assert texts(stages[2][1]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2][1] if r.text != dict(docs)[r.doc_id])


def test_near_copies(stages):
    sets = {}
    for d, t in texts(stages[2][1]).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}
    for _ in range(20):
        for d in sets:
            root[d] = min([root[d], *(root[e] for e in sets if sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]))])
    assert set(texts(stages[3][1])) == {d for d in root if root[d] == d}


def test_decontamination(spark, sf_dir, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {d for d, t in texts(stages[3][1]).items() if any(tuple(words(t)[i : i + n]) in windows for n in sizes for i in range(len(words(t)) - n + 1))}
    assert set(texts(stages[4][1])) == set(texts(stages[3][1])) - dirty and dirty


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    source = texts(stages[4][1])
    assert len(stages[5][1]) == len(source)
    for r in stages[5][1]:
        ids = library.encode(source[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    line = "this line has more than a few words in it so that it counts as a run of its own when it comes again and again"
    rows = [(1, f"{line}\nend one", "en", "s", 5), (2, f"{line}\nother end", "en", "s", 5), (2, f"{line}\nother end", "en", "s", 5), (3, None, None, None, None), (4, "", "en", None, 0), (None, "a text of no id", None, "s", 1), (None, f"{line}\nend one", "en", "s", 5), (7, "w " * 30_000, "en", "s", None)]
    return spark.createDataFrame([(*r, "t", "k", "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, N_Hit string, `key` string, `row` string")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, name, stage):
    found = stage(spark, odd, sf_dir)
    rows = found.collect()
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    if name != "tokens":
        assert found.columns == corpus_pipeline.COLUMNS
    places = [(r.doc_id, getattr(r, "text", None)) for r in rows]
    line = odd.first().text.split("\n")[0]
    others = [(3, None), (4, ""), (None, "a text of no id"), (7, "w " * 30_000)]
    if name == "lines":  # the null id comes first, so that its run stays; nothing is left of document 1
        assert sorted(places, key=str) == sorted([(2, "other end"), (2, "other end"), (None, f"{line}\nend one"), *others], key=str)
    if name == "near_copies":  # 1, 2 and the row of no id are near copies
        assert sorted(places, key=str) == sorted([(1, f"{line}\nend one"), *others], key=str)
    if name == "decontamination":
        assert len(rows) == 8
    if name == "tokens":
        assert sorted((str(r.doc_id), r.n_tokens) for r in rows if r.doc_id in (3, 4)) == [("3", 0), ("4", 0)] and len(rows) == 8


def test_quality_keeps_all_without_positives(spark, sf_dir, tmp_path, odd):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, odd, str(tmp_path)).count() == 8

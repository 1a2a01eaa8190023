"""Structured words, clashing column names, ids of other types, and repeated rows, for every operator."""

import public_tokenizers
import pytest

from tessera.llm import bpe, chat_format, decontaminate, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, suffix_dedup, url_filters


def morse(n):
    """A Thue-Morse word of two letters and its complement: what a polynomial modulo a power of two takes for one."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(params=[1024, 4096])
def words(request):
    return morse(request.param)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


def test_structured_lines(spark, words):
    fill = " and" * 30
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup(texts(spark, words[0] + fill, words[1] + fill, words[0] + fill)).collect()}
    assert out == {0: 0, 1: 0, 2: 1}
    found = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(texts(spark, "\n".join(words), "\n".join([*words, words[0]]), f"{words[0]} b c d e {words[1]} b c d e")).collect()}
    assert found == {0: (0, 0), 1: (1, 0), 2: (0, 0)}


def test_structured_bytes(spark, words):
    out = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(texts(spark, "x" * 50 + words[0], words[1], words[0])).collect()}
    first = {("x" * 50 + words[0])[i : i + 100] for i in range(len(words[0]) - 49)}
    gone = [False] * len(words[1])
    for i in range(len(words[1]) - 99):
        if words[1][i : i + 100] in first or words[1].index(words[1][i : i + 100]) < i:
            gone[i : i + 100] = [True] * 100
    assert out[1] == sum(gone) and out[2] == len(words[0])


def test_structured_terms(spark, words):
    test = spark.createDataFrame([(0, f"a b {words[0]} c")], "item_id bigint, text string")
    out = {r.doc_id: (r.n_hit, r.near_items) for r in decontaminate.annotate(texts(spark, f"a b {words[1]} c", f"a b {words[0]} c"), test).collect()}
    assert out == {0: (0, []), 1: (4, [0])}


def test_structured_sets(spark, words):
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(texts(spark, words[0], words[1], words[0].upper())).collect()}
    assert out == {0: (0, 0), 1: (1, 0), 2: (0, 0)}


#: Names that operators use inside, in some case or other, and those of results.
NAMES = ["row", "KEY", "Doc", "tie", "hit", "runs", "canonical", "entry", "host", "_block", "_bits", "_word0", "_set_word0", "of", "with", "member", "label", "labels", "node", "part", "set_a", "keeper", "class_ID", "N_Links", "N_Words", "Failed", "N_lines", "n_removed", "N_hit", "items", "Lang_Pred", "Score", "predicted", "ids", "IDS2", "decoded", "x", "positive", "marks", "span", "shard", "talk", "seq", "n_bytes", "Kept", "with space", "a`b", "lang"]


@pytest.fixture(scope="module")
def clashing(spark):
    schema = "doc_id bigint, text string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)
    rows = [(i, t, *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(["one two three four five six", "one two three four five six", None, "a\n" + "line with words " * 9, "z\n" + "line with words " * 9])]
    return spark.createDataFrame(rows + rows[:1], schema)


PATH = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "language": lambda s, df: language_id.identify(df, language_id.train(df)),
    "lines": lambda s, df: line_dedup.dedup(df),
    "rules": lambda s, df: quality_rules.apply_policy(quality_rules.ledger(df), "web-1"),
    "suffixes": lambda s, df: suffix_dedup.dedup(df),
    "items": lambda s, df: decontaminate.annotate(df, df.selectExpr("doc_id AS item_id", "text").limit(1)),
    "routed items": lambda s, df: decontaminate.annotate(df, df.selectExpr("doc_id AS item_id", "text").limit(1), limit=0),
    "classifier": lambda s, df: quality_classifier.classify(df, quality_classifier.fit(df, df.selectExpr("doc_id", "1 AS quality"))),
    "copies": lambda s, df: jaccard_join.near_duplicates(df),
    "tokens": lambda s, df: bpe.decode(bpe.encode(df, PATH, ids="ids2"), PATH, "ids2"),
    "urls": lambda s, df: url_filters.judge(df, df.selectExpr("text AS canonical"), [("block", "org", "/")], url="text"),
    "listed": lambda s, df: url_filters.listed(df, df.selectExpr("text AS canonical"), "hit", "text"),
}


RESULTS = {
    "language": "lang_pred score cross_entropy accepted", "lines": "n_lines n_removed", "suffixes": "n_bytes n_removed n_spans kept", "items": "n_words n_hit items near_items",
    "rules": "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper failed kept", "classifier": "score predicted", "copies": "class_id n_links", "tokens": "ids2 decoded",
    "urls": "host path rule listed verdict", "listed": "hit",
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_users_stay_as_they_are(spark, clashing, name):
    out, results = OPERATORS[name](spark, clashing), RESULTS[name.removeprefix("routed ")].split()
    own = [c for c in clashing.columns if c.lower() not in results]
    assert out.columns == [*own, *results]
    rows = out.collect()
    assert len(rows) == 6 and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in own if c in NAMES)


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("b", "one two three four five six seven"), ("a", "one two three four five six seven"), (None, "x"), ("c", None)], "doc_id string, text string")
    assert {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(docs).collect()} == {"a": "a", "b": "a", None: None, "c": "c"}
    assert sorted(r.doc_id or "" for r in jaccard_join.keep_one(docs).collect()) == ["", "a", "c"]
    assert line_dedup.dedup(docs).count() == 4
    model = quality_classifier.fit(docs, spark.createDataFrame([("a", 1)], "doc_id string, quality int"))
    assert quality_classifier.classify(docs, model).count() == 4
    talks = spark.createDataFrame([("t", 1, "user", "hi"), (None, 1, "assistant", "yes"), ("t", 2, "assistant", "ho")], "conv_id string, turn bigint, role string, text string")
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.windows(talks)).collect()} == {"t": (2, 2), None: (1, 3)}


def test_urls_repeated_very_long_and_none(spark):
    urls = ["http://a.org/" + "x/" * 50_000, "http://a.org/", "http://a.org/", None]
    pages = spark.createDataFrame([(1, u) for u in urls], "page_id bigint, url string")
    listing = spark.createDataFrame([("a.org/" + "x/" * 49_999 + "x",), ("a.org",), ("a.org",)], "canonical string")
    assert sorted(r.listed for r in url_filters.judge(pages, listing, []).collect()) == [False, True, True, True]
    assert url_filters.judge(pages.limit(0), listing, []).count() == 0 and url_filters.judge(pages, listing.limit(0), []).where("listed").count() == 0


def test_hot_conversation_very_long_turns_and_null_ids_only(spark):
    import hashlib

    def digest(turns):
        sha, loss = hashlib.sha256(), "".join(t for r, t in turns if r == "assistant")
        for role, text in turns:
            sha.update(f"{role}\n{text}\n".encode())
        return len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()

    turns = [("system", "be kind " * 5)] + [(("user", "assistant")[i % 2], f"turn {i} " * (i % 40 + 1) if i != 700 else "long " * 60_000) for i in range(1500)]
    df = spark.createDataFrame([(None, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string").repartition(7)
    spans = chat_format.windows(df, 400, 100, model_file=PATH)
    (got,) = chat_format.read_back(spans).collect()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == digest(turns)
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(PATH), sorted(spans.collect(), key=lambda r: r.window)
    assert len(rows) > 100 and {r.talk for r in rows} == {rows[0].talk}
    assert all(r.n_tokens == len(library.encode(r.formatted, add_special_tokens=False).ids) for r in rows if len(r.formatted) < 50_000)
    assert all(r.n_tokens <= 400 for r in rows if r.n_turns - r.n_repeated > 1) and sum(r.n_tokens > 400 for r in rows) <= 1
    size = [len(library.encode(f"{chat_format.START}{r}\n{t}{chat_format.END}", add_special_tokens=False).ids) for r, t in turns]
    at = 1  # the system turn is new in the first window and repeated in all others
    for k, r in enumerate(rows):
        new = r.n_turns - r.n_repeated - (k == 0)
        room, past = min(100, 400 - size[0] - sum(size[at : at + new])), 0
        while k and at - past > 1 and size[at - past - 1] <= room:
            past += 1
            room -= size[at - past]
        assert [x[:2] for x in chat_format.turns_of(r.formatted)] == [turns[0], *turns[at - past : at + new]] and r.n_repeated == (past + 1 if k else 0)
        at += new


@pytest.mark.parametrize("crowd", [4096, 20])
def test_walks_of_crowded_subtrees(spark, monkeypatch, crowd):
    import random

    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(("x" + str(k)) if i in random.Random(k).sample(range(120), 1) else w for i, w in enumerate(base)) for k in range(150)] + [" ".join(f"v{k}{i}" for i in range(40)) for k in range(60)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(texts(spark, *rows)).collect()}
    for i, s in enumerate(sets):
        assert out[i] == (0 if i < 150 else i, sum(1 for j, t in enumerate(sets) if t != s and len(s & t) >= 0.8 * len(s | t)))

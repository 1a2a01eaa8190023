"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, url_filters

SCHEMA = "doc_id bigint, text string, lang string, key string, n_words string, score string, items string, class_id string, n_lines string, kept string"
LONG = "lorem ipsum dolor sit amet " * 8000


def rows(*texts):
    return [(i, t, "en", "k", "w", "s", "i", "c", "l", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    data = rows(None, "", " \n\t ", "word", LONG, LONG, "été\ncafé", "x" * 50_000) + [(None, None, None, None, None, None, None, None, None, None), (4, LONG, None, "k", "w", "s", "i", "c", "l", "x"), (4, "other", "en", "k", "w", "s", "i", "c", "l", "x")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, None), (3, 1, 0), (None, 1, 1), (6, None, 0)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "language": lambda s, df: language_id.identify(df, language_id.train(df)),
    "lines": lambda s, df: line_dedup.dedup(df),
    "rules": lambda s, df: quality_rules.apply_policy(quality_rules.ledger(df), "web-1"),
    "decontamination": lambda s, df: decontaminate.annotate(df, items(s, "word", None, "", "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")),
    "classifier": lambda s, df: quality_classifier.classify(df, quality_classifier.fit(df, labels(s))),
    "jaccard": lambda s, df: jaccard_join.near_duplicates(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(spark, odd, empty, name):
    out = OPERATORS[name](spark, odd)
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in odd.collect())))
    assert {"lang", "key"} <= set(out.columns)
    assert OPERATORS[name](spark, empty).count() == 0


def test_language_of_odd_texts(spark, odd):
    found = {(r.doc_id, r.text): r for r in language_id.identify(odd, language_id.train(odd)).collect()}
    for text in (None, "", " \n\t "):
        row = next(r for (_, t), r in found.items() if t == text)
        assert (row.lang_pred, row.score, row.accepted) == ("und", 0.0, False)
    assert found[(6, "été\ncafé")].lang_pred == "en"


def test_language_model_probabilities_sum_to_one(spark):
    import numpy as np

    docs = spark.createDataFrame([("abab abba baab", "aa"), ("cdcd dccd cd", "cc")] * 3, "text string, lang string")
    model = language_id.estimate(language_id.count_grams(docs))
    for history in ("ab ", "bab", "zzz", "   "):
        code = 0
        for c in history:
            code = (code << language_id.BITS) | (0 if c == " " else ord(c))
        grams = (code << language_id.BITS) | np.arange(language_id.CLASSES)
        total = np.exp(model.log_probabilities(grams).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-3), (history, total)


def test_language_model_keeps_every_gram_and_sums_to_one(spark):
    import random

    import numpy as np

    random.seed(4)
    letters = [chr(c) for c in range(0x100, 0x600) if chr(c).isalpha() and chr(c).islower()]
    text = "".join(random.choice(letters) for _ in range(150_000))
    docs = spark.createDataFrame([(text, "aa"), (text[:500], "aa"), (text[:500] + "x", "aa"), ("abab abba", "cc")], "text string, lang string")
    counts = language_id.count_grams(docs).cache()
    model = language_id.estimate(counts)
    assert len(model.keys[language_id.ORDER - 1]) == counts.select("gram").distinct().count() > 1 << 17
    for history in (text[:3], text[200:203], text[100_000:100_003], "aba"):
        code = 0
        for c in history:
            code = (code << language_id.BITS) | ord(c)
        total = np.exp(model.log_probabilities((code << language_id.BITS) | np.arange(language_id.CLASSES)).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-3), (history, total)


def test_language_model_is_that_of_plain_python(spark):
    import math
    from collections import Counter

    texts = {"aa": ["Das ist gut", "gut, das!", "日本 das"], "": ["this is good", "is it good"], "cc": ["x"]}
    docs = spark.createDataFrame([(t, k) for k, ts in texts.items() for t in ts] + [("left out", None), (None, "aa")], "text string, lang string")
    model = language_id.estimate(language_id.count_grams(docs))
    assert model.languages == ["", "aa", "cc"]

    def fold(text):
        out = ""
        for c in text.lower():
            c = c if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out += c
        return "   " + out

    for at, (_, ts) in enumerate(sorted(texts.items())):
        levels = {4: Counter(f[i : i + 4] for t in ts for f in [fold(t)] for i in range(len(f) - 3))}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])

        def share(gram, k):
            if k == 0:
                return 1 / language_id.CLASSES
            gram, counts = gram[-k:], levels[k]
            one, two = (sum(1 for v in counts.values() if v == n) for n in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.5
            own = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
            if not own:
                return share(gram, k - 1)
            return max(0, counts[gram] - d) / sum(own) + d * len(own) / sum(own) * share(gram, k - 1)

        for text in ("das good", "日本語 is", "zzz", "gut"):
            f = fold(text)
            want = -sum(math.log(share(f[i : i + 4], 4)) for i in range(len(f) - 3)) / (len(f) - 3)
            got, _ = model.cross_entropy(*language_id.Folder().fold([text]))
            assert got[0, at] == pytest.approx(want, abs=2e-6)


def test_held_out_language_accuracy(spark):
    from tessera.llm import queries

    sf = "/root/testdata/sf0.01"
    found = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_held_out_quality_accuracy(spark):
    from tessera.llm import queries

    sf = "/root/testdata/sf0.1"
    found = queries.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1


def plain_features(text):
    """The features of a short text without numpy."""
    data, words, lines = (text or "").encode(), (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
    size = max(1, len(data))
    out = [(sum(1 for b in data if min(b, 128) == c) / size) ** 0.5 for c in range(129)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    chars = sum(map(len, words))
    out += [sum(text.count(c) for c in "#*$%&|<>") / max(1, len(words)), (len(lines) - len(set(lines))) / max(1, len(lines)), len(repeated) / max(1, len(words))]
    out += [sum("A" <= c <= "Z" for c in text) / max(1, chars), chars / max(1, len(words)), len(lines) / max(1, len(words)), size / (size + 8)]
    return out


def test_non_negative_risk_is_that_of_plain_python(spark):
    import math
    import random

    random.seed(9)
    good = lambda: " ".join(random.choice(("the", "small", "river", "Bank", "flows")) for _ in range(random.randint(5, 30)))
    bad = lambda: "\n".join(random.choice(("$$$ BUY", "#1 <a>", "BUY BUY BUY BUY BUY BUY")) for _ in range(random.randint(1, 6)))
    docs = [(i, good() if i % 3 else bad()) for i in range(120)]
    marks = [(i, 1, 0) for i in range(120) if i % 3 and i % 2] + [(0, 0, 0), (5, 0, 1), (5, 1, 1)]
    model = quality_classifier.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    assert 0.4 < model.prior < 0.9
    import zlib

    learned = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    x = {i: plain_features(t) for i, t in learned}
    mean = [sum(v[k] for v in x.values()) / len(x) for k in range(136)]
    spread = [math.sqrt(max(0, sum(v[k] ** 2 for v in x.values()) / len(x) - mean[k] ** 2)) + 1e-3 for k in range(136)]

    def raw(v, w):
        z = [max(-8, min(8, (v[k] - mean[k]) / spread[k])) * (v[-1] if k < 129 else 1) for k in range(136)]
        return sum(a * b for a, b in zip(z, w, strict=False)) + w[-1]

    trusted = [i for i, _ in learned if i in {m for m, q, _ in marks if q} and i != 5]

    def risk(w):
        loss = lambda g: math.log1p(math.exp(-abs(g))) + max(0, -g)
        mean_of = lambda ids, sign: sum(loss(sign * raw(x[i], w)) for i in ids) / len(ids)
        bracket = mean_of(list(x), -1) - model.prior * mean_of(trusted, -1)
        return model.prior * mean_of(trusted, 1) + max(0, bracket) + 0.5 * quality_classifier.DECAY * sum(v * v for v in w[:-1])

    w = model.weights.tolist()
    assert risk(w) == pytest.approx(model.risk, abs=1e-6)
    for k in (*random.sample(range(136), 12), 136):  # no weight can be moved to a lower risk
        for step in (1e-2, -1e-2):
            assert risk([v + step * (i == k) for i, v in enumerate(w)]) > model.risk - 1e-6
    found = {r.doc_id: r.score for r in quality_classifier.classify(spark.createDataFrame(docs, "doc_id bigint, text string"), model).collect()}
    for i, t in learned[:20]:
        assert found[i] == pytest.approx(1 / (1 + math.exp(-raw(plain_features(t), w))), abs=1e-5)


def test_repeated_ids_are_not_collected(spark):
    rows_of_one = spark.range(3000).selectExpr("7L AS doc_id", "concat('some good text ', id) AS text")
    model = quality_classifier.fit(rows_of_one, spark.createDataFrame([(7, 1)], "doc_id bigint, quality int"))
    assert model.weights.shape == (137,) and 0 <= model.prior <= 1


def brute_lines(docs, least):
    """Lines in runs of ``least`` words or more that occur earlier, by trying all runs."""
    lines = {}
    for d, text in docs:
        found = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n"))]
        lines[d] = [(i, x) for i, x in found if x]
    seen, gone = {}, {d: set() for d, _ in docs}
    for d, _ in docs:
        have = lines[d]
        for a in range(len(have)):
            for b in range(a, len(have)):
                if sum(len(x.split()) for _, x in have[a : b + 1]) >= least:
                    run = tuple(x for _, x in have[a : b + 1])
                    if seen.setdefault(run, (d, a)) != (d, a):
                        gone[d].update(range(have[a][0], have[b][0] + 1))
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in docs}


def test_line_runs_match_brute_force(spark):
    import random

    random.seed(5)
    pool = [" ".join(random.choice("abcdefg") for _ in range(random.choice((1, 2, 3, 9, 25)))) for _ in range(14)] + ["", "  "]
    docs = [(i, "\n".join(random.choice(pool) + random.choice(("", " ")) for _ in range(random.randint(0, 12)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == brute_lines(docs, line_dedup.MIN_WORDS)


def test_repeated_rows_are_no_repeats_of_each_other(spark):
    text = "\n".join(f"line {i} with some more words to be long enough" for i in range(5))
    out = line_dedup.dedup(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(1, 0), (1, 0), (2, 5)]


def test_jaccard_links_and_classes(spark):
    words = [f"w{i}" for i in range(100)]
    change = lambda *at: " ".join("new" + w if i in at else w for i, w in enumerate(words))
    texts = [change(), change(3), change(3), change(96), change(3, 50, 80), change(3, 20, 40, 60, 80), None, "", "", "one two", "ONE  two", "one three"]
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    link = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)
    for i, s in enumerate(sets):
        assert out[i][1] == len({frozenset(t) for t in sets if t != s and link(s, t)}), i
    root = list(range(len(texts)))
    for _ in texts:
        for i, s in enumerate(sets):
            root[i] = min([root[i], *(root[j] for j, t in enumerate(sets) if link(s, t))])
    assert [out[i][0] for i in range(len(texts))] == root


def test_large_group_of_near_copies_is_one_class(spark):
    import random

    random.seed(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(("x" + str(k)) if i in random.Random(k).sample(range(200), 2) else w for i, w in enumerate(words)) for k in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = jaccard_join.near_duplicates(df).collect()
    assert {r.class_id for r in found} == {0}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    for r in random.sample(found, 25):
        assert r.n_links == sum(1 for s in sets if s != sets[r.doc_id] and len(s & sets[r.doc_id]) >= 0.8 * len(s | sets[r.doc_id]))


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(3, text, "z"), (1, text, "a"), (1, text, "a"), (7, text + " end", "q"), (9, None, "n"), (8, "alone", "o")]
    kept = jaccard_join.keep_one(spark.createDataFrame(data, "doc_id bigint, text string, class_id string"))
    assert sorted((r.doc_id, r.class_id) for r in kept.collect()) == [(1, "a"), (8, "o"), (9, "n")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1002, 1001), (5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


def brute_matches(docs, tests, width, reach):
    """(words, hit words, items by phrase, items by proximity) of each document by trying all windows everywhere."""
    import re

    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(item, tuple(w[i : i + width])) for item, t in tests for w in [fold(t)] for i in range(max(1, len(w) - width + 1)) if w]
    out = []
    for _, text in docs:
        w = fold(text)
        hit, items, nearby = set(), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    items.add(item)
            if any(set(window) <= set(w[i : i + reach]) for i in range(len(w))):
                nearby.add(item)
        out.append((len(w), len(hit), sorted(items - {None}), sorted(nearby - {None})))
    return out


def test_phrases_and_proximity(spark):
    docs = [(0, "a b c d e f g h i j k"), (1, "A, b c d e; f g h i J"), (2, "k b a"), (3, "x y"), (4, "x. z. y"), (5, "b c d e f g h i j")]
    tests = items(spark, "a b c d e f g h i j k l", "x y", "x y", None)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in decontaminate.search(decontaminate.build_index(spark.createDataFrame(docs, "doc_id bigint, text string")), tests).collect()}
    assert got[0][:3] == (11, 11, [0]) and got[1][:3] == (10, 10, [0]) and got[2][1:3] == (0, []) and got[5][1] == 0
    assert got[3] == (2, 2, [1, 2], [1, 2]) and got[4] == (3, 0, [], [1, 2])


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_by_brute_force(spark, limit):
    import random

    random.seed(6)
    word = lambda: random.choice("abcdefghéx")
    docs = [(i, " ".join(word() for _ in range(random.choice((0, 3, 30, 80))))) for i in range(60)] + [(60, None), (3, None), (None, "a b c")]
    tests = [(f"t{i % 7}" if i else None, " ".join(word() for _ in range(random.choice((0, 1, 3, 4, 6))))) for i in range(16)] + [("n", None)]
    df = spark.createDataFrame([(d, t, "n", "i", 1) for d, t in docs], "doc_id bigint, text string, N_Words string, items string, shard int").repartition(3)
    test = spark.createDataFrame(tests, "item_id string, text string")
    got = decontaminate.annotate(df, test, width=4, reach=6, limit=limit)
    assert got.columns == ["doc_id", "text", "shard", "n_words", "n_hit", "items", "near_items"]
    want = sorted((str(d), str(t), *m) for (d, t), m in zip(docs, brute_matches(docs, tests, 4, 6), strict=True))
    assert sorted((str(r.doc_id), str(r.text), r.n_words, r.n_hit, r["items"], r.near_items) for r in got.collect()) == want
    found = decontaminate.search(decontaminate.build_index(df), test, width=4, reach=6, limit=limit).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.near_items) for r in found) == sorted((w[0], *w[2:]) for w in want)
    assert decontaminate.annotate(df, test.limit(0), limit=limit).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        decontaminate.annotate(df, test, reach=90)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Bad-Site.Example.ORG:80/en/2/?utm_source=x&b=2&a=1#top", "https://bad-site.example.org/en/2?a=1&b=2", "ftp://example.org/es/x", "x://sub.example.org/es/", "x://notexample.org/es/", "http://org/", "http://a.org", "http://com/de/?q#f", "http://É.com/fr/://y"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    listing = spark.createDataFrame([("bad-site.example.org/en/2?a=1&b=2",), (None,)], "canonical string")
    from tessera.llm.queries import URL_RULES

    got = {r.page_id: (r.host, r.path, r.rule, r.listed, r.verdict) for r in url_filters.judge(df, listing, URL_RULES).collect()}
    assert all(got[i] == ("", "", None, False, "allow") for i in range(4))
    assert got[4] == ("www.bad-site.example.org:80", "/en/2/", None, True, "block")
    assert got[5] == ("bad-site.example.org", "/en/2", "org/", True, "allow")
    assert got[6][2:] == ("example.org/es/", False, "block") and got[7][4] == "block" and got[8][2] == "org/"
    assert got[10][1:3] == ("", None) and got[11][2] == "com/de/" and got[12][:3] == ("É.com", "/fr/://y", "com/fr/")


def test_rule_ledger_and_ablation(spark):
    texts = ["few words", "a b c d e " * 10, "fine words that do not repeat in this text at all and so are kept here", None]
    entries = quality_rules.ledger(spark.createDataFrame(rows(*texts), SCHEMA)).cache()
    kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(entries.select("doc_id", "failed"), "base-1").collect()}
    assert kept == {0: False, 1: False, 2: True, 3: False}
    ablated = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablate(entries, "base-1").collect()}
    assert ablated == {"few_words": (2, 2, 3), "repeated_windows": (1, 1, 2)}

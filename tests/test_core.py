"""Golden values and properties of the bilingual operators."""

import json
import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import ratio, scoring, scripts, text
from tessera.operators import export, lookup, report, scenarios
from tessera.plans import agents, pipeline, tools
from tessera.sources import config, results

CONFIG = {
    "topics": ["Travel", "Weather", "Market", "Kitchen", "School"],
    "tense": ["Past", "Present", "Future"],
    "perspective": ["First Person", "Third Person"],
    "character_setting": {
        "gender": ["Male", "Female"],
        "age": ["8-17", "18-25", "26-35", "56-65", "66+"],
        "education_level": ["High School", "College", "Master", "Doctor"],
        "nationality": {"first_language": "Arabic", "second_language": "English"},
    },
    "cs_ratio": ["30%", "50%", "70%"],
    "conversation_type": ["single_turn", "multi-turn"],
    "cs_function": ["Directive", "Expressive", "Referential", "Phatic", "Metalinguistic", "Poetic"],
    "cs_type": ["Intersentential", "Intrasentential", "Tag switching"],
    "use_tools": True,
}

ONE = "الفريق بدأ المباراة بشكل قوي جدًا وحقق تقدم كبير في البداية. But then the defense couldn't keep up and things started to fall apart."
TWO = "الجمهور كان متحمس جدًا في الربع الأول. The mood shifted quickly after halftime when the game got tense."
THREE = "الخسارة كانت صعبة على الجميع، خصوصًا بعد الأداء القوي في البداية. It's frustrating to see them lose after such a promising start."


def talk(spark, *sentences, first="Arabic", second="English", target="30%", key=0):
    return spark.createDataFrame([(key, list(sentences), first, second, target)], "scenario_id long, instances array<string>, first_language string, second_language string, cs_ratio string")


@pytest.mark.parametrize("sentences,counts,ratio_text,score", [((ONE,), (11, 13), "54.2% English : 45.8% Arabic", 0.0), ((ONE, TWO), (18, 24), "57.1% English : 42.9% Arabic", 0.0), ((ONE, TWO, THREE), (29, 35), "54.7% English : 45.3% Arabic", 0.0)])
def test_recorded_counts(spark, sentences, counts, ratio_text, score):
    row = ratio.first_letter(talk(spark, *sentences)).withColumn("s", scoring.linear_score(F.col("lang2_percent"), F.col("cs_ratio"))).first()
    assert (row.lang1_word_count, row.lang2_word_count) == counts
    assert row.computed_ratio == ratio_text and row.s == score


@pytest.mark.parametrize("scores,want", [((9, 8.5, 7, 9), 8.475), ((9.0, 8.5, 0.0, 9.0), 7.074999999999999), ((8.5, 8.0, 0.0, 9.0), 6.8), ((9, 9, 2, 9), 7.6), ((9.5, 9.5, 1, 9.5), 7.8), ((8, 8, 8, 8), 8.0)])
def test_weighted_scores(spark, scores, want):
    row = spark.createDataFrame([tuple(map(float, scores))], list(scoring.WEIGHTS)).select(scoring.weighted_score().alias("s")).withColumn("d", scoring.decision(F.col("s"), F.lit(0))).first()
    assert row.s == pytest.approx(want, abs=1e-12) and row.d == ("ACCEPT" if want >= 8 else "REFINE")


@pytest.mark.parametrize("actual,target,want", [(30.0, "30%", 10.0), (32.0, "30%", 9.0), (35.0, "30%", 7.5), (40.0, "30%", 5.0), (50.0, "30%", 0.0), (54.7, "30%", 0.0), (54.7, "Low", 5.0), (1.0, None, 5.0), (30.0, "30%%", 10.0), (0.0, "", 5.0), (5.0, "nan", 0.0), (30.0, " 30 ", 10.0)])
def test_linear_score(spark, actual, target, want):
    df = spark.createDataFrame([(actual, target)], "a double, t string")
    assert df.select(scoring.linear_score(F.col("a"), F.col("t")).alias("s")).first().s == want


@pytest.mark.parametrize("diff,want", [(0, 10), (5, 10), (5.1, 8), (10, 8), (15, 6), (20, 4), (25, 2), (25.5, 0)])
def test_step_score(spark, diff, want):
    df = spark.createDataFrame([(50.0 + diff, "50%")], "a double, t string")
    assert df.select(scoring.step_score(F.col("a"), F.col("t")).alias("s")).first().s == want


def python_counts(sentences, first, second):
    def kind(word):
        letters = [c for c in word if c.isalpha()]
        if letters:
            for i, name in enumerate((first, second)):
                lo, hi = scripts.LANGUAGE_RANGES.get(name, scripts.DEFAULT_RANGE)
                if lo <= ord(letters[0]) <= hi:
                    return i
        return 2

    found = [kind(w) for s in sentences for w in s.split()]
    return tuple(found.count(i) for i in range(3))


ALPHABET = "ab éœĐ1.'كتاب؟ 　\u001c\u0085​漢字かなカ한हिन्दीйґΩ \t\n"


@settings(deadline=None, max_examples=25)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=4), st.sampled_from(["Arabic", "French", "Japanese", "Chinese", "Cantonese", "Hindi"]), st.sampled_from(["English", "Russian", "Korean"]))
def test_first_letter_against_python(spark, sentences, first, second):
    row = ratio.first_letter(talk(spark, *sentences, first=first, second=second)).first()
    one, two, unknown = python_counts(sentences, first, second)
    assert (row.lang1_word_count, row.lang2_word_count) == (one, two)
    assert row.unknown_words == (unknown if one + two else None)
    want = f"{two / (one + two) * 100:.1f}% {second} : {one / (one + two) * 100:.1f}% {first}" if one + two else "0% : 0%"
    assert row.computed_ratio == want
    assert text_count(spark, sentences) == sum(len(s.split()) for s in sentences)


def text_count(spark, sentences):
    return talk(spark, *sentences).select(text.count_words(F.col("instances")).alias("n")).first().n


def test_white_space_is_that_of_python(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, f"a{chr(i)}b") for i in points if i < 0x3100 or i % 997 == 0], "i int, t string")
    split = {r.i for r in df.where(F.size(text.words(F.col("t"))) == 2).collect()}
    assert split == {i for i in points if (i < 0x3100 or i % 997 == 0) and len(f"a{chr(i)}b".split()) == 2}


def test_swapping_languages_swaps_counts(spark):
    a = ratio.first_letter(talk(spark, ONE, TWO)).first()
    b = ratio.first_letter(talk(spark, TWO, ONE, first="English", second="Arabic")).first()
    assert (a.lang1_word_count, a.lang2_word_count) == (b.lang2_word_count, b.lang1_word_count)


def test_script_majority_and_guards(spark):
    run = lambda *s, **k: ratio.script_majority(talk(spark, *s, **k)).first()
    row = run(ONE, target="50%")
    assert (row.computed_ratio, row.ratio_score) == ("48% : 52%", 10.0) and row.matrix_count + row.embedded_count == 25
    assert run(ONE, first="Klingon").computed_ratio == "N/A" and run(ONE, first="French").notes.startswith("Both languages")
    assert run("123 ...").notes.startswith("No identifiable") and run().ratio_score == 0.0
    both = run("漢字 漢字 かな", first="Chinese", second="Japanese")
    assert (both.matrix_count, both.embedded_count) == (2, 1)


@pytest.mark.parametrize("script,sample", [("latin", "aéœĐﬁªº"), ("greek", "Ωἀ"), ("cyrillic", "йꙀ"), ("thai", "กๆ"), ("hangul", "한ᄀ")])
def test_characters_of_scripts(spark, script, sample):
    inside = lambda c: "LATIN" in unicodedata.name(c, "") if script == "latin" else any(lo <= ord(c) <= hi for lo, hi in scripts.SCRIPT_RANGES[script])
    got = spark.createDataFrame([(sample, script)], "t string, s string").select(scripts.characters_in(F.col("t"), F.col("s")).alias("n")).first().n
    assert got == sum(1 for c in sample if inside(c))


# Counts recorded for nine rows: matrix and embedded words, and the rounded matrix percentage.
RECORDED = [(31, 8, 79), (27, 22, 55), (34, 15, 69), (32, 15, 68), (21, 31, 40), (33, 31, 52), (40, 20, 67), (27, 19, 59), (33, 37, 47), (91, 88, 51), (107, 171, 38), (116, 88, 57), (123, 97, 56), (198, 40, 83), (155, 93, 62), (120, 105, 53), (187, 147, 56), (86, 88, 49)]


def test_recorded_percentages_and_rollup(spark):
    df = spark.createDataFrame([(i, 0, m, e) for i, (m, e, _) in enumerate(RECORDED)] + [(0, 1, 0, 0)], "row int, sentence int, matrix long, embedded long")
    got = {r.row: r for r in report.by_sentence(df, "row").where("level = 1").collect()}
    assert [got[i].matrix_pct for i in range(len(RECORDED))] == [p for *_, p in RECORDED]


def test_rounding_ties_to_even(spark):
    values = [6.25, 6.35, 0.05, 12.5, 93.75, 0.25]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(text.one_decimal(F.col("x"))).collect()]
    assert got[0] == "6.2" and got[3] == "12.5" and got[4] == "93.8"


def test_rounding_of_exact_values(spark):
    values = [n / total * 100 for total in (16, 80, 400, 625, 2000) for n in range(total + 1)] + [k / 20 for k in range(-200, 200, 2)] + [x for k in range(1, 4001, 2) for x in (math.nextafter(k / 20, 0), k / 20, math.nextafter(k / 20, 999))]
    values += [1e9 + 0.05, 123456789.25, 2.0**52 + 1, 1e-320, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(text.one_decimal(F.col("x"))).collect()]
    assert got[:-2] == [f"{v:.1f}" for v in values[:-2]] and got[-2] == "NaN"


def halves(spark, tmp_path):
    """Documents of 2000 words, with shares whose second decimal is a five."""
    rows = [(k, " ".join(["ab"] * n + ["abc"] * (2000 - n)), f"{n / 2000 * 100:.1f}% English : {(2000 - n) / 2000 * 100:.1f}% Arabic") for k, n in enumerate(range(1241, 1301, 6))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ratio string")
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(r.ratio for r in docs.collect())


def test_exported_ratios_round_as_their_sql(spark, tmp_path):
    from tessera import queries

    want = halves(spark, tmp_path)
    assert "63.5% English : 36.4% Arabic" in want
    assert sorted(r.cs_ratio_computed for r in queries.q_export_sentences(spark, str(tmp_path)).collect()) == want


def near_half(spark, tmp_path):
    """A document with a score of 4.0296875, which as a double is a little less."""
    spark.createDataFrame([(65, " ".join(["ab"] * 149 + ["abc"] * 107))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")


def test_exported_scores_round_as_their_sql(spark, tmp_path):
    from tessera import queries

    near_half(spark, tmp_path)
    row = queries.q_export_sentences(spark, str(tmp_path)).first()
    assert (row.score, row.cs_ratio_score, row.cs_ratio_computed) == (4.029687, 5.898438, "58.2% English : 41.8% Arabic")
    values = [4.0296875, -4.0296875, 9.1953125, 0.0, 1.0000005, 2.5e-7, 5e-7, None]
    want = [None if v is None else math.copysign(math.floor(abs(v) * 1e6 + 0.5), v) / 1e6 for v in values]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(queries.rounded(F.col("x"))).collect()] == want


def test_results_that_are_read_round_as_their_sql(spark, tmp_path):
    from tessera import queries

    want = halves(spark, tmp_path / "ratios")
    assert sorted(r.cs_ratio_computed for r in queries.q_results_read(spark, str(tmp_path / "ratios")).collect()) == want
    near_half(spark, tmp_path / "score")
    (row,) = queries.q_results_read(spark, str(tmp_path / "score")).collect()
    assert (row.score, row.cs_ratio_computed, row.fluency_errors) == (4.029687, "58.2% English : 41.8% Arabic", "topic2")


@pytest.mark.parametrize("shape,want", [("63% Arabic : 37% English", (63.0, 37.0, "Arabic", "English")), ("65% : 35%", (65.0, 35.0, None, None)), ("54.7% English : 45.3% Arabic", (54.7, 45.3, "English", "Arabic")), ("0% : 0%", (0.0, 0.0, None, None)), ("N/A", None), (None, None)])
def test_parsed_ratios(spark, shape, want):
    p = spark.createDataFrame([(shape,)], "c string").select(report.parsed(F.col("c")).alias("p")).first().p
    assert (tuple(p) if p else None) == want


def test_product_and_batches(spark):
    df = scenarios.product(spark, CONFIG)
    n = scenarios.count(CONFIG)
    assert df.count() == n == df.drop("scenario_id").distinct().count()
    assert [r.cs_type for r in df.orderBy("scenario_id").limit(4).collect()] == ["Intersentential", "Intrasentential", "Tag switching", "Intersentential"]
    got = scenarios.batches(df).groupBy("batch_id").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {40}
    assert scenarios.product(spark, CONFIG | {"topics": []}).count() == 0


def test_config_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    assert config.load(spark, str(tmp_path / "c.json")) == CONFIG
    assert config.setting(spark, ["no.such.setting", "spark.app.name"]) and config.setting(spark, ["no.such"], "x") == "x"


ROW = {"topic": "sports", "first_language": "Arabic", "second_language": "English", "score": 9, "refine_count": 0, "data_generation_result": ["a", "b"], "fluency_result": {"fluency_score": 9, "errors": [{"k": 1}, "x"], "summary": "s"}, "naturalness_result": {"naturalness_score": 8.5, "observations": {"sentence_1": "u", "sentence_2": "v"}}, "cs_ratio_result": {"ratio_score": 7, "computed_ratio": "63% : 37%", "notes": None}, "social_cultural_result": {"socio_cultural_score": 9, "issues": "No."}}


def test_results_of_varying_shape(spark, tmp_path):
    lines = [ROW, ROW | {"data_generation_result": None, "fluency_result": None}, ROW | {"data_generation_result": []}, ROW | {"data_generation_result": "one text"}]
    (tmp_path / "r.jsonl").write_text("\n\n  \n".join(json.dumps(x) for x in lines) + "\n")
    out = export.sentences(results.read(spark, str(tmp_path / "r.jsonl"))).collect()
    assert sorted((r.text or "", r.sentence_index) for r in out) == [("", 0), ("", 0), ("a", 0), ("b", 1), ("one text", 0)]
    full = next(r for r in out if r.text == "b")
    assert (full.fluency_errors, full.naturalness_observations, full.socio_cultural_issues, full.score) == ('{"k":1}; x', "sentence_1; sentence_2", "No.", 9.0)
    assert export.sentences(results.read(spark, str(tmp_path / "r.jsonl")), compat=True).first().socio_cultural_issues == "N; o; ."
    assert out[0].__fields__[:3] == ["topic", "text", "score"]
    (tmp_path / "one.json").write_text(json.dumps(ROW, indent=1))
    assert results.read(spark, str(tmp_path / "one.json"), multi_line=True).count() == 1


def test_sinks(spark, tmp_path):
    rows = talk(spark, ONE).withColumn("use_tools", F.lit(True))
    for _ in range(2):
        results.accept(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "language=Arabic").is_dir()
    back = results.read_accepted(spark, str(tmp_path / "out"), "scenario_id long, first_language string, instances array<string>")
    assert [r.instances for r in back.collect()] == [[ONE]] * 2
    results.export_csv(spark.createDataFrame([('a "quoted", text\nwith a line', 1)], "t string, n int"), str(tmp_path / "csv"), single=True)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first().t == 'a "quoted", text\nwith a line'


def test_tools(spark):
    class Broken:
        name = "broken"

        def run(self):
            raise KeyError("no column")

    both = tools.registered() | {"broken": Broken()}
    got = talk(spark, ONE, "12 !").select(tools.merged(both).alias("m")).first().m
    assert got == {"word_count": "26", "broken": "ERROR: 'no column'"}
    with pytest.raises(TypeError):
        tools.register(type("NoName", (), {}))


def test_generator_retries_and_replay(spark):
    calls = talk(spark, key=5).drop("instances")

    class Asked:
        n = 0

    def answer(prompt):
        Asked.n += 1
        return ["x", prompt] if Asked.n > 3 else []

    row = agents.call(calls, agents.rendered("{cs_ratio} {missing}", ["cs_ratio"]), answer).first()
    assert row.instances == ["x", "30% {missing}"]
    assert agents.call(calls, F.lit("p"), lambda p: []).first().instances == []


def test_pipeline_modes(spark):
    base = talk(spark, ONE, TWO, THREE).withColumnRenamed("instances", "given")
    generate = lambda df: df.withColumn("instances", F.col("given"))
    evaluate = lambda df: df.withColumns({"fluency_result": F.struct(F.lit(9.0).alias("fluency_score")), "naturalness_result": F.struct(F.lit(8.5).alias("naturalness_score")), "social_cultural_result": F.struct(F.lit(9.0).alias("socio_cultural_score"))})
    row = pipeline.run(base, generate, evaluate, tools=True).first()
    assert (row.score, row.refine_count, row.instances) == (7.074999999999999, 3, [ONE, TWO, THREE])
    assert row.cs_ratio_result.notes == "Target: 30%, Actual: 54.7%. Counted 29 Arabic words and 35 English words." and row.mcp_result == {"word_count": "64"}
    better = lambda df: df.withColumn("instances", F.array(F.lit("مرحبا مرحبا hello")))
    redone = pipeline.run(base, generate, evaluate, refine_mode="reevaluate", refine=better).first()
    assert redone.refine_count == 3 and redone.score > row.score and "mcp_result" not in redone
    assert pipeline.run(base, generate, evaluate, method="script_majority").first().cs_ratio_result.computed_ratio.endswith("%")
    with pytest.raises(ValueError):
        pipeline.run(base, generate, evaluate, refine_mode="other")


def test_news(spark):
    raw = spark.createDataFrame([("a", "t1", "c1", None), ("a", "t2", "c2", None), ("b", "t", "c", "error")], "topic string, title string, content string, type string")
    picked = {r.topic: r.article for r in lookup.pick_one(lookup.articles(raw)).collect()}
    assert picked["a"] in ("t1\nc1", "t2\nc2") and picked["b"] == ""
    joined = lookup.with_news(spark.createDataFrame([("a",), ("z",)], "topic string"), lookup.pick_one(lookup.articles(raw)))
    assert {r.topic: r.article for r in joined.collect()} == {"a": picked["a"], "z": ""}


def test_plans_stay_where_they_should(spark, sf_dir):
    from tessera import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    measured = plan(queries.q_ratio_first_letter(spark, sf_dir))
    assert "hashpartitioning" not in measured and "Python" not in measured and "ReadSchema: struct<doc_id:bigint,text:string>" in measured
    assert "CartesianProduct" not in plan(queries.q_scenario_cross_product(spark, sf_dir))


def test_whole_exports_have_every_line_of_every_document(spark, sf_dir):
    from tessera import queries

    lines = sorted(r.line for r in queries.fixture(spark, sf_dir).select(F.explode("instances").alias("line")).collect())
    assert sorted(r.text for r in queries.q_export_sentences(spark, sf_dir).select("text").collect()) == lines
    back = queries.q_accept_sink_roundtrip(spark, sf_dir).select(F.explode(F.split("sentences", "[|]")).alias("line"))
    assert sorted(r.line for r in back.collect()) == sorted(x for line in lines for x in line.split("|"))


def test_exports_of_empty_and_null_lists(spark):
    from tessera.operators import export

    states = spark.createDataFrame([("a", [], "[]"), ("b", None, None), ("c", ["x", None], '{"s":1}')], "topic string, instances array<string>, errors string")
    agent = lambda *fields: F.struct(*(F.lit("1").alias(f) for f in fields), F.lit("s").alias("summary"))
    states = states.select(
        "topic", "instances", F.struct(F.lit(1.0).alias("fluency_score"), "errors", F.lit("s").alias("summary")).alias("fluency_result"), agent("naturalness_score", "observations").alias("naturalness_result"),
        agent("ratio_score", "computed_ratio", "notes").alias("cs_ratio_result"), agent("socio_cultural_score", "issues").alias("social_cultural_result"),
    )
    got = {(r.topic, r.sentence_index, r.text, r.fluency_errors) for r in export.sentences(states).collect()}
    assert got == {("a", 0, None, ""), ("b", 0, None, ""), ("c", 0, "x", "s"), ("c", 1, None, "s")}


def test_whole_lists_news_and_product(spark, sf_dir):
    from tessera import queries

    docs = {r.scenario_id: r.instances for r in queries.fixture(spark, sf_dir).select("scenario_id", "instances").collect()}
    counts = {r.scenario_id: r.word_count for r in queries.q_word_count_tool(spark, sf_dir).collect()}
    joined = {r.scenario_id: r.plain for r in queries.q_join_any(spark, sf_dir).collect()}
    assert {k: len(v.split("; ")) if v else 0 for k, v in joined.items()} == counts
    for r in queries.q_news_pick(spark, sf_dir).collect():
        title, _, content = r.article.partition("\n")
        assert content == "\n".join(docs[int(title.removeprefix("title "))])
    assert queries.q_scenario_cross_product(spark, sf_dir).distinct().count() == scenarios.count(scenarios.config_of(queries.lists(spark, sf_dir), "Arabic", "English"))


def test_tools_that_fail_at_a_row_and_in_sql(spark):
    half = tools.FunctionTool("half", lambda n: 10 // n, "scenario_id")
    df = spark.createDataFrame([(0, ["a b"]), (5, None)], "scenario_id long, instances array<string>")
    got = {r.scenario_id: r.m for r in df.select("scenario_id", tools.merged({"half": half, **tools.registered()}).alias("m")).collect()}
    assert got == {0: {"half": "ERROR: integer division or modulo by zero", "word_count": "2"}, 5: {"half": "2", "word_count": "0"}}
    assert tools.register_sql(spark, {"half": half}) == ["half"]
    assert spark.sql("SELECT half(4) AS h").first().h == "2"
    one = df.select(tools.updated(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), tools.updated(F.lit(None), F.create_map(F.lit("b"), F.lit("3"))).alias("n")).first()
    assert one.m == {"a": "1", "b": "3"} and one.n == {"b": "3"}


def test_evaluators_and_generators_with_typed_replies(spark):
    base = talk(spark, ONE, TWO, THREE).drop("instances").withColumn("topic", F.lit("sports"))
    said = {"generate": json.dumps({"instances": [ONE, TWO, THREE]}), "fluency": json.dumps({"fluency_score": 9, "errors": {}, "summary": "s"}), "naturalness": json.dumps({"naturalness_score": 8.5, "observations": {"sentence_1": "x"}}), "social": json.dumps({"socio_cultural_score": 9, "issues": ["a", 1]}), "ratio": json.dumps({"ratio_score": 1, "computed_ratio": "1% : 99%", "notes": "too much English"})}

    def answer(prompt):
        kinds = {"Main language": "generate", "counted": "ratio", "grammar": "fluency", "Would speakers": "naturalness", "suit a speaker": "social"}
        return said[next(v for k, v in kinds.items() if k in prompt)]

    ask = agents.called(answer)
    judges = agents.standard(ask)
    generate = lambda df: agents.Generator(ask)(df).withColumn("data_generation_result", F.to_json("instances"))
    evaluate = lambda df: judges["social_cultural_result"](judges["naturalness_result"](judges["fluency_result"](df)))
    row = pipeline.run(base, generate, evaluate, ask_ratio=judges["cs_ratio_result"]).first()
    assert (row.score, row.instances) == (7.074999999999999, [ONE, TWO, THREE])
    assert tuple(row.cs_ratio_result) == (0.0, "54.7% English : 45.3% Arabic", "too much English")
    assert row.naturalness_result.observations == '{"sentence_1":"x"}' and row.social_cultural_result.issues == '["a",1]'
    said["ratio"] = "no JSON"
    assert pipeline.run(base, generate, evaluate, ask_ratio=judges["cs_ratio_result"]).first().cs_ratio_result.notes == "Counted 29 Arabic words and 35 English words. Target: 30%"
    noted = pipeline.run(base.withColumn("remark", F.lit("fine")), generate, evaluate, notes="remark").first()
    assert noted.cs_ratio_result.notes == "fine"
    shown = agents.ratio_context(ratio.first_letter(talk(spark, ONE, target="30%"))).first()
    assert (shown.actual_percent, shown.target_second_percent, shown.target_first_percent) == ("54.2%", "30.0%", "70.0%")
    assert agents.ratio_context(ratio.first_letter(talk(spark, ONE, target="Low"))).first().target_first_percent == "100.0%"


def test_ratio_evaluator_is_not_asked_without_a_ratio(spark):
    asked = []

    def ask(df):
        asked.append(sorted(r.scenario_id for r in df.select("scenario_id").collect()))
        return df.withColumn("cs_ratio_result", F.struct(F.lit(3.0).alias("ratio_score"), F.lit("x").alias("computed_ratio"), F.lit("said").alias("notes")))

    rows = talk(spark, ONE, target="50%").union(talk(spark, ONE, first="Klingon", key=1))
    got = {r.scenario_id: tuple(r.cs_ratio_result) for r in pipeline.with_ratio(rows, "script_majority", ask=ask).collect()}
    assert asked == [[0]] and got[0] == (3.0, "48% : 52%", "said") and got[1][:2] == (0.0, "N/A")


def test_stream_appends_accepted_rows_only(spark, tmp_path):
    from tessera.streaming import accept

    spark.createDataFrame([(1, "Arabic", 9.0, 0), (2, "Arabic", 5.0, 0), (3, "French", 5.0, 1)], "scenario_id long, first_language string, score double, refine_count int").write.json(str(tmp_path / "in"))
    schema = "scenario_id bigint, first_language string, score double, refine_count int"
    for _ in range(2):
        accept.accept_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "at"), refine_sink=str(tmp_path / "again"))
    assert sorted(r.scenario_id for r in accept.accepted(spark, str(tmp_path / "out"), schema).collect()) == [1, 3]
    assert [(r.scenario_id, r.decision) for r in accept.accepted(spark, str(tmp_path / "again"), schema).collect()] == [(2, "REFINE")]


def test_running_count_of_sparse_and_repeated_keys(spark):
    keys = sorted([i * i * 10**9 for i in range(500)] + [7] * 40)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    got = sorted((r.k, r.n_done) for r in report.progress(df, "k", 50).collect())
    assert got == [(keys[n - 1], n) for n in range(50, len(keys) + 1, 50)]


def test_report_text(spark):
    rows = spark.createDataFrame([(0, "70%", "79% : 21%", 7.0), (1, "70%", "70% : 30%", 4.5), (2, "70%", None, None)], "row long, cs_ratio string, computed_ratio string, ratio_score double")
    got = [r.line for r in report.lines(rows, "row", "matrix").orderBy("part", "key").collect()]
    assert got == ["rows: 3", "columns: row, cs_ratio, computed_ratio, ratio_score", "mismatch_count: 2", "sample_mismatches:", "- row 0: cs_ratio=70% computed_ratio=79% : 21% ratio_score=7", "- row 2: cs_ratio=70% computed_ratio=None ratio_score=None", "ratio_score stats: count=2 min=4.5 max=7 mean=5.75"]
    counts = spark.createDataFrame([(0, 0, 5, 1), (0, 1, 0, 0)], "row long, sentence int, matrix long, embedded long")
    assert [r.line for r in report.sentence_lines(counts, "row").orderBy("row", F.col("sentence").asc_nulls_first()).collect()] == ["row 0:", "  sentence 1: matrix_pct=83 words=5/1", "  sentence 2: matrix_pct=N/A words=0/0"]


def test_small_selections(spark):
    df = scenarios.product(spark, CONFIG)
    assert scenarios.first_of(df).first().scenario_id == 0
    with pytest.raises(ValueError):
        scenarios.first_of(df.limit(0))
    news = spark.createDataFrame([("a", "x"), ("b", "y")], "topic string, article string")
    assert lookup.sample_one(news).count() == 1 and lookup.sample_one(news.limit(0)).count() == 0
    large = scenarios.product(spark, CONFIG).where("scenario_id = 1").select(F.expr("scenario_id").alias("n")).first().n
    assert large == 1
    shown = export.preview(spark.createDataFrame([("t", "30%", "r", 1.0, None, 0, 0, "x")], "topic string, cs_ratio string, cs_ratio_computed string, cs_ratio_score double, cs_ratio_notes string, sentence_index int, refine_count int, text string"), ["topic"], compat=True).first()
    assert shown.cs_ratio_notes == "nan"

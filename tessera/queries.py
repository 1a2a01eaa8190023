"""Registered queries of the bilingual operators, and their SQL twins.

The tables hold Latin text only, so a fixture makes it bilingual: every word of a
length divisible by three is lower-cased and written in Arabic letters, in Spark and
in SQL alike.  A document is a scenario and its lines are the generated sentences.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ratio, scoring, text
from tessera.functions.scripts import LANGUAGE_RANGES, SCRIPT_RANGES, ranges
from tessera.operators import export, lookup, report, scenarios
from tessera.plans import agents, pipeline, prompts, tables, tools
from tessera.sources import batches, results, storage
from tessera.sources import lists as list_source
from tessera.streaming import accept

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
#: The separators of text.WHITE_SPACE in the syntax of RE2.
WS = text.WHITE_SPACE

#: The table and expression whose different values are the list of each scenario column.
LISTS = {
    "topic": ("region", "r_name"),
    "tense": ("conversations", "role"),
    "perspective": ("documents", "lang"),
    "gender": ("labels", "quality"),
    "age": ("customer", "c_mktsegment"),
    "education_level": ("orders", "o_orderstatus"),
    "cs_ratio": ("customer", "concat(20 * (c_custkey % 3) + 30, '%')"),
    "conversation_type": ("lineitem", "l_linestatus"),
    "cs_function": ("orders", "o_orderpriority"),
    "cs_type": ("lineitem", "l_returnflag"),
}


def lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{value} AS {name}") for name, (table, value) in LISTS.items()}


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.product(spark, scenarios.config_of(lists(spark, sf_dir), "Arabic", "English", use_tools=True))


def mixed(line: Column) -> Column:
    """A line with every word of a length divisible by three in Arabic letters."""
    word = lambda w: F.when(F.length(w) % 3 == 0, F.translate(F.lower(w), LATIN, ARABIC)).otherwise(w)
    return F.array_join(F.transform(F.split(line, " "), word), " ")


def rounded(x: Column) -> Column:
    """A number with six decimals, as SQL rounds it: a million times it as a double, to the nearest whole number.

    Spark's own ``round`` takes the shortest decimal form for the number, so that 4.0296875, which is a little less, is rounded up.
    """
    return F.round(x * 1e6) / 1e6


def fixture(spark: SparkSession, sf_dir: str, first: str = "Arabic", second: str = "English") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if tasks := spark.conf.get("spark.tessera.scanTasks", None):  # for files of one row group, as the benchmark's are
        docs = docs.repartition(int(tasks))
    score = lambda k: (F.col("doc_id") * k % 21) / F.lit(2.0)
    return docs.select(
        F.col("doc_id").alias("scenario_id"),
        F.concat(F.lit("topic"), (F.col("doc_id") % 9).cast("string")).alias("topic"),
        F.element_at(F.array(*map(F.lit, ["70%", "50%", "30%", "Low"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("cs_ratio"),
        F.lit(first).alias("first_language"),
        F.lit(second).alias("second_language"),
        F.transform(F.split("text", "\n"), mixed).alias("instances"),
        score(7).alias("fluency_score"),
        score(11).alias("naturalness_score"),
        score(13).alias("socio_cultural_score"),
    )


FIXTURE = f"""
fixture AS (
  SELECT doc_id AS scenario_id, 'topic' || (doc_id % 9) AS topic, ['70%', '50%', '30%', 'Low'][doc_id % 4 + 1] AS cs_ratio,
    list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda w: CASE WHEN length(w) % 3 = 0 THEN translate(lower(w), '{LATIN}', '{ARABIC}') ELSE w END), ' ')) AS instances,
    (doc_id * 7 % 21) / 2.0::DOUBLE AS fluency_score, (doc_id * 11 % 21) / 2.0::DOUBLE AS naturalness_score, (doc_id * 13 % 21) / 2.0::DOUBLE AS socio_cultural_score
  FROM documents
), lines AS (
  SELECT scenario_id, generate_subscripts(instances, 1) - 1 AS sentence, unnest(instances) AS line FROM fixture
), words AS (
  SELECT scenario_id, sentence, unnest(list_filter(regexp_split_to_array(line, '{WS}'), lambda w: w <> '')) AS w FROM lines
), coded AS (
  SELECT *, CASE WHEN regexp_extract(w, '\\p{{L}}') <> '' THEN unicode(regexp_extract(w, '\\p{{L}}')) END AS code FROM words
)"""


def measured_sql(lo1: int = 0x600, hi1: int = 0x6FF, first: str = "Arabic", second: str = "English", lo2: int = 0, hi2: int = 0xFF) -> str:
    """CTE ``measured``: counts, shares and ratio text of each scenario."""
    one, two = f"code BETWEEN {lo1} AND {hi1}", f"code BETWEEN {lo2} AND {hi2}"
    return f"""{FIXTURE}, counted AS (
  SELECT scenario_id, count(*) FILTER ({one}) AS n1, count(*) FILTER ({two} AND NOT {one}) AS n2, count(*) AS n FROM coded GROUP BY scenario_id
), measured AS (
  SELECT f.*, coalesce(n1, 0) AS lang1_word_count, coalesce(n2, 0) AS lang2_word_count,
    CASE WHEN n1 + n2 > 0 THEN n - n1 - n2 END AS unknown_words, CASE WHEN n1 + n2 > 0 THEN n1 + n2 END AS total_words,
    coalesce(n1 / nullif(n1 + n2, 0)::DOUBLE * 100, 0.0) AS lang1_percent, coalesce(n2 / nullif(n1 + n2, 0)::DOUBLE * 100, 0.0) AS lang2_percent,
    CASE WHEN n1 + n2 > 0 THEN printf('%.1f', n2 / (n1 + n2)::DOUBLE * 100) || '% {second} : ' || printf('%.1f', n1 / (n1 + n2)::DOUBLE * 100) || '% {first}' ELSE '0% : 0%' END AS computed_ratio,
    CASE WHEN n1 + n2 > 0 THEN 'Counted ' || n1 || ' {first} words and ' || n2 || ' {second} words.' ELSE 'No words detected in text.' END AS details
  FROM fixture f LEFT JOIN counted USING (scenario_id)
), scored AS (
  SELECT *, CASE WHEN cs_ratio = 'Low' THEN 5.0 ELSE greatest(0.0, 10.0 - abs(lang2_percent - rtrim(cs_ratio, '%')::DOUBLE) * 0.5) END AS ratio_score FROM measured
), finished AS (
  SELECT *, fluency_score * 0.3::DOUBLE + naturalness_score * 0.25::DOUBLE + ratio_score * 0.2::DOUBLE + socio_cultural_score * 0.25::DOUBLE AS score FROM scored
)"""


COUNTS = ["scenario_id", "lang1_word_count", "lang2_word_count", "unknown_words", "total_words", "lang1_percent", "lang2_percent", "computed_ratio", "details"]
MEASURED = measured_sql()


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured, scored and weighted scenarios."""
    rows = ratio.first_letter(fixture(spark, sf_dir)).withColumn("ratio_score", scoring.linear_score(F.col("lang2_percent"), F.col("cs_ratio")))
    return rows.withColumn("score", scoring.weighted_score())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = finished(spark, sf_dir).withColumn("decision", scoring.decision(F.col("score"), F.lit(0)))
    return done.select("scenario_id", "topic", "cs_ratio", "lang1_word_count", "lang2_word_count", "computed_ratio", rounded(F.col("ratio_score")).alias("ratio_score"), rounded(F.col("score")).alias("score"), "decision")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted results in the shape that sinks and exports take, with all lines of every document."""
    rows = finished(spark, sf_dir)
    errors = F.to_json(F.array("topic", "cs_ratio"))
    return rows.select(
        "scenario_id", "topic", "cs_ratio", "first_language", "second_language", rounded(F.col("score")).alias("score"),
        F.when(F.col("score") < 8, 3).otherwise(0).alias("refine_count"),
        "instances",
        F.struct("fluency_score", errors.alias("errors"), F.lit("fluent").alias("summary")).alias("fluency_result"),
        F.struct("naturalness_score", F.lit("{}").alias("observations"), F.lit("natural").alias("summary")).alias("naturalness_result"),
        F.struct(rounded(F.col("ratio_score")).alias("ratio_score"), "computed_ratio", F.concat(F.lit(" Target:\n"), "cs_ratio").alias("notes")).alias("cs_ratio_result"),
        F.struct("socio_cultural_score", F.lit("No").alias("issues"), F.lit("polite").alias("summary")).alias("social_cultural_result"),
    )


STATES_SQL = f"""{MEASURED}, states AS (
  SELECT *, CASE WHEN score < 8 THEN 3 ELSE 0 END AS refine_count, instances AS kept, topic || '; ' || cs_ratio AS fluency_errors FROM finished
)"""


# --- scenarios ---


def q_scenario_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product(spark, sf_dir)


def product_sql() -> str:
    joins, number = [], "0"
    for name, (table, value) in LISTS.items():
        joins.append(f"(SELECT v AS {name}, row_number() OVER (ORDER BY v) - 1 AS i_{name}, count(*) OVER () AS n_{name} FROM (SELECT DISTINCT ({value})::VARCHAR AS v FROM {table}) WHERE v IS NOT NULL)")
        number = f"({number}) * n_{name} + i_{name}"
    return f"SELECT ({number})::BIGINT AS scenario_id, {', '.join(LISTS)}, true AS use_tools, 'Arabic' AS first_language, 'English' AS second_language FROM {' CROSS JOIN '.join(joins)}"


def q_scenario_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.cross_product(lists(spark, sf_dir))


def q_scenario_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.batches(product(spark, sf_dir)).select("scenario_id", "batch_id")


def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.progress(fixture(spark, sf_dir), "scenario_id", 10)


# --- words and ratios ---


def q_word_count_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir).select("scenario_id", text.count_words(F.col("instances")).alias("word_count"))


def q_tools_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = fixture(spark, sf_dir).select("scenario_id", tools.merged().alias("mcp_result"))
    return merged.select("scenario_id", F.map_keys("mcp_result")[0].alias("tool"), F.col("mcp_result")["word_count"].alias("value"))


def q_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixture(spark, sf_dir).select("scenario_id", "first_language", "second_language", F.explode("instances").alias("line"))
    words = lines.select("scenario_id", F.explode(text.words(F.col("line"))).alias("word"), "first_language", "second_language")
    kind = ratio.word_language(F.col("word"), F.col("first_language"), F.col("second_language"))
    return words.groupBy("scenario_id", kind.alias("word_language")).agg(F.count("*").alias("n_words"))


def q_ratio_first_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.first_letter(fixture(spark, sf_dir)).select(*COUNTS)


def q_ratio_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.with_shares(ratio.first_letter_grouped(fixture(spark, sf_dir), "scenario_id")).select(*COUNTS)


def q_ratio_same_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.first_letter(fixture(spark, sf_dir, "French", "English")).select(*COUNTS)


def q_ratio_unknown_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.first_letter(fixture(spark, sf_dir, "Cantonese", "Arabic")).select(*COUNTS)


def q_ratio_per_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ratio.per_sentence(fixture(spark, sf_dir), "scenario_id")
    return counts.withColumn("matrix_pct", ratio.matrix_percent(F.col("matrix"), F.col("embedded"))).withColumn("sentence_number", F.col("sentence") + 1)


def q_ratio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_sentence(ratio.per_sentence(fixture(spark, sf_dir), "scenario_id"), "scenario_id")


SENTENCES_SQL = """, sentences AS (
  SELECT scenario_id, sentence, count(*) FILTER (code BETWEEN 1536 AND 1791) AS matrix, count(*) FILTER (code BETWEEN 0 AND 255) AS embedded
  FROM lines LEFT JOIN coded USING (scenario_id, sentence) GROUP BY ALL
)"""


def q_ratio_script_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir).withColumn("second_language", F.when(F.col("scenario_id") % 10 == 7, "Klingon").when(F.col("scenario_id") % 10 == 8, " ARABIC").otherwise("English"))
    return ratio.script_majority(rows).select("scenario_id", "matrix_count", "embedded_count", "computed_ratio", "ratio_score", "notes")


SCRIPT_SQL = f"""{FIXTURE}, tokens AS (
  SELECT scenario_id, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_'']+')) AS t FROM lines
), votes AS (
  SELECT scenario_id, length(regexp_replace(t, '[^\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{08A0}}-\\x{{08FF}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]', '', 'g')) AS m,
    length(regexp_replace(t, '[^\\p{{Latin}}]|[ªº]', '', 'g')) AS e FROM tokens
), majority AS (
  SELECT scenario_id, count(*) FILTER (m > e) AS m, count(*) FILTER (e > m) AS e FROM votes GROUP BY scenario_id
), shares AS (
  SELECT f.scenario_id, cs_ratio, f.scenario_id % 10 AS k, CASE WHEN f.scenario_id % 10 IN (7, 8) THEN 0 ELSE coalesce(m, 0) END AS m, CASE WHEN f.scenario_id % 10 IN (7, 8) THEN 0 ELSE coalesce(e, 0) END AS e
  FROM fixture f LEFT JOIN majority USING (scenario_id)
), pct AS (
  SELECT *, CASE WHEN m + e > 0 THEN round_even(100 * m / (m + e)::DOUBLE, 0)::INT END AS p, CASE WHEN cs_ratio = 'Low' THEN 0.0 ELSE rtrim(cs_ratio, '%')::DOUBLE END AS target FROM shares
)
SELECT scenario_id, m AS matrix_count, e AS embedded_count, coalesce(p || '% : ' || (100 - p) || '%', 'N/A') AS computed_ratio,
  CASE WHEN p IS NULL THEN 0.0 WHEN abs(p - target) <= 5 THEN 10.0 WHEN abs(p - target) <= 10 THEN 8.0 WHEN abs(p - target) <= 15 THEN 6.0 WHEN abs(p - target) <= 20 THEN 4.0 WHEN abs(p - target) <= 25 THEN 2.0 ELSE 0.0 END::DOUBLE AS ratio_score,
  CASE WHEN k = 7 THEN 'Unknown script mapping for one or both languages; deterministic ratio not computed.'
    WHEN k = 8 THEN 'Both languages share the same script; deterministic script-based ratio not possible.'
    WHEN m + e = 0 THEN 'No identifiable script characters found for either language.'
    ELSE 'Deterministic script ratio using Arabic/English (arabic/latin).' END AS notes
FROM pct"""


def q_range_join_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.words_by_script(fixture(spark, sf_dir), "scenario_id")


RANGES_SQL = ", ".join(f"('{s}', {lo}, {hi})" for s, rs in SCRIPT_RANGES.items() for lo, hi in rs)


# --- scores ---


def q_score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, sf_dir).select("scenario_id", "cs_ratio", rounded(F.col("ratio_score")).alias("ratio_score"))


def q_score_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.first_letter(fixture(spark, sf_dir)).select("scenario_id", scoring.step_score(F.col("lang1_percent"), F.col("cs_ratio")).alias("ratio_score"))


def q_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, sf_dir).select("scenario_id", rounded(F.col("score")).alias("score"))


def q_score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finished(spark, sf_dir).select("scenario_id", F.inline(scoring.contributions()))
    return rows.select("scenario_id", "dimension", rounded(F.col("score")).alias("score"), "weight", rounded(F.col("contribution")).alias("contribution"))


def q_accept_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = scoring.decision(F.col("score"), F.lit(0))
    rows = finished(spark, sf_dir).withColumn("first_decision", first).withColumn("refine_count", F.when(F.col("first_decision") == "REFINE", 3).otherwise(0))
    return rows.select("scenario_id", "first_decision", "refine_count", scoring.decision(F.col("score"), F.col("refine_count")).alias("final_decision"))


def q_strict_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.least("fluency_score", "naturalness_score", "ratio_score", "socio_cultural_score")
    return finished(spark, sf_dir).select("scenario_id", scoring.decision(F.col("score"), F.lit(0), least=least).alias("decision"))


# --- sinks, exports and reports ---


def q_accept_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).select("scenario_id", "topic", F.when(F.col("scenario_id") % 2 == 0, "Arabic").otherwise("English").alias("first_language"), "score", "refine_count", "instances", F.lit(True).alias("use_tools"))
    path = results.folder(spark, "accepted")
    results.accept(rows.where("scenario_id % 2 = 0"), path)
    results.accept(rows.where("scenario_id % 2 = 1"), path)
    back = results.read_accepted(spark, path, "scenario_id bigint, topic string, first_language string, score double, refine_count int, instances array<string>")
    return back.select("scenario_id", "topic", "first_language", "score", "refine_count", F.array_join("instances", "|").alias("sentences"))


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source, sink, refine = results.folder(spark, "scored"), results.folder(spark, "streamed"), results.folder(spark, "to-refine")
    rows = _states(spark, sf_dir).select("scenario_id", "first_language", "score", (F.col("scenario_id") % 2).cast("int").alias("refine_count"))
    rows.repartition(4).write.json(source)
    schema = "scenario_id bigint, first_language string, score double, refine_count int"
    accept.accept_stream(spark, source, schema, sink, results.folder(spark, "progress"), files_per_batch=2, refine_sink=refine)
    return accept.accepted(spark, sink, schema), accept.accepted(spark, refine, schema)


def q_stream_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir)[0]


def q_stream_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir)[1]


def q_refine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).select("scenario_id", "refine_count")
    return accept.refine_counts(rows.unionByName(rows))


def q_export_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.sentences(_states(spark, sf_dir)).select(*EXPORTED)


EXPORTED = ["topic", "text", "score", "fluency_score", "cs_ratio_score", "fluency_errors", "naturalness_observations", "socio_cultural_issues", "cs_ratio_computed", "cs_ratio", "refine_count", "sentence_index", "socio_cultural_summary", "first_language", "tense"]


def q_export_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.scenarios(_states(spark, sf_dir)).select("scenario_id", "topic", "score", "cs_ratio", "first_language", "refine_count", "instances")


def q_results_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines whose values vary in type, with blank lines between them, read and exported: sentences as a list or as one text, errors as a list, an object or a text."""
    rows, path = _states(spark, sf_dir), results.folder(spark, "results")
    errors = F.col("fluency_result.errors")
    shapes = [
        (F.col("instances"), F.from_json(errors, "array<string>")),
        (F.array_join("instances", "\n"), F.create_map(F.col("topic"), F.lit("x"))),
        (F.col("instances"), F.col("topic")),
    ]
    lines = None
    for k, (given, of) in enumerate(shapes):
        fluency = F.struct("fluency_result.fluency_score", of.alias("errors"), F.lit("s").alias("summary"))
        some = rows.where(F.col("scenario_id") % 3 == k).select(F.to_json(F.struct("topic", "score", "first_language", given.alias("data_generation_result"), fluency.alias("fluency_result"), "cs_ratio_result")).alias("value"))
        some = some.select(F.explode(F.array("value", F.lit("  "))).alias("value"))
        lines = some if lines is None else lines.unionByName(some)
    lines.write.text(path)
    return export.sentences(results.read(spark, path)).select("topic", "text", "score", "fluency_score", "fluency_errors", "cs_ratio_computed", "sentence_index", "first_language", "tense")


def q_join_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.flatten(F.transform("instances", text.words)))
    return fixture(spark, sf_dir).select("scenario_id", text.listed(raw).alias("plain"), text.listed(raw, compat=True).alias("compat"))


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir).withColumn("topic", F.format_string("%s-%06d", "topic", "scenario_id"))
    return export.preview(export.sentences(states), ["topic", "sentence_index"])


def q_ratio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = report.statistics(finished(spark, sf_dir))
    return stats.select("n", *(rounded(F.col(c)).alias(c) for c in ("min_score", "max_score", "mean_score")))


def q_ratio_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.mismatches(ratio.script_majority(fixture(spark, sf_dir)), "matrix")
    return rows.select("scenario_id", "mismatch")


def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratio.script_majority(fixture(spark, sf_dir)).select("scenario_id", "cs_ratio", "computed_ratio", F.floor("ratio_score").cast("double").alias("ratio_score"))
    return report.lines(rows, "scenario_id", "matrix")


def q_report_sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sentence_lines(ratio.per_sentence(fixture(spark, sf_dir), "scenario_id"), "scenario_id")


def q_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.deviation(ratio.first_letter(fixture(spark, sf_dir))).select("scenario_id", rounded(F.col("deviation")).alias("deviation"))


def q_parse_computed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio texts of both methods, read back."""
    docs = fixture(spark, sf_dir)
    texts = ratio.first_letter(docs).select("scenario_id", F.lit("first_letter").alias("method"), "computed_ratio").unionByName(ratio.script_majority(docs).select("scenario_id", F.lit("script_majority").alias("method"), "computed_ratio"))
    return texts.select("scenario_id", "method", report.parsed(F.col("computed_ratio")).alias("p")).select("scenario_id", "method", "p.*")


# --- lookups, prompts and the whole pipeline ---


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as articles; topics 7 and 8 have none, so that lookups also miss."""
    raw = fixture(spark, sf_dir).where("topic < 'topic7'").select("topic", F.concat(F.lit("title "), "scenario_id").alias("title"), F.array_join("instances", "\n").alias("content"))
    return lookup.articles(raw)


NEWS_SQL = "news AS (SELECT topic, 'title ' || scenario_id || chr(10) || array_to_string(instances, chr(10)) AS article FROM fixture WHERE topic < 'topic7'), picked AS (SELECT topic, arg_min(article, md5('0:' || article)) AS article FROM news GROUP BY topic)"


def q_news_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.pick_one(_news(spark, sf_dir))


def q_news_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_news(fixture(spark, sf_dir), lookup.pick_one(_news(spark, sf_dir))).select("scenario_id", "topic", "article")


def q_news_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.sample_one(_news(spark, sf_dir))


def q_news_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = results.folder(spark, "news")
    fixture(spark, sf_dir).select("topic", F.concat(F.lit("title "), "scenario_id").alias("title"), F.array_join("instances", "\n").alias("content")).write.json(path)
    return lookup.read_news(spark, path)


def q_unseen_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unseen(fixture(spark, sf_dir), _news(spark, sf_dir))


def q_first_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.first_of(product(spark, sf_dir)).select("scenario_id", "topic", "cs_type")


def q_distinct_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.distinct_topics(fixture(spark, sf_dir))


TEMPLATE = "Write about {topic} in {first_language} with {cs_ratio} {second_language}; {unknown} stays."


def q_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir).select("scenario_id", agents.rendered(TEMPLATE, ["topic", "first_language", "second_language", "cs_ratio"]).alias("prompt"))


def q_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixture(spark, sf_dir)
    prompt = agents.rendered(TEMPLATE, ["topic", "first_language", "second_language", "cs_ratio"])
    replies = docs.where("topic <> 'topic4'").select(F.sha2(prompt, 256).alias("prompt_sha256"), F.concat(F.lit("reply to "), "topic", F.lit(" "), "cs_ratio").alias("reply")).distinct()
    return agents.replay(docs, replies, prompt, "answer").select("scenario_id", "answer")


def _replies(df: DataFrame, template: str, reply: Column) -> DataFrame:
    """A table of recorded replies for the prompts of all rows."""
    prompt = agents.rendered(template, df.columns)
    return df.select(F.sha2(prompt, 256).alias("prompt_sha256"), reply.alias("reply")).groupBy("prompt_sha256").agg(F.min("reply").alias("reply"))


def q_evaluator_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded replies of the fluency evaluator, of which some are no JSON, become typed results."""
    docs = fixture(spark, sf_dir).withColumn("data_generation_result", F.to_json("instances"))
    reply = F.when(F.col("topic") == "topic4", "sorry").otherwise(F.to_json(F.struct("fluency_score", F.array("topic").alias("errors"), F.col("cs_ratio").alias("summary"))))
    template = "{scenario_id}: " + prompts.FLUENCY
    ask = agents.replayed(_replies(docs, template, reply))
    found = agents.Evaluator("judged", template, agents.FLUENCY_REPLY, ask)(docs)
    return found.select("scenario_id", F.col("judged.fluency_score").alias("fluency_score_read"), text.listed(F.col("judged.errors")).alias("errors"), F.col("judged.summary").alias("summary"))


def q_ratio_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.ratio_context(ratio.first_letter(fixture(spark, sf_dir))).select("scenario_id", "actual_percent", "target_second_percent", "target_first_percent")


def _ratio_judge(df: DataFrame) -> DataFrame:
    return df.withColumn("cs_ratio_result", F.struct(F.lit(6.5).alias("ratio_score"), F.lit("wrong").alias("computed_ratio"), F.concat(F.lit("asked about "), "topic").alias("notes")))


def q_ratio_evaluator_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluator's score where there is a ratio; it isn't asked where there is none."""
    docs = fixture(spark, sf_dir).withColumn("second_language", F.when(F.col("topic") == "topic3", "Klingon").otherwise("English"))
    return pipeline.with_ratio(docs, "script_majority", ask=_ratio_judge).select("scenario_id", "cs_ratio_result.ratio_score", "cs_ratio_result.computed_ratio", "cs_ratio_result.notes")


def q_ratio_evaluator_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted score and ratio with an evaluator's notes, through the whole pipeline."""
    rows = pipeline.run(fixture(spark, sf_dir), lambda df: df, _evaluated, ask_ratio=_ratio_judge)
    return rows.select("scenario_id", rounded(F.col("score")).alias("score"), "cs_ratio_result.computed_ratio", "cs_ratio_result.notes")


def q_tools_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results as one map, the later values winning; a tool that fails at some rows says so there."""
    failing = tools.FunctionTool("third", lambda n: n // (n % 3), "scenario_id")
    first = F.create_map(F.lit("word_count"), F.lit("none"), F.lit("kept"), F.col("topic"))
    docs = fixture(spark, sf_dir).withColumn("all", tools.updated(first, tools.merged(tools.registered() | {"third": failing})))
    return docs.select("scenario_id", *(F.col("all")[k].alias(k) for k in ("word_count", "kept", "third")))


def q_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {"fluency_result": "fluency_score", "naturalness_result": "naturalness_score", "cs_ratio_result": "fluency_score", "social_cultural_result": "socio_cultural_score"}
    rows = fixture(spark, sf_dir).select("scenario_id", *(F.struct(F.col(score).alias("score"), F.col("topic").alias("summary")).alias(c) for c, score in scores.items()))
    return rows.select("scenario_id", pipeline.summary().alias("summary"))


def _evaluated(df: DataFrame) -> DataFrame:
    return df.withColumns({"fluency_result": F.struct("fluency_score"), "naturalness_result": F.struct("naturalness_score"), "social_cultural_result": F.struct("socio_cultural_score")})


def q_pipeline_as_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.run(fixture(spark, sf_dir), lambda df: df, _evaluated, tools=True)
    return rows.select("scenario_id", rounded(F.col("score")).alias("score"), "refine_count", F.col("cs_ratio_result.notes").alias("notes"), F.col("mcp_result")["word_count"].alias("word_count"))


def q_pipeline_reevaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shorter(df: DataFrame) -> DataFrame:
        return df.withColumns({"instances": F.array(F.lit("مرحبا hello")), "fluency_score": F.lit(9.0)})

    rows = pipeline.run(fixture(spark, sf_dir).withColumn("instances_", F.col("instances")), lambda df: df.withColumn("instances", F.col("instances_")), _evaluated, refine_mode="reevaluate", refine=shorter)
    return rows.select("scenario_id", rounded(F.col("score")).alias("score"), "refine_count", F.size("instances").cast("bigint").alias("n_sentences"))


# --- calls that fail, and calls that are kept ---


def q_prompt_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces in a value are text, whatever stands in them."""
    docs = fixture(spark, sf_dir).withColumn("remark", F.concat(F.lit("say {cs_ratio} of {topic} and {remark}, "), "topic"))
    return docs.select("scenario_id", agents.rendered("{topic}: {remark} at {cs_ratio} {}", docs.columns).alias("prompt"))


def q_failing_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluator that fails at some rows: the counted score stands there, with the details and the target as notes."""

    def judge(prompt: str) -> str:
        if prompt == "topic4":
            raise TimeoutError("no answer")
        return "{}" if prompt == "topic5" else json.dumps({"ratio_score": 1, "computed_ratio": "wrong", "notes": f"asked about {prompt}"})

    asked = agents.Evaluator("cs_ratio_result", "{topic}", agents.CS_RATIO_REPLY, agents.called(judge, retries=1, error="failure"))
    rows = pipeline.with_ratio(fixture(spark, sf_dir), ask=asked)
    return rows.select("scenario_id", rounded(F.col("cs_ratio_result.ratio_score")).alias("ratio_score"), "cs_ratio_result.computed_ratio", "cs_ratio_result.notes", "failure")


def q_resumable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that ask about every scenario, of which the first leaves failures: how many runs asked for each prompt, and its reply."""
    docs = fixture(spark, sf_dir).withColumn("sentences", F.array_join("instances", " "))
    log, template = agents.ReplyLog(results.folder(spark, "replies")), "{topic}: {sentences}"

    def answer(prompt: str) -> str:
        return f"{len(prompt)} characters"

    def sometimes(prompt: str) -> str:
        if prompt.startswith("topic4"):
            raise ConnectionError("busy")
        return answer(prompt)

    prompt = agents.rendered(template, docs.columns)
    log.ask(sometimes, retries=0)(docs, prompt, "reply")
    second = log.ask(answer, retries=0)(docs, prompt, "reply")
    log.ask(answer, retries=0)(docs, prompt, "reply")  # asks nobody
    asked = log.entries(spark).groupBy("prompt_sha256").agg(F.countDistinct("job").alias("n_runs"), F.count("*").alias("n_calls"))
    return second.withColumn("prompt_sha256", F.sha2(prompt, 256)).join(asked, "prompt_sha256").select("scenario_id", "reply", "n_runs", "n_calls")


# --- values of varying type, and tables of ranges ---


def q_variant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, objects, texts and numbers in one column, as rows."""
    shapes = [F.to_json("instances"), F.to_json(F.create_map("topic", "cs_ratio")), F.col("topic"), F.col("fluency_score").cast("string")]
    rows = fixture(spark, sf_dir).withColumn("raw", F.element_at(F.array(*shapes), (F.col("scenario_id") % 4 + 1).cast("int")))
    return export.items(rows, "scenario_id", "raw")


def q_range_join_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of an order, how many orders' totals begin a band that its price is in, and the widest of them.

    A band is a hundredth of the total wide, so that bands have all widths.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bands = orders.select(F.floor("o_totalprice").alias("lo"), F.floor(F.col("o_totalprice") * 1.01).alias("hi")).withColumn("widest", F.col("hi") - F.col("lo"))
    prices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("price"))
    met = prices.join(lookup.range_totals(prices, bands, "price", "widest"), "price")
    return met.groupBy("l_orderkey", "l_linenumber", "price").agg(F.sum("n_ranges").alias("n_bands"), F.max("widest").alias("widest"))


def q_language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each language by the table of its ranges, and the language with most."""
    return lookup.language_votes(fixture(spark, sf_dir), ranges(spark), "scenario_id")


# --- streams with a deadline, state and memory ---


#: Rows of a file of a stream's source.
FILE_ROWS = 1_000_000


def _arriving(rows: DataFrame, parts: Column, n: int, source: str, first: int = 0, files: int = 1) -> None:
    """Write the rows of each part as one more file of a stream's source, or as so many, in order."""
    for k in range(first, n):
        some = rows.where(parts == k)
        (some.repartition(files) if files > 1 else some.coalesce(1)).write.mode("append").json(source)


def q_stream_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, the third of which takes too long: its rows are noted as late, the others' are accepted."""
    source, sink, late, notes = (results.folder(spark, n) for n in ("arriving", "in-time", "late", "notes"))
    rows = _states(spark, sf_dir).select("scenario_id", "score")
    _arriving(rows, F.col("scenario_id") % 4, 4, source)

    def stuck(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and batch.column(0)[0].as_py() % 4 == 2:
                time.sleep(3600)
            yield batch

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.mapInArrow(stuck, batch.schema).write.mode("overwrite").json(f"{sink}/batch={batch_id}")

    schema = "scenario_id bigint, score double"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    accept.timed_batches(arriving, handle, results.folder(spark, "progress"), 25.0, notes, late)
    status = accept.noted(spark, notes).select("batch_id", "status")
    done = spark.read.schema(schema).option("recursiveFileLookup", True).json(sink).withColumn("batch_id", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("bigint"))
    both = done.unionByName(spark.read.schema(f"{schema}, batch_id bigint").json(late))
    return both.join(status, "batch_id").select("scenario_id", "score", "batch_id", "status")


def q_refine_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refinements of each scenario as a stream's state: two batches, a restart, and one more."""
    source, sink, progress = (results.folder(spark, n) for n in ("events", "states", "progress"))
    rows = storage.stored(_states(spark, sf_dir).select("scenario_id", "refine_count"), "counts")
    files = rows.count() // FILE_ROWS + 1  # each has rows, so that a batch is a part
    rows = rows.select("scenario_id", "refine_count", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    decision = F.when((F.col("scenario_id") + F.col("step")) % 2 == 0, "REFINE").otherwise("ACCEPT")
    rows = rows.select("scenario_id", "step", (F.col("refine_count") + F.col("step")).alias("refine_count"), decision.alias("decision"))
    schema = "scenario_id bigint, step int, refine_count int, decision string"
    for first, n in ((0, 2), (2, 3)):
        _arriving(rows, F.col("step"), n, source, first, files)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
        accept.refine_states(spark, arriving, sink, progress)
    return accept.refined(spark, sink)


def q_new_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that no earlier batch and no article had, over three batches and a restart."""
    source, sink, progress = (results.folder(spark, n) for n in ("talks", "topics", "progress"))
    rows, schema = fixture(spark, sf_dir).select("scenario_id", "topic"), "scenario_id bigint, topic string"
    for first, n in ((0, 2), (2, 3)):
        _arriving(rows, F.col("scenario_id") % 3, n, source, first)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        accept.new_topics(arriving, _news(spark, sf_dir), sink, progress)
    return spark.read.schema(schema).json(sink).groupBy("topic").agg(F.count("*").alias("n_times"))

# --- table functions, sources and sinks ---


def q_sentences_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT scenario_id, topic, sentence_index, text FROM sentences(TABLE({talks}), 'instances')", talks=fixture(spark, sf_dir))


def q_failing_tool_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool that can't handle every third row: these get their error, the others their value."""
    tables.register(spark, {"third": tools.FunctionTool("third", lambda n: n // (n % 3), "scenario_id")})
    return spark.sql("SELECT scenario_id, value, error FROM third_rows(TABLE({talks}))", talks=fixture(spark, sf_dir).select("scenario_id"))


def q_repeated_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, of which two come again, one of them after it was compacted: each row is there once."""
    rows, path = _states(spark, sf_dir).select("scenario_id", "topic", "first_language", "score"), results.folder(spark, "batches")
    schema = "scenario_id bigint, topic string, first_language string, score double"
    some = lambda k: rows.where(F.col("scenario_id") % 4 == k).withColumn("first_language", F.when(F.col("scenario_id") % 3 == 0, "Arabic").otherwise("English"))
    for k in (0, 1, 1):
        batches.append(some(k), path, k)
    batches.compact(spark, path, schema)
    for k in (0, 2, 3, 3):
        batches.append(some(k), path, k)
    return batches.read(spark, path, schema).groupBy("scenario_id", "topic", "first_language", "score").agg(F.count("*").alias("n_times"))


def q_news_pick_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.pick_some(_news(spark, sf_dir), 3)


def q_report_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = results.folder(spark, "report")
    report.write_sentences(ratio.per_sentence(fixture(spark, sf_dir), "scenario_id"), "scenario_id", path)
    return report.read_sentences(spark, path, "scenario_id").withColumn("scenario_id", F.col("scenario_id").cast("bigint"))


def q_scenario_lists_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files with the tables' different values, read as a table, and the product of their lists."""
    path = results.folder(spark, "lists")
    for name, values in lists(spark, sf_dir).items():
        values.distinct().agg(F.collect_list(name).alias(name)).coalesce(1).write.mode("append").json(path)
    list_source.register(spark)
    found = storage.stored(spark.read.format("scenario_lists").load(path), "values")
    return scenarios.cross_product({name: found.where(F.col("name") == name).select(F.col("value").alias(name)) for name in LISTS})



QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")} | {"flagship": flagship}

_COUNTS = f"SELECT {', '.join(COUNTS)} FROM measured"
ORACLES = {
    "scenario_product": product_sql(),
    "scenario_batches": f"SELECT scenario_id, ((row_number() OVER (ORDER BY md5('0:' || scenario_id), scenario_id) - 1) // 40)::BIGINT AS batch_id FROM (SELECT scenario_id FROM ({product_sql()}) ORDER BY md5('0:' || scenario_id), scenario_id LIMIT 8000)",
    "progress": "SELECT * FROM (SELECT doc_id AS scenario_id, row_number() OVER (ORDER BY doc_id) AS n_done FROM documents) WHERE n_done % 10 = 0",
    "word_count_tool": f"WITH {FIXTURE} SELECT scenario_id, count(w) AS word_count FROM fixture LEFT JOIN words USING (scenario_id) GROUP BY scenario_id",
    "tools_merge": f"WITH {FIXTURE} SELECT scenario_id, 'word_count' AS tool, count(w)::VARCHAR AS value FROM fixture LEFT JOIN words USING (scenario_id) GROUP BY scenario_id",
    "word_language": f"WITH {FIXTURE} SELECT scenario_id, CASE WHEN code BETWEEN 1536 AND 1791 THEN 'lang1' WHEN code BETWEEN 0 AND 255 THEN 'lang2' ELSE 'unknown' END AS word_language, count(*) AS n_words FROM coded GROUP BY ALL",
    "ratio_first_letter": f"WITH {MEASURED} {_COUNTS}",
    "ratio_grouped": f"WITH {MEASURED} {_COUNTS}",
    "ratio_same_script": f"WITH {measured_sql(0, 255, 'French', 'English')} {_COUNTS}",
    "ratio_unknown_lang": f"WITH {measured_sql(0, 255, 'Cantonese', 'Arabic', 0x600, 0x6FF)} {_COUNTS}",
    "ratio_per_sentence": f"WITH {FIXTURE}{SENTENCES_SQL} SELECT *, CASE WHEN matrix + embedded > 0 THEN round_even(100 * matrix / (matrix + embedded)::DOUBLE, 0)::INT END AS matrix_pct, sentence + 1 AS sentence_number FROM sentences",
    "ratio_rollup": f"WITH {FIXTURE}{SENTENCES_SQL} SELECT scenario_id, sentence, sum(matrix)::BIGINT AS matrix, sum(embedded)::BIGINT AS embedded, grouping(scenario_id, sentence)::BIGINT AS level, CASE WHEN sum(matrix + embedded) > 0 THEN round_even(100 * sum(matrix) / sum(matrix + embedded)::DOUBLE, 0)::INT END AS matrix_pct FROM sentences GROUP BY ROLLUP (scenario_id, sentence)",
    "ratio_script_majority": f"WITH {SCRIPT_SQL}",
    "range_join_script": f"WITH {FIXTURE}, ranges(script, lo, hi) AS (VALUES {RANGES_SQL}) SELECT scenario_id, script, count(*) AS n_words FROM coded JOIN ranges ON code BETWEEN lo AND hi GROUP BY ALL",
    "score_linear": f"WITH {MEASURED} SELECT scenario_id, cs_ratio, round(ratio_score, 6) AS ratio_score FROM scored",
    "score_step": f"WITH {MEASURED}, d AS (SELECT scenario_id, abs(lang1_percent - CASE WHEN cs_ratio = 'Low' THEN 0 ELSE rtrim(cs_ratio, '%')::DOUBLE END) AS diff FROM measured) SELECT scenario_id, (CASE WHEN diff <= 5 THEN 10 WHEN diff <= 10 THEN 8 WHEN diff <= 15 THEN 6 WHEN diff <= 20 THEN 4 WHEN diff <= 25 THEN 2 ELSE 0 END)::DOUBLE AS ratio_score FROM d",
    "weighted_score": f"WITH {MEASURED} SELECT scenario_id, round(score, 6) AS score FROM finished",
    "score_breakdown": f"WITH {MEASURED} SELECT scenario_id, dimension, round(value, 6) AS score, weight, round(value * weight, 6) AS contribution FROM (UNPIVOT (SELECT scenario_id, fluency_score, naturalness_score, ratio_score, socio_cultural_score FROM scored) ON fluency_score, naturalness_score, ratio_score, socio_cultural_score INTO NAME dimension VALUE value) JOIN (VALUES ('fluency_score', 0.3::DOUBLE), ('naturalness_score', 0.25::DOUBLE), ('ratio_score', 0.2::DOUBLE), ('socio_cultural_score', 0.25::DOUBLE)) AS w(dimension, weight) USING (dimension)",
    "accept_refine": f"WITH {MEASURED} SELECT scenario_id, CASE WHEN score < 8 THEN 'REFINE' ELSE 'ACCEPT' END AS first_decision, CASE WHEN score < 8 THEN 3 ELSE 0 END AS refine_count, 'ACCEPT' AS final_decision FROM finished",
    "strict_gates": f"WITH {MEASURED} SELECT scenario_id, CASE WHEN score < 8 OR least(fluency_score, naturalness_score, ratio_score, socio_cultural_score) < 5 THEN 'REFINE' ELSE 'ACCEPT' END AS decision FROM finished",
    "accept_sink_roundtrip": f"WITH {STATES_SQL} SELECT scenario_id, topic, CASE WHEN scenario_id % 2 = 0 THEN 'Arabic' ELSE 'English' END AS first_language, round(score, 6) AS score, refine_count, array_to_string(kept, '|') AS sentences FROM states",
    "export_sentences": f"WITH {STATES_SQL}, rows AS (SELECT *, unnest(CASE WHEN len(kept) = 0 THEN [NULL] ELSE kept END) AS text, generate_subscripts(CASE WHEN len(kept) = 0 THEN [NULL] ELSE kept END, 1) - 1 AS sentence_index FROM states) SELECT topic, text, round(score, 6) AS score, fluency_score, round(ratio_score, 6) AS cs_ratio_score, fluency_errors, '' AS naturalness_observations, 'No' AS socio_cultural_issues, computed_ratio AS cs_ratio_computed, cs_ratio, refine_count, sentence_index, 'polite' AS socio_cultural_summary, 'Arabic' AS first_language, NULL::VARCHAR AS tense FROM rows",
    "export_scenarios": f"WITH {STATES_SQL} SELECT scenario_id, topic, round(score, 6) AS score, cs_ratio, 'Arabic' AS first_language, refine_count, to_json(kept)::VARCHAR AS instances FROM states",
    "preview": f"WITH {STATES_SQL}, rows AS (SELECT *, topic || '-' || lpad(scenario_id::VARCHAR, 6, '0') AS name, unnest(CASE WHEN len(kept) = 0 THEN [NULL] ELSE kept END) AS text, generate_subscripts(CASE WHEN len(kept) = 0 THEN [NULL] ELSE kept END, 1) - 1 AS sentence_index FROM states) SELECT name AS topic, cs_ratio, computed_ratio AS cs_ratio_computed, printf('%.2f', round(ratio_score, 6)) AS cs_ratio_score, 'Target: ' || cs_ratio AS cs_ratio_notes, sentence_index, refine_count, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS text FROM rows ORDER BY name, sentence_index LIMIT 12",
    "ratio_stats": f"WITH {MEASURED} SELECT count(*) AS n, round(min(ratio_score), 6) AS min_score, round(max(ratio_score), 6) AS max_score, round(avg(ratio_score), 6) AS mean_score FROM scored",
    "ratio_mismatch": "WITH " + SCRIPT_SQL.replace(" IN (7, 8)", " IN (10, 11)").rpartition("SELECT scenario_id, m AS")[0] + " SELECT scenario_id, coalesce(cs_ratio = 'Low' OR p <> target OR p IS NULL, true) AS mismatch FROM pct",
    "news_pick": f"WITH {FIXTURE}, {NEWS_SQL} SELECT * FROM picked",
    "news_lookup": f"WITH {FIXTURE}, {NEWS_SQL} SELECT scenario_id, topic, coalesce(article, '') AS article FROM fixture LEFT JOIN picked USING (topic)",
    "distinct_topics": "SELECT DISTINCT 'topic' || (doc_id % 9) AS topic FROM documents",
    "prompt_render": f"WITH {FIXTURE} SELECT scenario_id, 'Write about ' || topic || ' in Arabic with ' || cs_ratio || ' English; {{unknown}} stays.' AS prompt FROM fixture",
    "replay": f"WITH {FIXTURE} SELECT scenario_id, CASE WHEN topic <> 'topic4' THEN 'reply to ' || topic || ' ' || cs_ratio END AS answer FROM fixture",
    "pipeline_as_coded": f"WITH {MEASURED}, n AS (SELECT scenario_id, count(*) AS n FROM words GROUP BY ALL) SELECT scenario_id, round(score, 6) AS score, CASE WHEN score < 8 THEN 3 ELSE 0 END AS refine_count, 'Target: ' || cs_ratio || ', Actual: ' || printf('%.1f', lang2_percent) || '%. ' || details AS notes, coalesce(n, 0)::VARCHAR AS word_count FROM finished LEFT JOIN n USING (scenario_id)",
    "pipeline_reevaluate": f"WITH {MEASURED} SELECT scenario_id, round(CASE WHEN score < 8 THEN 9.0::DOUBLE * 0.3::DOUBLE + naturalness_score * 0.25::DOUBLE + CASE cs_ratio WHEN '50%' THEN 10.0 WHEN 'Low' THEN 5.0 ELSE 0.0 END * 0.2::DOUBLE + socio_cultural_score * 0.25::DOUBLE ELSE score END, 6) AS score, CASE WHEN score < 8 THEN 3 ELSE 0 END AS refine_count, CASE WHEN score < 8 THEN 1 ELSE len(instances) END AS n_sentences FROM finished",
    "flagship": f"WITH {MEASURED} SELECT scenario_id, topic, cs_ratio, lang1_word_count, lang2_word_count, computed_ratio, round(ratio_score, 6) AS ratio_score, round(score, 6) AS score, CASE WHEN score < 8 THEN 'REFINE' ELSE 'ACCEPT' END AS decision FROM finished",
}
_ALL_WORDS = f"array_to_string(list_filter(flatten(list_transform(instances, lambda l: regexp_split_to_array(l, '{WS}'))), lambda w: w <> ''), '; ')"
_MAJORITY = SCRIPT_SQL.replace(" IN (7, 8)", " IN (10, 11)").rpartition("SELECT scenario_id, m AS")[0]
_SHOWN = "coalesce(p || '% : ' || (100 - p) || '%', 'N/A')"
_STEP = "CASE WHEN p IS NULL THEN 0 WHEN abs(p - target) <= 5 THEN 10 WHEN abs(p - target) <= 10 THEN 8 WHEN abs(p - target) <= 15 THEN 6 WHEN abs(p - target) <= 20 THEN 4 WHEN abs(p - target) <= 25 THEN 2 ELSE 0 END"
_OFF = "coalesce(cs_ratio = 'Low' OR p <> target OR p IS NULL, true)"
_TARGET = "coalesce(try_cast(rtrim(cs_ratio, '%') AS DOUBLE), 0.0)"
_STREAMED = f"WITH {STATES_SQL} SELECT scenario_id, 'Arabic' AS first_language, round(score, 6) AS score, (scenario_id % 2)::INT AS refine_count, CASE WHEN round(score, 6) < 8 AND scenario_id % 2 = 0 THEN 'REFINE' ELSE 'ACCEPT' END AS decision FROM states"
ORACLES |= {
    "scenario_cross_product": f"SELECT scenario_id, {', '.join(LISTS)} FROM ({product_sql()})",
    "join_any": f"WITH {FIXTURE} SELECT scenario_id, {_ALL_WORDS} AS plain, {_ALL_WORDS} AS compat FROM fixture",
    "stream_accept": _STREAMED + " WHERE NOT (round(score, 6) < 8 AND scenario_id % 2 = 0)",
    "stream_refine": _STREAMED + " WHERE round(score, 6) < 8 AND scenario_id % 2 = 0",
    "refine_counts": f"WITH {STATES_SQL} SELECT scenario_id, (2 * refine_count)::INT AS refine_count FROM states",
    "results_read": f"WITH {STATES_SQL}, rows AS (SELECT *, unnest(CASE WHEN scenario_id % 3 = 1 THEN [array_to_string(kept, chr(10))] ELSE kept END) AS text, generate_subscripts(CASE WHEN scenario_id % 3 = 1 THEN [''] ELSE kept END, 1) - 1 AS sentence_index FROM states) SELECT topic, text, round(score, 6) AS score, fluency_score, CASE scenario_id % 3 WHEN 0 THEN fluency_errors ELSE topic END AS fluency_errors, computed_ratio AS cs_ratio_computed, sentence_index, 'Arabic' AS first_language, NULL::VARCHAR AS tense FROM rows",
    "report_lines": f"WITH {_MAJORITY}, c AS (SELECT *, {_OFF} AS off FROM pct) SELECT 0 AS part, NULL::BIGINT AS key, 'rows: ' || count(*) AS line FROM c UNION ALL SELECT 1, NULL, 'columns: scenario_id, cs_ratio, computed_ratio, ratio_score' UNION ALL SELECT 2, NULL, 'mismatch_count: ' || count(*) FROM c WHERE off UNION ALL SELECT 3, NULL, 'sample_mismatches:' UNION ALL SELECT 4, scenario_id, '- row ' || scenario_id || ': cs_ratio=' || cs_ratio || ' computed_ratio=' || {_SHOWN} || ' ratio_score=' || {_STEP} FROM c WHERE off UNION ALL SELECT 5, NULL, 'ratio_score stats: count=' || count(*) || ' min=' || min(s) || ' max=' || max(s) || ' mean=' || regexp_replace(avg(s)::VARCHAR, '[.]0$', '') FROM (SELECT {_STEP} AS s FROM c)",
    "parse_computed_ratio": f"WITH {MEASURED}{_MAJORITY[len(FIXTURE) :]} SELECT scenario_id, 'first_letter' AS method, CASE WHEN total_words IS NULL THEN 0 ELSE printf('%.1f', lang2_percent)::DOUBLE END AS first_percent, CASE WHEN total_words IS NULL THEN 0 ELSE printf('%.1f', lang1_percent)::DOUBLE END AS second_percent, CASE WHEN total_words IS NOT NULL THEN 'English' END AS first_language, CASE WHEN total_words IS NOT NULL THEN 'Arabic' END AS second_language FROM measured UNION ALL SELECT scenario_id, 'script_majority', p, 100 - p, NULL, NULL FROM pct",
    "summary_text": f"WITH {FIXTURE}, said AS (SELECT scenario_id, kind, score, ' Result: {{\"score\":' || score || ',\"summary\":\"' || topic || '\"}}' AS line FROM (SELECT scenario_id, topic, unnest(['Fluency', 'Naturalness', 'CS Ratio', 'Social Cultural']) AS kind, unnest([fluency_score, naturalness_score, fluency_score, socio_cultural_score]) AS score, FROM fixture)) SELECT scenario_id, string_agg(kind || line, chr(10) ORDER BY list_position(['Fluency', 'Naturalness', 'CS Ratio', 'Social Cultural'], kind)) AS summary FROM said GROUP BY scenario_id",
    "report_sentence_lines": f"WITH {FIXTURE}{SENTENCES_SQL} SELECT scenario_id, NULL::INT AS sentence, 'row ' || scenario_id || ':' AS line FROM (SELECT DISTINCT scenario_id FROM sentences) UNION ALL SELECT scenario_id, sentence, '  sentence ' || (sentence + 1) || ': matrix_pct=' || CASE WHEN matrix + embedded > 0 THEN round_even(100 * matrix / (matrix + embedded)::DOUBLE, 0)::INT::VARCHAR ELSE 'N/A' END || ' words=' || matrix || '/' || embedded FROM sentences",
    "deviation": f"WITH {MEASURED} SELECT scenario_id, round(lang2_percent - try_cast(rtrim(cs_ratio, '%') AS DOUBLE), 6) AS deviation FROM measured",
    "news_sample": f"WITH {FIXTURE}, {NEWS_SQL} SELECT topic, article FROM news ORDER BY md5('0:' || topic || ':' || article), topic, article LIMIT 1",
    "news_read": f"WITH {FIXTURE} SELECT topic, 'title ' || scenario_id || chr(10) || array_to_string(instances, chr(10)) AS article FROM fixture",
    "unseen_topics": "SELECT 'topic' || (doc_id % 9) AS topic, min(doc_id) AS scenario_id FROM documents WHERE doc_id % 9 >= 7 GROUP BY 1",
    "first_scenario": f"SELECT scenario_id, topic, cs_type FROM ({product_sql()}) ORDER BY scenario_id LIMIT 1",
    "evaluator_replies": f"WITH {FIXTURE} SELECT scenario_id, CASE WHEN topic <> 'topic4' THEN fluency_score END AS fluency_score_read, CASE WHEN topic <> 'topic4' THEN topic ELSE '' END AS errors, CASE WHEN topic <> 'topic4' THEN cs_ratio END AS summary FROM fixture",
    "ratio_context": f"WITH {MEASURED} SELECT scenario_id, printf('%.1f', lang2_percent) || '%' AS actual_percent, printf('%.1f', {_TARGET}) || '%' AS target_second_percent, printf('%.1f', 100.0 - {_TARGET}) || '%' AS target_first_percent FROM measured",
    "ratio_evaluator_skipped": f"WITH {_MAJORITY}, c AS (SELECT *, scenario_id % 9 = 3 AS foreign_one FROM pct) SELECT scenario_id, CASE WHEN foreign_one OR p IS NULL THEN 0.0 ELSE 6.5 END::DOUBLE AS ratio_score, CASE WHEN foreign_one THEN 'N/A' ELSE {_SHOWN} END AS computed_ratio, CASE WHEN foreign_one THEN 'Unknown script mapping for one or both languages; deterministic ratio not computed.' WHEN p IS NULL THEN 'No identifiable script characters found for either language.' ELSE 'asked about topic' || (scenario_id % 9) END AS notes FROM c",
    "ratio_evaluator_notes": f"WITH {MEASURED} SELECT scenario_id, round(score, 6) AS score, computed_ratio, 'asked about ' || topic AS notes FROM finished",
    "tools_update": f"WITH {FIXTURE}, n AS (SELECT scenario_id, count(*) AS n FROM words GROUP BY ALL) SELECT scenario_id, coalesce(n, 0)::VARCHAR AS word_count, topic AS kept, CASE WHEN scenario_id % 3 = 0 THEN 'ERROR: integer division or modulo by zero' ELSE (scenario_id // (scenario_id % 3))::VARCHAR END AS third FROM fixture LEFT JOIN n USING (scenario_id)",
    "prompt_braces": f"WITH {FIXTURE} SELECT scenario_id, topic || ': say {{cs_ratio}} of {{topic}} and {{remark}}, ' || topic || ' at ' || cs_ratio || ' {{}}' AS prompt FROM fixture",
    "failing_evaluator": f"WITH {MEASURED} SELECT scenario_id, round(ratio_score, 6) AS ratio_score, computed_ratio, CASE topic WHEN 'topic4' THEN details || ' Target: ' || cs_ratio WHEN 'topic5' THEN details ELSE 'asked about ' || topic END AS notes, CASE topic WHEN 'topic4' THEN 'TimeoutError: no answer' END AS failure FROM scored",
    "resumable_calls": f"WITH {FIXTURE}, asked AS (SELECT scenario_id, topic, topic || ': ' || array_to_string(instances, ' ') AS prompt FROM fixture) SELECT scenario_id, length(prompt) || ' characters' AS reply, CASE WHEN topic = 'topic4' THEN 2 ELSE 1 END::BIGINT AS n_runs, CASE WHEN topic = 'topic4' THEN 2 ELSE 1 END::BIGINT AS n_calls FROM asked",
    "variant_items": f"WITH {FIXTURE}, rows AS (SELECT scenario_id, 'list' AS kind, unnest(instances) AS value, generate_subscripts(instances, 1) - 1 AS place, NULL::VARCHAR AS name FROM fixture WHERE scenario_id % 4 = 0 UNION ALL SELECT scenario_id, 'object', cs_ratio, 0, topic FROM fixture WHERE scenario_id % 4 = 1 UNION ALL SELECT scenario_id, 'text', topic, NULL, NULL FROM fixture WHERE scenario_id % 4 = 2 UNION ALL SELECT scenario_id, 'number', fluency_score::VARCHAR, NULL, NULL FROM fixture WHERE scenario_id % 4 = 3) SELECT * FROM rows",
    "range_join_table": "SELECT l_orderkey, l_linenumber, price, count(*) AS n_bands, max(hi - lo) AS widest FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS price FROM lineitem) JOIN (SELECT floor(o_totalprice)::BIGINT AS lo, floor(o_totalprice * 1.01::DOUBLE)::BIGINT AS hi FROM orders) ON price BETWEEN lo AND hi GROUP BY ALL",
    "language_votes": f"WITH {FIXTURE}, ranges(language, lo, hi) AS (VALUES {', '.join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in LANGUAGE_RANGES.items())}), votes AS (SELECT scenario_id, language, count(*) AS n_words FROM coded JOIN ranges ON code BETWEEN lo AND hi GROUP BY ALL) SELECT *, first_value(language) OVER (PARTITION BY scenario_id ORDER BY n_words DESC, language) AS most FROM votes",
    "stream_deadline": f"WITH {STATES_SQL} SELECT scenario_id, round(score, 6) AS score, scenario_id % 4 AS batch_id, CASE WHEN scenario_id % 4 = 2 THEN 'timed out' ELSE 'done' END AS status FROM states",
    "refine_states": f"WITH {STATES_SQL} SELECT scenario_id, 3 * refine_count + 3 AS refine_count, 3 AS decisions, CASE WHEN scenario_id % 2 = 0 THEN 'REFINE' ELSE 'ACCEPT' END AS decision FROM states",
    "new_topics": "SELECT 'topic' || (doc_id % 9) AS topic, 1::BIGINT AS n_times FROM documents WHERE doc_id % 9 >= 7 GROUP BY 1",
    "sentences_by_sql": f"WITH {FIXTURE} SELECT scenario_id, topic, sentence AS sentence_index, line AS text FROM lines JOIN fixture USING (scenario_id)",
    "failing_tool_by_sql": "SELECT doc_id AS scenario_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id // (doc_id % 3))::VARCHAR END AS value, CASE WHEN doc_id % 3 = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM documents",
    "repeated_appends": f"WITH {STATES_SQL} SELECT scenario_id, topic, CASE WHEN scenario_id % 3 = 0 THEN 'Arabic' ELSE 'English' END AS first_language, round(score, 6) AS score, 1::BIGINT AS n_times FROM states",
    "news_pick_three": f"WITH {FIXTURE}, {NEWS_SQL} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY md5('0:' || article), article) AS place, article FROM news QUALIFY place <= 3",
    "report_read_back": f"WITH {FIXTURE}{SENTENCES_SQL} SELECT scenario_id, sentence, matrix, embedded, CASE WHEN matrix + embedded > 0 THEN round_even(100 * matrix / (matrix + embedded)::DOUBLE, 0)::INT END AS matrix_pct FROM sentences",
}
ORACLES["scenario_lists_product"] = ORACLES["scenario_cross_product"]

"""The queries ``opN_<name>`` and their SQL: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, decontaminate, fill_middle, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_alignment, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The listing of op2: URLs of hosts whose first label is hyphenated, as those of link farms are, and 200,000 that no page has.
LISTED_HOST = r"^[a-z]+-[a-z]+\."
LISTED_ELSEWHERE = 200_000


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listing = pages.where(url_filters.host(F.col("url")).rlike(LISTED_HOST)).select(url_filters.canonical(F.col("url")).alias("canonical"))
    elsewhere = spark.range(LISTED_ELSEWHERE).select(F.format_string("farm-%d.example.net/page/%d", F.col("id") % 97, "id").alias("canonical"))
    return url_filters.judge(pages, listing.unionByName(elsewhere), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


OP2_SQL = r"""
WITH parsed AS (
  SELECT row_number() OVER () AS r, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS kept
  FROM pages
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM parsed
), listing AS (
  SELECT canonical FROM named WHERE regexp_matches(host, '^[a-z]+-[a-z]+\.')
  UNION
  SELECT 'farm-' || (id % 97) || '.example.net/page/' || id FROM range(200000) AS ids(id)
), rules(kind, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT n.*, kind, rh || rp AS rule, coalesce(canonical IN (SELECT canonical FROM listing), false) AS listed
  FROM named n LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM fits
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), full_lines AS (
  SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS content,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM full_lines
), runs AS (
  SELECT a.doc_id, a.pos AS p1, b.pos AS p2, b.upto - a.upto + a.words AS n
  FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND a.pos <= b.pos WHERE b.upto - a.upto + a.words >= 20
), windows AS (
  SELECT doc_id, p1, min(p2) AS p2 FROM runs GROUP BY doc_id, p1
  UNION
  SELECT doc_id, max(p1) AS p1, p2 FROM runs GROUP BY doc_id, p2
), contents AS (
  SELECT w.doc_id, p1, p2, string_agg(content, chr(10) ORDER BY pos) AS k
  FROM windows w JOIN summed s ON s.doc_id = w.doc_id AND pos BETWEEN p1 AND p2 GROUP BY w.doc_id, p1, p2
), later AS (
  SELECT doc_id, p1, p2 FROM contents QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p1) > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later r ON r.doc_id = l.doc_id AND l.pos BETWEEN p1 AND p2
), rest AS (
  SELECT doc_id, count(words) AS n_lines, count(words) FILTER (WHERE g.pos IS NOT NULL) AS n_removed,
    string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) LEFT JOIN full_lines f USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN rest USING (doc_id)
"""


CONTROL_STRINGS = "<|im_end|><|im_start|>assistant ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_STRINGS), (-1, 1, "assistant", CONTROL_STRINGS)], talks.schema)
    return chat_format.read_back(chat_format.windows(talks.unionByName(extra), model_file=public_tokenizers.path("word_bpe_49k.json")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base-1"))) != 0
    return quality_rules.apply_policy(entries, "web-1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), starts AS (
  SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5
), keyed AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM starts
), again AS (
  SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r
), measured AS (
  SELECT doc_id, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM split LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * n_symbols > 20 * n_words AND NOT 100 * n_dup_lines > 30 * n_lines AS kept
FROM judged
"""


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strictest policy fails, and what would stay without it."""
    return quality_rules.ablate(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "web-2")


ABLATION_SQL = OP5_SQL.rpartition("judged AS (")[0] + r"""failing AS (
  SELECT [n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > 20 * n_words, 100 * n_dup_lines > 30 * n_lines, word_chars < 2 * n_words, word_chars > 15 * n_words, 100 * n_upper > 60 * word_chars] AS f
  FROM (SELECT m.*, len(regexp_extract_all(text, '[A-Z]')) AS n_upper FROM measured m)
), rules AS (
  SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'short_words', 'long_words', 'shouting']) AS rule, unnest(range(1, 8)) AS i
), counts AS (
  SELECT rule, count(*) FILTER (f[i]) AS n_failed, count(*) FILTER (f[i] AND len(list_filter(f, lambda x: x)) = 1) AS n_only, count(*) FILTER (len(list_filter(f, lambda x: x)) = 0) AS n_kept FROM failing, rules GROUP BY rule
)
SELECT rule, n_failed, n_only, n_kept + n_only AS n_kept_without FROM counts
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decontaminate.search(index, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near"))


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM starts
), places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), keyed AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM places
), hits AS (
  SELECT r, n, i, item_id FROM keyed JOIN windows USING (n, k)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r
), listed AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY r
), terms AS (
  SELECT k, len(ts) AS m, unnest(ts) AS t FROM (SELECT DISTINCT k, list_distinct(string_split(k, ' ')) AS ts FROM windows)
), occurrences AS (
  SELECT r, k, m, t, p FROM (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs) JOIN terms USING (t)
), complete AS (
  SELECT r, k FROM occurrences GROUP BY r, k, m HAVING count(DISTINCT t) = m
), spans AS (
  SELECT r, k, m, count(DISTINCT t) OVER (PARTITION BY r, k ORDER BY p RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS c FROM occurrences JOIN complete USING (r, k)
), nearby AS (
  SELECT r, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT r, k FROM spans WHERE c = m) JOIN windows USING (k) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r) LEFT JOIN nearby USING (r)
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality_classifier.classify(docs, model).drop("text")
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text"), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM split WHERE len(w) > 0
), ones AS MATERIALIZED (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM sets GROUP BY s
), items AS (
  SELECT id, n, unnest(s) AS g FROM ones
), pairs AS (
  SELECT a.id AS a, b.id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.id <> b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.id, b.id
), links AS MATERIALIZED (
  SELECT a, b FROM pairs WHERE 9 * c >= 4 * (an + bn)
), reached AS (
  SELECT id AS a, id AS b FROM ones
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), named AS (
  SELECT a AS id, min(b) AS class_id FROM reached GROUP BY a
), counted AS (
  SELECT a AS id, count(*) AS n_links FROM links GROUP BY a
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN ones USING (s) LEFT JOIN named USING (id) LEFT JOIN counted USING (id)
"""


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split)
), again AS (
  SELECT r, i FROM windows JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
), gone AS (
  SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM again) GROUP BY r
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM split) LEFT JOIN gone USING (r)
  WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rebuilt = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS r1, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS r2, ('0x' || h[25:32])::UBIGINT % 100 AS h4 FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {"op1_language_id": op1_language_id, "op2_url_filters": op2_url_filters, "op3_line_dedup": op3_line_dedup, "op4_chat_formatting": op4_chat_formatting, "op5_quality_rules": op5_quality_rules, "op6_suffix_dedup": op6_suffix_dedup, "op7_decontamination": op7_decontamination, "op8_quality_classifier": op8_quality_classifier, "op9_bpe": op9_bpe, "op10_jaccard_join": op10_jaccard_join, "op11_substring_dedup": op11_substring_dedup, "op12_fill_middle": op12_fill_middle, "op13_token_alignment": op13_token_alignment, "rule_ablation": rule_ablation}
ORACLES = {"op2_url_filters": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op7_decontamination": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_substring_dedup": OP11_SQL, "op12_fill_middle": OP12_SQL, "rule_ablation": ABLATION_SQL}

"""Evaluate, score, decide and refine scenarios.

``refine_mode="as_coded"`` marks a refined row (``refine_count`` grows by 3) and accepts
it with its sentences and scores as they were; ``"reevaluate"`` generates, measures
and scores it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ratio, scoring, text
from tessera.plans import agents
from tessera.plans import tools as registry
from tessera.sources.storage import stored

Stage = Callable[[DataFrame], DataFrame]


def with_ratio(df: DataFrame, method: str = "first_letter", notes: str | None = None, ask: Stage | None = None) -> DataFrame:
    """Add ``cs_ratio_result``: score, ratio text and notes.

    ``ask`` is an evaluator that adds a ``cs_ratio_result`` of its own to measured rows.
    With ``first_letter`` only its notes count, else those of column ``notes``; with
    ``script_majority`` its score and notes do, but it isn't asked where the ratio is
    ``N/A``.  With ``evaluator`` the struct is already there and stays, or ``ask`` adds it.
    """
    if method == "evaluator":
        return df if ask is None else ask(df)
    if method == "script_majority":
        measured = ratio.script_majority(df)
        own = ["ratio_score", "computed_ratio", "notes", "matrix_count", "embedded_count"]
        if ask is None:
            return measured.withColumn("cs_ratio_result", F.struct("ratio_score", "computed_ratio", "notes")).drop(*own)
        measured, valid = stored(measured, "measured"), F.col("computed_ratio") != "N/A"
        # where the evaluator fails, what was measured stands
        given = lambda part: F.coalesce(F.col("cs_ratio_result")[part], F.col(part)).alias(part)
        asked = ask(measured.where(valid)).withColumn("cs_ratio_result", F.struct(given("ratio_score"), "computed_ratio", given("notes")))
        rest = measured.where(~valid).withColumn("cs_ratio_result", F.struct("ratio_score", "computed_ratio", "notes"))
        return asked.drop(*own).unionByName(rest.drop(*own), allowMissingColumns=True)
    if method != "first_letter":
        raise ValueError(f"unknown method {method!r}")
    own = ["lang1_word_count", "lang2_word_count", "unknown_words", "lang1_percent", "lang2_percent", "total_words", "computed_ratio", "details"]
    measured = ratio.first_letter(df)
    if ask is not None:
        answered = F.col("cs_ratio_result").isNotNull()
        # a reply without notes gets the details, a failed call the details and the target
        remark = F.coalesce(F.col("cs_ratio_result.notes"), F.when(answered, F.col("details")).otherwise(F.concat("details", F.lit(" Target: "), F.coalesce("cs_ratio", F.lit("")))))
        (said_by,) = text.spare(measured, "_said")
        measured = ask(agents.ratio_context(measured)).withColumn(said_by, remark).drop("cs_ratio_result")
        notes, own = said_by, [*own, said_by, "actual_percent", "target_second_percent", "target_first_percent"]
    fallback = F.concat(F.lit("Target: "), F.coalesce("cs_ratio", F.lit("")), F.lit(", Actual: "), text.one_decimal(F.col("lang2_percent")), F.lit("%. "), F.col("details"))
    said = F.coalesce(F.col(notes), fallback) if notes else fallback
    score = scoring.linear_score(F.col("lang2_percent"), F.col("cs_ratio"))
    return measured.withColumn("cs_ratio_result", F.struct(score.alias("ratio_score"), F.col("computed_ratio"), said.alias("notes"))).drop(*own)


def scored(df: DataFrame, weights: dict[str, float] = scoring.WEIGHTS) -> DataFrame:
    """Add ``score`` from the four results."""
    parts = {"fluency_score": "fluency_result.fluency_score", "naturalness_score": "naturalness_result.naturalness_score", "ratio_score": "cs_ratio_result.ratio_score", "socio_cultural_score": "social_cultural_result.socio_cultural_score"}
    flat = df.withColumns({f"_{k}": F.col(v).cast("double") for k, v in parts.items()})
    return flat.withColumn("score", scoring.weighted_score({f"_{k}": w for k, w in weights.items()})).drop(*(f"_{k}" for k in parts))


def summary() -> Column:
    """One line for each result, as JSON."""
    names = {"Fluency Result: ": "fluency_result", "Naturalness Result: ": "naturalness_result", "CS Ratio Result: ": "cs_ratio_result", "Social Cultural Result: ": "social_cultural_result"}
    return F.concat_ws("\n", *(F.concat(F.lit(k), F.to_json(v)) for k, v in names.items()))


def run(
    scenarios: DataFrame,
    generate: Stage,
    evaluate: Stage,
    method: str = "first_letter",
    refine_mode: str = "as_coded",
    refine: Stage | None = None,
    tools: bool = False,
    weights: dict[str, float] = scoring.WEIGHTS,
    max_refine: int = 1,
    notes: str | None = None,
    ask_ratio: Stage | None = None,
) -> DataFrame:
    """Accepted rows with ``score``, ``summary`` and ``refine_count``.

    ``generate`` adds ``instances``; ``evaluate`` adds ``fluency_result``,
    ``naturalness_result`` and ``social_cultural_result``, all in the same row, so that
    four evaluations need no join.  ``notes`` and ``ask_ratio`` go to ``with_ratio``.
    """
    if refine_mode not in ("as_coded", "reevaluate"):
        raise ValueError(f"unknown refine_mode {refine_mode!r}")

    def judged(df: DataFrame) -> DataFrame:
        return scored(with_ratio(evaluate(df), method, notes, ask_ratio), weights)

    rows = judged(generate(scenarios)).withColumn("refine_count", F.lit(0))
    decision = scoring.decision(F.col("score"), F.col("refine_count"), max_refine=max_refine)
    if refine_mode == "as_coded":
        out = rows.withColumn("refine_count", F.when(decision == "REFINE", 3).otherwise(0))
    else:
        # both branches must see one evaluation: generators and evaluators may answer differently each time
        (decided_by,) = text.spare(rows, "_decision")
        decided = stored(rows.withColumn(decided_by, decision), "decided")
        results = ["instances", "fluency_result", "naturalness_result", "cs_ratio_result", "social_cultural_result", "score"]
        again = decided.where(F.col(decided_by) == "REFINE").drop(decided_by, *results)
        redone = judged((refine or generate)(again)).withColumn("refine_count", F.lit(3))
        out = decided.where(F.coalesce(F.col(decided_by) != "REFINE", F.lit(True))).drop(decided_by).unionByName(redone, allowMissingColumns=True)
    out = out.withColumn("summary", summary())
    return out.withColumn("mcp_result", registry.merged()) if tools else out

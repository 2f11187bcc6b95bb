"""Answers -> claims -> evidence -> verdicts -> decision -> revised answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.answers import answer_policy, flagged_claims, revise, summary_line
from claimlens.functions.arrays import let
from claimlens.functions.claims import claims_or_answer, extract_claims
from claimlens.functions.labels import label_attr
from claimlens.functions.outputs import parse_output
from claimlens.functions.text import cut
from claimlens.operators.decisions import verify_answer
from claimlens.operators.guards import apply_guards
from claimlens.operators.retrieval import passthrough_evidence, retrieve_local
from claimlens.session import cut_lineage
from claimlens.operators.scorers import LexicalScorer, cascade_verdict, lexical_verdict


def with_claims(df: DataFrame, **lists) -> DataFrame:
    """Set ``claims`` array<string>; given ones are kept, null means extract them.

    The whole answer stands in when there is none.
    """
    found = extract_claims(F.col("answer"), **lists)
    if "claims" in df.columns:
        found = F.coalesce(F.col("claims"), found)
    return df.withColumn("claims", let(found, lambda c: claims_or_answer(c, F.col("answer"))))


def lexical_claim_verdict(claim: Column, ctx_words: Column, ctx_negates: Column, error: Column,
                          scorer: LexicalScorer, threshold: float) -> Column:
    """Verdict struct of one claim (with its text) by the cascade over lexical scores."""

    def build(s: Column) -> Column:
        stage1 = F.when(s["con"] >= 0.30, F.lit("contradicted")).when(
            s["sup"] >= 0.5, F.lit("supported")
        ).otherwise(F.lit("neutral"))
        label = lexical_verdict(s)
        stage2 = F.struct(
            label.alias("label"), label_attr(label, "typical").alias("score"),
            F.when(label == "supported", F.lit("none")).otherwise(
                F.lit("unsupported_inference")
            ).alias("error_type"),
            F.lit("").alias("evidence_span"),
            F.lit("Word overlap with the evidence.").alias("explanation"),
        )
        return let(
            cascade_verdict(error, stage1, s["sup"], stage2, threshold),
            lambda v: F.struct(
                claim.alias("claim"), v["label"].alias("label"), v["score"].alias("score"),
                v["error_type"].alias("error_type"), v["evidence_span"].alias("evidence_span"),
                v["explanation"].alias("explanation"),
            ),
        )

    return let(scorer.score(claim, ctx_words, ctx_negates), build)


def verify_answers(df: DataFrame, strategy: str = "drop", threshold: float = 0.85,
                   scorer: LexicalScorer = LexicalScorer(), max_chars: int | None = None,
                   **lists) -> DataFrame:
    """Verify answers against their own context.

    Columns question, answer, context (and optional claims) are needed.  Claims stay an
    array of their row from extraction to rewriting, so the plan is map-only.
    """
    rows = with_claims(df, **lists)
    evidence = passthrough_evidence(F.col("context"), max_chars)

    def judge(e: Column) -> Column:
        return let(
            F.struct(
                scorer.context_words(e["context"]).alias("words"),
                scorer.negates(e["context"]).alias("negates"),
            ),
            lambda ctx: F.transform(
                "claims",
                lambda c: lexical_claim_verdict(
                    c, ctx["words"], ctx["negates"], e["error"], scorer, threshold
                ),
            ),
        )

    return finish_answers(rows.withColumn("verdicts", let(evidence, judge)), strategy)


def verify_answers_with_corpus(df: DataFrame, corpus: DataFrame, key: str,
                               strategy: str = "drop", threshold: float = 0.85,
                               scorer: LexicalScorer = LexicalScorer(), k: int = 3,
                               max_chars: int | None = None, index=None, **lists) -> DataFrame:
    """Verify answers against evidence searched per claim in a corpus, or in its written ``index``.

    ``key`` is unique per answer row.  Claims leave the row for the search and come back
    grouped by it, so a group never holds more than one answer's claims.
    """
    rows = with_claims(df, **lists)
    # the array is never empty; a plain explode would add a filter that extracts claims twice
    exploded = rows.select(key, F.posexplode_outer("claims").alias("claim_index", "claim"))
    # read by the search, its empty queries and the verdicts: extracted once
    claims = cut_lineage(exploded.withColumn(
        "claim_id", F.concat_ws("#", F.col(key).cast("string"), F.col("claim_index"))
    ), "claims")
    found = retrieve_local(claims, corpus, k, max_chars, index=index)
    judged = claims.join(found, "claim_id").select(
        key, "claim_index",
        lexical_claim_verdict(
            F.col("claim"), scorer.context_words(F.col("context")),
            scorer.negates(F.col("context")), F.col("error"), scorer, threshold,
        ).alias("verdict"),
    )
    per_answer = judged.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("claim_index", "verdict"))).alias("v")
    ).select(key, F.transform("v", lambda x: x["verdict"]).alias("verdicts"))
    return finish_answers(rows.join(per_answer, key), strategy)


def finish_answers(df: DataFrame, strategy: str = "drop",
                   policy: fv.AnswerPolicy = fv.AnswerPolicy()) -> DataFrame:
    """Decision, revision and summary columns from ``verdicts``."""
    decided = df.withColumn("_d", answer_policy(F.col("verdicts"), policy))
    decision = F.col("_d.final_decision")
    revised = F.when(
        decision.isin("revise", "reject"),
        revise(strategy, F.col("answer"), F.col("verdicts"), decision),
    )
    out = decided.withColumn("_r", revised)
    keep = [c for c in df.columns if c not in ("claims", "verdicts", "context")]
    return out.select(
        *keep, cut(F.col("context"), 500, "...").alias("context_preview"), "verdicts", "_d.*",
        flagged_claims(F.col("verdicts"), policy).alias("flagged_claims"),
        F.when(decision == "accept", F.col("answer"))
        .otherwise(F.col("_r.revised_answer")).alias("revised_answer"),
        F.coalesce("_r.revision_log", F.array().cast("array<string>")).alias("revision_log"),
        summary_line(F.col("_d")).alias("summary"),
    )


def verdicts_from_outputs(df: DataFrame, raw: str = "raw", **words) -> DataFrame:
    """Raw model output per claim -> guarded verdict columns; needs claim and context.  Map-only.

    ``words`` are the phrase lists of the guards.
    """
    parsed = df.withColumn("_o", parse_output(F.col(raw)))
    fields = ("label", "hallucination_score", "error_type", "evidence_span", "explanation", "decision",
              "parse_error")
    return apply_guards(parsed.withColumns({f: F.col(f"_o.{f}") for f in fields}).drop("_o"), **words)


def verify_outputs(df: DataFrame, key: str, raw: str = "raw", **words) -> DataFrame:
    """Highest score, most severe decision and label counts of each answer from raw model outputs."""
    return verify_answer(verdicts_from_outputs(df, raw, **words), key)

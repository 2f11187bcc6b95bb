"""Post-processing guards over a table of claim verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import any_contains, let
from claimlens.functions.text import is_blank, share_of, strip, token_overlap_ratio, token_set

# Input columns: claim, context, label, hallucination_score, error_type, evidence_span,
# explanation, parse_error.


def _with_note(explanation: Column, note: Column) -> Column:
    return F.when(
        F.length(explanation) > 0, F.concat(explanation, F.lit("  ["), note, F.lit("]"))
    ).otherwise(note)


def _rewrite(df: DataFrame, hit: Column, **new: Column) -> DataFrame:
    """Replace columns where ``hit``; the condition is computed once as its own column."""
    flagged = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    updates = {k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}
    return flagged.withColumns(updates).drop("_hit")


def missing_span(df: DataFrame) -> DataFrame:
    """Supported without a quoted span becomes partially supported."""
    score = F.least(F.greatest(F.col("hallucination_score"), F.lit(0.35)), F.lit(0.55))
    return _rewrite(
        df,
        (F.col("label") == "supported") & ~F.col("parse_error") & is_blank(F.col("evidence_span")),
        label=F.lit("partially_supported"),
        hallucination_score=score,
        error_type=F.lit("missing_evidence_span"),
        explanation=_with_note(F.col("explanation"), F.lit(fv.NOTE_MISSING_SPAN)),
    )


def foreign_span(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Clear a span whose words mostly do not occur in the context."""
    share = let(
        token_set(F.col("evidence_span")),
        lambda span: F.when(F.size(span) > 0, share_of(span, token_set(F.col("context")))),
    )
    return _rewrite(
        df,
        ~is_blank(F.col("evidence_span")) & (share < min_share),
        evidence_span=F.lit(None).cast("string"),
        error_type=F.when(F.length("error_type") > 0, F.col("error_type")).otherwise(
            F.lit("hallucinated_span")
        ),
    )


def placeholder_span(df: DataFrame, phrases=fv.PLACEHOLDER_PHRASES) -> DataFrame:
    """Clear a span that talks about the claim instead of quoting the context."""
    return _rewrite(
        df,
        any_contains(strip(F.lower("evidence_span")), phrases),
        evidence_span=F.lit(None).cast("string"),
        error_type=F.when(F.length("error_type") > 0, F.col("error_type")).otherwise(
            F.lit("placeholder_span")
        ),
    )


def paraphrase(df: DataFrame, min_overlap: float = 0.60) -> DataFrame:
    """Unsupported although most claim words occur in the context: partially supported."""
    todo = (F.col("label") == "unsupported") & ~F.col("parse_error")
    overlap = F.when(todo, token_overlap_ratio(F.col("claim"), F.col("context")))
    percent = F.format_string("%.0f", F.bround(F.col("_overlap") * 100, 0))
    note = F.concat(
        F.lit(fv.NOTE_PARAPHRASE.split("%s%%")[0]), percent, F.lit("%"),
        F.lit(fv.NOTE_PARAPHRASE.split("%s%%")[1]),
    )
    return _rewrite(
        df.withColumn("_overlap", overlap),
        F.col("_overlap") >= min_overlap,
        label=F.lit("partially_supported"),
        hallucination_score=F.least(F.col("hallucination_score"), F.lit(0.50)),
        error_type=F.lit("paraphrase_mismatch"),
        explanation=_with_note(F.col("explanation"), note),
    ).drop("_overlap")


def shared_negation(df: DataFrame, words=fv.NEGATION_WORDS) -> DataFrame:
    """Claim and span both negate: the span supports the claim."""
    return _rewrite(
        df,
        F.col("label").isin("contradicted", "partially_supported")
        & ~F.col("parse_error")
        & any_contains(F.lower("claim"), words)
        & any_contains(F.lower("evidence_span"), words),
        label=F.lit("supported"),
        hallucination_score=F.least(F.col("hallucination_score"), F.lit(0.15)),
        error_type=F.lit("none"),
        explanation=_with_note(F.col("explanation"), F.lit(fv.NOTE_NEGATION)),
    )


def conflict_without_span(df: DataFrame) -> DataFrame:
    """Contradicted without a quoted span becomes unsupported."""
    return _rewrite(
        df,
        (F.col("label") == "contradicted") & ~F.col("parse_error")
        & is_blank(F.col("evidence_span")),
        label=F.lit("unsupported"),
        hallucination_score=F.least(F.col("hallucination_score"), F.lit(0.80)),
        error_type=F.when(F.length("error_type") > 0, F.col("error_type")).otherwise(
            F.lit("unsupported_inference")
        ),
        explanation=_with_note(F.col("explanation"), F.lit(fv.NOTE_NO_CONFLICT_SPAN)),
    )


def apply_guards(df: DataFrame, placeholder_phrases=fv.PLACEHOLDER_PHRASES,
                 negation_words=fv.NEGATION_WORDS) -> DataFrame:
    """All guards in order; the decision column is left alone.

    Adds ``original_label`` and ``original_score``.
    """
    out = df.withColumns(
        {"original_label": F.col("label"), "original_score": F.col("hallucination_score")}
    )
    out = missing_span(out)
    out = foreign_span(out)
    out = placeholder_span(out, placeholder_phrases)
    out = paraphrase(out)
    out = shared_negation(out, negation_words)
    return conflict_without_span(out)

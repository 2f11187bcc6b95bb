"""Model scores -> probabilities, danger scores and single-model decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let, literal_array
from claimlens.functions.labels import label_attr
from claimlens.functions.numbers import round_to, softmax


def nli_scores(logits: Column, entail_at: int = 0, contra_at: int = 2) -> Column:
    """struct<support, contradiction, neutral> from three raw logits."""
    return let(
        softmax(logits),
        lambda p: F.struct(
            round_to(p[entail_at], 6).alias("support"),
            round_to(p[contra_at], 6).alias("contradiction"),
            round_to(F.greatest(1.0 - p[entail_at] - p[contra_at], F.lit(0.0)), 6).alias(
                "neutral"
            ),
        ),
    )


def class_probs(logits: Column, labels=fv.LABELS) -> Column:
    """struct<predicted_label, confidence, probs map> from one logit per label."""
    names = literal_array(labels)
    return let(
        softmax(logits),
        lambda p: F.struct(
            F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias(
                "predicted_label"
            ),
            round_to(F.array_max(p), 6).alias("confidence"),
            F.map_from_arrays(names, F.transform(p, lambda x: round_to(x, 6))).alias("probs"),
        ),
    )


def nli_policy(sup: Column, con: Column, kw: Column,
               policy: fv.NliPolicy = fv.NliPolicy()) -> Column:
    return (
        F.when(con >= policy.p_contra, F.lit("revise"))
        .when(sup >= policy.p_high, F.lit("accept"))
        .when((sup >= policy.p_mid) | (kw >= policy.t_kw), F.lit("warn"))
        .otherwise(F.lit("insufficient_context"))
    )


def classifier_decision(label: Column, confidence: Column, threshold: float = 0.75) -> Column:
    return F.when(
        (label == "supported") & (confidence >= threshold), F.lit("accept")
    ).otherwise(F.lit("block_or_review"))


def classifier_danger(label: Column, confidence: Column) -> Column:
    return label_attr(label, "danger_weight", 0.5) * confidence


def nli_danger(sup: Column, con: Column, rules: fv.FusionRules = fv.FusionRules()) -> Column:
    return con * rules.con_weight + (F.lit(1.0) - sup) * rules.unsup_weight


def blended_score(decision: Column, label: Column, confidence: Column, sup: Column, con: Column,
                  rules: fv.FusionRules = fv.FusionRules()) -> Column:
    """Weighted danger, held at or below/above a bound for accept/revise."""
    raw = classifier_danger(label, confidence) * rules.classifier_weight + nli_danger(
        sup, con, rules
    ) * rules.nli_weight
    return (
        F.when(decision == "accept", F.least(raw, F.lit(rules.accept_ceiling)))
        .when(decision == "revise", F.greatest(raw, F.lit(rules.revise_floor)))
        .otherwise(raw)
    )


def two_digits(x: Column) -> Column:
    return F.format_string("%.2f", round_to(x, 2))

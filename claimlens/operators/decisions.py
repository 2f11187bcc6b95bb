"""Answer decisions over tables: claim-level roll-ups and answer-level policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.answers import COUNTED, counted_label, policy_rule
from claimlens.functions.fusion import claim_contradicted, claim_unsupported
from claimlens.functions.numbers import exact_mean, round_to


def claim_rollup(claim_scores: DataFrame, key: str,
                 rules: fv.FusionRules = fv.FusionRules()) -> DataFrame:
    """key, any_contra, any_unsupp from a table of claim scores (sup, con, decision)."""
    cols = F.col("sup"), F.col("con"), F.col("decision")
    return claim_scores.groupBy(key).agg(
        F.bool_or(claim_contradicted(*cols, rules)).alias("any_contra"),
        F.bool_or(claim_unsupported(*cols, rules)).alias("any_unsupp"),
    )


def policy_by_answer(claims: DataFrame, key: str,
                     policy: fv.AnswerPolicy = fv.AnswerPolicy()) -> DataFrame:
    """Answer decision from a claim table; counts and sums only, nothing is collected."""
    label = counted_label(F.col("label"))
    tally = claims.groupBy(key).agg(
        F.count("*").alias("n_claims"),
        exact_mean(F.col("score")).alias("_score"),
        F.count(F.when(F.col("score") >= policy.flag_claim_score, 1)).alias("n_flagged"),
        *[F.count(F.when(label == name, 1)).alias(f"n_{name}") for name in COUNTED],
    )
    counts = {name: F.col(f"n_{name}") for name in COUNTED}
    ruled = tally.withColumn(
        "_rule", policy_rule(F.col("n_claims"), counts, F.col("_score"), policy)
    )
    return ruled.select(
        key, "_rule.final_decision", "_rule.action_message", "_rule.retrieval_needed",
        round_to(F.col("_score"), 4).alias("aggregate_hallucination_score"), "n_claims",
        *[f"n_{name}" for name in COUNTED], "n_flagged",
    )


def verify_answer(claims: DataFrame, key: str) -> DataFrame:
    """Highest score and most severe decision per answer, with label counts."""
    severity = F.lit(len(fv.DECISION_SEVERITY))
    for rank, name in reversed(list(enumerate(fv.DECISION_SEVERITY))):
        severity = F.when(F.col("decision") == name, F.lit(rank)).otherwise(severity)
    worst = F.get(F.array(*[F.lit(d) for d in fv.DECISION_SEVERITY]), F.min(severity))
    return claims.groupBy(key).agg(
        F.max("hallucination_score").alias("aggregate_risk_score"),
        F.coalesce(worst, F.lit("accept")).alias("aggregate_decision"),
        F.count("*").alias("n_claims"),
        *[F.count(F.when(F.col("label") == x, 1)).alias(f"n_{x}") for x in COUNTED],
    )

"""Detection requests -> decisions: two scorers, routing, fusion, scoring, gold check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.claims import sentence_count, sentences
from claimlens.functions.fusion import (
    decide, effective_claim, fuse, no_info_phrase, rollup_claims, route,
)
from claimlens.functions.labels import gold_accepts
from claimlens.functions.numbers import round_to
from claimlens.functions.text import word_count
from claimlens.operators.quality import reject_reason
from claimlens.operators.scorers import LexicalScorer, lexical_verdict


def detect(df: DataFrame, phrases=fv.NO_INFO_PHRASES,
           fold_phrases: bool = False, rules: fv.FusionRules = fv.FusionRules()) -> DataFrame:
    """Add decision, confidence, hallucination_score, explanation, routing, source,
    is_correct and context_words.

    Needs context, answer, gold_label, mode; label, conf (classifier), sup, con, nli_decision
    (entailment); any_contra, any_unsupp (sentence roll-up, may be null).  A null label or sup
    means that scorer failed.  Narrow: no shuffle, every step is a projection.
    """
    col = F.col
    staged = df.withColumns(
        {
            "_route": route(col("mode")),
            "_phrase": no_info_phrase(col("answer"), phrases, fold_phrases),
            "_fused": fuse(
                col("label"), col("conf"), col("sup"), col("con"), sentence_count(col("answer")),
                col("any_contra"), col("any_unsupp"), rules,
            ),
            "context_words": word_count(col("context")),
        }
    )
    decided = staged.withColumn(
        "_out",
        decide(col("_route"), col("_phrase"), col("label"), col("conf"), col("sup"), col("con"),
               col("nli_decision"), col("_fused"), rules),
    )
    by_phrase = col("_out.source") == "keyword_rule"
    gold = F.length("gold_label") > 0
    correct = F.when(
        by_phrase, F.when(gold, col("gold_label") == "insufficient_context")
    ).otherwise(gold_accepts(col("gold_label"), col("_out.decision")))
    return decided.select(
        *df.columns,
        col("_out.decision").alias("decision"),
        round_to(col("_out.confidence"), 4).alias("confidence"),
        round_to(col("_out.score"), 4).alias("hallucination_score"),
        col("_out.reason").alias("explanation"),
        col("_out.routing").alias("routing"),
        col("_out.source").alias("source"),
        correct.alias("is_correct"),
        "context_words",
    )


def lexical_classifier(scores: Column) -> Column:
    """struct<label, conf> from entailment-like scores, where no classifier is at hand."""
    return F.struct(
        lexical_verdict(scores).alias("label"), F.greatest(scores["sup"], scores["con"]).alias("conf")
    )


def detect_requests(df: DataFrame, scorer: LexicalScorer = LexicalScorer(),
                    classifier: Callable[[Column], Column] = lexical_classifier,
                    question_required: bool = True, **options) -> DataFrame:
    """Decisions from raw requests: context, question, answer, claim, gold_label, mode.

    Admission, effective inputs, scores of the claim and of every sentence of the answer against
    the context (whose words are found once per row), roll-up, routing and fusion.  Requests
    that are not admitted keep null results and say why in ``reject_reason``.  Map-only, so the
    same call serves a stream.
    """
    col = F.col
    reason = reject_reason(col("context"), col("question"), col("answer"), question_required)
    claim = effective_claim(F.coalesce("claim", F.lit("")), col("answer"))

    def scored(ctx: Column) -> Column:
        def score(text: Column) -> Column:
            return scorer.score(text, ctx["words"], ctx["negates"])

        return F.struct(
            score(claim).alias("whole"), F.transform(sentences(col("answer")), score).alias("parts")
        )

    context = F.struct(
        scorer.context_words(col("context")).alias("words"),
        scorer.negates(col("context")).alias("negates"),
    )
    rows = df.withColumns({"reject_reason": reason, "_s": let(context, scored)})
    rows = rows.withColumns(
        {"_c": classifier(col("_s.whole")), "_r": rollup_claims(col("_s.parts"))}
    ).withColumns(
        {
            "label": col("_c.label"), "conf": col("_c.conf"), "sup": col("_s.whole.sup"),
            "con": col("_s.whole.con"), "nli_decision": col("_s.whole.decision"),
            "any_contra": col("_r.any_contra"), "any_unsupp": col("_r.any_unsupp"),
        }
    ).drop("_s", "_c", "_r")
    results = ("decision", "confidence", "hallucination_score", "explanation", "routing", "source",
               "is_correct")
    decided = detect(rows, **options)
    admitted = col("reject_reason").isNull()
    return decided.withColumns({c: F.when(admitted, col(c)) for c in results})

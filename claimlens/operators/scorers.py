"""Plug-in scorers and the two-stage cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import any_contains, let
from claimlens.functions.numbers import round_to
from claimlens.functions.scores import nli_policy, two_digits
from claimlens.functions.text import share_of, token_set

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def with_scorer(df: DataFrame, load: Callable[[], Scorer], inputs: list[str], schema: str,
                out: str = "scored", batch_rows: int = 32,
                only: Column | None = None) -> DataFrame:
    """Add a struct column computed by a model.

    ``load`` runs once per task and returns a function from a pandas frame of at most
    ``batch_rows`` rows to a frame with the schema's columns.  Only the input columns
    cross into Python.  Rows for which ``only`` does not hold are sent as nulls and are not
    scored; their result is null.
    """
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            asked = frame.loc[frame["_wanted"].to_numpy(bool), inputs].reset_index(drop=True)
            parts = [
                model(asked.iloc[i:i + batch_rows].reset_index(drop=True))
                for i in range(0, len(asked), batch_rows)
            ]
            done = pd.concat(parts, ignore_index=True) if parts else model(asked)
            yield pd.DataFrame({c: spread(done[c].tolist(), frame["_wanted"]) for c in done.columns})

    def spread(values: list, wanted: pd.Series) -> pd.Series:
        rest = iter(values)
        return pd.Series([next(rest) if w else None for w in wanted], dtype=object)

    sent = [F.when(wanted, F.col(c)).alias(c) for c in inputs]
    return df.withColumn(out, score(F.struct(*sent, wanted.alias("_wanted"))))


def with_tokenizer(df: DataFrame, text: str, load: Callable[[], Callable[[str], int]],
                   out: str = "n_tokens") -> DataFrame:
    """Add exact token counts from a tokenizer that is loaded once per task.

    Texts cross a few at a time: an Arrow batch holds 10,000 of them, however long they are.
    """
    loaded: list[Callable[[str], int]] = []  # every task unpacks its own

    @F.udf("int", useArrow=False)
    def count(text: str | None) -> int:
        if not loaded:
            loaded.append(load())
        return int(loaded[0](text or ""))

    return df.withColumn(out, count(F.col(text)))


@dataclass(frozen=True)
class LexicalScorer:
    """Word-overlap stand-in for an entailment model, so that jobs run without one.

    support = share of the claim's key words in the context; contradiction = .9 * support
    when exactly one side negates and at least half the words match.
    """

    min_len: int = 4
    stopwords: tuple = fv.STOPWORDS
    negations: tuple = fv.NEGATION_WORDS

    def context_words(self, context: Column) -> Column:
        return token_set(context, self.min_len, self.stopwords)

    def negates(self, text: Column) -> Column:
        return any_contains(F.lower(text), self.negations)

    def score(self, claim: Column, ctx_words: Column, ctx_negates: Column) -> Column:
        """struct<sup, con, kw, decision>; context parts are computed once per row."""
        support = share_of(token_set(claim, self.min_len, self.stopwords), ctx_words)
        opposed = self.negates(claim) != ctx_negates
        return let(
            support,
            lambda s: let(
                F.when(opposed & (s >= 0.5), s * 0.9).otherwise(F.lit(0.0)),
                lambda c: F.struct(
                    round_to(s, 4).alias("sup"), round_to(c, 4).alias("con"),
                    round_to(s, 4).alias("kw"), nli_policy(s, c, s).alias("decision"),
                ),
            ),
        )

    def score_row(self, claim: Column, context: Column) -> Column:
        return self.score(claim, self.context_words(context), self.negates(context))


def lexical_verdict(scores: Column) -> Column:
    """Five-way label from lexical scores."""
    return (
        F.when(scores["con"] >= 0.30, F.lit("contradicted"))
        .when(scores["sup"] >= 0.80, F.lit("supported"))
        .when(scores["sup"] >= 0.30, F.lit("partially_supported"))
        .when(scores["sup"] >= 0.05, F.lit("unsupported"))
        .otherwise(F.lit("insufficient_context"))
    )


def stage1_supported(label: Column, confidence: Column, threshold: float = 0.85) -> Column:
    return F.coalesce((label == "supported") & (confidence >= threshold), F.lit(False))


def stage1_explanation(confidence: Column) -> Column:
    return F.concat(
        F.lit("Stage 1 (Zero-Shot NLI) verified as supported (confidence: "),
        two_digits(confidence), F.lit(")."),
    )


def cascade_verdict(retrieval_error: Column, stage1_label: Column, stage1_conf: Column,
                    stage2: Column, threshold: float = 0.85) -> Column:
    """Verdict struct of one claim: retrieval failure, else stage 1, else stage 2.

    ``stage2`` is struct<label, score, error_type, evidence_span, explanation>.
    """

    def verdict(label, score, error_type, span, explanation) -> Column:
        return F.struct(
            label.alias("label"), score.cast("double").alias("score"),
            error_type.alias("error_type"), span.alias("evidence_span"),
            explanation.alias("explanation"),
        )

    none = F.lit(None).cast("string")
    return (
        F.when(
            retrieval_error.isNotNull(),
            verdict(F.lit("insufficient_context"), F.lit(0.45), F.lit("retrieval_failure"), none,
                    F.concat(F.lit("Retrieval failed: "), retrieval_error)),
        )
        .when(
            stage1_supported(stage1_label, stage1_conf, threshold),
            verdict(F.lit("supported"), round_to(F.lit(1.0) - stage1_conf, 6), F.lit("none"),
                    F.lit(""), stage1_explanation(stage1_conf)),
        )
        .otherwise(
            verdict(stage2["label"], stage2["score"], stage2["error_type"],
                    stage2["evidence_span"], stage2["explanation"])
        )
    )


def cascade_with_scorer(df: DataFrame, stage2: Callable[[DataFrame, Column], DataFrame],
                        threshold: float = 0.85) -> DataFrame:
    """Run a costly scorer only on claims that stage 1 did not settle.

    ``df`` has stage1_label and stage1_conf; ``stage2(df, only)`` adds label and score to the rows
    for which ``only`` holds and leaves the others alone, as ``with_scorer`` does.  One pass:
    settled rows do not cross into Python with their texts, and nothing is written or joined.
    """
    settled = stage1_supported(F.col("stage1_label"), F.col("stage1_conf"), threshold)
    first = round_to(F.lit(1.0) - F.col("stage1_conf"), 6)
    return stage2(df, ~settled).withColumns(
        {
            "label": F.when(settled, F.lit("supported")).otherwise(F.col("label")),
            "score": F.when(settled, first).otherwise(F.col("score")),
            "stage": F.when(settled, F.lit(1)).otherwise(F.lit(2)),
        }
    )

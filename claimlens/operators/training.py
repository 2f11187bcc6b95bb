"""Training rows from validated examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.labels import lookup
from claimlens.functions.text import estimate_tokens, strip

TRAINING_COLUMNS = (
    "id", "question", "context", "answer", "claim", "label", "hallucination_score", "error_type",
    "evidence_span", "explanation", "decision", "prompt_version", "split",
)
NLI_IDS = {
    "supported": 0, "neutral": 1, "partially_supported": 1, "unsupported": 1,
    "insufficient_context": 1, "contradicted": 2,
}


def premise(question: Column, context: Column) -> Column:
    q, c = strip(F.coalesce(question, F.lit(""))), strip(F.coalesce(context, F.lit("")))
    return F.when(q != "", F.concat(F.lit("Soru: "), q, F.lit("\nBağlam: "), c)).otherwise(c)


def nli_pairs(df: DataFrame) -> DataFrame:
    """id, premise, hypothesis, label id (supported 0, neutral 1, contradicted 2)."""
    return df.select(
        "id",
        premise(F.col("question"), F.col("context")).alias("premise"),
        strip(F.coalesce("claim", F.lit(""))).alias("hypothesis"),
        lookup(F.coalesce("label", F.lit("neutral")), NLI_IDS).alias("label"),
    )


def classifier_text(question: Column, context: Column, answer: Column, claim: Column) -> Column:
    shown = F.when(F.length(claim) > 0, claim).otherwise(answer)
    return F.concat(
        F.lit("Soru: "), question, F.lit("\n\nBaglam:\n"), context, F.lit("\n\nCevap:\n"), answer,
        F.lit("\n\nIddia:\n"), shown,
    )


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` marks of a literal template with columns."""
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


def _json_text(c: Column) -> Column:
    """JSON string literal of a text column, quotes included."""
    boxed = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def assistant_json(df_cols=F.col) -> Column:
    """The six verdict fields as one JSON line with ", " and ": " separators."""
    pairs = []
    for name in ("label", "hallucination_score", "error_type", "evidence_span", "explanation",
                 "decision"):
        c = df_cols(name)
        value = c.cast("string") if name == "hallucination_score" else _json_text(c)
        pairs.append(F.concat(F.lit(f'"{name}": '), value))
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def chat_rows(df: DataFrame, system_prompt: str, user_template: str) -> DataFrame:
    """id, label, split, prompt_version and messages array<struct<role,content>>."""
    fields = {n: F.col(n) for n in ("question", "context", "answer", "claim")}

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.select(
        "id", "label", "split",
        F.coalesce(F.when(F.length("prompt_version") > 0, F.col("prompt_version")),
                   F.lit("v1.0")).alias("prompt_version"),
        F.array(
            message("system", F.lit(system_prompt)),
            message("user", fill_template(user_template, fields)),
            message("assistant", assistant_json()),
        ).alias("messages"),
    )


def skip_ratio(df: DataFrame, is_valid: str = "is_valid") -> DataFrame:
    """One row: total_seen, n_skipped, skip_ratio."""
    seen = df.agg(
        F.count("*").alias("total_seen"),
        F.count(F.when(~F.col(is_valid), 1)).alias("n_skipped"),
    )
    return seen.withColumn(
        "skip_ratio", F.col("n_skipped") / F.greatest(F.col("total_seen"), F.lit(1))
    )


def skip_guard(df: DataFrame, max_skip_ratio: float = 0.05, strict: bool = False) -> DataFrame:
    """Valid rows; raises when too many (strict: any) rows are invalid."""
    row = skip_ratio(df).first()
    if row["n_skipped"] and (strict or row["skip_ratio"] > max_skip_ratio):
        raise ValueError(
            f"skipped {row['n_skipped']}/{row['total_seen']} examples, "
            f"limit {0.0 if strict else max_skip_ratio:.1%}"
        )
    return df.where("is_valid")


def token_length_stats(df: DataFrame, text: Column,
                       tokens: Callable[[Column], Column] = estimate_tokens,
                       percentiles=(50, 75, 90, 95, 99, 100)) -> DataFrame:
    """One row: n, mean, std, min, max, p50 ... p100.

    Exact percentiles keep one counter per distinct length, and lengths are small integers.
    """
    lengths = df.select(tokens(text).alias("t"))
    quantiles = F.percentile("t", [p / 100 for p in percentiles])
    stats = lengths.agg(
        F.count("*").alias("n"), F.avg("t").alias("mean"), F.stddev_pop("t").alias("std"),
        F.min("t").alias("min"), F.max("t").alias("max"), quantiles.alias("q"),
    )
    return stats.select(
        "n", "mean", "std", "min", "max",
        *[F.col("q")[i].cast("int").alias(f"p{p}") for i, p in enumerate(percentiles)],
    )


def training_projection(df: DataFrame) -> DataFrame:
    return df.select(*TRAINING_COLUMNS)

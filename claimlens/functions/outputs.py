"""Raw model output text -> verdict columns, in four tiers, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.labels import default_decision, label_attr
from claimlens.functions.text import cut, is_blank, strip


def balanced_block(text: Column) -> Column:
    """First ``{...}`` with matching braces (braces inside strings count), else null.

    The text is cut after every brace, so the fold runs over braces, not characters, and the
    cut looks at one character only, which keeps it linear in the text.
    """
    tail = F.substring(text, F.instr(text, "{"), F.length(text))
    pieces = F.split(tail, "(?<=[{}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        opened = F.when(F.endswith(piece, F.lit("{")), 1)
        depth = acc["depth"] + opened.when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (acc["used"] + F.length(piece)).alias("used"),
                (depth == 0).alias("done"),
            )
        )

    fold = F.aggregate(pieces, start, step)
    block = let(fold, lambda f: F.when(f["done"], F.substring(tail, F.lit(1), f["used"])))
    return F.when(F.contains(text, F.lit("{")), block)


def whole_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else null.

    The JSON reader accepts trailing text; inside brackets that becomes a syntax error
    or a second element, so both are noticed.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(
        boxed,
        lambda v: F.when(
            F.startswith(F.schema_of_variant(v), F.lit("ARRAY<OBJECT"))
            & F.try_variant_get(v, "$[1]", "variant").isNull(),
            F.try_variant_get(v, "$[0]", "variant"),
        ),
    )


def _verdict(label, score, error_type, span, explanation, decision, parse_error, raw, tier):
    return F.struct(
        label.alias("label"), score.cast("double").alias("hallucination_score"),
        error_type.alias("error_type"), span.alias("evidence_span"),
        explanation.alias("explanation"), decision.alias("decision"),
        F.lit(parse_error).alias("parse_error"), raw.alias("raw_output"),
        F.lit(tier).alias("tier"),
    )


def _text_field(obj: Column, name: str) -> tuple[Column, Column]:
    """(value, usable): missing -> "", a JSON null or another type is unusable."""
    value = F.try_variant_get(obj, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    usable = value.isNull() | (kind == "STRING")
    return F.coalesce(F.try_variant_get(obj, f"$.{name}", "string"), F.lit("")), usable


def object_verdict(obj: Column, tier: int) -> Column:
    """Verdict struct from a parsed JSON object; null when it cannot be used."""

    def field(name: str) -> Column:
        return F.try_variant_get(obj, f"$.{name}", "string")

    def missing(name: str) -> Column:
        return F.try_variant_get(obj, f"$.{name}", "variant").isNull()

    label = field("label")
    score = F.when(missing("hallucination_score"), F.lit(0.5)).otherwise(
        strip(field("hallucination_score")).try_cast("double")
    )
    span, span_ok = _text_field(obj, "evidence_span")
    explanation, explanation_ok = _text_field(obj, "explanation")
    error_type, decision = field("error_type"), field("decision")
    usable = label.isin(list(fv.LABELS)) & score.isNotNull() & span_ok & explanation_ok
    return F.when(
        usable,
        _verdict(
            label,
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)),
            F.when(error_type.isin(list(fv.ERROR_TYPES)), error_type).otherwise(F.lit("none")),
            span,
            explanation,
            F.when(missing("decision"), F.lit("warn"))
            .when(decision.isin(list(fv.DECISIONS)), decision)
            .otherwise(default_decision(label)),
            False,
            F.lit(None).cast("string"),
            tier,
        ),
    )


def pattern_verdict(text: Column) -> Column:
    """Verdict from single fields found by pattern; null without a known label.

    A bare label is searched longest name first, because "supported" is part of two
    others.
    """

    def quoted(name: str) -> Column:
        value = F.regexp_extract(text, f'"{name}"\\s*:\\s*"([^"]*)"', 1)
        return F.when(value != "", value)

    number = F.regexp_extract(text, r'"hallucination_score"\s*:\s*([0-9]*\.?[0-9]+)', 1)
    bare = F.coalesce(
        *[F.when(F.contains(text, F.lit(x)), F.lit(x))
          for x in sorted(fv.LABELS, key=lambda s: (-len(s), s))],
        F.lit(None),
    )
    label = F.when(quoted("label").isin(list(fv.LABELS)), quoted("label")).otherwise(bare)

    def build(name: Column) -> Column:
        error_type, decision = quoted("error_type"), quoted("decision")
        score = F.coalesce(number.try_cast("double"), label_attr(name, "typical", 0.5))
        return F.when(
            name.isNotNull(),
            _verdict(
                name,
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)),
                F.when(error_type.isin(list(fv.ERROR_TYPES)), error_type)
                .when(name == "supported", F.lit("none"))
                .otherwise(F.lit("unsupported_inference")),
                F.coalesce(quoted("evidence_span"), F.lit("")),
                F.coalesce(quoted("explanation"), F.lit(fv.NO_EXPLANATION)),
                F.when(decision.isin(list(fv.DECISIONS)), decision).otherwise(
                    default_decision(name)
                ),
                True,
                cut(text, 500, "..."),
                3,
            ),
        )

    return let(label, build)


def sentinel(raw: Column, reason: str) -> Column:
    return _verdict(
        F.lit("insufficient_context"), F.lit(0.5), F.lit("none"), F.lit(""),
        F.lit(f"[PARSE ERROR: {reason}]"), F.lit("warn"), True,
        F.coalesce(cut(raw, 500, "..."), F.lit("")), 4,
    )


def parse_output(raw: Column) -> Column:
    """Whole object -> first balanced block -> field patterns -> sentinel."""
    tier1 = let(whole_object(strip(raw)), lambda v: object_verdict(v, 1))
    tier2 = let(whole_object(balanced_block(raw)), lambda v: object_verdict(v, 2))
    return F.when(is_blank(raw), sentinel(raw, "Empty output")).otherwise(
        F.coalesce(
            tier1, tier2, pattern_verdict(raw), sentinel(raw, "All parsing strategies failed")
        )
    )


def fenced_json(raw: Column) -> Column:
    """VARIANT object from text with optional code fences; null when there is none."""

    def outermost(bare: Column) -> Column:
        first, from_end = F.instr(bare, "{"), F.instr(F.reverse(bare), "}")
        length = F.length(bare) - from_end - first + 2
        return F.when(
            (first > 0) & (from_end > 0) & (length > 0), F.substring(bare, first, length)
        )

    bare = strip(F.regexp_replace(raw, r"```(?:json)?\s*", ""))
    return whole_object(let(bare, outermost))


def coerce_output(label: Column, error_type: Column, decision: Column) -> Column:
    """struct<label, error_type, decision, error> with soft fallbacks for model output."""
    known = label.isin([*fv.LABELS, "parse_error"])
    return F.struct(
        label.alias("label"),
        F.when(error_type.isin(list(fv.ERROR_TYPES)), error_type).otherwise("none").alias(
            "error_type"
        ),
        F.when(decision.isin(list(fv.DECISIONS)), decision).otherwise("warn").alias("decision"),
        F.when(~known, F.concat(F.lit("Invalid label '"), label, F.lit("'"))).alias("error"),
    )


def accept_generated(label, score, error_type, decision, question, answer) -> Column:
    """Is a generated example usable: vocabulary, score range, non-blank texts?"""
    return F.coalesce(
        label.isin(list(fv.LABELS))
        & score.between(0.0, 1.0)
        & error_type.isin(list(fv.ERROR_TYPES))
        & decision.isin(list(fv.DECISIONS))
        & ~is_blank(question)
        & ~is_blank(answer),
        F.lit(False),
    )

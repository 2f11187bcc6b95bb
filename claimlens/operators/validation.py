"""Rule checks over a table of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.labels import label_attr, label_dim
from claimlens.functions.numbers import ratio, round_to
from claimlens.functions.text import is_blank
from claimlens.operators.alignment import leakage

REQUIRED_TEXT = {
    "id": 0, "question": 5, "context": 10, "answer": 1, "claim": 5, "label": 0, "error_type": 0,
    "explanation": 10, "decision": 0, "source_type": 0, "split": 0,
}
VOCABULARIES = {
    "label": fv.LABELS, "error_type": fv.ERROR_TYPES, "decision": fv.DECISIONS,
    "split": fv.SPLITS, "source_type": fv.SOURCE_TYPES, "domain": fv.DOMAINS,
}
MINIMA = {
    "claim_index": 0, "claim_count_in_answer": 1, "context_source_count": 1,
    "evidence_source_index": 0, "annotation_round": 1,
}
UNIT_RANGE = ("hallucination_score", "annotation_confidence")


def _issue(field: str, when: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        when, F.struct(F.lit(field).alias("field"), text.alias("error"))
    )


def _rules(df: DataFrame) -> list[Column]:
    """One struct-or-null per rule; rules for absent optional columns are left out."""
    has = set(df.columns)
    out = []
    for field, shortest in REQUIRED_TEXT.items():
        c = F.col(field)
        out.append(_issue(field, c.isNull(), "Field required"))
        if shortest:
            unit = "character" if shortest == 1 else "characters"
            out.append(_issue(field, F.length(c) < shortest,
                              f"String should have at least {shortest} {unit}"))
    out.append(_issue("hallucination_score", F.col("hallucination_score").isNull(),
                      "Field required"))
    for field in UNIT_RANGE:
        if field in has:
            out.append(_issue(field, F.col(field) < 0,
                              "Input should be greater than or equal to 0"))
            out.append(_issue(field, F.col(field) > 1, "Input should be less than or equal to 1"))
    for field, least in MINIMA.items():
        if field in has:
            out.append(_issue(field, F.col(field) < least,
                              f"Input should be greater than or equal to {least}"))
    for field, allowed in VOCABULARIES.items():
        if field in has:
            listing = "[" + ", ".join(f"'{v}'" for v in sorted(allowed)) + "]"
            text = F.concat(
                F.lit(f"Value error, Invalid {field} '"), F.col(field),
                F.lit(f"'. Must be one of: {listing}"),
            )
            out.append(_issue(field, ~F.col(field).isin(list(allowed)), text))
    out.append(_issue(
        "id", ~F.startswith("id", F.lit(fv.ID_PREFIX)),
        F.concat(F.lit(f"Value error, ID must start with '{fv.ID_PREFIX}', got: '"), F.col("id"),
                 F.lit("'")),
    ))
    return out


def _cross_rules() -> list[Column]:
    label = F.col("label")
    return [
        F.when(
            (label == "supported") & (F.col("error_type") != "none"),
            F.concat(F.lit("label='supported' requires error_type='none', got '"),
                     F.col("error_type"), F.lit("'")),
        ),
        F.when(
            label.isin("supported", "contradicted") & is_blank(F.col("evidence_span")),
            F.concat(F.lit("label='"), label, F.lit("' requires a non-empty evidence_span")),
        ),
        F.when(
            F.col("claim_index") >= F.col("claim_count_in_answer"),
            F.format_string("claim_index (%d) must be < claim_count_in_answer (%d)",
                            "claim_index", "claim_count_in_answer"),
        ),
    ]


def field_errors(df: DataFrame) -> DataFrame:
    """Add ``errors`` array<struct<field,error>> of single-field rules."""
    return df.withColumn("errors", F.array_compact(F.array(*_rules(df))))


def row_errors(df: DataFrame) -> Column:
    """Field errors, or the one combined cross-field error of a row without field errors.

    One bound expression: the rules appear once however often the result is referenced, so
    filters that the optimizer derives from a later explode stay small.
    """

    def combined(parts: Column) -> Column:
        message = F.concat(F.lit("Value error, "), F.array_join(parts, "; "))
        one = F.struct(F.lit("").alias("field"), message.alias("error"))
        return F.filter(F.array(one), lambda _: F.size(parts) > 0)

    def gated(found: Column) -> Column:
        cross = let(F.array_compact(F.array(*_cross_rules())), combined)
        return F.when(F.size(found) > 0, found).otherwise(cross)

    return let(F.array_compact(F.array(*_rules(df))), gated)


def score_range_warning(label: Column, score: Column) -> Column:
    """Guideline message, null when the score fits its label."""
    lo, hi = label_attr(label, "score_lo"), label_attr(label, "score_hi")
    return F.when(
        ~score.between(lo, hi),
        F.concat(
            F.lit("hallucination_score="), score.cast("string"),
            F.lit(" is outside the guideline range ["), lo.cast("string"), F.lit(", "),
            hi.cast("string"), F.lit("] for label='"), label,
            F.lit("' (guideline only, not an error)"),
        ),
    )


def validate(df: DataFrame) -> DataFrame:
    """Rows with ``errors``, ``is_valid`` and ``score_warning``."""
    out = df.withColumn("errors", row_errors(df))
    ok = F.size("errors") == 0
    return out.withColumns(
        {
            "is_valid": ok,
            "score_warning": F.when(
                ok, score_range_warning(F.col("label"), F.col("hallucination_score"))
            ),
        }
    )


def explode_errors(df: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per entry of ``errors``: the kept columns, field and error.

    The outer form matters: for a plain explode the optimizer derives a filter on the whole
    rule array and pushes it through every projection below, which can take minutes to plan.
    """
    rows = df.select(*keep, F.explode_outer("errors").alias("e"))
    return rows.where(F.col("e").isNotNull()).select("*", "e.field", "e.error").drop("e")


def duplicate_ids(df: DataFrame, id_col: str = "id", seq: str = "line") -> DataFrame:
    """Second and later occurrences of an id.

    First positions are aggregated (map-side combine) and only repeated ids are joined
    back; no window ever sorts all rows of a hot id in one task.
    """
    first = df.groupBy(id_col).agg(F.min(seq).alias("_first"), F.count("*").alias("_n"))
    repeated = first.where(F.col("_n") > 1).drop("_n")
    return df.join(repeated, id_col).where(F.col(seq) > F.col("_first")).drop("_first")


def validation_errors(df: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """One row per problem: line, id, field, error.  ``corrupt`` has line and message."""
    shown_id = F.coalesce("id", F.concat(F.lit("line_"), F.col("line").cast("string")))
    rules = explode_errors(validate(df), "line", shown_id.alias("id"))
    again = duplicate_ids(df.select("id", "line")).select(
        "line", "id", F.lit("id").alias("field"),
        F.concat(F.lit("Duplicate ID: '"), F.col("id"), F.lit("'")).alias("error"),
    )
    out = rules.unionByName(again)
    if corrupt is not None:
        out = out.unionByName(
            corrupt.select(
                "line", F.lit("?").alias("id"), F.lit("JSON").alias("field"),
                F.concat(F.lit("Invalid JSON: "), F.col("message")).alias("error"),
            )
        )
    return out


def validation_summary(df: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """One row: n_total (distinct ids), n_valid, n_errors, n_score_warnings, leakage counts.

    ``corrupt`` has a row for each line that is no JSON; these count as errors.
    """
    checked = validate(df)
    shown_id = F.coalesce("id", F.concat(F.lit("line_"), F.col("line").cast("string")))
    per_id = checked.groupBy(shown_id.alias("id")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("is_valid").cast("int")).alias("valid"),
        F.sum(F.size("errors")).alias("errors"),
        F.count("score_warning").alias("warnings"),
    )
    totals = per_id.agg(
        F.count("*").alias("n_total"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(F.col("errors") + F.col("n") - 1), F.lit(0)).alias("n_errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("n_score_warnings"),
    )
    if corrupt is not None:
        broken = corrupt.agg(F.count("*").alias("n")).scalar()
        totals = totals.withColumn("n_errors", F.col("n_errors") + broken)
    leaks = leakage(checked.where("is_valid")).where(F.col("type") != "val_test_leakage")
    return totals.select(
        "*",
        *[
            leaks.where(F.col("type") == t).select("n_overlapping_contexts").scalar()
            .alias("n_" + t)
            for t in ("train_test_leakage", "train_val_leakage")
        ],
    )


def distributions(df: DataFrame) -> DataFrame:
    """Counts of valid rows by label, split, domain and source in one grouping-sets pass,
    in which the rules run once.

    Labels that do not occur are listed with 0; ``pct`` is the share of valid rows (labels only).
    """
    df = validate(df).where("is_valid")
    families = ("label", "split", "domain", "source_type")
    view = df.select(*families)
    grouped = view.groupingSets(
        [[F.col(f)] for f in families], *[F.col(f) for f in families]
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    masks = {0b0111: "label", 0b1011: "split", 0b1101: "domain", 0b1110: "source_type"}
    family = F.coalesce(*[F.when(F.col("g") == m, F.lit(f)) for m, f in masks.items()])
    tidy = grouped.select(
        family.alias("family"),
        F.coalesce(*[F.when(F.col("g") == m, F.col(f)) for m, f in masks.items()]).alias("value"),
        "n",
    ).where(F.col("value").isNotNull())
    known = label_dim(df.sparkSession).select(
        F.lit("label").alias("family"), F.col("label").alias("value")
    )
    zero = known.select("family", "value", F.lit(0).cast("bigint").alias("n"))
    counts = tidy.unionByName(zero).groupBy("family", "value").agg(F.sum("n").alias("n"))
    # a valid row has a label, so the label family adds up to all rows; a family has few values
    total = F.sum("n").over(Window.partitionBy("family"))
    pct = F.when(F.col("family") == "label", round_to(ratio(F.col("n") * 100, total), 1))
    return counts.withColumn("pct", pct)

"""Label dictionary as a (five-row) dimension table and as literal lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.numbers import round_to

LABEL_SCHEMA = (
    "label string, score_lo double, score_hi double, typical double, default_decision string, "
    "nli3 string, binary string, risk string, danger_weight double"
)


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in fv.LABEL_ROWS], LABEL_SCHEMA)


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Literal dictionary lookup without a join."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def label_attr(label: Column, field: str, default=None) -> Column:
    at = fv.LABEL_FIELDS.index(field)
    return lookup(label, {r[0]: r[at] for r in fv.LABEL_ROWS}, default)


def to_nli3(label: Column, default: str | None = "neutral") -> Column:
    return label_attr(label, "nli3", default)


def to_binary(label: Column) -> Column:
    return F.when(label == "supported", F.lit("supported")).otherwise(F.lit("unsupported"))


def risk(label: Column) -> Column:
    return label_attr(label, "risk", "unsafe")


def default_decision(label: Column) -> Column:
    return label_attr(label, "default_decision", "warn")


def is_hallucinated(label: Column) -> Column:
    return F.coalesce(label.isin("contradicted", "unsupported"), F.lit(False))


def clamp_score(label: Column, score: Column) -> Column:
    lo, hi = label_attr(label, "score_lo", 0.0), label_attr(label, "score_hi", 1.0)
    return round_to(F.greatest(lo, F.least(hi, score)), 4)


def gold_accepts(gold: Column, decision: Column, unknown_gold: bool | None = None) -> Column:
    """Is the decision acceptable for the gold label?  Null when there is no gold.

    ``unknown_gold`` is the answer for a gold value outside the vocabulary: null
    for the combined detector, False for the entailment scorer.
    """
    from claimlens.functions.text import strip

    key = F.lower(strip(gold))
    verdict = F.when(key.isin(list(fv.GOLD_ACCEPTS)), F.lit(False)).otherwise(
        F.lit(unknown_gold).cast("boolean")
    )
    hit = F.lit(False)
    for name, accepted in fv.GOLD_ACCEPTS.items():
        hit = hit | ((key == name) & decision.isin(list(accepted)))
    has_gold = F.coalesce(F.length(gold) > 0, F.lit(False))
    return F.when(has_gold, F.when(hit, F.lit(True)).otherwise(verdict))

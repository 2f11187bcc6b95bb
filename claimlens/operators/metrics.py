"""Evaluation tables from aligned rows.

Aligned rows have: gold, pred, score, and optionally gold_span, pred_span, context,
parse_error, latency_ms.  Classification metrics all derive from one (gold, pred) count
table; every other family is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.labels import label_attr, to_binary, to_nli3
from claimlens.functions.numbers import EXACT, exact_mean, ratio, round_to
from claimlens.functions.text import is_blank, span_in_context, strip, token_f1
from claimlens.operators.ranking import as_scalar, percentiles
from claimlens.session import cut_lineage


def _non_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def prediction_fields(pred: DataFrame, score_col: str | None = None) -> DataFrame:
    """Normalise prediction records with varying key names.

    label: predicted_label, pred_label, label.  score: confidence, pred_hallucination_score,
    hallucination_score, 0.5 (or ``score_col``).  span: pred_evidence_span, evidence_span,
    first of evidence_spans, evidence_span inside raw_output.
    """
    has = set(pred.columns)

    def pick(*names: str, cast: str = "string") -> list[Column]:
        return [F.col(n).cast(cast) for n in names if n in has]

    labels = pick("predicted_label", "pred_label", "label")
    score_names = (score_col,) if score_col else (
        "confidence", "pred_hallucination_score", "hallucination_score"
    )
    spans = [_non_empty(c) for c in pick("pred_evidence_span", "evidence_span")]
    if "evidence_spans" in has:
        spans.append(_non_empty(F.get("evidence_spans", F.lit(0))))
    if "raw_output" in has:
        spans.append(F.get_json_object("raw_output", "$.evidence_span"))
    out = {
        "pred": F.coalesce(*labels, F.lit("")),
        "score": F.coalesce(*pick(*score_names, cast="double"), F.lit(0.5)),
        "pred_span": F.coalesce(*spans, F.lit("")),
        "parse_error": F.coalesce(*pick("parse_error", cast="boolean"), F.lit(False)),
    }
    if "latency_ms" in has:
        out["latency_ms"] = F.col("latency_ms").cast("double")
    keep = [F.col(n) for n in ("id", "seq") if n in has]
    return pred.select(*keep, *[c.alias(n) for n, c in out.items()])


def pair_counts(df: DataFrame) -> DataFrame:
    """Rows per (gold, pred): at most a few dozen rows whatever the input size."""
    return df.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def accuracy(df: DataFrame) -> DataFrame:
    hits = F.sum((F.col("gold") == F.col("pred")).cast("int"))
    return df.agg(
        F.count("*").alias("n"), F.coalesce(hits, F.lit(0)).alias("n_correct")
    ).withColumn("accuracy", round_to(ratio(F.col("n_correct"), F.col("n")), 4))


def _label_sums(counts: DataFrame) -> DataFrame:
    """Per label: support, predicted and hit counts, from a count table."""
    sides = F.array(
        F.struct(
            F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
            F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    return (
        counts.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )


def _prf(df: DataFrame) -> DataFrame:
    return df.select(
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.col("hits") * 2, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def per_class(df: DataFrame, labels=fv.LABELS) -> DataFrame:
    """Precision, recall, F1 and support for every label of the vocabulary."""
    counts = pair_counts(df)
    zero = F.lit(0).cast("bigint")
    known = df.sparkSession.createDataFrame([(x,) for x in labels], "label string").select(
        "label", zero.alias("support"), zero.alias("predicted"), zero.alias("hits")
    )
    sums = (
        _label_sums(counts).where(F.col("label").isin(list(labels))).unionByName(known)
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    rounded = {c: round_to(F.col(c), 4) for c in ("precision", "recall", "f1")}
    return _prf(sums).withColumns(rounded)


def f1_averages(df: DataFrame) -> DataFrame:
    """One row: macro_f1 over labels that occur in gold or pred, weighted_f1 by support."""
    prf = _prf(_label_sums(pair_counts(df)))
    return prf.agg(
        round_to(F.avg("f1"), 4).alias("macro_f1"),
        round_to(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 4).alias(
            "weighted_f1"
        ),
    )


def confusion_matrix(df: DataFrame, labels=fv.LABELS) -> DataFrame:
    """One row per gold label (zeros included), one column per predicted label."""
    names = sorted(labels)
    known = df.sparkSession.createDataFrame([(x,) for x in names], "gold string")
    cells = pair_counts(df).where(F.col("gold").isin(names))
    zero = known.select("gold", F.lit(None).cast("string").alias("pred"),
                        F.lit(0).cast("bigint").alias("n"))
    return (
        cells.unionByName(zero)
        .groupBy("gold")
        .agg(*[
            F.coalesce(F.sum(F.when(F.col("pred") == x, F.col("n"))), F.lit(0)).alias(x)
            for x in names
        ])
    )


def bin_edges(n_bins: int) -> list[float]:
    """Evenly spaced edges with the floating-point values of i * (1/n)."""
    return [*[i * (1.0 / n_bins) for i in range(n_bins)], 1.0]


def _bin(score: Column, n_bins: int) -> Column:
    """1-based bin; the last bin is closed, scores outside [0, 1] get null."""
    edges = bin_edges(n_bins)
    reached = sum(((score >= e).cast("int") for e in edges[1:-1]), F.lit(1))
    return F.when((score >= 0.0) & (score <= 1.0), reached)


def _binned(df: DataFrame, n_bins: int) -> DataFrame:
    truth = label_attr(F.col("gold"), "typical", 0.5)
    return (
        df.select(F.col("score"), truth.alias("truth"), _bin(F.col("score"), n_bins).alias("bin"))
        .groupBy("bin")
        .agg(
            F.count("*").alias("n"), exact_mean(F.col("score")).alias("conf"),
            exact_mean(F.col("truth")).alias("acc"),
            F.sum(
                ((F.col("score") - F.col("truth")) * (F.col("score") - F.col("truth"))).cast(EXACT)
            ).cast("double").alias("sq"),
        )
    )


def reliability_bins(df: DataFrame, n_bins: int = 10) -> DataFrame:
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    gap = F.abs(F.col("conf") - F.col("acc"))
    return _binned(df, n_bins).where(F.col("bin").isNotNull()).select(
        round_to(F.get(edges, F.col("bin") - 1), 2).alias("bin_lower"),
        round_to(F.get(edges, F.col("bin")), 2).alias("bin_upper"),
        round_to(F.col("conf"), 4).alias("avg_confidence"),
        round_to(F.col("acc"), 4).alias("accuracy"),
        "n",
        round_to(gap, 4).alias("calibration_error"),
    )


def calibration(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: ece, mce, brier_score, n_bins."""
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("acc")))
    return _binned(df, n_bins).agg(
        round_to(ratio(F.sum(gap * F.col("n")), F.sum("n")), 4).alias("ece"),
        round_to(F.coalesce(F.max(gap), F.lit(0.0)), 4).alias("mce"),
        round_to(ratio(F.sum("sq"), F.sum("n")), 4).alias("brier_score"),
    ).withColumn("n_bins", F.lit(n_bins))


def span_metrics(df: DataFrame) -> DataFrame:
    """One row over rows with a gold span: exact match, token F1 mean/std, span in context."""
    gold, pred = strip(F.col("gold_span")), strip(F.coalesce("pred_span", F.lit("")))
    rows = df.where(~is_blank(F.col("gold_span"))).select(
        (F.lower(gold) == F.lower(pred)).cast("int").alias("exact"),
        token_f1(pred, gold).alias("f1"),
        span_in_context(pred, F.col("context")).cast("int").alias("found"),
    )
    return rows.agg(
        F.count("*").alias("n_evaluated"),
        round_to(F.avg("exact"), 4).alias("exact_match_rate"),
        round_to(exact_mean(F.col("f1")), 4).alias("token_f1_mean"),
        round_to(F.stddev_pop("f1"), 4).alias("token_f1_std"),
        round_to(F.avg("found"), 4).alias("span_in_context_rate"),
    )


def json_validity(df: DataFrame) -> DataFrame:
    errors = F.coalesce(F.sum(F.col("parse_error").cast("int")), F.lit(0))
    totals = df.agg(F.count("*").alias("n_total"), errors.alias("n_parse_errors"))
    return totals.withColumn("n_valid", F.col("n_total") - F.col("n_parse_errors")).withColumn(
        "json_validity_rate", round_to(ratio(F.col("n_valid"), F.col("n_total")), 4)
    )


def latency_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: mean, median, p95 (linear interpolation) and max in ms.

    Exact percentiles come from counts (``ranking.percentiles``); ``approximate`` uses a
    fixed-size sketch instead.
    """
    # read several times below, so one narrow column is written out
    rows = cut_lineage(df.where(F.col("latency_ms").isNotNull()).select("latency_ms"), "latency")
    shares = {"median_ms": 0.5, "p95_ms": 0.95}
    if approximate:
        found = rows.agg(*[F.percentile_approx("latency_ms", F.lit(p)).alias(n) for n, p in shares.items()])
    else:
        found = percentiles(rows, "latency_ms", shares)
    found = as_scalar(found)
    return rows.agg(
        round_to(exact_mean(F.col("latency_ms")), 1).alias("mean_ms"),
        round_to(F.max("latency_ms"), 1).alias("max_ms"),
    ).select("mean_ms", *[round_to(found[n], 1).alias(n) for n in shares], "max_ms")


def label_distributions(df: DataFrame) -> DataFrame:
    """side (gold/pred), label, n from the count table."""
    sides = F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gold").alias("label"), "n"),
        F.struct(F.lit("pred").alias("side"), F.col("pred").alias("label"), "n"),
    )
    return (
        pair_counts(df).select(F.inline(sides)).groupBy("side", "label")
        .agg(F.sum("n").alias("n"))
    )


def success_gates(df: DataFrame) -> DataFrame:
    """name, value, threshold, passed for the three acceptance criteria."""
    gold_con = F.col("gold") == "contradicted"
    one = (
        df.agg(
            round_to(
                ratio(F.count(F.when(~F.col("parse_error"), 1)), F.count("*")), 4
            ).alias("json_validity_rate"),
            round_to(
                ratio(F.count(F.when(gold_con & (F.col("pred") == "contradicted"), 1)),
                      F.count(F.when(gold_con, 1))), 4
            ).alias("contradicted_recall"),
        )
        .withColumn("ece", calibration(df).select("ece").scalar())
    )
    gates = F.array(
        F.struct(F.lit("json_validity").alias("name"), F.col("json_validity_rate").alias("value"),
                 F.lit(0.95).alias("threshold"),
                 (F.col("json_validity_rate") > 0.95).alias("passed")),
        F.struct(F.lit("contradicted_recall").alias("name"),
                 F.col("contradicted_recall").alias("value"), F.lit(0.60).alias("threshold"),
                 (F.col("contradicted_recall") > 0.60).alias("passed")),
        F.struct(F.lit("ece").alias("name"), F.col("ece").alias("value"),
                 F.lit(0.15).alias("threshold"), (F.col("ece") < 0.15).alias("passed")),
    )
    return one.select(F.inline(gates))


# --- batch summaries of the three scorers -------------------------------------------------
def _accuracy_on_gold() -> list[Column]:
    n_gold, n_ok = F.count("is_correct"), F.count(F.when(F.col("is_correct"), 1))
    return [
        n_gold.alias("n_with_gold"), n_ok.alias("n_correct"),
        F.when(n_gold > 0, round_to(ratio(n_ok, n_gold), 4)).alias("accuracy"),
    ]


def classifier_batch_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Columns predicted_label, decision, is_correct -> one row per batch key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count(F.when(F.col("decision") == "accept", 1)).alias("n_accept"),
        F.count(F.when(F.col("decision") != "accept", 1)).alias("n_block"),
        *[
            F.count(F.when(F.col("predicted_label") == x, 1)).alias(f"n_{x}") for x in fv.LABELS
        ],
        *_accuracy_on_gold(),
    )


def nli_batch_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Columns sup, con, decision, is_correct; an empty batch gives nulls."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        *[
            F.count(F.when(F.col("decision") == d, 1)).alias(f"n_{d}")
            for d in ("accept", "warn", "revise", "insufficient_context")
        ],
        round_to(exact_mean(F.col("sup")), 4).alias("avg_support_score"),
        round_to(exact_mean(F.col("con")), 4).alias("avg_contradiction_score"),
        *_accuracy_on_gold(),
    )


def hybrid_batch_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Columns hallucination_score, is_correct -> scores and accuracy per batch key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.coalesce(round_to(exact_mean(F.col("hallucination_score")), 4), F.lit(0.0)).alias(
            "avg_hallucination_score"
        ),
        F.coalesce(round_to(F.max("hallucination_score"), 4), F.lit(0.0)).alias(
            "max_hallucination_score"
        ),
        *_accuracy_on_gold(),
    )


def decision_routing_dist(df: DataFrame) -> DataFrame:
    """family (decision/routing), value, n by grouping sets."""
    grouped = df.select("decision", "routing").groupingSets(
        [[F.col("decision")], [F.col("routing")]], F.col("decision"), F.col("routing")
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.select(
        F.when(F.col("g") == 1, F.lit("decision")).otherwise(F.lit("routing")).alias("family"),
        F.when(F.col("g") == 1, F.col("decision")).otherwise(F.col("routing")).alias("value"), "n",
    )


def nli3_benchmark(df: DataFrame) -> DataFrame:
    """gold3, pred3, n over rows with a gold label, both mapped to three classes."""
    rows = df.where(F.length("gold") > 0).select(
        F.coalesce(to_nli3(F.col("gold"), None), F.col("gold")).alias("gold3"),
        F.coalesce(to_nli3(F.col("pred"), None), F.col("pred")).alias("pred3"),
    )
    return rows.groupBy("gold3", "pred3").agg(F.count("*").alias("n"))


def binary_benchmark(df: DataFrame) -> DataFrame:
    """gold2, pred2, n with everything but supported mapped to unsupported."""
    rows = df.select(to_binary(F.col("gold")).alias("gold2"), to_binary(F.col("pred")).alias("pred2"))
    return rows.groupBy("gold2", "pred2").agg(F.count("*").alias("n"))


def any_hallucination(sentences: DataFrame, record_id: str = "id",
                      label: str = "label") -> DataFrame:
    """Record is unsupported if any sentence is neutral or contradicted."""
    bad = F.bool_or(F.col(label).isin("neutral", "contradicted"))
    return sentences.groupBy(record_id).agg(
        F.when(bad, F.lit("unsupported")).otherwise(F.lit("supported")).alias("label")
    )

"""Gold and prediction tables -> all metric tables, and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators import metrics as m
from claimlens.operators.alignment import align_predictions, extra_predictions, missing_predictions
from claimlens.session import cut_lineage


def aligned(gold: DataFrame, pred: DataFrame, texts: bool = True) -> DataFrame:
    """Gold rows (id, seq, gold, gold_span, context) with their last normalised prediction.

    Without ``texts`` contexts and spans stay out of the shuffles.
    """
    fields = m.prediction_fields(pred)
    if not texts:
        gold, fields = gold.select("id", "seq", "gold"), fields.drop("pred_span")
    both = align_predictions(gold, fields)
    renamed = {
        "pred_pred": "pred", "pred_score": "score", "pred_pred_span": "pred_span",
        "pred_parse_error": "parse_error", "pred_latency_ms": "latency_ms",
    }
    return both.withColumnsRenamed(renamed)


def evaluate(gold: DataFrame, pred: DataFrame) -> dict[str, DataFrame]:
    """All metric families by name; only the span family reads the long texts.

    The narrow alignment is written once to the shared folder and every other family reads that.
    """
    rows = cut_lineage(aligned(gold, pred, texts=False), "aligned")
    fields = m.prediction_fields(pred)
    return {
        "accuracy": m.accuracy(rows),
        "averages": m.f1_averages(rows),
        "per_class": m.per_class(rows),
        "confusion": m.confusion_matrix(rows),
        "calibration": m.calibration(rows),
        "reliability": m.reliability_bins(rows),
        "json_validity": m.json_validity(rows),
        "latency": m.latency_stats(rows),
        "spans": m.span_metrics(aligned(gold, pred)),
        "distributions": m.label_distributions(rows),
        "gates": m.success_gates(rows),
        "missing": missing_predictions(gold, fields).agg(F.count("*").alias("n")),
        "extra": extra_predictions(gold, fields).agg(F.count("*").alias("n")),
    }


def report_lines(tables: dict[str, DataFrame], run_name: str = "") -> list[str]:
    """Markdown lines from the (tiny) metric tables."""

    def row(name: str) -> dict:
        first = tables[name].first()
        return first.asDict() if first else {}

    acc, avg, cal = row("accuracy"), row("averages"), row("calibration")
    js, lat, span = row("json_validity"), row("latency"), row("spans")
    classes = {r["label"]: r for r in tables["per_class"].collect()}
    lines = [
        f"# Evaluation Report: {run_name}", "", f"N examples: {acc['n']}", "",
        "## Classification Metrics",
        f"- Accuracy:    {acc['accuracy']:.4f}",
        f"- Macro F1:    {avg['macro_f1']:.4f}  (primary metric)",
        f"- Weighted F1: {avg['weighted_f1']:.4f}", "", "### Key Recall Metrics",
    ]
    for label, title in (
        ("contradicted", "Contradicted recall:        "),
        ("unsupported", "Unsupported recall:         "),
        ("insufficient_context", "Insufficient context recall:"),
    ):
        lines.append(f"- {title} {classes[label]['recall']:.4f}")
    lines += ["", "### Per-Class Metrics", "| Label | Precision | Recall | F1 | Support |",
              "|-------|-----------|--------|----|---------|"]
    for label in sorted(classes):
        c = classes[label]
        lines.append(f"| {label} | {c['precision']:.4f} | {c['recall']:.4f} | {c['f1']:.4f} | "
                     f"{c['support']} |")
    lines += ["", "## Calibration Metrics (MANDATORY)",
              f"- ECE:         {cal['ece']:.4f}  (target: < 0.15)",
              f"- MCE:         {cal['mce']:.4f}", f"- Brier Score: {cal['brier_score']:.4f}"]
    lines += ["", "## JSON Validity",
              f"- JSON validity rate: {js['json_validity_rate']:.4f}  (target: > 0.95)",
              f"- Parse errors: {js['n_parse_errors']}"]
    if lat.get("mean_ms") is not None:
        lines += ["", "## Latency", f"- Mean: {lat['mean_ms']:.1f} ms",
                  f"- P95:  {lat['p95_ms']:.1f} ms"]
    if span.get("n_evaluated"):
        lines += ["", "## Evidence Span Quality",
                  f"- Exact match rate: {span['exact_match_rate']:.4f}",
                  f"- Token F1 mean:    {span['token_f1_mean']:.4f}",
                  f"- Span in context:  {span['span_in_context_rate']:.4f}"]
    return lines


def write_metrics(tables: dict[str, DataFrame], path: str, run_name: str = "") -> None:
    """One JSON folder per metric family and the report as text, below ``path``."""
    spark = tables["accuracy"].sparkSession
    written = {}
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)
        # the report reads what was written instead of computing it again
        written[name] = spark.read.schema(table.schema).json(f"{path}/{name}")
    lines = report_lines(written, run_name)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/report")

"""Metric, alignment, claim-set and batch-summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.catalog import lists as ls
from claimlens.catalog import sql as q
from claimlens.catalog import views as v
from claimlens.catalog.decision_queries import DETECT_SQL, detections
from claimlens.catalog.registry import SQL, query
from claimlens.catalog.text_queries import span_found_sql, token_f1_sql
from claimlens.functions.claims import extract_claims, sentences
from claimlens.functions.labels import gold_accepts
from claimlens.operators import alignment as al
from claimlens.operators import metrics as m
from claimlens.plans.evaluate import aligned, evaluate, report_lines


def both(spark, d, texts=False):
    return aligned(v.gold_records(spark, d), v.pred_records(spark, d), texts)


@query("prediction_fields", q.with_views("select * from pred_fields"))
def _(spark, d):
    return m.prediction_fields(v.pred_records(spark, d))


@query("align_predictions", q.with_views("""select id, gold, pred, score, gold_span, pred_span,
    md5(context) as context_md5, parse_error, latency_ms from aligned"""))
def _(spark, d):
    rows = both(spark, d, True)
    return rows.select(
        "id", "gold", "pred", "score", "gold_span", "pred_span",
        F.md5("context").alias("context_md5"), "parse_error", "latency_ms",
    )


@query("missing_predictions",
       q.with_views("select id from gold_pred where id not in (select id from pred_rows)"))
def _(spark, d):
    return al.missing_predictions(v.gold_records(spark, d), v.pred_records(spark, d))


@query("extra_predictions", q.with_views(
    "select distinct id from pred_rows where id not in (select id from gold_pred)"))
def _(spark, d):
    return al.extra_predictions(v.gold_records(spark, d), v.pred_records(spark, d))


@query("accuracy", q.with_views("""select count(*) as n, count(*) filter (gold = pred) as n_correct,
    floor(count(*) filter (gold = pred)::double / count(*) * 1e4 + 0.5e0) / 1e4 as accuracy
    from aligned"""))
def _(spark, d):
    return m.accuracy(both(spark, d))


_ALL_LABELS = "(select unnest(" + q.array(fv.LABELS) + ") as label)"
_PRF = """
  select label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted,
         coalesce(hits, 0) as hits
  from (select gold as label, count(*) as support, count(*) filter (gold = pred) as hits
        from aligned group by 1) g
  full join (select pred as label, count(*) as predicted from aligned group by 1) p using (label)"""


@query(
    "per_class",
    q.with_views(
        f"""select l.label, {q.rnd(q.ratio('hits', 'predicted'), 4)} as precision,
        {q.rnd(q.ratio('hits', 'support'), 4)} as recall,
        {q.rnd(q.ratio('hits * 2', 'support + predicted'), 4)} as f1,
        coalesce(support, 0) as support from {_ALL_LABELS} l left join prf using (label)""",
        prf=_PRF),
)
def _(spark, d):
    return m.per_class(both(spark, d))


@query(
    "f1_averages",
    q.with_views(
        f"""select {q.rnd('avg(f)', 4)} as macro_f1,
        {q.rnd('sum(f * support) / sum(support)', 4)} as weighted_f1
        from (select *, {q.ratio('hits * 2', 'support + predicted')} as f from prf)""", prf=_PRF),
)
def _(spark, d):
    return m.f1_averages(both(spark, d))


@query(
    "confusion_matrix",
    q.with_views("select l.label as gold, "
                 + ", ".join(f"count(*) filter (pred = '{x}') as {x}" for x in sorted(fv.LABELS))
                 + f" from {_ALL_LABELS} l left join aligned a on a.gold = l.label group by 1"),
)
def _(spark, d):
    return m.confusion_matrix(both(spark, d))


_TRUTH = q.label_case("gold", "typical", "0.5e0")
_EDGES = "[" + ", ".join(f"{e!r}::double" for e in m.bin_edges(10)) + "]"
_BINNED = f"""
  select bin, count(*) as n, {q.mean('score')} as conf, {q.mean('truth')} as acc,
         sum(((score - truth) * (score - truth))::decimal(18,9))::double as sq
  from (select score, {_TRUTH} as truth, least(10, len(list_filter({_EDGES}, lambda e:
          e <= score))) as bin from aligned) group by 1"""


@query("calibration", q.with_views(
    f"""select {q.rnd('sum(abs(conf - acc) * n) / sum(n)', 4)} as ece,
    {q.rnd('max(abs(conf - acc))', 4)} as mce, {q.rnd('sum(sq) / sum(n)', 4)} as brier_score,
    10 as n_bins from binned""", binned=_BINNED))
def _(spark, d):
    return m.calibration(both(spark, d))


@query("reliability_bins", q.with_views(
    f"""select {q.rnd(f'({_EDGES})[bin]', 2)} as bin_lower,
    {q.rnd(f'({_EDGES})[bin + 1]', 2)} as bin_upper, {q.rnd('conf', 4)} as avg_confidence,
    {q.rnd('acc', 4)} as accuracy, n, {q.rnd('abs(conf - acc)', 4)} as calibration_error
    from binned""", binned=_BINNED))
def _(spark, d):
    return m.reliability_bins(both(spark, d))


@query("span_metrics", q.with_views(
    f"""select count(*) as n_evaluated, {q.rnd('avg(e::int)', 4)} as exact_match_rate,
    {q.rnd(q.mean('f'), 4)} as token_f1_mean, {q.rnd('stddev_pop(f)', 4)} as token_f1_std,
    {q.rnd('avg(c::int)', 4)} as span_in_context_rate
    from (select lower(g) = lower(p) as e, {token_f1_sql('p', 'g')} as f,
            {span_found_sql('p', 'context')} as c
          from (select {q.strip('gold_span')} as g, {q.strip('pred_span')} as p, context
                from aligned) where g <> '')"""))
def _(spark, d):
    return m.span_metrics(both(spark, d, True))


@query("json_validity", q.with_views(
    """select count(*) as n_total, count(*) filter (parse_error) as n_parse_errors,
    count(*) filter (not parse_error) as n_valid,
    floor(count(*) filter (not parse_error)::double / count(*) * 1e4 + 0.5e0) / 1e4
      as json_validity_rate from aligned"""))
def _(spark, d):
    return m.json_validity(both(spark, d))


@query("latency_stats", q.with_views(
    f"""select {q.rnd(q.mean('latency_ms'), 1)} as mean_ms,
    {q.rnd('quantile_cont(latency_ms, 0.5)', 1)} as median_ms,
    {q.rnd('quantile_cont(latency_ms, 0.95)', 1)} as p95_ms,
    {q.rnd('max(latency_ms)', 1)} as max_ms from aligned"""))
def _(spark, d):
    return m.latency_stats(both(spark, d))


@query("label_distributions", q.with_views(
    """select 'gold' as side, gold as label, count(*) as n from aligned group by 2
    union all select 'pred', pred, count(*) from aligned group by 2"""))
def _(spark, d):
    return m.label_distributions(both(spark, d))


@query("success_gates", q.with_views(
    f"""select name, value, threshold, case when name = 'ece' then value < threshold
        else value > threshold end as passed from (
      select 'json_validity' as name,
        {q.rnd('avg((not parse_error)::int)', 4)} as value, 0.95e0 as threshold from aligned
      union all select 'contradicted_recall',
        {q.rnd("avg((pred = 'contradicted')::int) filter (gold = 'contradicted')", 4)}, 0.6e0
        from aligned
      union all select 'ece', {q.rnd('sum(abs(conf - acc) * n) / sum(n)', 4)}, 0.15e0
        from binned)""", binned=_BINNED))
def _(spark, d):
    return m.success_gates(both(spark, d))


def _report_sql() -> str:
    """The report's lines, read from the SQL of the single tables."""
    tables = {"acc": "accuracy", "ave": "f1_averages", "cal": "calibration", "js": "json_validity",
              "lat": "latency_stats", "sp": "span_metrics", "pc": "per_class"}

    def num(table: str, field: str, digits: int = 4, where: str = "true") -> str:
        return f"(select printf('%.{digits}f', {field}) from {table} where {where})"

    def whole(table: str, field: str, where: str = "true") -> str:
        return f"(select {field}::varchar from {table} where {where})"

    def recall(label: str) -> str:
        return num("pc", "recall", where=f"label = '{label}'")

    def text(*parts: str) -> str:
        return " || ".join(p if p.startswith("(") else q.quote(p) for p in parts)

    lines = [
        text("# Evaluation Report: tables"), text(""), text("N examples: ", whole("acc", "n")), text(""),
        text("## Classification Metrics"), text("- Accuracy:    ", num("acc", "accuracy")),
        text("- Macro F1:    ", num("ave", "macro_f1"), "  (primary metric)"),
        text("- Weighted F1: ", num("ave", "weighted_f1")), text(""), text("### Key Recall Metrics"),
        text("- Contradicted recall:         ", recall("contradicted")),
        text("- Unsupported recall:          ", recall("unsupported")),
        text("- Insufficient context recall: ", recall("insufficient_context")), text(""),
        text("### Per-Class Metrics"), text("| Label | Precision | Recall | F1 | Support |"),
        text("|-------|-----------|--------|----|---------|"),
    ]
    for label in sorted(fv.LABELS):
        at = f"label = '{label}'"
        lines.append(text(f"| {label} | ", num("pc", "precision", where=at), " | ", num("pc", "recall", where=at), " | ",
                          num("pc", "f1", where=at), " | ", whole("pc", "support", at), " |"))
    lines += [
        text(""), text("## Calibration Metrics (MANDATORY)"),
        text("- ECE:         ", num("cal", "ece"), "  (target: < 0.15)"), text("- MCE:         ", num("cal", "mce")),
        text("- Brier Score: ", num("cal", "brier_score")), text(""), text("## JSON Validity"),
        text("- JSON validity rate: ", num("js", "json_validity_rate"), "  (target: > 0.95)"),
        text("- Parse errors: ", whole("js", "n_parse_errors")), text(""), text("## Latency"),
        text("- Mean: ", num("lat", "mean_ms", 1), " ms"), text("- P95:  ", num("lat", "p95_ms", 1), " ms"),
        text(""), text("## Evidence Span Quality"), text("- Exact match rate: ", num("sp", "exact_match_rate")),
        text("- Token F1 mean:    ", num("sp", "token_f1_mean")),
        text("- Span in context:  ", num("sp", "span_in_context_rate")),
    ]
    given = ", ".join(f"{k} as ({SQL[n]})" for k, n in tables.items())
    rows = ", ".join(f"({i}, {line})" for i, line in enumerate(lines))
    return f"with {given} select * from (values {rows}) r(line_no, line)"


@query("metrics_report", _report_sql())
def _(spark, d):
    tables = evaluate(v.gold_records(spark, d), v.pred_records(spark, d))
    lines = report_lines(tables, "tables")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


# --- claim sets -----------------------------------------------------------------------------------
_PLAIN = lambda x: f"list_distinct({q.words(f'lower({x})')})"
_SETS = f"""
  select qa_id, list_transform(g, lambda s: {_PLAIN('s')}) as gs,
         list_transform(e, lambda s: {_PLAIN('s')}) as es
  from (select qa_id, {q.sentences('answer')} as g, {q.extract_claims('answer')} as e
        from rag_qa)"""
def _hits(own: str, other: str) -> str:
    return f"""
  select qa_id, count(*) filter (best >= 0.5e0) as hits, count(*) as n from (
    select qa_id, k, coalesce(max({q.jaccard('a', 'b')}), 0) as best
    from (select qa_id, generate_subscripts({own}, 1) as k, unnest({own}) as a from sets)
    left join (select qa_id, unnest({other}) as b from sets) using (qa_id) group by 1, 2)
  group by 1"""


@query(
    "compare_claim_sets",
    q.with_views(
        f"""select qa_id, {q.rnd(q.ratio('eh', 'en'), 4)} as precision,
        {q.rnd(q.ratio('gh', 'gn'), 4)} as recall,
        {q.rnd(q.ratio(f"{q.ratio('eh', 'en')} * {q.ratio('gh', 'gn')} * 2",
                       f"{q.ratio('eh', 'en')} + {q.ratio('gh', 'gn')}"), 4)} as f1,
        gn as n_ground_truth, en as n_extracted, gh as n_matched
        from (select s.qa_id, coalesce(a.hits, 0) as gh, coalesce(a.n, 0) as gn,
                case when a.n > 0 then coalesce(b.hits, 0) else 0 end as eh,
                case when a.n > 0 then coalesce(b.n, 0) else 0 end as en
              from sets s left join gold_hits a using (qa_id) left join ex_hits b using (qa_id))""",
        sets=_SETS, gold_hits=_hits("gs", "es"), ex_hits=_hits("es", "gs")),
)
def _(spark, d):
    answer = F.col("answer")
    return al.compare_claim_sets(v.rag_qa(spark, d), "qa_id", sentences(answer),
                                 extract_claims(answer, **ls.CLAIM_LISTS))


# --- batch summaries and benchmarks ---------------------------------------------------------------
_GOLD_PART = """count(is_correct) as n_with_gold, count(*) filter (is_correct) as n_correct,
    case when count(is_correct) > 0 then floor(count(*) filter (is_correct)::double
      / count(is_correct) * 1e4 + 0.5e0) / 1e4 end as accuracy"""
_BATCH = f"""
  select batch, label, conf, sup, con,
    case when label = 'supported' and conf >= 0.75e0 then 'accept' else 'block_or_review' end
      as cls_decision,
    {q.nli_policy('sup', 'con', 'sup')} as nli_decision,
    case when doc_id % 3 <> 0 then {q.pick(fv.LABELS, 'doc_id * 3 % 5')} else '' end as gold
  from (select s.*, source as batch from doc_scores s join documents using (doc_id))"""


def batch_rows(spark, d):
    source = v.table(spark, d, "documents").select("doc_id", F.col("source").alias("batch"))
    i = F.col("doc_id")
    gold = F.when(i % 3 != 0, v.pick(fv.LABELS, i * 3 % 5)).otherwise("")
    return source.withColumns(v.score_columns(i)).withColumn("gold", gold)


@query("classifier_batch_summary", q.with_views(
    f"""select batch, count(*) as n_total, count(*) filter (cls_decision = 'accept') as n_accept,
    count(*) filter (cls_decision <> 'accept') as n_block,
    {', '.join(f"count(*) filter (label = '{x}') as n_{x}" for x in fv.LABELS)}, {_GOLD_PART}
    from (select *, case when gold <> '' then label = gold end as is_correct from batches)
    group by 1""", batches=_BATCH))
def _(spark, d):
    from claimlens.functions.scores import classifier_decision

    rows = batch_rows(spark, d).select(
        "batch", F.col("label").alias("predicted_label"),
        classifier_decision(F.col("label"), F.col("conf")).alias("decision"),
        F.when(F.col("gold") != "", F.col("label") == F.col("gold")).alias("is_correct"),
    )
    return m.classifier_batch_summary(rows, "batch")


def _nli_ok() -> str:
    arms = " ".join(f"when gold = '{k}' then {q.in_list('nli_decision', a)}"
                    for k, a in fv.GOLD_ACCEPTS.items())
    return f"case when gold <> '' then case {arms} else false end end"


@query("nli_batch_summary", q.with_views(
    f"""select batch, count(*) as n_total,
    {', '.join(f"count(*) filter (nli_decision = '{x}') as n_{x}" for x in
               ('accept', 'warn', 'revise', 'insufficient_context'))},
    {q.rnd(q.mean('sup'), 4)} as avg_support_score, {q.rnd(q.mean('con'), 4)}
      as avg_contradiction_score, {_GOLD_PART}
    from (select *, {_nli_ok()} as is_correct from batches) group by 1""", batches=_BATCH))
def _(spark, d):
    from claimlens.functions.scores import nli_policy

    decision = nli_policy(F.col("sup"), F.col("con"), F.col("sup"))
    rows = batch_rows(spark, d).withColumn("decision", decision)
    rows = rows.withColumn("is_correct", gold_accepts(F.col("gold"), F.col("decision"), False))
    return m.nli_batch_summary(rows, "batch")


@query("hybrid_batch_summary", q.with_views(
    f"""select event_id % 7 as batch, count(*) as n_total,
    {q.rnd(q.mean('hallucination_score'), 4)} as avg_hallucination_score,
    {q.rnd('max(hallucination_score)', 4)} as max_hallucination_score, {_GOLD_PART}
    from det group by 1""", det=DETECT_SQL))
def _(spark, d):
    rows = detections(spark, d).withColumn("batch", F.col("event_id") % 7)
    return m.hybrid_batch_summary(rows, "batch")


@query("decision_routing_dist", q.with_views(
    """select 'decision' as family, decision as value, count(*) as n from det group by 2
    union all select 'routing', routing, count(*) from det group by 2""", det=DETECT_SQL))
def _(spark, d):
    return m.decision_routing_dist(detections(spark, d))


@query("nli3_benchmark", q.with_views(
    f"""select {q.label_case('gold', 'nli3', 'gold')} as gold3,
    {q.label_case('pred', 'nli3', 'pred')} as pred3, count(*) as n from aligned
    where gold <> '' group by 1, 2"""))
def _(spark, d):
    return m.nli3_benchmark(both(spark, d))


@query("binary_benchmark", q.with_views(
    """select case when gold = 'supported' then 'supported' else 'unsupported' end as gold2,
    case when pred = 'supported' then 'supported' else 'unsupported' end as pred2, count(*) as n
    from aligned group by 1, 2"""))
def _(spark, d):
    return m.binary_benchmark(both(spark, d))

"""Sources, validation, splits, sampling and training-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.catalog import sql as q
from claimlens.catalog import views as v
from claimlens.catalog.registry import query
from claimlens.catalog.text_queries import _GOOD_PARAGRAPHS, _PARAGRAPHS, good_paragraphs
from claimlens.operators import alignment as al
from claimlens.operators import splits as sp
from claimlens.operators import training as tr
from claimlens.operators import validation as va
from claimlens.plans.dataset import build_dataset
from claimlens.session import cut_lineage, work_dir
from claimlens.sources import jsonl
from claimlens.sources.fingerprint import dataset_fingerprint


# --- sources ---------------------------------------------------------------------------------------
@query("jsonl_round_trip", q.with_views(
    "select id, label, split, hallucination_score, domain, claim_index, md5(context) as h, "
    "context_truncated from (select *, null::boolean as context_truncated from examples)"))
def _(spark, d):
    path = work_dir(spark, "examples")
    jsonl.write_jsonl(v.examples(spark, d).drop("line"), path)
    back = jsonl.read_jsonl(spark, path, jsonl.example_schema())
    return back.select("id", "label", "split", "hallucination_score", "domain", "claim_index",
                       F.md5("context").alias("h"), "context_truncated")


@query("jsonl_corrupt_lines",
       "select count(*) as n, count(*) filter (doc_id % 8 = 3) as n_corrupt from documents")
def _(spark, d):
    path = work_dir(spark, "broken")
    i = F.col("doc_id")
    record = F.to_json(F.struct(F.concat(F.lit("trrag_"), i.cast("string")).alias("id"),
                                F.col("text").alias("context")))
    cut = F.substring(record, F.lit(1), F.length(record) - 2)
    line = F.when(i % 8 == 3, cut).otherwise(record)
    blank = F.when(i % 5 == 0, F.lit("   "))
    rows = v.table(spark, d, "documents").select(
        F.explode(F.array_compact(F.array(line, blank))).alias("value")
    )
    rows.write.text(path)
    back = jsonl.read_jsonl(spark, path, jsonl.example_schema(), strict=False)
    return back.agg(F.count("*").alias("n"), F.count(jsonl.CORRUPT).alias("n_corrupt"))


@query("dataset_fingerprint", q.with_views(
    """select split, count(*) as n, sum(('0x' || substr(md5(concat_ws(chr(31), id, label, context,
    coalesce(domain, chr(0)))), 1, 15))::bigint::hugeint)::varchar as checksum
    from examples group by 1""".replace("chr(0)", "''")))
def _(spark, d):
    rows = v.examples(spark, d).withColumn("domain", F.coalesce("domain", F.lit("")))
    return dataset_fingerprint(rows, ["id", "label", "context", "domain"])


# --- validation -----------------------------------------------------------------------------------------
def _vocab_error(field: str, allowed) -> str:
    listing = "[" + ", ".join(f"'{x}'" for x in sorted(allowed)) + "]"
    return (f"case when {field} is not null and not {q.in_list(field, allowed)} then "
            f"{{'field': '{field}', 'error': 'Value error, Invalid {field} ''' || {field} || "
            f"{q.quote(chr(39) + '. Must be one of: ' + listing)}}} end")


def _err(field: str, cond: str, message: str) -> str:
    return f"case when {cond} then {{'field': '{field}', 'error': {message}}} end"


_FIELD_RULES = [
    *[_err(f, f"length({f}) < {n}", q.quote(f"String should have at least {n} "
                                            f"character{'s' if n > 1 else ''}"))
      for f, n in (("question", 5), ("context", 10), ("answer", 1), ("claim", 5),
                   ("explanation", 10))],
    _err("hallucination_score", "hallucination_score > 1",
         "'Input should be less than or equal to 1'"),
    _err("claim_count_in_answer", "claim_count_in_answer < 1",
         "'Input should be greater than or equal to 1'"),
    *[_vocab_error(f, a) for f, a in va.VOCABULARIES.items()],
    _err("id", "not starts_with(id, 'trrag_')",
         "'Value error, ID must start with ''trrag_'', got: ''' || id || ''''"),
]
_CROSS = f"""list_filter([
  case when label = 'supported' and error_type <> 'none' then
    'label=''supported'' requires error_type=''none'', got ''' || error_type || '''' end,
  case when label in ('supported', 'contradicted') and {q.strip('evidence_span')} = '' then
    'label=''' || label || ''' requires a non-empty evidence_span' end,
  case when claim_index >= claim_count_in_answer then 'claim_index (' || claim_index ||
    ') must be < claim_count_in_answer (' || claim_count_in_answer || ')' end],
  lambda x: x is not null)"""
_CHECKED = f"""
  select *, case when len(fe) = 0 and len(ce) > 0 then
      [{{'field': '', 'error': 'Value error, ' || array_to_string(ce, '; ')}}] else fe end as errs
  from (select *, list_filter([{', '.join(_FIELD_RULES)}], lambda x: x is not null) as fe,
          {_CROSS} as ce from examples)"""
_WARN = f"""case when len(errs) = 0 and not (hallucination_score between
    {q.label_case('label', 'score_lo')} and {q.label_case('label', 'score_hi')}) then
    'hallucination_score=' || hallucination_score || ' is outside the guideline range [' ||
    {q.label_case('label', 'score_lo')} || ', ' || {q.label_case('label', 'score_hi')} ||
    '] for label=''' || label || ''' (guideline only, not an error)' end"""


@query("field_errors", q.with_views(
    """select line, e.field, e.error from (select line, unnest(fe) as e from checked)""",
    checked=_CHECKED))
def _(spark, d):
    return va.explode_errors(va.field_errors(v.examples(spark, d)), "line")


@query("cross_field_errors", q.with_views(
    """select line, e.error from (select line, unnest(errs) as e from checked) where
    e.field = ''""", checked=_CHECKED))
def _(spark, d):
    rows = va.explode_errors(va.validate(v.examples(spark, d)), "line")
    return rows.where("field = ''").drop("field")


@query("score_range_warnings", q.with_views(
    f"""select line, id, {_WARN} as message from checked where {_WARN} is not null""",
    checked=_CHECKED))
def _(spark, d):
    rows = va.validate(v.examples(spark, d)).where(F.col("score_warning").isNotNull())
    return rows.select("line", "id", F.col("score_warning").alias("message"))


_DUPES = """select line, id from examples qualify row_number() over (partition by id
    order by line) > 1"""


@query("duplicate_ids", q.with_views(_DUPES))
def _(spark, d):
    return va.duplicate_ids(v.examples(spark, d)).select("line", "id")


@query("validation_errors", q.with_views(
    """select line, id, e.field, e.error from (select line, id, unnest(errs) as e from checked)
    union all select line, id, 'id', 'Duplicate ID: ''' || id || '''' from dupes""",
    checked=_CHECKED, dupes=_DUPES))
def _(spark, d):
    return va.validation_errors(v.examples(spark, d))


def broken_examples(spark, d) -> str:
    """Examples as JSON lines; every eighth is cut off, every fifth is followed by a blank line."""
    path = work_dir(spark, "broken-examples")
    i = F.col("line")
    record = F.to_json(F.struct(*[c for c in v.examples(spark, d).columns if c != "line"]))
    cut = F.substring(record, F.lit(1), F.length(record) - 2)
    line = F.when(i % 8 == 3, cut).otherwise(record)
    blank = F.when(i % 5 == 0, F.lit("   "))
    rows = v.examples(spark, d).select(F.explode(F.array_compact(F.array(line, blank))).alias("value"))
    rows.write.text(path)
    return path


def read_broken(spark, d):
    rows = jsonl.read_jsonl(spark, broken_examples(spark, d), jsonl.example_schema(), strict=False,
                            numbered=True)
    good, broken = jsonl.split_corrupt(rows)
    return good.fillna(jsonl.EXAMPLE_DEFAULTS), broken


_WHOLE = {"sound": "select * from checked where line % 8 <> 3",
          "again": "select id, count(*) - 1 as n from sound group by 1 having count(*) > 1"}


@query("validation_errors_from_file", q.with_views(
    """select field, error, count(*) as n from (
      select e.field, e.error from (select unnest(errs) as e from sound)
      union all select 'id', 'Duplicate ID: ''' || id || ''''
        from (select id, unnest(range(n)) from again)
      union all select 'JSON', 'Invalid JSON' from examples where line % 8 = 3) group by 1, 2""",
    checked=_CHECKED, **_WHOLE))
def _(spark, d):
    found = va.validation_errors(*read_broken(spark, d))
    # the message of a broken line quotes it
    error = F.when(F.col("field") == "JSON", F.lit("Invalid JSON")).otherwise(F.col("error"))
    return found.groupBy("field", error.alias("error")).agg(F.count("*").alias("n"))


@query("validation_summary_from_file", q.with_views(
    """select (select count(distinct id) from sound) as n_total,
      (select count(*) from sound where len(errs) = 0) as n_valid,
      (select sum(len(errs)) from sound) + (select coalesce(sum(n), 0) from again)
        + (select count(*) from examples where line % 8 = 3) as n_errors""",
    checked=_CHECKED, **_WHOLE))
def _(spark, d):
    return va.validation_summary(*read_broken(spark, d)).select("n_total", "n_valid", "n_errors")


def _leaks(source: str) -> str:
    pairs = {"train_test_leakage": ("train", "test"), "train_val_leakage": ("train", "validation"),
             "val_test_leakage": ("validation", "test")}
    return " union all ".join(
        f"select '{n}' as type, count(*) as n_overlapping_contexts from (select context from "
        f"{source} where split = '{a}' intersect select context from {source} where split = '{b}')"
        for n, (a, b) in pairs.items())


@query("validation_summary", q.with_views(
    f"""select (select count(distinct id) from examples) as n_total,
    (select count(*) from valid) as n_valid,
    (select sum(len(errs)) from checked) + (select count(*) from dupes) as n_errors,
    (select count({_WARN}) from checked) as n_score_warnings,
    (select n_overlapping_contexts from ({_leaks('valid')}) where type = 'train_test_leakage')
      as n_train_test_leakage,
    (select n_overlapping_contexts from ({_leaks('valid')}) where type = 'train_val_leakage')
      as n_train_val_leakage""",
    checked=_CHECKED, dupes=_DUPES, valid="select * from checked where len(errs) = 0"))
def _(spark, d):
    return va.validation_summary(v.examples(spark, d))


@query("load_examples", q.with_views(
    """select split, count(*) as n, count(*) filter (len(errs) = 0) as n_valid
    from checked group by 1""", checked=_CHECKED))
def _(spark, d):
    path = work_dir(spark, "load")
    jsonl.write_jsonl(v.examples(spark, d).drop("line"), path)
    good, bad = jsonl.load_examples(spark, path, strict=False)
    marked = good.select("split", F.lit(1).alias("ok")).unionByName(
        bad.select("split", F.lit(0).alias("ok"))
    )
    return marked.groupBy("split").agg(F.count("*").alias("n"), F.sum("ok").alias("n_valid"))


@query("distributions", q.with_views(
    f"""select family, value, sum(n)::bigint as n, case when family = 'label' then
      floor(sum(n) * 100e0 / (select count(*) from valid) * 10e0 + 0.5e0) / 10e0 end as pct from (
      {' union all '.join(f"select '{f}' as family, {f} as value, count(*) as n from valid "
                          f"where {f} is not null group by 2"
                          for f in ('label', 'split', 'domain', 'source_type'))}
      union all select 'label', unnest({q.array(fv.LABELS)}), 0) group by 1, 2""",
    checked=_CHECKED, valid="select * from checked where len(errs) = 0"))
def _(spark, d):
    return va.distributions(v.examples(spark, d))


@query("leakage", q.with_views(_leaks("examples")))
def _(spark, d):
    return al.leakage(v.examples(spark, d))


# --- splits and samples ---------------------------------------------------------------------------------
_CTX_KEYS = f"""
  select context, k, row_number() over (order by k) as r, count(*) over () as n
  from (select distinct context, {q.hash_key('42', 'md5(context)')} as k from examples)"""
_GROUPED = """
  select line, id, label, e.context, case when r <= greatest(1, floor(n * 0.17e0)) then 'test'
    when r <= greatest(1, floor(n * 0.17e0)) + greatest(1, floor(n * 0.1e0)) then 'validation'
    else 'train' end as split
  from examples e join ctx_keys using (context)"""


def grouped(spark, d):
    return sp.context_grouped_split(v.examples(spark, d))


@query("context_grouped_split", q.with_views("select line, split from grp",
                                             ctx_keys=_CTX_KEYS, grp=_GROUPED))
def _(spark, d):
    return grouped(spark, d).select("line", "split")


@query("leakage_after_split", q.with_views(_leaks("grp"), ctx_keys=_CTX_KEYS, grp=_GROUPED))
def _(spark, d):
    return al.leakage(grouped(spark, d))


@query("split_stats", q.with_views(
    "select split, label, count(*) as n from grp group by grouping sets ((split, label), (split))",
    ctx_keys=_CTX_KEYS, grp=_GROUPED))
def _(spark, d):
    return sp.split_stats(grouped(spark, d))


_SOUND = """select * from checked where len(errs) = 0"""
_BUILT_KEYS = f"""
  select context, k, row_number() over (order by k) as r, count(*) over () as n
  from (select distinct context, {q.hash_key('42', 'md5(context)')} as k from sound)"""
_BUILT = _GROUPED.replace("examples e join ctx_keys", "sound e join built_keys")


@query("build_dataset", q.with_views(
    """select split, count(*) as n, sum(('0x' || substr(md5(concat_ws(chr(31), id, label, context)),
    1, 15))::bigint::hugeint)::varchar as checksum, 0 as n_shared_contexts from built group by 1""",
    checked=_CHECKED, sound=_SOUND, built_keys=_BUILT_KEYS, built=_BUILT))
def _(spark, d):
    source, target = work_dir(spark, "source"), work_dir(spark, "built")
    jsonl.write_jsonl(v.examples(spark, d).drop("line"), source)
    return build_dataset(spark, source, target, strict=False)


def _ranked(key: str, source: str, where: str = "true") -> str:
    return f"""select *, row_number() over (order by {key}) as r, count(*) over () as n
      from {source} where {where}"""


@query("row_split",
       f"""select doc_id, case when r <= ceil(n * 0.1e0) then 'validation' else 'train' end
       as split from ({_ranked(q.hash_key('42', 'doc_id'), 'documents')})""")
def _(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id")
    return sp.row_split(rows, "doc_id")


_NLI_ROWS = f"""select doc_id, {q.pick(['supported', 'supported', 'supported', 'neutral',
    'contradicted', 'other'], 'doc_id % 6')} as label from documents"""


def nli_rows(spark, d):
    label = v.pick(["supported", "supported", "supported", "neutral", "contradicted", "other"],
                   F.col("doc_id") % 6)
    return v.table(spark, d, "documents").select("doc_id", label.alias("label"))


@query("balance_cap", f"""select doc_id, label from ({_NLI_ROWS}) where label in ('neutral',
    'contradicted') union all select doc_id, label from ({_ranked(q.hash_key('42', 'doc_id'),
    f'({_NLI_ROWS})', "label = 'supported'")}) where r <= 150""")
def _(spark, d):
    return sp.balance_cap(nli_rows(spark, d), 150, id_col="doc_id")


@query("sample_n",
       f"select doc_id, lang from ({_ranked(q.hash_key('42', 'doc_id'), 'documents')}) where r <= 200")
def _(spark, d):
    return sp.sample_n(v.table(spark, d, "documents").select("doc_id", "lang"), 200,
                       id_col="doc_id")


@query("shuffle_within_split", q.with_views(
    f"""select line, split, row_number() over (partition by split order by
    {q.hash_key('42', 'split', 'line')}) - 1 as position from examples"""))
def _(spark, d):
    rows = v.examples(spark, d).select("line", "split")
    return sp.shuffle_within_split(rows, id_col="line")


def _pick_label_sql(u: str) -> str:
    edge, arms = 0.0, []
    for label, weight in fv.LABEL_WEIGHTS[:-1]:
        edge = round(edge + weight, 10)
        arms.append(f"when {u} < {edge!r}::double then '{label}'")
    return f"case {' '.join(arms)} else '{fv.LABEL_WEIGHTS[-1][0]}' end"


_PLAN = f"""with recursive paras as ({_PARAGRAPHS}), good as (
    select doc_id || '-' || pos as paragraph_id from ({_GOOD_PARAGRAPHS})),
  ranked as (select paragraph_id, row_number() over (order by {q.hash_key('42', 'paragraph_id')})
      - 1 as slot, count(*) over () as total from good),
  plan as (select paragraph_id, slot, unnest(range(slot, total * 2 + total // 2, total)) as plan_id
           from ranked),
  drawn as (select *, {_pick_label_sql(q.hash_unit("'42|label|' || plan_id"))} as target_label,
      1 + floor({q.hash_unit("'42|error|' || plan_id")} * 3)::int as e from plan)
  select plan_id, paragraph_id, target_label, case target_label
      {' '.join(f"when '{k}' then ({q.array(x)})[e]" for k, x in fv.ERROR_CHOICES.items())}
      else 'none' end as error_type,
    case target_label {' '.join(f"when '{k}' then {q.quote(x)}" for k, x in fv.ERROR_HINTS.items())}
      end as error_hint from drawn"""


@query("generation_plan", _PLAN)
def _(spark, d):
    paragraphs = good_paragraphs(spark, d).select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias(
            "paragraph_id"
        )
    )
    paragraphs = cut_lineage(paragraphs, "paragraphs")
    goal = paragraphs.agg(F.expr("count(*) * 2 + count(*) div 2").alias("n")).scalar()
    return sp.generation_plan(paragraphs, goal).select(
        "plan_id", "paragraph_id", "target_label", "error_type", "error_hint"
    )


# --- training rows ------------------------------------------------------------------------------------------
_PREMISE = f"""case when {q.strip('question')} <> '' then 'Soru: ' || {q.strip('question')} || chr(10)
    || 'Bağlam: ' || {q.strip('context')} else {q.strip('context')} end"""


@query("nli_pairs", q.with_views(
    f"""select id, md5({_PREMISE}) as premise, {q.strip('claim')} as hypothesis,
    case label when 'supported' then 0 when 'contradicted' then 2 when 'maybe' then null else 1 end
      as label from (select * replace (case when line % 4 = 0 then ' ' else question end
      as question) from examples)"""))
def _(spark, d):
    question = F.when(F.col("line") % 4 == 0, F.lit(" ")).otherwise(F.col("question"))
    pairs = tr.nli_pairs(v.examples(spark, d).withColumn("question", question))
    return pairs.withColumn("premise", F.md5("premise"))


@query("classifier_text", q.with_views(
    """select line, md5('Soru: ' || question || chr(10) || chr(10) || 'Baglam:' || chr(10) ||
    context || chr(10) || chr(10) || 'Cevap:' || chr(10) || answer || chr(10) || chr(10) ||
    'Iddia:' || chr(10) || case when line % 3 = 0 then answer else claim end) as h from examples"""))
def _(spark, d):
    claim = F.when(F.col("line") % 3 == 0, F.lit("")).otherwise(F.col("claim"))
    text = tr.classifier_text(F.col("question"), F.col("context"), F.col("answer"), claim)
    return v.examples(spark, d).select("line", F.md5(text).alias("h"))


SYSTEM_PROMPT = "You verify claims."
USER_TEMPLATE = "Q: {question}\nC: {context}\nA: {answer}\nClaim: {claim}"


@query("chat_rows", q.with_views(
    f"""select id, label, split, case when prompt_version <> '' then prompt_version else 'v1.0' end
      as prompt_version, '{SYSTEM_PROMPT}' as system_text,
    md5('Q: ' || question || chr(10) || 'C: ' || context || chr(10) || 'A: ' || answer || chr(10)
      || 'Claim: ' || claim) as user_md5,
    '{{"label": ' || to_json(label) || ', "hallucination_score": ' || hallucination_score ||
      ', "error_type": ' || to_json(error_type) || ', "evidence_span": ' ||
      to_json(evidence_span) || ', "explanation": ' || to_json(explanation) || ', "decision": ' ||
      to_json(decision) || '}}' as assistant_text from examples"""))
def _(spark, d):
    rows = tr.chat_rows(v.examples(spark, d), SYSTEM_PROMPT, USER_TEMPLATE)
    m = F.col("messages")
    return rows.select(
        "id", "label", "split", "prompt_version", m[0]["content"].alias("system_text"),
        F.md5(m[1]["content"]).alias("user_md5"), m[2]["content"].alias("assistant_text"),
    )


@query("skip_ratio", q.with_views(
    """select count(*) as total_seen, count(*) filter (len(errs) > 0) as n_skipped,
    count(*) filter (len(errs) > 0)::double / count(*) as skip_ratio from checked""",
    checked=_CHECKED))
def _(spark, d):
    return tr.skip_ratio(va.validate(v.examples(spark, d)))


@query("skip_guard", q.with_views("select line from checked where len(errs) = 0",
                                  checked=_CHECKED))
def _(spark, d):
    checked = va.validate(v.examples(spark, d))
    return tr.skip_guard(checked, max_skip_ratio=0.9).select("line")


_LEN = f"floor({q.n_words('text')} * 1.4e0)::int"


@query("token_length_stats",
       f"""select count(*) as n, {q.rnd('avg(t)', 6)} as mean, {q.rnd('stddev_pop(t)', 6)} as std,
       min(t) as min, max(t) as max, {', '.join(
           f"trunc(quantile_cont(t, {p / 100}))::int as p{p}" for p in (50, 75, 90, 95, 99, 100))}
       from (select {_LEN} as t from documents)""")
def _(spark, d):
    from claimlens.functions.numbers import round_to

    stats = tr.token_length_stats(v.table(spark, d, "documents"), F.col("text"))
    return stats.withColumns(
        {"mean": round_to(F.col("mean"), 6), "std": round_to(F.col("std"), 6)}
    )


@query("training_projection", q.with_views(
    "select * replace (md5(context) as context, md5(answer) as answer) from (select "
    + ", ".join(tr.TRAINING_COLUMNS) + " from examples)"))
def _(spark, d):
    rows = tr.training_projection(v.examples(spark, d))
    return rows.withColumns({"context": F.md5("context"), "answer": F.md5("answer")})

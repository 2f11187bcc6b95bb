"""Label mapping, scoring, decision, output-parsing and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.catalog import lists as ls
from claimlens.catalog import sql as q
from claimlens.catalog import views as v
from claimlens.catalog.registry import query
from claimlens.functions import answers as an
from claimlens.functions import fusion as fu
from claimlens.functions import labels as lb
from claimlens.functions import outputs as op
from claimlens.functions import scores as sc
from claimlens.functions.claims import sentence_count
from claimlens.functions.numbers import round_to
from claimlens.operators import decisions, guards
from claimlens.operators.alignment import enrich_with_label_dim
from claimlens.operators.retrieval import passthrough_evidence
from claimlens.operators.scorers import (
    LexicalScorer, cascade_verdict, cascade_with_scorer, with_scorer,
    with_tokenizer,
)
from claimlens.plans.detect import detect, detect_requests
from claimlens.plans.verify import verify_answers, verify_outputs

ODD_LABELS = [*fv.LABELS, "odd"]


def odd_labels(spark, d):
    """Every document with a label, one in six outside the vocabulary."""
    i = F.col("doc_id")
    return v.table(spark, d, "documents").select(
        "doc_id", v.pick(ODD_LABELS, i % 6).alias("label"),
        (i * 17 % 101 / F.lit(100e0)).alias("score"),
        v.pick([*fv.DECISIONS], i % 7 % 6).alias("decision"),
    )


_ODD = f"""select doc_id, {q.pick(ODD_LABELS, 'doc_id % 6')} as label,
  (doc_id * 17 % 101) / 100e0 as score, {q.pick(fv.DECISIONS, 'doc_id % 7 % 6')} as decision
  from documents"""


# --- labels -----------------------------------------------------------------------------------
@query(
    "label_dim",
    "select l.*, n from (values "
    + ", ".join(
        "(" + ", ".join(q.quote(x) if isinstance(x, str) else f"{x}e0" for x in r) + ")"
        for r in fv.LABEL_ROWS
    )
    + f""") l({', '.join(f'"{x}"' for x in fv.LABEL_FIELDS)}) join (select label, count(*) as n from ({_ODD})
    group by 1) c on l.label = c.label""",
)
def _(spark, d):
    counts = odd_labels(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return lb.label_dim(spark).join(counts, "label")


@query(
    "enrich_with_label_dim",
    f"""select doc_id, label, score, decision,
        {', '.join(f"{q.label_case('label', f, x)} as {f}" for f, x in (
            ('score_lo', 'null'), ('score_hi', 'null'), ('typical', 'null'),
            ('default_decision', "'warn'"), ('nli3', "'neutral'"), ('binary', 'null'),
            ('risk', "'unsafe'"), ('danger_weight', '0.5e0')))} from ({_ODD})""",
)
def _(spark, d):
    return enrich_with_label_dim(odd_labels(spark, d))


@query(
    "label_mappings",
    f"""select doc_id, {q.label_case('label', 'nli3', "'neutral'")} as nli3,
        case when label = 'supported' then 'supported' else 'unsupported' end as "binary",
        {q.label_case('label', 'risk', "'unsafe'")} as risk,
        {q.label_case('label', 'default_decision', "'warn'")} as default_decision,
        label in ('contradicted', 'unsupported') as hallucinated from ({_ODD})""",
)
def _(spark, d):
    c = F.col("label")
    return odd_labels(spark, d).select(
        "doc_id", lb.to_nli3(c).alias("nli3"), lb.to_binary(c).alias("binary"),
        lb.risk(c).alias("risk"), lb.default_decision(c).alias("default_decision"),
        lb.is_hallucinated(c).alias("hallucinated"),
    )


def _accept_sql(gold: str, decision: str, unknown: str) -> str:
    g = f"lower(trim({gold}))"
    arms = " ".join(
        f"when {g} = {q.quote(k)} then {q.in_list(decision, a)}" for k, a in fv.GOLD_ACCEPTS.items()
    )
    return f"(case when length({gold}) > 0 then case {arms} else {unknown} end end)"


@query(
    "gold_accepts",
    f"""select doc_id, {_accept_sql('gold', 'decision', 'null')} as hybrid,
        {_accept_sql('gold', 'decision', 'false')} as nli
        from (select doc_id, decision, case when doc_id % 4 = 0 then ''
                when doc_id % 4 = 1 then upper(label) || ' ' else label end as gold
              from ({_ODD}))""",
)
def _(spark, d):
    i = F.col("doc_id")
    gold = F.when(i % 4 == 0, F.lit("")).when(
        i % 4 == 1, F.concat(F.upper("label"), F.lit(" "))
    ).otherwise(F.col("label"))
    return odd_labels(spark, d).select(
        "doc_id", lb.gold_accepts(gold, F.col("decision")).alias("hybrid"),
        lb.gold_accepts(gold, F.col("decision"), False).alias("nli"),
    )


@query(
    "clamp_score",
    f"""select doc_id, {q.rnd(f"greatest({q.label_case('label', 'score_lo', '0e0')}, least("
        f"{q.label_case('label', 'score_hi', '1e0')}, score))", 4)} as score from ({_ODD})""",
)
def _(spark, d):
    return odd_labels(spark, d).select(
        "doc_id", lb.clamp_score(F.col("label"), F.col("score")).alias("score")
    )


# --- scores -------------------------------------------------------------------------------------
def _softmax_sql(z: str) -> tuple[str, str]:
    """(clean-up of logits, probabilities) as list expressions."""
    clean = (f"list_transform({z}, lambda x: case when isnan(x) then 0e0 when x = 'inf'::double "
             f"then 10e0 when x = '-inf'::double then -10e0 else x end)")
    return clean, "list_transform(w, lambda x: x / list_sum(w))"


def _probs(col: str) -> str:
    clean, probs = _softmax_sql(col)
    return f"""select doc_id, {probs} as p from (select doc_id,
      list_transform(z, lambda x: exp(x - list_max(z))) as w
      from (select doc_id, {clean} as z from logits))"""


@query(
    "nli_scores",
    q.with_views(f"""select doc_id, {q.rnd('p[1]', 6)} as support,
      {q.rnd('p[3]', 6)} as contradiction,
      {q.rnd('greatest(1e0 - p[1] - p[3], 0e0)', 6)} as neutral from ({_probs('nli')})"""),
)
def _(spark, d):
    return v.logits(spark, d).select("doc_id", sc.nli_scores(F.col("nli")).alias("s")).select(
        "doc_id", "s.*"
    )


@query(
    "class_probs",
    q.with_views(f"""select doc_id, ({q.array(fv.LABELS)})[list_position(p, list_max(p))]
        as predicted_label, {q.rnd('list_max(p)', 6)} as confidence,
        {', '.join(f"{q.rnd(f'p[{i + 1}]', 6)} as p_{x}" for i, x in enumerate(fv.LABELS))}
        from ({_probs('cls')})"""),
)
def _(spark, d):
    rows = v.logits(spark, d).select("doc_id", sc.class_probs(F.col("cls")).alias("s"))
    return rows.select(
        "doc_id", "s.predicted_label", "s.confidence",
        *[F.col("s.probs")[x].alias(f"p_{x}") for x in fv.LABELS],
    )


@query(
    "nli_policy",
    q.with_views(f"""select doc_id, {q.nli_policy('sup', 'con', 'kw')} as decision
        from (select doc_id, sup, con * 0.4e0 as con, (doc_id * 7 % 11) / 100e0 as kw
              from doc_scores)"""),
)
def _(spark, d):
    kw = F.col("doc_id") * 7 % 11 / F.lit(100e0)
    return v.doc_scores(spark, d).select(
        "doc_id", sc.nli_policy(F.col("sup"), F.col("con") * 0.4, kw).alias("decision")
    )


@query(
    "classifier_decision",
    q.with_views("""select doc_id, case when label = 'supported' and conf >= 0.75e0 then 'accept'
        else 'block_or_review' end as decision from doc_scores"""),
)
def _(spark, d):
    return v.doc_scores(spark, d).select(
        "doc_id", sc.classifier_decision(F.col("label"), F.col("conf")).alias("decision")
    )


_CLS_DANGER = f"{q.label_case('label', 'danger_weight', '0.5e0')} * conf"
_NLI_DANGER = "(con * 0.75e0 + (1e0 - sup) * 0.25e0)"


@query(
    "danger_scores",
    q.with_views(f"""select doc_id, {q.rnd(_CLS_DANGER, 6)} as classifier_danger,
        {q.rnd(_NLI_DANGER, 6)} as nli_danger from doc_scores"""),
)
def _(spark, d):
    return v.doc_scores(spark, d).select(
        "doc_id",
        round_to(sc.classifier_danger(F.col("label"), F.col("conf")), 6).alias(
            "classifier_danger"
        ),
        round_to(sc.nli_danger(F.col("sup"), F.col("con")), 6).alias("nli_danger"),
    )


@query(
    "route",
    f"""select doc_id, case when mode = 'auto' then 'ensemble' else mode end as executed
        from (select doc_id, (['auto', 'auto', 'bert', 'nli', 'ensemble'])[1 + doc_id % 5] as mode
              from documents)""",
)
def _(spark, d):
    mode = v.pick(["auto", "auto", "bert", "nli", "ensemble"], F.col("doc_id") % 5)
    return v.table(spark, d, "documents").select(
        "doc_id", fu.route(mode).alias("executed"),
    )


def _phrase_sql(x: str, phrases) -> str:
    arms = " ".join(f"when contains(lower({x}), {q.quote(p)}) then {q.quote(p)}" for p in phrases)
    return f"(case {arms} end)"


@query(
    "no_info_rule",
    f"""select doc_id, phrase, case when phrase is not null then 'insufficient_context' end
          as decision from (select doc_id, {_phrase_sql('text', ls.PHRASES)} as phrase
          from documents)""",
)
def _(spark, d):
    phrase = fu.no_info_phrase(F.col("text"), ls.PHRASES)
    rows = v.table(spark, d, "documents").select("doc_id", phrase.alias("phrase"))
    return rows.withColumn(
        "decision", F.when(F.col("phrase").isNotNull(), F.lit("insufficient_context"))
    )


_N_SENTENCES = f"len({q.sentences('answer')})"


def _fuse_sql(field: str) -> str:
    """One field of the fusion result, as CASE over the ordered rules."""
    partial, several = "label = 'partially_supported'", "n > 1"
    contra, unsupp = "coalesce(any_contra, false)", "coalesce(any_unsupp, true)"
    conflict = "label = 'contradicted' and sup >= 0.8e0"
    s, c, f = q.two("sup"), q.two("con"), q.two("conf")
    rules = [
        ("con >= 0.8e0", "revise", "nli_veto", "con", f"'Güçlü NLI çelişkisi (con=' || {c} || ')'"),
        ("sup < 0.8e0 and label = 'supported'", "warn", "bert_supported_veto", "conf",
         f"'BERT supported verdi ama NLI desteği yetersiz (sup=' || {s} || ')'"),
        (f"{partial} and {several} and {contra}", "revise", "claim_level_nli", "conf",
         "'BERT partial dedi; iddia seviyesinde çelişki bulundu.'"),
        (f"{partial} and {several} and {unsupp}", "warn", "claim_level_nli", "conf",
         "'BERT partial dedi; iddia seviyesinde yetersiz destek bulundu.'"),
        (f"{partial} and {several}", "accept", "claim_level_nli", "conf",
         "'BERT partial dedi; tüm iddialar başarıyla desteklendi.'"),
        (partial, "warn", "bert_partial_fallback", "conf",
         "'BERT kısmi destek dedi (tek cümle).'"),
        (f"{conflict} and {several} and {contra}", "revise", "conflict_claim_level_nli", "conf",
         "'BERT çelişki bildirdi; iddia seviyesinde çelişen alt cümle doğrulandı.'"),
        (conflict, "warn", "conflict_safe_warn", "greatest(conf, sup)",
         f"'Uyuşmazlık: BERT çelişki (' || {f} || ') derken NLI destek (' || {s} || "
         f"') bildirdi. Güvenli karar: WARN'"),
        ("sup >= 0.85e0 and con < 0.1e0", "accept", "nli_strong_support", "sup",
         f"'Güçlü NLI desteği (sup=' || {s} || ', con=' || {c} || ')'"),
        ("true", "warn", "fallback_warn", "greatest(sup, con)",
         f"'Düşük/belirsiz destek: NLI sup=' || {s} || ', con=' || {c}"),
    ]
    at = {"decision": 1, "source": 2, "confidence": 3, "reason": 4}[field]
    lit = field in ("decision", "source")
    arms = " ".join(f"when {r[0]} then {q.quote(r[at]) if lit else r[at]}" for r in rules)
    return f"(case {arms} end)"


_ROLLUP = """
  select qa_id, bool_or(c) as any_contra, bool_or(not c and weak) as any_unsupp from (
    select qa_id, decision = 'revise' or con >= 0.3e0 as c,
           decision in ('warn', 'insufficient_context') or sup < 0.8e0 as weak
    from claim_scores) group by 1"""
_FUSE_IN = f"""
  select r.qa_id, s.sup, s.con, s.label, s.conf, {_N_SENTENCES} as n, u.any_contra, u.any_unsupp
  from rag_qa r join scores s using (qa_id) left join rollup u using (qa_id)"""
_FUSED = ("select qa_id, " + ", ".join(
    f"{_fuse_sql(f)} as {f}" for f in ("decision", "source", "confidence", "reason"))
    + f" from ({_FUSE_IN})")


def fuse_inputs(spark, d):
    qa = v.rag_qa(spark, d).select("qa_id", sentence_count(F.col("answer")).alias("n"))
    rolled = decisions.claim_rollup(v.claim_scores(spark, d), "qa_id")
    return qa.withColumns(v.score_columns(F.col("qa_id"))).join(rolled, "qa_id", "left")


def _fuse_col():
    return fu.fuse(
        F.col("label"), F.col("conf"), F.col("sup"), F.col("con"), F.col("n"),
        F.col("any_contra"), F.col("any_unsupp"),
    )


@query("claim_level_rollup", q.with_views(f"select * from ({_ROLLUP})"))
def _(spark, d):
    return decisions.claim_rollup(v.claim_scores(spark, d), "qa_id")


@query("fuse", q.with_views(_FUSED, rollup=_ROLLUP))
def _(spark, d):
    return fuse_inputs(spark, d).select("qa_id", _fuse_col().alias("f")).select("qa_id", "f.*")


@query(
    "blended_score",
    q.with_views(f"""select qa_id, decision, {q.rnd('''case when decision = 'accept' then
          least(raw, 0.15e0) when decision = 'revise' then greatest(raw, 0.85e0)
          else raw end''', 4)} as hallucination_score
        from (select qa_id, {_fuse_sql('decision')} as decision,
                ({_CLS_DANGER}) * 0.15e0 + {_NLI_DANGER} * 0.85e0 as raw from ({_FUSE_IN}))""",
                 rollup=_ROLLUP),
)
def _(spark, d):
    rows = fuse_inputs(spark, d).withColumn("decision", _fuse_col()["decision"])
    score = sc.blended_score(
        F.col("decision"), F.col("label"), F.col("conf"), F.col("sup"), F.col("con")
    )
    return rows.select("qa_id", "decision", round_to(score, 4).alias("hallucination_score"))


def _detect_sql() -> str:
    """The complete request -> decision rules over event_detections."""
    has_c = "(label is not null and rt <> 'nli')"
    has_n = "(sup is not null and rt <> 'bert')"
    mapped = q.label_case("label", "default_decision", "'warn'")
    arms = [
        ("phrase is not null", "'insufficient_context'", "'keyword_rule'", "0.95e0", "0.2e0",
         "'Cevap ''bilgi yok'' ifadesi iceriyor: ''' || phrase || ''''"),
        (f"rt = 'bert' and {has_c}", mapped, "'bert'", "conf", _CLS_DANGER,
         f"'BERT: ' || label || ' (' || {q.two('conf')} || ')'"),
        (f"rt = 'nli' and {has_n}", "nli_decision", "'nli'", "greatest(sup, con)", _NLI_DANGER,
         f"'NLI: sup=' || {q.two('sup')} || ', con=' || {q.two('con')}"),
        (f"{has_c} and {has_n}", "f_decision", "f_source", "f_confidence",
         f"""case when f_decision = 'accept' then least({_CLS_DANGER} * 0.15e0 + {_NLI_DANGER}
             * 0.85e0, 0.15e0) when f_decision = 'revise' then greatest({_CLS_DANGER} * 0.15e0 +
             {_NLI_DANGER} * 0.85e0, 0.85e0) else {_CLS_DANGER} * 0.15e0 + {_NLI_DANGER} * 0.85e0
             end""", "f_reason"),
        (has_c, mapped, "'bert_fallback'", "conf", _CLS_DANGER,
         "'NLI hatası, BERT fallback: ' || label"),
        (has_n, "nli_decision", "'nli_fallback'", "greatest(sup, con)", _NLI_DANGER,
         "'BERT hatası, NLI fallback'"),
        ("true", "'warn'", "'error'", "0e0", "0.5e0", "'Her iki model de başarısız'"),
    ]

    def pickcol(at: int) -> str:
        return "(case " + " ".join(f"when {a[0]} then {a[at]}" for a in arms) + " end)"

    fused = ", ".join(
        f"{_fuse_sql(f)} as f_{f}" for f in ("decision", "source", "confidence", "reason")
    )
    return f"""
  select event_id, decision, source, {q.rnd('confidence', 4)} as confidence,
         {q.rnd('score', 4)} as hallucination_score, explanation,
         case when source = 'keyword_rule' then 'keyword_rule' else rt end as routing,
         case when source = 'keyword_rule' then
           case when length(gold_label) > 0 then gold_label = 'insufficient_context' end
           else {_accept_sql('gold_label', 'decision', 'null')} end as is_correct,
         context_words
  from (select *, {pickcol(1)} as decision, {pickcol(2)} as source, {pickcol(3)} as confidence,
          {pickcol(4)} as score, {pickcol(5)} as explanation
        from (select *, case when mode = 'auto' then 'ensemble' else mode end as rt,
                {_phrase_sql('answer', fv.NO_INFO_PHRASES)} as phrase, {fused},
                {q.n_words('context')} as context_words
              from (select *, {_N_SENTENCES} as n from event_detections)))"""


DETECT_SQL = _detect_sql()
DETECT_COLUMNS = ("event_id", "decision", "source", "confidence", "hallucination_score",
                  "explanation", "routing", "is_correct", "context_words")


def detections(spark, d):
    return detect(v.event_detections(v.table(spark, d, "events")))


@query("detect", q.with_views(DETECT_SQL))
def _(spark, d):
    return detections(spark, d).select(*DETECT_COLUMNS)


_ASKED = f"""
  select qa_id as event_id, case when qa_id % 5 = 0 then substr(context, 1, 4) else context end as context,
    case when qa_id % 3 = 0 then substr(question, 1, 2) else question end as question,
    case when qa_id % 7 = 0 then '' else answer end as answer,
    case when qa_id % 2 = 0 then '' else split_part(answer, '.', 1) end as claim,
    case when qa_id % 4 <> 0 then {q.pick(fv.LABELS, 'qa_id % 5')} else '' end as gold_label,
    (['auto', 'auto', 'bert', 'nli'])[1 + qa_id % 4] as mode from rag_qa"""
_UNITS = f"""
  select event_id, 0 as k, case when length(claim) > 0 then claim else answer end as unit from asked
  union all select event_id, generate_subscripts(ss, 1), unnest(ss)
    from (select event_id, {q.sentences('answer')} as ss from asked)"""


def _raw_detections() -> str:
    tokens = lambda x: q.tokens(x, 4, ls.STOP)
    scored = f"""select *, {q.rnd('sup', 4)} as sup4, {q.rnd('con', 4)} as con4,
        {q.nli_policy('sup', 'con', 'sup')} as dec
      from (select *, case when neg_c <> neg_x and sup >= 0.5e0 then sup * 0.9e0 else 0e0 end as con
        from (select u.event_id, k, {q.share(tokens('unit'), tokens('context'))} as sup,
                {q.contains_any('lower(unit)', ls.NEGATIONS)} as neg_c,
                {q.contains_any('lower(context)', ls.NEGATIONS)} as neg_x
              from units u join asked using (event_id)))"""
    return f"""
  select a.*, w.sup4 as sup, w.con4 as con, {_LEX_LABEL} as label, greatest(sup4, con4) as conf,
    w.dec as nli_decision, coalesce(any_contra, false) as any_contra,
    coalesce(any_unsupp, false) as any_unsupp
  from asked a join (select * from ({scored}) where k = 0) w using (event_id)
  left join (select event_id, bool_or(c) as any_contra, bool_or(not c and weak) as any_unsupp
    from (select event_id, dec = 'revise' or con4 >= 0.3e0 as c,
            dec in ('warn', 'insufficient_context') or sup4 < 0.8e0 as weak
          from ({scored}) where k > 0) group by 1) r using (event_id)"""


def _detect_requests_sql() -> str:
    results = ", ".join(f"case when reason is null then {c} end as {c}" for c in DETECT_COLUMNS[1:-1])
    return q.with_views(f"""select event_id, reason as reject_reason, {results}, context_words
      from ({DETECT_SQL.replace('event_detections', 'raw_det')}) join (
        select event_id, case when length(context) < 5 then 'context too short'
          when length(question) < 3 then 'question too short'
          when length(answer) < 3 then 'answer too short' end as reason from asked) using (event_id)""",
        asked=_ASKED, units=_UNITS, raw_det=_raw_detections())


def _register_detect_requests() -> None:
    @query("detect_requests", _detect_requests_sql())
    def _(spark, d):
        i = F.col("qa_id")
        rows = v.rag_qa(spark, d).select(
            i.alias("event_id"),
            F.when(i % 5 == 0, F.substring("context", 1, 4)).otherwise(F.col("context")).alias("context"),
            F.when(i % 3 == 0, F.substring("question", 1, 2)).otherwise(F.col("question")).alias("question"),
            F.when(i % 7 == 0, F.lit("")).otherwise(F.col("answer")).alias("answer"),
            F.when(i % 2 == 0, F.lit("")).otherwise(v.sentence(1, "answer")).alias("claim"),
            F.when(i % 4 != 0, v.pick(fv.LABELS, i % 5)).otherwise("").alias("gold_label"),
            v.pick(["auto", "auto", "bert", "nli"], i % 4).alias("mode"),
        )
        return detect_requests(rows, LEXICAL).select("reject_reason", *DETECT_COLUMNS)


@query(
    "fallback_ladder",
    q.with_views("""select source, routing, count(*) as n, count(is_correct) as n_with_gold,
        count(*) filter (is_correct) as n_correct from det group by 1, 2""", det=DETECT_SQL),
)
def _(spark, d):
    return detections(spark, d).groupBy("source", "routing").agg(
        F.count("*").alias("n"), F.count("is_correct").alias("n_with_gold"),
        F.count(F.when(F.col("is_correct"), 1)).alias("n_correct"),
    )


@query(
    "effective_inputs",
    q.with_views(f"""select qa_id, case when length({q.strip('qn')}) >= 3 then qn
          else 'Bu iddia dogru mu?' end as classifier_question,
        case when length({q.strip('qn')}) >= 3 then qn else answer end as nli_question,
        case when length(cl) > 0 then cl else answer end as claim,
        {q.n_words('context')} as context_words
        from (select *, case when qa_id % 3 = 0 then ' ? ' else question end as qn,
                case when qa_id % 2 = 0 then '' else 'claim ' || qa_id end as cl from rag_qa)"""),
)
def _(spark, d):
    from claimlens.functions.text import word_count

    i = F.col("qa_id")
    question = F.when(i % 3 == 0, F.lit(" ? ")).otherwise(F.col("question"))
    claim = F.when(i % 2 == 0, F.lit("")).otherwise(
        F.concat(F.lit("claim "), i.cast("string"))
    )
    return v.rag_qa(spark, d).select(
        "qa_id",
        fu.effective_question(question, F.lit(fv.DEFAULT_QUESTION)).alias("classifier_question"),
        fu.effective_question(question, F.col("answer")).alias("nli_question"),
        fu.effective_claim(claim, F.col("answer")).alias("claim"),
        word_count(F.col("context")).alias("context_words"),
    )


# --- cascade and scorers -------------------------------------------------------------------------
LEXICAL = LexicalScorer(4, ls.STOP, ls.NEGATIONS)
_LEX = f"""
  select qa_id, claim_index, claim, sup0 as sup,
         case when neg_c <> neg_x and sup0 >= 0.5e0 then sup0 * 0.9e0 else 0e0 end as con
  from (select qa_id, claim_index, claim,
          {q.share(q.tokens('claim', 4, ls.STOP), q.tokens('ctx', 4, ls.STOP))} as sup0,
          {q.contains_any('lower(claim)', ls.NEGATIONS)} as neg_c,
          {q.contains_any('lower(ctx)', ls.NEGATIONS)} as neg_x
        from (select c.*, r.context as ctx
              from claims c join rag_qa r using (qa_id)))"""
_LEX_LABEL = """(case when con4 >= 0.3e0 then 'contradicted' when sup4 >= 0.8e0 then 'supported'
  when sup4 >= 0.3e0 then 'partially_supported' when sup4 >= 0.05e0 then 'unsupported'
  else 'insufficient_context' end)"""
_STAGE1 = """(case when con4 >= 0.3e0 then 'contradicted' when sup4 >= 0.5e0 then 'supported'
  else 'neutral' end)"""
_JUDGED = f"""
  select qa_id, claim_index, claim, sup4, con4,
    case when first then 'supported' else {_LEX_LABEL} end as label,
    case when first then {q.rnd('1e0 - sup4', 6)} else {q.label_case(_LEX_LABEL, 'typical')} end
      as score,
    case when first or {_LEX_LABEL} = 'supported' then 'none' else 'unsupported_inference' end
      as error_type,
    case when first then 'Stage 1 (Zero-Shot NLI) verified as supported (confidence: '
           || {q.two('sup4')} || ').' else 'Word overlap with the evidence.' end as explanation
  from (select *, {_STAGE1} = 'supported' and sup4 >= 0.85e0 as first
        from (select *, {q.rnd('sup', 4)} as sup4, {q.rnd('con', 4)} as con4 from lex))"""


_register_detect_requests()


@query(
    "lexical_scorer",
    q.with_views(f"""select qa_id, claim_index, {q.rnd('sup', 4)} as sup, {q.rnd('con', 4)} as con,
        {q.nli_policy('sup', 'con', 'sup')} as decision from lex""", lex=_LEX),
)
def _(spark, d):
    qa = v.rag_qa(spark, d).select("qa_id", F.col("context").alias("ctx"))
    rows = v.claims(spark, d).join(qa, "qa_id").select(
        "qa_id", "claim_index", LEXICAL.score_row(F.col("claim"), F.col("ctx")).alias("s")
    )
    return rows.select("qa_id", "claim_index", "s.sup", "s.con", "s.decision")


@query(
    "cascade",
    q.with_views("""select doc_id, case when fail then 'insufficient_context'
          when s1 = 'supported' and conf >= 0.85e0 then 'supported' else label end as label,
        case when fail then 0.45e0 when s1 = 'supported' and conf >= 0.85e0
          then floor((1e0 - conf) * 1e6 + 0.5e0) / 1e6 else sup end as score,
        case when fail then 'retrieval_failure' when s1 = 'supported' and conf >= 0.85e0
          then 'none' else 'omission' end as error_type
        from (select *, doc_id % 9 = 0 as fail,
          (['supported', 'neutral', 'contradicted'])[1 + doc_id % 3] as s1 from doc_scores)"""),
)
def _(spark, d):
    i = F.col("doc_id")
    stage2 = F.struct(
        F.col("label"), F.col("sup").alias("score"), F.lit("omission").alias("error_type"),
        F.lit("").alias("evidence_span"), F.lit("").alias("explanation"),
    )
    verdict = cascade_verdict(
        F.when(i % 9 == 0, F.lit(fv.NO_CONTEXT_ERROR)), v.pick(fv.NLI_LABELS, _nli_at(i)),
        F.col("conf"), stage2,
    )
    rows = v.doc_scores(spark, d).select("doc_id", verdict.alias("v"))
    return rows.select("doc_id", "v.label", "v.score", "v.error_type")


def _nli_at(i):
    return i % 3


def word_share_model():
    """Example of a plug-in scorer: loaded once per task, scores pandas frames."""
    import pandas as pd

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        shares = [
            len(set(a.split()) & set(b.split())) / max(len(set(a.split())), 1)
            for a, b in zip(frame["answer"], frame["context"], strict=True)
        ]
        return pd.DataFrame({"label": ["supported" if s >= 0.5 else "unsupported" for s in shares],
                             "score": [round(1 - s, 6) for s in shares]})

    return score


_SHARE_SQL = """(len(list_intersect(list_distinct(regexp_extract_all(answer, '[^\\s]+')),
    list_distinct(regexp_extract_all(context, '[^\\s]+'))))::double
    / greatest(len(list_distinct(regexp_extract_all(answer, '[^\\s]+'))), 1))"""


@query(
    "with_scorer",
    q.with_views(f"""select qa_id, case when s >= 0.5e0 then 'supported' else 'unsupported' end
        as label, floor((1e0 - s) * 1e4 + 0.5e0) / 1e4 as score
        from (select qa_id, {_SHARE_SQL} as s from rag_qa)"""),
)
def _(spark, d):
    scored = with_scorer(
        v.rag_qa(spark, d), word_share_model, ["answer", "context"], "label string, score double"
    )
    return scored.select(
        "qa_id", "scored.label", round_to(F.col("scored.score"), 4).alias("score")
    )


@query(
    "cascade_with_scorer",
    q.with_views(f"""select r.qa_id, case when first then 1 else 2 end as stage,
        case when first or s >= 0.5e0 then 'supported' else 'unsupported' end as label,
        floor((case when first then 1e0 - conf else 1e0 - s end) * 1e4 + 0.5e0) / 1e4 as score
        from (select rag_qa.qa_id, conf, label = 'supported' and conf >= 0.85e0 as first,
                {_SHARE_SQL} as s from rag_qa join scores using (qa_id)) r"""),
)
def _(spark, d):
    rows = v.rag_qa(spark, d).withColumns(v.score_columns(F.col("qa_id")))
    staged = rows.select(
        "qa_id", "answer", "context", F.col("label").alias("stage1_label"),
        F.col("conf").alias("stage1_conf"),
    )

    def second(rows, only):
        out = with_scorer(rows, word_share_model, ["answer", "context"],
                          "label string, score double", only=only)
        return out.withColumns({"label": F.col("scored.label"), "score": F.col("scored.score")})

    done = cascade_with_scorer(staged, second)
    return done.select("qa_id", "stage", "label", round_to(F.col("score"), 4).alias("score"))


def space_tokenizer():
    """Example of a plug-in tokenizer: counts blank-separated pieces."""
    return lambda text: len(text.split(" "))


@query("with_tokenizer", "select doc_id, len(string_split(text, ' ')) as n_tokens from documents")
def _(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", "text")
    return with_tokenizer(rows, "text", space_tokenizer).select("doc_id", "n_tokens")


# --- model output ---------------------------------------------------------------------------------
def _fields_sql(j: str, raw: str, tier: int) -> str:
    """Verdict struct from JSON text j, null when unusable."""
    f = lambda n: f"json_extract_string({j}, '$.{n}')"
    ty = lambda n: f"coalesce(json_type({j}, '$.{n}'), 'MISSING')"
    score = (f"case when {ty('hallucination_score')} = 'MISSING' then 0.5e0 "
             f"else try_cast({f('hallucination_score')} as double) end")
    return f"""(case when {q.in_list(f('label'), fv.LABELS)} and ({score}) is not null
      and {ty('evidence_span')} in ('MISSING', 'VARCHAR')
      and {ty('explanation')} in ('MISSING', 'VARCHAR') then
      {{'label': {f('label')}, 'score': greatest(0e0, least(1e0, {score})),
        'error_type': case when {q.in_list(f('error_type'), fv.ERROR_TYPES)}
            then {f('error_type')} else 'none' end,
        'span': coalesce({f('evidence_span')}, ''),
        'explanation': coalesce({f('explanation')}, ''),
        'decision': case when {ty('decision')} = 'MISSING' then 'warn'
            when {q.in_list(f('decision'), fv.DECISIONS)} then {f('decision')}
            else {q.label_case(f('label'), 'default_decision')} end,
        'parse_error': false, 'raw_output': null::varchar, 'tier': {tier}}} end)"""


_Q = lambda n: f"nullif(regexp_extract(raw, '\"{n}\"\\s*:\\s*\"([^\"]*)\"', 1), '')"
_BARE = "(case " + " ".join(
    f"when contains(raw, '{x}') then '{x}'" for x in
    ("insufficient_context", "partially_supported", "contradicted", "unsupported", "supported")
) + " end)"
_RAW_CUT = "case when length(raw) > 500 then substr(raw, 1, 500) || '...' else raw end"
_TIER3 = f"""(case when lab3 is not null then {{'label': lab3,
  'score': greatest(0e0, least(1e0, coalesce(try_cast(regexp_extract(raw,
     '"hallucination_score"\\s*:\\s*([0-9]*\\.?[0-9]+)', 1) as double),
     {q.label_case('lab3', 'typical')}))),
  'error_type': case when {q.in_list(_Q('error_type'), fv.ERROR_TYPES)} then {_Q('error_type')}
     when lab3 = 'supported' then 'none' else 'unsupported_inference' end,
  'span': coalesce({_Q('evidence_span')}, ''),
  'explanation': coalesce({_Q('explanation')}, {q.quote(fv.NO_EXPLANATION)}),
  'decision': case when {q.in_list(_Q('decision'), fv.DECISIONS)} then {_Q('decision')}
     else {q.label_case('lab3', 'default_decision')} end,
  'parse_error': true, 'raw_output': {_RAW_CUT}, 'tier': 3}} end)"""
_SENTINEL = lambda reason: f"""{{'label': 'insufficient_context', 'score': 0.5e0,
  'error_type': 'none', 'span': '', 'explanation': '[PARSE ERROR: {reason}]', 'decision': 'warn',
  'parse_error': true, 'raw_output': {_RAW_CUT}, 'tier': 4}}"""
_PIECES = """
  select doc_id, raw, list_sum(list_transform(pieces[1:n], lambda p: length(p))) as used
  from (select doc_id, raw, pieces, min(i) filter (depth = 0) as n
        from (select doc_id, raw, pieces, i, sum(case when ends_with(pieces[i], '{') then 1
                else -1 end) over (partition by doc_id order by i) as depth
              from (select *, generate_subscripts(pieces, 1) as i
                    from (select doc_id, raw, regexp_extract_all(substr(raw, instr(raw, '{')),
                            '[^{}]*[{}]') as pieces from raw_outputs where contains(raw, '{'))))
        group by 1, 2, 3)"""
_OBJ = lambda x: f"(case when json_valid({x}) and json_type({x}) = 'OBJECT' then {x} end)"
_PARSED = f"""
  select doc_id, case when {q.strip('raw')} = '' then {_SENTINEL('Empty output')}
    else coalesce({_fields_sql('j1', 'raw', 1)}, {_fields_sql('j2', 'raw', 2)}, {_TIER3},
                  {_SENTINEL('All parsing strategies failed')}) end as r
  from (select *, {_OBJ(q.strip('raw'))} as j1, {_OBJ('block')} as j2,
          case when {q.in_list(_Q('label'), fv.LABELS)} then {_Q('label')} else {_BARE} end as lab3
        from (select o.doc_id, o.raw, substr(o.raw, instr(o.raw, '{{'), used::bigint) as block
              from raw_outputs o left join pieces p on o.doc_id = p.doc_id))"""


@query(
    "parse_outputs",
    q.with_views("""select doc_id, r.label, r.score as hallucination_score, r.error_type,
        r.span as evidence_span, r.explanation, r.decision, r.parse_error, r.raw_output, r.tier
        from parsed""", pieces=_PIECES, parsed=_PARSED),
)
def _(spark, d):
    rows = v.raw_outputs(spark, d).select("doc_id", op.parse_output(F.col("raw")).alias("r"))
    return rows.select("doc_id", "r.*")


@query(
    "parse_stats",
    q.with_views("""select count(*) as n_total, count(*) filter (not r.parse_error) as n_valid,
        count(*) filter (r.parse_error) as n_parse_errors,
        floor(count(*) filter (not r.parse_error)::double / count(*) * 1e4 + 0.5e0) / 1e4
          as json_validity_rate from parsed""", pieces=_PIECES, parsed=_PARSED),
)
def _(spark, d):
    from claimlens.operators.metrics import json_validity

    rows = v.raw_outputs(spark, d).select(op.parse_output(F.col("raw")).alias("r"))
    return json_validity(rows.select("r.parse_error")).select(
        "n_total", "n_valid", "n_parse_errors", "json_validity_rate"
    )


@query(
    "fenced_json",
    q.with_views(f"""select doc_id, json_extract_string(j, '$.label') as label,
        json_extract_string(j, '$.decision') as decision from (
          select doc_id, {_OBJ('b')} as j from (select doc_id,
            nullif(regexp_extract({q.strip("regexp_replace(raw, '```(?:json)?[^S]*?', '', 'g')")},
              '(?s)\\{{.*\\}}'), '') as b from raw_outputs))"""),
)
def _(spark, d):
    obj = op.fenced_json(F.col("raw"))
    rows = v.raw_outputs(spark, d).select("doc_id", obj.alias("o"))
    return rows.select(
        "doc_id", F.try_variant_get("o", "$.label", "string").alias("label"),
        F.try_variant_get("o", "$.decision", "string").alias("decision"),
    )


@query(
    "accept_generated",
    q.with_views(f"""select doc_id, coalesce({q.in_list('r.label', fv.LABELS)} and
        r.score between 0 and 1 and {q.in_list('r.error_type', fv.ERROR_TYPES)} and
        {q.in_list('r.decision', fv.DECISIONS)} and trim(r.explanation) <> '' and
        doc_id % 7 <> 0 and not r.parse_error, false) as ok from parsed""",
                 pieces=_PIECES, parsed=_PARSED),
)
def _(spark, d):
    rows = v.raw_outputs(spark, d).select("doc_id", op.parse_output(F.col("raw")).alias("r"))
    question = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("Why?"))
    ok = op.accept_generated(
        F.col("r.label"), F.col("r.hallucination_score"), F.col("r.error_type"),
        F.col("r.decision"), question, F.col("r.explanation"),
    )
    return rows.select("doc_id", (ok & ~F.col("r.parse_error")).alias("ok"))


@query(
    "coerce_output",
    f"""select doc_id, label, case when {q.in_list('e', fv.ERROR_TYPES)} then e else 'none' end
          as error_type, case when {q.in_list('dd', fv.DECISIONS)} then dd else 'warn' end
          as decision, case when label not in ({', '.join(map(q.quote, fv.LABELS))},
          'parse_error') then 'Invalid label ''' || label || '''' end as error
        from (select doc_id, {q.pick([*fv.LABELS, 'parse_error', 'odd'], 'doc_id % 7')} as label,
          {q.pick([*fv.ERROR_TYPES, 'weird', 'x'], 'doc_id % 13')} as e,
          {q.pick([*fv.DECISIONS, 'explode'], 'doc_id % 7')} as dd from documents)""",
)
def _(spark, d):
    i = F.col("doc_id")
    out = op.coerce_output(
        v.pick([*fv.LABELS, "parse_error", "odd"], i % 7),
        v.pick([*fv.ERROR_TYPES, "weird", "x"], i % 13),
        v.pick([*fv.DECISIONS, "explode"], i % 7),
    )
    rows = v.table(spark, d, "documents").select("doc_id", out.alias("o"))
    return rows.select("doc_id", "o.*")


def _guards_sql() -> str:
    cols = ["doc_id", "claim", "context", "original_label", "original_score", "label",
            "hallucination_score", "error_type", "evidence_span", "explanation", "parse_error"]

    def step(source: str, hit: str, **new: str) -> str:
        inner = f"select *, coalesce({hit}, false) as hit from ({source})"
        outs = [f"case when hit then {new[c]} else {c} end as {c}" if c in new else c for c in cols]
        return f"select {', '.join(outs)} from ({inner})"

    def note(text: str) -> str:
        return (f"case when length(explanation) > 0 then explanation || '  [' || {text} || ']' "
                f"else {text} end")

    blank = f"coalesce({q.strip('evidence_span')} = '', true)"
    named = lambda name: f"case when length(error_type) > 0 then error_type else '{name}' end"
    s = ("select *, label as original_label, hallucination_score as original_score "
         "from guard_rows")
    s = step(s, f"label = 'supported' and not parse_error and {blank}",
             label="'partially_supported'",
             hallucination_score="least(greatest(hallucination_score, 0.35e0), 0.55e0)",
             error_type="'missing_evidence_span'", explanation=note(q.quote(fv.NOTE_MISSING_SPAN)))
    span = q.tokens("evidence_span")
    s = step(s, f"not {blank} and len({span}) > 0 and {q.share(span, q.tokens('context'))} < 0.5e0",
             evidence_span="null", error_type=named("hallucinated_span"))
    s = step(s, q.contains_any("lower(evidence_span)", ls.PLACEHOLDERS),
             evidence_span="null", error_type=named("placeholder_span"))
    over = q.share(q.tokens("claim", 3), q.tokens("context", 3))
    head, tail = fv.NOTE_PARAPHRASE.split("%s%%")
    percent = f"printf('%.0f', round_even({over} * 100, 0))"
    s = step(s, f"label = 'unsupported' and not parse_error and {over} >= 0.6e0",
             label="'partially_supported'",
             hallucination_score="least(hallucination_score, 0.5e0)",
             error_type="'paraphrase_mismatch'",
             explanation=note(f"({q.quote(head)} || {percent} || '%' || {q.quote(tail)})"))
    s = step(s, "label in ('contradicted', 'partially_supported') and not parse_error and "
             + q.contains_any("lower(claim)", ls.NEGATIONS) + " and "
             + q.contains_any("lower(evidence_span)", ls.NEGATIONS),
             label="'supported'", hallucination_score="least(hallucination_score, 0.15e0)",
             error_type="'none'", explanation=note(q.quote(fv.NOTE_NEGATION)))
    return step(s, f"label = 'contradicted' and not parse_error and {blank}",
                label="'unsupported'", hallucination_score="least(hallucination_score, 0.8e0)",
                error_type=named("unsupported_inference"),
                explanation=note(q.quote(fv.NOTE_NO_CONFLICT_SPAN)))


GUARD_COLUMNS = ("doc_id", "original_label", "original_score", "label", "hallucination_score",
                 "error_type", "evidence_span", "explanation")


@query("apply_guards", q.with_views(f"select {', '.join(GUARD_COLUMNS)} from ({_guards_sql()})"))
def _(spark, d):
    out = guards.apply_guards(v.guard_rows(spark, d), ls.PLACEHOLDERS, ls.NEGATIONS)
    return out.select(*GUARD_COLUMNS)


_CHAIN_ROWS = """
  select p.doc_id, p.doc_id // 4 as answer_id, case when p.doc_id % 2 = 0 then split_part(text, '.', 1)
      else 'the is of qqqqq zzzzz wwwww' end as claim, text as context, r.label as label,
    r.score as hallucination_score, r.error_type as error_type, r.span as evidence_span,
    r.explanation as explanation, r.parse_error as parse_error, r.decision as decision
  from parsed p join documents using (doc_id)"""


@query(
    "verify_outputs",
    q.with_views(f"""select answer_id, max(hallucination_score) as aggregate_risk_score,
        ({q.array(fv.DECISION_SEVERITY)})[min(list_position({q.array(fv.DECISION_SEVERITY)},
           decision))] as aggregate_decision, count(*) as n_claims,
        {', '.join(f"count(*) filter (label = '{x}') as n_{x}" for x in an.COUNTED)}
        from (select g.label, g.hallucination_score, c.answer_id, c.decision
          from ({_guards_sql().replace('guard_rows', 'chain_rows')}) g
          join chain_rows c using (doc_id)) group by 1""",
                 pieces=_PIECES, parsed=_PARSED, chain_rows=_CHAIN_ROWS),
)
def _(spark, d):
    i = F.col("doc_id")
    texts = v.table(spark, d, "documents").select("doc_id", "text")
    rows = v.raw_outputs(spark, d).join(texts, "doc_id").select(
        F.expr("doc_id div 4").alias("answer_id"),
        F.when(i % 2 == 0, v.sentence(1)).otherwise(F.lit("the is of qqqqq zzzzz wwwww")).alias("claim"),
        F.col("text").alias("context"), "raw",
    )
    return verify_outputs(rows, "answer_id", placeholder_phrases=ls.PLACEHOLDERS,
                          negation_words=ls.NEGATIONS)


def _single_guard(name: str, fn, hit: str, changed: str) -> None:
    @query(name, q.with_views(f"select doc_id, {hit} as hit from guard_rows"))
    def _(spark, d):
        before = v.guard_rows(spark, d).withColumn("_before", F.col(changed))
        after = fn(before)
        return after.select("doc_id", (~F.col(changed).eqNullSafe(F.col("_before"))).alias("hit"))


_BLANK = f"coalesce({q.strip('evidence_span')} = '', true)"
_single_guard("guard_missing_span", guards.missing_span,
              f"label = 'supported' and not parse_error and {_BLANK}", "label")
_single_guard(
    "guard_foreign_span", guards.foreign_span,
    f"""coalesce(not {_BLANK} and len({q.tokens('evidence_span')}) > 0 and
        {q.share(q.tokens('evidence_span'), q.tokens('context'))} < 0.5e0, false)""",
    "evidence_span")
_single_guard("guard_placeholder_span",
              lambda df: guards.placeholder_span(df, ls.PLACEHOLDERS),
              f"coalesce({q.contains_any('lower(evidence_span)', ls.PLACEHOLDERS)}, false)",
              "evidence_span")
_single_guard("guard_paraphrase", guards.paraphrase,
              f"label = 'unsupported' and not parse_error and "
              f"{q.share(q.tokens('claim', 3), q.tokens('context', 3))} >= 0.6e0", "label")
_single_guard(
    "guard_shared_negation", lambda df: guards.shared_negation(df, ls.NEGATIONS),
    "coalesce(label in ('contradicted', 'partially_supported') and not parse_error and "
    + q.contains_any("lower(claim)", ls.NEGATIONS) + " and "
    + q.contains_any("lower(evidence_span)", ls.NEGATIONS) + ", false)", "label")
_single_guard("guard_conflict_without_span", guards.conflict_without_span,
              f"label = 'contradicted' and not parse_error and {_BLANK}", "label")


# --- answers ------------------------------------------------------------------------------------------
def _tally(score: str = "score") -> str:
    counts = ", ".join(
        f"count(*) filter (label = '{x}') as n_{x}" for x in an.COUNTED
    )
    return f"count(*) as n_claims, {q.mean(score)} as s, {counts}"


def _policy_case(at: int) -> str:
    n, s = "n_claims", q.two("s")
    sup, con, ins = "n_supported", "n_contradicted", "n_insufficient_context"
    par, uns = "n_partially_supported", "n_unsupported"
    more = "Additional retrieval needed."
    rules = [
        (f"{n} = 1 and {sup} = 1", "accept", "'Single claim supported by context.'"),
        (f"{n} = 1 and {par} = 1", "warn", "'Single claim only partially supported by context.'"),
        (f"{n} = 1 and {uns} = 1", "warn", "'Single claim not found in context. "
         "Answer may contain unverified information.'"),
        (f"{n} = 1 and {con} = 1", "revise", "'Single claim contradicted by context. "
         "Revise or remove the incorrect statement.'"),
        (f"{n} = 1", "insufficient_context",
         f"'Cannot verify claim — insufficient context. {more}'"),
        (f"{sup} = {n}", "accept", f"'All ' || {n} || '/' || {n} || ' claims supported by context. "
         f"Aggregate hallucination score: ' || {s} || '.'"),
        (f"{ins} = {n}", "insufficient_context", f"'All ' || {n} || '/' || {n} || ' claims cannot "
         f"be verified with current context. {more}'"),
        (f"{ins} > 0", "insufficient_context", f"{ins} || '/' || {n} || ' claim(s) cannot be "
         f"verified with current context. {more}'"),
        (f"{con} >= 2 and {sup} = 0", "reject", f"{con} || '/' || {n} || ' claim(s) directly "
         "contradicted, none supported. Answer is unreliable.'"),
        (f"{con} > 0", "revise", f"{con} || '/' || {n} || ' claim(s) contradicted by context. "
         "Revise or remove the contradicted parts.'"),
        ("true", "warn", f"({par} + {uns}) || '/' || {n} || ' claim(s) not fully supported by "
         "context. Answer may contain unverified information.'"),
    ]
    arms = " ".join(f"when {r[0]} then {q.quote(r[1]) if at == 1 else r[2]}" for r in rules)
    return f"(case {arms} end)"


_COUNT_COLS = ", ".join(f"n_{x}" for x in an.COUNTED)
_POLICY = f"""
  select qa_id, {_policy_case(1)} as final_decision, {_policy_case(2)} as action_message,
    {_policy_case(1)} = 'insufficient_context' as retrieval_needed,
    {q.rnd('s', 4)} as aggregate_hallucination_score, n_claims, {_COUNT_COLS}"""
_POLICY_ROWS = f"{_POLICY} from (select qa_id, {_tally()} from verdicts group by 1)"
POLICY_COLUMNS = ("final_decision", "action_message", "retrieval_needed",
                  "aggregate_hallucination_score", "n_claims", *[f"n_{x}" for x in an.COUNTED])


@query("answer_policy", q.with_views(_POLICY_ROWS))
def _(spark, d):
    rows = v.answer_verdicts(spark, d).select(
        "qa_id", an.answer_policy(F.col("verdicts")).alias("p")
    )
    return rows.select("qa_id", "p.*")


@query(
    "policy_by_answer",
    q.with_views(f"""{_POLICY}, n_flagged from (select qa_id, {_tally()},
        count(*) filter (score >= 0.5e0) as n_flagged from verdicts group by 1)"""),
)
def _(spark, d):
    return decisions.policy_by_answer(v.verdicts(spark, d), "qa_id")


@query("flagged_claims",
       q.with_views("select qa_id, claim, label, score from verdicts where score >= 0.5e0"))
def _(spark, d):
    rows = v.answer_verdicts(spark, d).select(
        "qa_id", F.explode(an.flagged_claims(F.col("verdicts"))).alias("c")
    )
    return rows.select("qa_id", "c.claim", "c.label", "c.score")


@query(
    "verify_answer",
    q.with_views(f"""select qa_id, max(score) as aggregate_risk_score,
        ({q.array(fv.DECISION_SEVERITY)})[min(list_position({q.array(fv.DECISION_SEVERITY)},
           decision))] as aggregate_decision, count(*) as n_claims,
        {', '.join(f"count(*) filter (label = '{x}') as n_{x}" for x in an.COUNTED)}
        from verdicts group by 1"""),
)
def _(spark, d):
    rows = v.verdicts(spark, d).withColumnRenamed("score", "hallucination_score")
    return decisions.verify_answer(rows, "qa_id")


def _revise_sql(strategy: str, source: str = "verdicts", key: str = "qa_id") -> str:
    cut = "substr(claim, 1, 60)"
    hedged = f"claim || {q.quote(fv.HEDGE_SUFFIX)}"
    if strategy == "drop":
        cut = "case when length(claim) > 80 then substr(claim, 1, 80) || '...' else claim end"
        act = """case when label in ('contradicted', 'unsupported') then 'DROPPED'
                 when label = 'partially_supported' then 'HEDGED' else 'KEPT' end"""
    elif strategy == "hedge":
        act = """case when label = 'contradicted' then 'DROPPED' when label in ('unsupported',
                 'partially_supported') then 'HEDGED' else 'KEPT' end"""
    elif strategy == "replace":
        act = """case when label = 'contradicted' and length(evidence_span) > 0 then 'REPLACED'
                 when label in ('contradicted', 'unsupported') then 'DROPPED' else 'KEPT' end"""
    else:
        act = "case when label = 'supported' then 'KEPT' else 'REMOVED' end"
    log = f"""case when act = 'REPLACED' then 'REPLACED [contradicted]: ''' ||
      substr(claim, 1, 50) || ''' → ''' || substr(evidence_span, 1, 50) || ''''
      else act || ' [' || label || ']: ' || ({cut}) end"""
    text = f"""case act when 'KEPT' then claim when 'HEDGED' then {hedged}
      when 'REPLACED' then {q.strip('evidence_span')} end"""
    fallback = fv.FALLBACK_ANSWER_DROP if strategy == "drop" else fv.FALLBACK_ANSWER
    extra = (f" || case when count(txt) = 0 then ' / ' || {q.quote(fv.FALLBACK_LOG)} else '' end"
             if strategy == "drop" else "")
    removed = "0" if strategy == "hedge" else "count(*) filter (act in ('DROPPED', 'REMOVED'))"
    kept = ("count(*) filter (act in ('KEPT', 'HEDGED'))" if strategy == "drop"
            else "count(*) filter (act = 'KEPT')")
    return f"""select {key}, coalesce(string_agg(txt, ' ' order by claim_index)
        filter (txt is not null), {q.quote(fallback)}) as revised_answer,
      {removed} as n_claims_removed, count(*) filter (act = 'HEDGED') as n_claims_hedged,
      count(*) filter (act = 'REPLACED') as n_claims_replaced, {kept} as n_claims_kept,
      string_agg(lg, ' / ' order by claim_index){extra} as revision_log
      from (select *, {log} as lg, {text} as txt from (select *, {act} as act from {source}))
      group by {key}"""


def _register_strategy(strategy: str) -> None:
    @query(f"revise_{strategy}", q.with_views(_revise_sql(strategy)))
    def _(spark, d):
        rows = v.answer_verdicts(spark, d).select(
            "qa_id",
            an.revise(strategy, F.col("answer"), F.col("verdicts"), F.lit("revise")).alias("r"),
        )
        return rows.select(
            "qa_id", "r.revised_answer", "r.n_claims_removed", "r.n_claims_hedged",
            "r.n_claims_replaced", "r.n_claims_kept",
            F.array_join("r.revision_log", " / ").alias("revision_log"),
        )


for _strategy in an.STRATEGIES:
    _register_strategy(_strategy)


@query(
    "revise_by_decision",
    q.with_views(f"""select p.qa_id, case when p.final_decision = 'accept' then r.answer
          else v.revised_answer end as revised_answer, p.final_decision = 'accept' as unchanged
        from pol p join rag_qa r using (qa_id) join rev v using (qa_id)""",
                 pol=_POLICY_ROWS, rev=_revise_sql("drop")),
)
def _(spark, d):
    decision = an.answer_policy(F.col("verdicts"))["final_decision"]
    rows = v.answer_verdicts(spark, d).withColumn("decision", decision)
    return rows.select(
        "qa_id",
        an.revise("drop", F.col("answer"), F.col("verdicts"), F.col("decision")).alias("r"),
    ).select("qa_id", "r.revised_answer", F.col("r.no_revision_needed").alias("unchanged"))


_ICON = ("(case final_decision " + " ".join(
    f"when '{k}' then '{x}'" for k, x in fv.DECISION_ICONS.items()) + " else '?' end)")
_SUMMARY = f"""{_ICON} || ' ' || upper(final_decision) || ' | score=' ||
  {q.two('aggregate_hallucination_score')} || ' | ' || n_claims || ' claims: ' || n_supported ||
  '✓ ' || n_contradicted || '✗ ' || n_unsupported || '? ' || n_partially_supported || '~ ' ||
  n_insufficient_context || '∅'"""


@query("summary_line", q.with_views(f"select qa_id, {_SUMMARY} as line from pol",
                                    pol=_POLICY_ROWS))
def _(spark, d):
    rows = v.answer_verdicts(spark, d).select(
        "qa_id", an.answer_policy(F.col("verdicts")).alias("p")
    )
    return rows.select("qa_id", an.summary_line(F.col("p")).alias("line"))


@query(
    "retrieve_passthrough",
    q.with_views(f"""select qa_id, c as context,
        case when c = '' then 'none' else 'passthrough' end as source,
        case when c <> '' then 1e0 end as score,
        case when c = '' then {q.quote(fv.NO_CONTEXT_ERROR)} end as error
        from (select qa_id, case when qa_id % 10 = 1 then '' else context end as c
              from rag_qa)"""),
)
def _(spark, d):
    c = F.when(F.col("qa_id") % 10 == 1, F.lit("")).otherwise(F.col("context"))
    rows = v.rag_qa(spark, d).select("qa_id", passthrough_evidence(c).alias("e"))
    return rows.select("qa_id", "e.*")


VERIFY_COLUMNS = ("qa_id", *POLICY_COLUMNS, "context_preview", "revised_answer", "summary")
_VERIFIED = f"""
  select pol.*, case when length(r.context) > 500 then substr(r.context, 1, 500) || '...'
      else r.context end as context_preview,
    case when final_decision = 'accept' then r.answer
         when final_decision in ('revise', 'reject') then rev.revised_answer end as revised_answer,
    {_SUMMARY} as summary
  from pol join rag_qa r using (qa_id) join rev using (qa_id)"""
_POL_JUDGED = f"{_POLICY} from (select qa_id, {_tally()} from judged group by 1)"
_REV_JUDGED = _revise_sql("drop", "(select *, '' as evidence_span from judged)")


@query(
    "verify_answers",
    q.with_views(_VERIFIED, lex=_LEX, judged=_JUDGED, pol=_POL_JUDGED, rev=_REV_JUDGED),
)
def _(spark, d):
    out = verify_answers(v.rag_qa(spark, d), scorer=LEXICAL, **ls.CLAIM_LISTS)
    return out.select(*VERIFY_COLUMNS)


@query(
    "verified_claims",
    q.with_views("""select qa_id, claim_index, claim, label, score, error_type, explanation
        from judged""", lex=_LEX, judged=_JUDGED),
)
def _(spark, d):
    out = verify_answers(v.rag_qa(spark, d), scorer=LEXICAL, **ls.CLAIM_LISTS)
    rows = out.select("qa_id", F.posexplode("verdicts").alias("claim_index", "c"))
    return rows.select(
        "qa_id", "claim_index", "c.claim", "c.label", "c.score", "c.error_type", "c.explanation"
    )

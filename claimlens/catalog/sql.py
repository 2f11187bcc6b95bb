"""SQL fragments and common table expressions that mirror :mod:`views`."""

from __future__ import annotations

import re

from claimlens import fixed_values as fv
from claimlens.catalog import lists as ls
from claimlens.functions.text import WORD, WS


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def pick(values, at: str) -> str:
    return f"({array(values)})[1 + ({at})]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def tokens(x: str, least: int = 1, stop=()) -> str:
    found = f"regexp_extract_all(lower({x}), '[{WORD}]{{{least},}}')"
    if stop:
        found = f"list_filter({found}, lambda t: not list_contains({array(stop)}, t))"
    return f"list_distinct({found})"


def turkish_lower(x: str) -> str:
    return f"lower(translate({x}, '{fv.TURKISH_UPPER_CHARS}', '{fv.TURKISH_LOWER_CHARS}'))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def share(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then {shared(a, b)}::double / len({a}) else 0e0 end)"


def jaccard(a: str, b: str) -> str:
    return (f"(case when len({a}) > 0 and len({b}) > 0 then {shared(a, b)}::double / "
            f"(len({a}) + len({b}) - {shared(a, b)}) else 0e0 end)")


def rnd(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5e0) / {scale})"


def ratio(a: str, b: str) -> str:
    return f"(case when ({b}) > 0 then ({a})::double / ({b})::double else 0e0 end)"


def mean(x: str) -> str:
    return f"(sum(({x})::decimal(18,9))::double / count({x}))"


def two(x: str) -> str:
    return f"printf('%.2f', {rnd(x, 2)})"


def label_case(x: str, field: str, default: str = "null") -> str:
    at = fv.LABEL_FIELDS.index(field)
    rows = [(r[0], r[at]) for r in fv.LABEL_ROWS]
    body = " ".join(
        f"when {quote(k)} then {quote(v) if isinstance(v, str) else f'{v}e0'}" for k, v in rows
    )
    return f"(case {x} {body} else {default} end)"


def contains_any(x: str, needles) -> str:
    return "(" + " or ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def in_list(x: str, values) -> str:
    return f"({x} in (" + ", ".join(quote(v) for v in values) + "))"


def has_word(x: str, alternatives) -> str:
    return f"regexp_matches({x}, '(^|[^{WORD}])({'|'.join(alternatives)})($|[^{WORD}])')"


def sentences(x: str) -> str:
    raw = f"regexp_extract_all({x}, '[^.!?]+[.!?]*')"
    return (f"list_filter(list_transform({raw}, lambda s: {strip('s')}), lambda s: s <> '')")


def is_valid_claim(x: str, opinion=ls.OPINION) -> str:
    return (f"(length({x}) >= 10 and not ends_with({x}, '?') "
            f"and not {has_word(f'lower({x})', opinion)})")


def multi_entity(x: str) -> str:
    tech = "(" + "|".join(fv.TECH_NAMES) + f")[{WS}]*/?[{WS}]*[0-9.]+"
    edge, year = f"(^|[^{WORD}])", "(1[0-9]{3}|20[0-9]{2})"
    years = f"{edge}{year}([^{WORD}](.*?[^{WORD}])?){year}($|[^{WORD}])"
    return f"regexp_matches({x}, '(?i){tech}.*?{tech}|v[0-9.]+.*?v[0-9.]+|{years}')"


def split_compound(s: str, conj=ls.CONJ, weak=ls.WEAK) -> str:
    def sides(hay: str, c: str) -> tuple[str, str, str]:
        at = f"instr({hay}, {quote(c)})"
        left = strip(f"substr({s}, 1, {at} - 1)")
        right = strip(f"substr({s}, {at} + {len(c)})")
        return at, left, right

    cases = []
    for c in conj:
        at, left, right = sides(f"lower({s})", c)
        cases.append(f"when {at} > 0 and length({left}) >= 10 and length({right}) >= 10 "
                     f"then [{left}, {right}]")
    at, left, right = sides(s, weak)
    cases.append(f"when {at} > 0 and {multi_entity(s)} and length({left}) >= 10 and "
                 f"length({right}) >= 10 then [{left}, {right}]")
    return "(case " + " ".join(cases) + f" else [{s}] end)"


def protect(x: str, abbr=ls.ABBR) -> str:
    names = "|".join(sorted(abbr, key=len, reverse=True))
    once = lambda y: f"regexp_replace({y}, '(^|[^{WORD}])({names})\\.', '\\1\\2<DOT>', 'g')"
    return once(once(x))


def extract_claims(x: str) -> str:
    marked = f"regexp_replace({protect(strip(x))}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g')"
    parts = f"string_split({marked}, chr(1))"
    restored = f"list_transform({parts}, lambda s: replace({strip('s')}, '<DOT>', '.'))"
    pieces = f"flatten(list_transform({restored}, lambda s: {split_compound('s')}))"
    return (f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), "
            f"lambda s: {is_valid_claim('s')})")


def nli_policy(sup: str, con: str, kw: str) -> str:
    return (f"(case when {con} >= 0.3e0 then 'revise' when {sup} >= 0.8e0 then 'accept' "
            f"when {sup} >= 0.3e0 then 'warn' when {kw} >= 0.05e0 then 'warn' "
            f"else 'insufficient_context' end)")


def hash_key(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"({p})::varchar" for p in parts) + ")"


def hash_unit(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296e0)"


def score_columns(k: str) -> str:
    return f"""({k} * 37 % 101) / 100e0 as sup,
    case when {k} % 7 = 0 then 0.85e0
         else ((100 - {k} * 37 % 101) * ({k} * 53 % 101)) / 10000e0 end as con,
    {pick(fv.LABELS, f'({k}) % 5')} as label,
    (50 + {k} * 29 % 51) / 100e0 as conf"""


def _label_at(i: str) -> str:
    return pick(fv.LABELS, f"({i}) % 5")


_SPAN = lambda s: f"{{'start': ({s})::int, 'end': ({s})::int + 40, 'label': nm}}"
_JSON_HEAD = (
    """'{"label": "' || lab || '", "hallucination_score": ' || sc || ', "error_type": "' || """
    """(['none', 'entity_error', 'weird'])[1 + doc_id % 3] || '", "explanation": "' || """
)
_JSON_TAIL = """ || '", "decision": "' || (['accept', 'explode', 'revise'])[1 + doc_id % 7 % 3] || '"'"""

CTES: dict[str, str] = {
    "rag_qa": f"""
  select conv_id * 1000000 + turn as qa_id, conv_id, turn, q as question, c.text as answer,
         case when conv_id % 2 = 1 then d.text else c.text || ' ' || d.text end as context
  from (select *, lag(text) over w as q, lag(role) over w as prev from conversations
        window w as (partition by conv_id order by turn)) c
  join documents d on d.doc_id = (conv_id * 7 + turn) % (select count(*) from documents)
  where role = 'assistant' and prev = 'user'""",
    "claim_lists": f"""
  select *, case when len(found) > 0 then found else [{strip('answer')}] end as clist
  from (select *, {extract_claims('answer')} as found from rag_qa)""",
    "claims": """
  select qa_id, len(clist) as claim_count, generate_subscripts(clist, 1) - 1 as claim_index,
         unnest(clist) as claim from claim_lists""",
    "scores": f"select qa_id, {score_columns('qa_id')} from rag_qa",
    "doc_scores": f"select doc_id, {score_columns('doc_id')} from documents",
    "claim_scores": f"""
  select *, {nli_policy('sup', 'con', 'sup')} as decision from (
    select qa_id, claim_index, claim_count, claim, label, conf,
           case when qa_id % 3 = 0 then 0.9e0 else sup end as sup,
           case when qa_id % 3 = 0 then 0.05e0 else con end as con
    from (select *, {score_columns('(qa_id * 31 + claim_index * 17)')} from claims))""",
    "verdicts": f"""
  select qa_id, claim_index, claim,
         {pick(fv.LABELS, 'case when qa_id % 4 = 0 then 0 when qa_id % 4 = 1 then 3 else k % 5 end')}
           as label,
         (k * 13 % 101) / 100e0 as score,
         case when k % 3 = 0 then claim else '' end as evidence_span,
         {pick(fv.DECISIONS, 'k % 6')} as decision
  from (select *, qa_id + claim_index * qa_id % 7 as k from claims)""",
    "logits": """
  select doc_id, [a, b, c] as nli, [a, b, c, e, f] as cls from (
    select doc_id,
      case when doc_id % 40 = 0 then 'nan'::double when doc_id % 40 = 1 then 'inf'::double
           else (doc_id * 37 % 101) / 10e0 - 5e0 end as a,
      (doc_id * 53 % 101) / 10e0 - 5e0 as b, (doc_id * 71 % 101) / 10e0 - 5e0 as c,
      (doc_id * 29 % 101) / 10e0 - 5e0 as e, (doc_id * 17 % 101) / 10e0 - 5e0 as f
    from documents)""",
    "gold_pred": f"""
  select id, {_label_at('ga')} as gold, {_label_at('pa')} as pred, score, gold_span,
         case when id % 3 = 0 then gold_span when id % 3 = 1 then split_part(context, '.', 2)
              else 'zzz' end as pred_span,
         context, id % 23 = 0 as parse_error, (id * 7 % 400 + 5)::double as latency_ms
  from (select d.doc_id as id, d.doc_id % 5 as ga,
          case when d.doc_id * 13 % 17 < 12 then d.doc_id % 5
               else (d.doc_id * 3 + coalesce(quality, 0) + 1) % 5 end as pa,
          (d.doc_id * 17 % 101) / 100e0 as score,
          case when d.doc_id % 5 in (0, 3) then split_part(text, '.', 1) else '' end as gold_span,
          text as context
        from documents d left join labels l on d.doc_id = l.doc_id)""",
    "pred_rows": """
  select id, 1 as seq, pred, score, pred_span, parse_error, latency_ms from gold_pred
    where id % 11 <> 0
  union all
  select id + 1000000, 1, pred, score, pred_span, parse_error, latency_ms from gold_pred
    where id % 29 = 0
  union all
  select id, 2, 'supported', 0.5e0, pred_span, parse_error, latency_ms from gold_pred
    where id % 31 = 0""",
    "pred_fields": """
  select id, seq, pred,
         case when id % 3 = 2 and id % 2 = 1 then 0.5e0 else score end as score,
         pred_span, parse_error, latency_ms from pred_rows""",
    "last_pred": """
  select * from pred_fields qualify row_number() over (partition by id order by seq desc) = 1""",
    "aligned": """
  select g.id, g.gold, p.pred, p.score, g.gold_span, p.pred_span, g.context, p.parse_error,
         p.latency_ms from gold_pred g join last_pred p on g.id = p.id""",
    "examples": f"""
  select doc_id + 1 as line,
    case when doc_id % 50 = 7 then 'bad_' || doc_id when doc_id % 97 = 5 then 'trrag_5'
         else 'trrag_' || doc_id end as id,
    case when doc_id % 37 = 6 then 'Why' else 'What does document ' || doc_id || ' say?' end
      as question,
    text as context, text as answer, split_part(text, '.', 1) as claim,
    case when doc_id % 59 = 9 then 'maybe' else {_label_at('doc_id')} end as label,
    case when doc_id % 61 = 3 then 1.5e0 when doc_id % 17 = 4 then 0.18e0
         else {label_case(_label_at('doc_id'), 'typical')} end as hallucination_score,
    case when doc_id % 5 = 0 and doc_id % 35 <> 0 then 'none'
         else {pick(fv.ERROR_TYPES[:10], 'doc_id % 10')} end as error_type,
    case when doc_id % 45 = 3 then '  ' when doc_id % 5 in (0, 3) then split_part(text, '.', 1)
         else '' end as evidence_span,
    'Explanation of row ' || doc_id as explanation,
    {label_case(_label_at('doc_id'), 'default_decision')} as decision,
    case when doc_id % 53 = 2 then 'scraped' else 'synthetic' end as source_type,
    case when doc_id % 10 < 7 then 'train' when doc_id % 10 = 7 then 'validation' else 'test' end
      as split,
    (doc_id % 3)::int as claim_index,
    case when doc_id % 41 = 1 then 0 when doc_id % 43 = 2 then 1 else 3 end
      as claim_count_in_answer,
    case when doc_id % 19 <> 0 then {pick(fv.DOMAINS, 'doc_id % 9')} end as domain,
    case when doc_id % 4 = 0 then 'v2.0' else '' end as prompt_version
  from documents""",
    "span_records": f"""
  select doc_id, ' Question ' || doc_id as question, text as context,
         text as answer,
         case when doc_id % 3 = 0 then [{_SPAN('doc_id * 31 % n_chars')}, {_SPAN('doc_id * 57 % n_chars')}]
              else [{_SPAN('doc_id * 31 % n_chars')}] end as labels
  from (select *, case when doc_id % 2 = 0 then 'Evident Conflict'
                       else 'Evident Baseless Info' end as nm from documents where n_chars > 0)""",
    "sentence_rows": f"""
  select doc_id, part, i, lead + coalesce(sum(length(part)) over (partition by doc_id order by i
           rows between unbounded preceding and 1 preceding), 0) as off
  from (select doc_id, length(regexp_extract(text, '^[.!?]*')) as lead,
               unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) as part,
               generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]*'), 1) - 1 as i
        from documents)""",
    "sentence_spans": f"""
  select doc_id, i as sentence_index,
         (off + length(part) - length(regexp_replace(part, '^[{WS}]+', '')))::bigint as start,
         (off + length(part) - length(regexp_replace(part, '^[{WS}]+', ''))
            + length({strip('part')}))::bigint as "end",
         {strip('part')} as sentence
  from sentence_rows where {strip('part')} <> ''""",
    "raw_outputs": f"""
  select doc_id, case m
    when 0 then chr(10) || ' ' || {_JSON_HEAD} w {_JSON_TAIL} || '}}' || ' '
    when 1 then 'Answer: ' || {_JSON_HEAD} w {_JSON_TAIL} || '}}' || ' done }}'
    when 2 then '```json' || chr(10) || {_JSON_HEAD} w {_JSON_TAIL} || '}}' || chr(10) || '```'
    when 3 then {_JSON_HEAD} w {_JSON_TAIL}
    when 4 then 'I say ' || lab || ' because ' || w
    when 5 then '  ' || chr(10)
    when 6 then w || ' ' || {_JSON_HEAD} w {_JSON_TAIL}
                || ', "more": {{"a": {{"b": 1}}}}, "evidence_span": "x y"}}' || ' {{'
    else '> ' || {_JSON_HEAD} (w || ' }} ') {_JSON_TAIL} || '}}' end as raw
  from (select doc_id, doc_id % 8 as m, regexp_replace(text, '[^A-Za-z ]', '', 'g') as w,
               '0.' || (doc_id % 90 + 10) as sc,
               {pick([*fv.LABELS, 'unknown'], 'doc_id % 6')} as lab from documents)""",
    "guard_rows": f"""
  select doc_id,
    case when doc_id % 2 = 0 then split_part(text, '.', 1) else 'the is of qqqqq zzzzz wwwww' end
      as claim,
    text as context, {_label_at('doc_id')} as label,
    (doc_id * 17 % 101) / 100e0 as hallucination_score,
    case when doc_id % 3 = 0 then '' else 'none' end as error_type,
    case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then 'zzz qqq www vvv'
         when doc_id % 7 = 2 then null else split_part(text, '.', 2) end as evidence_span,
    case when doc_id % 4 = 0 then '' else 'Because.' end as explanation,
    doc_id % 11 = 0 as parse_error from documents""",
    "requests": """
  select event_id, ts, user_id, event_type,
    case event_type when 'purchase' then 'accept' when 'signup' then 'warn'
      when 'view' then 'warn' when 'click' then 'revise' when 'error' then 'insufficient_context'
      end as decision,
    least(value, 100e0) / 100e0 as hallucination_score,
    case when event_id % 3 = 0 then event_type in ('signup', 'view') end as is_correct
  from events""",
    "event_detections": f"""
  select *, {nli_policy('sup', 'con', 'sup')} as nli_decision from (
    select event_id, ts, context, answer, gold_label, mode,
      case when event_id % 13 <> 0 then label end as label, conf,
      case when event_id % 17 <> 0 then sup end as sup,
      case when event_id % 17 <> 0 then con end as con,
      case when event_id % 5 <> 0 then event_id % 10 < 3 end as any_contra,
      case when event_id % 5 <> 0 then event_id % 10 < 7 end as any_unsupp
    from (select event_id, ts, 'user ' || user_id || ' ' || props as context,
            case when event_id % 9 = 0 then 'of and so on. bilgi bulunmadi'
                 else event_type || '. Value ' || value end as answer,
            case when event_id % 2 = 0 then {pick([*fv.LABELS, 'odd'], 'event_id % 6')}
                 else '' end as gold_label,
            (['auto', 'auto', 'bert', 'nli'])[1 + event_id % 4] as mode,
            {score_columns('event_id')} from events))""",
}

_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def _needs(sql: str, done: list[str]) -> None:
    for name in dict.fromkeys(_NAMES.findall(sql)):
        if name not in done:
            _needs_inside(name, done)


def _needs_inside(name: str, done: list[str]) -> None:
    body = CTES[name]
    for other in dict.fromkeys(_NAMES.findall(body)):
        if other != name and other not in done:
            _needs_inside(other, done)
    if name not in done:
        done.append(name)


def with_views(sql: str, **extra: str) -> str:
    """Prefix a statement with the derived views it mentions (and ``extra`` ones)."""
    used: list[str] = []
    _needs(sql + " " + " ".join(extra.values()), used)
    parts = [f"{n} as ({CTES[n]})" for n in used] + [f"{n} as ({b})" for n, b in extra.items()]
    return f"with {', '.join(parts)}\n{sql}" if parts else sql

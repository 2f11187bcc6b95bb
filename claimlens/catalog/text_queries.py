"""Text, quality and restructuring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.catalog import lists as ls
from claimlens.catalog import sql as q
from claimlens.catalog import views as v
from claimlens.catalog.registry import query
from claimlens.functions import claims as cl
from claimlens.functions import context as cx
from claimlens.functions import text as t
from claimlens.functions.numbers import round_to
from claimlens.operators import quality
from claimlens.operators.metrics import any_hallucination
from claimlens.operators.alignment import label_sentences


def docs(spark, d, *cols):
    return v.table(spark, d, "documents").select("doc_id", *(cols or ("text",)))


def digest(c):
    """Fingerprint of a long result text."""
    return F.md5(c)


# --- normalisation -------------------------------------------------------------------------
@query("turkish_lower", f"select doc_id, md5({q.turkish_lower('text')}) as h from documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", digest(t.turkish_lower(F.col("text"))).alias("h"))


@query(
    "turkish_upper",
    f"""select doc_id, md5(replace(upper(translate(text, '{fv.TURKISH_LOWER_CHARS}',
        '{fv.TURKISH_UPPER_CHARS}')), 'ẞ', 'SS')) as h from documents""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", digest(t.turkish_upper(F.col("text"))).alias("h"))


@query(
    "normalize_text",
    f"""select doc_id, md5(n) as h, length(n) as n_chars from (select doc_id,
        regexp_replace({q.strip('nfc_normalize(text)')}, '[{q.WS}]+', ' ', 'g') as n
        from documents)""",
)
def _(spark, d):
    n = docs(spark, d).select("doc_id", t.normalize_text(F.col("text")).alias("n"))
    return n.select("doc_id", digest(F.col("n")).alias("h"), F.length("n").alias("n_chars"))


@query(
    "estimate_token_count",
    f"""select doc_id, {q.n_words('text')} as n_words,
        floor({q.n_words('text')} * 1.4e0)::int as n_tokens from documents""",
)
def _(spark, d):
    c = F.col("text")
    return docs(spark, d).select(
        "doc_id", t.word_count(c).alias("n_words"), t.estimate_tokens(c).alias("n_tokens")
    )


@query(
    "truncate_to_words",
    f"""select doc_id, case when len(w) <= 120 then text
        else array_to_string(w[1:120], ' ') || ' ...' end as cut
        from (select doc_id, text, {q.words('text')} as w from documents)""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", t.truncate_words(F.col("text"), 120).alias("cut"))


@query(
    "token_set",
    f"""select doc_id, len(a) as n_keywords, len(b) as n_index, len(c) as n_overlap,
        md5(array_to_string(list_sort(a), ' ')) as h
        from (select doc_id, {q.tokens('text', 4, ls.STOP)} as a, {q.tokens('text', 3)} as b,
              {q.tokens('text', 1)} as c from documents)""",
)
def _(spark, d):
    c = F.col("text")
    sets = docs(spark, d).select(
        "doc_id", t.token_set(c, 4, ls.STOP).alias("a"), t.token_set(c, 3).alias("b"),
        t.token_set(c).alias("c"),
    )
    # binary order of UTF-8 in both engines
    return sets.select(
        "doc_id", F.size("a").alias("n_keywords"), F.size("b").alias("n_index"),
        F.size("c").alias("n_overlap"),
        F.md5(F.array_join(F.array_sort("a"), " ")).alias("h"),
    )


def _qa_pairs(spark, d, value):
    return v.rag_qa(spark, d).select("qa_id", value.alias("value"))


@query(
    "keyword_overlap",
    q.with_views(f"""select qa_id, {q.rnd(q.share(q.tokens('answer', 4, ls.STOP),
        q.tokens('context', 4, ls.STOP)), 6)} as value from rag_qa"""),
)
def _(spark, d):
    a, c = F.col("answer"), F.col("context")
    return _qa_pairs(spark, d, round_to(t.keyword_overlap(a, c, 4, ls.STOP), 6))


@query(
    "token_overlap_ratio",
    q.with_views(f"""select qa_id, {q.rnd(q.share(q.tokens('question', 3),
        q.tokens('context', 3)), 6)} as value from rag_qa"""),
)
def _(spark, d):
    return _qa_pairs(
        spark, d, round_to(t.token_overlap_ratio(F.col("question"), F.col("context")), 6)
    )


def _plain(x: str) -> str:
    return f"list_distinct({q.words(f'lower({x})')})"


@query(
    "token_jaccard",
    q.with_views(f"""select qa_id, {q.rnd(q.jaccard(_plain('question'), _plain('answer')), 6)}
        as value from rag_qa"""),
)
def _(spark, d):
    return _qa_pairs(spark, d, round_to(t.token_jaccard(F.col("question"), F.col("answer")), 6))


def _turkish_tokens(x: str) -> str:
    return f"list_distinct({q.words(q.turkish_lower(x))})"


def token_f1_sql(p: str, g: str) -> str:
    a, b = _turkish_tokens(p), _turkish_tokens(g)
    score = q.rnd(q.ratio(f"2 * {q.shared(a, b)}", f"len({a}) + len({b})"), 4)
    return f"(case when len({a}) > 0 and len({b}) > 0 then {score} else 0e0 end)"


@query("token_f1", q.with_views(f"select qa_id, {token_f1_sql('answer', 'context')} as value from rag_qa"))
def _(spark, d):
    return _qa_pairs(spark, d, t.token_f1(F.col("answer"), F.col("context")))


def span_found_sql(span: str, ctx: str) -> str:
    return (f"coalesce(length({span}) > 0 and length({ctx}) > 0 and "
            f"contains({q.turkish_lower(ctx)}, {q.turkish_lower(q.strip(span))}), false)")


@query(
    "span_in_context",
    q.with_views(f"select id, {span_found_sql('pred_span', 'context')} as found from gold_pred"),
)
def _(spark, d):
    return v.gold_pred(spark, d).select(
        "id", t.span_in_context(F.col("pred_span"), F.col("context")).alias("found")
    )


_CAP = f"[{fv.CAPITALS}][{fv.SMALLS}{fv.CAPITALS}]+"


@query(
    "search_term",
    f"""select doc_id, coalesce(list_filter(m, lambda r: length(r) =
            list_max(list_transform(m, lambda z: length(z))))[1],
          array_to_string({q.words('text')}[1:3], ' ')) as term
        from (select doc_id, text,
              regexp_extract_all(text, '{_CAP}(?:[{q.WS}]+{_CAP})*') as m from documents)""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", t.search_term(F.col("text")).alias("term"))


# --- quality gates ------------------------------------------------------------------------------
@query(
    "filter_article",
    f"""select doc_id, {q.n_words('text')} >= 100
          and not regexp_matches(lower(text), '{'|'.join([*ls.STUBS, *ls.DISAMBIGUATION])}')
          and not {q.has_word('lower(text)', ls.TRANSLATED)} as ok from documents""",
)
def _(spark, d):
    ok = quality.article_ok(F.col("text"), 100, ls.STUBS, ls.DISAMBIGUATION, ls.TRANSLATED)
    return docs(spark, d).select("doc_id", ok.alias("ok"))


_PARAGRAPHS = f"""
  select doc_id, lang, generate_subscripts(ps, 1) - 1 as pos, unnest(ps) as paragraph from (
    select doc_id, lang, list_filter(list_transform(string_split(text, chr(10)),
             lambda p: {q.strip('p')}), lambda p: p <> '') as ps
    from documents where {q.n_words('text')} >= 100)"""
_GOOD_PARAGRAPHS = f"""select * from paras where {q.n_words('paragraph')} between 20 and 80
    and not starts_with(paragraph, '==') and not starts_with(paragraph, '*')"""


def good_paragraphs(spark, d):
    return quality.paragraph_window(docs(spark, d, "text", "lang"), "text", "\n", 100, 20, 80)


@query("paragraph_window", f"with paras as ({_PARAGRAPHS}) {_GOOD_PARAGRAPHS}")
def _(spark, d):
    return good_paragraphs(spark, d)


@query(
    "cap_paragraphs",
    f"""with paras as ({_PARAGRAPHS}), good as ({_GOOD_PARAGRAPHS}),
        a as (select *, row_number() over (partition by doc_id order by pos) as article_rank
              from good qualify article_rank <= 5)
        select *, row_number() over (partition by lang order by doc_id, pos) as domain_rank
        from a qualify domain_rank <= 60""",
)
def _(spark, d):
    return quality.cap_paragraphs(good_paragraphs(spark, d), "doc_id", "lang", 5, 60)


def _reason_sql(c: str) -> str:
    ends = "|".join(ls.ENDINGS)
    return f"""case when length({c}) < 15 then 'Length too short (' || length({c}) || ' chars)'
      when {q.n_words(c)} < 3 then 'Word count too low (' || {q.n_words(c)} || ' words)'
      when regexp_matches({c}, '(?i)(^|[^{q.WORD}])({ends})[{q.WS}]*$')
        then 'Claim ends with a fragment/conjunction/postposition'
      when not regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') then 'No alphanumeric characters' end"""


def lines(spark, d):
    """Text lines as raw claims."""
    return docs(spark, d, F.posexplode(F.split("text", "\n")).alias("pos", "claim"))


_LINES = """select doc_id, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as claim
            from (select doc_id, string_split(text, chr(10)) as ls from documents)"""


@query(
    "clean_claims",
    f"""select doc_id, pos, {_reason_sql(q.strip('claim'))} as filter_reason
        from ({_LINES})""",
)
def _(spark, d):
    marked = quality.with_claim_quality(lines(spark, d), "claim", ls.ENDINGS)
    return marked.select("doc_id", "pos", "filter_reason")


@query(
    "clean_claims_reasons",
    f"""select coalesce(regexp_replace({_reason_sql(q.strip('claim'))}, ' \\([0-9]+ \\w+\\)$', ''),
          'kept') as reason, count(*) as n from ({_LINES}) group by 1""",
)
def _(spark, d):
    return quality.reason_counts(lines(spark, d), "claim", ls.ENDINGS)


@query(
    "prose_only",
    """select event_id from events where not starts_with(ltrim(
         case when event_id % 3 = 0 then props else 'text ' || props end), '{')""",
)
def _(spark, d):
    i = F.col("event_id")
    rows = v.table(spark, d, "events").select(
        i, F.when(i % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("text "), "props"))
        .alias("context"),
    )
    return quality.prose_only(rows).select("event_id")


@query(
    "admit_requests",
    q.with_views("""select qa_id, case when length(c) < 5 then 'context too short'
          when length(qn) < 3 then 'question too short'
          when length(a) < 3 then 'answer too short' end as reason_classifier,
        case when length(c) < 5 then 'context too short'
          when length(a) < 3 then 'answer too short' end as reason_nli
        from (select qa_id, case when qa_id % 5 = 0 then substr(context, 1, 4) else context end c,
                case when qa_id % 3 = 0 then substr(question, 1, 2) else question end qn,
                case when qa_id % 7 = 0 then '' else answer end a from rag_qa)"""),
)
def _(spark, d):
    i = F.col("qa_id")
    rows = v.rag_qa(spark, d).withColumns(
        {
            "context": F.when(i % 5 == 0, F.substring("context", 1, 4)).otherwise(F.col("context")),
            "question": F.when(i % 3 == 0, F.substring("question", 1, 2)).otherwise(
                F.col("question")
            ),
            "answer": F.when(i % 7 == 0, F.lit("")).otherwise(F.col("answer")),
        }
    )
    cols = F.col("context"), F.col("question"), F.col("answer")
    return rows.select(
        "qa_id", quality.reject_reason(*cols).alias("reason_classifier"),
        quality.reject_reason(*cols, question_required=False).alias("reason_nli"),
    )


@query("split_filter", q.with_views("select line, id from examples where split = 'validation'"))
def _(spark, d):
    return quality.split_filter(v.examples(spark, d), "validation").select("line", "id")


# --- explode and restructure -----------------------------------------------------------------------
@query(
    "sentences_with_spans",
    q.with_views('select doc_id, start, "end", sentence from sentence_spans'),
)
def _(spark, d):
    spans = docs(spark, d, F.explode(cl.sentence_spans(F.col("text"))).alias("s"))
    return spans.select(
        "doc_id", F.col("s.start").cast("bigint").alias("start"),
        F.col("s.end").cast("bigint").alias("end"), F.col("s.sentence").alias("sentence"),
    )


@query(
    "sentences",
    f"""select doc_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as sentence
        from (select doc_id, {q.sentences('text')} as s from documents)""",
)
def _(spark, d):
    return docs(spark, d, F.posexplode(cl.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "extract_claims",
    f"""select doc_id, generate_subscripts(c, 1) - 1 as claim_index, unnest(c) as claim
        from (select doc_id, {q.extract_claims('text')} as c from documents)""",
)
def _(spark, d):
    found = cl.extract_claims(F.col("text"), **ls.CLAIM_LISTS)
    return docs(spark, d, F.posexplode(found).alias("claim_index", "claim"))


@query(
    "split_compound",
    f"""select doc_id, pos, len(p) as n_parts, p[1] as first_part from (
          select doc_id, pos, {q.split_compound('claim')} as p from ({_LINES}))""",
)
def _(spark, d):
    parts = cl.split_compound(F.col("claim"), ls.CONJ, ls.WEAK)
    rows = lines(spark, d).select("doc_id", "pos", parts.alias("p"))
    return rows.select(
        "doc_id", "pos", F.size("p").alias("n_parts"), F.get("p", F.lit(0)).alias("first_part")
    )


@query(
    "is_valid_claim",
    f"""select doc_id, pos, {q.is_valid_claim('sentence')} as ok from (
          select doc_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as sentence
          from (select doc_id, {q.sentences('text')} as s from documents))""",
)
def _(spark, d):
    rows = docs(spark, d, F.posexplode(cl.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select(
        "doc_id", "pos", cl.is_valid_claim(F.col("sentence"), ls.OPINION).alias("ok")
    )


@query("claim_fallback", q.with_views("select qa_id, claim_index, claim_count, claim from claims"))
def _(spark, d):
    return v.claims(spark, d)


@query(
    "first_sentence_claim",
    f"""select doc_id, case when length(h) < 10 then text else h end as claim from (
          select doc_id, text, {q.strip("string_split(text, '.')[1]")} as h from documents)""",
)
def _(spark, d):
    return docs(spark, d, cl.first_sentence_claim(F.col("text")).alias("claim"))


def _build_sql(arr: str) -> str:
    tag = (f"list_transform({arr}, lambda c, i: '[Kaynak ' || i || ']: ' || {q.strip('c')})")
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return (f"case when len({arr}) = 1 then {arr}[1] when len({arr}) > 1 then "
            f"array_to_string({tag}, {sep}) else '' end")


_CHUNKS = "select doc_id, string_split(text, chr(10)) as chunk_list from documents"
_BUILT = f"select doc_id, {_build_sql('chunk_list')} as context from ({_CHUNKS})"


@query("build_context", _BUILT)
def _(spark, d):
    return v.chunks(spark, d).select("doc_id", cx.build_context(F.col("chunks")).alias("context"))


@query(
    "parse_context_chunks",
    f"""select doc_id, generate_subscripts(p, 1) - 1 as pos, unnest(p) as chunk from (
          select doc_id, case when contains(context, {q.quote(fv.CHUNK_SEPARATOR)}) then
            list_filter(list_transform(string_split(context, {q.quote(fv.CHUNK_SEPARATOR)}),
              lambda x: regexp_replace({q.strip('x')}, '^\\[Kaynak [0-9]+\\]:[{q.WS}]*', '')),
              lambda x: x <> '') else [{q.strip('context')}] end as p from ({_BUILT}))""",
)
def _(spark, d):
    built = v.chunks(spark, d).select("doc_id", cx.build_context(F.col("chunks")).alias("c"))
    return built.select(
        "doc_id", F.posexplode(cx.parse_context(F.col("c"))).alias("pos", "chunk")
    )


@query(
    "source_index",
    """select doc_id, case when doc_id % 3 = 0 then null else doc_id % 12 - 1 end as source_index
       from documents""",
)
def _(spark, d):
    i = F.col("doc_id")
    tag = F.concat(F.lit(" [Kaynak "), (i % 12).cast("string"), F.lit("]: "))
    span = F.when(i % 3 == 0, F.col("text")).otherwise(F.concat(tag, F.col("text")))
    return docs(spark, d, cx.source_index(span).cast("bigint").alias("source_index"))


_FIT = f"""with recursive sized as (
    select doc_id, chunk_list, list_transform(chunk_list, lambda c:
             floor({q.n_words('c')} * 1.4e0)::int) as sizes,
           60 + (doc_id % 90)::int - floor({q.n_words("split_part(text, '.', 1)")} * 1.4e0)::int
             - floor({q.n_words("split_part(text, '.', 2)")} * 1.4e0)::int as room
    from (select doc_id, text, string_split(text, chr(10)) as chunk_list from documents)),
  walk as (
    select doc_id, 0 as i, room as free, []::int[] as kept from sized
    union all
    select w.doc_id, i + 1, case when sizes[i + 1] <= free then free - sizes[i + 1] else free end,
           case when sizes[i + 1] <= free then list_append(kept, i) else kept end
    from walk w join sized s using (doc_id) where i < len(sizes)),
  chosen as (
    select s.doc_id, chunk_list, room, case when room <= 0 or len(kept) = 0 then [0] else kept end as kept
    from sized s join walk w on s.doc_id = w.doc_id and w.i = len(s.sizes))
  select doc_id, {_build_sql('list_transform(kept, lambda k: chunk_list[k + 1])')} as context,
         room <= 0 or len(kept) < len(chunk_list) as was_truncated, len(chunk_list) as original_chunk_count,
         len(kept) as remaining_chunk_count,
         array_to_string(list_filter(range(len(chunk_list)),
           lambda k: not list_contains(kept, k::int)), ',') as removed
  from chosen"""


@query("truncate_context", _FIT)
def _(spark, d):
    i = F.col("doc_id")
    rows = docs(spark, d, "text", F.split("text", "\n").alias("chunks"))
    fitted = rows.select(
        "doc_id",
        cx.fit_chunks(
            F.col("chunks"), (60 + i % 90).cast("int"), v.sentence(1),
            v.sentence(2), F.lit(""),
        ).alias("r"),
    )
    return fitted.select(
        "doc_id", "r.context", "r.was_truncated", "r.original_chunk_count",
        "r.remaining_chunk_count",
        F.array_join(F.col("r.removed_chunk_indices").cast("array<string>"), ",").alias("removed"),
    )


_SENTENCE_LABELS = """
    select s.doc_id, s.start, s."end", s.sentence as claim,
      case when hit is null then 'supported' when hit = 'Evident Conflict' then 'contradicted'
           else 'neutral' end as label
    from (select sp.*, list_filter(labels, lambda z: greatest(sp.start, z.start) <
                   least(sp."end", z."end"))[1].label as hit
          from sentence_spans sp join span_records r on sp.doc_id = r.doc_id) s"""


@query("label_by_span_overlap", q.with_views(_SENTENCE_LABELS))
def _(spark, d):
    rows = label_sentences(v.span_records(spark, d).select("doc_id", "answer", "labels"),
                           "answer", "labels")
    # two result columns share a name: "labels" holds spans, "label" the sentence label
    return rows.select(
        "doc_id", F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), "claim", "label",
    )


@query(
    "nli_dataset",
    q.with_views(
        f"""select {q.strip('question')} as question, {q.strip('context')} as context,
              l.claim, l.label from lab l join span_records using (doc_id)""",
        lab=_SENTENCE_LABELS,
    ),
)
def _(spark, d):
    from claimlens.operators.alignment import nli_dataset

    return nli_dataset(v.span_records(spark, d))


@query(
    "any_hallucination",
    q.with_views(
        """select doc_id, case when bool_or(label in ('neutral', 'contradicted'))
             then 'unsupported' else 'supported' end as label from lab group by doc_id""",
        lab=_SENTENCE_LABELS,
    ),
)
def _(spark, d):
    rows = label_sentences(v.span_records(spark, d).select("doc_id", "answer", "labels"),
                           "answer", "labels")
    return any_hallucination(rows.select("doc_id", "label"), "doc_id")

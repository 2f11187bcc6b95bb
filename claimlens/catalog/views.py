"""Derived input views, as DataFrames over a folder of parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.catalog.lists import CLAIM_LISTS
from claimlens.functions.arrays import literal_array
from claimlens.functions.scores import nli_policy
from claimlens.plans.verify import with_claims
from claimlens.session import INPUT_PARTITIONS

Spark = SparkSession


def table(spark: Spark, d: str, name: str) -> DataFrame:
    """A table of the folder, dealt out anew only where the caller has set a number of partitions."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    many = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(many)) if many else df


def sentence(n: int, text: str = "text") -> Column:
    """n-th stretch of a text between full stops."""
    return F.split_part(F.col(text), F.lit("."), F.lit(n))


def pick(values, at: Column) -> Column:
    return F.get(literal_array(values), at.cast("int"))


def rag_qa(spark: Spark, d: str) -> DataFrame:
    """Assistant turns that answer a user turn.

    Turns are numbered without gaps, so the previous turn is an equi-join: unlike a window
    per conversation it spreads one giant conversation over all tasks.
    """
    conv, docs = table(spark, d, "conversations"), table(spark, d, "documents")
    asked = conv.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answered = conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    n = docs.agg(F.count("*").alias("n")).scalar()
    pairs = asked.join(answered, ["conv_id", "turn"]).withColumn(
        "doc_id", F.pmod(F.col("conv_id") * 7 + F.col("turn"), n)
    )
    odd = F.col("conv_id") % 2 == 1
    return pairs.join(docs.select("doc_id", "text"), "doc_id").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("qa_id"), "conv_id", "turn", "question",
        "answer",
        F.when(odd, F.col("text")).otherwise(F.concat_ws(" ", "answer", "text")).alias("context"),
    )


def claims(spark: Spark, d: str) -> DataFrame:
    # never empty; the plain explode would add a filter that extracts everything twice
    rows = with_claims(rag_qa(spark, d), **CLAIM_LISTS)
    return rows.select(
        "qa_id", F.size("claims").alias("claim_count"),
        F.posexplode_outer("claims").alias("claim_index", "claim"),
    )


def score_columns(key: Column) -> dict[str, Column]:
    """sup, con, label, conf derived from an id."""
    a, b = F.pmod(key * 37, F.lit(101)), F.pmod(key * 53, F.lit(101))
    return {
        "sup": a / F.lit(100e0),
        "con": F.when(F.pmod(key, F.lit(7)) == 0, F.lit(0.85)).otherwise(
            ((100 - a) * b) / F.lit(10000e0)
        ),
        "label": pick(fv.LABELS, F.pmod(key, F.lit(5))),
        "conf": (50 + F.pmod(key * 29, F.lit(51))) / F.lit(100e0),
    }


def scores(spark: Spark, d: str) -> DataFrame:
    return rag_qa(spark, d).select("qa_id").withColumns(score_columns(F.col("qa_id")))


def doc_scores(spark: Spark, d: str) -> DataFrame:
    """The same scores for every document."""
    return table(spark, d, "documents").select("doc_id").withColumns(
        score_columns(F.col("doc_id"))
    )


def claim_scores(spark: Spark, d: str) -> DataFrame:
    """Scores per claim of an answer, with the policy decision (kw = sup)."""
    key = F.col("qa_id") * 31 + F.col("claim_index") * 17
    rows = claims(spark, d).withColumns(score_columns(key))
    return rows.withColumns(
        {
            "sup": F.when(F.pmod(F.col("qa_id"), F.lit(3)) == 0, F.lit(0.9)).otherwise(
                F.col("sup")
            ),
            "con": F.when(F.pmod(F.col("qa_id"), F.lit(3)) == 0, F.lit(0.05)).otherwise(
                F.col("con")
            ),
        }
    ).withColumn("decision", nli_policy(F.col("sup"), F.col("con"), F.col("sup")))


def verdicts(spark: Spark, d: str) -> DataFrame:
    """One verdict per claim, every label and some without a span."""
    key = F.col("qa_id") + F.col("claim_index") * F.col("qa_id") % 7
    label = pick(fv.LABELS, F.when(F.col("qa_id") % 4 == 0, F.lit(0)).otherwise(
        F.when(F.col("qa_id") % 4 == 1, F.lit(3)).otherwise(F.pmod(key, F.lit(5)))))
    return claims(spark, d).select(
        "qa_id", "claim_index", "claim", label.alias("label"),
        (F.pmod(key * 13, F.lit(101)) / F.lit(100e0)).alias("score"),
        F.when(F.pmod(key, F.lit(3)) == 0, F.col("claim")).otherwise("").alias(
            "evidence_span"
        ),
        pick(fv.DECISIONS, F.pmod(key, F.lit(6))).alias("decision"),
    )


def answer_verdicts(spark: Spark, d: str) -> DataFrame:
    """qa_id, answer and the verdict array; made inside the row, claim order kept."""
    key = F.col("qa_id")

    def verdict(c: Column, i: Column) -> Column:
        k = key + i * key % 7
        at = F.when(key % 4 == 0, F.lit(0)).when(key % 4 == 1, F.lit(3)).otherwise(
            F.pmod(k, F.lit(5))
        )
        return F.struct(
            c.alias("claim"), pick(fv.LABELS, at).alias("label"),
            (F.pmod(k * 13, F.lit(101)) / F.lit(100e0)).alias("score"),
            F.lit("none").alias("error_type"),
            F.when(F.pmod(k, F.lit(3)) == 0, c).otherwise("").alias(
                "evidence_span"
            ),
            F.lit("").alias("explanation"),
        )

    rows = with_claims(rag_qa(spark, d), **CLAIM_LISTS)
    return rows.select("qa_id", "answer", F.transform("claims", verdict).alias("verdicts"))


def logits(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")

    def logit(k: int, may_break: bool = False) -> Column:
        x = F.pmod(i * k, F.lit(101)) / F.lit(10e0) - F.lit(5e0)
        if may_break:
            x = F.when(i % 40 == 0, F.lit(float("nan"))).when(
                i % 40 == 1, F.lit(float("inf"))
            ).otherwise(x)
        return x

    return table(spark, d, "documents").select(
        "doc_id",
        F.array(logit(37, True), logit(53), logit(71)).alias("nli"),
        F.array(logit(37, True), logit(53), logit(71), logit(29), logit(17)).alias("cls"),
    )


def gold_pred(spark: Spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    gold_at = i % 5
    pred_at = F.when(i * 13 % 17 < 12, gold_at).otherwise(
        (i * 3 + F.coalesce("quality", F.lit(0)) + 1) % 5
    )
    gold_span = F.when(gold_at.isin(0, 3), sentence(1)).otherwise("")
    return rows.select(
        i.alias("id"), pick(fv.LABELS, gold_at).alias("gold"),
        pick(fv.LABELS, pred_at).alias("pred"), (i * 17 % 101 / F.lit(100e0)).alias("score"),
        gold_span.alias("gold_span"),
        F.when(i % 3 == 0, gold_span).when(i % 3 == 1, sentence(2))
        .otherwise("zzz").alias("pred_span"),
        F.col("text").alias("context"), (i % 23 == 0).alias("parse_error"),
        (i * 7 % 400 + 5).cast("double").alias("latency_ms"),
    )


def gold_records(spark: Spark, d: str) -> DataFrame:
    return gold_pred(spark, d).select("id", F.lit(1).alias("seq"), "gold", "gold_span", "context")


def pred_records(spark: Spark, d: str) -> DataFrame:
    """Predictions with gaps, strangers, repeats and changing key names."""
    base = gold_pred(spark, d)
    kept = base.where(F.col("id") % 11 != 0).withColumn("seq", F.lit(1))
    strangers = base.where(F.col("id") % 29 == 0).withColumns(
        {"id": F.col("id") + 1000000, "seq": F.lit(1)}
    )
    repeats = base.where(F.col("id") % 31 == 0).withColumns(
        {"seq": F.lit(2), "pred": F.lit("supported"), "score": F.lit(0.5)}
    )
    rows = kept.unionByName(strangers).unionByName(repeats)
    m = F.col("id") % 3
    span_json = F.to_json(F.struct(F.col("pred_span").alias("evidence_span")))
    return rows.select(
        "id", "seq",
        F.when(m == 0, F.col("pred")).alias("predicted_label"),
        F.when(m == 1, F.col("pred")).alias("pred_label"),
        F.when(m == 2, F.col("pred")).alias("label"),
        F.when(m == 0, F.col("score")).alias("confidence"),
        F.when(m == 1, F.col("score")).alias("pred_hallucination_score"),
        F.when((m == 2) & (F.col("id") % 2 == 0), F.col("score")).alias("hallucination_score"),
        F.when(m == 0, F.col("pred_span")).alias("pred_evidence_span"),
        F.when(m == 1, F.lit("")).alias("evidence_span"),
        F.when(m == 1, F.array("pred_span")).alias("evidence_spans"),
        F.when(m == 2, span_json).alias("raw_output"),
        "parse_error", "latency_ms",
    )


def examples(spark: Spark, d: str) -> DataFrame:
    return as_examples(table(spark, d, "documents"))


def as_examples(documents: DataFrame) -> DataFrame:
    """Documents as claim-level examples with planted faults; works on a stream, too."""
    i = F.col("doc_id")
    at = i % 5
    label = pick(fv.LABELS, at)
    typical = pick([str(r[3]) for r in fv.LABEL_ROWS], at).cast("double")
    score = F.when(i % 61 == 3, F.lit(1.5)).when(i % 17 == 4, F.lit(0.18)).otherwise(typical)
    wrong = pick(fv.ERROR_TYPES[:10], i % 10)
    span = F.when(i % 45 == 3, F.lit("  ")).when(
        at.isin(0, 3), sentence(1)
    ).otherwise("")
    count = F.when(i % 41 == 1, F.lit(0)).when(i % 43 == 2, F.lit(1)).otherwise(F.lit(3))
    number = i.cast("string")
    return documents.select(
        (i + 1).alias("line"),
        F.when(i % 50 == 7, F.concat(F.lit("bad_"), number))
        .when(i % 97 == 5, F.lit("trrag_5"))
        .otherwise(F.concat(F.lit("trrag_"), number)).alias("id"),
        F.when(i % 37 == 6, F.lit("Why")).otherwise(
            F.concat(F.lit("What does document "), number, F.lit(" say?"))
        ).alias("question"),
        F.col("text").alias("context"), F.col("text").alias("answer"),
        sentence(1).alias("claim"),
        F.when(i % 59 == 9, F.lit("maybe")).otherwise(label).alias("label"),
        score.alias("hallucination_score"),
        F.when((at == 0) & (i % 35 != 0), F.lit("none")).otherwise(wrong).alias("error_type"),
        span.alias("evidence_span"),
        F.concat(F.lit("Explanation of row "), number).alias("explanation"),
        pick([r[4] for r in fv.LABEL_ROWS], at).alias("decision"),
        F.when(i % 53 == 2, F.lit("scraped")).otherwise("synthetic").alias("source_type"),
        F.when(i % 10 < 7, F.lit("train")).when(i % 10 == 7, F.lit("validation"))
        .otherwise("test").alias("split"),
        (i % 3).cast("int").alias("claim_index"), count.alias("claim_count_in_answer"),
        F.when(i % 19 != 0, pick(fv.DOMAINS, i % 9)).alias("domain"),
        F.when(i % 4 == 0, F.lit("v2.0")).otherwise("").alias("prompt_version"),
    )


def span_records(spark: Spark, d: str) -> DataFrame:
    """Documents as span-labelled answers."""
    i, n = F.col("doc_id"), F.col("n_chars")
    name = F.when(i % 2 == 0, F.lit("Evident Conflict")).otherwise("Evident Baseless Info")

    def span(start: Column) -> Column:
        s = start.cast("int")
        return F.struct(s.alias("start"), (s + 40).alias("end"), name.alias("label"))

    one, two = span(i * 31 % n), span(i * 57 % n)
    return table(spark, d, "documents").where(n > 0).select(
        "doc_id", F.concat(F.lit(" Question "), i.cast("string")).alias("question"),
        F.col("text").alias("context"), F.col("text").alias("answer"),
        F.when(i % 3 == 0, F.array(one, two)).otherwise(F.array(one)).alias("labels"),
    )


def chunks(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("chunks"))


def raw_outputs(spark: Spark, d: str) -> DataFrame:
    """Model output texts in eight shapes, from clean JSON to blank."""
    i = F.col("doc_id")
    # what is kept, joined: taking the rest out one by one is many times slower
    words = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z ]+"), F.lit(0)), "")
    score = F.concat(F.lit("0."), (i % 90 + 10).cast("string"))
    label = pick([*fv.LABELS, "unknown"], i % 6)

    def obj(tail: Column | str, explanation: Column = words) -> Column:
        tail = F.lit(tail) if isinstance(tail, str) else tail
        return F.concat(
            F.lit('{"label": "'), label, F.lit('", "hallucination_score": '), score,
            F.lit(', "error_type": "'),
            pick(["none", "entity_error", "weird"], i % 3),
            F.lit('", "explanation": "'), explanation, F.lit('", "decision": "'),
            pick(["accept", "explode", "revise"], i % 7 % 3), F.lit('"'), tail,
        )

    clean = obj("}")
    nested = obj(', "more": {"a": {"b": 1}}, "evidence_span": "x y"}')
    braced = obj("}", F.concat(words, F.lit(" } ")))
    m = i % 8
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(m == 0, F.concat(F.lit("\n "), clean, F.lit(" ")))
        .when(m == 1, F.concat(F.lit("Answer: "), clean, F.lit(" done }")))
        .when(m == 2, F.concat(F.lit("```json\n"), clean, F.lit("\n```")))
        .when(m == 3, obj(""))
        .when(m == 4, F.concat(F.lit("I say "), label, F.lit(" because "), words))
        .when(m == 5, F.lit("  \n"))
        .when(m == 6, F.concat(words, F.lit(" "), nested, F.lit(" {")))
        .otherwise(F.concat(F.lit("> "), braced)).alias("raw"),
    )


def guard_rows(spark: Spark, d: str) -> DataFrame:
    """Verdict rows that trigger every guard."""
    i = F.col("doc_id")
    span = (
        F.when(i % 7 == 0, F.lit("")).when(i % 7 == 1, F.lit("zzz qqq www vvv"))
        .when(i % 7 == 2, F.lit(None).cast("string"))
        .otherwise(sentence(2))
    )
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(i % 2 == 0, sentence(1)).otherwise(
            F.lit("the is of qqqqq zzzzz wwwww")
        ).alias("claim"),
        F.col("text").alias("context"),
        pick(fv.LABELS, i % 5).alias("label"),
        (i * 17 % 101 / F.lit(100e0)).alias("hallucination_score"),
        F.when(i % 3 == 0, F.lit("")).otherwise("none").alias("error_type"),
        span.alias("evidence_span"),
        F.when(i % 4 == 0, F.lit("")).otherwise("Because.").alias("explanation"),
        (i % 11 == 0).alias("parse_error"),
    )


def requests(spark: Spark, d: str) -> DataFrame:
    """Batch form; the zone-less event time stays as it is."""
    return event_requests(table(spark, d, "events"), F.col("ts"))


def event_requests(events: DataFrame, ts: Column | None = None) -> DataFrame:
    """Events as decided requests; works on a stream, whose watermark needs a zoned time."""
    ts = F.col("ts").cast("timestamp") if ts is None else ts
    kinds = {"purchase": "accept", "signup": "warn", "view": "warn", "click": "revise",
             "error": "insufficient_context"}
    decision = F.lit(None).cast("string")
    for event_type, name in kinds.items():
        decision = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(decision)
    return events.select(
        "event_id", ts.alias("ts"), "user_id", "event_type",
        decision.alias("decision"),
        (F.least("value", F.lit(100e0)) / F.lit(100e0)).alias("hallucination_score"),
        F.when(F.col("event_id") % 3 == 0, decision == "warn").alias("is_correct"),
    )


def event_detections(events: DataFrame) -> DataFrame:
    """Events as raw detection requests with both scorers' results."""
    i = F.col("event_id")
    cols = score_columns(i)
    base = events.select(
        i, F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.col("props"))
        .alias("context"),
        F.when(i % 9 == 0, F.lit("of and so on. bilgi bulunmadi"))
        .otherwise(F.concat("event_type", F.lit(". Value "), F.col("value").cast("string")))
        .alias("answer"),
        F.when(i % 2 == 0, pick([*fv.LABELS, "odd"], i % 6)).otherwise("").alias("gold_label"),
        pick(["auto", "auto", "bert", "nli"], i % 4).alias("mode"),
    ).withColumns(cols)
    return base.withColumns(
        {
            "label": F.when(i % 13 != 0, F.col("label")),
            "sup": F.when(i % 17 != 0, F.col("sup")),
            "con": F.when(i % 17 != 0, F.col("con")),
            "any_contra": F.when(i % 5 != 0, i % 10 < 3),
            "any_unsupp": F.when(i % 5 != 0, i % 10 < 7),
        }
    ).withColumn(
        "nli_decision", nli_policy(F.col("sup"), F.col("con"), F.col("sup"))
    )

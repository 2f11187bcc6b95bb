"""Streaming queries: the given tables are read as streams and run to completion.

Results that a finished stream writes equal the batch form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.catalog import sql as q
from claimlens.catalog import views as v
from claimlens.catalog.dataset_queries import _CHECKED
from claimlens.catalog.decision_queries import DETECT_COLUMNS, DETECT_SQL
from claimlens.catalog.registry import query
from claimlens.session import work_dir
from claimlens.streaming import late as lt
from claimlens.streaming import late_scores as ls
from claimlens.streaming import requests as st

ROUNDS = 8
LATE = "7 days"


def stream(spark, d, name):
    """One table of the folder as a file stream, be it a file or a folder of files.

    A stream's path must be a folder or a pattern; this pattern matches the table's own name only.
    """
    schema = v.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def run(spark, df, name):
    out = work_dir(spark, name)
    st.run_to_table(df, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


@query("stream_detect", q.with_views(DETECT_SQL))
def _(spark, d):
    found = st.stream_detect(v.event_detections(stream(spark, d, "events")))
    return run(spark, found.select(*DETECT_COLUMNS), "detect")


def answers_in_time(rows, seconds, columns, came):
    """Answers of one scorer: withheld where ``came`` does not hold, ``seconds`` after the request."""
    at = F.timestamp_micros(F.unix_micros("ts") + seconds.cast("long") * 1_000_000)
    return rows.where(came).select("event_id", at.alias("answered"), *columns)


@query("stream_detect_late_scores", q.with_views(DETECT_SQL.replace("event_detections", "timed"), timed="""
  select * replace (case when event_id % 11 <> 0 then label end as label,
    case when event_id % 7 <> 0 then sup end as sup, case when event_id % 7 <> 0 then con end as con,
    case when event_id % 17 <> 0 and event_id % 7 <> 0 then any_contra end as any_contra,
    case when event_id % 17 <> 0 and event_id % 7 <> 0 then any_unsupp end as any_unsupp)
  from event_detections"""))
def _(spark, d):
    """Three streams in three rounds: the earlier half by time, the later half, and an end of the streams.

    The classifier answers after 5 s, exactly at the limit of 40 s, or after 60 s; the entailment model
    after 20 s or 50 s; some answers never come.
    """
    out = work_dir(spark, "late-scores")
    rows, i = v.event_detections(v.table(spark, d, "events")), F.col("event_id")
    delay = F.when(i % 11 == 0, 60).when(i % 11 == 1, 40).otherwise(5)
    sent = {
        "requests": (rows.select("event_id", "ts", "context", "answer", "gold_label", "mode"), "ts"),
        "classifier": (answers_in_time(rows, delay, ls.CLASSIFIER, F.col("label").isNotNull()), "answered"),
        "entailment": (answers_in_time(rows, F.when(i % 7 == 0, 50).otherwise(20), ls.ENTAILMENT,
                                       F.col("sup").isNotNull()), "answered"),
    }
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        F.timestamp_micros(F.expr("(unix_micros(lo) + unix_micros(hi)) div 2")).alias("mid"),
        (F.col("hi") + F.expr("interval 1 day")).alias("end"))
    middle = ends.select("mid").scalar()
    for k in range(3):
        streams = []
        for name, (df, at) in sent.items():
            # the end is a row one day later that meets no other: it moves the watermark past all bounds
            marks = {at: F.col("end"), "event_id": F.lit(-1 - len(streams))}
            last = ends.select(*[marks.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
            part = [df.where(F.col(at) < middle), df.where(F.col(at) >= middle), last][k]
            part.write.mode("append").parquet(f"{out}/{name}")
            streams.append(spark.readStream.schema(df.schema).parquet(f"{out}/{name}"))
        st.run_to_table(ls.stream_detect_with_scores(*streams), f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select(*DETECT_COLUMNS)


_WINDOWS = q.with_views(
    f"""select date_trunc('day', ts) as window_start, decision, count(*) as n,
        {q.rnd(q.mean('hallucination_score'), 6)} as avg_score,
        max(hallucination_score) as max_score, count(is_correct) as n_with_gold,
        count(*) filter (is_correct) as n_correct from requests group by 1, 2""")


def tidy(rows):
    return rows.withColumn("avg_score", F.floor(F.col("avg_score") * 1e6 + 0.5) / 1e6).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query("window_summary", _WINDOWS)
def _(spark, d):
    return tidy(st.stream_summary(v.requests(spark, d)))


# Events arrive in rounds by event time; every sixteenth comes two rounds after its time.
_ARRIVALS = {
    "arrivals": """select *, ((epoch_us(ts) - lo) * 5) // (hi - lo + 1)
      + case when event_id % 16 = 0 then 2 else 0 end as round
      from requests, (select epoch_us(min(ts)) as lo, epoch_us(max(ts)) as hi from events)""",
    "marks": """select round, max(max(ts)) over (order by round rows between unbounded preceding and 1 preceding)
      - interval 7 day as mark from arrivals group by round""",
    "judged": """select a.*, coalesce(ts < mark, false) as is_late from arrivals a join marks using (round)""",
}


def arrivals(spark, d):
    """Events with the round they arrive in."""
    events = st.with_event_time(v.table(spark, d, "events"))
    at = F.unix_micros("ts")
    ends = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    delay = F.when(F.col("event_id") % 16 == 0, F.lit(2)).otherwise(F.lit(0))
    return events.withColumn("round", F.expr(f"(unix_micros(ts) - {lo}L) * 5 div {hi - lo + 1}L") + delay)


def in_rounds(spark, rows, out, job):
    """Write the rows round by round; after each the stream goes on from its checkpoint with the new files."""
    for k in range(ROUNDS):
        rows.where(F.col("round") == k).drop("round").write.mode("append").parquet(f"{out}/in")
        files = spark.readStream.schema(rows.drop("round").schema).parquet(f"{out}/in")
        found = job(files)
    return found


@query("stream_summary", q.with_views(
    f"""select date_trunc('day', ts) as window_start, decision, count(*) as n,
        count(*) filter (is_late) as n_late,
        {q.rnd(q.mean('hallucination_score'), 6)} as avg_score,
        max(hallucination_score) as max_score, count(is_correct) as n_with_gold,
        count(*) filter (is_correct) as n_correct from judged group by 1, 2""", **_ARRIVALS))
def _(spark, d):
    out = work_dir(spark, "summary")
    rows = in_rounds(spark, arrivals(spark, d), out, lambda files: lt.run_windows(
        v.event_requests(files), f"{out}/table", f"{out}/checkpoint", late=LATE))
    return tidy(rows.drop("p50", "p95"))


@query("stream_percentiles", q.with_views(
    """select date_trunc('day', ts) as window_start, decision, count(*) as n, true as p50_within,
        true as p95_within from requests group by 1, 2"""))
def _(spark, d):
    """Whether the quantiles of merged sketches have the rank they should, within the stated error."""
    out = work_dir(spark, "percentiles")
    shares = {"p50": 0.5, "p95": 0.95}
    rows = in_rounds(spark, arrivals(spark, d), out, lambda files: lt.run_windows(
        v.event_requests(files), f"{out}/table", f"{out}/checkpoint", late=LATE, shares=shares))
    all_rows = v.event_requests(st.with_event_time(v.table(spark, d, "events"))).withColumn(
        "window_start", F.window("ts", "1 day")["start"])
    both = all_rows.join(rows.select("window_start", "decision", *shares), ["window_start", "decision"])
    x = F.col("hallucination_score")
    within = [((F.avg((x < F.col(name)).cast("int")) - lt.RANK_ERROR <= p)
               & (F.avg((x <= F.col(name)).cast("int")) + lt.RANK_ERROR >= p)).alias(f"{name}_within")
              for name, p in shares.items()]
    checked = both.groupBy("window_start", "decision").agg(F.count("*").alias("n"), *within)
    return checked.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_dedupe", """with copies as (select event_id, user_id, ts, copy,
    ((epoch_us(ts) - lo) * 5) // (hi - lo + 1) + case when event_id % 16 = 0 then 2 else 0 end
      + case when event_id % 4 = 0 then copy else 0 end as round
  from events, (select epoch_us(min(ts)) as lo, epoch_us(max(ts)) as hi from events), (values (0), (1)) t(copy)),
  marks as (select round, max(max(ts)) over (order by round rows between unbounded preceding and 1 preceding)
    - interval 7 day as mark from copies group by round),
  judged as (select c.*, coalesce(ts < mark, false) as is_late from copies c join marks using (round))
  select event_id, user_id, 'kept' as outcome from judged where not is_late group by 1, 2
  union all select event_id, user_id, 'late' from judged where is_late""")
def _(spark, d):
    out = work_dir(spark, "dedupe")
    twice = arrivals(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "round", F.col("round") + F.when(F.col("event_id") % 4 == 0, F.col("copy")).otherwise(0))
    rows = in_rounds(spark, twice.drop("copy"), out, lambda files: lt.run_dedupe(
        files, f"{out}/table", f"{out}/checkpoint", "event_id", late=LATE))
    return rows.select("event_id", "user_id", "outcome")


@query(
    "stream_validate",
    q.with_views("""select line, len(errs) as n_errors from checked""", checked=_CHECKED),
)
def _(spark, d):
    out = work_dir(spark, "validate")
    docs = stream(spark, d, "documents")
    examples = v.as_examples(docs)
    query_ = st.stream_validate(examples, f"{out}/good", f"{out}/bad", f"{out}/checkpoint")
    query_.awaitTermination()
    good = spark.read.parquet(f"{out}/good").select("line", F.lit(0).alias("n_errors"))
    bad = spark.read.parquet(f"{out}/bad").select("line", F.size("errors").alias("n_errors"))
    return good.unionByName(bad)

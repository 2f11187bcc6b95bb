"""Late rows of streams: nothing vanishes, corrections count once, files come one by one."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from claimlens.session import work_dir
from claimlens.streaming import late as lt

DAY = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, ts timestamp, decision string, hallucination_score double, is_correct boolean"


def row(i, hours, score=0.5):
    ts = None if hours is None else DAY + dt.timedelta(hours=hours)
    return (i, ts, "accept" if (i or 0) % 2 else "warn", score, (i or 0) % 3 == 0)


FILES = [
    [row(1, 1), row(2, 30, 0.25), row(2, 30, 0.25)],
    [row(3, 2), row(4, 29.5), row(1, 1), row(5, None)],
    [row(6, 60, 0.75), row(2, 30.5), row(7, 3)],
    [row(8, 59.5), row(6, 60), row(9, 10), row(9, 10), row(10, 61), row(None, 61), row(None, 61)],
]


@pytest.fixture
def arriving(spark):
    """The files as a stream that takes one file a batch, and the number of its rows."""
    folder = work_dir(spark, "arriving")
    for rows in FILES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return (lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder),
            sum(map(len, FILES)))


def lines(spark, path):
    return {r.batch: r for r in lt.book(spark, path).collect()}


def test_dedupe_accounts_for_every_row(spark, arriving):
    stream, n = arriving
    out = work_dir(spark, "dedupe")
    got = lt.run_dedupe(stream(), out, f"{out}/checkpoint", late="1 hour").collect()
    outcome = lambda kind: sorted((r.id for r in got if r.outcome == kind), key=lambda i: (i is None, i or 0))
    assert outcome("kept") == [1, 2, 4, 6, 8, 10, None]
    # behind the watermark of its batch, or without event time
    assert outcome("late") == [1, 3, 5, 7, 9, 9]
    book = lines(spark, out)
    assert sorted(book) == [0, 1, 2, 3] and sum(r.n_in for r in book.values()) == n
    assert all(r.n_in >= r.n_kept + r.n_late for r in book.values())
    assert sum(r.n_in - r.n_kept - r.n_late for r in book.values()) == n - len(got)
    assert book[0].mark is None and book[1].mark == book[0].next_mark
    # what is there already is not read again
    assert len(lt.run_dedupe(stream(), out, f"{out}/checkpoint", late="1 hour").collect()) == len(got)


def test_late_rows_correct_their_window_once(spark, arriving):
    stream, n = arriving
    out = work_dir(spark, "windows")
    rows = lt.run_windows(stream(), out, f"{out}/checkpoint", late="1 hour").collect()
    every = [r for f in FILES for r in f if r[1] is not None]
    assert sum(r.n for r in rows) == len(every)
    assert sum(r.n_late for r in rows) == 5
    scores = sorted(r[3] for r in every if r[2] == "warn" and 24 <= (r[1] - DAY).total_seconds() / 3600 < 48)
    window = [r for r in rows if r.decision == "warn" and r.n == len(scores) and r.max_score == max(scores)]
    assert any(abs(r.avg_score - sum(scores) / len(scores)) < 1e-9 for r in window)
    # a batch that is repeated replaces its part
    again = spark.read.parquet(f"{out}/parts").where("batch = 3").drop("batch").collect()
    spark.createDataFrame(again, spark.read.parquet(f"{out}/parts").drop("batch").schema).write.mode(
        "overwrite").parquet(f"{out}/parts/batch=3")
    merged = lt.merged(spark.read.parquet(f"{out}/parts"), ("decision",), {"p50": 0.5}).collect()
    assert sorted((r.window_start, r.decision, r.n) for r in merged) == sorted(
        (r.window_start, r.decision, r.n) for r in rows)


def test_merged_sketches_keep_their_rank_error(spark):
    rows = spark.range(60_000).select(
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.lit("d").alias("decision"),
        F.pow(F.rand(3), 4).alias("hallucination_score"), F.lit(True).alias("is_correct"),
        (F.col("id") % 7).alias("batch")).persist()
    parts = None
    for k in range(7):
        own = lt.window_parts(rows.where(F.col("batch") == k), F.lit(False), "ts", "1 day", None, ("decision",),
                              "hallucination_score")
        parts = own if parts is None else parts.union(own)
    got = lt.merged(parts, ("decision",), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        rank = rows.where(F.col("hallucination_score") <= got[name]).count() / 60_000
        assert abs(rank - p) <= lt.RANK_ERROR
    rows.unpersist()


def test_no_rows_and_no_values(spark):
    folder, out = work_dir(spark, "none"), work_dir(spark, "none")
    spark.createDataFrame([(1, DAY, "warn", None, None)], SCHEMA).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    one = lt.run_windows(stream, out, f"{out}/checkpoint").collect()
    assert [(r.n, r.avg_score, r.max_score, r.p50, r.n_with_gold) for r in one] == [(1, None, None, None, 0)]

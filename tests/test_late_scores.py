"""Requests and both scorers' answers as three streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from claimlens.session import work_dir
from claimlens.streaming import late_scores as ls
from claimlens.streaming import requests as st

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
REQUEST = "event_id long, ts timestamp, context string, answer string, gold_label string, mode string"
CLASSIFIER = "event_id long, answered timestamp, label string, conf double"
ENTAILMENT = ("event_id long, answered timestamp, sup double, con double, nli_decision string, any_contra boolean, "
              "any_unsupp boolean")


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


REQUESTS = [(i, at(10 * i), "some context here", "an answer", "supported", "auto") for i in range(6)]
REQUESTS += [(None, at(55), "some context here", "an answer", "", "auto")]
# 0: both; 1: classifier one second late; 2: at the limit; 3: before its request; 4: entailment only; 5: none
LABELS = [(0, at(1), "supported", 0.9), (1, at(51), "supported", 0.9), (2, at(60), "supported", 0.9),
          (3, at(29), "supported", 0.9), (9, at(30), "supported", 0.9)]
SUPPORT = [(i, at(10 * i + 2), 0.9, 0.0, "accept", None, None) for i in (0, 1, 2, 3, 4)]
WANT = {0: True, 1: False, 2: True, 3: False, 4: False, 5: False, None: False}


def frames(spark):
    return (spark.createDataFrame(REQUESTS, REQUEST), spark.createDataFrame(LABELS, CLASSIFIER),
            spark.createDataFrame(SUPPORT, ENTAILMENT))


def test_answers_count_up_to_the_limit(spark):
    got = {r.event_id: r for r in ls.stream_detect_with_scores(*frames(spark)).collect()}
    assert {i: r.label is not None for i, r in got.items()} == WANT
    assert got[1].source == "nli_fallback" and got[5].source == "error" and got[5].decision == "warn"


def test_streams_give_the_batch_rows(spark):
    out = work_dir(spark, "late-scores")
    batch = frames(spark)
    for low, high in ((0, 25), (25, 10 ** 6), (10 ** 6, 10 ** 7)):
        streams = []
        for name, df in zip(("r", "c", "e"), batch, strict=True):
            when = "ts" if name == "r" else "answered"
            part = df.where((F.col(when) >= F.lit(at(low))) & (F.col(when) < F.lit(at(high))))
            if low == 10 ** 6:
                # rows that meet no other move the watermark past all bounds
                marks = {when: at(low), "event_id": -1 - len(streams)}
                part = spark.createDataFrame([tuple(marks.get(c) for c in df.columns)], df.schema)
            part.write.mode("append").parquet(f"{out}/{name}")
            streams.append(spark.readStream.schema(df.schema).parquet(f"{out}/{name}"))
        st.run_to_table(ls.stream_detect_with_scores(*streams), f"{out}/t", f"{out}/ck")
    text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert text(spark.read.parquet(f"{out}/t")) == text(ls.stream_detect_with_scores(*batch))

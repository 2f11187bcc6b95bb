"""Whole contexts, line numbers, exact percentiles, one-pass cascades and request detection."""

from __future__ import annotations

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens import session
from claimlens.functions import context as cx
from claimlens.functions.arrays import running_sum
from claimlens.operators import alignment as al
from claimlens.operators import quality
from claimlens.operators.ranking import percentiles
from claimlens.operators.retrieval import retrieve_local
from claimlens.operators.scorers import cascade_with_scorer, with_scorer
from claimlens.operators.splits import generation_plan
from claimlens.plans.detect import detect_requests
from claimlens.plans.verify import verify_answers
from claimlens.session import clear_work, cut_lineage, work_dir
from claimlens.sources import jsonl
from claimlens.streaming import requests as st

CLAIM = "Quarterly revenue reached seventy million"


def test_evidence_behind_the_first_two_thousand_characters_counts(spark):
    context = "Nothing to see here at all. " * 200 + CLAIM + "."
    assert context.index(CLAIM) > 2000
    qa = spark.createDataFrame([("Why?", context, CLAIM + ".")], "question string, context string, answer string")
    row = verify_answers(qa).first()
    assert [x["label"] for x in row["verdicts"]] == ["supported"]
    cut = verify_answers(qa, max_chars=2000).first()
    assert [x["label"] for x in cut["verdicts"]] != ["supported"]
    found = retrieve_local(
        spark.createDataFrame([("c", CLAIM)], "claim_id string, claim string"),
        spark.createDataFrame([(1, context)], "doc_id int, text string")).first()
    assert CLAIM in found["context"]


def test_no_budget_left_counts_as_truncated(one):
    chunk = F.array(F.lit("only one"))
    got = one(cx.fit_chunks(chunk, F.lit(1), F.lit("a b c"), F.lit(""), F.lit("")))
    assert got["was_truncated"] and got["remaining_chunk_count"] == 1
    assert not one(cx.fit_chunks(chunk, F.lit(100), F.lit("a"), F.lit(""), F.lit("")))["was_truncated"]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300, 5000])
def test_running_sum(spark, n):
    values = list(range(n))
    row = spark.createDataFrame([(values,)], "a array<int>").select(running_sum(F.col("a")).alias("s")).first()
    assert row["s"] == [0, *np.cumsum(values)[:-1].tolist()] if n else row["s"] == []


def test_lines_are_numbered_per_file(spark):
    path = work_dir(spark, "numbered")
    lines = ['{"id": "a"}', "", '{"id": ', '{"id": "b"}']
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    rows = jsonl.read_jsonl(spark, path, jsonl.example_schema(), strict=False, numbered=True)
    good, broken = jsonl.split_corrupt(rows)
    assert sorted((r["line"], r["id"]) for r in good.collect()) == [(1, "a"), (4, "b")]
    assert [(r["line"], r["message"]) for r in broken.collect()] == [(3, '{"id": ')]


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    for values in ([rng.random() * 10 ** rng.randint(0, 6) for _ in range(999)], [5.0] * 40, [1.0], [1.0, 2.0]):
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double").repartition(3)
        got = percentiles(df, "x", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
        want = [np.percentile(values, 100 * p) for p in (0.5, 0.95, 0.0, 1.0)]
        assert [got[c] for c in "abcd"] == pytest.approx(want, rel=1e-12)
    assert percentiles(df.limit(0), "x", {"a": 0.5}).first()["a"] is None


def test_cascade_scores_open_rows_only(spark):
    def load():
        def score(frame: pd.DataFrame) -> pd.DataFrame:
            assert frame["answer"].notna().all()
            return pd.DataFrame({"label": ["seen"] * len(frame), "score": frame["answer"].str.len().astype(float)})

        return score

    rows = spark.createDataFrame(
        [(1, "supported", 0.9, "abc"), (2, "supported", 0.5, "abcd"), (3, "neutral", 0.9, "x"), (4, None, None, "yy")],
        "id int, stage1_label string, stage1_conf double, answer string")

    def second(df, only):
        out = with_scorer(df, load, ["answer"], "label string, score double", batch_rows=2, only=only)
        return out.withColumns({"label": F.col("scored.label"), "score": F.col("scored.score")})

    got = {r["id"]: (r["label"], r["score"], r["stage"]) for r in cascade_with_scorer(rows, second).collect()}
    assert got == {1: ("supported", 0.1, 1), 2: ("seen", 4.0, 2), 3: ("seen", 1.0, 2), 4: ("seen", 2.0, 2)}


def test_plan_ids_go_round_the_paragraphs(spark):
    paragraphs = spark.createDataFrame([(f"p{i}",) for i in range(7)], "paragraph_id string")
    rows = generation_plan(paragraphs, 20).collect()
    assert sorted(r["plan_id"] for r in rows) == list(range(20))
    by_id = {r["plan_id"]: r["paragraph_id"] for r in rows}
    assert all(by_id[i] == by_id[i + 7] for i in range(13))
    assert generation_plan(paragraphs.limit(0), 20).count() == 0


def test_limits_of_filters(spark):
    rows = spark.createDataFrame([(i, "train", i % 2, i) for i in range(30)], "id int, split string, domain int, pos int")
    first = {r["id"] for r in quality.split_filter(rows, "train", 5).collect()}
    assert len(first) == 5 and first == {r["id"] for r in quality.split_filter(rows.repartition(7), "train", 5).collect()}
    assert quality.cap_paragraphs(rows, "id", "domain", None, None).count() == 30
    assert quality.cap_paragraphs(rows, "id", "domain", 1, 4).count() == 8


def test_requests_are_admitted_scored_and_decided(spark):
    columns = "event_id int, context string, question string, answer string, claim string, gold_label string, mode string"
    rows = [(1, f"{CLAIM} last year.", "How much was it?", f"{CLAIM}.", "", "supported", "auto"),
            (2, "ctx", "How much was it?", f"{CLAIM}.", "", "", "auto"),
            (3, "Unrelated words only.", "How much was it?", f"{CLAIM}. Winters were cold.", None, "", "nli")]
    got = {r["event_id"]: r for r in detect_requests(spark.createDataFrame(rows, columns)).collect()}
    assert got[1]["decision"] == "accept" and got[1]["is_correct"] and not got[1]["any_unsupp"]
    assert got[2]["reject_reason"] == "context too short" and got[2]["decision"] is None
    assert got[3]["any_unsupp"] and got[3]["decision"] in fv.DECISIONS and got[3]["decision"] != "accept"


def test_claim_sets_of_a_long_answer(spark):
    gold = [f"alpha{i} beta{i} the and of gamma{i % 7}" for i in range(600)]
    extracted = [g.replace("the", "a") for g in gold[:300]] + ["something else entirely"]
    rows = spark.createDataFrame([(1, gold, extracted), (2, [], ["x"]), (3, ["x y"], [])],
                                 "k int, g array<string>, e array<string>")
    got = {r["k"]: tuple(r)[1:] for r in al.compare_claim_sets(rows, "k", F.col("g"), F.col("e")).collect()}
    assert got[1][3:] == (600, 301, 300) and got[1][1] == 0.5
    assert got[2] == (0.0, 0.0, 0.0, 0, 0, 0) and got[3] == (0.0, 0.0, 0.0, 1, 0, 0)


def test_short_claim_sets_stay_in_their_row(spark, monkeypatch):
    claims = ["the cat sat", "a dog sat here", "", "cat sat", "here sat a dog", None, "one two three four", "two three"]
    rows = [(i, [claims[(i * 3 + j) % 8] for j in range(i % 5)], [claims[(i + j * 5) % 8] for j in range(i % 4)])
            for i in range(40)] + [(40, None, ["x"]), (41, ["x"], None)]
    df = spark.createDataFrame(rows, "k int, g array<string>, e array<string>")
    written = []

    def keep(rows, purpose):
        written.append(cut_lineage(rows, purpose))
        return written[-1]

    monkeypatch.setattr(al, "cut_lineage", keep)
    got = {r["k"]: tuple(r)[1:] for r in al.compare_claim_sets(df, "k", F.col("g"), F.col("e")).collect()}
    assert "_lists" in written[0].columns and written[0].where("_lists IS NOT NULL").count() == 0
    spread = {r["k"]: tuple(r)[1:] for r in al.compare_claim_sets(df, "k", F.col("g"), F.col("e"), in_row=-1).collect()}
    assert written[1].where("_lists IS NULL").count() == 0
    assert got == spread and len(got) == 42 and got[40] == (0.0, 0.0, 0.0, 0, 0, 0)
    assert {m[5] for m in got.values()} >= {0, 1, 2}


def test_open_windows_are_kept_over_several_batches(spark):
    path, out = work_dir(spark, "events"), work_dir(spark, "windows")
    schema = "ts timestamp, decision string, hallucination_score double, is_correct boolean"
    for day in (1, 2, 3):
        rows = [(f"2024-01-0{d} 0{h}:00:00", "accept", 0.5, True) for d in (day,) for h in range(5)]
        df = spark.createDataFrame(rows, "t string, decision string, hallucination_score double, is_correct boolean")
        df.select(F.col("t").cast("timestamp").alias("ts"), *df.columns[1:]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = st.run_summary(st.stream_summary(stream), f"{out}/table", f"{out}/checkpoint")
    assert sorted((r["window_start"].day, r["n"]) for r in got.collect()) == [(1, 5), (2, 5), (3, 5)]


def test_work_folders_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    df = cut_lineage(spark.range(5), "short-lived")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 5
    clear_work(spark)
    assert not os.path.exists(folder)

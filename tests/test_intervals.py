"""Interval joins and order statistics that hold up on large or lopsided input."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import ranking
from claimlens.operators.alignment import first_overlaps, label_sentences, overlap_labels


@pytest.mark.parametrize("seed", range(4))
def test_first_overlaps_equal_brute_force(seed):
    rng = random.Random(seed)
    edges = sorted(rng.sample(range(2_000), 2 * rng.randrange(1, 150)))
    start, end = edges[::2], edges[1::2]
    spans = [(a, a + rng.choice([-1, 0, 1, 5, 200, 1500])) for a in (rng.randrange(-20, 2_050) for _ in range(rng.randrange(80)))]
    want = [next((k for k, (a, b) in enumerate(spans) if max(s, a) < min(e, b)), -1)
            for s, e in zip(start, end, strict=True)]
    got = first_overlaps(*(np.array(x, np.int64) for x in (start, end, [a for a, _ in spans], [b for _, b in spans])),
                         np.arange(len(spans)))
    assert got.tolist() == want


SPANS = "array<struct<start:int,end:int,label:string>>"


def brute(text_spans, sentences):
    rows = []
    for s, e in sentences:
        hit = next((x for x in text_spans if x is not None and max(s, x[0] or 0) < min(e, 10**9 if x[1] is None else x[1])), None)
        rows.append("supported" if hit is None else "contradicted" if hit[2] == "Evident Conflict" else "neutral")
    return rows


def test_label_sentences_odd_records(spark):
    text = "One here. Two there! Three? Four now. Five."
    records = [
        (1, text, []), (2, text, None), (3, None, [(0, 5, "x")]), (4, "", [(0, 5, "x")]),
        (5, text, [(0, 100, "Evident Conflict"), (0, 3, "other")]), (6, text, [(12, 11, "x"), (10, 11, "Evident Conflict")]),
        (7, text, [(None, 4, "x"), (30, None, "Evident Conflict")]), (8, text, [None, (22, 24, "y")]), (8, text, [(22, 24, "y")]),
    ]
    df = spark.createDataFrame(records, f"id int, answer string, labels {SPANS}").repartition(2)
    rows = label_sentences(df.withColumn("_s", F.lit("clash"))).collect()
    for i, _, spans in records:
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.sentence_index)
        if i == 8:
            own = own[::2]
        assert [r.label for r in own] == brute(spans or [], [(r.start, r.end) for r in own])
    assert sum(r.id == 8 for r in rows) == 10


def test_one_record_of_forty_thousand_ranges_and_spans(spark):
    n = 40_000
    rng = random.Random(2)
    spans = [(a, a + rng.choice([3, 40, 5_000]), "Evident Conflict" if k % 3 else "x")
             for k, a in enumerate(rng.randrange(12 * n) for _ in range(n))]
    df = spark.createDataFrame([(1, spans)], f"id int, labels {SPANS}").withColumn(
        "ranges", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(i * 12, i * 12 + 11)))).cache()
    df.count()
    began = time.monotonic()
    got = df.select(F.explode(overlap_labels(F.col("ranges"), F.col("labels"))).alias("label")).groupBy(
        "label").count().collect()
    assert time.monotonic() - began < 10
    assert sum(r["count"] for r in got) == n and len(got) >= 2
    df.unpersist()


@pytest.mark.parametrize("name, values", [
    ("outlier", [*np.linspace(5, 400, 3_000), 1e9]),
    ("signs", [*np.random.default_rng(1).normal(0, 1, 2_001), 0.0, -0.0, 1e-300, -1e300]),
    ("near", [*(1 + np.arange(5_000) * 2.0 ** -50), -1e9, 1e9]),
    ("ties", [7.0] * 500 + [8.0]), ("one", [3.5]), ("none", []),
])
def test_percentiles_whatever_the_values(spark, name, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "ms double").repartition(3)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = ranking.percentiles(df, "ms", shares).first()
    for k, p in shares.items():
        if values:
            assert got[k] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-300)
        else:
            assert got[k] is None


def test_outlier_leaves_slices_even(spark):
    values = spark.range(20_000).select((5 + F.rand(1) * 395).alias("x")).union(spark.range(1).select(F.lit(1e9)))
    sizes = values.groupBy(ranking._octave_slice(F.col("x")).alias("s")).count()
    assert sizes.agg(F.max("count")).first()[0] < 1_000

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import toxicity
from claimlens.llm.queries import QUERIES, unseen_label


def test_op11_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no table of that size")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    result = QUERIES["op11_toxicity"](spark, folder)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = result.join(labels, "doc_id").join(
        docs.select("doc_id", F.lower("text").rlike(r"\b(idiot|moron|scum|pathetic|worthless)\b").alias("insult")),
        "doc_id").where("held_out").collect()
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    insults = [r for r in rows if r.toxic == 1 and r.insult]
    assert insults and sum(r.predicted for r in insults) >= 0.9 * len(insults)
    every = result.collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    assert all(r.predicted == int(r.score >= 0.7) for r in every)


def test_op11_learns_only_from_rows_it_may(spark):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(400)]
    texts = [(i, " ".join([*rng.choice(made, 12), *["zorgl grumph"] * (i % 5 == 0)])) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(unseen_label(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = []
    for given in (labels, turned):
        classifier, _, voters = toxicity.fit(docs, given, ~unseen_label())
        assert len(voters.sets) > len(toxicity.LEXICONS)
        scores.append({r.doc_id: (round(r.score, 9), r.predicted) for r in toxicity.score(docs, classifier).collect()})
    assert scores[0] == scores[1]
    assert sum(p == int(i % 5 == 0) for i, (_, p) in scores[0].items()) >= 0.97 * len(texts)


def test_op11_odd_documents_no_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 0), (3, 1)], "doc_id long, toxic int")
    classifier, _, _ = toxicity.fit(odd_docs, labels, ~unseen_label())
    rows = toxicity.score(odd_docs, classifier).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0.5 for r in rows)
    classifier, _, _ = toxicity.fit(no_docs, labels.limit(0), ~unseen_label())
    assert toxicity.score(no_docs, classifier).collect() == []


def test_op11_label_model_finds_accuracies_and_followers(spark):
    rng = np.random.default_rng(5)
    toxic = rng.random(20_000) < 0.1
    speaks = [np.where(toxic, rng.random(20_000) < 0.6, rng.random(20_000) < e) for e in (0.001, 0.002, 0.004)]
    copy = speaks[0] & (rng.random(20_000) < 0.98)
    words = np.stack([*speaks, copy], 1)
    rest = np.zeros((20_000, len(toxicity.PATTERNS)), bool)
    rest[:, -1] = ~words.any(1)
    votes = np.concatenate((words, rest), 1).astype(np.uint8)
    kinds, n = np.unique(votes, axis=0, return_counts=True)
    table = spark.createDataFrame([(bytes(k), int(c)) for k, c in zip(kinds, n, strict=True)], "votes binary, n long")
    sets = [np.array([i], np.uint64) for i in range(4)]
    voters = toxicity.Voters(["a", "b", "c", "d"], sets, np.full(4, 0.9))
    model = toxicity.fit_labels(table, voters)
    assert {(int(model.follows[0]), int(model.follows[3]))} <= {(-1, 0), (3, -1)}
    assert abs(model.speaks[1, 0, 1] - 0.6) < 0.1 and model.speaks[0, 0, 1] < 0.02
    q = model.posterior(votes.astype(np.int64))
    assert np.mean((q >= 0.5) == toxic) > 0.95


def test_op11_voters_speak_where_they_should():
    sets = [toxicity.word_hashes("idiot moron")]
    voters = toxicity.Voters(["own"], sets, np.array([0.9]))
    texts = ["You are an IDIOT", "idiotic words", "moron", "", "SHOUTING TWENTY CAPITAL LETTERS", "no!! so *** it", "you"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = voters.votes(data, offsets)
    assert got[:, 0].tolist() == [1, 0, 1, 0, 0, 0, 0]
    assert got[:, 1].tolist() == [1, 0, 0, 0, 0, 0, 0]
    assert got[:, 2:].tolist() == [[0, 0, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1],
                                   [0, 1, 1, 1], [0, 0, 0, 1]]

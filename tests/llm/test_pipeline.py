"""The pipeline against brute-force forms of its stages, and its contract."""

from __future__ import annotations

import inspect

import corpus_pipeline
from claimlens.llm import language
from tests.llm.test_duplicates import brute_classes, brute_removed
from tests.llm.test_language_and_benchmark import brute_matches


def test_stages_are_named_functions_of_three():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeats", "benchmark", "bpe"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    found = language.predict(docs, language.fit(docs)).where(~language.rejected())
    rows = {r.doc_id: rows[r.doc_id] for r in found.collect()}
    order = sorted(rows.items())
    rows = {k: rows[k] for k in sorted({w[0] for w in brute_classes(order)})}
    gone = {k[0]: v for k, v in brute_removed(sorted(rows.items())).items()}
    stage = dict(corpus_pipeline.STAGES)
    some = docs.where(docs.doc_id.isin(list(rows)))
    left = {r.doc_id: r for r in stage["repeats"](spark, some, sf_dir).collect()}
    assert all(left[k].text == rows[k] and left[k].n_chars is not None for k in left if not gone[k][1])
    assert all(len(rows[k].encode()) - gone[k][1] - 8 * gone[k][2] <= len(left[k].text.encode())
               <= len(rows[k].encode()) - gone[k][1] for k in left if gone[k][1])
    assert set(rows) - set(left) <= {k for k in rows if gone[k][1] > len(rows[k].encode()) - 200}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {m[0] for m in brute_matches([(k, r.text) for k, r in left.items()], items) if not m[5]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean)


def test_stages_keep_the_columns_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    plain = odd_docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, plain, sf_dir)
        assert out.columns == plain.columns, name
        assert out.count() > 0
        assert stage(spark, plain.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, plain, sf_dir).count() == plain.count()

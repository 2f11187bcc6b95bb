from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimlens.llm import fill_in_middle
from claimlens.llm.fill_in_middle import Parser


def brute(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if n == 0 or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (key, n, "plain", None, None, sha(text), sha(text))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (key, n, form, len(p), len(m), sha(out), sha(text))


def expected(docs):
    return Counter(brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def found(result):
    return Counter(map(tuple, result.collect()))


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_op13_odd_documents(odd_docs, chunk):
    docs = odd_docs.where(F.coalesce(F.length("text"), F.lit(0)) < 50_000) if chunk == 1 else odd_docs
    assert found(fill_in_middle.fill_in_middle(docs, chunk=chunk)) == expected(docs)


def test_op13_markers_almost_in_texts(spark):
    texts = ["<", "<P", "P>", "<<S", "S>x<", "<P>in", "a<S>b", "<M", "<S<M<P", "M><P<S"]
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    for chunk in (1, 2, 5):
        assert found(fill_in_middle.fill_in_middle(docs, chunk=chunk)) == expected(docs)


def test_op13_copies_and_text_keys(spark):
    rows = [(None, "x" * 9)] * 5000 + [("k", "same text")] * 4500 + [("k", "other")] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    result = fill_in_middle.fill_in_middle(docs, with_text=True)
    assert all((r.restored == t) for r in result.where("doc_id = 'k'").limit(5).collect()
               for t in ["same text" if r.n == 9 else "other"])
    assert found(result.drop("restored")) == expected(docs)


def test_op13_empty_and_registered_query(spark, no_docs, sf_dir):
    from claimlens.llm.queries import QUERIES

    assert fill_in_middle.fill_in_middle(no_docs).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op13_fill_in_middle"](spark, sf_dir)
    assert found(got) == expected(docs)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_op13_pieces_spell_the_output(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [r for r in fill_in_middle.output_pieces(docs, chunk=64).collect() if r.place >= 0]
    assert [r.place for r in rows] == list(range(len(rows)))
    assert hashlib.sha256("".join(r.piece for r in rows).encode()).hexdigest() == brute(1, text)[5]
    assert max(len(r.piece) for r in rows) <= 64


def test_op13_parser_over_any_cut():
    out = "<S>suf<<P>pre<M<M>mid"
    for cut in range(len(out)):
        parser, parts = Parser("spm"), {0: "", 1: "", 2: ""}
        for piece in (out[:cut], out[cut:]):
            for part, text in parser.feed(piece):
                parts[part] += text
        assert parts == {2: "suf<", 0: "pre<M", 1: "mid"}

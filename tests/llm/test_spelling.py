from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimlens.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(rows, thin=31):
    """Every row of the result, from deletions and replacements of every word."""
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % thin == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1:]].add(w)
            if (short := w[:i] + w[i + 1:]) in n:
                near[w].add(short)
                near[short].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= own - {w}
    near = {w: own for w, own in near.items() if own}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x))
        if n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]) if w in near else 0, n[form[w]] if w in form else None)
            for w, c in n.items()}


def found(result):
    rows = result.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def edits(word, rng, n):
    for _ in range(n):
        i, c = rng.randrange(len(word) + 1), rng.choice("abcdeéß")
        yield rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


@pytest.mark.parametrize("block", [2, 3, 256])
@pytest.mark.parametrize("windows", [1, 4])
def test_op12_near_pairs_in_blocks_of_any_size(spark, block, windows):
    rng = random.Random(block)
    stems = ["aaaaaaaa", "abababab", "spelling", "variants", "Ünïcödéß", "x" * 300]
    words = sorted({e for s in stems for e in [s, *edits(s, rng, 60)]})
    table = spark.createDataFrame([(w, rng.randrange(1, 9)) for w in words], "word string, n long")
    got = Counter((r.word, r.near) for r in spelling.near_pairs(table, windows, block).collect())

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        return a != b and any(a[:i] + a[i + 1:] in (b, b[:i] + b[i + 1:] if len(a) == len(b) else b)
                              for i in range(len(a)))

    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and near(a, b)}
    assert set(got) == want and max(got.values()) == 1


def test_op12_forms_and_roots(spark):
    words = {"correction": 4000, "corection": 300, "corectin": 25, "corctin": 2, "otherword": 20, "otherwork": 2,
             "atherword": 20, "alonealone": 5, "onlyonce": 1}
    rows = [(i % 997, w) for w, k in words.items() for i in range(k)]
    random.Random(1).shuffle(rows)
    rows += [(None, None), (None, ""), (3, "short " * 40), (7, "CORRECTION Corectin×÷ naïveté-naïveté")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = found(spelling.variants(docs))
    assert got == brute(rows)
    assert got["corctin"][1] == "correction"


def test_op12_odd_documents_and_registered_query(spark, odd_docs, no_docs, sf_dir):
    from claimlens.llm.queries import QUERIES

    assert found(spelling.variants(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert spelling.variants(no_docs).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(QUERIES["op12_spelling_variants"](spark, sf_dir)) == brute(
        [(r.doc_id, r.text) for r in docs.collect()])


def test_op12_very_long_run(spark):
    long = "ab" * 1_500
    rows = [(1, long), (2, long), (3, long + "c"), (4, long + "c"), (5, "x" + long[1:])] * 2
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_op12_joins_broadcast_no_table(spark):
    def broadcasts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")

    words = spark.createDataFrame([("spelling", 20), ("speling", 2)], "word string, n long")
    assert not broadcasts(spelling.near_pairs(words))
    docs = spark.createDataFrame([(i, "spelling" if i % 11 else "speling") for i in range(40)], "doc_id long, text string")
    assert not broadcasts(spelling.variants(docs, thin=10**9))

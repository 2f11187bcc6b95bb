"""Repeated strings and near copies against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import numpy as np
import pytest

from claimlens.llm import ngram_join, queries, suffix_array, suffix_dedup
from claimlens.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_removed(docs, length=100):
    """(doc_id, text) -> (bytes, removed, spans, digest of what is kept)."""
    seen, out = set(), {}
    for key, text in docs:
        data = (text or "").encode()
        gone, own = bytearray(len(data)), set()
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen or w in own:
                gone[s:s + length] = b"\1" * length
            own.add(w)
        seen |= own
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key, text] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def in_order(rows):
    """Distinct documents in the operator's order, unless one id has several texts."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))


def brute_classes(docs, num=4, den=5):
    """[(doc_id, text)] -> [(class, links, shingles)] by index."""
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a):
                both[own[b], own[a]] += 1
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return [(docs[i][0] if not sets[i] else least[root(i)], links[i], len(sets[i])) for i in range(len(docs))]


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randint(0, 30), rng.choice([1, 2, 3, 5])
        text = [rng.randint(1, letters) for _ in range(n)]
        order = suffix_array.suffix_array(text)
        assert order == sorted(range(n), key=lambda i: text[i:])
        owner = [rng.randint(0, 4) for _ in range(n)]

        def shared(i, j):
            k = 0
            while max(i, j) + k < n and text[i + k] == text[j + k]:
                k += 1
            return k

        assert suffix_array.earlier_matches(text, owner) == [
            max((shared(i, j) for j in range(n) if owner[j] < owner[i]), default=0) for i in range(n)]


def test_earlier_matches_where_they_count():
    rng = random.Random(11)
    for many in (1, 2, 7, 40):
        text, owner, least = [], [], []
        for who in rng.sample(range(many), many):
            head, tail = ([rng.randint(1, 2) for _ in range(rng.randint(0, 6))] for _ in "ab")
            text += [*head, 1000 + rng.randint(0, 2), *tail, 0]
            owner += [who // 2] * (len(head) + len(tail) + 2)
            least += [*range(len(head) + 1, 0, -1)] + [0] * (len(tail) + 1)
        every, some = suffix_array.earlier_matches(text, owner), suffix_array.earlier_matches(text, owner, least)
        assert [x if least[i] and x >= least[i] else 0 for i, x in enumerate(every)] == some
    own, low = np.array([3, 3, 5, 4, 2, 9, 9]), np.array([0, 4, 7, 5, 6, 0, 8])
    assert suffix_array.nearest_smaller(own, low).tolist() == [0, 0, 7, 5, 0, 0, 0]


def test_op2_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {k[0]: v for k, v in brute_removed(docs).items()}
    assert {r[0]: tuple(r)[1:] for r in queries.op2(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("hot", [20_000, 1])
def test_op2_made_up_documents(spark, hot):
    rng = random.Random(hot)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 400))) for _ in range(12)]
    docs = []
    for i in range(80):
        text = "".join(rng.choice(base)[rng.randint(0, 30):][:rng.randint(1, 300)] for _ in range(rng.randint(0, 4)))
        docs.append((i, "ab" * rng.randint(1, 400) if rng.random() < 0.1 else text if rng.random() < 0.95 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(df, hot=hot).collect()}
    assert got == {k[0]: v for k, v in brute_removed(docs).items()}


def test_op2_odd_documents(odd_docs, no_docs):
    some = odd_docs.where("doc_id IS NULL AND text IS NOT NULL OR doc_id != 4")
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    want = brute_removed(in_order(rows))
    got = suffix_dedup.removed(some, keep=["doc_id", "text", "key"], with_text=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[3:7]) for r in got) == sorted(
        (a is None, a or 0, *want[a, b]) for a, b in rows)
    assert all(r.key == "clash" for r in got)
    repeated = suffix_dedup.removed(odd_docs.where("text = 'same row'")).collect()
    assert [r.n_removed for r in repeated] == [0, 0]
    assert suffix_dedup.removed(no_docs).count() == 0
    kept = suffix_dedup.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {2, 3, 4, 5, 8}
    assert kept.where("doc_id = 7").count() == 0


def test_op2_texts_of_one_id_are_spread():
    rows = np.full(4000, 7), np.arange(4000, dtype=np.uint16)
    assert np.bincount(suffix_dedup.spread(*rows, 8), minlength=8).min() > 400


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_common_counts_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    got = ngram_join.common(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60))


def test_bands_follow_the_recall():
    assert ngram_join.bands_for(0.8, 5, 0.99999) == 29
    assert 1 - (1 - 0.8 ** 5) ** 29 >= 0.99999


def test_op3_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r[0]: tuple(r)[1:] for r in queries.op3(spark, sf_dir).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute_classes(docs), strict=True)}


def test_op3_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    docs = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in ngram_join.join(df).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute_classes(docs), strict=True)}


@pytest.mark.parametrize("many", [2, 3])
def test_op3_more_blocks_than_nodes(spark, monkeypatch, many):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 60)
    docs = [(100 * g + i, " ".join([*(f"g{g}w{k}" for k in range(150)), f"x{i}"])) for g in range(8) for i in range(many)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in ngram_join.join(df).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute_classes(docs), strict=True)}


def test_op3_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = [(d[0], *w) for d, w in zip(rows, brute_classes(rows), strict=True)]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, ngram_join.join(odd_docs).collect()), key=order) == sorted(want, key=order)
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in kept.where("doc_id IN (1, 4, 5, 6, 7)").collect()]
    assert sorted(t[:5] for t in texts) == ["The q", "other", "same ", "word0"]
    assert ngram_join.join(no_docs).count() == 0 and ngram_join.one_of_each(no_docs).count() == 0


def test_op2_many_texts_of_one_id(spark):
    """Texts of one id are told apart by more than 16 bits: none loses what another repeats."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = ["".join(rng.choices(letters, k=150)) for _ in range(30)]
    texts = ["".join(rng.choices(letters, k=180)) for _ in range(2_500)]
    texts += [rng.choice(passage) + "".join(rng.choices(letters, k=60)) for _ in range(2_500)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(7)
    order = [r.text for r in docs.select("text", F.xxhash64("text").alias("h")).orderBy("h").collect()]
    want = brute_removed([(None, t) for t in order])
    got = suffix_dedup.removed(docs, keep=["text"]).collect()
    assert len(got) == len(texts)
    assert {(None, r.text): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want

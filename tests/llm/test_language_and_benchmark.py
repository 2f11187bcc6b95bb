"""Language ID by held-out accuracy, contamination and licences against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from claimlens.llm import decontaminate, language, licenses, queries
from tests.llm.test_duplicates import words


def brute_matches(docs, items, size=13):
    windows, sizes = defaultdict(set), set()
    for key, text in items:
        w = words(text)
        if w and key is not None:
            n = min(size, len(w))
            sizes.add(n)
            for i in range(len(w) - n + 1):
                windows[tuple(w[i:i + n])].add(str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def judged(found):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in found.select(
        "doc_id", "n_words", decontaminate.n_hit(), F.size("items"), F.sha2(F.array_join("items", ","), 256),
        decontaminate.contaminated()).collect()), key=str)


def test_op4_query(spark, sf_dir):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    want = brute_matches(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert sorted(map(tuple, queries.op4(spark, sf_dir).collect())) == sorted(want)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_op4_short_and_nested_items(spark, part_bytes):
    rng = random.Random(7)
    draw = lambda n: " ".join(rng.choice(["a", "B", "c-d", "é"]) for _ in range(n))
    items = [(i, draw(rng.randint(0, 16))) for i in range(25)] + [(None, "a a"), (99, None), (3, "c d c")]
    docs = [(i, draw(rng.randint(0, 60))) for i in range(60)] + [(None, "a b c"), (60, None), (1, "a b"), (1, "a b")]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        items, "item_id long, text string"), part_bytes=part_bytes)
    assert judged(found) == sorted(brute_matches(docs, items), key=str)


def test_op4_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "jumps over the LAZY dog, while the band plays on and on. The quick")],
                                  "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = sorted(brute_matches(rows, [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert judged(decontaminate.matches(odd_docs, items, keep=["doc_id"])) == want
    assert sum(w[5] for w in want) == 3
    clean = decontaminate.decontaminate(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == len(rows) - 3
    cut = decontaminate.decontaminate(odd_docs, items, share=None, span_words=13)
    assert cut.count() == len(rows)
    assert decontaminate.matches(cut, items, keep=["text"]).where("size(hits) > 0").count() == 0
    assert decontaminate.matches(no_docs, items).count() == 0
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).count() == len(rows)


def test_op10_query(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10(spark, folder).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op10_odd_documents(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    taught = spark.createDataFrame(
        [("en", "the band plays on and the dog jumps over the fox"), ("fr", "été à la mer et le vent du soir"),
         (None, "nothing"), ("de", None), ("de", "12 34")], "lang string, text string")
    learnt = language.fit(taught)
    assert sorted(learnt) == ["en", "fr"]
    assert learnt == language.fit(taught.union(taught).repartition(5))
    rows = language.predict(odd_docs, learnt, keep=odd_docs.columns).collect()
    assert len(rows) == odd_docs.count()
    for r in language.predict(odd_docs.select("doc_id", "text"), learnt, keep=["doc_id", "text"]).collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.text.startswith("The quick"):
            assert r.lang_pred == "en"
    assert {r.lang_pred for r in language.predict(odd_docs, {}).collect()} == {"und"}
    assert language.predict(no_docs, learnt).count() == 0
    one = language.predict(odd_docs, {"en": learnt["en"]})
    assert one.where(F.col("lang_pred") == "en").count() > 0


def test_op9_odd_documents(spark, odd_docs, no_docs):
    mit = licenses.KNOWN["MIT"]
    texts = [(1, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(" ", "  ")),
             (2, mit + " more"), (3, "intro\n** released under the MIT licence **\nRELEASED under the MIT License.\nend"),
             (4, None), (5, ""), (6, "© 2021 us"), (7, "Licensed under CC BY 4.0"), (7, "Licensed under CC BY 4.0")]
    rows = {r.doc_id: tuple(r)[2:] for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows == {1: ("MIT", 0, ""), 2: (None, 0, ""), 3: (None, 2, "MIT-notice"), 4: (None, 0, ""), 5: (None, 0, ""),
                    6: (None, 0, ""), 7: ("CC-BY-4.0-notice", 1, "CC-BY-4.0-notice")}
    assert licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(no_docs).count() == 0
    own = spark.createDataFrame([("b", "Hello, Colour!"), ("a", "hello color"), (None, "x"), ("c", "...")],
                                "license_id string, text string")
    assert [r.license_id for r in licenses.known_digests(spark, own).collect()] == ["a"]


def test_op9_common_texts(spark):
    read = lambda n: (Path(licenses.__file__).parent / "licence_texts" / f"{n}.txt").read_text()
    apache = read("Apache-2.0")
    texts = [("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses.KNOWN["MIT"]),
             ("ISC", "ISC License\n\n" + licenses.KNOWN["ISC"]), ("Zlib", "zlib License\n" + licenses.KNOWN["Zlib"]),
             ("Apache-2.0", apache), ("Apache-2.0", apache.split("   APPENDIX")[0]),
             ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, us\n\n" + read("BSD-3-Clause")),
             *((n, read(n)) for n in ("BSD-2-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0",
                                      "CC0-1.0", "Unlicense"))]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(99, "Distributed under the Mozilla Public License 2.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(len(texts))] == [n for n, _ in texts]
    assert got[99].line_licenses == "MPL-2.0-notice"


def test_op9_runs_no_python(spark, sf_dir):
    plan = queries.op9(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op4_nulls_beside_texts_in_any_number_of_parts(spark):
    from claimlens.llm import decontaminate

    docs = spark.createDataFrame([(None, "alpha"), ("alpha", None), (None, None), ("beta", "alpha beta"), (None, "alpha")],
                                 "doc_id string, text string")
    items = spark.createDataFrame([("1", "alpha"), ("2", "beta"), ("3", "gamma delta")], "item_id string, text string")
    results = []
    for part_bytes in (1 << 20, 6, 1):
        rows = decontaminate.matches(docs, items, part_bytes=part_bytes).collect()
        results.append(sorted((str(r.doc_id), str(r.text), r.n_words, str(r.hits), str(r["items"])) for r in rows))
    assert results[0] == results[1] == results[2]
    assert [x for x in results[0] if x[:2] == ("alpha", "None")] == [("alpha", "None", 0, "[]", "[]")]
    assert sum(x == ("None", "alpha", 1, "[[0, 1]]", "['1']") for x in results[0]) == 2


def test_op10_sizes_and_rejection_by_plain_python(spark, sf_dir):
    """Sum of block sizes per language, margin, and one rejection rule for texts of all lengths."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learnt = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    short = [(-1, "a b"), (-2, "zzz"), (-3, "the house"), (-4, "x " * 40), (-5, "q" * 5000)]
    rows = docs.union(spark.createDataFrame(short, docs.schema))

    def coder(name):
        kind = zstandard.DICT_TYPE_RAWCONTENT
        return zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False,
                                        dict_data=zstandard.ZstdCompressionDict(learnt[name], dict_type=kind))

    coders = {name: coder(name) for name in learnt}
    found = language.predict(rows, learnt, keep=["doc_id", "text"]).withColumn("gone", language.rejected())
    got = found.collect()
    assert len(got) == docs.count() + len(short)
    for r in got:
        data = language.seen(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.gone) == ("und", 0.0, True)
            continue
        cut = [data[i:i + 500] for i in range(0, len(data), 500)]
        sizes = sorted((sum(len(c.compress(b)) for b in cut), name) for name, c in coders.items())
        saved = sizes[1][0] - sizes[0][0]
        assert (r.lang_pred, r.n_seen, r.n_saved) == (sizes[0][1], len(data), saved)
        assert abs(r.score - saved / sizes[1][0]) < 1e-12
        assert r.gone == (saved < math.sqrt(len(data) / 500))

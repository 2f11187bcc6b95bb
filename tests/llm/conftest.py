from __future__ import annotations

import pytest

# Names that the operators use inside, to clash with.
CLASHING = ("id", "key", "k0", "seen", "n_tokens", "n_words", "hits", "items", "node", "comp", "bucket",
            "kind", "data", "score", "lang_pred", "n_bytes", "start", "license_id", "lines", "class")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, repeated, tied and very long documents, with columns of clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} of the {i}" for i in range(12_000))
    copied = "The quick brown fox jumps over the lazy dog while the band plays on and on. " * 3
    rows = [(1, copied), (None, copied + "x"), (2, None), (3, ""), (4, "same row"), (4, "same row"),
            (4, "other text of the same id"), (5, long), (6, long + " end"), (7, copied), (8, " \n\t ..."),
            (9, "été à la ñandú 北京 🙂 " * 20), (10, "été à la ñandú 北京 🙂 " * 20), (None, None), (11, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

"""Language of a text by compression: the language whose dictionary shrinks it most."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.texts import stored

UNKNOWN = "und"
SAMPLE_TEXTS = 100
# With SAMPLE_TEXTS this bounds what is broadcast and what the driver holds.
MAX_LANGUAGES = 1_000
SAMPLE_CHARS = 2_000
BLOCK = 500
LEVEL = 3
# Bytes that the best dictionary must save per square root of the number of blocks.
MARGIN = 1.0
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def seen(text: str) -> bytes:
    """What is compressed: lower-cased letters, everything else as single spaces."""
    return _OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang",
        sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary per language from a bounded sample of labelled rows.

    The bound: per language the ``sample_texts`` distinct texts with the smallest hashes, and of
    each the first ``sample_chars`` characters (of the sample only; predictions read whole
    texts).  Rows without a letter or a language teach nothing.  The sample does not depend on
    partitioning or on how often a text is repeated.  Hashes are made distinct before they are
    ranked, so a hot language or copied text stays small; more than ``MAX_LANGUAGES`` are an error.
    """
    rows = labelled.select(
        F.col(lang).alias("lang"),
        F.substring(F.col(text).cast("string"), 1, sample_chars).alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    distinct = stored(rows.groupBy("lang", "h").agg(F.count("*").alias("n")).select("lang", "h"), "language-texts")
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # hashes are uniform, so the smallest lie in the lowest part of their range: a few hundred are ranked
    share = F.col("h") / F.lit(2.0 ** 64) + 0.5
    low = distinct.join(F.broadcast(sizes), "lang").where(share * F.col("n") <= 8 * sample_texts)
    chosen = low.withColumn("place", F.row_number().over(
        Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= sample_texts)
    picked = rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"])
    texts: dict[str, list[str]] = {}
    for r in picked.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return {name: b"\n".join(map(seen, own)) for name, own in texts.items()}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id",
            text: str = "text", keep: list[str] | None = None, level: int = LEVEL) -> DataFrame:
    """``lang_pred``, ``score`` and ``n_seen`` of every whole text, beside the key or ``keep``
    (columns of these names are replaced).

    A text is compressed once per dictionary, in blocks of ``BLOCK`` bytes that do not see each
    other, so that a long text cannot explain itself.  ``score`` is the margin between the
    smallest and the second smallest sum of sizes, as a share of the second; ties go to the
    language first in the alphabet and score 0.  Texts that are null or have no letter are
    ``und`` with score 0, as is everything if no language was learnt; with one language the
    score is its saving against no dictionary.  ``n_seen`` is the number of bytes compressed,
    ``n_saved`` the margin in bytes.
    Repeated rows each give a row.  Map only.
    """
    kept = [c for c in keep or [doc_id] if c not in RESULT]
    found = judged(docs, dictionaries, text, kept, level)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *RESULT)


RESULT = ["lang_pred", "score", "n_seen", "n_saved"]


def judged(docs: DataFrame, dictionaries: dict[str, bytes], text: str, kept: list[str], level: int) -> DataFrame:
    """The result columns beside k0, k1, ... for the columns ``kept``, so that no name clashes."""
    names = sorted(dictionaries)
    # a text that is kept is sent once
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    narrow = docs.select(*carried, *[F.col(text).cast("string").alias("seen")] * (text not in kept))
    at = kept.index(text) if text in kept else len(kept)
    kinds = {c: narrow.schema[c].dataType.simpleString() for c in narrow.columns[:len(kept)]}
    schema = (", ".join(f"{c} {t}" for c, t in kinds.items())
              + ", lang_pred string, score double, n_seen long, n_saved long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [zstandard.ZstdCompressor(
            level=level, write_content_size=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(
                dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in names]
        bare = zstandard.ZstdCompressor(level=level, write_content_size=False)

        def judge(value: str | None) -> tuple[str, float, int, int]:
            if not value or not _LETTER.search(value):
                return UNKNOWN, 0.0, 0, 0
            data = seen(value)
            blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = sorted((sum([len(c.compress(b)) for b in blocks]), n)
                           for c, n in zip(coders, names, strict=True))
            if not sizes:
                return UNKNOWN, 0.0, len(data), 0
            second = sizes[1][0] if len(sizes) > 1 else sum(len(bare.compress(b)) for b in blocks)
            saved = max(0, second - sizes[0][0])
            return sizes[0][1], saved / second, len(data), saved

        for batch in batches:
            got = [judge(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                names=[*kinds, *RESULT])

    return narrow.mapInArrow(work, schema)


def rejected(margin: float = MARGIN) -> Column:
    """Texts without an accepted language: ``und``, or a narrow margin.

    A block's size is off by about a byte, so the sum over n blocks is off by about the square
    root of n; a text must save at least ``margin`` times that.  One rule for all lengths: a
    text of any length that ties is rejected.
    """
    needed = F.lit(margin) * F.sqrt(F.col("n_seen") / F.lit(float(BLOCK)))
    return (F.col("lang_pred") == UNKNOWN) | (F.col("n_saved") < needed)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = LEVEL,
             margin: float = MARGIN) -> DataFrame:
    """Documents of an accepted language, columns as they were."""
    own = docs.columns
    found = judged(docs, dictionaries, text, own, level).where(~rejected(margin))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(own)])

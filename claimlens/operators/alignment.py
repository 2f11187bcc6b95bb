"""Joins between gold rows, predictions, spans and claim sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.claims import sentence_spans
from claimlens.functions.labels import label_dim
from claimlens.functions.numbers import ratio, round_to
from claimlens.functions.text import jaccard, plain_tokens, strip
from claimlens.session import cut_lineage


OPEN_END = 2**31 - 1
PART_BYTES = 512 << 10  # of contexts in a partition of nli_dataset
# Pairs of claims up to which two claim lists are compared in their row.
IN_ROW = 4_096


def first_overlaps(start: np.ndarray, end: np.ndarray, span_start: np.ndarray, span_end: np.ndarray,
                   place: np.ndarray) -> np.ndarray:
    """Least ``place`` of the spans that overlap each of the ranges, which follow each other; -1 for none.

    A span meets consecutive ranges, found by bisection.  Their number is covered by two runs of a
    power of two, and each run keeps the least place of its spans; from the longest runs down every
    run hands its place to its halves.  That is (ranges + spans) * log(ranges), not their product.
    """
    n = len(start)
    none = np.iinfo(np.int64).max
    low = np.searchsorted(end, span_start, "right")
    high = np.searchsorted(start, span_end, "left")
    real = (high > low) & (span_end > span_start)
    low, high, place = low[real], high[real], place[real]
    if not len(low):
        return np.full(n, -1)
    level = np.frexp(high - low)[1] - 1
    best = np.full(n, none)
    for k in range(int(level.max()), -1, -1):
        own = level == k
        np.minimum.at(best, low[own], place[own])
        np.minimum.at(best, high[own] - (1 << k), place[own])
        if k:
            half = 1 << (k - 1)
            best[half:] = np.minimum(best[half:], best[:-half])
    return np.where(best == none, -1, best)


def overlap_labels(ranges: Column, spans: Column) -> Column:
    """Array with the label of each range, from the first listed span that overlaps it.

    The ranges of a row (start, end, start, end, ...) are sorted and disjoint.  Only numbers go to Python, and the rows of a
    batch are laid end to end, so a batch is one call whatever the sizes of its rows.
    """
    names = np.array(["supported", "neutral", "contradicted"], object)

    @F.pandas_udf("array<string>")
    def labels(ranges: pd.Series, a: pd.Series, b: pd.Series, conflict: pd.Series) -> pd.Series:
        def flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
            full = [np.asarray(x, np.int64) for x in lists if x is not None and len(x)]
            return np.concatenate(full) if full else np.zeros(0, np.int64), sizes

        (both, n), (span_start, m), (span_end, _), (kind, _) = map(flat, (ranges, a, b, conflict))
        start, end, n = both[::2], both[1::2], n // 2
        # rows are moved apart, so that no span reaches the next row
        low = min(0, int(start.min(initial=0)), int(span_start.min(initial=0)))
        wide = max(int(end.max(initial=0)), int(span_end.max(initial=0))) - low + 1
        move, span_move = np.repeat(np.arange(len(n)) * wide - low, n), np.repeat(np.arange(len(m)) * wide - low, m)
        hit = first_overlaps(start + move, end + move, span_start + span_move, span_end + span_move, np.arange(len(kind)))
        found = names[np.append(kind + 1, 0)[hit]]
        return pd.Series(np.split(found, np.cumsum(n)[:-1]))

    known = F.filter(spans, lambda s: s.isNotNull())
    return labels(
        ranges, F.transform(known, lambda s: F.coalesce(s["start"].cast("bigint"), F.lit(0))),
        F.transform(known, lambda s: F.coalesce(s["end"].cast("bigint"), F.lit(OPEN_END))),
        F.transform(known, lambda s: F.coalesce((s["label"] == fv.CONFLICT_SPAN_LABEL).cast("int"), F.lit(0))))


def label_sentences(df: DataFrame, text: str = "answer", spans: str = "labels") -> DataFrame:
    """One row per sentence with its label, that of the first listed span that overlaps it.

    Spans belong to the record, so the interval join is one over the row's own arrays; its work
    grows with sentences plus spans, not with their product.  A span without a start or an end is
    open there; null spans mark nothing.
    """
    cut = df.withColumn("__cut", sentence_spans(F.col(text)))
    ranges = F.flatten(F.transform("__cut", lambda s: F.array(s["start"].cast("bigint"), s["end"].cast("bigint"))))
    placed = cut.withColumn("__label", overlap_labels(ranges, F.col(spans)))
    rows = placed.select(*df.columns, F.posexplode(F.arrays_zip("__cut", "__label")).alias("sentence_index", "__s"))
    return rows.select(
        *df.columns, "sentence_index", F.col("__s.__cut.start").alias("start"), F.col("__s.__cut.end").alias("end"),
        F.col("__s.__cut.sentence").alias("claim"), F.col("__s.__label").alias("label"),
    )


def nli_dataset(df: DataFrame) -> DataFrame:
    """Span-labelled records -> (question, context, claim, label) rows.

    Every row repeats its record's whole context.  Parquet writes a repeated value once as long as
    the values of a file fit its dictionary (1 MB), so records are dealt out to partitions of less.
    """
    size = df.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    dealt = df.select("question", "context", "answer", "labels").repartition(1 + size // PART_BYTES)
    # stripped in the records, as an array element: a plain column would move behind the explode
    pair = F.array(*[strip(F.coalesce(c, F.lit(""))) for c in ("question", "context")])
    rows = label_sentences(dealt.select("answer", "labels", pair.alias("__pair")))
    return rows.select(
        F.col("__pair")[0].alias("question"), F.col("__pair")[1].alias("context"), "claim", "label")


def last_by_id(df: DataFrame, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """Last row per id (``seq`` is unique within an id).

    The greatest seq per id is a hash aggregate over two narrow columns that combines map-side;
    rows with long texts are only joined with it, so a hot id stays cheap.
    """
    last = df.groupBy(id_col).agg(F.max(seq).alias(seq))
    return df.join(last, [id_col, seq]).select(*df.columns)


def align_predictions(gold: DataFrame, pred: DataFrame, id_col: str = "id",
                      seq: str = "seq") -> DataFrame:
    """Inner join of the last gold and the last prediction per id (pred_* columns)."""
    g = last_by_id(gold, id_col, seq).drop(seq)
    p = last_by_id(pred, id_col, seq).drop(seq)
    renamed = p.select(id_col, *[F.col(c).alias(f"pred_{c}") for c in p.columns if c != id_col])
    return g.join(renamed, id_col)


def missing_predictions(gold: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    return gold.select(id_col).distinct().join(pred.select(id_col).distinct(), id_col, "left_anti")


def extra_predictions(gold: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    return missing_predictions(pred, gold, id_col)


def matched_claims(items: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, side, i) of claims with a counterpart of Jaccard >= threshold on the other side.

    ``items`` has key, side (gold or extracted), i, words, n.  Two such claims share a word among
    the n - ceil(threshold * n) + 1 words of each that are rarest in their answer, so only those
    words are joined, and common ones hardly ever; what meets is compared in full.
    """
    words = items.select(key, "side", "i", "n", F.explode("words").alias("word"))
    common = words.groupBy(key, "word").agg(F.count("*").alias("_times"))
    rarest = Window.partitionBy(key, "side", "i").orderBy("_times", "word")
    lead = (
        words.join(common, [key, "word"]).withColumn("_place", F.row_number().over(rarest))
        .where(F.col("_place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    )

    def side(name: str, prefix: str) -> DataFrame:
        own = lead.where(F.col("side") == name)
        return own.select(key, "word", F.col("i").alias(f"{prefix}i"), F.col("n").alias(f"{prefix}n"))

    def texts(name: str, prefix: str) -> DataFrame:
        own = items.where(F.col("side") == name)
        return own.select(key, F.col("i").alias(f"{prefix}i"), F.col("words").alias(f"{prefix}words"))

    near = F.least("gn", "en") >= F.lit(threshold) * F.greatest("gn", "en")
    pairs = side("gold", "g").join(side("extracted", "e"), [key, "word"]).where(near)
    pairs = pairs.select(key, "gi", "ei").distinct()
    full = pairs.join(texts("gold", "g"), [key, "gi"]).join(texts("extracted", "e"), [key, "ei"])
    found = full.where(jaccard(F.col("gwords"), F.col("ewords")) >= threshold)
    ends = F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gi").alias("i")),
        F.struct(F.lit("extracted").alias("side"), F.col("ei").alias("i")),
    )
    return found.select(key, F.inline(ends)).distinct()


def compare_claim_sets(df: DataFrame, key: str, gold: Column, extracted: Column,
                       threshold: float = 0.5, in_row: int = IN_ROW) -> DataFrame:
    """Precision, recall, F1 and counts of two claim lists per answer; ``key`` is unique.

    An answer of at most ``in_row`` pairs of claims is settled in its row, so its words are neither
    written nor shuffled.  Claims of longer ones leave their row, so a book-length answer is
    spread over tasks.  Without gold claims everything is zero.
    """
    usable = F.when(F.size(gold) > 0, extracted).otherwise(F.array().cast("array<string>"))

    def count(claims: Column) -> Column:
        return F.coalesce(F.greatest(F.size(claims), F.lit(0)), F.lit(0)).cast("long")

    def near(a: Column, b: Column) -> Column:
        alike = F.least(F.size(a), F.size(b)) >= F.lit(threshold) * F.greatest(F.size(a), F.size(b))
        return alike & (jaccard(a, b) >= threshold)

    def hits(own: str, other: str) -> Column:
        found = F.filter(own, lambda a: F.exists(other, lambda b: near(a, b)))
        return F.when(F.col("_short"), count(found))

    lists = df.select(key, gold.alias("_gold"), usable.alias("_extracted"))
    words = lists.select(
        key, count(F.col("_gold")).alias("n_ground_truth"), count(F.col("_extracted")).alias("n_extracted"),
        F.transform("_gold", plain_tokens).alias("_gwords"), F.transform("_extracted", plain_tokens).alias("_ewords"))
    words = words.withColumn("_short", F.col("n_ground_truth") * F.col("n_extracted") <= in_row)
    # both lists are made once; words are only written for what is read again
    rows = cut_lineage(words.select(
        key, "n_ground_truth", "n_extracted", hits("_gwords", "_ewords").alias("_g"), hits("_ewords", "_gwords").alias("_e"),
        F.when(~F.col("_short"), F.array(
            F.struct(F.lit("gold").alias("side"), F.col("_gwords").alias("claims")),
            F.struct(F.lit("extracted").alias("side"), F.col("_ewords").alias("claims")))).alias("_lists"),
    ), "claim-sets")
    short, long = rows.where("_g IS NOT NULL"), rows.where("_g IS NULL")
    items = long.select(key, F.inline("_lists")).select(key, "side", F.posexplode("claims").alias("i", "words"))
    found = matched_claims(items.withColumn("n", F.size("words")), key, threshold).groupBy(key).agg(
        F.count_if(F.col("side") == "gold").alias("_g"), F.count_if(F.col("side") == "extracted").alias("_e"))
    spread = long.drop("_g", "_e", "_lists").join(found, key, "left").fillna(0, ["_g", "_e"])
    both = short.drop("_lists").unionByName(spread)
    precision, recall = ratio(F.col("_e"), F.col("n_extracted")), ratio(F.col("_g"), F.col("n_ground_truth"))
    return both.select(
        key, round_to(precision, 4).alias("precision"), round_to(recall, 4).alias("recall"),
        round_to(ratio(precision * recall * 2, precision + recall), 4).alias("f1"),
        "n_ground_truth", "n_extracted", F.col("_g").alias("n_matched"),
    )


def leakage(df: DataFrame, context: str = "context", split: str = "split") -> DataFrame:
    """Contexts shared by two splits, one row per pair of splits; a single shuffle."""
    seen = df.groupBy(F.md5(context).alias("h")).agg(
        *[F.max((F.col(split) == s).cast("int")).alias(s) for s in fv.SPLITS]
    )
    both = {
        "train_test_leakage": ("train", "test"),
        "train_val_leakage": ("train", "validation"),
        "val_test_leakage": ("validation", "test"),
    }
    totals = seen.agg(
        *[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(n) for n, (a, b) in both.items()]
    )
    return totals.unpivot([], list(both), "type", "n_overlapping_contexts")


def enrich_with_label_dim(df: DataFrame, label: str = "label") -> DataFrame:
    """All label attributes by broadcast join; the dimension has five rows."""
    dim = label_dim(df.sparkSession).withColumnRenamed("label", label)
    out = df.join(F.broadcast(dim), label, "left")
    return out.withColumns(
        {
            "default_decision": F.coalesce("default_decision", F.lit("warn")),
            "nli3": F.coalesce("nli3", F.lit("neutral")),
            "risk": F.coalesce("risk", F.lit("unsafe")),
            "danger_weight": F.coalesce("danger_weight", F.lit(0.5)),
        }
    )

"""Leak-free splits, sampling and generation plans with reproducible hash keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.labels import lookup
from claimlens.functions.numbers import hash_key, hash_unit
from claimlens.operators.ranking import as_scalar, exact_rank, key_thresholds


def _share(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))


def context_grouped_split(df: DataFrame, seed: int = 42, val_ratio: float = 0.10,
                          test_ratio: float = 0.17, context: str = "context") -> DataFrame:
    """Set ``split`` so that equal contexts share a split, with exact context counts.

    Distinct context hashes are ordered by a seeded key; the two cut-off keys are found by
    counting, and rows then compare their own key with them.  Rows are never shuffled or
    joined, so a context copied a billion times costs nothing extra.
    """
    key = hash_key(F.lit(seed), F.md5(F.col(context)))
    keys = df.select(key.alias("key")).distinct()
    cuts = key_thresholds(
        keys,
        "key",
        {
            "test_key": lambda n: _share(n, test_ratio),
            "val_key": lambda n: _share(n, test_ratio) + _share(n, val_ratio),
        },
    )
    cut = as_scalar(cuts)
    too_few = cut["n"] - _share(cut["n"], test_ratio) - _share(cut["n"], val_ratio) <= 0
    split = (
        F.when(too_few, F.raise_error(F.lit("not enough contexts for splitting")))
        .when(key <= cut["test_key"], F.lit("test"))
        .when(key <= cut["val_key"], F.lit("validation"))
        .otherwise(F.lit("train"))
    )
    return df.withColumn("split", split)


def row_split(df: DataFrame, id_col: str = "id", test_size: float = 0.1,
              seed: int = 42) -> DataFrame:
    """Record-level train/validation split with exactly ceil(n * test_size) held out."""
    key = hash_key(F.lit(seed), F.col(id_col))
    cut = as_scalar(
        key_thresholds(
            df.select(key.alias("key")), "key",
            {"val_key": lambda n: F.ceil(n * F.lit(test_size))},
        )
    )
    return df.withColumn(
        "split", F.when(key <= cut["val_key"], F.lit("validation")).otherwise(F.lit("train"))
    )


def balance_cap(df: DataFrame, max_supported: int = 12000, seed: int = 42, id_col: str = "id",
                label: str = "label") -> DataFrame:
    """At most ``max_supported`` supported rows, all other known rows; unknown labels go."""
    key = hash_key(F.lit(seed), F.col(id_col))
    name = F.coalesce(F.col(label), F.lit("neutral"))
    supported = df.where(name == "supported").select(key.alias("key"))
    cut = as_scalar(
        key_thresholds(
            supported, "key", {"last": lambda n: F.least(n, F.lit(max_supported))}
        )
    )
    return df.where(
        name.isin("neutral", "contradicted") | ((name == "supported") & (key <= cut["last"]))
    )


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly min(n, rows) rows, the same ones on every run."""
    key = hash_key(F.lit(seed), F.col(id_col))
    cut = as_scalar(
        key_thresholds(
            df.select(key.alias("key")), "key", {"last": lambda t: F.least(t, F.lit(n))}
        )
    )
    return df.where(key <= cut["last"])


def shuffle_within_split(df: DataFrame, seed: int = 42, id_col: str = "id",
                         split: str = "split") -> DataFrame:
    """Shuffled position of every row inside its split."""
    keyed = df.withColumn("_key", hash_key(F.lit(seed), F.col(split), F.col(id_col)))
    return exact_rank(keyed, "_key", split, "position").drop("_key")


def write_shuffled_splits(df: DataFrame, path: str, seed: int = 42, id_col: str = "id") -> None:
    """One JSON-lines folder per split in shuffled order.

    Range partitioning over (split, key) spreads a big split over many tasks.
    """
    keyed = df.withColumn("_key", hash_key(F.lit(seed), F.col("split"), F.col(id_col)))
    ordered = keyed.repartitionByRange("split", "_key").sortWithinPartitions("split", "_key")
    ordered.drop("_key").write.partitionBy("split").json(path, ignoreNullFields=False)


def split_stats(df: DataFrame) -> DataFrame:
    """Rows per (split, label) and per split (label null)."""
    return (
        df.rollup("split", "label")
        .agg(F.count("*").alias("n"))
        .where(F.col("split").isNotNull())
        .select("split", "label", "n")
    )


def pick_label(u: Column) -> Column:
    """Target label for a uniform draw in [0, 1)."""
    out, edge = None, 0.0
    for label, weight in fv.LABEL_WEIGHTS[:-1]:
        edge = round(edge + weight, 10)
        test = u < F.lit(edge)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(fv.LABEL_WEIGHTS[-1][0]))


def generation_plan(paragraphs: DataFrame, n_target: int | Column, id_col: str = "paragraph_id",
                    seed: int = 42) -> DataFrame:
    """Round-robin plan: plan_id, paragraph id, target label, error type and hint.

    Paragraph r of N serves plan ids r, r+N, r+2N, ... below ``n_target``.  Ids are a range that
    is joined with the ranked paragraphs, so no row ever makes more than itself.  The paragraphs
    are read three times (counts, total, ranks): hand in a written table, not an expensive plan.
    """
    spark = paragraphs.sparkSession
    keyed = paragraphs.withColumn("_key", hash_key(F.lit(seed), F.col(id_col)))
    ranked = exact_rank(keyed, "_key", None, "slot").drop("_key")
    total = paragraphs.count()
    goal = n_target
    if isinstance(n_target, Column):
        goal = spark.range(1).select(n_target.alias("n")).first()["n"]
    ids = spark.range(goal if total else 0).select(
        F.col("id").alias("plan_id"), F.pmod("id", F.lit(max(total, 1))).alias("slot")
    )
    plan = ids.join(ranked, "slot")

    def draw(name: str) -> Column:
        return hash_unit(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("plan_id")))

    plan = plan.withColumn("target_label", pick_label(draw("label")))
    choice = F.floor(draw("error") * 3).cast("int")
    error = F.lit("none")
    for label, options in fv.ERROR_CHOICES.items():
        error = F.when(
            F.col("target_label") == label, F.get(F.array(*[F.lit(o) for o in options]), choice)
        ).otherwise(error)
    return plan.withColumns(
        {"error_type": error, "error_hint": lookup(F.col("target_label"), fv.ERROR_HINTS, "")}
    )

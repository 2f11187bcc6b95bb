"""Example files -> validated, split, shuffled and written dataset with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.alignment import leakage
from claimlens.operators.splits import context_grouped_split, write_shuffled_splits
from claimlens.session import cut_lineage
from claimlens.sources.fingerprint import dataset_fingerprint
from claimlens.sources.jsonl import example_schema, load_examples


def build_dataset(spark: SparkSession, source: str, target: str, seed: int = 42, strict: bool = True,
                  columns: tuple[str, ...] = ("id", "label", "context")) -> DataFrame:
    """Load, validate, split by context, write shuffled, and describe what was written.

    Returns the manifest: split, n and checksum per split, and the number of contexts that the
    written splits share (0 for a sound build).  The manifest reads the written files, not the
    plan that wrote them.
    """
    good, _ = load_examples(spark, source, strict=strict)
    # read by the split's key counts and by the writer
    rows = cut_lineage(good, "valid-examples")
    write_shuffled_splits(context_grouped_split(rows, seed), target, seed)
    written = spark.read.schema(example_schema()).json(target)
    shared = leakage(written).agg(F.sum("n_overlapping_contexts").alias("n")).scalar()
    return dataset_fingerprint(written, list(columns)).withColumn("n_shared_contexts", shared)

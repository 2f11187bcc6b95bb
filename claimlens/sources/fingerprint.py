"""Order-insensitive table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.numbers import hash_bigint


def dataset_fingerprint(df: DataFrame, columns: list[str], by: str = "split") -> DataFrame:
    """Row count and content checksum per ``by`` value; equal tables give equal rows."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(hash_bigint(row).cast("decimal(38,0)")).cast("string").alias("checksum"),
    )

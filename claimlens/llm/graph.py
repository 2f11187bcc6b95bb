"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.texts import stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, comp) of every node of ``edges`` with two ends; comp is the least node of its component.

    Each round points neighbours at the least node seen so far, until nothing changes; rounds grow
    with the logarithm of the longest path.  Minima are aggregated before they are joined back, so
    a node with very many neighbours is a skewed join with a unique other side, which adaptive
    execution can split.  Every round is written to the shared folder; no edge reaches the driver.
    """
    now = stored(edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least).distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        now.select("v", "v").distinct())


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

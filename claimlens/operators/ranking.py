"""Exact ranks and order statistics over hash keys without a one-task window.

Keys are MD5 hex strings of unique values, so their first characters spread rows evenly
over at most 16**PREFIX buckets.  Only per-bucket counts (65,536 rows at most) ever meet
in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import cut_lineage

PREFIX = 4


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, PREFIX)


def key_thresholds(keys: DataFrame, key: str,
                   positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row holding the key at each 1-based position, plus the number of keys ``n``.

    ``positions`` maps a result name to a function of n.  A position below 1 gives null.
    Pass 1 counts keys per prefix bucket; pass 2 looks only into the bucket that holds the
    position.  Counting combines map-side, and rows themselves are never sorted globally.
    """
    counts = keys.groupBy(_bucket(F.col(key)).alias("bucket")).agg(F.count("*").alias("n"))
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.select(
        "bucket", "n", F.sum("n").over(everything).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), fn(F.col("total")).cast("bigint").alias("k"))
            for name, fn in positions.items()
        ]
    )
    targets = (
        cumulated.select("*", F.explode(wanted).alias("w"))
        .where((F.col("w.k") > F.col("upto") - F.col("n")) & (F.col("w.k") <= F.col("upto")))
        .select(
            "bucket", F.col("w.name").alias("name"), "total",
            (F.col("w.k") - F.col("upto") + F.col("n")).alias("at"),
        )
    )
    within = Window.partitionBy("name").orderBy(key)
    # targets has one row per requested position, a fixed handful
    picked = (
        keys.select(key, _bucket(F.col(key)).alias("bucket"))
        .join(F.broadcast(targets), "bucket")
        .withColumn("rn", F.row_number().over(within))
        .where(F.col("rn") == F.col("at"))
    )
    named = [F.max(F.when(F.col("name") == n, F.col(key))).alias(n) for n in positions]
    return picked.agg(*named, F.max("total").alias("n"))


def as_scalar(one_row: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery: no join and no driver round trip."""
    return one_row.select(F.struct(*one_row.columns).alias("v")).scalar()


def exact_rank(df: DataFrame, key: str, group: str | None = None,
               rank: str = "rank") -> DataFrame:
    """0-based rank of every row by ``key`` (within ``group``), for unique keys.

    Bucket offsets plus a window inside (group, bucket): a group with a third of all rows
    is spread over thousands of windows.
    """
    groups = [group] if group else []
    rows = df.withColumn("_bucket", _bucket(F.col(key)))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *groups, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(key)
    ranked = rows.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*groups, "_bucket"])
        .withColumn(rank, F.col("_before") + F.col("_rn") - 1)
        .drop("_bucket", "_rn", "_before")
    )


def _octave_slice(x: Column) -> Column:
    """Slice number that grows with x: 32 slices for every power of two, of either sign."""
    size = F.floor(F.log2(F.abs(x)) * 32).cast("int") + 40_000
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], buckets: int = 65_536) -> DataFrame:
    """One row of exact percentiles with linear interpolation; null without values.

    Distinct values are counted once and written.  They are sliced by powers of two, so that an
    outlier takes its own slice and leaves the others alone; the slices that hold a wanted position
    are cut into ``buckets`` equal parts, and those parts once more.  A double has 52 bits after its
    power of two: 5 are told apart by the first cut and 16 by each other one, so what is left to
    sort has at most 2 ** 15 distinct values, whatever the values are.  Each cut is a job over the
    written values that returns two rows for each percentile.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    counted = cut_lineage(rows.groupBy("x").agg(F.count("*").alias("c")), "values")
    total = counted.agg(F.sum("c")).first()[0]
    if total is None:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in shares])
    wanted = {int(fn(p * (total - 1))) for p in shares.values() for fn in (math.floor, math.ceil)}
    # least and greatest value of a slice, values before it, positions in it
    slices = [(None, None, 0, sorted(wanted))]
    for level in range(3):
        if level == 0:
            part = _octave_slice(F.col("x"))
        else:
            part = F.lit(None).cast("bigint")
            for i, (lo, hi, _, _) in enumerate(slices):
                width = (hi - lo) / buckets
                inside = F.least(F.floor((F.col("x") - lo) / width), F.lit(buckets - 1)) if 0 < width < math.inf else F.lit(0)
                part = F.when(F.col("x").between(lo, hi), inside.cast("bigint")).otherwise(part)
        slices = _holding(counted, slices, part)
    values = {k: x for x, _, _, own in _holding(counted, slices, F.col("x")) for k in own}

    def one(share: float) -> float:
        place = share * (total - 1)
        low, high = values[math.floor(place)], values[math.ceil(place)]
        return low + (high - low) * (place - math.floor(place)) if high != low else low

    return df.sparkSession.range(1).select(*[F.lit(one(p)).alias(n) for n, p in shares.items()])


def _holding(counted: DataFrame, slices: list[tuple], key: Column) -> list[tuple]:
    """The parts by ``key`` of the slices that hold one of their positions: few rows, however many parts."""
    which, offset, positions = F.lit(None).cast("int"), [], []
    for i, (lo, hi, before, own) in enumerate(slices):
        which = F.lit(0) if lo is None else F.when(F.col("x").between(lo, hi), i).otherwise(which)
        offset.append(F.lit(before).cast("bigint"))
        positions += own
    counts = counted.select("x", "c", which.alias("slice"), key.alias("part")).where("slice is not null").groupBy(
        "slice", "part").agg(F.sum("c").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ahead = F.sum("c").over(Window.partitionBy("slice").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.withColumn("end", ahead + F.get(F.array(*offset), F.col("slice"))).withColumn("begin", F.col("end") - F.col("c"))
    holds = F.exists(F.array(*map(F.lit, positions)), lambda k: (k >= F.col("begin")) & (k < F.col("end")))
    return [(r.lo, r.hi, r.begin, [k for k in positions if r.begin <= k < r.end])
            for r in upto.where(holds).select("lo", "hi", "begin", "end").orderBy("begin").collect()]

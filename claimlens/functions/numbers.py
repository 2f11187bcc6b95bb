"""Numeric helpers that stay in generated code and behave alike on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column, digits: int) -> Column:
    """Round a non-negative double, halves up.

    ``F.round`` on doubles goes through BigDecimal for every row; plain IEEE
    arithmetic is several times cheaper and bit-identical across engines.
    """
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0."""
    den = den.cast("double")
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


EXACT = "decimal(18,9)"


def exact_mean(c: Column) -> Column:
    """Mean (aggregate) that does not depend on the order in which partitions are merged.

    Sums of doubles differ in the last bits between runs, which shows where a rounded mean
    sits on a tie; sums of nine-digit decimals do not.
    """
    return F.sum(c.cast(EXACT)).cast("double") / F.count(c)


def clean_logit(x: Column) -> Column:
    """NaN -> 0, +-Infinity -> +-10."""
    return (
        F.when(F.isnan(x), F.lit(0.0))
        .when(x == float("inf"), F.lit(10.0))
        .when(x == float("-inf"), F.lit(-10.0))
        .otherwise(x)
    )


def softmax(logits: Column) -> Column:
    """Softmax of an array<double> after :func:`clean_logit`."""
    from claimlens.functions.arrays import let

    def normalise(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
        return let(total, lambda t: F.transform(weights, lambda w: w / t))

    clean = F.transform(logits, clean_logit)
    weights = let(
        clean, lambda z: let(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp(v - m)))
    )
    return let(weights, normalise)


def hash_key(*parts: Column) -> Column:
    """Reproducible, uniformly spread ordering key (32 hex characters)."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_bigint(text: Column) -> Column:
    """First 60 bits of MD5 as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_unit(text: Column) -> Column:
    """First 32 bits of MD5 as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

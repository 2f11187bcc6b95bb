"""Small helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimizer may inline a projected column into a lambda, where it would be
    evaluated once per element.  Binding it as the only element of an array keeps
    costly inputs (token sets of whole contexts) at one evaluation per row.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def any_contains(haystack: Column, needles) -> Column:
    """True when ``haystack`` contains one of the literal ``needles``."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(haystack, F.lit(needle))
    return found


def literal_array(values, dtype: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{dtype}>")


def running_sum(values: Column, block: int = 16, levels: int = 3) -> Column:
    """Sum of all earlier elements for every position of an int array.

    Appending to an accumulator copies it, so one flat fold costs n*n.  Folding inside small
    blocks, then over the totals of blocks in the same way, costs n * block per level instead,
    which keeps megabyte documents with tens of thousands of sentences cheap.
    """

    def fold(arr: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(
            arr,
            start,
            lambda acc, x: F.struct(
                (acc["total"] + x).alias("total"),
                F.array_append(acc["before"], acc["total"]).alias("before"),
            ),
        )

    def by_block(arr: Column) -> Column:
        n_blocks = F.ceil(F.size(arr) / F.lit(block)).cast("int")
        starts = F.sequence(F.lit(0), n_blocks - 1)
        blocks = F.transform(starts, lambda b: fold(F.slice(arr, b * block + 1, F.lit(block))))

        def placed(bl: Column) -> Column:
            totals = F.transform(bl, lambda x: x["total"])
            heads = running_sum(totals, block, levels - 1) if levels > 1 else fold(totals)["before"]
            return let(
                heads,
                lambda h: F.flatten(
                    F.transform(
                        bl, lambda x, i: F.transform(x["before"], lambda v: v + F.get(h, i))
                    )
                ),
            )

        return let(blocks, placed)

    empty = F.array().cast("array<int>")
    return let(values, lambda arr: F.when(F.size(arr) > 0, by_block(arr)).otherwise(empty))

"""Evidence chunks: assemble, take apart and fit into a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.text import WS, estimate_tokens, strip


def build_context(chunks: Column) -> Column:
    """No chunk -> "", one chunk -> itself, several -> tagged and joined."""
    tagged = F.transform(
        chunks,
        lambda c, i: F.concat(
            F.lit(f"[{fv.SOURCE_TAG} "), (i + 1).cast("string"), F.lit("]: "), strip(c)
        ),
    )
    return (
        F.when(F.size(chunks) == 1, chunks[0])
        .when(F.size(chunks) > 1, F.array_join(tagged, fv.CHUNK_SEPARATOR))
        .otherwise(F.lit(""))
    )


def parse_context(context: Column) -> Column:
    """Chunks of an assembled context without their tags; blank chunks are dropped."""
    parts = F.split(context, r"\n\n---\n\n")
    bare = F.transform(
        parts,
        lambda p: F.regexp_replace(
            strip(p), f"^\\[{fv.SOURCE_TAG} [0-9]+\\]:[{WS}]*", ""
        ),
    )
    return F.when(
        F.contains(context, F.lit(fv.CHUNK_SEPARATOR)), F.filter(bare, lambda p: p != "")
    ).otherwise(F.array(strip(context)))


def source_index(span: Column) -> Column:
    """0-based source number of a tagged span, null without a tag."""
    number = F.regexp_extract(strip(span), f"^\\[{fv.SOURCE_TAG} ([0-9]+)\\]:", 1)
    return number.try_cast("int") - 1


def fit_chunks(chunks: Column, budget: Column, question: Column, answer: Column,
               claim: Column, tokens: Callable[[Column], Column] = estimate_tokens,
               sizes: Column | None = None) -> Column:
    """Keep the chunks that fit the budget left by question, answer and claim.

    Chunks are tried in order and skipped when too big, so a later small one may
    still fit; one chunk always stays.  With no budget left the context counts as truncated.  ``sizes`` takes precomputed token counts.
    Only indices travel through the fold, never chunk text.
    """
    left = budget - tokens(question) - tokens(answer) - tokens(claim)
    sizes = F.transform(chunks, lambda c: tokens(c)) if sizes is None else sizes
    no_ints = F.array().cast("array<int>")
    start = F.struct(left.cast("int").alias("left"), no_ints.alias("kept"))
    indexed = F.transform(sizes, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    fold = F.aggregate(
        indexed,
        start,
        lambda acc, s: F.when(
            s["n"] <= acc["left"],
            F.struct(
                (acc["left"] - s["n"]).alias("left"),
                F.array_append(acc["kept"], s["i"]).alias("kept"),
            ),
        ).otherwise(acc),
    )

    def result(kept: Column, room: Column) -> Column:
        all_positions = F.transform(chunks, lambda _, i: i)
        removed = F.array_except(all_positions, kept)
        return F.struct(
            build_context(F.transform(kept, lambda i: F.get(chunks, i))).alias("context"),
            ((F.size(removed) > 0) | ((room <= 0) & (F.size(chunks) > 0))).alias("was_truncated"),
            F.size(chunks).alias("original_chunk_count"),
            F.size(kept).alias("remaining_chunk_count"),
            removed.alias("removed_chunk_indices"),
        )

    first_only = F.when(F.size(chunks) > 0, F.array(F.lit(0))).otherwise(no_ints)

    def fitted(room: Column) -> Column:
        kept = F.when(room > 0, fold["kept"]).otherwise(first_only)
        return let(
            let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(first_only)),
            lambda k: result(k, room),
        )

    return let(left, fitted)

"""Spelling variants: words that differ by one code point, found by dense tiles of word blocks.

A single edit leaves all of a word but one window as it is.  Words meet by what is left outside of a
window, and the words that meet are compared as padded code-point matrices: for all pairs of two
blocks at once the lengths of the common prefix and suffix, which for a single edit reach the longer
length minus one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.texts import stored

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS = 7
MIN_COUNT = 2
TIMES = 10
WINDOWS = 4
BLOCK = 256
# A block of words of up to 32 code points has BLOCK words, one of longer words fewer.
BLOCK_CHARS = 1 << 13
TILE_CELLS = 1 << 21
# A form has at least TIMES the occurrences of its word, so no chain of 64-bit counts is longer than 18.
DOUBLINGS = 5


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thin: int = 31,
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all documents.

    Runs are lower-cased (A-Z only); where ``thin`` divides the crc32 of ``<doc_id>:<run>``, one
    code point is deleted.  Only runs of ``min_chars`` and more can give such words, so shorter
    ones never leave the expression.  Counts are summed before the shuffle.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text).cast("string"), upper, lower),
                                       F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run")), F.char_length("run")
    at = F.pmod(F.col("h"), F.col("size")).cast("int")
    cut = runs.withColumn("h", h).withColumn("size", size)
    word = F.when(F.col("h") % thin == 0, F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))).otherwise(F.col("run"))
    words = cut.select(word.alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def meeting(words: DataFrame, windows: int) -> DataFrame:
    """One row per word, length and window: ``key`` is what lies outside the window.

    A word is taken with its own length (``side`` is the window), and as what a word longer by one
    might become (``side`` is the window plus ``windows``).  Two words that differ by one edit leave
    the same text outside the window where they differ.
    """
    size = F.char_length("word")

    def rows(short: int) -> list[Column]:
        length = (size + short).cast("int")
        ends = [F.floor(length * k / F.lit(windows)).cast("int") for k in range(windows + 1)]
        return [F.struct(F.lit(k + windows * short).alias("side"), F.xxhash64(
            length, F.lit(k), F.substring("word", F.lit(1), ends[k]),
            F.substring("word", ends[k + 1] + F.lit(1 - short), size)).alias("key")) for k in range(windows)]

    return words.select("word", "n", F.inline(F.array(*rows(0), *rows(1))))


def padded(points: np.ndarray, at: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words in ``width`` columns, aligned to the left and to the right; zero elsewhere."""
    column = np.arange(width)
    shift = (width - sizes)[..., None]
    top = len(points) - 1
    left = np.where(column < sizes[..., None], points[np.minimum(at[..., None] + column, top)], 0)
    right = np.where(column >= shift, points[np.clip(at[..., None] + column - shift, 0, top)], 0)
    return left.astype(points.dtype), right[..., ::-1].astype(points.dtype)


def common(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all rows of blocks ``a`` with all rows of blocks ``b``."""
    differs = a[:, :, None, :] != b[:, None, :, :]
    first = differs.argmax(3)
    first[~np.take_along_axis(differs, first[..., None], 3)[..., 0]] = a.shape[-1]
    return np.minimum(first, least)


def tiles(batch: pa.RecordBatch, starts: np.ndarray, windows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of near pairs inside the groups that begin at ``starts``.

    Groups of one length and about one size are compared together, in tiles of bounded size:
    (group, word, word, column).  The edit's place is the end of the longest common prefix, so it
    lies in one window only and each pair is found in one group.
    """
    texts = batch.column("word").to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    points = points.astype(np.min_scalar_type(int(points.max(initial=0))))
    side, block, i, j = (batch.column(c).to_numpy() for c in ("side", "block", "i", "j"))
    whole, window = side < windows, side % windows
    length = np.where(whole, sizes, sizes + 1)
    count = np.diff(np.append(starts, len(texts)))
    ranked = 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    order = np.lexsort((ranked, length[starts]))
    order = order[count[order] > 1]
    shape = np.stack([length[starts][order], ranked[order]], 1)
    cut = np.flatnonzero(np.any(shape[1:] != shape[:-1], 1)) + 1 if len(shape) else []
    for same in np.split(order, cut) if len(order) else []:
        width, rows = int(length[starts[same[0]]]), int(ranked[same[0]])
        step = max(1, TILE_CELLS // (rows * rows * width))
        for lot in (same[x:x + step] for x in range(0, len(same), step)):
            at = starts[lot][:, None] + np.arange(rows)
            real = np.arange(rows) < count[lot][:, None]
            at = np.where(real, at, starts[lot][:, None])
            left, right = padded(points, offsets[at], sizes[at], width)
            full = real & whole[at]
            low = window[at[:, :1]] * width // windows
            high = (window[at[:, :1]] + 1) * width // windows
            one = (i[starts[lot]] == j[starts[lot]])[:, None, None]
            some = max(1, TILE_CELLS // (len(lot) * rows * width))
            for x in range(0, rows, some):
                own = slice(x, x + some)
                least = np.minimum(sizes[at][:, own, None], sizes[at][:, None, :])
                prefix = common(left[:, own], left, least)
                later = np.arange(rows)[own, None] < np.arange(rows)
                hit = (full[:, own, None] & real[:, None, :] & (later | ~whole[at][:, None, :])
                       & (one | (block[at][:, own, None] != block[at][:, None, :]))
                       & (prefix >= low[..., None]) & (prefix < high[..., None]))
                if hit.any():
                    hit &= prefix + common(right[:, own], right, least) >= width - 1
                    group, a, b = np.nonzero(hit)
                    yield at[group, a + x], at[group, b]


def compare(batches: Iterator[pa.RecordBatch], windows: int) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of the words of each (key, i, j), whose rows follow each other.

    Keys are hashes; the length and window that a key stands for (``kind``) keep chance meetings apart.
    """
    held: pa.RecordBatch | None = None

    def judge(done: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in tiles(done, starts, windows):
            both, other = np.concatenate((a, b)), np.concatenate((b, a))
            yield pa.RecordBatch.from_arrays(
                [done.column("word").take(both), done.column("word").take(other), done.column("n").take(other)],
                names=["word", "near", "near_n"])

    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if not rows.num_rows:
            continue
        names = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j", "kind")], 1)
        starts = np.concatenate(([0], np.flatnonzero(np.any(names[1:] != names[:-1], 1)) + 1))
        last = int(starts[-1])
        held = rows.slice(last)
        if last:
            yield from judge(rows.slice(0, last), starts[:-1])
    if held is not None:
        yield from judge(held, np.zeros(1, np.int64))


def near_pairs(words: DataFrame, windows: int = WINDOWS, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n) that differ by one code point, both ways.

    Words that share a key are dealt into blocks by hash, as many as their number asks for, and a
    group holds two blocks; so a key that very many words share is spread over groups of bounded
    size, and only near pairs leave a group.  A key with one word is dropped before the shuffle of
    words.  A pair is found once: only in the window where its edit lies.
    """
    rows = meeting(words, windows)
    # Spark sizes these rows, and the files read back below, far too low: it must not broadcast them
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").hint("merge")
    cells = F.greatest(F.char_length("word") + 1, F.lit(BLOCK_CHARS // block))
    sized = rows.join(sizes, "key").withColumn("blocks", F.least(
        F.col("size"), F.ceil(F.col("size") * cells / F.lit(BLOCK_CHARS))).cast("int"))
    placed = sized.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    length = F.char_length("word") + (F.col("side") >= windows).cast("int")
    groups = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           (length * windows + F.col("side") % windows).alias("kind"), "side", "word", "n", "block")
    ordered = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind")
    return ordered.mapInArrow(lambda batches: compare(batches, windows), "word string, near string, near_n long")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thin: int = 31,
             min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``form``, ``form_n``, ``root`` and ``n_near`` of every word of ``docs``.

    A word's form is its near word of most occurrences (ties: the smallest in code-point order), if
    those are at least ``times`` its own; its root is where the forms lead.  Null and empty texts
    have no words, a null key is empty in the checksum, repeated rows count each, one very long run
    is one word, other columns are not looked at; no documents give no rows.
    """
    words = stored(occurrences(docs, doc_id, text, thin, min_chars, min_count), "words")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.least") >= times * F.col("n"), F.col("best")).alias("best"))
    judged = stored(joined.select("word", "n", "n_near", F.col("best.near").alias("form"),
                                  (-F.col("best.least")).alias("form_n")), "forms")
    return judged.join(roots(judged).hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(judged: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round doubles the length of the way known."""
    way = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        way = stored(way.alias("a").join(
            way.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")
    return way

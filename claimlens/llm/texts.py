"""Shared byte work: texts of an Arrow batch as one numpy buffer, rolling hashes, words, work folders.

Everything here is vectorised over a slice of a batch, so memory follows ``SLICE_BYTES`` (or
one document, if that is longer), never the size of a batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.session import work_dir

SLICE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + n + 1]
    if n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """(rows, bytes, offsets) of row ranges of about SLICE_BYTES; a longer text stands alone."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1
            stop = min(n, max(stop, start + 1))
            yield (batch.slice(start, stop - start), data[offsets[start]:offsets[stop]],
                   offsets[start:stop + 1] - offsets[start])
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 (the base is odd), for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = []
        for base in (BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of bytes i..j-1, times BASE ** i."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data) + 1)
    np.cumsum(byte_codes()[data] * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of byte spans."""
    _, down = powers(len(prefix))
    raw = (prefix[stop] - prefix[start]) * down[start]
    return mix(raw + (stop - start).astype(np.uint64) * GOLDEN)


@lru_cache(maxsize=1)
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and bytes with A-Z lowered."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return inside, lower


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, starts and ends of words, and the n + 1 word offsets of the rows.

    A word is a run of 0-9, a-z and bytes from 0x80 on after lowering A-Z; since those are
    whole characters, it equals the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
    """
    inside, lower = word_tables()
    low = lower[data]
    mask = inside[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], mask[:-1])) if len(mask) else mask
    after = np.concatenate((mask[1:], [False])) if len(mask) else mask
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    stops = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return low, starts, stops, np.searchsorted(starts, offsets)


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the n + 1 offsets of the rows.

    A row with fewer words, but not none, has one shingle of all its words.
    """
    low, starts, stops, at = words(data, offsets)
    counts = np.diff(at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes = span_hashes(prefix_hashes(low), starts, stops)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(counts)), per_row)
    first = at[row] + np.arange(out_at[-1]) - out_at[row]
    length = np.minimum(counts[row], size)
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        place = np.uint64((k + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)
        term = mix(hashes[np.minimum(first + k, len(hashes) - 1)] + place)
        total += np.where(length > k, term, np.uint64(0))
    return mix(total), out_at


def row_key(*columns: Column | str) -> Column:
    """64-bit identity of a row; equal rows share it, nulls count as values."""
    every = [F.col(c) if isinstance(c, str) else c for c in columns]
    # the hash alone skips nulls, so (null, 'a') and ('a', null) would be one
    return F.xxhash64(*[x for c in every for x in (c.isNull(), c)])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back, so that lost executors cost nothing."""
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Benchmark passages in documents: a generalised suffix automaton over the items' words.

The automaton holds every run of words of every item.  A document's words walk through it; the
longest match that ends at each word tells which windows of the items occur there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.texts import row_key, slices, span_hashes, prefix_hashes, text_bytes, words

WINDOW = 13
# Items broadcast at once; a larger benchmark takes one pass per part.
PART_BYTES = 8 << 20


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, own in items:
            last = 0
            for word in own:
                last = self.extend(last, word)
        # windows end in the state that holds them: its longest string may be longer
        self.ends: list[dict[int, set[str]] | None] = [None] * len(self.next)
        for name, own in items:
            size = min(window, len(own))
            if not size:
                continue
            state = length = 0
            for word in own:
                state, length = self.step(state, length, word)
                if length >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    if self.ends[at] is None:
                        self.ends[at] = {}
                    self.ends[at].setdefault(size, set()).add(name)
        # windows that are suffixes of a state's strings, by way of its suffix links
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.found: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for state in order[1:]:
            own = tuple((n, frozenset(x)) for n, x in sorted((self.ends[state] or {}).items()))
            self.found[state] = self.found[self.link[state]] + own
        self.least = min((min(window, len(o)) for _, o in items if o), default=0)

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            found = self.next[last][word]
            if self.length[found] == self.length[last] + 1:
                return found
            return self.clone(last, word, found)
        state = self.add(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            found = self.next[last][word]
            exact = self.length[found] == self.length[last] + 1
            self.link[state] = found if exact else self.clone(last, word, found)
        return state

    def add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def clone(self, last: int, word: int, found: int) -> int:
        copy = self.add(self.length[last] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = copy
        while last >= 0 and self.next[last].get(word) == found:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def walk(self, own: list[int]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(end, size, items) of every window that ends at each word."""
        state = length = 0
        for end, word in enumerate(own, 1):
            state, length = self.step(state, length, word)
            if length >= self.least:
                for size, names in self.found[state]:
                    if size <= length:
                        yield end, size, names


class Matcher:
    """An automaton with the words of its items; words are known by 64-bit hashes."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([t or "" for _, t in items], pa.string())
        low, starts, stops, at = words(*text_bytes(texts))
        hashes = span_hashes(prefix_hashes(low), starts, stops)
        self.known, ranks = np.unique(hashes, return_inverse=True)
        ranks = ranks.tolist()
        self.machine = Automaton(
            [(n, ranks[a:b]) for (n, _), a, b in zip(items, at[:-1], at[1:], strict=True)], window)

    def runs(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(row, first word, ranks) of runs of known words that can hold a window.

        A word that no item has ends every match, so only these runs need the automaton.
        """
        least = self.machine.least
        if not least or not len(hashes):
            return
        rank = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        good = self.known[rank] == hashes
        edge = np.zeros(len(hashes) + 1, bool)
        edge[at] = True
        first = np.flatnonzero(good & (np.concatenate(([True], ~good[:-1])) | edge[:-1]))
        last = np.flatnonzero(good & (np.concatenate((~good[1:], [True])) | edge[1:])) + 1
        long = last - first >= least
        first, last = first[long], last[long]
        rows = np.searchsorted(at, first, "right") - 1
        for row, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
            yield row, a, rank[a:b].tolist()


@lru_cache(maxsize=1)
def matcher(items: tuple[tuple[str, str | None], ...], window: int) -> Matcher:
    return Matcher(list(items), window)


def parts(items: DataFrame, item_id: str, text: str, part_bytes: int) -> Iterator[list]:
    """The benchmark in lists of at most ``part_bytes`` of text (a longer item stands alone)."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    own, size = [], 0
    for r in rows.toLocalIterator():
        if own and size + len(r.text) > part_bytes:
            yield own
            own, size = [], 0
        own.append((r.id, r.text))
        size += len(r.text)
    if own:
        yield own


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None,
            part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document the words that item windows hit, and the items.

    Columns: those of ``keep`` (default: all), then ``n_words``, ``hits`` (ranges of words, first
    and last + 1, disjoint and ascending), ``spans`` (the same ranges in characters) and ``items``
    (ids as strings, sorted); columns of these names are replaced.  Items without words or id
    match nothing; items of one id count together.  Null texts have no words.  Repeated rows each
    give a row.

    A benchmark of up to ``part_bytes`` is broadcast whole and documents are only mapped over.
    A larger one is taken in parts of that size, a pass over the documents each, and the
    passes are merged per document; what is in memory at once stays bounded.
    """
    own = [c for c in keep or docs.columns if c not in ADDED]
    found = judged(docs, items, text, item_id, item_text, window, own, part_bytes)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(own)], *ADDED)


def judged(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int,
           own: list[str], part_bytes: int) -> DataFrame:
    """The result columns beside k0, k1, ... for the columns ``own``, so that no name clashes."""
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(own))]
    seen = names[own.index(text)] if text in own else "seen"  # a text that is kept is sent once
    narrow = docs.select(*[F.col(c).alias(k) for k, c in zip(names, own, strict=True)],
                         *[F.col(text).cast("string").alias(seen)] * (text not in own))
    def one_pass(batch: list | None, carried: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(tuple(batch)) if batch else None
        rows = narrow.withColumn("key", row_key(*narrow.columns)).select(*dict.fromkeys([*carried, seen]))
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
        return rows.mapInArrow(match_work(shared, window, carried, seen), (
            f"{kinds}, n_words long, hits array<array<long>>, spans array<array<long>>, "
            "items array<string>"))

    batches = list(parts(items, item_id, item_text, part_bytes))
    if len(batches) < 2:
        return one_pass(batches[0] if batches else None, names).select(*names, *ADDED)
    # equal rows have equal results, so passes are merged per distinct row and dealt out again
    found = one_pass(batches[0], ["key"])
    for batch in batches[1:]:
        found = found.unionByName(one_pass(batch, ["key"]))
    merged = found.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_set("hits")).alias("hits"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = merged.withColumns({c: F.udf(merge_ranges, "array<array<long>>")(c)
                                 for c in ("hits", "spans")})
    return narrow.withColumn("key", row_key(*narrow.columns)).join(merged, "key").select(*names, *ADDED)


ADDED = ["n_words", "hits", "spans", "items"]


def merge_ranges(ranges: list[list[int]] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges or ()):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def match_work(shared, window: int, carried: list[str], seen: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(shared.value if shared else (), window)
        for rows, data, offsets in slices(batches, seen):
            low, starts, stops, at = words(data, offsets)
            hashes = span_hashes(prefix_hashes(low), starts, stops)
            hits: list[list[list[int]]] = [[] for _ in range(rows.num_rows)]
            names: list[set[str]] = [set() for _ in range(rows.num_rows)]
            for row, first, ranks in own.runs(hashes, at):
                ranges = hits[row]
                base = first - int(at[row])
                for end, size, found in own.machine.walk(ranks):
                    names[row] |= found
                    a, b = base + end - size, base + end
                    while ranges and ranges[-1][1] >= a:
                        a = min(a, ranges.pop()[0])
                    ranges.append([a, b])
            spans: list[list[list[int]]] = []
            for row, ranges in enumerate(hits):
                spans.append([])
                if ranges:
                    begin, word = int(offsets[row]), int(at[row])
                    chars = np.concatenate(([0], np.cumsum(
                        (data[begin:int(offsets[row + 1])] & 0xC0) != 0x80)))
                    spans[-1] = [[int(chars[starts[word + a] - begin]),
                                  int(chars[stops[word + b - 1] - begin])] for a, b in ranges]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in carried], pa.array(np.diff(at), pa.int64()),
                 pa.array(hits, pa.list_(pa.list_(pa.int64()))),
                 pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                names=[*carried, *ADDED])

    return work


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])


def contaminated(share: int = 20, n_words: str = "n_words", hits: str = "hits") -> Column:
    """Some word is hit, and at least one word in ``share``."""
    return (n_hit(hits) > 0) & (share * n_hit(hits) >= F.col(n_words))


def without_spans(text: str, spans: Column) -> Column:
    """The text with character ranges cut out."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s[1]))
    starts = F.concat(F.transform(spans, lambda s: s[0]), F.array(F.length(text).cast("long")))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(
        F.col(text), (a + 1).cast("int"), (b - a).cast("int"))), "")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", share: int | None = 20,
                  span_words: int | None = None, item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents without the benchmark, columns as they were.

    A document goes if hits cover at least one word in ``share`` (None: none goes); in the others,
    hit ranges of at least ``span_words`` words are cut out of the text (None: none is cut).
    """
    own = docs.columns
    found = judged(docs, items, text, item_id, item_text, window, own, part_bytes)
    if share is not None:
        found = found.where(~contaminated(share))
    new = F.col(at := f"k{own.index(text)}")
    if span_words is not None:
        long = F.transform(F.filter(F.arrays_zip("hits", "spans"), lambda x: (
            x["hits"][1] - x["hits"][0]) >= span_words), lambda x: x["spans"])
        new = F.when(F.size(long) > 0, without_spans(at, long)).otherwise(new)
    return found.select(*[(new if c == text else F.col(f"k{i}")).alias(c) for i, c in enumerate(own)])

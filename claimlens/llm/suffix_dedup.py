"""Removal of repeated byte strings: anchors propose, suffix arrays over their contexts decide.

A byte goes if a string of ``length`` bytes that covers it starts earlier as well.  Every such
string holds an anchor, a run of ``ANCHOR`` bytes whose hash is the least in the string, and equal
strings hold equal anchors at equal places.  So only occurrences of the same anchor can share a
string, and its bytes lie in the anchor's context, ``length`` - ``ANCHOR`` bytes to either side.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.suffix_array import earlier_matches
from claimlens.llm.texts import mix, powers, prefix_hashes, slices, span_hashes, stored

LENGTH = 100
ANCHOR = 40
HOT = 20_000
SYMBOLS = 1 << 17
FLUSH = 1 << 19
SPAN, ASK, TEXT, WINDOW = 0, 1, 2, 3

# One occurrence: anchor and context hash, place of its document in the order, position in it,
# and how many bytes of context there are before and from the anchor on.
FOUND = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("pos", "<u4"),
                  ("left", "u1"), ("right", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("stop", "<u4")])
WANT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("pos", "<u4"), ("hot", "u1")])
STRING = np.dtype([("w", "<u8"), ("v", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4")])
ROW = "bucket long, kind int, data binary, bytes binary"
NAMES = ["bucket", "kind", "data", "bytes"]


def slide(x: np.ndarray, width: int, fn) -> np.ndarray:
    """fn over every run of ``width`` values, by doubling."""
    y, n, span = x, len(x), 1
    while span * 2 <= width:
        y = fn(y[:len(y) - span], y[span:])
        span *= 2
    return fn(y[:n - width + 1], y[width - span:n - span + 1]) if span < width else y


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, size: int) -> tuple:
    """Positions, hashes, rows, contexts before and after of all anchors, and the prefix hashes."""
    prefix = prefix_hashes(data)
    n, width = len(data), length - size + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none, prefix
    _, down = powers(n + 1)
    hashes = mix((prefix[size:] - prefix[:-size]) * down[:n - size + 1])
    least = slide(hashes, width, np.minimum)
    # strings that cross into the next document are none
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    least = np.where(np.cumsum(inside)[:-1] > 0, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    chosen = slide(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero((chosen == hashes) & (hashes > 0))
    row = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(at - offsets[row], length - size)
    right = np.minimum(offsets[row + 1] - at, length)
    return at, hashes[at], row, left, right, prefix


def emit(kind: int, records: np.ndarray, buckets: np.ndarray, many: int,
         texts: list[bytes] | None = None) -> Iterator[tuple]:
    """Rows of (bucket, kind, records, bytes), one for each bucket there is."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=many))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[a:b]
        yield (int(buckets[order[a]]), kind, records[own].tobytes(),
               b"".join([texts[i] for i in own]) if texts is not None else None)


def frame(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + len(row[3] or b"")
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=NAMES)


def spread(doc: np.ndarray, tie: np.ndarray, many: int) -> np.ndarray:
    """Bucket of each document; the texts of one id have their own."""
    own = mix(doc.astype(np.int64).view(np.uint64)) + tie.astype(np.uint64)
    return (mix(own) % np.uint64(many)).astype(np.int64)


def doc_rows(found: np.ndarray, starts: np.ndarray, stops: np.ndarray, many: int) -> Iterator[tuple]:
    """Removed ranges by bucket of their document, touching ones joined."""
    if not len(found):
        return
    out = np.empty(len(found), RANGE)
    out["doc"], out["tie"], out["start"], out["stop"] = found["doc"], found["tie"], starts, stops
    out = joined(out)
    yield from emit(SPAN, out, spread(out["doc"], out["tie"], many), many)


def joined(ranges: np.ndarray) -> np.ndarray:
    """Disjoint, separate, ascending ranges per document."""
    ranges = ranges[np.lexsort((ranges["start"], ranges["tie"], ranges["doc"]))]
    same = (ranges["doc"][1:] == ranges["doc"][:-1]) & (ranges["tie"][1:] == ranges["tie"][:-1])
    group = np.concatenate(([0], np.cumsum(~same)))
    reach = np.maximum.accumulate(ranges["stop"].astype(np.int64) + group * (1 << 33))
    new = np.ones(len(ranges), bool)
    new[1:] = ranges["start"][1:] + group[1:] * (1 << 33) > reach[:-1]
    at = np.flatnonzero(new)
    out = ranges[at]
    out["stop"] = reach[np.append(at[1:], len(ranges)) - 1] & ((1 << 33) - 1)
    return out


def by_document(records: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """First and last + 1 record of each document, in records sorted by document."""
    if not len(records):
        return {}
    new = np.flatnonzero(np.concatenate(([True], (records["doc"][1:] != records["doc"][:-1]) | (
        records["tie"][1:] != records["tie"][:-1])))).tolist()
    return {(int(records["doc"][a]), int(records["tie"][a])): (a, b)
            for a, b in zip(new, [*new[1:], len(records)], strict=True)}


def first_of_each(found: np.ndarray, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Records in order of the keys, then place; and where each run of equal keys begins."""
    found = found[np.lexsort((found["pos" if "pos" in found.dtype.names else "start"], found["tie"],
                              found["doc"], *[found[k] for k in reversed(keys)]))]
    new = np.ones(len(found), bool)
    same = np.ones(max(len(found) - 1, 0), bool)
    for k in keys:
        same &= found[k][1:] == found[k][:-1]
    new[1:] = ~same
    return found, new


def find_anchors(length: int, size: int, many: int):
    """Map: occurrences by anchor bucket.

    Of equal contexts in what a task holds at once only the earliest is sent on; the others are
    repeated for sure, so their ranges go straight to their documents.
    """
    def flush(held: list[np.ndarray]) -> Iterator[tuple]:
        found, new = first_of_each(np.concatenate(held), ("h", "c"))
        again = found[~new]
        # a repeated row is the same document, not a copy
        leader = found[new][np.cumsum(new)[~new] - 1]
        again = again[(again["doc"] != leader["doc"]) | (again["tie"] != leader["tie"]) | (
            again["pos"] != leader["pos"])]
        again = again[again["left"].astype(np.int64) + again["right"] >= length]
        for bucket, kind, data, _ in doc_rows(again, again["pos"] - again["left"], again["pos"] + again["right"], many):
            yield bucket, kind, data, None
        found = found[new]
        yield from emit(ASK, found, (found["h"] % np.uint64(many)).astype(np.int64), many)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, count = [], 0
        for part, data, offsets in slices(batches, "text"):
            at, hashes, row, left, right, prefix = anchors(data, offsets, length, size)
            out = np.empty(len(at), FOUND)
            out["h"], out["c"] = hashes, span_hashes(prefix, at - left, at + right)
            out["doc"] = part.column("doc").to_numpy()[row]
            out["tie"] = part.column("tie").to_numpy()[row]
            out["pos"], out["left"], out["right"] = at - offsets[row], left, right
            held.append(out)
            count += len(out)
            if count > FLUSH:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frame(rows(batches))

    return find


def grouped(batches: Iterator[pa.RecordBatch], names: list[str] = NAMES) -> Iterator[tuple[int, Iterator]]:
    """(bucket, rows) of a partition sorted by bucket; rows are streamed and must be used up."""
    def flat() -> Iterator[tuple]:
        for batch in batches:
            cols = [batch.column(c) for c in names]
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in cols)

    rows = flat()
    head = next(rows, None)

    def run(bucket: int) -> Iterator[tuple]:
        nonlocal head
        while head is not None and head[0] == bucket:
            row, head = head, None
            yield row
            head = next(rows, None)

    while head is not None:
        yield head[0], run(head[0])


def compare_hashes(length: int, many: int, hot: int):
    """Reduce by anchor: equal contexts are settled, different ones of an anchor are asked for."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, own in grouped(batches):
            held = []
            for row in own:
                if row[1] == SPAN:
                    yield row
                else:
                    held.append(np.frombuffer(row[2], FOUND))
            if not held:
                continue
            found, new = first_of_each(np.concatenate(held), ("h", "c"))
            again = found[~new]
            leader = found[new][np.cumsum(new)[~new] - 1]
            other = (again["doc"] != leader["doc"]) | (again["tie"] != leader["tie"]) | (again["pos"] != leader["pos"])
            again = again[other & (again["left"].astype(np.int64) + again["right"] >= length)]
            yield from doc_rows(again, again["pos"] - again["left"], again["pos"] + again["right"], many)
            reps = found[new]
            _, group, share = np.unique(reps["h"], return_inverse=True, return_counts=True)
            reps, share = reps[share[group] > 1], share[group][share[group] > 1]
            want = np.empty(len(reps), WANT)
            for k in ("h", "doc", "tie", "pos"):
                want[k] = reps[k]
            want["hot"] = share > hot
            yield from emit(ASK, want, spread(want["doc"], want["tie"], many), many)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frame(rows(batches))

    return compare


def cut_contexts(length: int, size: int, many: int):
    """Documents with what is asked of them: contexts by anchor bucket, for hot anchors strings."""
    def flush(ctx: list, texts: list, hot: list) -> Iterator[tuple]:
        if ctx:
            records = np.array(ctx, FOUND)
            yield from emit(TEXT, records, (records["h"] % np.uint64(many)).astype(np.int64), many, texts)
        if hot:
            found, new = first_of_each(np.concatenate(hot), ("w", "v"))
            again = found[~new]
            leader = found[new][np.cumsum(new)[~new] - 1]
            again = again[(again["doc"] != leader["doc"]) | (again["tie"] != leader["tie"])
                          | (again["start"] != leader["start"])]
            yield from doc_rows(again, again["start"], again["start"] + length, many)
            found = found[new]
            yield from emit(WINDOW, found, (found["w"] % np.uint64(many)).astype(np.int64), many)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        ctx, texts, hot, count = [], [], [], 0
        for _, own in grouped(batches, ["bucket", "kind", "data", "bytes", "doc", "tie"]):
            held, asked, edges = [], None, {}
            for _, kind, data, packed, doc, tie in own:
                if kind == ASK:
                    held.append(np.frombuffer(data, WANT))
                    continue
                if asked is None:
                    asked = np.concatenate(held) if held else np.zeros(0, WANT)
                    asked = asked[np.lexsort((asked["pos"], asked["tie"], asked["doc"]))]
                    edges = by_document(asked)
                # a repeated row answers once
                mine = edges.pop((doc, tie), None)
                if mine is None:
                    continue
                text = unpack(packed)
                some = asked[mine[0]:mine[1]]
                for h, pos, is_hot in zip(some["h"].tolist(), some["pos"].tolist(), some["hot"].tolist(), strict=True):
                    left = min(pos, length - size)
                    right = min(len(text) - pos, length)
                    count += 1
                    if is_hot:
                        piece = np.frombuffer(text, np.uint8)[pos - left:pos + right]
                        if len(piece) < length:
                            continue
                        prefix = prefix_hashes(piece)
                        starts = np.arange(len(piece) - length + 1)
                        out = np.empty(len(starts), STRING)
                        out["w"] = span_hashes(prefix, starts, starts + length)
                        out["v"] = strong(piece, starts, length)
                        out["doc"], out["tie"], out["start"] = doc, tie, pos - left + starts
                        hot.append(out)
                        count += len(starts)
                    else:
                        ctx.append((h, 0, doc, tie, pos, left, right))
                        texts.append(text[pos - left:pos + right])
                if count > FLUSH // 4:
                    yield from flush(ctx, texts, hot)
                    ctx, texts, hot, count = [], [], [], 0
        yield from flush(ctx, texts, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frame(rows(batches))

    return cut


def strong(piece: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A second, independent hash of each string."""
    data = piece.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(data[s:s + length], digest_size=8).digest(), "little")
                     for s in starts.tolist()], np.uint64)


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return bisect_left(range(1, n + 1), True, key=lambda k: a[:k] != b[:k])


def compare_contexts(length: int, size: int, many: int):
    """Reduce by anchor: suffix arrays over the contexts find strings that start earlier.

    What all contexts of an anchor share around it becomes one symbol, and what no two share is
    left off; the rest of many anchors is one text.  A match that holds the anchor's symbol is a
    match at the same place, so the longest match with an earlier context tells the strings.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, own in grouped(batches):
            records, texts, strings = [], [], []
            for _, kind, data, packed in own:
                if kind == SPAN:
                    yield _, kind, data, packed
                elif kind == WINDOW:
                    strings.append(np.frombuffer(data, STRING))
                else:
                    part = np.frombuffer(data, FOUND)
                    records.append(part)
                    ends = np.cumsum(part["left"].astype(np.int64) + part["right"]).tolist()
                    texts += [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            if strings:
                found, new = first_of_each(np.concatenate(strings), ("w", "v"))
                again = found[~new]
                leader = found[new][np.cumsum(new)[~new] - 1]
                again = again[(again["doc"] != leader["doc"]) | (again["tie"] != leader["tie"])
                              | (again["start"] != leader["start"])]
                yield from doc_rows(again, again["start"], again["start"] + length, many)
            if records:
                found = np.concatenate(records)
                order = np.lexsort((found["pos"], found["tie"], found["doc"], found["h"]))
                yield from settle(found[order], [texts[i] for i in order.tolist()])

    def settle(found: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
        edges = np.flatnonzero(np.diff(found["h"], prepend=found["h"][:1] + np.uint64(1))).tolist()
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((found["pos"], found["tie"], found["doc"]))] = np.arange(len(found))
        rank, lefts = rank.tolist(), found["left"].tolist()
        text: list[int] = []
        owner: list[int] = []
        least: list[int] = []  # a match counts if the anchor's symbol is in it
        marks: list[tuple] = []  # (context, place of its symbol, letters before it, shared before, after)
        hits: list[tuple[int, int, int]] = []
        for a, b in zip(edges, [*edges[1:], len(found)], strict=True):
            before = [texts[i][:lefts[i]][::-1] for i in range(a, b)]
            after = [texts[i][lefts[i] + size:] for i in range(a, b)]
            core_l, keep_l = shared_and_needed(before)
            core_r, keep_r = shared_and_needed(after)
            symbol = 1000 + len(marks)
            for i in range(a, b):
                head = before[i - a][core_l:keep_l[i - a]][::-1]
                tail = after[i - a][core_r:keep_r[i - a]]
                marks.append((i, len(text) + len(head), len(head), core_l, core_r))
                text += [x + 1 for x in head]
                text.append(symbol)
                text += [x + 1 for x in tail]
                text.append(0)
                owner += [rank[i]] * (len(head) + len(tail) + 2)
                least += [*range(len(head) + 1, 0, -1), *[0] * (len(tail) + 1)]
            if len(text) > SYMBOLS:
                hits += judge(text, owner, least, marks)
                text, owner, least, marks = [], [], [], []
        if text:
            hits += judge(text, owner, least, marks)
        if hits:
            who = found[[i for i, _, _ in hits]]
            pos = who["pos"].astype(np.int64)
            yield from doc_rows(who, pos - [o for _, o, _ in hits], pos + length - [o for _, _, o in hits], many)

    def judge(text: list[int], owner: list[int], least: list[int], marks: list[tuple]) -> list[tuple[int, int, int]]:
        """(context, first, last offset) of strings that start earlier: so many bytes before the anchor."""
        best = earlier_matches(text, owner, least)
        hits = []
        for n, (i, at, letters, core_l, core_r) in enumerate(marks):
            stop = (marks[n + 1][1] - marks[n + 1][2] if n + 1 < len(marks) else len(text)) - 1
            run = None
            for t in range(letters + 1):
                here = at - t
                match = min(best[here], stop - here)
                if match <= t:  # the anchor is not in it
                    continue
                reach = size + core_r + match - t - 1
                if t:
                    low = high = core_l + t
                    if reach < length - high:
                        continue
                else:
                    low, high = max(0, length - reach), core_l
                    if low > high:
                        continue
                if run and run[1] + 1 == low:
                    run[1] = high
                else:
                    if run:
                        hits.append((i, run[1], run[0]))
                    run = [low, high]
            if run:
                hits.append((i, run[1], run[0]))
        return hits

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frame(rows(batches))

    return match


def shared_and_needed(sides: list[bytes]) -> tuple[int, list[int]]:
    """What all share, and for each how far it agrees with any other."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    ranked = [sides[i] for i in order]
    near = [shared_prefix(x, y) for x, y in zip(ranked[:-1], ranked[1:], strict=True)]
    need = [0] * len(sides)
    for at, i in enumerate(order):
        need[i] = max(near[at - 1] if at else 0, near[at] if at < len(near) else 0)
    return (min(near) if near else 0), need


def buckets(spark: SparkSession) -> int:
    """Buckets of the shuffles: one for each shuffle partition, so they follow the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, many: int) -> DataFrame:
    """One partition for each bucket: hashed again, some would get several and others none."""
    return df.repartitionById(many, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
            anchor: int = ANCHOR, keep: list[str] | None = None, with_text: bool = False,
            hot: int = HOT) -> DataFrame:
    """Which bytes of each text repeat an earlier string of ``length`` bytes.

    Columns: those of ``keep`` (default: the key; result names are replaced), ``n_bytes``, ``n_removed``, ``n_spans`` (removed
    runs), ``kept_sha256`` (of the remaining bytes end to end), and with ``with_text`` ``kept``, the
    remaining characters (a character goes if any of its bytes does).  Texts count as UTF-8; null is
    empty; matches never cross documents.  Documents are ordered by the key, an integer (null
    first), and repeated rows are one document: they do not repeat each other, and each gets its
    result.  Rows of one key and different texts are told apart and ordered by a
    64-bit hash of the text.

    Shuffles: anchors by hash (of equal contexts one per task buffer), documents twice with their
    texts compressed, contexts of anchors that do not settle themselves.  An anchor with more
    than ``hot`` different contexts is not gathered: its strings are hashed one by one and dealt
    out by that hash, the earliest of each per task buffer.
    """
    kept = [c for c in keep or [doc_id] if c not in RESULT]
    found = judged(docs, doc_id, text, length, anchor, kept, with_text, hot)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *RESULT[:4],
                        *["kept"] * with_text)


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def judged(docs: DataFrame, doc_id: str, text: str, length: int, anchor: int, kept: list[str],
           with_text: bool, hot: int) -> DataFrame:
    """The result columns beside k0, k1, ... for the columns ``kept``, so that no name clashes."""
    spark = docs.sparkSession
    many = buckets(spark)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)],
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    found = rows.select("doc", "tie", "text").mapInArrow(find_anchors(length, anchor, many), ROW)
    settled = stored(ordered(found, many).mapInArrow(compare_hashes(length, many, hot), ROW), "anchors")
    carried = [c for c in rows.columns if c.startswith("k")]
    packed = pack(rows, carried, many)
    asked = settled.where(f"kind = {ASK}").withColumns({"doc": F.lit(0).cast("long"), "tie": F.lit(0).cast("long")})
    answers = ordered(packed.select(*NAMES, "doc", "tie").union(asked.select(*NAMES, "doc", "tie")), many).mapInArrow(
        cut_contexts(length, anchor, many), ROW)
    more = ordered(answers, many).mapInArrow(compare_contexts(length, anchor, many), ROW)
    spans = settled.where(f"kind = {SPAN}").union(more)
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in carried} | {
        "doc": F.lit(0).cast("long"), "tie": F.lit(0).cast("long")}
    both = packed.select(*NAMES, "doc", "tie", *carried).union(
        spans.withColumns(nothing).select(*NAMES, "doc", "tie", *carried))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    schema = kinds + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return ordered(both, many).mapInArrow(apply_spans(carried, with_text), schema + ", kept string" * with_text)


def pack(rows: DataFrame, carried: list[str], many: int) -> DataFrame:
    """Documents by bucket with compressed texts, as rows of kind TEXT."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                doc, tie = part.column("doc").to_numpy(), part.column("tie").to_numpy()
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread(doc, tie, many)), pa.array([TEXT] * n, pa.int32()), pa.nulls(n, pa.binary()),
                     pa.array([squeeze(t.encode()) for t in part.column("text").to_pylist()], pa.binary()),
                     part.column("doc"), part.column("tie"), *[part.column(c) for c in carried]],
                    names=[*NAMES, "doc", "tie", *carried])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.select("doc", "tie", "text", *carried).mapInArrow(work, f"{ROW}, doc long, tie long, {kinds}")


def apply_spans(carried: list[str], with_text: bool):
    """Documents with the ranges found for them, bucket by bucket."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, own in grouped(batches, [*NAMES, "doc", "tie", *carried]):
            held, edges = [], None
            for _, kind, data, packed, doc, tie, *keep in own:
                if kind == SPAN:
                    held.append(np.frombuffer(data, RANGE))
                    continue
                if edges is None:
                    ranges = joined(np.concatenate(held)) if held else np.zeros(0, RANGE)
                    edges = by_document(ranges)
                text = unpack(packed)
                a, b = edges.get((doc, tie), (0, 0))
                cuts = list(zip(ranges["start"][a:b].tolist(), ranges["stop"][a:b].tolist(), strict=True)) if a < b else []
                pieces = [text[x:y] for x, y in zip([0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(text)],
                                                    strict=True)]
                left = b"".join(pieces)
                row = [*keep, len(text), len(text) - len(left), len(cuts), hashlib.sha256(left).hexdigest()]
                if with_text:
                    row.append("".join(p.decode(errors="ignore") for p in pieces))
                yield row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kinds = [], 0, None

        def close() -> pa.RecordBatch:
            tail = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            names = [*carried, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), [*kinds, *tail])], names=names)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(c).type for c in carried]
                yield batch

        for row in rows(watched()):
            held.append(row)
            size += 200 + (len(row[-1]) if with_text else 0)
            if size > 4 << 20:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return work


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Documents whose texts have lost what they repeat, columns as they were.

    Documents of which nothing but white space is left go; a text that was empty before stays.
    ``n_chars``, where there is one, is counted anew.
    """
    own = docs.columns
    found = judged(docs, doc_id, text, length, anchor, own, True, hot)
    found = found.where("n_removed = 0 OR trim(kept) != ''")
    new = {text: F.col("kept"), "n_chars": F.length("kept")}
    return found.select(*[
        F.when(F.col("n_removed") > 0, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"k{i}")).alias(c)
        if c in new else F.col(f"k{i}").alias(c) for i, c in enumerate(own)])

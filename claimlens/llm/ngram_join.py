"""Near-duplicate join: MinHash bands propose, full shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.graph import components
from claimlens.llm.texts import GOLDEN, mix, row_key, slices, stored, word_shingles

SHINGLE = 5
# Similarity as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
ROWS = 5
RECALL = 0.99999
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1 << 19
DENSE_FROM = 24


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` hashes that propose a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def signatures(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """id, key, node (identity of the shingle set, null without words), n_shingles, bands.

    Bands are given for the first document of a set in a slice only, so copies cost little.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, rows * bands + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        for part, data, offsets in slices(batches, "text"):
            hashes, at = word_shingles(data, offsets, size)
            full = np.flatnonzero(np.diff(at))
            node = np.zeros(part.num_rows, np.int64)
            count = np.zeros(part.num_rows, np.int64)
            chosen: list[list[int] | None] = [None] * part.num_rows
            if len(full):
                starts = at[full]
                row = np.repeat(np.arange(len(full)), np.diff(at)[full])
                order = np.lexsort((hashes, row))
                ranked = hashes[order]
                new = np.ones(len(ranked), bool)
                new[1:] = (ranked[1:] != ranked[:-1]) | (row[1:] != row[:-1])
                distinct = np.add.reduceat(new.astype(np.int64), starts)
                total = np.add.reduceat(np.where(new, mix(ranked + GOLDEN), np.uint64(0)), starts)
                node[full] = mix(total + distinct.astype(np.uint64) * GOLDEN).view(np.int64)
                count[full] = distinct
                _, first = np.unique(node[full], return_index=True)
                first.sort()
                signs = minima(hashes, starts, salts, np.diff(np.append(starts, len(hashes))))[:, first]
                keys = band_keys(signs, rows, bands)
                for i, own in zip(full[first].tolist(), keys.T.tolist(), strict=True):
                    chosen[i] = own
            none = np.diff(at) == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(node, pa.int64(), mask=none),
                 pa.array(count, pa.int64()), pa.array(chosen, pa.list_(pa.int64()))], names=names)

    names = ["id", "key", "node", "n_shingles", "bands"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", "text").mapInArrow(
        work, f"id {kind}, key long, node long, n_shingles long, bands array<long>")


def minima(hashes: np.ndarray, starts: np.ndarray, salts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least salted hash of each row per salt."""
    out = np.empty((len(salts), len(starts)), np.uint64)
    for i, salt in enumerate(salts):
        out[i] = np.minimum.reduceat((hashes ^ (salt >> np.uint64(7))) * salt, starts)
    return out


def band_keys(signs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    grouped = signs.reshape(bands, rows, -1)
    keys = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)[:, None], signs.shape[1], axis=1)
    for r in range(rows):
        keys = mix(keys + grouped[:, r])
    return keys.view(np.int64)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays, without a pass per pair."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    share = np.diff(np.append(edge, len(flat)))
    out = np.zeros((n, n), np.int64)
    for d in np.unique(share).tolist():
        if d < 2:
            continue
        if d >= DENSE_FROM:
            break
        members = owner[edge[share == d][:, None] + np.arange(d)]
        step = max(1, (1 << 21) // (d * d))
        for a in range(0, len(members), step):
            own = members[a:a + step]
            pairs = (own[:, :, None] * n + own[:, None, :]).ravel()
            out += np.bincount(pairs, minlength=n * n).reshape(n, n)
    heavy = share >= DENSE_FROM
    first, width = edge[heavy], share[heavy]
    step = max(1, (1 << 22) // n)
    for a in range(0, len(first), step):
        f, w = first[a:a + step], width[a:a + step]
        table = np.zeros((n, len(f)), np.float32)
        at = np.repeat(f - np.concatenate(([0], np.cumsum(w)[:-1])), w) + np.arange(w.sum())
        table[owner[at], np.repeat(np.arange(len(f)), w)] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    label = np.arange(len(linked))
    own = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(own, label[None, :], len(linked)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, links, root) from the blocks of candidate components; ``docs`` has text and placement."""
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            hashes, at = word_shingles(data, offsets, size)
            nodes = part.column("node").to_pylist()
            take = sorted({n: i for i, n in reversed(list(enumerate(nodes)))}.values())
            own = part.take(pa.array(take, pa.int64()))
            sets = [np.unique(hashes[at[i]:at[i + 1]]).tobytes() for i in take]
            yield pa.RecordBatch.from_arrays(
                [*[own.column(c) for c in ("comp", "blocks", "node", "copies")],
                 pa.array(sets, pa.binary())], names=["comp", "blocks", "node", "copies", "data"])

    def judge(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch:
        """rows: (block, node, copies, data) of the blocks i and j; links inside a block are counted at (i, i)."""
        rows = list({r[1]: r for r in rows}.values())
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        block = np.array([r[0] for r in rows])
        both = common(sets)
        # num / den <= both / (a + b - both), in whole numbers
        linked = (num + den) * both >= num * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        cross = block[:, None] != block[None, :]
        counted = linked if i == j else linked & cross
        links = counted @ np.array([r[2] for r in rows], np.int64)
        roots = local_roots(linked)
        some = np.flatnonzero(linked.any(axis=1))
        node = np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[some]), pa.array(links[some], pa.int64()), pa.array(node[roots[some]])],
            names=["node", "links", "root"])

    def settle(key: tuple | None, group: list[tuple]) -> Iterator[pa.RecordBatch]:
        # with one of two blocks empty there is nothing that (i, i) has not settled
        if len(group) > 1 and (key[1] == key[2] or len({r[0] for r in group}) > 1):
            yield judge(*key[1:], group)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("comp", "i", "j", "block", "node", "copies", "data")]
            for comp, i, j, *row in zip(*cols, strict=True):
                if (comp, i, j) != key:
                    yield from settle(key, group)
                    group, key = [], (comp, i, j)
                group.append(tuple(row))
        yield from settle(key, group)

    sets = docs.select("comp", "blocks", "node", "copies", "text").mapInArrow(
        shingle, "comp long, blocks long, node long, copies long, data binary")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           "block", "node", "copies", "data")
    return placed.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(
        pairs, "node long, links long, root long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
         num: int = NUMERATOR, den: int = DENOMINATOR, rows: int = ROWS, recall: float = RECALL,
         with_key: bool = False) -> DataFrame:
    """Classes and links of documents whose sets of ``size``-word shingles have Jaccard >= num / den.

    Columns: the key, ``class_id`` (least key of the documents that links connect), ``n_links``
    (other documents it is linked to, equal sets and copies included), ``n_shingles`` (distinct).
    A text of fewer words has one shingle of all of them; null texts and texts without words have
    none and link to nothing, not even to each other.  Repeated rows are documents of their own.
    An empty table gives none.

    * Documents of one shingle set become one node, so copies are never paired.
    * Bands are shuffled by hash; a bucket only gives stars to its least node, never pairs.  The
      components of these stars hold every pair that shares a band.  Bands follow from the
      recall wanted at the limit; verification looks at all pairs of a component, which only adds.
    * Components are verified exactly in blocks of bounded size: a component of m nodes takes
      its blocks two by two, in as many tasks, and each gives sums and one edge a node.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("key", row_key("id", "text"))
    signed = stored(signatures(own, size, rows, bands_for(num / den, rows, recall)), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("key").alias("key"), F.max("n_shingles").alias("size"))
    bands = signed.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    stars = bands.join(buckets.where("low != high").select("band", "low"), "band").where("node != low")
    near = components(stars.select(F.col("low").alias("src"), F.col("node").alias("dst")))
    placed = stored(near.join(nodes, "node"), "candidates")
    shape = placed.groupBy("comp").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    # always merged: a small side must not turn into a broadcast here that larger data would undo
    found = own.select("key", "text").join(placed.join(shape, "comp").hint("merge"), "key")
    judged = stored(verify(found, size, num, den), "links")
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(judged.select(F.col("root").alias("src"), F.col("node").alias("dst")))
    by_node = nodes.select("node", "copies").join(links, "node", "left").join(classes, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("class"),
        (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    each = signed.select("id", "key", "node", "n_shingles").join(by_node, "node", "left")
    least = each.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"))
    return each.join(least, "class", "left").select(
        F.col("id").alias(doc_id), *["key"] * with_key,
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_shingles",
        *[F.coalesce("class", "key").alias("class")] * with_key)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: the one with the least key, columns as they were.

    Texts without words are classes of their own, repeated rows of such a text one together.
    """
    own = docs.columns
    kept = join(docs, doc_id, text, with_key=True, **options)
    first = kept.groupBy("class").agg(F.min(F.struct(F.col(doc_id).isNull(), doc_id, "key")).alias("x"))
    keyed = docs.withColumn("__key", row_key(F.col(doc_id), F.col(text).cast("string")))
    picked = keyed.join(first.select(F.col("x.key").alias("__key")), "__key", "left_semi")
    once = Window.partitionBy("__key").orderBy(F.lit(0))
    return picked.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*own)

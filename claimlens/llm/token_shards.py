"""Token ids in binary shards with a minimal perfect hash index.

A shard is one row of a Parquet file: the raw ids of consecutive documents end to end
(``payload``, little-endian, two or four bytes an id), and an index from document keys to
offsets.  The index is a minimal perfect hash (hash and displace): a seed per bucket sends
each of the n keys to its own one of n slots; a slot stores a fingerprint of its key, so that
an unknown key is told apart, and where the documents of that key are in the payload.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.llm import bpe
from claimlens.llm.bpe import PieceEncoder, Store
from claimlens.llm.texts import slices, text_bytes
from claimlens.session import work_dir

SHARD_BYTES = 4 << 20
PREFIX = 64
SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4")])


def key_bytes(key: object) -> bytes:
    """Bytes of a document key; null is a key of its own."""
    return b"\0" if key is None else b"\1" + str(key).encode()


def hashed(key: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(key, seed)


def build_index(keys: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Seeds per bucket (negative: the slot itself) and the slot of each of the distinct keys."""
    n = len(keys)
    seeds = np.zeros(n, "<i4")
    buckets: dict[int, list[int]] = {}
    for i, key in enumerate(keys):
        buckets.setdefault(hashed(key, 0) % n, []).append(i)
    slots, taken = [-1] * n, [False] * n
    for bucket, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(members) == 1:
            break
        seed = 1
        while True:
            at = [hashed(keys[i], seed) % n for i in members]
            if len(set(at)) == len(at) and not any(taken[s] for s in at):
                break
            seed += 1
        seeds[bucket] = seed
        for i, s in zip(members, at, strict=True):
            slots[i], taken[s] = s, True
    free = (s for s in range(n) if not taken[s])
    for bucket, members in buckets.items():
        if len(members) == 1:
            slots[members[0]] = s = next(free)
            seeds[bucket] = -s - 1
    return seeds, slots


def find_slot(seeds: np.ndarray, slots: np.ndarray, key: bytes) -> int:
    """Slot of a key in constant time, or -1 if its fingerprint is not there."""
    n = len(seeds)
    if n == 0:
        return -1
    seed = int(seeds[hashed(key, 0) % n])
    slot = -seed - 1 if seed < 0 else hashed(key, seed) % n
    return slot if int(slots[slot]["fingerprint"]) == hashed(key, 1 << 32) >> 32 else -1


class LibraryEncoder(PieceEncoder):
    """The tokenizers library encodes each distinct piece of a worker once, many in one text.

    A line feed between two characters that are not white space is a pre-token of its own, so texts
    fall into pieces there too; such a piece begins with the line feed, others with a space that is
    not written.  Marks after a letter or number begin a pre-token, so a piece that ends in marks is
    made of the ids of what is before them and of theirs.  Arrow cuts the texts and numbers their
    pieces; Python sees each distinct piece of a call once.
    """

    RUN = 512
    MARKS = string.punctuation

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        super().__init__(lambda words: [w.tobytes() for w in self.ids(words)], special)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        # bytes that an id stands for; an added token, which no piece holds, counts as none
        self.widths = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = 0 if token in special else len(token)
        self.pieces = Store(2 * bpe.STORE_BYTES)  # few words are met outside of pieces

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, missing: list[str]) -> dict[str, bytes]:
        marked, whole = {}, [*filter(str.isalpha, missing)]
        for p in filterfalse(str.isalpha, missing):
            body = p.rstrip(self.MARKS)
            if len(body) < len(p) and body and body[-1] < "\u0250" and body[-1].isalnum():
                marked[p] = body
            else:
                whole.append(p)
        bodies = {b: self.pieces.get(b) for b in marked.values()}
        found = self.encode_runs([*{b for b, ids in bodies.items() if ids is None}.union(whole)])
        ends = [p[len(b):] for p, b in marked.items()]
        tails = {e: self.words.get(e) for e in ends}
        new = [e for e, ids in tails.items() if ids is None]
        learnt = dict(zip(new, self.encode_words(new), strict=True))
        self.words.keep(learnt)
        tails.update(learnt)
        found.update([(p, (bodies[b] or found[b]) + tails[e]) for (p, b), e in zip(marked.items(), ends, strict=True)])
        return found

    def encode_runs(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces end to end, many in one text; its ids are dealt out by the bytes they stand for."""
        found = {}
        full = [p if p[0] == "\n" else " " + p for p in pieces]
        places = text_bytes(pa.array(full, pa.large_string()))[1]
        for at in range(0, len(pieces), self.RUN):
            run, stops = pieces[at:at + self.RUN], places[at + 1:at + self.RUN + 1] - places[at]
            ids, = self.ids(["".join(full[at:at + self.RUN])])
            reach = np.cumsum(self.widths[ids])
            cuts = np.searchsorted(reach, stops)
            if len(reach) and reach[-1] == stops[-1] and (reach[cuts] == stops).all():
                data, cuts = ids.tobytes(), (4 * cuts + 4).tolist()
                found.update(zip(run, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
            else:  # an added token came up where two pieces meet
                found.update(zip(run, self.encode_words(full[at:at + self.RUN]), strict=True))
        return found

    def odd(self, pieces: list[str]) -> set[str]:
        """Pieces that are empty, or begin or end with white space: the cut beside them is none."""
        joined = " ".join(pieces)
        words = joined.split()
        spaces = joined.count(" ") + joined.count("\n")
        if len(words) == len(pieces) and sum(map(len, words)) == len(joined) - spaces:
            return set()  # no white space but a line feed before a word
        return {p for p in pieces if not p or p[-1].isspace() or p[p[0] == "\n"].isspace()}

    def plain(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy()
        own = np.ones(offsets[-1], bool)
        own[offsets[:-1]] = False  # what begins a text has no space before it
        heads = strings(cut.values.take(cut.offsets[:-1]))
        coded = cut.values.filter(pa.array(own)).dictionary_encode()
        codes, wanted = coded.indices.to_numpy(), strings(coded.dictionary)
        offsets = offsets - np.arange(len(offsets))
        parts = [*map(self.pieces.get, wanted)]
        missing = [p for p, ids in zip(wanted, parts, strict=True) if ids is None]
        careful = {i for i, (h, more) in enumerate(zip(heads, np.diff(offsets).tolist(), strict=True))
                   if more and (not h or h[-1].isspace())}
        if odd := self.odd(missing):
            at = np.flatnonzero(np.array([p in odd for p in wanted])[codes])
            careful.update((np.searchsorted(offsets, at, "right") - 1).tolist())
        if careful:
            rest = [i for i in range(len(texts)) if i not in careful]
            done = dict(zip(careful, super().plain([texts[i] for i in careful]), strict=True))
            done.update(zip(rest, self.plain([texts[i] for i in rest]) if rest else [], strict=True))
            return [done[i] for i in range(len(texts))]
        found = self.encode_pieces(missing)
        self.pieces.keep(found)
        parts = [found[p] if ids is None else ids for p, ids in zip(wanted, parts, strict=True)]
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.array([*map(len, parts)], np.int64) // 4
        first, many = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate(([0], np.cumsum(many)))
        out = ids[np.repeat(first[codes] - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        ends = (4 * ends[offsets]).tolist()
        return [h + out[a:b] for h, a, b in zip(self.heads(heads), ends[:-1], ends[1:], strict=True)]


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def library_encoder(file: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return LibraryEncoder(tokenizer)


def shard_row(keys: list, ids: list[bytes], width: int) -> dict:
    runs: dict[bytes, list[int]] = {}
    names: list[bytes] = []
    for i, key in enumerate(map(key_bytes, keys)):
        if key not in runs:
            runs[key] = [i, 0]
            names.append(key)
        runs[key][1] += 1
    seeds, at = build_index(names)
    slots = np.zeros(len(names), SLOT)
    for name, slot in zip(names, at, strict=True):
        slots[slot] = (hashed(name, 1 << 32) >> 32, *runs[name])
    lengths = np.array([len(x) // 4 for x in ids], "<u8")
    payload = np.frombuffer(b"".join(ids), "<u4")
    return {"n_docs": len(ids), "n_ids": len(payload),
            "keys": keys, "lengths": lengths.tobytes(), "seeds": seeds.tobytes(),
            "slots": slots.tobytes(),
            "payload": payload.astype("<u2").tobytes() if width == 2 else payload.tobytes()}


def write_shards(docs: DataFrame, file: str, end_id: int = 0, doc_id: str = "doc_id",
                 text: str = "text", shard_bytes: int = SHARD_BYTES, path: str | None = None) -> str:
    """Encode every whole text, close it with ``end_id``, write shards; returns their folder.

    Documents lie in ascending order of the key (null first; repeated keys by the first
    ``PREFIX`` characters of the text, then by its hash, all kept), dealt out by ranges of that
    order, so neither a driver nor a task sees more than its range and the different texts of a
    hot key are dealt out too; equal rows meet in one task.  A shard is closed at ``shard_bytes``
    of ids, also inside a key, whose other documents are then in the index of the next shard; one
    longer document stands alone.  Null and empty texts are just
    the end id.  Other columns are not looked at; no documents give no shards.
    """
    spark = docs.sparkSession
    path = path or work_dir(spark, "token-shards")
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    key_type = narrow.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library_encoder(file)
        width = 2 if vocabulary_size(file) <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part, seq, inside = TaskContext.get().partitionId(), 0, 0
        keys, ids, size, kind = [], [], 0, None

        def close() -> pa.RecordBatch:
            row = shard_row(keys, ids, width) | {"part": part, "seq": seq, "width": width, "inside": inside}
            return pa.RecordBatch.from_pydict(
                {k: pa.array([row[k]], pa.list_(kind) if k == "keys" else
                             pa.binary() if isinstance(row[k], bytes) else pa.int64()) for k in names})

        for piece, _, _ in slices(batches, "text"):
            kind = piece.schema.field(0).type
            own = encoder.encode([t or "" for t in piece.column(1).to_pylist()])
            for key, data in zip(piece.column(0).to_pylist(), own, strict=True):
                if ids and size + len(data) > shard_bytes:
                    yield close()
                    inside += size // 4
                    keys, ids, size, seq = [], [], 0, seq + 1
                keys.append(key)
                ids.append(data + end)
                size += len(data) + 4
        if ids:
            yield close()

    names = ["part", "seq", "inside", "width", "n_docs", "n_ids", "keys", "lengths", "seeds", "slots", "payload"]
    schema = (f"part long, seq long, inside long, width long, n_docs long, n_ids long, keys array<{key_type}>, "
              "lengths binary, seeds binary, slots binary, payload binary")
    order = [F.col("id").asc_nulls_first(), F.substring("text", 1, PREFIX).asc_nulls_first(),
             F.xxhash64("text").asc(), F.col("text").asc()]
    # ranges are sampled without the whole text; texts of one hash stay together
    ordered = narrow.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    (ordered.mapInArrow(work, schema).write.option("compression", "zstd").parquet(path))
    return path


@lru_cache(maxsize=2)
def vocabulary_size(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``start``, the number of ids before each.

    A shard knows the ids before it in its range, as one task writes a range; what is added is
    the total of earlier ranges, one small row per range partition, and so bounded by their number.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(
        Window.orderBy("part")) - F.col("ids")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn(
        "start", F.col("inside") + F.col("before")).drop("before", "inside")


def read_documents(spark: SparkSession, path: str, doc_id: str = "doc_id",
                   with_ids: bool = False) -> DataFrame:
    """Every document as its key finds it through the index.

    Columns: the key, ``start`` (ids before it), ``n_tokens`` (with the end id), ``ids_crc32``,
    ``shard``, ``slot``, and ``ids`` if asked for.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {k: batch.column(k)[row].as_py() for k in batch.schema.names if k != "keys"}
                keys = batch.column("keys")[row].values
                opened = open_shard(shard)
                out: dict[str, list] = {k: [] for k in names}
                for key in dict.fromkeys(keys.to_pylist()):
                    for doc in opened.get(key):
                        for k, v in zip(names, (key, *doc), strict=False):
                            out[k].append(v)
                kinds = [keys.type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                         pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[k], t) for k, t in zip(names, kinds, strict=False)], names=names)

    names = ["id", "start", "n_tokens", "ids_crc32", "shard", "slot"] + ["ids"] * with_ids
    rows = shards(spark, path)
    kind = rows.schema["keys"].dataType.elementType.simpleString()
    out = rows.mapInArrow(work, f"id {kind}, start long, n_tokens long, ids_crc32 long, shard string, "
                                "slot long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("id", doc_id)


class open_shard:
    """Keyed access to one shard row."""

    def __init__(self, row: dict):
        self.seeds = np.frombuffer(row["seeds"], "<i4")
        self.slots = np.frombuffer(row["slots"], SLOT)
        self.ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
        self.ends = np.cumsum(np.frombuffer(row["lengths"], "<u8")).astype(np.int64)
        self.start, self.name = row.get("start", 0), f"{row['part']}-{row['seq']}"

    def get(self, key: object) -> Iterator[tuple]:
        """(start, n_tokens, crc32, shard, slot, ids) of each document of the key."""
        slot = find_slot(self.seeds, self.slots, key_bytes(key))
        if slot < 0:
            return
        first, count = int(self.slots[slot]["first"]), int(self.slots[slot]["count"])
        for i in range(first, first + count):
            at = int(self.ends[i - 1]) if i else 0
            ids = self.ids[at:int(self.ends[i])].astype("<u4")
            yield self.start + at, len(ids), zlib.crc32(ids.tobytes()), self.name, slot, ids


def lookup(spark: SparkSession, path: str, keys: Iterable, doc_id: str = "doc_id") -> DataFrame:
    """Documents of a few given keys: only shards whose key range holds one are opened."""
    wanted = list(dict.fromkeys(keys))
    rows = shards(spark, path)
    kind = rows.schema["keys"].dataType.elementType.simpleString()
    real = [k for k in wanted if k is not None]
    near = F.lit(None in wanted)
    for k in real:
        near = near | F.lit(k).between(F.array_min("keys"), F.array_max("keys"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                found = [(k, *d) for k in wanted for d in open_shard(shard).get(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], batch.schema.field("keys").type.value_type),
                     pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[-1] for f in found], pa.list_(pa.int64()))], names=["id", "start", "ids"])

    out = rows.where(near).mapInArrow(work, f"id {kind}, start long, ids array<long>")
    return out.withColumnRenamed("id", doc_id)

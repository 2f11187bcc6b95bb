"""Byte-level BPE: merge ranks in a priority queue over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
              r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# A store holds strings of up to LONG characters and is cut back beyond STORE_BYTES (keys, ids and ENTRY_BYTES each).
STORE_BYTES = 100 << 20
ENTRY_BYTES = 220
LONG = 1_000


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte in byte-level vocabularies (public convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Store(dict[str, bytes]):
    """Ids of strings, bounded by bytes.

    Once full it keeps the quarter that came first, as common strings come early, and fills the
    rest anew.  Long strings are not kept.
    """

    def __init__(self, limit: int | None = None):
        super().__init__()
        self.limit = limit or STORE_BYTES
        self.held = 0

    def fits(self, found: dict[str, bytes]) -> bool:
        """Whether all of it can be kept and nothing need go for it."""
        return max(map(len, found), default=0) <= LONG and self.held + weight(found) <= self.limit

    def keep(self, found: dict[str, bytes]) -> None:
        if not self.fits(found):
            found = {k: v for k, v in found.items() if len(k) <= LONG}
            if not self.fits(found):
                first = dict(islice(self.items(), len(self) // 4))
                self.clear()
                self.update(first)
                self.held = weight(first)
                if not self.fits(found):
                    return
        self.update(found)
        self.held += weight(found)


def weight(entries: dict[str, bytes]) -> int:
    """About the bytes that strings and their ids take; a character counts as four."""
    return ENTRY_BYTES * len(entries) + 4 * sum(map(len, entries)) + sum(map(len, entries.values()))


class PieceEncoder:
    """Encodes whole texts from remembered pieces.

    A space between two other characters that are not white space always begins a pre-token,
    so texts fall into pieces there.  Pieces repeat: each distinct piece is cut into pre-tokens
    once, each distinct pre-token is encoded once, as long as the stores remember it.
    ``encode_words`` maps pre-tokens to their ids as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], special: dict[str, int]):
        self.encode_words = encode_words
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut = (re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
                               + ")") if special else None)
        self.find = regex.compile(PRE_TOKENS).findall
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.double = re.compile(r"\s\s").search
        self.pieces, self.words = Store(), Store()

    def encode_pieces(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces; the key is the piece without the space before it."""
        plain, other = [], []  # plain: one pre-token, a space and letters
        for p in missing:
            (plain if p.isalpha() else other).append(p)
        found = dict(zip(plain, self.encode_words([" " + p for p in plain]), strict=True))
        cut = {p: self.find(" " + p) for p in other}
        own = {w: self.words.get(w) for ws in cut.values() for w in ws}
        new = [w for w, ids in own.items() if ids is None]
        learnt = dict(zip(new, self.encode_words(new), strict=True))
        self.words.keep(learnt)
        own.update(learnt)
        found.update((p, b"".join(map(own.__getitem__, ws))) for p, ws in cut.items())
        return found

    def heads(self, pieces: list[str]) -> list[bytes]:
        """Ids of the pieces that begin texts, which have no space before them."""
        cut = [self.find(p) for p in pieces]
        todo = [*{w for ws in cut for w in ws}]
        own = dict(zip(todo, self.encode_words(todo), strict=True))
        return [b"".join([own[w] for w in ws]) for ws in cut]

    def plain(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") if t and not self.double(t) and t[0] != " " and t[-1] != " "
               else self.split(t) for t in texts]
        heads = self.heads([parts.pop(0) for parts in cut])
        wanted: set[str] = set().union(*cut)
        found = self.encode_pieces([*filterfalse(self.pieces.__contains__, wanted)])
        get = self.pieces.__getitem__
        if not self.pieces.fits(found):
            # the store may drop what these texts need
            get = ({p: self.pieces[p] for p in wanted if p in self.pieces} | found).__getitem__
        self.pieces.keep(found)
        return [head + b"".join(map(get, parts)) for head, parts in zip(heads, cut, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return self.plain(texts)
        runs = [self.cut.split(t) for t in texts]
        flat = iter(self.plain([r for parts in runs for r in parts[::2]]))
        return [b"".join(next(flat) if i % 2 == 0 else self.special[part]
                         for i, part in enumerate(parts)) for parts in runs]


class Merges:
    """Merge ranks and vocabulary of a byte-level BPE file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError(f"added token {token['content']!r} has an unsupported flag")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.byte_ids = [vocab[s] for s in symbols]
        self.strings = [b""] * self.size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimals = [b"%d," % i for i in range(self.size)]
        self.four = [i.to_bytes(4, "little") for i in range(self.size)]
        # per left symbol: rank by right symbol
        self.ranks: list[dict[int, int]] = [{} for _ in range(self.size)]
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a]].setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost among equals."""
        ranks, made = self.ranks, self.made
        ids = [*map(self.byte_ids.__getitem__, data)]
        n = len(ids)
        shift = n.bit_length()
        heap = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            if right in (row := ranks[left]):
                heap.append(row[right] << shift | i - 1)
            left = right
        if not heap:
            return ids
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        low = (1 << shift) - 1
        while heap:
            entry = heappop(heap)
            i = entry & low
            left = ids[i]
            j = after[i]
            # stale: a side is gone or has grown since the entry was made
            if left < 0 or j >= n or ranks[left].get(ids[j]) != entry >> shift:
                continue
            ids[i] = new = made[entry >> shift]
            ids[j] = -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (right := ids[j]) in (row := ranks[new]):
                    heappush(heap, row[right] << shift | i)
            j = before[i]
            if j >= 0 and new in (row := ranks[ids[j]]):
                heappush(heap, row[new] << shift | j)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        word, four, join = self.word, self.four.__getitem__, b"".join
        return [join(map(four, word(w.encode()))) for w in words]

    def decode(self, ids: list[int]) -> bytes:
        """Vocabulary strings end to end; what is not UTF-8 becomes replacement characters."""
        data = b"".join(map(self.strings.__getitem__, ids))
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode(errors="replace").encode()
        return data


@lru_cache(maxsize=2)
def merges(file: str) -> Merges:
    return Merges(file)


@lru_cache(maxsize=2)
def encoder(file: str) -> PieceEncoder:
    """One per Python worker, so what a worker has learnt serves its later tasks too."""
    own = merges(file)
    return PieceEncoder(own.encode_words, own.special)


def encode_decode(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Encode every text with the merges of ``file`` and decode the ids again.

    Columns: the key, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded UTF-8), and with ``with_ids`` also ``ids`` and
    ``decoded``.  Null and empty texts have no ids, an empty decoded text and the digests of
    nothing.  Repeated rows each give a row; other input columns are not looked at.  A map
    without a shuffle: batches of texts pass through, nothing is kept but bounded stores.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, enc = merges(file), encoder(file)
        sha = hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                count, digest, back, all_ids, all_text = [], [], [], [], []
                for data in enc.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(data, "<u4").tolist()
                    decoded = own.decode(ids)
                    count.append(len(ids))
                    digest.append(sha(b"".join(map(own.decimals.__getitem__, ids))[:-1]).hexdigest())
                    back.append(sha(decoded).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        all_text.append(decoded.decode())
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()),
                           pa.array(back, pa.string())]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kinds = f"id {narrow.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = narrow.mapInArrow(work, kinds + ", ids array<int>, decoded string" * with_ids)
    return out.withColumnRenamed("id", doc_id)

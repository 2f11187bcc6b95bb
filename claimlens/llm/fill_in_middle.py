"""Fill-in-the-middle rows by a secondary sort of text pieces.

A task cuts its texts into pieces of bounded size, each keyed by its document and its place in the
output.  One shuffle by document, sorted inside partitions by that place, lets a task stream the
pieces of a document into an incremental digest without ever holding the text; the output is parsed
as it streams by, its pieces are sorted by their place in the text, and a second stream restores it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 90, 20
CHUNK = 2048
FLUSH = 2_000
HEAD = -1
# Parts in output order; a part's number is its place in the text.
ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
         "plain": ((None, 0),)}


def plan(key: object, text: str) -> tuple[str, int | None, int | None]:
    """Form, and the ends of prefix and middle; decided by the key alone (null: no digits)."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_SHARE:
        return "plain", None, None
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < SPM_SHARE else "psm"), a, b


def pieces(text: str, form: str, a: int | None, b: int | None, chunk: int) -> Iterator[str]:
    """The output from left to right in pieces of at most ``chunk`` units; markers stand alone."""
    ends = (0, len(text)) if form == "plain" else (0, a, b, len(text))
    for marker, part in ORDER[form]:
        if marker:
            yield marker
        for i in range(ends[part], ends[part + 1], chunk):
            yield text[i:min(i + chunk, ends[part + 1])]


class Parser:
    """Splits an output that arrives piece by piece into (part, text); markers may straddle pieces."""

    def __init__(self, form: str):
        self.left = list(ORDER[form])
        self.part = None if self.left[0][0] else self.left.pop(0)[1]
        self.kept = ""

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        data = self.kept + piece
        self.kept = ""
        while self.left:
            at = data.find(self.left[0][0])
            if at < 0:
                cut = max(0, len(data) - len(self.left[0][0]) + 1)
                self.kept = data[cut:]
                data = data[:cut]
                break
            if at:
                yield self.part, data[:at]
            data = data[at + len(self.left[0][0]):]
            self.part = self.left.pop(0)[1]
        if data:
            yield self.part, data


COLUMNS = {"doc": pa.binary(), "task": pa.int32(), "part": pa.int32(), "place": pa.int64(), "piece": pa.string(),
           "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
           "copies": pa.int64(), "output_sha256": pa.string()}
SCHEMA = ("doc binary, task int, part int, place long, piece string, n long, form string, "
          "prefix_chars long, middle_chars long, copies long, output_sha256 string")


class Rows:
    """Rows of the piece table, handed out in batches."""

    def __init__(self, id_type: pa.DataType):
        self.types = {"id": id_type} | COLUMNS
        self.clear()

    def clear(self) -> None:
        self.columns: dict[str, list] = {c: [] for c in self.types}

    def add(self, **row: object) -> None:
        for c, values in self.columns.items():
            values.append(row.get(c))

    def full(self) -> bool:
        return len(self.columns["doc"]) >= FLUSH

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(self.columns[c], t) for c, t in self.types.items()], names=list(self.types))
        self.clear()
        return out


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """((doc, task), row) of rows sorted by document; a row is a dict of its columns."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for values in zip(*columns, strict=True):
            row = dict(zip(batch.schema.names, values, strict=True))
            yield (row["doc"], row["task"]), row


def cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Head row and pieces of every text; equal rows of a batch are cut once and counted."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for batch in batches:
        rows = Rows(batch.schema.field(0).type)
        seen: dict[bytes, list] = {}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            name = b"\0" if key is None else b"\1" + str(key).encode()
            doc = xxhash.xxh3_128_digest(len(name).to_bytes(4, "little") + name + text.encode())
            if doc in seen:
                seen[doc][2] += 1
            else:
                seen[doc] = [key, text, 1]
        for doc, (key, text, copies) in seen.items():
            form, a, b = plan(key, text)
            own = {"doc": doc, "task": task}
            rows.add(**own, part=0, place=HEAD, id=key, n=len(text), form=form, copies=copies,
                     prefix_chars=a, middle_chars=None if a is None else b - a)
            for i, piece in enumerate(pieces(text, form, a, b, chunk)):
                rows.add(**own, part=0, place=i, piece=piece)
                if rows.full():
                    yield rows.batch()
            if rows.full():
                yield rows.batch()
        yield rows.batch()


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each output, and its pieces with their places in the text."""
    rows, now, head, place, sha, parser, n_out = None, None, None, HEAD, None, None, 0
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    rows = Rows(first.schema.field("id").type)

    def close() -> None:
        rows.add(**head | {"part": HEAD, "output_sha256": sha.hexdigest()})

    for key, row in runs(_chain(first, batches)):
        if key != now:
            if now is not None:
                close()
            now, head, place, n_out = key, dict(row), HEAD, 0
            sha, parser = hashlib.sha256(), Parser(row["form"])
        elif row["place"] == HEAD:  # the same row again, from another batch of its task
            head["copies"] += row["copies"]
        elif row["place"] > place:  # of equal rows' equal pieces the first counts
            place = row["place"]
            sha.update(row["piece"].encode())
            for part, text in parser.feed(row["piece"]):
                rows.add(doc=row["doc"], task=row["task"], part=part, place=n_out, piece=text)
                n_out += 1
        if rows.full():
            yield rows.batch()
    close()
    yield rows.batch()


def restore(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """One row per document and copy: what the sorted pieces spell."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    types = {"id": first.schema.field("id").type} | {
        c: COLUMNS[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256")
    } | {"restored_sha256": pa.string()} | ({"restored": pa.string()} if with_text else {})
    out: dict[str, list] = {c: [] for c in types}
    now, head, sha, text = None, None, None, []

    def close() -> None:
        done = head | {"restored_sha256": sha.hexdigest(), "restored": "".join(text)}
        for c, values in out.items():
            values += [done[c]] * min(head["copies"], FLUSH)
        head["copies"] -= min(head["copies"], FLUSH)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], names=list(types))
        for values in out.values():
            values.clear()
        return made

    for key, row in runs(_chain(first, batches)):
        if key != now:
            while head is not None and head["copies"]:
                close()
                if len(out["id"]) >= FLUSH:
                    yield batch()
            now, head, sha, text = key, dict(row), hashlib.sha256(), []
        else:
            sha.update(row["piece"].encode())
            if with_text:
                text.append(row["piece"])
    while head is not None and head["copies"]:
        close()
        yield batch()
    if out["id"]:
        yield batch()


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def output_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Pieces of the outputs of all ``docs``: rows of a document sorted by place inside one partition.

    ``repartition`` by document and ``sortWithinPartitions`` is the secondary sort of the method
    (one shuffle, sorted by the shuffle's reader).  A document is named by a 128-bit digest of its
    key and whole text and by the task that read it.  So many rows of one key, a null key too, are
    spread by their texts; equal rows of a batch travel once with their number, and those of
    different tasks do not meet.  The names depend on content only: a task that is run again after
    a loss sends the same rows to the same places.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, {SCHEMA}"
    made = narrow.mapInArrow(lambda batches: cut(batches, chunk), schema)
    return made.repartition("doc", "task").sortWithinPartitions("doc", "task", "place")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                   with_text: bool = False) -> DataFrame:
    """Form, lengths and digests of every document's fill-in-the-middle output and of its restoration.

    Columns: the key, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain),
    ``output_sha256``, ``restored_sha256`` (of the text that the output spells when its parts are
    sorted back) and with ``with_text`` also ``restored``.  The outputs themselves are the rows of
    ``output_pieces`` in order.  Null and empty texts are plain and empty; a null key is decided by
    the digest of ``1:``; repeated rows each give a row; other columns are not looked at; no
    documents give no rows.  A very long text passes in pieces of ``chunk`` units, and no task holds
    it after the cut unless ``with_text`` asks for it.  One shuffle: the pieces are sorted again in
    the partition where they are.
    """
    sent = output_pieces(docs, doc_id, text, chunk)
    kind = sent.schema["id"].dataType.simpleString()
    parsed = sent.mapInArrow(assemble, f"id {kind}, {SCHEMA}")
    back = parsed.sortWithinPartitions("doc", "task", "part", "place")
    out = back.mapInArrow(
        lambda batches: restore(batches, with_text),
        f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
        "restored_sha256 string" + ", restored string" * with_text)
    return out.withColumnRenamed("id", doc_id)

"""Chat formatting by prefix-target expansion: one training example for each assistant turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.session import work_dir

# The template's control strings; in texts each is broken by a backslash after its first letter,
# and backslashes are doubled, so both can be told apart again.
OPEN, CLOSE, HEAD, HEAD_END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (OPEN, CLOSE, HEAD, HEAD_END)
TRAINED = "assistant"
FLUSH_CHARS = 4 << 20
_TURN = re.compile(re.escape(f"{OPEN}{HEAD} ") + "(.*?)" + re.escape(f" {HEAD_END}\n") + "(.*?)"
                   + re.escape(f"{CLOSE}\n"), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(word[0] + "\\" + word[1:]))
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted string."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def rendered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """One segment a turn, and where in it the text lies."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "head": F.concat(F.lit(f"{OPEN}{HEAD} "), escaped(F.col("role")), F.lit(f" {HEAD_END}\n")),
        "body": escaped(F.col("text"))})
    return rows.select("conv", "turn", "role", "text", "head", "body")


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", trained: str = TRAINED) -> DataFrame:
    """Every turn of the trained role as an example with all turns before it.

    Columns: the conversation, ``example`` (from 0), ``formatted``, ``mask_start`` and ``mask_end``
    (characters of ``formatted`` that are trained on: that reply's text and nothing else), and
    ``is_last``.  Turns after the last reply, and conversations without one, come as a last
    example with an empty mask, so no turn is lost.  Turns are ordered by number (null first),
    role and text; null role and text are empty; repeated rows are turns of their own; a null
    conversation is one like others.  Other columns are not looked at.

    Turns are dealt out by conversation, sorted and streamed: a task holds the formatted prefix of
    one conversation, which is what its longest example has to hold anyway.
    """
    rows = rendered(turns, conv_id, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key_type = 0, None
        conv, begun, prefix, example, open_turns = None, False, "", 0, 0

        def close() -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

        waiting = None  # the newest example, until it is known whether it is the last
        for batch in batches:
            key_type = batch.schema.field("conv").type
            cols = [batch.column(c).to_pylist() for c in ("conv", "role", "head", "body")]
            for key, who, head, body in zip(*cols, strict=True):
                if not begun or key != conv:
                    if begun:
                        held.append((*waiting, not open_turns) if not open_turns else (
                            conv, example, prefix, len(prefix), len(prefix), True))
                        size += len(held[-1][2])
                    conv, begun, prefix, example, open_turns, waiting = key, True, "", 0, 0, None
                start = len(prefix) + len(head)
                prefix = "".join((prefix, head, body, CLOSE, "\n"))
                open_turns += 1
                if who == trained:
                    if waiting:
                        held.append((*waiting, False))
                        size += len(waiting[2])
                    waiting, open_turns = (conv, example, prefix, start, start + len(body)), 0
                    example += 1
                elif waiting:
                    held.append((*waiting, False))
                    size += len(waiting[2])
                    waiting = None
                if size > FLUSH_CHARS:
                    yield close()
                    held, size = [], 0
        if begun:
            held.append((*waiting, True) if not open_turns else (conv, example, prefix, len(prefix), len(prefix), True))
        if held:
            yield close()

    names = ["conv", "example", "formatted", "mask_start", "mask_end", "is_last"]
    ordered = rows.repartition("conv").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text").select("conv", "role", "head", "body")
    out = ordered.mapInArrow(work, f"conv {kind}, example long, formatted string, mask_start long, "
                                   "mask_end long, is_last boolean")
    return out.withColumnRenamed("conv", conv_id)


def write_examples(turns: DataFrame, path: str | None = None, **options) -> str:
    """Examples as Parquet; returns the folder."""
    path = path or work_dir(turns.sparkSession, "chat-examples")
    expand(turns, **options).write.option("compression", "zstd").parquet(path)
    return path


def read_back(examples: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What written examples hold, per conversation, parsed and unescaped.

    ``n_turns`` and ``turns_sha256`` (role, line end, text, line end of each turn) come from the
    last example, ``loss_chars`` and ``loss_sha256`` from the masks of all in order,
    ``formatted_chars`` from all formatted strings.  Only masked texts are shuffled; they are
    hashed as a stream.
    """
    rows = examples.withColumnRenamed(conv_id, "conv")
    kind = rows.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                turns, digests, loss, chars = [], [], [], []
                cols = [part.column(c).to_pylist() for c in ("formatted", "mask_start", "mask_end", "is_last")]
                for formatted, start, stop, last in zip(*cols, strict=True):
                    chars.append(len(formatted))
                    loss.append(unescape(formatted[start:stop]) if stop > start else "")
                    if last:
                        own = parse(formatted)
                        turns.append(len(own))
                        digests.append(hashlib.sha256("".join(
                            [f"{r}\n{t}\n" for r, t in own]).encode()).hexdigest())
                    else:
                        turns.append(None)
                        digests.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), part.column("example"), pa.array(turns, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())],
                    names=["conv", "example", "n_turns", "turns_sha256", "loss", "chars"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, conv, state, done = None, None, None, []

        def close() -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

        def finish() -> tuple:
            turns, digest, count, sha, chars = state
            return conv, turns, digest, count, sha.hexdigest(), chars

        for batch in batches:
            key_type = batch.schema.field("conv").type
            cols = [batch.column(c).to_pylist() for c in ("conv", "n_turns", "turns_sha256", "loss", "chars")]
            for key, turns, digest, loss, chars in zip(*cols, strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append(finish())
                    conv, state = key, [None, None, 0, hashlib.sha256(), 0]
                state[0], state[1] = (turns, digest) if turns is not None else state[:2]
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if len(done) > 5000:
                yield close()
                done = []
        if state is not None:
            done.append(finish())
        if done:
            yield close()

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    found = rows.select("conv", "example", "formatted", "mask_start", "mask_end", "is_last").mapInArrow(
        read, f"conv {kind}, example long, n_turns long, turns_sha256 string, loss string, chars long")
    out = found.repartition("conv").sortWithinPartitions("conv", "example").mapInArrow(
        gather, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                "formatted_chars long")
    return out.withColumnRenamed("conv", conv_id)

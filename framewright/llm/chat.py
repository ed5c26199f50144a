"""Conversations as training text with a loss mask, assembled column by column.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts every
``<`` that is followed by backslashes and a bar gets one more backslash, so that
no control string can arise and the change can be taken back. The loss mask
covers the texts of assistant turns.

For each Arrow batch the lengths of all segments are computed, their offsets
summed, and headers, texts and ends are copied to their places in one
preallocated buffer. Rows are ordered by range partitions, so a conversation of
any length is cut into pieces by partitions and batches; its pieces are numbered.

Defined results: null roles and texts are empty; rows are ordered by conv_id,
turn (nulls first), role and text; rows without conv_id form one conversation
without an id; repeated rows are turns of their own; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import row_tasks, ship

START, BREAK, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
ASSISTANT = "assistant"
PIECES = "conv_id long, part int, seq long, formatted string, mask array<struct<start:int,length:int>>"
#: Bytes of text that one buffer is made for.
BUFFER_BYTES = 16 << 20

_GUARDED = re.compile(rb"<(\\+)\|")
_ROLE = {b"\\\\": b"\\", b"\\n": b"\n", b"\\l": b"<"}


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def unescape(text: bytes) -> bytes:
    return _GUARDED.sub(lambda m: b"<" + m[1][1:] + b"|", text) if b"<\\" in text else text


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\[\\nl]", lambda m: _ROLE[m[0]], role) if b"\\" in role else role


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The turns' bytes in one buffer, where each turn begins (with the end), and where its text begins and how long it is."""
    coded = roles.dictionary_encode()
    heads = pa.array([START + escape_role(r).encode() + BREAK for r in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)
    head, head_at = flat(heads)
    body, body_at = flat(escape(texts))
    n = len(roles)
    sizes = np.column_stack([np.diff(head_at), np.diff(body_at), np.full(n, len(END), dtype=np.int64)])
    ends = np.zeros(3 * n + 1, dtype=np.int64)
    np.cumsum(sizes.ravel(), out=ends[1:])
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for k, (data, at) in enumerate(((head, head_at), (body, body_at), (np.tile(np.frombuffer(END, np.uint8), n), np.arange(n + 1) * len(END)))):
        places = np.arange(len(data)) + np.repeat(ends[k:-1:3] - at[:-1], np.diff(at))
        out[places] = data
    return buffer, ends[::3], ends[1::3], sizes[:, 1]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Pieces of formatted conversations, in order by (part, seq), each with its mask in bytes."""
    ship(conversations.sparkSession)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in small(incoming):
            roles = batch.column("role")
            buffer, turns, at, size = assemble(roles, batch.column("text"))
            ids = batch.column("conv_id")
            plain = np.asarray(ids.fill_null(0))
            null = np.asarray(ids.is_null())
            first = np.flatnonzero(np.concatenate([[True], (np.diff(plain) != 0) | (np.diff(null.astype(np.int8)) != 0)]))
            ends = np.append(first[1:], len(plain))
            offsets = turns[np.append(first, len(plain))].astype(np.int32)
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
            ours = np.asarray(pc.equal(roles, ASSISTANT)).nonzero()[0]
            counts = np.searchsorted(ours, ends) - np.searchsorted(ours, first)
            spans = pa.StructArray.from_arrays([pa.array((at[ours] - np.repeat(turns[first], counts)).astype(np.int32)), pa.array(size[ours].astype(np.int32))], ["start", "length"])
            mask = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
            n = len(first)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array([part] * n, pa.int32()), pa.array(np.arange(seq, seq + n)), formatted, mask], names=["conv_id", "part", "seq", "formatted", "mask"])
            seq += n

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(row_tasks(conversations.sparkSession), "conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, PIECES)


def small(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with a bounded amount of text (one row at least)."""
    for batch in incoming:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // BUFFER_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say: per conversation its turns' and its loss text's digests and lengths.

    A conversation's pieces go through one task in order, one at a time, as its
    digests have to; none of them is held.
    """

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result() -> pa.RecordBatch:
            conv, turns, sha, n, loss, chars = state
            row = [conv, turns, sha.hexdigest(), n, loss.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        done: list[pa.RecordBatch] = []
        for batch in incoming:
            for conv, text, mask in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").cast(pa.binary()).to_pylist(), batch.column("mask").to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(result())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in text.split(END)[:-1]:
                    role, said = turn.removeprefix(START).split(BREAK, 1)
                    state[2].update(unescape_role(role) + b"\n" + unescape(said) + b"\n")
                    state[1] += 1
                for span in mask:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[3] += len(said.decode())
                    state[4].update(said)
                state[5] += len(text.decode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state is not None:
            yield result()

    ordered = pieces.repartition(row_tasks(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

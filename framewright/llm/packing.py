"""Packing documents into sequences of a fixed size by length patterns.

Only lengths matter for packing, and there are at most ``capacity`` of them, so
the plan is made from the histogram of lengths. All patterns of two or three
lengths that fill a sequence exactly get repeat counts by non-negative least
squares against the histogram, less a small reserve. The fit is thinned out: the
patterns with the largest counts are kept and fitted again, until about as many
are left as there are lengths, so that counts are large and rounding keeps most of
them. Counts are rounded along their running sum and kept within the histogram,
and what that leaves is fitted once more, ROUNDS times. The reserve and the rest,
which have pieces of all lengths, are packed best-fit, longest first. Pieces that
fill a sequence are a pattern by themselves.

The plan has a bounded number of rows however many documents there are; each piece
finds its sequence from its number among the pieces of its length, by a search in
the plan. A length is numbered in as many cells as its number of pieces asks for.

Defined results: a null text is an empty one (its single id is the end id);
repeated rows are packed each; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, number_within
from .tokens import batches, word_encoder

#: Share of every length's pieces that is kept for the gaps that patterns leave.
RESERVE = 0.05
#: Descent steps, and the patterns kept after them as multiples of the capacity.
THINNING = ((40, 16.0), (60, 4.0), (80, 1.5))
#: Descent steps over the patterns that are left, before each rounding.
STEPS, ROUNDS = 100, 3
#: Pieces of one length that one task numbers, about.
CELL_PIECES = 1 << 18

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


#: (lengths, repeats) of patterns
Plan = list[tuple[tuple[int, ...], int]]


def all_patterns(there: np.ndarray) -> np.ndarray:
    """Rows of two or three lengths (the last may be 0: none) that add up to the capacity; there[L]: whether a piece of length L is."""
    capacity = len(there) - 1
    have = np.flatnonzero(there[:capacity])
    have = have[have > 0]
    a, b = (m.ravel() for m in np.meshgrid(have, have, indexing="ij"))
    c = capacity - a - b
    good = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[good], b[good], c[good]
    good = (c == 0) | there[c]
    return np.column_stack([a[good], b[good], c[good]])


def least_squares(rows: np.ndarray, goal: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """Repeats >= 0 of the patterns that bring what they use near the goal, by accelerated projected descent from x.

    Differences weigh by how often a length occurs, so that rare lengths count as
    much as frequent ones.
    """
    used, there = rows.ravel(), (rows > 0).ravel().astype(float)
    weight = 1 / np.maximum(goal, 1)

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(used, weights=np.repeat(x, 3) * there, minlength=len(goal))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[used] * there).reshape(-1, 3).sum(1)

    majorant = np.maximum(back(weight * use(np.ones(len(rows)))), 1e-12)  # of the normal matrix, on its diagonal
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weight * (use(y) - goal)) / majorant)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def fit_patterns(counts: np.ndarray, steps: int = STEPS) -> Plan:
    """Patterns with whole repeat counts within the histogram; counts[L]: pieces of length L, capacity = len(counts) - 1."""
    capacity = len(counts) - 1
    left = np.floor(counts * (1 - RESERVE)).astype(np.int64)
    left[0] = left[capacity] = 0
    rows = all_patterns(left > 0)
    goal = left.astype(float)
    degree = np.maximum(np.bincount(rows.ravel(), minlength=capacity + 1), 1)
    x = (goal / degree)[rows].sum(1) / 3
    for some, share in THINNING:
        x = least_squares(rows, goal, x, some)
        keep = int(share * capacity)
        if len(rows) > keep:
            best = np.sort(np.argpartition(-x, keep)[:keep])
            rows, x = rows[best], x[best]
    repeats = np.zeros(len(rows), dtype=np.int64)
    for _ in range(ROUNDS):
        x = least_squares(rows, left.astype(float), x, steps)
        # rows are sorted by their lengths, so rounding the running sum keeps the sums of neighbouring patterns
        whole = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)
        before = repeats.sum()
        for k in np.argsort(-whole, kind="stable"):
            if whole[k] <= 0:
                break
            lengths, copies = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = int(min(whole[k], *(left[lengths] // copies)))
            left[lengths] -= n * copies
            repeats[k] += n
        if repeats.sum() == before:
            break
        x = np.zeros(len(rows))
    plan = [(tuple(int(v) for v in rows[k] if v), int(repeats[k])) for k in np.flatnonzero(repeats)]
    return [*([((capacity,), int(counts[capacity]))] if counts[capacity] else []), *plan]


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, copies), ...], sequences) by best fit, longest first, over a histogram."""
    capacity = len(counts) - 1
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(room: int, items: list, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([items, n])

    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                if todo >= fit:
                    put(capacity - fit * length, [(length, fit)], todo // fit)
                    todo %= fit
                else:
                    put(capacity - todo * length, [(length, todo)], 1)
                    todo = 0
                continue
            room = rooms[k]
            items, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            fit = room // length
            bins = min(n, todo // fit)
            if bins:
                put(room - fit * length, [*items, (length, fit)], bins)
                todo -= bins * fit
            if bins < n and todo:  # fewer than fit are left
                put(room - todo * length, [*items, (length, todo)], 1)
                todo, bins = 0, bins + 1
            if bins < n:
                put(room, items, n - bins)
    return [(items, n) for groups in open_.values() for items, n in groups]


def plan_rows(counts: np.ndarray, plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies in a sequence, first offset): the patterns' sequences, then best-fit ones."""
    left, groups = counts.copy(), []
    for lengths, n in plan:
        groups.append(([(v, lengths.count(v)) for v in dict.fromkeys(lengths)], n))
        for v in lengths:
            left[v] -= n
    groups += best_fit(left)
    taken = np.zeros(len(counts), dtype=np.int64)
    rows, sequence = [], 0
    for items, n in groups:
        offset = 0
        for length, copies in items:
            rows.append((length, int(taken[length]), int(taken[length]) + copies * n, sequence, copies, offset))
            taken[length] += copies * n
            offset += copies * length
        sequence += n
    return rows


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids with the end id; with keep_ids also the ids (little-endian unsigned 32-bit)."""

    def cut(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer_path)
        for batch in batches(incoming):
            flat, starts = coder.column(batch.column("text"))
            flat = np.insert(flat, starts[1:], np.uint32(end_id)).astype("<u4")
            starts = starts + np.arange(len(starts))
            sizes = np.diff(starts)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            begin = piece * capacity
            length = np.minimum(capacity, sizes[doc] - begin)
            view = memoryview(flat).cast("B")
            at = starts[:-1][doc] + begin
            raw = [view[4 * a : 4 * (a + b)] for a, b in zip(at.tolist(), length.tolist())]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int32()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([bytes(r) for r in raw], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def place(ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """The ranked pieces with sequence_id and offset, by a search in the plan, whose size depends on the capacity alone."""
    length, first, end, sequence, copies, offset = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6).T
    bits = 45  # ranks have fewer
    key = (length << bits) + first

    def find(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            own = np.asarray(batch.column("length"), dtype=np.int64)
            rank = np.asarray(batch.column("rank"), dtype=np.int64)
            at = np.searchsorted(key, (own << bits) + rank, "right") - 1
            past = rank - first[at]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            columns["length"] = pa.array(own)
            columns["sequence_id"] = pa.array(sequence[at] + past // copies[at])
            columns["offset"] = pa.array(offset[at] + own * (past % copies[at]))
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"{f.name} {'long' if f.name == 'length' else f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(find, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Place every piece: the columns of ``cut_pieces`` with sequence_id, offset and in_pattern (else packed best-fit)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row for each length up to the capacity
        counts[length] = n
    plan = fit_patterns(counts)
    cells = F.get(F.lit([int(n) for n in 1 + counts // CELL_PIECES]), F.col("length"))
    ranked = number_within(scratch, pieces, "length", F.xxhash64("doc_id", "piece"), cells, "rank", ["doc_id", "piece", "ids_crc32"])
    return place(ranked, plan_rows(counts, plan)).withColumn("in_pattern", F.col("sequence_id") < sum(n for _, n in plan))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids (little-endian unsigned 32-bit) and documents, from ``pack(..., keep_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("documents"),
    )

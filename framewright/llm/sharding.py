"""Shards of nearly equal size by minimax contiguous partition, with DataFrame functions only.

Documents with equal texts form an atomic group; groups are ordered by a 64-bit
hash of their text, and each shard takes a contiguous range of hashes. The
smallest capacity for which a greedy sweep needs no more shards than there are is
found by binary search. The sweep works on hash cells: 2**FIRST_BITS of them at
first, and only cells in which a cut can fall are split further, until those
hold one group each; so the driver sees a bounded number of cell sums and the
capacity is exact. Cuts then go as near to equal shares as that capacity allows.

Defined results: a null text has no bytes, and all null texts form one group;
other columns are ignored; an empty table gives no rows. Different texts with
one 64-bit hash would share a shard, which breaks no law.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, number_within

SHARDS = 40
ROW_BYTES = 16
#: Hash bits of the first cells, and of each further split.
FIRST_BITS, MORE_BITS = 14, 6
#: Cells in which the rows of a shard are numbered.
NUMBER_CELLS = 1024
LOWEST = -(1 << 63)


class Cells:
    """Hash cells in order: first hash, bits, bytes, and whether a cell holds a single group."""

    def __init__(self, first: np.ndarray, bits: np.ndarray, size: np.ndarray, single: np.ndarray):
        order = np.argsort(first, kind="stable")
        self.first, self.bits, self.size, self.single = first[order], bits[order], size[order], single[order]
        self.ends = np.concatenate([[0], np.cumsum(self.size)])

    def sweep(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Bytes up to each shard's end under a greedy sweep; divisible: whether cells of many groups may be cut anywhere."""
        at, stops = 0, []
        for _ in range(shards):
            want = at + capacity
            k = int(np.searchsorted(self.ends, want, "right")) - 1
            inside = divisible and k < len(self.size) and not self.single[k]
            at = max(at, min(want, int(self.ends[-1])) if inside else int(self.ends[k]))
            stops.append(at)
        return stops

    def least(self, shards: int, divisible: bool) -> int:
        """The smallest capacity whose sweep reaches the end."""
        low, high = 0, int(self.ends[-1])
        while low < high:
            middle = (low + high) // 2
            if self.sweep(middle, shards, divisible)[-1] >= self.ends[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    def straddled(self, low: int, high: int, shards: int) -> np.ndarray:
        """Cells of many groups in which a cut may fall at any capacity from low to high."""
        a = np.array(self.sweep(low, shards, False))
        b = np.array(self.sweep(high, shards, True))
        maybe = np.zeros(len(self.size) + 1, dtype=np.int64)
        np.add.at(maybe, np.searchsorted(self.ends, a, "right") - 1, 1)
        np.add.at(maybe, np.minimum(np.searchsorted(self.ends, b, "left") + 1, len(self.size)), -1)
        return np.flatnonzero((np.cumsum(maybe)[:-1] > 0) & ~self.single)

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Index of the first cell of each shard but the first: near equal shares of what is left, within the capacity."""
        total, starts, k = int(self.ends[-1]), [], 0
        for left in range(shards, 1, -1):
            at = int(self.ends[k])
            goal = at + (total - at) / left
            stop = int(np.searchsorted(self.ends, goal, "left"))
            if stop > k and goal - self.ends[stop - 1] <= self.ends[min(stop, len(self.size))] - goal:
                stop -= 1
            most = int(np.searchsorted(self.ends, at + capacity, "right")) - 1
            stop = min(stop, most, len(self.size))
            rest = Cells.__new__(Cells)
            rest.size, rest.single, rest.ends = self.size[stop:], self.single[stop:], self.ends[stop:] - self.ends[stop]
            if rest.sweep(capacity, left - 1, False)[-1] < rest.ends[-1]:
                stop = most
            starts.append(stop)
            k = stop
        return starts


def cell_of(bits: int) -> Column:
    """The lowest hash of the cell that a hash lies in."""
    return F.shiftleft(F.shiftright("h", 64 - bits), 64 - bits)


def cell_sums(sized: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    rows = sized.groupBy(cell_of(bits).alias("cell")).agg(F.sum("size"), F.min("h") == F.max("h")).collect()
    n = len(rows)
    return np.array([r[0] for r in rows], dtype=np.int64), np.full(n, bits), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=bool)


def minimax_cells(sized: DataFrame, shards: int) -> tuple[Cells, int]:
    """Cells fine enough for the smallest capacity, and that capacity; sized: h long, size long."""
    cells = Cells(*cell_sums(sized, FIRST_BITS))
    while True:
        low, high = cells.least(shards, True), cells.least(shards, False)
        if low >= high:
            return cells, high
        large = np.flatnonzero(~cells.single & (cells.size > max(1, low // 64)))
        split = large if len(large) else cells.straddled(low, high, shards)
        if not len(split):
            return cells, high
        parts = []
        keep = np.ones(len(cells.size), dtype=bool)
        keep[split] = False
        for bits in np.unique(cells.bits[split]).tolist():
            chosen = cells.first[split][cells.bits[split] == bits].tolist()
            wanted = sized.where(cell_of(bits).isin(chosen))
            parts.append(cell_sums(wanted, min(64, bits + MORE_BITS)))
        old = (cells.first[keep], cells.bits[keep], cells.size[keep], cells.single[keep])
        cells = Cells(*[np.concatenate([o, *(p[k] for p in parts)]) for k, o in enumerate(old)])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), "text").alias("h"),
    )
    sized = scratch.write(sized, "sized")
    cells, capacity = minimax_cells(sized, shards)
    starts = [int(cells.first[k]) if k < len(cells.size) else None for k in cells.cuts(capacity, shards)]
    bounds = [s for s in starts if s is not None]
    placed = sized.withColumn("shard", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("h"))) if bounds else F.lit(0))
    numbered = number_within(scratch, placed, "shard", F.xxhash64("doc_id", "h"), NUMBER_CELLS, "slot", ["doc_id", "h"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))

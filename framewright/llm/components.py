"""Connected components of links between documents, as a distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Links that one local union-find holds.
LOCAL_LINKS = 200_000
#: Bytes of a link in a file, at most.
LINK_BYTES = 16


def local_forest(links: DataFrame) -> DataFrame:
    """The links (child, parent) contracted by a union-find within blocks of each partition: a node and its root."""

    def contract(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        def out() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["child", "parent"])

        for batch in incoming:
            for a, b in zip(batch.column("child").to_pylist(), batch.column("parent").to_pylist()):
                ra, rb = root(a), root(b)
                low, high = min(ra, rb), max(ra, rb)
                parent.setdefault(low, low)
                parent[high] = low
            if len(parent) >= LOCAL_LINKS:
                yield out()
                parent.clear()
        if parent:
            yield out()

    return links.select("child", "parent").mapInArrow(contract, "child long, parent long")


def star_step(links: DataFrame) -> DataFrame:
    """Point every node's larger neighbours, then its other parents, at its smallest neighbour.

    The minima are aggregated before the shuffle and joined back, so that a node
    with very many links needs no task of its own.
    """
    both = links.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionAll(links.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
    low = large.groupBy("child").agg(F.min("parent").alias("m"))
    small = large.join(low, "child")
    return small.select("child", F.col("m").alias("parent")).unionAll(small.where("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))).distinct()


def components(scratch: Scratch, links: DataFrame, label: str, size: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (child, parent: any two different ids; size: their bytes, about); component is the smallest id reachable."""
    ordered = links.select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")).where("child <> parent")
    now = scratch.write(local_forest(ordered), f"{label}_0", size)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent") % 1_000_000_007)).first())

    before, k = mark(now), 0
    while before[0]:
        k += 1
        now = scratch.write(star_step(now), f"{label}_{k}", LINK_BYTES * before[0])
        scratch.drop(f"{label}_{k - 1}")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionAll(roots)

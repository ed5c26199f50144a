"""Folds of sorted rows by key, many keys to a task: a key costs its rows and no call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes back to Spark.
BATCH = 8192


def tasks_of(spark: SparkSession) -> int:
    """As many tasks as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def values(column: pa.Array) -> list:
    """A column's values. By the way of numpy, which takes a tenth of the time of ``to_pylist``."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        if not column.null_count:
            return column.to_numpy().tolist()
        there = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [v if t else None for v, t in zip(column.fill_null(0).to_numpy().tolist(), there)]
    if pa.types.is_string(kind) or pa.types.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def folded(rows: DataFrame, keys: list[str], order: list[str | Column], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, tasks: int | None = None) -> DataFrame:
    """What ``fold`` makes of each key's rows, as tuples of all columns in the order asked for; its tuples have the columns of ``schema``.

    Rows come one by one, so a key of any length passes without being held. ``tasks``
    is for folds that cost much a row: Spark joins partitions by their bytes else.
    """
    target, key = to_arrow_schema(StructType.fromDDL(schema)), itemgetter(*[rows.columns.index(c) for c in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*map(values, batch.columns)))
        made = (out for _, group in groupby(flat, key) for out in fold(group))
        while chunk := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), target)], schema=target)

    dealt = rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

"""Context around candidates, and windows grouped for one pass over a source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import ranges
from .keyed import folded

MAX_FRAMES = 120


def context(candidates: DataFrame, samples: DataFrame, lengths: DataFrame, pre: int, post: int) -> DataFrame:
    """candidates(source_id, candidate, start, end) widened by pre and post within their stream, then to the samples that bracket that.

    samples(source_id, ticks, length), in the order of a timeline; lengths(source_id,
    stream_length). Every candidate stays: where no sample lies at or before (after) an
    end, the first (last) sample there is can't widen it (widens it if it reaches out).
    """
    asked = candidates.join(lengths, "source_id", "left")
    asked = asked.withColumn("ask_from", F.greatest(F.col("start") - pre, F.lit(0))).withColumn("ask_to", F.least(F.col("end") + post, F.col("stream_length")))
    point = lambda at: samples.withColumn(at, F.col("ticks"))
    ends = F.col("ticks") + F.col("length")
    wide = ranges.nearest(asked, point("ask_from"), ["source_id"], "ask_from", F.col("ticks"), False, "lo")
    wide = ranges.nearest(wide, point("ask_to"), ["source_id"], "ask_to", ends, True, "hi")
    last = samples.groupBy("source_id").agg(F.max(ends).alias("last_end"))
    wide = wide.join(last, "source_id", "left").withColumn("hi", F.coalesce("hi", "last_end"))
    return wide.select(
        "source_id", "candidate", F.col("ask_from").alias("requested_from"), F.col("ask_to").alias("requested_to"),
        F.least("ask_from", F.coalesce("lo", "ask_from")).alias("context_from"), F.greatest("ask_to", F.coalesce("hi", "ask_to")).alias("context_to"),
    )


def grouped_windows(windows: DataFrame, most: int = MAX_FRAMES) -> DataFrame:
    """windows(source_id, first, count, idx) merged in order while they touch the last group and the union stays within ``most`` frames.

    Windows that don't touch the furthest end before them begin a group whatever came
    earlier, so each stretch between such windows is folded by itself.
    """
    order = Window.partitionBy("source_id").orderBy("first", "count", "idx")
    reach = F.max(F.col("first") + F.col("count")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = windows.withColumn("apart", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)).withColumn("stretch", F.sum("apart").over(order))

    def fold(part: Iterator[tuple]) -> Iterator[tuple]:
        source, stretch, begin, count, _ = next(part)
        end, n = begin + count, 1
        for _, _, first, count, _ in part:
            furthest = max(first + count, end)
            if first <= end and furthest - begin <= most:
                end, n = furthest, n + 1
            else:
                yield source, stretch, begin, end - begin, n
                begin, end, n = first, first + count, 1
        yield source, stretch, begin, end - begin, n

    merged = folded(cut.select("source_id", "stretch", "first", "count", "idx"), ["source_id", "stretch"], ["first", "count", "idx"], fold, "source_id long, stretch long, first long, count long, n_windows long")
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("stretch", "first")) - 1
    return merged.select("source_id", number.cast("int").alias("group"), "first", "count", "n_windows")

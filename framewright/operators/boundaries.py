"""Breaks in a stream, and the segments between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.frames import by_source


def reasons(frames: DataFrame, max_gap: int, key: Column | None = None, order=None, clock: Column | None = None, several: bool = False) -> DataFrame:
    """The reason why a frame doesn't continue the one before: start, source_or_geometry_change, missing_frame, time_gap, or null.

    Time or order that runs back is an error, and so is a clock that changes while the
    key stays. ``several``: a frame may have several rows, of which the first has the
    reason; rows of one ordinal that differ in time or key are an error.
    """
    key, order = F.lit(0) if key is None else key, order or by_source()
    keyed = frames.withColumn("__key", key).withColumn("__clock", F.lit(0) if clock is None else clock)
    last_pts, last_ordinal, last_key, last_clock = (F.lag(c).over(order) for c in ("pts", "ordinal", "__key", "__clock"))
    wrong = (F.col("pts") <= last_pts) | (F.col("ordinal") <= last_ordinal)
    first = F.when(last_ordinal.isNull(), "start")
    if several:
        first = first.when((F.col("ordinal") == last_ordinal) & (F.col("pts") == last_pts) & F.col("__key").eqNullSafe(last_key), F.lit(None).cast("string"))
        first = first.when(F.col("ordinal") <= last_ordinal, F.raise_error(F.lit("time or order is not strictly increasing")).cast("string"))
    reason = (
        first.when(~F.col("__key").eqNullSafe(last_key), "source_or_geometry_change")
        .when(~F.col("__clock").eqNullSafe(last_clock), F.raise_error(F.lit("the clock of a source changed")).cast("string"))
        .when(wrong, F.raise_error(F.lit("time or order is not strictly increasing")).cast("string"))
        .when(F.col("ordinal") != last_ordinal + 1, "missing_frame")
        .when(F.col("pts") - last_pts > max_gap, "time_gap")
    )
    return keyed.withColumn("reason", reason).drop("__key", "__clock")


def segments(frames: DataFrame, max_gap: int, key: Column | None = None, several: bool = False) -> DataFrame:
    """Frames with the number of their segment, from 1."""
    marked = reasons(frames, max_gap, key, several=several)
    return marked.withColumn("segment", F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(by_source()))


def reset_floor(frames: DataFrame, key: Column) -> DataFrame:
    """The latest ordinal at or before each frame at which the key changed."""
    last = F.lag(key).over(by_source())
    reset = F.when(F.col("ordinal") == 0, F.lit(True)).otherwise(~key.eqNullSafe(last))
    return frames.withColumn("is_reset", reset).withColumn("floor", F.max(F.when(F.col("is_reset"), F.col("ordinal"))).over(by_source()))

"""Timelines: normalised time, durations, range selection and audio-style windows."""

from __future__ import annotations

from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..sources.frames import by_source


def normalised(frames: DataFrame) -> DataFrame:
    """Ticks since each source's first frame."""
    return frames.withColumn("ticks", F.col("pts") - F.min("pts").over(Window.partitionBy("source_id")))


def extent(frames: DataFrame) -> DataFrame:
    """Per source: frames, origin, and the end, one tick after the last frame."""
    return frames.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_frames"), F.min("pts").alias("origin"), (F.max("pts") + 1).alias("stream_end"))


def with_durations(timeline: DataFrame, stream_end: Column) -> DataFrame:
    """A zero duration becomes the time to the next frame, or to the stream's end. Times that don't grow are an error."""
    step = F.lead("pts").over(by_source()) - F.col("pts")
    given = F.coalesce(F.nullif("duration", F.lit(0)), step, stream_end - F.col("pts"))
    wrong = F.raise_error(F.lit("presentation times have to grow")).cast("long")
    return timeline.withColumn("duration", F.when(step.isNull() | (step > 0), given).otherwise(wrong))


def select_range(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames of the half-open range of ticks."""
    return normalised(frames).where((F.col("ticks") >= start) & (F.col("ticks") < end))


def lower_bound(frames: DataFrame, tick: int) -> DataFrame:
    """Per source the first ordinal at or after a tick (null: none)."""
    return normalised(frames).groupBy("source_id").agg(F.min(F.when(F.col("ticks") >= tick, F.col("ordinal"))).alias("first_ordinal"))


def clipped_windows(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks (source_id, ordinal, ticks, length) that meet the window: how many, first and last clipped tick, and overlaps of neighbours."""
    before = F.lag(F.col("ticks") + F.col("length")).over(by_source())
    marked = blocks.withColumn("overlap", F.coalesce(before > F.col("ticks"), F.lit(False)))
    met = marked.where((F.col("ticks") < end) & (F.col("ticks") + F.col("length") > start))
    return met.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.min(F.greatest("ticks", F.lit(start))).alias("first_tick"),
        F.max(F.least(F.col("ticks") + F.col("length"), F.lit(end))).alias("end_tick"),
        F.sum(F.least(F.col("ticks") + F.col("length"), F.lit(end)) - F.greatest("ticks", F.lit(start))).alias("covered"),
        F.count_if("overlap").alias("overlaps"),
    )


def shifted(ticks: Column, numerator: int, denominator: int) -> tuple[Column, Column]:
    """Whole ticks and remainder of ticks * numerator / denominator."""
    product = ticks * F.lit(numerator)
    return F.floor(product / F.lit(denominator)), F.pmod(product, F.lit(denominator))


def range_problems(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Sources for which the half-open range of ticks can't be selected: it isn't within the timeline, or no frame begins in it."""
    inside = (F.col("ticks") >= start) & (F.col("ticks") < end)
    found = normalised(frames).groupBy("source_id").agg(F.max(F.col("ticks") + F.col("duration")).alias("length"), F.count_if(inside).alias("n"))
    problem = F.when(F.lit(not 0 <= start < end) | (F.col("length") < end), "outside of the timeline").when(F.col("n") == 0, "no frame begins in it")
    return found.select("source_id", problem.alias("problem")).where("problem is not null")


def prepared(frames: DataFrame, start: int, end: int, most: int = 120) -> DataFrame:
    """Per source the window of frames that begin within the half-open range: its first ordinal and count, or why a review of it can't be made."""
    inside = (F.col("ticks") >= start) & (F.col("ticks") < end)
    found = normalised(frames).groupBy("source_id").agg(F.max(F.col("ticks") + F.col("duration")).alias("length"), F.min(F.when(inside, F.col("ordinal"))).alias("first"), F.count_if(inside).alias("n"))
    problem = F.when(F.lit(not 0 <= start < end) | (F.col("length") < end), "outside of the timeline").when(F.col("n") == 0, "no frame begins in it").when(F.col("n") > most, "too many frames")
    fits = problem.isNull()
    return found.select("source_id", F.when(fits, F.col("first")).alias("first"), F.when(fits, F.col("n")).alias("count"), problem.alias("problem"))


@F.pandas_udf(T.StringType())
def display_seconds(numerators: pd.Series, denominators: pd.Series) -> pd.Series:
    """A fraction as a plain decimal of 30 digits at most, without trailing zeros; for showing only."""
    with localcontext() as context:
        context.prec = 30
        texts = [None if pd.isna(n) or pd.isna(d) or not d else format(Decimal(int(n)) / Decimal(int(d)), "f") for n, d in zip(numerators, denominators)]
    return pd.Series([t.rstrip("0").rstrip(".") if t and "." in t else t for t in texts], dtype=object)


def outward(numerator: Column, denominator: Column, places: int, up: bool) -> Column:
    """numerator / denominator as a decimal text with so many places, rounded up or down but never past an exact value. Both are whole and not negative."""
    scaled = numerator.cast("decimal(38,0)") * F.lit(10**places).cast(f"decimal({places + 1},0)")
    rest = scaled % denominator.cast("decimal(20,0)")
    units = (scaled - rest) / denominator.cast("decimal(20,0)") + (F.when(rest > 0, 1).otherwise(0) if up else F.lit(0))
    digits = F.lpad(units.cast("decimal(38,0)").cast("string"), 38, "0")
    head = F.regexp_replace(F.substring(digits, 1, 38 - places), "^0+(?=.)", "")
    return F.concat(head, F.lit("."), F.substring(digits, 39 - places, places))

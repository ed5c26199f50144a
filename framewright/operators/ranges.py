"""Joins of points with ranges, and the nearest point before or after: never all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def bucket(value: Column, width: int) -> Column:
    """Number of the bucket of whole numbers that a value lies in, also below zero."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def meet(points: DataFrame, ranges: DataFrame, on: list[str], at: str, begin: str, end: str, width: int) -> DataFrame:
    """Points and ranges equal in ``on`` with begin <= at < end.

    Both sides also join on the bucket of the axis, so a key with very many rows is
    dealt to as many tasks as it has buckets, and a point meets only the ranges near
    it. A range is copied once for each bucket that it touches: the width should be
    about as large as ranges are.
    """
    near = points.withColumn("__bucket", bucket(F.col(at), width))
    steps = F.sequence(bucket(F.col(begin), width), bucket(F.col(end) - 1, width))
    spread = ranges.where(F.col(begin) < F.col(end)).withColumn("__bucket", F.explode(steps))
    return near.join(spread, [*on, "__bucket"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("__bucket")


def nearest(asked: DataFrame, points: DataFrame, on: list[str], at: str, value: Column, after: bool, name: str) -> DataFrame:
    """asked with the value of the last point at or before ``at`` (after: the first at or after it), null without one.

    Both sides are laid on one axis and swept once in its order; points of ``points``
    that stand at the same place count as well. ``value`` has to grow with the place
    among points of the same place.
    """
    kinds = asked.select(*on, F.col(at).alias("__at"), F.lit(None).cast("long").alias("__value"), F.struct(*asked.columns).alias("__row"))
    marks = points.select(*on, F.col(at).alias("__at"), value.cast("long").alias("__value"), F.lit(None).cast(kinds.schema["__row"].dataType).alias("__row"))
    place = F.desc("__at") if after else F.asc("__at")
    order = Window.partitionBy(*on).orderBy(place, F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = kinds.unionByName(marks).withColumn("__near", F.last("__value", ignorenulls=True).over(order))
    return swept.where(F.col("__row").isNotNull()).select("__row.*", F.col("__near").alias(name))

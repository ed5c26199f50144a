"""The events table as timed observation streams, one source per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

def by_source():
    """The window of a source's frames in order."""
    return Window.partitionBy("source_id").orderBy("ordinal")



def micros(column: str):
    return F.unix_micros(F.to_timestamp(F.col(column).cast("timestamp")))


def frames(events: DataFrame) -> DataFrame:
    """source_id, ordinal, pts (microseconds), event_id, event_type, cents (value in hundredths)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("source_id"),
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        micros("ts").alias("pts"),
        "event_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )

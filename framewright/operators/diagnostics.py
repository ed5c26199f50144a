"""What lanes and lamps were told, row by row and counted: declarations and discontinuities, no proof of what was to be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.frames import by_source
from .boundaries import reasons
from .geometry import whole_pixels
from .lamps import source_reset


def lane_counts(states: DataFrame) -> DataFrame:
    """states(source_id, status, reason, section_reason, reset_reason, recorded): one row of counters a source."""
    known = F.col("recorded") & F.col("section_reason").isNull()
    return states.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(~F.col("recorded")).alias("legacy_rows"), F.count_if(known).alias("section_ready_rows"),
        F.count_if(F.col("recorded") & F.col("section_reason").isNotNull()).alias("section_unknown_rows"), F.count_if(F.col("status") == "unknown").alias("lane_unknown_rows"),
        F.count("reset_reason").alias("source_resets"), F.count_if(F.col("status") == "candidate").alias("candidate_count"),
    )


def reason_counts(rows: DataFrame, channels: dict[str, str]) -> DataFrame:
    """(source_id, channel, reason, n) of the reason columns, or arrays of reasons, that make the channels."""
    listed = lambda c: F.col(c) if rows.schema[c].dataType.typeName() == "array" else F.array_compact(F.array(c))
    each = F.array(*[F.struct(F.lit(name).alias("channel"), listed(c).alias("reasons")) for name, c in channels.items()])
    long = rows.select("source_id", F.inline(each)).select("source_id", "channel", F.explode("reasons").alias("reason"))
    return long.groupBy("source_id", "channel", "reason").agg(F.count(F.lit(1)).alias("n"))


def section_resets(rows: DataFrame, reason: str, source: Column) -> DataFrame:
    """rows with reset_reason: why the section is unknown, or lane_source_change where its source differs from the last known one's neighbour."""
    key = F.when(F.col(reason).isNull(), source)
    last = F.lag(key).over(by_source())
    return rows.withColumn("reset_reason", F.when(F.col(reason).isNotNull(), F.col(reason)).when(last.isNotNull() & (last != key), "lane_source_change"))


def side_geometry(prefix: str, min_pixels: int) -> tuple[Column, Column]:
    """(geometry status, whole pixels) of a side's declared region and status; without an observation the identity is uncertain."""
    corners = [F.col(f"{prefix}_{c}") for c in ("x1", "y1", "x2", "y2")]
    pixels = whole_pixels(*corners)
    declared = F.when(F.col("observed"), F.col(f"{prefix}_status")).otherwise("identity_uncertain")
    return F.when((declared == "usable") & (pixels < min_pixels), "too_small").otherwise(declared), pixels


def lamp_facts(rows: DataFrame, max_gap: int, min_pixels: int) -> DataFrame:
    """rows(source_id, ordinal, pts, observed, identity, source, and each side's x1..y2 and status): per row its statuses and every reason why a history breaks there."""
    order = by_source()
    marked = reasons(rows, max_gap)
    seen = F.lag("observed").over(order)
    reset = source_reset(F.col("source"))
    moved = F.col("observed") & seen & ~F.col("identity").eqNullSafe(F.lag("identity").over(order))
    breaks = F.array_compact(F.array(
        F.col("reason"), reset, F.when(~F.col("observed"), "no_actual_observation"), F.when(F.col("observed") & ~seen, "actual_observation_resumed"),
        F.when(moved, "identity_or_model_change"), F.when((F.col("left_status") == "identity_uncertain") | (F.col("right_status") == "identity_uncertain"), "identity_uncertain"),
    ))
    (left, left_pixels), (right, right_pixels) = (side_geometry(s, min_pixels) for s in ("left", "right"))
    return marked.select(
        "source_id", "ordinal", "observed", F.col("source").isNull().alias("unknown_source"), F.col("reason").alias("clock_break"), reset.alias("source_reset"), F.array_sort(F.array_distinct(breaks)).alias("breaks"),
        left.alias("left_geometry"), left_pixels.alias("left_pixels"), right.alias("right_geometry"), right_pixels.alias("right_pixels"),
        F.coalesce(F.col("ordinal") - F.lag("ordinal").over(order) - 1, F.lit(0)).alias("missing"), (F.col("pts") - F.lag("pts").over(order)).alias("elapsed"),
    )


def lamp_counts(facts: DataFrame) -> DataFrame:
    """One row of counters a source."""
    return facts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if("unknown_source").alias("observation_unknown_rows"), F.count("source_reset").alias("source_resets"),
        F.count_if(F.col("clock_break").isin("missing_frame", "time_gap")).alias("gap_rows"), F.count_if(~F.col("observed")).alias("no_actual_rows"),
    )

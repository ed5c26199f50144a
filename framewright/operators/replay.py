"""Recorded rows joined with decoded frames and run through the lane and lamp folds; windows planned for several candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import lamps, lanes, ranges
from .planning import MAX_FRAMES
from .receipts import region_sum
from .sinks import checked_selection


def joined(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """Decoded frames with what was recorded for them; frames without a row are passed over, never filled."""
    return frames.join(rows, ["source_id", "ordinal"])


def pixel_window(decoded: DataFrame, first: int, count: int) -> DataFrame:
    """decoded(source_id, ordinal, width, height, bgr): the frames of a window of at most MAX_FRAMES, each of the right size."""
    if not 1 <= count <= MAX_FRAMES or first < 0:
        raise ValueError("a window holds 1 to 120 frames")
    fits = F.octet_length("bgr") == F.col("width") * F.col("height") * 3
    checked = F.when(fits, F.col("bgr")).otherwise(F.raise_error(F.lit("frame has the wrong size")).cast("binary"))
    return decoded.where((F.col("ordinal") >= first) & (F.col("ordinal") < first + count)).withColumn("bgr", checked)


def brightness(frames: DataFrame, side: str, min_pixels: int) -> DataFrame:
    """frames(bgr, width, and the side's x1..y2 and visibility): status and exact mean of the whole pixels, as a sum and a count."""
    x1, y1, x2, y2 = (F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2"))
    whole = [F.ceil(x1).cast("int"), F.ceil(y1).cast("int"), F.floor(x2).cast("int"), F.floor(y2).cast("int")]
    summed = region_sum(F.col("bgr"), F.col("width"), *whole)
    status = F.when(F.col(f"{side}_status") != "usable", F.col(f"{side}_status")).when(F.col("__s.count") < min_pixels, "too_small").otherwise("usable")
    usable = F.col("status") == "usable"
    return (
        frames.withColumn("__s", summed).withColumn("status", status)
        .withColumn("total", F.when(usable, F.col("__s.total"))).withColumn("samples", F.when(usable, F.col("__s.count") * 3)).drop("__s")
    )


# The names of gates and statuses.
def section_reason(vehicle: Column, batch: Column, context: Column, flags: dict[str, Column], bindings: Column, first_failure: Column, ordered: Column) -> Column:
    """Why a lane section can't be used: the first gate that is shut, then the first failing binding, then the order of what was found."""
    return F.coalesce(
        F.when(vehicle.isNull(), "no_actual_observation"), F.when(batch.isNull(), "lanes_unknown"), F.when(context.isNull(), "context_unknown"),
        F.when(~flags["adjacency"], "boundary_bindings_unconfirmed"), F.when(~flags["axes"], "coded_axes_uncertain"), F.when(~flags["scene"], "ego_scene_or_pose_uncertain"),
        F.when(bindings < 3, "insufficient_boundaries"), first_failure, F.when(~ordered, "boundary_order_uncertain"),
    )


def roi_gate(vehicle: Column, observation: Column, identity: Column, mapped: Column, visibility: Column) -> Column:
    """Status of a lamp region by its gates; what isn't known is uncertain, never dark."""
    return (
        F.when(vehicle.isNull(), "identity_uncertain").when(observation.isNull(), "model_uncertain").when(~identity, "identity_uncertain").when(~mapped, "model_uncertain")
        .when(visibility == "visible", "usable").when(visibility == "unknown", "model_uncertain").otherwise(visibility)
    )


def source_key(*parts: str) -> Column:
    """Everything that a reading depends on; a change of any part begins anew."""
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def one_mode(rows: DataFrame, provenance: str) -> DataFrame:
    """Rows of runs that keep to one mode: all with provenance, or none; a mixed run is an error."""
    mode = F.col(provenance).isNotNull()
    mixed = rows.groupBy("source_id").agg((F.min(mode.cast("int")) != F.max(mode.cast("int"))).alias("__mixed"))
    checked = F.when(~F.col("__mixed"), F.col("source_id")).otherwise(F.raise_error(F.lit("a run mixes its modes")).cast(rows.schema["source_id"].dataType))
    return rows.join(mixed, "source_id").withColumn("source_id", checked).drop("__mixed")


def lanes_by_mode(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """rows(source_id, ordinal, lane, evidence) with the lane that counts: the recorded one of runs without evidence, that of sections(source_id, ordinal, lane) made anew of runs with it.

    A run that mixes both is an error, so no recorded lane stands in for one that evidence doesn't give.
    """
    fresh = sections.select("source_id", "ordinal", F.col("lane").alias("__lane"))
    met = one_mode(rows, "evidence").join(fresh, ["source_id", "ordinal"], "left")
    return met.withColumn("lane", F.when(F.col("evidence").isNull(), F.col("lane")).otherwise(F.col("__lane"))).drop("__lane")


def observer(rows: DataFrame) -> DataFrame:
    """What a review may show: actually observed frames of the chosen vehicle alone."""
    return rows.where("state = 'observed'")


def analyse(frames: DataFrame, rows: DataFrame, source: Column, max_gap: int, dwell: int, windows: DataFrame, config: lamps.LampConfig) -> dict[str, DataFrame]:
    """Lane changes, lamp reports and resets of recorded rows (source_id, ordinal, lane, interior, observed, identity, uncertain, status, brightness).

    A frame without a row is none of the stream, so the next one breaks it.
    """
    whole = joined(frames, rows)
    marked = lamps.histories(whole, max_gap, source=source)
    samples = lamps.latest(marked).select("source_id", "ordinal", "ticks", "status", "brightness")
    return {
        "changes": lanes.lane_changes(whole.select("source_id", "ordinal", "pts", "lane", "interior"), max_gap, dwell),
        "lamps": lamps.window_report(samples, windows, config),
        "resets": marked.where("source_reset is not null").select("source_id", "ordinal", F.col("source_reset").alias("reason")),
    }


def batch_windows(timeline: DataFrame, contexts: DataFrame, selection: list[int], width: int) -> DataFrame:
    """contexts(source_id, candidate, context_from, context_to) of the chosen candidates as windows (source_id, idx, first, count) of frames; width: about that of a context, in ticks."""
    checked_selection(selection)
    chosen = contexts.where(F.col("candidate").isin(list(selection)))
    inside = ranges.meet(timeline.select("source_id", "ordinal", "ticks"), chosen, ["source_id"], "ticks", "context_from", "context_to", width)
    windows = inside.groupBy("source_id", F.col("candidate").alias("idx")).agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("count"))
    fits = F.when(F.col("count") <= MAX_FRAMES, F.col("count")).otherwise(F.raise_error(F.lit("a window holds 120 frames at most")).cast("long"))
    return windows.withColumn("count", fits)


def worth_priming(groups: DataFrame, windows: DataFrame, kept_from: int, kept_count: int) -> DataFrame:
    """Groups (source_id, group, first, count) with whether one pass costs no more frames than the windows that what is kept doesn't cover."""
    covered = (F.col("w_first") >= kept_from) & (F.col("w_first") + F.col("w_count") <= kept_from + kept_count)
    single = windows.select("source_id", F.col("first").alias("w_first"), F.col("count").alias("w_count"))
    met = groups.join(single, "source_id").where((F.col("w_first") >= F.col("first")) & (F.col("w_first") + F.col("w_count") <= F.col("first") + F.col("count")))
    cost = met.groupBy("source_id", "group", "first", "count").agg(F.sum(F.when(covered, 0).otherwise(F.col("w_count"))).alias("separate"))
    return cost.withColumn("prime", ~((F.col("separate") > 0) & (F.col("separate") < F.col("count"))))

"""Lamp brightness: histories, hysteresis phases, blink cycles and window reports. Unknown is never read as off."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.frames import by_source
from .boundaries import reasons as break_reasons

UNKNOWN = "unknown"
#: Samples that a history keeps.
MOST_SAMPLES = 120


@dataclass(frozen=True)
class LampConfig:
    """Brightness thresholds, and times in ticks."""

    off: int = 50
    on: int = 180
    min_phase: int = 1
    max_phase: int = 1 << 60
    min_cycles: int = 1
    min_window: int = 1


def source_reset(source: Column) -> Column:
    """Why readings of a source key begin anew: lamps_unknown where there is no key, lamp_source_change where it differs from the last one."""
    last = F.lag(source).over(by_source())
    return F.when(source.isNull(), "lamps_unknown").when(last.isNotNull() & (last != source), "lamp_source_change")


def histories(rows: DataFrame, max_gap: int, key: Column | None = None, source: Column | None = None) -> DataFrame:
    """rows(source_id, ordinal, pts, observed, identity, uncertain) with the number of their history and why it began.

    A break of the stream, another identity or model, an uncertain identity, a row
    without observation, and with ``source`` an unknown or changed source key, end a
    history. Rows without an observation belong to none.
    """
    order = by_source()
    marked = break_reasons(rows, max_gap, key)
    fresh = ~F.coalesce(F.lag("observed").over(order), F.lit(False))
    if source is not None:
        marked = marked.withColumn("source_reset", source_reset(source))
        fresh = fresh | F.col("source_reset").isNotNull()
    changed = ~F.col("identity").eqNullSafe(F.lag("identity").over(order))
    begun = F.when(F.col("uncertain"), "identity_uncertain").when(fresh, "start").when(F.col("reason").isNotNull(), F.col("reason")).when(changed, "identity_or_model_change")
    begun = F.when(F.col("observed"), begun).otherwise("no_actual_observation")
    counted = marked.withColumn("begun", begun).withColumn("history", F.sum(F.when(F.col("begun").isNotNull(), 1).otherwise(0)).over(order))
    return counted.withColumn("begun", F.first("begun").over(Window.partitionBy("source_id", "history").orderBy("ordinal")))


def latest(marked: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """The samples that a report can use: of each source's last history the newest ``most``; none if its last row has no observation."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("ordinal"))
    numbered = marked.withColumn("__n", F.row_number().over(newest)).withColumn("__last", F.first("history").over(newest))
    return numbered.where((F.col("history") == F.col("__last")) & F.col("observed") & (F.col("__n") <= most)).drop("__n", "__last")


def phases(rows: DataFrame, config: LampConfig, keys: tuple[str, ...] = ("source_id",), breaks: Column | None = None) -> DataFrame:
    """rows(keys, ordinal, ticks, status, brightness): run, phase and whether the phase changes there.

    A sample that isn't usable ends a run, and one at which ``breaks`` holds begins
    one; within a run the phase holds between the thresholds, and its first value is
    no change.
    """
    usable = F.col("status") == "usable"
    ends = ~usable if breaks is None else ~usable | breaks
    order = Window.partitionBy(*keys).orderBy("ordinal")
    runs = rows.withColumn("run", F.sum(F.when(ends, 1).otherwise(0)).over(order))
    raw = F.when(F.col("brightness") >= config.on, "on").when(F.col("brightness") <= config.off, "off")
    within = Window.partitionBy(*keys, "run").orderBy("ordinal")
    held = runs.where(usable).withColumn("phase", F.last(raw, ignorenulls=True).over(within))
    return held.withColumn("changes", F.coalesce(F.lag("phase").over(within) != F.col("phase"), F.lit(False)))


def cycles(phased: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Three changes on, off, on in turn: where they lie and how long both phases last."""
    order = Window.partitionBy(*keys, "run").orderBy("ordinal")
    changes = phased.where("changes").select(*keys, "run", "ordinal", "ticks", "phase", F.lag("ticks", 1).over(order).alias("off_at"), F.lag("ticks", 2).over(order).alias("on_at"))
    return changes.where("phase = 'on' and on_at is not null").select(*keys, "on_at", "off_at", F.col("ticks").alias("end_at"), (F.col("off_at") - F.col("on_at")).alias("lit"), (F.col("ticks") - F.col("off_at")).alias("dark"))


KEYS = ("source_id", "window_id")


def bracketed(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window (source_id, window_id, start, end) the samples from the last at or before its start to the first at or after its end, and whether both exist.

    A window of a source without samples has one row without any. A source has
    MOST_SAMPLES samples at most, so a window meets no more.
    """
    met = windows.join(samples, "source_id", "left")
    own = Window.partitionBy(*KEYS)
    before = F.max(F.when(F.col("ticks") <= F.col("start"), F.col("ordinal"))).over(own)
    after = F.min(F.when(F.col("ticks") >= F.col("end"), F.col("ordinal"))).over(own)
    marked = met.withColumn("__before", before).withColumn("__after", after).withColumn("bracketed", F.col("__before").isNotNull() & F.col("__after").isNotNull())
    inside = (F.col("__before").isNull() | (F.col("ordinal") >= F.col("__before"))) & (F.col("__after").isNull() | (F.col("ordinal") <= F.col("__after")))
    return marked.where(F.col("ordinal").isNull() | inside).drop("__before", "__after")


def window_report(samples: DataFrame, windows: DataFrame, config: LampConfig) -> DataFrame:
    """Per window: state, whether blinking was seen, cycles, reasons for unknown, usable samples, and the samples looked at.

    samples(source_id, ordinal, ticks, status, brightness) are those of ``latest``.
    """
    seen = bracketed(samples, windows)
    phased = phases(seen, config, KEYS)
    inside = cycles(phased, KEYS).join(windows, list(KEYS)).where((F.col("on_at") >= F.col("start")) & (F.col("end_at") <= F.col("end")))
    good = F.col("lit").between(config.min_phase, config.max_phase) & F.col("dark").between(config.min_phase, config.max_phase)
    counted = inside.groupBy(*KEYS).agg(F.count_if(good).alias("n_cycles"), F.count_if(~good).alias("bad"))
    within = F.col("changes") & (F.col("ticks") >= F.col("start")) & (F.col("ticks") <= F.col("end"))
    phase = phased.groupBy(*KEYS).agg(F.count_if(F.col("phase").isNull()).alias("unclear"), F.count_if(within).alias("n_changes"))
    base = seen.groupBy(*KEYS).agg(
        F.count_if(F.col("status") == "usable").alias("valid_samples"), F.bool_and("bracketed").alias("bracketed"), F.collect_set(F.when(F.col("status") != "usable", F.col("status"))).alias("statuses"),
        F.count("ordinal").alias("n_samples"), F.min("ticks").alias("first_tick"), F.max("ticks").alias("last_tick"), F.bool_and(F.col("end") - F.col("start") >= config.min_window).alias("long"),
    )
    joined = base.join(phase, list(KEYS), "left").join(counted, list(KEYS), "left").na.fill(0, ["n_cycles", "bad", "unclear", "n_changes"])
    blink = F.col("n_cycles") >= config.min_cycles
    complete = F.col("bracketed") & F.col("long")
    more = F.array_compact(F.array(
        F.when(~complete, "insufficient_history"), F.when((F.col("unclear") > 0) | (F.col("bad") > 0), "model_uncertain"), F.when((F.col("n_changes") > 0) & ~blink, "insufficient_cycles"),
    ))
    why = F.array_sort(F.array_distinct(F.concat("statuses", more)))
    state = F.when(F.size(why) > 0, UNKNOWN).when(blink, "blink_observed").otherwise("no_blink_observed")
    return joined.select(*KEYS, state.alias("state"), blink.alias("blink_evidence"), "n_cycles", F.array_join(why, ",").alias("reasons"), "valid_samples", "n_samples", "first_tick", "last_tick")


def combined(left: Column, right: Column, left_blinks: Column, right_blinks: Column) -> Column:
    """The signal that two sides make."""
    return (
        F.when((left == UNKNOWN) | (right == UNKNOWN), UNKNOWN).when(left_blinks & right_blinks, "both_blink")
        .when(left_blinks, "left_blink").when(right_blinks, "right_blink").otherwise("no_blink_observed")
    )


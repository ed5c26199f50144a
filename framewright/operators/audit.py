"""Catalogues of candidates, checks of reports, and audits that recompute what was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .lamps import UNKNOWN, combined
from .receipts import canonical_json, differences


BODY = ("source_id", "candidate", "direction", "start", "end", "context_from", "context_to", "signal")


def catalogue(candidates: DataFrame, contexts: DataFrame, sides: DataFrame) -> DataFrame:
    """One row per candidate (source_id, candidate, start, end, direction): widened context, signal, and the digest of its canonical JSON.

    contexts: of ``planning.context``; sides: per candidate the state and blink evidence of the left and right lamps.
    """
    on = ["source_id", "candidate"]
    wide = candidates.join(contexts, on, "left").join(sides, on, "left")
    known = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    blinks = lambda c: F.coalesce(c, F.lit(False))
    signal = combined(known(F.col("left_state")), known(F.col("right_state")), blinks(F.col("left_blinks")), blinks(F.col("right_blinks")))
    return wide.withColumn("signal", signal).withColumn("sha256", F.sha2(body_text().cast("binary"), 256)).select(*BODY, "requested_from", "requested_to", "sha256")


def body_text() -> Column:
    """A catalogue row as canonical JSON."""
    return canonical_json(F.to_json(F.struct(*BODY)))


def summary(rows: DataFrame) -> DataFrame:
    """What may be shown of a catalogue: no digests, sources or planned contexts."""
    return rows.select("candidate", "direction", "start", "end", "signal")


def catalogue_problem(order: list[str]) -> Column:
    """The first thing that contradicts itself in a catalogue row (source_id, candidate, direction, start, end, requested_*, context_*, signal, and both sides' state, blinks and reasons)."""
    last = F.lag("end").over(Window.partitionBy("source_id").orderBy(*order))
    left, right = (side_problem(F.col(f"{s}_state"), F.col(f"{s}_blinks"), F.col(f"{s}_reasons")) for s in ("left", "right"))
    signal = combined(F.col("left_state"), F.col("right_state"), F.col("left_blinks"), F.col("right_blinks"))
    return F.coalesce(
        F.when(~F.col("direction").isin("left", "right"), "direction"), F.when(F.col("start") > F.col("end"), "chronology"), F.when(F.col("end") <= last, "order"),
        F.when(~((F.col("context_from") <= F.col("requested_from")) & (F.col("requested_from") <= F.col("start")) & (F.col("end") < F.col("requested_to")) & (F.col("requested_to") <= F.col("context_to"))), "context"),
        left, right, F.when(signal != F.col("signal"), "signal"),
    )


def side_problem(state: Column, blinks: Column, reasons: Column) -> Column:
    """What contradicts itself in a side's summary: unknown has reasons and nothing else has; blinking agrees with the state."""
    some = F.size(reasons) > 0
    return (
        F.when((state == UNKNOWN) != some, "unknown needs reasons, and only that").when((state == "blink_observed") & ~blinks, "no evidence of blinking").when((state == "no_blink_observed") & blinks, "evidence of blinking")
    )


def bracket_problem(names: list[str]) -> Column:
    """Brackets that don't follow each other: each of (from, to) goes forward, and starts no earlier than the one before."""
    found = F.lit(None).cast("string")
    pairs = [(names[k], names[k + 1]) for k in range(0, len(names), 2)]
    for k, (a, b) in reversed(list(enumerate(pairs))):
        wrong = F.col(a) > F.col(b)
        if k:
            wrong = wrong | (F.col(pairs[k - 1][0]) > F.col(a)) | (F.col(pairs[k - 1][1]) > F.col(b))
        found = F.when(wrong, F.lit(f"{a}, {b} out of order")).otherwise(found)
    return found


def report_problems(reports: DataFrame) -> DataFrame:
    """(source_id, ordinal, problem) of tracking reports that contradict themselves.

    A state has to fit what it names: observed rows have a detection and no age,
    predictions no detection and an age; an identity or detection stands once; an
    ambiguous detection belongs to no track, and an ended track isn't there any more;
    an ambiguous group has one class.
    """
    keys = ["source_id", "ordinal"]
    state, det, track = F.col("state"), F.col("det_index"), F.col("track_id")
    wrong = (
        ((state == "observed") & (det.isNull() | track.isNull() | (F.col("unobserved") != 0))) | ((state == "prediction_only") & (det.isNotNull() | track.isNull() | (F.col("unobserved") <= 0)))
        | ((state == "ambiguous") & (track.isNotNull() | det.isNull())) | ((state == "ended") & track.isNull()) | ~state.isin("observed", "prediction_only", "ambiguous", "ended")
    )
    odd = reports.where(wrong).select(*keys, F.lit("state").alias("problem"))
    twice = lambda c: reports.where(F.col(c).isNotNull()).groupBy(*keys, c).count().where("count > 1").select(*keys, F.lit(f"{c} twice").alias("problem"))
    mixed = reports.where("component is not null").groupBy(*keys, "component").agg(F.count_distinct("class_id").alias("n")).where("n > 1").select(*keys, F.lit("classes of a group").alias("problem"))
    return odd.unionAll(twice("track_id")).unionAll(twice("det_index")).unionAll(mixed).distinct()


def mismatched_frames(recorded: DataFrame, timeline: DataFrame, columns: tuple[str, ...] = ("pts",)) -> DataFrame:
    """Recorded frames (source_id, ordinal, columns) that the timeline doesn't have just so: with what differs, or ``ordinal`` if there is no such frame."""
    there = timeline.select("source_id", "ordinal", F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in columns])
    met = recorded.join(there, ["source_id", "ordinal"], "left")
    wrong = F.coalesce(F.when(F.col("__there").isNull(), "ordinal"), *[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in columns])
    return met.select("source_id", "ordinal", wrong.alias("problem")).where("problem is not null")


def review_problems(review: DataFrame, timeline: DataFrame, rows: DataFrame) -> DataFrame:
    """review(source_id, ordinal, pts, track_id) against the source's frames and the recorded rows (source_id, ordinal, track_id): frame, pts or observation."""
    frame = timeline.select("source_id", "ordinal", F.col("pts").alias("__pts"))
    row = rows.select("source_id", "ordinal", F.col("track_id").alias("__track"))
    met = review.join(frame, ["source_id", "ordinal"], "left").join(row, ["source_id", "ordinal"], "left")
    wrong = F.coalesce(F.when(F.col("__pts").isNull(), "frame"), F.when(F.col("pts") != F.col("__pts"), "pts"), F.when(~F.col("track_id").eqNullSafe(F.col("__track")), "observation"))
    return met.select("source_id", "ordinal", wrong.alias("problem")).where("problem is not null")


def batch_problems(recorded: DataFrame, recomputed: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Recorded rows against fresh ones, row by row: missing, unexpected, or the first column that differs."""
    r = recorded.select(*on, F.lit(True).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in columns])
    n = recomputed.select(*on, F.lit(True).alias("__n"), *[F.col(c).alias(f"__n_{c}") for c in columns])
    differs = [F.when(~F.col(f"__r_{c}").eqNullSafe(F.col(f"__n_{c}")), c) for c in columns]
    problem = F.coalesce(F.when(F.col("__r").isNull(), "missing"), F.when(F.col("__n").isNull(), "unexpected"), *differs)
    return r.join(n, on, "full_outer").select(*on, problem.alias("problem")).where("problem is not null")


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest(path, sha256) against the files(path, sha256) that are there: missing, unlisted or changed."""
    met = manifest.select("path", F.col("sha256").alias("__m")).join(files.select("path", F.col("sha256").alias("__f")), "path", "full_outer")
    problem = F.when(F.col("__f").isNull(), "missing").when(F.col("__m").isNull(), "unlisted").when(F.col("__m") != F.col("__f"), "changed")
    return met.select("path", problem.alias("problem")).where("problem is not null")


def verify(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that stand on one side only; a recording holds if there are none."""
    return differences(recomputed, recorded.select(*recomputed.columns))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_.-]{1,64}\z"), F.lit(False))


def is_model(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_.:-]{1,160}\z"), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))

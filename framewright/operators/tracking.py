"""Multi-object tracking as a keyed fold: constant-velocity filters and unique association."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .boundaries import segments
from .keyed import folded, tasks_of


@dataclass(frozen=True)
class Policy:
    """Times in ticks; noise for (cx, cy, ln w, ln h). classes: those that detections may have (empty: any)."""

    max_gap: int
    max_unobserved: int
    min_score: float = 0.2
    new_score: float = 0.7
    min_iou: float = 0.2
    duplicate_iou: float = 0.95
    ticks_per_second: int = 1_000_000
    measurement: tuple[float, ...] = (1.0, 1.0, 0.01, 0.01)
    spectral: tuple[float, ...] = (1.0, 1.0, 0.01, 0.01)
    position_variance: tuple[float, ...] = (1.0, 1.0, 0.01, 0.01)
    velocity_variance: tuple[float, ...] = (10.0, 10.0, 0.1, 0.1)
    max_detections: int = 64
    max_tracks: int = 128
    classes: tuple[int, ...] = ()


#: How far below zero the determinant of a covariance may come by rounding.
ROUNDING = 1e-10


def predict(state: list[float], dt: float, q: float) -> list[float]:
    """One channel (position, velocity, and their variances and covariance) dt seconds on."""
    x, v, pxx, pxv, pvv = state
    return [x + dt * v, v, pxx + dt * (2 * pxv + dt * pvv) + q * dt**3 / 3, pxv + dt * pvv + q * dt**2 / 2, pvv + q * dt]


def correct(state: list[float], z: float, r: float) -> list[float]:
    x, v, pxx, pxv, pvv = state
    s = pxx + r
    kx, kv = pxx / s, pxv / s
    return [x + kx * (z - x), v + kv * (z - x), pxx - kx * pxx, pxv - kx * pxv, pvv - kv * pxv]


def guarded(state: list[float]) -> list[float]:
    """The channel, if it is finite and its covariance has no negative variance; else an error."""
    _, _, pxx, pxv, pvv = state
    if not all(map(math.isfinite, state)) or min(pxx, pvv, pxx * pvv - pxv * pxv) < -ROUNDING:
        raise ValueError("covariance is not positive or not finite")
    return state


def advanced(channels: list[list[float]], dt: float, noise: list[tuple[float, float, float]]) -> list[list[float]]:
    """All channels of a track dt seconds on and guarded; noise: what ``predict`` adds to each one's variances and covariance."""
    out = []
    for (x, v, pxx, pxv, pvv), (nxx, nxv, nvv) in zip(channels, noise):
        x, pxx, pxv, pvv = x + dt * v, pxx + dt * (2 * pxv + dt * pvv) + nxx, pxv + dt * pvv + nxv, pvv + nvv
        state = [x, v, pxx, pxv, pvv]
        total = x + v + pxx + pxv + pvv  # finite only if all are
        if total - total or pxx < -ROUNDING or pvv < -ROUNDING or pxx * pvv - pxv * pxv < -ROUNDING:
            guarded(state)
        out.append(state)
    return out


def measure(box) -> tuple[float, ...]:
    x1, y1, x2, y2 = box
    return (x1 + x2) / 2, (y1 + y2) / 2, math.log(x2 - x1), math.log(y2 - y1)


def to_box(channels) -> tuple[float, ...]:
    try:
        cx, cy, w, h = channels[0][0], channels[1][0], math.exp(channels[2][0]), math.exp(channels[3][0])
    except OverflowError:
        raise ValueError("state is not finite") from None
    if not all(map(math.isfinite, (cx, cy, w, h))):
        raise ValueError("state is not finite")
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def inside(box, raster) -> tuple:
    """The part of a box within (width, height); four nulls if there is none, the box itself without a raster."""
    if raster is None:
        return box
    x1, y1, x2, y2 = max(box[0], 0.0), max(box[1], 0.0), min(box[2], raster[0]), min(box[3], raster[1])
    return (x1, y1, x2, y2) if x1 < x2 and y1 < y2 else (None,) * 4


def iou(a, b) -> float:
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    wide = (bx2 if bx2 < ax2 else ax2) - (bx1 if bx1 > ax1 else ax1)
    high = (by2 if by2 < ay2 else ay2) - (by1 if by1 > ay1 else ay1)
    common = wide * high if wide > 0 and high > 0 else 0.0
    return common / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - common)


def linked(of_detection: dict[int, set[int]], twins: list[tuple[int, int]]) -> list[tuple[set[int], set[int]]]:
    """(tracks, detections) of each group that edges and twins connect, by their smallest detection."""
    groups: list[tuple[set[int], set[int]]] = []
    for tracks, detections in [*((set(t), {d}) for d, t in of_detection.items()), *((set(), {a, b}) for a, b in twins)]:
        apart = []
        for other in groups:
            if other[0] & tracks or other[1] & detections:
                tracks, detections = tracks | other[0], detections | other[1]
            else:
                apart.append(other)
        groups = [*apart, (tracks, detections)]
    return sorted(groups, key=lambda g: min(g[1]))


@dataclass
class Tracker:
    """State of one source. A failed update leaves none behind."""

    policy: Policy
    last: tuple | None = None  # ordinal, pts, key, clock
    segment: int = 0
    next_id: int = 1
    tracks: dict[int, dict] = field(default_factory=dict)
    reason: str = "start"

    def state(self) -> dict:
        return {"last": self.last, "segment": self.segment, "next_id": self.next_id, "tracks": self.tracks, "reason": self.reason}

    def reset(self, reason: str = "manual_reset") -> None:
        """Forget all tracks; the next update begins a segment for this reason."""
        if reason not in ("start", "manual_reset", "failed_update"):
            raise ValueError("not a reason to reset")
        self.last, self.tracks, self.reason = None, {}, reason

    def update(self, ordinal: int, pts: int, detections: list[dict], key=None, clock=None, raster: tuple[float, float] | None = None) -> list[dict]:
        """detections: index, class_id, box, score. Reports every track, every ambiguous detection and every track that ambiguity ends."""
        return [dict(zip(FIELDS, r)) for r in self.reports(ordinal, pts, detections, key, clock, raster)]

    def reports(self, ordinal: int, pts: int, detections: list[dict], key=None, clock=None, raster: tuple[float, float] | None = None) -> list[tuple]:
        """``update`` with its rows as tuples of FIELDS."""
        try:
            return self._update(ordinal, pts, detections, key, clock, raster)
        except BaseException:
            self.reset("failed_update")
            raise

    def _boundary(self, ordinal, pts, key, clock) -> tuple[str | None, int]:
        if self.last is None:
            return self.reason, 0
        last_ordinal, last_pts, last_key, last_clock = self.last
        if key != last_key:
            return "source_or_geometry_change", 0
        if clock != last_clock:
            raise ValueError("the clock of a source changed")
        dt = pts - last_pts
        if dt <= 0 or ordinal <= last_ordinal:
            raise ValueError("time or order is not strictly increasing")
        return ("missing_decoded_frame" if ordinal != last_ordinal + 1 else "time_gap" if dt > self.policy.max_gap else None), dt

    def _update(self, ordinal, pts, detections, key, clock, raster):
        p = self.policy
        if len(detections) > p.max_detections or len({d["index"] for d in detections}) != len(detections):
            raise ValueError("too many detections, or one index twice")
        if p.classes and any(d["class_id"] not in p.classes for d in detections):
            raise ValueError("a class that the policy doesn't have")
        for d in detections:
            x1, y1, x2, y2 = d["box"]
            total = x1 + y1 + x2 + y2 + d["score"]
            if total != total:
                raise ValueError("a box or score is no number")
        reason, dt = self._boundary(ordinal, pts, key, clock)
        if reason:
            self.segment, self.tracks = self.segment + 1, {}
        self.tracks = {k: t for k, t in self.tracks.items() if pts - t["seen"] <= p.max_unobserved}
        if not reason and self.tracks:
            seconds = dt / p.ticks_per_second
            noise = [(q * seconds**3 / 3, q * seconds**2 / 2, q * seconds) for q in p.spectral]
            for t in self.tracks.values():
                t["channels"] = advanced(t["channels"], seconds, noise)
        fit = {d["index"]: d for d in sorted(detections, key=itemgetter("index")) if d["score"] >= p.min_score}
        of_detection: dict[int, set[int]] = {}
        of_track: dict[int, int] = {}
        boxes = {k: to_box(t["channels"]) for k, t in self.tracks.items()}
        of_class: dict[int, list] = {}
        for i, d in fit.items():
            of_class.setdefault(d["class_id"], []).append((i, d["box"]))
        for k, t in self.tracks.items():
            for i, box in of_class.get(t["class_id"], ()):
                if iou(boxes[k], box) >= p.min_iou:
                    of_detection.setdefault(i, set()).add(k)
                    of_track[k] = of_track.get(k, 0) + 1
        order = list(fit)
        twins = [
            (a, b) for n, a in enumerate(order) for b in order[n + 1 :]
            if fit[a]["class_id"] == fit[b]["class_id"] and iou(fit[a]["box"], fit[b]["box"]) >= p.duplicate_iou
        ]
        twin = {i for pair in twins for i in pair}
        taken = {next(iter(ks)): i for i, ks in of_detection.items() if len(ks) == 1 and i not in twin and of_track[next(iter(ks))] == 1}
        rows, unclear = [], set(taken.values())
        loose = {i: ks for i, ks in of_detection.items() if i not in unclear}
        for number, (ended, indices) in enumerate(linked(loose, twins) if loose or twins else ()):
            unclear |= indices
            for k in sorted(ended):
                rows.append((self.segment, reason, "ended", k, None, self.tracks.pop(k)["class_id"], (None,) * 4, None, None, number))
            for i in sorted(indices):
                d = fit[i]
                rows.append((self.segment, reason, "ambiguous", None, i, d["class_id"], d["box"], d["score"], None, number))
        for k, i in taken.items():
            t = self.tracks[k]
            t["channels"] = [guarded(correct(c, z, r)) for c, z, r in zip(t["channels"], measure(fit[i]["box"]), p.measurement)]
            t["seen"] = pts
            boxes[k] = to_box(t["channels"])
        for i, d in fit.items():
            if i in unclear or d["score"] < p.new_score:
                continue
            if len(self.tracks) >= p.max_tracks:
                raise ValueError("too many tracks")
            self.tracks[self.next_id] = {"class_id": d["class_id"], "seen": pts, "channels": [[z, 0.0, a, 0.0, b] for z, a, b in zip(measure(d["box"]), p.position_variance, p.velocity_variance)]}
            taken[self.next_id] = i
            boxes[self.next_id] = to_box(self.tracks[self.next_id]["channels"])
            self.next_id += 1
        for k, t in sorted(self.tracks.items()):
            i = taken.get(k)
            box = boxes[k] if raster is None else inside(boxes[k], raster)
            rows.append((self.segment, reason, "prediction_only" if i is None else "observed", k, i, t["class_id"], box, None if i is None else fit[i]["score"], pts - t["seen"], None))
        self.last, self.reason = (ordinal, pts, key, clock), None
        return rows


#: Columns of a tracker's rows.
FIELDS = ("segment", "reset_reason", "state", "track_id", "det_index", "class_id", "box", "score", "unobserved", "component")
REPORT = (
    "source_id long, ordinal long, segment int, reset_reason string, state string, track_id int, det_index int, class_id int, x1 double, y1 double, x2 double, y2 double,"
    " score double, unobserved long, component int"
)
COLUMNS = [f.split()[0] for f in REPORT.replace(",", ", ").split(", ")]


#: Columns of a detection, in the order in which ``fed`` takes them; those of its frame first.
DETECTION = ["ordinal", "pts", "key", "clock", "width", "height", "det_index", "class_id", "x1", "y1", "x2", "y2", "score"]


def frames_of(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Ordinal, pts, detections, key, clock and raster of each frame of rows (DETECTION) in order; a row without det_index is for an empty frame."""
    for (ordinal, pts, key, clock, width, height), frame in groupby(rows, itemgetter(0, 1, 2, 3, 4, 5)):
        seen = [{"index": r[6], "class_id": r[7], "box": r[8:12], "score": r[12]} for r in frame if r[6] is not None]
        yield ordinal, pts, seen, key, clock, None if width is None else (float(width), float(height))


def fed(tracker: Tracker, source: int, frames: Iterable[tuple]) -> Iterator[tuple]:
    """The tracker's reports of frames, as tuples of COLUMNS."""
    for frame in frames:
        for segment, reason, state, track, det, kind, (x1, y1, x2, y2), score, unobserved, component in tracker.reports(*frame):
            yield source, frame[0], segment, reason, state, track, det, kind, x1, y1, x2, y2, score, unobserved, component


def plain_rows(rows: pd.DataFrame) -> list[tuple]:
    """Rows of a pandas frame as tuples of DETECTION in order, with None for what is missing."""
    ordered = rows.sort_values(["ordinal", "det_index"]).reindex(columns=DETECTION)
    whole = {"ordinal", "pts", "det_index", "class_id"}
    columns = [[None if pd.isna(v) else int(v) if c in whole else v for v in ordered[c].tolist()] for c in DETECTION]
    return list(zip(*columns))


def run_frames(tracker: Tracker, rows: pd.DataFrame) -> list[dict]:
    """Feed rows (source_id, ordinal, pts, det_index, class_id, box, score; one without det_index for an empty frame; key, clock, width and height if there) in order."""
    return [dict(zip(COLUMNS, r)) for r in fed(tracker, int(rows["source_id"].iloc[0]), frames_of(plain_rows(rows)))]


def as_report(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    return frame.astype({"track_id": "Int32", "det_index": "Int32", "unobserved": "Int64", "component": "Int32"})


def track(detections: DataFrame, policy: Policy) -> DataFrame:
    """All sources' reports. Tracks don't cross segments, so each segment is folded by itself; identities are numbered on over a source's segments.

    Detections are read once and folded once: frames aren't joined back to them, and
    the number of a segment's new tracks stands in one of its rows.
    """
    key = F.col("key") if "key" in detections.columns else None
    known = detections.where("source_id is not null and ordinal is not null")
    cut = segments(known, policy.max_gap, key, several=True)
    given = [F.col(c) if c in detections.columns else F.lit(None).alias(c) for c in DETECTION]
    rows = cut.select("source_id", F.col("segment").alias("__segment"), F.col("reason").alias("__reason"), *given)

    def fold(part: Iterator[tuple]) -> Iterator[tuple]:
        first = next(part)
        source, segment, begun = first[:3]
        tracker = Tracker(policy, segment=segment - 1, reason=begun.replace("missing_frame", "missing_decoded_frame"))
        reported = fed(tracker, source, frames_of(r[3:] for r in chain([first], part)))
        last = next(reported, None)
        for row in reported:
            yield *last, None
            last = row
        if last is not None:
            yield *last, tracker.next_id - 1

    local = folded(rows, ["source_id", "__segment"], ["ordinal", F.col("__reason").isNull()], fold, f"{REPORT}, __born int", tasks_of(detections.sparkSession))
    earlier = Window.partitionBy("source_id").orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    return local.withColumn("track_id", F.col("track_id") + F.coalesce(F.sum("__born").over(earlier), F.lit(0)).cast("int")).select(*COLUMNS)


def filtered(rows: DataFrame, measurement: float, spectral: float, start: tuple[float, float]) -> DataFrame:
    """rows(source_id, ordinal, z, t seconds): position and velocity of one channel after each measurement; start: variances of both at the first."""

    def fold(part: Iterator[tuple]) -> Iterator[tuple]:
        state, last = None, 0.0
        for source, ordinal, z, t in part:
            state = [z, 0.0, start[0], 0.0, start[1]] if state is None else guarded(correct(predict(state, t - last, spectral), z, measurement))
            last = t
            yield source, ordinal, state[0], state[1]

    return folded(rows.select("source_id", "ordinal", "z", "t"), ["source_id"], ["ordinal"], fold, "source_id long, ordinal long, x double, v double")


def annotations(reports: DataFrame, detections: DataFrame) -> DataFrame:
    """What a review shows of each frame: tracks that are observed or predicted, and detections that belong to none, ambiguous or unassociated."""
    on, columns = ["source_id", "ordinal", "det_index"], ["source_id", "ordinal", "state", "track_id", "det_index", "class_id"]
    told = reports.select(*columns, F.lit(True).alias("__told"))
    loose = detections.where("det_index is not null").select("source_id", "ordinal", F.lit("unassociated").alias("state"), F.lit(None).cast("int").alias("track_id"), "det_index", "class_id", F.lit(False).alias("__told"))
    known = F.max("__told").over(Window.partitionBy(*on))  # reports are made once and met here, not joined with themselves
    both = told.unionByName(loose).withColumn("__known", known)
    return both.where("if(__told, state in ('observed', 'prediction_only', 'ambiguous'), not __known)").select(*columns)


def selected(frames: DataFrame, reports: DataFrame, identities: DataFrame) -> DataFrame:
    """frames with the detection of the chosen identity (source_id, segment, class_id, track_id), null where it isn't actually observed."""
    seen = reports.where("state = 'observed'").join(identities, ["source_id", "segment", "class_id", "track_id"], "left_semi")
    return frames.join(seen.select("source_id", "ordinal", "track_id", "det_index"), ["source_id", "ordinal"], "left")

"""Results that appear as a whole or not at all: bundles of chosen candidates with receipts, and what a review shows of them."""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from .planning import MAX_FRAMES
from .receipts import canonical, owned_output, write_once


def checked_selection(selection) -> tuple[int, ...]:
    """A choice of candidates: 1 to MAX_FRAMES different whole numbers from 0, in the caller's order."""
    if type(selection) not in (list, tuple) or not 1 <= len(selection) <= MAX_FRAMES:
        raise ValueError("choose 1 to 120 candidates")
    if any(type(k) is not int or k < 0 for k in selection) or len(set(selection)) != len(selection):
        raise ValueError("candidates are different whole numbers from 0")
    return tuple(selection)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, if it has no more than ``most`` rows; only one more is looked at."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def chosen(candidates: DataFrame, selection, column: str = "candidate") -> DataFrame:
    """The chosen candidates with their position in the selection."""
    spots = F.array(*[F.lit(k).cast("long") for k in checked_selection(selection)])
    place = F.array_position(spots, F.col(column).cast("long")) - 1
    return candidates.where(place >= 0).withColumn("position", place.cast("int"))


def export_bundle(rows: DataFrame, target: str, documents: dict[str, bytes] | None = None) -> dict[str, str]:
    """Write rows(position, text) of canonical JSON as candidates/NNNNNN.json beside the documents, and a manifest of SHA-256 receipts last.

    No more than MAX_FRAMES rows pass the driver. The folder appears under its name only if all of it is there.
    """
    receipts: dict[str, str] = {}
    with owned_output(target) as stage:
        (stage / "candidates").mkdir()
        files = dict(documents or {})
        for r in sorted(bounded(rows.select("position", "text"), MAX_FRAMES).collect(), key=lambda r: r.position):
            files[f"candidates/{r.position:06d}.json"] = r.text.encode()
        for name, data in files.items():
            write_once(stage / name, data)
            receipts[name] = hashlib.sha256(data).hexdigest()
        write_once(stage / "manifest.json", canonical({"files": receipts, "status": "complete"}).encode())
    return receipts


def folder_problems(folder: str) -> list[tuple[str, str]]:
    """(file, problem) of a bundle whose files aren't those of its manifest: missing, unlisted or changed."""
    root = Path(folder)
    try:
        listed = json.loads((root / "manifest.json").read_text("utf-8"))["files"]
    except (OSError, ValueError, KeyError):
        return [("manifest.json", "missing or malformed")]
    there = {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()} - {"manifest.json"}
    found = [(name, "missing") for name in sorted(set(listed) - there)] + [(name, "unlisted") for name in sorted(there - set(listed))]
    return found + [(name, "changed") for name in sorted(there & set(listed)) if hashlib.sha256((root / name).read_bytes()).hexdigest() != listed[name]]


def clip_mapping(frames: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Frames (source_id, ordinal, pts, ticks, duration) of windows (on, start, end) with the place of each in a clip that begins at 0."""
    met = frames.join(windows, "source_id").where((F.col("ticks") >= F.col("start")) & (F.col("ticks") < F.col("end")))
    first = met.groupBy(*on).agg(F.min("pts").alias("first_pts"), F.min("ordinal").alias("first_ordinal"))
    return met.join(first, on).select(*on, "ordinal", "pts", (F.col("ordinal") - F.col("first_ordinal")).alias("index"), (F.col("pts") - F.col("first_pts")).alias("clip_pts"), "duration")


def timing_error(pairs: DataFrame, on: list[str], tolerance: int) -> DataFrame:
    """Largest difference of actual from expected times, and whether it is within the tolerance."""
    worst = F.max(F.abs(F.col("expected") - F.col("actual")))
    return pairs.groupBy(*on).agg(worst.alias("worst"), (worst <= tolerance).alias("within"))


def pixel_edges(low: Column, high: Column) -> tuple[Column, Column]:
    """First and last pixel that a range of continuous coordinates touches."""
    return F.floor(low), F.ceil(high) - 1


#: Styles of what a review shows: (pixels on, pixels off, insets of further outlines).
STYLES = {"observed": (1, 0, ()), "prediction_only": (4, 4, ()), "ambiguous": (1, 0, (2,)), "unassociated": (2, 2, ())}


def outline(width: int, height: int, box: tuple[float, float, float, float], style: str) -> np.ndarray:
    """The pixels of a box's outline in a raster, as a mask."""
    on, off, insets = STYLES[style]
    mask = np.zeros((height, width), dtype=bool)
    rows, columns = np.indices((height, width))
    dash = (rows + columns) % (on + off) < on
    for inset in (0, *insets):
        x1, y1 = int(np.floor(box[0])) + inset, int(np.floor(box[1])) + inset
        x2, y2 = int(np.ceil(box[2])) - 1 - inset, int(np.ceil(box[3])) - 1 - inset
        if x1 > x2 or y1 > y2:
            continue
        within = (columns >= x1) & (columns <= x2) & (rows >= y1) & (rows <= y2)
        edge = (columns == x1) | (columns == x2) | (rows == y1) | (rows == y2)
        mask |= within & edge & dash
    return mask


def overlay(bgr: bytes, width: int, height: int, boxes: list[tuple[tuple[float, float, float, float], str, tuple[int, int, int]]]) -> bytes:
    """A raster with outlines of (box, style, colour) drawn over it; outside of it nothing is drawn."""
    picture = np.frombuffer(bgr, dtype=np.uint8).reshape(height, width, 3).copy()
    for box, style, colour in boxes:
        picture[outline(width, height, box, style)] = colour
    return picture.tobytes()


@contextmanager
def reuse(*frames: DataFrame, receipts=None):
    """Keep tables for the length of a job and free them after it; if ``receipts()`` differs at its end the job fails, as what it read has changed."""
    before = receipts() if receipts else None
    kept = [f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames]
    try:
        yield kept
        if receipts and receipts() != before:
            raise RuntimeError("an input changed while it was used")
    finally:
        for f in kept:
            f.unpersist()

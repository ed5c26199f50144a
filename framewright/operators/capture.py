"""From decoded frames to recorded rows: a detector and gates that the caller brings, and the tracker between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import tracking

FRAME = "source_id long, ordinal long, pts long, width int, height int"
DETECTIONS = f"{FRAME}, det_index int, class_id int, x1 double, y1 double, x2 double, y2 double, score double, model_id string"
MOST = 64


class Detector(Protocol):
    """What finds objects in one frame. ``detect`` returns dicts with source_id, ordinal, index, class_id, box, score and model_id."""

    model_id: str

    def detect(self, frame: dict, bgr: bytes) -> list[dict]: ...


def checked(frame: dict, found: list[dict], model_id: str) -> list[dict]:
    """The detections, if all are of this frame and model, within its raster, with a score from 0 to 1 and an index of their own."""
    if len(found) > MOST or len({d["index"] for d in found}) != len(found):
        raise ValueError("too many detections, or one index twice")
    for d in found:
        x1, y1, x2, y2 = d["box"]
        if (d["source_id"], d["ordinal"], d["model_id"]) != (frame["source_id"], frame["ordinal"], model_id):
            raise ValueError("a detection of another frame or model")
        if not (0 <= x1 < x2 <= frame["width"] and 0 <= y1 < y2 <= frame["height"] and 0 <= d["score"] <= 1):
            raise ValueError("a box outside of the frame, or a score that is none")
    return found


def detections(frames: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """One detector call for each of the frames (FRAME, bgr). ``make`` is called once in a task; a frame without detections has one row without an index."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector, names = make(), [f.split()[0] for f in DETECTIONS.split(", ")]
        for part in parts:
            rows = []
            for frame in part.to_dict("records"):
                raw, own = bytes(frame.pop("bgr")), [frame[c] for c in names[:5]]
                if len(raw) != frame["width"] * frame["height"] * 3:
                    raise ValueError("frame has the wrong size")
                found = checked(frame, detector.detect(frame, raw), detector.model_id)
                rows += [[*own, d["index"], d["class_id"], *d["box"], d["score"], d["model_id"]] for d in found] or [[*own, *[None] * 8]]
            yield pd.DataFrame(rows, columns=names).astype({"det_index": "Int32", "class_id": "Int32"})

    return frames.select(*[f.split()[0] for f in FRAME.split(", ")], "bgr").mapInPandas(run, DETECTIONS)


def capture(frames: DataFrame, make: Callable[[], Detector], policy: tracking.Policy, identities: DataFrame, gates: Callable[[pd.DataFrame], pd.DataFrame], gate_schema: str) -> DataFrame:
    """Recorded rows of the chosen identities (source_id, segment, class_id, track_id): every frame, with the actually observed detection or none, and what the gates say of it.

    ``gates`` gets rows in parts and returns as many, with the columns of ``gate_schema`` after theirs.
    """
    found = detections(frames, make)
    chosen = tracking.selected(frames.drop("bgr"), tracking.track(found, policy), identities)
    boxes = found.select("source_id", "ordinal", "det_index", "class_id", "x1", "y1", "x2", "y2", "score", "model_id")
    rows = chosen.join(boxes, ["source_id", "ordinal", "det_index"], "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), gate_schema])
    return rows.mapInPandas(lambda parts: map(gates, parts), schema).withColumn("observed", F.col("det_index").isNotNull())

"""One-to-one association of tracks and detections: only what is unique counts, nothing is guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .geometry import BOX, iou_at_least


def edges(tracks: DataFrame, detections: DataFrame, on: list[str], numerator: int, denominator: int) -> DataFrame:
    """Track and detection pairs of equal ``on`` whose boxes overlap enough."""
    t = tracks.select(*on, "track_id", *[F.col(c).alias(f"t_{c}") for c in BOX])
    d = detections.select(*on, "det_index", *[F.col(c).alias(f"d_{c}") for c in BOX])
    return t.join(d, on).where(iou_at_least("t_", "d_", numerator, denominator))


def with_degrees(pairs: DataFrame, on: list[str]) -> DataFrame:
    return pairs.withColumn("track_degree", F.count(F.lit(1)).over(Window.partitionBy(*on, "track_id"))).withColumn("det_degree", F.count(F.lit(1)).over(Window.partitionBy(*on, "det_index")))


def unique(pairs: DataFrame, on: list[str], conflicts: DataFrame | None = None) -> DataFrame:
    """Pairs whose track and detection have no other edge; detections in a conflict are out."""
    single = with_degrees(pairs, on).where("track_degree = 1 and det_degree = 1").drop("track_degree", "det_degree")
    return single if conflicts is None else single.join(conflicts.select(*on, "det_index").distinct(), [*on, "det_index"], "left_anti")


def ambiguous(pairs: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of components with more than one edge."""
    return with_degrees(pairs, on).where("track_degree > 1 or det_degree > 1")

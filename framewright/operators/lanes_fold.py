"""The lane fold one row at a time, for streams and for the state of every row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .boundaries import reasons
from .keyed import folded


@dataclass
class LaneFold:
    """What one source's lane fold remembers; pairs are (first, last) ordinals of a bracket."""

    dwell: int
    base: int | None = None
    stable: int | None = None
    pending: tuple[int, int, int] | None = None  # lane, ordinal, pts
    departure: tuple[int, int] | None = None
    crossing: tuple[int, int] | None = None
    last_lane: int | None = None
    last: int | None = None  # ordinal

    def forget(self) -> None:
        self.__init__(self.dwell)

    def step(self, ordinal: int, pts: int, lane: int | None, interior: bool, breaks: bool) -> tuple[str, dict | None]:
        """Status of a row (unknown, warming, moving, stable, candidate), and the change that it completes."""
        if lane is None:
            self.forget()
            return "unknown", None
        if breaks:
            self.forget()
        before, self.last = self.last, ordinal
        if self.base is not None and abs(lane - self.base) > 1:
            self.forget()
            return "unknown", None
        settled = self.base is not None
        away = settled and lane != self.base
        if settled and (away or not interior) and self.departure is None:
            self.departure = (self.stable, ordinal)
        if not away:
            self.crossing = None
        elif self.crossing is None and self.last_lane == self.base:
            self.crossing = (before, ordinal)
        self.last_lane = lane
        on_the_way = "moving" if settled else "warming"
        if not interior:
            self.pending = None
            return on_the_way, None
        if settled and not away:
            self.stable, self.departure, self.crossing, self.pending = ordinal, None, None, None
            return "stable", None
        if self.pending is None or self.pending[0] != lane:
            self.pending = (lane, ordinal, pts)
        if pts - self.pending[2] < self.dwell:
            return on_the_way, None
        change = None
        if self.departure is not None and self.crossing is not None:
            change = {
                "direction": "right" if lane > self.base else "left", "from_lane": self.base, "to_lane": lane, "start_from": self.departure[0], "start_to": self.departure[1],
                "cross_from": self.crossing[0], "cross_to": self.crossing[1], "done_from": self.pending[1], "done_to": ordinal,
            }
        self.base, self.stable = lane, ordinal
        self.pending = self.departure = self.crossing = None
        return ("candidate" if change else "stable"), change

    def state(self) -> dict:
        return asdict(self)


STATES = "source_id long, ordinal long, status string, reason string, direction string"


def lane_states(rows: DataFrame, max_gap: int, dwell: int) -> DataFrame:
    """rows(source_id, ordinal, pts, lane, interior, why): the fold's status of every row.

    ``why`` says why a row has no lane; a jump over a lane is non_adjacent_or_incomplete.
    Runs between rows without a lane don't depend on each other, so each is folded by
    itself. A row after one that is unknown starts anew.
    """
    cuts = F.when(F.col("lane").isNull(), 1).otherwise(0)
    runs = reasons(rows, max_gap).withColumn("__run", F.sum(cuts).over(Window.partitionBy("source_id").orderBy("ordinal")))
    empty = runs.where("lane is null").select("source_id", "ordinal", F.lit("unknown").alias("status"), F.col("why").alias("reason"), F.lit(None).cast("string").alias("direction"))

    def fold(part: Iterator[tuple]) -> Iterator[tuple]:
        state = LaneFold(dwell)
        for source, _, ordinal, pts, lane, interior, told in part:
            reason = "start" if state.last is None else told
            status, change = state.step(ordinal, pts, lane, interior, reason is not None)
            yield source, ordinal, status, "non_adjacent_or_incomplete" if status == "unknown" else reason, change["direction"] if change else None

    lanes = runs.where("lane is not null").select("source_id", "__run", "ordinal", "pts", "lane", F.coalesce("interior", F.lit(False)).alias("interior"), "reason")
    return folded(lanes, ["source_id", "__run"], ["ordinal"], fold, STATES).unionByName(empty)

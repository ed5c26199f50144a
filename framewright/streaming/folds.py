"""Lanes, lamps and tracks on Structured Streaming: the batch folds, with their state kept per source.

Rows of a source are taken in order within a micro-batch. A row that doesn't come
after the last one seen, in this batch or an earlier one, is an error of that
source: it is reported with its problem, and the state begins anew after it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lamps import LampConfig
from ..operators.lanes_fold import LaneFold
from ..operators.tracking import COLUMNS, REPORT, Policy, Tracker, as_report, fed, frames_of, plain_rows

BACKWARDS = "time or order is not strictly increasing"


def keyed_fold(rows: DataFrame, schema: str, begin: dict, step: Callable[[dict, object], list[tuple]], failed: Callable[[int, int], tuple]) -> DataFrame:
    """A fold per source_id over rows with ordinal and pts: step(state, row) changes the state and gives output rows.

    The state is a dict that JSON can hold. It remembers the last ordinal and pts; a
    row that isn't after them goes to ``failed`` and the state begins anew.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else dict(begin)
        out = []
        for row in pd.concat(list(parts)).sort_values("ordinal").itertuples():
            last = state.get("seen")
            if last is not None and (row.ordinal <= last[0] or row.pts <= last[1]):
                state = dict(begin)
                out.append(failed(int(key[0]), int(row.ordinal)))
                continue
            out += step(state, row)
            state["seen"] = (int(row.ordinal), int(row.pts))
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("source_id").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def track_stream(detections: DataFrame, policy: Policy) -> DataFrame:
    """Reports of a stream of detections; rows as for the batch tracker."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(policy)
        if state.exists:
            kept = json.loads(state.get[0])
            tracker = Tracker(policy, tuple(kept["last"]) if kept["last"] else None, kept["segment"], kept["next_id"], {int(k): t for k, t in kept["tracks"].items()}, kept["reason"])
        source, out = int(key[0]), []
        rows = plain_rows(pd.concat(list(parts)))
        for ordinal, rows_of in groupby(rows, itemgetter(0)):
            try:
                out += list(fed(tracker, source, frames_of(rows_of)))
            except ValueError as problem:  # only the frame that fails is lost
                failed = {"source_id": source, "ordinal": ordinal, "segment": tracker.segment, "state": "failed", "reset_reason": str(problem), "class_id": 0}
                out.append(tuple(map(failed.get, COLUMNS)))
        state.update((json.dumps(tracker.state()),))
        yield as_report(out)

    return detections.groupBy("source_id").applyInPandasWithState(step, REPORT, "state string", "append", GroupStateTimeout.NoTimeout)


LAMP = "source_id long, ordinal long, ticks long, phase string, changes boolean, problem string"


def lamp_phase_stream(samples: DataFrame, config: LampConfig, max_gap: int) -> DataFrame:
    """samples(source_id, ordinal, pts, ticks, observed, identity, uncertain, status, brightness): phases as the batch operator gives them within histories."""

    def step(state: dict, r) -> list[tuple]:
        last, identity = state.get("seen"), None if pd.isna(r.identity) else int(r.identity)
        goes_on = last is not None and r.ordinal == last[0] + 1 and r.pts - last[1] <= max_gap and state["identity"] == identity and not r.uncertain
        if not r.observed or not goes_on:
            state["phase"] = None
        state["identity"] = identity if r.observed else None
        if not r.observed:
            return []
        if r.status != "usable":
            state["phase"] = None
            return []
        before = state["phase"]
        state["phase"] = "on" if r.brightness >= config.on else "off" if r.brightness <= config.off else before
        return [(int(r.source_id), int(r.ordinal), int(r.ticks), state["phase"], before is not None and before != state["phase"], None)]

    return keyed_fold(samples, LAMP, {"phase": None, "identity": None}, step, lambda source, ordinal: (source, ordinal, None, None, None, BACKWARDS))


LANE = "source_id long, direction string, from_lane int, to_lane int, start_from long, start_to long, cross_from long, cross_to long, done_from long, done_to long, problem string"


def lane_stream(rows: DataFrame, max_gap: int, dwell: int) -> DataFrame:
    """rows(source_id, ordinal, pts, lane, interior): completed lane changes as the batch operator gives them."""

    def step(state: dict, r) -> list[tuple]:
        last, kept = state.get("seen"), state["lane"]
        fold = LaneFold(dwell, **{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items() if k != "dwell"}) if kept else LaneFold(dwell)
        breaks = last is None or r.ordinal != last[0] + 1 or r.pts - last[1] > max_gap
        _, change = fold.step(int(r.ordinal), int(r.pts), None if pd.isna(r.lane) else int(r.lane), bool(r.interior), breaks)
        state["lane"] = fold.state()
        return [(int(r.source_id), *change.values(), None)] if change else []

    return keyed_fold(rows, LANE, {"lane": None}, step, lambda source, ordinal: (source, *[None] * 8, ordinal, BACKWARDS))

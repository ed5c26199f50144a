"""Folds, matching, tracking, receipts, containers and streams against loops, brute force and literal cases."""

import itertools
import random
import struct
import time
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.clock import Clock, exact
from framewright import tools
from framewright.functions import sql
from framewright.operators import audit, boundaries, capture, codecs, evaluation, geometry, lamps, lanes, lanes_fold, planning, ranges, receipts, replay, sinks, timeline, tracking
from framewright.sources import inputs, media
from framewright.streaming import folds


def test_ticks_are_exact():
    draw = random.Random(1)
    for _ in range(2000):
        clock = Clock(Fraction(draw.randint(1, 50), draw.randint(1, 90000)))
        seconds, dt = Fraction(draw.randint(1, 900), draw.randint(1, 70)), draw.randint(0, 100000)
        assert (dt * clock.base > seconds) == (dt > clock.more_than(seconds))
        assert (dt * clock.base >= seconds) == (dt >= clock.at_least(seconds))
    assert exact("3/10") == Fraction(3, 10)
    with pytest.raises(ValueError):
        exact("6/20")


def test_matching_is_best():
    draw = random.Random(7)
    for _ in range(150):
        n, m = draw.randint(0, 4), draw.randint(0, 4)
        costs = np.array([[draw.choice([-1, *range(6)]) for _ in range(m)] for _ in range(n)], dtype=object).reshape(n, m)
        best = (0, 0)
        for k in range(min(n, m) + 1):
            for a in itertools.combinations(range(n), k):
                for b in itertools.permutations(range(m), k):
                    if all(costs[i, j] >= 0 for i, j in zip(a, b)):
                        best = min(best, (-k, sum(costs[i, j] for i, j in zip(a, b))))
        got = evaluation.assign(costs)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert (-len(got), sum(costs[i, j] for i, j in got)) == best


def lane_loop(rows, gap, dwell):
    out, s = [], {}
    for o, t, lane, inner in rows:
        if lane is None:
            s = {}
            continue
        if "prev" not in s or t - s["prev"][1] > gap:
            s = {}
        before, s["prev"] = s.get("prev"), (o, t)
        base = s.get("base")
        if base is not None and abs(lane - base) > 1:
            s = {}
            continue
        if base is not None and (lane != base or not inner):
            s.setdefault("dep", (s["stable"], o))
        if lane == base:
            s.pop("cross", None)
        elif base is not None and "cross" not in s and s.get("last") == base:
            s["cross"] = (before[0], o)
        s["last"] = lane
        if not inner:
            s.pop("pend", None)
            continue
        if lane == base:
            s["stable"] = o
            for k in ("dep", "cross", "pend"):
                s.pop(k, None)
            continue
        if s.get("pend", (None,))[0] != lane:
            s["pend"] = (lane, o, t)
        if t - s["pend"][2] < dwell:
            continue
        if base is not None and "dep" in s and "cross" in s:
            out.append(("right" if lane > base else "left", base, lane, *s["dep"], *s["cross"], s["pend"][1], o))
        s.update(base=lane, stable=o)
        for k in ("dep", "cross", "pend"):
            s.pop(k, None)
    return out


def test_lane_fold_is_the_loop(spark):
    draw, data, want = random.Random(3), [], []
    for source in range(150):
        t, lane, rows = 0, 1, []
        for o in range(60):
            t += draw.choice([1, 1, 2, 9])
            lane = max(0, min(3, lane + draw.choice([0, 0, 0, 1, -1, draw.choice([0, 2])])))
            rows.append((o, t, None if draw.random() < 0.04 else lane, draw.random() < 0.7))
        data += [(source, *r) for r in rows]
        want += [(source, *c) for c in lane_loop(rows, 5, 2)]
    frame = spark.createDataFrame(data, "source_id long, ordinal long, pts long, lane int, interior boolean")
    assert sorted(map(tuple, lanes.lane_changes(frame, 5, 2).collect())) == sorted(want) and len(want) > 20


def test_lane_steps_are_the_loop():
    draw = random.Random(23)
    for _ in range(200):
        fold, out, t, lane, rows = lanes_fold.LaneFold(2), [], 0, 1, []
        for o in range(50):
            t += draw.choice([1, 1, 2, 8])
            lane = max(0, min(3, lane + draw.choice([0, 0, 0, 1, -1, 2, -2])))
            rows.append((o, t, None if draw.random() < 0.05 else lane, draw.random() < 0.7))
        last = None
        for o, t, lane, inner in rows:
            _, change = fold.step(o, t, lane, inner, last is None or t - last > 5)
            last = t
            if change:
                out.append(tuple(change.values()))
        assert out == lane_loop(rows, 5, 2)


def test_anchors_and_views(spark):
    row = spark.range(1).select(lanes.anchor_place(F.lit("row"), F.lit(0), F.lit(72), F.lit(200), F.lit(100)).alias("a"), lanes.anchor_place(F.lit("column"), F.lit(80), F.lit(81), F.lit(200), F.lit(100)).alias("b")).first()
    assert (row.a, row.b) == (pytest.approx(42.0), pytest.approx(200.0))
    with pytest.raises(Exception, match="outside of the view"):
        spark.range(1).select(geometry.within_view(F.lit(5.0), F.lit(11.0), F.lit(10.0), F.lit(10.0))).collect()


def lamp_loop(rows, gap, windows, config):
    """(history number, why it began) of every row, and the report of each window, by a plain loop."""
    marks, held, last, number, begun = [], [], None, 0, None
    for r in rows:
        new = None
        if not r["observed"]:
            new = "no_actual_observation"
        elif r["status"] == "identity_uncertain":
            new = "identity_uncertain"
        elif last is None or not last["observed"]:
            new = "start"
        elif r["ordinal"] != last["ordinal"] + 1:
            new = "missing_frame"
        elif r["pts"] - last["pts"] > gap:
            new = "time_gap"
        elif r["identity"] != last["identity"]:
            new = "identity_or_model_change"
        if new:
            number, begun, held = number + 1, new, []
        if r["observed"]:
            held.append(r)
        marks.append((r["ordinal"], number, begun))
        last = r
    reports = []
    for start, end in windows:
        first = max([k for k, s in enumerate(held) if s["ticks"] <= start], default=None)
        final = min([k for k, s in enumerate(held) if s["ticks"] >= end], default=None)
        why = set() if first is not None and final is not None and end - start >= config.min_window else {"insufficient_history"}
        phase, turns, cycles, moved, valid = None, [], 0, 0, 0
        for s in held[-120:][first or 0 : None if final is None else final + 1]:
            if s["status"] != "usable":
                why.add(s["status"])
                phase, turns = None, []
                continue
            valid += 1
            now = "on" if s["brightness"] >= config.on else "off" if s["brightness"] <= config.off else phase
            if now is None:
                why.add("model_uncertain")
            elif phase is not None and now != phase:
                turns.append((now, s["ticks"]))
                moved += start <= s["ticks"] <= end
                if [x for x, _ in turns[-3:]] == ["on", "off", "on"] and turns[-3][1] >= start and turns[-1][1] <= end:
                    lit, dark = turns[-2][1] - turns[-3][1], turns[-1][1] - turns[-2][1]
                    if all(config.min_phase <= d <= config.max_phase for d in (lit, dark)):
                        cycles += 1
                    else:
                        why.add("model_uncertain")
            phase = now
        blink = cycles >= config.min_cycles
        if moved and not blink:
            why.add("insufficient_cycles")
        reports.append(("unknown" if why else "blink_observed" if blink else "no_blink_observed", blink, cycles, ",".join(sorted(why)), valid))
    return marks, reports


def test_lamps_are_the_loop(spark):
    draw = random.Random(31)
    config = lamps.LampConfig(60, 150, 1, 14, 1, 6)
    data, spans, want_marks, want = [], [], [], []
    for source in range(120):
        rows, o, t, bright = [], 0, 0, 20
        for _ in range(draw.choice([3, 40, 150])):
            o += draw.choice([1] * 60 + [2])
            t += draw.choice([1, 1, 2, 3] * 15 + [30])
            if draw.random() < 0.4:
                bright = draw.choice([20, 200, 200, 20, 100])
            status = draw.choice(["usable"] * 40 + ["occluded", "too_small", "identity_uncertain"])
            rows.append({"ordinal": o, "pts": 500 + t, "ticks": t, "observed": draw.random() > 0.005, "identity": o // 70, "status": status, "brightness": bright})
        windows = [(t - 30, t - 8), (max(0, t - 12), t), (t - 3, t + 5)]
        marks, reports = lamp_loop(rows, 10, windows, config)
        data += [(source, *r.values(), r["status"] == "identity_uncertain") for r in rows]
        spans += [(source, k, a, b) for k, (a, b) in enumerate(windows)]
        want_marks += [(source, *m) for m in marks]
        want += [(source, k, *r) for k, r in enumerate(reports)]
    frame = spark.createDataFrame(data, "source_id long, ordinal long, pts long, ticks long, observed boolean, identity long, status string, brightness long, uncertain boolean")
    marked = lamps.histories(frame, 10)
    assert sorted(map(tuple, marked.select("source_id", "ordinal", "history", "begun").collect())) == sorted(want_marks)
    found = lamps.window_report(lamps.latest(marked).select("source_id", "ordinal", "ticks", "status", "brightness"), spark.createDataFrame(spans, "source_id long, window_id long, start long, end long"), config)
    got = sorted(map(tuple, found.select("source_id", "window_id", "state", "blink_evidence", "n_cycles", "reasons", "valid_samples").collect()))
    assert got == sorted(want)
    assert {r[2] for r in want} == {"unknown", "blink_observed", "no_blink_observed"} and sum(r[2] != "unknown" for r in want) > 10


def test_a_gap_within_a_window_is_unknown(spark):
    values = [20, 200, 200, 20, 200, 20]
    rows = [(1, n if n < 3 else n + 5, 10 * n, 10 * n, True, 1, "usable", v, False) for n, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "source_id long, ordinal long, pts long, ticks long, observed boolean, identity long, status string, brightness long, uncertain boolean")
    windows = spark.createDataFrame([(1, 0, 0, 50), (2, 0, 0, 50)], "source_id long, window_id long, start long, end long")
    found = {r.source_id: r for r in lamps.window_report(lamps.latest(lamps.histories(frame, 100)).select("source_id", "ordinal", "ticks", "status", "brightness"), windows, lamps.LampConfig(60, 150)).collect()}
    assert (found[1].state, found[1].n_cycles) == ("unknown", 0) and (found[2].state, found[2].reasons, found[2].n_samples) == ("unknown", "insufficient_history", 0)


def test_every_candidate_keeps_a_context(spark):
    draw = random.Random(41)
    samples = [(s, k * 10 + draw.randint(0, 5), 4) for s in range(3) for k in range(30)]
    asked = [(s, n, t, t + draw.randint(0, 20)) for s in range(5) for n, t in enumerate(draw.sample(range(400), 12))]
    lengths = [(s, 330) for s in range(5)]
    frames = [spark.createDataFrame(d, c) for d, c in ((asked, "source_id long, candidate long, start long, end long"), (samples, "source_id long, ticks long, length long"), (lengths, "source_id long, stream_length long"))]
    want = []
    for s, n, a, b in asked:
        lo, hi = max(a - 15, 0), min(b + 15, 330)
        own = sorted((t, t + d) for q, t, d in samples if q == s)
        before, after = [t for t, _ in own if t <= lo], [e for t, e in own if t >= hi] or [e for _, e in own][-1:]
        want.append((s, n, lo, hi, min([lo, *before[-1:]]), max([hi, *after[:1]])))
    assert sorted(map(tuple, planning.context(*frames, 15, 15).collect())) == sorted(want)


def test_ranges_meet_once(spark):
    draw = random.Random(43)
    points = [(draw.randint(0, 2), draw.randint(-50, 200)) for _ in range(300)]
    spans = [(draw.randint(0, 2), n, a := draw.randint(-60, 200), a + draw.randint(-3, 70)) for n in range(60)]
    p, r = spark.createDataFrame(points, "k int, at long").withColumn("id", F.monotonically_increasing_id()), spark.createDataFrame(spans, "k int, n int, a long, b long")
    for width in (1, 7, 1000):
        got = ranges.meet(p, r, ["k"], "at", "a", "b", width)
        assert got.count() == got.select("id", "n").distinct().count() == sum(k == q and a <= t < b for k, t in points for q, _, a, b in spans)


def test_box_pairs_count_once(spark):
    draw = random.Random(47)
    boxes = [(0, n, x := draw.randint(-90, 300), y := draw.randint(-90, 300), x + draw.randint(1, 150), y + draw.randint(1, 150)) for n in range(80)]
    frame = spark.createDataFrame(boxes, "k int, idx int, x1 int, y1 int, x2 int, y2 int")
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and 10 * tracking.iou(a[2:], b[2:]) >= 2}
    for cell in (16, 64, 1000):
        got = [(r.a_idx, r.b_idx) for r in geometry.pairs_of_class(frame, ["k"], 2, 10, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_order_that_runs_back_is_an_error(spark):
    frame = spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "source_id long, ordinal long, pts long")
    with pytest.raises(Exception, match="strictly increasing"):
        boundaries.reasons(frame, 10).collect()


def test_a_clock_that_changes_is_an_error(spark):
    frame = spark.createDataFrame([(1, 0, 5, "a", 1), (1, 1, 6, "a", 2)], "source_id long, ordinal long, pts long, k string, c int")
    with pytest.raises(Exception, match="clock of a source"):
        boundaries.reasons(frame, 10, F.col("k"), clock=F.col("c")).collect()
    moved = frame.withColumn("k", F.col("c"))  # another key may have another clock
    assert [r.reason for r in boundaries.reasons(moved, 10, F.col("k"), clock=F.col("c")).orderBy("ordinal").collect()] == ["start", "source_or_geometry_change"]


def test_detectors_are_held_to_their_frame():
    frame = {"source_id": 1, "ordinal": 2, "width": 10, "height": 10}
    good = {"source_id": 1, "ordinal": 2, "index": 0, "class_id": 1, "box": (0, 0, 10, 10), "score": 1.0, "model_id": "m"}
    assert capture.checked(frame, [good], "m") == [good]
    for wrong in ([good, good], [good | {"ordinal": 3}], [good | {"model_id": "n"}], [good | {"box": (0, 0, 11, 10)}], [good | {"score": 1.5}], [good | {"index": k} for k in range(65)]):
        with pytest.raises(ValueError):
            capture.checked(frame, wrong, "m")


def test_windows_are_grouped(spark):
    draw = random.Random(51)
    data, want = [], []
    for source in range(60):
        windows = [(draw.randint(0, draw.choice([60, 400])), draw.randint(1, draw.choice([20, 120])), n) for n in range(draw.randint(1, 25))]
        groups = []
        for first, count, _ in sorted(windows):
            last = groups[-1] if groups else None
            if last and first <= last[0] + last[1] and (union := max(first + count, last[0] + last[1]) - last[0]) <= 120:
                last[1:] = [union, last[2] + 1]
            else:
                groups.append([first, count, 1])
        data += [(source, *w) for w in windows]
        want += [(source, n, *g) for n, g in enumerate(groups)]
    frame = spark.createDataFrame(data, "source_id long, first long, count long, idx int")
    assert sorted(map(tuple, planning.grouped_windows(frame).collect())) == sorted(want)


POLICY = tracking.Policy(max_gap=40, max_unobserved=25, ticks_per_second=100, classes=(3, 4))


def box(x, score=0.95, index=0, kind=3, y=5.0):
    return {"index": index, "class_id": kind, "box": (x, y, x + 40.0, y + 25.0), "score": score}


def test_tracks_go_on_and_end():
    t = tracking.Tracker(POLICY)
    for n in range(6):  # two cars side by side, far enough from each other
        found = t.update(n, 10 * n, [box(2.0 * n), box(200.0 - n, index=1, kind=4)], raster=(180, 60))
        assert [(r["state"], r["track_id"], r["unobserved"]) for r in found] == [("observed", 1, 0), ("observed", 2, 0)]
    assert found[1]["box"] == (None,) * 4 and found[0]["box"][0] > 5  # the second one is out of the raster
    weak = t.update(6, 60, [box(12.0, score=0.3)])
    assert [(r["state"], r["unobserved"]) for r in weak] == [("observed", 0), ("prediction_only", 10)]
    assert t.update(7, 70, [box(500.0, score=0.5)])[0]["track_id"] == 1  # too weak to begin a track
    gone = t.update(8, 80, [])
    assert [r["track_id"] for r in gone] == [1] and gone[0]["unobserved"] == 20  # the second one's 30 are too many


def test_ambiguity_ends_tracks_as_a_group():
    t = tracking.Tracker(POLICY)
    t.update(0, 0, [box(0.0), box(300.0, index=1)])
    found = t.update(1, 10, [box(0.0), box(8.0, index=4), box(300.0, index=2), box(600.0, index=7), box(600.2, index=8)])
    assert [(r["state"], r["track_id"], r["det_index"], r["component"]) for r in found] == [
        ("ended", 1, None, 0), ("ambiguous", None, 0, 0), ("ambiguous", None, 4, 0), ("ambiguous", None, 7, 1), ("ambiguous", None, 8, 1), ("observed", 2, 2, None),
    ]
    assert t.update(2, 20, [box(0.0)])[0]["track_id"] == 2 and t.update(3, 30, [box(0.0)])[-1]["track_id"] == 3  # identities don't come back


def test_tracker_boundaries():
    t = tracking.Tracker(POLICY)
    reasons = [t.update(o, p, [box(0.0)], key, "c")[0]["reset_reason"] for o, p, key in ((0, 0, "a"), (1, 10, "a"), (2, 51, "a"), (4, 60, "a"), (5, 70, "b"), (6, 75, "b"))]
    assert reasons == ["start", None, "time_gap", "missing_decoded_frame", "source_or_geometry_change", None]
    t.reset()
    assert t.update(7, 80, [box(0.0)], "b", "c")[0]["reset_reason"] == "manual_reset"
    for wrong in ((8, 90, [], "b", "other"), (9, 100, [box(0.0, kind=9)], "b", "c"), (10, 5, [], "b", "c"), (11, 110, [box(0.0), box(9.0)], "b", "c")):
        t.last = (7, 80, "b", "c")
        with pytest.raises(ValueError):
            t.update(*wrong)
        assert t.tracks == {} and t.update(20, 200, [box(0.0)], "b", "c")[0]["reset_reason"] == "failed_update"
    with pytest.raises(ValueError):
        t.reset("other")
    with pytest.raises(ValueError):
        tracking.guarded([0.0, 0.0, 1.0, 2.0, 1.0])


def test_segments_are_tracked_apart(spark):
    draw = random.Random(53)
    data = []
    for source in range(6):
        t, o = 0, 0
        for _ in range(60):
            o, t = o + draw.choice([1] * 9 + [2]), t + draw.choice([5, 10, 10, 60])
            data += [(source, o, t, k, 3 + k % 2, x := float(draw.choice([0, 10, 200])), 5.0, x + 40, 30.0, draw.choice([0.5, 0.95])) for k in range(draw.randint(1, 3))]
    frame = spark.createDataFrame(data, "source_id long, ordinal long, pts long, det_index int, class_id int, x1 double, y1 double, x2 double, y2 double, score double")
    got = tracking.track(frame, POLICY).toPandas()
    want = pd.concat([tracking.as_report(tracking.run_frames(tracking.Tracker(POLICY), part)) for _, part in frame.toPandas().groupby("source_id")])
    plain = lambda v: v if isinstance(v, str) else None if pd.isna(v) else int(v)
    key = lambda f: sorted(repr([plain(v) for v in r]) for r in f[["source_id", "ordinal", "segment", "reset_reason", "state", "track_id", "det_index", "component", "unobserved"]].astype(object).itertuples(index=False, name=None))
    assert key(got) == key(want) and got.track_id.max() > 20
    assert audit.report_problems(spark.createDataFrame(got.astype({"track_id": "float", "det_index": "float", "unobserved": "float", "component": "float"})).selectExpr("source_id", "ordinal", "state", "if(isnan(track_id), null, int(track_id)) track_id", "if(isnan(det_index), null, int(det_index)) det_index", "class_id", "if(isnan(unobserved), null, cast(unobserved as long)) unobserved", "if(isnan(component), null, int(component)) component")).count() == 0


def test_filter_agrees_with_matrices():
    state, x, p = [0.0, 0.0, 1.0, 0.0, 10.0], np.zeros(2), np.diag([1.0, 10.0])
    for k in range(1, 40):
        dt, z = 0.1 * (k % 3 + 1), np.sin(k)
        state = tracking.correct(tracking.predict(state, dt, 2.0), z, 0.5)
        a = np.array([[1, dt], [0, 1]])
        x, p = a @ x, a @ p @ a.T + 2.0 * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
        gain = p[:, 0] / (p[0, 0] + 0.5)
        x, p = x + gain * (z - x[0]), p - np.outer(gain, p[0])
        assert np.allclose([*x, p[0, 0], p[0, 1], p[1, 1]], state)


def test_streams_agree_with_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(s, n, n * 3, n * 2, draw.random() < 0.95, n // 25, "usable" if draw.random() < 0.9 else "occluded", draw.randint(0, 255), draw.random() < 0.02) for s in range(5) for n in range(40) if draw.random() < 0.97]
    frame = spark.createDataFrame(rows, "source_id long, ordinal long, pts long, ticks long, observed boolean, identity long, status string, brightness long, uncertain boolean")
    config = lamps.LampConfig()
    boxes = spark.createDataFrame([(s, n, 10 * n, 0, 2, float(n), 0.0, n + 30.0, 30.0, 0.9) for s in range(3) for n in range(12)], "source_id long, ordinal long, pts long, det_index int, class_id int, x1 double, y1 double, x2 double, y2 double, score double")
    policy = tracking.Policy(max_gap=20, max_unobserved=20, ticks_per_second=10)
    lane, path = 1, []
    for s in range(4):
        for n in range(60):
            lane = max(0, min(3, lane + draw.choice([0, 0, 0, 0, 1, -1])))
            path.append((s, n, 2 * n, None if draw.random() < 0.02 else lane, draw.random() < 0.8))
    paths = spark.createDataFrame(path, "source_id long, ordinal long, pts long, lane int, interior boolean")
    phased = lamps.phases(lamps.histories(frame, 7).where("observed"), config, ("source_id", "history"))
    changes = lanes.lane_changes(paths, 5, 2)
    assert changes.count() > 5
    for name, data, start, batch, columns in (
        ("lamp", frame, lambda d: folds.lamp_phase_stream(d, config, 7), phased, ["source_id", "ordinal", "phase", "changes"]),
        ("track", boxes, lambda d: folds.track_stream(d, policy), tracking.track(boxes, policy), ["source_id", "ordinal", "state", "track_id", "segment", "x1"]),
        ("lane", paths, lambda d: folds.lane_stream(d, 5, 2), changes, changes.columns),
    ):
        folder = str(tmp_path / name)
        for half in (data.where("ordinal < 7"), data.where("ordinal >= 7")):  # the second run goes on from the first one's state
            half.write.mode("append").parquet(f"{folder}/in")
            out = start(spark.readStream.schema(data.schema).parquet(f"{folder}/in"))
            out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(out.schema).parquet(f"{folder}/out").select(columns)
        assert got.exceptAll(batch.select(columns)).count() == 0 == batch.select(columns).exceptAll(got).count()


def test_late_rows_are_reported(spark, tmp_path):
    schema = "source_id long, ordinal long, pts long, ticks long, observed boolean, identity long, status string, brightness long, uncertain boolean"
    row = lambda n, light: (1, n, 3 * n, 3 * n, True, 1, "usable", light, False)
    found = []
    for rows in ([row(5, 200), row(6, 10)], [row(4, 200), row(7, 200)]):  # 4 comes after 6 was seen
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        out = folds.lamp_phase_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lamps.LampConfig(), 10)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        found = sorted((r.ordinal, r.phase, r.changes, r.problem is not None) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    assert found == [(4, None, None, True), (5, "on", False, False), (6, "off", True, False), (7, "on", False, False)]  # after the error 7 is a beginning


def atom(kind, body=b""):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_containers(spark, tmp_path):
    url = atom(b"url ", b"\0\0\0\1")
    inside = atom(b"dref", struct.pack(">II", 0, 1) + url)
    brand = atom(b"ftyp", b"isom\0\0\2\0")
    nest = lambda d: atom(b"moov", atom(b"trak", atom(b"mdia", atom(b"minf", atom(b"dinf", d)))))
    whole = brand + nest(inside) + atom(b"mdat", b"123")
    large = struct.pack(">I4sQ", 1, b"mdat", 19) + b"abc"
    assert media.scan_container(whole)[1] is None and media.scan_container(brand + nest(inside) + large)[1] is None
    assert media.scan_container(brand + nest(inside) + struct.pack(">I4s", 0, b"mdat") + b"to the end")[1] is None
    for content in (
        whole[:-1], whole + b"\0\0\0", brand + whole, atom(b"ftyp", b"abcd\0\0\0\0isox") + whole[len(brand) :], brand + nest(b"") + atom(b"mdat"), brand + nest(inside + atom(b"rmra")) + atom(b"mdat"),
        brand + nest(atom(b"dref", struct.pack(">II", 0, 1) + atom(b"url ", b"\0\0\0\0x.mp4\0"))) + atom(b"mdat"), brand + nest(atom(b"dref", struct.pack(">II", 0, 2) + url)) + atom(b"mdat"),
        brand + nest(atom(b"dref", struct.pack(">II", 1, 1) + url)) + atom(b"mdat"), brand + nest(inside), b"",
    ):
        assert media.scan_container(content)[1] is not None
    deep = inside
    for _ in range(9):
        deep = atom(b"moov", deep)
    assert media.scan_container(brand + deep + atom(b"mdat"))[1] == "boxes are nested too deeply"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mp4").write_bytes(whole)
    (tmp_path / "m" / "b.mp4").write_bytes(b"junk")
    found = media.container_boxes(spark, str(tmp_path / "m")).toPandas()
    assert found.problem.notna().sum() == 1 and "dref" in set(found.kind)
    before = media.file_receipts(spark, str(tmp_path / "m")).localCheckpoint()
    assert before.count() == 2 and media.changed_receipts(before, media.file_receipts(spark, str(tmp_path / "m"))).count() == 0
    (tmp_path / "m" / "b.mp4").write_bytes(b"other")
    assert media.changed_receipts(before, media.file_receipts(spark, str(tmp_path / "m"))).count() == 1


def test_malformed_frame_records(spark):
    good = ["[FRAME]", "pts=1", "[SIDE_DATA]", "what ever", "[/SIDE_DATA]", "[/FRAME]"]
    read = lambda lines: media.frame_records(spark.createDataFrame([(1, n, t) for n, t in enumerate(lines)], "source_id long, n long, line string"), ["pts"]).collect()
    assert [r.pts for r in read(good)] == ["1"]
    for bad in (good[:-1], good[1:], ["x=1", *good], [*good[:2], "pts=2", *good[2:]], [*good[:2], "other=2", *good[2:]], ["[FRAME]", "pts=", "[/FRAME]"], [good[0], *good], ["[FRAME]", "[/SIDE_DATA]", "[/FRAME]"]):
        with pytest.raises(Exception, match="malformed|twice"):
            read(bad)


def test_tools(spark, tmp_path):
    tool = tmp_path / "ffprobe"
    tool.write_text("#!/bin/sh\necho '{\"streams\": []}'\n")
    tool.chmod(0o755)
    assert tools.discover(("ffprobe",), str(tmp_path)) == {"ffprobe": str(tool.resolve())}
    with pytest.raises(tools.ToolError):
        tools.discover(("ffmpeg",), str(tmp_path))
    assert "unusable" in tools.doctor(("ffmpeg", "ffprobe"), str(tmp_path))["ffmpeg"]
    paths = spark.createDataFrame([("file:/a.mp4",)], "path string")
    assert tools.probe(paths, str(tool)).first().report == '{"streams": []}\n'
    assert tools.probe(paths, "/nowhere").first().problem
    seen = []
    assert tools.consume(tools.run_lines(["printf", "a\nb\n"]), seen.append) == 2 and seen == ["a\n", "b\n"]
    for command, bounds in ((["false"], {}), (["sleep", "30"], {"seconds": 0.2}), (["yes"], {"most_bytes": 1000}), (["head", "-c", "5000", "/dev/zero"], {"most_line": 100})):
        with pytest.raises(tools.ToolError):
            tools.run_lines(command, **bounds).__next__() and list(tools.run_lines(command, **bounds))
            list(tools.run_lines(command, **bounds))


def test_receipts(spark, tmp_path):
    with receipts.owned_output(str(tmp_path / "out")) as stage:
        receipts.write_once(stage / "a", b"1")
    assert (tmp_path / "out" / "a").read_bytes() == b"1"
    with pytest.raises(FileExistsError), receipts.owned_output(str(tmp_path / "out")):
        pass
    with pytest.raises(RuntimeError), receipts.owned_output(str(tmp_path / "other")):
        raise RuntimeError
    assert not (tmp_path / "other").exists()
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(ValueError):
            receipts.strict_loads(bad)
    frame = spark.createDataFrame([('{"b": 1.5, "a": [1, null]}', 6, 20), (None, 1, 0)], "t string, n long, d long")
    got = frame.select(receipts.canonical_json("t").alias("t"), receipts.ratio_text("n", "d").alias("r")).collect()
    assert [tuple(r) for r in got] == [('{"a":[1,null],"b":1.5}\n', "3/10"), (None, None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"k": 3}')
    assert inputs.read_documents(spark, str(tmp_path / "j"), "k long").first().value.k == 3


def test_audits(spark):
    a = spark.createDataFrame([(1, 2), (1, 2)], "x int, y int")
    assert audit.verify(a, a).count() == 0 and audit.verify(a.limit(1), a).count() == 1
    rows = spark.createDataFrame([(1, 2, 2, 3), (5, 4, 6, 7), (1, 2, 0, 3)], "a int, b int, c int, d int")
    assert [r[0] is None for r in rows.select(audit.bracket_problem(["a", "b", "c", "d"])).collect()] == [True, False, False]


def test_bundles_and_reuse(spark, tmp_path):
    rows = spark.createDataFrame([(k, '{"k":%d}\n' % k) for k in range(5)], "candidate long, text string")
    picked = sinks.chosen(rows, [3, 1])
    receipts_ = sinks.export_bundle(picked, str(tmp_path / "out"), {"inputs.json": b"{}\n"})
    assert (tmp_path / "out" / "candidates" / "000000.json").read_text() == '{"k":3}\n' and len(receipts_) == 3 and sinks.folder_problems(str(tmp_path / "out")) == []
    (tmp_path / "out" / "inputs.json").write_text("{ }")
    (tmp_path / "out" / "more").write_text("")
    (tmp_path / "out" / "candidates" / "000001.json").unlink()
    assert sinks.folder_problems(str(tmp_path / "out")) == [("candidates/000001.json", "missing"), ("more", "unlisted"), ("inputs.json", "changed")]
    for bad in ([], [1, 1], [-1], [True], list(range(121)), "12"):
        with pytest.raises(ValueError):
            sinks.checked_selection(bad)
    with pytest.raises(ValueError):
        sinks.bounded(rows, 4)
    with sinks.reuse(rows) as (kept,):
        assert kept.is_cached and kept.count() == 5
    assert not rows.is_cached
    state = [1]
    with pytest.raises(RuntimeError), sinks.reuse(rows, receipts=lambda: tuple(state)):
        state.append(2)


def test_overlays():
    blank = bytes(20 * 10 * 3)
    drawn = np.frombuffer(sinks.overlay(blank, 20, 10, [((2.5, 1.5, 8.5, 6.0), "observed", (1, 2, 3)), ((-5, -5, 3, 3), "prediction_only", (9, 9, 9))]), dtype=np.uint8).reshape(10, 20, 3)
    want = np.zeros((10, 20), dtype=bool)
    want[1:6, [2, 8]] = want[[1, 5], 2:9] = True
    assert ((drawn == (1, 2, 3)).all(2) | (drawn == (9, 9, 9)).all(2))[want].all() and (drawn[9] == 0).all()
    assert 0 < sinks.outline(20, 10, (0, 0, 20, 10), "prediction_only").sum() < sinks.outline(20, 10, (0, 0, 20, 10), "observed").sum() < sinks.outline(20, 10, (0, 0, 20, 10), "ambiguous").sum()


def test_documents(tmp_path):
    slot = {"slot": 1, "axis": "row", "exists": [True] * 72, "points": [None, [1.5, 2]] * 36}
    text = receipts.canonical(slot)
    assert codecs.document_fault(text, codecs.lane_slot("row")) is None and codecs.document_fault(text, codecs.lane_slot("column")) is not None
    assert codecs.document_fault(text.replace("1.5", "NaN"), codecs.lane_slot("row")) == "not strict JSON"
    assert codecs.document_fault(receipts.canonical(slot | {"slot": True}), codecs.lane_slot("row")) == ".slot: int"
    (tmp_path / "a.json").write_text(text)
    assert codecs.load(tmp_path / "a.json", codecs.lane_slot("row")) == slot
    (tmp_path / "b.json").write_text(text + " ")
    with pytest.raises(ValueError):
        codecs.load(tmp_path / "b.json", codecs.lane_slot("row"))


def test_numbers_that_are_missing(spark):
    frame = spark.createDataFrame([(6, 20, bytearray(b"\1" * 12), 2), (None, 20, None, 2), (6, None, bytearray(12), None)], "n long, d long, p binary, w int")
    got = frame.select(receipts.ratio_text("n", "d").alias("r"), sql.common_divisor("n", "d").alias("g"), receipts.region_sum("p", "w", F.lit(0), F.lit(0), F.lit(2), F.lit(1)).alias("s")).collect()
    assert [(r.r, r.g, tuple(r.s)) for r in got] == [("3/10", 2, (6, 2)), (None, None, (None, None)), (None, None, (None, None))]
    sql.register(spark)
    assert spark.sql("SELECT common_divisor(12L, 18L) AS g, ratio_text(2L, 4L) AS r").first().asDict() == {"g": 6, "r": "1/2"}
    with pytest.raises(Exception, match="have to grow"):
        timeline.with_durations(spark.createDataFrame([(1, 0, 5, 1), (1, 1, 5, 1)], "source_id long, ordinal long, pts long, duration long"), F.lit(9)).collect()


def test_pixels_and_modes(spark):
    bgr = bytes(range(48))
    frame = spark.createDataFrame([(1, 0, 4, 4, bytearray(bgr), 0.5, 0.0, 3.2, 2.9, "usable"), (1, 1, 4, 4, bytearray(bgr), 0.5, 0.0, 1.2, 2.9, "usable"), (1, 2, 4, 4, bytearray(bgr), 0.0, 0.0, 4.0, 4.0, "occluded")], "source_id long, ordinal long, width int, height int, bgr binary, left_x1 double, left_y1 double, left_x2 double, left_y2 double, left_status string")
    got = replay.brightness(replay.pixel_window(frame, 0, 3), "left", 2).orderBy("ordinal").select("status", "total", "samples").collect()
    want = sum(bgr[3:9]) + sum(bgr[15:21])
    assert [tuple(r) for r in got] == [("usable", want, 12), ("too_small", None, None), ("occluded", None, None)]
    with pytest.raises(ValueError):
        replay.pixel_window(frame, 0, 121)
    with pytest.raises(Exception, match="wrong size"):
        replay.pixel_window(frame.withColumn("width", F.lit(5)), 0, 3).collect()
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "source_id long, p string")
    with pytest.raises(Exception, match="mixes"):
        replay.one_mode(rows, "p").collect()
    assert replay.one_mode(rows.where("source_id = 2"), "p").count() == 1


def python_steps(frame):
    """(calls by group, passes through Python) of a plan."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("FlatMapGroups"), plan.count("MapInArrow") + plan.count("MapInPandas") + plan.count("FlatMapGroups")


DETECTED = "source_id long, ordinal long, pts long, det_index int, class_id int, x1 double, y1 double, x2 double, y2 double, score double"


def some_boxes(spark, sources, frames):
    return spark.createDataFrame([(s, n, 10 * n, k, 3, float(9 * k), 5.0, 40.0 + 9 * k, 30.0, 0.9) for s in range(sources) for n in range(frames) for k in range(2)], DETECTED)


def test_tracks_are_folded_once(spark):
    assert python_steps(tracking.track(some_boxes(spark, 2, 4), POLICY)) == (0, 1)
    wrong = spark.createDataFrame([(1, 0, 5, 0, 3, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 0, 6, 1, 3, 0.0, 0.0, 9.0, 9.0, 0.9)], DETECTED)
    with pytest.raises(Exception, match="strictly increasing"):
        tracking.track(wrong, POLICY).collect()


def test_a_long_stream_of_tracks_costs_its_frames(spark, tmp_path):
    """A pandas frame for each frame of a source took some ten times as long."""
    rows = some_boxes(spark, 1, 4000)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = folds.track_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), POLICY)
    began = time.time()
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert time.time() - began < 15
    got, want = spark.read.schema(out.schema).parquet(str(tmp_path / "out")), tracking.track(rows, POLICY)
    assert got.count() == want.count() > 4000 and got.exceptAll(want).count() == 0


def test_annotations_make_reports_once(spark):
    rows = some_boxes(spark, 2, 4)
    shown = tracking.annotations(tracking.track(rows.where("det_index = 0"), POLICY), rows)
    assert python_steps(shown)[1] == 1
    assert sorted((r.det_index, r.state) for r in shown.where("source_id = 1").collect()) == [(0, "observed")] * 4 + [(1, "unassociated")] * 4


def test_box_pairs_of_any_share_and_place(spark):
    """Whole and broken coordinates, indices not in the order of places, columns with the lower index first."""
    draw = random.Random(67)
    boxes = [(n % 2, n, x := draw.choice([draw.uniform(-90, 90), draw.randint(-3, 3) * 16.0]), y := draw.choice([draw.uniform(-90, 90), draw.randint(-3, 3) * 16.0]), x + draw.choice([16.0, draw.uniform(1, 150)]), y + draw.choice([16.0, draw.uniform(1, 150)])) for n in range(120)]
    frame = spark.createDataFrame(boxes, "k int, idx int, x1 double, y1 double, x2 double, y2 double")
    for share in (1, 3, 5, 9):
        want = {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and 10 * tracking.iou(a[2:], b[2:]) >= share}
        for cell in (7, 48):
            found = geometry.pairs_of_class(frame, ["k"], share, 10, cell)
            rows = [(r.a_idx, r.b_idx) for r in found.collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want
            assert all(r.a_x1 == boxes[r.a_idx][2] and r.b_y2 == boxes[r.b_idx][5] for r in found.collect())
    assert geometry.pairs_of_class(frame, ["k"], 3, 10)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 3  # two for left boxes, one for right ones


def test_stretches_of_windows_are_no_calls_of_their_own(spark):
    got = planning.grouped_windows(spark.createDataFrame([(s, 200 * n, 5, n) for s in range(3) for n in range(4)], "source_id long, first long, count long, idx int"))
    assert python_steps(got) == (0, 1) and got.count() == 12


def test_lane_runs_are_no_calls_of_their_own(spark):
    rows = spark.createDataFrame([(1, n, 10 * n, None if n % 3 == 2 else 1, True if n else None, "why") for n in range(9)], "source_id long, ordinal long, pts long, lane int, interior boolean, why string")
    got = lanes_fold.lane_states(rows, 100, 5)
    assert python_steps(got) == (0, 1)
    assert [(r.status, r.reason) for r in got.orderBy("ordinal").collect()] == [("warming", "start"), ("warming", None), ("unknown", "why"), *[("warming", "start"), ("stable", None), ("unknown", "why")] * 2]


def test_groups_of_a_matching_are_no_calls_of_their_own(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0, 0, 1, 1), (1, 2, 2, 50, 50, 51, 1), (1, 2, 3, 50, 50, 53, 3), (1, 3, 3, 54, 54, 53, 1)], "k int, truth_id long, prediction_id long, earliest long, latest long, at long, cost long")
    got = evaluation.best_matching(pairs, ["k"])
    assert python_steps(got) == (0, 1)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 1), (1, 2, 2, 1), (1, 3, 3, 1)]


def test_parts_are_placed_many_at_once(monkeypatch):
    """Fractions only where long doubles can't tell; all as fractions give them."""
    draw, calls, one = random.Random(61), [], sql.placed
    number = lambda: draw.choice([float(draw.randint(-50, 900)), draw.uniform(-50, 900), draw.randint(-50, 900) / 10])
    rows = [(draw.choice([0.0, 90.0, 180.0, 270.0]), float(draw.choice([64, 63, 7])), float(draw.choice([32, 31])), [number() for _ in range(4)], [number() for _ in range(4)]) for _ in range(2000)]
    want = [one(*r) for r in rows]
    monkeypatch.setattr(sql, "placed", lambda *r: calls.append(r) or one(*r))
    assert [tuple(r) for r in sql.placed_rows(*map(np.array, zip(*rows))).tolist()] == want and len(calls) < 600
    empty = sql.placed_rows(np.array([90.0]), np.array([64.0]), np.array([32.0]), np.array([[0.0, 0.0, 9.0, np.nan]]), np.array([[0.0, 0.0, 1.0, 1.0]]))
    assert np.isnan(empty).all()
    with pytest.raises(KeyError):
        sql.placed_rows(*map(np.array, ([45.0], [64.0], [32.0], [[0.0, 0.0, 9.0, 9.0]], [[0.0, 0.0, 1.0, 1.0]])))

"""Recorded inputs in, candidate listings, bundles and assessments out, as files. The work is done by the operators; a run holds MAX_FRAMES rows at most."""

from __future__ import annotations

import hashlib
import json
from fractions import Fraction
from math import lcm
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .clock import exact
from .operators import diagnostics, evaluation, lamps, lanes, lanes_fold, planning, sinks
from .operators.codecs import Many, Maybe, OneOf, document_fault, load
from .operators.planning import MAX_FRAMES
from .operators.receipts import canonical, local_path, owned_output, write_once

STATUS = OneOf(("usable", "occluded", "out_of_view", "too_small", "identity_uncertain", "model_uncertain"))
ROW = {
    "ordinal": "int", "pts": "int", "duration": "int", "lane": Maybe("int"), "interior": "bool", "observed": "bool", "identity": "int",
    "left_status": STATUS, "left_brightness": Maybe("int"), "right_status": STATUS, "right_brightness": Maybe("int"),
}
CONFIG = dict.fromkeys(("max_gap", "dwell", "pre", "post", "off", "on", "min_phase", "max_phase", "min_cycles", "min_window"), "int")
INPUTS = {"schema": OneOf(("recorded-inputs-1",)), "source_id": "int", "config": CONFIG, "rows": Many(ROW, (1, MAX_FRAMES))}
ROWS = (
    "source_id long, ordinal long, pts long, duration long, lane int, interior boolean, observed boolean, identity long, left_status string, left_brightness long,"
    " right_status string, right_brightness long"
)
SIDES = ("left", "right")


def load_inputs(path: str) -> dict:
    value = load(local_path(path), INPUTS)
    before = None
    for row in value["rows"]:
        if row["duration"] <= 0 or (before and (row["ordinal"] <= before["ordinal"] or row["pts"] <= before["pts"])):
            raise ValueError("rows have to go forward")
        before = row
    return value


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def recorded(spark: SparkSession, inputs: dict) -> DataFrame:
    names = [f.split()[0] for f in ROWS.split(", ")[1:]]
    rows = spark.createDataFrame([(inputs["source_id"], *[r[n] for n in names]) for r in inputs["rows"]], ROWS)
    uncertain = F.greatest(*[F.when(F.col(f"{s}_status") == "identity_uncertain", 1).otherwise(0) for s in SIDES]) == 1
    return rows.withColumn("ticks", F.col("pts") - min(r["pts"] for r in inputs["rows"])).withColumn("uncertain", uncertain)


def listing(spark: SparkSession, inputs: dict) -> dict:
    """The catalogue of a run: its candidates with brackets, contexts and signals."""
    c = inputs["config"]
    rows = recorded(spark, inputs)
    changes = lanes.lane_changes(rows.select("source_id", "ordinal", "pts", F.when(F.col("observed"), F.col("lane")).alias("lane"), "interior"), c["max_gap"], c["dwell"])
    at = {r.ordinal: r.ticks for r in rows.select("ordinal", "ticks").collect()}
    place = F.create_map(*[F.lit(v) for kv in at.items() for v in kv])
    number = (F.row_number().over(Window.partitionBy("source_id").orderBy("done_to")) - 1).cast("long")
    candidates = changes.withColumns({"candidate": number, "start": place[F.col("start_from")], "end": place[F.col("done_to")]})
    samples = lamps.latest(lamps.histories(rows, c["max_gap"]))
    lengths = rows.groupBy("source_id").agg(F.max(F.col("ticks") + F.col("duration")).alias("stream_length"))
    found = planning.context(candidates.select("source_id", "candidate", "start", "end"), samples.select("source_id", "ticks", F.col("duration").alias("length")), lengths, c["pre"], c["post"])
    windows = found.select("source_id", F.col("candidate").alias("window_id"), F.col("requested_from").alias("start"), F.col("requested_to").alias("end"))
    config = lamps.LampConfig(c["off"], c["on"], c["min_phase"], c["max_phase"], c["min_cycles"], c["min_window"])
    joined = candidates.join(found, ["source_id", "candidate"])
    for s in SIDES:
        side = samples.select("source_id", "ordinal", "ticks", F.col(f"{s}_status").alias("status"), F.col(f"{s}_brightness").alias("brightness"))
        report = lamps.window_report(side, windows, config)
        joined = joined.join(report.select("source_id", F.col("window_id").alias("candidate"), F.struct("state", "blink_evidence", "reasons", "valid_samples").alias(s)), ["source_id", "candidate"])
    known = lambda s, f: F.col(f"{s}.{f}")
    joined = joined.withColumn("signal", lamps.combined(known("left", "state"), known("right", "state"), known("left", "blink_evidence"), known("right", "blink_evidence")))
    entries = []
    for r in sinks.bounded(joined, MAX_FRAMES).orderBy("candidate").collect():
        entry = {"candidate": r.candidate, "direction": r.direction, "from_lane": r.from_lane, "to_lane": r.to_lane, "signal": r.signal}
        entry |= {"start": [r.start_from, r.start_to], "crossing": [r.cross_from, r.cross_to], "completion": [r.done_from, r.done_to]}
        entry |= {"requested": [r.requested_from, r.requested_to], "context": [r.context_from, r.context_to]}
        for s in SIDES:
            entry[s] = {"state": r[s].state, "blink_evidence": r[s].blink_evidence, "reasons": r[s].reasons.split(",") if r[s].reasons else [], "valid_samples": r[s].valid_samples}
        entries.append(entry)
    return {"schema": "candidate-catalogue-1", "status": "complete", "inputs_sha256": digest(inputs), "source_id": inputs["source_id"], "candidate_count": len(entries), "candidates": entries}


def lane_report(spark: SparkSession, inputs: dict) -> dict:
    rows = recorded(spark, inputs)
    why = F.when(F.col("observed"), "lanes_unknown").otherwise("no_actual_observation")
    states = lanes_fold.lane_states(rows.select("source_id", "ordinal", "pts", F.when(F.col("observed"), F.col("lane")).alias("lane"), "interior", why.alias("why")), inputs["config"]["max_gap"], inputs["config"]["dwell"])
    counted = diagnostics.reason_counts(states, {"lane": "reason"}).collect()
    return {
        "inputs_sha256": digest(inputs), "rows": [[r.ordinal, r.status, r.reason] for r in states.orderBy("ordinal").collect()], "reason_counts": {r.reason: r.n for r in sorted(counted, key=lambda r: r.reason)},
    }


def lamp_report(spark: SparkSession, inputs: dict) -> dict:
    marked = lamps.histories(recorded(spark, inputs), inputs["config"]["max_gap"])
    rows = marked.orderBy("ordinal").collect()
    counts: dict[str, int] = {}
    for r in rows:
        for s in SIDES:
            counts[f"{s}:{r[f'{s}_status']}"] = counts.get(f"{s}:{r[f'{s}_status']}", 0) + 1
    return {"inputs_sha256": digest(inputs), "rows": [[r.ordinal, r.history, r.begun] for r in rows], "status_counts": counts}


REPORTS = {"lane": ("lane-diagnostics.json", lane_report), "lamp": ("lamp-diagnostics.json", lamp_report)}


def export_listing(spark: SparkSession, path: str, output: str, wanted: tuple[str, ...] = ()) -> dict:
    inputs = load_inputs(path)
    catalogue = listing(spark, inputs)
    documents = {"inputs.json": inputs, "catalog.json": catalogue} | {REPORTS[w][0]: REPORTS[w][1](spark, inputs) for w in wanted}
    with owned_output(output) as stage:
        for name, value in documents.items():
            write_once(stage / name, canonical(value).encode())
    return summary(catalogue)


def summary(catalogue: dict) -> dict:
    """What may be shown: no digests and no planned contexts."""
    shown = ("candidate", "direction", "start", "crossing", "completion", "signal", "left", "right")
    return {"status": catalogue["status"], "candidate_count": catalogue["candidate_count"], "candidates": [{k: e[k] for k in shown} for e in catalogue["candidates"]]}


def verify_listing(spark: SparkSession, folder: str, required: tuple[str, ...] = ()) -> dict:
    """Make every file of a listing anew from its inputs and compare bytes."""
    root = local_path(folder)
    inputs = load_inputs(str(root / "inputs.json"))
    names = {"inputs.json", "catalog.json"} | {REPORTS[r][0] for r in REPORTS if (root / REPORTS[r][0]).exists() or r in required}
    if {p.name for p in root.iterdir()} != names:
        raise ValueError("other files than a listing has")
    fresh = {"catalog.json": listing(spark, inputs)} | {name: make(spark, inputs) for name, make in REPORTS.values() if name in names}
    for name, value in fresh.items():
        if (root / name).read_bytes() != canonical(value).encode():
            raise ValueError(f"{name} differs from what its inputs give")
    return {"status": "verified", "files": sorted(names), "candidate_count": fresh["catalog.json"]["candidate_count"]}


def export_replay(spark: SparkSession, path: str, output: str, selection: list[int], catalogue_path: str | None = None) -> dict:
    """The chosen candidates as a bundle, in the caller's order; a given catalogue has to be the one that the inputs give."""
    inputs, chosen = load_inputs(path), sinks.checked_selection(selection)
    catalogue = listing(spark, inputs)
    if catalogue_path is not None and local_path(catalogue_path).read_bytes() != canonical(catalogue).encode():
        raise ValueError("the catalogue has changed")
    if max(chosen) >= catalogue["candidate_count"]:
        raise ValueError("no such candidate")
    texts = spark.createDataFrame([(k, canonical(catalogue["candidates"][n])) for k, n in enumerate(chosen)], "position int, text string")
    batch = {"schema": "candidate-batch-1", "inputs_sha256": digest(inputs), "selection": list(chosen), "candidate_count": catalogue["candidate_count"]}
    sinks.export_bundle(texts, output, {"inputs.json": canonical(inputs).encode(), "batch.json": canonical(batch).encode()})
    return {"status": "complete", "selection": list(chosen), "selected_count": len(chosen)}


def verify_bundle(spark: SparkSession, folder: str) -> dict:
    """The bundle's files against its manifest, then its candidates against a fresh listing of its inputs."""
    root = local_path(folder)
    if found := sinks.folder_problems(str(root)):
        raise ValueError(f"{found[0][0]}: {found[0][1]}")
    inputs, batch = load_inputs(str(root / "inputs.json")), json.loads((root / "batch.json").read_text("utf-8"))
    fresh = listing(spark, inputs)
    if batch["inputs_sha256"] != digest(inputs) or batch["candidate_count"] != fresh["candidate_count"]:
        raise ValueError("batch.json: differs from what its inputs give")
    for k, n in enumerate(sinks.checked_selection(batch["selection"])):
        if (root / f"candidates/{k:06d}.json").read_text("utf-8") != canonical(fresh["candidates"][n]):
            raise ValueError(f"candidates/{k:06d}.json: differs from what its inputs give")
    return {"status": "verified", "selected_count": len(batch["selection"])}


WHO = {"event_id": "identifier", "source_id": "identifier", "segment_id": "identifier", "vehicle_id": "identifier", "direction": OneOf(("left", "right", "unknown")), "signal_state": OneOf(evaluation.SIGNALS)}
MOST_EVENTS = 64
LABELS = {
    "schema": OneOf(("assessment-1",)), "tolerance": "ratio", "max_gt_width": "ratio", "truths": Many(WHO | {"earliest": "ratio", "latest": "ratio"}, (0, MOST_EVENTS)),
    "predictions": Many(WHO | {"time": "ratio", "abstained": "bool"}, (0, MOST_EVENTS)),
    "correspondence": Many({"source_id": "identifier", "segment_id": "identifier", "prediction_vehicle_id": "identifier", "truth_vehicle_id": "identifier"}, (0, MOST_EVENTS)),
}


def ratio(a: int, b: int) -> str | None:
    return str(Fraction(a, b)) if b else None


def assess(spark: SparkSession, value: dict) -> dict:
    """Events and signals of labels against predictions; all times on one clock that holds them exactly."""
    if (wrong := document_fault(canonical(value), LABELS)) is not None:
        raise ValueError(f"labels{wrong}")
    truths, predictions, tolerance = value["truths"], value["predictions"], exact(value["tolerance"])
    for rows in (truths, predictions):
        if len({r["event_id"] for r in rows}) != len(rows):
            raise ValueError("an event occurs twice")
    vehicle = {(r["source_id"], r["segment_id"], r["prediction_vehicle_id"]): r["truth_vehicle_id"] for r in value["correspondence"]}
    if len(vehicle) != len(value["correspondence"]):
        raise ValueError("a correspondence occurs twice")
    if any(not 0 <= exact(t["latest"]) - exact(t["earliest"]) <= exact(value["max_gt_width"]) for t in truths):
        raise ValueError("an interval is backward or too wide")
    times = [exact(t[k]) for t in truths for k in ("earliest", "latest")] + [exact(p["time"]) for p in predictions] + [tolerance]
    unit = lcm(*[t.denominator for t in times])
    ticks = lambda text: int(exact(text) * unit)
    t = spark.createDataFrame([(r["source_id"], r["segment_id"], r["vehicle_id"], r["event_id"], ticks(r["earliest"]), ticks(r["latest"]), r["direction"], r["signal_state"]) for r in truths], "source string, segment string, vehicle string, truth_id string, earliest long, latest long, t_direction string, t_signal string")
    p = spark.createDataFrame([(r["source_id"], r["segment_id"], vehicle.get((r["source_id"], r["segment_id"], r["vehicle_id"])), r["event_id"], ticks(r["time"]), r["direction"], r["abstained"], r["signal_state"]) for r in predictions], "source string, segment string, vehicle string, prediction_id string, at long, p_direction string, abstained boolean, p_signal string")
    on = ["source", "segment", "vehicle"]
    pairs = evaluation.edges(t, p.where("not abstained and vehicle is not null"), on, int(tolerance * unit))
    labelled = evaluation.best_matching(pairs, on).join(t.select("truth_id", "t_direction", "t_signal"), "truth_id")
    matches = labelled.join(p.select("prediction_id", "p_direction", "p_signal"), "prediction_id")
    found = sorted(matches.collect(), key=lambda r: r.truth_id)
    m = evaluation.metrics(t, p, matches).first()
    s = evaluation.signal_coverage(t.withColumnRenamed("t_signal", "signal"), matches).first()
    grid = evaluation.confusion(matches.select(F.col("t_signal").alias("truth"), F.col("p_signal").alias("predicted")), list(evaluation.SIGNALS)).collect()
    used = {r.truth_id for r in found}, {r.prediction_id for r in found}
    return {
        "tp": m.tp, "fp": m.fp, "fn": m.fn, "precision": ratio(m.tp, m.tp + m.fp), "recall": ratio(m.tp, m.tp + m.fn), "abstained_predictions": m.abstained, "direction_correct": m.direction_correct,
        "direction_eligible_matches": m.direction_eligible, "matches": [{"truth": r.truth_id, "prediction": r.prediction_id, "time_distance": str(Fraction(r.cost, unit))} for r in found],
        "unmatched_truths": sorted(r["event_id"] for r in truths if r["event_id"] not in used[0]), "unmatched_predictions": sorted(r["event_id"] for r in predictions if not r["abstained"] and r["event_id"] not in used[1]),
        "signal_confusion_on_matches": {a: {r.predicted: r.n for r in grid if r.truth == a} for a in evaluation.SIGNALS}, "eligible_truths": s.eligible, "truth_known_signal": s.truth_known,
        "truth_observability_ratio": ratio(s.truth_known, s.eligible), "matched_known_predictions": s.matched_known, "end_to_end_known_prediction_coverage": ratio(s.matched_known, s.eligible), "correct_known_signal_matches": s.correct,
        "end_to_end_correct_signal_coverage": ratio(s.correct, s.eligible), "observable_truth_known_prediction_coverage": ratio(s.known_on_observable, s.truth_known),
        "observable_truth_correct_signal_coverage": ratio(s.correct, s.truth_known), "unknown_truth_to_no_blink": s.unknown_to_no_blink,
    }


def evaluate(spark: SparkSession, path: str) -> dict:
    return assess(spark, load(Path(local_path(path)), LABELS))

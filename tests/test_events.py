"""Listings, bundles, assessments and their commands over recorded runs, and what they refuse."""

import json

import pytest

from framewright import cli, events
from framewright.operators.receipts import canonical


def run(**changes):
    """Two lane changes, there and back, with a left lamp that blinks throughout."""
    lanes = [0] * 8 + [1] * 14 + [0] * 12
    rows = [
        {
            "ordinal": n, "pts": 1000 + 10 * n, "duration": 10, "lane": lane, "interior": True, "observed": True, "identity": 7,
            "left_status": "usable", "left_brightness": 200 if n // 2 % 2 else 20, "right_status": "usable", "right_brightness": 20,
        }
        for n, lane in enumerate(lanes)
    ]
    config = {"max_gap": 25, "dwell": 20, "pre": 60, "post": 60, "off": 60, "on": 150, "min_phase": 10, "max_phase": 40, "min_cycles": 1, "min_window": 30}
    return {"schema": "recorded-inputs-1", "source_id": 5, "config": config, "rows": rows} | changes


def command(capsys, *args):
    status = cli.main(list(args))
    return status, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_listings_and_bundles(spark, tmp_path, capsys):
    source = tmp_path / "inputs.json"
    source.write_text(canonical(run()))
    folder = str(tmp_path / "listing")
    status, shown = command(capsys, "events", "list", "--inputs", str(source), "--output", folder, "--lane-diagnostics", "--lamp-diagnostics")
    assert status == 0 and [(c["direction"], c["signal"]) for c in shown["candidates"]] == [("right", "left_blink"), ("left", "left_blink")]
    assert shown["candidates"][0]["crossing"] == [7, 8] and shown["candidates"][0]["completion"] == [8, 10] and "context" not in shown["candidates"][0]
    catalogue = json.loads((tmp_path / "listing" / "catalog.json").read_text())
    assert catalogue["candidates"][0]["requested"] == [10, 160] and catalogue["candidates"][0]["context"] == [10, 170]
    assert command(capsys, "events", "verify-list", "--listing", folder, "--require-diagnostics", "lane", "lamp")[0] == 0
    assert command(capsys, "events", "list", "--inputs", str(source), "--output", folder)[1]["error"] == "IO_ERROR"  # never replaced
    bundle = str(tmp_path / "bundle")
    status, made = command(capsys, "events", "replay", "--inputs", str(source), "--output", bundle, "--candidate-indices", "1", "0", "--catalog", f"{folder}/catalog.json")
    assert (status, made["selection"]) == (0, [1, 0])
    assert json.loads((tmp_path / "bundle" / "candidates" / "000000.json").read_text())["direction"] == "left"
    assert command(capsys, "events", "verify", "--bundle", bundle) == (0, {"status": "verified", "selected_count": 2})
    (tmp_path / "bundle" / "candidates" / "000001.json").write_text("{}")
    assert command(capsys, "events", "verify", "--bundle", bundle)[0] == 2
    (tmp_path / "listing" / "catalog.json").write_text(canonical(catalogue | {"status": "other"}))
    assert command(capsys, "events", "verify-list", "--listing", folder)[0] == 2
    for wrong in (["--candidate-index", "2"], ["--candidate-indices", "0", "0"], ["--candidate-index", "0", "--catalog", "x"]):
        assert command(capsys, "events", "replay", "--inputs", str(source), "--output", str(tmp_path / "none"), *wrong)[0] == 2
    assert not (tmp_path / "none").exists()


@pytest.mark.parametrize("change", [{"schema": "other"}, {"rows": []}, {"more": 1}, {"rows": run()["rows"][:1] * 2}, {"rows": run()["rows"] * 4}])
def test_inputs_that_are_refused(tmp_path, change):
    (tmp_path / "inputs.json").write_text(canonical(run(**change)))
    with pytest.raises(ValueError):
        events.load_inputs(str(tmp_path / "inputs.json"))


def test_a_gap_hides_a_signal(spark):
    rows = run()["rows"]
    found = events.listing(spark, run(rows=rows[:26] + [r | {"ordinal": r["ordinal"] + 1, "pts": r["pts"] + 10} for r in rows[26:]]))
    assert [c["signal"] for c in found["candidates"]] == ["unknown"] * 2 and found["candidates"][0]["left"]["reasons"] == ["insufficient_history"]


def labels(**changes):
    who = {"source_id": "s", "segment_id": "g", "direction": "left", "signal_state": "left_blink"}
    truths = [who | {"event_id": f"t{n}", "vehicle_id": "car", "earliest": f"{n}", "latest": f"{n}"} for n in (1, 3, 8)]
    truths[2]["signal_state"] = "unknown"
    predictions = [who | {"event_id": f"p{n}", "vehicle_id": "track", "time": t, "abstained": a} for n, (t, a) in enumerate((("2", False), ("5/2", False), ("17/2", False), ("8", True), ("20", False)))]
    predictions[2] |= {"signal_state": "no_blink_observed", "direction": "right"}
    mapped = [{"source_id": "s", "segment_id": "g", "prediction_vehicle_id": "track", "truth_vehicle_id": "car"}]
    return {"schema": "assessment-1", "tolerance": "1", "max_gt_width": "1/2", "truths": truths, "predictions": predictions, "correspondence": mapped} | changes


def test_assessment(spark, tmp_path, capsys):
    (tmp_path / "labels.json").write_text(canonical(labels()))
    status, found = command(capsys, "events", "evaluate", "--labels", str(tmp_path / "labels.json"))
    assert status == 0 and (found["tp"], found["fp"], found["fn"], found["precision"], found["recall"], found["abstained_predictions"]) == (3, 1, 0, "3/4", "1", 1)
    assert [(m["truth"], m["prediction"], m["time_distance"]) for m in found["matches"]] == [("t1", "p0", "1"), ("t3", "p1", "1/2"), ("t8", "p2", "1/2")]  # nearest first would leave t1 alone
    assert (found["direction_correct"], found["direction_eligible_matches"], found["unmatched_predictions"]) == (2, 3, ["p4"])
    assert found["signal_confusion_on_matches"]["unknown"]["no_blink_observed"] == found["unknown_truth_to_no_blink"] == 1
    assert (found["truth_observability_ratio"], found["end_to_end_correct_signal_coverage"], found["observable_truth_correct_signal_coverage"]) == ("2/3", "2/3", "1")
    nothing = events.assess(spark, labels(truths=[], predictions=[], correspondence=[]))
    assert (nothing["precision"], nothing["recall"], nothing["truth_observability_ratio"]) == (None, None, None)
    wide = labels()["truths"][:1]
    for change in ({"truths": wide * 2}, {"truths": [wide[0] | {"latest": "2"}]}, {"truths": [wide[0] | {"signal_state": "dark"}]}, {"correspondence": labels()["correspondence"] * 2}, {"tolerance": "2/2"}):
        (tmp_path / "bad.json").write_text(canonical(labels(**change)))
        assert command(capsys, "events", "evaluate", "--labels", str(tmp_path / "bad.json")) [1]["error"] == "INVALID_ASSESSMENT"


def test_other_commands(spark, tmp_path, capsys):
    assert "tracker_batch" in command(capsys, "query", "list")[1]
    folder = "/root/testdata/sf0.001"
    assert command(capsys, "query", "run", "bounded_take", folder, str(tmp_path / "out")) == (0, {"query": "bounded_take", "rows": 5})
    assert command(capsys, "query", "verify", "bounded_take", folder, str(tmp_path / "out")) == (0, {"query": "bounded_take", "differences": 0})
    assert command(capsys, "query", "run", "none", folder, str(tmp_path / "x"))[0] == 2
    assert set(command(capsys, "doctor")[1]) == {"ffmpeg", "ffprobe"}

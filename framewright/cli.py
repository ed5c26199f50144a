"""python -m framewright.cli: recorded runs (events ...), tools (doctor) and catalogue queries (query ...) from a shell.

JSON on stdout; exit 0, 2 on failed input, 130 when interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys

from . import events, tools
from .operators.audit import verify
from .plans import QUERIES
from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor").add_argument("--ffmpeg-dir")
    run = commands.add_parser("events").add_subparsers(dest="action", required=True)
    listing, replay = run.add_parser("list"), run.add_parser("replay")
    for command in (listing, replay):
        command.add_argument("--inputs", required=True)
        command.add_argument("--output", required=True)
    listing.add_argument("--lane-diagnostics", action="store_true")
    listing.add_argument("--lamp-diagnostics", action="store_true")
    replay.add_argument("--catalog")
    choice = replay.add_mutually_exclusive_group(required=True)
    choice.add_argument("--candidate-index", type=int)
    choice.add_argument("--candidate-indices", type=int, nargs="+")
    run.add_parser("verify").add_argument("--bundle", required=True)
    check = run.add_parser("verify-list")
    check.add_argument("--listing", required=True)
    check.add_argument("--require-diagnostics", nargs="+", choices=("lane", "lamp"), default=[])
    run.add_parser("evaluate").add_argument("--labels", required=True)
    query = commands.add_parser("query").add_subparsers(dest="action", required=True)
    query.add_parser("list")
    for name, last in (("run", "output"), ("verify", "recorded")):
        command = query.add_parser(name)
        for field in ("query", "folder", last):
            command.add_argument(field)
    return top


def run_events(a: argparse.Namespace) -> dict:
    if a.action == "list":
        return events.export_listing(session(), a.inputs, a.output, tuple(k for k in ("lane", "lamp") if getattr(a, f"{k}_diagnostics")))
    if a.action == "replay":
        if a.catalog is not None and a.candidate_indices is None:
            raise ValueError("--catalog goes with --candidate-indices")
        return events.export_replay(session(), a.inputs, a.output, [a.candidate_index] if a.candidate_indices is None else a.candidate_indices, a.catalog)
    if a.action == "verify":
        return events.verify_bundle(session(), a.bundle)
    if a.action == "verify-list":
        return events.verify_listing(session(), a.listing, tuple(a.require_diagnostics))
    return events.evaluate(session(), a.labels)


def run_query(a: argparse.Namespace) -> tuple[dict | list, int]:
    if a.action == "list":
        return sorted(QUERIES), 0
    if a.query not in QUERIES:
        raise ValueError(f"no query {a.query}")
    spark = session()
    result = QUERIES[a.query](spark, a.folder)
    if a.action == "run":
        result.write.mode("errorifexists").parquet(a.output)
        return {"query": a.query, "rows": spark.read.parquet(a.output).count()}, 0
    wrong = verify(spark.read.parquet(a.recorded), result).count()
    return {"query": a.query, "differences": wrong}, 2 if wrong else 0


def main(args: list[str] | None = None) -> int:
    chosen = parser().parse_args(args)
    try:
        if chosen.command == "doctor":
            report, status = tools.doctor(folder=chosen.ffmpeg_dir), 0
        elif chosen.command == "events":
            report, status = run_events(chosen), 0
        else:
            report, status = run_query(chosen)
    except KeyboardInterrupt:
        report, status = {"error": "INTERRUPTED"}, 130
    except OSError as problem:
        report, status = {"error": "IO_ERROR", "message": str(problem)[:300]}, 2
    except Exception as problem:
        code = "INVALID_ASSESSMENT" if getattr(chosen, "action", "") == "evaluate" else "INVALID_INPUTS"
        report, status = {"error": code, "message": str(problem)[:300]}, 2
    print(json.dumps(report))
    return status


if __name__ == "__main__":
    sys.exit(main())

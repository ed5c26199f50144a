"""Outside programs: finding them, running them with bounds, and reading what they print line by line."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import threading
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

#: What a probe is told, so that it opens local files of this format alone.
PROBE_OPTIONS = ("-protocol_whitelist", "file", "-f", "mov", "-enable_drefs", "0", "-use_absolute_path", "0", "-ignore_chapters", "1")
MOST_BYTES, MOST_LINE, MOST_SECONDS = 64 << 20, 1 << 16, 600


class ToolError(RuntimeError):
    """A tool that is missing, failed, or went over a bound."""


def discover(names: tuple[str, ...] = ("ffmpeg", "ffprobe"), folder: str | None = None) -> dict[str, str]:
    """Full paths of the programs, from a folder or from PATH; all of them or an error."""
    found = {}
    for name in names:
        path = shutil.which(name, path=folder) if folder else shutil.which(name)
        if path is None or not os.access(path, os.X_OK):
            raise ToolError(f"{name} isn't installed")
        found[name] = str(Path(path).resolve())
    return found


def doctor(names: tuple[str, ...] = ("ffmpeg", "ffprobe"), folder: str | None = None) -> dict[str, str]:
    """For each program its first line of version text, or why it can't be used."""
    report = {}
    for name in names:
        try:
            path = discover((name,), folder)[name]
            report[name] = next(run_lines([path, "-version"], seconds=20), "").strip() or "no version"
        except (ToolError, OSError) as problem:
            report[name] = f"unusable: {problem}"
    return report


def run_lines(command: list[str], seconds: float = MOST_SECONDS, most_line: int = MOST_LINE, most_bytes: int = MOST_BYTES) -> Iterator[str]:
    """The lines that a program prints, as it prints them. Too long a line, too much output, too much time or a failure are errors; the program is always ended and reaped."""
    process = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    late = threading.Event()
    timer = threading.Timer(seconds, lambda: (late.set(), process.kill()))
    timer.start()
    total = 0
    try:
        while raw := process.stdout.readline(most_line + 1):
            total += len(raw)
            if len(raw) > most_line or total > most_bytes:
                raise ToolError("a tool printed too much")
            yield raw.decode("utf-8", "strict")
        if process.wait() != 0 or late.is_set():
            raise ToolError("a tool took too long" if late.is_set() else f"a tool failed with status {process.returncode}")
    finally:
        timer.cancel()
        if process.poll() is None:
            process.kill()
        process.stdout.close()
        process.wait()


def run(command: list[str], seconds: float = MOST_SECONDS, most_bytes: int = MOST_BYTES) -> str:
    return "".join(run_lines(command, seconds, most_bytes, most_bytes))


def probe(paths: DataFrame, program: str, seconds: float = 60) -> DataFrame:
    """paths(path) with the probe's JSON report, or the problem why there is none. Runs where the data is, one program at a time in a task."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["path"]:
                try:
                    text = run([program, "-v", "error", *PROBE_OPTIONS, "-show_streams", "-show_format", "-of", "json", path.removeprefix("file:")], seconds)
                    if not isinstance(value := json.loads(text), dict) or "error" in value:
                        raise ToolError("the probe's report isn't valid")
                    rows.append((path, text, None))
                except (ToolError, ValueError, OSError) as problem:
                    rows.append((path, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "report", "problem"])

    return paths.select("path").mapInPandas(ask, "path string, report string, problem string")


def consume(lines: Iterator[str], accept: Callable[[str], None]) -> int:
    """Hand each line to a function as it comes; how many there were."""
    n = 0
    for line in lines:
        accept(line)
        n += 1
    return n

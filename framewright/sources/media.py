"""Containers, probe reports and frame records as tables. Decoding and encoding need outside tools (see tools.py)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

# Fixed values of the container format and of what is accepted.
PARENTS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"dinf"))
BARRED = frozenset((b"cmov", b"rmra", b"rdrf"))
BRANDS = frozenset((b"isom", b"iso2", b"iso3", b"iso4", b"iso5", b"iso6", b"mp41", b"mp42", b"avc1"))
MOST_DEPTH, MOST_BOXES, MOST_ENTRIES, MOST_BRAND_BYTES = 8, 100_000, 100_000, 4096
BOXES = "path string, depth int, kind string, begin long, payload long, finish long, problem string"

Fetch = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Atom:
    depth: int
    kind: bytes
    begin: int
    payload: int
    finish: int


class Refused(ValueError):
    """A file that isn't accepted, with the reason."""


def header(fetch: Fetch, at: int, room: int) -> tuple[bytes, int, int]:
    """Kind, header length and whole length of the box at a place with ``room`` bytes to its parent's end."""
    raw = fetch(at, min(16, room))
    if len(raw) < 8:
        raise Refused("a box header is cut off")
    short, kind = struct.unpack(">I4s", raw[:8])
    if short == 1 and len(raw) < 16:
        raise Refused("a box header is cut off")
    head, whole = (16, int.from_bytes(raw[8:16], "big")) if short == 1 else (8, short or room)
    if not head <= whole <= room:
        raise Refused("a box doesn't fit")
    return kind, head, whole


def atoms(fetch: Fetch, size: int) -> Iterator[Atom]:
    """All boxes of a file, parents before what they hold, from their headers alone: payloads are skipped."""
    todo = [(0, size, 0)]  # ranges still to be walked, the nearest last
    seen = 0
    while todo:
        at, end, depth = todo.pop()
        if at == end:
            continue
        kind, head, whole = header(fetch, at, end - at)
        seen += 1
        if seen > MOST_BOXES:
            raise Refused("too many boxes")
        yield Atom(depth, kind, at, at + head, at + whole)
        todo.append((at + whole, end, depth))
        if kind in PARENTS:
            if depth >= MOST_DEPTH:
                raise Refused("boxes are nested too deeply")
            todo.append((at + head, at + whole, depth + 1))


def check_brand(fetch: Fetch, box: Atom) -> None:
    size = box.finish - box.payload
    if not 8 <= size <= MOST_BRAND_BYTES:
        raise Refused("the brand box has a wrong size")
    words = struct.unpack(f"{size // 4 * 4}s", fetch(box.payload, size)[: size // 4 * 4])[0]
    named = {words[k : k + 4] for k in range(0, len(words), 4) if k != 4}  # the second word is a version
    if not named & BRANDS:
        raise Refused("no known brand")


def check_references(fetch: Fetch, box: Atom) -> None:
    """Every entry has to say that the media is in this file."""
    fixed = fetch(box.payload, 8)
    if len(fixed) < 8 or fixed[:4] != bytes(4) or box.finish - box.payload < 8:
        raise Refused("a data reference is malformed")
    count, at, entries = int.from_bytes(fixed[4:], "big"), box.payload + 8, 0
    while at < box.finish:
        kind, head, whole = header(fetch, at, box.finish - at)
        if kind != b"url " or whole - head != 4 or fetch(at + head, 4) != b"\0\0\0\1":
            raise Refused("media lies outside of the file")
        at, entries = at + whole, entries + 1
    if entries != count or not 0 < count <= MOST_ENTRIES:
        raise Refused("a data reference has another number of entries")


def scan(fetch: Fetch, size: int) -> tuple[list[Atom], str | None]:
    """All boxes and the first problem that bars the file. ``fetch(offset, length)`` reads no payload but those of brands and references."""
    found: list[Atom] = []
    try:
        for box in atoms(fetch, size):
            found.append(box)
            if box.kind in BARRED:
                raise Refused("packed metadata or references to other files")
            if box.kind == b"ftyp" and box.depth == 0:
                check_brand(fetch, box)
            if box.kind == b"dref":
                check_references(fetch, box)
        top = [b.kind for b in found if b.depth == 0]
        if top.count(b"ftyp") != 1 or top.count(b"moov") != 1 or b"mdat" not in top:
            raise Refused("the file needs one ftyp, one moov and an mdat")
        if all(b.kind != b"dref" for b in found):
            raise Refused("no data reference says where the media is")
    except Refused as problem:
        return found, str(problem)
    return found, None


def scan_container(data: bytes) -> tuple[list[tuple[int, str, int, int, int]], str | None]:
    """``scan`` of bytes that are there already; boxes as (depth, kind, begin, payload, finish)."""
    found, problem = scan(lambda at, n: data[at : at + n], len(data))
    return [(b.depth, b.kind.decode("latin-1"), b.begin, b.payload, b.finish) for b in found], problem


@F.pandas_udf(T.StringType())
def container_problem(contents: pd.Series) -> pd.Series:
    """Why a file's content is refused, or null."""
    return pd.Series([None if c is None else scan_container(bytes(c))[1] for c in contents], dtype=object)


def container_boxes(spark: SparkSession, path: str) -> DataFrame:
    """The boxes of all files under a path; a file that is barred has one row with the problem.

    Only names and sizes go through Spark; each task opens its files and reads headers
    by seeking, so files may be of any size.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            rows = []
            for name, size in zip(part["path"], part["length"]):
                store, inner = fs.FileSystem.from_uri(name)
                with store.open_input_file(inner) as handle:

                    def fetch(at: int, n: int, handle=handle) -> bytes:
                        handle.seek(at)
                        return handle.read(n)

                    found, problem = scan(fetch, int(size))
                rows += [(name, -1, None, None, None, None, problem)] if problem else [(name, b.depth, b.kind.decode("latin-1"), b.begin, b.payload, b.finish, None) for b in found]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in BOXES.split(", ")]).astype({"begin": "Int64", "payload": "Int64", "finish": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").mapInPandas(run, BOXES)


def file_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed_receipts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose receipts differ between opening and finishing a job, or that came or went."""
    b = after.select("path", F.col("size").alias("size2"), F.col("sha256").alias("sha2"))
    return before.join(b, "path", "full_outer").where(~(F.col("size").eqNullSafe(F.col("size2")) & F.col("sha256").eqNullSafe(F.col("sha2")))).select("path", "sha256", F.col("sha2").alias("now"))


STREAM = (
    "struct<codec_type:string,codec_name:string,pix_fmt:string,color_transfer:string,color_primaries:string,width:int,height:int,sample_rate:string,channels:int,"
    "disposition:struct<attached_pic:int>,side_data_list:array<struct<rotation:string,displaymatrix:string>>>"
)
PROBE = f"struct<streams:array<{STREAM}>>"
QUARTER = 65536


def rotation(side_data: Column) -> Column:
    """Quarter turns (0, 90, 180, 270) that the last rotation entry says; null for another angle, or a matrix that mirrors or scales."""
    numbers = lambda text: F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(?m)^[^:\n]*:", ""), F.lit(r"(-?\d+)"), F.lit(1)), lambda v: v.cast("long"))

    def pure(item: Column) -> Column:
        m = numbers(item["displaymatrix"])
        a, b, c, d = (F.get(m, F.lit(k)) for k in (0, 1, 3, 4))
        flat = F.forall(F.array(a, b, c, d), lambda v: v.isin(-QUARTER, 0, QUARTER))
        return F.coalesce(item["displaymatrix"], F.lit("")).isin("") | F.coalesce((a * d - b * c == QUARTER * QUARTER) & flat, F.lit(False))

    given = F.filter(F.coalesce(side_data, F.array().cast(f"array<struct<rotation:string,displaymatrix:string>>")), lambda i: i["rotation"].isNotNull())
    angle = F.coalesce(F.element_at(F.transform(given, lambda i: i["rotation"].try_cast("double")), -1), F.lit(0.0))
    angle = F.when(F.size(given) == 0, F.lit(0.0)).otherwise(angle)
    odd = ~F.forall(F.coalesce(side_data, F.array().cast("array<struct<rotation:string,displaymatrix:string>>")), pure)
    return F.when(~odd & (angle % 90 == 0), F.pmod(angle, F.lit(360.0)).cast("int"))


def profile_problem(info: Column) -> Column:
    """Why the streams of a probe report are refused, or null: one plain 8-bit 4:2:0 H.264 video, at most one AAC audio and nothing else."""
    streams = F.coalesce(info["streams"], F.array().cast(f"array<{STREAM}>"))
    of = lambda kind: F.filter(streams, lambda s: s["codec_type"] == kind)
    videos, audios = of("video"), of("audio")
    video, audio = F.get(videos, F.lit(0)), F.get(audios, F.lit(0))
    is_ = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    positive = lambda c: F.coalesce(c.try_cast("long") > 0, F.lit(False))
    return (
        F.when((F.size(videos) != 1) | (F.size(audios) > 1) | (F.size(streams) != F.size(videos) + F.size(audios)), "streams")
        .when(~is_(video["codec_name"], "h264") | ~is_(video["pix_fmt"], "yuv420p", "yuvj420p"), "codec")
        .when(is_(video["color_transfer"], "smpte2084", "arib-std-b67") | is_(video["color_primaries"], "bt2020"), "high dynamic range")
        .when(F.coalesce(video["disposition"]["attached_pic"], F.lit(0)) != 0, "cover picture")
        .when(~positive(video["width"]) | ~positive(video["height"]), "size")
        .when(rotation(video["side_data_list"]).isNull(), "rotation")
        .when(audio.isNotNull() & (~is_(audio["codec_name"], "aac") | ~positive(audio["sample_rate"]) | ~positive(audio["channels"])), "audio")
    )


def stream_profile(probes: DataFrame, column: str = "report") -> DataFrame:
    """Probe reports with the reason why they are refused (null: accepted), and the rotation of their video."""
    parsed = probes.withColumn("info", F.from_json(column, PROBE, {"mode": "FAILFAST"}))
    video = F.get(F.filter("info.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    return parsed.withColumn("problem", profile_problem(F.col("info"))).withColumn("rotation", F.when(video.isNotNull(), rotation(video["side_data_list"]))).drop("info")


def frame_records(lines: DataFrame, fields: list[str], on: str = "source_id") -> DataFrame:
    """lines(on, n, line) of a tool's sectioned output as one row for each [FRAME] section, with the fields as text (N/A: null).

    Sections don't nest but for [SIDE_DATA], whose own lines are skipped. A line out of
    place, an unknown, repeated or empty field, and a section without end are errors.
    """
    order = Window.partitionBy(on).orderBy("n")
    line = F.rtrim(F.col("line"))
    opens, closes = lambda tag: (line == f"[{tag}]").cast("int"), lambda tag: (line == f"[/{tag}]").cast("int")
    marked = lines.withColumn("frame", F.sum(opens("FRAME")).over(order)).withColumn("depth", F.sum(opens("FRAME") - closes("FRAME")).over(order)).withColumn("side", F.sum(opens("SIDE_DATA") - closes("SIDE_DATA")).over(order))
    tag = line.isin("[FRAME]", "[/FRAME]", "[SIDE_DATA]", "[/SIDE_DATA]")
    name, value = F.split_part(line, F.lit("="), F.lit(1)), F.regexp_replace(line, "^[^=]*=", "")
    last = F.last(F.struct("depth", "side")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    between_side = (F.col("side") == 1) & ~tag
    wrong = (
        ~F.col("depth").isin(0, 1) | ~F.col("side").isin(0, 1) | ((F.col("side") == 1) & (F.col("depth") == 0)) | ((line == "[/FRAME]") & (F.col("side") != 0))
        | (~tag & ((F.col("depth") == 0) | (~between_side & (~line.contains("=") | ~name.isin(fields) | (value == "") | value.contains("\\"))))) | (last["depth"] != 0) | (last["side"] != 0)
    )
    checked = marked.withColumn("frame", F.when(~wrong, F.col("frame")).otherwise(F.raise_error(F.lit("frame records are malformed")).cast("long")))
    inside = checked.where(~tag & (F.col("side") == 0) | (line == "[FRAME]")).withColumn("name", F.when(line == "[FRAME]", "").otherwise(name)).withColumn("value", F.nullif(value, F.lit("N/A")))

    def one(field: str) -> Column:
        said = F.collect_list(F.when(F.col("name") == field, value))
        return F.when(F.size(said) <= 1, F.max(F.when(F.col("name") == field, F.col("value")))).otherwise(F.raise_error(F.lit("a field occurs twice")).cast("string")).alias(field)

    return inside.groupBy(on, "frame").agg(*[one(f) for f in fields])


RECORD = "<qQ"


@F.pandas_udf(T.BinaryType())
def packed(frames: pd.Series) -> pd.Series:
    """Arrays of (pts, duration) in order as records of 16 bytes."""
    return pd.Series([None if rows is None else b"".join(struct.pack(RECORD, r["pts"], r["duration"]) for r in rows) for rows in frames], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("duration", T.LongType())])))
def unpacked(data: pd.Series) -> pd.Series:
    return pd.Series([None if raw is None else [{"pts": p, "duration": d} for p, d in struct.iter_unpack(RECORD, raw)] for raw in data], dtype=object)

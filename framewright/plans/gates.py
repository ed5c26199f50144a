"""Queries of gates, codecs, media records and exact numbers: most lay faults into the given tables and say which are found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sql import common_divisor, part_to_coded
from ..operators import association, audit, capture, codecs, diagnostics, geometry, lanes, lanes_fold, receipts, replay, sinks, timeline, tracking
from ..session import shared_folder
from ..sources import media
from .catalogue import DAY, EDGES, FRAMES, HOUR, IOU, LANE_STATES, UNION, event_edges, lane_rows, line_boxes, query, ticked

# --- containers and probe reports


def atom(kind: str, *bodies: Column) -> Column:
    """A box of a container as a binary expression."""
    body = F.concat(*bodies) if bodies else F.unhex(F.lit(""))
    return F.concat(F.unhex(F.lpad(F.hex((F.octet_length(body) + 8).cast("long")), 8, "0")), F.lit(kind).cast("binary"), body)


def raw(text: str) -> Column:
    return F.unhex(F.lit(text))


CONTAINER_FAULTS = {
    1: "no known brand", 2: "media lies outside of the file", 3: "a data reference has another number of entries", 4: "packed metadata or references to other files", 5: "a box doesn't fit",
    6: "the file needs one ftyp, one moov and an mdat", 7: "no data reference says where the media is", 8: "the brand box has a wrong size", 9: "a data reference is malformed",
}


@query("SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in CONTAINER_FAULTS.items()) + " END AS problem FROM part")
def container_gate(read):
    """Containers of one track, with a fault for some remainders of the part's key."""
    k = F.col("p_partkey") % 12
    pick = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    brand = F.concat(F.when(k == 1, F.lit("abcd")).otherwise(F.lit("isom")).cast("binary"), F.when(k == 8, raw("00")).otherwise(raw("00000200")))
    entry = pick(2, atom("url ", raw("00000000"), F.lit("x.mp4").cast("binary")), atom("url ", raw("00000001")))
    references = atom("dref", F.when(k == 9, raw("01000000")).otherwise(raw("00000000")), F.when(k == 3, raw("00000002")).otherwise(raw("00000001")), entry)
    inner = F.when(k == 7, atom("free")).otherwise(references)
    more = F.when(k == 4, atom("cmov")).otherwise(raw(""))
    moov = atom("moov", atom("trak", atom("mdia", atom("minf", atom("dinf", inner)))), more)
    whole = F.concat(atom("ftyp", brand), moov, F.when(k == 6, moov).otherwise(raw("")), atom("mdat", F.col("p_name").cast("binary")))
    cut = F.when(k == 5, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole)
    return read("part").select("p_partkey", media.container_problem(cut).alias("problem"))


PROFILE_FAULTS = {1: "streams", 2: "codec", 3: "high dynamic range", 4: "cover picture", 5: "size", 6: "rotation", 7: "audio", 8: "streams", 9: "rotation", 10: "high dynamic range"}


@query("SELECT p_partkey, CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PROFILE_FAULTS.items()) + " END AS problem, CASE p_partkey % 16 WHEN 6 THEN NULL WHEN 9 THEN NULL WHEN 8 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 270 WHEN 2 THEN 180 ELSE 90 END END AS rotation FROM part")
def probe_profiles(read):
    """Probe reports with faults in their streams."""
    k = F.col("p_partkey") % 16
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    turn = F.when(k == 6, "45").otherwise((F.col("p_partkey") % 4 * -90).cast("string"))
    matrix = F.when(k == 9, "0: 65536 0 0\\n1: 0 -65536 0\\n2: 0 0 1073741824").otherwise("0: 0 65536 0\\n1: -65536 0 0\\n2: 0 0 1073741824")
    video = text(
        '{"codec_type":"video","codec_name":"', F.when(k == 2, "hevc").otherwise("h264"), '","pix_fmt":"', F.when(k == 11, "yuvj420p").otherwise("yuv420p"), '","color_transfer":"', F.when(k == 3, "smpte2084").otherwise("bt709"),
        '","color_primaries":"', F.when(k == 10, "bt2020").otherwise("bt709"), '","width":', F.when(k == 5, "0").otherwise("96"), ',"height":64,"disposition":{"attached_pic":', F.when(k == 4, "1").otherwise("0"),
        '},"side_data_list":[{"rotation":"', turn, '","displaymatrix":"', matrix, '"}]}',
    )
    audio = text(',{"codec_type":"audio","codec_name":"aac","sample_rate":"', F.when(k == 7, "0").otherwise("48000"), '","channels":2}')
    streams = F.when(k == 8, F.lit('{"codec_type":"data"}')).otherwise(text(video, F.when(k == 1, text(",", video)).otherwise(audio)))
    return media.stream_profile(read("part").select("p_partkey", text('{"streams":[', streams, "]}").alias("report"))).select("p_partkey", "problem", "rotation")


@query(f"WITH {FRAMES} SELECT source_id, CAST(pts AS VARCHAR) AS pts, CASE WHEN cents % 3 <> 0 THEN CAST(cents AS VARCHAR) END AS duration, '96' AS width FROM t")
def frame_records(read):
    """Frames printed as sections of lines, some with side data, and read back."""
    lines = lambda *texts: F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    said = lines("[FRAME]", F.concat(F.lit("pts="), "pts"), F.concat(F.lit("duration="), F.when(F.col("cents") % 3 != 0, F.col("cents").cast("string")).otherwise("N/A")))
    side = F.when(F.col("cents") % 5 == 0, lines("[SIDE_DATA]", "type=other", "[/SIDE_DATA]")).otherwise(F.array().cast("array<string>"))
    each = ticked(read).select("source_id", "ordinal", F.posexplode(F.concat(said, side, lines("width=96", "[/FRAME]"))).alias("k", "line"))
    found = media.frame_records(each.select("source_id", (F.col("ordinal") * 100 + F.col("k")).alias("n"), "line"), ["pts", "duration", "width"])
    return found.select("source_id", "pts", "duration", "width")


@query(f"WITH {FRAMES} SELECT source_id, pts, cents AS duration FROM t")
def packed_timeline(read):
    """Timelines as records of 16 bytes and back."""
    rows = ticked(read).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("pts", F.col("cents").alias("duration")))).alias("frames"))
    return rows.select("source_id", media.packed(F.col("frames")).alias("data")).select("source_id", F.inline(media.unpacked(F.col("data")))).select("source_id", "pts", "duration")


# --- exact numbers


@query(f"WITH {FRAMES} SELECT source_id, ordinal, regexp_replace(regexp_replace(printf('%d.%06d', ticks // 1000000, ticks % 1000000), '0+$', ''), '\\.$', '') AS seconds FROM t")
def display_seconds(read):
    return ticked(read).select("source_id", "ordinal", timeline.display_seconds(F.col("ticks"), F.lit(1_000_000)).alias("seconds"))


@query(f"""WITH {FRAMES}, d AS (SELECT source_id, ordinal, CAST(ticks AS HUGEINT) * 1000000000000 AS n FROM t) SELECT source_id, ordinal, printf('%d.%012d', CAST(n // 90000 // 1000000000000 AS BIGINT), CAST(n // 90000 % 1000000000000 AS BIGINT)) AS low,
printf('%d.%012d', CAST((n + 89999) // 90000 // 1000000000000 AS BIGINT), CAST((n + 89999) // 90000 % 1000000000000 AS BIGINT)) AS high FROM d""")
def outward_rounding(read):
    low, high = (timeline.outward(F.col("ticks"), F.lit(90_000), 12, up) for up in (False, True))
    return ticked(read).select("source_id", "ordinal", low.alias("low"), high.alias("high"))


@query("""WITH g AS (SELECT *, gcd(l_suppkey, l_partkey) AS divisor, CASE WHEN l_linenumber % 4 <> 0 AND l_partkey <> 0 THEN gcd(l_suppkey, l_partkey) END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey = d THEN CAST(l_suppkey // d AS VARCHAR) ELSE (l_suppkey // d) || '/' || (l_partkey // d) END AS ratio, divisor FROM g""")
def exact_ratios(read):
    below = F.when(F.col("l_linenumber") % 4 == 0, 0).otherwise(F.col("l_partkey"))
    return read("lineitem").select("l_orderkey", "l_linenumber", receipts.ratio_text(F.col("l_suppkey"), below).alias("ratio"), common_divisor(F.col("l_suppkey"), F.col("l_partkey")).alias("divisor"))


@query(f"WITH {FRAMES}, e AS (SELECT source_id, abs(ticks - ticks // 1000 * 1000) AS d FROM t) SELECT source_id, max(d) AS worst, max(d) <= 998 AS within FROM e GROUP BY source_id")
def timing_error(read):
    pairs = ticked(read).select("source_id", F.col("ticks").alias("expected"), (F.floor(F.col("ticks") / 1000) * 1000).alias("actual"))
    return sinks.timing_error(pairs, ["source_id"], 998)


@query(f"""WITH {FRAMES}, g AS (SELECT source_id, max(ticks) + 1000 AS total, count(*) FILTER (WHERE ticks >= {20 * DAY} AND ticks < {20 * DAY + 8 * HOUR}) AS n FROM t GROUP BY source_id)
SELECT source_id, CASE WHEN total < {20 * DAY + 8 * HOUR} THEN 'outside of the timeline' ELSE 'no frame begins in it' END AS problem FROM g WHERE total < {20 * DAY + 8 * HOUR} OR n = 0""")
def range_problems(read):
    return timeline.range_problems(ticked(read).drop("ticks").withColumn("duration", F.lit(1000).cast("long")), 20 * DAY, 20 * DAY + 8 * HOUR)


IDS = "CASE WHEN doc_id % 5 = 0 THEN source || ' ' WHEN doc_id % 5 = 1 THEN source || ':' || lang WHEN doc_id % 5 = 2 THEN repeat('x', 65) ELSE source END"


@query(f"SELECT doc_id, regexp_full_match(id, '[A-Za-z0-9_.-]{{1,64}}') AS identifier, regexp_full_match(id, '[A-Za-z0-9_.:-]{{1,160}}') AS model, doc_id % 3 <> 0 AS digest FROM (SELECT doc_id, coalesce({IDS}, '') AS id FROM documents)")
def scalar_gates(read):
    k = F.col("doc_id") % 5
    name = F.coalesce(F.when(k == 0, F.concat("source", F.lit(" "))).when(k == 1, F.concat_ws(":", "source", "lang")).when(k == 2, F.repeat(F.lit("x"), 65)).otherwise(F.col("source")), F.lit(""))
    hex_ = F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha2(F.lit("a"), 256))).otherwise(F.sha2(F.lit("a"), 256))
    return read("documents").select("doc_id", audit.is_identifier(name).alias("identifier"), audit.is_model(name).alias("model"), audit.is_digest(hex_).alias("digest"))


# --- geometry


@query("SELECT vec_id, k, round(CASE WHEN label % 2 = 0 THEN (0.42 + 0.58 * (k / 71.0::DOUBLE)) * 590 ELSE k / 71.0::DOUBLE * 1640 END, 6) AS place FROM (SELECT vec_id, label, unnest(range(72)) AS k FROM embeddings)")
def anchor_places(read):
    each = read("embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(71).cast("long"))).alias("k"))
    place = lanes.anchor_place(F.when(F.col("label") % 2 == 0, "row").otherwise("column"), F.col("k"), F.lit(72), F.lit(1640), F.lit(590))
    return each.select("vec_id", "k", F.round(place, 6).alias("place"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_tax * 100) AS BIGINT) AS first, CAST(ceil(l_tax * 100 + l_quantity / 3) - 1 AS BIGINT) AS last FROM lineitem")
def pixel_edges(read):
    first, last = sinks.pixel_edges(F.col("l_tax") * 100, F.col("l_tax") * 100 + F.col("l_quantity") / 3)
    return read("lineitem").select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 * 90 AS rot, l_partkey % 100 AS cx, l_suppkey % 50 AS cy, 40 + l_partkey % 60 AS w, 20 + l_suppkey % 40 AS h, CAST(l_quantity AS BIGINT) % 30 AS a, l_partkey % 15 AS b, CAST(l_quantity AS BIGINT) % 30 + 20 AS c, l_partkey % 15 + 10 AS d FROM lineitem),
q AS (SELECT *, CASE WHEN rot % 180 = 0 THEN w ELSE h END AS vw, CASE WHEN rot % 180 = 0 THEN h ELSE w END AS vh FROM p), s AS (SELECT *, a * vw / 64 AS u1, c * vw / 64 AS u2, b * vh / 32 AS v1, d * vh / 32 AS v2 FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 <> 0 THEN cx + CASE rot WHEN 0 THEN u1 WHEN 90 THEN v1 WHEN 180 THEN w - u2 ELSE w - v2 END END AS x1, CASE WHEN l_linenumber % 5 <> 0 THEN cy + CASE rot WHEN 0 THEN v1 WHEN 90 THEN h - u2 WHEN 180 THEN h - v2 ELSE u1 END END AS y1,
CASE WHEN l_linenumber % 5 <> 0 THEN cx + CASE rot WHEN 0 THEN u2 WHEN 90 THEN v2 WHEN 180 THEN w - u1 ELSE w - v1 END END AS x2, CASE WHEN l_linenumber % 5 <> 0 THEN cy + CASE rot WHEN 0 THEN v2 WHEN 90 THEN h - u1 WHEN 180 THEN h - v1 ELSE u2 END END AS y2 FROM s""")
def lamp_part_boxes(read):
    """Boxes on the canvas of a turned crop in the raster; every fifth has no part."""
    x, y, q = F.col("l_partkey") % 100, F.col("l_suppkey") % 50, F.col("l_quantity").cast("long") % 30
    box = lambda a, b, c, d: F.struct(*[v.cast("double").alias(n) for v, n in zip((a, b, c, d), geometry.BOX)])
    crop = box(x, y, x + 40 + F.col("l_partkey") % 60, y + 20 + F.col("l_suppkey") % 40)
    part = box(F.when(F.col("l_linenumber") % 5 != 0, q), F.col("l_partkey") % 15, q + 20, F.col("l_partkey") % 15 + 10)
    found = read("lineitem").select("l_orderkey", "l_linenumber", part_to_coded(F.col("l_linenumber") % 4 * 90, F.lit(64), F.lit(32), crop, part).alias("b"))
    return found.select("l_orderkey", "l_linenumber", "b.*")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 200 + l_partkey % 800 AS w, 150 + l_suppkey % 500 AS h, l_quantity * 12 AS a, l_quantity * 6 AS b FROM lineitem), r AS (SELECT *, least(640, w * 384 // h) AS rw, least(384, h * 640 // w) AS rh FROM s),
c AS (SELECT *, greatest(least(greatest(a, 0), rw) * w / rw, 0) AS x1, greatest(least(greatest(b, 0), rh) * h / rh, 0) AS y1, least(least(greatest(a + 90, 0), rw) * w / rw, w) AS x2, least(least(greatest(b + 45, 0), rh) * h / rh, h) AS y2 FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN x1 < x2 AND y1 < y2 THEN x1 END, 6) AS x1, round(CASE WHEN x1 < x2 AND y1 < y2 THEN y1 END, 6) AS y1, round(CASE WHEN x1 < x2 AND y1 < y2 THEN x2 END, 6) AS x2, round(CASE WHEN x1 < x2 AND y1 < y2 THEN y2 END, 6) AS y2 FROM c""")
def letterbox_boxes(read):
    sized = read("lineitem").select("l_orderkey", "l_linenumber", (F.lit(200) + F.col("l_partkey") % 800).alias("w"), (F.lit(150) + F.col("l_suppkey") % 500).alias("h"), (F.col("l_quantity") * 12).alias("a"), (F.col("l_quantity") * 6).alias("b"))
    rw, rh = geometry.letterbox(F.col("w"), F.col("h"), 640, 384)
    fitted = sized.withColumns({"rw": rw, "rh": rh})
    box = geometry.box_from_letterbox({"x1": F.col("a"), "y1": F.col("b"), "x2": F.col("a") + 90, "y2": F.col("b") + 45}, (F.col("rw"), F.col("rh")), (F.col("w").cast("double"), F.col("h").cast("double")))
    return fitted.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(c) for c, v in box.items()])


@query(f"""WITH {EDGES}, tw AS (SELECT DISTINCT a.source_id, a.day, unnest([a.det_index, b.det_index]) AS det_index FROM b a JOIN b ON a.source_id = b.source_id AND a.day = b.day AND a.det_index < b.det_index WHERE {IOU} * 2 >= {UNION})
SELECT source_id, day, track_id, det_index FROM g WHERE td = 1 AND dd = 1 AND NOT EXISTS (SELECT 1 FROM tw WHERE tw.source_id = g.source_id AND tw.day = g.day AND tw.det_index = g.det_index)""")
def association_conflicts(read):
    """Unique pairs whose detection has no near double of its own frame."""
    x, y = F.col("cents") % 400, F.col("cents") % 200
    boxes = ticked(read).where(~F.col("event_type").isin("view", "click")).select("source_id", F.floor(F.col("ticks") / DAY).alias("day"), F.col("ordinal").alias("idx"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 50).alias("y2"))
    twins = geometry.pairs_of_class(boxes, ["source_id", "day"], 1, 2)
    doubled = twins.select("source_id", "day", F.explode(F.array("a_idx", "b_idx")).alias("det_index"))
    return association.unique(event_edges(read), ["source_id", "day"], doubled).select("source_id", "day", "track_id", "det_index")


# --- lane sections

POINTS = """e AS (SELECT vec_id, label, unnest(range(0, 24)) AS k, embedding FROM embeddings), p AS (SELECT vec_id, label, k, CAST(floor(CAST(embedding[k + 1] AS DOUBLE) * 1000) AS DOUBLE) AS x, CASE WHEN embedding[k + 25] > -0.15 THEN CASE WHEN embedding[k + 25] > 0.3 THEN 120.0 ELSE k * 10.0 END END AS y, embedding[k + 2] > -0.05 AS seen, embedding FROM e),
q AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k)), m AS (SELECT * FROM q WHERE k < 23 AND y IS NOT NULL AND y2 IS NOT NULL AND least(y, y2) <= 120 AND greatest(y, y2) >= 120),
h AS (SELECT vec_id, k, y = y2 AS flat, CASE WHEN y = 120 THEN 2 * k WHEN y2 = 120 THEN 2 * k + 2 ELSE 2 * k + 1 END AS place, CASE WHEN y = 120 THEN x WHEN y2 = 120 THEN x2 ELSE x + (120 - y) / (y2 - y) * (x2 - x) END AS met, seen FROM m),
z AS (SELECT vec_id, bool_or(flat) AS flat, count(DISTINCT place) AS n, arg_min(met, k) FILTER (WHERE seen) AS met FROM h GROUP BY vec_id),
sm AS (SELECT v.vec_id, CASE WHEN label % 7 = 0 THEN 'slot_support_missing' WHEN coalesce(flat, false) THEN 'horizontal_intersection' WHEN coalesce(n, 0) = 0 THEN 'no_adjacent_support' WHEN n > 1 THEN 'multiple_intersections' WHEN met IS NULL THEN 'uncertified_intersection' END AS reason, met FROM embeddings v LEFT JOIN z USING (vec_id))"""


def line_samples(read) -> DataFrame:
    """Lines of 24 anchors out of the vectors, joined with a binding each, and their samples at y = 120."""
    value = lambda k: F.get("embedding", k)
    y = lambda k: F.when(value(k + 24) > 0.3, F.lit(120.0)).otherwise((k * 10).cast("double"))
    point = lambda x, k: F.when(value(k + 24) > -0.15, F.struct(F.floor(x.cast("double") * 1000).cast("double").alias("x"), y(k).alias("y")))
    vectors = read("embeddings").withColumn("slot", F.lit(1))
    slots = vectors.select("vec_id", "slot", F.transform(F.slice("embedding", 1, 24), point).alias("points"), (F.col("label") % 7 != 0).alias("passed"))
    seen = F.transform(F.sequence(F.lit(1), F.lit(23)), lambda k: F.get("embedding", k) > -0.05)
    bindings = vectors.select("vec_id", "slot", F.lit(0).alias("position"), F.lit("b").alias("boundary_id"), seen.alias("visible"), F.lit(120.0).alias("y"))
    return lanes.bound_samples(slots, bindings, ["vec_id"], "y")


@query(f"WITH {POINTS} SELECT vec_id, reason, round(CASE WHEN reason IS NULL THEN met END, 6) AS x FROM sm")
def section_samples(read):
    return line_samples(read).select("vec_id", "reason", F.round("x", 6).alias("x"))


@query(f"""WITH {POINTS}, f AS (SELECT vec_id // 5 AS frame, vec_id % 5 AS position, reason, CASE WHEN reason IS NULL THEN met END AS x FROM sm), o AS (SELECT *, x <= lag(x) OVER (PARTITION BY frame ORDER BY position) AS back FROM f)
SELECT frame, count(*) AS bindings, arg_min(reason, position) FILTER (WHERE reason IS NOT NULL) AS first_failure, NOT bool_or(coalesce(back, false)) AS ordered FROM o GROUP BY frame""")
def section_facts(read):
    found = line_samples(read).select(F.floor(F.col("vec_id") / 5).alias("frame"), (F.col("vec_id") % 5).alias("position"), "x", "reason")
    return lanes.section_facts(found, ["frame"])


SHUT = """CASE WHEN event_type = 'error' THEN 'no_actual_observation' WHEN cents % 5 = 0 THEN 'lanes_unknown' WHEN cents % 7 = 0 THEN 'context_unknown' WHEN cents % 9 = 0 THEN 'boundary_bindings_unconfirmed' WHEN cents % 10 = 3 THEN 'coded_axes_uncertain' WHEN cents % 11 = 0 THEN 'ego_scene_or_pose_uncertain'
 WHEN cents % 13 < 3 THEN 'insufficient_boundaries' WHEN cents % 17 = 1 THEN 'no_adjacent_support' WHEN cents % 19 = 1 THEN 'boundary_order_uncertain' END"""


def gated(read) -> DataFrame:
    c = F.col("cents")
    some = lambda condition: F.when(condition, F.lit(1))
    reason = replay.section_reason(
        some(F.col("event_type") != "error"), some(c % 5 != 0), some(c % 7 != 0), {"adjacency": c % 9 != 0, "axes": c % 10 != 3, "scene": c % 11 != 0}, c % 13, F.when(c % 17 == 1, "no_adjacent_support"), c % 19 != 1
    )
    return ticked(read).withColumn("reason", reason)


@query(f"WITH {FRAMES} SELECT source_id, ordinal, {SHUT} AS reason FROM t")
def section_gate_reasons(read):
    return gated(read).select("source_id", "ordinal", "reason")


RESETS = f"""sr AS (SELECT *, {SHUT} AS section, CASE WHEN {SHUT} IS NULL THEN ordinal // 20 END AS key FROM t), rs AS (SELECT *, CASE WHEN section IS NOT NULL THEN section WHEN lag(key) OVER (PARTITION BY source_id ORDER BY ordinal) <> key THEN 'lane_source_change' END AS reset_reason FROM sr)"""


def reset_rows(read) -> DataFrame:
    return diagnostics.section_resets(gated(read), "reason", F.floor(F.col("ordinal") / 20))


@query(f"WITH {FRAMES}, {RESETS} SELECT source_id, ordinal, reset_reason FROM rs")
def lane_source_resets(read):
    return reset_rows(read).select("source_id", "ordinal", "reset_reason")


DIAGNOSED = f"""{LANE_STATES.rstrip()}, st AS (SELECT source_id, ordinal, CASE act WHEN 'none' THEN 'unknown' WHEN 'settle' THEN CASE WHEN hit THEN 'candidate' ELSE 'stable' END ELSE act END AS status,
CASE WHEN act = 'none' AND nb IS NULL THEN 'outside_lane_section' WHEN act = 'none' THEN 'non_adjacent_or_incomplete' WHEN anew THEN 'start' WHEN cut THEN 'time_gap' END AS lane_reason FROM s WHERE ordinal >= 0), {RESETS},
dg AS (SELECT rs.source_id, status, lane_reason, section, reset_reason, cents % 4 <> 0 AS recorded FROM rs JOIN st ON st.source_id = rs.source_id AND st.ordinal = rs.ordinal)"""


def lane_facts(read) -> DataFrame:
    rows = lane_rows(read).select("source_id", "ordinal", "pts", "lane", "interior", F.lit("outside_lane_section").alias("why"))
    states = lanes_fold.lane_states(rows, 3 * DAY, HOUR).withColumnRenamed("reason", "lane_reason")
    told = reset_rows(read).select("source_id", "ordinal", F.col("reason").alias("section_reason"), "reset_reason", (F.col("cents") % 4 != 0).alias("recorded"))
    return states.join(told, ["source_id", "ordinal"])


@query(f"""{DIAGNOSED} SELECT source_id, count(*) AS input_rows, count(*) FILTER (WHERE NOT recorded) AS legacy_rows, count(*) FILTER (WHERE recorded AND section IS NULL) AS section_ready_rows, count(*) FILTER (WHERE recorded AND section IS NOT NULL) AS section_unknown_rows,
count(*) FILTER (WHERE status = 'unknown') AS lane_unknown_rows, count(reset_reason) AS source_resets, count(*) FILTER (WHERE status = 'candidate') AS candidate_count FROM dg GROUP BY source_id""")
def lane_diagnostics(read):
    return diagnostics.lane_counts(lane_facts(read))


@query(f"""{DIAGNOSED}, lg AS (SELECT source_id, 'section' AS channel, section AS reason FROM dg UNION ALL SELECT source_id, 'lane', lane_reason FROM dg UNION ALL SELECT source_id, 'source_reset', reset_reason FROM dg) SELECT source_id, channel, reason, count(*) AS n FROM lg WHERE reason IS NOT NULL GROUP BY ALL""")
def lane_reason_counts(read):
    return diagnostics.reason_counts(lane_facts(read), {"section": "section_reason", "lane": "lane_reason", "source_reset": "reset_reason"})


@query(f"""WITH {FRAMES}, b AS (SELECT source_id, ordinal, ticks AS a, ticks + 3 AS b, CASE WHEN cents % 5 = 1 THEN ticks + 9 ELSE ticks + 5 END AS c, ticks + 6 AS d, CASE WHEN cents % 5 = 2 THEN ticks + 7 ELSE ticks + 8 END AS e, CASE WHEN cents % 5 = 3 THEN ticks ELSE ticks + 9 END AS f FROM t)
SELECT source_id, ordinal, CASE WHEN a > b THEN 'a, b out of order' WHEN c > d OR a > c OR b > d THEN 'c, d out of order' WHEN e > f OR c > e OR d > f THEN 'e, f out of order' END AS problem FROM b""")
def candidate_chronology(read):
    k, t = F.col("cents") % 5, F.col("ticks")
    brackets = ticked(read).withColumns({"a": t, "b": t + 3, "c": F.when(k == 1, t + 9).otherwise(t + 5), "d": t + 6, "e": F.when(k == 2, t + 7).otherwise(t + 8), "f": F.when(k == 3, t).otherwise(t + 9)})
    return brackets.select("source_id", "ordinal", audit.bracket_problem(["a", "b", "c", "d", "e", "f"]).alias("problem"))


# --- pixels


def pictures(read) -> DataFrame:
    """Rasters of 12 x 8 whose upper half has one brightness and whose lower half has another."""
    half = lambda c: F.unhex(F.repeat(F.lpad(F.hex(c.cast("long")), 2, "0"), 12 * 4 * 3))
    return ticked(read).withColumns({"width": F.lit(12), "height": F.lit(8), "bgr": F.concat(half(F.col("cents") % 256), half(F.col("cents") % 101))})


@query(f"""WITH {FRAMES}, p AS (SELECT source_id, ordinal, cents % 256 AS a, cents % 101 AS b, cents % 4 AS dx, cents % 9 = 0 AS hid FROM t), q AS (SELECT *, CAST(floor(dx + 5.5) - ceil(dx + 0.5) AS BIGINT) AS w FROM p)
SELECT source_id, ordinal, CASE WHEN hid THEN 'occluded' WHEN w * 5 < 25 THEN 'too_small' ELSE 'usable' END AS status, CASE WHEN NOT hid AND w * 5 >= 25 THEN w * 3 * (2 * a + 3 * b) END AS total, CASE WHEN NOT hid AND w * 5 >= 25 THEN w * 5 * 3 END AS samples FROM q WHERE ordinal >= 3 AND ordinal < 40""")
def roi_brightness(read):
    window = replay.pixel_window(pictures(read), 3, 37)
    x = F.col("cents") % 4
    sided = window.withColumns({"left_x1": x + 0.5, "left_y1": F.lit(1.75), "left_x2": x + 5.5, "left_y2": F.lit(7.25), "left_status": F.when(F.col("cents") % 9 == 0, "occluded").otherwise("usable")})
    return replay.brightness(sided, "left", 25).select("source_id", "ordinal", "status", "total", "samples")


# --- codecs


ROW_FAULTS = {1: ".frame: keys", 2: ".frame.time_base: ratio", 3: "not strict JSON", 4: "not canonical", 5: ".vehicle.identity: size", 6: ".left.status: value", 7: ".frame.ordinal: int"}


@query(f"WITH {FRAMES} SELECT source_id, ordinal, CASE cents % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ROW_FAULTS.items()) + " END AS problem FROM t")
def row_codec(read):
    """Recorded rows as documents, with a fault for some remainders of cents."""
    k = F.col("cents") % 12
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    frame = text('{"coded_size":[96,64],"first_pts":0,"ordinal":', F.when(k == 7, F.concat("ordinal", F.lit(".5"))).otherwise(F.col("ordinal").cast("string")), ',"pts":', F.col("ticks"), ',"rotation":0,"source_id":"s', F.col("source_id"),
                 '","stream_index":0,"time_base":"', F.when(k == 2, "2/2000000").otherwise("1/1000000"), '"', F.when(k == 1, ',"zeta":1').otherwise(""), "}")
    vehicle = text('{"box":[1,2,30,40],"class_id":2,"identity":', F.when(k == 5, "[1,2]").otherwise("[1,2,1]"), ',"index":0,"model_id":"m:1","score":0.9}')
    side = lambda status: text('{"box":null,"status":"', status, '"}')
    body = text('{"frame":', frame, ',"lanes":null,"left":', side(F.when(k == 6, "dark").otherwise("occluded")), F.when(k == 4, " ").otherwise(""), F.when(k == 3, ',"lanes":null').otherwise(""), ',"right":', side(F.lit("too_small")), ',"vehicle":', F.when(k == 8, "null").otherwise(vehicle), "}")
    return ticked(read).withColumn("text", body).select("source_id", "ordinal", codecs.document_problem("text", codecs.ROW).alias("problem"))


@query("SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN '.points: size' WHEN 2 THEN '.points[7]: size' WHEN 3 THEN '.exists[0]: bool' END AS slot_problem, CASE vec_id % 5 WHEN 4 THEN '.visible: size' END AS binding_problem FROM embeddings")
def lane_evidence_codec(read):
    """A lane slot and a binding out of each vector, some with a point, a flag or a length that is wrong."""
    k = F.col("vec_id") % 5
    list_ = lambda n, body: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), body), ","), F.lit("]"))
    point = lambda i: F.when((k == 2) & (i == 7), "[1]").when(i % 9 == 0, "null").otherwise(F.concat(F.lit("["), i.cast("string"), F.lit(","), (i * 2).cast("string"), F.lit("]")))
    flag = lambda i: F.when((k == 3) & (i == 0), "1").when(i % 4 == 0, "false").otherwise("true")
    slot = F.concat(F.lit('{"axis":"row","exists":'), list_(F.lit(72), flag), F.lit(',"points":'), list_(F.when(k == 1, 71).otherwise(72), point), F.lit(',"slot":1}'))
    binding = F.concat(F.lit('{"boundary_id":"b1","slot":1,"visible":'), list_(F.when(k == 4, 72).otherwise(71), lambda i: F.lit("true")), F.lit("}"))
    rows = read("embeddings").select("vec_id", slot.alias("slot"), binding.alias("binding"))
    return rows.select("vec_id", codecs.document_problem("slot", codecs.lane_slot("row")).alias("slot_problem"), codecs.document_problem("binding", codecs.lane_binding("row")).alias("binding_problem"))


LAMP_FAULTS = {1: ".observation.rotation: value", 2: ".observation.left.visibility: value", 3: ".observation.crop: size", 5: ".observation.right: keys"}


@query(f"WITH {FRAMES} SELECT source_id, ordinal, CASE cents % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LAMP_FAULTS.items()) + " END AS problem FROM t")
def lamp_evidence_codec(read):
    k = F.col("cents") % 8
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    part = lambda side, seen, more: text('{"box":null,"confirmed":true,"part_id":"', side, '"', more, ',"side":"', side, '","visibility":"', seen, '"}')
    body = text('{"observation":{"canvas":[64,32],"context_id":"c","crop":', F.when(k == 3, "[1,2,3]").otherwise("[1,2,3,4]"), ',"identity_confirmed":true,"left":', part("left", F.when(k == 2, "dim").otherwise("visible"), ""),
                ',"model_id":"m","rear_view":true,"right":', part("right", "unknown", F.when(k == 5, ',"q":0').otherwise("")), ',"rotation":', F.when(k == 1, "45").otherwise("90"), ',"sides_confirmed":false}}')
    whole = F.when(k == 4, '{"observation":null}').otherwise(body)
    return ticked(read).withColumn("text", whole).select("source_id", "ordinal", codecs.document_problem("text", codecs.LAMPS).alias("problem"))


@query(f"WITH {FRAMES} SELECT source_id, ordinal, CASE cents % 6 WHEN 1 THEN '.direction: value' WHEN 2 THEN '.start: size' WHEN 3 THEN 'not canonical' END AS problem FROM t")
def candidate_codec(read):
    k = F.col("cents") % 6
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    o = F.col("ordinal").cast("string")
    body = text('{"candidate":', o, ',"completion":[', o, ",", o, '],"crossing":[', o, ",", o, '],"direction":"', F.when(k == 1, "up").otherwise("left"), '","from_lane":', F.when(k == 3, "01").otherwise("1"), ',"start":[', o, F.when(k == 2, "").otherwise(F.concat(F.lit(","), o)), '],"to_lane":0}')
    body = F.when(k == 3, F.replace(body, F.lit('"from_lane":01'), F.lit('"from_lane": 1'))).otherwise(body)
    return ticked(read).withColumn("text", body).select("source_id", "ordinal", codecs.document_problem("text", codecs.CANDIDATE).alias("problem"))


# --- clips and bundles


@query(f"""WITH {FRAMES}, w AS (SELECT source_id, ordinal AS candidate, greatest(ticks - {DAY}, 0) AS a, ticks + {DAY} AS b FROM t WHERE event_type = 'signup' AND ordinal < 30), m AS (SELECT w.source_id, candidate, t.ordinal, pts, cents FROM w JOIN t ON t.source_id = w.source_id AND t.ticks >= a AND t.ticks < b)
SELECT source_id, candidate, ordinal, pts, ordinal - min(ordinal) OVER (PARTITION BY source_id, candidate) AS "index", pts - min(pts) OVER (PARTITION BY source_id, candidate) AS clip_pts, cents AS duration FROM m""")
def clip_mapping(read):
    rows = ticked(read).withColumn("duration", F.col("cents"))
    windows = rows.where("event_type = 'signup' and ordinal < 30").select("source_id", F.col("ordinal").alias("candidate"), F.greatest(F.col("ticks") - DAY, F.lit(0)).alias("start"), (F.col("ticks") + DAY).alias("end"))
    return sinks.clip_mapping(rows.select("source_id", "ordinal", "pts", "ticks", "duration"), windows, ["source_id", "candidate"])


@query("SELECT r_regionkey, r_name FROM region")
def bounded_take(read):
    return sinks.bounded(read("region").select("r_regionkey", "r_name"), 64)


@query("""WITH s AS (SELECT unnest([0, 1, 2]) AS position, unnest([4, 0, 2]) AS k) SELECT position, 'candidates/' || printf('%06d', position) || '.json' AS file, sha256('{"candidate":' || r_regionkey || ',"name":"' || r_name || '"}' || chr(10)) AS sha256 FROM region JOIN s ON s.k = r_regionkey""")
def replay_bundle(read):
    """Chosen rows written as a bundle in the caller's order, and its receipts read back."""
    rows = read("region").select(F.col("r_regionkey").alias("candidate"), F.col("r_name").alias("name"))
    picked = sinks.chosen(rows, [4, 0, 2]).withColumn("text", receipts.canonical_json(F.to_json(F.struct("candidate", "name"))))
    spark = rows.sparkSession
    target = shared_folder(spark, "bundle").removeprefix("file:").replace("///", "/")
    found = sinks.export_bundle(picked, target)
    if sinks.folder_problems(target):
        raise ValueError("a bundle differs from its manifest")
    return spark.createDataFrame([(k, name, found[name]) for k, name in enumerate(sorted(found))], "position int, file string, sha256 string")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 20 AS x, l_suppkey % 10 AS y, 3 + CAST(l_quantity AS BIGINT) % 9 AS w, 3 + l_linenumber AS h FROM lineitem WHERE l_orderkey % 50 = 0)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 2 WHEN 0 THEN 2 * w + 2 * h - 4 ELSE 2 * w + 2 * h - 4 + CASE WHEN w > 4 AND h > 4 THEN CASE WHEN w - 4 = 1 THEN h - 4 WHEN h - 4 = 1 THEN w - 4 ELSE 2 * (w - 4) + 2 * (h - 4) - 4 END ELSE 0 END END AS pixels FROM b""")
def overlay_pixels(read):
    """How many pixels the outlines of boxes have: a plain one, and a double one."""
    @F.pandas_udf("long")
    def drawn(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, style: pd.Series) -> pd.Series:
        return pd.Series([int(sinks.outline(48, 32, (a, b, a + c, b + d), s).sum()) for a, b, c, d, s in zip(x, y, w, h, style)])

    rows = read("lineitem").where("l_orderkey % 50 = 0")
    style = F.when(F.col("l_linenumber") % 2 == 0, "observed").otherwise("ambiguous")
    return rows.select("l_orderkey", "l_linenumber", drawn(F.col("l_partkey") % 20, F.col("l_suppkey") % 10, 3 + F.col("l_quantity").cast("long") % 9, 3 + F.col("l_linenumber"), style).alias("pixels"))


# --- capture


class Scripted:
    """A detector of one box, whose place is in the picture's first byte; every picture whose last byte is a multiple of 11 has none."""

    model_id = "scripted:1"

    def detect(self, frame: dict, bgr: bytes) -> list[dict]:
        if bgr[-1] % 11 == 0:
            return []
        x = float(bgr[0] % 5)
        return [{"source_id": frame["source_id"], "ordinal": frame["ordinal"], "index": 3, "class_id": 2, "box": (x, 1.0, x + 6.0, 7.0), "score": 0.9, "model_id": self.model_id}]


CAPTURED = tracking.Policy(max_gap=10 * DAY, max_unobserved=400 * DAY, min_iou=0.05, ticks_per_second=DAY, measurement=(1e-3,) * 4, spectral=(1e-6,) * 4, velocity_variance=(1e-6,) * 4)


@query(f"""WITH {FRAMES}, b AS (SELECT *, coalesce(pts - lag(pts) OVER (PARTITION BY source_id ORDER BY ordinal) > {10 * DAY}, true) AS brk FROM t), s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY source_id ORDER BY ordinal) AS segment FROM b),
fx AS (SELECT *, CASE WHEN segment = 1 AND cents % 101 % 11 <> 0 THEN cents % 256 % 5 END AS x FROM s) SELECT source_id, ordinal, CASE WHEN x IS NOT NULL THEN 3 END AS det_index, CAST(x AS DOUBLE) AS x1, x IS NOT NULL AS observed, CASE WHEN x IS NULL THEN 'identity_uncertain' WHEN x < 2 THEN 'occluded' ELSE 'usable' END AS left_status FROM fx""")
def capture_rows(read):
    """Pictures through a detector, the tracker and a gate; the first track of each source's first segment is followed."""

    def gates(part: pd.DataFrame) -> pd.DataFrame:
        status = ["identity_uncertain" if pd.isna(x) else "occluded" if x < 2 else "usable" for x in part["x1"]]
        return part.assign(left_status=status)

    frames = pictures(read).select("source_id", "ordinal", "pts", "width", "height", "bgr")
    asked = frames.select("source_id").distinct().select("source_id", F.lit(1).alias("segment"), F.lit(2).alias("class_id"), F.lit(1).alias("track_id"))
    return capture.capture(frames, Scripted, CAPTURED, asked, gates, "left_status string").select("source_id", "ordinal", "det_index", "x1", "observed", "left_status")


@query(f"""WITH {FRAMES}, m AS (SELECT *, source_id % 2 = 0 AS fresh FROM t) SELECT source_id, ordinal, CASE WHEN fresh THEN CASE WHEN cents % 7 <> 0 THEN cents % 4 END ELSE cents % 3 END AS lane FROM m""")
def lanes_by_mode(read):
    """Runs of even sources have evidence, of which some frames give no lane; the others have recorded lanes alone."""
    rows = ticked(read).select("source_id", "ordinal", "cents", (F.col("cents") % 3).alias("lane"), F.when(F.col("source_id") % 2 == 0, "e").alias("evidence"))
    sections = rows.where("source_id % 2 = 0 and cents % 7 <> 0").select("source_id", "ordinal", (F.col("cents") % 4).alias("lane"))
    return replay.lanes_by_mode(rows, sections).select("source_id", "ordinal", "lane")


@query(f"WITH {FRAMES} SELECT source_id, ordinal, event_id FROM t WHERE cents % 3 = 0")
def recorded_observer(read):
    state = F.when(F.col("cents") % 3 == 0, "observed").otherwise("prediction_only")
    return replay.observer(ticked(read).withColumn("state", state)).select("source_id", "ordinal", "event_id")


@query(f"""WITH {FRAMES}, g AS (SELECT source_id, max(ticks) + 1000 AS total, min(ordinal) FILTER (WHERE ticks >= {5 * DAY} AND ticks < {9 * DAY}) AS first, count(*) FILTER (WHERE ticks >= {5 * DAY} AND ticks < {9 * DAY}) AS n FROM t GROUP BY source_id),
p AS (SELECT *, CASE WHEN total < {9 * DAY} THEN 'outside of the timeline' WHEN n = 0 THEN 'no frame begins in it' WHEN n > 12 THEN 'too many frames' END AS problem FROM g)
SELECT source_id, CASE WHEN problem IS NULL THEN first END AS first, CASE WHEN problem IS NULL THEN n END AS count, problem FROM p""")
def prepared_windows(read):
    return timeline.prepared(ticked(read).drop("ticks").withColumn("duration", F.lit(1000).cast("long")), 5 * DAY, 9 * DAY, 12)

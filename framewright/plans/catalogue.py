"""The queries of the observation operators over the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators import association, audit, boundaries, diagnostics, evaluation, geometry, lamps, lanes, lanes_fold, planning, receipts, replay, sinks, timeline, tracking
from ..sources.frames import by_source, frames
from ..session import shared_folder
from ..sources.inputs import closed_shape
from ..streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
GAP, DAY = 12 * HOUR, 24 * HOUR

FRAMES = """
f AS (SELECT user_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal, epoch_us(ts) AS pts, event_id, event_type,
             CAST(round(value * 100) AS BIGINT) AS cents FROM events),
t AS (SELECT *, pts - min(pts) OVER (PARTITION BY source_id) AS ticks FROM f)"""


def query(sql: str | None = None):
    """Register a function of (read) as a query, with its SQL."""

    def add(function):
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return function

    return add


def ticked(read) -> DataFrame:
    return timeline.normalised(frames(read("events")))


# --- timelines


@query(f"WITH {FRAMES} SELECT source_id, ordinal, ticks FROM t")
def timeline_normalised(read):
    return ticked(read).select("source_id", "ordinal", "ticks")


@query(f"WITH {FRAMES} SELECT source_id, count(*) AS n_frames, min(pts) AS origin, max(pts) + 1 AS stream_end FROM t GROUP BY source_id")
def timeline_extent(read):
    return timeline.extent(frames(read("events")))


@query(f"""WITH {FRAMES}, d AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1000 END AS given, max(pts) OVER (PARTITION BY source_id) + 1 AS stream_end FROM t)
SELECT source_id, ordinal, coalesce(nullif(given, 0), lead(pts) OVER (PARTITION BY source_id ORDER BY ordinal) - pts, stream_end - pts) AS duration FROM d""")
def duration_inference(read):
    given = frames(read("events")).withColumn("duration", F.when(F.col("event_id") % 3 == 0, 0).otherwise(1000).cast("long")).withColumn("stream_end", F.max("pts").over(Window.partitionBy("source_id")) + 1)
    return timeline.with_durations(given, F.col("stream_end")).select("source_id", "ordinal", "duration")


@query(f"WITH {FRAMES} SELECT source_id, ordinal, ticks FROM t WHERE ticks >= {DAY} AND ticks < {9 * DAY}")
def frame_range_select(read):
    return timeline.select_range(frames(read("events")), DAY, 9 * DAY).select("source_id", "ordinal", "ticks")


@query(f"WITH {FRAMES} SELECT source_id, min(CASE WHEN ticks >= {3 * DAY} THEN ordinal END) AS first_ordinal FROM t GROUP BY source_id")
def lower_bound(read):
    return timeline.lower_bound(frames(read("events")), 3 * DAY)


@query(f"""WITH {FRAMES}, b AS (SELECT *, cents * 1000000 AS length FROM t), m AS (SELECT *, coalesce(lag(ticks + length) OVER (PARTITION BY source_id ORDER BY ordinal) > ticks, false) AS ovl FROM b)
SELECT source_id, count(*) AS n_blocks, min(greatest(ticks, {2 * DAY})) AS first_tick, max(least(ticks + length, {8 * DAY})) AS end_tick,
       CAST(sum(least(ticks + length, {8 * DAY}) - greatest(ticks, {2 * DAY})) AS BIGINT) AS covered, count(*) FILTER (WHERE ovl) AS overlaps
FROM m WHERE ticks < {8 * DAY} AND ticks + length > {2 * DAY} GROUP BY source_id""")
def interval_clip_agg(read):
    return timeline.clipped_windows(ticked(read).withColumn("length", F.col("cents") * 1_000_000), 2 * DAY, 8 * DAY)


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 1001) // 30 AS whole, (l_partkey * 1001) % 30 AS rest FROM lineitem")
def tick_shift(read):
    whole, rest = timeline.shifted(F.col("l_partkey"), 1001, 30)
    return read("lineitem").select("l_orderkey", "l_linenumber", whole.alias("whole"), rest.alias("rest"))


# --- breaks

REASONS = f"""r AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL THEN 'start' WHEN event_type = 'error' AND lag(event_type) OVER w <> 'error' OR event_type <> 'error' AND lag(event_type) OVER w = 'error' THEN 'source_or_geometry_change'
 WHEN pts - lag(pts) OVER w > {GAP} THEN 'time_gap' END AS reason FROM t WINDOW w AS (PARTITION BY source_id ORDER BY ordinal))"""


def broken(read) -> DataFrame:
    return boundaries.reasons(ticked(read), GAP, F.col("event_type") == "error")


@query(f"WITH {FRAMES}, {REASONS} SELECT source_id, ordinal, reason FROM r")
def boundary_reasons(read):
    return broken(read).select("source_id", "ordinal", "reason")


@query(f"""WITH {FRAMES}, {REASONS}, s AS (SELECT *, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ordinal) AS segment FROM r)
SELECT source_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_frames, min(ordinal) AS first_ordinal, max(ticks) - min(ticks) AS length FROM s GROUP BY source_id, segment""")
def gap_sessions(read):
    cut = boundaries.segments(ticked(read), GAP, F.col("event_type") == "error")
    return cut.groupBy("source_id", "segment").agg(F.count(F.lit(1)).alias("n_frames"), F.min("ordinal").alias("first_ordinal"), (F.max("ticks") - F.min("ticks")).alias("length"))


@query("SELECT conv_id, turn, coalesce(turn <> lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, turn <> 0) AS gap FROM conversations")
def turn_gap_audit(read):
    last = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return read("conversations").select("conv_id", "turn", F.coalesce(F.col("turn") != last + 1, F.col("turn") != 0).alias("gap"))


@query(f"""WITH {FRAMES}, k AS (SELECT *, ordinal = 0 OR event_type <> lag(event_type) OVER (PARTITION BY source_id ORDER BY ordinal) AS is_reset FROM t)
SELECT source_id, ordinal, is_reset, max(CASE WHEN is_reset THEN ordinal END) OVER (PARTITION BY source_id ORDER BY ordinal) AS floor FROM k""")
def source_reset_floor(read):
    return boundaries.reset_floor(frames(read("events")), F.col("event_type")).select("source_id", "ordinal", "is_reset", "floor")


# --- geometry

BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_partkey % 1200 - 100 AS x1, l_suppkey % 700 - 50 AS y1, l_partkey % 1200 - 100 + CAST(l_quantity AS BIGINT) * 4 AS x2, l_suppkey % 700 - 50 + l_linenumber * 20 AS y2 FROM lineitem)"


def line_boxes(read) -> DataFrame:
    x, y = F.col("l_partkey") % 1200 - 100, F.col("l_suppkey") % 700 - 50
    return read("lineitem").select("l_orderkey", "l_linenumber", x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity").cast("long") * 4).alias("x2"), (y + F.col("l_linenumber") * 20).alias("y2"))


@query(f"""WITH {BOXES}, c AS (SELECT l_orderkey, l_linenumber, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 1024) AS x2, least(y2, 576) AS y2 FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN x1 < x2 AND y1 < y2 THEN (x2 - x1) * (y2 - y1) END AS area FROM c""")
def box_clip_area(read):
    inside = geometry.clip({c: F.col(c) for c in geometry.BOX}, F.lit(1024), F.lit(576))
    return line_boxes(read).withColumns(inside).select("l_orderkey", "l_linenumber", geometry.area().alias("area"))


IOU = """greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"""
UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU})"


@query(f"""WITH p AS (SELECT p_brand, p_partkey AS idx, p_partkey * 37 % 500 AS x1, p_partkey * 53 % 300 AS y1, p_partkey * 37 % 500 + 40 + p_size AS x2, p_partkey * 53 % 300 + 60 AS y2 FROM part)
SELECT a.p_brand, a.idx AS a_idx, b.idx AS b_idx FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.idx < b.idx WHERE {IOU} * 10 >= {UNION} * 3""")
def iou_pairs(read):
    x, y = F.col("p_partkey") * 37 % 500, F.col("p_partkey") * 53 % 300
    boxes = read("part").select("p_brand", F.col("p_partkey").alias("idx"), x.alias("x1"), y.alias("y1"), (x + 40 + F.col("p_size")).alias("x2"), (y + 60).alias("y2"))
    return geometry.pairs_of_class(boxes, ["p_brand"], 3, 10).select("p_brand", "a_idx", "b_idx")


EDGES = f"""{FRAMES}, a AS (SELECT source_id, ticks // {DAY} AS day, ordinal AS track_id, cents % 400 AS x1, cents % 200 AS y1, cents % 400 + 60 AS x2, cents % 200 + 50 AS y2 FROM t WHERE event_type IN ('view', 'click')),
b AS (SELECT source_id, ticks // {DAY} AS day, ordinal AS det_index, cents % 400 AS x1, cents % 200 AS y1, cents % 400 + 60 AS x2, cents % 200 + 50 AS y2 FROM t WHERE event_type IN ('purchase', 'signup', 'error')),
e AS (SELECT a.source_id, a.day, track_id, det_index FROM a JOIN b ON a.source_id = b.source_id AND a.day = b.day WHERE {IOU} * 10 >= {UNION}),
g AS (SELECT *, count(*) OVER (PARTITION BY source_id, day, track_id) AS td, count(*) OVER (PARTITION BY source_id, day, det_index) AS dd FROM e)"""


def event_edges(read) -> DataFrame:
    x, y = F.col("cents") % 400, F.col("cents") % 200
    boxes = ticked(read).withColumn("day", F.floor(F.col("ticks") / DAY)).withColumns({"x1": x, "y1": y, "x2": x + 60, "y2": y + 50})
    side = F.col("event_type").isin("view", "click")
    return association.edges(boxes.where(side).withColumnRenamed("ordinal", "track_id"), boxes.where(~side).withColumnRenamed("ordinal", "det_index"), ["source_id", "day"], 1, 10)


@query(f"WITH {EDGES} SELECT source_id, day, track_id, det_index FROM g WHERE td = 1 AND dd = 1")
def unique_association(read):
    return association.unique(event_edges(read), ["source_id", "day"]).select("source_id", "day", "track_id", "det_index")


@query(f"WITH {EDGES} SELECT source_id, day, track_id, det_index FROM g WHERE td > 1 OR dd > 1")
def ambiguity_rows(read):
    return association.ambiguous(event_edges(read), ["source_id", "day"]).select("source_id", "day", "track_id", "det_index")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 200 + l_partkey % 800 AS w, 150 + l_suppkey % 500 AS h, l_quantity * 16 AS v FROM lineitem),
r AS (SELECT *, least(640, w * 384 // h) AS rw, least(384, h * 640 // w) AS rh FROM s)
SELECT l_orderkey, l_linenumber, rw, rh, round(least(greatest(v, 0), rw) * w / rw, 6) AS x FROM r""")
def letterbox_inverse(read):
    sized = read("lineitem").select("l_orderkey", "l_linenumber", (F.lit(200) + F.col("l_partkey") % 800).alias("w"), (F.lit(150) + F.col("l_suppkey") % 500).alias("h"), (F.col("l_quantity") * 16).alias("v"))
    rw, rh = geometry.letterbox(F.col("w"), F.col("h"), 640, 384)
    fitted = sized.withColumns({"rw": rw, "rh": rh})
    return fitted.select("l_orderkey", "l_linenumber", "rw", "rh", F.round(geometry.from_letterbox(F.col("v"), F.col("rw"), F.col("w")), 6).alias("x"))


@query("""WITH r AS (SELECT vec_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS det_index, embedding FROM embeddings),
s AS (SELECT vec_id, det_index, CAST(embedding[det_index * 7 + 5] AS DOUBLE) AS o, CAST(embedding[det_index * 7 + 6] AS DOUBLE) AS c, CAST(floor(abs(CAST(embedding[det_index * 7 + 7] AS DOUBLE)) * 40) AS INTEGER) AS class_id FROM r)
SELECT vec_id, det_index, class_id, round(o * c, 9) AS score FROM s WHERE class_id IN (2, 5, 7)""")
def post_nms_filter(read):
    value = lambda k, j: F.get("embedding", F.lit(k * 7 + j)).cast("double")
    rows = F.array(*[F.array(*[value(k, j) for j in range(6)], F.floor(F.abs(value(k, 6)) * 40).cast("double")) for k in range(9)])
    kept = geometry.post_nms(read("embeddings").select("vec_id", rows.alias("values")), [2, 5, 7])
    return kept.select("vec_id", "det_index", "class_id", F.round("score", 9).alias("score"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, (l_linenumber % 4) * 90 AS rot, l_partkey % 960 AS x, l_suppkey % 540 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE rot WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN 960 - x ELSE 960 - y END AS u, CASE rot WHEN 0 THEN y WHEN 90 THEN 540 - x WHEN 180 THEN 540 - y ELSE x END AS v FROM p""")
def rotation_inverse(read):
    u, v = geometry.unrotate((F.col("l_linenumber") % 4) * 90, F.col("l_partkey") % 960, F.col("l_suppkey") % 540, F.lit(960), F.lit(540))
    return read("lineitem").select("l_orderkey", "l_linenumber", u.alias("u"), v.alias("v"))


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(0, floor(x2) - ceil(x1)) * greatest(0, floor(y2) - ceil(y1)) AS BIGINT) AS pixels FROM
(SELECT l_orderkey, l_linenumber, l_tax * 100 AS x1, l_discount * 50 AS y1, l_tax * 100 + l_quantity / 3 AS x2, l_discount * 50 + l_quantity / 7 AS y2 FROM lineitem)""")
def roi_whole_pixels(read):
    x, y = F.col("l_tax") * 100, F.col("l_discount") * 50
    return read("lineitem").select("l_orderkey", "l_linenumber", geometry.whole_pixels(x, y, x + F.col("l_quantity") / 3, y + F.col("l_quantity") / 7).cast("long").alias("pixels"))


# --- lanes

LANE_X = [0, 5000, 10000, 15000]
LANES = f"""{FRAMES}, l AS (SELECT *, CASE WHEN cents % 17 <> 0 AND cents % 15000 > 0 THEN cents % 15000 // 5000 END AS lane, cents % 5000 BETWEEN 750 AND 4250 AS interior FROM t)"""


def lane_rows(read) -> DataFrame:
    x = F.col("cents") % 15000
    lane = F.when(F.col("cents") % 17 != 0, lanes.lane_of(x, F.array(*map(F.lit, LANE_X))))
    return ticked(read).withColumn("lane", lane).withColumn("interior", (F.col("cents") % 5000).between(750, 4250))


@query(f"WITH {LANES} SELECT source_id, ordinal, CAST(lane AS INTEGER) AS lane, interior FROM l")
def lane_index(read):
    return lane_rows(read).select("source_id", "ordinal", "lane", "interior")


#: One step a row: the state is carried from row to row by a recursive query over each source.
LANE_CHANGES = f"""WITH RECURSIVE {LANES}, r AS (SELECT source_id, ordinal, pts, lane, interior, coalesce(pts - lag(pts) OVER (PARTITION BY source_id ORDER BY ordinal) > {6 * DAY // 2}, true) AS brk FROM l),
s AS (
 SELECT source_id, CAST(-1 AS BIGINT) AS ordinal, CAST(NULL AS BIGINT) AS base, CAST(NULL AS BIGINT) AS stable, CAST(NULL AS BIGINT) AS pend, CAST(NULL AS BIGINT) AS po, CAST(NULL AS BIGINT) AS pt, false AS dep, CAST(NULL AS BIGINT) AS d0, CAST(NULL AS BIGINT) AS d1,
  false AS crs, CAST(NULL AS BIGINT) AS c0, CAST(NULL AS BIGINT) AS c1, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS prev, false AS hit, CAST(NULL AS BIGINT) AS ob, CAST(NULL AS BIGINT) AS nb, CAST(NULL AS BIGINT) AS e0 FROM (SELECT DISTINCT source_id FROM r)
 UNION ALL
 SELECT source_id, ordinal, base2, stable2, pend2, po2, pt2, dep2, d02, d12, crs2, c02, c12, last2, prev2, hit, ob, nb, e0 FROM (
  SELECT *, CASE WHEN act = 'none' THEN NULL WHEN act = 'settle' THEN lane ELSE base1 END AS base2, CASE WHEN act = 'none' THEN NULL WHEN act IN ('settle', 'stable') THEN ordinal ELSE stable1 END AS stable2,
   CASE WHEN act = 'wait' THEN lane END AS pend2, CASE WHEN act = 'wait' THEN so END AS po2, CASE WHEN act = 'wait' THEN st END AS pt2,
   CASE WHEN act IN ('wait', 'edge') THEN dep1 ELSE false END AS dep2, d01 AS d02, d11 AS d12, CASE WHEN act IN ('wait', 'edge') THEN crs1 ELSE false END AS crs2, c01 AS c02, c11 AS c12,
   CASE WHEN act = 'none' THEN NULL ELSE lane END AS last2, CASE WHEN act = 'none' THEN NULL ELSE ordinal END AS prev2, act = 'settle' AND base1 IS NOT NULL AND dep1 AND crs1 AS hit, base1 AS ob, lane AS nb, so AS e0 FROM (
   SELECT *, CASE WHEN lane IS NULL OR base1 IS NOT NULL AND abs(lane - base1) > 1 THEN 'none' WHEN NOT interior THEN 'edge' WHEN lane IS NOT DISTINCT FROM base1 THEN 'stable' WHEN pts - st < {HOUR} THEN 'wait' ELSE 'settle' END AS act FROM (
    SELECT *, CASE WHEN moved THEN true ELSE dep0 END AS dep1, CASE WHEN moved THEN stable1 ELSE d00 END AS d01, CASE WHEN moved THEN ordinal ELSE d10 END AS d11,
     CASE WHEN lane IS NOT DISTINCT FROM base1 THEN false ELSE crs0 OR crossed END AS crs1, CASE WHEN crossed THEN prev0 ELSE c00 END AS c01, CASE WHEN crossed THEN ordinal ELSE c10 END AS c11,
     CASE WHEN pend0 IS NULL OR pend0 <> lane THEN ordinal ELSE po0 END AS so, CASE WHEN pend0 IS NULL OR pend0 <> lane THEN pts ELSE pt0 END AS st FROM (
     SELECT *, base1 IS NOT NULL AND (lane <> base1 OR NOT interior) AND NOT dep0 AS moved, base1 IS NOT NULL AND lane <> base1 AND NOT crs0 AND last0 IS NOT DISTINCT FROM base1 AS crossed FROM (
      SELECT r.source_id, r.ordinal, r.pts, r.lane, r.interior, CASE WHEN fresh THEN NULL ELSE base END AS base1, CASE WHEN fresh THEN NULL ELSE stable END AS stable1, CASE WHEN fresh THEN NULL ELSE pend END AS pend0, CASE WHEN fresh THEN NULL ELSE po END AS po0, CASE WHEN fresh THEN NULL ELSE pt END AS pt0,
       CASE WHEN fresh THEN false ELSE dep END AS dep0, d0 AS d00, d1 AS d10, CASE WHEN fresh THEN false ELSE crs END AS crs0, c0 AS c00, c1 AS c10, CASE WHEN fresh THEN NULL ELSE last END AS last0, CASE WHEN fresh THEN NULL ELSE prev END AS prev0
      FROM (SELECT s.*, r.pts, r.lane, r.interior, r.ordinal AS o2, r.brk OR s.prev IS NULL AS fresh FROM s JOIN r ON r.source_id = s.source_id AND r.ordinal = s.ordinal + 1) q JOIN r ON r.source_id = q.source_id AND r.ordinal = q.o2)))))
)"""
CHANGES = "SELECT source_id, CASE WHEN nb > ob THEN 'right' ELSE 'left' END AS direction, CAST(ob AS INTEGER) AS from_lane, CAST(nb AS INTEGER) AS to_lane, d0 AS start_from, d1 AS start_to, c0 AS cross_from, c1 AS cross_to, e0 AS done_from, ordinal AS done_to FROM s WHERE hit"


def changes(read) -> DataFrame:
    return lanes.lane_changes(lane_rows(read).select("source_id", "ordinal", "pts", "lane", "interior"), 3 * DAY, HOUR)


@query(f"{LANE_CHANGES} {CHANGES}")
def lane_change_candidates(read):
    return changes(read)


@query(f"{LANE_CHANGES} SELECT direction, from_lane, count(*) AS n FROM ({CHANGES}) GROUP BY direction, from_lane")
def lane_direction_counts(read):
    return changes(read).groupBy("direction", "from_lane").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT *, list_position(v, list_max(v)) - 1 AS peak, list_max(v) AS top FROM e),
n AS (SELECT *, greatest(peak - 1, 0) AS a, least(peak + 2, len(v)) AS b FROM p), w AS (SELECT vec_id, peak, unnest(range(a, b)) AS k, v, top FROM n),
m AS (SELECT vec_id, peak, (sum(exp(v[k + 1] - top) * k) / sum(exp(v[k + 1] - top)) + 0.5) / 63 AS share FROM w GROUP BY vec_id, peak)
SELECT vec_id, CAST(peak AS INTEGER) AS peak, round(CASE WHEN share BETWEEN 0 AND 1 THEN share END, 9) AS share FROM m""")
def argmax_local_softmax(read):
    v = read("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", lanes.first_peak(F.col("v")).alias("peak"), F.round(lanes.local_softmax(F.col("v"), 64), 9).alias("share"))


@query("SELECT vec_id, CASE WHEN label % 2 = 0 THEN 2 * len(list_filter(embedding, lambda x: x > 0)) > len(embedding) ELSE 4 * len(list_filter(embedding, lambda x: x > 0)) > len(embedding) END AS passed FROM embeddings")
def support_gate(read):
    exists = F.transform("embedding", lambda x: x > 0)
    return read("embeddings").select("vec_id", lanes.supported(exists, F.when(F.col("label") % 2 == 0, "row").otherwise("column")).alias("passed"))


# --- lamps

LAMP = lamps.LampConfig(off=60, on=150, min_phase=2 * HOUR, max_phase=3 * DAY, min_cycles=1, min_window=HOUR)
LAMP_GAP = 5 * DAY // 2


def lamp_rows(read) -> DataFrame:
    """Both sides' samples of each frame; identities change every 40 frames, and some frames have no observation or an uncertain one."""
    status = lambda k: F.when(F.col("cents") % (97 + k) == 0, "identity_uncertain").when(F.col("cents") % (28 + k) == 0, "occluded").when(F.col("cents") % (30 + k) == 0, "too_small").otherwise("usable")
    rows = ticked(read).withColumns({"observed": F.col("cents") % 41 != 0, "identity": F.floor(F.col("ordinal") / 40), "left_status": status(1), "right_status": status(3)})
    uncertain = (F.col("left_status") == "identity_uncertain") | (F.col("right_status") == "identity_uncertain")
    return rows.withColumns({"uncertain": uncertain, "left_brightness": F.col("cents") % 256, "right_brightness": F.col("cents") * 7 % 256})


def lamp_histories(read) -> DataFrame:
    return lamps.histories(lamp_rows(read), LAMP_GAP)


def side(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumns({"status": F.col(f"{name}_status"), "brightness": F.col(f"{name}_brightness")})


def lamp_windows(read) -> DataFrame:
    """For each source two windows, of which the later one mostly lies within the last history."""
    ends = ticked(read).groupBy("source_id").agg(F.max("ticks").alias("last"))
    spans = F.array(*[F.struct(F.lit(k).alias("window_id"), F.greatest(F.col("last") - a, F.lit(0)).alias("start"), F.greatest(F.col("last") - b, F.lit(2)).alias("end")) for k, a, b in ((0, 12 * DAY, 9 * DAY), (1, 5 * DAY, DAY // 2))])
    return ends.select("source_id", F.inline(spans))


HISTORY = f"""v AS (SELECT *, cents % 41 <> 0 AS observed, ordinal // 40 AS identity, CASE WHEN cents % 98 = 0 THEN 'identity_uncertain' WHEN cents % 29 = 0 THEN 'occluded' WHEN cents % 31 = 0 THEN 'too_small' ELSE 'usable' END AS left_status,
 CASE WHEN cents % 100 = 0 THEN 'identity_uncertain' WHEN cents % 31 = 0 THEN 'occluded' WHEN cents % 33 = 0 THEN 'too_small' ELSE 'usable' END AS right_status, cents % 256 AS left_brightness, cents * 7 % 256 AS right_brightness FROM t),
k AS (SELECT *, CASE WHEN NOT observed THEN 'no_actual_observation' WHEN 'identity_uncertain' IN (left_status, right_status) THEN 'identity_uncertain' WHEN NOT coalesce(lag(observed) OVER o, false) THEN 'start'
 WHEN pts - lag(pts) OVER o > {LAMP_GAP} THEN 'time_gap' WHEN identity <> lag(identity) OVER o THEN 'identity_or_model_change' END AS why FROM v WINDOW o AS (PARTITION BY source_id ORDER BY ordinal)),
i AS (SELECT *, sum(CASE WHEN why IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY ordinal) AS history FROM k),
j AS (SELECT * FROM (SELECT *, max(history) OVER (PARTITION BY source_id) AS newest, row_number() OVER (PARTITION BY source_id ORDER BY ordinal DESC) AS back FROM i) WHERE history = newest AND observed AND back <= 120)"""


def phase_sql(source: str, keys: str, name: str) -> str:
    """Phases, changes and cycles of samples with status and brightness."""
    return f"""u{name} AS (SELECT *, sum(CASE WHEN status = 'usable' THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY ordinal) AS run FROM {source}),
h{name} AS (SELECT *, last_value(CASE WHEN brightness >= 150 THEN 'on' WHEN brightness <= 60 THEN 'off' END IGNORE NULLS) OVER (PARTITION BY {keys}, run ORDER BY ordinal) AS phase FROM u{name} WHERE status = 'usable'),
p{name} AS (SELECT *, coalesce(lag(phase) OVER (PARTITION BY {keys}, run ORDER BY ordinal) <> phase, false) AS changes FROM h{name}),
y{name} AS (SELECT {keys}, on_at, off_at, ticks AS end_at, off_at - on_at AS lit, ticks - off_at AS dark FROM (SELECT *, lag(ticks) OVER w AS off_at, lag(ticks, 2) OVER w AS on_at FROM p{name} WHERE changes WINDOW w AS (PARTITION BY {keys}, run ORDER BY ordinal)) WHERE phase = 'on' AND on_at IS NOT NULL)"""


LEFT = f"{HISTORY}, a AS (SELECT source_id, history, ordinal, ticks, left_status AS status, left_brightness AS brightness FROM i WHERE observed), {phase_sql('a', 'source_id, history', '')}"
SPANS = f"""n AS (SELECT source_id, max(ticks) AS last FROM t GROUP BY source_id), q AS (SELECT source_id, 0 AS window_id, greatest(last - {12 * DAY}, 0) AS a, greatest(last - {9 * DAY}, 2) AS b FROM n
 UNION ALL SELECT source_id, 1, greatest(last - {5 * DAY}, 0), greatest(last - {DAY // 2}, 2) FROM n)"""


def report_sql(name: str, samples: str = "j", windows: str = "q") -> str:
    """The report of one side over samples and windows(source_id, window_id, a, b)."""
    good = f"lit BETWEEN {LAMP.min_phase} AND {LAMP.max_phase} AND dark BETWEEN {LAMP.min_phase} AND {LAMP.max_phase}"
    keys = "source_id, window_id"
    return f"""b{name} AS (SELECT w.*, s.ordinal, s.ticks, s.{name}_status AS status, s.{name}_brightness AS brightness FROM {windows} w LEFT JOIN {samples} s USING (source_id)),
e{name} AS (SELECT *, max(CASE WHEN ticks <= a THEN ordinal END) OVER (PARTITION BY {keys}) AS bef, min(CASE WHEN ticks >= b THEN ordinal END) OVER (PARTITION BY {keys}) AS aft FROM b{name}),
s{name} AS (SELECT * FROM e{name} WHERE ordinal IS NULL OR (bef IS NULL OR ordinal >= bef) AND (aft IS NULL OR ordinal <= aft)),
{phase_sql(f's{name}', keys, name)},
z{name} AS (SELECT g.*, coalesce(nc, 0) AS n_cycles, coalesce(nc, 0) >= 1 AS blink, list_sort(list_distinct(list_filter(coalesce(st, []) || [CASE WHEN NOT br THEN 'insufficient_history' END, CASE WHEN unclear > 0 OR bad > 0 THEN 'model_uncertain' END, CASE WHEN chg > 0 AND coalesce(nc, 0) < 1 THEN 'insufficient_cycles' END], lambda x: x IS NOT NULL))) AS why
 FROM (SELECT {keys}, count(*) FILTER (WHERE status = 'usable') AS valid, bool_and(bef IS NOT NULL AND aft IS NOT NULL AND b - a >= {LAMP.min_window}) AS br, list(DISTINCT status) FILTER (WHERE status <> 'usable') AS st, count(ordinal) AS n_samples, min(ticks) AS first_tick, max(ticks) AS last_tick FROM s{name} GROUP BY ALL) g
 LEFT JOIN (SELECT {keys}, count(*) FILTER (WHERE phase IS NULL) AS unclear, count(*) FILTER (WHERE changes AND ticks >= a AND ticks <= b) AS chg FROM p{name} GROUP BY ALL) USING ({keys})
 LEFT JOIN (SELECT {keys}, count(*) FILTER (WHERE {good}) AS nc, count(*) FILTER (WHERE NOT ({good})) AS bad FROM y{name} JOIN {windows} USING ({keys}) WHERE on_at >= a AND end_at <= b GROUP BY ALL) USING ({keys})),
w{name} AS (SELECT {keys}, CASE WHEN len(why) > 0 THEN 'unknown' WHEN blink THEN 'blink_observed' ELSE 'no_blink_observed' END AS state, blink AS blink_evidence, n_cycles, array_to_string(why, ',') AS reasons, valid AS valid_samples, n_samples, first_tick, last_tick FROM z{name})"""


def reports(samples: DataFrame, windows: DataFrame) -> dict[str, DataFrame]:
    """The reports of both sides over samples of the last histories."""
    return {name: lamps.window_report(side(samples, name).select("source_id", "ordinal", "ticks", "status", "brightness"), windows, LAMP) for name in ("left", "right")}


SIGNAL = "CASE WHEN l.state = 'unknown' OR r.state = 'unknown' THEN 'unknown' WHEN l.blink_evidence AND r.blink_evidence THEN 'both_blink' WHEN l.blink_evidence THEN 'left_blink' WHEN r.blink_evidence THEN 'right_blink' ELSE 'no_blink_observed' END"


@query(f"WITH {FRAMES}, {HISTORY} SELECT source_id, ordinal, CAST(history AS BIGINT) AS history, first_value(why) OVER (PARTITION BY source_id, history ORDER BY ordinal) AS begun FROM i")
def lamp_history(read):
    return lamp_histories(read).select("source_id", "ordinal", "history", "begun")


@query(f"WITH {FRAMES}, {LEFT} SELECT source_id, ordinal, CAST(history AS BIGINT) AS history, CAST(run AS BIGINT) AS run, phase, changes FROM p")
def lamp_phases(read):
    return lamps.phases(side(lamp_histories(read).where("observed"), "left"), LAMP, ("source_id", "history")).select("source_id", "ordinal", "history", "run", "phase", "changes")


@query(f"WITH {FRAMES}, {LEFT} SELECT source_id, CAST(history AS BIGINT) AS history, on_at, off_at, end_at, lit, dark FROM y")
def lamp_cycles(read):
    keys = ("source_id", "history")
    return lamps.cycles(lamps.phases(side(lamp_histories(read).where("observed"), "left"), LAMP, keys), keys)


@query(f"WITH {FRAMES}, {HISTORY}, {SPANS}, {report_sql('left')} SELECT * FROM wleft")
def lamp_window_report(read):
    return reports(lamps.latest(lamp_histories(read)), lamp_windows(read))["left"]


@query(f"WITH {FRAMES}, {HISTORY}, {SPANS}, {report_sql('left')}, {report_sql('right')} SELECT source_id, window_id, {SIGNAL} AS signal FROM wleft l JOIN wright r USING (source_id, window_id)")
def signal_state(read):
    found = reports(lamps.latest(lamp_histories(read)), lamp_windows(read))
    left, right = (found[s].select("source_id", "window_id", F.col("state").alias(f"{s}_state"), F.col("blink_evidence").alias(f"{s}_blinks")) for s in ("left", "right"))
    return left.join(right, ["source_id", "window_id"]).select("source_id", "window_id", lamps.combined(*map(F.col, ("left_state", "right_state", "left_blinks", "right_blinks"))).alias("signal"))


def lamp_declarations(read) -> DataFrame:
    """Both sides' declared regions, and a source key that some rows lack."""
    box = lambda s, k: {f"{s}_x1": F.col("cents") % 50 + 0.5, f"{s}_y1": F.lit(2.25), f"{s}_x2": F.col("cents") % 50 + F.col("cents") % k + 1.0, f"{s}_y2": F.lit(6.75)}
    source = F.when(F.col("cents") % 23 != 0, F.concat(F.lit("key"), F.floor(F.col("ordinal") / 25)))
    return lamp_rows(read).withColumns({**box("left", 5), **box("right", 7), "source": source})


FACTS = f"""{HISTORY}, d AS (SELECT *, CASE WHEN cents % 23 <> 0 THEN 'key' || (ordinal // 25) END AS source, CAST(greatest(0, floor(cents % 50 + cents % 5 + 1.0) - ceil(cents % 50 + 0.5)) * 3 AS BIGINT) AS left_pixels,
 CAST(greatest(0, floor(cents % 50 + cents % 7 + 1.0) - ceil(cents % 50 + 0.5)) * 3 AS BIGINT) AS right_pixels FROM v),
m AS (SELECT *, CASE WHEN lag(ordinal) OVER o IS NULL THEN 'start' WHEN pts - lag(pts) OVER o > {LAMP_GAP} THEN 'time_gap' END AS clock_break, CASE WHEN source IS NULL THEN 'lamps_unknown' WHEN lag(source) OVER o <> source THEN 'lamp_source_change' END AS source_reset,
 lag(observed) OVER o AS seen, identity IS DISTINCT FROM lag(identity) OVER o AS moved, coalesce(ordinal - lag(ordinal) OVER o - 1, 0) AS missing, pts - lag(pts) OVER o AS elapsed FROM d WINDOW o AS (PARTITION BY source_id ORDER BY ordinal)),
x AS (SELECT *, list_sort(list_filter([clock_break, source_reset, CASE WHEN NOT observed THEN 'no_actual_observation' END, CASE WHEN observed AND NOT seen THEN 'actual_observation_resumed' END, CASE WHEN observed AND seen AND moved THEN 'identity_or_model_change' END,
 CASE WHEN 'identity_uncertain' IN (left_status, right_status) THEN 'identity_uncertain' END], lambda r: r IS NOT NULL)) AS breaks,
 CASE WHEN NOT observed THEN 'identity_uncertain' WHEN left_status = 'usable' AND left_pixels < 8 THEN 'too_small' ELSE left_status END AS left_geometry, CASE WHEN NOT observed THEN 'identity_uncertain' WHEN right_status = 'usable' AND right_pixels < 8 THEN 'too_small' ELSE right_status END AS right_geometry FROM m)"""


def lamp_facts(read) -> DataFrame:
    return diagnostics.lamp_facts(lamp_declarations(read), LAMP_GAP, 8)


@query(f"WITH {FRAMES}, {FACTS} SELECT source_id, ordinal, array_to_string(breaks, ',') AS breaks, left_geometry, left_pixels, right_geometry, right_pixels, missing, elapsed FROM x")
def lamp_row_facts(read):
    return lamp_facts(read).select("source_id", "ordinal", F.array_join("breaks", ",").alias("breaks"), "left_geometry", "left_pixels", "right_geometry", "right_pixels", "missing", "elapsed")


@query(f"""WITH {FRAMES}, {FACTS} SELECT source_id, count(*) AS input_rows, count(*) FILTER (WHERE source IS NULL) AS observation_unknown_rows, count(source_reset) AS source_resets, count(*) FILTER (WHERE clock_break = 'time_gap') AS gap_rows,
 count(*) FILTER (WHERE NOT observed) AS no_actual_rows FROM x GROUP BY source_id""")
def lamp_diagnostics(read):
    return diagnostics.lamp_counts(lamp_facts(read))


@query(f"""WITH {FRAMES}, {FACTS}, r AS (SELECT source_id, 'history_break' AS channel, unnest(breaks) AS reason FROM x UNION ALL SELECT source_id, 'source_reset', source_reset FROM x UNION ALL SELECT source_id, 'left', left_geometry FROM x UNION ALL SELECT source_id, 'right', right_geometry FROM x)
SELECT source_id, channel, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""")
def lamp_reason_counts(read):
    return diagnostics.reason_counts(lamp_facts(read), {"history_break": "breaks", "source_reset": "source_reset", "left": "left_geometry", "right": "right_geometry"})


# --- planning


CONTEXT = f"""c AS (SELECT source_id, ordinal AS candidate, CASE WHEN cents % 2 = 0 THEN 'left' ELSE 'right' END AS direction, ticks AS "start", ticks + {HOUR} AS "end" FROM t WHERE event_type = 'signup'), g AS (SELECT source_id, max(ticks) + {2 * HOUR} AS total FROM t GROUP BY source_id),
ask AS (SELECT c.*, greatest("start" - {DAY}, 0) AS lo, least("end" + {DAY}, total) AS hi FROM c JOIN g USING (source_id)), m AS (SELECT source_id, ticks, ticks + 60000000 AS stop FROM t WHERE event_type = 'view'),
ctx AS (SELECT *, least(lo, coalesce((SELECT max(m.ticks) FROM m WHERE m.source_id = ask.source_id AND m.ticks <= lo), lo)) AS context_from,
 greatest(hi, coalesce((SELECT min(m.stop) FROM m WHERE m.source_id = ask.source_id AND m.ticks >= hi), (SELECT max(m.stop) FROM m WHERE m.source_id = ask.source_id), hi)) AS context_to FROM ask)"""


def event_candidates(read) -> DataFrame:
    rows = ticked(read).where("event_type = 'signup'")
    return rows.select("source_id", F.col("ordinal").alias("candidate"), F.when(F.col("cents") % 2 == 0, "left").otherwise("right").alias("direction"), F.col("ticks").alias("start"), (F.col("ticks") + HOUR).alias("end"))


def event_contexts(read) -> DataFrame:
    rows = ticked(read)
    samples = rows.where("event_type = 'view'").select("source_id", "ticks", F.lit(60_000_000).alias("length"))
    lengths = rows.groupBy("source_id").agg((F.max("ticks") + 2 * HOUR).alias("stream_length"))
    return planning.context(event_candidates(read), samples, lengths, DAY, DAY)


@query(f"WITH {FRAMES}, {CONTEXT} SELECT source_id, candidate, lo AS requested_from, hi AS requested_to, context_from, context_to FROM ctx")
def candidate_context(read):
    return event_contexts(read)


@query(f"""WITH RECURSIVE {FRAMES}, w AS (SELECT source_id, ticks // {DAY} * 20 AS first, 1 + cents % 60 AS count, row_number() OVER (PARTITION BY source_id ORDER BY ticks // {DAY} * 20, 1 + cents % 60, ordinal) AS k FROM t),
g AS (SELECT source_id, k, first AS gf, count AS gc, 1 AS n, 0 AS grp FROM w WHERE k = 1 UNION ALL
 SELECT source_id, w.k, CASE WHEN joins THEN gf ELSE first END, CASE WHEN joins THEN greatest(first + count, gf + gc) - gf ELSE count END, CASE WHEN joins THEN n + 1 ELSE 1 END, CASE WHEN joins THEN grp ELSE grp + 1 END
 FROM (SELECT g.*, w.first, w.count, w.k AS wk, w.first <= gf + gc AND greatest(w.first + w.count, gf + gc) - gf <= 120 AS joins FROM g JOIN w ON w.source_id = g.source_id AND w.k = g.k + 1) x JOIN w USING (source_id, first, count) WHERE w.k = wk)
SELECT source_id, CAST(grp AS INTEGER) AS "group", arg_max(gf, k) AS first, arg_max(gc, k) AS count, CAST(max(n) AS BIGINT) AS n_windows FROM g GROUP BY source_id, grp""")
def window_groups_capped(read):
    windows = ticked(read).select("source_id", (F.floor(F.col("ticks") / DAY) * 20).alias("first"), (F.col("cents") % 60 + 1).alias("count"), F.col("ordinal").alias("idx"))
    return planning.grouped_windows(windows)


# --- evaluation

TOLERANCE = 6 * HOUR
# truths and predictions belong together by source, stretch and mapped vehicle: the prediction's vehicle, taken down by one, is the truth's
MATCHES = f"""{FRAMES}, tr AS (SELECT source_id, ticks // {15 * DAY} AS stretch, cents % 2 AS vehicle, ordinal AS truth_id, ticks AS earliest, ticks AS latest, CASE cents % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END AS direction, cents % 5 AS sig FROM t WHERE event_type IN ('purchase', 'view')),
pr AS (SELECT source_id, ticks // {15 * DAY} AS stretch, cents % 2 + 1 AS alias, ordinal AS prediction_id, ticks AS seen, CASE cents % 4 WHEN 0 THEN 'left' ELSE 'right' END AS direction, cents % 7 = 0 AS abstained, cents % 6 AS sig FROM t WHERE event_type IN ('click', 'signup')),
mp AS (SELECT DISTINCT source_id, stretch, alias, alias - 1 AS vehicle FROM pr WHERE alias = 1 OR source_id % 4 <> 0),
ed AS (SELECT source_id, stretch, vehicle, truth_id, prediction_id, earliest, latest, seen, greatest(earliest - seen, seen - latest, 0) AS cost FROM tr JOIN mp USING (source_id, stretch, vehicle) JOIN pr USING (source_id, stretch, alias)
 WHERE NOT abstained AND greatest(earliest - seen, seen - latest, 0) <= {TOLERANCE})"""
ON = ["source_id", "stretch", "vehicle"]


def label(column, names) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (column + 1).cast("int"))


TRUTH_SIGNALS, PREDICTION_SIGNALS = evaluation.SIGNALS, (*evaluation.SIGNALS[:4], "no_blink_observed", "unknown")


def sides(read) -> tuple[DataFrame, DataFrame]:
    """Truths, and predictions with the truth's vehicle that theirs corresponds to."""
    rows = ticked(read).withColumn("stretch", F.floor(F.col("ticks") / (15 * DAY)))
    t = rows.where(F.col("event_type").isin("purchase", "view"))
    direction = F.when(F.col("cents") % 3 == 0, "left").when(F.col("cents") % 3 == 1, "right").otherwise("unknown")
    truths = t.select("source_id", "stretch", (F.col("cents") % 2).alias("vehicle"), F.col("ordinal").alias("truth_id"), F.col("ticks").alias("earliest"), F.col("ticks").alias("latest"), direction.alias("t_direction"), label(F.col("cents") % 5, TRUTH_SIGNALS).alias("t_signal"))
    p = rows.where(F.col("event_type").isin("click", "signup")).withColumn("alias", F.col("cents") % 2 + 1)
    mapped = F.when((F.col("alias") == 1) | (F.col("source_id") % 4 != 0), F.col("alias") - 1)
    guess = F.when(F.col("cents") % 4 == 0, "left").otherwise("right")
    predictions = p.select("source_id", "stretch", mapped.alias("vehicle"), F.col("ordinal").alias("prediction_id"), F.col("ticks").alias("at"), guess.alias("p_direction"), (F.col("cents") % 7 == 0).alias("abstained"), label(F.col("cents") % 6, PREDICTION_SIGNALS).alias("p_signal"))
    return truths, predictions


def match_pairs(read) -> DataFrame:
    truths, predictions = sides(read)
    return evaluation.edges(truths, predictions.where("not abstained and vehicle is not null"), ON, TOLERANCE)


@query(f"WITH {MATCHES} SELECT source_id, stretch, vehicle, truth_id, prediction_id, cost FROM ed")
def match_edges(read):
    return match_pairs(read).select(*ON, "truth_id", "prediction_id", "cost")


@query(f"""WITH {MATCHES} SELECT source_id, 'truth' AS side, truth_id AS id FROM tr WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.source_id = tr.source_id AND ed.truth_id = tr.truth_id)
UNION ALL SELECT source_id, 'prediction', prediction_id FROM pr WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.source_id = pr.source_id AND ed.prediction_id = pr.prediction_id)""")
def unmatched_truths(read):
    """Truths, and predictions, without any edge."""
    truths, predictions = sides(read)
    pairs = match_pairs(read).select("source_id", "truth_id", "prediction_id")
    alone = lambda rows, c, name: rows.join(pairs, ["source_id", c], "left_anti").select("source_id", F.lit(name).alias("side"), F.col(c).alias("id"))
    return alone(truths, "truth_id", "truth").unionAll(alone(predictions, "prediction_id", "prediction"))


# Best matchings by trying all: a truth joins its group in turn and takes any free prediction of its own, or none.
BEST = f"""{MATCHES}, bd AS (SELECT *, least(earliest, seen) AS lo, greatest(latest, seen) AS hi FROM ed), nw AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY source_id, stretch, vehicle ORDER BY lo, truth_id, prediction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM bd),
gr AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY source_id, stretch, vehicle ORDER BY lo, truth_id, prediction_id) AS grp FROM nw),
tn AS (SELECT source_id, stretch, vehicle, grp, truth_id, row_number() OVER (PARTITION BY source_id, stretch, vehicle, grp ORDER BY truth_id) AS k FROM (SELECT DISTINCT source_id, stretch, vehicle, grp, truth_id FROM gr)),
en AS (SELECT gr.*, k FROM gr JOIN tn USING (source_id, stretch, vehicle, grp, truth_id)),
mt AS (SELECT DISTINCT source_id, stretch, vehicle, grp, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS who, CAST(0 AS BIGINT) AS spent, CAST(0 AS HUGEINT) AS squares FROM gr UNION
 SELECT m.source_id, m.stretch, m.vehicle, m.grp, n.k, CASE WHEN e.prediction_id IS NULL THEN used ELSE list_append(used, e.prediction_id) END, CASE WHEN e.prediction_id IS NULL THEN who ELSE list_append(who, n.truth_id) END, CAST(spent + coalesce(e.cost, 0) AS BIGINT), squares + CAST(coalesce(e.cost, 0) AS HUGEINT) * coalesce(e.cost, 0)
 FROM mt m JOIN tn n ON n.source_id = m.source_id AND n.stretch = m.stretch AND n.vehicle = m.vehicle AND n.grp = m.grp AND n.k = m.k + 1
 JOIN (SELECT source_id, stretch, vehicle, grp, k, prediction_id, cost FROM en UNION ALL SELECT source_id, stretch, vehicle, grp, k, NULL, NULL FROM tn) e ON e.source_id = n.source_id AND e.stretch = n.stretch AND e.vehicle = n.vehicle AND e.grp = n.grp AND e.k = n.k WHERE e.prediction_id IS NULL OR NOT list_contains(used, e.prediction_id)),
lst AS (SELECT *, row_number() OVER (PARTITION BY source_id, stretch, vehicle, grp ORDER BY len(used) DESC, spent, squares) AS place FROM mt JOIN (SELECT source_id, stretch, vehicle, grp, max(k) AS k FROM tn GROUP BY ALL) USING (source_id, stretch, vehicle, grp, k)),
bst AS (SELECT source_id, stretch, vehicle, unnest(who) AS truth_id, unnest(used) AS prediction_id FROM lst WHERE place = 1)"""
SIGNAL_OF = "['left_blink', 'right_blink', 'both_blink', 'no_blink_observed', 'unknown']"
MET = f"""{BEST}, met AS (SELECT tr.direction AS td, pr.direction AS pd, {SIGNAL_OF}[tr.sig + 1] AS ts, ['left_blink', 'right_blink', 'both_blink', 'no_blink_observed', 'no_blink_observed', 'unknown'][pr.sig + 1] AS ps FROM bst JOIN tr USING (source_id, truth_id) JOIN pr USING (source_id, prediction_id))"""


def best_pairs(read) -> DataFrame:
    return evaluation.best_matching(match_pairs(read), ON)


def labelled_matches(read) -> DataFrame:
    truths, predictions = sides(read)
    return best_pairs(read).join(truths.select("source_id", "truth_id", "t_direction", "t_signal"), ["source_id", "truth_id"]).join(predictions.select("source_id", "prediction_id", "p_direction", "p_signal"), ["source_id", "prediction_id"])


@query(f"WITH RECURSIVE {BEST} SELECT source_id, stretch, vehicle, truth_id, prediction_id, cost FROM bst JOIN ed USING (source_id, stretch, vehicle, truth_id, prediction_id)")
def optimal_matching(read):
    return best_pairs(read)


@query(f"""WITH RECURSIVE {MET}, h AS (SELECT count(*) AS tp, count(*) FILTER (WHERE td <> 'unknown') AS direction_eligible, count(*) FILTER (WHERE td <> 'unknown' AND td = pd) AS direction_correct FROM met)
SELECT tp, (SELECT count(*) FROM pr WHERE NOT abstained) - tp AS fp, (SELECT count(*) FROM tr) - tp AS fn, (SELECT count(*) FROM pr WHERE abstained) AS abstained, direction_eligible, direction_correct, tp / (SELECT count(*) FROM pr WHERE NOT abstained) AS precision, tp / (SELECT count(*) FROM tr) AS recall FROM h""")
def event_metrics(read):
    return evaluation.metrics(*sides(read), labelled_matches(read))


@query(f"WITH RECURSIVE {MET}, g AS (SELECT unnest({SIGNAL_OF}) AS truth), h AS (SELECT unnest({SIGNAL_OF}) AS predicted) SELECT g.truth, h.predicted, count(met.ts) AS n FROM g CROSS JOIN h LEFT JOIN met ON met.ts = g.truth AND met.ps = h.predicted GROUP BY ALL")
def signal_confusion(read):
    return evaluation.confusion(labelled_matches(read).select(F.col("t_signal").alias("truth"), F.col("p_signal").alias("predicted")), list(evaluation.SIGNALS))


@query(f"""WITH RECURSIVE {MET} SELECT (SELECT count(*) FROM tr) AS eligible, (SELECT count(*) FROM tr WHERE sig <> 4) AS truth_known, count(*) FILTER (WHERE ps <> 'unknown') AS matched_known, count(*) FILTER (WHERE ts <> 'unknown' AND ps <> 'unknown') AS known_on_observable,
 count(*) FILTER (WHERE ts <> 'unknown' AND ts = ps) AS correct, count(*) FILTER (WHERE ts = 'unknown' AND ps = 'no_blink_observed') AS unknown_to_no_blink FROM met""")
def signal_coverage(read):
    return evaluation.signal_coverage(sides(read)[0].withColumnRenamed("t_signal", "signal"), labelled_matches(read))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'bad id' ELSE 'e' || (doc_id // CASE WHEN doc_id % 13 = 0 THEN 26 ELSE 1 END) END AS event, CASE WHEN doc_id % 17 = 0 THEN 'blink' ELSE 'unknown' END AS signal FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY event) AS c FROM l)
SELECT doc_id, CASE WHEN NOT regexp_full_match(event, '[A-Za-z0-9_.-]{1,64}') THEN 'not an identifier' WHEN c > 1 THEN 'an id occurs twice' WHEN signal = 'blink' THEN 'unknown label' END AS problem FROM n WHERE NOT regexp_full_match(event, '[A-Za-z0-9_.-]{1,64}') OR c > 1 OR signal = 'blink'""")
def label_gates(read):
    step = F.when(F.col("doc_id") % 13 == 0, 26).otherwise(1)
    event = F.when(F.col("doc_id") % 11 == 0, "bad id").otherwise(F.concat(F.lit("e"), F.floor(F.col("doc_id") / step)))
    rows = read("documents").select("doc_id", event.alias("event"), F.when(F.col("doc_id") % 17 == 0, "blink").otherwise("unknown").alias("signal"))
    return evaluation.label_problems(rows, "event", "signal").select("doc_id", "problem")


@query("""WITH g AS (SELECT unnest([0, 1]) AS truth), h AS (SELECT unnest([0, 1]) AS predicted), c AS (SELECT quality AS truth, toxic AS predicted, count(*) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT g.truth, h.predicted, coalesce(c, 0) AS n FROM g CROSS JOIN h LEFT JOIN c ON c.truth = g.truth AND c.predicted = h.predicted""")
def confusion_matrix(read):
    pairs = read("labels").join(read("documents").select("doc_id"), "doc_id").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))
    return evaluation.confusion(pairs, [0, 1])


@query("""SELECT source, count(*) AS denominator, count(toxic) AS covered, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_ratios(read):
    joined = read("documents").select("doc_id", "source").join(read("labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("denominator"), F.count("toxic").alias("covered"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"))


FAMILIES = {"start": "expected", "time_gap": "timing", "source_or_geometry_change": "identity"}


@query(f"""WITH {FRAMES}, {REASONS}, m AS (SELECT source_id, reason, CASE reason WHEN 'start' THEN 'expected' WHEN 'time_gap' THEN 'timing' WHEN 'source_or_geometry_change' THEN 'identity' ELSE 'usable' END AS family FROM r)
SELECT family, reason, count(*) AS n, grouping(reason) = 1 AS total FROM m GROUP BY ROLLUP (family, reason) HAVING grouping(family) = 0""")
def reason_families(read):
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.col("reason")), F.lit("usable"))
    rolled = broken(read).withColumn("family", family).rollup("family", "reason").agg(F.count(F.lit(1)).alias("n"), (F.grouping("reason") == 1).alias("total"), F.grouping("family").alias("g"))
    return rolled.where("g = 0").drop("g")


# --- receipts and selections


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_digest(read):
    return read("documents").select("doc_id", receipts.digest(F.col("text")).alias("sha256"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_digests(read):
    hashed = read("documents").select("doc_id", receipts.digest(F.col("text")).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, lang, 'expected' AS side FROM documents WHERE doc_id % 97 = 0 UNION ALL SELECT doc_id, 'xx' AS lang, 'actual' AS side FROM documents WHERE doc_id % 97 = 0")
def catalog_audit(read):
    expected = read("documents").select("doc_id", "lang")
    return receipts.differences(expected, expected.withColumn("lang", F.when(F.col("doc_id") % 97 == 0, "xx").otherwise(F.col("lang"))))


@query("SELECT page_id, NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]+://') AS as_it_is, regexp_matches(regexp_replace(url, '^[A-Za-z]+://', ''), '(^|/)\\.\\.(/|$)') AS climbs FROM pages")
def path_gate(read):
    rest = F.regexp_replace("url", "^[A-Za-z]+://", "")
    return read("pages").select("page_id", receipts.well_formed_path(F.col("url")).alias("as_it_is"), (~receipts.well_formed_path(rest)).alias("climbs"))


@query("SELECT event_id, json_keys(props) = ['k'] AS closed, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_shape_gate(read):
    return read("events").select("event_id", closed_shape("props", ["k"]).alias("closed"), F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query(f"WITH {FRAMES} SELECT source_id, ordinal, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ordinal DESC) AS rn FROM t) WHERE rn <= 120")
def recent_n_samples(read):
    newest = Window.partitionBy("source_id").orderBy(F.desc("ordinal"))
    return frames(read("events")).withColumn("rn", F.row_number().over(newest)).where("rn <= 120").select("source_id", "ordinal", "event_id")


@query(f"WITH {FRAMES}, s AS (SELECT unnest([0, 1, 2, 3]) AS position, unnest([7, 2, 11, 0]) AS ordinal) SELECT source_id, position, ordinal, event_id FROM t JOIN s USING (ordinal)")
def selection_order(read):
    wanted = F.array(*[F.lit(k).cast("long") for k in (7, 2, 11, 0)])
    rows = frames(read("events"))
    asked = rows.select("source_id").distinct().select("source_id", F.posexplode(wanted).alias("position", "ordinal"))
    return rows.join(asked, ["source_id", "ordinal"]).select("source_id", "position", "ordinal", "event_id")


@query(f"""WITH {EDGES} SELECT source_id, day, det_index, track_id, 'associated' AS kind FROM g WHERE td = 1 AND dd = 1 UNION ALL SELECT DISTINCT source_id, day, det_index, CAST(NULL AS BIGINT), 'ambiguous' FROM g WHERE td > 1 OR dd > 1
UNION ALL SELECT source_id, day, det_index, CAST(NULL AS BIGINT), 'unassociated' FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source_id = b.source_id AND e.day = b.day AND e.det_index = b.det_index)""")
def annotation_union(read):
    on = ["source_id", "day"]
    pairs = event_edges(read)
    detections = ticked(read).where(~F.col("event_type").isin("view", "click")).select("source_id", F.floor(F.col("ticks") / DAY).alias("day"), F.col("ordinal").alias("det_index"))
    none = F.lit(None).cast("long").alias("track_id")
    parts = [
        association.unique(pairs, on).select(*on, "det_index", "track_id", F.lit("associated").alias("kind")),
        association.ambiguous(pairs, on).select(*on, "det_index").distinct().select(*on, "det_index", none, F.lit("ambiguous").alias("kind")),
        detections.join(pairs, [*on, "det_index"], "left_anti").select(*on, "det_index", none, F.lit("unassociated").alias("kind")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- tracking


def event_detections(read) -> DataFrame:
    """Up to three boxes a frame: the frame's own, one that drifts slowly, and now and then a near copy of the first."""
    rows = ticked(read).withColumn("x", (F.col("cents") % 400).cast("double")).withColumn("y", (F.col("cents") % 200).cast("double"))
    box = lambda k, kind, x, y, score: F.struct(F.lit(k).alias("det_index"), kind.cast("int").alias("class_id"), x.alias("x1"), y.alias("y1"), (x + 300).alias("x2"), (y + 200).alias("y2"), score.alias("score"))
    score = F.col("cents") % 100 / 100
    drift = (F.col("ordinal") % 50 * 4).cast("double")
    first, second = box(0, F.col("event_id") % 2, F.col("x"), F.col("y"), score), box(1, F.lit(2), drift, drift, F.lit(0.9))
    third = F.when(F.col("cents") % 5 == 0, box(2, F.col("event_id") % 2, F.col("x") + 1, F.col("y"), score))
    each = rows.select("source_id", "ordinal", "pts", F.inline(F.array_compact(F.array(first, second, third))))
    return each.withColumns({"width": F.lit(640.0), "height": F.lit(360.0)})


POLICY = tracking.Policy(max_gap=10 * DAY, max_unobserved=5 * DAY, min_iou=0.1, new_score=0.5, ticks_per_second=DAY)


@query()
def tracker_batch(read):
    return tracking.track(event_detections(read), POLICY)


@query()
def stream_track(read):
    """The tracker as a stream over files, run until all are read."""
    return streamed(event_detections(read), "stream-track", lambda rows: folds.track_stream(rows, POLICY))


@query(f"""WITH {FRAMES}, b AS (SELECT *, coalesce(pts - lag(pts) OVER (PARTITION BY source_id ORDER BY ordinal) > {10 * DAY}, true) AS brk FROM t), s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY source_id ORDER BY ordinal) AS segment FROM b)
SELECT source_id, CAST(segment AS INTEGER) AS segment, count(*) AS n_frames FROM s GROUP BY ALL""")
def tracker_segments(read):
    found = tracking.track(event_detections(read), POLICY)
    return found.groupBy("source_id", "segment").agg(F.count_distinct("ordinal").alias("n_frames"))


@query()
def tracker_annotations(read):
    detections = event_detections(read)
    return tracking.annotations(tracking.track(detections, POLICY), detections)


def planted_reports(read) -> DataFrame:
    """Reports of one track a frame, with one fault for each remainder of cents."""
    rows = ticked(read).withColumn("k", F.col("cents") % 20)
    row = lambda state, track, det, kind, age, group: F.struct(state.alias("state"), track.cast("int").alias("track_id"), det.cast("int").alias("det_index"), kind.cast("int").alias("class_id"), age.cast("long").alias("unobserved"), group.cast("int").alias("component"))
    k, no = F.col("k"), F.lit(None)
    first = row(F.when(k == 1, "guessed").otherwise("observed"), F.when(k != 2, 1), F.when(k != 3, 0), F.lit(2), F.when(k == 4, 5).otherwise(0), no)
    second = row(F.lit("prediction_only"), F.when(k == 5, 1).otherwise(2), F.when(k == 6, 3), F.lit(2), F.when(k == 7, 0).otherwise(4), no)
    third = row(F.lit("ambiguous"), F.when(k == 8, 9), F.when(k == 9, 0).when(k == 10, None).otherwise(4), F.lit(2), no, F.lit(0))
    fourth = row(F.lit("ended"), F.when(k == 11, 1).when(k == 12, None).otherwise(7), no, F.when(k == 13, 5).otherwise(2), no, F.lit(0))
    return rows.select("source_id", "ordinal", F.inline(F.array(first, second, third, fourth)))


@query(f"""WITH {FRAMES}, f2 AS (SELECT source_id, ordinal, cents % 20 AS k FROM t) SELECT source_id, ordinal, 'state' AS problem FROM f2 WHERE k IN (1, 2, 3, 4, 6, 7, 8, 10, 12) UNION ALL SELECT source_id, ordinal, 'track_id twice' FROM f2 WHERE k IN (5, 11)
UNION ALL SELECT source_id, ordinal, 'det_index twice' FROM f2 WHERE k = 9 UNION ALL SELECT source_id, ordinal, 'classes of a group' FROM f2 WHERE k = 13""")
def tracking_report_audit(read):
    return audit.report_problems(planted_reports(read))


@query(f"WITH {FRAMES} SELECT source_id, ordinal, CASE WHEN cents % 20 NOT IN (1, 2) THEN 1 END AS track_id, CASE WHEN cents % 20 NOT IN (1, 2, 3) THEN 0 END AS det_index FROM t")
def identity_lookup(read):
    """The chosen identity's detection in every frame, where it is observed."""
    reports = planted_reports(read).withColumn("segment", F.lit(1))
    asked = ticked(read).select("source_id").distinct().select("source_id", F.lit(1).alias("segment"), F.lit(2).alias("class_id"), F.lit(1).alias("track_id"))
    return tracking.selected(ticked(read).select("source_id", "ordinal"), reports, asked).select("source_id", "ordinal", "track_id", "det_index")


@query(f"""WITH RECURSIVE {FRAMES}, z AS (SELECT source_id, ordinal, cents / 100.0::DOUBLE AS z, (ticks - lag(ticks) OVER (PARTITION BY source_id ORDER BY ordinal)) / {DAY}.0::DOUBLE AS dt FROM t),
k AS (SELECT source_id, ordinal, z AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM z WHERE ordinal = 0 UNION ALL
 SELECT source_id, ordinal, px + pa / (pa + 4) * (z - px), v + pb / (pa + 4) * (z - px), pa - pa / (pa + 4) * pa, pb - pa / (pa + 4) * pb, pc - pb / (pa + 4) * pb FROM
 (SELECT z.source_id, z.ordinal, z.z, k.v, k.x + dt * k.v AS px, k.a + dt * (2 * k.b + dt * k.c) + dt * dt * dt / 3 AS pa, k.b + dt * k.c + dt * dt / 2 AS pb, k.c + dt AS pc FROM k JOIN z ON z.source_id = k.source_id AND z.ordinal = k.ordinal + 1))
SELECT source_id, ordinal, round(x, 5) AS x, round(v, 5) AS v FROM k""")
def kalman_filter_1d(read):
    """One channel of the motion filter: measurement variance 4, spectral density 1, time in days."""
    rows = ticked(read).select("source_id", "ordinal", (F.col("cents") / 100.0).alias("z"), (F.col("ticks") / float(DAY)).alias("t"))
    return tracking.filtered(rows, 4.0, 1.0, (1.0, 1.0)).select("source_id", "ordinal", F.round("x", 5).alias("x"), F.round("v", 5).alias("v"))


# --- streams and audits


def streamed(rows: DataFrame, label: str, fold) -> DataFrame:
    """What a streaming fold makes of rows that are read from files, all of them."""
    spark = rows.sparkSession
    folder = shared_folder(spark, label)
    rows.write.parquet(f"{folder}/in")
    out = fold(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(f"WITH {FRAMES}, {LEFT} SELECT source_id, ordinal, ticks, phase, changes, CAST(NULL AS VARCHAR) AS problem FROM p")
def stream_lamp(read):
    rows = side(lamp_rows(read), "left").select("source_id", "ordinal", "pts", "ticks", "observed", "identity", "uncertain", "status", "brightness")
    return streamed(rows, "stream-lamp", lambda samples: folds.lamp_phase_stream(samples, LAMP, LAMP_GAP))


@query(f"{LANE_CHANGES} {CHANGES}")
def stream_lane(read):
    rows = lane_rows(read).select("source_id", "ordinal", "pts", "lane", "interior")
    return streamed(rows, "stream-lane", lambda lane: folds.lane_stream(lane, 3 * DAY, HOUR)).where("problem is null").drop("problem")


LANE_STATES = LANE_CHANGES.replace("CAST(NULL AS BIGINT) AS e0 FROM (SELECT DISTINCT", "CAST(NULL AS BIGINT) AS e0, '' AS act, false AS anew, false AS cut FROM (SELECT DISTINCT").replace("prev2, hit, ob, nb, e0 FROM (", "prev2, hit, ob, nb, e0, act, anew, cut FROM (")
LANE_STATES = LANE_STATES.replace("AS last0, CASE WHEN fresh THEN NULL ELSE prev END AS prev0\n", "AS last0, CASE WHEN fresh THEN NULL ELSE prev END AS prev0, q.prev IS NULL AS anew, r.brk AS cut\n")
LANE_NULL = "'no_actual_observation'"


@query(f"""{LANE_STATES} SELECT source_id, ordinal, CASE act WHEN 'none' THEN 'unknown' WHEN 'stable' THEN 'stable' WHEN 'settle' THEN CASE WHEN hit THEN 'candidate' ELSE 'stable' END ELSE CASE WHEN ob IS NULL THEN 'warming' ELSE 'moving' END END AS status,
CASE WHEN act = 'none' AND nb IS NULL THEN 'outside_lane_section' WHEN act = 'none' THEN 'non_adjacent_or_incomplete' WHEN anew THEN 'start' WHEN cut THEN 'time_gap' END AS reason, CASE WHEN hit THEN CASE WHEN nb > ob THEN 'right' ELSE 'left' END END AS direction FROM s WHERE ordinal >= 0""")
def lane_states(read):
    rows = lane_rows(read).select("source_id", "ordinal", "pts", "lane", "interior", F.lit("outside_lane_section").alias("why"))
    return lanes_fold.lane_states(rows, 3 * DAY, HOUR)


def event_catalogue(read) -> DataFrame:
    """Candidates with their contexts, and signals over the contexts of what is left of the last lamp histories."""
    contexts = event_contexts(read)
    windows = contexts.select("source_id", F.col("candidate").alias("window_id"), F.col("requested_from").alias("start"), F.col("requested_to").alias("end"))
    found = reports(lamps.latest(lamp_histories(read)), windows)
    left, right = (found[s].select("source_id", F.col("window_id").alias("candidate"), F.col("state").alias(f"{s}_state"), F.col("blink_evidence").alias(f"{s}_blinks")) for s in ("left", "right"))
    return audit.catalogue(event_candidates(read), contexts, left.join(right, ["source_id", "candidate"]))


CATALOGUE = f"""{FRAMES}, {CONTEXT}, {HISTORY}, q AS (SELECT source_id, candidate AS window_id, lo AS a, hi AS b FROM ctx), {report_sql('left')}, {report_sql('right')},
ct AS (SELECT ctx.*, {SIGNAL} AS signal FROM ctx JOIN wleft l ON l.source_id = ctx.source_id AND l.window_id = ctx.candidate JOIN wright r ON r.source_id = ctx.source_id AND r.window_id = ctx.candidate),
cat AS (SELECT *, '{{"candidate":' || candidate || ',"context_from":' || context_from || ',"context_to":' || context_to || ',"direction":"' || direction || '","end":' || "end" || ',"signal":"' || signal || '","source_id":' || source_id || ',"start":' || "start" || '}}' || chr(10) AS body FROM ct)"""


@query(f'WITH {CATALOGUE} SELECT source_id, candidate, direction, "start", "end", context_from, context_to, signal, lo AS requested_from, hi AS requested_to, sha256(body) AS sha256 FROM cat')
def candidate_catalogue(read):
    return event_catalogue(read)


@query(f'WITH {CATALOGUE} SELECT candidate, direction, "start", "end", signal FROM cat')
def catalogue_summary(read):
    return audit.summary(event_catalogue(read))


PLANTED = {"direction": 1, "chronology": 2, "context": 3, "signal": 4}


@query(f"""WITH {CATALOGUE}, x AS (SELECT *, candidate % 9 AS k, lag("end") OVER (PARTITION BY source_id ORDER BY candidate) AS last, CASE WHEN candidate % 9 = 2 THEN "start" - 1 ELSE "end" END AS fin FROM cat)
SELECT source_id, candidate, CASE WHEN k = 1 THEN 'direction' WHEN k = 2 THEN 'chronology' WHEN fin <= lag(fin) OVER (PARTITION BY source_id ORDER BY candidate) THEN 'order'
 WHEN k = 3 OR NOT (context_from <= lo AND lo <= "start" AND fin < hi AND hi <= context_to) THEN 'context' WHEN k = 5 THEN 'unknown needs reasons, and only that' WHEN k = 6 THEN 'no evidence of blinking' WHEN k = 4 THEN 'signal' END AS problem FROM x
QUALIFY problem IS NOT NULL""")
def catalogue_checks(read):
    """A catalogue's rows with a fault for some remainders of their number."""
    k = F.col("candidate") % 9
    known = event_catalogue(read)
    faulty = known.withColumns({
        "direction": F.when(k == 1, "up").otherwise(F.col("direction")), "end": F.when(k == 2, F.col("start") - 1).otherwise(F.col("end")), "context_from": F.when(k == 3, F.col("start") + 1).otherwise(F.col("context_from")),
        "left_state": F.when(k == 6, "blink_observed").when(k == 5, "unknown").otherwise("no_blink_observed"), "left_blinks": F.lit(False), "left_reasons": F.array().cast("array<string>"),
        "right_state": F.lit("no_blink_observed"), "right_blinks": F.lit(False), "right_reasons": F.array().cast("array<string>"), "signal": F.when(k == 4, "left_blink").otherwise("no_blink_observed"),
    })
    return faulty.withColumn("problem", audit.catalogue_problem(["candidate"])).where("problem is not null").select("source_id", "candidate", "problem")


@query(f"""WITH {CATALOGUE} SELECT source_id, candidate, CASE WHEN candidate % 7 = 1 THEN 'missing' WHEN candidate % 7 = 2 THEN 'unexpected' WHEN candidate % 7 = 3 THEN 'context_to' ELSE 'sha256' END AS problem FROM cat WHERE candidate % 7 BETWEEN 1 AND 4""")
def batch_audit(read):
    """A recorded catalogue with rows left out, added and changed, against a fresh one."""
    fresh = event_catalogue(read)
    k = F.col("candidate") % 7
    recorded = fresh.where(k != 1).withColumn("context_to", F.when(k == 3, F.col("context_to") + 1).otherwise(F.col("context_to"))).withColumn("sha256", F.when(k == 4, "0").otherwise(F.col("sha256")))
    return audit.batch_problems(recorded, fresh.where(k != 2), ["source_id", "candidate"], ["context_from", "context_to", "sha256"])


@query("SELECT 'doc' || doc_id AS path, CASE doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'unlisted' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 10 < 3")
def listing_audit(read):
    files = read("documents").select((F.col("doc_id") % 10).alias("k"), F.concat(F.lit("doc"), "doc_id").alias("path"), receipts.digest(F.col("text")).alias("sha256"))
    manifest = files.where("k <> 1").withColumn("sha256", F.when(F.col("k") == 2, "0").otherwise(F.col("sha256")))
    return audit.manifest_problems(manifest, files.where("k <> 0"))


@query(f"""WITH {FRAMES} SELECT source_id, ordinal, CASE WHEN cents % 12 = 1 THEN 'ordinal' WHEN cents % 12 = 2 THEN 'pts' ELSE 'event_type' END AS problem FROM (SELECT source_id, CASE WHEN cents % 12 = 1 THEN ordinal + 1000000 ELSE ordinal END AS ordinal, cents FROM t) WHERE cents % 12 IN (1, 2, 3)""")
def frame_match(read):
    rows, k = ticked(read), F.col("cents") % 12
    recorded = rows.select("source_id", F.when(k == 1, F.col("ordinal") + 1_000_000).otherwise(F.col("ordinal")).alias("ordinal"), F.when(k == 2, F.col("pts") + 1).otherwise(F.col("pts")).alias("pts"), F.when(k == 3, "none").otherwise(F.col("event_type")).alias("event_type"))
    return audit.mismatched_frames(recorded, rows, ("pts", "event_type"))


@query(f"WITH {FRAMES} SELECT source_id, ordinal, CASE WHEN cents % 12 = 2 THEN 'pts' ELSE 'observation' END AS problem FROM t WHERE cents % 12 IN (2, 4, 5)")
def review_join(read):
    rows, k = ticked(read), F.col("cents") % 12
    review = rows.select("source_id", "ordinal", F.when(k == 2, F.col("pts") + 1).otherwise(F.col("pts")).alias("pts"), F.when(k == 4, 2).when(k == 5, None).otherwise(1).alias("track_id"))
    return audit.review_problems(review, rows, rows.select("source_id", "ordinal", F.lit(1).alias("track_id")))


# --- replay


def event_batch(read) -> DataFrame:
    rows = ticked(read)
    asked = rows.where("event_type = 'signup'").select("source_id", F.col("ordinal").alias("candidate"), F.greatest(F.col("ticks") - DAY, F.lit(0)).alias("context_from"), (F.col("ticks") + DAY).alias("context_to"))
    return replay.batch_windows(rows, asked, [1, 4, 9, 16, 25], 2 * DAY)


BATCH = f"""{FRAMES}, c AS (SELECT source_id, ordinal, ticks, event_type = 'signup' AS asked FROM t), x AS (SELECT source_id, ordinal AS candidate, greatest(ticks - {DAY}, 0) AS a, ticks + {DAY} AS b FROM c WHERE asked AND ordinal IN (1, 4, 9, 16, 25)),
w AS (SELECT x.source_id, candidate, min(c.ordinal) AS first, count(*) AS n FROM x JOIN c ON c.source_id = x.source_id AND c.ticks >= a AND c.ticks < b GROUP BY ALL),
m AS (SELECT *, max(first + n) OVER (PARTITION BY source_id ORDER BY first, n, candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM w),
g AS (SELECT *, sum(CASE WHEN first <= ended THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY first, n, candidate) - 1 AS grp FROM m)"""


@query(f"""WITH {BATCH} SELECT source_id, CAST(grp AS INTEGER) AS "group", min(first) AS first, max(first + n) - min(first) AS count, count(*) AS n_windows FROM g GROUP BY source_id, grp""")
def batch_window_plan(read):
    """The sources' windows have far fewer than 120 frames together, so the bound cuts none here; ``window_groups_capped`` has those that it cuts."""
    return planning.grouped_windows(event_batch(read))


@query(f"""WITH {BATCH}, p AS (SELECT source_id, grp, min(first) AS first, max(first + n) - min(first) AS count, sum(CASE WHEN first >= 5 AND first + n <= 20 THEN 0 ELSE n END) AS separate FROM g GROUP BY source_id, grp)
SELECT source_id, CAST(grp AS INTEGER) AS "group", first, count, CAST(separate AS BIGINT) AS separate, NOT (separate > 0 AND separate < count) AS prime FROM p""")
def window_priming(read):
    windows = event_batch(read)
    return replay.worth_priming(planning.grouped_windows(windows), windows, 5, 15)


def replayed(read) -> dict[str, DataFrame]:
    """The replay of recorded rows of which some frames have none."""
    recorded = side(lamp_rows(read), "left").withColumn("source", F.when(F.col("cents") % 23 != 0, F.floor(F.col("ordinal") / 25)))
    rows = lane_rows(read).select("source_id", "ordinal", "lane", "interior").join(recorded.select("source_id", "ordinal", "observed", "identity", "uncertain", "status", "brightness", "source"), ["source_id", "ordinal"])
    rows = rows.join(ticked(read).where("cents % 13 <> 0").select("source_id", "ordinal"), ["source_id", "ordinal"], "left_semi")
    return replay.analyse(ticked(read).select("source_id", "ordinal", "pts", "ticks"), rows, F.col("source"), 3 * DAY, HOUR, lamp_windows(read), LAMP)


#: Recorded rows alone, so that the row after a frame without one comes after a gap.
RECORDED = FRAMES.replace("t AS (SELECT *,", "t0 AS (SELECT *,") + ", t AS (SELECT * FROM t0 WHERE cents % 13 <> 0)"
KEPT = HISTORY.replace("WHEN pts - lag(pts) OVER o >", "WHEN CASE WHEN cents % 23 <> 0 THEN ordinal // 25 END IS NULL OR lag(CASE WHEN cents % 23 <> 0 THEN ordinal // 25 END) OVER o <> ordinal // 25 THEN 'start' WHEN ordinal <> lag(ordinal) OVER o + 1 THEN 'missing_frame' WHEN pts - lag(pts) OVER o >").replace(str(LAMP_GAP), str(3 * DAY))


@query(f"""WITH {RECORDED}, k AS (SELECT source_id, ordinal, CASE WHEN cents % 23 <> 0 THEN ordinal // 25 END AS key FROM t), z AS (SELECT *, lag(key) OVER (PARTITION BY source_id ORDER BY ordinal) AS last FROM k)
SELECT source_id, ordinal, CASE WHEN key IS NULL THEN 'lamps_unknown' ELSE 'lamp_source_change' END AS reason FROM z WHERE key IS NULL OR last <> key""")
def replay_resets(read):
    return replayed(read)["resets"]


LANE_RECORDED = LANE_CHANGES.replace(FRAMES, RECORDED).replace("coalesce(pts - lag(pts) OVER (PARTITION BY source_id ORDER BY ordinal) >", "coalesce(ordinal <> lag(ordinal) OVER (PARTITION BY source_id ORDER BY ordinal) + 1 OR pts - lag(pts) OVER (PARTITION BY source_id ORDER BY ordinal) >")
LANE_RECORDED = LANE_RECORDED.replace("SELECT source_id, ordinal, pts, lane, interior, coalesce(", "SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) - 1 AS ordinal, ordinal AS frame, pts, lane, interior, coalesce(")


@query(f"""{LANE_RECORDED}, o AS (SELECT source_id, ordinal, frame FROM r) SELECT c.source_id, direction, from_lane, to_lane, a.frame AS start_from, b.frame AS start_to, d.frame AS cross_from, e.frame AS cross_to, g.frame AS done_from, h.frame AS done_to FROM ({CHANGES}) c
JOIN o a ON a.source_id = c.source_id AND a.ordinal = start_from JOIN o b ON b.source_id = c.source_id AND b.ordinal = start_to JOIN o d ON d.source_id = c.source_id AND d.ordinal = cross_from JOIN o e ON e.source_id = c.source_id AND e.ordinal = cross_to
JOIN o g ON g.source_id = c.source_id AND g.ordinal = done_from JOIN o h ON h.source_id = c.source_id AND h.ordinal = done_to""")
def replay_lane_changes(read):
    return replayed(read)["changes"]


@query(f"WITH {RECORDED}, {KEPT}, {SPANS.replace('FROM t GROUP BY', 'FROM t0 GROUP BY')}, {report_sql('left')} SELECT * FROM wleft")
def replay_lamp_reports(read):
    return replayed(read)["lamps"]


@query(f"""WITH {FRAMES} SELECT source_id, ordinal, CASE WHEN event_type = 'error' THEN 'identity_uncertain' WHEN cents % 5 = 0 THEN 'model_uncertain' WHEN cents % 7 = 0 THEN 'identity_uncertain' WHEN cents % 11 = 0 THEN 'model_uncertain'
 WHEN event_type = 'view' THEN 'usable' WHEN event_type = 'click' THEN 'model_uncertain' ELSE 'occluded' END AS status FROM t""")
def lamp_roi_status(read):
    kind, cents = F.col("event_type"), F.col("cents")
    visibility = F.when(kind == "view", "visible").when(kind == "click", "unknown").otherwise("occluded")
    status = replay.roi_gate(F.when(kind != "error", 1), F.when(cents % 5 != 0, 1), cents % 7 != 0, cents % 11 != 0, visibility)
    return ticked(read).select("source_id", "ordinal", status.alias("status"))

"""Lane decoding and lane changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .boundaries import reasons


def first_peak(values: Column) -> Column:
    """Place of the largest value, the first on ties, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def local_softmax(values: Column, grid: int) -> Column:
    """Expected place around the peak, as a share of the axis; null if it lies outside."""
    peak = first_peak(values)
    start = F.greatest(peak - 1, F.lit(0))
    near = F.slice(values, start + 1, F.least(peak + 2, F.size(values)) - start)
    top = F.array_max(values)
    weights = F.transform(near, lambda v: F.exp(v - top))
    mean = F.aggregate(F.transform(weights, lambda w, k: w * (start + k)), F.lit(0.0), lambda a, x: a + x) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    share = (mean + 0.5) / (grid - 1)
    return F.when((share >= 0) & (share <= 1), share)


def supported(exists: Column, axis: Column) -> Column:
    """Strictly more than half of a row axis' anchors, or a quarter of a column axis'."""
    n = F.size(F.filter(exists, lambda e: e))
    return F.when(axis == "row", n * 2 > F.size(exists)).otherwise(n * 4 > F.size(exists))


def lane_of(x: Column, boundaries: Column) -> Column:
    """Index of the lane a point lies in; null outside of the outer boundaries or on them."""
    inside = (x > F.element_at(boundaries, 1)) & (x < F.element_at(boundaries, -1))
    return F.when(inside, F.size(F.filter(boundaries, lambda b: b <= x)) - 1)


def anchor_place(axis: Column, index: Column, n: Column, width: Column, height: Column) -> Column:
    """Where an anchor lies: rows from 0.42 of the height to all of it, columns over the whole width."""
    share = index / (n - 1)
    return F.when(axis == "row", (F.lit(0.42) + F.lit(0.58) * share) * height).otherwise(share * width)


def section_sample(points: Column, visible: Column, passed: Column, y: Column) -> Column:
    """Where a line meets the height y, as a struct of x (or null) and the reason why there is no x.

    points: array of (x, y) by anchor, with nulls; visible: a flag for each pair of
    neighbouring anchors; passed: whether the slot has support. A flat pair at y comes
    first of all reasons. A vertex that two pairs share counts once. Of the pairs that
    meet y at one place a visible one is needed.
    """
    pairs = F.zip_with(
        F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        visible, lambda p, v: F.struct(p["a"].alias("a"), p["b"].alias("b"), v.alias("seen")),
    )
    placed = F.transform(pairs, lambda p, i: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["seen"].alias("seen"), i.alias("i")))
    met = F.filter(placed, lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (F.least(p["a"]["y"], p["b"]["y"]) <= y) & (F.greatest(p["a"]["y"], p["b"]["y"]) >= y))
    flat = F.exists(met, lambda p: p["a"]["y"] == p["b"]["y"])

    def hit(p: Column) -> Column:
        a, b = p["a"], p["b"]
        place = F.when(y == a["y"], 2 * p["i"]).when(y == b["y"], 2 * p["i"] + 2).otherwise(2 * p["i"] + 1)  # even: an anchor
        x = F.when(y == a["y"], a["x"]).when(y == b["y"], b["x"]).otherwise(a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]))
        return F.struct(place.alias("place"), x.alias("x"), p["seen"].alias("seen"))

    hits = F.transform(F.filter(met, lambda p: p["a"]["y"] != p["b"]["y"]), hit)
    places = F.size(F.array_distinct(F.transform(hits, lambda h: h["place"])))
    certain = F.get(F.filter(hits, lambda h: h["seen"]), F.lit(0))["x"]
    reason = (
        F.when(~passed, "slot_support_missing").when(flat, "horizontal_intersection").when(places == 0, "no_adjacent_support")
        .when(places > 1, "multiple_intersections").when(certain.isNull(), "uncertified_intersection")
    )
    return F.struct(F.when(reason.isNull(), certain).alias("x"), reason.alias("reason"))


def bound_samples(slots: DataFrame, bindings: DataFrame, on: list[str], y: str) -> DataFrame:
    """slots(on, slot, points, passed) joined with bindings(on, slot, position, boundary_id, visible, y): each binding's sample."""
    met = bindings.join(slots, [*on, "slot"])
    return met.withColumn("__s", section_sample(F.col("points"), F.col("visible"), F.col("passed"), F.col(y))).select(*on, "position", "slot", "boundary_id", F.col("__s.x").alias("x"), F.col("__s.reason").alias("reason"))


def section_facts(samples: DataFrame, on: list[str]) -> DataFrame:
    """samples(on, position, x, reason): how many bindings a frame has, the first that fails, and whether x grows from one to the next."""
    last = F.lag("x").over(Window.partitionBy(*on).orderBy("position"))
    steps = samples.withColumn("back", F.coalesce(F.col("x") <= last, F.lit(False)))
    return steps.groupBy(*on).agg(F.count(F.lit(1)).alias("bindings"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("position"))).alias("first_failure"), (~F.bool_or("back")).alias("ordered"))


STATE = (
    "struct<base:int,stable:bigint,pend:int,pend_o:bigint,pend_t:bigint,dep:boolean,d0:bigint,d1:bigint,crs:boolean,c0:bigint,c1:bigint,"
    "last:int,prev:bigint,out:array<struct<direction:string,from_lane:int,to_lane:int,start_from:bigint,start_to:bigint,cross_from:bigint,cross_to:bigint,done_from:bigint,done_to:bigint>>>"
)


def lane_changes(rows: DataFrame, max_gap: int, dwell: int, key: Column | None = None) -> DataFrame:
    """rows(source_id, ordinal, pts, lane, interior): completed changes to a neighbouring lane, with the frames that bracket them.

    A lane of null (nothing observed, gates closed, outside) and every break of the
    stream begin anew, so the runs between them don't depend on each other. The fold
    goes over each run's rows in order, in the JVM.
    """
    marked = reasons(rows, max_gap, key)
    cuts = F.when(F.col("lane").isNull() | F.col("reason").isNotNull(), 1).otherwise(0)
    marked = marked.withColumn("run", F.sum(cuts).over(Window.partitionBy("source_id").orderBy("ordinal"))).where("lane is not null")
    ordered = marked.groupBy("source_id", "run").agg(F.sort_array(F.collect_list(F.struct("ordinal", "pts", "lane", "interior", F.col("reason").isNotNull().alias("brk")))).alias("rows"))
    blank = "named_struct('base', cast(null as int), 'stable', cast(null as bigint), 'pend', cast(null as int), 'pend_o', cast(null as bigint), 'pend_t', cast(null as bigint), 'dep', false, 'd0', cast(null as bigint), 'd1', cast(null as bigint), 'crs', false, 'c0', cast(null as bigint), 'c1', cast(null as bigint), 'last', cast(null as int), 'prev', cast(null as bigint), 'out', {out})"
    empty = f"cast(array() as {STATE.split('out:')[1][:-1]})"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    moved = "(s.base is not null and (r.lane <> s.base or not r.interior) and not s.dep)"
    crossed = "(s.base is not null and r.lane <> s.base and not s.crs and s.last <=> s.base)"
    # after departure, crossing and the last lane are brought up to date
    noted = (
        f"named_struct('base', s.base, 'stable', s.stable, 'pend', s.pend, 'pend_o', s.pend_o, 'pend_t', s.pend_t, 'dep', s.dep or {moved}, 'd0', if({moved}, s.stable, s.d0), 'd1', if({moved}, r.ordinal, s.d1),"
        f" 'crs', if(r.lane <=> s.base, false, s.crs or {crossed}), 'c0', if({crossed}, s.prev, s.c0), 'c1', if({crossed}, r.ordinal, s.c1), 'last', r.lane, 'prev', r.ordinal, 'out', s.out)"
    )
    keep = "'dep', u.dep, 'd0', u.d0, 'd1', u.d1, 'crs', u.crs, 'c0', u.c0, 'c1', u.c1, 'last', u.last, 'prev', u.prev"
    gone = "'dep', false, 'd0', u.d0, 'd1', u.d1, 'crs', false, 'c0', u.c0, 'c1', u.c1, 'last', u.last, 'prev', u.prev"
    none = "'pend', cast(null as int), 'pend_o', cast(null as bigint), 'pend_t', cast(null as bigint)"
    begun = "(u.pend is null or u.pend <> r.lane)"
    since_o, since_t = f"if({begun}, r.ordinal, u.pend_o)", f"if({begun}, r.pts, u.pend_t)"
    waiting = f"named_struct('base', u.base, 'stable', u.stable, 'pend', r.lane, 'pend_o', {since_o}, 'pend_t', {since_t}, {keep}, 'out', u.out)"
    change = f"named_struct('direction', if(r.lane > u.base, 'right', 'left'), 'from_lane', u.base, 'to_lane', r.lane, 'start_from', u.d0, 'start_to', u.d1, 'cross_from', u.c0, 'cross_to', u.c1, 'done_from', {since_o}, 'done_to', r.ordinal)"
    settled = f"named_struct('base', r.lane, 'stable', r.ordinal, {none}, {gone}, 'out', if(u.base is not null and u.dep and u.crs, array_append(u.out, {change}), u.out))"
    judged = (
        f"case when not r.interior then named_struct('base', u.base, 'stable', u.stable, {none}, {keep}, 'out', u.out)"
        f" when r.lane <=> u.base then named_struct('base', u.base, 'stable', r.ordinal, {none}, {gone}, 'out', u.out)"
        f" when r.pts - {since_t} < {dwell} then {waiting} else {settled} end"
    )
    on_row = let(noted, "u", judged)
    fresh = f"if(r.brk or q.prev is null, {blank.format(out='q.out')}, q)"
    step = f"case when r.lane is null then {blank.format(out='q.out')} else {let(fresh, 's', f'case when s.base is not null and abs(r.lane - s.base) > 1 then ' + blank.format(out='s.out') + f' else {on_row} end')} end"
    fold = F.expr(f"aggregate(rows, {blank.format(out=empty)}, (q, r) -> {step}, q -> q.out)")
    return ordered.select("source_id", F.explode(fold).alias("c")).select("source_id", "c.*")

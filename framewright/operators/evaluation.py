"""Truths against predictions: edges, best one-to-one matching, counts and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import ranges
from .keyed import folded


def edges(truths: DataFrame, predictions: DataFrame, on: list[str], tolerance: int) -> DataFrame:
    """truths(on, truth_id, earliest, latest) and predictions(on, prediction_id, at) within tolerance of the interval, with their distance."""
    near = truths.withColumn("__from", F.col("earliest") - tolerance).withColumn("__to", F.col("latest") + tolerance + 1)
    cost = F.greatest(F.col("earliest") - F.col("at"), F.col("at") - F.col("latest"), F.lit(0))
    return ranges.meet(predictions, near, on, "at", "__from", "__to", 2 * tolerance + 1).withColumn("cost", cost).drop("__from", "__to")


def assign(costs: np.ndarray) -> list[tuple[int, int]]:
    """Most pairs, then least total cost; costs: rows x columns of whole numbers, negative where there is no edge.

    Rows are added one by one, each along a cheapest alternating path under dual
    prices; every row may also take a place of its own that costs more than any
    change of real pairs could save.
    """
    n, m = costs.shape
    dear = int(costs.max(initial=0)) * (n + m + 1) + 1
    table = np.full((n, m + n), 4 * dear, dtype=object)
    table[:, :m] = np.where(costs >= 0, costs, 4 * dear)
    for i in range(n):
        table[i, m + i] = dear
    table = table.tolist()
    owner = [-1] * (m + n)
    row_price, col_price = [0] * n, [0] * (m + n)
    for start in range(n):
        reach, back, done = [None] * (m + n), [-1] * (m + n), [False] * (m + n)
        row, base, last = start, 0, -1
        while True:
            best = None
            for j in range(m + n):
                if done[j]:
                    continue
                through = base + table[row][j] - row_price[row] - col_price[j]
                if reach[j] is None or through < reach[j]:
                    reach[j], back[j] = through, last
                if best is None or reach[j] < reach[best]:
                    best = j
            done[best], base, last = True, reach[best], best
            if owner[best] < 0:
                break
            row = owner[best]
        row_price[start] += base
        for j in range(m + n):
            if done[j] and j != last:
                row_price[owner[j]] += base - reach[j]
                col_price[j] -= base - reach[j]
        while last >= 0:
            before = back[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    return sorted((owner[j], j) for j in range(m) if owner[j] >= 0 and costs[owner[j], j] >= 0)


def groups_of(pairs: DataFrame, on: list[str]) -> DataFrame:
    """pairs with the number of their connected group: pairs that share a truth or prediction, at once or by others.

    Intervals lie on one axis, so groups are runs of it: a pair that begins after
    the end of all earlier ones begins a new group. That may join groups, never cut one.
    """
    begin, end = F.least("earliest", "at"), F.greatest("latest", "at")
    order = Window.partitionBy(*on).orderBy("__begin", "truth_id", "prediction_id")
    laid = pairs.withColumn("__begin", begin).withColumn("__end", end)
    so_far = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(so_far.isNull() | (F.col("__begin") > so_far), 1).otherwise(0)
    return laid.withColumn("__new", new).withColumn("matching_group", F.sum("__new").over(order)).drop("__begin", "__end", "__new")


def best_matching(pairs: DataFrame, on: list[str]) -> DataFrame:
    """A best matching of edges (on, truth_id, prediction_id, earliest, latest, at, cost), group by group: groups share nothing, so they don't interact.

    Most pairs, then least total cost, then least sum of squared costs: on one axis
    pairs that cross cost as much in all as those that don't.
    """

    n = len(on)

    def solve(part: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(part)
        truths, predictions = sorted({r[n + 1] for r in rows}), sorted({r[n + 2] for r in rows})
        row, column = {t: k for k, t in enumerate(truths)}, {p: k for k, p in enumerate(predictions)}
        costs = np.full((len(truths), len(predictions)), -1, dtype=object)
        for r in rows:
            costs[row[r[n + 1]], column[r[n + 2]]] = r[n + 3]
        dearest = int(costs.max()) ** 2 * len(truths) + 1  # more than all squares together
        ranked = np.where(costs >= 0, costs * dearest + costs**2, -1)
        for i, j in assign(ranked):
            yield *rows[0][:n], truths[i], predictions[j], costs[i, j]

    fields = [f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in [*on, "truth_id", "prediction_id"]]
    columns = [*on, "truth_id", "prediction_id", "cost"]
    # a pair alone in its group is its matching; only other groups go through Python
    size = F.count(F.lit(1)).over(Window.partitionBy(*on, "matching_group"))
    grouped = groups_of(pairs, on).select(*on, "matching_group", "truth_id", "prediction_id", F.col("cost").cast("long").alias("cost")).withColumn("__n", size)
    several = folded(grouped.where("__n > 1").drop("__n"), [*on, "matching_group"], ["truth_id", "prediction_id"], solve, ", ".join([*fields, "cost long"]))
    return several.select(*columns).unionByName(grouped.where("__n = 1").select(*columns))


def metrics(truths: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row over the matches of truths(truth_id, direction) with predictions(prediction_id, direction, abstained).

    Abstained predictions leave the denominator of precision, truths never leave that
    of recall; a ratio without a denominator is null. ``matches`` carry t_direction and
    p_direction; those of a truth of unknown direction don't count for directions.
    """
    known = F.col("t_direction") != "unknown"
    hits = matches.agg(F.count(F.lit(1)).alias("tp"), F.count_if(known).alias("direction_eligible"), F.count_if(known & (F.col("t_direction") == F.col("p_direction"))).alias("direction_correct"))
    asked = truths.agg(F.count(F.lit(1)).alias("n_truths"))
    said = predictions.agg(F.count_if(~F.col("abstained")).alias("n_active"), F.count_if("abstained").alias("abstained"))
    n = asked.crossJoin(said).crossJoin(hits)  # three tables of one row
    return n.select(
        "tp", (F.col("n_active") - F.col("tp")).alias("fp"), (F.col("n_truths") - F.col("tp")).alias("fn"), "abstained", "direction_eligible", "direction_correct",
        F.try_divide("tp", "n_active").alias("precision"), F.try_divide("tp", "n_truths").alias("recall"),
    )


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    """Counts of (truth, predicted) for all combinations of the labels, zeros kept."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], pairs.select("truth", "predicted").schema)
    counted = pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("c"))
    return grid.join(counted, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("c", F.lit(0)).alias("n"))


#: The signal labels, in their order.
SIGNALS = ("left_blink", "right_blink", "both_blink", "no_blink_observed", "unknown")


def signal_coverage(truths: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: signals of matches(t_signal, p_signal) against all truths(signal), so a missed truth stays in every denominator."""
    t, p = F.col("t_signal"), F.col("p_signal")
    hits = matches.agg(
        F.count_if(p != "unknown").alias("matched_known"), F.count_if((t != "unknown") & (p != "unknown")).alias("known_on_observable"),
        F.count_if((t != "unknown") & (t == p)).alias("correct"), F.count_if((t == "unknown") & (p == "no_blink_observed")).alias("unknown_to_no_blink"),
    )
    asked = truths.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("signal") != "unknown").alias("truth_known"))
    return asked.crossJoin(hits)


def label_problems(rows: DataFrame, id_column: str, labels: str) -> DataFrame:
    """Rows whose id occurs twice or isn't an identifier, or whose label is none of the signals."""
    n = F.count(F.lit(1)).over(Window.partitionBy(id_column))
    problem = (
        F.when(~F.coalesce(F.col(id_column).cast("string").rlike(r"^[A-Za-z0-9_.-]{1,64}\z"), F.lit(False)), "not an identifier").when(n > 1, "an id occurs twice")
        .when(~F.coalesce(F.col(labels).isin(*SIGNALS), F.lit(False)), "unknown label")
    )
    return rows.withColumn("problem", problem).where("problem is not null")

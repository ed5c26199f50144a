"""The functions that SQL lacks, under names that SQL can use."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from ..operators.receipts import canonical_json, ratio_text, region_sum


@F.pandas_udf(T.LongType())
def common_divisor(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greatest common divisor; null where a number is missing."""
    return pd.Series([None if pd.isna(x) or pd.isna(y) else math.gcd(int(x), int(y)) for x, y in zip(a, b)], dtype="Int64")


CORNERS = ["x1", "y1", "x2", "y2"]


def placed(degrees, cw, ch, c, p) -> tuple:
    """One part's box in the raster, by fractions until the last step."""
    left, top, right, bottom = map(Fraction, c)
    wide, high = right - left, bottom - top
    sideways = int(degrees) in (90, 270)
    seen_w, seen_h = (high, wide) if sideways else (wide, high)
    u = [Fraction(v) * seen_w / int(cw) for v in (p[0], p[2])]
    v = [Fraction(w) * seen_h / int(ch) for w in (p[1], p[3])]
    # each axis of the raster runs along one axis of the canvas, forwards or backwards
    xs, ys = {0: (u, v), 90: (v, [high - a for a in u]), 180: ([wide - a for a in u], [high - b for b in v]), 270: ([wide - b for b in v], u)}[int(degrees)]
    return tuple(map(float, (left + min(xs), top + min(ys), left + max(xs), top + max(ys))))


def placed_rows(degrees: np.ndarray, cw: np.ndarray, ch: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``placed`` of many rows, all of doubles; rows with a nan give nans.

    Worked out in long doubles. Where all within the bound of their error rounds to one
    double, that is the exact result rounded; other rows are worked out as fractions.
    """
    given = np.column_stack([degrees, cw, ch, c, p])
    there = ~np.isnan(given).any(axis=1)
    with np.errstate(all="ignore"):
        d, w, h = (np.trunc(v).astype(np.longdouble) for v in (degrees, cw, ch))
        (left, top, right, bottom), (x1, y1, x2, y2) = c.T.astype(np.longdouble), p.T.astype(np.longdouble)
        sideways = (d == 90) | (d == 270)
        seen_w, seen_h = np.where(sideways, bottom - top, right - left), np.where(sideways, right - left, bottom - top)
        u, v = (x1 * seen_w / w, x2 * seen_w / w), (y1 * seen_h / h, y2 * seen_h / h)
        out, sure = np.full((len(given), 4), np.nan), np.isfinite(given).all(axis=1) & (w != 0) & (h != 0) & np.isin(d, (0, 90, 180, 270))
        for k, (low, high, along, back) in enumerate(((left, right, [np.where(sideways, b, a) for a, b in zip(u, v)], d >= 180), (top, bottom, [np.where(sideways, a, b) for a, b in zip(u, v)], (d == 90) | (d == 180)))):
            base = np.where(back, high, low)
            edges = [base + np.where(back, -a, a) for a in along]
            error = 3 * np.finfo(np.longdouble).eps * (np.abs(base) + np.maximum(np.abs(along[0]), np.abs(along[1])))  # four roundings, and that of edge and bound
            for place, edge in ((k, np.minimum(*edges)), (k + 2, np.maximum(*edges))):
                out[:, place] = edge
                sure &= ((edge - error).astype(float) == (edge + error).astype(float)) & np.isfinite(out[:, place])
        out[~there] = np.nan
    for i in np.flatnonzero(there & ~sure):
        out[i] = placed(degrees[i], cw[i], ch[i], c[i].tolist(), p[i].tolist())
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in CORNERS]))
def part_to_coded(turn: pd.Series, canvas_w: pd.Series, canvas_h: pd.Series, crop: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """A part's box on the resized canvas of a crop that was turned clockwise, in the raster that the crop (x1..y2) is of.

    Exact until the last step, so an edge on a whole pixel stays there. Nulls give nulls.
    """
    numbers = lambda v: v.to_numpy(dtype=float, na_value=np.nan)
    return pd.DataFrame(placed_rows(numbers(turn), numbers(canvas_w), numbers(canvas_h), numbers(crop[CORNERS]), numbers(part[CORNERS])), columns=CORNERS)


def register(spark: SparkSession) -> None:
    for name, function in (("canonical_json", canonical_json), ("ratio_text", ratio_text), ("region_sum", region_sum), ("common_divisor", common_divisor), ("part_to_coded", part_to_coded)):
        spark.udf.register(name, function)

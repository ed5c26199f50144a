"""Boxes, letterboxes, rotations and regions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .keyed import tasks_of

BOX = ("x1", "y1", "x2", "y2")


def clip(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The part of a box inside the raster; all null if that is empty."""
    inside = {
        "x1": F.greatest(box["x1"], F.lit(0)), "y1": F.greatest(box["y1"], F.lit(0)),
        "x2": F.least(box["x2"], width), "y2": F.least(box["y2"], height),
    }
    there = (inside["x1"] < inside["x2"]) & (inside["y1"] < inside["y2"])
    return {k: F.when(there, v) for k, v in inside.items()}


def area(prefix: str = "") -> Column:
    x1, y1, x2, y2 = (F.col(prefix + c) for c in BOX)
    return (x2 - x1) * (y2 - y1)


def overlap(a: str, b: str) -> Column:
    """Area common to two half-open boxes given by column prefixes."""
    wide = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    high = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou_at_least(a: str, b: str, numerator: int, denominator: int) -> Column:
    """overlap / union >= numerator / denominator, exactly for whole coordinates."""
    common = overlap(a, b)
    return common * F.lit(denominator) >= F.lit(numerator) * (area(a) + area(b) - common)


def letterbox(width: Column, height: Column, target_width: int, target_height: int) -> tuple[Column, Column]:
    """Resized width and height of a picture that keeps its shape in the target."""
    tw, th = F.lit(target_width), F.lit(target_height)
    div = lambda a, b: F.floor(a / b)  # noqa: E731  whole numbers far below 2**53
    return F.least(tw, div(width * th, height)), F.least(th, div(height * tw, width))


def from_letterbox(value: Column, content: Column, original: Column) -> Column:
    """A coordinate of the resized picture, clipped to its content, in the original."""
    return F.least(F.greatest(value, F.lit(0)), content) * original / content


def unrotate(rotation: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A displayed point in coded axes; width and height are the coded ones."""
    u = F.when(rotation == 0, x).when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, width - y)
    v = F.when(rotation == 0, y).when(rotation == 90, height - x).when(rotation == 180, height - y).when(rotation == 270, x)
    return u, v


def whole_pixels(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels that lie in a region as a whole."""
    return F.greatest(F.lit(0), F.floor(x2) - F.ceil(x1)) * F.greatest(F.lit(0), F.floor(y2) - F.ceil(y1))


MOST_ROWS = 512


def post_nms(rows: DataFrame, classes: list[int]) -> DataFrame:
    """rows(source, values array of [x1, y1, x2, y2, objectness, class score, class]): kept detections with their original index and score."""
    fits = (F.size("values") <= MOST_ROWS) & F.forall("values", lambda v: F.size(v) == 7)
    rows = rows.withColumn("values", F.when(fits, F.col("values")).otherwise(F.raise_error(F.lit("more than 512 rows, or a row without 7 columns")).cast(rows.schema["values"].dataType)))
    each = rows.select("*", F.posexplode("values").alias("det_index", "v")).withColumn("class_id", F.get("v", F.lit(6)).cast("int"))
    score = F.get("v", F.lit(4)) * F.get("v", F.lit(5))
    return each.where(F.col("class_id").isin(classes)).withColumn("score", score)


def pairs_of_class(boxes: DataFrame, on: list[str], numerator: int, denominator: int, cell: int = 48) -> DataFrame:
    """Pairs (lower index first) of boxes equal in ``on`` that overlap enough.

    Boxes join by cells of a grid, so a key with very many boxes is dealt over the
    grid. Of an overlap of at least a share of both boxes the first corner lies within
    the rest of each box's extent, so only that part of a box is laid on the grid. The
    right box of a pair stands in its own column of cells, which can be narrow. A pair
    counts in the cell of its common part's first corner alone.
    """
    narrow, tasks = max(1, cell // 4), tasks_of(boxes.sparkSession)

    def cells(low: str, high: str, width: int) -> Column:
        rest = (F.col(high) - F.col(low)) * ((denominator - numerator) / denominator)
        first, slack = F.floor(F.col(low) / width), 1e-9 * (F.abs(low) + F.abs(high))
        return F.explode(F.sequence(first, F.greatest(first, F.floor((F.col(low) + rest + slack) / width))))

    side = lambda rows, p: rows.select(*on, "__cx", "__cy", *[F.col(c).alias(f"{p}_{c}") for c in ("idx", *BOX)]).repartition(tasks, *on, "__cx", "__cy")
    rows = boxes.withColumn("__cy", cells("y1", "y2", cell))
    left, right = side(rows.withColumn("__cx", cells("x1", "x2", narrow)), "l"), side(rows.withColumn("__cx", F.floor(F.col("x1") / narrow)), "r")
    ordered = (F.col("l_x1") < F.col("r_x1")) & (F.col("l_idx") != F.col("r_idx")) | (F.col("l_x1") == F.col("r_x1")) & (F.col("l_idx") < F.col("r_idx"))
    home = F.floor(F.greatest("l_y1", "r_y1") / cell) == F.col("__cy")
    met = left.join(right, [*on, "__cx", "__cy"]).where(ordered & iou_at_least("l_", "r_", numerator, denominator) & home)
    lower = F.col("l_idx") < F.col("r_idx")
    pick = lambda c, a, b: F.when(lower, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}"))
    return met.select(*on, *[pick(c, "l", "r").alias(f"a_{c}") for c in ("idx", *BOX)], *[pick(c, "r", "l").alias(f"b_{c}") for c in ("idx", *BOX)])


def box_from_letterbox(box: dict[str, Column], content: tuple[Column, Column], original: tuple[Column, Column]) -> dict[str, Column]:
    """A box of the resized picture in the original: clipped to the content, scaled by each axis, null if nothing is left."""
    places = {c: from_letterbox(box[c], content[c[0] == "y"], original[c[0] == "y"]) for c in BOX}
    return clip(places, *original)


def within_view(x: Column, y: Column, width: Column, height: Column) -> Column:
    """x, or an error if the point lies outside of the view."""
    good = (x >= 0) & (x <= width) & (y >= 0) & (y <= height)
    return F.when(good, x).otherwise(F.raise_error(F.lit("a point lies outside of the view")).cast("double"))

"""Page geometry as Columns. Halves round up, as floor(x + 0.5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid of the model's frame and its pixel limits.
GRID, LEAST_PIXELS, MOST_PIXELS = 28, 3136, 11_289_600


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def smart_resize(height: Column, width: Column, most: int = MOST_PIXELS, least: int = LEAST_PIXELS) -> Column:
    """struct<height, width>: both on the grid, area within the limits, aspect kept as near as the grid allows."""
    h, w = half_up(height / GRID) * GRID, half_up(width / GRID) * GRID
    over, under = F.sqrt(height * width / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (height * width))
    big = h * w > most
    small = h * w < least
    down = lambda side: F.floor(side / over / GRID) * GRID
    up = lambda side: F.ceil(side * under / GRID) * GRID
    pick = lambda plain, side: F.when(big, down(side)).when(small, up(side)).otherwise(plain).cast("long")
    return F.struct(pick(h, height).alias("height"), pick(w, width).alias("width"))


def line_height(height: Column, text: Column) -> Column:
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return height / F.greatest(F.lit(1), breaks + 1, half_up(height / 40))


def type_size(height: Column, text: Column) -> Column:
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(breaks > 0, height / (breaks + 1)).when(F.char_length(text) > 90, line_height(height, text)).otherwise(height.cast("double"))


def alignment_class(x1: Column, x2: Column, body_x1: Column, body_x2: Column) -> Column:
    """'center', 'right' or '' by the margins within the body column, as shares of its width."""
    width = F.greatest(F.lit(1), body_x2 - body_x1)
    left, right = (x1 - body_x1) / width, (body_x2 - x2) / width
    centered = (left > 0.06) & (right > 0.06) & (F.abs(left - right) < 0.4 * F.greatest(left, right))
    return F.when(centered, "center").when((left > 0.45) & (right < 0.03), "right").otherwise("")


def quad_area(points: Column) -> Column:
    """Area of a quadrilateral, an array of four [x, y] arrays."""
    terms = [points[i][0] * points[(i + 1) % 4][1] - points[(i + 1) % 4][0] * points[i][1] for i in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2


def output_size(points: Column) -> Column:
    """struct<width, height> of a rectified quadrilateral: the longer of each pair of opposite sides, rounded, one at least."""
    side = lambda a, b: F.hypot(points[b][0] - points[a][0], points[b][1] - points[a][1])
    size = lambda p, q: F.greatest(F.lit(1), half_up(F.greatest(p, q))).cast("long")
    return F.struct(size(side(0, 1), side(3, 2)).alias("width"), size(side(1, 2), side(0, 3)).alias("height"))


def turned(points: Column, quarters: int) -> Column:
    """The quadrilateral's corners named anew after so many clockwise quarter turns."""
    k = quarters % 4
    return F.array(*[points[(i - k) % 4] for i in range(4)])


def render_scale(height: Column, width: Column, most: int = MOST_PIXELS) -> Column:
    """How much a box grows to be back in the frame of its picture: one number for both axes."""
    return width / smart_resize(height, width, most)["width"]


def box_to_display(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, points_wide: Column, points_high: Column, quarters: int = 0) -> Column:
    """struct<x, y, w, h> in points, y upwards from the foot of the page. The page is shown after so many clockwise quarter
    turns; points_wide and points_high are its size as shown, boxes are in the pixels of the page as shown."""
    sx, sy = points_wide / width, points_high / height
    left, right, low, high = x1 * sx, x2 * sx, points_high - y2 * sy, points_high - y1 * sy
    k = quarters % 4
    corner = ((left, low), (low, points_wide - right), (points_wide - right, points_high - high), (points_high - high, left))[k]
    w, h = right - left, high - low
    return F.struct(corner[0].alias("x"), corner[1].alias("y"), (w if k % 2 == 0 else h).alias("w"), (h if k % 2 == 0 else w).alias("h"))


def same_shape(points: Column, other: Column, tolerance: float = 0.02) -> Column:
    """Whether two quadrilaterals have about the same ratio of width to height."""
    ratio = lambda q: (lambda s: s["width"] / s["height"])(output_size(q))
    return F.abs(ratio(points) / ratio(other) - 1) <= tolerance


def halves(points: Column, at: Column) -> Column:
    """The left and right parts of a quadrilateral that is cut from its top to its foot at this share of its width."""
    mix = lambda a, b: F.array(points[a][0] + (points[b][0] - points[a][0]) * at, points[a][1] + (points[b][1] - points[a][1]) * at)
    top, foot = mix(0, 1), mix(3, 2)
    return F.array(F.array(points[0], top, foot, points[3]), F.array(top, points[1], points[2], foot))

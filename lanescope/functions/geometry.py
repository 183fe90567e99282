"""Column geometry: boxes, motion of pairs, lines and polygons. Polygons and lines are lists of (x, y) on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Points = list[tuple[float, float]]


def ground_x(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def box_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Root of the box's area; sides count as one pixel at least."""
    return F.sqrt(F.greatest(x2 - x1, F.lit(1.0)) * F.greatest(y2 - y1, F.lit(1.0)))


def shared_area(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: list[Column], b: list[Column]) -> Column:
    s = shared_area(a, b)
    return s / (area(a) + area(b) - s + 1e-9)


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def time_to_contact(px: Column, py: Column, vx: Column, vy: Column, radius: Column) -> Column:
    """When two discs, p apart and closing at v, touch: 0 if they do now, null if they never will."""
    a, b, c = vx * vx + vy * vy, 2 * (px * vx + py * vy), px * px + py * py - radius * radius
    disc = b * b - 4 * a * c
    meets = (a > 1e-9) & (b < 0) & (disc >= 0)
    return F.when(c <= 0, 0.0).when(meets, (-b - F.sqrt(F.when(meets, disc).otherwise(0.0))) / (2 * a))


def closing_speed(px: Column, py: Column, vx: Column, vy: Column, size: Column) -> Column:
    return -(px * vx + py * vy) / (F.hypot(px, py) + 1e-9) / size


def side_of_line(line: Points, x: Column, y: Column) -> Column:
    (ax, ay), (bx, by) = line
    return F.signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))


def along_line(line: Points, x: Column, y: Column) -> Column:
    """Where the point projects onto the line: 0 at its first end, 1 at its second."""
    (ax, ay), (bx, by) = line
    return ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)


def polyline_side(line: Points, x: Column, y: Column, reach: Column) -> Column:
    """Side of the nearest segment, the first of equals; 0 beyond reach."""
    best = []
    for k, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:], strict=False)):
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along_line([(ax, ay), (bx, by)], x, y)))
        d = F.hypot(x - (ax + u * (bx - ax)), y - (ay + u * (by - ay)))
        best.append(F.struct(d.alias("d"), F.lit(k).alias("k"), side_of_line([(ax, ay), (bx, by)], x, y).alias("side")))
    near = F.least(*best) if len(best) > 1 else best[0]
    return F.when(near["d"] > reach, 0.0).otherwise(near["side"])


def in_polygon(poly: Points, x: Column, y: Column) -> Column:
    """Inside or on the boundary: even-odd crossings, or on an edge."""
    crossings, on = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1], strict=True):
        if ay != by:
            crosses = ((y >= min(ay, by)) & (y < max(ay, by))) & (x < ax + (y - ay) * ((bx - ax) / (by - ay)))
            crossings = crossings + crosses.cast("int")
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on = on | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    return (crossings % 2 == 1) | on


def in_any(polys: list[Points], x: Column, y: Column) -> Column:
    out = F.lit(False)
    for p in polys:
        out = out | in_polygon(p, x, y)
    return out


def grown(poly: Points, by: float) -> Points:
    """A rectangle's corners moved outwards on both axes; other polygons are grown as their bounding rectangle."""
    xs, ys = [p[0] for p in poly], [p[1] for p in poly]
    return [(min(xs) - by, min(ys) - by), (max(xs) + by, min(ys) - by), (max(xs) + by, max(ys) + by), (min(xs) - by, max(ys) + by)]


def first_polygon(polys: list[Points], x: Column, y: Column, grow: float = 0.0) -> Column:
    """1 + the index of the first polygon with the point, 0 if none."""
    out = F.lit(0)
    for k in range(len(polys) - 1, -1, -1):
        p = grown(polys[k], grow) if grow else polys[k]
        out = F.when(in_polygon(p, x, y), k + 1).otherwise(out)
    return out


def touching_groups(polys: list[Points], grow: float) -> list[int]:
    """A group number for each polygon; rectangles that touch once grown share one. For a scene's handful of zones."""
    box = [grown(p, grow) for p in polys]
    group = list(range(len(polys)))
    for i in range(len(polys)):
        for j in range(i):
            if box[i][0][0] <= box[j][2][0] and box[j][0][0] <= box[i][2][0] and box[i][0][1] <= box[j][2][1] and box[j][0][1] <= box[i][2][1]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def moved(poly: Points, affine: tuple[float, float, float, float, float, float]) -> Points:
    """An affine map (a, b, tx, c, d, ty) of the points, rounded to 5 places."""
    a, b, tx, c, d, ty = affine
    return [(round(a * x + b * y + tx, 5), round(c * x + d * y + ty, 5)) for x, y in poly]


def heading_cosine(vx: Column, vy: Column, direction: tuple[float, float]) -> Column:
    n = math.hypot(*direction)
    return (vx * (direction[0] / n) + vy * (direction[1] / n)) / (F.hypot(vx, vy) + 1e-9)


# shapes held in columns: arrays of (x, y), so that each row can have its own


def edges(points: Column) -> Column:
    """The sides of a polygon as (a, b) pairs of points, the last one back to the first."""
    n = F.size(points)
    return F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds the point, boundary included: even-odd crossings, or on a side."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        level = (y >= F.least(a["y"], b["y"])) & (y < F.greatest(a["y"], b["y"]))
        return level & (x < a["x"] + (y - a["y"]) * ((b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        within = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return within & ((b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"]))

    sides = edges(points)
    return (F.size(F.filter(sides, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1) | F.exists(sides, on)


def square_distance(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Chebyshev distance from the point to the segment a-b: half the side of the least square about the point that meets it.
    It lies at an end, or where both coordinates are equally far."""
    px, py, ux, uy = ax - x, ay - y, bx - ax, by - ay
    places = [F.lit(0.0), F.lit(1.0), -(px - py) / F.nullif(ux - uy, F.lit(0.0)), -(px + py) / F.nullif(ux + uy, F.lit(0.0))]
    inside = [F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for t in places]
    return F.least(*[F.greatest(F.abs(px + t * ux), F.abs(py + t * uy)) for t in inside])


def contains_within(points: Column, x: Column, y: Column, by: float) -> Column:
    """Whether a polygon widened by a square, `by` to each side, holds the point."""
    if by == 0:
        return contains(points, x, y)
    near = lambda e: square_distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], x, y) <= by
    return contains(points, x, y) | F.exists(edges(points), near)

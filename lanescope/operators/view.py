"""Scenes seen from another view or at another resolution: zones, grids, and the bounds of what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.functions.geometry import moved

from .runs import TRACK, over
from .scene import flow_direction

Affine = tuple[float, float, float, float, float, float]  # (a, b, tx, c, d, ty): x' = a x + b y + tx, y' = c x + d y + ty


def grid_size(width: int, cells: int) -> int:
    """The side of a cell in pixels: a fixed share of the width, 8 at least."""
    return max(8, round(width / cells))


def moved_box(box: tuple[float, float, float, float], affine: Affine) -> tuple[float, float, float, float]:
    """The box around a box's moved corners."""
    x1, y1, x2, y2 = box
    xs, ys = zip(*moved([(x1, y1), (x2, y1), (x1, y2), (x2, y2)], affine), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def moved_direction(direction: tuple[float, float], affine: Affine, aspect: float = 1.0) -> tuple[float, float]:
    """A direction in pixels under the linear part of an affine map of normalised points; aspect: width / height."""
    a, b, _, c, d, _ = affine
    x, y = direction
    return a * x + b * y * aspect, c * x / aspect + d * y


def moved_scene(scene: dict[str, list], affine: Affine | None) -> dict[str, list]:
    """Lists of zones by name (lists of points) under the map; as they were where there is none."""
    return scene if affine is None else {name: [moved(zone, affine) for zone in zones] for name, zones in scene.items()}


def inverse(affine: Affine) -> Affine:
    a, b, tx, c, d, ty = affine
    det = a * d - b * c
    return d / det, -b / det, (b * ty - d * tx) / det, -c / det, a / det, (c * tx - a * ty) / det


def moved_grid(cells: DataFrame, affine: Affine, ny: int, nx: int) -> DataFrame:
    """cells (video_id, cy, cx, ...) under a map of cell coordinates: every cell of the new grid takes the values of the
    cell nearest to where it came from, and is missing where that lies outside."""
    a, b, tx, c, d, ty = inverse(affine)
    grid = cells.select("video_id").distinct()
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    source = grid.withColumns({"cx": F.floor(a * F.col("x") + b * F.col("y") + (tx + 0.5)).cast("int"), "cy": F.floor(c * F.col("x") + d * F.col("y") + (ty + 0.5)).cast("int")})
    rest = [n for n in cells.columns if n not in ("video_id", "cy", "cx")]
    return source.join(cells, ["video_id", "cy", "cx"]).select("video_id", F.col("y").alias("cy"), F.col("x").alias("cx"), *rest)


def rescaled_grid(grid: int, size: tuple[int, int], shape: tuple[int, int], new: tuple[int, int]) -> int | None:
    """The cell size with which a field of `shape` (ny, nx) learned at `size` (width, height) serves a recording of size
    `new`; None where the aspects differ by over 0.01 or the shapes would."""
    (w, h), (nw, nh) = size, new
    if abs(w / h - nw / nh) > 0.01:
        return None
    scaled = max(8, round(grid * nw / w))
    return scaled if (-(-nh // scaled), -(-nw // scaled)) == shape else None


def shown_tracks(kin: DataFrame, least: int = 3, step: float = 40.0) -> DataFrame:
    """Rows of tracks with at least `least` points and no step between them of over `step`."""
    w, own = over(), Window.partitionBy(*TRACK)
    far = F.hypot(F.col("gx") - F.lag("gx").over(w), F.col("gy") - F.lag("gy").over(w))
    marked = kin.withColumn("_far", F.coalesce(far, F.lit(0.0))).withColumns({"_most": F.max("_far").over(own), "_n": F.count("*").over(own)})
    return marked.where((F.col("_n") >= least) & (F.col("_most") <= step)).drop("_far", "_most", "_n")


def lane_arrows(flow: DataFrame, axis: DataFrame, least: int, coherence: float) -> DataFrame:
    """(video_id, cy, cx, ux, uy, onward): every other cell with enough rows of one direction, and whether it runs along the axis."""
    d = flow_direction(flow).where((F.col("n") >= least) & (F.col("coherence") >= coherence) & ((F.col("cx") + F.col("cy")) % 2 == 0)).join(axis, "video_id")
    return d.select("video_id", "cy", "cx", "ux", "uy", (F.col("ux") * F.col("ax") + F.col("uy") * F.col("ay") >= 0).alias("onward"))


def density(flow: DataFrame) -> DataFrame:
    """(video_id, cy, cx, density): log density of rows, 1 at the 99th percentile of the video's cells and above."""
    logs = flow.withColumn("log", F.log1p("n"))
    top = logs.groupBy("video_id").agg(F.percentile("log", 0.99).alias("top"))
    return logs.join(top, "video_id").select("video_id", "cy", "cx", F.least(F.col("log") / F.col("top"), F.lit(1.0)).alias("density"))


def crop(boxes: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, x1, y1, x2, y2): a 16:9 crop, in whole pixels inside the frame, around each key's boxes and 1.6 times as
    large, no narrower than 0.3 of the frame."""
    e = boxes.groupBy(*keys).agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    w = F.greatest((F.col("c") - F.col("a")) * 1.6, (F.col("d") - F.col("b")) * 1.6 * 16 / 9, F.lit(0.3 * width))
    e = e.withColumn("w", F.least(w, F.lit(float(width)), F.lit(height * 16 / 9))).withColumn("h", F.col("w") * 9 / 16)
    inside = lambda mid, size, most: F.floor(F.least(F.greatest(mid - size / 2, F.lit(0.0)), most - size))
    e = e.withColumns({"x": inside((F.col("a") + F.col("c")) / 2, F.col("w"), width), "y": inside((F.col("b") + F.col("d")) / 2, F.col("h"), height)})
    return e.select(*keys, F.col("x").cast("int").alias("x1"), F.col("y").cast("int").alias("y1"), F.floor(F.col("x") + F.col("w")).cast("int").alias("x2"), F.floor(F.col("y") + F.col("h")).cast("int").alias("y2"))

"""What tracks teach of a scene: flow grid, its direction, the carriageway, and lookups by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["video_id", "cy", "cx"]


def with_cell(df: DataFrame, grid: float, x: str = "gx", y: str = "gy") -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col(x) / grid).cast("int"), "cy": F.floor(F.col(y) / grid).cast("int")})


def flow_field(kin: DataFrame, grid: float, moving: float) -> DataFrame:
    """(video_id, cy, cx, n, sx, sy): moving rows of all classes but persons, with summed unit vectors, by cell."""
    rows = with_cell(kin.where((F.col("speed") > moving) & (F.col("cls") != "person")), grid)
    norm = F.hypot("vx", "vy") + 1e-9
    return rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum(F.col("vx") / norm).alias("sx"), F.sum(F.col("vy") / norm).alias("sy"))


def merged_flow(*fields: DataFrame) -> DataFrame:
    out = fields[0]
    for f in fields[1:]:
        out = out.unionByName(f)
    return out.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))


def flow_direction(flow: DataFrame) -> DataFrame:
    """Adds ux, uy (the unit direction) and coherence."""
    norm = F.hypot("sx", "sy")
    return flow.withColumns({"ux": F.col("sx") / (norm + 1e-9), "uy": F.col("sy") / (norm + 1e-9), "coherence": norm / (F.col("n") + 1e-9)})


def main_axis(flow: DataFrame) -> DataFrame:
    """(video_id, ax, ay): the axis of traffic, weighted by rows, opposite directions counting as one."""
    d = flow_direction(flow).withColumn("th", F.atan2("uy", "ux"))
    half = 0.5 * F.atan2(F.sum(F.col("n") * F.sin(2 * F.col("th"))), F.sum(F.col("n") * F.cos(2 * F.col("th"))))
    return d.groupBy("video_id").agg(half.alias("a")).select("video_id", F.cos("a").alias("ax"), F.sin("a").alias("ay"))


def neighbours(cells: DataFrame, reach: int) -> DataFrame:
    around = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)).alias(c)
    return cells.select("video_id", around("cy"), "cx").select("video_id", "cy", around("cx"))


def road_cells(flow: DataFrame, least: int, ny: int, nx: int, reach: int = 2) -> DataFrame:
    """Cells with at least `least` rows, closed by a square of 2 * reach + 1 cells; cells beyond the grid are ignored."""
    inside = F.col("cy").between(0, ny - 1) & F.col("cx").between(0, nx - 1)
    wide = neighbours(flow.where(F.col("n") >= least).select(*CELL), reach).where(inside).distinct()
    # a cell stays if all its neighbours in the grid are in the widened set
    have = neighbours(wide, reach).where(inside).groupBy(*CELL).count()
    rows = F.least(F.col("cy") + reach, F.lit(ny - 1)) - F.greatest(F.col("cy") - reach, F.lit(0)) + 1
    cols = F.least(F.col("cx") + reach, F.lit(nx - 1)) - F.greatest(F.col("cx") - reach, F.lit(0)) + 1
    return have.where(F.col("count") == rows * cols).select(*CELL).join(wide, CELL, "left_semi")


def with_road(df: DataFrame, road: DataFrame, grid: float, ny: int, nx: int) -> DataFrame:
    """Adds on_road: whether the row's cell, taken inside the frame, is road. The road table has a grid's cells per video."""
    clip = lambda c, n: F.greatest(F.least(F.floor(F.col(c) / grid).cast("int"), F.lit(n - 1)), F.lit(0))
    at = df.withColumns({"cx": clip("gx", nx), "cy": clip("gy", ny)})
    return at.join(road.withColumn("_r", F.lit(True)), CELL, "left").withColumn("on_road", F.coalesce("_r", F.lit(False))).drop("_r")


def with_lane(df: DataFrame, flow: DataFrame, grid: float) -> DataFrame:
    """Adds ux, uy and coherence of the row's cell; nulls where no flow is known."""
    return with_cell(df, grid).join(flow_direction(flow).select(*CELL, "ux", "uy", "coherence"), CELL, "left")


def signal_code(red: Column, green: Column, least: float) -> Column:
    """1 red, 2 green, 0 neither: lit enough and more than the other."""
    return F.when((red >= least) & (red > green), 1).when((green >= least) & (green > red), 2).otherwise(0)

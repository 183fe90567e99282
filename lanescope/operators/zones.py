"""Scenes as tables: zones and approaches of any number of videos, each with its own.

zones: (video_id, kind, zone_id, points array<struct<x, y>>), zone_id from 1 in the order they were drawn, for each kind.
approaches: (video_id, approach, ax, ay, bx, by of the stop line, dx, dy as a unit vector of travel, box array or null,
red_delay, red_early).

Points meet zones through a grid index: a row for each cell that a zone may reach, with the zones near it, so a point meets one
row by equality and tests only what is near. Its row count doesn't change and nothing is broadcast unless Spark sees that it is small.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.functions import geometry as G

CELL = ["video_id", "cy", "cx"]
POINTS = "array<struct<x:double,y:double>>"
ZONES = f"video_id long, kind string, zone_id int, points {POINTS}"
APPROACHES = f"video_id long, approach string, ax double, ay double, bx double, by double, dx double, dy double, box {POINTS}, red_delay double, red_early double"
#: Document of a scene in unit coordinates, one per video.
DOCUMENT = (
    "struct<carriageway:array<array<array<double>>>,crosswalks:array<array<array<double>>>,refuges:array<array<array<double>>>,solid_lines:array<array<array<double>>>,"
    "approaches:array<struct<name:string,stop_line:array<array<double>>,direction:array<double>,signal_roi:array<double>,intersection:array<array<double>>,red_delay_sec:double,red_early_end_sec:double>>,"
    "movements:struct<u_turn_prohibited:array<array<array<double>>>,forbidden:array<struct<from:array<array<double>>,to:array<array<double>>>>>>"
)
KINDS = {"carriageway": "carriageway", "crosswalks": "crosswalk", "refuges": "refuge", "solid_lines": "solid_line"}


# reading


def read_scenes(documents: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zones, approaches) in pixels of documents (video_id, value as JSON) and videos (video_id, width, height).

    A zone that is missing, or has no point, gives no row; forbidden moves give a zone of kind `from` and one of kind `to` with one number.
    Junctions are the approaches' boxes, as zones too. Videos without a document have neither.
    """
    d = documents.join(videos.select("video_id", "width", "height"), "video_id").withColumn("doc", F.from_json("value", DOCUMENT)).drop("value").where("doc is not null")
    scaled = lambda p: F.transform(p, lambda q: F.struct((q[0] * F.col("width")).alias("x"), (q[1] * F.col("height")).alias("y")))

    def kind(name: str, lists: Column) -> DataFrame:
        rows = d.select("video_id", "width", "height", F.posexplode(lists).alias("i", "p")).where(F.size("p") > 0)
        return rows.select("video_id", F.lit(name).alias("kind"), (F.col("i") + 1).alias("zone_id"), scaled(F.col("p")).alias("points"))

    zones = [kind(name, F.col(f"doc.{source}")) for source, name in KINDS.items()]
    moves = F.col("doc.movements.forbidden")
    zones += [kind("no_u_turn", F.col("doc.movements.u_turn_prohibited")), kind("from", F.transform(moves, lambda m: m["from"])), kind("to", F.transform(moves, lambda m: m["to"]))]
    zones.append(kind("junction", F.filter(F.transform("doc.approaches", lambda a: a["intersection"]), lambda p: p.isNotNull())))
    out = zones[0]
    for z in zones[1:]:
        out = out.union(z)
    a = d.select("video_id", "width", "height", F.explode("doc.approaches").alias("a")).withColumns({"line": scaled(F.col("a.stop_line")), "n": F.hypot(F.col("a.direction")[0], F.col("a.direction")[1])})
    a = a.where(F.coalesce(F.col("n") > 0, F.lit(False)))  # a direction is needed
    ends = [F.get("line", F.lit(0)), F.element_at("line", -1)]
    approaches = a.select(
        "video_id",
        F.col("a.name").alias("approach"),
        *[ends[i][c].alias(f"{'ab'[i]}{c}") for i in (0, 1) for c in "xy"],
        *[(F.col("a.direction")[i] / F.col("n")).alias(f"d{c}") for i, c in enumerate("xy")],
        F.when(F.size("a.intersection") > 0, scaled(F.col("a.intersection"))).alias("box"),
        F.coalesce("a.red_delay_sec", F.lit(0.0)).alias("red_delay"),
        F.coalesce("a.red_early_end_sec", F.lit(0.0)).alias("red_early"),
    )
    return out, approaches


def scene_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, value) of a folder of JSON scenes named by video number."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("long").alias("video_id"), "value")
    return rows.where("video_id is not null")


def zone_table(spark: SparkSession, zones: dict[int, dict[str, list[G.Points]]]) -> DataFrame:
    """The table of zones by video and kind, given on the driver."""
    return spark.createDataFrame([(v, kind, i + 1, [tuple(map(float, p)) for p in z]) for v, kinds in zones.items() for kind, own in kinds.items() for i, z in enumerate(own)], ZONES)


# the grid index


def zone_index(zones: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """(video_id, cy, cx, near): the zones whose box, `grow` wider on each side, reaches a cell. A cell has as many as are drawn there."""
    bound = lambda c, f, by: f(F.transform("points", lambda p: p[c])) + by
    spans = {c: F.sequence(F.floor(bound(c, F.array_min, -grow) / cell).cast("int"), F.floor(bound(c, F.array_max, grow) / cell).cast("int")) for c in "yx"}
    rows = zones.where(F.size("points") > 0).select("video_id", "kind", "zone_id", "points", F.explode(spans["y"]).alias("cy"), spans["x"].alias("xs"))
    rows = rows.select("video_id", "kind", "zone_id", "points", "cy", F.explode("xs").alias("cx"))
    return rows.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("kind", "zone_id", "points"))).alias("near"))


def with_zones(rows: DataFrame, index: DataFrame, cell: float, lookups: dict[str, tuple[str, float]], x: str = "gx", y: str = "gy") -> DataFrame:
    """rows with, for each name -> (kind, grow), the first zone of that kind that holds the point, grown by a square: its
    zone_id, 0 where there is none. The index has to reach as far as the largest growth. Rows without a place are in no zone."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    own = rows.withColumns({"_cy": at(y), "_cx": at(x)})
    near = index.select(F.col("video_id").alias("_v"), F.col("cy").alias("_y"), F.col("cx").alias("_x"), F.col("near").alias("_near"))
    met = own.join(near, (F.col("video_id") == F.col("_v")) & (F.col("_cy") == F.col("_y")) & (F.col("_cx") == F.col("_x")), "left")
    found = {name: first_zone(F.col("_near"), kind, F.col(x), F.col(y), grow) for name, (kind, grow) in lookups.items()}
    return met.withColumns(found).drop("_cy", "_cx", "_v", "_y", "_x", "_near")


def first_zone(near: Column, kind: str, x: Column, y: Column, grow: float) -> Column:
    hit = F.filter(near, lambda z: (z["kind"] == kind) & G.contains_within(z["points"], x, y, grow))
    return F.coalesce(F.array_min(F.transform(hit, lambda z: z["zone_id"])), F.lit(0))


# crossings


def _touch(a: list[tuple[float, float]], b: list[tuple[float, float]], reach: float) -> bool:
    """Whether two polygons are at most `reach` apart, by the larger of both coordinates' distances."""
    for p, q in ((a, b), (b, a)):
        sides = list(zip(q, q[1:] + q[:1], strict=True))
        for x, y in p:
            odd = sum((qy > y) != (ry > y) and x < qx + (y - qy) * (rx - qx) / (ry - qy) for (qx, qy), (rx, ry) in sides)
            if odd % 2 or any(_square_distance(s, t, x, y) <= reach for s, t in sides):
                return True
    cross = lambda s, t, p: (t[0] - s[0]) * (p[1] - s[1]) - (t[1] - s[1]) * (p[0] - s[0])
    return any(cross(s, t, p) * cross(s, t, q) < 0 and cross(p, q, s) * cross(p, q, t) < 0 for s, t in zip(a, a[1:] + a[:1], strict=True) for p, q in zip(b, b[1:] + b[:1], strict=True))


def _square_distance(s: tuple[float, float], t: tuple[float, float], x: float, y: float) -> float:
    px, py, ux, uy = s[0] - x, s[1] - y, t[0] - s[0], t[1] - s[1]
    at = [0.0, 1.0] + [-(px + k * py) / (ux + k * uy) for k in (-1, 1) if ux + k * uy]
    return min(max(abs(px + u * ux), abs(py + u * uy)) for u in (min(max(a, 0.0), 1.0) for a in at))


def crossings(zones: DataFrame, kinds: Iterable[str] = ("crosswalk", "refuge"), grow: float = 2.0) -> DataFrame:
    """Zones of these kinds as zones of kind `crossing`, numbered anew over the kinds in order, with `part_of`: the least number
    among those that a chain of zones joins which overlap once each is grown. What meets in a task is the zones of one video, as drawn."""
    order = list(kinds)
    own = zones.where(F.col("kind").isin(order)).withColumn("_k", F.array_position(F.array(*map(F.lit, order)), F.col("kind")))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("_k", "zone_id"))
    own = own.select("video_id", F.lit("crossing").alias("kind"), number.cast("int").alias("zone_id"), "points")

    def joined(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("zone_id")
        shapes = [[(p["x"], p["y"]) for p in z] for z in df["points"]]
        root = list(range(len(shapes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i in range(len(shapes)):
            for j in range(i):
                a, b = find(i), find(j)
                if a != b and _touch(shapes[i], shapes[j], 2 * grow):
                    root[max(a, b)] = min(a, b)
        return df.assign(part_of=[int(df["zone_id"].iloc[find(i)]) for i in range(len(shapes))])

    return own.groupBy("video_id").applyInPandas(joined, f"{ZONES}, part_of int")


def with_crossing(rows: DataFrame, parts: DataFrame, cell: float, grow: float, name: str = "zone") -> DataFrame:
    """rows with the crossing that holds their point, each part grown by a square: part_of, 0 where there is none."""
    as_zone = parts.select("video_id", "kind", F.col("part_of").alias("zone_id"), "points")
    return with_zones(rows, zone_index(as_zone, cell, grow), cell, {name: ("crossing", grow)})


# the margin of the road


def road_runs(road: DataFrame, grid: int, nx: int, reach: int) -> DataFrame:
    """(video_id, cy, cx, runs array<struct<cy, x0, x1>>) for each road cell: how far the road goes on left and right, in
    pixels, in the rows of cells up to `reach` above and below. Beyond the frame everything is road."""
    by_row = Window.partitionBy("video_id", "cy").orderBy("cx")
    island = road.select(*CELL).withColumn("_i", F.col("cx") - F.row_number().over(by_row))
    whole = Window.partitionBy("video_id", "cy", "_i")
    first, last = F.min("cx").over(whole), F.max("cx").over(whole)
    x0 = F.when(first == 0, F.lit(-(2**31)).cast("long")).otherwise(first.cast("long") * grid)
    x1 = F.when(last == nx - 1, F.lit(2**31).cast("long")).otherwise((last.cast("long") + 1) * grid - 1)
    rows = island.select(*CELL, x0.alias("x0"), x1.alias("x1"))
    around = Window.partitionBy("video_id", "cx").orderBy("cy").rangeBetween(-reach, reach)
    return rows.select(*CELL, F.collect_list(F.struct("cy", "x0", "x1")).over(around).alias("runs"))


def with_eroded_road(rows: DataFrame, road: DataFrame, grid: int, ny: int, nx: int, size: int, width: int | None = None, height: int | None = None, name: str = "on_road", x: str = "gx", y: str = "gy") -> DataFrame:
    """rows with whether their pixel is road once road (cells of `grid` pixels) is eroded by a square of `size` pixels: all
    pixels from size // 2 before it to the rest after it, as far as the frame goes, are road. First along rows, by the
    ends of the runs of cells, then across them. The frame is width by height pixels, where given, else whole cells."""
    before, after = size // 2, size - 1 - size // 2
    most = {"x": (width or nx * grid) - 1, "y": (height or ny * grid) - 1}
    pixel = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), F.lit(n)))
    own = rows.withColumns({"_px": pixel(x, most["x"]), "_py": pixel(y, most["y"])})
    own = own.withColumns({"_cx": F.floor(F.col("_px") / grid).cast("int"), "_cy": F.floor(F.col("_py") / grid).cast("int")})
    reach = -(-max(before, after) // grid)
    runs = road_runs(road, grid, nx, reach).select(F.col("video_id").alias("_v"), F.col("cy").alias("_y"), F.col("cx").alias("_x"), F.col("runs").alias("_runs"))
    met = own.join(runs, (F.col("video_id") == F.col("_v")) & (F.col("_cy") == F.col("_y")) & (F.col("_cx") == F.col("_x")), "left")
    top = F.floor(F.greatest(F.col("_py") - before, F.lit(0)) / grid)
    bottom = F.floor(F.least(F.col("_py") + after, F.lit(most["y"])) / grid)
    right = F.least(F.col("_px") + after, F.lit(most["x"]))
    hit = F.filter("_runs", lambda r: r["cy"].between(top, bottom) & (r["x0"] <= F.col("_px") - before) & (r["x1"] >= right))
    # a run that reaches the frame's left edge goes on beyond it, so the window needn't be cut there
    return met.withColumn(name, F.coalesce(F.size(hit) == bottom - top + 1, F.lit(False))).drop("_px", "_py", "_cx", "_cy", "_v", "_y", "_x", "_runs")

"""The event rules that need a scene, over tables of zones and approaches: every video with its own, all in one plan.

A row meets the approaches of its video, which are few; signal states are looked up for the rows that may be events only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.functions import geometry as G

from . import pairs as P
from . import zones as Z
from .rules import EVENT, ever
from .runs import ORDER, TRACK, over, runs
from .temporal import as_of, binned_join

LANE = ["video_id", "approach"]
VISIT = [*TRACK, "approach"]


def line_of(row: str = "") -> list[tuple[Column, Column]]:
    c = lambda name: F.col(f"{row}{name}")
    return [(c("ax"), c("ay")), (c("bx"), c("by"))]


def upstream() -> Column:
    """The side of an approach's stop line that traffic comes from, -1 or 1."""
    return F.when((F.col("bx") - F.col("ax")) * F.col("dy") - (F.col("by") - F.col("ay")) * F.col("dx") > 0, -1.0).otherwise(1.0)


def effective_red(states: DataFrame, approaches: DataFrame) -> DataFrame:
    """states (video_id, approach, t, state: 1 red) with red: 1 from red_delay after a red run's first sample until red_early
    before the sample that ends it. A run that is open at the end has no early end."""
    s = states.join(approaches.select(*LANE, "red_delay", "red_early"), LANE)
    w = Window.partitionBy(*LANE).orderBy("t")
    is_red = F.col("state") == 1
    run = F.sum((~is_red).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumns({"_run": run, "_after": F.lead("t").over(w)})
    own = Window.partitionBy(*LANE, "_run")
    s = s.withColumns({"_from": F.min(F.when(is_red, F.col("t"))).over(own), "_last": F.max(F.when(is_red, F.struct("t", "_after"))).over(own)})
    until = F.col("_last._after") - F.col("red_early")
    red = is_red & (F.col("t") >= F.col("_from") + F.col("red_delay")) & (until.isNull() | (F.col("t") < until))
    return s.select(*LANE, "t", "state", red.cast("int").alias("red"))


def at_lines(kin: DataFrame, approaches: DataFrame) -> DataFrame:
    """Vehicle rows with each approach of their video: side of the stop line (0 where not level with it) as seen from
    upstream, -1 before it and 1 past it; whether they are in the box (null without one); cosine of the heading; distance past the line in sizes."""
    x, y = F.col("gx"), F.col("gy")
    v = kin.where(F.col("cls").isin(P.VEHICLES)).join(approaches, "video_id")
    line = line_of()
    nx, ny = F.col("by") - F.col("ay"), F.col("ax") - F.col("bx")
    n = F.hypot(nx, ny) + 1e-9
    sign = F.when(nx * F.col("dx") + ny * F.col("dy") < 0, -1.0).otherwise(1.0)
    return v.withColumns({
        "side": F.when(G.along_line(line, x, y).between(-0.05, 1.05), -upstream() * G.side_of_line(line, x, y)).otherwise(0.0),
        "inside": G.contains(F.col("box"), x, y),
        "towards": (F.col("vx") * F.col("dx") + F.col("vy") * F.col("dy")) / (F.hypot("vx", "vy") + 1e-9),
        "past": ((x - F.col("ax")) * nx + (y - F.col("ay")) * ny) / n * sign / F.col("size"),
    })


def red_lights(kin: DataFrame, red: DataFrame, approaches: DataFrame, heading: float, shortest: float, within: float, stopped: float) -> DataFrame:
    """(video_id, tid, approach, start, end): of each vehicle and approach the first passage over the line at red, along the
    approach and after at least `shortest` seconds since it first was before the line, if it drives on into the junction."""
    v = at_lines(kin, approaches).select(*VISIT, *ORDER, "side", "inside", "towards", "speed", F.col("box").isNull().alias("open"))
    w = over(VISIT)
    since = F.min(F.when(F.col("side") == -1, F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    passing = v.withColumns({"_was": F.lag("side").over(w), "_from": F.lag("t").over(w), "_since": since})
    passing = passing.where((F.col("_was") == -1) & (F.col("side") == 1) & (F.col("towards") >= heading) & (F.col("t") - F.col("_since") >= shortest))
    passing = as_of(passing.select(*VISIT, "t", "_from"), red.select(*LANE, "t", "red"), ["red"], LANE, forward=True, clamp=True).where("red = 1")
    first = passing.groupBy(*VISIT).agg(F.min(F.struct("t", "_from")).alias("c")).select(*VISIT, F.col("c.t").alias("tc"), F.col("c._from").alias("start"))
    after = v.join(first, VISIT).where("t >= tc")
    after = after.withColumn("_entry", F.min(F.when(F.col("inside"), F.col("t"))).over(Window.partitionBy(*VISIT)))
    soon = F.col("t") <= F.col("tc") + within
    a = after.groupBy(*VISIT, "start", "open").agg(
        F.min(F.when(soon, F.col("speed"))).alias("slowest"),
        F.max(soon & F.coalesce("inside", F.lit(False))).alias("enters"),
        F.min(F.when((F.col("t") > F.col("_entry")) & ~F.col("inside"), F.col("t"))).alias("exit"),
        F.max("t").alias("last"),
    )
    return a.where((F.col("slowest") > stopped) & (F.col("open") | F.col("enters"))).select(*VISIT, "start", F.coalesce("exit", "last").alias("end"))


def stop_lines(kin: DataFrame, red: DataFrame, approaches: DataFrame, margin: float, moving: float, stopped: float) -> DataFrame:
    """(video_id, tid, approach, start, end): vehicles that once moved and come to stand past the line, short of the
    junction, at red: until the lamp's red has ended, less red_early, or they move on, and half a second at least."""
    v = at_lines(kin.withColumn("_moved", ever(F.col("speed") > moving)).where("_moved"), approaches)
    stands = (F.col("side") == 1) & (F.col("past") >= margin) & ~F.coalesce("inside", F.lit(False)) & (F.col("speed") < stopped)
    v = v.select(*VISIT, *ORDER, stands.alias("stands"), "red_early")
    v = v.withColumn("_next", F.lead("t").over(over(VISIT)))
    found = runs(v, F.col("stands"), VISIT, ORDER, F.max_by(F.struct("_next"), F.struct(*ORDER)).alias("_next"), F.min("red_early").alias("red_early"))
    found = found.select(*VISIT, F.col("start").alias("t"), F.col("end").alias("last"), F.coalesce("_next._next", "end").alias("leave"), "red_early")
    found = as_of(found, red.select(*LANE, "t", "red"), ["red"], LANE, forward=True, clamp=True).where("red = 1").drop("red")
    over_ = red.where("state <> 1").select(*LANE, "t", F.col("t").alias("over"))
    found = as_of(found, over_, ["over"], LANE, forward=True)
    end = F.least(F.coalesce(F.col("over") - F.col("red_early"), "last"), "leave")
    return found.select(*VISIT, F.col("t").alias("start"), F.greatest(end, F.col("t") + 0.5).alias("end"))


def waiting_at_red(found: DataFrame, states: DataFrame, approaches: DataFrame) -> DataFrame:
    """(id): runs (video_id, id, start, end, x1..y2) upstream of any approach of their video that is red in over half of its samples meanwhile."""
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    before = found.join(approaches, "video_id").where(G.side_of_line(line_of(), x, y) == upstream())
    j = binned_join(states.select(*LANE, "t", "state"), before.select(*LANE, "id", "start", "end"), LANE, 10.0)
    share = j.groupBy("id", "approach").agg(F.avg((F.col("state") == 1).cast("double")).alias("share"))
    return share.where("share > 0.5").select("id").distinct()


def jaywalkers(kin: DataFrame, road: DataFrame, zones: DataFrame, grid: int, ny: int, nx: int, kerb: int, margin: float, shortest: float) -> DataFrame:
    """(video_id, tid, start, end): walkers on the road, farther than the kerb's margin inside it, off crosswalks, each
    grown by `margin`, and off refuges. `kerb`: side of the square in pixels that the road is eroded by."""
    cell = float(4 * grid)
    walking = Z.with_eroded_road(P.walkers(kin), road, grid, ny, nx, kerb, name="_road")
    walking = Z.with_zones(walking, Z.zone_index(zones.where("kind in ('crosswalk', 'refuge')"), cell, margin), cell, {"_crosswalk": ("crosswalk", margin), "_refuge": ("refuge", 0.0)})
    bad = F.col("_road") & (F.col("_crosswalk") == 0) & (F.col("_refuge") == 0)
    return runs(walking, bad).where(F.col("end") - F.col("start") >= shortest).select(*EVENT)


def failures_to_yield(kin: DataFrame, zones: DataFrame, cell: float, sizes: float, margin: float, moving: float, walking: float) -> DataFrame:
    """(video_id, tid, start, end): stays of vehicles on a crossing, in motion at some time, with someone near who walks on the
    same crossing, or up to `margin` from it, and stands on no refuge. Videos without crosswalks have none."""
    drawn = zones.join(zones.where("kind = 'crosswalk'").select("video_id").distinct(), "video_id", "left_semi")
    parts = Z.crossings(drawn)
    people = Z.with_crossing(P.walkers(kin).where(F.col("speed") >= walking), parts, cell, margin + 2.0)
    people = Z.with_zones(people.where("zone > 0"), Z.zone_index(drawn.where("kind = 'refuge'"), cell), cell, {"_refuge": ("refuge", 0.0)}).where("_refuge = 0")
    every = Z.with_crossing(kin.where(F.col("cls").isin(P.VEHICLES)), parts, cell, 2.0)
    middle = kin.where("cls = 'car'").groupBy("video_id").agg(F.median("size").alias("car"))
    on = every.where("zone > 0").join(middle, "video_id", "left").withColumn("_reach", sizes * F.least("size", F.coalesce("car", "size")))
    met = on.join(people.select("video_id", "frame", "zone", F.col("gx").alias("_x"), F.col("gy").alias("_y")), ["video_id", "frame", "zone"])
    hit = met.where(F.hypot(F.col("gx") - F.col("_x"), F.col("gy") - F.col("_y")) < F.col("_reach")).select("event_id").distinct()
    v = every.join(hit.withColumn("_hit", F.lit(True)), "event_id", "left")
    w = over()
    new = (~F.col("zone").eqNullSafe(F.lag("zone").over(w))).cast("int")
    v = v.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("zone > 0")
    stay = v.groupBy(*TRACK, "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("speed").alias("top"), F.count("_hit").alias("hits"))
    return stay.where((F.col("top") > moving) & (F.col("hits") > 0)).select(*EVENT)

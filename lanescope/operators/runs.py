"""Runs, sessions and intervals over ordered rows: windows only, any number of tracks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRACK, ORDER = ["video_id", "tid"], ["t", "event_id"]


def over(keys: list[str] = TRACK, order: list[str] = ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, mask: Column, keys: list[str] = TRACK, order: list[str] = ORDER, *aggs: Column) -> DataFrame:
    """Maximal stretches of true rows in row order: keys, run, start, end, n, and aggs. Gaps in time don't break a run."""
    w = over(keys, order)
    m = df.withColumn("_m", F.coalesce(mask, F.lit(False)))
    m = m.withColumn("_run", F.sum((~F.col("_m")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.where("_m").groupBy(*keys, F.col("_run").alias("run")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), *aggs)


def fill_gaps(df: DataFrame, mask: str, max_gap: float, keys: list[str] = TRACK, order: list[str] = ORDER) -> Column:
    """The mask with false stretches set that lie between true rows at most max_gap apart in time."""
    hit, reverse = F.when(F.col(mask), F.col("t")), Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    before, after = (F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (over(keys, order), reverse))
    return F.col(mask) | F.coalesce(after - before <= max_gap, F.lit(False))


def session_id(gap: float, keys: list[str] = TRACK, order: list[str] = ORDER) -> Column:
    """Number of the session a row is in: a new one starts after more than `gap` without a row."""
    w = over(keys, order)
    return F.sum((F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)) > gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def merge_intervals(df: DataFrame, gap: float, keys: list[str], strict: bool = True) -> DataFrame:
    """Intervals (start, end) merged per key where the next start is at most `gap` after all ends so far (under, if not strict)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") - reach > gap if strict else F.col("start") - reach >= gap
    marked = df.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def finalize(events: DataFrame, duration: float | Column, gap: float = 1.0, least: float = 0.5, shift: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Events (video_id, start, end, label): shifted by label, clipped to [0, duration], merged, short ones dropped, rounded."""
    return rounded_off(clipped(events, duration, gap, shift), gap, least)


def clipped(events: DataFrame, duration: float | Column, gap: float = 1.0, shift: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Events shifted and clipped. Those of a label that start within half a gap are one already, as they will be merged: pairs
    of tracks can have far more events than a video has such stretches, and these combine before a shuffle."""
    start, end = shifted(shift or {})
    limit = F.lit(duration) if isinstance(duration, int | float) else duration
    e = events.select("video_id", "label", F.greatest(start, F.lit(0.0)).alias("start"), F.least(end, limit).alias("end")).where("end > start")
    if gap <= 0:
        return e
    return e.groupBy("video_id", "label", F.floor(F.col("start") / (gap / 2)).alias("_half")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_half")


def rounded_off(events: DataFrame, gap: float, least: float) -> DataFrame:
    e = merge_intervals(events, gap, ["video_id", "label"]).where(F.col("end") - F.col("start") >= least)
    return e.select("video_id", "label", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"))


def shifted(shift: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    a = b = F.lit(0.0)
    for label, (x, y) in shift.items():
        a, b = F.when(F.col("label") == label, x).otherwise(a), F.when(F.col("label") == label, y).otherwise(b)
    return F.col("start") + a, F.col("end") + b


def alarm_starts(curve: DataFrame, theta: float = 0.5, gap: float = 2.0) -> DataFrame:
    """(video_id, start, end) of alarms: runs of score >= theta, joined when the next begins under `gap` after the last."""
    found = runs(curve, F.col("score") >= theta, ["video_id"])
    return merge_intervals(found.select("video_id", "start", "end"), gap, ["video_id"], strict=False)


def step_points(df: DataFrame, value: str, keys: list[str] = ["video_id"], order: list[str] = ORDER) -> DataFrame:
    """Only the first and last rows and those whose value differs from the row before."""
    w = over(keys, order)
    first, last, before = F.lag("t").over(w), F.lead("t").over(w), F.lag(value).over(w)
    return df.withColumn("_k", first.isNull() | last.isNull() | ~F.col(value).eqNullSafe(before)).where("_k").drop("_k")


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def unwrapped(angle: str, keys: list[str] = TRACK, order: list[str] = ORDER) -> Column:
    """Degrees made continuous; a jump of exactly half a turn keeps its sign."""
    w = over(keys, order)
    d = F.col(angle) - F.lag(angle).over(w)
    m = F.pmod(d + 180.0, F.lit(360.0)) - 180.0
    m = F.when((m == -180.0) & (d > 0), 180.0).otherwise(m)
    turn = F.coalesce(F.when(F.abs(d) < 180.0, 0.0).otherwise(m - d), F.lit(0.0))
    return F.col(angle) + F.sum(turn).over(w.rowsBetween(Window.unboundedPreceding, 0))


PER_SECOND = 1_000_000


def micros(t: str = "t") -> Column:
    """Seconds as whole microseconds, for frames that go by time."""
    return F.bround(F.col(t) * PER_SECOND).cast("long")


def trails(kin: DataFrame, back: float = 2.0, jump: float = 40.0) -> DataFrame:
    """Rows with their track's trail: the points of the last `back` seconds, both ends included, cut after the last step of over
    `jump`. Adds since (time of its first point), points, and path (its length)."""
    w = over()
    step = F.coalesce(F.hypot(F.col("gx") - F.lag("gx").over(w), F.col("gy") - F.lag("gy").over(w)), F.lit(0.0))
    k = kin.withColumn("_step", step).withColumn("_us", micros())
    k = k.withColumn("_part", F.sum((F.col("_step") > jump).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy(*TRACK, "_part")
    k = k.withColumn("_far", F.sum(F.when(F.col("_step") <= jump, F.col("_step")).otherwise(0.0)).over(part.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    near = part.orderBy("_us").rangeBetween(-round(back * PER_SECOND), 0)
    # rows at one time are in each other's frame, so the first point's path is taken by the rows' own order
    first = F.min(F.struct("t", "event_id", "_far")).over(near)
    k = k.withColumns({"_first": first, "points": F.count("*").over(near)})
    return k.withColumns({"since": F.col("_first.t"), "path": F.col("_far") - F.col("_first._far")}).drop("_step", "_us", "_part", "_far", "_first")


def braking_share(kin: DataFrame, back: float = 1.0, moving: float = 0.35) -> DataFrame:
    """Rows with brake: how much of the track's peak speed of the last `back` seconds is lost; 0 where it did not move in them."""
    k = kin.withColumn("_us", micros())
    peak = F.max("speed").over(Window.partitionBy(*TRACK).orderBy("_us").rangeBetween(-round(back * PER_SECOND), 0))
    return k.withColumn("_peak", peak).withColumn("brake", F.when(F.col("_peak") > moving, (F.col("_peak") - F.col("speed")) / F.col("_peak")).otherwise(0.0)).drop("_us", "_peak")


def running_totals(df: DataFrame, order: str, columns: list[str], descending: bool = False, shares: int = 256) -> DataFrame:
    """df, whose values of `order` differ, with cum_<column>: the sum of each column over all rows up to the row. No task sees all
    rows: they are cut at approximate quantiles, shares are summed up by themselves, and the sums of the shares before come on top."""
    cuts = df.agg(F.percentile_approx(order, [i / shares for i in range(1, shares)], 10_000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts if c is not None})
    # how many cuts a value is at or above: a search in a short sorted list
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(order).cast("double")))
    dealt = df.withColumn("_share", -place if descending else place)
    totals = dealt.groupBy("_share").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.partitionBy().orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)  # a row for each share
    offsets = totals.select("_share", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    own = Window.partitionBy("_share").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"cum_{c}": F.sum(c).over(own) for c in columns}).join(F.broadcast(offsets), "_share")
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_{c}") for c in columns}).drop("_share", *[f"_{c}" for c in columns])

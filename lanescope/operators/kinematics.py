"""Tracks to kinematic tracks: ground point, size, smoothed velocity, speed in sizes a second and heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanescope.functions.geometry import box_size, ground_x

from .runs import TRACK, over


def sampling_interval(tracks: DataFrame) -> DataFrame:
    """(video_id, dt): the median time between neighbouring rows of a track."""
    return tracks.withColumn("d", F.col("t") - F.lag("t").over(over())).groupBy("video_id").agg(F.median("d").alias("dt"))


def long_tracks(tracks: DataFrame, least: float) -> DataFrame:
    """Rows of tracks that last at least so long."""
    span = tracks.groupBy(*TRACK).agg((F.max("t") - F.min("t")).alias("span")).where(F.col("span") >= least)
    return tracks.join(span.select(*TRACK), TRACK, "left_semi")


def majority_class(tracks: DataFrame) -> DataFrame:
    """Each track's most frequent class, the first by name of equals, in place of the rows' own."""
    most = tracks.groupBy(*TRACK, "cls").count().groupBy(*TRACK).agg(F.min_by("cls", F.struct(-F.col("count"), "cls")).alias("most"))
    return tracks.join(most, TRACK).withColumn("cls", F.col("most")).drop("most")


def gradient(value: str) -> Column:
    """Second-order derivative by t over rows that needn't be evenly spaced; one-sided at the ends, 0 for a lone row."""
    w = over()
    x, t = F.col(value), F.col("t")
    xp, xn, tp, tn = F.lag(value).over(w), F.lead(value).over(w), F.lag("t").over(w), F.lead("t").over(w)
    h1, h2 = t - tp, tn - t
    inner = (h1 * h1 * xn + (h2 * h2 - h1 * h1) * x - h2 * h2 * xp) / F.nullif(h1 * h2 * (h1 + h2), F.lit(0.0))
    return F.when(tp.isNull() & tn.isNull(), 0.0).when(tp.isNull(), (xn - x) / F.nullif(h2, F.lit(0.0))).when(tn.isNull(), (x - xp) / F.nullif(h1, F.lit(0.0))).otherwise(inner)


def rolling_mean(value: str, win: int, centred: bool = True) -> Column:
    after = (win - 1) // 2 if centred else 0
    return F.avg(value).over(over().rowsBetween(-(win - 1 - after), after))


def with_ground(tracks: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return tracks.withColumns({"gx": ground_x(x1, x2), "gy": y2, "size": box_size(x1, y1, x2, y2)})


def with_velocity(tracks: DataFrame) -> DataFrame:
    return with_ground(tracks).withColumns({"vx": gradient("gx"), "vy": gradient("gy")})


def with_kinematics(tracks: DataFrame, win: int, centred: bool = True) -> DataFrame:
    """Adds gx, gy, size, vx, vy (each smoothed over `win` rows of its raw series), speed and heading."""
    raw = with_velocity(tracks)
    names = ["gx", "gy", "size", "vx", "vy"]
    smooth = raw.select(*[c for c in raw.columns if c not in names], *[rolling_mean(c, win, centred).alias(c) for c in names])
    return smooth.withColumns({"speed": F.hypot("vx", "vy") / F.col("size"), "heading": F.degrees(F.atan2("vy", "vx"))})


def smoothed_by_video(tracks: DataFrame, smooth: float) -> DataFrame:
    """with_kinematics where each video has the window its own sampling asks for. The frames of all window sizes that occur,
    some dozens at most, share one sort."""
    win = sampling_interval(tracks).select("video_id", F.when(F.col("dt") > 0, F.greatest(F.lit(1), F.bround(smooth / F.col("dt")).cast("int"))).otherwise(1).alias("_win"))
    sizes = sorted(r["_win"] for r in win.select("_win").distinct().collect())
    raw = with_velocity(tracks).join(win, "video_id")
    names = ["gx", "gy", "size", "vx", "vy"]
    own = lambda c: F.coalesce(*[F.when(F.col("_win") == k, rolling_mean(c, k)) for k in sizes]).alias(c)
    smoothed = raw.select(*[c for c in tracks.columns], *[own(c) for c in names])
    return smoothed.withColumns({"speed": F.hypot("vx", "vy") / F.col("size"), "heading": F.degrees(F.atan2("vy", "vx"))})

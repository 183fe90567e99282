"""Operators whose every step depends on the ones before: grouped functions, one group a video, a track or a label."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .temporal import overlapping

BLOCK = 64  # islands in a row that are folded together


def ious(boxes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box with b."""
    low, high = np.maximum(boxes[:, :2], b[:2]), np.minimum(boxes[:, 2:], b[2:])
    shared = np.prod(np.clip(high - low, 0, None), axis=1)
    area = lambda x: np.prod(x[..., 2:] - x[..., :2], axis=-1)
    return np.divide(shared, area(boxes) + area(b) - shared, out=np.zeros(len(boxes)), where=shared > 0)


def stitch_runs(found: DataFrame, max_gap: float = 3.0, least: float = 0.5) -> DataFrame:
    """Runs (video_id, tid, start, end, x1, y1, x2, y2) joined, by start, to the first group that ended at most max_gap before
    and whose first box overlaps theirs enough; with the group's first tid and its number of parts.

    Runs that begin over max_gap after all before them have ended start an island; islands are folded one by one.
    """
    cols = ["video_id", "tid", "start", "end", "x1", "y1", "x2", "y2"]
    order = ["start", "end", "x1", "y1", "x2", "y2", "tid"]
    w = Window.partitionBy("video_id").orderBy(*order)
    fresh = F.coalesce(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) > max_gap, F.lit(True))
    split = found.select(*cols).withColumn("island", F.floor(F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) / BLOCK))

    def stitched(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order, ignore_index=True)
        start, end, box = df["start"].to_numpy(), df["end"].to_numpy(), df[["x1", "y1", "x2", "y2"]].to_numpy()
        own = np.empty(len(df), int)  # the row that a row's group began with
        till = np.full(len(df), -np.inf)  # by first row: when its group ends
        open_ = np.empty(0, int)  # first rows of groups that may go on, as they were made
        for i in range(len(df)):
            open_ = open_[till[open_] >= start[i] - max_gap]
            fits = open_[(till[open_] <= start[i]) & (ious(box[open_], box[i]) >= least)]
            own[i] = fits[0] if len(fits) else i
            till[own[i]] = max(till[own[i]], end[i])
            if own[i] == i:
                open_ = np.append(open_, i)
        first = np.unique(own)
        return df.loc[first, cols].assign(end=till[first], parts=np.bincount(own)[first])

    return split.groupBy("video_id", "island").applyInPandas(stitched, "video_id long, tid long, start double, end double, x1 double, y1 double, x2 double, y2 double, parts long")


def candidate_groups(segments: DataFrame, least: float = 0.2) -> DataFrame:
    """Candidates of (video_id, label, start, end, current): (video_id, label, start, end, hits, current).

    Each current segment is one, hit by every other segment that overlaps it. Segments that overlap no current one are
    grouped by start and end with the first group whose first member they overlap by `least`, which widens to hold them.
    A group of segments that nothing before them reaches ends an island; islands are folded one by one.
    """
    s = segments.select("video_id", "label", "start", "end", "current")
    now = s.where("current").withColumn("id", F.monotonically_increasing_id())
    other = s.where("not current").withColumn("other", F.monotonically_increasing_id())
    keys = ["video_id", "label"]
    met = overlapping(now.select(*keys, "id", "start", "end"), other.select(*keys, "other", F.col("start").alias("start_b"), F.col("end").alias("end_b")), keys, 10.0)
    hit = now.join(met.groupBy("id").count(), "id", "left").select(*keys, "start", "end", (F.coalesce("count", F.lit(0)) + 1).alias("hits"), "current")
    rest = other.join(met.select("other").distinct(), "other", "left_anti")
    w = Window.partitionBy(*keys).orderBy("start", "end")
    fresh = F.coalesce(F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rest = rest.withColumn("island", F.floor(F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) / BLOCK))

    def group(df: pd.DataFrame) -> pd.DataFrame:
        made: list[list] = []  # first start, first end, start, end, hits
        for s, e in df[["start", "end"]].sort_values(["start", "end"]).to_numpy():
            for g in made:
                if min(e, g[1]) - max(s, g[0]) >= least * (max(e, g[1]) - min(s, g[0])):
                    g[2:] = min(g[2], s), max(g[3], e), g[4] + 1
                    break
            else:
                made.append([s, e, s, e, 1])
        rows = [(df["video_id"].iloc[0], df["label"].iloc[0], *g[2:], False) for g in made]
        return pd.DataFrame(rows, columns=["video_id", "label", "start", "end", "hits", "current"])

    grouped = rest.groupBy(*keys, "island").applyInPandas(group, "video_id long, label string, start double, end double, hits long, current boolean")
    return hit.unionByName(grouped)


def smoothed(curve: DataFrame, tau: float = 0.6) -> DataFrame:
    """Exponential mean over uneven steps of (video_id, t, raw, seq): adds score; the first step takes raw. Of steps at one time
    the least seq comes first, and it alone counts. A video's rows pass in order, a batch at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, score, last = None, 0.0, None
        for df in batches:
            out = []
            for v, t, raw in zip(df["video_id"], df["t"], df["raw"], strict=True):
                if last is None or not (v == video or (v != v and video != video)):  # rows without a video are one together
                    video, score, alpha = v, 0.0, 1.0
                else:
                    alpha = 1 - math.exp(-(t - last) / tau)
                score = min(1.0, max(0.0, score + alpha * (raw - score)))
                last = t
                out.append(score)
            yield df[["video_id", "t", "raw"]].assign(score=out)

    own = curve.select("video_id", "t", "raw", "seq").repartition("video_id").sortWithinPartitions("video_id", F.asc_nulls_last("t"), "seq")
    return own.mapInPandas(fold, "video_id long, t double, raw double, score double")


def best_setting(scores: DataFrame, margin: float = 0.02) -> tuple | None:
    """(setting, score) after going through (setting, score) in order of setting: a later one must beat the best by margin.
    scores has one row per setting of a grid."""
    best = None
    for r in scores.select("setting", "score").orderBy("setting").toLocalIterator():
        if best is None or r["score"] > best[1] + margin:
            best = (r["setting"], r["score"])
    return best


def settings(spark, **values: list) -> DataFrame:
    """The product of parameter values as a table, numbered in grid order; as large as the grid."""
    out = spark.createDataFrame([(0,)], "one int")
    for name, own in values.items():
        out = out.crossJoin(spark.createDataFrame([(i, float(v)) for i, v in enumerate(own)], f"_{name} int, {name} double"))
    order = F.lit(0)
    for name, own in values.items():
        order = order * len(own) + F.col(f"_{name}")
    return out.select(order.alias("setting"), *values)

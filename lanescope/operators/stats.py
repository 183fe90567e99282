"""Counts over time, histograms, votes and label tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runs import running_totals
from .temporal import spine

GROUPS = {"car": "car", "person": "person", "bus": "heavy", "truck": "heavy", "bicycle": "two_wheeler", "motorcycle": "two_wheeler"}


def class_group(cls: str = "cls"):
    return F.create_map(*[F.lit(x) for p in GROUPS.items() for x in p])[F.col(cls)]


def object_counts(tracks: DataFrame, bin_sec: float, duration: float) -> DataFrame:
    """(video_id, grp, bin, n): mean objects of a group per frame of each bin, 0 in empty bins."""
    rows = tracks.withColumns({"grp": class_group(), "bin": F.floor(F.col("t") / bin_sec).cast("int")})
    frames = rows.groupBy("video_id", "bin").agg(F.countDistinct("frame").alias("frames"))
    seen = rows.where("grp is not null").groupBy("video_id", "grp", "bin").agg(F.count("*").alias("rows"))
    every = spine(rows.select("video_id").distinct().withColumn("grp", F.explode(F.array(*[F.lit(g) for g in sorted(set(GROUPS.values()))]))), int(duration // bin_sec))
    j = every.join(seen, ["video_id", "grp", "bin"], "left").join(frames, ["video_id", "bin"], "left").fillna(0)
    return j.select("video_id", "grp", "bin", F.bround(F.col("rows") / F.greatest("frames", F.lit(1)), 2).alias("n"))


def speed_histogram(kin: DataFrame, moving: float, width: float, bins: int) -> DataFrame:
    """(video_id, bin, n, percent) of moving rows; the last bin holds all beyond."""
    b = F.least(F.floor(F.col("speed") / width).cast("int"), F.lit(bins - 1))
    h = kin.where(F.col("speed") > moving).groupBy("video_id", b.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("video_id")))


def stopped_share(kin: DataFrame, stopped: float, bin_sec: float, duration: float) -> DataFrame:
    """(video_id, bin, percent): share of rows that are stopped, null in empty bins."""
    got = kin.groupBy("video_id", F.floor(F.col("t") / bin_sec).cast("int").alias("bin")).agg((100 * F.avg((F.col("speed") < stopped).cast("double"))).alias("percent"))
    return spine(kin.select("video_id").distinct(), int(duration // bin_sec)).join(got, ["video_id", "bin"], "left")


def latest_votes(votes: DataFrame) -> DataFrame:
    """The newest vote of each person on each candidate; the first seen of equals."""
    w = Window.partitionBy("cid", "person").orderBy(F.desc("at"), "seq")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def consensus(votes: DataFrame) -> DataFrame:
    """(cid, verdict, start, end): the majority of real and not_real, split if even, unsure if neither; medians of the real
    votes' corrections, what was proposed if there are none."""
    yes, no = F.count_if(F.col("verdict") == "real"), F.count_if(F.col("verdict") == "not_real")
    real = lambda c: F.median(F.when(F.col("verdict") == "real", F.col(c)))
    verdict = F.when(yes > no, "real").when(yes < no, "not_real").when(yes > 0, "split").otherwise("unsure")
    return votes.groupBy("cid").agg(verdict.alias("verdict"), F.coalesce(real("start"), F.min("proposed_start")).alias("start"), F.coalesce(real("end"), F.min("proposed_end")).alias("end"))


def anonymous(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Adds anon: 1, 2, ... by each name's first appearance."""
    first = df.groupBy(name).agg(F.min(seq).alias("_first"))
    places = running_totals(first.select("_first").distinct().withColumn("one", F.lit(1)), "_first", ["one"])  # names that appear together share a number
    return df.join(first.join(places.select("_first", F.col("cum_one").cast("int").alias("anon")), "_first").drop("_first"), name)


def superseded(candidates: DataFrame) -> DataFrame:
    """Candidates without the originals that a confirmed re-time replaces, and without re-times that were not confirmed."""
    ok = candidates.where("retime_of is not null and verdict = 'real'").select(F.col("retime_of").alias("cid")).distinct()
    return candidates.where("retime_of is null or verdict = 'real'").join(ok, "cid", "left_anti")

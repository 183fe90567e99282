"""Which tracks an event needs: the fewest, by leaving out, with which its rule still finds it.

All events go through a round together. A round's subsets are told apart by a video of their own, so that one plan of the rule judges them all: first
each share of an event's tracks is left out by itself, then growing stretches of those that can be spared one by one, as
some can't be spared together. Shares shrink until they are single tracks and none can be spared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.session import materialised

from .review import nearby_rows

Rule = Callable[[DataFrame], DataFrame]
SHARES = 8  # of an event's tracks, at first


def fires(rows: DataFrame, tried: DataFrame, events: DataFrame, rule: Rule) -> DataFrame:
    """(id, variant) of the variants (id, variant, tid) of events' tracks with which the rule finds an event that overlaps theirs.

    rows: (id, tid, and a track's columns) around each event. The rule takes rows by video and gives (video_id, start, end)."""
    named = tried.withColumn("_v", F.xxhash64("id", "variant"))
    own = rows.drop("video_id").join(named.select("id", "tid", F.col("_v").alias("video_id")), ["id", "tid"]).drop("id")
    # rows of one subset are rows of their own for rules that tell rows apart by event_id
    own = own.withColumn("event_id", F.xxhash64("video_id", "event_id")) if "event_id" in own.columns else own
    found = rule(own).select(F.col("video_id").alias("_v"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = found.join(named.select("id", "variant", "_v").distinct(), "_v").join(events.select("id", "start", "end"), "id")
    return hit.where((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e"))).select("id", "variant").distinct()


def involved_tracks(tracks: DataFrame, events: DataFrame, rule: Rule, seen: float = 3.0, kept: float = 5.0, whole_tracks: bool = False) -> DataFrame:
    """(id, tid): for each event (id, video_id, start, end) a set of tracks with which the rule still finds it, and none of which
    can be left out. Events that the rule doesn't find among the tracks near them have none.

    Only tracks seen within `seen` seconds of an event count, by their rows within `kept` of it, or all of them where
    whole_tracks is set. Each round is two jobs, whatever the number of events.
    """
    near = nearby_rows(tracks, events, seen, kept)
    if whole_tracks:
        near = near.select("id", "video_id", "tid").distinct().join(tracks, ["video_id", "tid"])
    rows = materialised(near)
    keep = rows.select("id", "tid").distinct()
    keep = materialised(keep.join(fires(rows, keep.withColumn("variant", F.lit(0)), events, rule).select("id"), "id", "left_semi"))
    shares = SHARES
    while True:
        # shares of each event's tracks, in order: as many as asked for, single tracks where there are no more
        order, whole = Window.partitionBy("id").orderBy("tid"), Window.partitionBy("id")
        rank, n = F.row_number().over(order) - 1, F.count("*").over(whole)
        dealt = materialised(keep.withColumns({"n": n, "share": F.floor(rank * F.least(n, F.lit(shares)) / n).cast("int")}))
        without = lambda left_out: dealt.join(left_out, "id").where(~F.array_contains("out", F.col("share"))).select("id", "variant", "tid")
        single = dealt.select("id", "share").distinct().select("id", F.col("share").alias("variant"), F.array("share").alias("out"))
        spare = materialised(fires(rows, without(single), events, rule))
        if spare.isEmpty():
            if dealt.where(F.col("n") > shares).isEmpty():
                break
            shares *= 4
            continue
        lists = spare.groupBy("id").agg(F.array_sort(F.collect_list("variant")).alias("l"))
        stretches = lists.select("id", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("variant")).select("id", "variant", F.slice("l", F.lit(1), F.col("variant")).alias("out"))
        ok = fires(rows, without(stretches), events, rule).union(stretches.where("variant = 1").select("id", "variant"))
        best = ok.groupBy("id").agg(F.max("variant").alias("variant")).join(stretches, ["id", "variant"]).select("id", "out")
        left = dealt.join(best, "id", "left").where(F.col("out").isNull() | ~F.array_contains("out", F.col("share"))).select("id", "tid")
        keep = materialised(left)
    return keep.select("id", "tid")

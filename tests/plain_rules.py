"""The rules of pairs by joins of all pairs of rows: what those by tiles are held against."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.operators import pairs as P
from lanescope.operators import rules as R
from lanescope.operators.runs import TRACK, unwrapped
from lanescope.operators.temporal import as_of, binned_join


def accidents(kin: DataFrame, contact: float, impact: float, drop: float, moving: float, stopped: float, scale: float = 1.0) -> DataFrame:
    """(video_id, a_tid, b_tid, start, end): contacts at which a vehicle loses its speed and both parties stay slow. Times scale with `scale`.

    A contact's parties meet their rows by track and bin of time; each has at least its row at the contact."""
    pair = ["video_id", "a_tid", "b_tid", "t0"]
    sides = F.array(*[F.struct(F.col(f"{s}_tid").alias("tid"), F.col(f"{s}_cls").alias("cls")) for s in "ab"])
    parties = R.contacts(kin, contact).select(*pair, F.explode(sides).alias("p")).select(*pair, "p.tid", "p.cls", (F.col("t0") - 0.3 * scale).alias("start"), (F.col("t0") + 2.5 * scale).alias("end"))
    near = binned_join(kin.select("video_id", "tid", "t", "speed"), parties, TRACK, 2.8 * scale)
    within = lambda a, b: F.when(F.col("t").between(F.col("t0") + a * scale, F.col("t0") + b * scale), F.col("speed"))
    each = near.groupBy(*pair, "tid", "cls").agg(F.max(within(-0.3, 0.3)).alias("peak"), F.min(within(0.0, 1.0)).alias("low"), F.avg(within(0.5, 2.5)).alias("after"))
    hit = F.coalesce(F.col("cls").isin(P.VEHICLES) & (F.col("peak") >= impact) & (F.col("low") <= (1 - drop) * F.col("peak")), F.lit(False))
    slow = F.coalesce(F.col("after") <= moving, F.lit(True))
    crashed = each.groupBy(*pair).agg(F.max(hit).alias("hit"), F.min(slow).alias("slow")).where("hit and slow")
    # the first time from then on that a party stands, or its last
    party = crashed.select("video_id", "a_tid", "b_tid", F.explode(F.array("a_tid", "b_tid")).alias("tid"), F.col("t0").alias("t"))
    stands = kin.where(F.col("speed") < stopped).select("video_id", "tid", "t", F.col("t").alias("still"))
    last = kin.groupBy(*TRACK).agg(F.max("t").alias("last"))
    done = as_of(party, stands, ["still"], TRACK, forward=True).join(last, TRACK)
    ends = done.groupBy("video_id", "a_tid", "b_tid", F.col("t").alias("start")).agg(F.max(F.coalesce("still", "last")).alias("end"))
    return ends.withColumn("end", F.greatest("end", F.col("start") + scale))


def braking(calls: DataFrame, kin: DataFrame, moving: float, peak: float, drop: float, turn: float, scale: float) -> DataFrame:
    """(video_id, a_tid, b_tid, onset): for close calls (video_id, a_tid, b_tid, tc) the first time that one of the vehicles
    began to lose its speed. A vehicle begins to brake when it last was near its peak before the call, unless it is turning."""
    rows = kin.where(F.col("cls").isin(P.VEHICLES)).select("video_id", "tid", "t", "speed", "heading")
    pair = ["video_id", "a_tid", "b_tid", "tid"]
    spans = calls.withColumn("tid", F.explode(F.array("a_tid", "b_tid"))).withColumns({"start": F.col("tc") - 1.5 * scale, "end": F.col("tc") + 2.0 * scale})
    near = binned_join(rows, spans.select(*pair, "tc", "start", "end"), ["video_id", "tid"], 4.0 * scale)
    before, around = F.col("t") <= F.col("tc") + 0.5 * scale, (F.col("t") <= F.col("tc") + 1.5 * scale) & (F.col("speed") > moving)
    top = near.withColumn("top", F.max(F.when(before, F.col("speed"))).over(Window.partitionBy(*pair)))
    top = top.withColumn("from", F.max(F.when(before & (F.col("speed") >= 0.95 * F.col("top")), F.col("t"))).over(Window.partitionBy(*pair)))
    after = F.col("t").between(F.col("from"), F.col("from") + 1.5 * scale)
    per = top.groupBy(*pair, "top", "from").agg(F.min(F.when(after, F.col("speed"))).alias("low")).where((F.col("top") >= peak) & (F.col("low") <= (1 - drop) * F.col("top")))
    headed = near.where(around).withColumn("turned", unwrapped("heading", pair, ["t"]))
    turning = headed.groupBy(*pair).agg(F.count("*").alias("n"), (F.max("turned") - F.min("turned")).alias("turned")).where((F.col("n") >= 3) & (F.col("turned") > turn))
    return per.join(turning.select(*pair), pair, "left_anti").groupBy("video_id", "a_tid", "b_tid").agg(F.min("from").alias("onset"))


def near_misses(kin: DataFrame, crashes: DataFrame, ttc: float, clear: float, factor: float, peak: float, drop: float, moving: float, turn: float = 30.0, scale: float = 1.0) -> DataFrame:
    """(video_id, a_tid, b_tid, start, end): close calls before which a vehicle brakes hard without turning, from the onset
    of braking to the end of the close stretch. A pair that crashes about when it first comes close isn't one."""
    users = kin.where(F.col("on_road") & F.col("cls").isin(P.VEHICLES)).unionByName(P.walkers(kin.where("on_road")))
    p = P.with_ttc(P.frame_pairs(users), factor).where((F.col("ttc") < clear) & (F.col("a_cls").isin(P.VEHICLES) | F.col("b_cls").isin(P.VEHICLES)))
    pair = ["video_id", "a_tid", "b_tid"]
    w = Window.partitionBy(*pair).orderBy("t")
    new = (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)) > scale).cast("int")
    p = p.withColumn("_new", new).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    worst = p.groupBy(*pair).agg(F.min(F.struct("ttc", "t", "part")).alias("m"), F.min("t").alias("first")).where(F.col("m.ttc") < ttc).select(*pair, "first", F.col("m.t").alias("tc"), F.col("m.part").alias("part"))
    c = worst.join(p.groupBy(*pair, "part").agg(F.max("t").alias("till")), [*pair, "part"]).drop("part")
    same = crashes.select("video_id", "a_tid", "b_tid", F.col("start").alias("t0")).join(c.select(*pair, "first"), pair).where(F.abs(F.col("t0") - F.col("first")) < 5 * scale)
    c = c.join(same.select(*pair), pair, "left_anti")
    found = c.join(braking(c, kin, moving, peak, drop, turn, scale), pair)
    return found.select(*pair, F.col("onset").alias("start"), F.greatest("till", F.col("tc") + 0.5 * scale).alias("end"))

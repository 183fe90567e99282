"""Queries on whole detection, reports, reviews and views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from lanescope.operators import detect as D
from lanescope.operators import evaluate as V
from lanescope.operators import kinematics as K
from lanescope.operators import review as W
from lanescope.operators import rules as E
from lanescope.operators import scene as S
from lanescope.operators import stats as C
from lanescope.operators import view as N
from lanescope.sources.tables import every_nth_frame, held_forward
from lanescope.streaming.risk import on_known_road, replay, sampled

from .fixture import BOX, CROSSWALKS, DURATION, FLOW, GRID, KIN, LINE, MOVING, NX, NY, TR, kinematic, rounded, tracks
from . import scenes
from .rules import STITCH, TURNS, VEH, alarm_score, close_calls, crashes, curve, truth_and_shifted, turning
from .tracks import MERGE, SEG, flow, on_road, segments

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# detection of whole videos; tests hold it against the rules one by one

DETECTOR = D.Detector()
NO_U_TURN, FORBIDDEN = [[(0.0, 0.0), (90.0, 0.0), (90.0, 130.0), (0.0, 130.0)]], [(CROSSWALKS[0], CROSSWALKS[1])]


class Context:
    """What the rules of one folder of tables share."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.kin, self.flow = on_road(spark, d), flow(spark, d)

    @cached_property
    def crashes(self):
        """Persisted, as both rules of pairs read them."""
        return crashes(self.spark, self.d).persist()


@DETECTOR.rule("stopped_vehicle")
def stopped_vehicle(c):
    return D.stopped_vehicles(c.kin, scenes.states(c.spark, c.d), scenes.approach_rows(c.spark), MOVING, 0.06, 10.0, 30.0, 0.1, 3.0, 0.6)


@DETECTOR.rule("congestion")
def _congestion(c):
    return E.congestion(c.kin, c.flow, S.main_axis(c.flow), GRID, 24.0, 2, 0.12, 24.0, DURATION)


@DETECTOR.rule("wrong_way")
def _wrong_way(c):
    return E.wrong_way(S.with_lane(c.kin.drop("cx", "cy"), c.flow, GRID), MOVING, 0.2, -0.2, 20.0, 0.5, [BOX])


@DETECTOR.rule("jaywalking")
def _jaywalking(c):
    return scenes.jaywalking_events(c.spark, c.d)


@DETECTOR.rule("failure_to_yield")
def _failure_to_yield(c):
    return scenes.yield_events(c.spark, c.d)


@DETECTOR.rule("red_light")
def _red_light(c):
    return scenes.red_light_events(c.spark, c.d)


@DETECTOR.rule("stop_line")
def _stop_line(c):
    return scenes.stop_line_events(c.spark, c.d)


@DETECTOR.rule("solid_line_crossing")
def _solid_line(c):
    return E.solid_line_crossing(c.kin, LINE, 1.5)


@DETECTOR.rule("illegal_turn")
def _illegal_turn(c):
    return D.illegal_turns(turning(c.spark, c.d), NO_U_TURN, FORBIDDEN)


@DETECTOR.rule("accident")
def _accident(c):
    return c.crashes


@DETECTOR.rule("near_miss")
def _near_miss(c):
    return close_calls(c.spark, c.d, c.crashes)


@query(f"""with recursive {STITCH}, {scenes.VOTED}, {scenes.LANES}, st10 as (select *, sqrt((x2 - x1) * (y2 - y1)) as size, (x1 + x2) / 2 as cx from stitched where e - s >= 10),
  close_by as (select a.video_id, a.tid, a.s, floor(k.t) as sec, median(k.speed) as sp from st10 a join kr k on k.video_id = a.video_id and k.tid <> a.tid and k.{VEH} and k.t between a.s and a.e and sqrt(power(k.gx - a.cx, 2) + power(k.gy - a.y2, 2)) < 3 * a.size group by all),
  queue as (select video_id, tid, s from close_by group by all having avg(case when sp < 0.08 then 1.0 else 0 end) >= 0.6),
  up as (select a.*, l.approach from st10 a join lanes l using (video_id) where sign((bx - ax) * (y2 - ay) - (by_ - ay) * (cx - ax)) = (case when (bx - ax) * dy - (by_ - ay) * dx > 0 then -1 else 1 end)),
  at_red as (select up.video_id, up.tid, up.s from up join rs on rs.video_id = up.video_id and rs.approach = up.approach and rs.t between up.s and up.e group by up.video_id, up.tid, up.s, up.approach having avg(case when rs.state = 1 then 1.0 else 0 end) > 0.5)
  select video_id, round_even(s, 4) as "start", round_even(e, 4) as "end" from st10 where (video_id, tid, s) not in (select (video_id, tid, s) from queue) and (video_id, tid, s) not in (select (video_id, tid, s) from at_red)""")
def stopped_vehicles(spark, d):
    return stopped_vehicle(Context(spark, d)).select("video_id", *rounded("start", "end"))


@query(f"""{TURNS}, lab as (select *, case when total >= 150 and mx between 0 and 90 and my between 0 and 130 then 'illegal_u_turn'
    when total >= 60 and fx between 20 and 60 and fy between 40 and 90 and lx between 70 and 110 and ly between 40 and 90 then 'illegal_turn' end as label from tu)
  select video_id, label, round_even("start", 4) as "start", round_even("end", 4) as "end" from lab where label is not null""")
def illegal_turns(spark, d):
    return D.illegal_turns(turning(spark, d), NO_U_TURN, FORBIDDEN).select("video_id", "label", *rounded("start", "end"))


SHIFT = {"red_light": (-0.5, 0.5)}


@query()
def detect_events(spark, d):
    return DETECTOR.events(Context(spark, d), DURATION, shift=SHIFT)


@query()
def rule_status(spark, d):
    return DETECTOR.outcome(Context(spark, d), DURATION, shift=SHIFT)[1]


# reports


@query()
def evaluation_report(spark, d):
    return V.report(*truth_and_shifted(spark, d)).withColumns({n: F.bround(n, 4) for n in ("precision", "recall", "f1")})


@query()
def model_score(spark, d):
    return V.model_score(V.segment_score(V.report(*truth_and_shifted(spark, d))), alarm_score(spark, d)).select(*rounded("score"))


@query(f"""with {TR}, m as (select *, x1 / 500 >= 0.5 as ok from tr), i as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id order by t, event_id rows unbounded preceding) as run from m),
  rn as (select video_id, min(t) as s, max(t) as e from i where ok group by video_id, run){MERGE.format(k='video_id', src='rn', op='>=', gap='2.0')}, al as (select video_id, count(*) as n from merged group by all),
  q as (select video_id, count(*) as samples, avg(x1 / 500) as mean, avg(case when ok then 1.0 else 0 end) as over_, max(t) as dur from m group by all)
  select q.video_id, samples, round_even(mean, 4) as mean, round_even(over_, 4)::double as "over", coalesce(al.n, 0) as alarms, round_even(coalesce(al.n, 0) / greatest(dur, 1) * 60, 4)::double as per_minute from q left join al on al.video_id = q.video_id""")
def curve_summary(spark, d):
    return W.curve_summary(curve(spark, d)).select("video_id", "samples", *rounded("mean", "over"), "alarms", *rounded("per_minute"))


# events against tracks and each other


@query(f"with {SEG}, p as (select distinct video_id, frame::double as t from tr) select p.video_id, p.t, seg.label, count(*) as n from p join seg on seg.video_id = p.video_id and p.t between seg.s and seg.e group by all")
def active_at(spark, d):
    points = tracks(spark, d).select("video_id", F.col("frame").cast("double").alias("t")).distinct()
    return W.active_at(points, segments(spark, d)).groupBy("video_id", "t", "label").agg(F.count("*").alias("n"))


def numbered(spark, d):
    return segments(spark, d).withColumnRenamed("event_id", "id")


@query(f"with {SEG} select a.video_id, a.label, a.event_id as id, b.event_id as other from seg a join seg b on a.video_id = b.video_id and a.label = b.label and a.s < b.e and b.s < a.e and (a.s < b.s or (a.s = b.s and a.event_id < b.event_id))")
def clashes(spark, d):
    return W.clashes(numbered(spark, d))


@query(f"with {SEG} select a.event_id as id, count(b.event_id) as hits from (select * from seg where label in ('error', 'signup')) a left join (select * from seg where label not in ('error', 'signup')) b on a.video_id = b.video_id and a.s < b.e and b.s < a.e group by all")
def overlap_counts(spark, d):
    s = numbered(spark, d)
    rare = F.col("label").isin("error", "signup")
    return W.overlap_counts(s.where(rare), s.where(~rare), ["video_id"]).select("id", "hits")


@query(f"""with {SEG}, ev as (select event_id as id, video_id, s, e from seg where label = 'error'), who as (select distinct ev.id, tr.tid from ev join tr on tr.video_id = ev.video_id and tr.t between ev.s - 3 and ev.e + 3)
  select ev.id, count(*) as n, count(distinct tr.tid) as tracks from ev join tr on tr.video_id = ev.video_id and tr.t between ev.s - 5 and ev.e + 5 join who on who.id = ev.id and who.tid = tr.tid group by ev.id""")
def nearby_tracks(spark, d):
    events = numbered(spark, d).where("label = 'error'").select("id", "video_id", "start", "end")
    return W.nearby_counts(tracks(spark, d), events)


@query(f"""with {SEG} select 'own' as source, video_id, label, count(*) as n from seg where video_id not in (select video_id from seg where label = 'error' and s > 715) group by all
  union all select 'submitted', video_id, label, count(*) from seg where label <> 'view' and video_id in (select video_id from seg where label = 'error' and s > 715) group by all""")
def preferred_predictions(spark, d):
    s = segments(spark, d)
    given = s.join(s.where("label = 'error' and start > 715").select("video_id").distinct(), "video_id", "left_semi").where("label <> 'view'")
    out = W.preferred(given.withColumn("source", F.lit("submitted")), s.withColumn("source", F.lit("own")))
    return out.groupBy("source", "video_id", "label").agg(F.count("*").alias("n"))


@query(f"with {SEG}, c as (select video_id, floor(s)::int as second, max(case when label = 'purchase' then 1 else 0 end) as answered, max(case when label = 'signup' then 1 else 0 end) as retimed from seg group by all) select video_id from c group by video_id having sum(case when answered = 0 and retimed = 0 then 1 else 0 end) = 0")
def complete_videos(spark, d):
    is_ = lambda v: F.max((F.col("label") == v).cast("int")) == 1
    c = segments(spark, d).groupBy("video_id", F.floor("start").alias("second")).agg(is_("purchase").alias("answered"), is_("signup").alias("retimed"))
    return W.complete_videos(c)


@query(f"""with {SEG} select label, count(*) filter (where video_id = 0) as real, count(*) filter (where video_id = 1) as not_real, count(*) filter (where video_id = 2) as split, count(*) filter (where video_id = 3) as unsure from seg group by label""")
def label_tally(spark, d):
    verdict = F.get(F.array(*[F.lit(v) for v in ("real", "not_real", "split", "unsure")]), F.col("video_id").cast("int"))
    return W.tally(segments(spark, d).withColumn("verdict", verdict), ["real", "not_real", "split", "unsure"])


@query(f"""with {TR}, e as (select video_id, tid, min(x1) as a, min(y1) as b, max(x2) as c, max(y2) as d from tr group by all),
  w as (select *, least(greatest((c - a) * 1.6, (d - b) * 1.6 * 16 / 9, 0.3 * 1920), 1920, 1080 * 16 / 9.0::double) as w from e), k as (select *, floor(least(greatest((a + c) / 2 - w / 2, 0), 1920 - w)) as x, floor(least(greatest((b + d) / 2 - w * 9 / 16 / 2, 0), 1080 - w * 9 / 16)) as y from w)
  select video_id, tid, x::int as x1, y::int as y1, floor(x + w)::int as x2, floor(y + w * 9 / 16)::int as y2 from k""")
def track_crop(spark, d):
    return N.crop(tracks(spark, d), ["video_id", "tid"], 1920, 1080)


# rows that are left: strides, cleaning, re-timed candidates


@query(f"with {TR} select event_id from tr where frame % 3 = 0")
def strided_frames(spark, d):
    return every_nth_frame(tracks(spark, d), 30.0, 10.0).select("event_id")


@query(f"with {TR} select event_id from tr where round_even(t * 2.0::double, 0)::bigint % 4 = 0")
def sampled_rows(spark, d):
    return sampled(tracks(spark, d), 2.0, 0.5).select("event_id")


@query(f"""with {TR}, w as (select video_id, greatest(1, round_even(30.0::double / dt, 0))::int as win from (select video_id, median(d) as dt from (select video_id, t - lag(t) over (partition by video_id, tid order by t, event_id) as d from tr) group by video_id)),
  gr as (select tr.*, w.win, (x1 + x2) / 2 as gx, y2 as gy from tr join w using (video_id))
  select event_id, round_even(avg(gx) over f, 4) as gx, round_even(avg(gy) over f, 4) as gy from gr window f as (partition by video_id, tid order by t, event_id rows between (win - 1 - (win - 1) // 2) preceding and ((win - 1) // 2) following)""")
def smoothed_by_video(spark, d):
    return K.smoothed_by_video(tracks(spark, d), 30.0).select("event_id", *rounded("gx", "gy"))


@query(f"""with recursive {SEG}, raw as (select video_id, label, case when label = 'view' and event_id % 3 = 0 then 'n/a' else s::varchar end as s, (e + 1)::varchar as e from seg),
  num as (select video_id, label, try_cast(s as double) as s, least(try_cast(e as double), 715.0) as e from raw where label <> 'purchase'), ok as (select video_id, label, round_even(s, 3) as s, round_even(e, 3) as e from num where s >= 0 and s < e),
  o as (select *, row_number() over (partition by video_id, label order by s, e) as r from ok),
  k(video_id, label, s, e, r, reach, kept) as (select video_id, label, s, e, r, e, true from o where r = 1 union all select o.video_id, o.label, o.s, o.e, o.r, case when o.s >= k.reach then o.e else k.reach end, o.s >= k.reach from k join o on o.video_id = k.video_id and o.label = k.label and o.r = k.r + 1)
  select video_id, label, s as "start", e as "end" from k where kept""")
def clean_events(spark, d):
    s = segments(spark, d).withColumn("duration", F.lit(715.0))
    start = F.when((F.col("label") == "view") & (F.col("event_id") % 3 == 0), "n/a").otherwise(F.col("start").cast("string"))
    return V.clean_events(s.withColumns({"start": start, "end": (F.col("end") + 1).cast("string")}), ["click", "view", "signup", "error"])


@query(f"""with {SEG}, c as (select event_id as cid, label, case when label = 'signup' then event_id - 3 end as retime_of, case when s > 360 then 'real' else 'not_real' end as verdict from seg), ok as (select retime_of from c where retime_of is not null and verdict = 'real')
  select cid, label from c where (retime_of is null or verdict = 'real') and cid not in (select retime_of from ok)""")
def superseded(spark, d):
    c = segments(spark, d).select(F.col("event_id").alias("cid"), "label", F.when(F.col("label") == "signup", F.col("event_id") - 3).alias("retime_of"), F.when(F.col("start") > 360, "real").otherwise("not_real").alias("verdict"))
    return C.superseded(c).select("cid", "label")


@query()
def risk_on_road(spark, d):
    road = S.road_cells(flow(spark, d), 5, NY, NX)
    return replay(on_known_road(tracks(spark, d), road, GRID, NY, NX)).select("video_id", "t", *rounded("score"))


# views


@query(f"with {KIN}, g as (select *, sqrt(power(gx - lag(gx) over w, 2) + power(gy - lag(gy) over w, 2)) as far from kin window w as (partition by video_id, tid order by t, event_id)), h as (select *, max(coalesce(far, 0)) over (partition by video_id, tid) as most, count(*) over (partition by video_id, tid) as n from g) select event_id from h where n >= 3 and most <= 120")
def shown_tracks(spark, d):
    return N.shown_tracks(kinematic(spark, d), 3, 120.0).select("event_id")


@query(f"""with {FLOW}, ax as (select video_id, 0.5 * atan2(sum(n * sin(2 * atan2(uy, ux))), sum(n * cos(2 * atan2(uy, ux)))) as a from dir group by video_id)
  select d.video_id, d.cy, d.cx, round_even(d.ux, 4) as ux, round_even(d.uy, 4) as uy, d.ux * cos(a) + d.uy * sin(a) >= 0 as onward from dir d join ax on ax.video_id = d.video_id where d.n >= 5 and d.coherence >= 0.1 and (d.cx + d.cy) % 2 = 0""")
def lane_arrows(spark, d):
    f = flow(spark, d)
    return N.lane_arrows(f, S.main_axis(f), 5, 0.1).select("video_id", "cy", "cx", *rounded("ux", "uy"), "onward")


@query(f"with {FLOW}, p as (select video_id, quantile_cont(ln(1 + n), 0.99) as top from flow group by video_id) select f.video_id, f.cy, f.cx, round_even(least(ln(1 + f.n) / p.top, 1.0), 4)::double as density from flow f join p on p.video_id = f.video_id")
def flow_density(spark, d):
    return N.density(flow(spark, d)).select("video_id", "cy", "cx", *rounded("density"))


@query(f"""with {FLOW}, g as (select v.video_id, y.y, x.x from (select distinct video_id from flow) v, (select unnest(range(0, {NY})) as y) y, (select unnest(range(0, {NX})) as x) x)
  select g.video_id, g.y::int as cy, g.x::int as cx, f.n, round_even(f.sx, 4) as sx from g join flow f on f.video_id = g.video_id and f.cx = floor((g.x - 3) / 2.0 + 0.5) and f.cy = floor(g.y - 1 + 0.5)""")
def moved_grid(spark, d):
    return N.moved_grid(flow(spark, d), (2.0, 0.0, 3.0, 0.0, 1.0, 1.0), NY, NX).select("video_id", "cy", "cx", "n", *rounded("sx"))


@query(f"with {FLOW} select cy, cx, 0::bigint as video_id, sum(n)::bigint as n, round_even(sum(sx), 4) as sx, round_even(sum(sy), 4) as sy from flow group by cy, cx")
def merged_flow(spark, d):
    f = flow(spark, d)
    videos = [f.where(F.col("video_id") == v).withColumn("video_id", F.lit(0).cast("long")) for v in range(4)]
    return S.merged_flow(*videos).select("cy", "cx", "video_id", "n", *rounded("sx", "sy"))


@query(f"with {TR}, f as (select distinct video_id, frame::double as t from tr) select f.video_id, f.t, round_even(coalesce((select arg_max(x1 / 500, (c.t, c.x1)) from tr c where c.video_id = f.video_id and c.t <= f.t), 0.0), 4) as score from f")
def held_forward_curve(spark, d):
    frames = tracks(spark, d).select("video_id", F.col("frame").cast("double").alias("t")).distinct()
    return held_forward(curve(spark, d), frames).select("video_id", "t", *rounded("score"))


@query("select distinct source, upper(substr(replace(source, '_', ' '), 1, 1)) || substr(replace(source, '_', ' '), 2) as shown from documents where source is not null")
def display_names(spark, d):
    return W.display_names(spark.read.parquet(f"{d}/documents.parquet").where("source is not null").select("source").distinct(), "source")

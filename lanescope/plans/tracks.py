"""Queries on tracks, kinematics, runs, pairs, time joins and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.functions import geometry as G
from lanescope.operators import kinematics as K
from lanescope.operators import pairs as P
from lanescope.operators import runs as R
from lanescope.operators import scene as S
from lanescope.operators import temporal as T

from .fixture import BOX, CROSSWALKS, DURATION, FLOW, GRID, KIN, LINE, MC, MOVING, NX, NY, RAW, REFUGE, ROAD, STOP_LINE, STOPPED, TR, WIN, kinematic, r_sql, rounded, tracks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


RUNS_SQL = """, m as (select *, {mask} as ok from {src}), i as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from m),
runs as (select video_id, tid, min(t) as "start", max(t) as "end", count(*) as n from i where ok group by video_id, tid, run)"""
STOP_RUNS = KIN + RUNS_SQL.format(mask="speed < 0.04", src="kin")


@query(f"with {TR} select event_id, video_id, tid from tr where (video_id, tid) in (select (video_id, tid) from tr group by video_id, tid having max(t) - min(t) >= 600)")
def track_span_filter(spark, d):
    return K.long_tracks(tracks(spark, d), 600.0).select("event_id", "video_id", "tid")


@query(f"with {MC} select distinct video_id, tid, cls from mc")
def majority_class(spark, d):
    return K.majority_class(tracks(spark, d)).select("video_id", "tid", "cls").distinct()


@query(f"with {TR}, g as (select video_id, t - lag(t) over (partition by video_id, tid order by t, event_id) as d from tr) select video_id, round_even(median(d), 4) as dt from g group by video_id")
def sampling_interval(spark, d):
    return K.sampling_interval(tracks(spark, d)).select("video_id", *rounded("dt"))


@query(f"with {TR}{RAW.format(src='tr')} select event_id, {r_sql('gx', 'gy', 'size')} from gr")
def ground_point_size(spark, d):
    return K.with_ground(tracks(spark, d)).select("event_id", *rounded("gx", "gy", "size"))


@query(f"with {TR}{RAW.format(src='tr')} select event_id, {r_sql('vx', 'vy')} from raw")
def gradient_velocity(spark, d):
    return K.with_velocity(tracks(spark, d)).select("event_id", *rounded("vx", "vy"))


@query(f"with {KIN} select event_id, {r_sql('gx', 'gy', 'size', 'vx', 'vy')} from kin")
def rolling_mean_centred(spark, d):
    return kinematic(spark, d).select("event_id", *rounded("gx", "gy", "size", "vx", "vy"))


@query(f"with {TR}{RAW.format(src='tr')} select event_id, round_even(avg(gx) over (partition by video_id, tid order by t, event_id rows between 6 preceding and current row), 4) as gx from raw")
def rolling_mean_trailing(spark, d):
    return K.with_kinematics(tracks(spark, d), WIN, centred=False).select("event_id", *rounded("gx"))


@query(f"with {KIN} select event_id, {r_sql('speed', 'heading')} from kin")
def speed_heading(spark, d):
    return kinematic(spark, d).select("event_id", *rounded("speed", "heading"))


@query(f"with {STOP_RUNS} select video_id, tid, {r_sql('\"start\"', '\"end\"')}, n from runs".replace('as "start"', 'as start').replace('as "end"', 'as "end"'))
def runs_stopped(spark, d):
    return R.runs(kinematic(spark, d), F.col("speed") < STOPPED).select("video_id", "tid", *rounded("start", "end"), "n")


@query(f"""with {KIN}, m as (select *, speed > 0.08 as mv from kin), f as (select *, last_value(case when mv then t end ignore nulls) over (partition by video_id, tid order by t, event_id rows between unbounded preceding and current row) as b,
  first_value(case when mv then t end ignore nulls) over (partition by video_id, tid order by t, event_id rows between current row and unbounded following) as a from m)
  select event_id, mv or coalesce(a - b <= 20.0, false) as filled from f""")
def fill_gaps(spark, d):
    k = kinematic(spark, d).withColumn("mv", F.col("speed") > MOVING)
    return k.select("event_id", R.fill_gaps(k, "mv", 20.0).alias("filled"))


@query(f"""with {TR}, g as (select *, case when t - lag(t) over (partition by video_id, tid order by t, event_id) > 20 then 1 else 0 end as brk from tr),
  s as (select *, sum(brk) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as sid from g)
  select video_id, tid, sid::bigint as session, count(*) as n, round_even(min(t), 4) as "start", round_even(max(t), 4) as "end" from s group by video_id, tid, sid""")
def sessionize_gap(spark, d):
    s = tracks(spark, d).withColumn("session", R.session_id(20.0))
    return s.groupBy("video_id", "tid", "session").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end")).select("video_id", "tid", "session", "n", *rounded("start", "end"))


SEG = f"""{TR}, seg as (select event_id, video_id, event_type as label, t as s, t + 1 + y1 / 50 as e from tr)"""
MERGE = """, mi as (select *, max(e) over (partition by {k} order by s, e rows between unbounded preceding and 1 preceding) as reach from {src}),
mn as (select *, sum(case when reach is null or s - reach {op} {gap} then 1 else 0 end) over (partition by {k} order by s, e rows unbounded preceding) as island from mi),
merged as (select {k}, min(s) as s, max(e) as e from mn group by {k}, island)"""


def segments(spark, d):
    return tracks(spark, d).select("event_id", "video_id", F.col("event_type").alias("label"), F.col("t").alias("start"), (F.col("t") + 1 + F.col("y1") / 50).alias("end"))


@query(f"with {SEG}{MERGE.format(k='video_id, label', src='seg', op='>', gap='0.1')} select video_id, label, round_even(s, 4) as \"start\", round_even(e, 4) as \"end\" from merged")
def merge_intervals(spark, d):
    return R.merge_intervals(segments(spark, d), 0.1, ["video_id", "label"]).select("video_id", "label", *rounded("start", "end"))


FINAL = """, fs as (select video_id, label, greatest({s}, 0.0) as s, least({e}, 720.0) as e from {src}), fc as (select * from fs where e > s)"""


@query(f"""with {SEG}{FINAL.format(s="s + case label when 'error' then -1.5 else 0 end", e="e + case label when 'click' then -0.5 else 0 end", src='seg')}{MERGE.format(k='video_id, label', src='fc', op='>', gap='1.0')}
  select video_id, label, round_even(s, 3) as "start", round_even(e, 3) as "end" from merged where e - s >= 0.5""")
def finalize_segments(spark, d):
    return R.finalize(segments(spark, d), DURATION, shift={"error": (-1.5, 0.0), "click": (0.0, -0.5)})


@query(f"with {SEG} select event_id, round_even(s + case label when 'view' then -1.5 when 'error' then -1.0 else 0 end, 4) as \"start\", round_even(e + case label when 'error' then -1.5 else 0 end, 4) as \"end\" from seg")
def boundary_shift(spark, d):
    a, b = R.shifted({"view": (-1.5, 0.0), "error": (-1.0, -1.5)})
    return segments(spark, d).select("event_id", F.bround(a, 4).alias("start"), F.bround(b, 4).alias("end"))


@query(f"""with {STOP_RUNS}, ev as (select video_id, "start" as s, "end" as e from runs where "end" - "start" >= 10)
  , lab as (select *, 'stopped_vehicle' as label from ev){FINAL.format(s='s - 1.0', e='e - 1.5', src='lab')}{MERGE.format(k='video_id, label', src='fc', op='>', gap='1.0')}
  select video_id, label, round_even(s, 3) as "start", round_even(e, 3) as "end" from merged where e - s >= 0.5""")
def stopped_segments(spark, d):
    found = R.runs(kinematic(spark, d), F.col("speed") < STOPPED).where(F.col("end") - F.col("start") >= 10)
    return R.finalize(found.select("video_id", "start", "end", F.lit("stopped_vehicle").alias("label")), DURATION, shift={"stopped_vehicle": (-1.0, -1.5)})


PAIRS = KIN + """, pr as (select a.video_id, a.frame, a.t, a.event_id as ea, b.event_id as eb, a.tid as a_tid, b.tid as b_tid, a.cls as ca, b.cls as cb,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab, b.gx - a.gx as px, b.gy - a.gy as py, b.vx - a.vx as wx, b.vy - a.vy as wy, a.size + b.size as ss
  from kin a join kin b on a.video_id = b.video_id and a.frame = b.frame and a.tid < b.tid)"""


@query(f"with {PAIRS} select ea, eb, round_even(inter / (aa + ab - inter + 1e-9), 4) as iou from pr where inter > 0")
def pair_iou(spark, d):
    p = P.with_iou(P.frame_pairs(kinematic(spark, d))).where("iou > 0")
    return p.select(F.col("a_event_id").alias("ea"), F.col("b_event_id").alias("eb"), *rounded("iou"))


TTC = """, q as (select *, wx * wx + wy * wy as qa, 2 * (px * wx + py * wy) as qb, px * px + py * py - power(0.25 * ss, 2) as qc from pr),
ttc as (select *, case when qc <= 0 then 0.0 when qa > 1e-9 and qb < 0 and qb * qb - 4 * qa * qc >= 0 then (-qb - sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) end as ttc from q)"""


@query(f"with {PAIRS}{TTC} select ea, eb, round_even(ttc, 3) as ttc from ttc where ttc < 100")
def pair_ttc(spark, d):
    p = P.with_ttc(P.frame_pairs(kinematic(spark, d)), 0.25).where("ttc < 100")
    return p.select(F.col("a_event_id").alias("ea"), F.col("b_event_id").alias("eb"), *rounded("ttc", places=3))


@query(f"with {PAIRS} select ea, eb, round_even(-(px * wx + py * wy) / (sqrt(px * px + py * py) + 1e-9) / (ss / 2), 4) as closing from pr")
def pair_closing_speed(spark, d):
    p = P.with_closing(P.frame_pairs(kinematic(spark, d)))
    return p.select(F.col("a_event_id").alias("ea"), F.col("b_event_id").alias("eb"), *rounded("closing"))


WALK = """, wk as (select * from kin p where cls = 'person' and not exists (select 1 from kin w where w.cls in ('bicycle', 'motorcycle') and w.video_id = p.video_id and w.frame = p.frame
  and greatest(least(p.x2, w.x2) - greatest(p.x1, w.x1), 0) * greatest(least(p.y2, w.y2) - greatest(p.y1, w.y1), 0) / greatest((p.x2 - p.x1) * (p.y2 - p.y1), 1e-9) > 0.3))"""


@query(f"with {KIN}{WALK} select event_id from wk")
def rider_overlap_anti(spark, d):
    return P.walkers(kinematic(spark, d)).select("event_id")


@query(f"""with {KIN}{WALK}, med as (select video_id, median(size) as car from kin where cls = 'car' group by video_id)
  select distinct v.event_id from kin v join wk p on v.video_id = p.video_id and v.frame = p.frame left join med on med.video_id = v.video_id
  where v.cls in ('car', 'truck', 'bus', 'motorcycle', 'bicycle') and sqrt(power(v.gx - p.gx, 2) + power(v.gy - p.gy, 2)) < 2.5 * least(v.size, coalesce(med.car, v.size))""")
def near_pairs(spark, d):
    k = kinematic(spark, d)
    return P.near_pairs(k.where(F.col("cls").isin(P.VEHICLES)), P.walkers(k), 2.5, ["video_id", "frame"]).select("event_id").distinct()


@query(f"""with {KIN}{RUNS_SQL.format(mask="speed < 0.04 and cls <> 'person'", src='kin')}, rb as (select r.video_id, r.tid, r."start", r."end", median(i.gx) as rx, median(i.gy) as ry, median(i.size) as rs from i
    join runs r on i.video_id = r.video_id and i.tid = r.tid and i.ok and i.t between r."start" and r."end" group by all)
  select b.video_id, b.tid, round_even(b."start", 4) as "start", count(*) as n, sum(case when o.speed < 0.08 then 1 else 0 end)::bigint as slow from rb b
    join kin o on o.video_id = b.video_id and o.tid <> b.tid and o.t between b."start" and b."end" and o.cls <> 'person' and sqrt(power(o.gx - b.rx, 2) + power(o.gy - b.ry, 2)) < 4 * b.rs group by all""")
def neighbour_range_join(spark, d):
    k = kinematic(spark, d).where("cls <> 'person'")
    full = kinematic(spark, d)
    r = R.runs(full, (F.col("speed") < STOPPED) & (F.col("cls") != "person"), R.TRACK, R.ORDER, F.median("gx").alias("rx"), F.median("gy").alias("ry"), F.median("size").alias("rs"))
    near = (F.col("other") != F.col("tid")) & (F.hypot(F.col("gx") - F.col("rx"), F.col("gy") - F.col("ry")) < 4 * F.col("rs"))
    j = T.binned_join(k.select("video_id", "t", F.col("tid").alias("other"), "gx", "gy", "speed"), r.drop("n"), ["video_id"], 10.0, near)
    return j.groupBy("video_id", "tid", "start").agg(F.count("*").alias("n"), F.sum((F.col("speed") < MOVING).cast("long")).alias("slow")).select("video_id", "tid", *rounded("start"), "n", "slow")


SIG = f"""{TR}, sg as (select video_id, frame, frame::double as t, avg(case when event_type = 'error' then 1.0 else 0 end) as red, avg(case when event_type = 'click' then 1.0 else 0 end) as green from tr group by all),
code as (select *, case when red >= 0.2 and red > green then 1 when green >= 0.2 and green > red then 2 else 0 end as code from sg)"""


def signals(spark, d):
    t = tracks(spark, d).groupBy("video_id", "frame").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("red"), F.avg((F.col("event_type") == "click").cast("double")).alias("green"))
    return t.withColumns({"t": F.col("frame").cast("double"), "event_id": F.col("frame"), "code": S.signal_code(F.col("red"), F.col("green"), 0.2)})


@query(f"""with {SIG} select tr.event_id, coalesce((select arg_min(c.code, c.t) from code c where c.video_id = tr.video_id and c.t >= tr.t), (select arg_max(c.code, c.t) from code c where c.video_id = tr.video_id)) as code from tr""")
def asof_forward(spark, d):
    return T.as_of(tracks(spark, d).select("video_id", "t", "event_id"), signals(spark, d).select("video_id", "t", "code"), ["code"], ["video_id"], forward=True, clamp=True).select("event_id", "code")


@query(f"with {SIG} select tr.event_id, (select arg_max(c.code, c.t) from code c where c.video_id = tr.video_id and c.t <= tr.t) as code from tr")
def asof_backward(spark, d):
    return T.as_of(tracks(spark, d).select("video_id", "t", "event_id"), signals(spark, d).select("video_id", "t", "code"), ["code"], ["video_id"]).select("event_id", "code")


@query(f"with {SIG} select tr.event_id, coalesce((select arg_max(c.code, c.t) from (select * from code where code > 0) c where c.video_id = tr.video_id and c.t <= tr.t and c.t >= tr.t - 2), 0) as code from tr")
def asof_tolerance(spark, d):
    return T.as_of(tracks(spark, d).select("video_id", "t", "event_id"), signals(spark, d).where("code > 0").select("video_id", "t", "code"), ["code"], ["video_id"], tolerance=2.0).select("event_id", F.coalesce("code", F.lit(0)).alias("code"))


@query(f"with {FLOW} select video_id, cy, cx, n, {r_sql('sx', 'sy')} from flow")
def flow_field(spark, d):
    return S.flow_field(kinematic(spark, d), GRID, MOVING).select("video_id", "cy", "cx", "n", *rounded("sx", "sy"))


def flow(spark, d):
    return S.flow_field(kinematic(spark, d), GRID, MOVING)


@query(f"with {FLOW} select video_id, cy, cx, {r_sql('ux', 'uy', 'coherence')} from dir")
def flow_direction(spark, d):
    return S.flow_direction(flow(spark, d)).select("video_id", "cy", "cx", *rounded("ux", "uy", "coherence"))


@query(f"with {FLOW}, ax as (select video_id, 0.5 * atan2(sum(n * sin(2 * atan2(uy, ux))), sum(n * cos(2 * atan2(uy, ux)))) as a from dir group by video_id) select video_id, round_even(cos(a), 4) as ax, round_even(sin(a), 4) as ay from ax")
def main_axis(spark, d):
    return S.main_axis(flow(spark, d)).select("video_id", *rounded("ax", "ay"))


@query(f"with {ROAD} select video_id, cy::int as cy, cx::int as cx from road")
def road_close(spark, d):
    return S.road_cells(flow(spark, d), 5, NY, NX)


def on_road(spark, d):
    return S.with_road(kinematic(spark, d), S.road_cells(flow(spark, d), 5, NY, NX), GRID, NY, NX).persist()


@query(f"with {ROAD} select event_id, on_road from kr")
def road_lookup(spark, d):
    return on_road(spark, d).select("event_id", "on_road")


@query(f"with {FLOW} select k.event_id, round_even(d.ux, 4) as ux, round_even(d.uy, 4) as uy, round_even(d.coherence, 4) as coherence from kin k left join dir d on d.video_id = k.video_id and d.cy = floor(k.gy / 16)::int and d.cx = floor(k.gx / 16)::int")
def lane_lookup(spark, d):
    return S.with_lane(kinematic(spark, d), flow(spark, d), GRID).select("event_id", *rounded("ux", "uy", "coherence"))


@query(f"with {KIN} select event_id, case when gx between 20 and 60 and gy between 40 and 90 then 1 when gx between 70 and 110 and gy between 40 and 90 then 2 else 0 end as crosswalk, gx between 55 and 75 and gy between 55 and 75 as refuge, gx between 50 and 140 and gy between 0 and 130 as junction from kin")
def point_in_polygon(spark, d):
    x, y = F.col("gx"), F.col("gy")
    return kinematic(spark, d).select("event_id", G.first_polygon(CROSSWALKS, x, y).alias("crosswalk"), G.in_polygon(REFUGE, x, y).alias("refuge"), G.in_any([BOX], x, y).alias("junction"))


@query(f"with {KIN} select event_id, sign(-(100) * (gx - 50))::double as side, round_even((gy - 20) / 100, 4) as along from kin")
def line_side(spark, d):
    x, y = F.col("gx"), F.col("gy")
    return kinematic(spark, d).select("event_id", G.side_of_line(STOP_LINE, x, y).alias("side"), F.bround(G.along_line(STOP_LINE, x, y), 4).alias("along"))


BENT = [(30.0, 0.0), (50.0, 60.0), (50.0, 130.0)]


@query(f"""with {KIN}, u as (select *, greatest(0, least(1, ((gx - 30) * 20 + gy * 60) / 4000)) as u1, greatest(0, least(1, (gy - 60) / 70)) as u2 from kin),
  dd as (select *, sqrt(power(gx - (30 + 20 * u1), 2) + power(gy - 60 * u1, 2)) as d1, sqrt(power(gx - 50, 2) + power(gy - (60 + 70 * u2), 2)) as d2 from u)
  select event_id, case when least(d1, d2) > 1.5 * size then 0.0 when d1 <= d2 then sign(20 * gy - 60 * (gx - 30)) else sign(-70 * (gx - 50)) end::double as side from dd""")
def polyline_side(spark, d):
    return kinematic(spark, d).select("event_id", G.polyline_side(BENT, F.col("gx"), F.col("gy"), 1.5 * F.col("size")).alias("side"))


@query(f"""with {KIN}, h as (select *, heading - lag(heading) over w as dh from kin window w as (partition by video_id, tid order by t, event_id)),
  c as (select *, case when dh is null or abs(dh) < 180 then 0 else (case when m = -180 and dh > 0 then 180 else m end) - dh end as turn from (select *, (dh + 180) - 360 * floor((dh + 180) / 360) - 180 as m from h))
  select event_id, round_even(heading + sum(turn) over (partition by video_id, tid order by t, event_id rows unbounded preceding), 3) as unwrapped from c""")
def heading_unwrap(spark, d):
    return kinematic(spark, d).withColumn("unwrapped", R.unwrapped("heading")).select("event_id", *rounded("unwrapped", places=3))


VOTE = SIG + """, vt as (select *, sum(case when code = 0 then 1 else 0 end) over w as v0, sum(case when code = 1 then 1 else 0 end) over w as v1, sum(case when code = 2 then 1 else 0 end) over w as v2
  from code window w as (partition by video_id order by t rows between 3 preceding and 3 following)), voted as (select *, case when v0 >= v1 and v0 >= v2 then 0 when v1 >= v2 then 1 else 2 end as state from vt)"""


def voted(spark, d):
    w = Window.partitionBy("video_id").orderBy("t").rowsBetween(-3, 3)
    n = [F.sum((F.col("code") == k).cast("int")).over(w) for k in range(3)]
    return signals(spark, d).withColumn("state", F.when((n[0] >= n[1]) & (n[0] >= n[2]), 0).when(n[1] >= n[2], 1).otherwise(2))


@query(f"with {VOTE} select video_id, frame, state from voted")
def signal_vote(spark, d):
    return voted(spark, d).select("video_id", "frame", "state")


# trailing windows


@query(f"""with {KIN}, s as (select *, coalesce(sqrt(power(gx - lag(gx) over w, 2) + power(gy - lag(gy) over w, 2)), 0) as step, round_even(t * 1000000, 0)::bigint as us from kin window w as (partition by video_id, tid order by t, event_id)),
  p as (select *, sum(case when step > 60 then 1 else 0 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as part from s)
  select a.event_id, round_even(min(b.t), 4) as since, count(*) as points from p a join p b on b.video_id = a.video_id and b.tid = a.tid and b.part = a.part and b.us between a.us - 40000000 and a.us group by a.event_id""")
def trails(spark, d):
    return R.trails(kinematic(spark, d), 40.0, 60.0).select("event_id", *rounded("since"), "points")


@query(f"""with {KIN}, s as (select *, coalesce(sqrt(power(gx - lag(gx) over w, 2) + power(gy - lag(gy) over w, 2)), 0) as step, round_even(t * 1000000, 0)::bigint as us from kin window w as (partition by video_id, tid order by t, event_id)),
  p as (select *, sum(case when step > 60 then 1 else 0 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as part from s)
  select a.event_id, round_even(coalesce((select sum(b.step) from p b where b.video_id = a.video_id and b.tid = a.tid and b.part = a.part and b.us between a.us - 40000000 and a.us and (b.t, b.event_id) <= (a.t, a.event_id) and b.step <= 60
    and (b.t, b.event_id) > (select min((c.t, c.event_id)) from p c where c.video_id = a.video_id and c.tid = a.tid and c.part = a.part and c.us between a.us - 40000000 and a.us)), 0), 3) as path from p a""")
def trail_lengths(spark, d):
    return R.trails(kinematic(spark, d), 40.0, 60.0).select("event_id", *rounded("path", places=3))


@query(f"""with {KIN}, s as (select *, round_even(t * 1000000, 0)::bigint as us from kin), p as (select a.event_id, any_value(a.speed) as speed, max(b.speed) as peak from s a join s b on b.video_id = a.video_id and b.tid = a.tid and b.us between a.us - 20000000 and a.us group by a.event_id)
  select event_id, round_even(case when peak > 0.08 then (peak - speed) / peak else 0 end, 4)::double as brake from p""")
def brake_share(spark, d):
    return R.braking_share(kinematic(spark, d), 20.0, MOVING).select("event_id", *rounded("brake"))

"""Queries on the event rules, evaluation, statistics, votes and the sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanescope.operators import evaluate as V
from lanescope.operators import rules as E
from lanescope.operators import runs as R
from lanescope.operators import scene as S
from lanescope.operators import sequential as Q
from lanescope.operators import stats as C
from lanescope.operators import tracking as T
from lanescope.streaming.risk import replay

from .fixture import BOX, CROSSWALKS, DIRECTION, DURATION, GRAD, GRID, KIN, LINE, MOVING, REFUGE, ROAD, STOP_LINE, STOPPED, TR, kinematic, rounded, tracks
from .tracks import MERGE, RUNS_SQL, SEG, TTC, VOTE, flow, on_road, segments, voted

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def keep(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


SE = 'round_even("start", 4) as "start", round_even("end", 4) as "end"'
VEH = "cls in ('car', 'truck', 'bus', 'motorcycle', 'bicycle')"
ENTRY = "case when gx between 20 and 60 and gy between 40 and 90 then 1 when gx between 70 and 110 and gy between 40 and 90 then 2 else 0 end"


@query(f"""with {ROAD}, mv as (select *, max(case when speed > 0.08 then 1 else 0 end) over (partition by video_id, tid) as moved from kr where {VEH})
  {RUNS_SQL.format(mask='speed < 0.04 and on_road', src='(select * from mv where moved = 1)')} select video_id, tid, {SE}, n from runs""")
def stationary_runs(spark, d):
    return E.stationary(on_road(spark, d), MOVING, STOPPED).select("video_id", "tid", *rounded("start", "end"), "n")


@query(f"""with {ROAD}, ax as (select video_id, 0.5 * atan2(sum(n * sin(2 * atan2(uy, ux))), sum(n * cos(2 * atan2(uy, ux)))) as a from dir group by video_id),
  w as (select k.*, sign(round_even(d.ux * cos(ax.a) + d.uy * sin(ax.a), 12))::int as way from kr k join dir d on d.video_id = k.video_id and d.cy = floor(k.gy / 16)::int and d.cx = floor(k.gx / 16)::int join ax on ax.video_id = k.video_id where k.on_road and k.{VEH}),
  b as (select video_id, way, floor(t / 24)::int as bin, count(distinct tid) as n, median(speed) as speed from w where way <> 0 group by all),
  sp as (select g.video_id, g.way, x.bin from (select distinct video_id, way from b) g, (select unnest(range(0, 31)) as bin) x),
  z as (select sp.*, coalesce(b.n >= 2 and b.speed < 0.12, false) as ok from sp left join b using (video_id, way, bin)),
  i as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, way order by bin rows unbounded preceding) as run from z)
  select video_id, way, min(bin) * 24.0::double as "start", (max(bin) + 1) * 24.0::double as "end" from i where ok group by video_id, way, run having (max(bin) + 1 - min(bin)) * 24 >= 24""")
def congestion(spark, d):
    f = flow(spark, d)
    return E.congestion(on_road(spark, d), f, S.main_axis(f), GRID, 24.0, 2, 0.12, 24.0, DURATION)


@query(f"""with {ROAD}, l as (select k.*, coalesce(k.on_road and k.speed > 0.08 and d.coherence >= 0.2 and (k.vx * d.ux + k.vy * d.uy) / (sqrt(k.vx * k.vx + k.vy * k.vy) + 1e-9) < -0.2 and not (k.gx between 50 and 140 and k.gy between 0 and 130), false) as bad
    from kr k left join dir d on d.video_id = k.video_id and d.cy = floor(k.gy / 16)::int and d.cx = floor(k.gx / 16)::int where k.{VEH}),
  f as (select *, last_value(case when bad then t end ignore nulls) over (partition by video_id, tid order by t, event_id rows between unbounded preceding and current row) as b, first_value(case when bad then t end ignore nulls) over (partition by video_id, tid order by t, event_id rows between current row and unbounded following) as a from l),
  g as (select * exclude (a, b), bad or coalesce(a - b <= 20, false) as filled from f){RUNS_SQL.format(mask='filled', src='g')} select video_id, tid, {SE} from runs where "end" - "start" >= 0.5""")
def wrong_way(spark, d):
    k = S.with_lane(on_road(spark, d).drop("cx", "cy"), flow(spark, d), GRID)
    return E.wrong_way(k, MOVING, 0.2, -0.2, 20.0, 0.5, [BOX]).select("video_id", "tid", *rounded("start", "end"))


WALKR = """, wk as (select * from kr p where cls = 'person' and not exists (select 1 from kr w where w.cls in ('bicycle', 'motorcycle') and w.video_id = p.video_id and w.frame = p.frame
  and greatest(least(p.x2, w.x2) - greatest(p.x1, w.x1), 0) * greatest(least(p.y2, w.y2) - greatest(p.y1, w.y1), 0) / greatest((p.x2 - p.x1) * (p.y2 - p.y1), 1e-9) > 0.3))"""


@query(f"""with {ROAD}{WALKR}{RUNS_SQL.format(mask=f'on_road and {ENTRY} = 0 and not (gx between 55 and 75 and gy between 55 and 75)', src='wk')} select video_id, tid, {SE} from runs where "end" - "start" >= 2""")
def jaywalking(spark, d):
    return E.jaywalking(on_road(spark, d), CROSSWALKS, [REFUGE], 0.0, 2.0).select("video_id", "tid", *rounded("start", "end"))


ZONE = "case when (gx between {0} and {1} and gy between {2} and {3}) or (gx between {4} and {5} and gy between {2} and {3}) or (gx between {6} and {7} and gy between {8} and {9}) then 1 else 0 end"


@query(f"""with {ROAD}{WALKR}, pz as (select * from wk where speed >= 0.05 and {ZONE.format(10, 70, 30, 100, 60, 120, 45, 85, 45, 85)} = 1 and not (gx between 55 and 75 and gy between 55 and 75)),
  vz as (select *, {ZONE.format(20, 60, 40, 90, 70, 110, 55, 75, 55, 75)} as zone from kr where {VEH}), med as (select video_id, median(size) as car from vz where cls = 'car' and zone > 0 group by video_id),
  hit as (select distinct v.event_id from vz v join pz p on v.video_id = p.video_id and v.frame = p.frame left join med on med.video_id = v.video_id where v.zone = 1 and sqrt(power(v.gx - p.gx, 2) + power(v.gy - p.gy, 2)) < 2.5 * least(v.size, coalesce(med.car, v.size))),
  lz as (select *, case when zone is distinct from lag(zone) over (partition by video_id, tid order by t, event_id) then 1 else 0 end as nw from vz),
  rz as (select *, sum(nw) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from lz),
  az as (select video_id, tid, run, min(t) as "start", max(t) as "end", max(speed) as top, count(h.event_id) as hits from rz left join hit h using (event_id) where zone > 0 group by video_id, tid, run)
  select video_id, tid, {SE} from az where top > 0.08 and hits > 0""")
def failure_to_yield(spark, d):
    return E.failure_to_yield(on_road(spark, d), CROSSWALKS, [REFUGE], 2.5, 10.0, MOVING, 0.05).select("video_id", "tid", *rounded("start", "end"))


RED = VOTE + """, rn as (select *, lead(t) over (partition by video_id order by t) as nxt, sum(case when state <> 1 then 1 else 0 end) over (partition by video_id order by t rows unbounded preceding) as run from voted),
rr as (select video_id, run, min(t) as r0, max(t) as r1, arg_max(nxt, t) filter (where nxt is not null or true) as na from rn where state = 1 group by video_id, run),
rs as (select rn.video_id, rn.t, case when rn.state = 1 and rn.t >= rr.r0 + 2 and (l.nxt is null or rn.t < l.nxt - 1) then 1 else 0 end as red from rn left join rr on rr.video_id = rn.video_id and rr.run = rn.run left join rn l on l.video_id = rr.video_id and l.t = rr.r1)"""


def red_states(spark, d):
    return E.red_at(voted(spark, d).select("video_id", "t", "state"), 2.0, 1.0)


@query(f"with {RED} select video_id, t, red from rs")
def effective_red(spark, d):
    return red_states(spark, d)


REDAT = "coalesce((select arg_min(s.red, s.t) from rs s where s.video_id = {0}.video_id and s.t >= {0}.t), (select arg_max(s.red, s.t) from rs s where s.video_id = {0}.video_id))"
INBOX = "(gx between 50 and 140 and gy between 0 and 130)"


@query(f"""with {KIN}, {RED.split('tr as', 1)[1].split('from events)', 1)[1].lstrip(', ')}, v0 as (select kin.*, gx < 50 as up, {INBOX} as box, (gy - 20) / 100 as along from kin where {VEH}),
  v1 as (select *, lag(up) over w as was, lag(t) over w as prev, min(case when up then t end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as since from v0 window w as (partition by video_id, tid order by t, event_id)),
  cr as (select * from v1 where was and not up and along between -0.05 and 1.05 and vx / (sqrt(vx * vx + vy * vy) + 1e-9) >= 0.5 and t - since >= 1),
  c1 as (select video_id, tid, min(t) as tc, arg_min(prev, t) as st from (select *, {REDAT.format('cr')} as red from cr) where red = 1 group by all),
  en as (select video_id, tid, min(t) as entry from v0 join c1 using (video_id, tid) where box and t >= tc group by all),
  a as (select c1.video_id, c1.tid, c1.st as "start", min(case when v.t <= c1.tc + 20 then v.speed end) as slow, max(case when v.t <= c1.tc + 20 and v.box then 1 else 0 end) as enters, min(case when v.t > en.entry and not v.box then v.t end) as xt, max(v.t) as last
    from c1 join v0 v on v.video_id = c1.video_id and v.tid = c1.tid and v.t >= c1.tc left join en on en.video_id = c1.video_id and en.tid = c1.tid group by all)
  select video_id, tid, round_even("start", 4) as "start", round_even(coalesce(xt, last), 4) as "end" from a where slow > 0.01 and enters = 1""")
def red_light(spark, d):
    out = E.red_light(kinematic(spark, d), red_states(spark, d), STOP_LINE, DIRECTION, BOX, 0.5, 1.0, 20.0, 0.01)
    return out.select("video_id", "tid", *rounded("start", "end"))


@query(f"""with {KIN}, {RED.split('tr as', 1)[1].split('from events)', 1)[1].lstrip(', ')}, v0 as (select *, max(case when speed > 0.08 then 1 else 0 end) over (partition by video_id, tid) as moved from kin where {VEH}),
  v1 as (select *, lead(t) over (partition by video_id, tid order by t, event_id) as nxt, (gx - 50) / size >= 0.3 and (gy - 20) / 100 between -0.05 and 1.05 and not (gx between 110 and 200 and gy between 0 and 130) and speed < 0.04 as ok from v0 where moved = 1),
  v2 as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from v1),
  r0 as (select video_id, tid, run, min(t) as t, max(t) as last, arg_max(coalesce(nxt, -1), (t, event_id)) as nxt from v2 where ok group by all),
  r1 as (select *, {REDAT.format('r0')} as red, (select min(s.t) from rs s where s.video_id = r0.video_id and s.red = 0 and s.t >= r0.t) as off_ from r0)
  select video_id, tid, round_even(t, 4) as "start", round_even(greatest(least(coalesce(off_ - 1, 1e18), case when nxt >= 0 then nxt else last end), t + 0.5), 4) as "end" from r1 where red = 1""")
def stop_line(spark, d):
    far = [(x + 60, y) for x, y in BOX]
    out = E.stop_line(kinematic(spark, d), red_states(spark, d), STOP_LINE, DIRECTION, far, 0.3, MOVING, STOPPED, 1.0)
    return out.select("video_id", "tid", *rounded("start", "end"))




@query(f"""with {KIN}, s as (select *, case when sqrt(power({{x1}} - 50, 2) + power(y2 - greatest(0, least(130, y2)), 2)) > 1.5 * size then 0 else sign(50 - {{x1}}) end as l,
    case when sqrt(power({{x2}} - 50, 2) + power(y2 - greatest(0, least(130, y2)), 2)) > 1.5 * size then 0 else sign(50 - {{x2}}) end as r from kin where {VEH}),
  ini as (select video_id, tid, arg_min(l, t) as l0, min(t) as t0, count(*) as known from s where l = r and l <> 0 group by all),
  a as (select s.video_id, s.tid, min(case when s.l = -l0 or s.r = -l0 then s.t end) as "start", min(case when s.l = -l0 and s.r = -l0 then s.t end) as "end" from s join ini i on i.video_id = s.video_id and i.tid = s.tid and i.known >= 2 and s.t > i.t0 group by all)
  select video_id, tid, {SE} from a where "end" >= "start" """.replace("{x1}", "x1").replace("{x2}", "x2"))
def solid_line_crossing(spark, d):
    return E.solid_line_crossing(kinematic(spark, d), LINE, 1.5).select("video_id", "tid", *rounded("start", "end"))


def turning(spark, d):
    return E.turns(kinematic(spark, d), 5.0, 0.05, 8.0)


TURNS = f"""with {KIN}, h as (select *, heading - lag(heading) over w as dh, row_number() over w as row_ from kin where {VEH} window w as (partition by video_id, tid order by t, event_id)),
  c as (select *, case when dh is null or abs(dh) < 180 then 0 else (case when m = -180 and dh > 0 then 180 else m end) - dh end as turn from (select *, (dh + 180) - 360 * floor((dh + 180) / 360) - 180 as m from h)),
  u as (select *, heading + sum(turn) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as un from c),
  n as (select *, lag(t) over w as tp, lead(t) over w as tn, lag(un) over w as up, lead(un) over w as ux from u window w as (partition by video_id, tid order by t, event_id)),
  g as (select *, coalesce(abs({GRAD.format(n='ux', x='un', p='up')}) > 5 and speed > 0.05, false) as bad from n),
  f as (select *, last_value(case when bad then t end ignore nulls) over (partition by video_id, tid order by t, event_id rows between unbounded preceding and current row) as b_, first_value(case when bad then t end ignore nulls) over (partition by video_id, tid order by t, event_id rows between current row and unbounded following) as a_ from g),
  m as (select *, bad or coalesce(a_ - b_ <= 8, false) as ok, count(*) filter (where speed > 0.05) over (partition by video_id, tid) as movers from f),
  i as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from m),
  rn as (select video_id, tid, run, min(t) as "start", max(t) as "end", abs(arg_max(un, (t, event_id)) - arg_min(un, (t, event_id))) as total, (min(row_) + max(row_)) // 2 as mid from i where ok group by video_id, tid, run having count(*) > 1 and min(movers) >= 3),
  ends as (select video_id, tid, arg_min(gx, (t, event_id)) as fx, arg_min(gy, (t, event_id)) as fy, arg_max(gx, (t, event_id)) as lx, arg_max(gy, (t, event_id)) as ly from i group by all),
  tu as (select rn.*, i.gx as mx, i.gy as my, fx, fy, lx, ly from rn join i on i.video_id = rn.video_id and i.tid = rn.tid and i.row_ = rn.mid join ends on ends.video_id = rn.video_id and ends.tid = rn.tid)"""


@query(f"{TURNS} select video_id, tid, case when total >= 150 then 'u_turn' else 'turn' end as kind, {SE} from tu where total >= 60")
def turns(spark, d):
    kind = F.when(F.col("total") >= 150, "u_turn").when(F.col("total") >= 60, "turn")
    return turning(spark, d).withColumn("kind", kind).where("kind is not null").select("video_id", "tid", "kind", *rounded("start", "end"))


def crashes(spark, d):
    return E.accidents(on_road(spark, d), 0.05, 0.1, 0.3, 0.3, STOPPED, 10.0)


CRASHED = f"""cu as (select video_id, frame, t, event_id, tid, cls, x1, y1, x2, y2 from kr where on_road and {VEH} union all select video_id, frame, t, event_id, tid, cls, x1, y1, x2, y2 from wk where on_road),
  cp as (select a.video_id, a.tid as a_tid, b.tid as b_tid, min(a.cls) as a_cls, min(b.cls) as b_cls, min(a.t) as t0 from cu a join cu b on a.video_id = b.video_id and a.frame = b.frame and a.tid < b.tid
    and greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) + 1e-9) >= 0.05
    and (a.{VEH} or b.{VEH}) group by all),
  cs as (select cp.*, u.side, max(case when k.t between t0 - 3 and t0 + 3 then speed end) as peak, min(case when k.t between t0 and t0 + 10 then speed end) as low, avg(case when k.t between t0 + 5 and t0 + 25 then speed end) as aft,
      coalesce(min(case when k.t >= t0 and speed < 0.04 then k.t end), max(case when k.t >= t0 then k.t end)) as done
    from cp, (values ('a'), ('b')) u(side) join kr k on k.video_id = cp.video_id and k.tid = case u.side when 'a' then cp.a_tid else cp.b_tid end group by all),
  crash as (select video_id, a_tid, b_tid, t0, greatest(max(done), t0 + 10) as done from cs group by video_id, a_tid, b_tid, t0
  having max(case when case side when 'a' then a_cls else b_cls end <> 'person' and peak >= 0.1 and low <= 0.7 * peak then 1 else 0 end) = 1 and min(case when aft is null or aft <= 0.3 then 1 else 0 end) = 1)"""


@query(f'with {ROAD}{WALKR}, {CRASHED} select video_id, a_tid, b_tid, round_even(t0, 4) as "start", round_even(done, 4) as "end" from crash')
def accident(spark, d):
    return crashes(spark, d).select("video_id", "a_tid", "b_tid", *rounded("start", "end"))


def close_calls(spark, d, crashed=None):
    crashed = crashes(spark, d) if crashed is None else crashed
    return E.near_misses(on_road(spark, d), crashed, 20.0, 60.0, 0.25, 0.1, 0.3, MOVING, 30.0, 10.0)


NEAR = f"""{ROAD}{WALKR}, us as (select video_id, frame, t, tid, cls, gx, gy, vx, vy, size from kr where on_road and {VEH} union all select video_id, frame, t, tid, cls, gx, gy, vx, vy, size from wk where on_road),
  pr as (select a.video_id, a.t, a.tid as a_tid, b.tid as b_tid, b.gx - a.gx as px, b.gy - a.gy as py, b.vx - a.vx as wx, b.vy - a.vy as wy, a.size + b.size as ss from us a join us b on a.video_id = b.video_id and a.frame = b.frame and a.tid < b.tid and (a.{VEH} or b.{VEH})){TTC},
  near as (select * from ttc where ttc < 60), np as (select *, sum(case when coalesce(t - before, 0) > 10 then 1 else 0 end) over (partition by video_id, a_tid, b_tid order by t rows unbounded preceding) as part from (select *, lag(t) over (partition by video_id, a_tid, b_tid order by t) as before from near)),
  worst as (select video_id, a_tid, b_tid, min(t) as first_, arg_min(t, (ttc, t, part)) as tc, arg_min(part, (ttc, t, part)) as part from np group by all having min(ttc) < 20),
  calls as (select w.*, (select max(n.t) from np n where n.video_id = w.video_id and n.a_tid = w.a_tid and n.b_tid = w.b_tid and n.part = w.part) as till from worst w),
  clear as (select * from calls c where not exists (select 1 from crash x where x.video_id = c.video_id and x.a_tid = c.a_tid and x.b_tid = c.b_tid and abs(x.t0 - c.first_) < 50)),
  party as (select c.video_id, c.a_tid, c.b_tid, c.tc, k.tid, k.t, k.speed, k.heading, k.event_id from clear c join kr k on k.video_id = c.video_id and k.tid in (c.a_tid, c.b_tid) and k.{VEH} and k.t between c.tc - 15 and c.tc + 20),
  top as (select *, max(case when t <= tc + 5 then speed end) over (partition by video_id, a_tid, b_tid, tid) as top from party),
  onset as (select *, max(case when t <= tc + 5 and speed >= 0.95 * top then t end) over (partition by video_id, a_tid, b_tid, tid) as from_ from top),
  brakes as (select video_id, a_tid, b_tid, tid, from_ from onset group by video_id, a_tid, b_tid, tid, top, from_ having top >= 0.1 and min(case when t between from_ and from_ + 15 then speed end) <= 0.7 * top),
  turn0 as (select *, heading - lag(heading) over (partition by video_id, a_tid, b_tid, tid order by t) as dh from party where t <= tc + 15 and speed > 0.08),
  turn1 as (select *, case when dh is null or abs(dh) < 180 then 0 else (case when m = -180 and dh > 0 then 180 else m end) - dh end as turn from (select *, (dh + 180) - 360 * floor((dh + 180) / 360) - 180 as m from turn0)),
  turn2 as (select *, heading + sum(turn) over (partition by video_id, a_tid, b_tid, tid order by t rows unbounded preceding) as un from turn1),
  turns as (select video_id, a_tid, b_tid, tid from turn2 group by all having count(*) >= 3 and max(un) - min(un) > 30),
  missed as (select video_id, a_tid, b_tid, min(from_) as onset from brakes b anti join turns t on t.video_id = b.video_id and t.a_tid = b.a_tid and t.b_tid = b.b_tid and t.tid = b.tid group by all)"""


@query(f"""with {NEAR.replace(', us as', ', ' + CRASHED + ', us as', 1)} select c.video_id, c.a_tid, c.b_tid, round_even(onset, 4) as "start", round_even(greatest(till, tc + 5), 4) as "end" from clear c join missed using (video_id, a_tid, b_tid)""")
def near_miss(spark, d):
    return close_calls(spark, d).select("video_id", "a_tid", "b_tid", *rounded("start", "end"))


# evaluation on segments: truth against the same intervals moved by value / 100


def truth_and_shifted(spark, d):
    t = tracks(spark, d).select("event_id", "video_id", F.col("event_type").alias("label"), F.col("t").alias("start"), (F.col("t") + 1 + F.col("y1") / 50).alias("end"), "x1")
    truth = t.select(F.col("event_id").alias("id"), "video_id", "label", "start", "end")
    pred = t.select(F.col("event_id").alias("id"), "video_id", "label", (F.col("start") + F.col("x1") / 100).alias("start"), (F.col("end") + F.col("x1") / 100).alias("end"))
    return truth, pred


CAND = f"""{SEG}, tp as (select tr.event_id as id, tr.video_id, event_type as label, t as s, t + 1 + y1 / 50 as e, x1 / 100 as sh from tr),
cand as (select a.video_id, a.label, a.id as truth_id, b.id as pred_id, (least(a.e, b.e + b.sh) - greatest(a.s, b.s + b.sh)) / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e + b.sh) - greatest(a.s, b.s + b.sh))) as iou
  from tp a join tp b on a.video_id = b.video_id and a.label = b.label and a.s < b.e + b.sh and b.s + b.sh < a.e)"""


@query(f"with {CAND} select truth_id, pred_id, round_even(iou, 4) as iou from cand where iou >= 0.3")
def tiou_candidates(spark, d):
    return V.candidates(*truth_and_shifted(spark, d), 0.3).select("truth_id", "pred_id", *rounded("iou"))


@query(f"""with {CAND}, b as (select label, count(distinct truth_id) as tp from cand where iou >= 0.3 group by label), nt as (select label, count(*) as n from tp group by label), np as (select label, count(*) as n from tp group by label),
  c as (select nt.label, coalesce(b.tp, 0) as tp, np.n - coalesce(b.tp, 0) as fp, nt.n - coalesce(b.tp, 0) as fn from nt join np using (label) left join b using (label))
  select label, tp, fp, fn, round_even(tp / (tp + fp), 4) as "precision", round_even(tp / (tp + fn), 4) as recall, round_even(2.0 * tp / (2 * tp + fp + fn), 4)::double as f1 from c""")
def prf_counts(spark, d):
    truth, pred = truth_and_shifted(spark, d)
    hit = V.found(truth, pred, 0.3).select("label", "truth_id").distinct()
    c = V.counts(truth, pred, hit)
    return c.select("label", "tp", "fp", "fn", *V.prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumns({n: F.bround(n, 4) for n in ("precision", "recall", "f1")})


PICK = """list_reduce(l, lambda a, x: case when list_contains(list_transform(a.k, lambda z: z.t), x.t) or list_contains(list_transform(a.k, lambda z: z.p), x.p) then a else {'t': a.t, 'p': a.p, 'v': a.v, 'k': list_append(a.k, {'t': x.t, 'p': x.p, 'v': x.v})} end,
  {'t': -1::bigint, 'p': -1::bigint, 'v': 0.0::double, 'k': []::struct(t bigint, p bigint, v double)[]}).k"""
PAIR = "{'t': truth_id, 'p': pred_id, 'v': iou, 'k': []::struct(t bigint, p bigint, v double)[]}"


@query(f"""with {CAND}, g as (select video_id, label, list({PAIR} order by iou desc, truth_id desc, pred_id desc) as l from cand where iou >= 0.3 group by all), k as (select video_id, label, unnest({PICK}) as k from g)
  select video_id, label, k.t as truth_id, k.p as pred_id, round_even(k.v, 4) as iou from k""")
def greedy_match(spark, d):
    return V.greedy_match(V.contenders(*truth_and_shifted(spark, d), 0.3)).select("video_id", "label", "truth_id", "pred_id", *rounded("iou"))


@query(f"""with {CAND}, th as (select unnest([0.3, 0.5, 0.7])::double as threshold), g as (select threshold, video_id, label, list({PAIR} order by iou desc, truth_id desc, pred_id desc) as l from cand join th on iou >= threshold group by all),
  m as (select threshold, label, count(*) as tp from (select threshold, label, unnest({PICK}) as k from g) group by all), n as (select label, count(*) as n from tp group by label),
  c as (select threshold, label, coalesce(m.tp, 0) as tp, n.n - coalesce(m.tp, 0) as fp, n.n - coalesce(m.tp, 0) as fn from th cross join n left join m using (threshold, label)),
  e as (select 'label' as scope, label, threshold, tp, fp, fn from c union all select 'micro', null, threshold, sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from c group by threshold)
  select scope, label, threshold, tp, fp, fn, round_even(tp / (tp + fp), 4) as "precision", round_even(tp / (tp + fn), 4) as recall, round_even(2.0 * tp / (2 * tp + fp + fn), 4)::double as f1 from e""")
def matched_counts(spark, d):
    r = V.report(*truth_and_shifted(spark, d)).where("scope <> 'agnostic'")
    return r.withColumns({n: F.bround(n, 4) for n in ("precision", "recall", "f1")})


@query("""with s as (select round_even(embedding[1]::double, 2) as score, (label = 3)::int as pos from embeddings), g as (select score, sum(pos) as p, count(*) as n from s group by score),
  c as (select *, sum(p) over (order by score desc rows unbounded preceding) as cp, sum(n) over (order by score desc rows unbounded preceding) as cn from g)
  select round_even(sum(p * cp / cn) / sum(p), 4)::double as ap, round_even(sum(p) / sum(n), 4)::double as rate from c""")
def average_precision(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.bround(F.get("embedding", F.lit(0)).cast("double"), 2).alias("score"), (F.col("label") == 3).cast("int").alias("positive"))
    return V.average_precision(e).select(*rounded("ap", "rate"))


def curve(spark, d):
    return tracks(spark, d).select("event_id", "video_id", "t", (F.col("x1") / 500).alias("score"))


def spans_of(spark, d, label):
    return segments(spark, d).where(F.col("label") == label).select("video_id", "start", "end")


@query(f"""with {SEG}, ac as (select * from seg where label = 'error'), nm as (select * from seg where label = 'signup')
  select tr.event_id, case when exists (select 1 from ac where ac.video_id = tr.video_id and tr.t between ac.s and ac.e) then -1 when exists (select 1 from ac where ac.video_id = tr.video_id and tr.t >= ac.s - 5 and tr.t < ac.s) then 1
    when exists (select 1 from nm where nm.video_id = tr.video_id and tr.t between nm.s - 5 and nm.e) then -1 else 0 end as label from tr""")
def frame_label(spark, d):
    return V.frame_labels(curve(spark, d), spans_of(spark, d, "error"), spans_of(spark, d, "signup")).select("event_id", F.coalesce("label", F.lit(-1)).alias("label"))


@query(f"""with {TR}, m as (select *, x1 / 500 >= 0.5 as ok from tr), i as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id order by t, event_id rows unbounded preceding) as run from m),
  rn as (select video_id, min(t) as s, max(t) as e from i where ok group by video_id, run){MERGE.format(k='video_id', src='rn', op='>=', gap='2.0')} select video_id, round_even(s, 4) as "start", round_even(e, 4) as "end" from merged""")
def alarm_starts(spark, d):
    return R.alarm_starts(curve(spark, d)).select("video_id", *rounded("start", "end"))


ALARMED = f"""{SEG}, am as (select *, x1 / 500 >= 0.5 as ok from tr), ai as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id order by t, event_id rows unbounded preceding) as run from am),
  arun as (select video_id, min(t) as s, max(t) as e from ai where ok group by video_id, run){MERGE.format(k='video_id', src='arun', op='>=', gap='2.0')},
  crash as (select video_id, list(s order by s) as l from seg where label = 'error' group by all), alarm as (select video_id, list(s order by s) as free from merged group by all),
  taken as (select video_id, unnest(list_reduce(list_transform(l, lambda x: {{'s': x, 'free': []::double[], 'k': []::struct(s double, a double)[]}}),
      lambda a, x: {{'s': x.s, 'free': list_filter(a.free, lambda f: f is distinct from list_min(list_filter(a.free, lambda g: g >= x.s - 10 and g < x.s))), 'k': list_append(a.k, {{'s': x.s, 'a': list_min(list_filter(a.free, lambda g: g >= x.s - 10 and g < x.s))}})}},
      {{'s': 0.0::double, 'free': coalesce(free, []::double[]), 'k': []::struct(s double, a double)[]}}).k) as k from crash left join alarm using (video_id)),
  matched as (select video_id, k.s as s, k.a as a from taken)"""


@query(f'with {ALARMED} select video_id, round_even(s, 4) as "start", round_even(a, 4) as alarm from matched')
def alarm_match(spark, d):
    return V.match_alarms(spans_of(spark, d, "error"), R.alarm_starts(curve(spark, d))).select("video_id", *rounded("start", "alarm"))


@query(f"""with {ALARMED}, ac as (select * from seg where label = 'error'), nm as (select * from seg where label = 'signup'),
  lab as (select tr.x1 / 500 as score, case when exists (select 1 from ac where ac.video_id = tr.video_id and tr.t between ac.s and ac.e) then -1 when exists (select 1 from ac where ac.video_id = tr.video_id and tr.t >= ac.s - 5 and tr.t < ac.s) then 1
    when exists (select 1 from nm where nm.video_id = tr.video_id and tr.t between nm.s - 5 and nm.e) then -1 else 0 end as label from tr),
  g as (select score, sum(label) as p, count(*) as n from lab where label >= 0 group by score), c as (select *, sum(p) over (order by score desc rows unbounded preceding) as cp, sum(n) over (order by score desc rows unbounded preceding) as cn from g),
  ap as (select case when sum(p) > 0 then sum(p * cp / cn) / sum(p) else 0 end as ap, sum(p) / sum(n) as rate from c), chance as (select case when rate < 1 then greatest(0, (ap - rate) / (1 - rate)) else 0 end as ap from ap),
  k as (select count(a) as tp, count(*) as n, coalesce(avg(coalesce(s - a, 0)), 0) as mtta, (select count(*) from merged) as alarms from matched),
  q as (select *, case when alarms > 0 then tp / alarms else 0 end as p, case when n > 0 then tp / n else 0 end as r from k), f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from q)
  select round_even(chance.ap, 4)::double as ap, round_even(p, 4)::double as "precision", round_even(r, 4)::double as recall, round_even(f1, 4)::double as f1, round_even(mtta, 4)::double as mtta, case when n > 0 then round_even(0.4 * chance.ap + 0.4 * f1 + 0.2 * least(1, mtta / 10), 4) end::double as score from f, chance""")
def alarm_score(spark, d):
    acc, alarms = spans_of(spark, d, "error"), R.alarm_starts(curve(spark, d))
    labelled = V.frame_labels(curve(spark, d), acc, spans_of(spark, d, "signup")).where("label is not null").select("score", F.col("label").alias("positive"))
    return V.alarm_score(V.match_alarms(acc, alarms), alarms, V.average_precision(labelled)).select(*rounded("ap", "precision", "recall", "f1", "mtta", "score"))


@query(f"""with recursive {SEG}, o as (select video_id, label, s, e, row_number() over (partition by video_id, label order by s, e) as r from seg),
  k(video_id, label, s, e, r, reach, kept) as (select video_id, label, s, e, r, e, true from o where r = 1 union all select o.video_id, o.label, o.s, o.e, o.r, case when o.s >= k.reach then o.e else k.reach end, o.s >= k.reach from k join o on o.video_id = k.video_id and o.label = k.label and o.r = k.r + 1)
  select video_id, label, round_even(s, 4) as "start", round_even(e, 4) as "end" from k where kept""")
def drop_overlaps(spark, d):
    return V.drop_overlaps(segments(spark, d)).select("video_id", "label", *rounded("start", "end"))


@query(f"""with {SEG}, o as (select *, lead(s) over (partition by video_id, label order by s, e) as ns from seg), v as (select * from (values (0), (1), (2), (3), (4)) t(video_id))
  select 'error' as severity, video_id, 'label' as what, count(*) as n from seg where label not in ('click', 'view', 'purchase', 'error') group by all
  union all select 'error', video_id, 'past the end', count(*) from seg where e > 700.5 group by all union all select 'error', video_id, 'overlap', count(*) from o where ns < e group by all
  union all select 'error', video_id, 'score', count(*) from tr where not (x1 / 400 between 0 and 1) group by all union all select 'warning', video_id, 'no curve', 1 from v where video_id not in (select video_id from tr)""")
def format_problems(spark, d):
    videos = spark.range(5).select(F.col("id").alias("video_id"), F.lit(700.0).alias("duration"))
    c = curve(spark, d).select("video_id", "t", (F.col("score") * 1.25).alias("score"), F.col("event_id").alias("seq"))
    out = V.problems(segments(spark, d), c.withColumn("seq", F.col("t")), videos, ["click", "view", "purchase", "error"])
    return out.groupBy("severity", "video_id", "what").agg(F.count("*").alias("n"))


# statistics


@query(f"""with {TR}, g as (select *, case when cls = 'car' then 'car' when cls = 'person' then 'person' when cls in ('bus', 'truck') then 'heavy' else 'two_wheeler' end as grp, floor(t / 24)::int as bin from tr),
  f as (select video_id, bin, count(distinct frame) as fr from g group by all), s as (select video_id, grp, bin, count(*) as n from g group by all),
  sp as (select v.video_id, q.grp, b.bin from (select distinct video_id from g) v, (select distinct grp from g) q, (select unnest(range(0, 31))::int as bin) b)
  select sp.video_id, sp.grp, sp.bin, round_even(coalesce(s.n, 0) / greatest(coalesce(f.fr, 0), 1), 2) as n from sp left join s using (video_id, grp, bin) left join f on f.video_id = sp.video_id and f.bin = sp.bin""")
def object_counts(spark, d):
    return C.object_counts(tracks(spark, d), 24.0, DURATION)


@query(f"with {KIN}, h as (select video_id, least(floor(speed / 0.05)::int, 39) as bin, count(*) as n from kin where speed > 0.08 group by all) select video_id, bin, n, round_even(100 * n / sum(n) over (partition by video_id), 4)::double as percent from h")
def speed_histogram(spark, d):
    return C.speed_histogram(kinematic(spark, d), MOVING, 0.05, 40).select("video_id", "bin", "n", *rounded("percent"))


@query(f"with {KIN}, g as (select video_id, floor(t / 5)::int as bin, 100 * avg(case when speed < 0.04 then 1.0 else 0 end) as p from kin group by all) select v.video_id, b.bin, round_even(g.p, 4)::double as percent from (select distinct video_id from kin) v cross join (select unnest(range(0, 145))::int as bin) b left join g on g.video_id = v.video_id and g.bin = b.bin")
def stopped_share(spark, d):
    return C.stopped_share(kinematic(spark, d), STOPPED, 5.0, DURATION).select("video_id", "bin", *rounded("percent"))


@query(f"with {VOTE}, c as (select *, lag(state) over w as p, lag(t) over w as tp, lead(t) over w as tn from voted window w as (partition by video_id order by t)) select video_id, frame, state from c where tp is null or tn is null or state is distinct from p")
def step_points(spark, d):
    return R.step_points(voted(spark, d), "state", order=["t"]).select("video_id", "frame", "state")


@query(f"with {SEG}, r as (select *, row_number() over (partition by label order by s, event_id) as r from seg) select label, event_id, r::int as rank from r where r <= 3")
def topk_per_label(spark, d):
    s = R.top_k(segments(spark, d), 3, ["label"], [F.col("start"), F.col("event_id")])
    w = F.row_number().over(R.Window.partitionBy("label").orderBy("start", "event_id"))
    return s.select("label", "event_id", w.alias("rank"))


def votes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    verdict = F.when(F.col("event_type").isin("click", "purchase"), "real").when(F.col("event_type").isin("view", "error"), "not_real").otherwise("unsure")
    v = e.select((F.col("event_id") % 300).alias("cid"), (F.col("user_id") % 5).alias("person"), verdict.alias("verdict"), F.col("event_id").alias("seq"), F.date_trunc("day", F.col("ts").cast("timestamp")).cast("string").alias("at"), (F.col("value").cast("double")).alias("start"))
    return v.withColumns({"end": F.col("start") + 2, "proposed_start": (F.col("cid") % 300).cast("double"), "proposed_end": (F.col("cid") % 300 + 1).cast("double")})


VT = """v as (select event_id % 300 as cid, user_id % 5 as person, case when event_type in ('click', 'purchase') then 'real' when event_type in ('view', 'error') then 'not_real' else 'unsure' end as verdict, event_id as seq, date_trunc('day', ts) as day, value::double as s from events),
lv as (select * from (select *, row_number() over (partition by cid, person order by day desc, seq) as r from v) where r = 1)"""


@query(f"with {VT} select cid, person, seq, verdict from lv")
def latest_vote(spark, d):
    return C.latest_votes(votes(spark, d)).select("cid", "person", "seq", "verdict")


@query(f"""with {VT} select cid, case when y > n then 'real' when y < n then 'not_real' when y > 0 then 'split' else 'unsure' end as verdict, round_even(coalesce(m, cid::double), 4) as "start", round_even(coalesce(m + 2, cid + 1.0::double), 4) as "end"
  from (select cid, count(*) filter (where verdict = 'real') as y, count(*) filter (where verdict = 'not_real') as n, median(s) filter (where verdict = 'real') as m from lv group by cid)""")
def vote_consensus(spark, d):
    return C.consensus(C.latest_votes(votes(spark, d))).select("cid", "verdict", *rounded("start", "end"))


@query(f"with {VT}, f as (select person, min(seq) as q from v group by person) select person, (row_number() over (order by q))::int as anon from f")
def anonymous_ids(spark, d):
    return C.anonymous(votes(spark, d), "person", "seq").select("person", "anon").distinct()


@query(f"with {SEG} select distinct video_id, floor(s / 60)::int as minute, label from seg except select video_id, floor(e / 60)::int, label from seg where label in ('error', 'signup')")
def set_difference(spark, d):
    s = segments(spark, d)
    minute = lambda c: F.floor(F.col(c) / 60).cast("int").alias("minute")
    return s.select("video_id", minute("start"), "label").subtract(s.where(F.col("label").isin("error", "signup")).select("video_id", minute("end"), "label"))


@query(f"with {SEG} select video_id, label, floor(s / 60)::int as minute, count(*) as n from seg group by all")
def events_per_minute(spark, d):
    return segments(spark, d).groupBy("video_id", "label", F.floor(F.col("start") / 60).cast("int").alias("minute")).agg(F.count("*").alias("n"))


# sequential operators, checked by rows here and against plain versions in tests


STITCH = f"""{ROAD}, mv as (select *, max(case when speed > 0.08 then 1 else 0 end) over (partition by video_id, tid) as moved from kr where {VEH}), ok as (select *, speed < 0.06 and on_road as ok from mv where moved = 1),
  irun as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from ok),
  stops as (select video_id, tid, min(t) as s, max(t) as e, median(x1) as x1, median(y1) as y1, median(x2) as x2, median(y2) as y2 from irun where ok group by video_id, tid, run),
  so as (select *, row_number() over (partition by video_id order by s, e, x1, y1, x2, y2, tid) as r from stops),
  fold(video_id, r, g) as (select video_id, 0::bigint, []::struct(tid bigint, s double, e double, x1 double, y1 double, x2 double, y2 double, n bigint)[] from (select distinct video_id from so)
    union all select f.video_id, o.r, case when k is null then list_append(g, {{'tid': o.tid, 's': o.s, 'e': o.e, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'n': 1}})
        else list_transform(g, lambda z, i: case when i = k then {{'tid': z.tid, 's': z.s, 'e': greatest(z.e, o.e), 'x1': z.x1, 'y1': z.y1, 'x2': z.x2, 'y2': z.y2, 'n': z.n + 1}} else z end) end
      from (select f.video_id, f.r, f.g, o.*, list_position(list_transform(f.g, lambda z: o.s - z.e between 0 and 30 and
          coalesce(greatest(least(z.x2, o.x2) - greatest(z.x1, o.x1), 0) * greatest(least(z.y2, o.y2) - greatest(z.y1, o.y1), 0)
          / nullif((z.x2 - z.x1) * (z.y2 - z.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(z.x2, o.x2) - greatest(z.x1, o.x1), 0) * greatest(least(z.y2, o.y2) - greatest(z.y1, o.y1), 0), 0), 0) >= 0.1), true) as k
        from fold f join so o on o.video_id = f.video_id and o.r = f.r + 1) x(video_id, r, g, v2, tid, s, e, x1, y1, x2, y2, r2, k), lateral (select x.tid, x.s, x.e, x.x1, x.y1, x.x2, x.y2, x.r2 as r) o, lateral (select x.video_id) f),
  stitched as (select video_id, z.* from (select video_id, unnest(arg_max(g, r)) as z from fold group by video_id))"""


@query(f"with recursive {STITCH} select video_id, round_even(s, 4) as \"start\", round_even(e, 4) as \"end\", n as parts from stitched")
def stitch_runs(spark, d):
    return Q.stitch_runs(E.stationary(on_road(spark, d), MOVING, 0.06), 30.0, 0.1).select("video_id", *rounded("start", "end"), "parts")


@query(f"""with {SEG}, cur as (select * from seg where event_id % 50 = 0), oth as (select * from seg where event_id % 50 <> 0),
  hit as (select c.event_id, count(o.event_id) as n from cur c left join oth o on o.video_id = c.video_id and o.label = c.label and c.s < o.e and o.s < c.e group by all),
  rest as (select * from oth o where not exists (select 1 from cur c where o.video_id = c.video_id and o.label = c.label and c.s < o.e and o.s < c.e)),
  l as (select video_id, label, list({{'s': s, 'e': e, 'g': []::struct(s double, e double, lo double, hi double, n bigint)[]}} order by s, e) as l from rest group by all),
  made as (select video_id, label, unnest(list_reduce(l, lambda a, x: {{'s': a.s, 'e': a.e, 'g': case when list_position(list_transform(a.g, lambda z: least(x.e, z.e) - greatest(x.s, z.s) >= 0.2 * (greatest(x.e, z.e) - least(x.s, z.s))), true) is null
        then list_append(a.g, {{'s': x.s, 'e': x.e, 'lo': x.s, 'hi': x.e, 'n': 1}})
        else list_transform(a.g, lambda z, i: case when i = list_position(list_transform(a.g, lambda y: least(x.e, y.e) - greatest(x.s, y.s) >= 0.2 * (greatest(x.e, y.e) - least(x.s, y.s))), true)
          then {{'s': z.s, 'e': z.e, 'lo': least(z.lo, x.s), 'hi': greatest(z.hi, x.e), 'n': z.n + 1}} else z end) end}},
      {{'s': 0.0::double, 'e': 0.0::double, 'g': []::struct(s double, e double, lo double, hi double, n bigint)[]}}).g) as g from l)
  select video_id, label, round_even(s, 4) as "start", round_even(e, 4) as "end", n + 1 as hits, true as current from cur join hit using (event_id)
  union all select video_id, label, round_even(g.lo, 4), round_even(g.hi, 4), g.n, false from made""")
def candidate_groups(spark, d):
    s = segments(spark, d).withColumn("current", F.col("event_id") % 50 == 0)
    return Q.candidate_groups(s).select("video_id", "label", *rounded("start", "end"), "hits", "current")


@query(f"""with recursive {TR}, o as (select video_id, t, x1 / 500 as raw, row_number() over (partition by video_id order by t) as r from tr),
  k(video_id, t, r, score) as (select video_id, t, r, least(1.0::double, greatest(0.0::double, raw)) from o where r = 1 union all
    select o.video_id, o.t, o.r, least(1.0::double, greatest(0.0::double, k.score + (1 - exp((k.t - o.t) / 0.6::double)) * (o.raw - k.score))) from k join o on o.video_id = k.video_id and o.r = k.r + 1)
  select video_id, t, round_even(score, 4) as score from k""")
def ema_risk(spark, d):
    return Q.smoothed(curve(spark, d).select("video_id", "t", F.col("score").alias("raw"), F.col("event_id").alias("seq"))).select("video_id", "t", *rounded("score"))


@keep("track_boxes")
def track_boxes(spark, d):
    det = tracks(spark, d).select("video_id", "frame", "t", "cls", (F.col("y1") / 100).alias("conf"), "x1", "y1", "x2", "y2")
    return T.track_boxes(det, keep=5.0, rate=1.0).select("video_id", "frame", "tid", *rounded("x1", "y1"))


@keep("risk_replay")
def risk_replay(spark, d):
    return replay(tracks(spark, d)).select("video_id", "t", *rounded("score"))



"""Queries on scenes as tables: videos with zones and approaches of their own, in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanescope.operators import rules as E
from lanescope.operators import scene as S
from lanescope.operators import scene_rules as X
from lanescope.operators import zones as Z

from .fixture import GRID, KIN, MOVING, NX, NY, ROAD, kinematic, rounded
from .rules import SE, VEH, WALKR
from .tracks import RUNS_SQL, VOTE, flow, on_road, voted

QUERIES: dict = {}
ORACLES: dict = {}
CELL = 64.0
#: Zones of the videos of the driver's events: quadrangles, one that is no convex polygon, one that crosses another, and a video without crosswalks.
SCENES = {
    0: {"crosswalk": [[(20, 40), (60, 44), (56, 90), (24, 84)], [(70, 40), (110, 40), (110, 90), (70, 90)]], "refuge": [[(58, 55), (72, 55), (72, 75), (58, 75)]]},
    1: {"crosswalk": [[(10, 30), (90, 30), (90, 60), (50, 45), (10, 60)], [(200, 20), (260, 50), (200, 80)], [(40, 0), (55, 0), (55, 100), (40, 100)]], "refuge": [[(300, 10), (340, 10), (340, 60)]]},
    2: {"crosswalk": [[(150, 10), (220, 10), (235, 110), (140, 110)]], "refuge": [[(170, 40), (200, 40), (185, 70)]]},
    3: {"refuge": [[(30, 30), (80, 30), (80, 80), (30, 80)]]},
}
LINES = [  # video, name, stop line, direction, box, delay, early end
    (0, "east", (50, 20, 50, 120), (1.0, 0.0), [(50, 0), (140, 10), (150, 120), (60, 130)], 2.0, 1.0),
    (1, "south", (20, 60, 160, 55), (0.0, 1.0), [(20, 60), (160, 58), (170, 130), (10, 130)], 1.0, 0.5),
    (2, "east", (80, 10, 90, 120), (0.8, 0.6), None, 2.0, 1.0),
    (2, "south", (160, 60, 20, 60), (0.0, 1.0), [(20, 60), (160, 60), (170, 130), (10, 130)], 1.0, 0.5),
    (3, "west", (200, 10, 200, 120), (-1.0, 0.0), [(190, 0), (120, 0), (120, 130), (190, 130)], 0.0, 0.0),
]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def zone_rows(spark):
    return Z.zone_table(spark, SCENES)


def approach_rows(spark):
    rows = [(v, n, *map(float, line), *d, [tuple(map(float, p)) for p in box] if box else None, delay, early) for v, n, line, d, box, delay, early in LINES]
    return spark.createDataFrame(rows, Z.APPROACHES)


def states(spark, d):
    """The lamp of each approach: the one that runs east as measured, the others the other way round."""
    s = voted(spark, d).select("video_id", "t", "state").join(approach_rows(spark).select("video_id", "approach"), "video_id")
    return s.select("video_id", "approach", "t", F.when((F.col("approach") == "east") | (F.col("state") == 0), F.col("state")).otherwise(3 - F.col("state")).alias("state"))


# the same in SQL: sides of polygons as rows

_sides = [(v, k, i + 1, *map(float, p + q)) for v, kinds in SCENES.items() for k, own in kinds.items() for i, z in enumerate(own) for p, q in zip(z, z[1:] + z[:1], strict=True)]
_boxes = [(v, n, *map(float, p + q)) for v, n, _, _, box, _, _ in LINES if box for p, q in zip(box, box[1:] + box[:1], strict=True)]
_values = lambda rows: ", ".join(str(r).replace("None", "null") for r in rows)
CROSSED = "count(*) filter (where gy >= least(ay, by_) and gy < greatest(ay, by_) and gx < ax + (gy - ay) * ((bx - ax) / nullif(by_ - ay, 0))) % 2 = 1"
ON_SIDE = "bool_or(gx between least(ax, bx) and greatest(ax, bx) and gy between least(ay, by_) and greatest(ay, by_) and (bx - ax) * (gy - ay) = (by_ - ay) * (gx - ax))"
SIDES = f"sides(video_id, kind, zone_id, ax, ay, bx, by_) as (values {_values(_sides)})"


def square_sql(x: str, y: str) -> str:
    """Chebyshev distance of a point from the side (ax, ay)-(bx, by_): where the square about the point first meets it."""
    at = ["0.0", "1.0", f"-((ax - {x}) - (ay - {y})) / nullif((bx - ax) - (by_ - ay), 0)", f"-((ax - {x}) + (ay - {y})) / nullif((bx - ax) + (by_ - ay), 0)"]
    far = lambda t: f"greatest(abs(ax - {x} + {t} * (bx - ax)), abs(ay - {y} + {t} * (by_ - ay)))"
    return "least(" + ", ".join(far(f"least(greatest(coalesce({t}, 0.0), 0.0), 1.0)") for t in at) + ")"


def zones_sql(src: str) -> str:
    """hits (event_id, kind, zone_id, inside, far) for rows of src and the zones of their video."""
    return f"""{SIDES}, hits as (select event_id, kind, zone_id, {CROSSED} or {ON_SIDE} as inside, min({square_sql('gx', 'gy')}) as far from {src} k join sides using (video_id) group by all)"""


ZONE_OF = "coalesce((select min(zone_id) from hits h where h.event_id = {k}.event_id and h.kind = '{kind}' and (inside or far <= {grow})), 0)"


@query(f"""with {KIN}, {zones_sql('kin')}
  select event_id, {ZONE_OF.format(k='kin', kind='crosswalk', grow=-1)}::int as crosswalk, {ZONE_OF.format(k='kin', kind='crosswalk', grow=6)}::int as near_crosswalk, {ZONE_OF.format(k='kin', kind='refuge', grow=-1)}::int as refuge from kin""")
def zone_lookup(spark, d):
    index = Z.zone_index(zone_rows(spark), CELL, 6.0)
    return Z.with_zones(kinematic(spark, d), index, CELL, {"crosswalk": ("crosswalk", 0.0), "near_crosswalk": ("crosswalk", 6.0), "refuge": ("refuge", 0.0)}).select("event_id", "crosswalk", "near_crosswalk", "refuge")


PARTS = f"""parts as (select video_id, kind, zone_id, (row_number() over (partition by video_id order by kind, zone_id))::int as part from (select distinct video_id, kind, zone_id from sides) z),
  ps as (select p.part, s.* from sides s join parts p using (video_id, kind, zone_id)),
  corner as (select a.video_id, a.part as p, b.part as q, min({square_sql('a.ax', 'a.ay').replace('ax - a.ax', 'b.ax - a.ax').replace('ay - a.ay', 'b.ay - a.ay').replace('(bx - ax)', '(b.bx - b.ax)').replace('(by_ - ay)', '(b.by_ - b.ay)')}) as far,
     bool_or(((b.bx - b.ax) * (a.ay - b.ay) - (b.by_ - b.ay) * (a.ax - b.ax)) * ((b.bx - b.ax) * (a.by_ - b.ay) - (b.by_ - b.ay) * (a.bx - b.ax)) < 0
       and ((a.bx - a.ax) * (b.ay - a.ay) - (a.by_ - a.ay) * (b.ax - a.ax)) * ((a.bx - a.ax) * (b.by_ - a.ay) - (a.by_ - a.ay) * (b.bx - a.ax)) < 0) as cut
    from ps a join ps b on a.video_id = b.video_id and a.part <> b.part group by all),
  held as (select video_id, p, q from (select a.video_id, a.part as p, b.part as q, a.ax as gx, a.ay as gy, b.ax, b.ay, b.bx, b.by_ from ps a join ps b on a.video_id = b.video_id and a.part <> b.part) h group by video_id, p, q, gx, gy having {CROSSED}),
  tied as (select video_id, p, q from corner where far <= 4 or cut union select video_id, p, q from held union select video_id, q, p from held union select video_id, q, p from corner where far <= 4 or cut),
  reach(video_id, p, q) as (select video_id, part, part from parts union select r.video_id, r.p, t.q from reach r join tied t on t.video_id = r.video_id and t.p = r.q),
  crossing as (select video_id, p as part, min(q) as part_of from reach group by all)"""


@query(f"with recursive {SIDES}, {PARTS} select video_id::bigint as video_id, part as zone_id, part_of from crossing")
def crossing_parts(spark, d):
    videos = kinematic(spark, d).select("video_id").distinct()
    return Z.crossings(zone_rows(spark).join(videos, "video_id", "left_semi")).select("video_id", "zone_id", "part_of")


def clipped(c: str, n: int) -> str:
    return f"greatest(least(trunc({c})::int, {n}), 0)"


_W, _H, _G = int(NX * GRID), int(NY * GRID), int(GRID)
KERB = f"""px as (select *, {clipped('gx', _W - 1)} as px, {clipped('gy', _H - 1)} as py from kr),
  win as (select event_id, video_id, greatest(px - 6, 0) // {_G} as c0, least(px + 5, {_W - 1}) // {_G} as c1, greatest(py - 6, 0) // {_G} as r0, least(py + 5, {_H - 1}) // {_G} as r1 from px),
  kerb as (select w.event_id, count(r.cx) = (c1 - c0 + 1) * (r1 - r0 + 1) as off_kerb from win w left join road r on r.video_id = w.video_id and r.cy between r0 and r1 and r.cx between c0 and c1 group by w.event_id, c0, c1, r0, r1)"""


@query(f"with {ROAD}, {KERB} select event_id, off_kerb from kerb")
def road_off_kerb(spark, d):
    road = S.road_cells(flow(spark, d), 5, NY, NX)
    return Z.with_eroded_road(kinematic(spark, d), road, _G, NY, NX, 12, name="off_kerb").select("event_id", "off_kerb")


@query(f"""with {ROAD}{WALKR}, {KERB}, {zones_sql('wk')}, wz as (select wk.*, kerb.off_kerb and {ZONE_OF.format(k='wk', kind='crosswalk', grow=3)} = 0 and {ZONE_OF.format(k='wk', kind='refuge', grow=-1)} = 0 as bad from wk join kerb using (event_id))
  {RUNS_SQL.format(mask='bad', src='wz')} select video_id, tid, {SE} from runs where "end" - "start" >= 2""")
def jaywalkers(spark, d):
    return jaywalking_events(spark, d).select("video_id", "tid", *rounded("start", "end"))


def jaywalking_events(spark, d):
    road = S.road_cells(flow(spark, d), 5, NY, NX)
    return X.jaywalkers(kinematic(spark, d), road, zone_rows(spark), _G, NY, NX, 12, 3.0, 2.0)


def crossing_sql(src: str, name: str, grow: float) -> str:
    """name (event_id, zone): the crossing that holds each row of src, its parts grown."""
    inner = f"select k.event_id, ps.part, {CROSSED} or {ON_SIDE} or min({square_sql('gx', 'gy')}) <= {grow} as inside from {src} k join ps on ps.video_id = k.video_id join (select distinct video_id from sides where kind = 'crosswalk') cv on cv.video_id = k.video_id group by all"
    return f"{name} as (select k.event_id, coalesce(min(c.part_of) filter (where h.inside), 0) as zone from {src} k left join ({inner}) h using (event_id) left join crossing c on c.video_id = k.video_id and c.part = h.part group by k.event_id)"


@query(f"""with recursive {ROAD}{WALKR}, {zones_sql('wk')}, {PARTS}, vh as (select * from kr where {VEH}), {crossing_sql('wk', 'wc', 12)}, {crossing_sql('vh', 'vc', 2)},
  pz as (select wk.video_id, wk.frame, wk.gx, wk.gy, wc.zone from wk join wc using (event_id) where speed >= 0.05 and zone > 0 and {ZONE_OF.format(k='wk', kind='refuge', grow=-1)} = 0), vz as (select vh.*, vc.zone from vh join vc using (event_id)),
  med as (select video_id, median(size) as car from kr where cls = 'car' group by video_id),
  hit as (select distinct v.event_id from vz v join pz p on v.video_id = p.video_id and v.frame = p.frame and v.zone = p.zone left join med on med.video_id = v.video_id where v.zone > 0 and sqrt(power(v.gx - p.gx, 2) + power(v.gy - p.gy, 2)) < 2.5 * least(v.size, coalesce(med.car, v.size))),
  lz as (select *, case when zone is distinct from lag(zone) over (partition by video_id, tid order by t, event_id) then 1 else 0 end as nw from vz),
  rz as (select *, sum(nw) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from lz),
  az as (select video_id, tid, run, min(t) as "start", max(t) as "end", max(speed) as top, count(h.event_id) as hits from rz left join hit h using (event_id) where zone > 0 group by video_id, tid, run)
  select video_id, tid, {SE} from az where top > 0.08 and hits > 0""")
def failures_to_yield(spark, d):
    return yield_events(spark, d).select("video_id", "tid", *rounded("start", "end"))


def yield_events(spark, d):
    return X.failures_to_yield(kinematic(spark, d), zone_rows(spark), CELL, 2.5, 10.0, MOVING, 0.05)


# approaches

_lines = [(v, n, *map(float, line), *map(float, dd), box is None, float(a), float(b)) for v, n, line, dd, box, a, b in LINES]
LANES = f"""lanes(video_id, approach, ax, ay, bx, by_, dx, dy, open_, delay, early) as (values {_values(_lines)}),
  st as (select v.video_id, l.approach, v.t, case when l.approach = 'east' or v.state = 0 then v.state else 3 - v.state end as state, l.delay, l.early from voted v join lanes l using (video_id)),
  sn as (select *, lead(t) over (partition by video_id, approach order by t) as nxt, sum(case when state <> 1 then 1 else 0 end) over (partition by video_id, approach order by t rows unbounded preceding) as run from st),
  sr as (select video_id, approach, run, min(t) as r0, max(t) as r1 from sn where state = 1 group by all),
  rs as (select s.video_id, s.approach, s.t, s.state, case when s.state = 1 and s.t >= r.r0 + s.delay and (l.nxt is null or s.t < l.nxt - s.early) then 1 else 0 end as red
    from sn s left join sr r on r.video_id = s.video_id and r.approach = s.approach and r.run = s.run left join sn l on l.video_id = r.video_id and l.approach = r.approach and l.t = r.r1)"""
ON_LANES = f"boxes(video_id, approach, ax, ay, bx, by_) as (values {_values(_boxes)})" + f""",
  ib as (select k.event_id, b.approach, {CROSSED} or {ON_SIDE} as inside from kin k join boxes b using (video_id) where {VEH} group by all),
  al as (select k.event_id, k.video_id, k.tid, k.t, k.speed, k.size, l.approach, l.open_, l.early, ib.inside,
     case when ((gx - ax) * (bx - ax) + (gy - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) between -0.05 and 1.05
       then sign((bx - ax) * (gy - ay) - (by_ - ay) * (gx - ax)) * (case when (bx - ax) * dy - (by_ - ay) * dx > 0 then 1 else -1 end) else 0 end as side,
     (vx * dx + vy * dy) / (sqrt(vx * vx + vy * vy) + 1e-9) as towards,
     ((gx - ax) * (by_ - ay) + (gy - ay) * (ax - bx)) / (sqrt((by_ - ay) * (by_ - ay) + (ax - bx) * (ax - bx)) + 1e-9) * (case when (by_ - ay) * dx + (ax - bx) * dy < 0 then -1 else 1 end) / size as past
    from kin k join lanes l using (video_id) left join ib on ib.event_id = k.event_id and ib.approach = l.approach where {VEH})"""
RED_AT = "coalesce((select arg_min(s.red, s.t) from rs s where s.video_id = {0}.video_id and s.approach = {0}.approach and s.t >= {0}.t), (select arg_max(s.red, s.t) from rs s where s.video_id = {0}.video_id and s.approach = {0}.approach))"
VOTED = VOTE.split("tr as", 1)[1].split("from events)", 1)[1].lstrip(", ")


def red(spark, d):
    return X.effective_red(states(spark, d), approach_rows(spark))


@query(f"with {VOTE}, {LANES} select video_id, approach, t, state, red from rs")
def red_by_approach(spark, d):
    return red(spark, d)


@query(f"""with {KIN}, {VOTED}, {LANES}, {ON_LANES},
  lg as (select *, lag(side) over w as was, lag(t) over w as prev, min(case when side = -1 then t end) over (partition by video_id, tid, approach order by t, event_id rows between unbounded preceding and 1 preceding) as since from al window w as (partition by video_id, tid, approach order by t, event_id)),
  cr as (select * from lg where was = -1 and side = 1 and towards >= 0.3 and t - since >= 1),
  c1 as (select video_id, tid, approach, min(t) as tc, arg_min(prev, t) as st from (select *, {RED_AT.format('cr')} as red from cr) where red = 1 group by all),
  en as (select al.video_id, al.tid, al.approach, min(t) as entry from al join c1 using (video_id, tid, approach) where inside and t >= tc group by all),
  a as (select c1.video_id, c1.tid, c1.approach, c1.st, bool_or(v.open_) as open_, min(case when v.t <= c1.tc + 20 then v.speed end) as slow, max(case when v.t <= c1.tc + 20 and v.inside then 1 else 0 end) as enters, min(case when v.t > en.entry and not v.inside then v.t end) as xt, max(v.t) as last
    from c1 join al v on v.video_id = c1.video_id and v.tid = c1.tid and v.approach = c1.approach and v.t >= c1.tc left join en on en.video_id = c1.video_id and en.tid = c1.tid and en.approach = c1.approach group by all)
  select video_id, tid, approach, round_even(st, 4) as "start", round_even(coalesce(xt, last), 4) as "end" from a where slow > 0.01 and (open_ or enters = 1)""")
def red_lights(spark, d):
    return red_light_events(spark, d).select("video_id", "tid", "approach", *rounded("start", "end"))


def red_light_events(spark, d):
    return X.red_lights(kinematic(spark, d), red(spark, d), approach_rows(spark), 0.3, 1.0, 20.0, 0.01)


@query(f"""with {KIN}, {VOTED}, {LANES}, {ON_LANES}, mv as (select *, max(case when speed > 0.08 then 1 else 0 end) over (partition by video_id, tid) as moved, lead(t) over (partition by video_id, tid, approach order by t, event_id) as nxt,
     side = 1 and past >= 0.3 and not coalesce(inside, false) and speed < 0.06 as ok from al),
  rn as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, tid, approach order by t, event_id rows unbounded preceding) as run from mv where moved = 1),
  r0 as (select video_id, tid, approach, run, min(t) as t, max(t) as last, arg_max(coalesce(nxt, -1), (t, event_id)) as nxt, min(early) as early from rn where ok group by all),
  r1 as (select *, {RED_AT.format('r0')} as red, (select min(s.t) from rs s where s.video_id = r0.video_id and s.approach = r0.approach and s.state <> 1 and s.t >= r0.t) as off_ from r0)
  select video_id, tid, approach, round_even(t, 4) as "start", round_even(greatest(least(coalesce(off_ - early, last), case when nxt >= 0 then nxt else last end), t + 0.5), 4) as "end" from r1 where red = 1""")
def stop_lines(spark, d):
    return stop_line_events(spark, d).select("video_id", "tid", "approach", *rounded("start", "end"))


def stop_line_events(spark, d):
    return X.stop_lines(kinematic(spark, d), red(spark, d), approach_rows(spark), 0.3, MOVING, 0.06)


@query(f"""with {ROAD}, {VOTED}, {LANES}, mv as (select *, max(case when speed > 0.08 then 1 else 0 end) over (partition by video_id, tid) as moved from kr where {VEH}), ok as (select *, speed < 0.06 and on_road as ok from mv where moved = 1),
  rn as (select *, sum(case when ok then 0 else 1 end) over (partition by video_id, tid order by t, event_id rows unbounded preceding) as run from ok),
  rr as (select video_id, tid, run, min(t) as s, max(t) as e, median(x1) as x1, median(x2) as x2, median(y2) as y2 from rn where ok group by all),
  up as (select rr.*, l.approach from rr join lanes l using (video_id) where sign((bx - ax) * (y2 - ay) - (by_ - ay) * ((x1 + x2) / 2 - ax)) = (case when (bx - ax) * dy - (by_ - ay) * dx > 0 then -1 else 1 end)),
  q as (select up.video_id, up.tid, up.s, up.approach from up join rs on rs.video_id = up.video_id and rs.approach = up.approach and rs.t between up.s and up.e group by all having avg(case when rs.state = 1 then 1.0 else 0 end) > 0.5)
  select distinct video_id, tid, round_even(s, 4) as "start" from q""")
def waiting_at_red(spark, d):
    found = stops(spark, d)
    return found.join(X.waiting_at_red(found, states(spark, d), approach_rows(spark)), "id", "left_semi").select("video_id", "tid", *rounded("start"))


def stops(spark, d):
    return E.stationary(on_road(spark, d), MOVING, 0.06).withColumn("id", F.xxhash64("video_id", "tid", "start"))

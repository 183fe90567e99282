"""Tracks seen in the driver's events table, in Spark and in DuckDB: one hour is a second, a user is a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.operators.kinematics import majority_class, with_kinematics

EPOCH, DURATION = 1704067200000000, 720.0
CLASSES = {"click": "car", "view": "person", "purchase": "bus", "signup": "bicycle", "error": "truck"}
WIN, MOVING, STOPPED, GRID, NY, NX = 7, 0.08, 0.04, 16.0, 9, 40
CROSSWALKS = [[(20.0, 40.0), (60.0, 40.0), (60.0, 90.0), (20.0, 90.0)], [(70.0, 40.0), (110.0, 40.0), (110.0, 90.0), (70.0, 90.0)]]
REFUGE = [(55.0, 55.0), (75.0, 55.0), (75.0, 75.0), (55.0, 75.0)]
LINE = [(50.0, 0.0), (50.0, 130.0)]
STOP_LINE, DIRECTION = [(50.0, 20.0), (50.0, 120.0)], (1.0, 0.0)
BOX = [(50.0, 0.0), (140.0, 0.0), (140.0, 130.0), (50.0, 130.0)]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p])[F.col("event_type")]
    e = e.select("event_id", (F.col("user_id") % 4).alias("video_id"), F.col("user_id").alias("tid"), ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / 3.6e9).alias("t"), kind.alias("cls"), "event_type", F.col("value").cast("double").alias("x1"), F.get_json_object("props", "$.k").cast("double").alias("y1"))
    return e.withColumns({"frame": F.floor("t").cast("long"), "x2": F.col("x1") + 10 + F.col("event_id") % 31, "y2": F.col("y1") + 10 + F.col("event_id") % 17})


def kinematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted: most rules read it several times. spark.catalog.clearCache() frees it; the next call makes it anew."""
    return with_kinematics(majority_class(tracks(spark, sf_dir)), WIN).persist()


TR = """tr as (select event_id, user_id % 4 as video_id, user_id as tid, (epoch_us(ts) - 1704067200000000) / 3.6e9::double as t,
  case event_type when 'click' then 'car' when 'view' then 'person' when 'purchase' then 'bus' when 'signup' then 'bicycle' when 'error' then 'truck' end as cls, event_type,
  value::double as x1, json_extract_string(props, '$.k')::double as y1,
  floor((epoch_us(ts) - 1704067200000000) / 3.6e9::double)::bigint as frame,
  value::double + 10 + event_id % 31 as x2, json_extract_string(props, '$.k')::double + 10 + event_id % 17 as y2 from events)"""
MC = TR + """, mcount as (select video_id, tid, cls, count(*) as n from tr group by all),
mfirst as (select video_id, tid, cls, row_number() over (partition by video_id, tid order by n desc, cls) as r from mcount),
mc as (select tr.* replace (m.cls as cls) from tr join mfirst m on tr.video_id = m.video_id and tr.tid = m.tid and m.r = 1)"""
GRAD = """case when tp is null and tn is null then 0.0 when tp is null then ({n} - {x}) / nullif(tn - t, 0) when tn is null then ({x} - {p}) / nullif(t - tp, 0)
  else ((t - tp) * (t - tp) * {n} + ((tn - t) * (tn - t) - (t - tp) * (t - tp)) * {x} - (tn - t) * (tn - t) * {p}) / nullif((t - tp) * (tn - t) * (tn - tp), 0) end"""
RAW = (
    """, gr as (select *, (x1 + x2) / 2 as gx, y2 as gy, sqrt(greatest(x2 - x1, 1) * greatest(y2 - y1, 1)) as size from {src}),
nb as (select *, lag(t) over w as tp, lead(t) over w as tn, lag(gx) over w as xp, lead(gx) over w as xn, lag(gy) over w as yp, lead(gy) over w as yn from gr window w as (partition by video_id, tid order by t, event_id)),
raw as (select * exclude (tp, tn, xp, xn, yp, yn), """
    + GRAD.format(n="xn", x="gx", p="xp")
    + " as vx, "
    + GRAD.format(n="yn", x="gy", p="yp")
    + " as vy from nb)"
)
KIN = (
    MC
    + RAW.format(src="mc")
    + """, sm as (select * exclude (gx, gy, size, vx, vy), avg(gx) over w as gx, avg(gy) over w as gy, avg(size) over w as size, avg(vx) over w as vx, avg(vy) over w as vy
  from raw window w as (partition by video_id, tid order by t, event_id rows between 3 preceding and 3 following)),
kin as (select *, sqrt(vx * vx + vy * vy) / size as speed, degrees(atan2(vy, vx)) as heading from sm)"""
)
FLOW = KIN + """, flow as (select video_id, floor(gy / 16)::int as cy, floor(gx / 16)::int as cx, count(*) as n, sum(vx / (sqrt(vx * vx + vy * vy) + 1e-9)) as sx, sum(vy / (sqrt(vx * vx + vy * vy) + 1e-9)) as sy
  from kin where speed > 0.08 and cls <> 'person' group by all),
dir as (select *, sx / (sqrt(sx * sx + sy * sy) + 1e-9) as ux, sy / (sqrt(sx * sx + sy * sy) + 1e-9) as uy, sqrt(sx * sx + sy * sy) / (n + 1e-9) as coherence from flow)"""
ROAD = FLOW + """, d5 as (select unnest(range(-2, 3)) as d), grid as (select v.video_id, y.cy, x.cx from (select distinct video_id from tr) v, (select unnest(range(0, 9)) as cy) y, (select unnest(range(0, 40)) as cx) x),
wide as (select g.* from grid g where exists (select 1 from flow f where f.n >= 5 and f.video_id = g.video_id and abs(f.cy - g.cy) <= 2 and abs(f.cx - g.cx) <= 2)),
road as (select w.* from wide w where not exists (select 1 from grid g anti join wide w2 on g.video_id = w2.video_id and g.cy = w2.cy and g.cx = w2.cx where g.video_id = w.video_id and abs(g.cy - w.cy) <= 2 and abs(g.cx - w.cx) <= 2)),
kr as (select k.*, r.cx is not null as on_road from kin k left join road r on r.video_id = k.video_id and r.cy = greatest(least(floor(k.gy / 16)::int, 8), 0) and r.cx = greatest(least(floor(k.gx / 16)::int, 39), 0))"""


def rounded(*names: str, places: int = 4):
    return [F.bround(n, places).alias(n) for n in names]


def r_sql(*names: str, places: int = 4) -> str:
    return ", ".join(f"round_even({n}, {places}) as {n}" for n in names)

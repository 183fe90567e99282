"""Streams say what the same operators say of the recorded table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanescope.operators import runs
from lanescope.streaming.alarms import alarm_stream
from lanescope.streaming.risk import RiskProcessor, RiskSettings, on_known_road, replay, risk_stream

TRACKS = "video_id long, t double, tid long, cls string, x1 double, y1 double, x2 double, y2 double"


def streamed(spark, tmp_path, batches, schema, plan, name):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = plan(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q, [tuple(r) for r in spark.table(name).collect()]


def course(video, shift=0.0, tid=0):
    """Two cars that meet after 8 s, a third far off, and tracks that come and go."""
    rows = []
    for i in range(80):
        t = i / 10
        boxes = [(1, 100 + 36 * t, 100 + 29 * t), (2, 700 - 36 * t, 580 - 29 * t), (3, 900 - 75 * t, 40.0), (100 + i // 10, 50.0 + i, 500.0)]
        rows += [(video, t + shift, tid + n, "car", x - 18, y - 24, x + 18, y) for n, x, y in boxes]
    return rows


def test_risk_stream_equals_replay_and_forgets_tracks(spark, tmp_path):
    rows = course(0) + course(1, 0.05) + course(0, 30.0, 50)
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in [(0, 0.35), (0.35, 3), (3, 3.1), (3.1, 20), (20, 99)]]
    kept = []
    q, got = streamed(spark, tmp_path, batches, TRACKS, risk_stream, "risk_a")
    want = {(r["video_id"], r["t"]): r["score"] for r in replay(spark.createDataFrame(rows, TRACKS)).collect()}
    got = {(v, t): s for v, t, s in got}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want) and max(want.values()) > 0.5
    state = spark.read.format("statestore").option("stateVarName", "tracks").load(str(tmp_path / "ck"))
    kept = state.select("key.video_id", "user_map_key.tid", "user_map_value.t") if "user_map_key" in state.columns else state
    last = {0: max(r[1] for r in rows if r[0] == 0), 1: max(r[1] for r in rows if r[0] == 1)}
    assert {(r[0], r[1]) for r in kept.select(*kept.columns[:2]).collect()} == {(v, str(tid)) for v, t, tid, *_ in rows if last[v] - t <= 2.0}


def test_boxes_off_the_road_are_no_risk_in_stream_and_replay(spark, tmp_path):
    rows = course(0) + course(1) + course(2)
    table = spark.createDataFrame(rows, TRACKS)
    # video 0: road everywhere the cars go; video 1: none where they meet; video 2 is not in the table
    road = spark.createDataFrame([(0, y, x) for y in range(20) for x in range(30)] + [(1, 0, 0)], "video_id long, cy int, cx int")
    on = lambda df: on_known_road(df, road, 32.0, 20, 30)
    want = {(r["video_id"], r["t"]): r["score"] for r in replay(on(table)).collect()}
    plain = {(r["video_id"], r["t"]): r["score"] for r in replay(table).collect()}
    assert all(want[k] == (0.0 if k[0] == 1 else plain[k]) for k in plain) and max(plain.values()) > 0.5
    _, got = streamed(spark, tmp_path, [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]], TRACKS, lambda s: risk_stream(on(s), RiskSettings()), "risk_b")
    assert {(v, t): s for v, t, s in got} == pytest.approx(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_alarm_stream_equals_recorded_alarms(spark, tmp_path, seed):
    g = random.Random(seed)
    rows, late = [], []
    for video in range(3):
        t, level = 0.0, 0.2
        while t < 60:
            t = round(t + g.choice([0.1, 0.2, 0.5, 1.0, 1.9, 2.0, 2.1, 4.0]), 3)
            level = g.choice([0.2, 0.5, 0.8]) if g.random() < 0.5 else level
            rows.append((video, t, level))
        rows += [(video, 200.0, 0.0), (video, 300.0, 0.0)]
    rows.sort(key=lambda r: r[1])
    cuts = [0, 12, 20, 31, 45, 50, 150, 250, 400]
    batches = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for a, b in zip(batches, batches[1:], strict=False):  # rows that come a batch later, but in time
        swap = [r for r in a if r[1] > max(x[1] for x in a) - 0.9 and g.random() < 0.5 and r[1] != max(x[1] for x in a)]
        for r in swap:
            a.remove(r)
            b.append(r)
        g.shuffle(b)
    late = [(0, 1.05, 0.9), (1, 5.05, 0.9)]
    batches[-2] += late  # after their time was settled
    _, got = streamed(spark, tmp_path, batches, "video_id long, t double, score double", alarm_stream, f"alarms_{seed}")
    curve = spark.createDataFrame(rows, "video_id long, t double, score double").withColumn("event_id", F.lit(0))
    want = [tuple(r) for r in runs.alarm_starts(curve).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5


def test_processors_are_plain_objects():
    import pickle

    assert pickle.loads(pickle.dumps(RiskSettings(forget=3.0))).forget == 3.0 and RiskProcessor(RiskSettings()).settings.persist == 3

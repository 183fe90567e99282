"""Scenes as tables against plain geometry and rasters, and the rules that read them on drawn scenes."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanescope.functions import geometry as G
from lanescope.operators import kinematics, runs, scene_rules, zones
from lanescope.operators.evaluate import average_precision
from lanescope.operators.rules import stationary
from tests.test_operators import CAR, TR, actors

CONCAVE = [(10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (50.0, 40.0), (10.0, 90.0)]
TRIANGLE = [(120.0, 20.0), (180.0, 60.0), (130.0, 110.0)]


def plain_inside(poly, x, y):
    sides = list(zip(poly, poly[1:] + poly[:1], strict=True))
    odd = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in sides) % 2 == 1
    on = any((b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in sides)
    return odd or on


def plain_within(poly, x, y, by):
    """Whether the square about the point meets the polygon, by cutting each side at the square (Liang and Barsky)."""
    if plain_inside(poly, x, y):
        return True
    for a, b in zip(poly, poly[1:] + poly[:1], strict=True):
        lo, hi = 0.0, 1.0
        for p, d in ((a[0] - x, b[0] - a[0]), (a[1] - y, b[1] - a[1])):
            if d == 0:
                lo, hi = (lo, hi) if abs(p) <= by else (1.0, 0.0)
            else:
                s, e = sorted(((-by - p) / d, (by - p) / d))
                lo, hi = max(lo, s), min(hi, e)
        if lo <= hi:
            return True
    return False


def test_points_meet_the_zones_of_their_video(spark):
    g = random.Random(3)
    drawn = {0: {"crosswalk": [CONCAVE, TRIANGLE], "refuge": [TRIANGLE]}, 1: {"crosswalk": [TRIANGLE, CONCAVE]}, 2: {"refuge": [CONCAVE]}}
    points = [(v, i * 10 + v, round(g.uniform(-20, 220), 2), round(g.uniform(-20, 140), 2)) for i in range(400) for v in range(4)]
    points += [(0, 10_000 + k, *p) for k, p in enumerate([(10.0, 10.0), (50.0, 40.0), (50.0, 10.0), (120.0, 20.0), (180.0, 60.0)])] + [(0, 20_000, None, 5.0)]
    df = spark.createDataFrame(points, "video_id long, event_id long, gx double, gy double")
    for cell in (16.0, 70.0, 500.0):
        index = zones.zone_index(zones.zone_table(spark, drawn), cell, 7.5)
        out = zones.with_zones(df, index, cell, {"a": ("crosswalk", 0.0), "b": ("crosswalk", 7.5), "c": ("refuge", 3.0)}).collect()
        assert len(out) == len(points)
        for r in out:
            first = lambda kind, test: next((i + 1 for i, z in enumerate(drawn.get(r["video_id"], {}).get(kind, [])) if r["gx"] is not None and test(z)), 0)  # noqa: B023, E731
            assert r["a"] == first("crosswalk", lambda z: plain_inside(z, r["gx"], r["gy"]))  # noqa: B023
            assert r["b"] == first("crosswalk", lambda z: plain_within(z, r["gx"], r["gy"], 7.5))  # noqa: B023
            assert r["c"] == first("refuge", lambda z: plain_within(z, r["gx"], r["gy"], 3.0))  # noqa: B023


def test_zones_join_where_they_overlap_once_grown(spark):
    square = lambda x, y, w=10.0: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    cross = [[(0.0, 40.0), (100.0, 40.0), (100.0, 45.0), (0.0, 45.0)], [(40.0, 0.0), (45.0, 0.0), (45.0, 100.0), (40.0, 100.0)]]  # no corner of one is in the other
    drawn = {
        0: {"crosswalk": [square(0, 0), square(30, 0), square(14, 0)], "refuge": [square(100, 0)]},  # 4 apart: 2 grown from each side
        1: {"crosswalk": cross, "refuge": [square(200, 200, 50.0), square(210, 210, 5.0)]},
        2: {"crosswalk": [square(0, 0), square(14.1, 0), square(24.1, 14.0)]},  # by both coordinates, not by the way between corners
    }
    got = {(r["video_id"], r["zone_id"]): r["part_of"] for r in zones.crossings(zones.zone_table(spark, drawn)).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 1, (0, 4): 4, (1, 1): 1, (1, 2): 1, (1, 3): 3, (1, 4): 3, (2, 1): 1, (2, 2): 2, (2, 3): 2}


def eroded(mask, size):
    """Least value of a square of `size` pixels that begins size // 2 before each pixel; pixels off the frame don't count."""
    h, w = mask.shape
    lo = size // 2
    return np.array([[mask[max(0, y - lo) : max(0, y - lo + size), max(0, x - lo) : max(0, x - lo + size)].all() for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("size,frame", [(1, None), (4, None), (12, None), (13, (93, 61)), (29, None), (40, (90, 60))])
def test_road_is_eroded_pixel_by_pixel(spark, size, frame):
    g, grid, ny, nx = np.random.default_rng(size), 8, 8, 12
    cells = {v: g.random((ny, nx)) < share for v, share in ((0, 0.9), (1, 0.97))}
    w, h = frame or (nx * grid, ny * grid)
    road = spark.createDataFrame([(v, int(y), int(x)) for v, c in cells.items() for y, x in zip(*np.nonzero(c), strict=True)], "video_id long, cy int, cx int")
    points = [(v, float(x) + 0.75, float(y) + 0.25) for v in cells for y in range(h) for x in range(w)] + [(0, -5.0, 3.0), (0, 1e4, 1e4), (5, 1.0, 1.0)]
    df = spark.createDataFrame(points, "video_id long, gx double, gy double")
    out = zones.with_eroded_road(df, road, grid, ny, nx, size, *(frame or ())).collect()
    want = {v: eroded(np.kron(c, np.ones((grid, grid), bool))[:h, :w], size) for v, c in cells.items()}
    assert len(out) == len(points)
    for r in out:
        assert r["on_road"] == (r["video_id"] in want and bool(want[r["video_id"]][min(max(int(r["gy"]), 0), h - 1), min(max(int(r["gx"]), 0), w - 1)]))


def test_scenes_are_read_from_files(spark, tmp_path):
    one = {
        "crosswalks": [[[0.1, 0.2], [0.3, 0.2], [0.3, 0.4]], []],
        "solid_lines": [[[0.0, 0.0], [1.0, 1.0]]],
        "approaches": [
            {"name": "in", "stop_line": [[0.1, 0.5], [0.2, 0.6], [0.3, 0.5]], "direction": [3.0, 4.0], "red_delay_sec": 5.0, "intersection": [[0.5, 0.5], [1.0, 0.5], [1.0, 1.0]]},
            {"name": "out", "stop_line": [[0, 0], [1, 0]], "direction": [0, -2]},
            {"name": "nowhere", "stop_line": [[0, 0], [1, 0]], "direction": [0, 0]},
        ],
        "movements": {"u_turn_prohibited": [[[0, 0], [1, 0], [1, 1]]], "forbidden": [{"from": [[0, 0], [0.5, 0], [0.5, 0.5]], "to": [[0.5, 0.5], [1, 0.5], [1, 1]]}]},
    }
    (tmp_path / "7.json").write_text(json.dumps(one))
    (tmp_path / "8.json").write_text(json.dumps({"refuges": [[[0, 0], [0.5, 0], [0.5, 0.5]]]}))
    (tmp_path / "9.json").write_text("not json")
    (tmp_path / "readme.json").write_text("{}")
    videos = spark.createDataFrame([(7, 1000, 500), (8, 640, 360), (9, 10, 10), (11, 10, 10)], "video_id long, width int, height int")
    drawn, approaches = zones.read_scenes(zones.scene_files(spark, str(tmp_path)), videos)
    got = {(r["video_id"], r["kind"], r["zone_id"]): [tuple(p) for p in r["points"]] for r in drawn.collect()}
    assert set(got) == {(7, "crosswalk", 1), (7, "solid_line", 1), (7, "no_u_turn", 1), (7, "from", 1), (7, "to", 1), (7, "junction", 1), (8, "refuge", 1)}
    assert got[7, "crosswalk", 1] == [(100.0, 100.0), (300.0, 100.0), (300.0, 200.0)] and got[8, "refuge", 1][1] == (320.0, 0.0)
    a = {r["approach"]: r for r in approaches.collect()}
    assert set(a) == {"in", "out"} and (a["in"]["dx"], a["in"]["dy"]) == (0.6, 0.8) and (a["in"]["ax"], a["in"]["by"]) == (100.0, 250.0) and a["in"]["red_delay"] == 5.0
    assert a["out"]["box"] is None and (a["out"]["dx"], a["out"]["dy"], a["out"]["red_early"]) == (0.0, -1.0, 0.0)
    assert set(zip(*[[r[c] for r in drawn.where("kind = 'crosswalk'").collect()] for c in ("video_id", "zone_id")], strict=True)) == {(7, 1)}


def lanes(spark, *rows):
    return spark.createDataFrame([(v, n, *map(float, line), *map(float, d), box, delay, early) for v, n, line, d, box, delay, early in rows], zones.APPROACHES)


def lamp(spark, *spans, video=0, approach="east", until=30.0):
    rows = [(video, approach, k / 2, next((s for lo, hi, s in spans if lo <= k / 2 < hi), 0)) for k in range(int(until * 2))]
    return spark.createDataFrame(rows, "video_id long, approach string, t double, state int")


def test_effective_red_is_shifted_by_approach(spark):
    a = lanes(spark, (0, "east", (0, 0, 0, 9), (1, 0), None, 2.0, 1.0), (0, "west", (0, 0, 0, 9), (-1, 0), None, 0.0, 0.0))
    states = lamp(spark, (5, 10, 1), (10, 20, 2), (25, 99, 1)).union(lamp(spark, (5, 10, 1), approach="west"))
    red = {n: [r["t"] for r in scene_rules.effective_red(states, a).where(f"red = 1 and approach = '{n}'").orderBy("t").collect()] for n in ("east", "west")}
    assert red["east"] == [7.0, 7.5, 8.0, 8.5] + [27 + k / 2 for k in range(6)] and red["west"] == [5 + k / 2 for k in range(10)]


BOX = [(500.0, 100.0), (700.0, 100.0), (700.0, 500.0), (500.0, 500.0)]


def test_red_lights_and_stop_lines_of_two_approaches_and_videos(spark):
    east, south = (500, 200, 500, 400), (700, 100, 500, 100)
    drive = lambda tid, start: (tid, "car", [(start, 300, 300), (start + 8, 900, 300)], CAR)
    rows = actors(drive(1, 2.0), drive(2, 16.0), (3, "car", [(3, 600, 10), (9, 600, 400)], CAR), (4, "car", [(10, 300, 350), (13, 540, 350), (20, 540, 350), (24, 900, 350)], CAR), (5, "car", [(4, 300, 250), (9, 470, 250), (16, 470, 250), (21, 800, 250)], CAR))
    video = lambda v: [(v, *r[1:4], r[4] + v * 10**9, *r[5:]) for r in rows]
    kin = kinematics.with_kinematics(spark.createDataFrame(video(0) + video(1) + video(2), TR), 3)
    early = [(500.0, 100.0), (530.0, 100.0), (530.0, 120.0), (500.0, 120.0)]
    a = lanes(spark, (0, "east", east, (1, 0), BOX, 0.0, 0.0), (1, "east", east, (1, 0), early, 0.0, 0.0), (1, "south", south, (0, 1), BOX, 0.0, 0.0), (2, "west", east, (-1, 0), BOX, 0.0, 0.0))
    states = lamp(spark, (0, 15, 1), (15, 99, 2))
    for v, n in ((1, "east"), (1, "south"), (2, "west")):
        states = states.union(lamp(spark, (0, 15, 1), (15, 99, 2), video=v, approach=n))
    red = scene_rules.effective_red(states, a).cache()
    got = {(r["video_id"], r["approach"], r["tid"]): (r["start"], r["end"]) for r in scene_rules.red_lights(kin, red, a, 0.8, 1.0, 2.0, 0.12).collect()}
    # car 2 comes at green, 4 and 5 wait; in video 1 the box east of the line is one that nobody enters; nobody drives west
    assert set(got) == {(0, "east", 1), (1, "south", 3)}
    assert got[0, "east", 1] == pytest.approx((4.6, 7.4), abs=0.2) and got[1, "south", 3] == pytest.approx((4.4, 9.0), abs=0.3)
    stops = {(r["video_id"], r["approach"], r["tid"]): (r["start"], r["end"]) for r in scene_rules.stop_lines(kin, red, a, 0.3, 0.35, 0.12).collect()}
    # car 4 stands past the line: in video 0 that is inside the box. The rule asks where a car stands, not which way it came
    assert set(stops) == {(1, "east", 4), (2, "west", 5)} and stops[1, "east", 4] == pytest.approx((13.1, 15.0), abs=0.4)
    found = stationary(kin.withColumn("on_road", F.lit(True)), 0.35, 0.12).withColumn("id", F.xxhash64("video_id", "tid"))
    waits = found.join(scene_rules.waiting_at_red(found, states, a), "id").select("video_id", "tid").collect()
    assert {tuple(r) for r in waits} == {(0, 5), (1, 5)}  # car 4 is before the line going west, but mostly at green


def test_jaywalkers_keep_off_the_kerb(spark):
    walk = lambda tid, y: (tid, "person", [(0, 100, y), (20, 500, y)], (12, 30))
    kin = kinematics.with_kinematics(spark.createDataFrame(actors(walk(1, 162.0), walk(2, 172.0), walk(3, 200.0)), TR), 3)
    road = spark.createDataFrame([(0, y, x) for y in range(10, 20) for x in range(40)], "video_id long, cy int, cx int")  # from 160 on
    drawn = zones.zone_table(spark, {0: {"crosswalk": [[(240.0, 190.0), (300.0, 190.0), (300.0, 260.0), (240.0, 260.0)]]}})
    got = {}
    for r in scene_rules.jaywalkers(kin, road, drawn, 16, 30, 40, 12, 5.0, 2.0).collect():
        got.setdefault(r["tid"], []).append((round(r["start"], 1), round(r["end"], 1)))
    assert set(got) == {2, 3} and len(got[2]) == 1 and sorted(got[3]) == [(0.0, pytest.approx(6.7, abs=0.2)), (pytest.approx(10.3, abs=0.2), 20.0)]


def test_yielding_is_judged_by_crossing(spark):
    car = lambda tid, x: (tid, "car", [(0, x, 0), (10, x, 400)], CAR)
    kin = kinematics.with_kinematics(spark.createDataFrame(actors(car(1, 130.0), car(2, 500.0), (3, "person", [(3, 60, 210), (8, 160, 210)], (12, 30)), (4, "person", [(0, 520, 210), (10, 520.5, 210)], (12, 30))), TR), 3)
    pieces = [[(50.0, 180.0), (110.0, 180.0), (110.0, 240.0), (50.0, 240.0)], [(113.0, 180.0), (180.0, 180.0), (180.0, 240.0), (113.0, 240.0)], [(450.0, 180.0), (560.0, 180.0), (560.0, 240.0), (450.0, 240.0)]]
    events = lambda kinds: scene_rules.failures_to_yield(kin, zones.zone_table(spark, {0: kinds}), 64.0, 2.5, 5.0, 0.35, 0.3).collect()
    (hit,) = events({"crosswalk": pieces})  # the walker is on the other piece of the first crossing; who stands by the second is no walker
    assert hit["tid"] == 1 and hit["start"] == pytest.approx(4.5, abs=0.2) and hit["end"] == pytest.approx(6.0, abs=0.2)
    assert [r["tid"] for r in events({"crosswalk": pieces[1:], "refuge": pieces[:1]})] == [1] and events({"refuge": pieces}) == []


# windows and sums that go with them


def test_trails_are_cut_at_jumps(spark):
    xs = [0.0, 10.0, 20.0, 100.0, 110.0, 120.0, 130.0]
    df = spark.createDataFrame([(0, 1, k / 2, k, x, 0.0, 1.0) for k, x in enumerate(xs)], "video_id long, tid long, t double, event_id long, gx double, gy double, speed double")
    got = [(r["since"], r["points"], r["path"]) for r in runs.trails(df, 1.0, 40.0).orderBy("t").collect()]
    assert got == [(0.0, 1, 0.0), (0.0, 2, 10.0), (0.0, 3, 20.0), (1.5, 1, 0.0), (1.5, 2, 10.0), (1.5, 3, 20.0), (2.0, 3, 20.0)]
    slow = df.withColumn("speed", F.greatest(F.lit(0.0), 2.0 - F.col("t")))
    assert [round(r["brake"], 3) for r in runs.braking_share(slow, 1.0, 0.35).orderBy("t").collect()] == [0.0, 0.25, 0.5, 0.667, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 2.5, 1.0], [float(k) for k in range(3000)], [math.sin(k) for k in range(2000)]])
def test_running_totals_need_no_single_task(spark, values):
    df = spark.createDataFrame([(v, k + 1, 1) for k, v in enumerate(values)], "x double, a long, b long")
    for down in (False, True):
        got = {r["x"]: (r["cum_a"], r["cum_b"]) for r in runs.running_totals(df, "x", ["a", "b"], descending=down, shares=16).collect()}
        a = b = 0
        want = {}
        for v, k in sorted(((v, k + 1) for k, v in enumerate(values)), reverse=down):
            a, b = a + k, b + 1
            want[v] = (a, b)
        assert got == want


def test_average_precision_over_chance(spark):
    g = random.Random(5)
    rows = [(round(g.random(), 2), int(g.random() < 0.3)) for _ in range(500)]
    by = sorted({s for s, _ in rows}, reverse=True)
    positives, seen, hits, ap = sum(p for _, p in rows), 0, 0, 0.0
    for s in by:
        own = [p for x, p in rows if x == s]
        seen, hits = seen + len(own), hits + sum(own)
        ap += sum(own) / positives * hits / seen
    got = average_precision(spark.createDataFrame(rows, "score double, positive int")).first()
    rate = positives / len(rows)
    assert got["ap"] == pytest.approx(ap) and got["rate"] == pytest.approx(rate) and got["ap_over_chance"] == pytest.approx(max(0.0, (ap - rate) / (1 - rate)))
    keyed = average_precision(spark.createDataFrame([("a", s, p) for s, p in rows] + [("b", 0.5, 1)], "k string, score double, positive int"), ["k"])
    assert {r["k"]: r["ap"] for r in keyed.collect()} == pytest.approx({"a": ap, "b": 1.0})


def test_the_box_of_a_stop_is_the_median_of_its_boxes(spark):
    xs = [0, 40, 80, 120, 120, 121, 122, 140, 122, 120]
    rows = [(0, k, float(k), 1, k, "car", float(x), 0.0, x + 40.0, 20.0) for k, x in enumerate(xs)]
    kin = kinematics.with_kinematics(spark.createDataFrame(rows, TR), 1).withColumn("on_road", F.lit(True)).withColumn("speed", F.when(F.col("t") < 3, 5.0).otherwise(0.0))
    (r,) = stationary(kin, 0.35, 0.12).collect()
    assert (r["start"], r["end"], r["x1"], r["x2"], r["y2"]) == (3.0, 9.0, 121.0, 161.0, 20.0)


def test_polygons_in_columns_and_in_code_agree(spark):
    points = [(x + 0.5 * (y % 2), float(y)) for x in range(0, 100, 7) for y in range(0, 100, 9)] + CONCAVE
    df = spark.createDataFrame(points, "x double, y double")
    as_column = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in CONCAVE])
    assert df.where(G.contains(as_column, F.col("x"), F.col("y")) != G.in_polygon(CONCAVE, F.col("x"), F.col("y"))).count() == 0

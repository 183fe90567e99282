import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lanescope.functions import geometry as G
from lanescope.operators import detect, evaluate, kinematics, pairs, rules, runs, scene, scene_rules, sequential, stats, temporal, tracking, view, zones
from lanescope.sources import tables
from lanescope.streaming.risk import RiskSettings, RiskState, replay, risk_stream

SEG = "video_id long, start double, end double, label string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_time_to_contact(spark):
    # 50 apart on a slant, closing at 5, touching at 10
    assert one(spark, G.time_to_contact(*lit(30, 40, -3, -4, 10))) == pytest.approx(8)
    assert one(spark, G.time_to_contact(*lit(30, 40, 4, -3, 10))) is None
    assert one(spark, G.time_to_contact(*lit(-3, 4, 1, 1, 6))) == 0


def test_polygons_and_lines(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert [one(spark, G.in_polygon(square, *lit(x, y))) for x, y in [(5, 5), (0, 5), (10, 10), (11, 5), (-0.1, 0)]] == [True, True, True, False, False]
    assert one(spark, G.polyline_side([(0, 0), (10, 0), (20, 0)], *lit(5, 3, 5))) == 1
    assert one(spark, G.polyline_side([(0, 0), (10, 0)], *lit(5, 9, 5))) == 0
    assert G.touching_groups([square, [(30.0, 0.0), (40.0, 0.0), (40.0, 10.0), (30.0, 10.0)], [(11.0, 0.0), (20.0, 0.0), (20.0, 10.0), (11.0, 10.0)]], 1.0) == [0, 1, 0]


def test_finalize_merges_clips_and_drops(spark):
    rows = [(2.25, 4.5, "wrong_way"), (5.25, 6.0, "wrong_way"), (7.5, 8.0, "wrong_way"), (-3.0, 1.125, "red_light"), (30.0, 30.25, "red_light"), (88.0, 95.0, "red_light"), (91.0, 99.0, "wrong_way")]
    e = spark.createDataFrame([(7, *r) for r in rows], SEG)
    got = sorted((r["label"], r["start"], r["end"]) for r in runs.finalize(e, 90.0).collect())
    assert got == [("red_light", 0.0, 1.125), ("red_light", 88.0, 90.0), ("wrong_way", 2.25, 6.0), ("wrong_way", 7.5, 8.0)]
    shifted = runs.finalize(e.where("label = 'wrong_way'"), 90.0, shift={"wrong_way": (0.5, 1.0)}).orderBy("start").first()
    assert (shifted["start"], shifted["end"]) == (2.75, 9.0)


def test_merging_is_idempotent_and_disjoint(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), s := rng.uniform(0, 100), s + rng.uniform(0, 3), "x") for _ in range(300)]
    once = runs.merge_intervals(spark.createDataFrame(rows, SEG), 0.5, ["video_id"]).select("video_id", "start", "end")
    twice = runs.merge_intervals(once, 0.5, ["video_id"]).select("video_id", "start", "end")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_runs_split_on_false_rows_only(spark):
    df = spark.createDataFrame([(0, 0, float(t), i, m) for i, (t, m) in enumerate([(0, True), (1, True), (50, True), (51, False), (52, True)])], "video_id long, tid long, t double, event_id long, m boolean")
    assert sorted((r["start"], r["end"], r["n"]) for r in runs.runs(df, F.col("m")).collect()) == [(0.0, 50.0, 3), (52.0, 52.0, 1)]


def test_as_of_both_ways(spark):
    left = spark.createDataFrame([(0, 1.0, "a"), (0, 5.0, "b"), (0, 9.0, "c"), (1, 1.0, "d")], "k long, t double, id string")
    right = spark.createDataFrame([(0, 2.0, 20), (0, 5.0, 50)], "k long, t double, v int")
    got = lambda **o: {r["id"]: r["v"] for r in temporal.as_of(left, right, ["v"], ["k"], **o).collect()}
    assert got() == {"a": None, "b": 50, "c": 50, "d": None}
    assert got(forward=True, clamp=True) == {"a": 20, "b": 50, "c": 50, "d": None}
    assert got(tolerance=3.0)["c"] is None


def test_gradient_of_a_parabola(spark):
    ts = [0.0, 0.5, 2.0, 2.5, 4.0]
    df = spark.createDataFrame([(0, 0, t, i, t * t) for i, t in enumerate(ts)], "video_id long, tid long, t double, event_id long, x double")
    g = [r["g"] for r in df.select("t", kinematics.gradient("x").alias("g")).orderBy("t").collect()]
    assert g[1:4] == pytest.approx([2 * t for t in ts[1:4]])
    assert g[0] == pytest.approx(0.5) and g[4] == pytest.approx(6.5)


def test_road_closing_ignores_cells_off_the_grid(spark):
    flow = spark.createDataFrame([(0, 0, x, 9, 1.0, 0.0) for x in (0, 1, 4)], "video_id long, cy int, cx int, n long, sx double, sy double")
    assert {(r["cy"], r["cx"]) for r in scene.road_cells(flow, 5, 6, 8).collect()} == {(0, x) for x in range(5)}


def test_greedy_match_and_counts(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 10.0, "a"), (2, 0, 8.0, 20.0, "a"), (3, 0, 0.0, 5.0, "b")], "id long, video_id long, start double, end double, label string")
    p = spark.createDataFrame([(7, 0, 0.0, 11.0, "a"), (8, 0, 1.0, 10.0, "a"), (9, 5, 0.0, 1.0, "c")], "id long, video_id long, start double, end double, label string")
    m = evaluate.greedy_match(evaluate.candidates(t, p, 0.05))
    assert {(r["truth_id"], r["pred_id"]) for r in m.collect()} == {(1, 7), (2, 8)}
    c = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.counts(t, p, m).collect()}
    assert c == {"a": (2, 0, 0), "b": (0, 0, 1), "c": (0, 0, 0)}


def test_average_precision_counts_ties_together(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, positive int")
    assert evaluate.average_precision(df).first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert evaluate.average_precision(df.withColumn("positive", F.lit(0))).first()["ap"] == 0


def test_alarms_match_once_and_in_order(spark):
    acc = spark.createDataFrame([(0, 10.0), (0, 12.0), (0, 40.0)], "video_id long, start double")
    al = spark.createDataFrame([(0, 5.0), (0, 9.0), (0, 20.0)], "video_id long, start double")
    assert {r["start"]: r["alarm"] for r in evaluate.match_alarms(acc, al).collect()} == {10.0: 5.0, 12.0: 9.0, 40.0: None}


def test_stitching_of_many_runs_keeps_groups_apart(spark):
    rng = random.Random(4)
    rows = [(0, i, s := round(rng.uniform(0, 200), 1), round(s + rng.uniform(0.5, 8), 1), x := float(rng.choice([0, 3, 40])), 0.0, x + 10, 10.0) for i in range(120)]
    kind = "video_id long, tid long, start double, end double, x1 double, y1 double, x2 double, y2 double"
    got = sequential.stitch_runs(spark.createDataFrame(rows, kind)).collect()
    assert sum(r["parts"] for r in got) == len(rows) and {r["tid"] for r in got} <= {r[1] for r in rows}
    by_tid = {r[1]: r for r in rows}
    for r in got:
        first = by_tid[r["tid"]]
        assert (r["start"], r["x1"]) == (first[2], first[4]) and (r["end"] == first[3] if r["parts"] == 1 else r["end"] >= first[3])
    # boxes at 0 and 3 overlap by more than half, those at 40 with neither: what begins soon after a group's end joined it
    for a in got:
        for b in got:
            alike = (a["x1"] == 40) == (b["x1"] == 40)
            assert not (alike and 0 <= b["start"] - a["end"] <= 3 and a["tid"] != b["tid"] and a["start"] < b["start"])


def test_stitching_takes_the_first_group_that_fits(spark):
    rows = [(0, 4, 0.0, 5.0, 0.0, 0.0, 10.0, 10.0), (0, 5, 7.0, 9.0, 1.0, 0.0, 11.0, 10.0), (0, 6, 9.5, 12.0, 30.0, 0.0, 40.0, 10.0), (0, 7, 20.0, 22.0, 0.0, 0.0, 10.0, 10.0)]
    got = sequential.stitch_runs(spark.createDataFrame(rows, "video_id long, tid long, start double, end double, x1 double, y1 double, x2 double, y2 double"))
    assert sorted((r["tid"], r["start"], r["end"], r["parts"]) for r in got.collect()) == [(4, 0.0, 9.0, 2), (6, 9.5, 12.0, 1), (7, 20.0, 22.0, 1)]


def groups_of(spark, current, others):
    rows = [(0, "x", float(s), float(e), True) for s, e in current] + [(0, "x", float(s), float(e), False) for s, e in others]
    df = spark.createDataFrame(rows, "video_id long, label string, start double, end double, current boolean")
    return sorted((r["start"], r["end"], r["hits"], r["current"]) for r in sequential.candidate_groups(df).collect())


def test_candidate_groups_by_hand(spark):
    assert groups_of(spark, [(0, 10)], [(9, 20), (10, 12)]) == [(0, 10, 2, True), (10, 12, 1, False)]  # touching is no overlap
    assert groups_of(spark, [], [(0, 10), (5, 15), (9, 19)]) == [(0, 15, 2, False), (9, 19, 1, False)]  # the first member counts, not the group
    assert groups_of(spark, [], [(0, 10), (8, 18), (1, 11)]) == [(0, 11, 2, False), (8, 18, 1, False)]
    assert groups_of(spark, [(0, 5), (4, 9)], [(4.5, 4.8)]) == [(0, 5, 2, True), (4, 9, 2, True)]  # one segment counts for each that it overlaps


def test_candidate_groups_keep_every_segment(spark):
    rng = random.Random(11)
    spans = [(s := round(rng.uniform(0, 300), 2), round(s + rng.uniform(0.5, 9), 2), rng.random() < 0.1) for _ in range(150)]
    now, rest = [r[:2] for r in spans if r[2]], [r[:2] for r in spans if not r[2]]
    got = groups_of(spark, now, rest)
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    assert sorted((s, e, 1 + sum(meets((s, e), o) for o in rest), True) for s, e in now) == [g for g in got if g[3]]
    free, made = [o for o in rest if not any(meets(o, c) for c in now)], [g for g in got if not g[3]]
    assert sum(g[2] for g in made) == len(free) and all(any(g[0] <= o[0] and o[1] <= g[1] for g in made) for o in free)
    assert {g[0] for g in made} | {g[1] for g in made} <= {x for o in free for x in o}
    assert groups_of(spark, now, rest[::-1]) == got  # in whatever order rows come


def test_report_counts_by_label_together_and_without_labels(spark):
    t = [(1, 0, 0.0, 10.0, "a"), (2, 0, 20.0, 30.0, "a"), (3, 0, 40.0, 50.0, "b"), (4, 1, 0.0, 4.0, "b")]
    p = [(1, 0, 1.0, 10.0, "a"), (2, 0, 2.0, 11.0, "a"), (3, 0, 20.0, 26.0, "a"), (4, 0, 40.0, 50.0, "a"), (5, 9, 0.0, 1.0, "b")]
    kind = "id long, video_id long, start double, end double, label string"
    rows = evaluate.report(spark.createDataFrame(t, kind), spark.createDataFrame(p, kind))
    got = {(r["scope"], r["label"], r["threshold"]): (r["tp"], r["fp"], r["fn"]) for r in rows.collect()}
    assert got["label", "a", 0.5] == (2, 2, 0) and got["label", "a", 0.7] == (1, 3, 1) and got["label", "b", 0.3] == (0, 0, 2)
    assert got["micro", None, 0.5] == (2, 2, 2) and got["agnostic", None, 0.5] == (3, 1, 1) and got["agnostic", None, 0.7] == (2, 2, 2)
    f = [2 * 2 / (4 + 2), 2 * 2 / (4 + 2), 2 * 1 / (2 + 4)]
    assert evaluate.segment_score(rows).first()[0] == pytest.approx(sum(f) / 3 / 2) and evaluate.segment_score(rows, "a").first()[0] == pytest.approx(sum(f) / 3)
    alarms = spark.createDataFrame([(0.5, 1.0)], "score double, recall double")
    assert evaluate.model_score(evaluate.segment_score(rows, "a"), alarms).first()[0] == pytest.approx(0.7 * sum(f) / 3 + 0.15)
    assert evaluate.model_score(evaluate.segment_score(rows, "a"), alarms.withColumn("score", F.lit(None).cast("double"))).first()[0] == pytest.approx(sum(f) / 3)


def test_illegal_turns_by_zone(spark):
    kind = "video_id long, tid long, start double, end double, total double, mid struct<gx:double,gy:double>, first struct<gx:double,gy:double>, last struct<gx:double,gy:double>"
    rows = [(0, 1, 1.0, 4.0, 170.0, (5.0, 5.0), (0.0, 0.0), (9.0, 9.0)), (0, 2, 1.0, 4.0, 170.0, (50.0, 5.0), (25.0, 25.0), (75.0, 75.0)), (0, 3, 2.0, 3.0, 80.0, (5.0, 5.0), (25.0, 25.0), (75.0, 75.0)), (0, 4, 2.0, 3.0, 80.0, (5.0, 5.0), (75.0, 75.0), (25.0, 25.0)), (0, 5, 2.0, 3.0, 20.0, (5.0, 5.0), (25.0, 25.0), (75.0, 75.0))]
    square = lambda a: [(a, a), (a + 10, a), (a + 10, a + 10), (a, a + 10)]
    got = detect.illegal_turns(spark.createDataFrame(rows, kind), [square(0.0)], [(square(20.0), square(70.0))]).collect()
    assert sorted((r["start"], r["label"]) for r in got) == [(1.0, "illegal_turn"), (1.0, "illegal_u_turn"), (2.0, "illegal_turn")]


def test_detector_unites_rules_and_leaves_out_broken_ones(spark):
    d = detect.Detector()
    spans = spark.createDataFrame([(0, 1.0, 3.0), (0, 3.5, 6.0), (1, 5.0, 99.0)], "video_id long, start double, end double")

    def bad_batch(batches):
        for df in batches:
            raise ArithmeticError("in a task")
        yield df

    d.rule("stop")(lambda c: c)
    d.rule("no_such_column")(lambda c: c.select("video_id", "nothing"))
    d.rule("in_a_task")(lambda c: c.mapInPandas(bad_batch, c.schema))
    d.rule("in_sql")(lambda c: c.withColumn("start", F.raise_error(F.lit("stopped")).cast("double")))
    d.rule("in_python")(lambda c: c["nothing"].missing["x"] if False else {}["x"])
    d.rule("own")(lambda c: c.limit(1).withColumn("label", F.lit("other")))
    events, status = d.outcome(spans, 60.0)
    got = sorted((r["video_id"], r["label"], r["start"], r["end"]) for r in events.collect())
    assert got == [(0, "other", 1.0, 3.0), (0, "stop", 1.0, 6.0), (1, "stop", 5.0, 60.0)]
    told = {r["rule"]: (r["ok"], r["error"]) for r in status.collect()}
    assert {k for k, (ok, _) in told.items() if ok} == {"stop", "own"} and all(e for ok, e in told.values() if not ok)
    assert {r["label"] for r in d.events(spans, 60.0, enabled=["other"]).collect()} == {"other"}
    with pytest.raises(ValueError):
        only = detect.Detector()
        only.rule("bad")(lambda c: c.select("nothing"))
        only.events(spans, 60.0)


def test_views_move_zones_and_grids(spark):
    turn = (0.0, -1.0, 10.0, 1.0, 0.0, 0.0)  # a quarter turn and a shift
    assert view.moved_box((0.0, 0.0, 2.0, 1.0), turn) == (9.0, 0.0, 10.0, 2.0) and view.moved_direction((1.0, 0.0), turn) == (0.0, 1.0)
    assert view.moved_scene({"z": [[(1.0, 2.0)]]}, turn) == {"z": [[(8.0, 1.0)]]} and view.moved_scene({"z": []}, None) == {"z": []}
    assert view.grid_size(1920, 60) == 32 and view.grid_size(100, 60) == 8
    assert view.rescaled_grid(32, (1920, 1080), (34, 60), (3840, 2160)) == 64 and view.rescaled_grid(32, (1920, 1080), (34, 60), (1080, 1920)) is None
    assert view.rescaled_grid(32, (1920, 1080), (33, 60), (3840, 2160)) is None
    cells = spark.createDataFrame([(0, 1, 2, 5), (0, 0, 0, 7)], "video_id long, cy int, cx int, n long")
    assert {(r["cy"], r["cx"], r["n"]) for r in view.moved_grid(cells, (1.0, 0.0, 1.0, 0.0, 1.0, 2.0), 4, 4).collect()} == {(3, 3, 5), (2, 1, 7)}


def test_tracker_keeps_two_crossing_boxes_apart(spark):
    rows = []
    for f in range(20):
        for k, (x, y) in enumerate([(f * 4.0, 0.0), (80 - f * 4.0, 60.0)]):
            rows.append((0, f, f / 10, "car", 0.9 if f % 5 else 0.3 if f else 0.9, x, y, x + 20, y + 20, k))
    df = spark.createDataFrame(rows, "video_id long, frame long, t double, cls string, conf double, x1 double, y1 double, x2 double, y2 double, truth long")
    got = tracking.track_boxes(df, rate=10.0).join(df.select("frame", "x1", "y1", "truth"), ["frame", "x1", "y1"])
    assert got.groupBy("truth").agg(F.countDistinct("tid").alias("n"), F.count("*").alias("rows")).select("n", "rows").distinct().collect() == [(1, 20)]


def test_grid_search_needs_a_margin(spark):
    grid = sequential.settings(spark, a=[1, 2], b=[5, 6, 7])
    assert grid.count() == 6 and grid.where("setting = 4").first()["b"] == 6.0
    assert sequential.best_setting(spark.createDataFrame([(0, 0.5), (1, 0.51), (2, 0.6), (3, 0.61)], "setting int, score double")) == (2, 0.6)


RATE = 10


def actors(*paths):
    """Rows at RATE a second of boxes that go through way points: (tid, cls, [(t, x, y), ...], (width, height))."""
    rows = []
    for tid, cls, way, (w, h) in paths:
        for (ta, xa, ya), (tb, xb, yb) in zip(way, way[1:], strict=False):
            for i in range(round(ta * RATE), round(tb * RATE) + (tb == way[-1][0])):
                t = i / RATE
                u = (t - ta) / (tb - ta)
                x, y = xa + u * (xb - xa), ya + u * (yb - ya)
                rows.append((0, i, t, tid, tid * 100_000 + i, cls, x - w / 2, y - h, x + w / 2, y))
    return rows


TR = "video_id long, frame long, t double, tid long, event_id long, cls string, x1 double, y1 double, x2 double, y2 double"
CAR, WALKER = (36, 24), (12, 30)
EAST, WEST = (200, 240, 280), (330, 370, 410)


def traffic():
    """Three lanes a way in a frame of 960 by 540: every 1.5 s a car that takes 9.6 s to pass, the lanes one after the other."""
    out = []
    for lane, y in enumerate(EAST + WEST):
        a, b = (0, 960) if y in EAST else (960, 0)
        out += [(500 + lane * 50 + k, "car", [(t := 1.5 * k + lane / 4, a, y), (t + 9.6, b, y)], CAR) for k in range(24)]
    return out


@pytest.fixture(scope="module")
def scene_of(spark):
    def build(*extra):
        kin = kinematics.with_kinematics(spark.createDataFrame(actors(*traffic(), *extra), TR), 7)
        flow = scene.flow_field(kin, 30.0, 0.35)
        road = scene.road_cells(flow, 5, 18, 32)
        return scene.with_road(kin, road, 30.0, 18, 32).drop("cx", "cy").cache(), flow

    return build


def test_stop_wrong_way_and_walker_in_a_drawn_scene(scene_of):
    kin, flow = scene_of(
        (1, "car", [(8, 0, 240), (12, 400, 240), (27, 400, 240), (32, 900, 240)], CAR),
        (2, "car", [(20, 900, 200), (29, 60, 200)], CAR),
        (3, "person", [(6, 700, 150), (22, 700, 470)], WALKER),
    )
    (stop,) = rules.stationary(kin, 0.35, 0.12).where(F.col("end") - F.col("start") >= 10).collect()
    assert stop["tid"] == 1 and stop["start"] == pytest.approx(12, abs=1) and stop["end"] == pytest.approx(27, abs=1)
    wrong = rules.wrong_way(scene.with_lane(kin, flow, 30.0), 0.35, 0.75, -0.5, 0.75, 1.5, []).collect()
    assert {r["tid"] for r in wrong} == {2} and sum(r["end"] - r["start"] for r in wrong) > 6
    (walk,) = rules.jaywalking(kin, [], [], 0.0, 2.0).collect()  # the road is from 180 to 420, at 20 a second
    assert walk["tid"] == 3 and walk["start"] == pytest.approx(7.5, abs=0.3) and walk["end"] == pytest.approx(19.5, abs=0.3)
    runs_ = sequential.stitch_runs(rules.stationary(kin, 0.35, 0.12)).withColumn("id", F.col("tid"))
    assert detect.stopped_in_queue(runs_, kin, 6.0, 0.35, 0.6).count() == 0  # traffic flows past the stopped car
    red = kin.select("video_id", F.lit("main").alias("approach"), "t", F.lit(1).alias("state")).distinct()
    lane = lambda *way: spark_of(kin).createDataFrame([(0, "main", 500.0, 150.0, 500.0, 450.0, *way, None, 0.0, 0.0), (5, "main", 0.0, 0.0, 0.0, 1.0, *way, None, 0.0, 0.0)], zones.APPROACHES)
    assert [r["id"] for r in scene_rules.waiting_at_red(runs_, red, lane(1.0, 0.0)).collect()] == [1]
    assert scene_rules.waiting_at_red(runs_, red, lane(-1.0, 0.0)).count() == 0
    assert detect.stopped_vehicles(kin, red, lane(1.0, 0.0), 0.35, 0.12, 10.0, 3.0, 0.5, 6.0, 0.6).count() == 0
    assert detect.stopped_vehicles(kin, None, None, 0.35, 0.12, 10.0, 3.0, 0.5, 6.0, 0.6).count() == 1


def spark_of(df):
    return df.sparkSession


def test_plain_traffic_has_no_events(scene_of):
    kin, flow = scene_of()
    assert rules.stationary(kin, 0.35, 0.12).where(F.col("end") - F.col("start") >= 10).count() == 0
    assert rules.wrong_way(scene.with_lane(kin, flow, 30.0), 0.35, 0.75, -0.5, 0.75, 1.5, []).count() == 0
    assert rules.jaywalking(kin, [], [], 0.0, 2.0).count() == 0
    assert rules.accidents(kin, 0.05, 0.8, 0.5, 0.35, 0.12).count() == 0


def test_queue_is_told_from_its_neighbours(spark):
    rows = [(0, k, i / RATE, k, k * 1000 + i, "car", 40.0 * k, 0.0, 40.0 * k + 36, 24.0) for k in range(4) for i in range(120)]
    kin = kinematics.with_kinematics(spark.createDataFrame(rows, TR), 7)
    found = spark.createDataFrame([(0, 1, 0, 1.0, 11.0, 0.0, 0.0, 36.0, 24.0)], "video_id long, id long, tid long, start double, end double, x1 double, y1 double, x2 double, y2 double")
    assert [r["id"] for r in detect.stopped_in_queue(found, kin, 3.0, 0.35, 0.6).collect()] == [1]
    assert detect.stopped_in_queue(found, kin, 0.5, 0.35, 0.6).count() == 0  # nobody near


def close_call(swerve: float = 0.0):
    """A car that brakes from 90 a second to a stop short of one that stands still across its way."""
    way = [(0, 0, 300), (4, 360, 300)] + [(4 + k / 4, 360 + 90 * (k / 4) * (1 - k / 8), 300 + swerve * k) for k in range(1, 5)] + [(9, 405, 300 + 4 * swerve)]
    return [(1, "car", way, CAR), (2, "car", [(0, 455, 302), (9, 455, 302)], CAR)]


def test_near_miss_begins_with_braking_and_not_in_a_turn(spark):
    none = spark.createDataFrame([], "video_id long, a_tid long, b_tid long, start double")

    def found(paths, crashes=none):
        kin = kinematics.with_kinematics(spark.createDataFrame(actors(*paths), TR), 3).withColumn("on_road", F.lit(True))
        return rules.near_misses(kin, crashes, 1.0, 2.0, 0.25, 1.0, 0.5, 0.35).collect()

    (miss,) = found(close_call())
    assert (miss["a_tid"], miss["b_tid"]) == (1, 2) and miss["start"] == pytest.approx(4, abs=0.4) and miss["end"] > 4
    assert found(close_call(swerve=25.0)) == []
    crash = spark.createDataFrame([(0, 1, 2, 4.0)], none.schema)
    assert found(close_call(), crash) == []


def test_a_person_who_stops_is_no_impact(spark):
    walker = (1, "person", [(0, 300, 300), (3, 408, 300), (8, 408, 300)], (20, 30))
    parked = (2, "car", [(0, 425, 300), (8, 425, 300)], CAR)
    rows = [(0, "car", [(0, 0, 500), (8, 900, 500)], CAR), walker, parked]
    kin = kinematics.with_kinematics(spark.createDataFrame(actors(*rows), TR), 3).withColumn("on_road", F.lit(True))
    assert rules.contacts(kin, 0.02).count() == 1 and rules.accidents(kin, 0.02, 0.8, 0.5, 0.35, 0.12).count() == 0


def on_collision_course():
    """Two cars that meet on a slanted road after 8 s, and one far off."""
    return [(1, "car", [(0, 100, 100), (8, 390, 332)], CAR), (2, "car", [(0, 700, 580), (8, 410, 348)], CAR), (3, "car", [(0, 900, 40), (8, 300, 40)], CAR)]


def test_risk_rises_on_a_collision_course_and_stays_low_in_calm(spark):
    course = spark.createDataFrame(actors(*on_collision_course()), TR)
    hot = {r["t"]: r["score"] for r in replay(course).collect()}
    calm = replay(spark.createDataFrame(actors(*[(k, "car", [(0, 40 * k, 110 * k), (9, 500 + 60 * k, 110 * k)], CAR) for k in (1, 2, 3)]), TR)).agg(F.max("score")).first()[0]
    assert max(hot.values()) > 0.5 and max(s for t, s in hot.items() if t < 4) < 0.1 and calm < 0.1
    late = {r["t"]: r["score"] for r in replay(course, RiskSettings(lag_samples=1)).collect()}
    ts = sorted(hot)
    assert [late[b] for b in ts[1:]] == pytest.approx([hot[a] for a in ts[:-1]])


@pytest.mark.parametrize("angle", [0, 19, 45, 90, 170])
def test_a_standing_car_ahead_is_danger_whatever_its_heading(angle):
    car = lambda x, vx, vy: {"p": [x, 6.0], "v": [vx, vy], "size": 30.0, "t": 1.0, "cls": "car", "speeds": [[1.0, math.hypot(vx, vy) / 30.0]]}
    state = RiskState(RiskSettings())
    coming = car(0.0, 110.0, 0.0)
    standing = car(100.0, 2 * math.cos(math.radians(angle)), 2 * math.sin(math.radians(angle)))
    standing["p"][1] = 8.0
    got = state._pair(coming, standing)
    assert got is not None and 0.5 < got < 1.5
    beside = car(100.0, 20.0, 0.0)
    beside["p"][1] = 40.0
    assert state._pair(coming, beside) is None  # a mover in the next lane


def test_stream_equals_replay(spark, tmp_path):
    df = spark.createDataFrame(actors(*on_collision_course()), TR)
    for k, (lo, hi) in enumerate([(0, 3), (3, 7), (7, 99)]):
        df.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = risk_stream(source).writeStream.format("memory").queryName("risk_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["t"]: r["score"] for r in spark.table("risk_out").collect()}
    want = {r["t"]: r["score"] for r in replay(df).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t]) for t in want)


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"a.mp4": {"duration": 60, "fps": 25, "events": [[5, 8, "red_light"], [20, 26, "accident"]]}}))
    videos, events = tables.read_truth(spark, str(tmp_path / "gt.json"))
    assert videos.first()["duration"] == 60 and events.count() == 2
    risk = spark.createDataFrame([("a.mp4", 0.0, 0.2), ("a.mp4", 1.0, 1.4), ("a.mp4", 2.0, None)], "video_id string, t double, score double")
    doc = {r["video_id"]: json.loads(r["json"]) for r in tables.predictions_document(events, risk).collect()}
    (tmp_path / "pred.json").write_text(json.dumps({"team": "x", "videos": doc}))
    e, c = tables.read_predictions(spark, str(tmp_path / "pred.json"))
    assert sorted(e.collect()) == sorted(events.collect()) and [r["score"] for r in c.orderBy("seq").collect()] == [0.2, 1.0, 0.0]
    path = tables.write_tracks(spark.createDataFrame([(1, 0, 0.0, 1, "car", 0.9, 0.0, 0.0, 1.0, 1.0)], tables.TRACKS), str(tmp_path), {"b": 1, "a": 2})
    assert tables.read_tracks(spark, path).count() == 1 and tables.cache_key({"a": 2, "b": 1}) in path
    assert tables.read_settings('{"a": {"b": 1, "c": 2}}', '{"a": {"c": 3}}') == {"a": {"b": 1, "c": 3}}


def test_votes(spark):
    v = spark.createDataFrame([("c", "p", "real", "1", 0, 1.0), ("c", "p", "not_real", "2", 1, 2.0), ("c", "q", "not_real", "1", 2, 3.0), ("d", "p", "unsure", "1", 3, 1.0)], "cid string, person string, verdict string, at string, seq int, start double")
    v = v.withColumns({"end": F.col("start"), "proposed_start": F.lit(7.0), "proposed_end": F.lit(8.0)})
    assert {r["cid"]: (r["verdict"], r["start"]) for r in stats.consensus(stats.latest_votes(v)).collect()} == {"c": ("not_real", 7.0), "d": ("unsure", 7.0)}
    assert pairs.VEHICLES[0] == "car"


def test_catalogue_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60

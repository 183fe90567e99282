"""Operators whose work has to grow with their rows: results against plain versions, and plans without pairs of a bin."""

import math
import random
import statistics

from pyspark.sql import functions as F

from lanescope.operators import detect as D
from lanescope.operators import evaluate as V
from lanescope.operators import pairs as P
from lanescope.operators import review as W
from lanescope.operators import sequential as Q
from lanescope.operators import temporal as T
from lanescope.streaming import risk


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frame_labels_are_running_maxima(spark):
    g = random.Random(4)
    spans = lambda n: [(g.randrange(2), s := g.randrange(0, 60) / 2, s + g.randrange(0, 30) / 2) for _ in range(n)]
    acc, near = spans(6), spans(5)
    points = [(i, g.choice([0, 1, 2]), g.randrange(0, 100) / 2) for i in range(400)] + [(1000, None, 3.0), (1001, 0, None)]
    one = lambda s: spark.createDataFrame(s, "video_id long, start double, end double")
    got = V.frame_labels(spark.createDataFrame(points, "event_id long, video_id long, t double"), one(acc), one(near))

    def label(v, t):
        if v is None or t is None:
            return 0
        of = lambda s, f: any(k == v and f(max(a, 0), b) for k, a, b in s)
        if of(acc, lambda a, b: a <= t <= b):
            return None
        if of(acc, lambda a, b: max(a - 5, 0) <= t < a):
            return 1
        return None if of(near, lambda a, b: max(a - 5, 0) <= t <= b) else 0

    assert {r["event_id"]: r["label"] for r in got.collect()} == {i: label(v, t) for i, v, t in points}
    assert "Join" not in plan_of(got)


def test_overlap_counts_by_order(spark):
    g = random.Random(5)
    spans = lambda n: [(i, g.randrange(2), s := g.randrange(0, 60) / 2, s + g.choice([0, 0, 1, 5, 30, 60]) / 2) for i in range(n)]
    now, other = spans(150), [*spans(150), (900, 0, None, 4.0), (901, 0, 4.0, None)]
    one = lambda s: spark.createDataFrame(s, "id long, video_id long, start double, end double")
    out = W.overlap_counts(one([*now, (902, None, 1.0, 2.0)]), one(other), ["video_id"])
    want = {i: sum(w == v and None not in (a, b) and s < b and a < e for _, w, a, b in other) for i, v, s, e in now} | {902: 0}
    assert {r["id"]: r["hits"] for r in out.collect()} == want
    assert "start_b" not in plan_of(out)  # no pairs of the intervals themselves


def test_alarm_score_looks_spans_up_without_pairs(spark):
    curve = spark.createDataFrame([(i, i % 2, i / 4, (i % 40) / 40) for i in range(800)], "event_id long, video_id long, t double, score double")
    spans = spark.createDataFrame([(v, float(s), s + 3.0) for v in (0, 1) for s in range(8, 190, 9)], "video_id long, start double, end double")
    labelled = V.frame_labels(curve, spans, spans.limit(0)).where("label is not null").select("score", F.col("label").alias("positive"))
    assert "Join" not in plan_of(labelled)
    plain = lambda v, t: None if any(s <= t <= s + 3 for s in range(8, 190, 9)) else int(any(s - 5 <= t < s for s in range(8, 190, 9)))
    want = [(r["score"], plain(r["video_id"], r["t"])) for r in curve.collect()]
    assert sorted(map(tuple, labelled.collect())) == sorted(x for x in want if x[1] is not None)


def test_risk_replay_holds_a_batch_of_a_video_at_most(spark):
    g = random.Random(6)
    rows = [(v, t / 10, k, "car", x := 500 + (40 - t) * (k - 1) * 12.0 + g.random(), 300.0, x + 60, 330.0) for v in range(3) for t in range(60) for k in range(3) if (t + v) % 7]
    tracks = spark.createDataFrame(rows, "video_id long, t double, tid long, cls string, x1 double, y1 double, x2 double, y2 double")
    whole = tracks.withColumn("on_road", F.lit(True)).toPandas()
    want = [tuple(r) for v, df in whole.groupby("video_id") for r in risk.scores(v, df, risk.RiskState(risk.RiskSettings())).itertuples(index=False)]
    assert max(s for _, _, s in want) > 0.05
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 5, 1000):  # samples and videos that end within, at and beyond a batch
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            out = risk.replay(tracks)
            assert sorted(map(tuple, out.collect())) == want, size
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert "FlatMapGroupsInPandas" not in plan_of(out)


def test_risk_on_known_road_is_replayed_by_batches_too(spark):
    tracks = spark.createDataFrame([(0, t / 10, k, "car", 10.0 * t, 20.0, 10.0 * t + 30, 40.0) for t in range(30) for k in (1, 2)], "video_id long, t double, tid long, cls string, x1 double, y1 double, x2 double, y2 double")
    road = spark.createDataFrame([(0, 2, x) for x in range(10)], "video_id long, cy int, cx int")
    out = risk.replay(risk.on_known_road(tracks, road, 16.0, 9, 40))
    assert out.count() == 30 and "FlatMapGroupsInPandas" not in plan_of(out)


def test_found_is_what_candidates_have(spark):
    g = random.Random(7)
    spans = lambda n: [(i, g.randrange(2), g.choice("ab"), s := g.random() * 300, s + g.choice([0, 0.01, 1, 1.1, 4, 30]) * (1 + g.random() / 5)) for i in range(n)]
    one = lambda s: spark.createDataFrame(s, "id long, video_id long, label string, start double, end double")
    truth = one(spans(1500))
    copies = [(i + 10_000 * k, *r) for i, *r in spans(700) for k in range(3)]  # each of them three times
    pred = one(copies)
    for least in (0.05, 0.3, 0.9, 1.0):
        want = {tuple(r) for r in V.candidates(truth, pred, least).select("video_id", "label", "truth_id").collect()}
        got = [tuple(r) for r in V.found(truth, pred, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want, least
    same = V.found(truth, truth, 1.0)
    assert same.count() == truth.where("start < end").count()


def test_report_matches_once_for_all_thresholds(spark, monkeypatch):
    g = random.Random(9)
    spans = lambda n: spark.createDataFrame([(i, g.randrange(2), g.choice("ab"), s := float(g.randrange(60)), s + g.randrange(1, 8)) for i in range(n)], "id long, video_id long, label string, start double, end double")
    truth, pred = spans(60), spans(80)
    out = V.report(truth, pred)
    got = {(r["label"], r["threshold"]): r["tp"] for r in out.where("scope = 'label'").collect()}
    for least in (0.3, 0.5, 0.7):  # each threshold matched by itself
        own = V.greedy_match(V.candidates(truth, pred, least)).groupBy("label").count().collect()
        assert {r["label"]: r["count"] for r in own} == {k: n for (k, t), n in got.items() if t == least and n}
    assert len({v for v in got.values()}) > 2
    seen, match = [], V.greedy_match
    monkeypatch.setattr(V, "greedy_match", lambda pairs, keys: seen.append(pairs.columns) or match(pairs, keys))
    V.report(truth, pred)
    assert len(seen) == 2 and not any("threshold" in c for c in seen)  # by label and together; pairs aren't multiplied by thresholds


def test_smoothed_takes_ties_in_order_and_rows_in_batches(spark):
    g = random.Random(11)
    rows = [(v, g.randrange(40) / 4, g.random(), i) for v in (0, 1, None) for i in range(90)]
    want = []
    for v in (0, 1, None):
        score = last = None
        for _, t, raw, _ in sorted((r for r in rows if r[0] == v), key=lambda r: (r[1], r[3])):
            score = raw if last is None else score + (1 - math.exp(-(t - last) / 0.6)) * (raw - score)
            last = t
            want.append((v is None, v or 0, t, raw, round(score, 9)))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            g.shuffle(rows)
            out = Q.smoothed(spark.createDataFrame(rows, "video_id long, t double, raw double, seq long").repartition(5))
            assert sorted((r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 9)) for r in out.collect()) == sorted(want), size
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert "FlatMapGroupsInPandas" not in plan_of(out)


def test_pairs_of_few_rows_keep_their_tasks(spark):
    rows = [(v, f, float(f), k) for v in range(2) for f in range(40) for k in range(4)]
    pairs = P.frame_pairs(spark.createDataFrame(rows, "video_id long, frame long, t double, tid long"))
    assert pairs.count() == 2 * 40 * 6
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_queues_are_told_without_a_median_over_pairs(spark):
    g = random.Random(12)
    runs = [(v, i, 10 * v + i, s := g.randrange(40) / 4, s + g.randrange(40) / 4, 0.0, 0.0, 10.0, 10.0) for v in range(2) for i in range(25)]
    runs = [(v, tid, 100 * v + tid, s, e, *box) for v, tid, _, s, e, *box in runs]
    speeds = [0.0, 0.07, 0.08, 0.09, 0.06, 0.1, 0.5, None, float("nan")]
    kin = [(v, g.randrange(30), "car", g.randrange(80) / 4, g.choice([5.0, 20.0, 50.0]), 10.0, g.choice(speeds)) for v in range(2) for _ in range(400)]
    out = D.stopped_in_queue(spark.createDataFrame(runs, "video_id long, tid long, id long, start double, end double, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(kin, "video_id long, tid long, cls string, t double, gx double, gy double, speed double"), 3.0, 0.08, 0.5)
    want = set()
    for v, tid, i, s, e, *_ in runs:
        seconds = {}
        for w, other, _, t, x, _, speed in kin:
            if v == w and tid != other and s <= t <= e and abs(x - 5) < 30 and speed is not None:
                seconds.setdefault(math.floor(t), []).append(math.inf if speed != speed else speed)
        slow = [statistics.median(x) < 0.08 for x in seconds.values()]
        if slow and sum(slow) / len(slow) >= 0.5:
            want.add(i)
    assert {r["id"] for r in out.collect()} == want and 5 < len(want) < 45
    assert "median" not in plan_of(out) and "percentile" not in plan_of(out)


def test_intervals_meet_where_the_later_one_starts(spark):
    g = random.Random(13)
    spans = lambda n: [(i, g.randrange(2), s := g.randrange(0, 80) / 4, s + g.choice([-1, 0, 0, 1, 2, 9, 40]) / 4) for i in range(n)]
    a, b = [*spans(120), (900, 0, None, 3.0)], [*spans(120), (901, 0, 3.0, None)]
    of = lambda rows, i, s, e: spark.createDataFrame(rows, f"{i} long, video_id long, {s} double, {e} double")
    meet = lambda x, y: x[1] == y[1] and None not in x + y and x[2] < y[3] and y[2] < x[3]
    for width in (0.5, 10.0):
        got = [(r["id"], r["other"]) for r in T.overlapping(of(a, "id", "start", "end"), of(b, "other", "start_b", "end_b"), ["video_id"], width).collect()]
        assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if meet(x, y)), width
    rows = W.clashes(of(a, "id", "start", "end"), ["video_id"])
    assert sorted((r["id"], r["other"]) for r in rows.collect()) == sorted((x[0], y[0]) for x in a for y in a if meet(x, y) and (x[2], x[0]) < (y[2], y[0]))
    # one side of the join is unrolled to bins, so no pair is compared in more than the one where the later starts
    assert plan_of(rows).count("explode(") == 1


def test_nearby_counts_are_those_of_the_rows_without_pairs(spark, monkeypatch):
    g = random.Random(14)
    tracks = [(g.randrange(2), g.randrange(12), g.randrange(0, 480) / 4) for _ in range(150)]
    tracks += [*tracks[:20], (0, None, 3.0), (None, 1, 3.0), (0, 1, None), (0, 1, float("nan")), *[(1, 50, 60.0 + k % 3) for k in range(40)], (2, 1, 0.0), (0, 60, -7.0)]
    events = [(i, g.randrange(3), s := g.randrange(-20, 500) / 4, s + g.choice([0, 0, 1, 2.5, 9, 40])) for i in range(150)] + [(900, 0, None, 3.0), (901, None, 3.0, 4.0)]
    one = lambda rows: spark.createDataFrame(rows, "id long, video_id long, start double, end double")
    seen_in = spark.createDataFrame(tracks, "video_id long, tid long, t double")

    def plain(rows, seen, kept):
        for i, v, a, b in rows:
            near = lambda by: [k for w, k, t in tracks if None not in (v, w, k, t, a, b) and w == v and a - by <= t <= b + by]
            who = set(near(seen))
            if who:
                yield i, sum(k in who for k in near(kept)), len(who)

    odd = [(i, v, a, a - g.choice([1, 4, 7])) for i, v, a, _ in events[:30]]
    for rows, seen, kept in ((events, 3.0, 5.0), (events, 1.5, 1.5), (events, 2.0, 5.75), (odd, 3.0, 5.0), (events[:60], 1.0, 9.0)):
        got = sorted(map(tuple, W.nearby_counts(seen_in, one(rows), seen, kept).collect()))
        assert got == sorted(plain(rows, seen, kept)) and len(got) > 5, (seen, kept)
    monkeypatch.setattr(W, "binned_join", None)  # the query meets no rows with spans
    from lanescope.plans import review

    assert review.nearby_tracks(spark, "/root/testdata/sf0.001").count() > 0


def test_matching_by_levels_is_that_of_all_pairs(spark, monkeypatch):
    g = random.Random(15)

    def spans(n, off):
        out = [(off + i, g.randrange(2), g.choice("ab"), s := g.choice([g.randrange(0, 240) / 4, g.random() * 60]), s + g.choice([0.0, 0.5, 1, 2, 2, 3.25, 1 + g.random(), 40])) for i in range(n)]
        out += [(off + n + i, *r[1:]) for i, r in enumerate(out[: n // 2])] + out[:5]  # other rows of the same times, and rows that are there twice
        return out + [(off + i, r[1], r[2], r[3] + 7, r[4] + 7) for i, r in enumerate(out[:6])] + [(off + 9000, 0, "a", None, 3.0), (off + 9001, None, "a", 1.0, 3.0), (off + 9002, 0, None, 1.0, 3.0)]  # ids of several intervals

    one = lambda rows: spark.createDataFrame(rows, "id long, video_id long, label string, start double, end double")
    truth, pred = one(spans(260, 0)), one(spans(300, 500))
    left = []
    for rows, least, keys in ((10, 0.3, ["video_id", "label"]), (10, 0.05, ["video_id"]), (10_000, 0.3, ["video_id"]), (40, 0.9, ["video_id"])):
        monkeypatch.setattr(V, "ROWS", rows)
        monkeypatch.setattr(V, "LENGTHS", 3)  # short stretches: much cannot be told in one
        few = V.contenders(truth, pred, least, keys)
        left.append(few.where("not settled").count())
        want = V.greedy_match(V.candidates(truth, pred, least, keys), keys)
        assert sorted(map(tuple, V.greedy_match(few, keys).collect())) == sorted(map(tuple, want.collect())), (rows, least)
    assert left[0] and left[1]


def test_matching_of_dense_intervals_takes_few_pairs(spark):
    t = spark.range(3000).select("id", F.lit(0).alias("video_id"), F.lit("a").alias("label"), (F.col("id") * 0.001).alias("start"), (F.col("id") * 0.001 + 1 + F.col("id") % 7 / 10).alias("end"))
    p = t.withColumns({c: F.col(c) + F.col("id") % 5 / 100 for c in ("start", "end")})
    few = V.contenders(t, p, 0.3)
    assert few.count() <= 3000 < 1_000_000 < V.candidates(t, p, 0.3).count()
    assert V.report(t, p).where("scope = 'label' and threshold = 0.3").first()["tp"] == V.greedy_match(few).count() > 2900


def test_events_of_a_rule_are_few_before_they_are_kept(spark, monkeypatch):
    g = random.Random(16)
    rows = [(v, s := g.random() * 100 - 5, s + g.choice([0.0, 0.01, 0.3, 1.7, 9.0]) * g.random(), g.choice("ab")) for v in range(3) for _ in range(150)]
    many = spark.createDataFrame(rows, "video_id long, start double, end double, label string")
    from lanescope.operators import runs

    shift = {"a": (0.4, -0.1), "b": (-0.5, 0.25)}
    a, b = runs.shifted(shift)
    for gap in (0.0, 0.05, 1.0):
        plain = many.select("video_id", "label", F.greatest(a, F.lit(0.0)).alias("start"), F.least(b, F.lit(90.0)).alias("end")).where("end > start")
        plain = runs.merge_intervals(plain, gap, ["video_id", "label"]).where(F.col("end") - F.col("start") >= 0.2)
        want = plain.select("video_id", "label", F.bround("start", 3), F.bround("end", 3)).collect()
        assert sorted(map(tuple, runs.finalize(many, 90.0, gap, 0.2, shift).collect())) == sorted(map(tuple, want)), gap
    kept, keep = [], D.materialised
    monkeypatch.setattr(D, "materialised", lambda df: kept.append(df.count()) or keep(df))
    rules = D.Detector()
    rules.rule("pairs")(lambda c: c.select("video_id", "start", "end"))
    dense = spark.range(5000).select(F.lit(0).alias("video_id"), (F.col("id") / 500).alias("start"), (F.col("id") / 500 + 2).alias("end"))
    events, status = rules.outcome(dense, 60.0)
    assert [tuple(r) for r in events.collect()] == [(0, "pairs", 0.0, 11.998)] and status.first()["ok"] and kept[0] <= 21

"""Registered queries see every row of their tables, not the subset that a slow SQL comparison was spared."""

from collections import defaultdict

from lanescope.plans import rules

SMALL = "/root/testdata/sf0.001"


def test_alarm_match_sees_all_accidents(spark):
    accidents = rules.segments(spark, SMALL).where("label = 'error'").select("video_id", "start").collect()
    free = defaultdict(list)
    for r in rules.R.alarm_starts(rules.curve(spark, SMALL)).collect():
        free[r["video_id"]].append(r["start"])
    want = []
    for v, s in sorted(map(tuple, accidents)):
        got = min((a for a in free[v] if s - 10 <= a < s), default=None)
        if got is not None:
            free[v].remove(got)
        want.append((v, s, got))
    out = rules.alarm_match(spark, SMALL).collect()
    flat = lambda rows: sorted((v, s, -1.0 if a is None else a) for v, s, a in rows)
    got, want = flat(map(tuple, out)), flat(want)
    assert len(got) == len(want)
    assert all(abs(x - y) < 1e-3 for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_greedy_match_compares_all_rows(spark):
    t = rules.tracks(spark, SMALL).select("event_id", "video_id", "event_type", "t", "x1", "y1").collect()
    groups = defaultdict(list)
    for r in t:
        groups[r["video_id"], r["event_type"]].append((r["event_id"], r["t"], r["t"] + 1 + r["y1"] / 50, r["x1"] / 100))
    want = set()
    for (v, label), g in groups.items():
        pairs = []
        for i, s, e, _ in g:
            for j, s2, e2, x in g:
                shared = min(e, e2 + x) - max(s, s2 + x)
                if shared > 0 and (iou := shared / ((e - s) + (e2 - s2) - shared)) >= 0.3:
                    pairs.append((iou, i, j))
        a, b = set(), set()
        for _, i, j in sorted(pairs, reverse=True):
            if i not in a and j not in b:
                a.add(i)
                b.add(j)
                want.add((v, label, i, j))
    assert {(r["video_id"], r["label"], r["truth_id"], r["pred_id"]) for r in rules.greedy_match(spark, SMALL).collect()} == want

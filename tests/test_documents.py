"""Sinks: round trips, failed tasks, order; the flow store; tracks that an event needs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lanescope.operators import evaluate, kinematics, rules
from lanescope.operators.involved import involved_tracks
from lanescope.sources import documents, tables
from tests.test_operators import CAR, TR, actors, close_call


def test_predictions_round_trip_from_many_tasks(spark, tmp_path):
    path = str(tmp_path / "pred.json")
    names = [f"v {i}\"x\\ü.mp4" for i in range(40)]
    events = spark.createDataFrame([(n, float(k), k + 2.5, "accident") for i, n in enumerate(names) for k in range(i % 4)], "video_id string, start double, end double, label string").repartition(7)
    risk = spark.createDataFrame([(n, k / 4, 0.25) for n in names for k in range(3)], "video_id string, t double, score double").repartition(5)
    for team in ("a \"team\"", "again"):  # what was there is replaced
        documents.write_predictions(events, risk, path, team)
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        assert doc["team"] == team and set(doc["videos"]) == set(names)
    e, r = tables.read_predictions(spark, path)
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, events.select("video_id", "start", "end", "label").collect()))
    assert r.count() == 120 and os.listdir(tmp_path) in (["pred.json", ".pred.json.crc"], [".pred.json.crc", "pred.json"], ["pred.json"])
    documents.write_predictions(events.where("false"), risk.where("false"), path, "none")
    with open(path) as f:
        assert json.load(f) == {"team": "none", "videos": {}}


def test_long_documents_are_copied_whole(spark, tmp_path):
    path = str(tmp_path / "long.json")
    rows = spark.range(300).select(F.format_string("%04d", "id").alias("key"), F.to_json(F.struct(F.repeat(F.lit("é\n🙂,"), 900).alias("text"), "id")).alias("json"))
    documents.write_document(rows.repartition(9), path)
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    assert list(doc) == [f"{i:04d}" for i in range(300)] and all(doc[f"{i:04d}"] == {"text": "é\n🙂," * 900, "id": i} for i in range(300))


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "bad.json")
    rows = spark.range(20).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.lit("1")).alias("json"))
    with pytest.raises(Exception, match="broken"):
        documents.write_document(rows.repartition(4), path)
    assert [n for n in os.listdir(tmp_path) if "bad" in n] == []


def test_reports_candidates_and_sites(spark, tmp_path):
    kind = "id long, video_id long, start double, end double, label string"
    t = spark.createDataFrame([(1, 0, 0.0, 10.0, "a"), (2, 0, 20.0, 30.0, "b")], kind)
    report = evaluate.report(t, t.where("label = 'a'"))
    documents.write_report(report, str(tmp_path / "report.json"), team="x", score=0.5)
    with open(tmp_path / "report.json") as f:
        doc = json.load(f)
    assert doc["team"] == "x" and len(doc["rows"]) == report.count() and {"scope", "label", "f1"} <= set(doc["rows"][0])
    videos = spark.createDataFrame([(1, 10.0, 25.0), (2, 99.5, 25.0), (3, 0.5, 30.0)], "video_id long, duration double, fps double")
    c = spark.createDataFrame([(1, "a", 5.0, 6.0, 2), (1, "b", 1.0, 3.0, 1), (2, "a", 0.0, 1.0, 0)], "video_id long, label string, start double, end double, hits int")
    documents.write_candidates(c, videos, str(tmp_path / "c.json"))
    with open(tmp_path / "c.json") as f:
        doc = json.load(f)
    assert [x["label"] for x in doc["1"]["candidates"]] == ["b", "a"] and doc["3"] == {"duration": 0.5, "fps": 30.0, "candidates": []}
    documents.write_site(videos.withColumn("events", F.lit(3)), str(tmp_path / "site"), ["duration", "events"], F.col("duration") > 1)
    with open(tmp_path / "site/index.json") as f:
        assert [x["video_id"] for x in json.load(f)] == [2, 1]
    assert json.loads(spark.read.text(str(tmp_path / "site/videos")).where("video_id = 3").first()["value"]) == {"video_id": 3, "duration": 0.5, "fps": 30.0, "events": 3}


def test_flow_of_two_runs_is_the_flow_of_both(spark, tmp_path):
    cells = lambda rows: spark.createDataFrame(rows, documents.FlowStore.FIELDS)
    a, b = [(0, 1, 1, 5, 1.0, 0.5), (0, 1, 2, 1, 0.0, 1.0), (1, 0, 0, 2, 2.0, 0.0)], [(0, 1, 1, 3, -0.5, 0.5), (2, 0, 0, 9, 9.0, 0.0)]
    store = documents.FlowStore(spark, str(tmp_path / "flow"))
    assert store.read().count() == 0 and store.runs() == []
    store.add("2024-01", cells(a))
    store.add("2024-02", cells(b))
    store.add("2024-02", cells(b))  # a run that is repeated
    with pytest.raises(Exception, match="broken"):
        store.add("2024-03", cells(b).withColumn("n", F.raise_error(F.lit("broken")).cast("long")))
    want = sorted(map(tuple, cells(a + b).groupBy("video_id", "cy", "cx").agg(F.sum("n"), F.sum("sx"), F.sum("sy")).collect()))
    assert sorted(map(tuple, store.read().collect())) == want and store.runs() == ["2024-01", "2024-02"]
    assert sorted(map(tuple, store.read(until="2024-01").collect())) == sorted(a)
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == want and store.runs() == ["2024-02"]
    with pytest.raises(ValueError):
        store.add("a/b", cells(a))


def test_the_fewest_tracks_of_close_calls(spark):
    by_hand = [(10 + k, "car", [(0, 40.0 * k, 100 + 40 * (k % 2)), (9, 40.0 * k + 200, 100 + 40 * (k % 2))], CAR) for k in range(11)]
    rows = actors(*close_call(), *by_hand)
    other = [(7, *r[1:]) for r in actors(*close_call())]
    none = spark.createDataFrame([], "video_id long, a_tid long, b_tid long, start double")
    kin = kinematics.with_kinematics(spark.createDataFrame(rows + other, TR), 3).withColumn("on_road", F.lit(True)).cache()
    rule = lambda k: rules.near_misses(k, none, 1.0, 2.0, 0.25, 1.0, 0.5, 0.35)
    found = rule(kin).select("video_id", "start", "end").collect()
    assert sorted(r["video_id"] for r in found) == [0, 7]
    events = spark.createDataFrame([(i, r["video_id"], r["start"], r["end"]) for i, r in enumerate(found)] + [(9, 0, 0.0, 0.2)], "id long, video_id long, start double, end double")
    got = {}
    for r in involved_tracks(kin, events, rule).collect():
        got.setdefault(r["id"], set()).add(r["tid"])
    assert got == {0: {1, 2}, 1: {1, 2}}  # the two parties, of fifteen; nothing for an event that isn't there

"""Documents of every wrong shape, each problem where it is."""

import json

from lanescope.sources import tables
from lanescope.sources.validate import document_problems

GOOD = {"events": [[0, 2.5, "a"], [2.5, 4, "a"], [1, 3, "b"]], "risk": [[0, 0.0], [0.5, 1], [0.5, 0.25]]}


def problems(spark, docs, truth=None):
    rows = [(k, d if isinstance(d, str) else json.dumps(d)) for k, d in docs.items()]
    asked = None if truth is None else spark.createDataFrame(truth, "video_id string, duration double")
    out = {}
    for r in document_problems(spark.createDataFrame(rows, "doc string, value string"), ["a", "b"], asked).collect():
        out.setdefault(r["doc"], set()).add((r["severity"], r["place"], r["what"]))
    return out


def test_a_good_document_has_no_problems(spark):
    assert problems(spark, {"x": {"team": "t", "videos": {"v.mp4": GOOD, "w.mp4": {"events": [], "risk": [[0, 0]]}}}}, [("v.mp4", 4.0), ("w.mp4", None)]) == {}
    assert problems(spark, {}) == {}


def test_every_problem_is_told_where_it_is(spark):
    entry = lambda events, risk=((0, 0),): {"team": "t", "videos": {"v": {"events": events, "risk": list(map(list, risk)) if isinstance(risk, tuple) else risk}}}
    docs = {
        "text": "not json", "list": [1], "no_videos": {"team": "t"}, "videos_list": {"team": "t", "videos": []}, "no_team": {"videos": {}},
        "path": {"team": "t", "videos": {"a/v": GOOD, "b\\v": GOOD}}, "entry": {"team": "t", "videos": {"v": [1], "w": {"risk": []}, "x": {"events": {}}}},
        "events": entry([[1, 2], [1, 2, "a", 3], "x", ["1", 2, "a"], [1, True, "a"], [1, None, "a"], [2, 1, "a"], [-1, 1, "b"], [5, 6, "c"], [7, 8, 9], [9, 10, None], [11, 12.5, "a"]]),
        "overlap": entry([[5, 9, "a"], [1, 6, "a"], [6, 7, "b"], [8, 12, "a"], [12, 13, "a"]]),
        "risk_kind": entry([], {}), "risk_empty": entry([], []), "risk_none": {"team": "t", "videos": {"v": {"events": []}}},
        "sample": entry([], ((0, 0), (1,), (0, 9))), "sample_text": entry([], ((0, "0.5"),)), "time": entry([], ((0, 0), (2, 0.5), (1, 7), (0, 9))), "score": entry([], ((0, 0), (1, 1.5), (0, 0))), "early": entry([], ((-2, 0),)),
    }
    error = lambda *ps: {("error", p, w) for p, w in ps}
    assert problems(spark, docs) == {
        "text": error(("", "videos")), "list": error(("", "videos")), "no_videos": error(("", "videos")), "videos_list": error(("", "videos")), "no_team": {("warning", "", "team")},
        "path": error(("a/v", "path"), ("b\\v", "path")), "entry": error(("v", "entry"), ("w", "entry"), ("x", "entry")),
        "events": error(*[(f"v.events[{i}]", w) for i, w in enumerate(["event", "event", "event", "number", "number", "number", "interval", "interval", "label", "label", "label"])]),
        "overlap": error(("v.events[0]", "overlap"), ("v.events[3]", "overlap")),
        "risk_kind": error(("v", "risk")), "risk_empty": {("warning", "v", "no risk")}, "risk_none": {("warning", "v", "no risk")},
        "sample": error(("v.risk[1]", "sample")), "sample_text": error(("v.risk[0]", "sample")), "time": error(("v.risk[2]", "time")), "score": error(("v.risk[1]", "score")), "early": error(("v.risk[0]", "time")),
    }


def test_videos_are_held_against_those_asked_for(spark):
    docs = {"one": {"team": "t", "videos": {"v": {"events": [[0, 10.5, "a"], [0, 10.6, "b"]], "risk": [[0, 0]]}, "extra": GOOD}}, "two": {"team": "t", "videos": {"v": GOOD, "w": GOOD}}}
    got = problems(spark, docs, [("v", 10.0), ("w", None)])
    assert got == {"one": {("error", "v.events[1]", "past the end"), ("warning", "extra", "unasked"), ("error", "w", "missing")}}


def test_settings_by_dotted_paths_and_profiles(tmp_path, monkeypatch):
    base = {"rules": {"stop": {"least": 10, "gap": 3}}, "name": "x"}
    got = tables.with_overrides(base, {"rules.stop.least": 4, "rules.turn.rate": 25.0, "name": "y"})
    assert got == {"rules": {"stop": {"least": 4, "gap": 3}, "turn": {"rate": 25.0}}, "name": "y"} and base["rules"]["stop"]["least"] == 10
    assert tables.setting(got, "rules.stop.gap") == 3
    for name, doc in (("base", base), ("tuned", {"rules": {"stop": {"gap": 5}}}), ("night", {"name": "n"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert tables.load_settings(str(tmp_path / "base.json")) == {"rules": {"stop": {"least": 10, "gap": 5}}, "name": "x"}
    assert tables.load_settings(str(tmp_path / "base.json"), profile="night")["name"] == "n"
    assert tables.load_settings(str(tmp_path / "base.json"), profile="missing")["name"] == "x"

"""Causal collision risk per video: one state machine, run over a recorded table or as a stateful stream.

State per video: each live track's position, velocity, size and recent speeds; how many samples in a row each pair has been
threatening; the smoothed score. Rows of one video go to one task in order of time; videos are the unit of parallelism.

The stream keeps a map entry for each track and each threatening pair, so a batch reads and writes the tracks it shows,
and entries go when their track has not been seen for `forget` seconds of the video's own time. It needs the RocksDB state store (state_store()).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lanescope.operators.scene import with_road

MOVERS = {"car", "truck", "bus", "motorcycle", "bicycle", "person"}
CURVE = "video_id long, t double, score double"


@dataclass(frozen=True)
class RiskSettings:
    forget: float = 2.0
    samples: int = 3
    moving: float = 0.35
    radius_both: float = 0.25
    radius_one: float = 0.15
    parallel: float = 0.94
    lane: float = 0.4
    closing: float = 2.5
    closing_crossing: float = 1.0
    crossing: float = 0.5
    middle: float = 1.5
    scale: float = 0.4
    persist: int = 3
    tau: float = 0.6
    lag_samples: int = 0


class RiskState:
    """step(t, rows) takes the boxes of one sample (tid, cls, x1, y1, x2, y2, on_road) and returns the smoothed score."""

    def __init__(self, settings: RiskSettings):
        self.s = settings
        self.tracks: dict[str, dict] = {}
        self.streaks: dict[str, int] = {}
        self.score, self.last, self.shown, self.swept = 0.0, None, [], float("-inf")

    def _follow(self, t: float, rows: list[tuple]) -> list[tuple[str, dict]]:
        """Takes in a sample's boxes; the tracks on the road that it shows and that are known well enough to judge."""
        s, seen = self.s, {}
        for tid, cls, x1, y1, x2, y2, road in rows:
            if cls not in MOVERS:
                continue
            x, y, size = (x1 + x2) / 2, y2, math.sqrt(max(x2 - x1, 1) * max(y2 - y1, 1))
            k = self.tracks.get(tid)
            if k is None or (self.last is not None and self.last - k["t"] > s.forget):
                k = self.tracks[tid] = {"p": [x, y], "v": [0.0, 0.0], "size": size, "t": t, "cls": cls, "speeds": [], "road": road}
            elif (dt := t - k["t"]) > 0:
                (px, py), (vx, vy) = k["p"], k["v"]
                v = [0.5 * vx + 0.5 * (x - px) / dt, 0.5 * vy + 0.5 * (y - py) / dt]
                size = 0.8 * k["size"] + 0.2 * size
                recent = [q for q in k["speeds"] if t - q[0] <= s.forget]
                k.update(p=[x, y], v=v, size=size, t=t, cls=cls, speeds=[*recent, [t, math.hypot(*v) / size]], road=road)
            seen[tid] = k
        if t - self.swept > s.forget:  # tracks that are forgotten count as new ones anyway
            self.tracks, self.swept = {n: k for n, k in self.tracks.items() if t - k["t"] <= s.forget}, t
        return [(n, k) for n, k in seen.items() if len(k["speeds"]) >= s.samples and k["road"]]

    def _pair(self, a: dict, b: dict) -> float | None:
        """Time to contact of a threatening pair."""
        s = self.s
        if a["cls"] == b["cls"] == "person":
            return None
        both = a["speeds"][-1][1] > s.moving and b["speeds"][-1][1] > s.moving
        px, py = b["p"][0] - a["p"][0], b["p"][1] - a["p"][1]
        vx, vy = b["v"][0] - a["v"][0], b["v"][1] - a["v"][1]
        size = (a["size"] + b["size"]) / 2
        r = (s.radius_both if both else s.radius_one) * 2 * size
        qa, qb, qc = vx * vx + vy * vy, 2 * (px * vx + py * vy), px * px + py * py - r * r
        if qc <= 0:
            ttc = 0.0
        elif qa > 1e-9 and qb < 0 and qb * qb - 4 * qa * qc >= 0:
            ttc = (-qb - math.sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)
        else:
            return None
        na, nb = math.hypot(*a["v"]) + 1e-9, math.hypot(*b["v"]) + 1e-9
        cos = (a["v"][0] * b["v"][0] + a["v"][1] * b["v"][1]) / (na * nb)
        if both and abs(cos) > s.parallel:  # a standing party's heading is noise
            sign = 1.0 if cos >= 0 else -1.0
            ax, ay = a["v"][0] / na + sign * b["v"][0] / nb, a["v"][1] / na + sign * b["v"][1] / nb
            n = math.hypot(ax, ay) + 1e-9
            if abs(px * ay - py * ax) / n / size > s.lane:
                return None
        closing = -(px * vx + py * vy) / (math.hypot(px, py) + 1e-9) / size
        floor = s.closing_crossing if both and abs(cos) < s.crossing else s.closing
        return ttc if closing >= floor and ttc < s.middle + 2 * s.scale else None

    def _brake(self, k: dict, t: float) -> float:
        recent = [v for at, v in k["speeds"] if t - at <= 1.0]
        if len(k["speeds"]) < 3 or not recent or max(recent) < self.s.moving:
            return 0.0
        return (max(recent) - recent[-1]) / max(recent)

    def _instant(self, t: float, live: list[tuple[str, dict]]) -> float:
        if len(live) < 2:
            self.streaks = {}
            return 0.0
        now, least = {}, None
        for i, (n, a) in enumerate(live):
            for m, b in live[i + 1 :]:
                ttc = self._pair(a, b)
                if ttc is not None:
                    key = "|".join(sorted((n, m)))
                    now[key] = self.streaks.get(key, 0) + 1
                    if now[key] >= self.s.persist:
                        least = ttc if least is None else min(least, ttc)
        self.streaks = now
        risk = 0.0 if least is None else 1 / (1 + math.exp((least - self.s.middle) / self.s.scale))
        brake = max(self._brake(k, t) for _, k in live)
        return 1 - (1 - risk) * (1 - 0.5 * brake * math.sqrt(risk))

    def step(self, t: float, rows: list[tuple]) -> float | None:
        if self.last is not None and t <= self.last:
            return None  # late rows change nothing
        raw = self._instant(t, self._follow(t, rows))
        alpha = 1.0 if self.last is None else 1 - math.exp(-(t - self.last) / self.s.tau)
        self.score = min(1.0, max(0.0, self.score + alpha * (raw - self.score)))
        self.last = t
        self.shown.append(self.score)
        lag = self.s.lag_samples
        self.shown = self.shown[-(lag + 1) :]
        return self.shown[0] if len(self.shown) > lag else 0.0


def scores(video: int, df: pd.DataFrame, state: RiskState) -> pd.DataFrame:
    out = []
    df = df.sort_values(["t", "tid"])
    t = df["t"].to_numpy(float)
    rows = list(zip(df["tid"].astype(str), df["cls"], *(df[c].tolist() for c in ("x1", "y1", "x2", "y2", "on_road")), strict=True))
    first = np.flatnonzero(np.diff(t, prepend=np.nan) != 0)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
        got = state.step(float(t[lo]), rows[lo:hi])
        if got is not None:
            out.append((video, float(t[lo]), got))
    return pd.DataFrame(out, columns=["video_id", "t", "score"]).astype({"video_id": "int64", "t": "float64", "score": "float64"})


INPUT = ["video_id", "t", "tid", "cls", "x1", "y1", "x2", "y2"]


def judged_boxes(tracks: DataFrame) -> DataFrame:
    """The columns that the state machine reads; where nothing is known of the road, all of it is."""
    road = F.coalesce("on_road", F.lit(False)) if "on_road" in tracks.columns else F.lit(True)
    return tracks.select(*INPUT, road.alias("on_road"))


def on_known_road(tracks: DataFrame, road: DataFrame, grid: float, ny: int, nx: int) -> DataFrame:
    """Boxes, recorded or streaming, with whether their ground point is on the road learned before (video_id, cy, cx).
    A video without any road cell counts as road everywhere, as it does where there is no road table at all."""
    at = tracks.withColumns({"gx": (F.col("x1") + F.col("x2")) / 2, "gy": F.col("y2")})
    known = road.select("video_id").distinct().withColumn("_known", F.lit(True))
    on = with_road(at, road.select("video_id", "cy", "cx"), grid, ny, nx).join(known, "video_id", "left")
    return on.withColumn("on_road", F.col("on_road") | F.col("_known").isNull()).drop("gx", "gy", "cy", "cx", "_known")


def replay(tracks: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """The curve of a recorded table: what the stream would have said, row for row. A video's rows pass its state machine
    in order of time, a batch at a time; a worker holds one batch, the sample it ends in and the state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, held = None, None, []  # held: pieces of a video's last sample so far, which may go on
        for batch in batches:
            for v, df in batch.groupby("video_id", sort=False, dropna=False):
                if state is None or v != video:
                    if held:
                        yield scores(int(video), pd.concat(held), state)
                    video, state, held = v, RiskState(settings), []
                last = df["t"].to_numpy() == df["t"].iloc[-1]
                if held and held[-1]["t"].iloc[-1] == df["t"].iloc[-1]:  # all of it is of the sample that is held
                    held.append(df)
                    continue
                if held or not last.all():
                    yield scores(int(v), pd.concat([*held, df[~last]]), state)
                held = [df[last]] if last.any() else []  # a time that is missing is a sample of its own
        if held:
            yield scores(int(video), pd.concat(held), state)

    ordered = judged_boxes(tracks).repartition("video_id").sortWithinPartitions("video_id", F.asc_nulls_last("t"), "tid")
    return ordered.mapInPandas(run, CURVE)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Sets the state store that maps and lists per key need, where the session still has Spark's default."""
    if "HDFSBacked" in spark.conf.get(STORE):
        spark.conf.set(STORE, ROCKSDB)


class RiskProcessor(StatefulProcessor):
    """The state machine of each video, with its tracks, pairs and clock in the state store."""

    def __init__(self, settings: RiskSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "tid string", "px double, py double, vx double, vy double, size double, t double, kind string, road boolean, times array<double>, speeds array<double>")
        self.pairs = handle.getMapState("pairs", "pair string", "streak int")
        self.clock = handle.getValueState("clock", "score double, last double, shown array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        state = RiskState(self.settings)
        for tid in df["tid"].astype(str).unique():
            k = self.tracks.getValue((tid,))
            if k is not None:
                px, py, vx, vy, size, t, cls, road, times, speeds = k
                state.tracks[tid] = {"p": [px, py], "v": [vx, vy], "size": size, "t": t, "cls": cls, "road": road, "speeds": [list(s) for s in zip(times, speeds, strict=True)]}
        state.streaks = before = {pair[0]: n[0] for pair, n in self.pairs.iterator()}
        if self.clock.exists():
            state.score, state.last, state.shown = self.clock.get()
            state.shown = list(state.shown)
        out = scores(int(key[0]), df, state)
        for tid, k in state.tracks.items():
            self.tracks.updateValue((tid,), (*map(float, (*k["p"], *k["v"], k["size"], k["t"])), k["cls"], bool(k["road"]), [float(s[0]) for s in k["speeds"]], [float(s[1]) for s in k["speeds"]]))
        for tid in [tid[0] for tid, k in self.tracks.iterator() if state.last - k[5] > self.settings.forget]:
            self.tracks.removeKey((tid,))
        for pair in before.keys() - state.streaks.keys():
            self.pairs.removeKey((pair,))
        for pair, n in state.streaks.items():
            self.pairs.updateValue((pair,), (n,))
        self.clock.update((float(state.score), float(state.last), [float(x) for x in state.shown]))
        yield out

    def close(self) -> None:
        pass


def risk_stream(tracks: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """The same over a streaming DataFrame, with the state of each video kept between batches; append mode. Rows of a video
    have to come in order of time between batches; rows that are not later than the last sample change nothing."""
    state_store(tracks.sparkSession)
    return judged_boxes(tracks).groupBy("video_id").transformWithStateInPandas(RiskProcessor(settings), CURVE, "Append", "None")


def sampled(tracks: DataFrame, fps: float, target: float) -> DataFrame:
    """Only every stride-th frame, the stride that comes nearest to target frames a second."""
    stride = max(1, round(fps / target))
    return tracks.where(F.bround(F.col("t") * fps).cast("long") % stride == 0)

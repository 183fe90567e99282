"""Alarms over a streaming risk curve: what alarm_starts finds on the recorded one, an alarm as soon as nothing can change it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .risk import state_store

ALARMS = "video_id long, start double, end double"


class AlarmProcessor(StatefulProcessor):
    """Per video: rows that the watermark has not reached yet, and the alarm that is open.

    Rows are taken in order of time once the watermark has passed them. Rows in a row at theta or above are one alarm, whatever time
    lies between; the next run is part of it if it starts under `gap` after its end. An alarm is given out when its run has
    ended and the watermark is `gap` past it.
    """

    def __init__(self, theta: float, gap: float):
        self.theta, self.gap = theta, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, score double")
        self.alarm = handle.getValueState("alarm", "start double, end double, running boolean")
        self.taken = handle.getValueState("taken", "t double")

    def _settle(self, key: tuple, watermark: float) -> pd.DataFrame:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= watermark]
        start, end, running = self.alarm.get() if self.alarm.exists() else (None, None, False)
        out = []
        for t, score in ready:
            if score < self.theta:
                running = False
            elif start is not None and (running or t - end < self.gap):
                end, running = t, True
            else:
                if start is not None:
                    out.append((int(key[0]), start, end))
                start, end, running = t, t, True
        if start is not None and not running and watermark >= end + self.gap:
            out.append((int(key[0]), start, end))
            start = None
        if ready:
            self.taken.update((ready[-1][0],))
            left = rows[len(ready) :]
            self.waiting.put(left) if left else self.waiting.clear()
        if start is None:
            self.alarm.clear()
        else:
            self.alarm.update((start, end, running))
        return pd.DataFrame(out, columns=["video_id", "start", "end"]).astype({"video_id": "int64", "start": "float64", "end": "float64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else float("-inf")
        df = pd.concat(list(rows))
        df = df[df["t"] > taken]  # what comes after its time was settled is late
        if len(df):
            self.waiting.appendList([(float(t), float(s)) for t, s in zip(df["t"], df["score"], strict=True)])
            self.handle.registerTimer(int((df["t"].max() + self.gap) * 1000) + 1)
        yield self._settle(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def alarm_stream(curve: DataFrame, theta: float = 0.5, gap: float = 2.0, late: float = 1.0) -> DataFrame:
    """(video_id, start, end) of a streaming curve (video_id, t, score) in append mode: the alarms of the recorded curve, each
    once it is over. Rows may come out of order by up to `late` seconds; later ones are dropped. Scores that are null count as 0.
    An alarm that the stream ends in is given out when other rows move the watermark on."""
    state_store(curve.sparkSession)
    rows = curve.where("t is not null").select("video_id", "t", F.coalesce("score", F.lit(0.0)).alias("score"), F.timestamp_millis(F.floor(F.col("t") * 1000)).alias("at"))
    return rows.withWatermark("at", f"{int(late * 1000)} milliseconds").groupBy("video_id").transformWithStateInPandas(AlarmProcessor(theta, gap), ALARMS, "Append", "EventTime")

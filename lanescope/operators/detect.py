"""From kinematic tracks to finalised, labelled events of whole videos."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.functions import geometry as G
from lanescope.session import materialised

from . import pairs as P
from . import rules as E
from .runs import clipped, rounded_off
from .scene_rules import waiting_at_red
from .sequential import stitch_runs
from .temporal import binned_join

log = logging.getLogger(__name__)
RUN = ["video_id", "start", "end", "x1", "y1", "x2", "y2"]


def stopped_in_queue(runs: DataFrame, kin: DataFrame, radius: float, moving: float, share: float) -> DataFrame:
    """(id): runs whose neighbours, within `radius` sizes, were mostly slow too: by the median of each second, in at least
    `share` of the seconds in which there were any."""
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    size = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    r = runs.select("video_id", "id", F.col("tid").alias("own"), "start", "end", x.alias("rx"), y.alias("ry"), size.alias("rs"))
    v = kin.where(F.col("cls").isin(P.VEHICLES)).select("video_id", "tid", "t", "gx", "gy", "speed")
    near = binned_join(v, r, ["video_id"], 1.0, (F.col("tid") != F.col("own")) & (F.hypot(F.col("gx") - F.col("rx"), F.col("gy") - F.col("ry")) < radius * F.col("rs")), apart=True)
    # whether the median is below `moving`, from what combines before a shuffle, so that no pair leaves its task
    slow = F.col("speed") < moving
    seen = [F.count_if(slow).alias("below"), F.count_if(~slow).alias("above"), F.max(F.when(slow, F.col("speed"))).alias("low"), F.min(F.when(~slow, F.col("speed"))).alias("high")]
    second = near.groupBy("id", F.floor("t").alias("second")).agg(*seen).where("below + above > 0")
    below = (F.col("below") > F.col("above")) | ((F.col("below") == F.col("above")) & (F.col("low") + (F.col("high") - F.col("low")) * 0.5 < moving))
    return second.groupBy("id").agg(F.avg(below.cast("double")).alias("slow")).where(F.col("slow") >= share).select("id")


def stopped_vehicles(kin: DataFrame, states: DataFrame | None, approaches: DataFrame | None, moving: float, stopped: float, shortest: float, gap: float, overlap: float, radius: float, share: float) -> DataFrame:
    """(video_id, start, end): stops of vehicles that once moved, stitched over lost tracks, that are no queue: neither among
    slow neighbours nor, where states (video_id, approach, t, state) are known, before any of the video's approaches at red."""
    runs = stitch_runs(E.stationary(kin, moving, stopped), gap, overlap).where(F.col("end") - F.col("start") >= shortest)
    runs = runs.withColumn("id", F.xxhash64("video_id", "tid", "start"))
    queued = stopped_in_queue(runs, kin, radius, moving, share)
    if states is not None and approaches is not None:
        queued = queued.union(waiting_at_red(runs, states, approaches))
    return runs.join(queued, "id", "left_anti").select("video_id", "start", "end")


def illegal_turns(turns: DataFrame, no_u_turn: list[G.Points], forbidden: list[tuple[G.Points, G.Points]], u_turn: float = 150.0, turn: float = 60.0) -> DataFrame:
    """(video_id, start, end, label) of turns (total, mid, first, last): wide ones whose middle is where none may turn round,
    others by tracks that come from and go to a forbidden pair of zones."""
    at = lambda p: (F.col(f"{p}.gx"), F.col(f"{p}.gy"))
    round_ = (F.col("total") >= u_turn) & G.in_any(no_u_turn, *at("mid"))
    move = F.lit(False)
    for a, b in forbidden:
        move = move | (G.in_polygon(a, *at("first")) & G.in_polygon(b, *at("last")))
    label = F.when(round_, "illegal_u_turn").when((F.col("total") >= turn) & move, "illegal_turn")
    return turns.withColumn("label", label).where("label is not null").select("video_id", "start", "end", "label")


@dataclass
class Detector:
    """Rules by name, each a function of the context that gives (video_id, start, end) or the same with its own labels."""

    rules: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def rule(self, label: str) -> Callable:
        def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.rules[label] = f
            return f

        return put

    def outcome(self, context, duration: float, enabled: list[str] | None = None, gap: float = 1.0, least: float = 0.5, shift: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
        """(events, status). events: (video_id, label, start, end) of all rules, shifted, clipped, merged and rounded; only
        labels that are enabled. status: (rule, ok, error), a row for each rule.

        Every rule is computed by itself before they are united. One that fails, when its plan is made or in any task, is left
        out, with its error in its status row, and the others stay whole.
        """
        found: list[DataFrame] = []
        status: list[tuple[str, bool, str | None]] = []
        for label, f in self.rules.items():
            try:
                own = f(context)
                own = own.select("video_id", "start", "end", F.col("label") if "label" in own.columns else F.lit(label).alias("label"))
                found.append(materialised(clipped(own, duration, gap, shift)))  # a rule of pairs can have far more events than are left
                status.append((label, True, None))
            except Exception as e:  # whatever a rule does wrong is its own affair
                log.warning("rule %s is left out: %s", label, e)
                status.append((label, False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]))
        if not found:
            raise ValueError(f"no rule can be applied: {status}")
        out = found[0]
        for own in found[1:]:
            out = out.union(own)
        told = out.sparkSession.createDataFrame(status, "rule string, ok boolean, error string")
        out = out if enabled is None else out.where(F.col("label").isin(enabled))
        return rounded_off(out, gap, least), told

    def events(self, context, duration: float, enabled: list[str] | None = None, gap: float = 1.0, least: float = 0.5, shift: dict[str, tuple[float, float]] | None = None) -> DataFrame:
        """The events of outcome()."""
        return self.outcome(context, duration, enabled, gap, least, shift)[0]

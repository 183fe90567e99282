"""Pairs of tracked boxes in one frame: equi-joins on (video, frame) with the pair's geometry in the same stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanescope.functions.geometry import area, closing_speed, iou, shared_area, time_to_contact
from lanescope.session import spread

VEHICLES = ["car", "truck", "bus", "motorcycle", "bicycle"]
TWO_WHEELERS = ["bicycle", "motorcycle"]
BOX = ["x1", "y1", "x2", "y2"]
SIDE = ["tid", "event_id", "cls", *BOX, "gx", "gy", "vx", "vy", "size", "speed"]


def frame_pairs(kin: DataFrame) -> DataFrame:
    """Unordered pairs of tracks in a frame, a_* and b_* with a_tid < b_tid."""
    cols = [c for c in SIDE if c in kin.columns]
    a = kin.select("video_id", "frame", "t", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = kin.select("video_id", "frame", *[F.col(c).alias(f"b_{c}") for c in cols])
    own = ["video_id", "frame"]
    return spread(a, *own).join(spread(b, *own), own).where("a_tid < b_tid")


def side(s: str, names: list[str]):
    return [F.col(f"{s}_{c}") for c in names]


def with_iou(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("iou", iou(side("a", BOX), side("b", BOX)))


def motion() -> list:
    return [F.col(f"b_{c}") - F.col(f"a_{c}") for c in ("gx", "gy", "vx", "vy")]


def with_ttc(pairs: DataFrame, factor: float) -> DataFrame:
    return pairs.withColumn("ttc", time_to_contact(*motion(), factor * (F.col("a_size") + F.col("b_size"))))


def with_closing(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("closing", closing_speed(*motion(), (F.col("a_size") + F.col("b_size")) / 2))


def walkers(kin: DataFrame, covered: float = 0.3) -> DataFrame:
    """Persons but for riders: those of whose box a two-wheeler in the frame covers more than `covered`."""
    people = kin.where("cls = 'person'")
    bikes = kin.where(F.col("cls").isin(TWO_WHEELERS)).select("video_id", "frame", *[F.col(c).alias(f"w_{c}") for c in BOX])
    share = shared_area([F.col(c) for c in BOX], side("w", BOX)) / F.greatest(area([F.col(c) for c in BOX]), F.lit(1e-9))
    riders = people.join(bikes, ["video_id", "frame"]).where(share > covered).select("event_id").distinct()
    return people.join(riders, "event_id", "left_anti")


def near_pairs(vehicles: DataFrame, people: DataFrame, sizes: float, keys: list[str]) -> DataFrame:
    """Vehicle rows with a person of the same keys within `sizes` of their size, the size no more than the median car's."""
    middle = vehicles.where("cls = 'car'").groupBy("video_id").agg(F.median("size").alias("car"))
    v = vehicles.join(middle, "video_id", "left").withColumn("reach", sizes * F.least("size", F.coalesce("car", "size")))
    p = people.select(*keys, F.col("event_id").alias("p_event_id"), F.col("gx").alias("p_gx"), F.col("gy").alias("p_gy"))
    return v.join(p, keys).where(F.hypot(F.col("gx") - F.col("p_gx"), F.col("gy") - F.col("p_gy")) < F.col("reach"))

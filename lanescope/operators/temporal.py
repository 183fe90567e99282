"""Joins by time: as-of in both directions, binned range joins, dense spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.session import spread


def as_of(left: DataFrame, right: DataFrame, values: list[str], keys: list[str], forward: bool = False, tolerance: float | None = None, clamp: bool = False) -> DataFrame:
    """left with `values` of right's row nearest in time at or before it (forward: at or after), by key.

    Union and one window: a sort by (keys, t), no pairs. Nulls where there is no such row or it is farther than
    tolerance; clamp gives the outermost row instead, the last one going forward and the first going back. A right row at the same time matches.
    Of right rows at one time the greatest by values counts going back, the least going forward.
    """
    names = [c for c in left.columns if c not in keys and c != "t"]
    held = F.struct("t", *values)
    a = left.select(*keys, "t", F.struct(*names).alias("_l"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("_r"), F.lit(0 if forward else 1).alias("_o"))
    b = right.select(*keys, "t", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), held.alias("_r"), F.lit(1 if forward else 0).alias("_o"))
    # forward runs over the rows in reverse: a frame that only grows costs one pass, one that shrinks is scanned anew for every row
    order = [F.desc(c) if forward else F.asc(c) for c in ("t", "_o", "_r")]
    near = F.last("_r", True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("_n", near)
    if clamp:
        every = Window.partitionBy(*keys)
        edge = F.max("_r").over(every) if forward else F.min("_r").over(every)
        both = both.withColumn("_n", F.coalesce("_n", edge))
    got = both.where("_l is not null").select(*keys, "t", "_l.*", F.col("_n"))
    ok = F.lit(True) if tolerance is None else F.abs(F.col("t") - F.col("_n.t")) <= tolerance
    return got.select(*[c for c in got.columns if c != "_n"], *[F.when(ok, F.col(f"_n.{v}")).alias(v) for v in values])


def binned_join(points: DataFrame, spans: DataFrame, keys: list[str], width: float, condition: Column | None = None, apart: bool = False) -> DataFrame:
    """Inner join of points (t) and spans (start, end) with start <= t <= end: spans are unrolled to bins of `width` and met by
    equality, so the join is a hash or sort-merge join on (keys, bin). Column names must differ but for the keys. `apart` keeps
    the tasks of the shuffle, where pairs are far more than rows."""
    p = points.withColumn("_bin", F.floor(F.col("t") / width))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    if apart:
        p, s = spread(p, *keys, "_bin"), spread(s, *keys, "_bin")
    out = p.join(s, [*keys, "_bin"]).where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end")))
    return (out if condition is None else out.where(condition)).drop("_bin")


def begun_within(spans: DataFrame, later: DataFrame, keys: list[str], width: float, names: tuple[str, str, str] = ("start", "end", "start_b")) -> DataFrame:
    """Pairs of spans (start, end) and of later rows whose start_b may lie in them: a span is unrolled to bins of `width`, a later
    row is in one, so that nearly all that is compared meets. The caller's condition tells the pairs."""
    start, end, at = (F.floor(F.col(c) / width) for c in names)
    own = [*keys, "_bin"]
    held = spread(spans.withColumn("_bin", F.explode(F.sequence(start, end))), *own)
    return held.join(spread(later.withColumn("_bin", at), *own), own).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals a(start, end) and b(start_b, end_b) that overlap, each once: the later one (b of equals) starts in the other."""
    meets = (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end"))
    first = begun_within(a, b, keys, width).where(meets & (F.col("start") <= F.col("start_b")))
    second = begun_within(b, a, keys, width, ("start_b", "end_b", "start")).where(meets & (F.col("start") > F.col("start_b")))
    return first.unionByName(second)


def spine(df: DataFrame, last_bin: int) -> DataFrame:
    """df's rows (few: one per group) times the bins 0..last_bin."""
    return df.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last_bin))))

"""Checks of submitted prediction documents, of any shape: a problem is a row, and no document stops the others' checks.

Documents stay variants, so that a text where a number belongs, or an object where a list does, is seen and not read away. Events and
samples of all videos are rows; what compares neighbours is a window within a video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROBLEM = ["doc", "severity", "place", "what"]
NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
#: How far past a video's end an event may reach.
SLACK = 0.5


def kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1), F.lit("VOID"))


def is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(NUMBER), F.lit(False))


def item(v: Column, i: int) -> Column:
    return F.try_variant_get(v, f"$[{i}]", "variant")


def number(v: Column, i: int) -> Column:
    """Element i as a double, null where it is no number (a truth value and a text that looks like one are none)."""
    return F.when(is_number(item(v, i)), F.try_variant_get(v, f"$[{i}]", "double"))


def exploded(df: DataFrame, column: str, keep: list[str], key: str, value: str) -> DataFrame:
    """A row for each member of an object or list in a variant column: its key (or place, from 0) and value."""
    df.createOrReplaceTempView("_checked")
    names = ", ".join(f"`{k}`" for k in keep)
    out = df.sparkSession.sql(f"select {names}, coalesce(e.key, cast(e.pos as string)) as `{key}`, e.value as `{value}` from _checked, lateral variant_explode(`{column}`) e")
    df.sparkSession.catalog.dropTempView("_checked")
    return out


def document_problems(documents: DataFrame, labels: list[str], truth: DataFrame | None = None) -> DataFrame:
    """(doc, severity, place, what) for every problem of documents (doc, value as JSON text). truth: (video_id as string,
    duration), the videos that have to be there; null durations bound nothing.

    Errors: no map of videos; a key that is a path; an entry without a list of events; an event that is not [start, end, label],
    has a start or end that is no number, or not 0 <= start < end, or a label not on the list, or ends over half a second past its video; events of one label
    that overlap, each with the one that starts before it; risk that is no list; of risk samples the first that is no pair of numbers, goes back in time
    or scores outside 0 to 1; a video that is missing. Warnings: no team; no risk; a video that nobody asked for.
    """
    docs = documents.select("doc", F.try_parse_json("value").alias("v"))
    docs = docs.withColumn("videos", F.try_variant_get("v", "$.videos", "variant"))
    told: list[DataFrame] = []

    def tell(rows: DataFrame, bad: Column, what: str, place: Column, severity: str = "error") -> None:
        told.append(rows.where(F.coalesce(bad, F.lit(False))).select("doc", F.lit(severity).alias("severity"), place.alias("place"), F.lit(what).alias("what")))

    whole = F.col("v").isNotNull() & (kind(F.col("v")) == "OBJECT") & F.coalesce(kind(F.col("videos")) == "OBJECT", F.lit(False))
    tell(docs, ~whole, "videos", F.lit(""))
    docs = docs.where(whole)
    tell(docs, F.try_variant_get("v", "$.team", "variant").isNull(), "team", F.lit(""), "warning")
    entries = exploded(docs, "videos", ["doc"], "video", "entry")
    video = F.col("video")
    tell(entries, video.contains("/") | video.contains("\\"), "path", video)
    events = F.try_variant_get("entry", "$.events", "variant")
    fine = (kind(F.col("entry")) == "OBJECT") & F.coalesce(kind(events) == "ARRAY", F.lit(False))
    tell(entries, ~fine, "entry", video)
    entries = entries.where(fine).withColumns({"events": events, "risk": F.try_variant_get("entry", "$.risk", "variant")})

    e = exploded(entries, "events", ["doc", "video"], "i", "event")
    at = F.concat(video, F.lit(".events["), "i", F.lit("]"))
    triple = (kind(F.col("event")) == "ARRAY") & item(F.col("event"), 2).isNotNull() & item(F.col("event"), 3).isNull()
    tell(e, ~triple, "event", at)
    e = e.where(triple).withColumns({"start": number(F.col("event"), 0), "end": number(F.col("event"), 1)})
    tell(e, F.col("start").isNull() | F.col("end").isNull(), "number", at)
    e = e.where("start is not null and end is not null").withColumn("label", F.when(kind(item(F.col("event"), 2)) == "STRING", F.try_variant_get("event", "$[2]", "string")))
    tell(e, ~((F.col("start") >= 0) & (F.col("start") < F.col("end"))), "interval", at)
    known = F.coalesce(F.col("label").isin(labels), F.lit(False))
    tell(e, ~known, "label", at)
    e = e.where(known)
    w = Window.partitionBy("doc", "video", "label").orderBy("start", "end", F.col("i").cast("int"))
    tell(e.withColumn("before", F.lag("end").over(w)), F.col("start") < F.col("before"), "overlap", at)

    there = kind(F.col("risk")) == "ARRAY"
    none = F.col("risk").isNull()
    tell(entries, ~none & ~there, "risk", video)
    empty = none | (there & F.try_variant_get("risk", "$[0]", "variant").isNull())
    tell(entries, empty, "no risk", video, "warning")
    r = exploded(entries.where(there), "risk", ["doc", "video"], "j", "sample").withColumn("j", F.col("j").cast("long"))
    t, score = number(F.col("sample"), 0), number(F.col("sample"), 1)
    pair = (kind(F.col("sample")) == "ARRAY") & t.isNotNull() & score.isNotNull() & item(F.col("sample"), 2).isNull()
    r = r.withColumns({"t": F.when(pair, t), "score": F.when(pair, score)})
    r = r.withColumn("before", F.lag("t").over(Window.partitionBy("doc", "video").orderBy("j")))
    # a time under -1 goes back even as the first one
    wrong = F.when(F.col("t").isNull(), "sample").when(F.col("t") < F.coalesce("before", F.lit(-1.0)), "time").when(~F.col("score").between(0, 1), "score")
    first = r.withColumn("what", wrong).where("what is not null").groupBy("doc", "video").agg(F.min(F.struct("j", "what")).alias("m"))
    told.append(first.select("doc", F.lit("error").alias("severity"), F.concat(video, F.lit(".risk["), F.col("m.j").cast("string"), F.lit("]")).alias("place"), F.col("m.what").alias("what")))

    if truth is not None:
        asked = truth.select(F.col("video_id").cast("string").alias("video"), F.col("duration").cast("double").alias("duration"))
        tell(e.join(asked, "video"), F.col("end") > F.col("duration") + SLACK, "past the end", at)
        tell(entries.join(asked, "video", "left_anti"), F.lit(True), "unasked", video, "warning")
        wanted = docs.select("doc").join(asked.select("video"))  # documents times videos, as many as there should be
        tell(wanted.join(exploded(docs, "videos", ["doc"], "video", "entry").select("doc", "video"), ["doc", "video"], "left_anti"), F.lit(True), "missing", video)
    out = told[0]
    for rows in told[1:]:
        out = out.union(rows)
    return out

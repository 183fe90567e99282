"""Sinks that make one JSON document of a table, by many tasks, and a store of learned flow.

A document's parts are written by Spark as text, in order, with its own commit of tasks. Only when all are there does the driver join them
in the file system, a buffer at a time, into a file beside the target, which then takes the target's name: a job that
fails leaves the target as it was. Paths may be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.operators.scene import CELL

from .tables import predictions_document


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_document(entries: DataFrame, path: str, head: str = "{", tail: str = "}", key: str = "key", value: str = "json") -> None:
    """Writes one document at path: head, an entry `"key": value` for each row in order of key, and tail. Values are JSON on one
    line; rows with a null key or value are left out. Without a key column entries are the values alone, in the rows' order."""
    spark = entries.sparkSession
    rows = entries.where(F.col(value).isNotNull())
    line = F.col(value)
    if key in entries.columns:
        rows = rows.where(F.col(key).isNotNull())
        name = F.to_json(F.array(F.col(key).cast("string")))  # in brackets
        line = F.concat(F.substring(name, 2, F.length(name) - 2), F.lit(":"), line)
        rows = rows.orderBy(key, value)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    where, fs = _files(spark, parts)
    try:
        rows.select(F.concat(F.lit(","), line).alias("value")).write.text(parts)
        target, _ = _files(spark, path)
        made, _ = _files(spark, f"{path}.new-{uuid.uuid4().hex}")
        out = fs.create(made, True)
        try:
            put = lambda s: out.write(bytearray(s.encode()))
            put(head)
            names = sorted(f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-") and f.getLen() > 0)
            for i, name in enumerate(names):
                source = fs.open(spark._jvm.org.apache.hadoop.fs.Path(name))
                try:
                    source.seek(0 if i else 1)  # every line begins with a comma, and the first of all needs none
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
            put(tail)
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(made, target):
            raise OSError(f"could not rename {made} to {target}")
    finally:
        fs.delete(where, True)


def write_predictions(events: DataFrame, risk: DataFrame, path: str, team: str) -> None:
    """One predictions file, as read_predictions takes it."""
    videos = predictions_document(events, risk)
    write_document(videos.select(F.col("video_id").cast("string").alias("key"), "json"), path, f'{{"team": {json.dumps(team)}, "videos": {{', "}}")


def write_report(report: DataFrame, path: str, **facts) -> None:
    """A report's rows as one JSON file: the facts, and a list `rows` in the order of the rows' own text."""
    rows = report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("json"))
    head = json.dumps(facts)[:-1] + (", " if facts else "") + '"rows": ['
    write_document(rows.orderBy("json"), path, head, "]}")


def write_candidates(candidates: DataFrame, videos: DataFrame, path: str) -> None:
    """Candidates for review (video_id, label, start, end, ...) as one JSON file: each video's own facts and its list."""
    rest = [c for c in candidates.columns if c != "video_id"]
    lists = candidates.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "label", *[c for c in rest if c not in ("start", "label")]))).alias("candidates"))
    facts = [c for c in videos.columns if c != "video_id"]
    docs = videos.join(lists, "video_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)))
    write_document(docs.select(F.col("video_id").cast("string").alias("key"), F.to_json(F.struct(*facts, "candidates")).alias("json")), path)


def write_site(videos: DataFrame, folder: str, index: list[str], shown: Column | None = None) -> None:
    """For each row of videos (video_id, and columns) a JSON file below folder/videos, a directory per video, and folder/index.json
    with its `index` columns, the longest first where they have a duration."""
    rest = [c for c in videos.columns if c != "video_id"]
    videos.select("video_id", F.to_json(F.struct("video_id", *rest)).alias("value")).write.partitionBy("video_id").mode("overwrite").text(f"{folder}/videos")
    rows = videos if shown is None else videos.where(shown)
    order = F.format_string("%015.3f", 1e11 - F.coalesce("duration", F.lit(0.0))) if "duration" in rest else F.lit("")
    listed = rows.select(F.concat(order, F.lit(" "), F.col("video_id").cast("string")).alias("_o"), F.to_json(F.struct("video_id", *index)).alias("json"))
    write_document(listed.orderBy("_o").select("json"), f"{folder}/index.json", "[", "]")


class FlowStore:
    """Learned flow (video_id, cy, cx, n, sx, sy), added to run by run.

    A run's counts are a partition of their own that its commit replaces as a whole, so a run that is repeated counts once and one that fails counts not at all.
    Reading sums up the runs; `until` reads the store as it was up to a run, in order of names. compact() joins runs when they are many.
    """

    FIELDS = "video_id long, cy int, cx int, n long, sx double, sy double"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def runs(self) -> list[str]:
        path, fs = _files(self.spark, self.folder)
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [p for p in found if p.getName().startswith("run=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName()[4:] for p in done)

    def add(self, run: str, flow: DataFrame) -> None:
        if not run or "/" in run:
            raise ValueError("a run's name is part of a path")
        names = [f.split()[0] for f in self.FIELDS.split(", ")]
        flow.select(*[flow[c].cast(k) for c, k in (f.split() for f in self.FIELDS.split(", "))]).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in names[3:]]).write.mode("overwrite").parquet(f"{self.folder}/run={run}")

    def read(self, until: str | None = None) -> DataFrame:
        runs = [r for r in self.runs() if until is None or r <= until]
        if not runs:
            return self.spark.createDataFrame([], self.FIELDS)
        rows = self.spark.read.schema(self.FIELDS).parquet(*[f"{self.folder}/run={r}" for r in runs])
        return rows.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))

    def compact(self) -> None:
        """Makes one run, named as the last one, of all. Readers see the old runs until the new one is whole, and a compaction that fails changes nothing."""
        runs = self.runs()
        if len(runs) < 2:
            return
        made, fs = _files(self.spark, f"{self.folder}/.joined-{uuid.uuid4().hex}")
        self.read().write.parquet(made.toString())
        old = [_files(self.spark, f"{self.folder}/run={r}")[0] for r in runs]
        for p in old:
            fs.delete(p, True)
        fs.rename(made, old[-1])

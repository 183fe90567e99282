"""What the corpus operators share: the shared folder, cut lineage, id lists, components."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting: the shuffle files of a finished query go when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where none is set, a local session gets a
    temporary one and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lanescope-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def modest_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_BYTES in its session from now on: texts are long, and a worker holds a batch
    as a whole. Only Spark's default bound is replaced."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == DEFAULT_BATCH:
        conf.set(BATCH, f"{BATCH_BYTES}b")
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The same rows from a table in the shared folder: short lineage, and one computation for many readers."""
    spark = df.sparkSession
    path, was = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and that nothing will read any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(t))
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; plain lower() says the same of ASCII and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_enough(df: DataFrame, bound: int) -> bool:
    """Whether df has at most `bound` rows."""
    return df.count() <= bound


def distinct_ids(rows: DataFrame) -> bool:
    """Whether no doc_id but null repeats."""
    return rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): component is the least node reachable.

    Alternates large-star and small-star rounds, each a shuffle that is linear in the edges, until the forest
    of stars no longer changes. Nodes without edges don't appear. Edges are never collected.

    A node with very many neighbours needs no task of its own: the least neighbour is a partial aggregate, and
    the join that hands it back to the neighbours is one that adaptive execution splits.
    """
    a, b = F.col("a"), F.col("b")
    e = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), name)

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.select("a", "b").union(e.select(b, a)) if large else e.select(b.alias("a"), a.alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(least, "a")
        if large:  # larger neighbours of a node move to its least neighbour
            moved = joined.where("b > a").select(F.col("m").alias("a"), "b")
        else:  # a node and its smaller neighbours move to the least of them
            moved = joined.select(F.col("m").alias("a"), "b").where("a < b").union(least.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")))
        return moved.where("a < b").distinct()

    now, said = (0, None), None
    while now != said and now[0] != 1:
        said, old = now, e
        e = cut(star(star(e, True), False), name)
        drop(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a"), F.col("a")).distinct())

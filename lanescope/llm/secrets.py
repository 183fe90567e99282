"""Secrets in texts, with built-in functions only: three fixed kinds, and sliding-window Shannon entropy.

Candidate strings are runs of at least `window` characters of the base64 alphabets that aren't on the allow-list and
mix digits with letters. Over each window of `window` consecutive characters the entropy is log2(window) - S / window
with S the sum of c * log2(c) over the counts c of the characters; S is kept by increments: the count of the entering
character after it enters and of the leaving one before it leaves are two ranged window counts per character, so a
candidate of n characters costs n log n however long it is. Thresholds go by the candidate's class of characters. The
span runs from the start of its first window at or over the threshold to the end of its last.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import counted, digest, located

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of 24 or more
WINDOW, STRETCH = 20, 4096
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}"
#: Least entropy in bits of a window, by class: hexadecimal digits, letters and digits of one case, all else.
THRESHOLDS = {"hex": 2.9, "single": 3.3, "mixed": 3.6}
#: Never secrets: identifiers of the 8-4-4-4-12 form, dates, version numbers and file paths of plain words.
ALLOWED = [r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T0-9-]*$", r"^/?(?:[a-z]++[/_-])++[a-z]*[0-9]?$"]


def entropy_spans(found: DataFrame, window: int = WINDOW, thresholds: dict = THRESHOLDS, allowed: list[str] = ALLOWED) -> DataFrame:
    """(row, doc_id, start, end, entropy) of the candidate strings in found(row, doc_id, match, start) with a window over its class's threshold."""
    s = F.col("match")
    ok = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    for p in allowed:
        ok = ok & ~s.rlike(p)
    least = F.when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), thresholds["hex"]).when(~s.rlike("[a-z]") | ~s.rlike("[A-Z]"), thresholds["single"]).otherwise(thresholds["mixed"])
    # long candidates are cut into stretches that share window - 1 characters: every window lies in one of them whole
    last = F.greatest(F.floor((F.length(s) - window) / STRETCH), F.lit(0))
    part = found.where(ok).select("row", "doc_id", F.col("start").alias("at"), least.alias("least"), s.alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    piece = F.substr("s", (F.col("part") * STRETCH + 1).cast("int"), F.lit(STRETCH + window - 1))
    each = part.select("row", "doc_id", "at", "least", "part", F.posexplode(F.split(piece, "")).alias("p", "c")).where("c <> ''")
    per_char = Window.partitionBy("row", "at", "part", "c").orderBy("p")
    per_string = Window.partitionBy("row", "at", "part").orderBy("p")
    entering = F.count("*").over(per_char.rangeBetween(-(window - 1), 0))
    leaving = F.count("*").over(per_char.rangeBetween(0, window - 1))

    def step(n):  # what the n-th of a character adds to S
        n = n.cast("double")
        return n * F.log2(n) - F.when(n > 1, (n - 1) * F.log2(n - 1)).otherwise(0.0)

    counted = each.withColumn("gain", step(entering)).withColumn("loss", step(leaving))
    run = counted.select("*", F.sum("gain").over(per_string).alias("in"), F.sum("loss").over(per_string).alias("out"))
    s_now = F.col("in") - F.coalesce(F.lag("out", window).over(per_string), F.lit(0.0))
    high = run.withColumn("bits", F.lit(math.log2(window)) - s_now / window).where((F.col("p") >= window - 1) & (F.col("bits") >= F.col("least")))
    high = high.withColumn("p", F.col("part") * STRETCH + F.col("p"))
    return high.groupBy("row", "doc_id", "at").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.max("bits").alias("entropy")).select(
        "row", "doc_id", (F.col("at") + F.col("a") - (window - 1)).cast("long").alias("start"), (F.col("at") + F.col("b") + 1).cast("long").alias("end"), "entropy"
    )


def secrets(docs: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (ordered arrays of kind, start, end; kinds index KINDS).

    Base spans of the three fixed kinds always stay; an entropy span is added where no base span covers it. Null and
    empty texts have none. Rows that repeat a doc_id are scanned one by one; other columns are ignored.
    """
    found = located(docs, [ASSIGN, ACCESS, HEX, CANDIDATE % window], **columns)
    good = (
        F.when(F.col("kind") == 0, F.length(F.regexp_extract("match", ASSIGN, 2)) >= 6)
        .when(F.col("kind") == 1, F.length("match") >= 20)
        .when(F.col("kind") == 3, F.lit(False))
        .otherwise(True)
    )
    base = found.where(good).select("row", "doc_id", "kind", "start", "end")
    more = entropy_spans(found.where("kind = 3"), window).select("row", "doc_id", F.lit(3).alias("kind"), "start", "end")
    span = F.struct("start", "kind", "end")
    of = base.union(more).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").between(0, 2), span))).alias("base"), F.collect_list(F.when(F.col("kind") == 3, span)).alias("more"))
    added = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return of.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    out = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [counted("base", k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])]
    return out.select("doc_id", *count, F.sha2(digest(KINDS, F.col("base")), 256).alias("base_sha256"), digest(KINDS, F.col("spans")).alias("spans"))

"""Toxicity by class-conditional Kneser-Ney models of words.

Two bigram models, of toxic and of ordinary text, share their lowest level: the continuation counts of both classes
together. Spark sums hashed bigrams over the labelled training texts and derives continuation counts, backoff masses
and the log-ratio of the two models; words that no training text has say nothing. The model is a table of what each
word, each context's backoff mass and each bigram adds to the log-ratio: shrunk by its uncertainty, and without rows
that add 0. It grows with the corpus. Scoring broadcasts its `keep` most frequent rows and joins the others.
A text's score is a logistic function of its mean log-ratio per word, fitted to training texts that were set aside
from the counts (a bounded sample of `max_fit`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, modest_batches, small_enough
from .language import fold, hashed_share
from .textbytes import NOT_ALNUM, slices, text_bytes, words

DISCOUNT, KEEP, MAX_FIT, ASIDE = 0.75, 300_000, 20_000, 8
#: Mean ratios well over this are all the same to the logistic curve.
SPAN = 0.25
BROADCAST = 2_000_000  # labelled ids at most to send to every task
BITS = 134_217_689  # a prime: bits of the set of joined keys that spares texts' other keys the shuffle
OPENING = np.int64(1)  # stands before a text's first word


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(31-bit hash, text) of every word."""
    h, doc, _, _ = words(*text_bytes(column), NOT_ALNUM)
    return np.maximum((h >> np.uint64(33)).astype(np.int64), 2), doc


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous word << 31 | word, word, text) of every word."""
    w, doc = word_ids(column)
    before = np.concatenate([[OPENING], w[:-1]]) if len(w) else w
    before = np.where(np.concatenate([[-1], doc[:-1]]) == doc, before, OPENING) if len(w) else w
    return (before << 31) | w, w, doc


def counts(labelled: DataFrame) -> DataFrame:
    """(pair, t, o) of each bigram in labelled(text, toxic): how often it occurs in toxic and in ordinary texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 16_000_000):
                pair, _, doc = bigrams(batch.column(0))
                if not len(pair):
                    continue
                toxic = batch.column(1).to_numpy(zero_copy_only=False)[doc] == 1
                order = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.diff(pair[order], prepend=-1))
                many, n = np.add.reduceat(toxic[order], first, dtype=np.int64), np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(pair[order][first]), pa.array(many), pa.array(n - many)], names=["pair", "t", "o"])

    return labelled.mapInArrow(counted, "pair long, t long, o long").groupBy("pair").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def sure(r, t, o, log_odds, least: float = 4.5):
    """A log-ratio shrunk towards 0 by how far the counts are from their expected odds: nothing within `least` standard
    deviations, nearly all of it far beyond. So rare entries lean on what they back off to."""
    share = 1 / (1 + F.exp(-log_odds))
    n = t + o
    z = F.greatest(F.abs(t - n * share) - 0.5, F.lit(0.0)) / F.sqrt(n * share * (1 - share))
    return F.when(z > least, r * (1 - least * least / (z * z))).otherwise(0.0)


def middles(df: DataFrame, value: str, count) -> tuple:
    """(class of a count, the median of `value` in that class) as columns; two classes a doubling."""
    klass = F.floor(2 * F.log2(count)).cast("int")
    got = df.groupBy(klass.alias("klass")).agg(F.percentile_approx(value, 0.5, 1000).alias("m")).where("klass is not null and m is not null").collect()
    return F.create_map(*[F.lit(x) for r in got for x in (r["klass"], float(r["m"]))])[klass]


def train(labelled: DataFrame, discount: float = DISCOUNT, least: float = 4.5) -> DataFrame:
    """(key, r, weight): what a word (its id), the backoff after a word (its id negated) and a bigram add to a word's
    log-ratio, and how frequent each is. Rows that add 0 are left out."""
    d = discount
    n = cut(counts(labelled).withColumn("w", F.col("pair").bitwiseAND(2**31 - 1)).withColumn("v", F.shiftright("pair", 31)), "bigrams").select("pair", "w", "v", F.col("t").cast("double").alias("t"), F.col("o").cast("double").alias("o"))
    own = {c: F.sum(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) for c in "to"}
    by_word = n.groupBy("w").agg(own["t"].alias("ct"), own["o"].alias("co"), F.sum(F.lit(1.0)).alias("cs"))
    by_word = cut(by_word, "words")
    z = by_word.agg(*[F.sum(c).alias(c) for c in ("ct", "co", "cs")], *[F.sum(F.when(F.col(c) > 0, 1.0).otherwise(0.0)).alias("v" + c) for c in ("ct", "co", "cs")]).first()
    if not z["ct"] or not z["co"]:
        return labelled.sparkSession.createDataFrame([], "key long, r float, weight double")
    shared = F.col("cs") / z["cs"]

    def level(c: str):
        return (F.greatest(F.col(c) - d, F.lit(0.0)) + d * z["v" + c] * shared) / z[c]

    pt, po = level("ct"), level("co")
    # a small corpus gives frequent words a larger share of its distinct bigrams than a large one does: each word is
    # held against the middle of the words that are as frequent
    ranked = by_word.select("w", pt.alias("pt"), po.alias("po"), F.log(pt / po).alias("raw"), "ct", "co").withColumn("n", F.col("ct") + F.col("co"))
    odds = math.log(z["ct"] / z["co"])
    usual = middles(ranked, "raw", F.col("n"))
    word = ranked.select(F.col("w").alias("key"), sure(F.col("raw") - usual, F.col("ct"), F.col("co"), usual + odds, least).alias("r"), F.col("n").alias("weight"))
    # a class that never has the context backs off wholly
    ctx = n.groupBy("v").agg(F.sum("t").alias("vt"), F.sum("o").alias("vo"), own["t"].alias("kt"), own["o"].alias("ko"))
    for c in "to":
        ctx = ctx.withColumn("m" + c, F.when(F.col("v" + c) > 0, d * F.col("k" + c) / F.col("v" + c)).otherwise(1.0))
    ctx = cut(ctx.withColumn("b", F.log(F.col("mt") / F.col("mo"))), "contexts")
    usual = middles(ctx, "b", F.col("kt") + F.col("ko"))
    seen_odds = F.log(F.greatest("vt", F.lit(0.5)) / F.greatest("vo", F.lit(0.5)))
    ctx = ctx.withColumn("back", sure(F.col("b") - usual, F.col("kt"), F.col("ko"), usual + seen_odds, least))
    after = ctx.select((-F.col("v")).alias("key"), F.col("back").alias("r"), (F.col("kt") + F.col("ko")).alias("weight"))
    # whatever its word, a bigram whose counts are within chance at both ends of the words' odds is so between them
    ends = ranked.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    may = [sure(F.lit(1.0), F.col("t"), F.col("o"), F.lit(ends[e] + odds), least * (1 - 1e-9)) > 0 for e in ("lo", "hi")]
    seen = n.where(may[0] | may[1]).join(ctx.select("v", "vt", "vo", "mt", "mo", "back"), "v").join(ranked.select("w", "pt", "po", "raw"), "w")
    full = {c: F.when(F.col("v" + c) > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col("v" + c)).otherwise(0.0) + F.col("m" + c) * F.col("p" + c) for c in "to"}
    more = sure(F.log(full["t"] / full["o"]) - F.col("raw") - F.col("back"), F.col("t"), F.col("o"), F.col("raw") + odds, least)
    pair = seen.select(F.col("pair").alias("key"), more.alias("r"), (F.col("t") + F.col("o")).alias("weight"))
    return word.union(after).union(pair).select("key", F.col("r").cast("float").alias("r"), "weight").where("r <> 0")


def prepared(entries: DataFrame, keep: int) -> tuple[dict[str, np.ndarray], DataFrame | None]:
    """The `keep` most frequent rows of the model as sorted arrays, with a set of the other keys' hashes (at most BITS
    bits), and those other rows, or None if there are none."""
    entries = cut(entries, "model")
    top = entries.orderBy(F.desc("weight"), "key").limit(keep).toPandas()
    got = top.sort_values("key")
    model = {"keys": got["key"].to_numpy(np.int64), "r": got["r"].to_numpy(np.float32)}
    if len(top) < keep or entries.count() == keep:
        return model, None
    last = top.iloc[-1] if keep else {"weight": float("inf"), "key": 0}
    cold = entries.where((F.col("weight") < float(last["weight"])) | ((F.col("weight") == float(last["weight"])) & (F.col("key") > int(last["key"])))).select("key", "r")
    marks = cold.select(F.pmod("key", F.lit(BITS)).alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toPandas()
    model["rest"] = np.zeros(BITS // 64 + 1, np.int64)
    model["rest"][marks["at"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    return model, cold


def known_ratios(column: pa.Array, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text what the broadcast rows add to its log-ratio and its number of words; (text, key, times) of keys
    that the other rows may have."""
    pair, w, doc = bigrams(column)
    r = np.zeros(len(w))
    left = []
    for key in (w, -(pair >> 31), pair):
        at = np.minimum(np.searchsorted(model["keys"], key), max(0, len(model["keys"]) - 1))
        hit = model["keys"][at] == key if len(model["keys"]) else np.zeros(len(key), bool)
        r[hit] += model["r"][at[hit]]
        if "rest" in model:
            p = key % BITS
            may = ~hit & ((model["rest"][p >> 6] >> (p & 63)) & 1 == 1)
            left.append((doc[may], key[may]))
    d, k = (np.concatenate(x) for x in zip(*left, strict=True)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((k, d))
    d, k = d[order], k[order]
    first = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(k, prepend=0) != 0))
    times = np.diff(np.append(first, len(d)))
    return np.bincount(doc, weights=r, minlength=len(column)).astype(np.float64), np.bincount(doc, minlength=len(column)), (d[first], k[first], times)


def ratios(docs: DataFrame, model: dict, cold: DataFrame | None, extra: list[str], text: str = "text") -> DataFrame:
    """The columns `extra` of docs and ratio, the mean log-ratio per word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["_sum", "_n", "_keys", "_times"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                total, n, (doc, key, times) = known_ratios(batch.column(0), shared.value)
                at = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (key, times)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(total), pa.array(n.astype(np.int64)), *lists], names=[*extra, "_row", *added])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *extra, F.monotonically_increasing_id().alias("_row"))
    out = rows.mapInArrow(scored, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:]) + ", _sum double, _n long, _keys array<long>, _times array<long>")
    if cold is not None:
        # a text without such keys gets one that no row has and that differs from other texts'
        asked = out.select(*extra, "_row", "_sum", "_n", F.explode_outer(F.arrays_zip("_keys", "_times")).alias("_x"))
        asked = asked.select(*extra, "_row", "_sum", "_n", F.coalesce("_x._keys", -F.lit(2**32) - F.col("_row")).alias("key"), F.col("_x._times").alias("_times"))
        more = F.coalesce(F.sum(F.col("r").cast("double") * F.col("_times")), F.lit(0.0))
        out = asked.join(cold, "key", "left").groupBy("_row").agg(*[F.first(c).alias(c) for c in (*extra, "_n")], (F.first("_sum") + more).alias("_sum"))
    return out.select(*extra, (F.col("_sum") / F.greatest(F.col("_n"), F.lit(1))).alias("ratio"))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, offset) of a logistic curve with both classes given equal weight, by damped Newton steps."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    scale = x.std() or 1.0
    q = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(q @ b, -30, 30)))
        g = q.T @ (weight * (y - p)) - 1e-4 * b
        h = (q * (weight * p * (1 - p))[:, None]).T @ q + 1e-4 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(b[0] / scale), float(b[1])


def toxicity(docs: DataFrame, labels: DataFrame, usable, keep: int = KEEP, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per row of docs: doc_id, ratio, score (0 to 1), predicted. Labels are learned from rows where `usable`, a
    column of doc_id, holds. Null and empty texts have ratio 0. Labels that are null or repeat an id with another value
    aren't learned from. Where either class is missing every ratio is 0 and scores are 0.5. Rows that repeat a doc_id each
    teach and get a score of their own; other columns are ignored; an empty table gives no rows.
    """
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").select("doc_id", "toxic")
    side = F.broadcast(one) if small_enough(one, BROADCAST) else one
    texts = modest_batches(docs).select("doc_id", "text").where(usable & F.col("text").isNotNull()).join(side, "doc_id")
    share = min(1 / ASIDE, max_fit / max(one.count(), 1))  # set aside no more than is fitted to
    aside = hashed_share(F.col("doc_id"), F.lit("aside")) < share
    model, cold = prepared(train(texts.where(~aside).select("text", "toxic")), keep)
    got = ratios(texts.where(aside), model, cold, ["toxic"]).toPandas()
    slope, offset = logistic(np.tanh(got["ratio"].to_numpy() / SPAN), got["toxic"].to_numpy())
    out = ratios(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, cold, ["doc_id"])
    score = 1 / (1 + F.exp(-(F.tanh(F.col("ratio") / SPAN) * slope + offset)))
    return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")

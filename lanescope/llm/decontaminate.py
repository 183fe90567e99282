"""Benchmark decontamination with built-in functions only.

Every text is lowered (A-Z) and split into words. The windows of the benchmark, 13 consecutive words or a shorter
item as a whole, form a set keyed by a 64-bit hash. Each document's windows are hashed in its own row, unrolled,
looked up in that set, and a hit is verified word by word while the words are still at hand, so nothing but hits is
shuffled. One row per input row comes back.

The set is broadcast when it has at most `broadcast_windows` rows and BROADCAST_BYTES in all, both counted first; a larger
one is joined by shuffling hashes with the words of each window.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, distinct_ids, small_enough

NGRAM = 13
BROADCAST_WINDOWS, BROADCAST_BYTES, BROADCAST_IDS = 2_000_000, 256 << 20, 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def window_set(items: DataFrame, ngram: int = NGRAM, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, size, words, items): each distinct window of the items with the ids, as text, of the items it occurs in."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(ngram)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    each = w.select("item", "size", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("size")))).alias("words"))
    return each.groupBy("size", "words").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("words"))


def contamination(docs: DataFrame, items: DataFrame, ngram: int = NGRAM, broadcast_windows: int = BROADCAST_WINDOWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, hit_spans (word positions from 0, end exclusive).

    Null and empty texts have no words. Items without words, and null item ids, take no part. Rows that repeat a
    doc_id are judged one by one. Empty tables give empty results or no hits. Other columns are ignored.
    """
    windows = window_set(items.where(F.col(item_key(items)).isNotNull()), ngram)
    held = F.sum(F.octet_length(F.array_join("words", " ")) + 16 * (F.size("words") + F.size("items")))
    about = windows.agg(F.sort_array(F.collect_set("size")).alias("sizes"), F.count("*").alias("n"), held.alias("bytes")).first()
    sizes = about["sizes"]  # at most `ngram` numbers
    small = about["n"] <= broadcast_windows and (about["bytes"] or 0) <= BROADCAST_BYTES
    base = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"), F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("n_words", F.size("w").cast("long"))

    def hashed(k: int):
        n = F.size("w") - F.lit(k - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("w", i, k)))).otherwise(F.array().cast("array<bigint>"))

    # the first element stands for the row itself, so that rows without a hit stay
    every = F.concat(F.array(F.lit(None).cast("bigint")), *[hashed(k) for k in sizes])
    at = base.select("doc_id", "row", "n_words", "w", F.posexplode(every).alias("p", "h"))
    start, size, before = F.lit(0), F.lit(0), F.lit(1)
    for k in sizes:  # position in the concatenation -> window length and start
        n = F.greatest(F.col("n_words").cast("int") - F.lit(k - 1), F.lit(0))
        mine = F.col("p") >= before
        start, size = F.when(mine, F.col("p") - before).otherwise(start), F.when(mine, F.lit(k)).otherwise(size)
        before = before + n
    side = windows.select("h", F.col("size").alias("k"), F.col("words").alias("b_words"), "items")
    if small:
        joined = at.withColumn("s", start).withColumn("size", size).join(F.broadcast(side), "h", "left")
        hit = F.col("h").isNotNull() & (F.col("k") == F.col("size")) & (F.slice("w", F.col("s") + 1, F.col("size")) == F.col("b_words"))
    else:
        joined = at.withColumn("s", start).withColumn("size", size).withColumn("w", F.slice("w", F.col("s") + 1, F.greatest("size", F.lit(1)))).join(side, "h", "left")
        hit = F.col("h").isNotNull() & (F.col("k") == F.col("size")) & (F.col("w") == F.col("b_words"))
    kept = joined.withColumn("hit", F.coalesce(hit, F.lit(False))).where("hit or p = 0")
    span = F.when(F.col("hit"), F.struct(F.col("s").cast("long").alias("start"), (F.col("s") + F.col("size")).cast("long").alias("end")))
    per_row = kept.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("items")))))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(acc["to"], x["start"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")),
    )
    return per_row.select("doc_id", "n_words", covered["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("spans").alias("hit_spans"))


def item_key(items: DataFrame) -> str:
    return "item_id" if "item_id" in items.columns else items.columns[0]


def is_contaminated(n_hit, n_words):
    """The rule: some hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that are contaminated; columns as they were. Rows are judged one by one: where ids are null or
    repeat, rows are numbered in a table first. Null and empty texts are clean; an empty table stays empty."""
    key, columns = doc_id, docs.columns
    named = docs.select(F.col(doc_id).alias("doc_id"))
    if not named.where("doc_id is null").isEmpty() or not distinct_ids(named):
        key = f"row_{uuid.uuid4().hex[:8]}"
        docs = cut(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    bad = contamination(docs, items, doc_id=key, **options).where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(key))
    bad = cut(bad, "contaminated")
    return docs.join(F.broadcast(bad) if small_enough(bad, BROADCAST_IDS) else bad, key, "left_anti").select(*columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item, size, array_to_string(w[i : i + size - 1], ' ') as g from (select item, w, size, unnest(range(1, len(w) - size + 2)) as i from (select item, w, least(len(w), 13) as size from b where len(w) > 0))),
sizes as (select distinct size from bw),
dw as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as g from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select distinct dw.doc_id, dw.i, dw.size from dw join (select distinct size, g from bw) x on dw.g = x.g and dw.size = x.size),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct dw.doc_id, bw.item from dw join bw on dw.g = bw.g and dw.size = bw.size) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(i.n_items, 0) as bigint) as n_items,
  sha256(coalesce(i.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join cov c using (doc_id) left join its i using (doc_id)
"""

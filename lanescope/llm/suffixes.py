"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Suffixes are sampled by content: of every string of `size` bytes the K-byte substring with the least hash, the leftmost
of equals, is its anchor, so equal strings have equal anchors. A suffix array entry is the anchor's hash g, a hash c of
its context (every string of `size` bytes around the anchor), and where it is. Arrays are sorted by (g, c, document,
position); entries that are equal in g and c are kept once, with the first place.

A batch of documents (an interval of doc_ids, ascending) becomes an array by slices and is merge-scanned with the levels
that exist: entries of the batch whose g and c are already there are copies, context and all. Where one g has several contexts,
shorter matches may cross them: those entries go on to the exact comparison, in which every string of `size` bytes that
the anchor stands for is hashed and all but the first place are repeats. The batch then is a level of its own, and levels of
equal size merge when the next batch comes, so each entry is rewritten once for each doubling.

Hashes have 64 bits and two of them must agree. A g or a context that is very common reaches a task once for each
slice, however often it occurs; nothing is compared in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, distinct_ids, drop, modest_batches
from .textbytes import Rolling, mixed, slices, text_bytes

SIZE, K = 100, 40
BATCHES, SLICE = 2, 2_000_000
BROADCAST = 16_000_000  # numbers in lists to send to every task, at most; 4 or 8 bytes each
ROW = "key long, kind byte, g long, c long, doc long, pos int"
SINGLE, MARK, MULTI, COPY = 0, 1, 2, 3  # an entry; g has several contexts; an entry of such a g; a copy of an entry before it
LEVEL = "kind byte, g long, c long, doc long, pos int, old boolean"
POSITION = np.uint64((1 << 26) - 1)  # bits of a position within a stretch; the others are the hash's
STRETCH = 1 << 25


def anchors(roll: Rolling, offsets: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, first string, last string) of each anchor and the strings, by start, it stands for."""
    n, w = int(offsets[-1]), size - k + 1
    none = np.zeros(0, np.int64)
    length = np.diff(offsets)
    if n < size or not (length >= size).any():
        return none, none, none, none
    h = roll.every(k)
    starts = np.repeat(offsets[:-1] - np.cumsum(np.maximum(length - size + 1, 0)) + np.maximum(length - size + 1, 0), np.maximum(length - size + 1, 0)) + np.arange(int(np.maximum(length - size + 1, 0).sum()))
    found = []
    for at in range(0, len(h), STRETCH):  # positions within a stretch fit their bits, however long the text is
        own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + STRETCH)] - at
        if len(own):
            least = h[at : at + STRETCH + w]
            v = (least & ~POSITION) | np.arange(len(least), dtype=np.uint64)
            blocks = np.concatenate([v, np.full(-len(v) % w + w, 2**64 - 1, np.uint64)]).reshape(-1, w)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            found.append((np.minimum(behind[own], ahead[own + w - 1]) & POSITION).astype(np.int64) + at)
    p = np.concatenate(found)
    first = np.flatnonzero(np.diff(p, prepend=-1))
    last = np.append(first[1:], len(p)) - 1
    p = p[first]
    return p, np.searchsorted(offsets, p, "right") - 1, starts[first], starts[last]


def sliced(docs: DataFrame, size: int, k: int) -> DataFrame:
    """ROW: the suffix arrays of the slices of docs(doc_id, text)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                data, offsets = text_bytes(batch.column(1))
                roll = Rolling(data)
                p, text, _, _ = anchors(roll, offsets, size, k)
                if not len(p):
                    continue
                lo, hi = np.maximum(p + k - size, offsets[text]), np.minimum(p + size, offsets[text + 1])
                g, c = roll.hash(p, p + k), roll.hash(lo, hi) ^ mixed((p - lo).astype(np.uint64))
                doc, pos = batch.column(0).to_numpy()[text], (p - offsets[text]).astype(np.int32)
                order = np.lexsort((pos, doc, c, g))
                g, c, doc, pos = g[order], c[order], doc[order], pos[order]
                new_g = np.diff(g, prepend=~g[:1]) != 0
                first = new_g | (np.diff(c, prepend=~c[:1]) != 0)
                contexts = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_g))
                many = np.repeat(contexts > 1, np.diff(np.append(np.flatnonzero(new_g), len(g))))
                kind = np.where(first, np.where(many, MULTI, SINGLE), COPY).astype(np.int8)
                key = np.where(kind == SINGLE, g, mixed(g ^ c)).view(np.int64)
                key = np.where(kind == COPY, mixed(doc.astype(np.uint64) ^ pos.astype(np.uint64)).view(np.int64), key)
                cols = [key, kind, g.view(np.int64), c.view(np.int64), doc, pos]
                marks = np.flatnonzero(new_g & many)
                tell = [g[marks].view(np.int64), np.full(len(marks), MARK, np.int8), *(x[marks] for x in cols[2:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(cols, tell, strict=True)], names=["key", "kind", "g", "c", "doc", "pos"])

    return docs.mapInArrow(entries, ROW)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, sorted by key, in tables that hold every key's rows together. What is held over is one key's rows so far,
    of which there is one for each slice at most."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        k = t.column(key).to_numpy()
        at = int(np.flatnonzero(k == k[-1])[0])
        held = t.slice(at)
        if at:
            yield t.slice(0, at)
    if held is not None:
        yield held


def scanned(rows: DataFrame, by_context: bool) -> DataFrame:
    """LEVEL rows from rows sorted by key within partitions, in one pass that holds a row: entries, and copies of them.

    Not by context: what meets under one g; an entry turns MULTI if g has a mark or another context. By context: the
    first of the MULTI entries that are equal in g and c stays, the others are copies.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            yield from judged(t)

    def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, kind, g, c, doc, pos, old = (t.column(n).to_numpy() for n in ("key", "kind", "g", "c", "doc", "pos", "old"))
        order = np.lexsort((pos, doc, c, g, kind == COPY, key))
        key, kind, g, c, doc, pos, old = (x[order] for x in (key, kind, g, c, doc, pos, old))
        entry = (kind == SINGLE) | (kind == MULTI)
        e = np.flatnonzero(entry)
        out = kind.copy()
        if len(e):
            first = (np.diff(g[e], prepend=~g[e][:1]) != 0) | (np.diff(c[e], prepend=~c[e][:1]) != 0)
            out[e] = np.where(first, kind[e], COPY)
            if not by_context:
                starts = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
                several = np.add.reduceat((out == SINGLE) | 0, starts) > 1
                several |= np.add.reduceat((kind == MARK) | 0, starts) > 0
                wide = np.repeat(several, np.diff(np.append(starts, len(key))))
                out = np.where(wide & (out == SINGLE), MULTI, out)
        keep = (out != MARK) & ~((out == COPY) & old)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (out.astype(np.int8), g, c, doc, pos, old)], names=["kind", "g", "c", "doc", "pos", "old"])

    return rows.mapInArrow(scan, LEVEL)


class SuffixLevels:
    """The index family: tables of entries in the shared folder, each with the number of batches it covers.

    add(docs) takes the next batch, whose documents must all come after those added before, and returns (copies, crossed):
    tables with the documents and anchor positions of copies, and of the entries, of all batches, that need the exact comparison.
    Both are the caller's to drop. The family's own tables go when a merge or the last batch has read them.
    """

    def __init__(self, spark: SparkSession, size: int = SIZE, k: int = K):
        self.spark, self.size, self.k = spark, size, k
        self.levels: list[tuple[int, DataFrame, list[DataFrame]]] = []  # with the tables that hold it

    def _merge(self) -> None:
        self.levels.sort(key=lambda x: -x[0])
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, of_a), (m, b, of_b) = self.levels.pop(), self.levels.pop()
            both = a.union(b).groupBy("g", "c").agg(F.max("kind").alias("kind"), F.min(F.struct("doc", "pos")).alias("at"))
            level = cut(both.select("kind", "g", "c", "at.doc", "at.pos"), "level")
            drop(*of_a, *of_b)
            self.levels.append((n + m, level, [level]))

    def add(self, docs: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """last: no batch will follow, so entries that only later batches could meet aren't written and every level goes."""
        self._merge()
        new = sliced(docs, self.size, self.k).withColumn("old", F.lit(False))
        for _, level, _ in self.levels:
            was = level.withColumn("old", F.lit(True))
            new = new.union(was.select(F.when(F.col("kind") == SINGLE, F.col("g")).otherwise(F.xxhash64("g", "c")).alias("key"), "kind", "g", "c", "doc", "pos", "old"))
            several = was.where(F.col("kind") == MULTI).groupBy("g").agg(F.first("c").alias("c"), F.first("doc").alias("doc"), F.first("pos").alias("pos"))
            new = new.union(several.select(F.col("g").alias("key"), F.lit(MARK).cast("byte").alias("kind"), "g", "c", "doc", "pos", F.lit(True).alias("old")))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        found = scanned(new.repartition(n, "key").sortWithinPartitions("key"), False).select("g", "c", "doc", "pos", "old", "kind")
        known = (F.col("kind") == SINGLE) & (F.lit(True) if last else F.col("old"))  # what other levels have stays there
        seen = cut(found.where(~known), "scan", "kind")
        wide = seen.where(F.col("kind") == MULTI).select(F.xxhash64("g", "c").alias("key"), F.col("kind").cast("byte").alias("kind"), "g", "c", "doc", "pos", "old")
        exact = cut(scanned(wide.repartition(n, "key").sortWithinPartitions("key"), True), "several")
        copies = cut(seen.where(F.col("kind") == COPY).union(exact.where(F.col("kind") == COPY).select(seen.columns)).select("doc", "pos"), "copies")
        wide = exact.where(F.col("kind") == MULTI)
        crossed = cut(wide.select("doc", "pos"), "wide")
        if last:
            drop(seen, exact, *(t for _, _, held in self.levels for t in held))
            self.levels = []
        else:
            own = seen.where((F.col("kind") == SINGLE) & ~F.col("old")).select(F.col("kind").cast("byte").alias("kind"), "g", "c", "doc", "pos").union(wide.where(~F.col("old")).select("kind", "g", "c", "doc", "pos"))
            self.levels.append((1, own, [seen, exact]))
        return copies, crossed


def with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs joined with one row per document; the lists are broadcast only if all they hold is little."""
    held = lists.agg(F.sum(F.size(lists.columns[1]) + 1)).first()[0] or 0
    return docs.join(F.broadcast(lists) if held <= BROADCAST else lists, "doc_id", how)


def as_runs(doc: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of what strings of `size` bytes at these places cover, touching ones joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero((np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(start, prepend=0) > size))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], start[last] + size


def crossing_repeats(docs: DataFrame, lists: DataFrame, size: int, k: int) -> DataFrame:
    """(doc, start, end): what is repeated of the strings that the anchors in lists(doc_id, at) stand for, but for the first place of each."""
    names = ["h", "h2", "doc", "start", "end"]

    def batch_of(h, h2, doc, start, again) -> pa.RecordBatch:
        """Places of strings that may have others before them, and runs of those that do, under any key."""
        d, a, b = as_runs(doc[again], start[again], size) if again.any() else (doc[:0], start[:0], start[:0])
        keep = ~again
        cols = [np.append(h[keep], mixed(d.astype(np.uint64)).view(np.int64)), np.append(h2[keep], np.zeros(len(d), np.int32)), np.append(doc[keep], d), np.append(start[keep], a), np.append(np.full(int(keep.sum()), -1), b)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int64, np.int32, np.int32), strict=True)], names=names)

    def later(h, h2, doc, start) -> tuple:
        order = np.lexsort((start, doc, h2, h))
        h, h2, doc, start = h[order], h2[order], doc[order], start[order]
        return h, h2, doc, start, (np.diff(h, prepend=~h[:1]) == 0) & (np.diff(h2, prepend=h2[:1]) == 0)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                data, offsets = text_bytes(batch.column(1))
                roll = Rolling(data)
                p, text, first, last = anchors(roll, offsets, size, k)
                if not len(p):
                    continue
                want = np.concatenate([np.asarray(batch.column(2)[i].as_py(), np.int64) + offsets[i] for i in range(batch.num_rows)])
                mine = np.isin(p, want)
                first, n, text = first[mine], (last - first + 1)[mine], text[mine]
                if not len(n):
                    continue
                start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                h, h2 = roll.hash(start, start + size), roll.hash(start, start + size // 2)
                doc = np.repeat(text, n)
                yield batch_of(*later(h.view(np.int64), (h2 >> np.uint64(33)).astype(np.int32), batch.column(0).to_numpy()[doc], (start - offsets[doc]).astype(np.int32)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "h"):
            h, h2, doc, start, end = (t.column(c).to_numpy() for c in names)
            place = end < 0
            again = np.zeros(0, bool)
            if place.any():
                h, h2, d, s, again = later(h[place], h2[place], doc[place], start[place])
            runs = as_runs(d[again], s[again], size) if again.any() else (doc[:0], start[:0], start[:0])
            cols = [np.append(doc[~place], runs[0]), np.append(start[~place], runs[1]), np.append(end[~place], runs[2])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(x)) for c, x in zip(cols, (np.int64, np.int32, np.int32), strict=True)], names=["doc", "start", "end"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = with_lists(docs, lists, "inner").select("doc_id", "text", "at").mapInArrow(strings, "h long, h2 int, doc long, start int, end int")
    return found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(meet, "doc long, start int, end int")


def repeats(docs: DataFrame, size: int = SIZE, k: int = K, batches: int = BATCHES) -> DataFrame:
    """(doc_id, spans): for each document with repeats the maximal runs of bytes to remove, as an array of (start, end)."""
    spark = docs.sparkSession
    bounds = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    family = SuffixLevels(spark, size, k)
    added = []
    for i, (lo, hi) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        part = docs if lo is None else docs.where(F.col("doc_id") > lo)
        part = part if hi is None else part.where(F.col("doc_id") <= hi)
        added.append(family.add(part, last=i == len(bounds)))
    copies, crossed = (reduce(DataFrame.union, x) for x in zip(*added, strict=True))
    lists = cut(crossed.distinct().groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("pos").alias("at")), "crossed")
    drop(*(b for _, b in added))
    # a table, so that the shuffle of strings, the largest of all, is gone before the next one
    crossing = cut(crossing_repeats(docs, lists, size, k), "crossing")
    drop(lists)
    around = copies.select(F.col("doc").alias("doc_id"), F.greatest(F.col("pos") + (k - size), F.lit(0)).alias("start"), (F.col("pos") + size).alias("end"))
    found = around.union(crossing.select(F.col("doc").alias("doc_id"), "start", "end"))
    # maximal runs by a window: a document with very many spans costs a sort, not a fold
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.distinct().withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    island = apart.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = cut(runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    drop(crossing, *(a for a, _ in added))
    return spans


def without_repeats(docs: DataFrame, size: int = SIZE, k: int = K, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (removed runs of UTF-8 bytes), kept (the bytes left).

    A byte goes if a string of `size` bytes that covers it also starts earlier, in a smaller doc_id or before it in the same
    document. Null texts are empty. Rows with a null doc_id are kept whole and count for nothing. Rows that repeat a doc_id
    are documents of their own, in the order of their texts. Other columns are ignored; an empty table gives no rows.
    """
    rows = modest_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not distinct_ids(rows):  # number the rows in the order of their ids
        ordered = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        ordered = cut(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")
        out = without_repeats(ordered.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text").where("doc_id is not null"), size, k, batches)
        lone = ordered.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
        return out.withColumnRenamed("doc_id", "row").join(ordered.where("doc_id is not null").select("row", "doc_id"), "row").select("doc_id", "n_bytes", "spans", "kept").union(lone)
    spans = repeats(rows.where("doc_id is not null"), size, k, batches)

    def removed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches_:
            for batch in slices(whole, 1):
                data, offsets = text_bytes(batch.column(1))
                out, kept, n = [], [], np.diff(offsets)
                for i, own in enumerate(batch.column(2).to_pylist()):
                    b = data[offsets[i] : offsets[i + 1]]
                    own = [(s["start"], min(s["end"], len(b))) for s in own or ()]
                    edges = [0, *(x for s in own for x in s), len(b)]
                    out.append([{"start": s, "end": e} for s, e in own])
                    kept.append(b"".join(b[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = with_lists(rows, spans, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(removed, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

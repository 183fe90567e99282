"""Language model scores from a log-frequency Bloom filter.

Counts of words and of pairs of neighbouring words are quantised to levels, 1 + floor(log2 n), and an n-gram of level q is
entered into the filter q times, each time with a number from 1 to q. A level is read back by repeated probes, upwards
until one fails: it is never too low, and too high for few. What a level stands for is the mean count of the n-grams
that have it. A pair's probability leans on its last word's where the word before is rare.

The filter is cut into segments by ranges of the n-grams' hashes, as many as the texts ask for. Tasks count their own
stretch of tokens first and send one packed row a segment, so that frequent n-grams are not met token by token; a segment adds up
its rows, enters its n-grams and keeps the exact counts of its words for the plain model. Where all segments together are within `bound` bytes
they are broadcast. Beyond it texts are dealt to chunks, each chunk asks each segment once about its distinct n-grams, and the replies meet the chunk's texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, drop, modest_batches
from .language import fold
from .textbytes import SPACE, mixed, slices, text_bytes, words

#: Bits of the filter an entry, and probes an entry is looked for with: 1.2 in 100 are found that were never entered.
BITS, PROBES = 10, 4
#: Largest broadcast in bytes, bytes of text a segment, least segments, tokens that a task counts together, bytes of a stretch of text.
BOUND, SEGMENT_BYTES, SEGMENTS, TOGETHER, STRETCH = 192 << 20, 16 << 20, 64, 3_000_000, 1 << 20
#: Weight of a word's own probability against the counts of pairs.
STRENGTH = 8.0
END = np.uint64(0x5851F42D4C957F2D)
GOLD = np.uint64(0x9E3779B97F4A7C15)
LEVELS = 64
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# tokens and keys


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, place of each text's first token and the end): words, and END after each text. Long texts are
    read in stretches that end between words."""
    data, at = text_bytes(column)
    found, owner, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + STRETCH, len(data))
        while hi < len(data) and not SPACE[data[hi]] and hi not in at:
            gap = np.flatnonzero(SPACE[data[hi : hi + 4096]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + 4096, len(data))
        first, last = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, hi, "left")
        inside = np.clip(at[first : last + 1], lo, hi) - lo
        h, text, _, _ = words(data[lo:hi], inside, SPACE)
        found.append(h)
        owner.append(text + first)
        lo = hi
    text = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    n = np.bincount(text, minlength=len(column)) if len(column) else np.zeros(0, np.int64)
    ends = np.cumsum(n + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END)
    if found:
        out[np.arange(len(text)) + text] = np.concatenate(found)
    return out, np.concatenate([[0], ends]).astype(np.int64)


def pairs(token: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The key of each token with the one before, which for a text's first is END."""
    before = np.concatenate([[END], token[:-1]]) if len(token) else token
    return mixed(before * GOLD + token)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Ranges of keys, so that sorted keys are sorted by segment."""
    return (((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def dealt(keys: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """(segment, its part) of sorted keys."""
    own = segment_of(keys, segments)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield int(own[lo]), slice(lo, hi)


# the filter


def places(keys: np.ndarray, level: int | np.ndarray, probe: int, bits: np.ndarray | int) -> np.ndarray:
    h = mixed(keys + GOLD * np.asarray(level, np.uint64))
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * (h >> np.uint64(32))) % np.asarray(bits, np.uint64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def entered(keys: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The filter of keys, each as often as its level says."""
    held = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for probe in range(PROBES):
            held[places(own, level, probe, bits)] = True
    return np.packbits(held, bitorder="little")


@dataclass
class Filter:
    """Segments end to end: bits, the byte each starts at and how many bits it has; words' exact counts, sorted by hash."""

    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key by probes: one more as long as all probes of the next one hit."""
        out = np.zeros(len(keys), np.int64)
        own = segment_of(keys, len(self.size))
        left = np.flatnonzero(self.size[own] > 0)
        level = 0
        while len(left) and level < LEVELS:
            level += 1
            for probe in range(PROBES):
                at = places(keys[left], level, probe, self.size[own[left]])
                byte = self.bits[self.start[own[left]] + (at >> np.uint64(3)).astype(np.int64)]
                left = left[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[left] = level
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at].astype(np.int64), 0)


@dataclass
class Totals:
    """Tokens and distinct tokens of the training texts, and the mean count of the words and of the pairs of each level."""

    tokens: int
    distinct: int
    mean: np.ndarray


BUILT = "segment long, bits binary, of long, size long, words binary, counts binary, n_keys array<long>, sums array<long>"


def built(train: DataFrame, text: str = "text") -> tuple[DataFrame, Totals]:
    """(segments of the filter, totals) of the training texts; the table is in the shared folder."""
    rows = modest_batches(train.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = max(SEGMENTS, -(-size // SEGMENT_BYTES))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = [[], []]

        def flushed() -> Iterator[pa.RecordBatch]:
            for order in (0, 1):
                if not waiting[order]:
                    continue
                keys, n = np.unique(np.concatenate(waiting[order]), return_counts=True)
                waiting[order].clear()
                parts = list(dealt(keys, segments))
                packed = [[p for p, _ in parts], [order] * len(parts), [keys[s].tobytes() for _, s in parts], [n[s].astype("<i4").tobytes() for _, s in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int64()), pa.array(packed[1], pa.int32()), pa.array(packed[2], pa.binary()), pa.array(packed[3], pa.binary())], names=["segment", "kind", "keys", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                token, starts = tokens(part.column(0))
                waiting[0].append(token)
                waiting[1].append(pairs(token, starts))
                if sum(map(len, waiting[0])) > TOGETHER:
                    yield from flushed()
        yield from flushed()

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sums, all_keys, all_levels, own = np.zeros((2, 2, LEVELS + 1), np.int64), [], [], {}
        kind = table.column("kind").to_numpy()
        for order in (0, 1):
            chosen = table.filter(pa.array(kind == order))
            keys = np.frombuffer(b"".join(chosen.column("keys").to_pylist()), "<u8")
            n = np.frombuffer(b"".join(chosen.column("n").to_pylist()), "<i4")
            sort = np.argsort(keys, kind="stable")
            keys = keys[sort]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
            n = np.add.reduceat(n[sort].astype(np.int64), first) if len(keys) else np.zeros(0, np.int64)
            keys, level = keys[first], level_of(n)
            sums[0, order] = np.bincount(level, minlength=LEVELS + 1)
            for lv in np.unique(level):
                sums[1, order, lv] = n[level == lv].sum()
            all_keys.append(keys)
            all_levels.append(level)
            if order == 0:
                own = {"words": [keys.tobytes()], "counts": [n.astype("<i8").tobytes()]}
        keys, level = np.concatenate(all_keys), np.concatenate(all_levels)
        bits = -(-BITS * int(level.sum()) // 64) * 64
        made = entered(keys, level, bits).tobytes()
        return pa.table({"segment": [key[0].as_py()], "bits": [made], "of": [segments], "size": [bits], **own, "n_keys": [sums[0].ravel().tolist()], "sums": [sums[1].ravel().tolist()]})

    counts = rows.mapInArrow(counted, "segment long, kind int, keys binary, n binary")
    table = cut(counts.groupBy("segment").applyInArrow(build, BUILT), "filter")
    # a number for each order and level
    levels = table.select(F.posexplode(F.arrays_zip("n_keys", "sums")).alias("i", "x")).groupBy("i").agg(F.sum("x.n_keys").alias("n"), F.sum("x.sums").alias("s")).toPandas()
    n, s = np.zeros((2, LEVELS + 1)), np.zeros((2, LEVELS + 1))
    n.ravel()[levels["i"]], s.ravel()[levels["i"]] = levels["n"], levels["s"]
    # a level that nothing has, which only a chance hit tells, stands for its least count
    mean = np.where(n > 0, s / np.maximum(n, 1), 2.0 ** (np.arange(LEVELS + 1) - 1))
    mean[:, 0] = 0
    return table, Totals(int(s[0].sum()), int(n[0].sum()), mean)


def assembled(rows: Iterable[Row], of: int, sizes: tuple[int, int]) -> Filter:
    """A filter of rows of the table, which may come one by one; sizes: bytes of the bits and of the words' hashes, all rows
    together. Segments that nothing was entered in have no row."""
    start, size = np.zeros(of, np.int64), np.zeros(of, np.int64)
    bits, held, counts = np.zeros(sizes[0], np.uint8), np.zeros(sizes[1] // 8, np.uint64), np.zeros(sizes[1] // 8, np.uint32)
    at = word = 0
    for r in rows:
        start[r["segment"]], size[r["segment"]] = at, r["size"]
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        own, n = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["counts"], "<i8")
        if n.max(initial=0) >= 2**32:
            counts = counts.astype(np.int64)
        held[word : word + len(own)], counts[word : word + len(own)] = own, n
        at, word = at + len(r["bits"]), word + len(own)
    return Filter(bits, start, size, held, counts)


# scores


class Asked:
    """The distinct words and pairs of some texts, and from their levels the texts' scores."""

    def __init__(self, column: pa.Array):
        token, self.starts = tokens(column)
        self.words, self.word = np.unique(token, return_inverse=True)
        self.pairs, self.pair = np.unique(pairs(token, self.starts), return_inverse=True)
        self.end = int(np.searchsorted(self.words, END))

    def scored(self, exact: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray, t: Totals, strength: float) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        total = t.tokens + t.distinct + 1
        count = t.mean[0][word_levels]
        before = np.concatenate([[self.end], self.word[:-1]])
        had = count[before]
        both = np.minimum(t.mean[1][pair_levels][self.pair], had)
        p = (both + strength * ((count + 1) / total)[self.word]) / (had + strength)
        per = lambda x: np.add.reduceat(x, self.starts[:-1])
        return np.diff(self.starts), per((exact > 0).astype(np.int64)[self.word]), per(np.log10((exact + 1) / total)[self.word]), per(np.log10(np.minimum(p, 1.0)))


def answer(part: pa.RecordBatch, result: tuple[np.ndarray, ...], train_tokens: int) -> pa.RecordBatch:
    n, known, base, score = result
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), train_tokens, np.int64)), pa.array(base), pa.array(score)], names=SCORED.replace(",", "").split()[::2])


def scored(docs: DataFrame, held_out: Column, bound: int = BOUND, strength: float = STRENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, by a model of the rows
    that are not held out.

    Null and empty texts are an end alone. Rows that repeat are scored, and learned from, one by one; without a doc_id too. With
    nothing to learn from every token has the same chance, 1. Tokens are told apart by 64-bit hashes. Texts may be of any length: a worker holds
    some forty bytes a token of one text. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table, totals = built(rows.where(~F.col("held_out")))
    total = table.agg(F.coalesce(F.max("of"), F.lit(1)), *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("bits", "words")]).first()
    if total[1] + 2 * total[2] <= bound:
        rows_ = table.select("segment", "bits", "size", "words", "counts").orderBy("segment").toLocalIterator()  # a part at a time
        shared = docs.sparkSession.sparkContext.broadcast(assembled(rows_, total[0], total[1:]))
        drop(table)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                for part in slices(batch, 2):
                    q = Asked(part.column(2))
                    yield answer(part, q.scored(held.exact(q.words), held.levels(q.words), held.levels(q.pairs), totals, strength), totals.tokens)

        return modest_batches(rows).mapInArrow(judge, SCORED)
    return scored_by_chunks(rows, table, totals, strength)


def scored_by_chunks(rows: DataFrame, table: DataFrame, totals: Totals, strength: float) -> DataFrame:
    """The same where the filter is too large to broadcast."""
    segments = table.first()["of"]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 2):
                chunk += 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, chunk)), *part.columns], names=["chunk", *part.schema.names])

    chunks = cut(modest_batches(rows).mapInArrow(chunked, "chunk long, doc_id long, held_out boolean, text string"), "chunks")

    def ask(_: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        q = Asked(part.column("text").combine_chunks())
        parts = [(order, s, keys[x].tobytes()) for order, keys in enumerate((q.words, q.pairs)) for s, x in dealt(keys, segments)]
        return pa.table({"chunk": pa.array([part.column("chunk")[0].as_py()] * len(parts), pa.int64()), "kind": pa.array([p[0] for p in parts], pa.int32()), "segment": pa.array([p[1] for p in parts], pa.int64()), "keys": pa.array([p[2] for p in parts], pa.binary())})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "chunk long, kind int, segment long, keys binary")

    def reply(_: tuple[pa.Scalar, ...], questions: pa.Table, own: pa.Table) -> pa.Table:
        parts = own.to_pylist()
        held = assembled(parts, parts[0]["of"], (len(parts[0]["bits"]), len(parts[0]["words"]))) if parts else None
        levels, exact = [], []
        for kind, packed in zip(questions.column("kind").to_pylist(), questions.column("keys").to_pylist(), strict=True):
            keys = np.frombuffer(packed, "<u8")
            levels.append((held.levels(keys) if held else np.zeros(len(keys), np.int64)).astype(np.uint8).tobytes())
            exact.append((held.exact(keys) if held else np.zeros(len(keys), np.int64)).astype("<i8").tobytes() if kind == 0 else b"")
        out = questions.select(["chunk", "kind", "segment"])
        return out.append_column("levels", pa.array(levels, pa.binary())).append_column("exact", pa.array(exact, pa.binary()))

    replies = asked.groupBy("segment").cogroup(table.groupBy("segment")).applyInArrow(reply, "chunk long, kind int, segment long, levels binary, exact binary")

    def judge(_: tuple[pa.Scalar, ...], part: pa.Table, replies: pa.Table) -> pa.Table:
        q = Asked(part.column("text").combine_chunks())
        replies = replies.sort_by([("kind", "ascending"), ("segment", "ascending")])
        of = lambda kind, name, dtype: np.frombuffer(b"".join(x for k, x in zip(replies.column("kind").to_pylist(), replies.column(name).to_pylist(), strict=True) if k == kind), dtype)
        result = q.scored(of(0, "exact", "<i8"), of(0, "levels", np.uint8), of(1, "levels", np.uint8), totals, strength)
        return pa.Table.from_batches([answer(part.select(["doc_id", "held_out"]).combine_chunks().to_batches()[0], result, totals.tokens)])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(judge, SCORED)


def op12_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fold(F.col("doc_id"), 7) == 2)

"""Exact Jaccard join of texts on sets of word n-grams, by count-vector R-trees.

1. One pass over the texts gives each document's set size, a 128-bit sum that names its set, its counts of n-grams in
   `GROUPS` hash groups (a point), and its prefix: the first n - ceil(0.75 n) + 1 n-grams in one order for all documents,
   rare ones first. Two sets that link share a prefix n-gram. Documents of equal sets are one class from then on.
2. Each prefix n-gram that several classes have names the least of them as its first; a class belongs to the firsts of
   its prefix n-grams. Two sets that link have a first in common, and copies mostly have one and the same.
3. Groups of one first are packed into tasks of bounded size, or dealt to several where they are larger, with their
   first in each. An R-tree over the points of a task says which members may link: it alone makes candidates, which are
   then verified on their sets. Links become components.
4. A large group whose members are in several components by now isn't settled: members outside its main component
   are queries against those inside, and among themselves, in tiles of bounded size, each with its own R-tree.

A pair's overlap is at most the sum of the smaller counts of each hash group, and a node's at most that with the greatest
counts below it, so both are dropped when this can't reach what the sizes ask for. Nodes hold the counts of `FOLD` groups
together, pairs are held to all counts as well. The order of n-grams only steers how
many meet: it ranks those that a part of the input repeats most, at most `RANKED` of them. Step 4 is quadratic in the
members of one group that no link joins to its main component; they are compared in tiles that share the work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, distinct_ids, drop, modest_batches, small_enough
from .textbytes import SPACE, mixed, slices, text_bytes, words

NGRAM, GROUPS, FOLD, RANKED, OFTEN = 5, 2048, 8, 500_000, 3
#: Members of a task, and n-grams of their sets, that packs and tiles are cut for.
PACK, TILE, HELD, LEAF = 512, 1024, 2_000_000, 16
BROADCAST = 1_000_000  # rows of (n-gram, first) or ids at most to send to every task
SIGNATURE = "doc_id long, n long, s1 long, s2 long, prefix array<long>, common array<long>, point binary"


def shingles(column: pa.Array, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes end to end, offsets) of the n-grams of words of each text, repeats included; a shorter text is one as a whole."""
    h, doc, _, _ = words(*text_bytes(column), SPACE)
    count = np.bincount(doc, minlength=len(column))
    made = np.where(count >= ngram, count - ngram + 1, np.minimum(count, 1))
    first = np.cumsum(count) - count
    at = np.cumsum(made) - made
    start = np.repeat(first - at, made) + np.arange(int(made.sum()))
    size = np.repeat(np.minimum(count, ngram), made)
    out = size.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(ngram, np.uint64)])
    for k in range(ngram):
        out = np.where(k < size, out * np.uint64(0x9E3779B97F4A7C15) + padded[start + k], out)
    return mixed(out), np.concatenate([[0], np.cumsum(made)])


def point_bytes(counts: np.ndarray) -> bytes:
    return counts.astype("<u4" if counts.max(initial=0) > 255 else np.uint8).tobytes()


def points_of(rows: list[bytes]) -> np.ndarray:
    if all(len(r) == GROUPS for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == GROUPS else "<u4").astype(np.uint32) for r in rows])


def folded(points: np.ndarray) -> np.ndarray:
    """Counts of FOLD groups together: a bound from these is never under that from the groups."""
    sums = points.reshape(len(points), -1, FOLD).sum(2, dtype=np.uint32)
    return sums.astype(np.uint16) if sums.max(initial=0) < 1 << 16 else sums


def needed(a, b):
    """The least overlap at which sets of sizes a and b link: 7 * overlap >= 3 * (a + b)."""
    return -(-3 * (a + b) // 7)


def ranks(docs: DataFrame, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, how often) of those that some part of the input repeats."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1_000_000):
                both, n = np.unique(shingles(batch.column(1), ngram)[0], return_counts=True)
                often = n >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(both[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

    sums = modest_batches(docs).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = sums.orderBy(F.desc("n"), "h").limit(RANKED).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def signatures(docs: DataFrame, ngram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks(docs, ngram))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, rank = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 500_000):
                h, at = shingles(batch.column(1), ngram)
                often = np.zeros(len(h), np.int64)
                if len(ranked):
                    k = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                    often = np.where(ranked[k] == h, rank[k], 0)
                rows = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    u, i = np.unique(h[a:b], return_index=True)
                    n = len(u)
                    p = n - -(-3 * n // 4) + 1 if n else 0
                    f = often[a:b][i]
                    head = np.argsort(f, kind="stable")[:p] if f.any() else np.arange(p)
                    rare = f[head] == 0
                    rows.append((n, u.sum(dtype=np.uint64), mixed(u ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64), u[head[rare]].view(np.int64), u[head[~rare]].view(np.int64), point_bytes(np.bincount((u >> np.uint64(53)).astype(np.int64), minlength=GROUPS))))
                n, s1, s2, head, common, point = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in (head, common)), pa.array(point, pa.binary())], names=["doc_id", "n", "s1", "s2", "prefix", "common", "point"])

    return modest_batches(docs).mapInArrow(signed, SIGNATURE)


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the distinct ids, which are broadcast if they are few."""
    return rows.join(F.broadcast(ids) if small_enough(ids, BROADCAST) else ids, "doc_id", "left_semi")


def sets_of(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, set): the sorted hashes of each document's n-grams."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 500_000):
                h, at = shingles(batch.column(1), ngram)
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return modest_batches(docs).mapInArrow(made, "doc_id long, set binary")


def overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


class CountTree:
    """An R-tree over count vectors, folded: halved by size while sizes are far apart, then at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.fine, self.points, self.sizes = points, folded(points), sizes.astype(np.int64)
        order, cuts = np.arange(len(points)), [0, len(points)]
        bounds = [np.array(cuts)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > LEAF:
            new = [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > LEAF:
                    own, n = self.points[order[a:b]], self.sizes[order[a:b]]
                    by = n if 2 * n.min() < n.max() else own[:, int(np.argmax(own.max(0) - own.min(0)))]
                    order[a:b] = order[a:b][np.argsort(by, kind="stable")]
                    new.append((a + b) // 2)
                new.append(b)
            cuts = new
            bounds.append(np.array(cuts))
        self.order = order
        sorted_points, sorted_sizes = self.points[order], self.sizes[order]
        #: from the root down: first entry of each node and the end, greatest counts, least and greatest size
        self.levels = [(at, *(f.reduceat(x, at[:-1]) for f, x in ((np.maximum, sorted_points), (np.minimum, sorted_sizes), (np.maximum, sorted_sizes)))) for at in bounds]

    def search(self, fine: np.ndarray, sizes: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of all pairs, of those for which wanted(query, entry) holds, whose bound of the overlap reaches
        what their sizes need: first by folded counts from the root down, then by all."""
        points, sizes = folded(fine), sizes.astype(np.int64)
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for depth, (at, most, least, greatest) in enumerate(self.levels):
            if depth:  # children: the nodes of this level that begin within the one above
                above = self.levels[depth - 1][0]
                lo, hi = np.searchsorted(at, above[node]), np.searchsorted(at, above[node + 1])
                q, node = np.repeat(q, hi - lo), _ranges(lo, hi)
            ok = (3 * sizes[q] <= 4 * greatest[node]) & (3 * least[node] <= 4 * sizes[q])
            q, node = q[ok], node[ok]
            ok = _bounded(points, q, most, node, needed(sizes[q], np.maximum(least[node], -(-3 * sizes[q] // 4))))
            q, node = q[ok], node[ok]
        at = self.levels[-1][0]
        lo, hi = at[node], at[node + 1]
        q, e = np.repeat(q, hi - lo), self.order[_ranges(lo, hi)]
        ok = (3 * sizes[q] <= 4 * self.sizes[e]) & (3 * self.sizes[e] <= 4 * sizes[q])
        q, e = q[ok], e[ok]
        if wanted is not None:
            ok = wanted(q, e)
            q, e = q[ok], e[ok]
        for a, b in ((points, self.points), (fine, self.fine)):
            ok = _bounded(a, q, b, e, needed(sizes[q], self.sizes[e]))
            q, e = q[ok], e[ok]
        return q, e


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo, lo + 1, .. hi - 1 for each pair, end to end."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))


def _bounded(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, least: np.ndarray, step: int = 1024) -> np.ndarray:
    """Whether the summed minima of a[i] and b[j] reach `least`, a block of pairs at a time."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), step):
        w = slice(k, k + step)
        out[w] = np.minimum(a[i[w]], b[j[w]]).sum(1, dtype=np.uint32) >= least[w]
    return out


#: A task's rows: a task, the group (its first), the document, its component so far, and its side: 0 meets all others, 1 asks, 2 is asked.
ROWS = ["k", "part", "f", "doc_id", "comp", "side"]


def least_common(groups: list[np.ndarray], least: np.ndarray, f: np.ndarray, q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether f[q], a group of both rows of a pair, is the least that they share: a pair counts in that one alone."""
    ok = (least[q] == f[q]) | (least[e] == f[q])
    unsure = np.flatnonzero(~ok & (least[q] != least[e]))
    for k in unsure.tolist():
        ok[k] = np.intersect1d(groups[q[k]], groups[e[k]], assume_unique=True)[0] == f[q[k]]
    return ok


def candidates(f: np.ndarray, comp: np.ndarray, side: np.ndarray, groups: list[np.ndarray], points: np.ndarray, sizes: np.ndarray, chunk: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows it may link with) in a task, as the R-tree over its rows says; `comp` may change between steps."""
    least = np.array([g.min() for g in groups])
    stored, asking = np.flatnonzero(side != 1), np.flatnonzero(side != 2)
    if not len(stored) or not len(asking):
        return
    tree = CountTree(points[stored], sizes[stored])
    for at in range(0, len(asking), chunk):
        own = asking[at : at + chunk]

        def wanted(i: np.ndarray, j: np.ndarray, own: np.ndarray = own) -> np.ndarray:
            q, e = own[i], stored[j]
            return (f[q] == f[e]) & (comp[q] != comp[e]) & ((side[q] != 0) | (q < e))

        q, e = tree.search(points[own], sizes[own], wanted)
        q, e = own[q], stored[e]
        ok = least_common(groups, least, f, q, e)
        q, e = q[ok], e[ok]
        order = np.argsort(q, kind="stable")
        q, e = q[order], e[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        for lo, hi in zip(first, np.append(first, len(q))[1:], strict=True):
            yield int(q[lo]), e[lo:hi]


def read(table: pa.Table) -> tuple[np.ndarray, ...]:
    groups = [np.asarray(x.as_py(), np.int64) for x in table.column("groups")]
    return *(table.column(c).to_numpy() for c in ("doc_id", "f", "comp", "side")), groups, points_of(table.column("point").to_pylist()), table.column("n").to_numpy()


def verified(doc: np.ndarray, f: np.ndarray, comp: np.ndarray, side: np.ndarray, groups: list[np.ndarray], points: np.ndarray, sizes: np.ndarray, sets: list[bytes]) -> Iterator[tuple[int, int]]:
    """Links of one task between components, none that joins what others have joined."""
    comp = comp.copy()
    for q, near in candidates(f, comp, side, groups, points, sizes):
        for e in near[np.argsort(-np.minimum(points[near], points[q]).sum(1, dtype=np.int64), kind="stable")].tolist():
            if comp[e] != comp[q] and overlap(sets[q], sets[e]) >= needed(int(sizes[q]), int(sizes[e])):
                comp[comp == comp[e]] = comp[q]
                yield int(doc[q]), int(doc[e])


def links_within(rows: DataFrame, points: DataFrame, docs: DataFrame, ngram: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each task of rows (ROWS). Sets are fetched only for members that the
    tree lets meet another one."""

    def alive(table: pa.Table) -> pa.Table:
        doc, f, comp, side, groups, points, sizes = read(table)
        met = np.zeros(len(doc), bool)
        for q, near in candidates(f, comp, side, groups, points, sizes):
            met[q] = met[near] = True
        return table.select(["k", "part", "doc_id", "f", "comp", "side", "n", "point", "groups"]).filter(pa.array(met))

    def linked(table: pa.Table) -> pa.Table:
        got = list(verified(*read(table), table.column("set").to_pylist()))
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    held = rows.join(points, "doc_id").groupBy("k", "part")
    met = cut(held.applyInArrow(alive, "k long, part int, doc_id long, f long, comp long, side int, n long, point binary, groups array<long>"), "met")
    ids = cut(met.select("doc_id").distinct(), "ids")
    sets = sets_of(chosen(docs, ids), ngram)
    links = cut(met.join(sets, "doc_id").groupBy("k", "part").applyInArrow(linked, "a long, b long"), "links")
    drop(met, ids)
    return links


def slots(count, grams):
    """Tasks that so many members with so many n-grams are dealt to."""
    return F.greatest(F.ceil(count / TILE), F.ceil(grams / HELD), F.lit(1)).cast("int")


def numbers(n):
    return F.sequence(F.lit(0), n - 1)


def slot_of(n):
    return F.pmod(F.xxhash64("doc_id"), n).cast("int")


def first_pass(entries: DataFrame, large: DataFrame) -> DataFrame:
    """ROWS: small groups in packs, the members of large ones dealt to slots with their first in each."""
    own = with_company(entries.join(large, "f", "left_anti")).withColumn("slots", F.lit(None).cast("int"))
    own = cut(own.union(entries.join(large.select("f", slots(F.col("m"), F.col("grams")).alias("slots")), "f")), "dealt")
    total = own.agg(F.count("*").alias("m"), F.sum("n").alias("n")).first()
    packs = max(1, -(-total["m"] // PACK), -(-(total["n"] or 0) // HELD))
    firsts = large.select("f", F.explode(numbers(slots(F.col("m"), F.col("grams")))).alias("part"))
    dealt = own.select(
        F.when(F.col("slots").isNull(), F.pmod(F.xxhash64("f"), F.lit(packs))).otherwise(F.col("f")).alias("k"),
        F.when(F.col("slots").isNull(), -1).otherwise(slot_of(F.col("slots"))).alias("part"), "f", "doc_id",
    )
    dealt = dealt.where("part = -1 or doc_id <> f").union(firsts.select(F.col("f").alias("k"), "part", "f", F.col("f").alias("doc_id")))
    return dealt.select("k", "part", "f", "doc_id", F.col("doc_id").alias("comp"), F.lit(0).alias("side"))


def second_pass(entries: DataFrame, large: DataFrame, parts: DataFrame) -> DataFrame:
    """ROWS: what is left to compare in large groups that are in several components."""
    member = entries.join(large.select("f"), "f").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    member = cut(member.select("f", "doc_id", "n", "comp"), "members")
    tally = member.groupBy("f", "comp").count().groupBy("f").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    left = member.join(tally.select("f", "main"), "f").withColumn("out", F.col("comp") != F.col("main"))
    per = [slots(F.count(F.when(c, 1)), F.sum(F.when(c, F.col("n")).otherwise(0))) for c in (F.col("out"), ~F.col("out"))]
    left = left.join(left.groupBy("f").agg(per[0].alias("nq"), per[1].alias("ns")), "f")
    i = F.when(F.col("out"), slot_of(F.col("nq"))).otherwise(slot_of(F.col("ns")))
    # kind 0: outside against inside, 1: among those outside; q and s: the slots of a tile
    own = F.when(
        F.col("out"),
        F.concat(
            F.transform(numbers(F.col("ns")), lambda s: F.struct(F.lit(0).alias("kind"), i.alias("q"), s.alias("s"), F.lit(1).alias("side"))),
            F.transform(numbers(F.col("nq")), lambda k: F.struct(F.lit(1).alias("kind"), F.least(i, k).alias("q"), F.greatest(i, k).alias("s"), F.when(i == k, 0).when(i < k, 1).otherwise(2).alias("side"))),
        ),
    ).otherwise(F.transform(numbers(F.col("nq")), lambda q: F.struct(F.lit(0).alias("kind"), q.alias("q"), i.alias("s"), F.lit(2).alias("side"))))
    dealt = left.select("f", "doc_id", "comp", F.explode(own).alias("t"))
    return dealt.select(F.xxhash64("f", "t.kind", "t.q", "t.s").alias("k"), F.col("t.kind").alias("part"), "f", "doc_id", "comp", "t.side")


def meeting(reps: DataFrame) -> DataFrame:
    """(f, doc_id, n): the groups that each class belongs to. The first of an n-gram is a partial aggregate, however many
    classes have it. Those of ranked n-grams are at most RANKED rows to broadcast; the others go back to their classes by a
    join of two tables' shuffles, which adaptive execution splits where an n-gram that wasn't ranked is common all the same."""

    def firsts(grams: DataFrame) -> DataFrame:
        return grams.groupBy("h").agg(F.min("doc_id").alias("f"), F.count("*").alias("k")).where("k > 1").select("h", "f")

    rare, common = (reps.select("doc_id", F.explode(c).alias("h")) for c in ("prefix", "common"))
    shared = cut(firsts(rare), "firsts")
    met = rare.join(shared, "h").union(common.join(F.broadcast(firsts(common)), "h")).select("f", "doc_id").distinct()
    entries = cut(met.join(reps.select("doc_id", "n"), "doc_id").select("f", "doc_id", "n"), "entries")
    drop(shared)
    return entries


def with_company(entries: DataFrame) -> DataFrame:
    """entries without those that no other of their group is near enough in size to: the nearest in order of size tell."""
    w = Window.partitionBy("f").orderBy("n", "doc_id")
    near = (4 * F.col("n") >= 3 * F.lead("n").over(w)) | (4 * F.lag("n").over(w) >= 3 * F.col("n"))
    return entries.withColumn("near", F.coalesce(near, F.lit(False))).where("near").drop("near")


def components_of_links(reps: DataFrame, docs: DataFrame, ngram: int) -> DataFrame:
    """(node, component) of the classes in reps(doc_id, n, prefix, common, point) that link with others."""
    entries = meeting(reps)
    large = cut(entries.groupBy("f").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where((F.col("m") > TILE) | ((F.col("grams") > HELD) & (F.col("m") > 2))), "large")
    dealt = first_pass(entries, large)
    ids = cut(dealt.select("doc_id").distinct(), "ids")
    of = entries.groupBy("doc_id").agg(F.collect_list("f").alias("groups"))  # no more than a document has prefix n-grams
    points = cut(chosen(reps.select("doc_id", "n", "point"), ids).join(of, "doc_id"), "points")
    links = links_within(dealt, points, docs, ngram)
    parts = components(links, "near")
    drop(links, ids)
    rest = cut(second_pass(entries, large, parts), "rest")
    if small_enough(rest, 0):
        drop(rest, entries, large, points)
        return parts
    links = links_within(rest, points, docs, ngram)
    to = parts.withColumnRenamed("component", "c")
    of = lambda c: F.coalesce(F.col(f"c{c}"), F.col(c)).alias(c)
    joined = links.join(to.toDF("a", "ca"), "a", "left").join(to.toDF("b", "cb"), "b", "left").select(of("a"), of("b"))
    more = components(joined, "near")  # of the components so far
    drop(rest, links, entries, large, points)
    nodes = parts.join(more.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return nodes.union(more.select("node", "component").join(parts.select("node"), "node", "left_anti"))


def solved(rows: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, n, class_id, component_id) of rows(doc_id, text) with distinct ids; null ids take no part."""
    sig = cut(signatures(rows, ngram), "signatures")
    real = sig.where("n > 0 and doc_id is not null")
    classes = cut(real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = chosen(real.select("doc_id", "n", "prefix", "common", "point"), classes.select(F.col("class_id").alias("doc_id")))
    parts = components_of_links(reps, rows, ngram)
    named = classes.join(parts, F.col("class_id") == F.col("node"), "left").select("n", "s1", "s2", "class_id", F.coalesce("component", "class_id").alias("component"))
    out = sig.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    told = cut(out.select("doc_id", "n", own("class_id").alias("class_id"), own("component").alias("component_id")), "told")
    drop(sig, classes)
    return told


def near_texts(docs: DataFrame, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (least doc_id with the same set), component_id (least doc_id reachable by links).

    Null texts and texts without words have an empty set and link with nothing. A null doc_id takes no part and has null
    class and component. Rows that repeat a doc_id are documents of their own that share a name. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if distinct_ids(rows):
        return solved(rows, ngram).withColumnRenamed("n", "n_shingles")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    own = solved(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), ngram)
    lone = own.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    own = cut(own.where("doc_id is not null").withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row"), "rows")
    least = lambda c: own.groupBy(c).agg(F.min("doc_id").alias(f"least_{c}"))
    named = own.join(least("class_id"), "class_id").join(least("component_id"), "component_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.col("least_class_id").alias("class_id"), F.col("least_component_id").alias("component_id")).union(lone)


def one_of_each(docs: DataFrame, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least doc_id; columns stay. Rows with a null doc_id stay, and of
    rows that repeat the least doc_id any one stays."""
    name = f"row_{uuid.uuid4().hex[:8]}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if distinct_ids(rows):
        gone = solved(rows, ngram).where("component_id <> doc_id").select(F.col("doc_id").alias(name))
        return docs.join(F.broadcast(gone) if small_enough(gone, BROADCAST) else gone, docs[doc_id].cast("long") == gone[name], "left_anti")
    docs = cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    rows = docs.select(F.col(name).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    own = solved(rows.select(F.col("row").alias("doc_id"), "text"), ngram).select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    own = cut(own, "rows")
    stay = own.groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("stay"))
    gone = own.join(stay, "component_id").where("row <> stay").select(F.col("row").alias(name))
    return docs.join(gone, name, "left_anti").drop(name)


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")

"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and split into `blocks` blocks of coordinates. Two vectors of cosine c are 2 - 2c apart in
squared distance, so in at least one block they are at most (2 - 2c) / blocks apart. For every block, vectors go to cells
along its first coordinate, as wide as that budget's root; a range join meets each cell with itself and the one below,
tests the block's distance, and verifies what is left over all coordinates in double precision. A pair counts in the
first block that meets the budget only. Cells are dealt out in tiles of at most about `tile` vectors a side, so no task
holds a cell or a group of copies as a whole.

Equal vectors are one class from the start. From a tile come counts of links and the edges of a spanning forest of
what it linked, not the pairs. The work is quadratic in the vectors of a cell; what the blocks save is most of the
coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, cut

LEAST, BLOCKS, TILE, SLACK, LENGTHS = 0.95, 4, 16384, 1e-5, 1000


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the edges (a, b) reach."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = np.minimum(new, new[new])
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, whatever the magnitude: each is first scaled by a power of two near its largest entry."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0.0))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def linked_within(q: np.ndarray, s: np.ndarray, same: bool, turn: np.ndarray, block: int, blocks: int, budget: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of rows of q and s (unit vectors) that this block answers for."""
    edges = np.linspace(0, q.shape[1], blocks + 1).astype(int)
    own = turn[:, edges[block] : edges[block + 1]]
    q_order, s_order = np.argsort(q @ own[:, 0]), np.argsort(s @ own[:, 0])
    q, s = q[q_order], s[s_order]
    qb, sb = q @ own, s @ own
    qx, sx = qb[:, 0], sb[:, 0]
    one = lambda x: np.ones((len(x), 1))
    sq = lambda x: (x * x).sum(1, keepdims=True)
    # the product of these is the squared distance
    ql = np.hstack([-2 * qb, sq(qb), one(qb)]).astype(np.float32)
    sl = np.hstack([sb, one(sb), sq(sb)]).astype(np.float32)
    reach = np.sqrt(budget) + 1e-3
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), 256):
        hi = min(lo + 256, len(q))
        left, right = lo if same else 0, int(np.searchsorted(sx, qx[hi - 1] + reach, "right"))
        if right <= left:
            continue
        near = np.flatnonzero(ql[lo:hi] @ sl[left:right].T <= budget + SLACK)
        i, j = lo + near // (right - left), left + near % (right - left)
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            ok = (q[a] * s[b]).sum(1) >= least
            a, b = a[ok], b[ok]
            if len(a):
                diff = (q[a] - s[b]) @ turn
                per = np.stack([(diff[:, x:y] ** 2).sum(1) for x, y in zip(edges, edges[1:], strict=False)], axis=1)
                mine = np.argmax(per <= budget + SLACK / 2, axis=1) == block
                found.append((a[mine], b[mine]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return q_order[np.concatenate([f[0] for f in found])], s_order[np.concatenate([f[1] for f in found])]


def near_vectors(vectors: DataFrame, least: float = LEAST, blocks: int = BLOCKS, tile: int = TILE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows with cosine >= least), component_id (least vec_id reachable).

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, nor do those with a null
    id; vectors of other lengths never link with each other. Entries may be as large or small as doubles go. Rows that repeat a vec_id are vectors of their own that share
    a name. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(embedding).alias("v")).schema["v"].dataType
    kind = "float" if getattr(kind, "elementType", None) == FloatType() else "double"  # nothing is cut to fewer digits
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v")))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    dims = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().limit(LENGTHS + 1).collect()]
    if len(dims) > LENGTHS:
        raise ValueError(f"vectors of over {LENGTHS} different lengths: join each length by itself")
    parts_of = lambda d: min(blocks, d)
    budget = {d: (2 - 2 * least) / parts_of(d) for d in dims}
    width = {d: float(np.sqrt(b)) + 1e-3 for d, b in budget.items()}
    turns = {d: rotation(d) for d in dims}
    shared = spark.sparkContext.broadcast(turns)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            cells: list = [None] * batch.num_rows
            flat = batch.column(0).flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                who = np.flatnonzero(sizes == d)
                x = unit(flat[at[who][:, None] + np.arange(d)])
                first = shared.value[int(d)][:, np.linspace(0, d, parts_of(int(d)) + 1).astype(int)[:-1]]
                for i, c in zip(who.tolist(), np.floor(x @ first / width[int(d)]).astype(np.int64).tolist(), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=["v", "rep", "n", "cells"])

    at = cut(classes.mapInArrow(celled, f"v array<{kind}>, rep long, n long, cells array<long>"), "cells")
    each = at.select("v", "rep", "n", F.size("v").alias("d"), F.posexplode("cells").alias("block", "cell"))
    sizes = {(r["d"], r["block"], r["cell"]): -(-r["count"] // tile) for r in each.groupBy("d", "block", "cell").count().collect()}  # blocks x 2 / width cells
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    spell = lambda d, b, c: F.concat_ws(":", d.cast("string"), b.cast("string"), c.cast("string"))
    tiles_of = F.create_map(*[F.lit(x) for (d, b, c), n in sizes.items() for x in (f"{d}:{b}:{c}", int(n))])
    tiles = lambda c: F.coalesce(tiles_of[spell(F.col("d"), F.col("block"), c)], F.lit(0))
    mine, above, below = tiles(F.col("cell")), tiles(F.col("cell") + 1), tiles(F.col("cell") - 1)
    i = F.pmod(F.xxhash64("rep", "block"), mine).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # (cell, kind 0: within the cell / 1: queries from the cell below, stored tile, query tile, is a query)
    keys = F.concat(
        F.transform(upto(mine), lambda k: F.struct(F.col("cell").alias("cell"), F.lit(0).alias("kind"), F.least(i, k).alias("s"), F.greatest(i, k).alias("q"), (i > k).alias("query"))),
        F.transform(upto(below), lambda k: F.struct(F.col("cell").alias("cell"), F.lit(1).alias("kind"), i.alias("s"), k.alias("q"), F.lit(False).alias("query"))),
        F.transform(upto(above), lambda k: F.struct((F.col("cell") + 1).alias("cell"), F.lit(1).alias("kind"), k.alias("s"), i.alias("q"), F.lit(True).alias("query"))),
    )
    dealt = each.select("v", "rep", "n", "d", "block", F.explode(keys).alias("key")).select("v", "rep", "n", "d", "block", "key.*")

    def joined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d, block, _, kind, s, q = (k.as_py() for k in key)
        v = unit(table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d))
        rep, n, query = (table.column(c).to_numpy() for c in ("rep", "n", "query"))
        same = kind == 0 and s == q
        qi = np.flatnonzero(query) if not same else np.arange(len(rep))
        si = np.flatnonzero(~query) if not same else qi
        a, b = linked_within(v[qi], v[si], same, shared.value[d], block, parts_of(d), budget[d], least)
        a, b = qi[a], si[b]
        gain = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        root = least_labels(len(rep), a, b)
        has = np.flatnonzero(gain)
        return pa.table({"rep": rep[has], "gain": gain[has].astype(np.int64), "to": rep[root[has]]})

    found = cut(dealt.groupBy("d", "block", "cell", "kind", "s", "q").applyInArrow(joined, "rep long, gain long, to long"), "links")
    gains = found.groupBy("rep").agg(F.sum("gain").alias("gain"))
    parts = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), "near")
    named = classes.join(gains, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("v", (F.coalesce("gain", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.where("v is not null").join(named, "v").select("vec_id", "n_links", "component_id").union(lone)


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))

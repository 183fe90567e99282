"""Whitening of vectors by spectrum slicing.

The fit list is each distinct vector of integers once: vectors are packed to a few bytes an entry, so that equal ones meet
in a partial aggregate. Spark sums it up twice, first for the mean and then, centred, for the covariance: a task hands on
one number for each pair of coordinates, whatever its rows, and the driver gets as many, which vectors' length bounds.

The driver then slices the spectrum. How many eigenvalues lie above a shift is the number of positive pivots of the LDL'
factors of the covariance less the shift (Sylvester's law of inertia). Bisection by such counts isolates each leading
eigenvalue, Rayleigh quotient iteration finds it with its vector, each step a solve with a shift that is cubically better
than the one before, and counts on both sides of what it found certify that it is the one with that number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, modest_batches

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
#: Entries are held within this, where doubles still tell whole numbers apart.
MOST = 2**53
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
EPS = np.finfo(float).eps


# the spectrum of a symmetric matrix, on the driver


def pivots(a: np.ndarray) -> np.ndarray:
    """Eigenvalues of the block-diagonal factor D of a symmetric matrix: as many of each sign as the matrix has itself.
    Pivots of one or two rows are chosen so that factors stay small (Bunch and Kaufman's rule)."""
    a, n = a.copy(), len(a)
    alpha, k, out = (1 + 17**0.5) / 8, 0, []

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max() if len(below) else 0.0
        two = False
        if most > 0 and abs(a[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            widest = row.max()
            if abs(a[k, k]) * widest < alpha * most * most:
                if abs(a[r, r]) >= alpha * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        step = 2 if two else 1
        block, rest = a[k : k + step, k : k + step], a[k + step :, k : k + step]
        own = np.linalg.eigvalsh(block) if two else block[0]
        out.extend(own)
        if len(rest) and np.all(own != 0):
            a[k + step :, k + step :] -= rest @ np.linalg.solve(block, rest.T)
        k += step
    return np.array(out)


@dataclass
class Spectrum:
    """Counts of the eigenvalues of a symmetric matrix above shifts, each shift factored once."""

    matrix: np.ndarray

    def __post_init__(self) -> None:
        self.known: dict[float, int] = {}
        self.size = float(np.abs(self.matrix).sum(axis=1).max())  # no eigenvalue is farther from 0
        self.near = 8 * len(self.matrix) * EPS * self.size  # what rounding blurs

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = int((pivots(self.matrix - shift * np.eye(len(self.matrix))) > 0).sum())
        return self.known[shift]

    def slice(self, k: int) -> tuple[float, float]:
        """(lo, hi) with the k-th largest eigenvalue between, alone or with others that rounding can't tell from it."""
        lo = max((s for s, n in self.known.items() if n >= k), default=-self.size - self.near)
        hi = min((s for s, n in self.known.items() if n < k), default=self.size + self.near)
        while self.above(lo) - self.above(hi) > 1 and hi - lo > self.near:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.above(mid) >= k else (lo, mid)
        return lo, hi

    def pair(self, k: int, before: list[tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
        """The k-th largest eigenvalue and its unit vector, orthogonal to the ones before."""
        n = len(self.matrix)
        lo, hi = self.slice(k)
        basis = np.array([v for _, v in before]).reshape(-1, n)
        clear = lambda x: x - basis.T @ (basis @ x)
        rng = np.random.default_rng(k)
        while True:
            alone = hi - lo > self.near / 4  # else several that rounding can't tell apart: any of their vectors will do
            x = clear(rng.normal(size=n))
            x /= np.linalg.norm(x)
            shift = (lo + hi) / 2
            best: tuple[float, float, np.ndarray] | None = None
            for _ in range(40):
                x = clear(self._solve(shift, x))
                x = clear(x / np.linalg.norm(x))
                x /= np.linalg.norm(x)
                image = self.matrix @ x
                value = float(x @ image)
                if alone and not lo - self.near <= value <= hi + self.near:
                    break  # towards a neighbour: slice finer and start again
                left = float(np.linalg.norm(image - value * x))
                if best is not None and left >= best[0] / 2 and best[0] <= self.near:
                    break
                if best is None or left < best[0]:
                    best = left, value, x
                shift = value
            if best is not None and (not alone or (best[0] <= self.near and self.certain(k, best[1], best[0]))):
                return best[1], best[2]
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.above(mid) >= k else (lo, mid)

    def certain(self, k: int, value: float, left: float) -> bool:
        """Whether counts say that what was found is number k: an eigenvalue lies within `left` of it."""
        by = max(left, self.near)
        return self.above(value - by) >= k > self.above(value + by)

    def _solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for off in (0.0, EPS * self.size, 16 * EPS * self.size):
            try:
                y = np.linalg.solve(self.matrix - (shift + off) * np.eye(len(x)), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y / np.abs(y).max()
        return x


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as columns) of a symmetric matrix, the `most` largest by falling eigenvalue."""
    n = len(matrix)
    if not np.abs(matrix).max(initial=0.0) > 0:
        return np.zeros(min(most, n)), np.eye(n)[:, : min(most, n)]
    scale = 2.0 ** -np.frexp(np.abs(matrix).max())[1]  # far from what doubles can hold
    spectrum = Spectrum(matrix * scale)
    found: list[tuple[float, np.ndarray]] = []
    for k in range(1, min(most, n) + 1):
        found.append(spectrum.pair(k, found))
    found.sort(key=lambda f: -f[0])  # only within what rounding blurs
    return np.array([e for e, _ in found]) / scale, np.array([v for _, v in found]).T


# vectors of whole numbers, packed


def whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x - OFFSET as a matrix) for each length of vector among the rows that are whole and finite."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (bad[at[1:]] == bad[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(good, np.diff(at), 0)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        with np.errstate(over="ignore"):
            y = np.clip(np.floor(SCALE * flat[at[rows][:, None] + np.arange(d)]), -MOST, MOST)
        yield rows, y.astype(np.int64)


def packed(y: np.ndarray) -> list[bytes]:
    """Each row as its number of bytes an entry, the least that hold it, and the entries: equal rows are equal bytes."""
    top = np.maximum(y.max(axis=1), -1 - y.min(axis=1))
    out: list = [None] * len(y)
    for width, limit in ((1, 2**7), (2, 2**15), (4, 2**31), (8, 2**62)):
        rows = np.flatnonzero((top < limit) & (top >= (0 if width == 1 else {2: 2**7, 4: 2**15, 8: 2**31}[width])))
        for i, b in zip(rows.tolist(), y[rows].astype(f"<i{width}"), strict=True):
            out[i] = bytes([width]) + b.tobytes()
    return out


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of packed rows, one for each length and width."""
    kinds: dict[tuple[int, int], list[bytes]] = {}
    for b in column.to_pylist():
        kinds.setdefault((len(b), b[0]), []).append(b)
    for (size, width), rows in kinds.items():
        flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), size)[:, 1:]
        yield np.ascontiguousarray(flat).view(f"<i{width}").astype(np.int64)


def summed(fit: DataFrame, columns: list[str], of: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Length -> sums over the fit list of the arrays that `of` gives for a matrix of vectors. A task adds up its own."""
    kinds = ["long" if c.startswith("whole") else "double" for c in columns]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for y in unpacked(batch.column(0)):
                own = of(y)
                have = sums.get(y.shape[1])
                sums[y.shape[1]] = own if have is None else tuple(a + b for a, b in zip(have, own, strict=True))
        for d, parts in sums.items():
            n = len(parts[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d)), pa.array(np.arange(n)), *map(pa.array, parts)], names=["d", "i", *columns])

    fields = ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True))
    total = fit.mapInArrow(added, f"d long, i long, {fields}").groupBy("d", "i").agg(*[F.sum(c).alias(c) for c in columns])
    rows = total.orderBy("d", "i").toPandas()  # as many as a covariance has entries
    return {int(d): tuple(own[c].to_numpy() for c in columns) for d, own in rows.groupby("d")}


@dataclass
class Model:
    """What whitens vectors of one length: n vectors in the fit list, their sums as middle * n + rest, and the components."""

    n: int
    middle: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def sound(self) -> np.ndarray:
        """Which components vary by more than rounding."""
        return self.values > 8 * len(self.middle) * EPS * max(self.trace, 0.0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.middle) - np.array([r / self.n for r in self.rest])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Projections over root of variance; NaN on components without variance."""
        scale = np.where(self.sound, np.sqrt(np.where(self.sound, self.values, 1.0)), np.nan)
        return self.centred(y) @ self.vectors / scale

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it is no long."""
        off = y - self.middle
        far = self.n * float(np.abs(off).max(initial=0)) + max(map(abs, self.rest), default=0)
        if far * far * y.shape[1] < 2**62:
            return ((self.n * off - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(x) if x < 2**63 else None for x in exact]


def fitted(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> dict[int, Model]:
    """A model for each length of vector, from the distinct vectors of whole numbers."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {b for _, y in whole(batch.column(0)) for b in packed(y)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary())], names=["x"])

    rows = modest_batches(vectors.select(F.col(embedding).alias("v")))
    fit = cut(rows.mapInArrow(keys, "x binary").distinct(), "fit")
    # in two parts, so that no sum of entries is too large for a long
    low = 2**26
    sums = summed(fit, ["whole_n", "whole_high", "whole_low"], lambda y: (np.full(y.shape[1], len(y)), (y // low).sum(axis=0), (y % low).sum(axis=0)))
    models = {}
    for d, (n, high, less) in sums.items():
        n, total = int(n[0]), [int(h) * low + int(w) for h, w in zip(high, less, strict=True)]
        middle = [(2 * s + n) // (2 * n) for s in total]
        models[d] = Model(n, np.array(middle, np.int64), [s - n * m for s, m in zip(total, middle, strict=True)], np.zeros(0), np.zeros((d, 0)), 0.0)

    def product(x: np.ndarray) -> tuple[np.ndarray]:
        return ((x.T @ x).ravel(),)

    known = dict(models)
    for d, (v,) in summed(fit, ["v"], lambda y: product(known[y.shape[1]].centred(y))).items():
        v = v.reshape(d, d) / models[d].n
        v = (v + v.T) / 2
        models[d].values, models[d].vectors = leading(v, components)
        models[d].trace = float(np.trace(v))
    for d, (v,) in summed(fit, ["v"], lambda y: product(np.nan_to_num(known[y.shape[1]].whitened(y)))).items():
        m = models[d]
        own = (v / m.n).reshape(len(m.values), -1)[np.ix_(m.sound, m.sound)]
        m.identity_error = float(np.abs(own - np.eye(len(own))).max()) if len(own) else None
    drop(fit)
    return models


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row and component up to `components`: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries give nothing, nor do empty vectors. Rows that repeat, or
    have no vec_id, are whitened one by one, and count once in the fit. Vectors of different lengths are fitted by
    themselves. Shorter vectors have as many components as entries. Components without variance have null whitened
    values and are left out of identity_error, which is null where none varies; explained is null where nothing does. Ties of
    eigenvalues: any orthonormal vectors of their space, the same for all rows. Entries beyond 2^53 / 64 are held there; a deviation that is no long is null.
    An empty table gives no rows; other columns are ignored.
    """
    models = fitted(vectors, components, embedding)
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # a square of the length of vectors

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in whole(batch.column(1)):
                m = shared.value[y.shape[1]]
                for lo in range(0, len(rows), 4096):
                    own, part = rows[lo : lo + 4096], y[lo : lo + 4096]
                    k, n = len(m.values), len(own)
                    ids = batch.column(0).take(pa.array(np.repeat(own, k)))
                    each = lambda x, kind: pa.array(np.tile(x, n), kind, from_pandas=True)
                    dev = pa.array(m.deviation(part), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
                    white = pa.array(m.whitened(part).ravel(), pa.float64(), from_pandas=True)
                    explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
                    error = pa.array([m.identity_error] * (n * k), pa.float64())
                    yield pa.RecordBatch.from_arrays([ids, each(np.arange(1, k + 1), pa.int32()), each(np.full(k, m.n), pa.int64()), dev, white, each(explained, pa.float64()), error], names=WHITENED.replace(",", "").split()[::2])

    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    return modest_batches(own).mapInArrow(applied, WHITENED)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

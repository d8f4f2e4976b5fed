"""Whitening of embeddings by TSQR: no covariance matrix is formed on the way to the components.

Entries become whole numbers, so sums are exact and every row can be centred exactly before it is rounded once. Each
partition of the distinct rows is reduced to the R of its QR decomposition, a block of rows at a time; R factors are
stacked and decomposed again, ``WIDTH`` of them in a task, until one is left. The right singular vectors of that R are
the components, its squared singular values over the number of rows are their eigenvalues.

A task holds a block of rows, or ``WIDTH`` square matrices of the dimension; the driver gets the sums, one R and the
projected covariance, all bounded by the dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, written

#: Rows of a block that goes through one QR, and factors that one task stacks.
BLOCK_ROWS = 4096
WIDTH = 16
SCALE = 256.0
#: Components below this share of the largest singular value are noise of rounding.
RANK = 1e-10
LARGE = 1 << 62


# ---------------------------------------------------------------- rows as whole numbers
def _rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors stay (no null, no non-finite entry), their lengths, and their entries as whole numbers, end to end."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    keep = keep & (np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) == 0)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * values[keep[owner]])
    return keep, sizes[keep], np.clip(x, -float(LARGE), float(LARGE)).astype(np.int64)


def _keys(sizes: np.ndarray, x: np.ndarray) -> list[bytes]:
    """The same bytes for the same numbers: zeros at the end left out, two or eight bytes a number."""
    stop, out, raw, small = np.cumsum(sizes).tolist(), [], x.astype("<i8"), x.astype("<i2")
    at = 0
    for end in stop:
        row = raw[at:end]
        last = np.flatnonzero(row)
        n = int(last[-1]) + 1 if len(last) else 0
        narrow = not n or (int(row[:n].min()) >= -(1 << 15) and int(row[:n].max()) < 1 << 15)
        out.append(b"\x02" + small[at : at + n].tobytes() if narrow else b"\x08" + row[:n].tobytes())
        at = end
    return out


def _matrix(keys: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``dim`` whole numbers from keys; shorter ones are padded with zeros."""
    out = np.zeros((len(keys), dim), np.int64)
    for i, k in enumerate(keys):
        row = np.frombuffer(k, "<i2" if k[0] == 2 else "<i8", offset=1)
        out[i, : len(row)] = row
    return out


KEYS = pa.schema([("id", pa.int64()), ("x", pa.binary())])


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of the rows that stay; ``x`` packs the whole numbers."""

    def run(batches):
        for b in batches:
            keep, sizes, x = _rows(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(_keys(sizes, x), pa.binary())], schema=KEYS)

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), run, "id long, x binary")


# ---------------------------------------------------------------- sums, factors, check
def _centred(keys: list[bytes], dim: int, n: int, sums: np.ndarray) -> tuple[np.ndarray, bool]:
    """``n * x - S`` exactly: as 64-bit numbers if they all fit, else as Python's."""
    x = _matrix(keys, dim)
    far = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums.tolist()), default=0)
    if far < LARGE:
        return x * n - sums.astype(np.int64), True
    return x.astype(object) * n - sums, False


def _floats(centred: np.ndarray, n: int) -> np.ndarray:
    """Rows less their mean, each rounded once or twice."""
    return centred.astype(np.float64) / n if centred.dtype != object else (centred / n).astype(np.float64)


def _key_chunks(batches, size: int = BLOCK_ROWS):
    for b in batches:
        keys = b.column(b.num_columns - 1).to_pylist()
        for i in range(0, len(keys), size):
            yield b.slice(i, size), keys[i : i + size]


def _totals(distinct: DataFrame) -> tuple[int, int, np.ndarray]:
    """Number of rows, dimension, and the exact sum of each dimension."""

    def run(batches):
        total, count = np.zeros(0, object), 0
        for _, keys in _key_chunks(batches):
            dim = max(len(k) // k[0] for k in keys)  # one byte more than the numbers take
            x = _matrix(keys, dim)
            block = x.sum(0).astype(object) if len(keys) * int(np.abs(x).max(initial=0)) < LARGE else x.astype(object).sum(0)
            if dim > len(total):
                total = np.concatenate([total, np.zeros(dim - len(total), object)])
            total[:dim] += block
            count += len(keys)
        # sums of partitions go out in two halves of 32 bits, so that adding them up can't overflow
        high = [int(t) >> 32 for t in total]
        low = [int(t) & 0xFFFFFFFF for t in total]
        d = ["dim", "high", "low"]
        yield pa.RecordBatch.from_pydict(dict(zip(d, ([-1, *range(len(high))], [0, *high], [count, *low]))), schema=pa.schema([(k, pa.int64()) for k in d]))

    parts = arrow_map(distinct.select("x"), run, "dim long, high long, low long")
    found = {r.dim: (int(r.high) << 32) + int(r.low) for r in parts.groupBy("dim").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()}
    n = found.pop(-1, 0)
    return n, len(found), np.array([found[k] for k in range(len(found))], object)


FACTOR = pa.schema([("part", pa.int64()), ("r", pa.binary())])


def _factor(distinct: DataFrame, n: int, dim: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all centred rows: one per partition, then merged by a tree."""

    def leaves(batches):
        r = np.zeros((0, dim))
        for _, keys in _key_chunks(batches):
            r = np.linalg.qr(np.concatenate([r, _floats(_centred(keys, dim, n, sums)[0], n)]), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], schema=FACTOR)

    def merge(pdf):
        r = np.linalg.qr(np.concatenate([np.frombuffer(x).reshape(-1, dim) for x in pdf.sort_values("part")["r"]]), "r")
        return pdf.iloc[:1].assign(part=pdf["part"].min() // WIDTH, r=[r.tobytes()])

    factors = arrow_map(distinct.select("x"), leaves, "part long, r binary")
    left = distinct.rdd.getNumPartitions()
    while left > 1:
        factors = factors.groupBy(F.floor(F.col("part") / WIDTH)).applyInPandas(merge, "part long, r binary")
        left = -(-left // WIDTH)
    return np.frombuffer(factors.first()["r"]).reshape(-1, dim)


def _identity_error(distinct: DataFrame, n: int, dim: int, sums: np.ndarray, axes: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity; partitions are centred on their own
    means and put together with what those means differ."""
    k = axes.shape[1]

    def run(batches):
        count, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for _, keys in _key_chunks(batches):
            w = _floats(_centred(keys, dim, n, sums)[0], n) @ axes
            m = len(w)
            own = w.mean(0)
            away = own - mean
            spread += (w - own).T @ (w - own) + np.outer(away, away) * (count * m / (count + m))
            mean += away * (m / (count + m))
            count += m
        flat = [*(count * mean), *(spread + count * np.outer(mean, mean)).ravel()]
        yield pa.RecordBatch.from_pydict({"k": list(range(len(flat))), "v": flat}, schema=pa.schema([("k", pa.int64()), ("v", pa.float64())]))

    sums_ = {r.k: r.v for r in arrow_map(distinct.select("x"), run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([sums_[i] for i in range(k + k * k)])
    mean = flat[:k] / n  # the rows are centred already, so this is near zero and nothing cancels
    return float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


# ---------------------------------------------------------------- operator
@dataclass
class Whitening:
    """What was fitted: number of distinct rows, exact sums, components as columns (falling eigenvalue), eigenvalues,
    the trace of the covariance, and the error of whitening the fit list with the first ``checked`` components."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    checked: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums], np.float64)

    @property
    def axes(self) -> np.ndarray:
        """Columns that take a centred row to its whitened coordinates."""
        return self.components / np.sqrt(self.eigenvalues)


def fit(rows: DataFrame, components: int | None = None) -> Whitening | None:
    """Whitening of the distinct rows of ``whole``; ``components`` keeps the first ones only. None if there is no row."""
    # aggregated before the shuffle, so a vector that a third of all rows share is one row of each task
    distinct = written(rows.select("x").distinct(), "vectors")
    n, dim, sums = _totals(distinct)
    if not n:
        return None
    if not dim:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    _, s, vt = np.linalg.svd(_factor(distinct, n, dim, sums))
    s = s[:dim]
    eigen = s * s / n
    rank = int((s > RANK * s[0]).sum()) if s[0] > 0 else 0
    k = rank if components is None else min(rank, components)
    vectors = vt[:k].T
    error = _identity_error(distinct, n, dim, sums, vectors / np.sqrt(eigen[:k])) if k else 0.0
    return Whitening(n, sums, vectors, eigen[:k], float(eigen.sum()), error, k)


OUT = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whitened(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, or hold a null or an entry that is not finite, are left out. Entries c become
    ``floor(256 c)``; the fit list has each vector of such numbers once. ``deviation`` is the exact sum of squares of
    ``n x - S`` (null where it doesn't fit a long), ``explained`` the component's share of the variance.

    Cases: a vector that is shorter than the longest is padded with zeros, an empty one is all zeros; entries beyond
    2**62 count as that. Components without variance have no rows, so a table of equal vectors gives none, and neither
    does an empty one. Rows that repeat an id, and rows without an id, have their own rows; other columns are ignored.
    Components with equal eigenvalues are any basis of their space.
    """
    rows = whole(vectors, id_col, vector_col)
    w = fit(rows, components)
    k = 0 if w is None else w.checked
    if k:
        n, sums, axes, explained, error, dim = w.n, w.sums, w.axes, w.eigenvalues / w.trace, w.identity_error, len(w.sums)

    def run(batches):
        for b, keys in _key_chunks(batches) if k else ():
            c, exact = _centred(keys, dim, n, sums)
            if exact and dim * float(np.abs(c).max(initial=0)) ** 2 < LARGE:
                deviation = pa.array((c * c).sum(1))
            else:
                squares = (c.astype(object) ** 2).sum(1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in squares], pa.int64())
            m, at = len(keys), np.repeat(np.arange(len(keys)), k)
            flat = (_floats(c, n) @ axes).ravel()
            cols = [b.column(0).take(pa.array(at)), np.tile(np.arange(1, k + 1), m), np.full(m * k, n), deviation.take(pa.array(at)), flat, np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, OUT)], schema=OUT)

    return arrow_map(rows, run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)

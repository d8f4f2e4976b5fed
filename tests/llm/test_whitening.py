"""Whitening against numpy's eigenvectors of the covariance, exact sums against Python's whole numbers."""

import math
import random

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, x string"


def brute(rows, most=4):
    kept = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (dim - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n = len(fit)
    sums = [sum(v[k] for v in fit) for k in range(dim)]
    centred = np.array([[float(n * v[k] - sums[k]) / n for k in range(dim)] for v in fit]).reshape(n, dim)
    e, u = np.linalg.eigh(centred.T @ centred / max(n, 1)) if dim else (np.zeros(0), np.zeros((0, 0)))
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-12 * e.max(initial=0)).sum()) if e.max(initial=0) > 0 else 0)
    out = {}
    for i, v in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        row = np.array([(n * a - s) / n for a, s in zip(v, sums)])
        out.setdefault(i, []).append((dev if dev < 2**63 else None, row @ u[:, :k] / np.sqrt(e[:k])))
    return n, k, e[:k] / e.sum() if k else e[:k], out


def hold(df, rows, most=4):
    n, k, explained, want = brute(rows, most)
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert sorted(got, key=str) == sorted(((i, c + 1) for i in want for c in range(k)), key=str)
    for (i, c), found in got.items():
        assert sorted(str(r.deviation) for r in found) == sorted(str(d) for d, _ in want[i])
        assert np.allclose(sorted(abs(r.whitened) for r in found), sorted(abs(w[c - 1]) for _, w in want[i]), rtol=1e-7, atol=1e-9)
        assert all(r.n == n and math.isclose(r.explained, explained[c - 1], rel_tol=1e-8) and r.identity_error < 1e-9 for r in found)
    # one sign for all rows of a component
    for c in range(1, k + 1):
        pairs = [(r.whitened, w[c - 1]) for (i, d), found in got.items() if d == c and len(found) == 1 for r, (_, w) in zip(found, want[i]) if abs(w[c - 1]) > 1e-6]
        assert len({np.sign(a * b) for a, b in pairs}) <= 1


def vectors(dim=7):
    rng = random.Random(4)
    base = [(i, [rng.gauss(0, 1 + k) for k in range(dim)]) for i in range(300)]
    same = [(1000 + i, base[0][1]) for i in range(150)]  # one vector that a third of all rows share
    odd = [(2000, None), (2001, [1.0, None] + [0.0] * (dim - 2)), (2002, [float("nan")] + [0.0] * (dim - 1)), (2003, [float("-inf")] * dim), (2004, [1.0]), (2005, []), (2006, [-0.0] * dim), (2007, [-1e-9] * dim), (2008, [300.0] * dim)]
    return base + same + odd + [(5, base[7][1]), (None, base[8][1])]


@pytest.mark.parametrize("width", [2, 16])
def test_against_numpy(spark, monkeypatch, width):
    monkeypatch.setattr(whitening, "WIDTH", width)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 3, "other") for i, v in rows], SCHEMA).repartition(5)
    hold(whitening.whitened(df), rows)
    hold(whitening.whitened(df, 2), rows, 2)


def test_sums_beyond_64_bits(spark):
    rows = [(i, [float(2**50 + i * 2**44), float(i), float((-1) ** i)]) for i in range(12)]
    hold(whitening.whitened(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [])], [(1, [3.0]), (2, [3.0]), (3, [3.001])], [(1, [0.0, 1.0]), (2, [0.0, 2.0])], [(k, [float(k), 2.0 * k, 0.5]) for k in range(9)]])
def test_little_variance(spark, rows):
    hold(whitening.whitened(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)), rows)


def test_a_task_without_rows_and_floats(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    hold(whitening.whitened(df.withColumnRenamed("vec_id", "x").withColumnRenamed("embedding", "id"), id_col="x", vector_col="id").withColumnRenamed("x", "vec_id"), rows)


def test_keys_are_equal_for_equal_vectors_only():
    lists = [[0], [], [0, 0], [1], [1, 0], [0, 1], [1 << 15], [1 << 15, 0], [-(1 << 15)], [257, 0, 0], [1, 1]]
    keys = whitening._keys(np.array([len(x) for x in lists]), np.array([v for x in lists for v in x], np.int64))
    strip = [tuple(x[: max((i + 1 for i, v in enumerate(x) if v), default=0)]) for x in lists]
    assert len(set(keys)) == len(set(strip)) and all((a == b) == (s == t) for a, s in zip(keys, strip) for b, t in zip(keys, strip))
    assert [tuple(r) for r in whitening._matrix(keys, 3).tolist()] == [(*s, 0, 0, 0)[:3] for s in strip]

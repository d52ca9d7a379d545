import math
from fractions import Fraction

import numpy as np
import pytest

from sidelines.llm import whitening as W


def definition(rows, k=8):
    """x, S, the covariance by exact fractions, and eigenvalues."""
    ok = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    d, n = len(ok[0][1]), len(ok)
    s = [sum(x[j] for _, x in ok) for j in range(d)]
    cov = [[float(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for _, x in ok) / Fraction(n) ** 3) for b in range(d)] for a in range(d)]
    return ok, s, np.array(cov)


def vectors(n, d, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(3, 0.2, d)[:, None]
    return [(i, (scale * (rng.normal(size=d) @ mix + 5)).tolist()) for i in range(n)]


def check(spark, rows, k=8, parts=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, deviation string").repartition(parts)
    out = W.whitened_embeddings(df, k).collect()
    ok, s, cov = definition(rows)
    n, d = len(ok), len(s)
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(out) == n * min(k, d) and {r["n"] for r in out} == {n}
    by = {}
    for r in out:
        by.setdefault(r["id"], {})[r["component"]] = r
    assert sorted(by) == sorted(i for i, _ in ok)
    for i, x in ok:
        assert int(by[i][1]["deviation"]) == sum((n * a - b) ** 2 for a, b in zip(x, s))
    for c in range(1, min(k, d) + 1):
        assert by[ok[0][0]][c]["explained"] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
    white = np.array([[by[i][c]["whitened"] for c in range(1, min(k, d) + 1)] for i, _ in ok])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(min(k, d))).max() < 1e-8
    assert 0 <= out[0]["identity_error"] < 1e-8
    # the coordinates are the centred rows on unit eigenvectors: V u = e u
    centred = np.array([[a - float(Fraction(b, n)) for a, b in zip(x, s)] for _, x in ok])
    u, *_ = np.linalg.lstsq(centred, white * np.sqrt(values[:min(k, d)]), rcond=None)
    assert np.abs(cov @ u - u * values[:min(k, d)]).max() < 1e-7 * values[0] and np.allclose(np.linalg.norm(u, axis=0), 1)


def test_equals_the_definition(spark):
    check(spark, vectors(200, 12))
    check(spark, vectors(60, 5, seed=2), parts=1)
    check(spark, vectors(80, 6, seed=3, scale=1e7))          # squares beyond 64 bits
    rows = vectors(50, 4, seed=4)
    check(spark, rows + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [1.0, float("inf"), 0.0, 0.0])])


def test_squares_are_exact_in_every_range():
    for scale in (1, 1 << 20, 1 << 29, 1 << 31, 1 << 50):
        y = np.random.default_rng(scale % 97).integers(-scale, scale + 1, size=(37, 6))
        got = W._square_sums(y)
        rows = y.tolist()
        for i in range(6):
            want = [sum((r[i] + r[j]) ** 2 if j > i else r[i] ** 2 for r in rows) for j in range(i, 6)]
            assert [int(t) for t in got[i]] == want


def test_offset_does_not_change_the_covariance(spark):
    rows = [(i, [i % 7 / 1024 + 1e6, i % 5 / 1024 + 1e6, (i % 7 + i % 5) / 2048]) for i in range(140)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit(W.quantised(df, "vec_id", "embedding"))
    assert np.array_equal(model.covariance, definition(rows)[2])


def test_no_variance_ties_and_other_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    equal = W.whitened_embeddings(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], schema)).collect()
    assert len(equal) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 and r["deviation"] == 0 for r in equal)
    line = W.whitened_embeddings(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], schema)).collect()
    assert [(r["whitened"] is None, r["explained"]) for r in line if r["id"] == 0] == [(False, 1.0), (True, 0.0)]
    mixed = W.whitened_embeddings(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (4, [3.0])], schema)).collect()
    assert sorted({r["id"] for r in mixed}) == [2, 3]
    for empty in ([], [(1, None)]):
        out = W.whitened_embeddings(spark.createDataFrame(empty, schema))
        assert out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check(spark, [tuple(r) for r in rows])

import itertools

import numpy as np
from pyspark.sql import functions as F

from sidelines.llm.packing import best_bounds, pack


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.sort(rng.choice(200, 9, replace=False))
        counts = rng.integers(1, 50, 9)
        for k in (1, 2, 3, 4, 12):
            got = best_bounds(lengths, counts, k)
            assert len(got) <= k
            want = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, 9) - 1))
            assert padding(lengths, counts, got) == want
    assert best_bounds(np.array([]), np.array([]), 3) == []


def test_batches(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), i) for i in range(2000)] + [(5, "w w w w w", 0)] * 3 + [(None, None, 0), (9999, "w " * 500, 0)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, bound long"), budget=100, buckets=4).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in out:
        assert r["n_tokens"] <= r["bound"]
        groups.setdefault((r["bound"], r["batch"]), []).append(r["place"])
    for (bound, batch), places in groups.items():
        per = max(1, 100 // max(bound, 1))
        assert sorted(places) == list(range(len(places))) and len(places) <= per
        last = max(b for x, b in groups if x == bound)
        assert len(places) == per or batch == last
    lengths = sorted({r["n_tokens"] for r in out})
    counts = [sum(r["n_tokens"] == x for r in out) for x in lengths]
    want = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 3))
    assert sum(r["bound"] - r["n_tokens"] for r in out) == want
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_documents_have_exact_bounds(spark):
    lengths = [3, 4097, 8195, 12345, 19997, 19999]
    rows = [(i, n) for i, n in enumerate(lengths * 3)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    out = pack(df, buckets=3, tokens=F.col("n")).collect()
    bounds = {r["bound"] for r in out}
    want = min(padding(lengths, [3] * 6, [*c, 19999]) for c in itertools.combinations(lengths[:-1], 2))
    assert bounds <= set(lengths) and sum(r["bound"] - r["n_tokens"] for r in out) == want

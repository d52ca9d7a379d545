import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sidelines.llm.catalog import load
from sidelines.llm.fingerprints import fingerprints, gamma_quantiles, likeness, signatures


def bag(t):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w)


def generalised(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def expected(rows):
    """Neighbours and edited texts by definition (distinct ids)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = (t, t[:len(t) - half] + nxt[:half], nxt)
    return out


def test_neighbours_and_estimates(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 300")
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    want = expected(rows)
    f = fingerprints(d.withColumn("part", F.lit(1)), samples=64, ranges=7)
    got = f.select("id", "n_chars", "edited_sha256", likeness(F.col("sig_own"), F.col("sig_edit"), 64).alias("e"),
                   likeness(F.col("sig_own"), F.col("sig_next"), 64).alias("x"), "sig_own").collect()
    assert len(got) == len(rows)
    off, by_text = [], {}
    for r in got:
        t, edited, nxt = want[r["id"]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [r["e"] - generalised(bag(t), bag(edited)), r["x"] - generalised(bag(t), bag(nxt))]
        assert by_text.setdefault(t, r["sig_own"]) == r["sig_own"]
    assert abs(sum(off) / len(off)) < 0.015 and math.sqrt(sum(x * x for x in off) / len(off)) < 0.07


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = {1: 9, 2: 1, 3: 4, 4: 30}, {1: 3, 2: 1, 4: 45, 5: 6}
    rows = [(k, a.get(k, 0), b.get(k, 0)) for k in {*a, *b}]
    t = spark.createDataFrame(rows, "k long, x long, y long")
    reps = spark.range(300).crossJoin(t).select(F.col("id"), F.xxhash64("id", "k").alias("h"), "x", "y")
    got = signatures(reps, ["id"], ["x", "y"], 16).select(likeness(F.col("sig_x"), F.col("sig_y"), 16).alias("s")).agg(F.avg("s")).first()[0]
    assert abs(got - generalised(Counter(a), Counter(b))) < 0.025


def test_quantiles(spark):
    x = gamma_quantiles(spark).first()[0]
    n = len(x)
    assert all(abs(1 - math.exp(-v) * (1 + v) - (i + 0.5) / n) < 1e-9 for i, v in list(enumerate(x))[::997])


def test_special_rows(spark):
    rows = [(5, None), (4, ""), (3, "a"), (2, " a\t"), (1, "été a b"), (None, "z")]
    got = {r["doc_id"]: r for r in _query(spark, rows)}
    assert got[5]["n_chars"] == 0 and got[5]["fingerprint"] == "" and got[5]["near_next"] == 1 and got[5]["near_edited"] == 1
    assert got[3]["fingerprint"] == got[2]["fingerprint"] != "" and got[3]["near_next"] == 1 and got[4]["near_next"] == 0
    assert got[1]["edited_sha256"] == hashlib.sha256("été z".encode()).hexdigest()
    assert got[None]["edited_sha256"] == hashlib.sha256(b"z").hexdigest()       # wraps round to the first, which is empty
    assert len(_query(spark, [(7, "x y z w")])) == 1 and _query(spark, []) == []
    both = _query(spark, [(1, "p q"), (1, "p q"), (2, "p q")])
    assert [r["near_next"] for r in both] == [1, 1, 1]


def _query(spark, rows):
    import tempfile
    d = tempfile.mkdtemp(prefix="sidelines-test-")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return load()[0]["op3_fingerprints"](spark, d).collect()

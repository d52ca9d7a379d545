"""Exact dedup, URL filter and source mixing on small tables, and all SQL of the package at sf0.001."""
import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sidelines.llm.catalog import load
from sidelines.llm.common import lower_az
from sidelines.llm.exact_dedup import exact_groups
from sidelines.llm.mixing import leaf_shares, mix
from sidelines.llm.url_filter import bloom_blocks, possible, url_verdicts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = load()[0][name](spark, SF), con.sql(load()[1][name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(found, names):
        return Counter(str([r[names.index(c)] for c in cols]) for r in map(tuple, found))

    got, want = rows(got.collect(), got.columns), rows(want.fetchall(), want.columns)
    assert len(got)
    assert got == want


def az(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_lower_az(spark):
    texts = ["ABC xyz", "ÉÀ Az", "İI", "", "Z" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lower_az(F.col("t"))).collect()]
    assert got == [az(t) for t in texts]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "A", "b b", "É", "é", None, "", "x" * 5000, "X" * 5000, "yy", "zz"]), "h", 1) for i in range(200)]
    rows += [(3, rows[3][1], "h", 1), (None, "a", "h", 1), (None, "only null", "h", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, sha int").repartition(4)
    best = {"min": lambda x: min([i for i in x if i is not None], default=None), "max": lambda x: max([i for i in x if i is not None], default=None)}[keep]
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(az(t), []).append(i)
    want = Counter((i, best(groups[az(t)]), len(groups[az(t)]), i == best(groups[az(t)]), hashlib.sha256(az(t).encode()).digest()) for i, t, *_ in rows)
    weak = {"content_hash": lambda c: F.length(c)}
    for kw in ({}, weak):                        # with the weak hash most groups collide
        got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"])) for r in exact_groups(df, keep=keep, **kw).collect())
        assert got == want
    assert exact_groups(df.limit(0)).count() == 0


def test_url_verdicts(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/x", "allow"), ("a.net", "/xy/", "block"), ("org", "", "block"), ("org", "", "allow")],
                                  "host string, path string, verdict string")
    urls = {"http://A.NET/xy/z?q": ("a.net", "/xy/z", "a.net/xy/", "block"), "https://b.a.net/xz#f": ("b.a.net", "/xz", "a.net/x", "allow"),
            "http://ba.net/x": ("ba.net", "/x", "net/", "block"), "http://net": ("net", "", None, "allow"), "http://q.org": ("q.org", "", "org", "allow"),
            "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"), "x://h?a://net/": ("h", "", None, "allow")}
    df = spark.createDataFrame([(1, u, "host") for u in urls] + [(2, "http://net/a", "host")] * 2, "page_id long, url string, rule string")
    for blocks in (1, 64):                       # one block: nearly everything passes the filter
        got = Counter(tuple(r) for r in url_verdicts(df, rules, blocks=blocks).collect())
        assert got == Counter([(1, *v) for v in urls.values()] + [(2, "net", "/a", "net/", "block")] * 2)
    assert url_verdicts(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_verdicts(df, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    more = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id")
    passed = possible(more, bloom_blocks(keys, blocks=1 << 12), blocks=1 << 12)
    inside, outside = passed.filter("id < 5000").count(), passed.filter("id >= 5000").count()
    assert inside == 5000 and outside < 300


def water(budget, nodes):
    """Share by weight; what a full node cannot hold goes round again among the rest."""
    share, open_ = {k: 0 for k in nodes}, {k for k, (c, w) in nodes.items() if w}
    left = min(budget, sum(nodes[k][0] for k in open_))
    while open_:
        total = sum(nodes[k][1] for k in open_)
        full = {k for k in open_ if nodes[k][0] * total <= left * nodes[k][1]}
        if not full:
            for k in open_:
                share[k] = left * nodes[k][1] // total
            break
        for k in full:
            share[k] = nodes[k][0]
            left -= share[k]
        open_ -= full
    return share


def test_shares_by_hand(spark):
    leaves = [("d1", "en", 100), ("d1", "de", 10), ("d1", "fr", 50), ("d2", "en", 30), ("d3", "en", 1000)]
    weights = ({"d1": 2, "d2": 1, "d3": 1}, {"en": 3, "fr": 0})
    got = {tuple(r)[:2]: r["share"] for r in leaf_shares(spark.createDataFrame(leaves, "a string, b string, tokens long"), ["a", "b"], weights, 1, 2, 1).collect()}
    # budget 595; d2 holds 30 only, d1 holds 110 (its fr has weight 0), the rest is d3's
    top = water(595, {"d1": (110, 2), "d2": (30, 1), "d3": (1000, 1)})
    assert top == {"d1": 110, "d2": 30, "d3": 455}
    assert got == {("d1", "en"): 100, ("d1", "de"): 10, ("d1", "fr"): 0, ("d2", "en"): 30, ("d3", "en"): 455}


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1"]), "x") for i in range(400)]
    rows += [(1000, None, "en", "s0", "x"), (1001, "", "en", "s0", "x"), (7, "a b", "en", "s1", "x"), (7, "a b", "en", "s1", "x"), (None, "q", "de", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string").repartition(3)
    keys = {"source_": F.col("source"), "lang_": F.col("lang")}
    for num, epochs in ((5, 1), (10, 1), (25, 3)):
        got = mix(df, keys, ({"s0": 1, "s1": 3}, {}), num, 10, max_epochs=epochs).collect()
        leaf = Counter()
        for _, t, lang, source, _ in rows:
            leaf[source, lang or "<null>"] += len((t or "").split())
        top = water(sum(leaf.values()) * num // 10, {s: (epochs * sum(v for (a, _), v in leaf.items() if a == s), {"s0": 1, "s1": 3}[s]) for s in ("s0", "s1")})
        for s in ("s0", "s1"):
            share = water(top[s], {b: (epochs * v, 1) for (a, b), v in leaf.items() if a == s})
            for b, quota in share.items():
                mine = [r for r in got if r["source_"] == s and r["lang_"] == b]
                taken = sum(r["tokens"] for r in mine)
                assert taken <= quota and quota - taken < 30
                times = Counter(r["epoch"] for r in mine)
                size = sum(1 for _, t, lang, source, _ in rows if source == s and (lang or "<null>") == b and t)
                assert all(times[e] == size for e in range(quota // leaf[s, b]))
    assert mix(df.limit(0), keys, ({}, {}), 1, 2).count() == 0

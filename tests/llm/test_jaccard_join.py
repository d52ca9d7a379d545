import random

import numpy as np

from pyspark.sql import functions as F

from sidelines.llm import jaccard_join
from sidelines.llm.jaccard_join import components, near_duplicates, prefix_places, trie_links
from tests.llm.brute import shingles


def brute(rows, k, percent):
    """Smallest id reachable by links, comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d if d is not None else -1), len(s), least.get(find(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df, **kw):
    return sorted((r["id"] if r["id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1)
                  for r in near_duplicates(df, **kw).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and rows:
            t = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[rng.randrange(4):]
            rows.append((i, " ".join(t)))
        elif kind < 0.7:
            rows.append((i, passage + " " + " ".join(rng.choices(words, k=rng.randrange(12)))))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 5, 8, 20, 60])))))
    return rows


def test_equals_all_pairs(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed, 220) + [(9001, None), (9002, ""), (9003, "A b"), (9004, "a  B"), (9004, "a  B"), (None, "a b"), (9005, "\t")]
        df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, sid int").repartition(3)
        assert got(df, k=k, percent=percent, buckets=5) == brute(rows, k, percent)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_links_span_the_components():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 85):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(30)]
        sets += [np.delete(s, 0) if len(s) > 1 else s for s in sets[:15]] + [np.union1d(s, [50]) for s in sets[:15]]
        n = np.array([len(s) for s in sets])
        links = trie_links(np.arange(len(sets)), n, sets, percent)
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        mine = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if find(i) == find(j)}
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= percent * (n[i] + n[j] - inter):
                    up[find(i)] = find(j)
        assert mine == {(i, j) for i in range(len(sets)) for j in range(len(sets)) if find(i) == find(j)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 3)]
    out = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def edited(n, words, passage, share, seed):
    """``n`` different copies of a passage with a share of its words altered."""
    rng = random.Random(seed)
    p = rng.choices(words, k=passage)
    out = []
    for _ in range(n):
        t = list(p)
        for _ in range(rng.randrange(1, max(2, int(share * passage)))):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


def test_component_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 20)
    words = [f"w{i}" for i in range(40)]
    texts = edited(320, words, 40, 0.12, 3) + edited(120, words, 25, 0.3, 4) + edited(60, words, 12, 0.3, 5)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((2, 80), (1, 70)):
        assert got(df, k=k, percent=percent, buckets=4) == brute(rows, k, percent)


def test_cells_grow_with_the_sets(spark, monkeypatch):
    """1,200 near copies in cells of 20: each is dealt three times (60 times, were all pairs of blocks cells)."""
    monkeypatch.setattr(jaccard_join, "CELL", 20)
    dealt = []
    real = jaccard_join.cell_links
    monkeypatch.setattr(jaccard_join, "cell_links", lambda cells, rows, *a: (dealt.append((cells.count(), rows, cells.groupBy("c", "i", "j").count().agg(F.max("count")).first()[0])), real(cells, rows, *a))[1])
    texts = edited(1200, [f"w{i}" for i in range(500)], 120, 0.03, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = got(df, k=1, percent=80, buckets=4)
    assert {c for _, _, c in out} == {0}
    assert sum(n for n, _, _ in dealt) <= 4 * len(set(texts)) and all(n == rows for n, rows, _ in dealt) and max(b for _, _, b in dealt) <= 4 * 20


def test_places_of_templated_pages(spark):
    """Pages that share a template but are not similar enough have no place left to meet at."""
    rows = [(i, 100, list(range(1000, 1086))) for i in range(50)]
    cand = spark.createDataFrame(rows, "sid long, n long, keys array<long>")
    assert prefix_places(cand, 85).count() == 0
    assert prefix_places(spark.createDataFrame([(i, 100, list(range(1000, 1095))) for i in range(50)], "sid long, n long, keys array<long>"), 85).count() > 0

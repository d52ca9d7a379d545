import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.brute import az, shingles

LANGS = {"en": "the cat and dog was here with some words for that house on hill".split(), "de": "der hund und die katze war hier mit dem haus auf berg".split(),
         "fr": "le chat et la chienne dans une maison avec des mots pour que".split()}


def fixture():
    rng = random.Random(11)
    rows = []
    for i in range(150):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choices(LANGS[lang], k=rng.randrange(8, 60))), lang, f"src{rng.choice([0, 0, 0, 1, 2, 3])}", 0, "x"))
    for i in range(40):                                  # exact and near copies
        t = rng.choice(rows[:150])
        w = t[1].split()
        if i % 2:
            w[0] = w[0] + "x"
        rows.append((200 + i, " ".join(w).upper() if i % 4 == 0 else " ".join(w), t[2], t[3], 0, "y"))
    rows += [(300, None, "en", "src1", None, None), (301, "", None, None, 0, None), (302, "12 34 !!", "en", "src0", 0, "z"), rows[3], rows[3], (None, "the cat was here with some other words", None, None, None, None)]
    return rows


def test_stages_equal_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sha string").repartition(3)
    out = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        docs = docs.persist()
        out[name] = docs
    base = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    got = out["language_id"]
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "sha"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(base, key=str)
    groups = {}
    for r in base:
        groups.setdefault(az(r[1]), []).append(r)
    want = [min((r for r in g), key=lambda r: (r[0] is not None, r[0] or 0)) if any(r[0] is None for r in g) and len(g) == 1 else
            min((r for r in g if r[0] is not None), key=lambda r: r[0]) for g in groups.values()]
    got = out["exact_dedup"].collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    left = sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    up = list(range(len(left)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(r[1], 5) for r in left]
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = [r for i, r in enumerate(left) if find(i) == i]
    assert len(want) < len(left) < len(base)
    got = out["near_dedup"].collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    tokens = {r[0]: len(r[1].split()) for r in want}
    mixed = [r["doc_id"] for r in out["source_mixing"].collect()]
    assert len(set(mixed)) == len(mixed) and set(mixed) <= set(tokens)
    assert 0.8 * sum(tokens.values()) < sum(tokens[i] for i in mixed) <= 0.9 * sum(tokens.values())
    packed = out["packing"].collect()
    assert {r["doc_id"]: r["n_tokens"] for r in packed} == {i: tokens[i] for i in mixed}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_corpus(spark):
    d = "/root/testdata/sf0.001"
    rows = P.run(spark, d).agg(F.count("*"), F.countDistinct("doc_id")).first()
    assert 100 < rows[0] == rows[1] <= 200

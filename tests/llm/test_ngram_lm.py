import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sidelines.llm import ngram_lm
from sidelines.llm.common import crc_mod
from sidelines.llm.ngram_lm import score, train

TEXTS = ["The cat sat on the mat", "the cat ate", None, "", "a dog sat on a log", "the dog the dog the cat sat", "The cat sat on the mat", "été İ ß x", "the the the the",
         "cat dog\x0blog\nmat", "one two one three one two one four one two"]


def tokens(text):
    az = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", az) + ["</s>"]


class Brute:
    """Interpolated modified Kneser-Ney by its definition."""

    def __init__(self, texts, order):
        self.order, self.c = order, {}
        top = Counter()
        for t in texts:
            w = ["<s>"] * (order - 1) + tokens(t)
            top.update(tuple(w[i:i + order]) for i in range(len(w) - order + 1))
        self.uni = Counter(x for t in texts for x in tokens(t))
        for n in range(order, 0, -1):
            self.c[n] = top
            top = Counter(g[1:] for g in top)
        self.d, self.ctx = {}, {}
        for n, c in self.c.items():
            n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
            d = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            self.d[n] = [0] + [min(max(x, ngram_lm.EDGE), k - ngram_lm.EDGE) for k, x in enumerate(d, 1)]      # inside (0, k)
            self.ctx[n] = defaultdict(list)
            for g, v in c.items():
                self.ctx[n][g[:-1]].append(v)

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.uni) + 1)
        low = self.p(gram[1:])
        seen = self.ctx[n].get(gram[:-1])
        if not seen:
            return low
        c, d = self.c[n].get(gram, 0), self.d[n]
        return (c - d[min(c, 3)]) / sum(seen) + sum(d[min(v, 3)] for v in seen) / sum(seen) * low

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(w[i:i + self.order]))) for i in range(len(w) - self.order + 1))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_definition(spark, order):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, words int").repartition(3)
    model = train(df, order=order, buckets=5)
    brute = Brute(TEXTS, order)
    n, v = sum(brute.uni.values()), len(brute.uni)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    more = TEXTS + ["never seen words the cat", "the cat sat never"]
    out = score(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), model).collect()
    for r in out:
        t = more[r["id"]]
        assert r["n_tokens"] == len(tokens(t)) and r["n_known"] == sum(x in brute.uni for x in tokens(t)) and r["train_tokens"] == n
        assert abs(r["score"] - brute.score(t)) < 1e-5
        assert abs(r["base_score"] - sum(math.log10((brute.uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))) < 1e-9
    words = [*brute.uni, "<new>"]
    assert abs(sum(brute.p(("cat",) * (order - 1) + (w,)) for w in words) - 1) < 1e-9


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = train(none, buckets=2)
    assert (model.vocabulary, model.train_tokens) == (0, 0) and score(none, model).count() == 0
    r = score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), model).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["score"] == 0


def test_query_depends_on_two_words_before(spark):
    out = {r["doc_id"]: r["score"] for r in ngram_lm.op2_ngram_lm(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = ngram_lm.train(docs.filter(~F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))), order=3)
    want = {r["id"]: r["score"] for r in ngram_lm.score(docs, model).collect()}
    assert out.keys() == want.keys() and all(abs(out[d] - want[d]) < 1e-6 for d in want)


def test_unseen_words_keep_a_probability(spark):
    """More n-grams stand four times than three times: the estimate of a discount is below 0."""
    texts = ["a b"] * 3 + ["c d"] * 4 + ["e f"] * 4 + ["g h"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    for order in (2, 3):
        model = train(docs, order=order, buckets=2)
        assert all(0 < d < k for x in model.discounts.values() for k, d in enumerate(x.tolist()[1:], 1))
        got = {r["id"]: r for r in score(spark.createDataFrame([(1, "a f"), (2, "zz yy"), (3, "a b")], "doc_id long, text string"), model).collect()}
        assert all(np.isfinite(r["score"]) and r["perplexity"] < 1e6 for r in got.values()) and got[3]["score"] > got[1]["score"]


def test_packets_hold_each_word_once():
    from sidelines.llm.ngram_lm import _blobs, _merge, _unpack
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w, h, v = _merge(vocabulary[rng.integers(0, 300, (20000, 3))], np.ones((20000, 1), np.uint32))
    batch = _blobs(w, h, v.astype(np.uint32), 4, np.zeros(0, np.uint64))
    got, values = _unpack(pa.Table.from_batches([batch]), 3, np.uint32, 1)
    back, _, sums = _merge(got, values)
    assert np.array_equal(back, w) and np.array_equal(sums, v)
    assert sum(len(x.as_py()) for c in batch.columns[1:-1] for x in c) < 20 * len(w)        # whole hashes take 28 and more


def test_files_take_few_bytes_an_ngram(spark):
    """Whole hashes of n-grams and contexts took over 20 bytes a token; numbers of words behind shared contexts take few."""
    import os
    words = np.random.default_rng(3).zipf(1.3, (400, 100)) % 3000
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(words.tolist())], "doc_id long, text string")
    model = train(docs, order=3, buckets=4)
    root = model.uri.removeprefix("file://").removeprefix("file:")
    grams = sum(os.path.getsize(f"{root}/{f}") - 128 for f in os.listdir(root) if not f.startswith("word"))
    distinct = len(set((a, b, c) for row in words.tolist() for a, b, c in zip([-1, -1, *row], [-1, *row], [*row, -2])))
    assert model.train_tokens >= 40000 and grams < 12 * distinct


def test_large_counts_and_long_contexts(spark):
    texts = ["the cat sat"] * 300 + [f"the w{i} ran" for i in range(40)] + [f"the cat v{i}" for i in range(40)]
    model = train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), order=3, buckets=3)
    brute = Brute(texts, 3)
    more = ["the cat sat", "the w7 ran", "the cat v3", "the cat new", "w1 cat sat", "ran the cat"]
    out = score(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), model).collect()
    assert all(abs(r["score"] - brute.score(more[r["id"]])) < 1e-9 for r in out)


@pytest.mark.parametrize("order", [4, 5])
def test_longer_orders_equal_definition(spark, order):
    """From order 4 on the files are sorted by a hash of a context's last words."""
    texts = TEXTS + ["one two one three one two four two one two one two one two"] * 2
    model = train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), order=order, buckets=3)
    brute, more = Brute(texts, order), texts + ["one two one two one new", "the cat sat on a log"]
    out = score(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), model).collect()
    assert len(out) == len(more) and all(abs(r["score"] - brute.score(more[r["id"]])) < 1e-9 for r in out)


def test_keys_are_ordered_like_rows():
    rng = np.random.default_rng(8)
    for width, top in ((1, 1 << 63), (3, 50), (3, 1 << 40), (5, 1 << 20), (2, 1 << 63)):
        words = rng.integers(0, top, (3000, width)).astype(np.uint64)
        words[rng.integers(0, 3000, 800)] = words[rng.integers(0, 3000, 800)]
        words[:3] = np.uint64(0xFFFFFFFFFFFFFFFF)
        got, start, times = ngram_lm._merge(words)
        want, count = np.unique(words, axis=0, return_counts=True)
        assert np.array_equal(got, want) and np.array_equal(times, count)
        assert len(start) == (len(np.unique(want[:, :-1], axis=0)) if width > 1 else 1)


def test_search_in_ranges():
    rng = np.random.default_rng(9)
    numbers = np.concatenate([np.sort(rng.choice(5000, n, replace=False)) for n in (0, 1, 2, 7, 40, 900)]).astype(np.uint16)
    edge = np.cumsum([0, 0, 1, 2, 7, 40, 900])
    ranges = np.repeat(np.concatenate([rng.integers(0, 6, 30), np.arange(6)]), 40)
    lo, hi = edge[ranges], edge[ranges + 1]
    lo[:60], hi[:30], hi[30:60] = 0, 0, 1                       # an empty range beside one that begins at the same place
    want = rng.integers(0, 5000, len(lo)).astype(np.uint64)
    want[::3] = numbers[np.minimum(lo + rng.integers(0, 900, len(lo)) % np.maximum(hi - lo, 1), len(numbers) - 1)][::3]
    want[::7] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at, there = ngram_lm._search(numbers, lo, hi, want)
    for a, b, x, i, found in zip(lo, hi, want, at, there):
        assert found == (x in numbers[a:b]) and (not found or a <= i < b and numbers[i] == x)


def test_bucket_is_merged_in_little_memory(tmp_path):
    """Whole numbers of words and hashes of n-grams took 171 bytes an n-gram of the packets; places among a bucket's words take few."""
    import tracemalloc
    rng = np.random.default_rng(5)
    vocabulary = np.unique(rng.integers(0, 1 << 40, 20000).astype(np.uint64))
    none, packets = np.zeros(0, np.uint64), []
    for _ in range(6):
        w, start, c = ngram_lm._merge(vocabulary[rng.integers(0, 20000, (50000, 3))])
        packets.append(ngram_lm._blobs(w, start, c.astype(np.uint32), 1, none))
    group = pa.Table.from_batches(packets)
    tracemalloc.start()
    names, w, v = ngram_lm._places(group, 3, np.uint32)
    w, start, c = ngram_lm._merge(w, v)
    ngram_lm._save_grams(str(tmp_path), 3, 0, names, w, start, c, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.sum() == 300000 and peak < 100 * 300000, peak / 300000


def test_each_ngram_of_a_batch_is_looked_up_once(spark, monkeypatch):
    texts = ["the cat sat on the mat"] * 50 + ["a dog sat on a log"] * 50
    model = train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=3, buckets=2)
    seen = []
    get = ngram_lm._Grams.get
    monkeypatch.setattr(ngram_lm._Grams, "get", lambda self, words: seen.append(words) or get(self, words))
    reader = ngram_lm.Reader(model)
    held = [(flat, pos) for _, _, _, pos, flat in ngram_lm._tokens(pa.array(texts), 3)]
    names, _, grams = ngram_lm._coded(held, 3, reader.words)
    p = reader.probabilities(names, grams)
    assert len(p) == 700 and len(names) == 9 + 1                # the words and the end, and the start
    for n in (1, 2, 3):
        rows = [tuple(r) for x in seen if x.shape[1] == n for r in x.tolist()]
        assert len(rows) == len(set(rows)) <= 14
        for x in (x for x in seen if x.shape[1] == n):          # contexts stand together
            assert len(ngram_lm._contexts(x)) == len({tuple(r[:-1]) for r in x.tolist()})


def test_one_python_function_a_stage(spark, monkeypatch):
    """Two in one stage take twice the Python workers, which then all stay: 1,184 MB of two cores where 691 do."""
    plans = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    train(spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string"), order=2, buckets=2)
    stages = [stage for p in plans if "FlatMapGroupsInArrow" in p for stage in re.split(r"\n.*Exchange", p)]
    assert stages and all(len(re.findall(r"(?:FlatMapGroups|Map)InArrow", stage)) <= 1 for stage in stages)

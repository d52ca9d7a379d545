import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sidelines.llm import repetition as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def definition(text):
    text = text or ""
    w = WORD.findall(text)
    out = dict.fromkeys(R.COUNTS, 0)
    out["n_words"], out["word_chars"] = len(w), sum(map(len, w))
    out["n_symbols"] = sum(text.count(c) for c in R.SYMBOLS)
    seen = set()
    for line in text.split("\n"):
        if WORD.search(line):
            out["n_lines"] += 1
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, WORD.findall(line)))
            seen.add(line)
    for n in (*R.TOP, *R.COVER):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        times = Counter(grams)
        if n in R.TOP:
            out[f"top_chars_{n}"] = max((t * sum(map(len, g)) for g, t in times.items() if t > 1), default=0)
        else:
            inside = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(n)}
            out[f"dup_chars_{n}"] = sum(len(w[i]) for i in inside)
            if n == 5:
                out["n_repeat_words"] = len(inside)
    return out


def measured(texts):
    import pyarrow as pa
    rows = np.concatenate([R.measure(d, o) for _, d, o in R.slices(pa.array(texts, pa.string()))])
    return [dict(zip(R.COUNTS, map(int, r))) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé𝒳 \n\t#| ", max_size=120)), min_size=1, max_size=6))
def test_counts_equal_the_definition(texts):
    assert measured(texts) == [definition(t) for t in texts]


def test_repeated_passages_and_long_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        w = rng.choices(vocab, k=rng.randrange(5, 400))
        for _ in range(3):
            a, b = rng.randrange(len(w)), rng.randrange(2, 30)
            w[rng.randrange(len(w)):0] = w[a:a + b]
        texts.append("".join(x + rng.choice([" ", " ", "\n", "  "]) for x in w))
    texts += ["", None, "one", "a\na\n\n a\na", "same line\n" * 500, " ".join(rng.choices(vocab, k=120_000)) + " tail " * 12]
    assert measured(texts) == [definition(t) for t in texts]


def test_colliding_hashes_are_told_apart(monkeypatch):
    """With all hashes equal only the exact comparison is left."""
    texts = ["a b c d e f a b c d e g\nx y\nx y", "a b c d e f", "p q\nr s"]
    monkeypatch.setattr(R, "window", lambda sums, start, end: np.zeros(len(start), R.U64))
    assert measured(texts) == [definition(t) for t in texts]


def test_rows_nulls_verdicts_and_extra_columns(spark):
    clean = "the quick brown fox jumps over a lazy dog while seven zebras watch from some far hill"
    rows = [(1, clean, 7), (1, clean, 7), (2, None, 0), (3, "", 0), (4, "too short", 0), (5, "buy it now and save a lot today\n" * 9, 0),
            (None, clean, 0), (6, clean + " ###" * 3, 0), (7, clean + "\n" + clean, 0)]
    out = R.judge(R.repetition(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))).collect()
    got = sorted(((r["id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in out))
    assert got == [(0, 17, False, True), (1, 17, False, True), (1, 17, False, True), (2, 0, True, False), (3, 0, True, False), (4, 2, True, False),
                   (5, 72, True, False), (6, 20, False, False), (7, 34, True, False)]
    assert R.judge(R.repetition(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_limits_decide_at_equality(spark):
    rows = [(1, 20, 100, 2, 10, 3, 0, 0, 0, 0, 0, 15, 0, 0, 0, 0, 0), (2, 20, 100, 2, 10, 3, 0, 0, 0, 0, 0, 16, 0, 0, 0, 0, 0),
            (3, 20, 100, 3, 10, 3, 0, 0, 0, 0, 0, 15, 0, 0, 0, 0, 0), (4, 20, 100, 2, 10, 4, 0, 0, 0, 0, 0, 15, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{c} long" for c in R.COUNTS]]))
    assert {r["id"]: r["kept"] for r in R.judge(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert R.judge(df, {}).filter("kept").count() == 4


def test_corpus_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = R.judge(R.repetition(docs)).withColumnRenamed("id", "doc_id")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in out.collect():
        assert {c: r[c] for c in R.COUNTS} == definition(texts[r["doc_id"]])
    share = dict(out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert share[1] > 0.95 and share[0] < 0.25

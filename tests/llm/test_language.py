import itertools

import numpy as np
from pyspark.sql import functions as F

from sidelines.llm import language as L
from sidelines.llm.language import corpus_model, held_out, identify, train, viterbi


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(5)
    length = np.array([3, 0, 5, 1])
    score = rng.normal(size=(9, 3)).astype(np.float32) * 2
    got = viterbi(score, length, 1.5)
    at = 0
    for n in length:
        s = score[at:at + n]
        best = max(itertools.product(range(3), repeat=int(n)),
                   key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at:at + n]) == best
        at += n


def test_spans_scripts_and_empty(spark):
    rows = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("кот и собака", "ru"), (None, "en"), ("x", None)] * 3
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    assert model[0] == ["de", "en", "ru"]
    texts = ["the dog", "собака", None, "", "12 !", "– …", "the cat and the dog and the cat der Hund und die Katze und der Hund die Katze", "the dog"]
    df = spark.createDataFrame([(i, t, "zz", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    by = {r["id"]: r for r in identify(df, model, penalty=3.0).collect()}
    assert [by[i]["lang_pred"] for i in range(6)] == ["en", "ru", "und", "und", "und", "und"]
    assert by[6]["spans"] == "en:0:8,de:8:18" and abs(by[6]["score"] - 0.6) < 1e-9 and by[0]["score"] == 1
    assert by[7]["lang_pred"] == "en" and by[2]["score"] == 0
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(none, model).count() == 0
    assert identify(df, train(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(d, corpus_model(d)).withColumnRenamed("id", "doc_id").join(d.select("doc_id", "lang"), "doc_id").filter(held_out())
    n, ok = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and ok / n > 0.95


def test_code_points_and_scripts():
    text = "aZé ŵıκЖբאعहবਗગଓதతಕമසไລ\u0f40ကა한አខ漢かカ𠀀’–"
    data = np.frombuffer(text.encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    assert L.code_points(data, lead).tolist() == [ord(c) for c in text]
    kind = L.scripts_of(data, np.arange(len(data)))
    by = dict(zip(text, kind[lead].tolist()))
    assert [by[c] for c in "aZ’–"] == [0] * 4 and by["é"] == by["ŵ"] == by["ı"] == 1 and by["漢"] == by["𠀀"] and by["か"] == by["カ"]
    others = [by[c] for c in "éκЖբאعहবਗગଓதతಕമසไລ\u0f40ကა한አខ漢か"]
    assert len(set(others)) == len(others) and kind[(data & 0xC0) == 0x80].max() == 0


def test_only_candidates_score_words(monkeypatch):
    rng = np.random.default_rng(4)
    score = rng.normal(size=(L.GRAMS, 6)).astype(np.float32)
    used = np.zeros((L.SCRIPTS, 6), bool)
    used[0, :4], used[3, 4:], used[5] = True, True, True
    length = rng.integers(1, 9, 500)
    script, gram = rng.choice([0, 3, 5], 500), rng.integers(0, L.GRAMS, length.sum())
    for cells in (1 << 22, 64):
        monkeypatch.setattr(L, "SCORE_CELLS", cells)
        got = L.word_scores(gram, length, script, score, used)
        at = 0
        for w, n in enumerate(length):
            s = score[gram[at:at + n]].sum(0)
            own = used[script[w]]
            assert np.allclose(got[w, own], s[own], atol=1e-4) and np.allclose(got[w, ~own], s[own].min() - L.FAR, atol=1e-3)
            at += n


def test_two_hundred_languages_in_small_groups(spark, monkeypatch):
    """Invented languages of ten letter pairs each, some in Cyrillic."""
    rng = np.random.default_rng(2)
    alphabet = {0: "abcdefghijklmnopqrstuvwxyz", 1: "абвгдежзиклмнопрстуфхц"}
    rows, texts = [], []
    for k in range(200):
        letters = np.array(list(alphabet[k % 2]))
        words = ["".join(rng.choice(letters, 6)) for _ in range(8)]
        rows += [(" ".join(rng.choice(words, 60)), f"l{k:03}") for _ in range(3)]
        texts.append((k, " ".join(rng.choice(words, 30))))
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    big = {r["id"]: (r["lang_pred"], r["spans"]) for r in identify(docs, model).collect()}
    assert sum(big[k][0] == f"l{k:03}" for k in range(200)) >= 195
    texts = __import__("pyarrow").array([t for _, t in texts])
    monkeypatch.setattr(L, "GROUP_CELLS", 5000)
    monkeypatch.setattr(L, "SCORE_CELLS", 5000)
    assert [x[:1] + x[2:] for x in L._predict(texts, model, 12.0)] == [big[k] for k in range(200)]


def test_ties_repeated_training_rows_and_long_texts(spark):
    rows = [("uno dos tres", "b"), ("uno dos tres", "a")] * 2
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "uno dos"), (2, "uno dos tres " * 60_000)], "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in identify(docs, model).collect()}
    assert got == {1: ("a", 1.0), 2: ("a", 1.0)}

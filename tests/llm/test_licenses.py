import re

import numpy as np

from sidelines.llm import licenses
from sidelines.llm.licenses import TEMPLATES, Index, document_frequencies, license_scan, template

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORDS.findall(az(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def rows_of(df):
    return [(r["id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in df.collect()]


def test_small(spark):
    texts = ["Released under the MIT License.", None, "", "mit-license MIT\nLicense mit mit license", "É général public license",
             "GNU General Public License, version 3.", "All rights reserved", "Licensed under the Apache License, Version 2.0", "!!! ...", "mit LİCENSE"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    out = license_scan(df)
    assert dict(rows_of(out)) == {i: base(t) for i, t in enumerate(texts)}
    by = {r["id"]: r for r in out.collect()}
    assert by[0]["labels"] == "mit,mit-notice" and by[7]["labels"] == "apache,apache-2.0"
    assert by[6]["labels"] == "all-rights-reserved" and by[1]["labels"] == "" and by[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in by.values())


def test_empty_and_repeated(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "the mit license")] * 3, "doc_id long, text string")
    assert rows_of(license_scan(df)) == [(1, base("the mit license"))] * 3


def test_corpus(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(d.select("doc_id", "text").collect())
    got = rows_of(license_scan(d))
    assert len(got) == len(texts) and all(r == base(texts[i]) for i, r in got)


def test_any_word_outside_the_key_phrase_altered(spark):
    """Longer notices with one word altered, also the rarest one of the template (here: in no document)."""
    cases = [(t, i) for t in TEMPLATES for i in range(len(t.words)) if len(t.words) >= 10 and not t.key[0] <= i < t.key[1]]
    texts = [" ".join("xx" if j == i else w for j, w in enumerate(t.words)) for t, i in cases]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["id"]: r["labels"].split(",") for r in license_scan(df).collect()}
    assert all(t.label in labels[n] for n, (t, _) in enumerate(cases))
    one = spark.createDataFrame([(1, "redistributions and use in source and binary forms with or without modification are permitted")]
                                + [(i, "other words") for i in range(2, 60)], "doc_id long, text string")
    bsd = TEMPLATES[[t.label for t in TEMPLATES].index("bsd")]
    assert license_scan(one).filter("id = 1").first()["labels"] == bsd.label


def brute(text, templates, n_docs, df):
    """Labels, best score and number of places by comparing every template at every position."""
    words = WORDS.findall(az(text))
    labels, best, places = set(), 0.0, 0
    for t in templates:
        idf = np.array([np.log((n_docs + 1) / (df[w] + 1)) for w in t.words])
        weight = np.array([(x / idf.sum() + 2 / len(idf)) / 3 if idf.sum() > 0 else 1 / len(idf) for x in idf])
        for start in range(-len(t.words) + 1, len(words)):
            agree = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)]
            score = float(weight[agree].sum())
            if all(agree[t.key[0]:t.key[1]]) and score >= t.threshold - 1e-9:
                labels.add(t.label)
                best, places = max(best, score), places + 1
    return ",".join(sorted(labels)), round(best, 9), places


def texts_with_notices(rng, templates, n):
    out = [None, "", "no licence here"]
    for _ in range(n):
        w = list(rng.choice("lorem ipsum of the in to and software license public copy use".split(), rng.integers(0, 60)))
        for _ in range(rng.integers(1, 3)):
            t = list(templates[rng.integers(len(templates))].words)
            for _ in range(rng.integers(0, 1 + len(t) // 5)):
                t[rng.integers(len(t))] = "changed"
            at = rng.integers(0, len(w) + 1)
            w[at:at] = t[rng.integers(0, 2):len(t) - rng.integers(0, 2)]
        out.append(" ".join(w))
    return out


def test_labels_and_scores_equal_all_templates_at_all_positions(spark):
    rng = np.random.default_rng(3)
    texts = texts_with_notices(rng, TEMPLATES, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    n, df = document_frequencies(docs, TEMPLATES)
    got = {r["id"]: (r["labels"], round(r["score"], 9), r["n_places"]) for r in license_scan(docs).collect()}
    assert got == {i: brute(t, TEMPLATES, n, df) for i, t in enumerate(texts)} and len({x[0] for x in got.values()}) > 10


def test_many_templates_and_words_without_weight(spark):
    rng = np.random.default_rng(9)
    vocab = np.array([f"w{i}" for i in range(400)])
    many = tuple(template(f"t{i}", " ".join(w := rng.choice(vocab, rng.integers(3, 30))), w[1]) for i in range(300))
    texts = texts_with_notices(rng, many, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, df = document_frequencies(docs, many)
    got = {r["id"]: (r["labels"], round(r["score"], 9), r["n_places"]) for r in license_scan(docs, templates=many).collect()}
    assert got == {i: brute(t, many, n, df) for i, t in enumerate(texts)}
    every = spark.createDataFrame([(i, "a b c d e") for i in range(5)], "doc_id long, text string")       # each word in every document
    flat = (template("x", "a b c d e", "b"), template("y", "a b z d e", "b"))
    assert {(r["labels"], r["score"]) for r in license_scan(every, templates=flat).collect()} == {("x", 1.0)}


def test_votes_follow_the_rare_words_not_the_templates():
    """Templates whose rare words a text does not hold get no candidate from it."""
    many = tuple(template("a", "the common words " + f"rare{i} and end{i}", f"rare{i}") for i in range(500))
    df = {w: 1 if w[-1].isdigit() else 900 for w in licenses.vocabulary(many)}
    index = Index.of(many, 1000, df)
    import pyarrow as pa
    (n, bounds, word), = licenses._file_words(pa.array(["the common words and the common words rare7 and end7"]), index.known)
    row, temp, start = index.candidates(bounds, word)
    assert n == 1 and list(zip(row.tolist(), temp.tolist(), start.tolist())) == [(0, 7, 4)]


def test_notices_with_a_word_altered_near_the_key(spark):
    texts = ["Permission is hereby granted, free of charge, to any persons obtaining a copy of this software",
             "Redistribution and use in source and binary form, with or without modification, are permitted", licenses.MIT, licenses.BSD_3, licenses.APACHE]
    docs = spark.createDataFrame(list(enumerate(texts + ["other words"] * 30)), "doc_id long, text string")
    labels = {r["id"]: r["labels"].split(",") for r in license_scan(docs).collect()}
    assert "mit-notice" in labels[0] and "bsd" in labels[1] and "mit-notice" in labels[2] and "bsd-3" in labels[3] and "apache-2.0" in labels[4]

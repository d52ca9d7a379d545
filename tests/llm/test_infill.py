import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sidelines.llm.infill import (ArrayContainer, BitmapContainer, BoundarySet, RunContainer, boundaries, container, infill, rebuild,
                                  restore, transform)


def definition(text, i):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b], a, b - a
    return n, "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b], a, b - a


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="<PSM>é𝒳a \n", max_size=40)), st.integers(-2 ** 62, 2 ** 62))
def test_transform_equals_the_definition_and_round_trips(text, i):
    text = text.encode("utf-8", "ignore").decode()
    got = transform(text, i)
    assert got == definition(text, i)
    assert rebuild(got[2], got[1]) == text


def test_containers_select_every_member():
    rng = np.random.default_rng(3)
    for members, kind in ((np.array([0]), ArrayContainer), (np.sort(rng.choice(65536, 300, False)), ArrayContainer),
                          (np.sort(rng.choice(65536, 9000, False)), BitmapContainer), (np.arange(65536), RunContainer),
                          (np.concatenate([np.arange(10, 2000), np.arange(2100, 65536)]), RunContainer)):
        c = container(members)
        assert isinstance(c, kind)
        for k in [*range(0, len(members), 97), len(members) - 1]:
            assert c.select(k) == members[k]


def test_select_across_containers():
    rng = np.random.default_rng(4)
    members = np.unique(np.concatenate([rng.choice(65536, 50), 65536 * 3 + rng.choice(65536, 20000), 65536 * 5 + np.arange(60000)]))
    s = BoundarySet.of(members)
    assert len(s) == len(members) and {type(c) for c in s.containers} == {ArrayContainer, BitmapContainer, RunContainer}
    assert [s.select(k) for k in range(0, len(members), 31)] == members[::31].tolist()
    full = BoundarySet.full(200_000)
    assert [full.select(k) for k in (0, 65535, 65536, 131072, 200_000)] == [0, 65535, 65536, 131072, 200_000]
    with pytest.raises(IndexError):
        full.select(200_001)


def test_units():
    text = " ab  cd\n\néf g"
    data = text.encode()
    for unit, pieces in (("char", list(text)), ("word", re.findall(r"^\s+|\S+\s*", text)), ("line", re.findall(r"[^\n]*\n|[^\n]+$", text))):
        s = boundaries(data, unit)
        at = [s.select(k) for k in range(len(s))]
        assert [data[a:b].decode() for a, b in zip(at, at[1:])] == pieces
    with pytest.raises(ValueError):
        boundaries(data, "page")


def test_long_texts():
    for text in ("x" * 300_000, "aé" * 150_000, "𝒳" * 70_000 + "b" * 70_000):
        for i in range(12):
            got = transform(text, i)
            assert got == definition(text, i) and rebuild(got[2], got[1]) == text


def test_rows_nulls_and_extra_columns(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", None), (None, "some text", None), (4, "a<P>b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    out = restore(infill(docs)).collect()
    assert sorted(((r["id"], r["n"], r["form"], r["output"], r["prefix_units"], r["middle_units"], r["restored"]) for r in out), key=str) == sorted(
        ((i, *(d := definition(t, i))[:3], d[3], d[4], t or "") for i, t, _ in rows), key=str)
    assert restore(infill(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_corpus(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(d.select("doc_id", "text").collect())
    got = restore(infill(d)).collect()
    assert len(got) == len(texts) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["output"], r["prefix_units"], r["middle_units"]) == definition(texts[r["id"]], r["id"])
        assert r["restored"] == (texts[r["id"]] or "")

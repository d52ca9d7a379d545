"""Quality rules from repetition coverage, by rolling hashes of several n-gram lengths.

Words stand between ASCII white space, lines between line feeds; both are
compared exactly (case counts).  For each text:

* ``dup_chars_n`` for n of 5 to 10: code points of the words that lie in an
  n-word window which stands twice or more in the text (the first included);
  overlapping windows count their words once;
* ``n_repeat_words``: how many words lie in such windows of five words;
* ``top_chars_n`` for n of 2 to 4: the largest product of occurrences and code
  points among the n-word sequences that stand twice or more;
* ``n_dup_lines``, ``dup_line_chars``: lines with a word that equal an earlier
  line of the text, and the code points of their words.

One ``mapInArrow`` without a shuffle.  A batch is cut into runs of whole texts
of about a megabyte, and numpy works on the run's bytes: prefix sums of a
polynomial hash give every word's and line's hash, prefix sums over the words'
hashes roll every window length over all texts at once.  Equal hashes are only
candidates: words and lines are compared byte by byte with the first of their
hash, windows word by word, and a run with a collision is numbered anew from
the words themselves.  Results are therefore exact.

:func:`judge` turns the counts into a verdict with integer comparisons.

Defined results: a NULL or empty text has no words and all counts 0; repeated
rows are judged alike, each alone; an empty table gives no rows; further
columns are ignored.  A text longer than a megabyte is a run of its own, whole:
a task needs about 100 bytes for each byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.llm.arrays import U64, _power_tables, doc_bounds, mix, slices, words
from sidelines.llm.catalog import register
from sidelines.llm.common import table

TOP, COVER = (2, 3, 4), (5, 6, 7, 8, 9, 10)
SYMBOLS = "#*$%&|<>"
#: Largest share, in per cent, of a text's word characters, lines or words (published rules for web text).
LIMITS = {"symbols": 10, "dup_lines": 30, "dup_line_chars": 20, "top_chars_2": 20, "top_chars_3": 18, "top_chars_4": 16,
          "dup_chars_5": 15, "dup_chars_6": 14, "dup_chars_7": 13, "dup_chars_8": 12, "dup_chars_9": 11, "dup_chars_10": 10}

_BITS = mix((np.arange(256, dtype=U64) + U64(257)) * U64(0x9E3779B97F4A7C15))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: What a limit compares, where it is not the count of its name with the word characters.
_SHARE = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words",
          *[f"top_chars_{n}" for n in TOP], *[f"dup_chars_{n}" for n in COVER]]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values`` times powers of the base; :func:`window` reads any range's hash from them."""
    return _prefix(values * _power_tables(len(values) + 1)[0][:len(values)])


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``start`` up to ``end``, wherever they stand."""
    down = _power_tables(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def first_like(hashes: np.ndarray) -> np.ndarray:
    """For each item the first item with its hash."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _spans_like(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first span of the same group with the same bytes, for each span."""
    head = first_like(hashes)
    again = np.flatnonzero(head != np.arange(len(head)))
    size, of = (end - start)[again], head[again]
    same = np.array_equal(size, (end - start)[of]) and np.array_equal(group[again], group[of])
    if same and len(again):
        at = np.repeat(start[again], size) + np.arange(size.sum()) - np.repeat(_prefix(size)[:-1], size)
        same = np.array_equal(data[at], data[at + np.repeat(start[of] - start[again], size)])
    if not same:                                     # two spans share a hash: number them by their bytes
        known: dict = {}
        for i, key in enumerate(zip(group.tolist(), (data[a:b].tobytes() for a, b in zip(start, end)))):
            head[i] = known.setdefault(key, i)
    return head


def _windows_like(word: np.ndarray, sums: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The first window of ``n`` words in the same text that has the same words, for each window (by place in ``at``)."""
    head = first_like(mix(window(sums, at, at + n) + mix(doc[at].astype(U64) + U64(1))))
    again = np.flatnonzero(head != np.arange(len(head)))
    a, b = at[again], at[head[again]]
    if not (np.array_equal(doc[a], doc[b]) and all(np.array_equal(word[a + j], word[b + j]) for j in range(n))):
        rows = np.stack([doc[at], *[word[at + j] for j in range(n)]], axis=1)
        _, first, back = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        head = first[back.ravel()]
    return head


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, COUNTS] of a run of whole texts."""
    texts = len(offsets) - 1
    out = {c: np.zeros(texts, np.int64) for c in COUNTS}
    start, end, doc = words(data, offsets)
    out["n_symbols"] = np.diff(_prefix(_SYMBOL[data].astype(np.int64))[offsets])
    if not len(start):
        return np.stack([out[c] for c in COUNTS], axis=1)

    def per_text(which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.bincount(which, weight, texts).astype(np.int64)      # exact below 2**53

    points = _prefix(((data & 0xC0) != 0x80).astype(np.int64))
    chars = points[end] - points[start]
    out["n_words"], out["word_chars"] = np.bincount(doc, minlength=texts), per_text(doc, chars)
    bytes_ = rolling(_BITS[data])
    word = _spans_like(data, start, end, np.zeros(len(start), np.int64), window(bytes_, start, end))

    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]])
    stop = np.where(data[stop - 1] == 10, stop - 1, stop)              # a line without its line feed
    first, last = np.searchsorted(start, begin), np.searchsorted(start, stop)
    filled = first < last
    begin, stop, first, last = begin[filled], stop[filled], first[filled], last[filled]
    of = doc[first]
    like = _spans_like(data, begin, stop, of, mix(window(bytes_, begin, stop) + mix(of.astype(U64) + U64(1))))
    again = like != np.arange(len(like))
    sums = _prefix(chars)
    out["n_lines"] = np.bincount(of, minlength=texts)
    out["n_dup_lines"] = np.bincount(of[again], minlength=texts)
    out["dup_line_chars"] = per_text(of[again], (sums[last] - sums[first])[again])

    left = doc_bounds(doc, texts)[1:][doc] - np.arange(len(doc))       # words from here to the text's end
    hashes = rolling(mix(word.astype(U64) + U64(1)))
    for n in (*TOP, *COVER):
        at = np.flatnonzero(left >= n)
        if not len(at):
            break
        like = _windows_like(word, hashes, at, doc, n)
        times = np.bincount(like, minlength=len(at))
        if n in TOP:
            some = np.flatnonzero(times > 1)
            size = times[some] * (sums[at[some] + n] - sums[at[some]])
            np.maximum.at(out[f"top_chars_{n}"], doc[at[some]], size)
            continue
        twice = at[times[like] > 1]
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + n, -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        out[f"dup_chars_{n}"] = per_text(doc[inside], chars[inside])
        if n == 5:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=texts)
    return np.stack([out[c] for c in COUNTS], axis=1)


_OUT = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [measure(data, offsets) for _, data, offsets in slices(b.column(1))]
        if done:
            counts = np.concatenate(done)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))]], schema=_OUT)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the counts above."""
    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return d.mapInArrow(_scan, ", ".join(["id bigint", *[f"{c} bigint" for c in COUNTS]]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(measured: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Rows of :func:`repetition` with ``base_failed`` and ``kept``: no share above its limit in per cent."""
    limits = LIMITS if limits is None else limits
    good = ~base_failed()
    for name, most in limits.items():
        part, whole = _SHARE.get(name, (name, "word_chars"))
        good = good & (100 * F.col(part) <= most * F.col(whole))
    return measured.withColumns({"base_failed": base_failed(), "kept": good})


def _sql() -> str:
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, array_to_string(w[i:i + {n - 1}], ' ') AS g, "
                               f"list_sum([length(x) for x in w[i:i + {n - 1}]]) AS c FROM spots WHERE i + {n - 1} <= len(w)"
                               for n in (*TOP, *COVER))
    top = ", ".join(f"max(times * c) FILTER (n = {n}) AS top_chars_{n}" for n in TOP)
    cover = ", ".join(f"sum(c) FILTER (n = {n}) AS dup_chars_{n}" for n in COVER)
    names = [*[f"top_chars_{n}" for n in TOP], *[f"dup_chars_{n}" for n in COVER]]
    shares = [(*_SHARE.get(k, (k, "word_chars")), v) for k, v in LIMITS.items()]
    limits = " AND ".join(f"100 * {part} <= {most} * {whole}" for part, whole, most in shares)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, count(*) AS times, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS k,
              length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c FROM l GROUP BY doc_id, line),
lines AS (SELECT doc_id, sum(times) AS n_lines, sum(times - 1) AS n_dup_lines, sum((times - 1) * c) AS dup_line_chars FROM l1 WHERE k > 0 GROUP BY doc_id),
g AS ({grams}),
gg AS (SELECT doc_id, n, g, c, count(*) AS times, list(i) AS places FROM g GROUP BY doc_id, n, g, c HAVING count(*) > 1),
tops AS (SELECT doc_id, {top} FROM gg GROUP BY doc_id),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS i
           FROM (SELECT doc_id, n, unnest(places) AS p FROM gg WHERE n >= 5)),
covered AS (SELECT s.doc_id, {cover}, count(*) FILTER (n = 5) AS n_repeat_words
            FROM (SELECT inside.doc_id, n, length(w[i]) AS c FROM inside JOIN w USING (doc_id)) s GROUP BY s.doc_id),
counts AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
       {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *names])}
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND {limits} AS kept FROM base
"""


@register("op11_repetition", _sql())
def op11_repetition(spark, sf_dir):
    """Repetition counts and the verdict of every document."""
    return judge(repetition(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")

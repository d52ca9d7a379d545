"""Fill-in-the-middle transformation with a Roaring-style set of cut offsets.

A text is cut into units (code points, words with the white space after them,
or lines).  Every place where a unit begins, and the end of the text, is a
member of the text's boundary set: byte offsets in UTF-8, kept as in a Roaring
bitmap.  The high bits of an offset choose a container of 2**16 offsets, and a
container is the smallest of

* an array of sorted 16-bit offsets,
* a bitmap of 2**16 bits with the number of members before each 64-bit word,
* runs (first offset, last offset) with the number of members before each run.

Cumulative cardinalities stand beside the containers.  The k-th cut is found by
a binary search in them and a select inside one container, so both cuts are
byte offsets into the text and the parts are slices of its bytes.

The cuts and the form come from a seeded hash of the id, so that a repeated
task or another engine chooses the same.  ``plain`` leaves the text as it is:
an empty text, one that holds a marker, and the share that is not to be
transformed.  ``psm`` and ``spm`` put the markers before the parts.

:func:`rebuild` reads the text back from the output and the form.  Each marker
has its only ``<`` at its beginning and no part holds a marker, so no marker
can lie across a part's end, and the first one found is the true one.

Defined results: a NULL text is an empty one and stays plain; a NULL id is
hashed as an empty id; rows are independent, so repeated rows get equal
answers, an empty table gives no rows, and further columns are ignored.  The
boundary set of a text is a few bytes for each 2**16 bytes where units follow
each other without gaps (ASCII, code points) and at most 8 KB otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import table

MARKERS = ("<P>", "<S>", "<M>")
CHUNK = 1 << 16
#: Members up to which a sorted array is not longer than a bitmap (2 bytes each against 8 KB).
ARRAY_TO = 4096


class ArrayContainer:
    """Sorted 16-bit members."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit per possible member and the number of members before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1                       # drop the lowest member
        return 64 * w + (word & -word).bit_length() - 1


class RunContainer:
    """First and last member of each run and the number of members before it."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        self.first, self.last = first.astype(np.uint16), last.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(last.astype(np.int64) - first + 1)])

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[r]) + k - int(self.before[r])


def container(low: np.ndarray):
    """The smallest container of the sorted members ``low`` (0 to 65535)."""
    breaks = np.flatnonzero(np.diff(low) != 1)
    runs = len(breaks) + 1
    if 4 * runs < min(2 * len(low), CHUNK // 8):
        return RunContainer(low[np.concatenate([[0], breaks + 1])], low[np.concatenate([breaks, [len(low) - 1]])])
    return ArrayContainer(low) if len(low) <= ARRAY_TO else BitmapContainer(low)


class BoundarySet:
    """Sorted distinct offsets in containers by their high bits."""

    def __init__(self, keys: list[int], containers: list, sizes: list[int]):
        self.keys, self.containers = keys, containers
        self.before = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])

    @classmethod
    def of(cls, offsets: np.ndarray) -> BoundarySet:
        high = offsets >> 16
        keys, start = np.unique(high, return_index=True)
        parts = np.split(offsets & (CHUNK - 1), start[1:])
        return cls(keys.tolist(), [container(p) for p in parts], [len(p) for p in parts])

    @classmethod
    def full(cls, end: int) -> BoundarySet:
        """All of 0 to ``end``, without listing them: one run for each chunk."""
        sizes = [min(CHUNK, end + 1 - a) for a in range(0, end + 1, CHUNK)]
        return cls(list(range(len(sizes))), [RunContainer(np.array([0]), np.array([n - 1])) for n in sizes], sizes)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The ``k``-th smallest member, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return (self.keys[c] << 16) + self.containers[c].select(k - int(self.before[c]))


def boundaries(data: bytes, unit: str = "char") -> BoundarySet:
    """Where the units of a text begin, and where it ends."""
    if unit == "char" and data.isascii():
        return BoundarySet.full(len(data))
    b = np.frombuffer(data, np.uint8)
    if unit == "char":
        begins = (b & 0xC0) != 0x80
    else:
        space = (b == 10) if unit == "line" else (b == 32) | ((b >= 9) & (b <= 13))
        if unit not in ("word", "line"):
            raise ValueError(unit)
        begins = np.concatenate([[True], space[:-1] & (~space[1:] | (unit == "line"))]) if len(b) else np.zeros(0, bool)
    return BoundarySet.of(np.concatenate([np.flatnonzero(begins), [len(b)]]))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str | None, doc_id: int | None, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char"):
    """(units, form, output, units of the prefix, units of the middle); the last two None if plain."""
    text = text or ""
    data = text.encode()
    cuts = boundaries(data, unit)
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, to = cuts.select(a), cuts.select(b)
    prefix, middle, suffix = data[:at].decode(), data[at:to].decode(), data[to:].decode()
    p, s, m = MARKERS
    if h4 % 100 < spm:
        return n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a
    return n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a


def rebuild(output: str, form: str) -> str:
    """The text that ``transform`` turned into ``output``."""
    if form == "plain":
        return output
    p, s, m = MARKERS
    one, two = (p, s) if form == "psm" else (s, p)
    at = output.index(two, len(one))
    to = output.index(m, at + len(two))
    first, second, middle = output[len(one):at], output[at + len(two):to], output[to + len(m):]
    return first + middle + second if form == "psm" else second + middle + first


_MADE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()),
                   ("middle_units", pa.int64()), ("output", pa.string())])
_BUILT = pa.schema([*_MADE, ("restored", pa.string())])
_DDL = "id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def infill(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (units), form, prefix_units, middle_units, output.

    ``rate``: per cent of texts that are transformed; ``spm``: per cent of those that put the suffix first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                n, form, out, before, inside = transform(text.as_py(), i, seed, rate, spm, unit)
                rows.append((i, n, form, before, inside, out))
            yield _emit(rows, _MADE)

    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, _DDL)


def restore(made: DataFrame) -> DataFrame:
    """Rows of :func:`infill` with the text rebuilt from output and form alone, as ``restored``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [rebuild(o.as_py(), f.as_py()) for o, f in zip(b.column("output"), b.column("form"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], schema=_BUILT)

    return made.select(*_MADE.names).mapInArrow(run, f"{_DDL}, restored string")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@register("op13_infill", SQL)
def op13_infill(spark, sf_dir):
    """Every document's fill-in-the-middle form, with digests of the output and of the text rebuilt from it."""
    done = restore(infill(table(spark, sf_dir, "documents")))
    return done.select(F.col("id").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"),
                       F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))

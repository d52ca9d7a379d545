"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and identifier cues.  Local, deterministic parsers expand each
anchor to the span's boundaries and validate it (number ranges, Luhn, mod 97).
No pattern is searched for over the whole text.

Kinds, in the order of the output:

* ``email``, ``ip``, ``card``, ``phone``: exactly the base patterns below,
  leftmost and non-overlapping per kind; a match that fails its check is
  dropped and not retried.
* ``url``: a scheme anchor (``http://``, ``https://``, ``ftp://``) and what
  follows up to white space, quotes or angle brackets, without closing
  punctuation.
* ``street``: a house number before and a street cue (``street``, ``avenue``..) after
  one to three capitalised words.
* ``iban``: two capital letters, two digits and 11 to 30 letters or digits that pass mod 97: of the
  country's length, else the longest that ends a word.
* ``account``: 6 to 34 letters, digits or hyphens with at least 6 digits after
  an account cue (``account``, ``acct``, ``passport``, ``ssn``..) and up to three words without a digit.

Offsets are code points, end exclusive.  Defined results: a NULL or empty text
has no spans; rows are independent, so repeated rows get equal answers and an
empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sidelines.llm.catalog import register
from sidelines.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "street", "iban", "account")
#: Anchors (fixed values).
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://")
STREETS = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", " Straße", " Strasse")
CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "passport", "Passport", "SSN", "ssn", "IBAN", "Konto", "konto")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?:\x20?(?i:number|nummer|no|nr|id))?[.:#\x20=]{0,4}([A-Za-z0-9-]{6,34})")
_FILLER = re.compile(r"(?:(?i:number|nummer|no|nr|id)|[.:#\x20=]{1,4}[A-Za-z-]+)(?![A-Za-z0-9-])")
#: Lengths of the countries' IBANs (fixed values); of other countries, lengths are tried.
IBAN_LENGTHS = dict(zip("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split(),
                        (24, 20, 16, 22, 21, 28, 24, 22, 18, 20, 24, 18, 27, 22, 27, 21, 28, 22, 26, 27, 21, 20, 20, 21, 27, 31, 18, 15, 28, 25, 24, 24, 19, 24, 27, 26)))
_STREET = re.compile(r"(?<![0-9])[0-9]{1,5}(?:\x20[A-Z][^\W\d_]+){1,3}$")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, all_of in (("scheme", SCHEMES), ("street", STREETS), ("cue", CUES)):
        for w in all_of:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    left = 0
    for c in moved:
        v = int(c, 36)
        left = (left * (100 if v > 9 else 10) + v) % 97
    return left == 1


def _byte_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN at ``start`` ends, at most at ``end``."""
    ends = [i + 1 for i in range(start, end) if text[i] != " "]          # by number of letters and digits
    own = IBAN_LENGTHS.get(text[start:start + 2], 0)
    whole = text[start:end].replace(" ", "")
    lengths = [n for n in range(len(whole), 14, -1) if n == len(whole) or not text[ends[n - 1]].isalnum()]
    return next((ends[n - 1] for n in ([own] if 15 <= own <= len(whole) else []) + lengths if _mod97(whole[:n])), None)


def _account_span(text: str, at: int) -> tuple[int, int] | None:
    """The number after an account cue that ends at ``at``."""
    for _ in range(4):
        m = _ACCOUNT.match(text, at)
        if m and sum("0" <= c <= "9" for c in m[1]) >= 6:
            return m.span(1)
        word = _FILLER.match(text, at)
        if not word:
            return None
        at = word.end()
    return None


def find_spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind; per kind in order and without overlaps."""
    out: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys((*KINDS, "_ip", "_card"), 0)   # where the last match of a kind ended

    def put(kind: str, start: int, end: int) -> None:
        out.setdefault(kind, []).append((start, end))
        done[kind] = end

    for last, (what, size) in anchors.iter(text):
        at = last + 1 - size
        if what == "digit":
            if at >= done["_card"]:
                m = _CARD.match(text, at)
                if m:
                    done["_card"] = m.end()
                    digits = re.sub("[^0-9]", "", m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        put("card", at, m.end())
                else:
                    done["_card"] = at + 1
            if at >= done["_ip"]:
                m = _IP.match(text, at)
                if m:
                    done["_ip"] = m.end()
                    if all(map(_byte_number, m[0].split("."))):
                        put("ip", at, m.end())
                else:                      # no match begins inside the same run of digits
                    end = at + 1
                    while end < len(text) and "0" <= text[end] <= "9":
                        end += 1
                    done["_ip"] = end
            if at >= 3 and at >= done["iban"] and "A" <= text[at - 1] <= "Z" and "A" <= text[at - 2] <= "Z" and not text[at - 3].isalnum() or at == 2:
                m = _IBAN.match(text, at - 2)
                if m:
                    end = _iban_end(text, at - 2, m.end())
                    if end:
                        put("iban", at - 2, end)
        elif what == "at":
            start, floor = at, done["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                m = _DOMAIN.match(text, at + 1)
                if m:
                    put("email", start, m.end())
        elif what == "plus":
            if at >= done["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    n = sum("0" <= c <= "9" for c in m[0])
                    if 8 <= n <= 15:
                        put("phone", at, m.end())
                    else:
                        done["phone"] = m.end()
        elif what == "scheme":
            if at >= done["url"]:
                m = _URL.match(text, last + 1)
                if m:
                    end = m.end()
                    while text[end - 1] in ".,;:!?)]":
                        end -= 1
                    if end > last + 1:
                        put("url", at, end)
        elif what == "street":
            m = _STREET.search(text, max(done["street"], at - 80), at)
            if m and not text[last + 1:last + 2].isalpha():
                put("street", m.start(), last + 1)
        elif at >= done["account"]:
            span = _account_span(text, last + 1)
            if span:
                put("account", *span)
    return out


def _listed(found: dict, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found.get(k, ()))


SCHEMA = "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
_OUT = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()),
                  ("spans", pa.string()), ("n_spans", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = _automaton()
    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = find_spans(text.as_py() or "", anchors)
            base = _listed(found, BASE)
            rows.append((i, *[len(found.get(k, ())) for k in BASE], hashlib.sha256(base.encode()).hexdigest(),
                         _listed(found, KINDS), sum(map(len, found.values()))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)] if rows else
                                         [pa.array([], f.type) for f in _OUT], schema=_OUT)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, their digest, all spans."""
    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return d.mapInArrow(_scan, SCHEMA)


@register("op1_pii")
def op1_pii(spark, sf_dir):
    """Personal data in every whole text."""
    return pii_spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

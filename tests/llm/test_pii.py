import hashlib
import re

from sidelines.llm.pii import KINDS, _automaton, find_spans, luhn, pii_spans

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    """The base patterns, searched over the whole text."""
    out = {}
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.setdefault(kind, []).append(m.span())
    return out


CASES = ["", "no data", "a@b.c@d.e f@g", "x@y.z.-w@v.u", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "007.1.1.1 12.3.4.5",
         "4041894974608795 and 4041-8949 7460 8795 5", "+1 (988) 555-2485 +1+49 30 1234567", "++12345678", "é a.b+c@x-y.zz ü",
         "1" * 5000, "5 4041894974608795", "@@ a@b@c.d"]


def test_base_kinds_equal_the_patterns():
    a = _automaton()
    for text in CASES:
        found = find_spans(text, a)
        assert {k: v for k, v in found.items() if k in PATTERNS} == base_spans(text), text


def test_method_spans():
    text = "See https://a.example/x?y=1). IBAN DE89 3704 0044 0532 0130 00, 12 Green Hill Street; account no. 12345678."
    found = find_spans(text, _automaton())
    assert [text[s:e] for s, e in found["url"]] == ["https://a.example/x?y=1"]
    assert [text[s:e] for s, e in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[s:e] for s, e in found["street"]] == ["12 Green Hill Street"]
    assert [text[s:e] for s, e in found["account"]] == ["12345678"]
    assert set(found) <= set(KINDS)


def test_rows_nulls_and_extra_columns(spark):
    rows = [(1, "a@b.cd", 0), (1, "a@b.cd", 0), (2, None, 0), (None, "", 0)]
    out = pii_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted((r["id"] or 0, r["n_email"], r["spans"]) for r in out) == [(0, 0, ""), (1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, "")]
    assert out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_corpus_equals_the_patterns(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(d.select("doc_id", "text").collect())
    for r in pii_spans(d).collect():
        want = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in base_spans(texts[r["id"]]).get(k, []))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_boundaries_before_further_words():
    a = _automaton()
    for text, kind, want in (
            ("pay DE89 3704 0044 0532 0130 00 Please pay", "iban", ["DE89 3704 0044 0532 0130 00"]),
            ("GB82WEST12345698765432 Contact us", "iban", ["GB82WEST12345698765432"]),
            ("GB82 WEST 1234 5698 7654 32 CONTACT 24 HOURS", "iban", ["GB82 WEST 1234 5698 7654 32"]),
            ("DE89370400440532013001 Please", "iban", []),
            ("Account Number: 12345678 is mine", "account", ["12345678"]),
            ("the account number is 12345678 as agreed", "account", ["12345678"]),
            ("Passport No is C01X00478 and", "account", ["C01X00478"]),
            ("Kontonummer lautet 12345678 bei", "account", ["12345678"]),
            ("account statement without any number at all 12345678", "account", [])):
        assert [text[s:e] for s, e in find_spans(text, a).get(kind, [])] == want, text

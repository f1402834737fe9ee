"""Personal data against Python's regular expressions and plain checks."""

import hashlib
import re
import time

from fixtures import SMALL, documents, odd_rows
from marketloom.llm.pii_spans import personal_data, pii_digest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [
        (m.start(), i, m.end(), kind)
        for i, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "") if valid(kind, m.group())
    ]
    return sorted(found)


def check(rows, got):
    expected = {}
    for i, text in rows:
        found = base(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()
        counts = tuple(sum(f[3] == k for f in found) for k in PATTERNS)
        expected.setdefault(i, []).append((*counts, digest))
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in expected.items()}


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], pii_digest(docs).collect())


def test_odd_rows(spark):
    extra = [
        (50, "a@b.c_d@e.f,x@y, x@y.z.w"), (51, "0001.2.3.4 and 256.1.1.1 1.2.3"), (52, "+1+2+12345678"),
        (53, "4111-1111-1111-1111 4111111111111112 41 11"), (54, "@" * 50), (55, "😀a@b.cd😀 +12 (345) 678-901"),
    ]
    rows = odd_rows() + extra
    check(rows, pii_digest(documents(spark, rows)).collect())


def test_kinds_of_the_method(spark):
    text = (
        "iban DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00, my ssn 123-45-6789, "
        "then far away from it some digits " + "x" * 60 + " 123-45-6789, token = \"" + "0af1" * 10 + "\""
    )
    found = personal_data(documents(spark, [(1, text)])).collect()[0].findings
    more = [(f.kind, text[f.start : f.end]) for f in found if f.kind in ("iban", "ssn", "secret")]
    assert more == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("secret", "0af1" * 10)
    ]
    assert all(text[f.start : f.end] == f.text and 0.5 <= f.score <= 1 for f in found)


def test_cost_follows_the_findings(spark):
    text = " ".join(f"a{i}@b.com" for i in range(30000)) + " " + "1" * 50000 + "a" * 50000
    start = time.time()
    row = pii_digest(documents(spark, [(1, text)])).collect()[0]
    assert row.n_email == 30000 and time.time() - start < 90


def test_numbers_with_text_behind_them(spark):
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    secret = "9233A8EC" * 4
    texts = [
        f"{de} BIC COBADEFFXXX", f"pay {gb} 12345 NOW", f"TO {no} BY {de} END", f'TOKEN = "{secret}"',
        "DE88370400440532013000 BIC COBADEFFXXX", f"iban {de}.",
    ]
    rows = personal_data(documents(spark, [(10 + i, t) for i, t in enumerate(texts)])).collect()
    got = {r.doc_id - 10: [f.text for f in r.findings if f.kind in ("iban", "secret")] for r in rows}
    assert got == {0: [de], 1: [gb], 2: [no, de], 3: [secret], 4: [], 5: [de]}

"""Spans of personal data in all texts, against direct computation."""

import re

from marketloom.functions import pii
from marketloom.plans.catalog import QUERIES
from marketloom.plans.text import messages

SMALL = "/root/testdata/sf0.001"


def valid(kind, found):
    plain = re.sub("[ -]", "", found)
    if kind == "CREDIT_CARD":
        digits = [int(c) for c in reversed(plain)]
        return sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10
    if kind == "IBAN_CODE":
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def spans(text):
    each = [
        (r.score, m.end() - m.start(), r.kind, m.start(), m.end())
        for r in pii.RECOGNIZERS for m in re.finditer(r.pattern, text, re.ASCII) if valid(r.kind, m[0])
    ]
    beaten = lambda f: any(g[3] < f[4] and f[3] < g[4] and g[:2] > f[:2] for g in each)
    return [f[2:] for f in each if not beaten(f)]


def expected(rows):
    return sorted((r.conv_id, r.turn, *f) for r in rows for f in spans(r.text or ""))


def test_all_texts(spark):
    got = sorted(map(tuple, QUERIES["pii_spans_all"](spark, SMALL).collect()))
    assert got and got == expected(messages(spark, SMALL).collect())


def test_texts_of_many_findings(spark, tmp_path):
    texts = [
        "\u00e9\U0001f600 mail a@b.com, b@c.org and a@b.com from 10.0.0.1",
        "see https://x.org/joe@example.com and 4111 1111 1111 1111, 4111 1111 1111 1112", "none here",
        "123.456.789-09 078-05-1120 +55 (11) 98765-4321 " * 20,
    ]
    turns = [(i, 0, "user", t) for i, t in enumerate(texts)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(turns, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = messages(spark, str(tmp_path)).collect()
    got = sorted(map(tuple, QUERIES["pii_spans_all"](spark, str(tmp_path)).collect()))
    assert got == expected(rows)
    assert sum(i == 0 for i, *_ in got) == 4 and sum(i == 3 for i, *_ in got) > 40

"""Importance resampling and span checksums against direct computation."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import PROSE, SMALL, documents, odd_rows
from marketloom.llm.resampling import resample
from marketloom.llm.span_crc import span_crc32


@given(st.binary(max_size=700), st.lists(st.tuples(st.integers(0, 700), st.integers(0, 700)), max_size=20))
@settings(deadline=None, max_examples=150)
def test_span_crc32(data, spans):
    spans = [(min(a, b, len(data)), min(max(a, b), len(data))) for a, b in spans]
    starts = np.array([a for a, _ in spans], np.int64)
    sizes = np.array([b - a for a, b in spans], np.int64)
    got = span_crc32(np.frombuffer(data + b"\0", np.uint8), starts, sizes)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def test_long_and_many_spans():
    data = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8)
    starts = np.arange(40_000) * 3
    sizes = np.concatenate([np.arange(39_990) % 90, [100_000, 64, 65, 128, 129, 127, 4097, 1, 0, 9999]])
    got = span_crc32(data, starts, sizes)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]


def features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in runs]


def brute(rows, items):
    rows = [(i, *features(t)) for i, t in rows]
    s = collections.Counter(b for _, _, f in rows for b in f)
    t = collections.Counter(b for x in items for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, n, f in rows:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, weight + noise, None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(map(str, r[:5])) for r in out)


@pytest.mark.parametrize("source", ["table", "odd", "ties"])
def test_resample(spark, source):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [None]
    if source == "table":
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    else:
        docs = documents(spark, odd_rows() if source == "odd" else [(7, PROSE)] * 30 + [(8, None)])
    target = spark.createDataFrame([(t, "x") for t in items], "text string, doc_id string")
    got = resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(tuple(map(str, r)) for r in got) == expected


def test_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert resample(documents(spark, []), target).collect() == []
    assert len(resample(documents(spark, odd_rows()), target).collect()) == len(odd_rows())

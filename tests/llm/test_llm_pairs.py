"""Similarity operators against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import PROSE, SMALL, documents, odd_rows
from marketloom.llm import decontaminate
from marketloom.llm.components import connected_components
from marketloom.llm.near_duplicates import choose_bands, keep_one_of_each, near_duplicates


def shingle_set(text):
    words = (text or "").encode().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_links(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter()
    for ids in holders.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    degree, parent = collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            degree[a] += 1
            degree[b] += 1
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (find(i), degree[i]) for i in sets}


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute_links([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert got == expected and any(n for _, n in expected.values())


def test_large_groups_in_tiles(spark):
    random.seed(5)
    words = PROSE.split() + [f"more{i}" for i in range(80)]
    rows = []
    for i in range(150):
        changed = list(words)
        for _ in range(i % 5):
            changed[random.randrange(len(changed))] = f"new{i}"
        rows.append((i, " ".join(changed)))
    rows += [(1000 + i, " ".join(words)) for i in range(60)] + [(2000, "one two"), (2001, "one  two"), (2002, "one")]
    got = near_duplicates(documents(spark, rows), tile=16).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_links(rows)


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    got = collections.defaultdict(set)
    for r in near_duplicates(docs).collect():
        got[r.doc_id].add((r.class_id, r.n_links))
    assert got[None] == {(None, 0)} and got[1] == {(1, 0)} and got[2] == {(2, 0)} and got[3] == {(3, 0)}
    assert all(len(x) == 1 for x in got.values())
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 4, None} <= set(ids)


def test_choose_bands():
    bands, rows = choose_bands(0.8, 0.99999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 100
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.99999, most=3)


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)]
    edges += [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    found = connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def windows_of(text):
    words = (text or "").lower().split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute_items(rows, items):
    found = {}
    for i, text in rows:
        parts = windows_of(text)
        places = collections.defaultdict(list)
        for at, x in enumerate(parts):
            places[x].append(at)
        for item, item_text in items:
            wanted = windows_of(item_text)
            starts = {at - k for k, x in enumerate(wanted) for at in places.get(x, [])}
            bag = collections.Counter(wanted)
            for s in starts:
                window = parts[max(0, s) : min(len(parts), s + len(wanted))]
                least = sum((collections.Counter(window) & bag).values())
                likeness = least / (len(window) + len(wanted) - least)
                if i is not None and item is not None and likeness >= 0.8 - 1e-12:
                    found[i, item] = max(found.get((i, item), 0), likeness)
    return found


def test_items_in_documents(spark):
    random.seed(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for n, (_, text) in enumerate(items * 2):
        words = text.split()
        for _ in range(n % 3):
            words[random.randrange(len(words))] = f"zz{n}"
        if n % 5 == 0:
            words.insert(len(words) // 2, "qq")
        if n % 7 == 0:
            words = words[2:]
        rows.append((5000 + n, "aa bb cc " * (n % 4) + " ".join(words) + " dd ee" * (n % 3)))
    repeated = "one two three four five six " * 6
    items += [(900, repeated), (901, "four words are few"), (None, items[0][1])]
    rows += [(6000, "x " + repeated + " y"), (6001, repeated[:60]), (None, items[0][1]), (6002, None)]
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    expected = brute_items(rows, items)
    assert {(r.doc_id, r.item_id) for r in found if r.item_id is not None} == set(expected)
    for r in found:
        if r.item_id is not None:
            assert r.similarity == pytest.approx(expected[r.doc_id, r.item_id])
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    hit = {r.doc_id for r in found}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in hit)


def test_every_fingerprint_within_the_radius_shares_a_block_value():
    random.seed(1)
    for _ in range(2000):
        flips = random.sample(range(64), decontaminate.RADIUS)
        assert min(
            sum(first <= f < first + bits for f in flips) for first, bits in decontaminate.BLOCKS
        ) <= decontaminate.NEAR


def test_simhash(spark):
    hashes = np.random.default_rng(0).integers(-(2**63), 2**63, 21)
    df = spark.createDataFrame([([int(h) for h in hashes],)], "h array<bigint>")
    got = df.select(decontaminate.simhash(F.col("h"))).collect()[0][0]
    bits = [2 * sum((int(h) >> k) & 1 for h in hashes) > len(hashes) for k in range(64)]
    assert got & (2**64 - 1) == sum(1 << k for k, on in enumerate(bits) if on)

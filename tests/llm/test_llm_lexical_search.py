"""K2-treap and ranked search against direct computation."""

import glob
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from fixtures import PROSE, documents, odd_rows
from marketloom.llm import lexical_search as ls
from marketloom.llm.treap import Treap, best_columns
from marketloom.session import shared_dir


@pytest.mark.parametrize("n_rows, n_columns, n_points", [(1, 1, 1), (3, 900, 700), (700, 3, 900), (300, 300, 20000)])
def test_treap(n_rows, n_columns, n_points):
    rng = np.random.default_rng(n_points)
    grid = np.zeros((n_rows, n_columns), np.int64)
    np.put(grid, rng.integers(0, grid.size, n_points), rng.integers(1, 50, n_points))
    rows, columns = np.nonzero(grid)
    built = Treap.build(rows, columns, grid[rows, columns], max(grid.shape))
    treap = Treap.load(built.height, *built.dump())
    assert all((a == b).all() for a, b in zip(built.peaks, treap.peaks))
    ids = rng.permutation(1 << treap.height)
    for _ in range(20):
        asked = np.unique(rng.integers(0, n_rows, 12))
        weights = rng.integers(0, 4, len(asked))  # few values, so that scores tie
        scores = weights @ grid[asked]
        expected = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if s > 0)
        before = expected[5:8]
        assert best_columns(treap, asked, weights, ids, 20, [], at_once=3) == expected[:20]
        assert best_columns(treap, asked, weights, ids, 20, before) == sorted(expected + before)[:20]


def brute(rows, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {x for x in items}:
        found = []
        for i, c, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            found.append((-score, i is not None, i or 0, i)) if score else None
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_per_shard, items_per_block, held", [(4096, 1024, 1 << 16), (3, 2, 1)])
def test_search(spark, monkeypatch, docs_per_shard, items_per_block, held):
    monkeypatch.setattr(ls, "SHARD_DOCS", docs_per_shard)
    monkeypatch.setattr(ls, "BLOCK_ITEMS", items_per_block)
    monkeypatch.setattr(ls, "HELD_ITEMS", held)
    copies = [(100 + i, "The same Words for all of them") for i in range(50)]
    rows = odd_rows() + copies + [(200, "same same same"), (201, "Straße ÄÖ same")]
    items = [(1, "the same words words"), (1, "the same words words"), (2, None), (3, ""), (None, "ÄÖ"), (4, PROSE),
             (4, "long unknownterm"), (5, "<|endoftext|>"), (6, "of")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = ls.lexical_search(documents(spark, rows).repartition(3), asked).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items)


def test_blocks_stay_small(spark, monkeypatch):
    """Blocks are stored packed, few in a file whatever a task holds, and are not shuffled."""
    monkeypatch.setattr(ls, "SHARD_DOCS", 40)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{n}" for n in rng.zipf(1.3, 120) % 4000)) for i in range(800)]
    asked = spark.createDataFrame([(1, "w1 w2 w17"), (2, "w900 w3")], "item_id bigint, text string")
    at = f"{shared_dir(spark)}/marketloom/lexical_index-*"
    before = set(glob.glob(at))
    found = ls.lexical_search(documents(spark, rows).coalesce(1), asked)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, [(1, "w1 w2 w17"), (2, "w900 w3")])
    (folder,) = set(glob.glob(at)) - before
    files = [pq.read_table(f).to_pylist() for f in glob.glob(f"{folder}/*.parquet")]
    assert sorted(map(len, files)) == [4, 8, 8]
    for block in sum(files, []):
        n_cells = int.from_bytes(block["falls"][:8], "little") // 4
        assert len(block["falls"]) < 2 * n_cells and len(block["masks"]) < n_cells
        Treap.load(block["height"], ls._unpacked(block["masks"]), ls._unpacked(block["falls"]))
    assert "RoundRobin" not in found._jdf.queryExecution().toString()


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert ls.lexical_search(documents(spark, []), asked).collect() == []
    assert ls.lexical_search(documents(spark, odd_rows()), none).collect() == []

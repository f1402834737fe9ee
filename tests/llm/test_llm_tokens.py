"""Packing and token files: exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fixtures import SMALL, documents, odd_rows
from marketloom.llm import simple8b
from marketloom.llm.packing import OpenBins, pack_documents, pieces_of, sequences
from marketloom.llm.queries import TOKENIZER
from marketloom.llm.token_files import read_token_files, write_token_files
from marketloom.llm.tokens import PieceEncoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
@settings(deadline=None, max_examples=60)
def test_simple8b_round_trip(values):
    numbers = np.array(values, np.uint64)
    words, offsets = simple8b.encode(numbers, block=64)
    assert (simple8b.decode(words, offsets, len(numbers), block=64) == numbers).all()


def test_simple8b_sizes():
    for values, most in ((np.zeros(3000), 30), (np.full(3000, 1), 54), (np.full(3000, 2**20 - 1), 1003)):
        words, offsets = simple8b.encode(values.astype(np.uint64))
        assert len(words) <= most and len(offsets) == 3
    words, _ = simple8b.encode(np.array([2**60, 1], np.uint64))
    assert len(words) == 3  # the escape takes two words


@given(st.text(alphabet="aZ9é日 .,'\n\t\r\x85\x1c%<|>", max_size=60))
@settings(deadline=None, max_examples=200)
def test_pieces_give_the_ids_of_the_whole_text(tokenizer, text):
    got = np.frombuffer(PIECES.encode([text])[0], "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


PIECES = PieceEncoder(TOKENIZER)


def test_pieces_of_texts(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [t or "" for _, t in odd_rows()]
    whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in PIECES.encode(texts)] == whole


@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 5))
@settings(deadline=None)
def test_open_bins(sizes, limit):
    bins, filled, open_bins, closed = OpenBins(20, limit), defaultdict(int), set(), set()
    for size in sizes:
        fitting = [20 - filled[b] for b in open_bins if 20 - filled[b] >= size]
        number, offset = bins.place(size)
        assert offset == filled[number] and number not in closed
        if fitting:
            assert 20 - filled[number] == min(fitting)
        elif len(open_bins) == limit:
            fullest = max(filled[b] for b in open_bins)
            gone = next(b for b in open_bins if filled[b] == fullest)
            candidates = {b for b in open_bins if filled[b] == fullest}
            if len(candidates) > 1:
                return  # any of the fullest may close
            open_bins.discard(gone)
            closed.add(gone)
        filled[number] += size
        open_bins.add(number)
        if filled[number] == 20:
            open_bins.discard(number)
            closed.add(number)
        assert filled[number] <= 20 and bins.open == len(open_bins)


def test_pieces_of():
    assert pieces_of(5, 2) == [(0, 1), (1, 2), (3, 2)] and pieces_of(2, 2) == [(0, 2)]


def check_pieces(pieces, expected, length):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length <= 4 * length
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, p.piece, bytes(p.ids)))
    for parts in by_sequence.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= length
    for name, parts in by_doc.items():
        ids = np.frombuffer(b"".join(x[2] for x in sorted(parts)), "<u4").tolist()
        assert sorted(ids) == sorted(i for n, e in expected if n == name for i in e)
    return by_sequence, by_doc


def test_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = [(r.doc_id, ids_of(tokenizer, r.text)) for r in docs.collect()]
    pieces = pack_documents(docs.coalesce(1), TOKENIZER).collect()
    by_sequence, by_doc = check_pieces(pieces, expected, 2048)
    for name, ids in expected:
        parts = sorted(by_doc[name])
        assert np.frombuffer(b"".join(x[2] for x in parts), "<u4").tolist() == ids
        assert len(parts) == -(-len(ids) // 2048) and [x[1] for x in parts] == list(range(len(parts)))
    least = -(-sum(len(e) for _, e in expected) // 2048)
    assert len(by_sequence) <= 1.005 * least + 1


def test_packing_of_odd_rows(spark, tokenizer):
    rows = odd_rows()
    pieces = pack_documents(documents(spark, rows), TOKENIZER, length=64, open_bins=3)
    check_pieces(pieces.collect(), [(i, ids_of(tokenizer, t)) for i, t in rows], 64)
    packed = sequences(pieces).collect()
    assert sum(len(s.ids) for s in packed) == 4 * sum(len(ids_of(tokenizer, t)) for _, t in rows)


@pytest.mark.parametrize("source", ["table", "odd"])
def test_token_files(spark, tokenizer, tmp_path, source):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet") if source == "table" else documents(spark, odd_rows())
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, TOKENIZER)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: (i is not None, i))
    at, left = 0, defaultdict(list)
    for r in docs.collect():
        left[r.doc_id].append(ids_of(tokenizer, r.text))
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        left[r.doc_id].remove(ids)
        at += len(ids)


def test_digests(spark, tokenizer):
    from marketloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    at = 0
    for r in sorted(QUERIES["op8_token_files"](spark, SMALL).collect(), key=lambda r: r.doc_id):
        ids = ids_of(tokenizer, texts[r.doc_id])
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc)
        at += len(ids)
    for r in QUERIES["op2_best_fit_packing"](spark, SMALL).collect():
        ids = ids_of(tokenizer, texts[r.doc_id])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32

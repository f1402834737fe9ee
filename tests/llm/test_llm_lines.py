"""Line deduplication against direct computation, hot keys included."""

import collections

import pytest

from fixtures import documents, odd_rows
from marketloom.llm import lines

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))


def kept_texts(rows):
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        stay = [
            x for x in (text or "").split("\n")
            if i is None or len(holders[key(x)]) < 3 or i == max(holders[key(x)])
        ]
        out.append((i, None if text is None else "\n".join(stay)))
    return out


@pytest.mark.parametrize("hot_rows", [None, 0, 10**9])  # as it comes, all keys hot, no key hot
def test_kept_text(spark, monkeypatch, hot_rows):
    if hot_rows is not None:
        counted = lines._hot_keys
        monkeypatch.setattr(lines, "_hot_keys", lambda places, _: counted(places, hot_rows))
    common = [(100 + i, f"own line number {i} of this text\nA line that all of them have here") for i in range(40)]
    rows = odd_rows() + common
    docs = documents(spark, rows)
    got = lines.drop_lines(docs)
    assert got.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    result = got.collect()
    assert sorted([(r.doc_id, r.text) for r in result], key=order) == sorted(kept_texts(rows), key=order)
    assert all(r.n_chars == len(r.text) for r in result if r.text is not None)


def test_bitmap_of_many_lines(spark):
    shared = "\n".join(f"shared line with the number {i:04}" for i in range(300))
    docs = documents(spark, [(1, shared), (2, shared), (3, shared + "\nthe last line of document three")])
    found = {r.doc_id: r for r in lines.line_bitmaps(docs).collect()}
    assert set(found) == {1, 2} and found[1].n_dropped == 300
    assert sum(bin(b.bits & (2**64 - 1)).count("1") for b in found[1].bitmap) == 300
    assert len(found[1].bitmap) == 5


@pytest.mark.parametrize("hot_rows", [0, 10**9])
def test_lines_repeated_inside_one_document(spark, hot_rows):
    line = "a line of more than twenty letters"
    alone, twice = f"{line} x\n{line} x\n{line} x", f"{line}\nother\n{line}"
    docs = documents(spark, [(1, alone), (2, line), (3, line), (9, twice)])
    found = {r.doc_id: r.n_dropped for r in lines.line_bitmaps(docs, hot_rows=hot_rows).collect()}
    assert found == {2: 1, 3: 1}

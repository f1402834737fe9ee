"""Word-end BPE against the tokenizers library."""

import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fixtures import SMALL, documents, odd_rows
from marketloom.llm.word_bpe import Decoder, Merges, WordEncoder, encode_texts, word_digest

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER, DECODER, LIBRARY = WordEncoder(PATH), Decoder(PATH), Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def check(text):
    ids = np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert DECODER.decode(np.array(ids, np.int64)).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.text(alphabet="abcdeABinotrhsİıΣσſKé́日本 '.,!|<>9٣\n\t\r\x85\x1c  😀", max_size=60))
@settings(deadline=None, max_examples=300)
def test_any_text(text):
    check(text)


@given(st.text(alphabet="abinoertsh", min_size=1, max_size=40))
@settings(deadline=None, max_examples=300)
def test_words(text):
    check(text)


@pytest.mark.parametrize("text", [
    "", " ", "<|endoftext|>", "a<|startoftext|>b <|EndOfText|> <|endoftext", "don't WE'LL i'm 'sword",
    "a" * 5000, "ab" * 3000 + "!" * 3000, "é e ́x", "x\x00y", "123 4,5 ½",
])
def test_odd_texts(text):
    check(text)


def test_all_words_of_a_small_vocabulary():
    """Every word over three letters against merging by rank, with merges that overlap."""
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "c</w>"), ("aa", "aa"), ("ba", "b"), ("b", "b</w>")]
    tokens = ["a", "b", "c", "a</w>", "b</w>", "c</w>"] + ["".join(m) for m in merges]
    table = Merges({t: i for i, t in enumerate(tokens)}, merges, "</w>")
    for n in range(1, 8):
        for word in map("".join, itertools.product("abc", repeat=n)):
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = ["".join(parts[i : i + 2])]
            assert [tokens[i] for i in table.encode(word)] == parts


@pytest.mark.parametrize("source", ["table", "odd"])
def test_digest(spark, source):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet") if source == "table" else documents(spark, odd_rows())
    expected = []
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, word_digest(docs, PATH).collect()), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert encode_texts(documents(spark, []), PATH).collect() == []

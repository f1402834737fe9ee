"""Plain words go to the BPE model as they are, once per group of texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketloom.llm import tokens
from marketloom.llm.queries import TOKENIZER

TEXT = "Onthing èaiénou,\nüberößsch. 2048! Thonere thonere$$$ thonere Ōnɏ 17\nOnthing onthing"


def same_ids(encoder, texts):
    plain = Tokenizer.from_file(TOKENIZER)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_need_no_pre_tokenizer(monkeypatch):
    encoder, asked = tokens.PieceEncoder(TOKENIZER), []
    monkeypatch.setattr(encoder, "_learn_together", lambda known, before, group: asked.extend(group))
    same_ids(encoder, [TEXT, "", TEXT])
    assert asked == []


@pytest.mark.parametrize("places", [1, 3, 1 << 17])
def test_copied_in_blocks(monkeypatch, places):
    monkeypatch.setattr(tokens, "GROUP_PARTS", places, raising=False)
    same_ids(tokens.PieceEncoder(TOKENIZER), [TEXT, "\n", "x", "", "a\n\nb", " lead", "trail ", "x3.5 é²!", TEXT] * 2)


ENCODER = tokens.PieceEncoder(TOKENIZER)


@given(st.lists(st.text(alphabet="abTh 19\n.,!$'éÖ×ɏɐ²٣\t<|", max_size=40), max_size=6))
@settings(deadline=None, max_examples=200)
def test_any_texts(texts):
    same_ids(ENCODER, texts)

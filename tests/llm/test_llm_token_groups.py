"""Token ids of Arrow columns: groups of texts, and words that differ in their marks only."""

import os

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketloom.llm import tokens
from marketloom.llm.queries import TOKENIZER

TEXTS = ["", " ", "the the.\nThe***", "a  b\tc", "wé²!! x's 4.", "\n\n", "<|endoftext|>.", "no?!", "日本,日本"]


@pytest.mark.parametrize("size", [1, 10, 1 << 20])
def test_groups_of_texts(monkeypatch, size):
    monkeypatch.setattr(tokens, "GROUP_BYTES", size)
    encoder, plain = tokens.PieceEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    encoder.first.most = encoder.after_blank.most = 2
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_column(pa.array(TEXTS * 3))]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS * 3]


def test_words_with_other_marks_are_encoded_once(monkeypatch):
    encoder, asked = tokens.PieceEncoder(TOKENIZER), []
    encoder.encode(["x inword, inword$$$ other!!"])
    monkeypatch.setattr(encoder, "_learn_together", lambda known, before, group: asked.extend(group))
    plain = Tokenizer.from_file(TOKENIZER)
    (got,) = encoder.encode(["x inword!! other$$$ inword"])
    assert asked == []
    assert np.frombuffer(got, "<u4").tolist() == plain.encode("x inword!! other$$$ inword").ids


def test_encoder_outlives_a_task(spark):
    shared = tokens.shared_encoder

    def known(batches):
        for batch in batches:
            encoder = shared(TOKENIZER)
            before = len(encoder.after_blank)
            encoder.encode([f"x outliving{batch.column(0)[0]}"])
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([before])], ["pid", "n"])

    rows = spark.range(0, 40, 1, 40).mapInArrow(known, "pid long, n long").collect()
    for pid in {r.pid for r in rows}:
        found = [r.n for r in rows if r.pid == pid]
        assert len(set(found)) == len(found)

"""Word-end BPE holds its tables once per task, and for many tasks."""

import os

import pyarrow as pa
import public_tokenizers

from fixtures import documents, odd_rows
from marketloom.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_one_worker_per_task(spark):
    digest = word_bpe.word_digest(documents(spark, odd_rows()), PATH)
    plan = digest._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_one_pass_gives_what_two_give(spark):
    docs = documents(spark, odd_rows())
    once = word_bpe.round_trip(docs, PATH).select("doc_id", "ids", "decoded").collect()
    twice = word_bpe.decode_texts(word_bpe.encode_texts(docs, PATH), PATH).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.decoded)
    assert sorted(once, key=key) == sorted(twice, key=key)


def test_encoder_outlives_a_task(spark):
    get, kind = getattr(word_bpe, "shared", None) or word_bpe._shared, word_bpe.WordEncoder

    def known(batches):
        for batch in batches:
            encoder = get(kind, PATH)
            before = len(encoder.pieces)
            encoder.encode([f"outliving{batch.column(0)[0]}"])
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([before])], ["pid", "n"])

    rows = spark.range(0, 24, 1, 24).mapInArrow(known, "pid long, n long").collect()
    for pid in {r.pid for r in rows}:
        found = [r.n for r in rows if r.pid == pid]
        assert len(set(found)) == len(found)

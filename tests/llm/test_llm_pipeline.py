"""The pipeline, stage by stage, against direct computation on its own input."""

import collections

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fixtures import SMALL
from marketloom.llm.queries import TOKENIZER
from test_llm_lines import kept_texts
from test_llm_pairs import brute_items, brute_links


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs.collect())
    return found


def texts(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_quality_stage_keeps_good_documents(spark, outputs):
    kept = {r.doc_id for r in outputs[1]}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    words = {r.doc_id: len(r.text.split()) for r in outputs[0]}
    assert {r.doc_id for r in labels if r.quality == 1 and words[r.doc_id] >= 50} <= kept
    assert not {r.doc_id for r in labels if r.quality == 0} & kept


def test_line_stage(outputs):
    before = [(r.doc_id, r.text) for r in outputs[1]]
    assert texts(outputs[2]) == sorted(kept_texts(before))


def test_duplicate_stage(outputs):
    links = brute_links([(r.doc_id, r.text) for r in outputs[2]])
    assert texts(outputs[3]) == [x for x in texts(outputs[2]) if links[x[0]][0] == x[0]]


def test_benchmark_stage(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {i for i, _ in brute_items([(r.doc_id, r.text) for r in outputs[3]], items)}
    assert texts(outputs[4]) == [x for x in texts(outputs[3]) if x[0] not in hit]


def test_packing_stage(outputs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = collections.defaultdict(list)
    for r in outputs[5]:
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    for r in outputs[4]:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        joined = b"".join(x for _, x in sorted(pieces[r.doc_id]))
        assert joined == b"".join(i.to_bytes(4, "little") for i in ids)


def test_run(spark, outputs):
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in outputs[5])

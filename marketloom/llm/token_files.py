"""Token files: documents as ids in ascending order, packed with Simple-8b."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import simple8b
from marketloom.llm.tokens import encoded_rows

END = 0
BATCH_IDS = 1 << 18  # a stored row closes when it holds so many ids

FILE_SCHEMA = (
    "shard int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, "
    "sizes array<bigint>, offsets array<bigint>, words binary"
)
READ_SCHEMA = "doc_id bigint, shard int, local_start bigint, n_tokens bigint, ids binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str,
    doc_id: str = "doc_id", text: str = "text", end: int = END,
) -> None:
    """Write the ids of all documents, each followed by ``end``, in ascending ``doc_id`` order.

    Rows are range-partitioned by id (a tie is split and ordered by a hash of the text), and each
    range becomes one shard. A stored row holds whole documents of about ``BATCH_IDS`` ids: its
    number in the shard, the ids of the shard before it, the documents with their sizes, the packed
    words, and the place of the first word of every 1024 ids, so that a reader may start anywhere.

    Null text is the end id alone. Rows without an id come first. An empty table writes no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0
        for name, ids in encoded_rows(batches, tokenizer, end):
            names.append(name)
            parts.append(ids)
            held += len(ids) // 4
            if held >= BATCH_IDS:
                yield _stored(shard, block, first, names, parts)
                block, first = block + 1, first + held
                names, parts, held = [], [], 0
        if names:
            yield _stored(shard, block, first, names, parts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(pack, FILE_SCHEMA).write.parquet(path)


def _stored(
    shard: int, block: int, first: int, names: list[int | None], parts: list[bytes]
) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    words, offsets = simple8b.encode(ids)
    sizes = [len(p) // 4 for p in parts]
    many = pa.list_(pa.int64())
    columns = [
        pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
        pa.array([len(ids)], pa.int64()), pa.array([names], many), pa.array([sizes], many),
        pa.array([offsets.tolist()], many), pa.array([words.astype("<u8").tobytes()], pa.binary()),
    ]
    fields = ["shard", "block", "first", "n_ids", "doc_ids", "sizes", "offsets", "words"]
    return pa.RecordBatch.from_arrays(columns, fields)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: (doc_id, start, n_tokens, ids); ``start`` counts all ids before it.

    Stored rows are decoded independently. Shards follow each other in order, so a shard starts
    after the totals of the earlier ones: one number per shard, which the writing tasks bound.
    """
    stored = spark.read.schema(FILE_SCHEMA).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _documents(row)

    docs = stored.mapInArrow(unpack, READ_SCHEMA)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def _documents(row: dict) -> pa.RecordBatch:
    words = np.frombuffer(row["words"], dtype="<u8")
    ids = simple8b.decode(words, np.array(row["offsets"], np.int64), row["n_ids"]).astype("<u4")
    ends = np.cumsum(row["sizes"])
    starts = ends - np.array(row["sizes"], np.int64)
    columns = [
        pa.array(row["doc_ids"], pa.int64()),
        pa.array([row["shard"]] * len(starts), pa.int32()),
        pa.array(starts + row["first"], pa.int64()),
        pa.array(row["sizes"], pa.int64()),
        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
    ]
    fields = ["doc_id", "shard", "local_start", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays(columns, fields)

"""Importance resampling towards a target: hashed n-gram counts, gains per bucket, Gumbel draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.span_crc import span_crc32
from marketloom.session import stage

BUCKETS = 10_000
LONGEST = 2  # words of the longest run that is a feature
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000  # gains and scores are whole thousandths
GROUP_BYTES = 1 << 20  # texts that are cut into words together

FEATURE_SCHEMA = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"

_bytes = np.arange(256)
IS_WORD = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def text_features(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, list[bytes]]:
    """Words per text, and per text the buckets of its features as little-endian unsigned 32-bit.

    The words of all texts are laid into one buffer with one blank between them, so that each run
    of words is one span of it. Runs that would cross from a text to the next are left out.
    """
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_starts = np.cumsum(sizes) - sizes
    inside = IS_WORD[data]
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    size = ends - begins
    of = np.searchsorted(text_starts, begins, side="right") - 1
    n_words = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(size + 1) - (size + 1)
    packed = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    packed[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    parts: list[list[bytes]] = [[] for _ in texts]
    for n in range(1, longest + 1):
        first = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.array([], int)
        last = first + n - 1
        crc = span_crc32(packed, starts[first], starts[last] + size[last] - starts[first])
        found = (crc % np.uint32(buckets)).astype("<u4")
        cuts = np.searchsorted(of[first], np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            parts[i].append(found[cuts[i] : cuts[i + 1]].tobytes())
    return n_words, [b"".join(p) for p in parts]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``GROUP_BYTES`` together."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= GROUP_BYTES:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def hashed_features(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) per row: the bucket of every feature of the text.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; features are all runs of 1
    to ``longest`` words joined by one blank, repeats included; the bucket is the CRC-32 of its UTF-8
    bytes modulo ``buckets``. Null text has none.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for low, high in _groups(texts):
                n_words, found = text_features(texts[low:high], buckets, longest)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(low, high - low), pa.array(n_words, pa.int64()),
                        pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary()),
                    ],
                    ["doc_id", "n_words", "n_features", "buckets"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(features, FEATURE_SCHEMA)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features; a task sums its own rows first, at most ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(found, "<u4"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(features: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket: how much more frequent it is in the target, as whole thousandths.

    The driver receives one number per bucket and side: ``buckets`` is their bound at any size.
    """
    sides = []
    for rows in (features, target):
        counts = [0] * buckets
        for r in bucket_counts(rows, buckets).collect():
            counts[r.bucket] = r.n
        sides.append(counts)
    raw, wanted = sides
    s_all, t_all = float(sum(raw)) + buckets, float(sum(wanted)) + buckets
    return [
        math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
        for s, t in zip(raw, wanted)
    ]


def _weights(features: DataFrame, gains: list[int]) -> DataFrame:
    """The floored mean gain of the features of each row; 0 without features."""
    values = np.array(gains, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for found in batch.column(3).to_pylist():
                held = np.frombuffer(found, "<u4")
                weights.append(int(values[held].sum()) // len(held) if len(held) else 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weights, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return features.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, min_words: int = MIN_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of ``docs``.

    ``target`` has a column ``text``. Features of both sides are counted per bucket; a document's
    weight is the floored mean gain of its features; its score adds Gumbel noise that follows from
    ``seed`` and its id alone, so that a run can be repeated. Of the documents with at least
    ``min_words`` words the ``percent`` with the highest scores are drawn, ties to the smaller id;
    ``rank`` counts them from 1 and is null for all others.

    Features are hashed once and stored. Ranks come from range partitions and one count per
    partition, so no task sorts all documents.

    Null or empty text has no features, weight 0 and no rank. A null id counts as the empty string
    in the noise and comes first among ties. Repeated rows get equal scores and ranks of their own.
    Other columns, whatever their names, are left out. An empty target gives gains too (its counts
    are 0); an empty table gives no rows.
    """
    features = stage(hashed_features(docs, doc_id, text, buckets, longest), "features")
    wanted = hashed_features(target.select(F.lit(0).alias("id"), "text"), "id", "text", buckets, longest)
    weighted = _weights(features, bucket_gains(features, wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    scored = weighted.withColumn("score", F.col("weight") + noise)
    ranged = stage(
        scored.withColumn("_short", F.col("n_words") < min_words)
        .repartitionByRange("_short", *order)
        .withColumn("_part", F.spark_partition_id()),
        "scored",
    )
    eligible = ranged.filter(~F.col("_short"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = eligible.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = eligible.withColumn("_place", place).join(F.broadcast(parts), "_part")
    rank = F.col("_base") + F.col("_place")
    drawn = F.when(rank <= F.floor(F.col("_all") * percent / 100), rank).cast("long")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, drawn.alias("rank")).unionByName(
        ranged.filter("_short").select(*columns, F.lit(None).cast("long").alias("rank"))
    )

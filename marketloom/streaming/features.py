"""Latest feature values kept up to date from a stream, in buckets of which a batch rewrites few.

The state is cut into ``BUCKETS`` parts by a hash of the key. A micro-batch reads and writes the
buckets of its own keys only, below ``data/batch=n/bucket=b``, and then a manifest
``manifest/batch=n`` that names for every bucket the batch that wrote it last. A batch counts once
its manifest is whole; running it again then changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketloom.operators.features import latest_per_key, merge_latest
from marketloom.sources.tables import delete, exists, list_names

DONE = "_SUCCESS"
BUCKETS = 256  # of a state whose keys grow, more: a bucket should be a few hundred megabytes at most
MANIFEST = "bucket int, batch bigint"


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest_path(target: str, batch: int) -> str:
    return f"{target}/manifest/batch={batch}"


def latest_batch(spark: SparkSession, target: str, before: int | None = None) -> int | None:
    """Number of the last batch with a whole manifest, below ``before`` if given; one listing."""
    numbers = [int(n.split("=")[1]) for n in list_names(spark, f"{target}/manifest") if n.startswith("batch=")]
    for number in sorted((n for n in numbers if before is None or n < before), reverse=True):
        if exists(spark, f"{manifest_path(target, number)}/{DONE}"):
            return number
    return None


def read_manifest(spark: SparkSession, target: str, batch: int | None) -> dict[int, int]:
    """The batch that wrote each bucket last; at most one entry per bucket."""
    if batch is None:
        return {}
    rows = spark.read.schema(MANIFEST).json(manifest_path(target, batch)).collect()
    return {r.bucket: r.batch for r in rows}


def _buckets(
    spark: SparkSession, target: str, schema: T.StructType, manifest: dict[int, int], wanted: list[int]
) -> DataFrame | None:
    paths = [f"{target}/data/batch={manifest[b]}/bucket={b}" for b in wanted if b in manifest]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def upsert_batch(
    batch: DataFrame, number: int, target: str, key: str = "ticker", order: str = "date",
    buckets: int = BUCKETS,
) -> None:
    """Bring the state up to date with the rows of batch ``number``.

    Of equal keys the row of the greatest ``order`` stays. Rows with a null key form a key of their
    own. A batch without rows leaves the state as it is. The number of buckets of a target is fixed
    by its first batch: the same number must be given later.
    """
    spark = batch.sparkSession
    if exists(spark, f"{manifest_path(target, number)}/{DONE}"):
        return
    manifest = read_manifest(spark, target, latest_batch(spark, target, number))
    fresh_path = f"{target}/fresh/batch={number}"
    latest_per_key(batch, key, order).withColumn("bucket", bucket_of(key, buckets)).write.mode(
        "overwrite"
    ).parquet(fresh_path)
    stored = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())]))
    fresh = stored.parquet(fresh_path)
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if touched:
        rows = fresh.drop("bucket")
        old = _buckets(spark, target, batch.schema, manifest, touched)
        merged = rows if old is None else merge_latest(old, rows, key, order)
        merged.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(f"{target}/data/batch={number}")
    entries = sorted((manifest | {b: number for b in touched}).items())
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").json(
        manifest_path(target, number)
    )
    delete(spark, fresh_path)


def start_materialize(
    stream: DataFrame, target: str, checkpoint: str, key: str = "ticker", order: str = "date",
    available_now: bool = True, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the latest row per key under ``target``; every micro-batch rewrites its own buckets.

    A batch is built from the manifest before it, so running it again after a failure writes the
    same rows to the same place.
    """
    writer = stream.writeStream.foreachBatch(
        lambda batch, number: upsert_batch(batch, number, target, key, order, buckets)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(
    spark: SparkSession, target: str, schema: T.StructType, batches: int | None = None,
    keys: list | None = None, key: str = "ticker", buckets: int = BUCKETS,
) -> DataFrame:
    """The state after the last whole batch, of the first ``batches`` if given; with ``keys`` only
    the buckets of these are read."""
    newest = latest_batch(spark, target, batches)
    if newest is None:
        raise FileNotFoundError(f"no state under {target}")
    manifest = read_manifest(spark, target, newest)
    wanted = sorted(manifest)
    if keys is not None:
        asked = spark.createDataFrame([(k,) for k in keys], T.StructType([schema[key]]))
        wanted = sorted({r.b for r in asked.select(bucket_of(key, buckets).alias("b")).collect()})
    found = _buckets(spark, target, schema, manifest, wanted)
    state = spark.createDataFrame([], schema) if found is None else found
    return state if keys is None else state.filter(F.col(key).isin(list(keys)))


def expire(spark: SparkSession, target: str) -> None:
    """Delete the buckets and manifests that the last whole batch no longer needs.

    Not while a reader may still hold the state of an earlier batch.
    """
    newest = latest_batch(spark, target)
    if newest is None:
        return
    manifest = read_manifest(spark, target, newest)
    for name in list_names(spark, f"{target}/data"):
        batch = int(name.split("=")[1]) if name.startswith("batch=") else newest + 1
        if batch <= newest:
            for part in list_names(spark, f"{target}/data/{name}"):
                if part.startswith("bucket=") and manifest.get(int(part.split("=")[1])) != batch:
                    delete(spark, f"{target}/data/{name}/{part}")
    for name in list_names(spark, f"{target}/manifest"):
        if name.startswith("batch=") and int(name.split("=")[1]) < newest:
            delete(spark, f"{target}/manifest/{name}")

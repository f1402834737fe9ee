"""Refresh of partitioned tables: only partitions whose content has changed are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import stage
from marketloom.sources.tables import exists, write_parquet

DIGESTS = "_digests"  # readers of the table skip folders that begin with an underscore


def content_digests(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, digest) per partition: the number of rows and a sum of row hashes.

    The sum does not depend on the order of rows, and repeated rows count as often as they occur.
    """
    hashes = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), hashes.alias("digest"))


def refresh_partitions(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Bring the partitions of ``df`` up to date in the table at ``path``; returns the written ones.

    Partitions of equal digest are left alone, others are replaced whole, and partitions that
    ``df`` does not have stay. Digests are stored below the table in a new folder per run, after the
    data: a run that ends in between leaves old digests, and the next one writes those partitions
    again, with the same result. Null partition values are a partition of their own. An empty ``df``
    writes nothing. One writer at a time is assumed, as for any overwrite of Parquet folders.
    """
    spark = df.sparkSession
    digests = f"{path}/{DIGESTS}"
    new = stage(content_digests(df, by), "digests")
    if not exists(spark, digests):
        write_parquet(df, path, by)
        new.withColumn("run", F.lit(0)).write.parquet(f"{digests}/{uuid.uuid4().hex}")
        return new
    stored = spark.read.option("recursiveFileLookup", True).schema(
        new.withColumn("run", F.lit(0)).schema
    ).parquet(digests)
    run = stored.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
    latest = stored.groupBy(*by).agg(F.max_by(F.struct("rows", "digest"), "run").alias("old"))
    same = _equal("new", "old", by)
    equal = F.col("old.old").eqNullSafe(F.struct("new.rows", "new.digest"))
    changed = stage(
        new.alias("new").join(latest.alias("old"), same, "left").filter(~equal).select("new.*"),
        "changed",
    )
    if changed.isEmpty():
        return changed
    rows = df.alias("rows").join(changed.select(*by).alias("changed"), _equal("rows", "changed", by), "left_semi")
    rows.hint("rebalance", *by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(path)
    changed.withColumn("run", F.lit(run)).write.parquet(f"{digests}/{uuid.uuid4().hex}")
    return changed


def _equal(left: str, right: str, columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out

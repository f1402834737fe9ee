"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import stage

SPACES = r"[\x20\x09-\x0D]+"  # ASCII white space; everything else belongs to a word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as constants of the plan, so that Spark knows its size."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bounded_parts(df: DataFrame, name: str, limit: int = 200_000) -> list[DataFrame]:
    """``df`` (an index made from templates or items) in parts of about ``limit`` rows at most.

    Each part may be broadcast; a larger index costs more passes over the other side, not memory.
    """
    stored = stage(df, name)
    parts = -(-stored.count() // limit)
    if parts <= 1:
        return [stored]
    share = F.pmod(F.xxhash64(*stored.columns), F.lit(parts))
    return [stored.filter(share == i) for i in range(parts)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(text, UPPER, LOWER)


def total(numbers: Column) -> Column:
    """Sum of an array of whole numbers, as long."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, v: a + v)


def shingles(parts: Column, size: int = 5) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order; empty for fewer words."""

    def of(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]),
        )
        return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    return let(parts, of)

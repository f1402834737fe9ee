"""Feature tables: point-in-time lookup, latest values, materialisation, fallback."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Features of the served view, all float, followed by the label.
VIEW_FEATURES = [
    "open", "high", "low", "close", "volume", "sma_5", "sma_10", "sma_20", "sma_50", "ema_12",
    "ema_26", "rsi_14", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_middle",
    "bb_lower", "bb_width", "atr_14", "obv", "volume_ma_20", "price_change", "price_change_5d",
]
TTL_SECONDS = 86_400


@dataclass(frozen=True)
class FeatureView:
    """Definition of a feature table: key, event time, time to live, and typed features."""

    name: str
    schema: T.StructType
    key: str = "ticker"
    order: str = "date"
    ttl_seconds: int = TTL_SECONDS
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row per feature with its type."""
        rows = [(self.name, f.name, f.dataType.simpleString()) for f in self.schema.fields]
        return spark.createDataFrame(rows, "view string, feature string, type string")

    def project(self, df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
        """Key, event time and the features in their served types.

        ``wanted`` holds names as ``feature`` or ``view:feature``.
        """
        names = self.features if wanted is None else [w.split(":", 1)[-1] for w in wanted]
        unknown = [n for n in names if n not in self.features]
        if unknown:
            raise ValueError(f"view {self.name} has no features {unknown}")
        served = [F.col(n).cast(self.schema[n].dataType).alias(n) for n in names]
        return df.select(self.key, self.order, *served)


def stock_view(name: str = "stock_features") -> FeatureView:
    """The view of the training table: 24 floats and the label."""
    fields = [T.StructField(c, T.FloatType()) for c in VIEW_FEATURES]
    return FeatureView(name, T.StructType([*fields, T.StructField("target", T.LongType())]))


def asof_features(
    entities: DataFrame,
    features: DataFrame,
    columns: list[str],
    key: str = "ticker",
    at: str = "event_timestamp",
    order: str = "date",
    ttl_seconds: int = TTL_SECONDS,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """For each entity row the latest feature row at or before its time, not older than the ttl.

    Entities without a match keep nulls. Features are packed into one array per (key, bucket of
    time), unique per (key, order) and hence short; the last row of a bucket is handed on to the
    buckets that its ttl reaches. An entity row then joins exactly one packed row, so no pairs are
    built, and since that side is unique, Spark can split a hot (key, bucket) of entities.
    """
    size = bucket_seconds or max(1, ttl_seconds)  # then a row reaches the next bucket at most
    reach = -(-ttl_seconds // size)

    def bucket(c: str):
        return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / F.lit(size))

    record = F.struct(F.col(order).alias("_at"), *columns)
    packed = (
        features.withColumn("_bucket", bucket(order))
        .groupBy(key, "_bucket")
        .agg(F.array_sort(F.collect_list(record)).alias("_rows"))
    )
    handed = (
        packed.withColumn("_carry", F.element_at("_rows", -1))
        .select(
            key,
            F.explode(F.sequence(F.col("_bucket") + 1, F.col("_bucket") + reach)).alias("_bucket"),
            "_carry",
        )
        .groupBy(key, "_bucket")
        .agg(F.max_by("_carry", "_carry._at").alias("_carry"))
    )
    lookup = packed.join(handed, [key, "_bucket"], "full")
    found = F.coalesce(
        F.try_element_at(F.filter("_rows", lambda r: r["_at"] <= F.col(at)), F.lit(-1)),
        F.col("_carry"),
    )
    oldest = F.col(at) - F.make_dt_interval(secs=F.lit(ttl_seconds))
    joined = (
        entities.withColumn("_bucket", bucket(at))
        .join(lookup, [key, "_bucket"], "left")
        .withColumn("_found", found)
        .withColumn("_found", F.when(F.col("_found._at") >= oldest, F.col("_found")))
    )
    return joined.select(
        *entities.columns,
        F.col("_found._at").alias(f"feature_{order}"),
        *[F.col(f"_found.{c}").alias(c) for c in columns],
    )


def latest_per_key(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """The last row of each key; (key, order) must be unique.

    One aggregate per column: with numbers and times only, Spark aggregates by hash on the map side
    and sorts nothing, which it could not do for a struct of the row.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    last = df.groupBy(key).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest]
    )
    return last.select(df.columns)


def online_features(requests: DataFrame, latest: DataFrame, key: str = "ticker") -> DataFrame:
    """Latest values for the requested keys; unknown keys keep nulls."""
    return requests.join(latest, key, "left")


def materialize(
    df: DataFrame, start: str | None, end: str, key: str = "ticker", order: str = "date"
) -> DataFrame:
    """Latest row per key among those with ``start <= order <= end``."""
    rows = df.filter(F.col(order) <= F.lit(end).cast("timestamp_ntz"))
    if start is not None:
        rows = rows.filter(F.col(order) >= F.lit(start).cast("timestamp_ntz"))
    return latest_per_key(rows, key, order)


def merge_latest(
    old: DataFrame, new: DataFrame, key: str = "ticker", order: str = "date"
) -> DataFrame:
    """Latest row per key of two tables of latest rows."""
    return latest_per_key(old.unionByName(new.select(old.columns)), key, order)


def materialize_incremental(
    old: DataFrame, df: DataFrame, key: str = "ticker", order: str = "date"
) -> DataFrame:
    """Bring a table of latest rows up to date with the rows past the high-water mark of their key.

    A key that the table does not have yet counts from its first row.
    """
    marks = old.groupBy(key).agg(F.max(order).alias("_mark"))
    fresh = df.join(marks, key, "left").filter(
        F.col("_mark").isNull() | (F.col(order) > F.col("_mark"))
    )
    return merge_latest(old, latest_per_key(fresh.select(df.columns), key, order), key, order)


def features_with_fallback(
    requests: DataFrame, online: DataFrame, stored: DataFrame, columns: list[str],
    key: str = "ticker",
) -> DataFrame:
    """Online values, else the last stored row, else nulls; ``source`` names where they came from."""
    hot = online.select(key, F.struct(*columns).alias("_online"))
    cold = latest_per_key(stored, key).select(key, F.struct(*columns).alias("_stored"))
    both = requests.join(hot, key, "left").join(cold, key, "left")
    source = (
        F.when(F.col("_online").isNotNull(), "online")
        .when(F.col("_stored").isNotNull(), "stored")
        .otherwise("not_found")
    )
    value = F.coalesce("_online", "_stored")
    return both.select(
        *requests.columns, source.alias("source"), *[value[c].alias(c) for c in columns]
    )


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows plus the new rows whose id is not there yet; the first of equal new ids wins.

    ``new`` may carry ``position``, its input order, which decides among equal ids; without it the
    row that comes first as JSON does.
    """
    if "position" in new.columns:
        first = new.groupBy(key).agg(F.min("position").alias("position"))
        new = new.join(first, [key, "position"], "left_semi").drop("position")
    else:
        rest = F.struct(*[c for c in new.columns if c != key])
        new = new.groupBy(key).agg(F.min_by(rest, F.to_json(rest)).alias("_row")).select(key, "_row.*")
    fresh = new.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)

"""Data contracts: declared columns and types, coercion, null rules and documented value rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.indicators import INDICATOR_COLUMNS


@dataclass(frozen=True)
class Contract:
    """A schema with null rules; further columns are allowed and values are cast to it first."""

    name: str
    schema: T.StructType


def _fields(names: list[str], kind: T.DataType, nullable: bool) -> list[T.StructField]:
    return [T.StructField(n, kind, nullable) for n in names]


_KEY = [T.StructField("date", T.TimestampNTZType(), False), *_fields(["ticker"], T.StringType(), False)]
_BAR = [
    *_fields(["open", "high", "low", "close"], T.DoubleType(), False),
    *_fields(["volume"], T.LongType(), False),
]
_INDICATORS = _fields(INDICATOR_COLUMNS, T.DoubleType(), True)
_TARGET = _fields(["target"], T.LongType(), False)

RAW = Contract("raw", T.StructType([*_KEY, *_BAR]))
FEATURES = Contract("features", T.StructType([*_KEY, *_BAR, *_INDICATORS]))
TRAINING = Contract("training", T.StructType([*_KEY, *_BAR, *_INDICATORS, *_TARGET]))
PREDICTION = Contract("prediction", T.StructType([*_BAR, *_INDICATORS]))


class ContractError(ValueError):
    """A table does not meet its contract."""


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [f.name for f in contract.schema.fields if f.name not in df.columns]


def _cast(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, T.DoubleType):
        number = value.try_cast(field.dataType)
        return F.when(~F.isnan(number), number)  # NaN means missing; the library uses null
    return value.try_cast(field.dataType)


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared columns cast to their types; a value that cannot be cast becomes null."""
    return df.withColumns(
        {f.name: _cast(f) for f in contract.schema.fields if f.name in df.columns}
    )


def _broken_rules(df: DataFrame, contract: Contract) -> dict[tuple[str, str], Column]:
    """(column, rule) to the condition that breaks it."""
    broken = {}
    for f in contract.schema.fields:
        if f.name not in df.columns:
            continue
        missing = F.col(f.name).isNull()
        if isinstance(f.dataType, T.DoubleType):
            number = F.col(f.name).try_cast("double")
            missing = missing | F.coalesce(F.isnan(number), F.lit(False))
        broken[f.name, "castable"] = ~missing & _cast(f).isNull()
        if not f.nullable:
            broken[f.name, "not_null"] = missing
    return broken


def _count_rules(df: DataFrame, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """Violations per (column, rule) in one pass over the table."""
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, rule string, violations long")
    names = {f"r{i}": key for i, key in enumerate(rules)}
    counted = df.agg(*[F.count_if(rules[key]).alias(n) for n, key in names.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(n).alias("violations"))
        for n, (c, r) in names.items()
    ]
    return counted.select(F.inline(F.array(*rows)))


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """(column, rule, violations) with the rules present, castable and not_null."""
    counts = _count_rules(df, _broken_rules(df, contract))
    absent = missing_columns(df, contract)
    if not absent:
        return counts
    rows = [(c, "present", 1) for c in absent]
    return counts.unionByName(
        df.sparkSession.createDataFrame(rows, "column string, rule string, violations long")
    )


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """The coerced table, or ``ContractError`` naming the rules that are broken."""
    absent = missing_columns(df, contract)
    if absent:
        raise ContractError(f"{contract.name}: missing columns {absent}")
    # at most two rows per declared column come to the driver
    broken = contract_report(df, contract).filter("violations > 0").collect()
    if broken:
        listed = ", ".join(f"{r['column']} {r['rule']} ({r['violations']})" for r in broken)
        raise ContractError(f"{contract.name}: {listed}")
    return coerce(df, contract)


def quarantine(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with ``broken``, the array of ``column:rule`` that each row breaks."""
    rules = _broken_rules(df, contract)
    marks = [F.when(condition, F.lit(f"{c}:{r}")) for (c, r), condition in rules.items()]
    return df.withColumn("broken", F.array_compact(F.array(*marks)))


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls (and NaN) per column in one pass: (column, missing)."""
    kinds = dict(df.dtypes)
    conditions = {}
    for c in columns or df.columns:
        missing = F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            missing = missing | F.isnan(c)
        conditions[c, "missing"] = missing
    return _count_rules(df, conditions).select("column", F.col("violations").alias("missing"))


def value_rules(df: DataFrame) -> dict[tuple[str, str], Column]:
    """The documented rules that apply to the columns present."""
    rules = {
        (c, "positive"): ~(F.col(c) > 0)
        for c in ("open", "high", "low", "close") if c in df.columns
    }
    if {"high", "low"} <= set(df.columns):
        rules["high", "not_below_low"] = F.col("high") < F.col("low")
    if "rsi_14" in df.columns:
        rules["rsi_14", "between_0_and_100"] = ~F.col("rsi_14").between(0, 100)
    if "target" in df.columns:
        rules["target", "zero_or_one"] = ~F.col("target").isin(0, 1)
    return rules


def rule_report(df: DataFrame, key: tuple[str, str] = ("ticker", "date")) -> DataFrame:
    """(column, rule, violations) for the value rules and for the uniqueness of the key."""
    repeats = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .agg(F.count(F.lit(1)).alias("violations"))
    )
    unique = repeats.select(
        F.lit(",".join(key)).alias("column"), F.lit("unique").alias("rule"), "violations"
    )
    return _count_rules(df, value_rules(df)).unionByName(unique)

"""Global order on large tables: running totals, exact quantiles, and cuts at a rank.

Nothing here sorts a whole group in one task. Running totals use range partitions and one total per
partition; a cut at a rank narrows the search level by level with counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import stage

PART = "_part"
SPLITTERS = 1024  # values that a round of a search for a rank counts between
FINAL_ROWS = 1 << 16  # rows that are few enough to be sorted for the row at a rank


def running_totals(df: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``cum_x`` (running total up to and including the row) and ``total_x`` for each sum.

    Also adds ``next_value``, the next value of ``order`` in the group. ``df`` must have one row per
    (group, order value): aggregate first, so that a value with very many rows is a single row.

    Rows are range-partitioned by (group, order) and stored, because the partition number must be
    the same for the totals and for the rows. A group of any size is spread over the partitions.
    """
    placed = stage(
        df.repartitionByRange(*group, order).withColumn(PART, F.spark_partition_id()), "ordered"
    )
    parts = Window.partitionBy(*group).orderBy(PART)
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, PART).agg(
        *[F.sum(c).alias(f"_{c}") for c in sums], F.min(order).alias("_first")
    )
    bases = totals.select(
        *group,
        PART,
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in sums],
        *[F.sum(f"_{c}").over(Window.partitionBy(*group)).alias(f"total_{c}") for c in sums],
        F.lead("_first").over(parts).alias("_next_first"),
    )
    inside = Window.partitionBy(*group, PART).orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumns({f"_run_{c}": F.sum(c).over(running) for c in sums})
        .withColumn("_next", F.lead(order).over(inside))
        .join(bases, [*group, PART])
        .withColumns({f"cum_{c}": F.col(f"_base_{c}") + F.col(f"_run_{c}") for c in sums})
        .withColumn("next_value", F.coalesce("_next", "_next_first"))
        .drop(PART, "_next", "_next_first")
        .drop(*[f"_run_{c}" for c in sums], *[f"_base_{c}" for c in sums])
    )


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the numeric columns, without nulls and NaN."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    values = numbers.unpivot([], columns, "column", "value")
    return values.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (column, prob) with ``quantile``."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(counts, "n", probs)


def quantiles_of_counts(counts: DataFrame, n: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles of the distribution given by (column, value, count) rows."""
    return quantiles_of_totals(running_totals(counts, ["column"], "value", [n]), n, probs)


def quantiles_of_totals(totals: DataFrame, n: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles from running totals; only the rows around a rank reach the aggregation."""
    before = F.col(f"cum_{n}") - F.col(n)

    def rank(p: Column) -> Column:
        return (F.col(f"total_{n}") - 1) * p

    def holds(position: Column) -> Column:
        return (before <= position) & (position < F.col(f"cum_{n}"))

    wanted = F.array(*[F.lit(float(p)) for p in probs])
    near = F.exists(wanted, lambda p: holds(F.floor(rank(p))) | holds(F.ceil(rank(p))))
    found = totals.filter((F.col(n) > 0) & near).withColumn("prob", F.explode(wanted))
    place = rank(F.col("prob"))
    pair = found.groupBy("column", "prob").agg(
        F.max(F.when(holds(F.floor(place)), F.col("value"))).alias("_a"),
        F.max(F.when(holds(F.ceil(place)), F.col("value"))).alias("_b"),
        F.max(place - F.floor(place)).alias("_part"),
    )
    return pair.select(
        "column", "prob",
        (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"),
    )


def rank_cuts(
    df: DataFrame, group: list[str], levels: list[str], ranks: DataFrame
) -> DataFrame:
    """The row at a rank in each group, found without sorting the group.

    ``levels`` are columns whose lexicographic order is the order of rows, from coarse to fine; all
    together must be unique in a group. ``ranks`` has (group, ``cut``, ``k``) rows with the 0-based
    rank wanted. Each level counts only the rows under the value chosen on the level above.
    """
    path = ranks
    chosen: list[str] = []
    for level in levels:
        keys = [*group, *chosen]
        rows = df if not chosen else df.join(path.select(*keys).distinct(), keys, "left_semi")
        counts = rows.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("_n"))
        earlier = (
            Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        )
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        inside = (F.col("_before") <= F.col("k")) & (F.col("k") < F.col("_before") + F.col("_n"))
        path = (
            path.join(placed, keys)
            .filter(inside)
            .select(*group, "cut", *chosen, level, (F.col("k") - F.col("_before")).alias("k"))
        )
        chosen.append(level)
    return path.drop("k")


def row_at_rank(df: DataFrame, columns: list[str], rank: int) -> list[str] | None:
    """The values of ``columns``, as strings, on the row at the 0-based ``rank``; None beyond it.

    A round draws some rows as splitters, counts all rows between them in one pass with partial
    sums, and goes on with the rows of the range that holds the rank. A range shrinks about
    ``SPLITTERS``-fold, so a table of 10^8 rows is counted twice; which rows are drawn changes the
    number of rounds, never the result. Values may repeat but must not be null.
    """
    kinds = dict(df.dtypes)
    rows, n = df.select(*columns), df.count()
    last: list[list[str]] = []  # the greatest value of the range, so that every round leaves something out
    if not 0 <= rank < n:
        return None
    while n > FINAL_ROWS:
        drawn = rows.orderBy(F.rand(7)).limit(SPLITTERS)
        known = rows.limit(1).select(
            F.inline(F.array(*[_values(columns, kinds, v) for v in last]))
        ) if last else drawn.limit(0)
        ordered = drawn.unionByName(known).distinct().orderBy(*columns)
        found = [list(r) for r in ordered.select(*[F.col(c).cast("string") for c in columns]).collect()]
        cuts = [[F.lit(v).cast(kinds[c]) for v, c in zip(values, columns)] for values in found]
        places = F.array(*[_values(columns, kinds, values) for values in found])
        key = F.struct(*columns)
        steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
        bucket = F.aggregate(
            steps, F.lit(0),
            lambda a, s: F.when(F.coalesce(F.get(places, a + s - 1) <= key, F.lit(False)), a + s).otherwise(a),
        )
        counted = rows.groupBy(bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        shown = counted.select(
            "bucket", "n", (F.col("low") == F.col("high")).alias("same"),
            *[F.col(f"high.{c}").cast("string").alias(f"high_{i}") for i, c in enumerate(columns)],
        )
        for part in shown.orderBy("bucket").collect():
            if rank < part.n:
                break
            rank -= part.n
        high = [part[f"high_{i}"] for i in range(len(columns))]
        if part.same:
            return high
        if part.bucket > 0:
            rows = rows.filter(~_before(columns, cuts[part.bucket - 1]))
        if part.bucket < len(cuts):
            rows = rows.filter(_before(columns, cuts[part.bucket]))
        n, last = part.n, [high]
    row = rows.orderBy(*columns).offset(rank).limit(1).select(*[F.col(c).cast("string") for c in columns]).first()
    return list(row)


def _values(columns: list[str], kinds: dict[str, str], values: list[str]) -> Column:
    return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for v, c in zip(values, columns)])


def _before(columns: list[str], values: list[Column]) -> Column:
    """Whether a row comes before ``values``, as comparisons that reach the scan."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, values))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out

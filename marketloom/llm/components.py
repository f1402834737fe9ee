"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import stage

MAX_ROUNDS = 50


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    own = least.select("a", F.col("m").alias("b"))
    rest = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return own.unionByName(rest).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    Large-star and small-star steps alternate until the edges stay as they are. A node with very
    many neighbours is never gathered: its least neighbour is a partial aggregate, which is stored, so
    that adaptive execution can split the join back (the other side is unique). Every round is stored, so the
    plan stays short and a lost executor costs one round. An edge table without rows gives none.
    """
    larger, smaller = F.greatest(a, b), F.least(a, b)
    current = stage(
        edges.filter(F.col(a) != F.col(b)).select(larger.alias("a"), smaller.alias("b")).distinct(),
        "edges",
    )
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b")))
    before = current.agg(mark.alias("m")).first().m
    for _ in range(MAX_ROUNDS):
        current = stage(_small_star(_large_star(current)), "edges")
        now = current.agg(mark.alias("m")).first().m
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )

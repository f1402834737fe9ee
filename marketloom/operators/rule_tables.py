"""Rules for texts as a table of any size: substrings and patterns filed under a rare part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import stage

GRAM = 3  # characters of the parts that rules are filed under
RULES_AT_ONCE = 200_000  # rules that a pass over the texts takes along


def _grams(text: Column, size: int) -> Column:
    """The distinct parts of ``size`` characters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    parts = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(parts)).otherwise(
        F.array().cast("array<string>")
    )


def rule_hits(
    df: DataFrame, rules: DataFrame, keys: list[str], text: str = "text"
) -> DataFrame:
    """(keys, rule_id) for each row of ``df`` and each rule that its lower-cased text fits.

    ``rules`` has ``rule_id``, ``literal`` and ``pattern``. Without a pattern a rule fits a text that
    contains its literal. With one the text must match the pattern (in lower case), and ``literal``
    is a part that every match contains; a pattern without such a part (null or empty literal) is
    tried on every text, so there should be few of those. Literals are compared in lower case.

    Each rule is filed under that part of its literal, ``GRAM`` characters long (or the whole of a
    shorter literal), which the fewest texts hold. Texts fetch the rules of the parts they hold by a
    join, and only those are tried. The rules are broadcast, ``RULES_AT_ONCE`` at a time, so a text
    is judged where it is read: neither its parts nor the rules to try are shuffled or stored. The
    plan is the same for any number of rules, but for one more pass per ``RULES_AT_ONCE``.

    Rows of equal keys are judged each by its own text. Null texts, rules with neither literal nor
    pattern, and empty tables give no rows. A rule id that stands in several rules is given once per
    row and rule.
    """
    lowered = F.lower("text").alias("text")
    texts = stage(
        df.select(F.struct(*keys).alias("key"), F.col(text).cast("string").alias("text"))
        .filter(F.col("text").isNotNull()).select("key", lowered),
        "rule_texts",
    )
    literal = F.lower(F.coalesce("literal", F.lit("")))
    filed = rules.select("rule_id", literal.alias("literal"), "pattern").filter(
        (F.col("literal") != "") | F.col("pattern").isNotNull()
    )
    short = F.length("literal") < GRAM
    parts = F.when(short, F.array("literal")).otherwise(_grams(F.col("literal"), GRAM))
    asked = filed.select("*", F.explode(parts).alias("gram"))

    held = F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])
    counts = texts.select(F.explode(held).alias("gram")).groupBy("gram").count()
    rarest = F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram")
    index = stage(
        asked.join(counts, "gram", "left").groupBy("rule_id", "literal", "pattern").agg(rarest),
        "rule_index",
    )
    fits = F.when(F.col("pattern").isNull(), F.contains("text", "literal")).otherwise(
        F.rlike(F.col("text"), F.col("pattern"))
    )
    # a text holds a part once and a rule is filed once, so no pair comes twice
    parted = texts.select(F.col("key").alias("_key"), "text", F.explode(held).alias("gram"))
    passes = max(-(-index.count() // RULES_AT_ONCE), 1)
    turn = F.pmod(F.xxhash64("rule_id", "literal", "pattern"), F.lit(passes))
    hits = [
        parted.join(F.broadcast(index.filter(turn == i)), "gram").filter(fits).select(
            *[F.col("_key")[k].alias(k) for k in keys], "rule_id"
        )
        for i in range(passes)
    ]
    return reduce(DataFrame.unionAll, hits)

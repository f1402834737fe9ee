"""Text expressions: words, normal form, token overlap."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The characters that count as white space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


SPACE_CHARACTERS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once even if the body uses it often.

    Expressions inside the lambdas of array functions are not shared by the optimizer.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    """Words between runs of white space; none in a blank text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    inner = strip(text)
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, f"{SPACE}+")))


def normalize_text(text: Column) -> Column:
    """Lower case, single spaces, no space at the ends."""
    return F.array_join(words(F.lower(text)), " ")


def token_overlap(expected: Column, actual: Column) -> Column:
    """Share of the distinct expected words that occur in the answer; 0 without expected words."""
    want = F.array_distinct(words(F.lower(expected)))
    have = words(F.lower(actual))
    shared = F.size(F.array_intersect(want, have))
    return F.coalesce(F.try_divide(shared, F.size(want)), F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, which is not symmetric."""
    return pd.Series(
        [
            None if e is None or a is None else difflib.SequenceMatcher(None, e, a).ratio()
            for e, a in zip(expected, actual)
        ],
        dtype="float64",
    )


def similarity(expected: Column, actual: Column) -> Column:
    """Matching ratio of the normal forms; equal texts skip the Python call."""
    e, a = normalize_text(expected), normalize_text(actual)
    return F.when(e == a, F.lit(1.0)).otherwise(sequence_ratio(e, a))



def edit_similarity(expected: Column, actual: Column) -> Column:
    """1 less the edit distance over the longer length, on normal forms with ASCII characters.

    Other characters count as one placeholder. Two empty texts are equal.
    """
    e, a = (F.regexp_replace(normalize_text(x), r"[^\x00-\x7F]", "?") for x in (expected, actual))
    longer = F.greatest(F.length(e), F.length(a))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(e, a) / longer)

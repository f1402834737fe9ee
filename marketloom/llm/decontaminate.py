"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_parts, let, shingles, total, whole, words
from marketloom.session import stage

THRESHOLD = 0.8
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]  # first bit and bits of each block
NEAR = 3  # differing bits that a block may have
RADIUS = len(BLOCKS) * (NEAR + 1) - 1  # some block has at most NEAR of so many differing bits


def _hashes(text: str | Column) -> Column:
    """Hashes of the five-word shingles of the lower-cased text."""
    return shingles(words(F.lower(whole(text))), 5)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of shingle hashes; a repeated shingle counts with its weight."""

    def bit(k: Column) -> Column:
        ones = total(F.transform(hashes, lambda h: F.call_function("getbit", h, k).cast("long")))
        return F.when(
            ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), k)
        ).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle arrays; the weight of a shingle is its number of places."""

    def count(of: Column, h: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == h))

    def by(both: Column) -> Column:
        return total(
            F.transform(both, lambda h: F.least(count(a, h), count(b, h)).cast("long"))
        )

    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return let(
        F.when(single, F.size(F.array_intersect(a, b)).cast("long")).otherwise(
            let(F.array_intersect(a, b), by)
        ),
        lambda least: least / (F.size(a) + F.size(b) - least),
    )


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, n_words, hashes, fingerprint) of the items that have a shingle."""
    rows = benchmark.select(
        F.col(item_id).alias("item_id"), _hashes(text).alias("hashes")
    ).filter(F.size("hashes") > 0)
    return rows.select(
        "item_id", (F.size("hashes") + 4).alias("n_words"), "hashes",
        let(F.col("hashes"), simhash).alias("fingerprint"),
    )


def _block(fingerprint: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _windows(docs: DataFrame, anchors: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, start, n_words, hashes) of the item-sized windows that can resemble an item.

    A window without any shingle of an item has similarity 0, so windows are laid where a shingle of
    the document is one of an item: the window starts so that both stand at the same place in window
    and item, cut at the ends of the text. The shingles of all items are broadcast, in parts of a
    bounded number of rows; documents are read once per part and never shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    placed = rows.filter(F.col("doc_id").isNotNull() & F.col("_text").isNotNull()).select(
        "doc_id", _hashes("_text").alias("_all")
    ).select("*", F.posexplode("_all").alias("_at", "shingle"))
    out = None
    for part in bounded_parts(anchors, "anchors"):
        met = placed.join(F.broadcast(part), "shingle")
        start = F.col("_at") - F.col("place")
        low = F.greatest(start, F.lit(0))
        high = F.least(start + F.col("n_words") - 4, F.size("_all"))
        found = met.select(
            "doc_id", start.cast("long").alias("start"), "n_words",
            F.slice("_all", low + 1, high - low).alias("hashes"),
        )
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "start", "n_words", "hashes"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and item that it holds: (doc_id, item_id, start, similarity).

    Every item is looked for in windows of as many words over every whole document: all windows
    where a shingle stands at the same place as in the item, cut at the ends of the text.
    ``similarity`` is the weighted Jaccard similarity of the five-word shingles of window and item,
    at least ``threshold``; the best window counts, the first of equals (``start``: its first word,
    negative if the text begins inside the item).

    Windows and items get 64-bit SimHash fingerprints. These are cut into blocks; the index holds
    for every item and block all values within ``NEAR`` bits, so every fingerprint within ``RADIUS``
    bits meets its window in some block. Those within the radius are verified on their shingles.

    Items and documents of fewer than five words, null texts and null ids match nothing; empty
    tables give no rows. Repeated rows give one result. Rows that share an id are searched each.
    """
    items = stage(_items(benchmark, item_id, item_text), "items")
    anchors = items.select(
        "n_words", F.posexplode("hashes").alias("place", "shingle")
    ).distinct()
    windows = stage(
        _windows(docs, anchors, doc_id, text).withColumn(
            "fingerprint", let(F.col("hashes"), simhash)
        ),
        "windows",
    )
    blocks = F.array(
        *[
            F.struct(F.lit(i).alias("block"), _block(F.col("fingerprint"), *b).alias("value"))
            for i, b in enumerate(BLOCKS)
        ]
    )
    asked = windows.select("fingerprint", "n_words").distinct().select("*", F.inline(blocks))
    filed = items.select("item_id", "n_words", "fingerprint", F.inline(blocks))
    masks = F.filter(
        F.sequence(F.lit(0).cast("long"), F.lit((1 << 13) - 1).cast("long")),
        lambda m: F.bit_count(m) <= NEAR,
    )
    index = filed.select(
        "item_id", "n_words", F.col("fingerprint").alias("item_print"), "block",
        F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"),
    )
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    near = (
        asked.join(index, ["block", "value", "n_words"]).filter(distance <= RADIUS)
        .select("fingerprint", "n_words", "item_id").distinct()
    )
    pairs = windows.join(near, ["fingerprint", "n_words"]).join(
        items.select("item_id", F.col("hashes").alias("item_hashes")), "item_id"
    )
    similarity = let(
        F.col("hashes"),
        lambda a: let(F.col("item_hashes"), lambda b: weighted_similarity(a, b)),
    )
    found = pairs.select("doc_id", "item_id", "start", similarity.alias("similarity"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"))).alias("best")
    return (
        found.filter(F.col("similarity") >= threshold - 1e-12)
        .groupBy("doc_id", "item_id").agg(best)
        .select(
            "doc_id", "item_id", (-F.col("best.back")).alias("start"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, rows without an id too."""
    gone = contaminated(docs, benchmark, doc_id, text).select(
        F.col("doc_id").alias("_gone")
    ).distinct().alias("gone")
    rows = docs.alias("rows")
    return rows.join(gone, F.col(f"rows.{doc_id}") == F.col("gone._gone"), "left_anti")

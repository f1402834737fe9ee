"""Line deduplication: keep bitmaps per document from range-partitioned line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import let, lower_ascii, whole
from marketloom.session import stage

MIN_CHARS = 20
MIN_DOCS = 3


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _key(line: Column) -> Column:
    return lower_ascii(F.regexp_replace(line, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))


def line_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_rows: float | None = None,
) -> DataFrame:
    """Dropped lines as bitmaps: (doc_id, text_hash, n_dropped, bitmap), only where lines go.

    A line's key is the line without white space at both ends and with A-Z lower-cased. A key of at
    least ``min_chars`` characters that occurs in at least ``min_docs`` documents loses all its
    lines but those of the largest ``doc_id``. ``bitmap`` is an array of (word, bits): bit ``k`` of
    64-bit word ``w`` is set if line ``64 w + k`` is dropped; words without dropped lines are not
    stored. ``text_hash`` tells apart rows that share a ``doc_id``.

    Key hashes (128 bits) are range-partitioned and each partition is read in the order of hash,
    document (largest first) and position: the first document of a key keeps its lines. A key with
    more lines than a task's share of all lines (``hot_rows``; by default all lines over the number
    of shuffle partitions, so there are fewer such keys than partitions) is aggregated with partial
    sums instead, and joined back by broadcast. Both ways give the same result.

    Null text counts as one empty line. Rows without an id, short lines and empty tables give no
    bitmap. Rows that share an id count as one document; repeated rows share one bitmap.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    source = source.filter(F.col("doc_id").isNotNull() & F.col("_text").isNotNull())
    long_lines = F.filter(
        F.transform(
            _lines(F.col("_text")),
            lambda line, i: F.struct(i.alias("pos"), _key(line).alias("key")),
        ),
        lambda x: F.length(x["key"]) >= min_chars,
    )
    found = source.select(
        "doc_id", F.xxhash64("_text").alias("text_hash"), F.explode(long_lines).alias("_l")
    )
    places = stage(
        found.select(
            F.xxhash64("_l.key").alias("h1"), F.xxhash64(F.lit(1), "_l.key").alias("h2"),
            "doc_id", "text_hash", F.col("_l.pos").alias("pos"),
        ),
        "line_places",
    )
    if hot_rows is None:
        hot_rows = places.count() / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_keys(places, hot_rows)
    spread = places.join(F.broadcast(hot), "h1", "left_anti")
    crowd = places.join(F.broadcast(hot), "h1", "left_semi")
    return _bitmaps(
        _dropped_in_order(spread, min_docs).unionByName(_dropped_hot(crowd, min_docs))
    )


def _hot_keys(places: DataFrame, hot_rows: float) -> DataFrame:
    """First hash of the keys with more than ``hot_rows`` lines, counted exactly."""
    counts = places.groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > hot_rows).select("h1")


def _dropped_in_order(places: DataFrame, min_docs: int) -> DataFrame:
    """Range-partitioned by hash, sorted by document and position; all but the first document go.

    ``nth`` counts the documents of a key as they begin, so all lines of a document share it.
    """
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy(F.desc("doc_id"), "pos")
    begins = F.coalesce(F.lag("doc_id").over(order) != F.col("doc_id"), F.lit(True))
    ranked = (
        places.repartitionByRange("h1")
        .withColumn("begins", begins.cast("long"))
        .withColumn("nth", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n_docs", F.max("nth").over(key))
    )
    return ranked.filter((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)).select(
        "doc_id", "text_hash", "pos"
    )


def _dropped_hot(places: DataFrame, min_docs: int) -> DataFrame:
    """The same decision for few very frequent keys, by sums that combine before the shuffle."""
    holders = places.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("first_doc")
    )
    known = places.join(F.broadcast(holders), ["h1", "h2"])
    return known.filter(
        (F.col("n_docs") >= min_docs) & (F.col("doc_id") < F.col("first_doc"))
    ).select("doc_id", "text_hash", "pos")


def _bitmaps(dropped: DataFrame) -> DataFrame:
    by_doc = dropped.distinct().repartition("doc_id", "text_hash")
    bit = F.expr("shiftleft(1L, pos % 64)")
    parts = by_doc.groupBy("doc_id", "text_hash", F.expr("pos div 64").alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")
    )
    return parts.groupBy("doc_id", "text_hash").agg(
        F.sum("n").alias("n_dropped"), F.collect_list(F.struct("word", "bits")).alias("bitmap")
    )


def kept_lines(text: Column, bitmap: Column) -> Column:
    """The text without the lines that ``bitmap`` marks; a null bitmap keeps all."""

    def kept(lines: Column) -> Column:
        marked = F.flatten(
            F.transform(
                bitmap,
                lambda b: F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.lit(63)),
                        lambda k: F.call_function("getbit", b["bits"], k) == 1,
                    ),
                    lambda k: (b["word"] * 64 + k).cast("int"),
                ),
            )
        )
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), marked)
        return F.array_join(F.transform(places, lambda i: lines[i]), "\n")

    return F.when(bitmap.isNull(), whole(text)).otherwise(let(_lines(text), kept))


def with_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each row of ``docs`` as struct ``d`` with its ``bitmap`` and ``n_dropped`` (null: none)."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"),
    ).alias("rows")
    marks = bitmaps.alias("marks")
    same = (F.col("rows.id") == F.col("marks.doc_id")) & (
        F.col("rows.hash") == F.col("marks.text_hash")
    )
    return rows.join(marks, same, "left").select("rows.d", "marks.bitmap", "marks.n_dropped")


def line_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (doc_id, n_lines, n_dropped, kept_sha256)."""
    marked = with_bitmaps(docs, line_bitmaps(docs, doc_id, text), doc_id, text)
    kept = kept_lines(F.col(f"d.{text}"), F.col("bitmap"))
    return marked.select(
        F.col(f"d.{doc_id}").alias("doc_id"),
        F.size(_lines(F.col(f"d.{text}"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; all columns stay.

    A column ``n_chars``, if there is one, follows the new text. Null texts stay null.
    """
    marked = with_bitmaps(docs, line_bitmaps(docs, doc_id, text), doc_id, text)
    whole_text, bitmap = F.col(f"d.{text}"), F.col("bitmap")
    kept = F.when(bitmap.isNull(), whole_text).otherwise(kept_lines(whole_text, bitmap))

    def column(name: str, kind: str) -> Column:
        value = F.col(f"d.`{name}`")
        if name == text:
            value = kept
        elif name == "n_chars":
            value = F.when(bitmap.isNull(), value).otherwise(F.length(kept).cast(kind))
        return value.alias(name)

    return marked.select(*[column(c, kind) for c, kind in docs.dtypes])

"""Ranked lexical search: K2-treaps over blocks of documents, searched best-first."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.treap import Treap, best_columns
from marketloom.session import stage

SHARD_DOCS = 512  # documents of one treap
SHARD_BYTES = 1 << 21  # bytes of text of one treap, unless a single text is longer
SHARDS_TOGETHER = 8  # treaps of one stored file, which bounds its pages and deals them out evenly
BLOCK_ITEMS = 1024  # items that are searched together
HELD_ITEMS = 1 << 16  # items whose best documents a task holds at once
TOP = 20
UNNAMED = -(1 << 63)  # stands for a null id, which comes first among ties

# The terms and the weights of the score.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # on UTF-8 with A-Z lower-cased
SATURATION, SCALE, LENGTH_PART = 12, 1000, 25

INDEX_SCHEMA = (
    "doc_ids array<bigint>, terms binary, holders binary, height int, masks binary, falls binary"
)
ITEM_SCHEMA = "item_id bigint, item_key string, terms array<binary>, counts array<bigint>"


def _terms(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").lower())


def _packed(data: bytes) -> bytes:
    """Compressed, behind its size: rows shrink to about a fifth, and with them every buffer on the way."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _texts(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.select(F.col(name).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))


def collection_totals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents): two numbers from sums of every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = terms = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                n = len(_terms(text))
                held, terms = held + (n > 0), terms + n
        yield pa.RecordBatch.from_pydict({"held": [held], "terms": [terms]})

    counted = _texts(docs, doc_id, text).mapInArrow(count, "held bigint, terms bigint")
    row = counted.agg(F.sum("held").alias("held"), F.sum("terms").alias("terms")).first()
    return row.held or 0, row.terms or 0


def index_documents(
    docs: DataFrame, totals: tuple[int, int], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The search index: one row per block of up to ``SHARD_DOCS`` documents with a term.

    Documents stay in their partition and are cut into blocks as they come, bounded by number and
    bytes. A block has its own dictionary, most frequent term first; its documents are ordered by
    their most frequent term and their length, so that ranges of columns are alike. The grid of
    (term, document) impacts is a K2-treap. Impacts are final but for the weight of the term, which
    the search adds: (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L. Binary columns are
    ``_packed``.
    """
    n_docs, n_terms = totals

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _terms(text.as_py())
                if not found:
                    continue
                block.append((name, Counter(found), len(found)))
                held += len(text.as_buffer())
                if len(block) == SHARD_DOCS or held >= SHARD_BYTES:
                    yield _indexed(block, n_docs, n_terms)
                    block, held = [], 0
        if block:
            yield _indexed(block, n_docs, n_terms)

    return _texts(docs, doc_id, text).mapInArrow(build, INDEX_SCHEMA)


def _indexed(block: list[tuple], n_docs: int, n_terms: int) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    rows: list[int] = []
    for _, counts, _ in block:
        for term in counts:
            if term not in numbers:
                numbers[term] = len(numbers)
        rows.extend(map(numbers.__getitem__, counts))
    holders = np.bincount(rows, minlength=len(numbers))
    by_use = np.argsort(-holders, kind="stable")
    place = np.empty(len(by_use), np.int64)
    place[by_use] = np.arange(len(by_use))
    leading = [place[numbers[max(c, key=c.__getitem__)]] for _, c, _ in block]
    sizes = np.array([n for _, _, n in block])
    order = np.lexsort((sizes, leading))
    column = np.empty(len(block), np.int64)
    column[order] = np.arange(len(block))
    each = np.array([len(c) for _, c, _ in block])
    tf = np.fromiter((n for _, c, _ in block for n in c.values()), np.int64, len(rows))
    length = np.array(
        [100 - LENGTH_PART + LENGTH_PART * n * n_docs // n_terms for _, _, n in block], np.int64
    )
    impact = 1_000_000_000 * tf // (SCALE * tf + SATURATION * np.repeat(length, each))
    treap = Treap.build(
        place[np.array(rows)], np.repeat(column, each), impact, max(len(numbers), len(block))
    )
    masks, falls = treap.dump()
    terms = list(numbers)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([[block[i][0] for i in order]], pa.list_(pa.int64())),
            pa.array([_packed(b" ".join([terms[i] for i in by_use]))], pa.binary()),
            pa.array([_packed(holders[by_use].astype("<u4").tobytes())], pa.binary()),
            pa.array([treap.height], pa.int32()),
            pa.array([_packed(masks)], pa.binary()), pa.array([_packed(falls)], pa.binary()),
        ],
        ["doc_ids", "terms", "holders", "height", "masks", "falls"],
    )


def _weighted_items(
    items: DataFrame, index: DataFrame, n_docs: int, item_id: str, text: str
) -> DataFrame:
    """(item_id, item_key, terms, weights): weight times repeats of the terms that documents hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(_terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2),
                    pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                ["item_id", "item_key", "terms", "counts"],
            )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, holders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_unpacked(terms).split(b" "), pa.binary()),
                        pa.array(np.frombuffer(_unpacked(holders), "<u4").astype(np.int64)),
                    ],
                    ["term", "df"],
                )

    named = _texts(items, item_id, text).distinct()
    cut_items = named.withColumn("key", F.sha2("text", 256)).mapInArrow(cut, ITEM_SCHEMA)
    uses = cut_items.select(
        "item_id", "item_key", F.explode(F.arrays_zip("terms", "counts")).alias("t")
    ).select("item_id", "item_key", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    uses = stage(uses, "item_terms")
    local = index.select("terms", "holders").mapInArrow(listed, "term binary, df bigint")
    df = local.join(uses.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.sum("df").alias("df")
    )
    weight = F.floor(SCALE * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return uses.join(df, "term").groupBy("item_id", "item_key").agg(
        F.collect_list(F.struct("term", (weight * F.col("n")).alias("weight"))).alias("terms")
    )


def search(
    index: DataFrame, items: DataFrame, totals: tuple[int, int],
    item_id: str = "item_id", text: str = "text", top: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0.

    Items go in blocks of about ``BLOCK_ITEMS`` to every block of documents, read from the files in
    which they are stored, without a shuffle. In a block the paths of an item's terms go down the
    treap together, best range of documents first, and stop at the score that the ``top`` best
    documents of the task have so far. A task hands on its ``top`` per item, of which the best are
    taken.
    """
    weighted = stage(_weighted_items(items, index, totals[0], item_id, text), "items")
    blocks = max(-(-weighted.count() // BLOCK_ITEMS), 1)
    packed = weighted.groupBy(
        F.pmod(F.xxhash64("item_id", "item_key"), F.lit(blocks)).alias("block")
    ).agg(F.collect_list(F.struct("item_id", "item_key", "terms")).alias("items")).coalesce(blocks)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[tuple[int, int]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                treap = Treap.load(row["height"], _unpacked(row["masks"]), _unpacked(row["falls"]))
                place = {t: i for i, t in enumerate(_unpacked(row["terms"]).split(b" "))}
                ids = np.array([UNNAMED if i is None else i for i in row["doc_ids"]], np.int64)
                ids = np.concatenate([ids, np.zeros((1 << treap.height) - len(ids), np.int64)])
                for item in row["items"]:
                    held = [(place[t["term"]], t["weight"]) for t in item["terms"] if t["term"] in place]
                    key = (item["item_id"], item["item_key"])
                    rows = np.array([r for r, _ in held], np.int64)
                    weights = np.array([w for _, w in held], np.int64)
                    best[key] = best_columns(treap, rows, weights, ids, top, best.get(key, []))
                if len(best) > HELD_ITEMS:
                    yield _ranked(best)
                    best = {}
        yield _ranked(best)

    found = index.crossJoin(packed).mapInArrow(
        look, "item_id bigint, item_key string, doc_id bigint, score bigint"
    )
    order = Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _ranked(best: dict[tuple, list[tuple[int, int]]]) -> pa.RecordBatch:
    rows = [
        (item, key, None if name == UNNAMED else name, -score)
        for (item, key), found in best.items() for score, name in found
    ]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["item_id", "item_key", "doc_id", "score"]
    )


def lexical_search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
    text: str = "text", top: int = TOP,
) -> DataFrame:
    """Rank all ``docs`` for every item: (item_id, rank, doc_id, score), the index built on the way.

    Null or empty texts have no terms: such documents are never found, such items find nothing.
    Equal scores go by ascending id, a null id first; repeated documents are ranked each. Repeated
    items count once; different texts of one item id are ranked apart. Other columns, whatever their
    names, are left out. Empty tables give no rows.
    """
    totals = collection_totals(docs, doc_id, text)
    if totals[1] == 0:
        totals = (0, 1)
    index = stage(index_documents(docs, totals, doc_id, text), "lexical_index", SHARDS_TOGETHER)
    return search(index, items, totals, item_id, text, top)

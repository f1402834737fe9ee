"""Nearest documents by vector, context text, growth of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import stage

# Defaults and texts.
TOP_K = 5
CONTEXT_K = 3
NO_CONTEXT = "No relevant context found."
PIVOTS = 64  # documents that the others are grouped around
SLACK = 1e-9  # relative and absolute room for rounding of distances
PACK_ROWS = 8192  # documents that a block of queries meets together
BLOCK_ROWS = 2048  # queries of a block
AT_ONCE = 1 << 21  # distances that a task holds at once


def squared_l2(a: Column, b: Column) -> Column:
    products = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def vector_topk(
    documents: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    where: dict[str, str] | None = None,
    metadata: str = "metadata",
    pivots: int = PIVOTS,
) -> DataFrame:
    """The ``k`` nearest documents of each query: (query_id, id, distance, rank), exact.

    ``documents`` has ``id`` and ``embedding``, ``queries`` has ``query_id`` and ``embedding``.
    Distance is squared L2, ties go to the smaller id. ``where`` filters on metadata entries first.

    Every document goes to the cell of its nearest pivot; pivots are ``pivots`` documents, the first
    by a hash of their id. A cell keeps its number of documents and its radius. By the triangle
    inequality a query knows the least and greatest distance to the documents of a cell: the nearest
    cells with ``k`` documents bound its k-th distance, and it visits only cells that may lie
    within this bound. Documents of a cell are stored in packs, visits gathered in blocks, both of
    bounded size, and they meet in an equi-join on the pack: matrix products tell which documents
    of a pack may be among the ``k`` best of a query, and only their distances are summed up. Each
    task keeps its own ``k`` best per query before the shuffle (the ranking filter is applied on
    both sides of it). Documents without a distance (a null in the embedding) come first.
    """
    for name, value in (where or {}).items():
        documents = documents.filter(F.try_element_at(F.col(metadata), F.lit(name)) == value)
    docs = documents.select("id", "embedding")
    first = docs.orderBy(F.xxhash64("id"), "id").limit(pivots)
    centres = first.agg(F.sort_array(F.collect_list("embedding")).alias("_p")).scalar()
    own = F.array_min(
        F.transform(
            "_centres",
            lambda p, i: F.struct(_distance(p, F.col("embedding")).alias("d"), i.alias("cell")),
        )
    )
    placed = stage(
        docs.withColumn("_centres", centres).select("id", "embedding", own.alias("_own")).select(
            "id", "embedding", F.col("_own.cell").alias("_cell"), F.col("_own.d").alias("_d")
        ),
        "placed_vectors",
    )
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("r"))
    cells = cells.withColumn("p", F.ceil(F.col("n") / PACK_ROWS).cast("int"))
    packed = cells.agg(F.collect_list(F.struct("_cell", "n", "r", "p")).alias("_c")).scalar()

    def reach(c: Column) -> Column:
        away = _distance(F.col("_centres")[c["_cell"]], F.col("embedding"))
        return F.struct(
            (away + c["r"]).alias("high"), (away - c["r"]).alias("low"), c["n"].alias("n"),
            c["_cell"].alias("cell"), c["p"].alias("packs"),
        )

    far = F.lit(float("inf"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), far.alias("bound"))
    counted = F.aggregate(
        "_reach", start,
        lambda a, c: F.when(a["seen"] >= k, a).otherwise(
            F.struct((a["seen"] + c["n"]).alias("seen"), c["high"].alias("bound"))
        ),
        lambda a: F.when(a["seen"] >= k, a["bound"]).otherwise(far),
    )
    bounded = (
        queries.select("query_id", "embedding")
        .withColumns({"_centres": centres, "_cells": packed})
        .withColumn("_reach", F.sort_array(F.transform("_cells", reach)))
        .withColumn("_bound", counted * (1 + SLACK) + SLACK)
    )
    every = F.filter("_reach", lambda c: c["low"] <= F.col("_bound"))
    packs_of = F.flatten(F.transform(every, lambda c: F.transform(
        F.sequence(F.lit(0), c["packs"] - 1), lambda p: F.struct(c["cell"].alias("_cell"), p.alias("_pack"))
    )))
    spread = F.monotonically_increasing_id()  # any even spread does: the result is the same
    blocks = F.ceil(F.greatest(queries.agg(F.count(F.lit(1)).alias("_q")).scalar(), F.lit(1)) / BLOCK_ROWS)
    visits = bounded.withColumn("_block", F.pmod(spread, blocks)).select(
        "query_id", F.col("embedding").alias("_query"), "_block", F.inline(packs_of)
    )
    known = F.col("_d").isNotNull()
    numbered = placed.filter(known).withColumn("_n", spread).join(F.broadcast(cells.select("_cell", "p")), "_cell")
    packs = numbered.groupBy("_cell", F.pmod("_n", F.col("p")).cast("int").alias("_pack")).agg(
        F.sort_array(F.collect_list(F.struct("id", "embedding"))).alias("_docs")  # ties go to the smaller id
    )
    gathered = visits.groupBy("_cell", "_pack", "_block").agg(
        F.collect_list(F.struct("query_id", "_query")).alias("_asked")
    )
    met = packs.join(gathered, ["_cell", "_pack"]).select(
        F.col("_docs.id").alias("ids"), F.col("_docs.embedding").cast("array<array<double>>").alias("vectors"),
        F.col("_asked.query_id").alias("names"), F.col("_asked._query").cast("array<array<double>>").alias("asked"),
    )
    kinds = dict(placed.select("id").dtypes) | dict(queries.select("query_id").dtypes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _met(*[batch.column(c)[i].values for c in range(4)], k)

    near = met.mapInArrow(
        meet, f"query_id {kinds['query_id']}, id {kinds['id']}, distance double"
    )
    unknown = placed.filter(~known).join(
        visits.filter(F.col("_pack") == 0).select("query_id", "_query", "_cell"), "_cell"
    ).select("query_id", "id", squared_l2(F.col("_query"), F.col("embedding")).alias("distance"))
    pairs = near.unionByName(unknown)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    top = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", "id", "distance", F.col("rank").cast("long").alias("rank"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def _met(
    ids: pa.Array, vectors: pa.ListArray, names: pa.Array, asked: pa.ListArray, k: int
) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of a pack for each query of a block; documents come in the order of ids."""
    docs, queries = _matrix(vectors), _matrix(asked)
    for i in range(0, len(queries), step := max(AT_ONCE // len(docs), 1)):
        rows, places, distances = nearest(docs, queries[i : i + step], k)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(rows + i)), ids.take(pa.array(places)), pa.array(distances)],
            ["query_id", "id", "distance"],
        )


def nearest(docs: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, distance) of the ``k`` nearest documents per query, ties to the first.

    A matrix product gives all distances but for rounding; whatever may be among the ``k`` nearest
    is then summed up term by term, in order, as ``squared_l2`` does.
    """
    if k < len(docs):
        own, other = (docs**2).sum(1), (queries**2).sum(1)
        about = other[:, None] + own[None, :] - 2 * queries @ docs.T
        room = 8 * (docs.shape[1] + 4) * np.finfo(np.float64).eps * (own.max() + other)
        most = np.partition(about, k - 1, axis=1)[:, k - 1] + room
        rows, places = np.nonzero(~(about > most[:, None]))  # where nothing can be told, all
    else:
        rows, places = (x.ravel() for x in np.indices((len(queries), len(docs))))
    distances = np.empty(len(rows))
    step = max(AT_ONCE // max(docs.shape[1], 1), 1)
    for i in range(0, len(rows), step):
        part = slice(i, i + step)
        terms = (queries[rows[part]] - docs[places[part]]) ** 2
        distances[part] = np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else 0.0
    order = np.lexsort((places, distances, rows))
    rows, places, distances = rows[order], places[order], distances[order]
    first = np.searchsorted(rows, np.arange(len(queries)))
    best = np.arange(len(rows)) - first[rows] < k
    return rows[best], places[best], distances[best]


def rag_context(
    queries: DataFrame, hits: DataFrame, documents: DataFrame, k: int = CONTEXT_K
) -> DataFrame:
    """(query_id, context): the ``k`` best documents as numbered sources, best first.

    Queries without hits get a fixed text. At most ``k`` documents meet per query.
    """
    texts = hits.filter(F.col("rank") <= k).join(documents.select("id", "text"), "id")
    listed = texts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_docs")
    )
    sources = F.transform(
        "_docs",
        lambda d, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]\n"), d["text"], F.lit("\n")),
    )
    joined = queries.select("query_id").join(
        listed.select("query_id", F.array_join(sources, "\n").alias("context")), "query_id", "left"
    )
    return joined.withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def with_document_ids(documents: DataFrame, position: str = "position") -> DataFrame:
    """Ids ``doc_0``, ``doc_1``... from a column that numbers the documents from 0."""
    return documents.withColumn("id", F.concat(F.lit("doc_"), F.col(position).cast("string")))

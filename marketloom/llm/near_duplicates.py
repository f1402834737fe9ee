"""Near duplicates: Jaccard join of word shingles by MinHash banding, verified on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import connected_components
from marketloom.session import stage

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999  # chance that a pair right at the threshold shares a band
MOST_HASHES = 100
TILE = 256  # texts of a bucket that are compared with each other, or with as many others, at once
SEED = 7

SIGNATURE_SCHEMA = "doc_id bigint, c1 bigint, c2 bigint, bands array<bigint>"
SET_SCHEMA = "doc_id bigint, c1 bigint, c2 bigint, shingles binary"
LINK_SCHEMA = "rep bigint, links bigint, root bigint"


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows per band for which ``most`` hashes give the recall at the threshold.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes cannot reach a recall of {recall} at {threshold}")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; a shorter text is one run of all its words."""
    from xxhash import xxh64_intdigest

    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(runs)]
    return _mix(runs)


def _class_of(words: list[bytes]) -> tuple[int, int]:
    """128-bit hash of the sequence of words, as two signed longs."""
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(b" ".join(words)), "<i8").tolist())


def _words_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(doc_id, words) of the rows of (doc_id, text) that have an id and a word."""
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = (text or "").encode().split()
        if doc_id is not None and words:
            yield doc_id, words


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    random = np.random.default_rng(SEED)
    count = bands * rows
    factors = random.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = random.integers(0, 1 << 32, count, dtype=np.uint32)

    def flush(names: list, runs: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(r) for r in runs])
        starts = np.cumsum(lengths) - lengths
        x = (np.concatenate(runs) >> np.uint64(32)).astype(np.uint32)
        least = np.empty((count, len(runs)), np.uint64)
        for k in range(count):
            least[k] = np.minimum.reduceat(x * factors[k] + shifts[k], starts)
        hashes = np.zeros((bands, len(runs)), np.uint64)
        for r in range(rows):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + least[r::rows]
        ids, firsts, seconds = zip(*names)
        flat = pa.array(_mix(hashes).T.reshape(-1).view(np.int64))
        ends = pa.array(np.arange(len(runs) + 1, dtype=np.int32) * bands)
        columns = [
            pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()),
            pa.ListArray.from_arrays(ends, flat),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "c1", "c2", "bands"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, runs, held = [], [], 0
        for batch in batches:
            for doc_id, words in _words_of(batch):
                names.append((doc_id, *_class_of(words)))
                runs.append(shingle_hashes(words, size))
                held += len(runs[-1])
                if held > 50_000:
                    yield flush(names, runs)
                    names, runs, held = [], [], 0
        if names:
            yield flush(names, runs)

    return docs.mapInArrow(sign, SIGNATURE_SCHEMA)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, *_class_of(words), np.unique(shingle_hashes(words, size)).tobytes())
                for doc_id, words in _words_of(batch)
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "c1", "c2", "shingles"])

    return docs.mapInArrow(collect, SET_SCHEMA)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections in a unit."""
    n = len(sets)
    lengths = [len(s) for s in sets]
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), lengths)
    shared = uses[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, step), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    np.fill_diagonal(out, lengths)
    return out


def _unit_links(band: int, rows: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(rep, links, root) for the rows of a unit that have a link counted here.

    A pair that shares several bands is counted in the first one only.
    """
    rows.sort(key=lambda r: r["rep"])
    tile = np.array([r["tile"] for r in rows])
    bands = np.array([r["bands"] for r in rows], np.int64)
    sizes = np.array([r["size"] for r in rows], np.int64)
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    across = tile[:, None] != tile[None, :]
    open_pairs = across if tile.min() != tile.max() else ~np.eye(len(rows), dtype=bool)
    for k in range(band):
        open_pairs &= bands[:, k, None] != bands[None, :, k]
    if not open_pairs.any():
        return []
    if open_pairs.sum() <= 8 * len(rows):
        overlap = np.zeros(open_pairs.shape)
        for i, j in zip(*np.nonzero(np.triu(open_pairs))):
            overlap[i, j] = overlap[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        overlap = _overlaps(sets)
    lengths = np.array([len(s) for s in sets])
    union = lengths[:, None] + lengths[None, :] - overlap
    linked = open_pairs & (overlap >= threshold * union - 1e-6)
    root = np.arange(len(rows))
    while True:
        near = np.where(linked, root[None, :], len(rows)).min(axis=1)
        lower = np.minimum(root, near)
        if (lower == root).all():
            break
        root = lower
    added = linked @ sizes
    return [
        (rows[i]["rep"], int(added[i]), rows[root[i]]["rep"]) for i in np.flatnonzero(added)
    ]


def _links(units: DataFrame, threshold: float) -> DataFrame:
    """Links of all units; the rows of a unit arrive together."""
    key = ["band", "hash", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, found = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                unit = tuple(row[k] for k in key)
                if unit != current:
                    if held:
                        found += _unit_links(current[0], held, threshold)
                    current, held = unit, []
                    if len(found) > 10_000:
                        yield _link_batch(found)
                        found = []
                held.append(row)
        if held:
            found += _unit_links(current[0], held, threshold)
        if found:
            yield _link_batch(found)

    ordered = units.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(compare, LINK_SCHEMA)


def _link_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*found)]
    return pa.RecordBatch.from_arrays(columns, ["rep", "links", "root"])


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, n_links).

    ``n_links`` counts the other documents whose set of word shingles has a Jaccard similarity of at
    least ``threshold``. ``class_id`` is the least id that a chain of links leads to.

    Texts of equal words form one class, and only its least id goes on. MinHash signatures are cut
    into bands; texts that agree in a band share a bucket. A bucket with exactly the members of
    another is met once. A large bucket is cut into tiles, and every pair of tiles is a unit of
    bounded size, so a group of any size spreads over many tasks: a text is sent once per tile, and
    no pair is emitted. A unit counts each pair of different texts on their full shingle sets in
    the first band they share, and returns one row per text: its links, and its root in the unit.
    Components are then found from these roots.

    A text of fewer than ``size`` words is one shingle. Null, empty and blank texts have no link
    and are their own class; rows without an id have a null class. Rows that share an id count as
    one document (the text of the least hash). An empty table gives no rows.
    """
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = _signatures(source, size, bands, rows).groupBy("doc_id").agg(
        F.min(F.struct("c1", "c2", "bands")).alias("s")
    )
    signed = stage(signed.select("doc_id", "s.*"), "signatures")
    classes = stage(
        signed.groupBy("c1", "c2").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    placed = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = placed.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2"),
    )
    kept = (
        buckets.filter(F.col("n") > 1).groupBy("n", "x1", "x2")
        .agg(F.min(F.struct("band", "hash")).alias("b"))
        .select("b.band", "b.hash", "n")
    )
    members = stage(placed.join(kept, ["band", "hash"]), "bucket_members")

    chosen = members.select("rep").distinct().join(classes, "rep")
    wanted = chosen.select("rep", "c1", "c2").alias("wanted")
    texts = source.alias("source").join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = _sets(texts.select("doc_id", "text"), size).join(
        chosen.withColumnRenamed("rep", "doc_id"), ["doc_id", "c1", "c2"]
    )
    full = sets.groupBy(F.col("doc_id").alias("rep")).agg(
        F.first("size").alias("size"), F.first("bands").alias("bands"),
        F.first("shingles").alias("shingles"),
    )
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64(F.lit(2), "rep"), tiles).cast("int")
    tiled = members.withColumn("tile", own).select(
        "*", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    )
    units = tiled.select(
        "band", "hash", F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"), "tile", "rep",
    ).join(full, "rep")
    links = stage(_links(units, threshold), "links")

    degrees = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links, "rep", "root").withColumnRenamed("node", "rep")
    of_class = classes.select("c1", "c2", "rep", "size").join(degrees, "rep", "left").join(
        components, "rep", "left"
    )
    known = signed.select("doc_id", "c1", "c2").join(of_class, ["c1", "c2"]).select(
        F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"),
    )
    return source.select("doc_id").join(known, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only the least id of each class; all columns stay, rows without an id too."""
    found = near_duplicates(docs, doc_id, text)
    gone = found.filter(F.col("class_id") < F.col("doc_id")).select(
        F.col("doc_id").alias("_gone")
    ).distinct().alias("gone")
    rows = docs.alias("rows")
    same = F.col(f"rows.{doc_id}") == F.col("gone._gone")
    return rows.join(gone, same, "left_anti")

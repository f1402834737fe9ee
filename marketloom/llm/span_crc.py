"""CRC-32 of many byte spans at once: contributions by byte and distance from the end of the span.

CRC-32 is linear over XOR. The checksum of a span is the XOR of one number per byte, which depends
only on the byte and on how many bytes follow it, and of one number per length. Spans longer than
``DEPTH`` are cut into blocks from the end; the blocks' values are folded in pairs, the left one
moved on by the length of the right one.
"""

from __future__ import annotations

import zlib

import numpy as np

DEPTH = 64  # bytes that the position table covers
AT_ONCE = 1 << 18  # bytes of spans that are looked up together, which bounds the memory
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), value >> np.uint32(1))
    return value


def _position_table(depth: int) -> np.ndarray:
    """Row ``d``: what each byte contributes with ``d`` bytes behind it."""
    step = _byte_table()
    rows = [step]
    for _ in range(depth - 1):
        last = rows[-1]
        rows.append(step[last & np.uint32(0xFF)] ^ (last >> np.uint32(8)))
    return np.stack(rows)


POSITIONS = _position_table(DEPTH)
LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)


def _moved(values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for k in range(4):
        out ^= tables[k][(values >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _move_tables() -> np.ndarray:
    """Four tables, one per byte of a value, that move it on by ``DEPTH`` zero bytes."""
    return np.stack([POSITIONS[DEPTH - 1 - k] for k in range(4)])


def _doubled(tables: np.ndarray) -> np.ndarray:
    return np.stack([_moved(t, tables) for t in tables])


def _contributions(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR over the bytes of each span, at most ``DEPTH`` long; empty spans give 0."""
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(AT_ONCE, sizes.sum() + AT_ONCE, AT_ONCE))
    parts = np.split(np.arange(len(starts)), np.unique(cuts))
    return np.concatenate([_looked_up(data, starts[p], sizes[p]) for p in parts])


def _looked_up(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some) == 0:
        return out
    sizes, starts = sizes[some], starts[some]
    ends = np.cumsum(sizes)
    first = ends - sizes
    places = np.arange(ends[-1])
    behind = np.repeat(ends - 1, sizes) - places
    at = places + np.repeat(starts - first, sizes)
    out[some] = np.bitwise_xor.reduceat(POSITIONS[behind, data[at]], first)
    return out


def span_crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 (unsigned 32-bit) of ``data[start:start + size]`` for every span."""
    out = np.empty(len(starts), np.uint32)
    short = sizes <= DEPTH
    out[short] = _contributions(data, starts[short], sizes[short]) ^ LENGTHS[sizes[short]]
    long = np.flatnonzero(~short)
    if len(long):
        out[long] = _folded(data, starts[long], sizes[long])
    return out


def _folded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans longer than ``DEPTH``: block values from the end, folded in pairs level by level."""
    blocks = -(-sizes // DEPTH)
    span = np.repeat(np.arange(len(sizes)), blocks)
    back = np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # blocks behind it
    block_ends = (starts + sizes)[span] - back * DEPTH
    block_starts = np.maximum(block_ends - DEPTH, starts[span])
    values = _contributions(data, block_starts, block_ends - block_starts)
    tables = _move_tables()
    while len(values) > len(sizes):
        left = back % 2 == 1
        values = np.where(left, _moved(values, tables), values)
        firsts = np.flatnonzero(~left)
        values = np.bitwise_xor.reduceat(values, firsts)
        span, back, tables = span[firsts], back[firsts] // 2, _doubled(tables)
    lengths = {int(n): zlib.crc32(bytes(int(n))) for n in np.unique(sizes)}
    return values ^ np.array([lengths[int(n)] for n in sizes], np.uint32)

"""Simple-8b: whole numbers packed into 64-bit words, in blocks that decode independently."""

from __future__ import annotations

import numpy as np

BLOCK = 1024  # numbers per block, 30000 at most; the offset of each block's first word is kept

# Numbers per word and bits per number, by selector. Selector 0 is the escape: the
# number follows in the next word, in full.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_PAD = int(COUNTS.max())


def encode(numbers: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): uint64 words, and the place of the first word of each block.

    In each block the selector that takes the most numbers is chosen from left to right; all blocks
    advance together, word by word. Numbers missing at the end of a block count as zero.
    """
    values = np.ascontiguousarray(numbers, dtype=np.uint64)
    blocks = -(-len(values) // block)
    if blocks == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = block + _PAD
    grid = np.zeros((blocks, width), np.uint64)
    filled = np.zeros(blocks * block, np.uint64)
    filled[: len(values)] = values
    grid[:, :block] = filled.reshape(blocks, block)
    sizes = np.full(blocks, block)
    sizes[-1] = len(values) - (blocks - 1) * block

    selector = np.zeros((blocks, block), np.int8)
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.int8)  # rounds up at most, which is safe
    most, seen = bits[:, :block].copy(), 1  # greatest number of bits among the next numbers
    for s in range(len(COUNTS) - 1, 0, -1):
        for k in range(seen, COUNTS[s]):
            np.maximum(most, bits[:, k : k + block], out=most)
        seen = COUNTS[s]
        np.copyto(selector, np.int8(s), where=most <= BITS[s])

    at = np.zeros(blocks, np.int64)
    rows, starts, chosen = [], [], []
    live = np.arange(blocks)
    while len(live):
        here = at[live]
        pick = selector[live, here]
        rows.append(live)
        starts.append(here)
        chosen.append(pick)
        at[live] = here + COUNTS[pick]
        live = live[at[live] < sizes[live]]
    rows, starts, chosen = (np.concatenate(x) for x in (rows, starts, chosen))
    order = np.argsort(rows, kind="stable")
    rows, starts, chosen = rows[order], starts[order], chosen[order].astype(np.int64)

    slots = np.where(chosen == 0, 2, 1)
    places = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    flat = grid.reshape(-1)
    first = rows * width + starts
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            words[places[mine] + 1] = flat[first[mine]]
            continue
        begin = first[mine]
        packed = np.full(len(begin), int(s) << 60, np.uint64)
        for k in range(COUNTS[s] if BITS[s] else 0):
            packed |= flat[begin + k] << np.uint64(BITS[s] * k)
        words[places[mine]] = packed
    offsets = places[np.searchsorted(rows, np.arange(blocks))]
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, count: int, block: int = BLOCK) -> np.ndarray:
    """The ``count`` numbers that ``encode`` packed; all words of a selector are unpacked at once."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    out = np.zeros(count, np.uint64)
    if count == 0:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for place in np.flatnonzero(selectors == 0):
        if not raw[place]:
            raw[place + 1] = True
    held = np.where(raw, 0, COUNTS[selectors])
    run = np.cumsum(held) - held
    of = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    inside = run - run[offsets][of]
    target = of * block + inside
    limit = np.minimum((of + 1) * block, count)
    for s in np.unique(selectors[~raw]):
        mine = np.flatnonzero((selectors == s) & ~raw)
        if s == 0:
            out[target[mine]] = words[mine + 1]
            continue
        mask, packed = np.uint64((1 << int(BITS[s])) - 1), words[mine]
        begin, room = target[mine], limit[mine] - target[mine]
        for k in range(COUNTS[s] if BITS[s] else 0):
            good = room > k
            out[begin[good] + k] = (packed[good] >> np.uint64(BITS[s] * k)) & mask
    return out

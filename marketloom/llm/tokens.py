"""Token ids of texts, inside tasks: parts of texts that come again are encoded once."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 256  # new pieces that are encoded together
GROUP_BYTES = 1 << 23  # texts that are cut into pieces together
GROUP_PARTS = 1 << 17  # places whose ids are copied at once
WORDS = 1 << 12  # plain words that become Python strings at once
MOST_PIECES = 250_000  # pieces remembered before they become the older half of a memory


class Memory(dict):
    """What was found before; of the older half only what is asked for again stays."""

    def __init__(self, most: int = MOST_PIECES):
        super().__init__()
        self.most = most
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        """Begin a new half if this one is full; not while keys found before are still needed."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys that are not known; known ones of the older half are taken over."""
        new = list(filterfalse(self.__contains__, keys))
        if not self.older:
            return new
        out = []
        for key in new:
            value = self.older.get(key)
            if value is None:
                out.append(key)
            else:
                self[key] = value
        return out


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    symbol = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [symbol[b] for b in range(256)]


def gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` one after another, and the place where each begins (and the last ends)."""
    stops = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - stops[:-1], sizes)
    at += np.arange(len(at))
    return table[at], stops


class PieceEncoder:
    """Ids of whole texts with a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer always starts a new token at a single blank between two other characters, and
    at a single line feed between them, which is a token of its own. So a text may be cut there, and
    a piece seen before need not be encoded again. ``add_special_tokens`` is false.

    Arrow cuts a group of texts, each after a line feed of its own, and tells its distinct pieces.
    Words of Latin letters or of digits are one unit for the pre-tokenizer, also before marks, so the
    library's BPE model gets them directly, each once per group. Other pieces are encoded many in one
    text, with line feeds between them, and remembered. The ids of all places are then copied from
    theirs at once. Texts with other white space between pieces are encoded apart.
    """

    BETWEEN = re.compile(r"(?<=\S) (?=\S)")
    ODD = re.compile(r"[^\S\n]|<\|")  # white space but line feeds; a special token
    MARKS = '.,;:!?"*$%&#'  # marks that no special token ends with
    PLAIN = "^\n?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)$"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        feed = self._ids(["\n"])[0]
        self.feed = feed[0] if len(feed) == 1 else None
        self.symbols = byte_symbols()
        self.model = self.tokenizer.model if self._by_words(path) else None
        self.marks: dict[str, bytes] = {}
        self.first, self.after_blank = Memory(), Memory()

    def _by_words(self, path: str) -> bool:
        """Whether the BPE model gets plain words as they are, in byte symbols."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cutter = told["pre_tokenizer"] or {}
        return (
            told["normalizer"] is None and told["model"]["type"] == "BPE" and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
            and all("<|" in t["content"] for t in told["added_tokens"])
        )

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = pa.array(texts if isinstance(texts, list) else list(texts), pa.large_string())
        return list(self.encode_column(whole))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The same for an Arrow column without nulls, about ``GROUP_BYTES`` of texts at a time."""
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        low = 0
        while low < len(texts):
            limit = (ends[low - 1] if low else 0) + GROUP_BYTES
            high = max(low + 1, int(np.searchsorted(ends, limit, side="right")))
            yield from self._encoded(texts.slice(low, high - low))
            low = high

    def _encoded(self, texts: pa.Array) -> Iterator[bytes]:
        if self.feed is None:
            yield from map(self._apart, texts.to_pylist())
            return
        none, feed = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        fed = pc.binary_join_element_wise(none, texts, feed)
        cut = pc.split_pattern(pc.replace_substring(fed, "\n", " \n"), " ")
        bounds, found = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        del fed, cut
        table, stops, known = self._learned(found.dictionary)
        code, lengths = found.indices.to_numpy(), np.diff(stops)
        low = 0
        while low < len(texts):
            high = int(np.searchsorted(bounds, bounds[low] + GROUP_PARTS, side="right")) - 1
            high = max(low + 1, high)
            here = code[bounds[low] : bounds[high]]
            edges = bounds[low : high + 1] - bounds[low]  # at each an empty part, then the first piece
            starts, sizes, lost = stops[here], lengths[here], ~known[here]
            lost[edges[:-1]] = False
            heads = edges[:-1] + 1
            starts[heads] += 1  # without the line feed that was put before the text
            sizes[heads] = np.maximum(sizes[heads] - 1, 0)
            ids, ends = gathered(table, starts, sizes)
            data, ends = ids.tobytes(), (4 * ends[edges]).tolist()
            apart = set((np.searchsorted(edges, np.flatnonzero(lost), side="right") - 1).tolist())
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                yield self._apart(texts[low + i].as_py()) if i in apart else data[a:b]
            low = high

    def _learned(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, where each begins, and which are known.

        A piece stands behind a blank, or begins with the line feed before it, whose id it then has.
        """
        cores = pc.utf8_rtrim(pieces, self.MARKS)
        plain = np.zeros(len(pieces), bool)
        if self.model is not None:
            plain = pc.match_substring_regex(cores, self.PLAIN).to_numpy(zero_copy_only=False)
        words = cores.filter(pa.array(plain)).dictionary_encode()
        marked = plain & (pc.binary_length(pieces).to_numpy() > pc.binary_length(cores).to_numpy())
        pairs = zip(strings(pieces.filter(pa.array(marked))), strings(cores.filter(pa.array(marked))))
        marks = pa.array([p[len(core) :] for p, core in pairs], pa.large_string()).dictionary_encode()
        others = self._others(strings(pieces.filter(pa.array(~plain))))
        ends = list(map(self._marks, strings(marks.dictionary)))

        word_ids, word_sizes = self._words(words.dictionary)
        rest = [*ends, *[x or b"" for x in others]]
        sizes = np.concatenate([word_sizes, np.fromiter(map(len, rest), np.int64, len(rest)) // 4, [0]])
        places = np.cumsum(sizes) - sizes
        both = np.full((len(pieces), 2), len(sizes) - 1)  # a piece is a word and its marks
        both[plain, 0] = words.indices.to_numpy()
        both[marked, 1] = len(word_sizes) + marks.indices.to_numpy()
        both[~plain, 0] = len(word_sizes) + len(ends) + np.arange(len(others))
        table = np.concatenate([word_ids, np.frombuffer(b"".join(rest), "<u4")])
        table, stops = gathered(table, places[both.ravel()], sizes[both.ravel()])
        known = np.ones(len(pieces), bool)
        known[~plain] = [x is not None for x in others]
        return table, stops[::2], known

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many each has."""
        parts, sizes, blank = [np.empty(0, "<u4")], [], self.symbols[0x20]
        for i in range(0, len(words), WORDS):
            ids: list[int] = []
            for word in strings(words.slice(i, WORDS)):
                before = len(ids)
                if word[0] == "\n":
                    ids.append(self.feed)
                    word = word[1:]
                    symbols = ""
                else:
                    symbols = blank
                if word.isascii():
                    symbols += word
                else:
                    symbols += "".join([self.symbols[b] for b in word.encode()])
                ids += [t.id for t in self.model.tokenize(symbols)]
                sizes.append(len(ids) - before)
            parts.append(np.array(ids, "<u4"))
        return np.concatenate(parts), np.array(sizes, np.int64)

    def _others(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces that are no plain words; none if the text must be encoded apart."""
        self.first.age()
        self.after_blank.age()
        lines = {p[1:] for p in pieces if p[:1] == "\n"}
        self._learn(self.first, "", lines)
        self._learn(self.after_blank, " ", {p for p in pieces if p[:1] != "\n"})
        feed, out = self.feed.to_bytes(4, "little"), []
        for p in pieces:
            ids = self.first.get(p[1:]) if p[:1] == "\n" else self.after_blank.get(p)
            out.append(feed + ids if ids is not None and p[:1] == "\n" else ids)
        return out

    def _apart(self, text: str) -> bytes:
        """A text with white space other than single blanks: cut between other characters only."""
        head, *rest = self.BETWEEN.split(text)
        ids = self._ids([head, *[" " + p for p in rest]])
        return b"".join([array("I", x).tobytes() for x in ids])

    def _learn(self, known: Memory, before: str, pieces: set[str]) -> None:
        """Remember the ids of new pieces that begin and end without white space."""
        new = known.missing(pieces - {""})
        marked = [(p, p.rstrip(self.MARKS)) for p in new if p[-1] in self.MARKS]
        marked = [(p, core) for p, core in marked if core[-1:].isalnum()]
        found = set(new).difference([p for p, _ in marked])
        found.update(known.missing({core for _, core in marked}))
        parts = list(found)
        for i in range(0, len(parts), GROUP):
            group = parts[i : i + GROUP]
            if self.feed is None or self.ODD.search("\n".join(group)):
                apart = [p for p in group if self.feed is None or self.ODD.search(p)]
                fit = [p for p in apart if p == p.strip()]
                for piece, ids in zip(fit, self._ids([before + p for p in fit])):
                    known[piece] = array("I", ids).tobytes()
                group = list(set(group).difference(apart))
            if group:
                self._learn_together(known, before, group)
        for piece, core in marked:  # marks after a letter or digit are tokens of their own
            if core in known:
                known[piece] = known[core] + self._marks(piece[len(core) :])

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > GROUP:
                self.marks.clear()
            self.marks[marks] = array("I", self._ids([marks])[0]).tobytes()
        return self.marks[marks]

    def _learn_together(self, known: Memory, before: str, group: list[str]) -> None:
        ids = array("I", self._ids([before + f"\n{before}".join(group)])[0])
        data = ids.tobytes()
        ends = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == self.feed)).tolist()
        if len(ends) + 1 != len(group):
            raise ValueError("line feeds are not tokens of their own with this tokenizer")
        starts = [0, *[end + 4 for end in ends]]
        known.update(zip(group, map(data.__getitem__, map(slice, starts, [*ends, len(data)]))))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encodings = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in encodings]


def shared(kind: Callable[[str], Any], path: str) -> Any:
    """One object of a kind per file and Python worker: Spark reuses a worker for many tasks.

    This package travels with its code, so that its globals are new in every task. What is to outlive
    a task is kept with a module that the workers import.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_marketloom_held", {})
    if (kind.__name__, path) not in held:
        held[kind.__name__, path] = kind(path)
    return held[kind.__name__, path]


def shared_encoder(path: str) -> PieceEncoder:
    return shared(PieceEncoder, path)


def encoded_rows(
    batches: Iterator[pa.RecordBatch], path: str, end: int
) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) per row of (doc_id, text) batches; null text is empty; ``end`` is appended."""
    encoder, close = shared_encoder(path), end.to_bytes(4, "little")
    for batch in batches:
        ids = encoder.encode_column(pc.fill_null(batch.column(1), ""))
        for doc_id, part in zip(batch.column(0).to_pylist(), ids):
            yield doc_id, part + close

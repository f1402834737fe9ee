"""BPE with word ends: exact merges by backtracking over longest matches, decoding by offsets."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import whole
from marketloom.llm.tokens import GROUP_BYTES, GROUP_PARTS, Memory, byte_symbols, gathered, shared, strings

GROUP = 256  # texts that are decoded together
MOST_PAIRS = 500_000  # answers for token pairs that are remembered
MOST_WORDS = 400_000  # words, and pieces that are none, remembered before they become the older half
LONGEST_KEPT = 100  # characters of a piece that is remembered
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"  # of a piece without the marks behind it
MARKS = "".join(m for m in map(chr, range(0x21, 0x7F)) if not m.isalnum() and m != "'")
END = "\x00"  # stands for the end of a word; the byte alphabet of the vocabulary does not hold it


class Merges:
    """The vocabulary of a BPE file as tables for a backtracking encoder.

    A word is its byte symbols and ``END``, which belongs to the last one. ``longest`` finds for
    every place the longest token that begins there; ``shorter`` leads from a token to the longest
    token that is its prefix. Two tokens may stand side by side only if merging by rank would leave
    the border between them alone; ``fits`` tells it from the halves of both tokens and keeps the
    answer in a table. A sequence in which all neighbours fit is the one that merging gives.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        plain = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        ids = {plain(t): i for t, i in vocab.items()}
        self.size = {i: len(t) for t, i in ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = (ids[plain(t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            merged = ids[plain("".join(pair).replace(" ", "") if isinstance(pair, str) else "".join(pair))]
            self.rank[left, right] = rank
            self.halves[merged] = (left, right, rank)
        self.shorter = {
            i: next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), None)
            for t, i in ids.items()
        }
        self.finder = ahocorasick.Automaton()
        for token, i in ids.items():
            self.finder.add_word(token, (i, len(token) - 1))
        self.finder.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def longest(self, word: str) -> list[int | None]:
        """Per place of ``word`` the longest token that begins there."""
        found: list[int | None] = [None] * len(word)
        for end, (token, before) in self.finder.iter(word):
            found[end - before] = token  # ends ascend, so longer ones come later
        return found

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = not self._joined(left, right)
        return known

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, float]]:
        """The tokens at one edge of ``token`` while it is built, with the rank that ends each."""
        until = float("inf")
        while True:
            yield token, until
            if token not in self.halves:
                return
            until = self.halves[token][2]
            token = self.halves[token][side]

    def _joined(self, left: int, right: int) -> bool:
        """Whether a merge across the border comes before both its sides are used otherwise.

        Of merges of one rank the leftmost is done first, hence the two comparisons differ.
        """
        starts = list(self._edge(right, 0))
        for a, a_until in self._edge(left, 1):
            for b, b_until in starts:
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return True
        return False

    def encode(self, word: str) -> list[int]:
        """Ids of one word (byte symbols without its end)."""
        symbols = word + END
        found, size, dead = self.longest(symbols), len(symbols), bytearray(len(symbols) + 1)
        lengths, shorter, known, fits = self.size, self.shorter, self.pairs, self.fits
        out: list[int] = []
        at, token, last = 0, found[0], None
        while True:
            while token is not None:
                end = at + lengths[token]
                if not dead[end]:
                    if last is None:
                        break
                    fit = known.get((last, token))
                    if fit or (fit is None and fits(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at, last = end, token
                if at == size:
                    return out
                token = found[at]
            else:  # nothing leads on from here: take back the last token and try its prefixes
                if not out:
                    raise ValueError("a symbol of the word is not in the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token, last = shorter[token], out[-1] if out else None


class WordEncoder:
    """Ids of whole texts with a word-end BPE file of the tokenizers library.

    Its own normalizer and pre-tokenizer give the words; white space only separates them, so a text
    is cut at blanks and line feeds, and every distinct piece of a group of texts is treated once. Strings of special
    tokens are their ids. Nothing is added and nothing truncated.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.merges = Merges(
            model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"]
        )
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.pieces, self.words = Memory(MOST_WORDS), Memory(MOST_WORDS)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return list(self.encode_column(pa.array(texts, pa.large_string())))

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
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds, found = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        del cut
        table, stops = self._learned(found.dictionary)
        code, lengths = found.indices.to_numpy(), np.diff(stops)
        low = 0
        while low < len(texts):
            high = int(np.searchsorted(bounds, bounds[low] + GROUP_PARTS, side="right")) - 1
            high = max(low + 1, high)
            here = code[bounds[low] : bounds[high]]
            ids, ends = gathered(table, stops[here], lengths[here])
            data, ends = ids.tobytes(), (4 * ends[bounds[low : high + 1] - bounds[low]]).tolist()
            yield from [data[a:b] for a, b in zip(ends, ends[1:])]
            low = high

    def _learned(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and where each begins (and the last ends)."""
        self.pieces.age()
        self.words.age()
        cores = pc.utf8_rtrim(pieces, MARKS)
        plain = pc.match_substring_regex(cores, LETTERS).to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(cores.filter(pa.array(plain))).dictionary_encode()
        marked = plain & (pc.binary_length(pieces).to_numpy() > pc.binary_length(cores).to_numpy())
        pairs = zip(strings(pieces.filter(pa.array(marked))), strings(cores.filter(pa.array(marked))))
        marks = pa.array([p[len(core) :] for p, core in pairs], pa.large_string()).dictionary_encode()

        known = self._words([self._symbols(w) for w in strings(words.dictionary)])
        ends = self._words(strings(marks.dictionary))
        others = self._others(strings(pieces.filter(pa.array(~plain))))
        each = [*known, *ends, *others, b""]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        places = np.cumsum(sizes) - sizes
        both = np.full((len(pieces), 2), len(each) - 1)  # a piece is a word and its marks
        both[plain, 0] = words.indices.to_numpy()
        both[marked, 1] = len(known) + marks.indices.to_numpy()
        both[~plain, 0] = len(known) + len(ends) + np.arange(len(others))
        both = both.ravel()
        table, stops = gathered(np.frombuffer(b"".join(each), "<u4"), places[both], sizes[both])
        return table, stops[::2]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words in byte symbols."""
        new = {w: array("I", self.merges.encode(w)).tobytes() for w in self.words.missing(words)}
        self.words.update({w: ids for w, ids in new.items() if len(w) <= LONGEST_KEPT})
        return [self.words[w] if w in self.words else new[w] for w in words]

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are not Latin letters with marks behind them."""
        new = {}
        for piece in self.pieces.missing(pieces):
            parts = self._cut(piece)
            ids = iter(self._words([w for w in parts if w not in self.special]))
            new[piece] = b"".join(
                [self.special[w].to_bytes(4, "little") if w in self.special else next(ids) for w in parts]
            )
        self.pieces.update({p: ids for p, ids in new.items() if len(p) <= LONGEST_KEPT})
        return [self.pieces[p] if p in self.pieces else new[p] for p in pieces]

    def _symbols(self, word: str) -> str:
        return word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])

    def _cut(self, piece: str) -> list[str]:
        """Words of a piece in byte symbols; strings of special tokens stay as they are."""
        parts = self.marks.split(piece) if self.marks is not None and "<|" in piece else [piece]
        out = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                out += [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out


class Decoder:
    """Token strings in one table of bytes with offsets; a text is its tokens joined by blanks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        tokens = dict(model["model"]["vocab"]) | {t["content"]: t["id"] for t in model["added_tokens"]}
        strings = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            strings[i] = token.encode() + b" "
        self.numbers = [str(i) for i in range(len(strings))]
        sizes = np.array([len(s) for s in strings], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.table = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        places = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.table[places][:-1].tobytes()


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            yield batch.slice(at, GROUP)


def _encoded(
    batches: Iterator[pa.RecordBatch], encoder: WordEncoder
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        ids = encoder.encode_column(batch.column(1))
        for part in _groups([batch]):
            yield part, list(islice(ids, part.num_rows))


def _decoded(decoder: Decoder, ids: list[bytes | None]) -> pa.Array:
    texts = [decoder.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in ids]
    return pa.array(texts, pa.binary()).cast(pa.string())


def encode_texts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids) per row of ``docs``; ids are little-endian unsigned 32-bit.

    Rows are encoded where they lie, without a shuffle; a worker remembers words up to a fixed number.
    Null or empty text has no ids. Null ids, ties and repeated rows are encoded like any row. Other
    columns, whatever their names, are left out. An empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(WordEncoder, tokenizer)
        for part, ids in _encoded(batches, encoder):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids binary")


def decode_texts(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) for rows of (doc_id, ids); no ids decode to an empty text.

    Null ids of tokens count as none. Repeated rows and ties are decoded like any row; an empty
    table gives no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared(Decoder, tokenizer)
        for part in _groups(batches):
            decoded = _decoded(decoder, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), decoded], ["doc_id", "ids", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        decode, "doc_id bigint, ids binary, decoded string"
    )


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: (doc_id, ids, numbers, decoded), with the decimal ids joined by blanks as ``numbers``.

    What ``encode_texts`` and ``decode_texts`` do, in one Python worker per task: each worker of a
    task holds tables and memories of its own. Edge cases as in ``encode_texts``.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared(WordEncoder, tokenizer), shared(Decoder, tokenizer)
        number = decoder.numbers.__getitem__
        for part, ids in _encoded(batches, encoder):
            numbers = [" ".join(map(number, array("I", x))) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array(numbers, pa.string()), _decoded(decoder, ids)],
                ["doc_id", "ids", "numbers", "decoded"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(both, "doc_id bigint, ids binary, numbers string, decoded string")


def word_digest(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: (doc_id, n_tokens, ids_sha256 of the decimal ids joined by blanks, decoded_sha256).

    Edge cases as in ``encode_texts``; a text without ids has the digests of the empty text.
    """
    return round_trip(docs, tokenizer, doc_id, text).select(
        "doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("numbers", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Problem 8: encode a corpus with a public byte-level BPE vocabulary.

Words are encoded in batches: the symbols of many words lie in one flat numpy array, and
in each round every word merges all places of its own lowest-ranked pair. Ranks of pairs
come from a binary search over a sorted array of pair keys.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of more symbols than this are merged one by one with a heap, as rounds over
#: them would cost the square of their length. The result is the same.
LONG_WORD = 400
#: Words kept with their ids in a Python worker; beyond it the store starts anew.
WORD_STORE = 400_000

#: Splitting patterns, and forms that split ASCII text alike but run in the faster engine.
_ASCII_FORMS = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+",
}

_NONE = np.iinfo(np.int64).max


class ByteBpe:
    """A vocabulary of byte strings whose ids are their ranks."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(_ASCII_FORMS[pattern]).findall if pattern in _ASCII_FORMS else self.split
        self.store: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.store.clear()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)

    def _ranks_of(self, symbols: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or _NONE."""
        wanted = symbols[:-1] * self.width + symbols[1:]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.merged[at], _NONE)

    def _long(self, word: bytes) -> np.ndarray:
        """One long word: a heap of pairs over a linked list of symbols."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        ahead, back = list(range(1, len(ids))) + [-1], [-1] + list(range(len(ids) - 1))
        ranks = self._ranks_of(np.array(ids, dtype=np.int64)).tolist()
        pair_of = dict(zip(self.keys.tolist(), self.merged.tolist())) if not hasattr(self, "pair_of") else self.pair_of
        self.pair_of = pair_of
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(ranks) if rank != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            ahead[i] = ahead[j]
            if ahead[j] >= 0:
                back[ahead[j]] = i
            for a in (back[i], i):
                if a >= 0 and ahead[a] >= 0:
                    new = pair_of.get(ids[a] * self.width + ids[ahead[a]])
                    if new is not None:
                        heapq.heappush(heap, (new, a, ids[a], ids[ahead[a]]))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self._long(word)
            else:
                short.append(i)
        if not short:
            return out
        number = np.array(short, dtype=np.int64)
        sizes = np.array([len(words[i]) for i in short], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8)]
        while len(number):
            owner = np.repeat(np.arange(len(number)), sizes)
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), _NONE, dtype=np.int64)
            rank[:-1] = self._ranks_of(symbols)
            rank[starts + sizes - 1] = _NONE  # a pair must not reach into the next word
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[number[k]] = symbols[starts[k] : starts[k] + sizes[k]]
                keep = ~done[owner]
                symbols, rank = symbols[keep], rank[keep]
                number, sizes, lowest = number[~done], sizes[~done], lowest[~done]
                if not len(number):
                    break
                owner = np.repeat(np.arange(len(number)), sizes)
            hit = rank == lowest[owner]
            places = np.flatnonzero(hit)
            # of overlapping places the leftmost wins, so every other one of a run stays
            first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            in_run = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
            places = places[in_run % 2 == 0]
            symbols[places] = rank[places]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            sizes = sizes - np.bincount(owner[places], minlength=len(number))
            symbols = symbols[keep]
        return out

    def _learn(self, words: list[str]) -> None:
        """Put the ids of unseen words into the store."""
        coded = self.encode_words([w.encode("utf-8", "replace") for w in words])
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        base, total = len(self.store), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(words) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + total] = np.concatenate(coded)
        self.sizes[base : base + len(words)] = sizes
        self.starts[base : base + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        for i, w in enumerate(words, base):
            self.store[w] = i

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of the texts in it."""
        if len(self.store) > WORD_STORE:
            self._reset()
        split, split_ascii = self.split, self.split_ascii
        words = [(split_ascii(t) if t.isascii() else split(t)) if t else [] for t in texts]
        fresh = set().union(*words) if words else set()
        fresh.difference_update(self.store)
        if fresh:
            self._learn(list(fresh))
        get = self.store.__getitem__
        counts = np.array([len(w) for w in words], dtype=np.int64)
        slots = np.fromiter((get(w) for ws in words for w in ws), dtype=np.int64, count=int(counts.sum()))
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(total)
        word_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[source], word_ends


_LOADED: dict[tuple[int, str], ByteBpe] = {}


def _loaded(vocabulary: bytes, pattern: str) -> ByteBpe:
    key = (hash(vocabulary), pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(vocabulary, pattern)
    return _LOADED[key]


def default_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ids of each text: (id, ids array<int>).

    Null and empty texts have an empty list; white space is text like any other, and
    strings of special tokens are ordinary text. One row in gives one row out, repeated
    rows and null keys included; other columns are left out. Texts are never cut.
    The vocabulary file (at most 1 MB) is read by the driver and sent to the executors
    inside the function, so executors need no file of their own.
    """
    default_path, default_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    with open(path or default_path, "rb") as fh:
        vocabulary = fh.read()
    sent, pattern = df.sparkSession.sparkContext.broadcast(vocabulary), pattern or default_pattern
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, ends = bpe.encode_texts(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)

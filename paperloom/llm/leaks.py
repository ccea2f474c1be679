"""Problem 9: find held-out test items inside a training corpus.

The normalised test items form a generalised suffix automaton over words. Documents are
streamed through it, tracking the longest match that ends at each word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of test items in one automaton. More items make more automata, each of which is
#: laid against the whole corpus, so that what is broadcast stays bounded.
BLOCK_WORDS = 400_000

_WORD = re.compile(r"[A-Za-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Runs of ASCII letters or digits, in lower case."""
    found = _WORD.findall(text) if text else []
    return " ".join(found).lower().split(" ") if found else []


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self, texts: Iterable[tuple[object, list[str]]], least: int):
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: list[set] = [set()]
        self.keys: list[object] = []
        for key, words in texts:
            number, last = len(self.keys), 0
            self.keys.append(key)
            for word in words:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), own)
                own[last].add(number)
        # a state holds the items of all states whose links lead to it
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            own[self.link[state]] |= own[state]
        # from each state, the one that stands for its suffix of just `least` words
        self.items: list[tuple[int, ...]] = [()] * len(self.length)
        self.anchor = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[state] >= least:
                if self.length[self.link[state]] < least:
                    self.anchor[state] = state
                    self.items[state] = tuple(sorted(own[state]))
                else:
                    self.anchor[state] = self.anchor[self.link[state]]

    def _copy(self, state: int, length: int, own: list[set]) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        own.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, word: int, own: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            there = nxt[last][word]
            if length[there] == length[last] + 1:
                return there
            clone = self._copy(there, length[last] + 1, own)
            link[there] = clone
            while last >= 0 and nxt[last].get(word) == there:
                nxt[last][word] = clone
                last = link[last]
            return clone
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        own.append(set())
        state = len(length) - 1
        while last >= 0 and word not in nxt[last]:
            nxt[last][word] = state
            last = link[last]
        if last >= 0:
            there = nxt[last][word]
            if length[there] == length[last] + 1:
                link[state] = there
            else:
                clone = self._copy(there, length[last] + 1, own)
                link[there] = link[state] = clone
                while last >= 0 and nxt[last].get(word) == there:
                    nxt[last][word] = clone
                    last = link[last]
        return state

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(end, length, state) of each word at which a match of `least` or more words ends.

        A word that no item holds ends every match, so only stretches of known words of
        sufficient length enter the automaton.
        """
        known = list(map(self.ids.get, words))
        found, least, count, at = [], self.least, len(known), 0
        nxt, link, length = self.next, self.link, self.length
        while at + least <= count:
            # the last unknown word of the window decides where the next one may begin
            probe = at + least - 1
            while probe >= at and known[probe] is not None:
                probe -= 1
            if probe >= at:
                at = probe + 1
                continue
            state = have = 0
            while at < count and (word := known[at]) is not None:
                while state and word not in nxt[state]:
                    state = link[state]
                    have = length[state]
                if word in nxt[state]:
                    state, have = nxt[state][word], have + 1
                else:
                    state = have = 0
                if have >= least:
                    found.append((at, have, state))
                at += 1
        return found

    def leaked(self, words: list[str]) -> set[int]:
        """Numbers of the items that share `least` consecutive words with the text."""
        out: set[int] = set()
        for state in {self.anchor[state] for _, _, state in self.matches(words)}:
            out.update(self.items[state])
        return out

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches [from, to) of words that lie in some item, merged."""
        merged: list[list[int]] = []
        for end, have, _ in self.matches(words):
            begin = end + 1 - have
            if merged and begin <= merged[-1][1]:
                merged[-1] = [min(begin, merged[-1][0]), end + 1]
            else:
                merged.append([begin, end + 1])
        return [(a, b) for a, b in merged]


def _blocks(items: DataFrame, id_col: str, text_col: str, least: int) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of items. The driver holds one block at a time."""
    block: list[tuple[object, list[str]]] = []
    size = 0
    for key, text in items.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(text)
        if len(words) < least:
            continue
        block.append((key, words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield SuffixAutomaton(block, least)
            block, size = [], 0
    if block:
        yield SuffixAutomaton(block, least)


def _through(docs: DataFrame, items: DataFrame, least: int, ids: tuple[str, str, str, str], column: str, kind: T.DataType, find: Callable[[SuffixAutomaton, list[str]], list]) -> DataFrame:
    """(doc_id, text, column): what ``find`` gives of all blocks of items, one after the other, in one scan of the texts.

    The text goes through the blocks as it is, so what is found does not depend on their size.
    """
    doc_id, doc_text, item_id, item_text = ids
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("text", T.StringType()), T.StructField(column, T.ArrayType(kind))])
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text"), F.array().cast(T.ArrayType(kind)).alias(column))
    for automaton in _blocks(items, item_id, item_text, least):
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, shape = sent.value, pa.list_(pa_type(kind))
            for batch in batches:
                found = [find(own, words_of(text)) for text in batch.column(1).to_pylist()]
                if any(found):
                    found = [before + more for before, more in zip(batch.column(2).to_pylist(), found)]
                    batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, shape)], names=schema.names)
                yield batch

        out = out.mapInArrow(run, schema)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) that share at least ``least`` consecutive words.

    Null, empty and short texts are in no pair; repeated rows give one pair. Texts are
    read whole, and columns besides the named ones are ignored.
    """
    kind = items.schema[item_id].dataType
    texts = docs.where(F.col(doc_text).isNotNull())
    found = _through(texts, items, least, (doc_id, doc_text, item_id, item_text), "items", kind, lambda own, words: [own.keys[n] for n in own.leaked(words)])
    return found.select("doc_id", F.explode("items").alias("item_id")).distinct()


def _cut(text: str, spans: list[list[int]]) -> tuple[str, int, int]:
    """The text without the spans of words, which may overlap; how many words went, and how many there were."""
    places = [m.span() for m in _WORD.finditer(text)]
    keep, at, end, gone = [], 0, 0, 0
    for first, stop in sorted(map(tuple, spans)):
        first = max(first, end)
        if first < stop:
            # a span that goes on from another takes what stands between them along
            keep.append(text[at : places[first][0]] if first > end or not gone else "")
            at, end, gone = places[stop - 1][1], stop, gone + stop - first
    return "".join(keep) + text[at:], gone, len(places)


def remove_leaks(docs: DataFrame, items: DataFrame, least: int = 10, coverage: float = 0.5, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents without their leaked spans: (doc_id, clean_text, removed_words, coverage).

    Spans of ``least`` or more words that lie in an item are cut out of the text, spans of
    all items together. A text of which they hold the share ``coverage`` or more comes out
    as null. Null texts stay null, with no removed words. One row in gives one row out.
    """
    found = _through(docs, items, least, (doc_id, doc_text, item_id, item_text), "spans", T.ArrayType(T.LongType()), lambda own, words: [list(x) for x in own.spans(words)])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("clean_text", T.StringType()), T.StructField("removed_words", T.LongType()), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, shares = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = share = 0
                if spans:
                    text, gone, count = _cut(text, spans)
                    share = gone / count
                texts.append(None if share >= coverage else text)
                removed.append(gone)
                shares.append(float(share))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(shares, pa.float64())], names=schema.names)

    return found.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

"""Word statistics over a whole corpus, shared by the text operators."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word belongs to the vocabulary if one text in so many has it. As a text of w different
#: words counts w times at most, the vocabulary is bounded by SHARE * w whatever the corpus' size.
SHARE = 2000
#: Words are flushed from a task's counter beyond this many.
COUNTER = 300_000

_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t\r]*\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def default_words(text: str) -> set[str]:
    """Different words of a text, with words that a hyphen splits over two lines put together."""
    return set(_WORD.findall(_BREAK.sub("", text) if "-" in text else text))


def document_counts(df: DataFrame, text_col: str, words: Callable[[str], set[str]] = default_words) -> DataFrame:
    """(word, n): in how many texts each word stands.

    Counts cover all texts. Words are summed inside each task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(words(text))
            if len(total) > COUNTER:
                yield flush()
        yield flush()

    source = df.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text_col: str, words: Callable[[str], set[str]] = default_words, share: int = SHARE) -> tuple[dict[str, int], int]:
    """The bounded vocabulary with its document counts, and how many texts there are."""
    texts = df.where(F.col(text_col).isNotNull()).count()
    least = max(3, math.ceil(texts / share))
    rows = document_counts(df, text_col, words).where((F.col("n") >= least)).collect()
    return {r["word"]: r["n"] for r in rows}, texts


class Trie:
    """A trie over words as nested dicts; the key "" holds a word's weight."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for char in word:
                node = node.setdefault(char, {})
            node[""] = n

    def within(self, word: str, most: int, swaps: dict[str, list[tuple]] | None = None, edits: int = 1) -> list[tuple[str, int, int]]:
        """(vocabulary word, cost, weight) of all words that the automaton of ``word`` accepts.

        The automaton's states are (place in the word, cost so far). It moves along the trie
        with equal characters, with ``swaps`` (read, meant and, if not 1, the cost, by first
        character read) and with Levenshtein's edits, which cost ``edits`` each; 0 means
        none. Retrieval is complete.
        """
        swaps = swaps or {}
        best: dict[str, tuple[int, int]] = {}
        stack = [(self.root, "", 0, 0)]
        seen: dict[tuple[int, int], int] = {}
        while stack:
            node, spelled, at, cost = stack.pop()
            key = (id(node), at)
            if seen.get(key, most + 1) <= cost:
                continue
            seen[key] = cost
            if at == len(word):
                if "" in node and (spelled not in best or best[spelled][0] > cost):
                    best[spelled] = (cost, node[""])
            else:
                char = word[at]
                if char in node:
                    stack.append((node[char], spelled + char, at + 1, cost))
                for read, meant, *own in swaps.get(char, ()):
                    after = cost + (own[0] if own else 1)
                    if after <= most and word.startswith(read, at):
                        down = node
                        for c in meant:
                            down = down.get(c)
                            if down is None:
                                break
                        if down is not None:
                            stack.append((down, spelled + meant, at + len(read), after))
            if edits and cost + edits <= most:
                if at < len(word):
                    stack.append((node, spelled, at + 1, cost + edits))
                for c, down in node.items():
                    if c:
                        stack.append((down, spelled + c, at, cost + edits))
                        if at < len(word) and c != word[at]:
                            stack.append((down, spelled + c, at + 1, cost + edits))
        return [(w, cost, n) for w, (cost, n) in best.items()]

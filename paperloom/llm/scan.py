"""Problem 1: noise in text that came from scanned pages.

Page furniture is found as numbered series of lines and the headings beside them, words
that a hyphen splits over two lines are put together where the vocabulary knows the whole,
and misread words are looked up by intersecting the token's Levenshtein automaton, in which
the confusions of scanning are cheaper than other edits, with a trie of the vocabulary. Of
several words the one that the neighbouring words speak for stands.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.vocabulary import _WORD, Trie, vocabulary

KINDS = ("hyphen_break", "misread", "page_furniture")

#: What scanning reads -> what was printed.
CONFUSIONS = [
    ("@", "a"), ("+", "t"), ("!", "i"), ("!", "l"), ("0", "o"), ("0", "O"), ("|", "l"), ("|", "I"), ("$", "s"), ("$", "S"), ("1", "l"), ("1", "i"), ("1", "I"),
    ("9", "g"), ("5", "s"), ("5", "S"), ("8", "B"), ("6", "b"), ("6", "G"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("VV", "W"), ("c", "e"), ("l", "I"), ("I", "l"), ("€", "e"), ("£", "E"), ("(", "c"), ("¢", "c"),
]
#: Letters of like shape, which a scan may take for each other one by one, as a typing slip may too.
ALIKE = [("o", "c"), ("c", "o"), ("u", "n"), ("n", "u"), ("l", "t"), ("t", "l"), ("l", "i"), ("i", "l"), ("i", "r"), ("r", "i"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"), ("e", "o"), ("o", "e")]
#: Costs of a confusion, of a letter for one of like shape and of any other edit, and the most of a word: three
#: confusions, two letters of like shape, or one edit beside a confusion. An edit alone is a slip and no misreading.
CONFUSED, SHAPED, EDITED, MOST_COST = 20, 30, 41, 61
_SWAPS: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
for _read, _meant in CONFUSIONS:
    _SWAPS[_read[0]].append((_read, _meant, CONFUSED))
_SHAPES: dict[str, list[tuple[str, str, int]]] = defaultdict(list, {k: list(v) for k, v in _SWAPS.items()})
for _read, _meant in ALIKE:
    _SHAPES[_read].append((_read, _meant, SHAPED))
#: Confusions with signs and digits, which typing slips do not make, and with letters, which they may.
_SIGN = re.compile(r"[@+!|$0-9€£¢]")
_PAIRS = re.compile(r"rn|cl|ii|li|vv|VV")
#: How much commoner the printed word must be than the token.
RATIO = 25.0

_PAGE = r"(?:p[a@][g9][ec]|s[ec][i!l1|][t+][ec]|p[aá@][g9][i!l1|]n[a@]|b[l1|][a@][t+]{1,2}|strona|sida)"
_OF = r"(?:[o0]f|v[o0]n|de|di|sur|z|av|/)"
_NUMBERED = (
    ("word of", re.compile(rf"{_PAGE}\s*(\d{{1,4}})\s*{_OF}\s*(\d{{1,4}})", re.I), True),
    ("word", re.compile(rf"{_PAGE}\s*(\d{{1,4}})", re.I), False),
    ("short of", re.compile(r"(?:p|s|pg|pag|str)\.\s*(\d{1,4})\s*(?:/|of|von|de)\s*(\d{1,4})", re.I), True),
    ("short", re.compile(r"(?:p|s|pg|pag|str)\.\s*(\d{1,4})", re.I), False),
    ("square", re.compile(r"\[\s*(\d{1,3})\s*\]"), False),
    ("dashes", re.compile(r"[-–—~]\s*(\d{1,3})\s*[-–—~]"), False),
    ("of", re.compile(r"(\d{1,3})\s*(?:/|\||of|von)\s*(\d{1,3})", re.I), False),
    ("bare", re.compile(r"(\d{1,3})"), False),
)
_HEADING_GAP = 8
_BULLET = re.compile(r"\s*(?:[-*•▪·◦‣●■–]|\d{1,2}[.)])\s")
_PLAIN = str.maketrans({"@": "a", "+": "t", "!": "i", "0": "o", "|": "l", "$": "s", "1": "l", "9": "g", "5": "s", "8": "b", "c": "e", "C": "e", "I": "l", "i": "l"})
def _alike(line: str) -> str:
    """A line with confusable characters made equal."""
    line = line.strip().replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("li", "h").replace("vv", "w").replace("VV", "W")
    return re.sub(r"\s+", " ", line.translate(_PLAIN).lower())


_HEADING = re.compile(
    "|".join(
        rf"(?:{form})"
        for form in (
            rf"(?:.{{3,40}} [-–|] )?(?:{_alike('curriculum vitae')}|{_alike('resume')}|{_alike('résumé')}|{_alike('lebenslauf')})(?: [-–|] .{{3,40}})?",
            rf"{_alike('c')} ?v[ :.\-–].{{3,40}}",
            rf"{_alike('confidential')}(?: [-–|] .{{3,40}})?",
            rf"{_alike('application')} (?:{_alike('file')}|{_alike('no')}\.?|{_alike('ref')}\.?) .{{2,20}}",
        )
    )
)
_SPLIT = re.compile(r"([^\W\d_]{2,}|[^\W_]*[@+!|$0-9€£¢][^\W_]*)-[ \t\r]*$")
_NEXT = re.compile(r"[ \t]*([^\W\d_]+)")
_TOKEN = re.compile(r"[^\s,;:()/\-–—\"“”„«»'’.?*•▪]+")


def furniture(lines: list[str]) -> set[int]:
    """Numbers of the lines that are page numbers, running headings or footings.

    Page numbers are lines of one form whose numbers rise by one; a form that names the
    number of pages counts alone. Headings are lines that come again beside page numbers
    or page feeds.
    """
    forms: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    feeds = set()
    for i, line in enumerate(lines):
        if "\f" in line:
            feeds.add(i)
        short = line.strip(" \t\r\f\v")
        if not short or len(short) > 24 or not any(c.isdigit() for c in short):
            continue
        for name, pattern, _ in _NUMBERED:
            m = pattern.fullmatch(short)
            if m:
                total = int(m.group(2)) if pattern.groups > 1 and m.group(2) else 0
                forms[name].append((i, int(m.group(1)), total))
                break
    numbers: set[int] = set()
    for name, _, alone in _NUMBERED:
        found = forms.get(name, [])
        if not found:
            continue
        best: list[int] = []
        for start in range(len(found)):
            chain, number = [found[start][0]], found[start][1]
            for i, n, _ in found[start + 1 :]:
                if n == number + 1 and i > chain[-1] + 2:
                    chain.append(i)
                    number = n
            if len(chain) > len(best) and (name != "bare" and name != "of" or found[start][1] <= 2):
                best = chain
        if len(best) >= 2 or alone and any(0 < n <= total for _, n, total in found):
            numbers.update(best)
        # a number of so many pages beside a page feed stands for itself
        numbers.update(i for i, n, total in found if 0 < n <= total and feeds & {i - 1, i, i + 1})
    out = set(numbers)
    around: Counter[str] = Counter()
    places: dict[str, list[int]] = defaultdict(list)
    for i in sorted(numbers | feeds):
        for step in (1, -1):
            j = i + step if "\f" not in lines[i] or not lines[i].strip() or step < 0 else i
            while 0 <= j < len(lines) and (not lines[j].strip() or j in numbers) and abs(j - i) < 4:
                j += step
            if 0 <= j < len(lines) and j not in numbers and 0 < len(lines[j].strip()) <= 70 and not _BULLET.match(lines[j]):
                key = _alike(lines[j])
                if j not in places[key]:
                    places[key].append(j)
                    around[key] += 1
    pages = max(len(numbers), len(feeds))
    for key, n in around.items():
        if n >= 2 and n >= pages / 2 and len(key) > 9:
            out.update(places[key])
            # the first page's heading has no number before it
            out.update(i for i, line in enumerate(lines) if i not in out and len(line.strip()) <= 70 and i >= _HEADING_GAP and _alike(line) == key)
    # headings may run without numbers: by their wording, or as lines that come at even distances
    again: dict[str, list[int]] = defaultdict(list)
    for i, line in enumerate(lines):
        if i >= _HEADING_GAP and i not in out and 5 <= len(line.strip()) <= 70 and not _BULLET.match(line):
            again[_alike(line)].append(i)
    for key, at in again.items():
        gaps = [b - a for a, b in zip(at, at[1:])]
        if _HEADING.fullmatch(key) or len(at) >= 3 and min(gaps) >= 12 and max(gaps) <= 1.4 * min(gaps) and not lines[at[0]].rstrip().endswith((",", "/")):
            out.update(at)
    return out


class Reader:
    """Finds and repairs the noise of one text, given the vocabulary of the corpus.

    ``wrong`` are the words of the vocabulary that are misread forms themselves. They are
    worked out where they are not given; this takes a look-up of each word.
    """

    def __init__(self, words: dict[str, int], texts: int, wrong: frozenset[str] | None = None, pairs: dict[str, int] | None = None):
        self.counts = words
        self.least = max(3, texts / 2000)
        self.pairs = pairs or {}
        #: counts whatever the case: a name may well be a common word, and a misread form stands at the head of a line too
        self.folded: Counter[str] = Counter()
        for w, n in words.items():
            self.folded[w.lower()] += n
        self.store: dict[str, list[tuple[str, int, int]]] = {}
        if wrong is None:
            self._fill(words)
            wrong = frozenset(w for w in words if self._accepted(w, self._confused(w)))
            self.store.clear()
        self.wrong = wrong
        self.right = words.keys() - wrong
        self._fill({w: n for w, n in words.items() if w not in wrong})

    def _fill(self, words: dict[str, int]) -> None:
        self.words = {w: n for w, n in words.items() if w.isalpha() and len(w) >= 3}
        self.lower = {w.lower() for w in self.words}
        self.trie = Trie(self.words)

    def meant(self, token: str) -> list[tuple[str, int, int]]:
        """Words of the vocabulary that scanning could have turned into the token, with costs and counts."""
        found = self.store.get(token)
        if found is None:
            if len(self.store) > 300_000:
                self.store.clear()
            found = self.store[token] = self._meant(token)
        return found

    def _readable(self, token: str) -> bool:
        letters = sum(c.isalpha() for c in token)
        return 4 <= len(token) <= 40 and letters >= 3 and letters >= 0.5 * len(token)

    def _confused(self, token: str) -> list[tuple[str, int, int]]:
        """Words that confusions alone turn into the token; the case of the first letter may be a heading's."""
        if not self._readable(token):
            return []
        found = self.trie.within(token, MOST_COST, _SWAPS, edits=0)
        if not found and token[0].isupper() and not token.isupper():
            small = token[0].lower() + token[1:]
            found = [(w[0].upper() + w[1:], c, n) for w, c, n in self.trie.within(small, MOST_COST, _SWAPS, edits=0)]
        if not found and token[0].islower():
            found = [(w[0].lower() + w[1:], c, n) for w, c, n in self.trie.within(token[0].upper() + token[1:], MOST_COST, _SWAPS, edits=0) if w[1:].islower()]
        return found

    def _accepted(self, token: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Those of the words that are so much commoner than the token that it is no word of its own."""
        found = [x for x in found if x[0].lower() != token.lower()]
        count = self.folded.get(token.lower(), 0)
        if count:  # the vocabulary has the token: a word of its own, or a misreading that is frequent
            return [(w, c, n) for w, c, n in found if self.folded[w.lower()] >= RATIO * count]
        return [(w, c, n) for w, c, n in found if n >= RATIO / 3]

    def _meant(self, token: str) -> list[tuple[str, int, int]]:
        found = self._accepted(token, self._confused(token))
        if found or token.lower() in self.folded or not self._readable(token) or len(token) < 6:
            return found
        if token.islower() and token.isalpha():
            found = [x for x in self.trie.within(token, MOST_COST, _SHAPES, edits=0) if x[2] >= RATIO]
        if not found and (_SIGN.search(token) or _PAIRS.search(token)):
            found = [x for x in self.trie.within(token, MOST_COST, _SWAPS, edits=EDITED) if x[1] > EDITED and x[2] >= RATIO]
        return self._accepted(token, found)

    def _likeliest(self, found: list[tuple[str, int, int]], before: str, after: str, own: set[str]) -> str:
        """The word that its frequency, this text and the neighbours speak for most, and the edits least."""

        def points(x: tuple[str, int, int]) -> float:
            word, cost, n = x
            low = word.lower()
            beside = self.pairs.get(f"{before.lower()} {low}", 0) + self.pairs.get(f"{low} {after.lower()}", 0)
            return math.log(n + 1) + 2 * math.log(beside + 1) + 2 * (word in own) - 3 * cost / CONFUSED

        return max(found, key=lambda x: (points(x), x[0]))[0]

    def misread(self, text: str) -> list[tuple[int, int, str, float]]:
        """(from, to, word, witness) of misread tokens.

        A sign, digit or pair of letters that no typing slip gives is a witness of 1 by itself, a
        confusion of letters of 0.5, and a letter of like shape of 0.35.
        """
        out = []
        right, own = self.right, None
        for m in _TOKEN.finditer(text):
            token = m.group()
            if token in right or len(token) < 4 or token.isdigit():
                continue
            begin, end = m.span()
            if "@" in token and (text[end : end + 1] == "." or begin and text[begin - 1] in "._-+<" or end < len(text) and text[end] in "-" and "@" in token[-4:]):
                continue  # a mail address
            stripped = token.rstrip("!+$|")
            if stripped != token and (stripped in right or stripped.lower() in self.lower):
                continue
            if stripped in self.wrong:
                token, end = stripped, begin + len(stripped)
            found = self.meant(token)
            if not found:
                continue
            if own is None:
                own = set(_TOKEN.findall(text))
            word = found[0][0]
            if len(found) > 1:
                before, after = _TOKEN.findall(text[max(0, begin - 60) : begin])[-1:], _TOKEN.search(text, end)
                word = self._likeliest(found, before[0] if before else "", after.group() if after else "", own)
            cost = next(c for w, c, _ in found if w == word)
            sure = bool(_SIGN.search(token)) or len(token) >= 5 and len(token) > len(word) and bool(_PAIRS.search(token))
            out.append((begin, end, word, 1.0 if sure else 0.5 if cost % CONFUSED == 0 else 0.35))
        return out

    def known(self, word: str) -> bool:
        return word in self.counts or word.lower() in self.lower or bool(self._accepted(word, self._confused(word)))

    def breaks(self, lines: list[str]) -> list[int]:
        """Numbers of the lines that end in the first part of a word."""
        out = []
        for i in range(len(lines) - 1):
            m = _SPLIT.search(lines[i])
            if not m:
                continue
            n = _NEXT.match(lines[i + 1])
            if not n or not n.group(1)[0].islower():
                continue
            first, second = m.group(1), n.group(1)
            whole = first + second
            before = lines[i][: m.start()]
            if before.endswith("-") or self.known(whole):
                if self.known(whole):
                    out.append(i)
            elif not (self.known(first) and self.known(second)):
                out.append(i)  # neither a word of ours nor a compound of two
        return out

    def examine(self, text: str | None) -> tuple[list[str], str | None]:
        """The kinds of noise in a text, and the text as continuous paragraphs."""
        if not text or not text.strip():
            return [], text
        kinds = []
        lines = text.split("\n")
        extra = furniture(lines)
        # page feeds go too, alone on a line or in front of one
        kept = [line.strip("\f") for i, line in enumerate(lines) if i not in extra and (line.strip() or "\f" not in line)]
        if extra:
            kinds.append("page_furniture")
        split = self.breaks(kept) if "-" in text else []
        if split:
            kinds.append("hyphen_break")
        for i in reversed(split):
            rest = kept[i + 1].lstrip()
            word, _, tail = rest.partition(" ")
            kept[i] = kept[i].rstrip().removesuffix("-") + word
            kept[i + 1] = tail
        joined = "\n".join(kept)
        wrong = self.misread(joined)
        if sum(x for *_, x in wrong) >= 1:
            kinds.append("misread")
            pieces, at = [], 0
            for begin, end, word, _ in wrong:
                pieces += [joined[at:begin], word]
                at = end
            joined = "".join(pieces) + joined[at:]
        if kinds:
            joined = reflow(joined)
        return kinds, joined


def reflow(text: str) -> str:
    """Lines that a page's width broke are put together; headings, items and blanks stay."""
    lines = text.split("\n")
    width = max((len(x.rstrip()) for x in lines), default=0)
    out: list[str] = []
    for line in lines:
        bare = line.strip()
        if out and bare and out[-1].strip() and not _BULLET.match(line) and bare[0].islower() and len(out[-1].rstrip()) + len(bare.split()[0]) >= 0.7 * width:
            out[-1] = f"{out[-1].rstrip()} {bare}"
        else:
            out.append(line.rstrip("\r"))
    return "\n".join(out)


def rivals(reader: Reader) -> frozenset[str]:
    """Words of which a misread form could as well be another word's: the ones that only neighbours can tell apart."""
    out: set[str] = set()
    for word in reader.words:
        for read, meant in CONFUSIONS:
            at = word.find(meant)
            if at >= 0:
                form = word[:at] + read + word[at + len(meant) :]
                found = {w.lower() for w, _, _ in reader._accepted(form, reader._confused(form))}
                if len(found) > 1:
                    out |= found
    return frozenset(out)


def beside(words: frozenset[str]) -> Callable[[str], set[str]]:
    """Counts of the pairs that these words form with the words before and after them: what of a text is counted."""

    def pairs(text: str) -> set[str]:
        own = _WORD.findall(text.lower())
        return {f"{a} {b}" for a, b in zip(own, own[1:]) if a in words or b in words}

    return pairs


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, kinds, clean_text) of each text.

    ``kinds`` lists the kinds of scanning noise in it, and ``clean_text`` is the text
    without them, as continuous paragraphs; a text without noise comes out as it is, a null
    text as null with no kinds. One row in gives one row out. The vocabulary covers all
    texts; it is broadcast, and its size is bounded (see vocabulary.SHARE), as is that of
    the pairs of words that are counted for the words that only neighbours can tell apart.
    Its misread forms are worked out once, before it is sent.
    """
    words, texts = vocabulary(df, text_col)
    reader = Reader(words, texts)
    alike = rivals(reader)
    pairs = vocabulary(df, text_col, beside(alike))[0] if alike else {}
    sent = df.sparkSession.sparkContext.broadcast((words, texts, reader.wrong, pairs))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sent.value)
        for batch in batches:
            found = [reader.examine(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in found], pa.list_(pa.string())), pa.array([t for _, t in found], pa.string())], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def find_noise(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, kind), one row for each kind of noise in a text."""
    return clean(df, id_col, text_col).select(id_col, F.explode("kinds").alias("kind")).distinct()

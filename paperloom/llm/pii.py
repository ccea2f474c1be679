"""Problem 7: personal data inside free text.

A character-level bidirectional LSTM gives every character scores of the labels, and a CRF
with learnt transitions decodes them. Both run in numpy over many windows at a time, and
over every line of every text: nothing chooses beforehand what the network sees.
Windows overlap: each character takes its scores from the window in which it lies farthest
from an edge, and one Viterbi pass then decodes the whole stretch, so that windows are
reconciled globally. A format check follows. The model is trained by ``pii_train``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "identity_number", "address", "name")
#: Label 0 is outside; each kind has a label for its first character and one for the rest.
LABELS = 1 + 2 * len(KINDS)
MODEL = Path(__file__).with_name("pii_model.npz")
WINDOW, OVERLAP = 128, 32
#: Prefixes run together, and stretches, and characters, padding included, decoded together besides those of one stretch.
WIDTH, BATCH, ROOM = 1024, 384, 400_000
#: Characters of stretches labelled together, besides those of one stretch.
GROUP = 2_500_000
#: Characters of stretches that are looked through for items together, besides those of one stretch.
BLOCK = 100_000
#: Bytes of the texts of rows that are looked at together, besides those of one row.
PART = 4_000_000
#: Different stretches whose spans a worker keeps.
STORE = 200_000

_VOCABULARY = 101


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Character ids by code point: ASCII as it is, accented and styled letters as their plain form."""
    table = np.full(0x20000, 3, dtype=np.uint8)
    for c in range(0x20000):
        if 0xD800 <= c <= 0xDFFF or 0x3400 <= c <= 0xABFF or 0xAC00 <= c <= 0xD7A3:
            continue
        if 32 <= c < 127:
            table[c] = c - 26
            continue
        char = chr(c)
        base = unicodedata.normalize("NFKD", char)[0]
        kind = unicodedata.category(char)
        if 32 <= ord(base) < 127:
            table[c] = ord(base) - 26
        elif kind in ("Mn", "Cf", "Me"):
            table[c] = 5
        elif kind == "Zs" or char in "\t\r\f\v":
            table[c] = 32 - 26
        elif kind[0] == "L":
            table[c] = 2 if char.isupper() else 1
    table[10] = 4
    for char, plain in zip("ØøŁłßæÆđıАВЕКМНОРСТУХаеорсухіѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοιρυν", "OoLlsaAdiABEKMHOPCTYXaeopcyxisABEZHIKMNOPTYXaoipuv"):
        table[ord(char)] = ord(plain) - 26
    return table


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _table()[np.minimum(points, 0x1FFFF)]


#: Added to a float32 below 2 ** 16 in size it leaves the nearest whole number, and ``HALF``, in the low bits.
HALF = 1 << 16
_MAGIC = np.float32((1 << 23) + HALF)
_LOW = np.int32(4 * HALF - 1)
#: Steps of a table for 1 of a cell, and the cell from which on its tanh is 1 (less by 2e-7).
CELL, FULL = 2048, 8
_MIDDLE = np.float32(FULL * CELL + 0.5)
#: Arrow's lookup, without a check of places, which cannot be outside.
_TAKE, _TRUSTED = pc.get_function("array_take"), pc.TakeOptions(boundscheck=False)


def _tree(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray | None]]]:
    """The prefixes that rows of ids (0 after their end) have, each once.

    Gives the number of each row's prefix of each length [rows, steps], in which shorter prefixes come
    first, and for each step the last ids of its prefixes and the places of what they go on from in the step before.
    """
    count, steps = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{steps}").ravel(), kind="stable")
    rows, lengths = rows[order], lengths[order]
    shared = np.zeros(count, dtype=np.int64)
    if count > 1:
        same = rows[1:] == rows[:-1]
        shared[1:] = np.where(same.all(axis=1), steps, same.argmin(axis=1))
    at = np.arange(steps)[:, None]
    fresh = (at >= shared) & (at < lengths)
    place = np.cumsum(fresh, axis=1, dtype=np.int32) - 1
    levels: list[tuple[np.ndarray, np.ndarray | None]] = []
    for t in range(steps):
        own = np.flatnonzero(fresh[t])
        levels.append((rows[own, t].astype(np.intp), place[t - 1, own].astype(np.intp) if t else None))
    place += np.cumsum([0] + [len(ids) for ids, _ in levels[:-1]], dtype=np.int32)[:, None]
    numbers = np.empty((count, steps), dtype=np.int32)
    numbers[order] = place.T
    return numbers, levels


class Tagger:
    """The network, for inference.

    The state after a character depends on the characters of its window up to it alone, so
    that windows with the same beginning (end, for the other direction) share its states,
    which are computed once. Sigmoid and tanh are read from tables, whose steps
    are as fine as the weights are (half precision).
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}
        self.size = n = w["fw_h"].shape[0]
        self.sides = []
        steps = np.arange(-HALF, HALF)
        for side in ("fw", "bw"):
            # what a character adds to the gates (input, forget, output, candidate) depends on the character alone
            table, recurrent = w["emb"] @ w[f"{side}_x"] + w[f"{side}_b"], w[f"{side}_h"]
            # hidden states are below 1 in size, so that no gate is beyond this
            most = np.abs(table).max(axis=0) + np.abs(recurrent).sum(axis=0)
            unit, last = [min(4096.0, (HALF - 2) / max(1e-6, float(part.max()))) for part in (most[: 3 * n], most[3 * n :])]
            each = np.array([unit] * 3 * n + [last] * n, dtype=np.float32)
            # the candidate's table comes after that of the others; it has steps of the cell
            gates = np.concatenate([1 / (1 + np.exp(-steps / unit)), np.tanh(steps / last) * CELL]).astype(np.float32)
            shift = np.array([0] * 3 * n + [2 * HALF] * n, dtype=np.float32)
            self.sides.append((table * each + (_MAGIC + shift), recurrent * each, pa.array(gates)))
        self.cell = pa.array(np.tanh(np.arange(-FULL * CELL, FULL * CELL + 1) / CELL).astype(np.float32))
        self.out, self.out_b = np.ascontiguousarray(w["out"].T), w["out_b"]
        self.start = w["start"]
        self.free = np.array([0, *range(1, LABELS, 2)])
        # the rest of an item follows its beginning or itself; outside and beginnings may follow anything
        self.trans = w["trans"].copy()
        for rest in range(2, LABELS, 2):
            self.trans[[k for k in range(LABELS) if k not in (rest - 1, rest)], rest] = -np.inf
        self.after = np.ascontiguousarray(self.trans.T)
        self.into = np.ascontiguousarray(self.trans[:, self.free])[:, :, None]
        self.begun = self.trans[np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)][:, None]
        self.kept = self.trans[np.arange(2, LABELS, 2), np.arange(2, LABELS, 2)][:, None]
        # ways are weighed so that going back outside never gains on staying there; what each label gains at most by any way into it
        weight = np.concatenate([[0.0], self.trans[0, 0] - self.trans[1:, 0]])
        into = self.trans + weight[:, None]
        self.gain = into.max(axis=0) - weight - self.trans[0, 0]
        self.gain_rest = np.array([into[[k - 1, k], k].max() for k in range(2, LABELS, 2)]) - weight[2::2] - self.trans[0, 0]
        self.gain_first = self.start - self.start[0] - weight
        # what an item that reaches the end of its stretch is spared
        self.spared = np.maximum(0.0, np.maximum(weight[1::2], weight[2::2]))

    def _run(self, side: int, levels: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
        """One direction over the levels of a tree; what its states add to the scores of the labels [LABELS, nodes]."""
        n = self.size
        table, recurrent, gates = self.sides[side]
        weights = self.out[:, side * n : (side + 1) * n]
        scores = np.empty((LABELS, sum(len(ids) for ids, _ in levels)), dtype=np.float32)
        most = max(len(ids) for ids, _ in levels)
        # hidden and cell states of this level and the one before
        states = np.empty((2, 2, most, n), dtype=np.float32)
        steps, before, added = np.empty((WIDTH, 4 * n), dtype=np.float32), np.empty((WIDTH, n), dtype=np.float32), np.empty((WIDTH, 4 * n), dtype=np.float32)
        # what is added is over when the places in the tables are taken, so these share its room
        bits, whole = steps.view(np.int32).reshape(WIDTH, 4, n).transpose(1, 0, 2), added.reshape(-1).view(np.int32)
        places = pa.Array.from_buffers(pa.uint32(), WIDTH * 4 * n, [None, pa.py_buffer(added)])

        def read(values: pa.Array, *shape: int) -> np.ndarray:
            size = math.prod(shape)
            return np.frombuffer(_TAKE.call([values, places[:size]], _TRUSTED).buffers()[1], dtype=np.float32, count=size).reshape(shape)

        at = 0
        for t, (ids, parents) in enumerate(levels):
            (h, c), (old_h, old_c) = states[t % 2], states[1 - t % 2]
            for a in range(0, len(ids), WIDTH):
                own = ids[a : a + WIDTH]
                k = len(own)
                new_c, step, up = c[a : a + k], steps[:k], before[:k]
                table.take(own, 0, step, "clip")
                if t:
                    above = parents[a : a + k]
                    step += np.matmul(old_h.take(above, 0, up, "clip"), recurrent, out=added[:k])
                np.bitwise_and(bits[:, :k], _LOW, out=whole[: 4 * k * n].reshape(4, k, n))
                g = read(gates, 4, k, n)
                np.multiply(g[0], g[3], out=new_c)
                if t:
                    old_c.take(above, 0, up, "clip")
                    up *= g[1]
                    new_c += up
                whole[: k * n].reshape(k, n)[...] = np.add(np.clip(new_c, -FULL * CELL, FULL * CELL, out=up), _MIDDLE, out=up)
                np.multiply(read(self.cell, k, n), g[2], out=h[a : a + k])
            np.matmul(weights, h[: len(ids)].T, out=scores[:, at : at + len(ids)])
            at += len(ids)
        return scores

    def scores(self, ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What either direction adds to the scores of the labels of windows of ids [LABELS, prefixes], and the prefixes' numbers [windows, steps]."""
        steps = np.arange(int(lengths.max()))
        inside = steps < lengths[:, None]
        ahead = np.where(inside, ids[np.minimum(begins[:, None] + steps, len(ids) - 1)], 0).astype(np.uint8)
        behind = np.where(inside, ids[np.maximum(begins[:, None] + lengths[:, None] - 1 - steps, 0)], 0).astype(np.uint8)
        parts = []
        numbers = []
        for side, rows in enumerate((ahead, behind)):
            number, levels = _tree(rows, lengths)
            parts.append(self._run(side, levels))
            numbers.append(number)
        return parts, numbers

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequence of each stretch, given its scores [length, LABELS]."""
        lengths = np.array([len(x) for x in scores], dtype=np.int64)
        flat = np.concatenate([np.zeros((0, LABELS), dtype=np.float32), *scores]).T
        return self._decode(np.ascontiguousarray(flat), np.cumsum(lengths) - lengths, lengths)

    def held(self, scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the best labels of a stretch may hold an item.

        If they do, one of its items, taken out, would not better them: what its characters gain on
        being outside, with the most that ways give, is no loss. Where no run of characters has such a gain, no item is.
        """
        if len(lengths) > 1 and lengths.sum() > BLOCK:
            # some stretches at a time
            ends = np.cumsum(lengths)
            cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), [len(lengths)]]))
            cuts = cuts if len(cuts) > 2 else np.array([0, len(lengths) // 2, len(lengths)])
            return np.concatenate([self.held(scores[:, begins[a] : begins[b - 1] + lengths[b - 1]], begins[a:b] - begins[a], lengths[a:b]) for a, b in zip(cuts, cuts[1:])])
        total = scores.shape[1]
        found = np.zeros(len(lengths), dtype=bool)
        some = np.flatnonzero(lengths)
        if not len(some):
            return found
        first, last = begins[some], begins[some] + lengths[some] - 1
        most = np.full(total, -np.inf, dtype=np.float32)
        for kind in range(len(KINDS)):
            begin, on = 1 + 2 * kind, 2 + 2 * kind
            opening = scores[begin] - scores[0]
            going = scores[on] - scores[0]
            opened = np.maximum(scores[begin, first] + self.gain_first[begin], scores[on, first] + self.gain_first[on]) - scores[0, first]
            opening += np.float32(self.gain[begin])
            opening[first] = opened
            # the rest of an item never reaches into the next stretch
            run = (going + np.float32(self.gain_rest[kind])).astype(np.float64)
            run[first] = -1e4
            np.cumsum(run, out=run)
            ahead = run.copy()
            ahead[last] += self.spared[kind]
            ahead = np.maximum.accumulate(ahead[::-1])[::-1]
            ahead -= run
            opening += ahead
            np.maximum(most, opening, out=most)
        found[some] = np.maximum.reduceat(most, first) > -1e-2
        return found

    def _decode(self, scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Viterbi over many stretches at a time; begins and lengths: where they are in the scores [LABELS, characters]."""
        found = [np.zeros(n, dtype=np.uint8) for n in lengths.tolist()]
        rest = np.flatnonzero(self.held(scores, begins, lengths))
        order = rest[np.argsort(-lengths[rest], kind="stable")]
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, min(BATCH, ROOM // int(lengths[order[at]])))]
            at += len(rows)
            own, from_ = lengths[rows], begins[rows]
            steps, width = int(own[0]), len(rows)
            # scores, to which those of the best ways up to each character are added
            best = np.empty((steps, LABELS, width), dtype=np.float32)
            alive = np.searchsorted(-own, -np.arange(steps), side="left").tolist()  # sequences longer than t
            for t in range(steps):
                k = alive[t]
                then = best[t, :, :k]
                then[...] = scores[:, from_[:k] + t]
                if not t:
                    then += self.start[:, None]
                    continue
                now = best[t - 1, :, :k]
                ways = np.maximum.reduce(now[:, None, :] + self.into, axis=0)
                then[0] += ways[0]
                then[1::2] += ways[1:]
                then[2::2] += np.maximum(now[1::2] + self.begun, now[2::2] + self.kept)
            labels = np.zeros((steps, width), dtype=np.uint8)
            for t in range(steps - 1, -1, -1):
                k, old = alive[t], alive[t + 1] if t + 1 < steps else 0
                if old:
                    labels[t, :old] = (best[t, :, :old].T + self.after[labels[t + 1, :old]]).argmax(axis=1)
                if k > old:
                    labels[t, old:k] = best[t, :, old:k].argmax(axis=0)
            for j, k in enumerate(rows.tolist()):
                found[k] = labels[: own[j], j].copy()
        return found

    def label(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Labels of the characters of whole stretches of any length, some of them at a time."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            yield from self._label(texts[at:end])
            at = end

    def _label(self, texts: list[str]) -> list[np.ndarray]:
        ids = char_ids("".join(texts))
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        # windows of each stretch: the last is the first that reaches its end
        counts = np.maximum(0, lengths - OVERLAP - 1) // (WINDOW - OVERLAP) + 1
        counts[lengths == 0] = 0
        owner = np.repeat(np.arange(len(texts)), counts)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        offset = turn * (WINDOW - OVERLAP)
        size = np.minimum(WINDOW, lengths[owner] - offset)
        # of what two windows cover the former keeps the first half
        skip = np.where(turn == 0, 0, OVERLAP // 2)
        keep = np.where(turn == counts[owner] - 1, size, WINDOW - OVERLAP // 2) - skip
        merged = np.empty((LABELS, len(ids)), dtype=np.float32)
        to = 0
        for a in range(0, len(owner), GROUP // 64):
            some = slice(a, a + GROUP // 64)
            (ahead, behind), (first, last) = self.scores(ids, begins[owner[some]] + offset[some], size[some])
            begin, end, own = skip[some, None], (skip + keep)[some, None], size[some, None]
            total = int(keep[some].sum())
            steps = np.arange(first.shape[1])
            one = first[(steps >= begin) & (steps < end)].astype(np.intp)
            # turned round, the last step is that of the window's first character
            back = steps - (len(steps) - own)
            two = last[:, ::-1][(back >= begin) & (back < end)].astype(np.intp)
            for label in range(LABELS):
                part = np.take(ahead[label], one, out=merged[label, to : to + total], mode="clip")
                part += np.take(behind[label], two, mode="clip")
                part += self.out_b[label]
            to += total
        return self._decode(merged, begins, lengths)


#: Where no item goes on: at blank lines, and before lines that begin with a bullet.
_CUT = re.compile(r"\n(?:[^\S\n]*(?:\n|\Z))+|\n(?=[^\S\n]*[-*\u2022\u2023\u25aa\u25cf\u25e6\u2043\u00b7\u2013\u2014\ufffd][^\S\n])")


def stretches(text: str) -> list[tuple[int, int, int]]:
    """(from, to, line number) of the runs of lines that are read on their own.

    Every line that is not blank is in one of them.
    """
    out = []
    at = line = 0
    for begin, end in [m.span() for m in _CUT.finditer(text)] + [(len(text), len(text))]:
        if text[at:begin].strip():
            out.append((at, begin, line))
        line += text.count("\n", at, end)
        at = end
    return out


_MAIL = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)


#: Written forms that one kind alone has.
_IDENTITY_FORM = re.compile(r"QQ\s?\d\d\s?\d\d\s?\d\d\s?[A-Z]|X\d{8}|\d{3}\.\d{3}\.\d{3}-\d\d|9\d\d[-\s]\d\d[-\s]\d{4}")
#: What stands before a number that tells a person's identity, whatever its form.
_IDENTITY_NAME = re.compile(
    r"(?:\b(?:ssn|social security|passport|national (?:id|identity|insurance)|identity(?: card| document)?|id card|tax(?:payer)? (?:id|identification)|tin|iban|nin|cpf|pesel|ausweis|reisepass|steuer-?id|dni|nie)\b)"
    r"\W{0,3}(?:(?:no|number|nr|num|code)\b)?\W{0,4}\Z",
    re.I,
)
_WORDS = re.compile(r"[^\W\d_]+")


def settled(kind: str, text: str, before: str = "") -> str | None:
    """The kind of a decoded stretch after a check of its form and of what stands before it; None if it has no form of it."""
    digits = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    if kind in ("phone", "identity_number") and (_IDENTITY_FORM.fullmatch(text) or 6 <= digits and _IDENTITY_NAME.search(before)):
        return "identity_number"
    if kind == "email":
        fits = bool(_MAIL.search(text)) and bool(_DOT.search(text)) and letters >= 5
    elif kind == "phone":
        fits = 7 <= digits <= 17
    elif kind == "identity_number":
        fits = 6 <= digits <= 14
    elif kind == "address":
        fits = digits >= 1 and letters >= 3 and (text.count(" ") >= 1 or len(text) > 8)
    else:
        # styled and look-alike letters count as the plain ones they stand for
        words = _WORDS.findall("".join(chr(i + 26) if i > 5 else "x" if i in (1, 2) else " " for i in char_ids(text).tolist() if i != 5))
        fits = letters >= 4 and digits <= 2 and len(words) >= 2 and any(c.isupper() for c in text) and any(len(w) > 1 for w in words)
    return kind if fits else None


def spans_of(labels: np.ndarray, text: str) -> list[tuple[int, int, str]]:
    """(from, to, kind) of the labelled stretches that have the form of their kind."""
    if not labels.any():
        return []
    out = []
    # an item goes on where the label is the rest of the kind before it
    on = np.zeros(len(labels) + 1, dtype=bool)
    on[1:-1] = (labels[1:] > 0) & (labels[1:] % 2 == 0) & ((labels[:-1] == labels[1:]) | (labels[:-1] + 1 == labels[1:]))
    edges = np.flatnonzero(~on).tolist()
    for at, end in zip(edges, edges[1:]):
        if label := int(labels[at]):
            kind = (label - 1) // 2
            a, b = at, end
            while a < b and (text[a].isspace() or text[a] in ",;|/<("):
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ",;|/>:"):
                b -= 1
            name = settled(KINDS[kind], text[a:b], text[max(0, a - 40) : a]) if b > a else None
            if name:
                out.append((a, b, name))
    return out


class Finder:
    """Finds the personal data of many texts."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.tagger = Tagger(weights)
        self.store: dict[str, list[tuple[int, int, str]]] = {}

    def find(self, texts: list[str | None], single: bool = False) -> list[list[tuple[int, int, str, int]]]:
        """(from, to, kind, line) of the items of each text. ``single``: texts are fields, looked at whole."""
        parts = [[] if not t or not t.strip() else [(0, 0, t)] if single else [(a, line, t[a:b]) for a, b, line in stretches(t)] for t in texts]
        store = self.store
        fresh = {piece for own in parts for _, _, piece in own if piece not in store}
        if fresh:
            if len(store) + len(fresh) > STORE:
                store.clear()
                fresh = {piece for own in parts for _, _, piece in own}
            order = sorted(fresh)
            for piece, labels in zip(order, self.tagger.label(order)):
                store[piece] = spans_of(labels, piece)
        out = []
        for own in parts:
            found = []
            for a, line, piece in own:
                for x, y, kind in store[piece]:
                    found.append((a + x, a + y, kind, line + piece.count("\n", 0, x)))
            out.append(found)
        return out


def redacted(text: str | None, found: list[tuple[int, int, str, int]]) -> str | None:
    """The text with a typed placeholder for each item."""
    if not text or not found:
        return text
    pieces, at = [], 0
    for a, b, kind, _ in sorted(found):
        if a >= at:
            pieces += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(pieces) + text[at:]


def load(path: str | Path | None = None) -> dict[str, np.ndarray]:
    with np.load(path or MODEL) as data:
        return {k: data[k] for k in data.files}


_FINDERS: dict[int, Finder] = {}


def _finder(weights: dict[str, np.ndarray]) -> Finder:
    key = hash(weights["trans"].tobytes())
    if key not in _FINDERS:
        _FINDERS[key] = Finder(weights)
    return _FINDERS[key]


def _parts(batch: pa.RecordBatch, count: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose first ``count`` texts have ``PART`` bytes, or one row."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns[1 : 1 + count]:
        size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _examined(df: DataFrame, id_col: str, fields: tuple[str, ...], lists: tuple[str, ...], path: str | None, whole: bool) -> DataFrame:
    """What ``examine`` gives; if not ``whole``, without redacted texts and texts that hold nothing."""
    sent = df.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("field_name", T.StringType()), T.StructField("place", T.IntegerType()),
        T.StructField("line_nos", T.ArrayType(T.IntegerType())), T.StructField("kinds", T.ArrayType(T.StringType())),
    ] + [T.StructField("redacted_text", T.StringType())] * whole)
    columns = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)] + [F.col(f).cast("array<string>").alias(f"l{i}") for i, f in enumerate(lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value)
        for batch in batches:
            for part in _parts(batch, len(fields)):
                rows, names, places, lines, kinds, texts = [], [], [], [], [], []

                def add(row, name, place, text, found):
                    if not whole and not found:
                        return
                    rows.append(row)
                    names.append(name)
                    places.append(place)
                    lines.append([x[3] for x in found])
                    kinds.append([x[2] for x in found])
                    if whole:
                        texts.append(redacted(text, found))

                # the fields of a row share most of their lines, which are decoded once
                values = [text for i in range(len(fields)) for text in part.column(1 + i).to_pylist()]
                for k, (text, found) in enumerate(zip(values, finder.find(values))):
                    if text is not None:
                        add(k % part.num_rows, fields[k // part.num_rows], None, text, found)
                values = [(row, name, place, text) for i, name in enumerate(lists) for row, own in enumerate(part.column(1 + len(fields) + i).to_pylist()) for place, text in enumerate(own or []) if text is not None]
                for (row, name, place, text), found in zip(values, finder.find([v[3] for v in values], single=True)):
                    add(row, name, place, text, found)
                keys = part.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(lines, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string()))] + [pa.array(texts, pa.string())] * whole, names=schema.names)

    return df.select(F.col(id_col), *columns).mapInArrow(run, schema)


def examine(df: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("raw_text", "cleaned_text"), lists: tuple[str, ...] = ("reference_items.email", "reference_items.phone"), path: str | None = None) -> DataFrame:
    """(id, field_name, place, text, line_nos, kinds, redacted_text), one row for each text.

    Texts are the ``fields`` and, with their ``place``, the values of ``lists`` (a field of
    the elements of a list, null elements counted). Null texts give no row. Texts are read
    whole. The weights, under 1 MB, are broadcast.
    """
    return _examined(df, id_col, fields, lists, path, True)


def find_personal(df: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("raw_text", "cleaned_text"), lists: tuple[str, ...] = ("reference_items.email", "reference_items.phone"), path: str | None = None) -> DataFrame:
    """(id, field_name, line_no, kind) of every place; for lists the line is the element's place."""
    found = _examined(df, id_col, fields, lists, path, False)
    items = found.select(id_col, "field_name", "place", F.explode(F.arrays_zip("line_nos", "kinds")).alias("item"))
    return items.select(id_col, "field_name", F.coalesce("place", F.col("item.line_nos")).alias("line_no"), F.col("item.kinds").alias("kind")).distinct()

"""Problem 2: text that was decoded with the wrong character encoding.

Adjacent character pairs are scored by their mutual information in the corpus. Characters
of running text meet each other about as often as chance has it, while the pieces of a
wrongly decoded character come together only: such runs are improbable for characters that
are independent. Maximum-scoring segments over the scores isolate them, and inverse
mappings are tested only inside those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import checkpoint

#: Encodings that texts are taken to have been read in, though they were UTF-8.
CODECS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp850", "iso8859-2", "cp1251", "cp1254", "iso8859-15", "koi8-r", "cp866")
#: Texts may have been decoded wrongly several times over.
ROUNDS = 3
#: Bits of mutual information above which a pair is improbable. Two pieces that come together
#: only have one bit even in a corpus that holds nothing else, and more in any other.
CUTOFF = 0.9
#: Pairs of at least this share of all pairs have a score of their own, so there are a
#: million of them at most in a corpus of any size. Rarer ones count as never seen.
RARE = 1e-6
#: Bits of a pair that was never seen: as improbable as pieces of one character.
UNSEEN = 12.0
#: A task's counter is flushed beyond so many entries.
COUNTER = 300_000

LOST = "\ufffd"
_LOST = re.compile(f"{LOST}+")
_HIGH = re.compile("[^\x00-\x7f]+")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
#: Encodings of one byte a letter whose words, read as Western European, are accented letters only.
SINGLE = ("cp1251", "koi8-r", "cp1253", "iso8859-5")
_ALL_HIGH = re.compile("(?<![A-Za-z0-9_\u0100-\uffff])[\u00c0-\u00ff\u00b8\u00a8\u00a3\u00b3]+(?![A-Za-z0-9_\u0100-\uffff])")
#: The commonest letters of running text in those scripts.
_COMMON = frozenset("оеаинтсрвлкмдпуяыαοιετσνηυρπκμλω")


def _tables() -> list[tuple[str, dict[str, int]]]:
    out = []
    for codec in CODECS:
        table: dict[str, int] = {}
        for byte in range(128, 256):
            try:
                char = bytes([byte]).decode(codec)
            except UnicodeDecodeError:
                char = chr(byte)  # what lenient decoders make of an undefined byte
            table.setdefault(char, byte)
        for byte in range(128, 160):
            table.setdefault(chr(byte), byte)
        out.append((codec, table))
    return out


_TABLES = _tables()


def _plausible(char: str) -> bool:
    """Whether a text of ours may hold the character."""
    c = ord(char)
    return (
        0xA1 <= c <= 0x17F
        or c in (0xA0, 0x218, 0x219, 0x21A, 0x21B, 0x192, 0xFEFF, 0xFB01, 0xFB02)
        or 0x2C6 <= c <= 0x2DD
        or c in (0x300, 0x301, 0x302, 0x303, 0x308, 0x30A, 0x30B, 0x30C, 0x327, 0x328)
        or 0x384 <= c <= 0x3CE
        or 0x400 <= c <= 0x45F
        or 0x2000 <= c <= 0x206F
        or 0x20A0 <= c <= 0x20BF
        or 0x2100 <= c <= 0x22FF
        or 0x2300 <= c <= 0x27BF
        or 0x3000 <= c <= 0x30FF
        or 0x4E00 <= c <= 0x9FFF
        or 0xFF00 <= c <= 0xFFEF
        or 0x1F300 <= c <= 0x1FAFF
        or 0x1D400 <= c <= 0x1D7FF
    )


def _undo(run: str, table: dict[str, int]) -> tuple[str, int, int]:
    """The run with all UTF-8 sequences in it decoded; their characters and how many there are."""
    values = [table.get(ch, -1) for ch in run]
    raw = bytes(v if v >= 0 else 0 for v in values)
    out, at, covered, count = [], 0, 0, 0
    for m in _SEQUENCE.finditer(raw):
        char = m.group().decode("utf-8")
        if not _plausible(char) and not 0x80 <= ord(char) <= 0x9F:
            continue
        out.append(run[at : m.start()])
        out.append(char)
        at = m.end()
        covered += m.end() - m.start()
        count += 1
    out.append(run[at:])
    return "".join(out), covered, count


_CYRILLIC = re.compile("[Ѐ-џ]")

def _best(run: str) -> tuple[str, int]:
    """The best inverse mapping of a run, and how many of its characters it explains."""
    best, covered = run, 0
    for codec, table in _TABLES:
        text, n, count = _undo(run, table)
        if n <= covered:
            continue
        if n < len(run) and run.isalpha() and codec not in ("cp1252", "latin-1"):
            continue  # letters only, of which some happen to form a sequence
        if codec in ("cp1251", "koi8-r", "cp866") and (count < 2 or n < len(run) or not _CYRILLIC.search(text)):
            continue  # a proper Cyrillic word may hold one such pair
        if codec == "mac_roman" and count < 2 and _CYRILLIC.search(text) and run[-1].isalpha() and run[-1] not in "ºªΩπ":
            continue  # a dash before an accented letter
        best, covered = text, n
    return best, covered


def repair_run(run: str) -> tuple[str, bool]:
    """A run of non-ASCII characters with its wrong decodings undone; whether there were any."""
    changed = False
    for _ in range(ROUNDS):
        pieces, at, some = [], 0, False
        for m in _HIGH.finditer(run):
            text, n = _best(m.group())
            pieces += [run[at : m.start()], text]
            at, some = m.end(), some or n > 0
        if not some:
            break
        run, changed = "".join(pieces) + run[at:], True
    return run, changed


def _natural(text: str) -> float:
    """How much letters look like running text: common ones in lower case, capitals in front."""
    good = sum(ch in _COMMON for ch in text)
    odd = sum(not ch.isalpha() for ch in text) + sum(a.islower() and b.isupper() for a, b in zip(text, text[1:]))
    return (good - 2 * odd) / max(1, len(text))


def single_byte(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(from, to, original) of words inside the ``runs`` that are accented letters only, if some have three and more."""
    words = [m for m in _ALL_HIGH.finditer(text) if any(lo <= m.start() and m.end() <= hi for lo, hi in runs)] if runs else []
    if not any(len(set(m.group())) >= 3 for m in words):
        return []
    joined = "".join(m.group() for m in words)
    best, score = None, 0.3
    for codec in SINGLE:
        try:
            score_here = _natural(joined.encode("cp1252").decode(codec).lower() if joined.isupper() else joined.encode("cp1252").decode(codec))
        except UnicodeError:
            continue
        if score_here > score + (0.15 if best else 0.0):
            best, score = codec, score_here
    return [(m.start(), m.end(), m.group().encode("cp1252").decode(best)) for m in words] if best else []


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments [from, to) of a sequence (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum with
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        begin, end, left, right = i, i + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((begin, end, left, right))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


class Detector:
    """Finds and repairs wrongly decoded runs, given the mutual information of character pairs in bits.

    Without a table every pair counts as never seen, so every run beyond ASCII is tested.
    """

    def __init__(self, bits: dict[str, float] | None = None, unseen: float = UNSEEN):
        self.bits, self.unseen = bits or {}, unseen

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Improbable runs of characters: stretches [from, to) of the text."""
        spans: list[list[int]] = []
        for m in _HIGH.finditer(text):  # only pairs with a character beyond ASCII are looked at
            lo, hi = max(0, m.start() - 1), min(len(text), m.end() + 1)
            if spans and lo < spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        get, unseen, out = self.bits.get, self.unseen, []
        for lo, hi in spans:
            part = text[lo:hi]
            scores = [get(a + b, unseen) - CUTOFF for a, b in zip(part, part[1:])]
            if max(scores, default=0) > 0:
                out += [(lo + a, lo + b + 1) for a, b in segments(scores)]
        return out

    def _found(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(from, to, original) of the runs that undo to something else."""
        at = 0
        for lo, hi in self.runs(text):
            for m in _HIGH.finditer(text, max(lo, at), hi):
                fixed, changed = repair_run(m.group())
                if changed:
                    at = m.end()
                    yield m.start(), at, fixed

    def examine(self, text: str | None) -> tuple[str | None, list[tuple[int, int]]]:
        """The text with what can be recovered, and the garbled stretches of the original."""
        if not text or text.isascii():
            return text, []
        garbled = [m.span() for m in _LOST.finditer(text)]  # what these hid is gone, whatever stands beside them
        for find in (self._found, lambda t: single_byte(t, self.runs(t))):
            # words of one byte a letter can be told only once all sequences are undone
            pieces, at = [], 0
            for lo, hi, fixed in find(text):
                garbled.append((lo, hi))
                pieces += [text[at:lo], fixed]
                at = hi
            text = "".join(pieces) + text[at:]
        return text, garbled

    def garbled(self, text: str) -> list[tuple[int, int]]:
        """Stretches [from, to) of the text that undo to something else, or are lost, in order and apart."""
        found = sorted([(lo, hi) for lo, hi, _ in self._found(text)] + [m.span() for m in _LOST.finditer(text)])
        return [x for i, x in enumerate(found) if not i or x[0] >= found[i - 1][1]]


def pair_table(df: DataFrame, text_col: str) -> dict[str, float]:
    """Mutual information in bits of adjacent characters of which one is beyond ASCII.

    PMI(x, y) = log2 p(x, y) / (p(x) p(y)), with characters and pairs counted in all texts:
    summed in each task, then over the cluster. Pairs above the share ``RARE`` come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        plain = np.zeros(256, dtype=np.int64)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["chars", "n"])
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                plain += np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
                if text.isascii():
                    continue
                for m in _HIGH.finditer(text):
                    part = text[max(0, m.start() - 1) : m.end() + 1]
                    total.update(m.group())
                    total.update(map("".join, zip(part, part[1:])))
            if len(total) > COUNTER:
                yield flush()
        total.update({chr(i): int(n) for i, n in enumerate(plain[:128]) if n})
        yield flush()

    texts = df.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    counts = checkpoint(texts.mapInArrow(run, "chars string, n long").groupBy("chars").agg(F.sum("n").alias("n")))
    single = counts.where(F.char_length("chars") == 1)
    size = single.agg(F.sum("n")).first()[0] or 1
    pairs = counts.where((F.char_length("chars") == 2) & (F.col("n") >= RARE * size))
    first, second = (single.select(F.col("chars").alias(k), F.col("n").alias(f"n_{k}")) for k in "xy")
    joined = pairs.withColumns({"x": F.substring("chars", 1, 1), "y": F.substring("chars", 2, 1)}).join(first, "x").join(second, "y")
    return {r["chars"]: math.log2(r["n"] * size / (r["n_x"] * r["n_y"])) for r in joined.select("chars", "n", "n_x", "n_y").collect()}


def repair(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(id, garbled, repaired_text, garbled_chars) of each text.

    ``garbled`` tells whether the text holds characters that come from a wrong decoding,
    replacement characters included; what they hid cannot be recovered and stays. Null and
    ASCII texts come out as they are. One row in gives one row out. The table of pairs is
    broadcast; ``RARE`` bounds it.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("garbled", T.BooleanType()), T.StructField("repaired_text", T.StringType()), T.StructField("garbled_chars", T.LongType())])
    sent = df.sparkSession.sparkContext.broadcast(pair_table(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(sent.value)
        for batch in batches:
            found = [detector.examine(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bool(g) for _, g in found], pa.bool_()), pa.array([t for t, _ in found], pa.string()), pa.array([sum(b - a for a, b in g) for _, g in found], pa.int64())],
                names=schema.names,
            )

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def find_garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """Ids of the texts that hold wrongly decoded characters, each once."""
    return repair(df, id_col, text_col).where("garbled").select(id_col).distinct()

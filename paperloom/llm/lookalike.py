"""Problem 3: text that looks the same but differs in its characters.

After compatibility normalisation and the deletion of ignorable characters, words that mix
scripts are searched as lattices of look-alike characters: Viterbi finds the path of the
highest character n-gram score that stays within one script. A word all of whose letters are
look-alikes has a path of its own script and a Latin one; between Latin words it is read as
the latter if that is a far commoner word of the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.encoding import Detector
from paperloom.llm.vocabulary import SHARE, document_counts
from paperloom.session import checkpoint

#: Letters of Cyrillic and Greek, and the Latin letters they look like.
_CYRILLIC = ("АВЕКМНОРСТУХІЈЅҮаеорсухіјѕһԁԛԝѵкмнтвг", "ABEKMHOPCTYXIJSYaeopcyxijshdqwvkmhtbr")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεικνορτυχωηςσ", "ABEZHIKMNOPTYXayeiknoptuxwncs")
_GREEK_MORE = ("ν", "v")
_LIKE: dict[str, str] = dict(zip(*_CYRILLIC)) | dict(zip(*_GREEK)) | dict([_GREEK_MORE])
_BACK: dict[str, list[str]] = {}
for _char, _latin in _LIKE.items():
    _BACK.setdefault(_latin, []).append(_char)

_SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_IGNORABLE = r"\u00ad\u034f\u061cᅟᅠ\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
_MARKS = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a"
_STYLED = (
    r"\uff01-\uff5e\uffe0-\uffe6\uff65-\uff9f\ufb00-\ufb06\U0001d400-\U0001d7ff\u2102\u210a-\u2113\u2115\u2118-\u211d\u2124\u2128\u212a-\u212d\u212f-\u2131\u2133-\u2134\u2139\u2145-\u2149"
    r"\u24b6-\u24e9\u249c-\u24b5\U0001f110-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189\u2160-\u217fᴀ-ᴫĲĳǄ-ǌǱ-ǳ"
)
#: One scan tells whether a text holds anything of the kind.
_SUSPECT = re.compile(f"[{_SPACES}{_IGNORABLE}{_MARKS}{_STYLED}\\u0370-\\u03ff\\u0400-\\u052f]")
_SIMPLE = re.compile(f"[{_SPACES}{_IGNORABLE}{_MARKS}{_STYLED}]")
_SPACE = re.compile(f"[{_SPACES}]")
_STYLE = re.compile(f"[{_STYLED}]")
_IGNORE = re.compile(f"[{_IGNORABLE}]")
_FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_TOKEN = re.compile("[^\\W\\d_]+")
_EMOJI = r"[©®\u203c\u2049\u2122\u2139\u2194-\u21aa\u231a-\u23ff▪-\u27bf\u2934\u2935\u2b05-\u2b55\u3030\u303d\u3297\u3299\U0001f000-\U0001faff]"
#: Joiners and presentation forms inside emoji, which stay.
_IN_EMOJI = re.compile(rf"(?<={_EMOJI})[\ufe0e\ufe0f]?\u200d(?={_EMOJI})|(?<={_EMOJI})[\ufe0e\ufe0f]|(?<=[0-9#*])\ufe0f?\u20e3")
_KEPT = {"\ufe0e": "\ue000", "\ufe0f": "\ue001", "\u20e3": "\ue002", "\u200d": "\ue003"}
_KEEP, _GIVE_BACK = str.maketrans(_KEPT), str.maketrans({v: k for k, v in _KEPT.items()})
#: Small capitals that compatibility normalisation leaves as they are.
_SMALL_CAPITALS = {"ᴀ": "A", "ᴄ": "C", "ᴅ": "D", "ᴇ": "E", "ᴊ": "J", "ᴋ": "K", "ᴍ": "M", "ᴏ": "O", "ᴘ": "P", "ᴛ": "T", "ᴜ": "U", "ᴠ": "V", "ᴡ": "W", "ᴢ": "Z"}
#: Cost in bits of changing a letter, and of going from one script to another inside a word.
CHANGE, SWITCH = 1.5, 25.0
#: A word of look-alikes only has so many letters at least, and its Latin reading is so much commoner.
TWIN_LETTERS, TWIN_RATIO = 3, 25


@lru_cache(maxsize=4096)
def script(char: str) -> str:
    """Latin, Cyrillic, Greek, or "" for everything else."""
    c = ord(char)
    if 0x370 <= c <= 0x3FF:
        return "Greek"
    if 0x400 <= c <= 0x52F:
        return "Cyrillic"
    return "Latin" if char.isalpha() and (c < 0x250 or 0x1E00 <= c <= 0x1EFF) else ""


@lru_cache(maxsize=4096)
def _split(char: str) -> tuple[str, str]:
    """A letter without its accents, and the accents."""
    parts = unicodedata.normalize("NFD", char)
    return parts[0], parts[1:]


@lru_cache(maxsize=4096)
def alternatives(char: str) -> tuple[str, ...]:
    """The character and its look-alikes in other scripts, accents kept."""
    base, marks = _split(char)
    found = [char]
    if base in _LIKE:
        found.append(unicodedata.normalize("NFC", _LIKE[base] + marks))
    for other in _BACK.get(base, ()):
        found.append(unicodedata.normalize("NFC", other + marks))
    return tuple(dict.fromkeys(x for x in found if len(x) == 1))


class Model:
    """Character pairs within words of one script, as bits of surprisal."""

    def __init__(self, pairs: dict[str, int] | None = None, twins: dict[str, str] | None = None):
        pairs = pairs or {}
        self.twins = twins or {}
        heads: Counter[str] = Counter()
        for pair, n in pairs.items():
            heads[pair[0]] += n
        self.bits = {pair: -math.log2((n + 0.5) / (heads[pair[0]] + 60)) for pair, n in pairs.items()}
        self.unseen = 12.0

    def read(self, token: str) -> str:
        """The likeliest reading of a word that mixes scripts."""
        best: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for char in token:
            step: dict[str, tuple[float, str]] = {}
            for option in alternatives(char):
                cost_here = CHANGE if option != char else 0.0
                own = script(option)
                for last, (cost, spelled) in best.items():
                    pair = (last or "^").lower() + option.lower()
                    bits = self.bits.get(pair, self.unseen)
                    if last and script(last) and own and script(last) != own:
                        bits += SWITCH
                    total = cost + cost_here + bits
                    if option not in step or step[option][0] > total:
                        step[option] = (total, spelled + option)
            best = step
        return min(best.values())[1]


_LATIN_WORD = re.compile(r"[A-Za-z\u00c0-\u024f]+")


def _among_latin(text: str, begin: int, end: int) -> bool:
    """Whether the words beside a place in a line are Latin, and there are any."""
    before = _TOKEN.findall(text[max(text.rfind("\n", 0, begin) + 1, begin - 80) : begin])[-1:]
    stop = text.find("\n", end)
    after = _TOKEN.findall(text[end : min(stop if stop >= 0 else len(text), end + 80)])[:1]
    return bool(before or after) and all(_LATIN_WORD.fullmatch(w) for w in before + after)


def _mixed(token: str) -> bool:
    scripts = {script(c) for c in token}
    return "Latin" in scripts and ("Greek" in scripts or "Cyrillic" in scripts)


def _style(m: re.Match) -> str:
    char = m.group()
    return _SMALL_CAPITALS.get(char) or unicodedata.normalize("NFKC", char)


def normalise(text: str | None, model: Model, garbled: list[tuple[int, int]] | None = None) -> str | None:
    """One consistent form of a text.

    Fractions, superscripts and trade marks stay, as do words fully in their own script,
    joiners inside emoji and the stretches ``garbled`` by a wrong decoding.
    """
    if not text or text.isascii() or not _SUSPECT.search(text):
        return text
    if garbled:
        pieces, at = [], 0
        for lo, hi in garbled:
            pieces += [normalise(text[at:lo], model), text[lo:hi]]
            at = hi
        return "".join(pieces) + (normalise(text[at:], model) or "")
    if _SIMPLE.search(text):
        kept = _IN_EMOJI.sub(lambda m: m.group().translate(_KEEP), text)
        fixed = unicodedata.normalize("NFC", _IGNORE.sub("", _STYLE.sub(_style, _SPACE.sub(" ", kept))))
        text = fixed.translate(_GIVE_BACK) if kept != text else fixed
    if _FOREIGN.search(text):
        text = _TOKEN.sub(lambda m: model.read(m.group()) if _mixed(m.group()) else m.group(), text)
        if model.twins:
            text = _TOKEN.sub(lambda m: model.twins[m.group()] if m.group() in model.twins and _among_latin(text, *m.span()) else m.group(), text)
    return text


def word_counts(df: DataFrame, *text_cols: str) -> DataFrame:
    """(word, n) over all texts of the columns, cut off from what it was counted from."""
    texts = df.select(F.explode(F.array(*(F.col(c).cast("string") for c in text_cols))).alias("text"))
    return checkpoint(document_counts(texts, "text"))


def pair_counts(df: DataFrame, *text_cols: str) -> dict[str, int]:
    """How often characters follow each other in words of one script, over all texts of the columns."""
    return _pairs(word_counts(df, *text_cols))


def _pairs(counts: DataFrame) -> dict[str, int]:
    """The same from the counts of words.

    The pairs are few, as they are of one script's letters only, and are all that comes to
    the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = unicodedata.normalize("NFC", word)
                scripts = {script(c) for c in word}
                if len(scripts) == 1 and "" not in scripts:
                    for a, b in zip("^" + word.lower(), word.lower()):
                        total[a + b] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pair", "n"])

    pairs = counts.mapInArrow(run, "pair string, n long")
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def twin_words(counts: DataFrame, texts: int) -> dict[str, str]:
    """Words whose letters all have Latin look-alikes, with the Latin word that they look like and that is far commoner.

    The Latin word must stand in one text of ``vocabulary.SHARE``, which bounds the result.
    """
    read, meant = "".join(_LIKE), "".join(_LIKE.values())
    own = counts.where(F.col("word").rlike(f"^[{read}]{{{TWIN_LETTERS},}}$")).select(F.col("word").alias("twin"), F.col("n").alias("seen"), F.translate("word", read, meant).alias("word"))
    common = counts.where(F.col("n") >= max(3, texts / SHARE))
    # both sides grow with the corpus before they are joined, so neither is broadcast
    rows = own.hint("merge").join(common, "word").where(F.col("n") >= TWIN_RATIO * F.col("seen"))
    return {r["twin"]: r["word"] for r in rows.select("twin", "word").collect()}


def unify(df: DataFrame, fields: tuple[str, ...], id_col: str = "doc_id", counted: str | None = None) -> DataFrame:
    """(id, field_name, needed, unified_text), one row for each row and field.

    ``needed`` tells whether the text had to be changed. Null texts stay null and need
    nothing. Words and their character pairs are counted over all these fields, or over ``counted``.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("field_name", T.StringType()), T.StructField("needed", T.BooleanType()), T.StructField("unified_text", T.StringType())])
    over = [counted] if counted else list(fields)
    counts = word_counts(df, *over)
    texts = df.select(*(F.count(f).alias(f) for f in over)).first()
    sent = df.sparkSession.sparkContext.broadcast((_pairs(counts), twin_words(counts, sum(texts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, detector = Model(*sent.value), Detector()
        for batch in batches:
            for i, field in enumerate(fields):
                needed, out = [], []
                for text in batch.column(i + 1).to_pylist():
                    fixed = text
                    if text and not text.isascii() and _SUSPECT.search(text):
                        fixed = normalise(text, model, detector.garbled(text))
                    needed.append(fixed != text)
                    out.append(fixed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([field] * batch.num_rows), pa.array(needed, pa.bool_()), pa.array(out, pa.string())], names=schema.names)

    return df.select(F.col(id_col), *(F.col(f).cast("string") for f in fields)).mapInArrow(run, schema)


def find_lookalikes(df: DataFrame, fields: tuple[str, ...] = ("raw_text", "cleaned_text"), id_col: str = "doc_id") -> DataFrame:
    """(id, field_name) of the fields that had to be brought to the consistent form."""
    return unify(df, fields, id_col).where("needed").select(id_col, "field_name").distinct()

"""Column expressions on text. All stay in the JVM.

Character classes are spelled out, so that they mean the same in every regex dialect:
white space is what Python calls so, and words are of letters, digits and underscores of
any script.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a string.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same characters without the brackets, for use in a larger class.
WS_IN = WS[1:-1]
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
BULLET = rf"^(?:[{WS_IN}\-\x{{2022}}\x{{2023}}\x{{25e6}}*\x{{2043}}\x{{2219}}]+|{DIGIT}+[.)]{WS}*)"
METRIC = rf"{DIGIT}+(?:\.{DIGIT}+)?{WS}?%|[$€£]{WS}?{DIGIT}[{DIGIT},]*|(?:^|{NOT_WORD}){DIGIT}+(?:\.{DIGIT}+)?{WS}?(?:x|k|K|m|M|million|billion|thousand)(?:\z|{NOT_WORD})|(?:^|{NOT_WORD}){DIGIT}{{2,}}(?:\z|{NOT_WORD})"


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def quoted(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constants(values: Iterable[str]) -> Column:
    """An array of strings, written as one expression rather than built value by value."""
    return F.expr(f"cast(array({', '.join(map(quoted, values))}) as array<string>)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(c: Column) -> Column:
    """Trimmed lines that hold something. Lines end at \\n only."""
    return F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != "")


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def block_count(c: Column) -> Column:
    """Stretches between blank lines that hold something."""
    return F.size(F.filter(F.split(c, rf"\n{WS}*\n"), lambda x: trim(x) != ""))


def clean(c: Column) -> Column:
    """The text as it is analysed: plain dashes, no soft hyphens, single blanks, trimmed lines.

    Line ends of every kind become \\n after runs of \\n were cut to two, so blank lines of
    another make may leave longer runs.
    """
    c = F.translate(F.coalesce(c, F.lit("")), "–—­", "--")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\r\n|[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", "\n")
    return trim(F.array_join(F.transform(F.split(c, "\n"), trim), "\n"))


def clean_extracted(c: Column) -> Column:
    """The text as it is parsed: broken words joined, bullets as dashes, no control characters."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), rf"({WORD})-{WS}*\n{WS}*({WORD}+)", "$1$2")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x{2022}\x{25aa}\x{2023}\x{2043}\x{25cf}\x{2219}]", "-")
    c = F.regexp_replace(c, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]", "")
    return trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def strip_bullet(c: Column) -> Column:
    return trim(F.regexp_replace(c, BULLET, ""))


def has_bullet(c: Column) -> Column:
    return c.rlike(BULLET)


def is_corrupted(c: Column) -> Column:
    """Whether a decoded text is no text: a NUL, or too many control characters."""
    controls = F.length(c) - F.length(F.regexp_replace(c, r"[\x{1}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", ""))
    return F.coalesce(F.when(F.length(c) == 0, False).when(F.instr(c, "\x00") > 0, True).otherwise(controls / F.length(c) > 0.05), F.lit(False))


def bounded(term: str) -> str:
    """Pattern of a term between word boundaries, in the sense of Python's \\b.

    Beside a sign the boundary asks for a word character, so "c++" stands only before one.
    """
    quoted = "".join(f"\\{c}" if not (c.isalnum() or c in "_ ") else c for c in term)
    word = lambda c: c.isalnum() or c == "_"
    before = rf"(?:^|{NOT_WORD})" if word(term[0]) else WORD
    after = rf"(?:\z|{NOT_WORD})" if word(term[-1]) else WORD
    return f"{before}{quoted}{after}"


def is_plain(term: str) -> bool:
    """Whether a term is one word of word characters, so that tokens tell it."""
    return all(c.isalnum() or c == "_" for c in term)


def matched_terms(c: Column, terms: list[str]) -> Column:
    """Sorted distinct terms of a list that stand in the lowered text.

    One pass splits the text into words for the plain terms; only the others are searched.
    """
    plain = [t for t in dict.fromkeys(terms) if is_plain(t)]
    rest = [t for t in dict.fromkeys(terms) if t and not is_plain(t)]

    patterns = F.expr(f"array({', '.join(f'struct({quoted(t)} as term, {quoted(bounded(t))} as pattern)' for t in rest)})")

    def found(low: Column) -> Column:
        tokens = F.array_intersect(F.split(low, f"{NOT_WORD}+"), constants(plain))
        # a pattern is tried only where its term stands at all
        others = lambda: F.transform(F.filter(patterns, lambda x: F.contains(low, x["term"]) & F.rlike(low, x["pattern"])), lambda x: x["term"])
        return F.concat(tokens, others()) if rest else tokens

    return F.array_sort(F.array_distinct(let(F.lower(F.coalesce(c, F.lit(""))), found)))


def half_even(c: Column, low: int, high: int) -> Column:
    """Rounded with halves to even, and kept between two limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(c).cast("int")))

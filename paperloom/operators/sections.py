"""Sections of resumes: splitters, summaries, completeness flags, structured items.

A text is one row, and all that is split off it stays in that row: its lines become an
array, headings are marked in it, and the stretches between them are its slices. Nothing is
exploded or shuffled, and every line is copied once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions.text import NOT_WORD, WS, constants, let, lines, quoted, trim, words


def _quote(term: str) -> str:
    return "".join(f"\\{c}" if not (c.isalnum() or c == " ") else c for c in term)


def heading_pattern(headings: list[str], ends: bool = True) -> str:
    """An upper-case line that is a heading, begins with one or, where ``ends`` says so, ends with one."""
    any_of = "|".join(map(_quote, headings))
    return rf"(?s)^(?:{any_of})(?: .*)?\z" + (rf"|^.* (?:{any_of})\z" if ends else "")


def secondary_pattern(name: str) -> str:
    """A line that begins with the heading of a secondary section."""
    lead = L._LEAD.replace("{ws}", WS)
    return rf"(?i)^{WS}*{lead}{L.HEADINGS[name].replace('{ws}', WS)}(?:\z|{NOT_WORD})"


ANY_HEADING_PATTERN = rf"(?i)^{WS}*(?:[0-9]+\.|\x{{2022}}|-|\*)*{WS}*{L.ANY_HEADING.replace('{ws}', WS)}(?:\z|{NOT_WORD})"
INLINE_SUMMARY_PATTERN = rf"(?i)^{WS}*{L.INLINE_SUMMARY.replace('{ws}', WS)}{WS}*[:\-]?{WS}*"


def _first(cases: list[tuple[str, Column]]) -> Column:
    return reduce(lambda out, case: out.when(case[1], case[0]), cases, F.when(F.lit(False), F.lit("")))


_NAMES = list(L.SECTIONS)
#: Words of the longest heading.
_LONGEST = max(h.count(" ") for hs in L.SECTIONS.values() for h in hs) + 1
_PLACES = "map(" + ", ".join(f"{quoted(h)}, {i}" for i, hs in enumerate(L.SECTIONS.values()) for h in hs) + ")"


def _heading_place(upper: Column, ends: bool = True) -> Column:
    """Number of the first section whose heading an upper-case line is, begins with or, where ``ends`` says so, ends with.

    The line's first and last words, as many as headings have, are looked up in a map.
    """
    places = F.expr(_PLACES)
    return F.least(*[F.element_at(places, F.substring_index(upper, " ", k)) for n in range(1, _LONGEST + 1) for k in ((n, -n) if ends else (n,))])


def heading_of(upper: Column) -> Column:
    """Name of the section that an upper-case line heads, or null."""
    return F.get(constants(_NAMES), _heading_place(upper))


#: Any heading of either kind: one pattern that most lines fail at their first letter.
_SOME_HEADING = rf"(?i)^{WS}*(?:[0-9]+\.|\x{{2022}}|-|\*)*{WS}*(?:{'|'.join((*L.HEADINGS.values(), L.ANY_HEADING)).replace('{ws}', WS)})(?:\z|{NOT_WORD})"
#: Mark of a line that closes a section and opens none.
_CLOSES = ""


def _edge_of(line: Column) -> Column:
    """Name of the secondary section that a line opens, "" where it only closes one, else null."""
    patterns = {name: secondary_pattern(name) for name in L.HEADINGS}
    return F.when(line.rlike(_SOME_HEADING), _first([(name, line.rlike(x)) for name, x in patterns.items()]).otherwise(F.lit(_CLOSES)))


def _stretches(own: Column, marks: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the stretches (section, next, body) of lines that follow each mark, the first stretch having none."""
    marked = F.filter(F.transform(marks, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

    def cut(at: Column) -> Column:
        stops = F.concat(at, F.array(F.size(own)))
        body = lambda b, k: F.slice(own, b + 2, stops[k] - b - 1)
        return F.transform(F.concat(F.array(F.lit(-1)), at), lambda b, k: F.struct(F.get(marks, b).alias("section"), F.get(marks, stops[k]).alias("next"), body(b, k).alias("body")))

    return let(let(marked, cut), use)


def _named(stretches: Column, text: Callable[[Column], Column]) -> Column:
    """Map from each section's name to the text made of its stretches."""
    names = F.array_distinct(F.transform(stretches, lambda r: r["section"]))
    return F.map_from_entries(F.transform(names, lambda s: F.struct(s, text(F.filter(stretches, lambda r: r["section"] == s)))))


def _block(lines_: Column) -> Column:
    return trim(F.array_join(lines_, "\n"))


def appended(text: Column) -> Column:
    """Map section -> text: repeated sections are appended; what stands before any is HEADER.

    A heading's own line is dropped, whatever else it holds. Sections without text are not
    in the map, and a null text has none.
    """

    def named(runs: Column) -> Column:
        known = F.transform(runs, lambda r: F.struct(F.coalesce(r["section"], F.lit("HEADER")).alias("section"), r["body"].alias("body")))
        return let(known, lambda k: _named(k, lambda own: _block(F.flatten(F.transform(own, lambda r: r["body"])))))

    def split(own: Column) -> Column:
        marks = F.transform(own, lambda x: let(F.upper(trim(x)), heading_of))
        return let(marks, lambda m: _stretches(own, m, named))

    return F.map_filter(let(F.split(F.coalesce(text, F.lit("")), "\n"), split), lambda _, x: x != "")


def overwritten(text: Column) -> Column:
    """Map section -> text: the last run of a section stands for it.

    A heading is a line's beginning. Any other known heading closes the section, and then
    an empty run stands too; a run that the next section's heading ends must hold a line.
    """
    stands = lambda r: r["section"].isNotNull() & (r["section"] != _CLOSES) & ((F.size(r["body"]) > 0) | F.coalesce(r["next"] == _CLOSES, F.lit(False)))

    def named(runs: Column) -> Column:
        return let(F.filter(runs, stands), lambda kept: _named(kept, lambda own: _block(F.element_at(own, -1)["body"])))

    def split(own: Column) -> Column:
        return let(F.transform(own, _edge_of), lambda m: _stretches(own, m, named))

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), split)


def split_appending(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, section_text) of ``appended``."""
    return df.select(F.col(id_col), F.explode(appended(F.col(text_col))).alias("section", "section_text"))


def split_overwriting(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, section_text) of ``overwritten``."""
    return df.select(F.col(id_col), F.explode(overwritten(F.col(text_col))).alias("section", "section_text"))


def summary_inline(text: Column) -> Column:
    """Summary of a text without a summary section: the first line that begins with a word for it, to the next heading."""
    own = lines(F.coalesce(text, F.lit("")))
    at = F.array_position(F.transform(own, lambda x: x.rlike(INLINE_SUMMARY_PATTERN)), True)
    rest = F.slice(own, (at + 1).cast("int"), F.size(own))
    stop = F.array_position(F.transform(rest, lambda x: _heading_place(F.upper(x), ends=False).isNotNull()), True)
    follow = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
    own_rest = trim(F.regexp_replace(F.try_element_at(own, at.cast("int")), INLINE_SUMMARY_PATTERN, ""))
    whole = F.concat(F.filter(F.array(own_rest), lambda x: x != ""), follow)
    return F.when(at > 0, F.nullif(trim(F.array_join(whole, " ")), F.lit("")))


def summary(found: Column, text: Column) -> Column:
    """The summary section of ``appended``, else the inline one, else null."""
    return F.coalesce(found["summary"], summary_inline(text))


def summaries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, summary). One row for each row."""
    return df.select(F.col(id_col), summary(appended(F.col(text_col)), F.col(text_col)).alias("summary"))


def completeness(text: Column) -> dict[str, Column]:
    """Which of the twelve sections a text has."""
    text = F.coalesce(text, F.lit(""))
    contact = rf"[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+\.[\p{{L}}\p{{N}}_]+|\+?\p{{Nd}}[\p{{Nd}} \-]{{8,}}\p{{Nd}}"
    flags = {"contact_info": text.rlike(contact)}
    low = F.lower(text)
    for name, terms in L.PRIMARY.items():
        # a pattern is tried only where one of its terms stands at all
        some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])
        flags[name] = some & low.rlike(rf"(?:^|{NOT_WORD})(?:{'|'.join(terms)})(?:\z|{NOT_WORD})")
    for name in ("certifications", "languages", "awards", "publications", "interests", "references"):
        flags[name] = text.rlike(secondary_pattern(name).replace("(?i)^", r"(?i)(?:\A|\n)", 1))
    return {k: flags[k] for k in L.FLAGS}


#: Sections whose lines are items.
ITEM_LISTS = [name for name in L.HEADINGS if name != "summary"]


def items(name: str, text: Column) -> Column:
    """(item, proficiency) of each line of a secondary section; none of a null one.

    Lines lose dashes and blanks at their ends. A language's line is cut at its dashes: the
    first piece is the language and the second the proficiency, so a line that begins with
    a dash has its language as the proficiency.
    """
    bare = lambda x: trim(F.btrim(x, F.lit("- ")))
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: bare(x) != "")
    if name != "languages":
        return F.transform(own, lambda x: F.struct(bare(x).alias("item"), F.lit(None).cast("string").alias("proficiency")))
    cut = lambda x: let(F.split(x, "-"), lambda p: F.struct(bare(p[0]).alias("item"), F.when(F.size(p) > 1, trim(F.try_element_at(p, F.lit(2)))).alias("proficiency")))
    return F.transform(own, cut)


def structured_items(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, list_name, pos, item, proficiency): one item a line of each secondary section."""
    rows = df.select(F.col(id_col), overwritten(F.col(text_col)).alias("_found"))
    lists = rows.select(id_col, F.explode(F.array(*[F.struct(F.lit(n).alias("list_name"), items(n, F.col("_found")[n]).alias("items")) for n in ITEM_LISTS])).alias("l"))
    return lists.select(id_col, "l.list_name", F.posexplode("l.items").alias("pos", "i")).select(id_col, "list_name", "pos", "i.item", "i.proficiency")


def resume_heuristic(text: Column) -> dict[str, Column]:
    """Whether a cleaned text is a resume, by words that name its sections."""
    named = lambda own: F.size(F.filter(own, lambda w: w.isin(L.RESUME_WORDS)))
    counted = let(words(F.lower(F.coalesce(text, F.lit("")))), lambda own: F.struct(F.size(own).alias("words"), named(own).alias("hits")))
    count, hits = counted["words"], counted["hits"]
    confidence = F.when(count > 30, F.least(F.round(hits / 4.0, 2), F.lit(1.0))).otherwise(0.1)
    return {
        "word_count": count, "char_count": F.length(F.coalesce(text, F.lit(""))), "section_words": hits, "confidence_score": confidence,
        "is_resume": (confidence >= 0.4) & (count >= 50), "long_enough": count >= 50, "dense_headings": confidence >= 0.6,
    }

"""Contact details, skills, names, work history, education, projects and certifications."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import lexicon as L
from paperloom.functions.text import DIGIT, NOT_WORD, WS, WS_IN, let, lines, matched_terms, trim, words
from paperloom.operators import sections

# Forms of mail addresses, phone numbers and profile links.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = rf"(?:\+?{DIGIT}{{1,3}}[{WS_IN}\-]?)?\(?{DIGIT}{{2,4}}\)?[{WS_IN}\-]?{DIGIT}{{3,4}}[{WS_IN}\-]?{DIGIT}{{3,4}}"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_\-]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[a-zA-Z0-9_\-]+"


def email(text: Column) -> Column:
    """The first mail address, or null."""
    return F.regexp_substr(text, F.lit(EMAIL))


def phone(text: Column) -> Column:
    """The first run that has a phone number's form, or null."""
    found = trim(F.regexp_substr(text, F.lit(PHONE)))
    return F.when(F.length(F.regexp_replace(found, f"[^{DIGIT}]", "")).between(7, 15), found)


def link(text: Column, pattern: str) -> Column:
    return F.regexp_substr(text, F.lit(pattern))


def skills(text: Column, terms: list[str] | None = None) -> Column:
    return matched_terms(text, terms or L.SKILLS)


def name(text: Column) -> Column:
    """The first of three lines without digits and signs of mail, of four words at most, in ASCII letters."""
    firsts = F.slice(lines(F.coalesce(text, F.lit(""))), 1, 3)
    fit = F.filter(firsts, lambda x: ~x.rlike(f"@|{DIGIT}") & (F.size(words(x)) <= 4))
    return F.try_element_at(F.filter(F.transform(fit, lambda x: trim(F.regexp_replace(x, f"[^a-zA-Z{WS_IN}.]", ""))), lambda x: x != ""), F.lit(1))


def certifications(text: Column) -> Column:
    """Lines without their bullets."""
    return F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: trim(F.regexp_replace(x, rf"^[\x{{2022}}\-*{WS_IN}]+", ""))), lambda x: x != "")


_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
#: A line that holds a date or a number of four digits.
DATED = rf"(?i){_MONTH}{WS}*{DIGIT}{{4}}{WS}*[{WS_IN}\x{{2013}}\-]+{WS}*(?:Present|{_MONTH}{WS}*{DIGIT}{{4}}|{DIGIT}{{4}})|(?:^|{NOT_WORD}){DIGIT}{{4}}(?:\z|{NOT_WORD})"
#: What tells a degree, an institution and a list of courses.
DEGREES = ["BS", "MS", "B.Sc", "M.Sc", "Bachelor", "Master", "Ph.D", "Diploma", "Associate"]
INSTITUTIONS = ["university", "college", "institute", "school", "academy"]
COURSES = ["core subjects", "subjects:", "courses:", "relevant coursework"]
DEGREE = rf"(?i)(?:^|{NOT_WORD})(?:{'|'.join(d.replace('.', chr(92) + '.') for d in DEGREES)})(?:\z|{NOT_WORD})"


def has_experience(text: Column) -> Column:
    """Whether any line of an experience section opens an entry."""
    tidy = lambda x: trim(F.regexp_replace(x, f"{WS}+", " "))

    def opens(x: Column) -> Column:
        own = tidy(x)
        bare = trim(F.regexp_replace(own, rf"^[\x{{2022}}\-*{WS_IN}]+", ""))
        dated, bullet = own.rlike(DATED), own.rlike(r"^[\x{2022}\-*]")
        return ~bullet & F.when(dated, F.length(own) < 50).otherwise((F.length(bare) < 80) & ~bare.endswith("."))

    return F.coalesce(F.exists(lines(text), opens), F.lit(False))


def has_education(text: Column) -> Column:
    """Whether any line of an education section names a degree."""
    courses = "|".join(COURSES)
    return F.coalesce(F.exists(lines(text), lambda x: x.rlike(DEGREE) & ~F.lower(x).rlike(courses)), F.lit(False))


# ---- line parsers that keep a state: one document at a time, in Arrow batches ----

EXPERIENCE_TYPE = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("company", T.StringType()), T.StructField("dates", T.StringType()), T.StructField("bullets", T.ArrayType(T.StringType()))]))
EDUCATION_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("degree", "institution", "cgpa", "dates")]))

# Forms of dates, grades and years.
_M = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_SPAN = re.compile(rf"{_M}\s*\d{{4}}\s*[\s–\-]+\s*(?:Present|{_M}\s*\d{{4}}|\d{{4}})|\b\d{{4}}\s*[\s–\-]+\s*(?:Present|\d{{4}})|\b\d{{4}}\b", re.I)
_GRADE = re.compile(r"(?:CGPA|GPA)[\s:]*([0-9]\.[0-9]{1,2}(?:\s*/\s*[0-9]\.[0-9])?)", re.I)
_YEAR = re.compile(r"\b(?:20\d{2}|19\d{2})\b")
_DEGREE = re.compile(rf"\b(?:{'|'.join(map(re.escape, DEGREES))})\b", re.I)
PLACEHOLDER = "Role / Position"


class _History:
    """Work entries read line by line."""

    def __init__(self) -> None:
        self.done: list[dict] = []

    def open(self, title: str = "", dates: str = "") -> None:
        self.done.append({"title": title, "company": "", "dates": dates, "bullets": []})

    def read(self, line: str) -> None:
        tidy = " ".join(line.split())
        bare = re.sub(r"^[•\-*\s]+", "", tidy).strip()
        bullet, span = tidy[:1] in ("•", "-", "*"), _SPAN.search(tidy)
        now = self.done[-1] if self.done else None
        if span and len(tidy) < 50 and not bullet:
            if now is None:
                self.open(PLACEHOLDER, span.group())
            elif now["dates"]:
                self.open("", span.group())
            else:
                now["dates"] = span.group()
        elif not span and len(bare) < 80 and not bullet and not bare.endswith("."):
            vacant = None if now is None or now["bullets"] else next((f for f in ("title", "company") if not now[f]), None)
            if vacant:
                now[vacant] = bare
            else:
                self.open(bare)
        elif now is not None:
            if not now["company"] and not bullet and len(bare) < 80:
                now["company"] = bare
            elif now["bullets"] and not bullet and not now["bullets"][-1].rstrip().endswith((".", ":", ";")):
                now["bullets"][-1] += f" {bare}"
            else:
                now["bullets"].append(bare)


def parse_experience(text: str | None) -> list[dict]:
    history = _History()
    for line in filter(None, map(str.strip, (text or "").split("\n"))):
        history.read(line)
    return history.done


def _institution(line: str, years: bool) -> str:
    line = _GRADE.sub("", line).strip()
    return " ".join((_YEAR.sub("", line) if years else line).split())


def _told(line: str, courses: bool) -> Iterator[tuple[str, str]]:
    """Fields that a line below a degree may fill, with their values; the first that is still empty takes it."""
    name = lambda years: _institution(line, years).strip(" -·,")
    if any(w in line.lower() for w in INSTITUTIONS):
        yield "institution", name(True)
    if _YEAR.search(line):
        yield "dates", " ".join(line.split())
    elif not courses:
        yield "institution", name(False)


def parse_education(text: str | None) -> list[dict]:
    """Entries of a degree's line and what the lines below it say. After a list of courses no plain line names an institution."""
    done: list[dict] = []
    courses = False
    for line in filter(None, map(str.strip, (text or "").split("\n"))):
        if any(mark in line.lower() for mark in COURSES):
            courses = True
            continue
        grade = _GRADE.search(line)
        if _DEGREE.search(line):
            courses = False
            named = next((v for f, v in _told(line, True) if f == "institution"), None)
            done.append({"degree": line, "institution": "" if named is None else _institution(line, False), "cgpa": "", "dates": ""})
        for field, value in _told(line, courses) if done and not _DEGREE.search(line) else ():
            if not done[-1][field]:
                done[-1][field] = value
                break
        if grade and done and not done[-1]["cgpa"]:
            done[-1]["cgpa"] = grade.group(1)
    return done


@F.pandas_udf(EXPERIENCE_TYPE)
def work_experience(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(parse_experience)


@F.pandas_udf(EDUCATION_TYPE)
def education(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(parse_education)


PROJECT_SPLIT = rf"{WS}+[\x{{2014}}\x{{2013}}\-]{WS}+|{WS}{{3,}}"


PROJECT_TYPE = "array<struct<name:string,description:string>>"


def projects_of(text: Column) -> Column:
    """(name, description) of the projects in a section's text.

    A line with a dash between blanks opens a project; other lines go on with its description.
    """

    def told(own: Column) -> Column:
        parts = F.split(own[0], PROJECT_SPLIT, 2)
        both = lambda p: F.size(p) == 2
        rest = lambda p: F.concat(F.array(F.when(both(p), trim(p[1])).otherwise("")), F.slice(own, 2, F.size(own)))
        return let(parts, lambda p: F.struct(F.when(both(p), trim(p[0])).otherwise(own[0]).alias("name"), trim(F.array_join(rest(p), " ")).alias("description")))

    def split(own: Column) -> Column:
        opens = lambda x, i: F.when((i == 0) | x.rlike(PROJECT_SPLIT), i)
        begins = F.filter(F.transform(own, opens), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda b, k: let(F.slice(own, b + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - b), told)))

    return let(certifications(text), split)


def projects(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, project_no, project_name, description) of each text's projects section. Numbers count from 1."""
    rows = df.select(F.col(id_col), F.posexplode(projects_of(sections.appended(F.col(text_col))["projects"])).alias("pos", "p"))
    return rows.select(id_col, (F.col("pos") + 1).alias("project_no"), F.col("p.name").alias("project_name"), "p.description")


ENTITIES = ("candidate_info", "summary", "skills", "total_skills_count", "work_experience", "education", "projects", "certifications")


def with_entities(df: DataFrame, text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """All columns of ``df``, and the entities of the text in each row. Sections that are missing count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select("*", sections.appended(text).alias("_found"), skills(text, terms).alias("skills"))
    found = lambda s: F.coalesce(F.col("_found")[s], F.lit(""))
    return rows.select(
        *df.columns,
        F.struct(name(text).alias("name"), email(text).alias("email"), phone(text).alias("phone"), link(text, LINKEDIN).alias("linkedin"), link(text, GITHUB).alias("github")).alias("candidate_info"),
        sections.summary(F.col("_found"), text).alias("summary"), "skills", F.size("skills").alias("total_skills_count"), work_experience(found("experience")).alias("work_experience"),
        education(found("education")).alias("education"), projects_of(F.col("_found")["projects"]).alias("projects"), certifications(found("certifications")).alias("certifications"),
    )


def parse_all(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """All entities of each text, one row for each row, without a join or shuffle."""
    return with_entities(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", terms).drop("_text")

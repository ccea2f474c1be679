"""What the engine asks from outside: keywords, pages of files, reviews by a language model.

Deterministic gates stand in front of the providers; without one the status says so, and
nothing is made up.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions.text import trim

#: Keywords that one provider may hold; more must be joined, not sent along.
MOST_KEYWORDS = 20_000
LEAST_CHARS, MOST_CHARS = 50, 30_000


class KeywordProvider(Protocol):
    def keywords(self, role: str | None) -> list[str]: ...


class StaticKeywords:
    """One list for all roles."""

    def __init__(self, terms: list[str] | None = None):
        self.terms = sorted({t.lower() for t in (L.SKILLS if terms is None else terms) if t})

    def keywords(self, role: str | None = None) -> list[str]:
        return self.terms


class TableKeywords:
    """Keywords from a table (target_role, keyword): those of the role and those of no role."""

    def __init__(self, table: DataFrame):
        tidy = table.select(F.lower(trim(F.col("target_role"))).alias("role"), F.lower(trim(F.col("keyword"))).alias("keyword")).where("keyword <> ''").distinct()
        rows = tidy.limit(MOST_KEYWORDS + 1).collect()
        if len(rows) > MOST_KEYWORDS:
            raise ValueError(f"more than {MOST_KEYWORDS} keywords; join the table instead")
        self.by_role: dict[str | None, set[str]] = {}
        for r in rows:
            self.by_role.setdefault(r["role"], set()).add(r["keyword"])

    def keywords(self, role: str | None = None) -> list[str]:
        found = set().union(*self.by_role.values()) if role is None else self.by_role.get(role.strip().lower(), set()) | self.by_role.get(None, set())
        return sorted(found)


class PageExtractor(Protocol):
    """Pages of a file's bytes: (page_no, height, text, has_ruled_table, blocks, links, images)."""

    def pages(self, content: bytes) -> Iterator[dict]: ...


Review = Callable[[str, str | None], str]


def _asked(provider: Review, tries: int, wait: float) -> Callable[[str, str | None], tuple[str | None, str | None]]:
    """A provider that is asked again after a failure, each time after a longer wait; (answer, name of the error)."""

    def ask(text: str, role: str | None) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(tries):
            try:
                return provider(text, role), None
            except Exception as e:  # noqa: BLE001
                error = type(e).__name__
                if attempt + 1 < tries:
                    time.sleep(wait * (attempt + 1))
        return None, error

    return ask


def classify(df: DataFrame, text_col: str = "text", provider: Review | None = None, tries: int = 3, wait: float = 1.5) -> DataFrame:
    """Adds is_resume, confidence, experience_level and classifier_status. Short texts are told without the provider.

    A provider answers with a label, or with a JSON object of is_resume, confidence_score
    (0-100) and experience_level. What it does not say is null. It gets the first 30,000
    characters, its own documented limit; a text beyond that has the status TRUNCATED in
    place of OK. Failures keep the row and say so.
    """
    short = F.length(trim(F.coalesce(F.col(text_col), F.lit("")))) < LEAST_CHARS
    if provider is None:
        status = F.when(short, "INSUFFICIENT_TEXT").otherwise("NOT_CONFIGURED")
        return df.withColumns({"classifier_status": status, "is_resume": F.lit(False), "confidence": F.lit(None).cast("double"), "experience_level": F.lit(None).cast("string")})
    once = _asked(provider, tries, wait)

    @F.pandas_udf("struct<label:string,error:string>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if text is None else once(text[:MOST_CHARS], None) for text in texts], columns=["label", "error"])

    # the function runs on every row, whatever stands around it, so short texts are taken away first
    told = df.withColumn("_told", ask(F.when(~short, F.col(text_col))))
    answer = F.try_parse_json(F.col("_told.label"))
    given = lambda path, kind: F.try_variant_get(answer, path, kind)
    long = F.length(F.col(text_col)) > MOST_CHARS
    status = F.when(short, "INSUFFICIENT_TEXT").when(F.col("_told.error").isNotNull(), F.concat(F.lit("FAILED: "), F.col("_told.error"))).when(long, "TRUNCATED").otherwise("OK")
    is_resume = F.coalesce(given("$.is_resume", "boolean"), F.lower(F.col("_told.label")) == "resume", F.lit(False))
    return told.withColumns({
        "classifier_status": status, "is_resume": is_resume, "confidence": given("$.confidence_score", "double") / 100.0, "experience_level": given("$.experience_level", "string"),
    }).drop("_told")


def review(df: DataFrame, text_col: str = "text", role: str | None = None, provider: Review | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds payload (JSON text) and review_status from a provider; without one, null and NOT_CONFIGURED.

    Null texts are not asked about. Calls are keyed by the text's hash, so that a task that
    runs again can be told.
    """
    if provider is None:
        return df.withColumn("payload", F.lit(None).cast("string")).withColumn("review_status", F.lit("NOT_CONFIGURED"))
    once = _asked(provider, tries, wait)

    @F.pandas_udf("struct<payload:string,error:string>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if text is None else once(text, role) for text in texts], columns=["payload", "error"])

    told = df.withColumn("_told", ask(F.col(text_col)))
    status = F.when(F.col(text_col).isNull(), "NOT_ASKED").when(F.col("_told.error").isNull(), "OK").otherwise(F.concat(F.lit("FAILED: "), F.col("_told.error")))
    return told.withColumns({"payload": F.col("_told.payload"), "review_status": status, "review_key": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)}).drop("_told")

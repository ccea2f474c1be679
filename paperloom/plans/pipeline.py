"""The two ways through the engine: parsing a resume, and auditing it for a role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import clean, clean_extracted
from paperloom.operators import entities, providers, report, scoring, sections, validate


def process(extracted: DataFrame, id_col: str = "doc_id", raw_col: str = "raw_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned text, quality, completeness, summary and item lists of extracted texts, one row for each row."""
    rows = extracted.select(F.col(id_col), *keep, F.col(raw_col).alias("raw_text")).withColumn("cleaned_text", clean_extracted(F.col("raw_text")))
    own = F.col("cleaned_text")
    quality = sections.resume_heuristic(own)
    flags = sections.completeness(own)
    rows = rows.select("*", sections.overwritten(own).alias("_found"))
    lists = [F.transform(sections.items(n, F.col("_found")[n]), lambda x: F.struct(x["item"].alias("title"), x["proficiency"].alias("proficiency"))).alias(n) for n in sections.ITEM_LISTS]
    return rows.select(
        id_col, *keep, "raw_text", "cleaned_text", F.struct(*[c.alias(k) for k, c in quality.items()]).alias("quality_info"),
        F.create_map(*[x for k, c in flags.items() for x in (F.lit(k), c)]).alias("section_completeness"), F.col("_found")["summary"].alias("summary"), *lists,
    )


def parse_resumes(extracted: DataFrame, id_col: str = "doc_id", classifier: providers.Review | None = None) -> DataFrame:
    """Extracted texts to records: gates, cleaning, lists, entities and classification.

    ``extracted`` has the id, raw_text and is_scanned. Rows that a gate holds back keep an
    error code and have null ``entities``. All of it runs in the scan's own stage: a row's
    text is never joined back to it.
    """
    code = validate.content_status(F.col("raw_text"), F.col("is_scanned"), F.col("quality_info.word_count"))
    done = process(extracted, id_col, keep=("is_scanned",)).withColumn("error_code", code)
    told = providers.classify(done.withColumn("_text", F.col("cleaned_text")), "_text", classifier)
    taken = told.withColumn("_text", F.when(F.col("error_code") == "OK", F.col("_text")))
    found = entities.with_entities(taken.withColumnsRenamed({"summary": "_summary", **{n: f"_{n}" for n in sections.ITEM_LISTS}}), "_text")
    own = F.struct(*[F.col(c) for c in entities.ENTITIES])
    lists = {"summary": "_summary", **{n: f"_{n}" for n in sections.ITEM_LISTS}}
    return found.select(*[F.col(lists.get(c, c)).alias(c) for c in told.columns if c != "_text"], F.when(F.col("error_code") == "OK", own).alias("entities"))


def analyze(extracted: DataFrame, role: str | None = None, keywords: providers.KeywordProvider | None = None, reviewer: providers.Review | None = None, classifier: providers.Review | None = None, id_col: str = "doc_id") -> DataFrame:
    """Extracted texts (id, text, is_scanned, word_count, page_count) to scores and finished reports.

    The score is deterministic. Texts that a gate holds back (too short for an audit, or no
    resume in the classifier's eyes) keep an error code and a null score, and no reviewer is
    asked about them. Without a reviewer the status of the review says so; without a
    classifier all texts pass. A review's payload is repaired where it was cut short,
    grounded in the text, aligned and capped (``report.finished``), and its score is the
    deterministic one.
    """
    terms = (keywords or providers.StaticKeywords()).keywords(role)
    issues = F.col("parsing_issues") if "parsing_issues" in extracted.columns else F.array().cast("array<string>")
    rows = extracted.select(id_col, "is_scanned", "word_count", "page_count", issues.alias("parsing_issues"), clean(F.col("text")).alias("text"))
    code = validate.content_status(F.col("text"), F.col("is_scanned"), F.col("word_count"))
    rows = rows.withColumn("error_code", F.when((code == "OK") & ~validate.audit_ready(F.col("word_count")), "TOO_SHORT_FOR_AUDIT").otherwise(code))
    if classifier is not None:
        rows = providers.classify(rows, provider=classifier)
        refused = (F.col("error_code") == "OK") & F.col("classifier_status").isin("OK", "TRUNCATED") & ~F.col("is_resume")
        rows = rows.withColumn("error_code", F.when(refused, "NOT_A_RESUME").otherwise(F.col("error_code")))
    rows = rows.withColumn("text", F.when(F.col("error_code") == "OK", F.col("text")))
    rows = providers.review(rows, role=role, provider=reviewer)
    rows = report.finished(rows) if reviewer is not None else rows
    kept = tuple(c for c in rows.columns if c not in (id_col, "text", "is_scanned", "page_count", "word_count"))
    scored = scoring.score(rows, terms, id_col, "text", "page_count", "is_scanned", keep=kept)
    ok = F.col("error_code") == "OK"
    own = scored.select(id_col, *kept, *[F.when(ok, F.col(c)).alias(c) for c in scored.columns if c not in (id_col, *kept)])
    return report.with_own_score(own) if reviewer is not None else own

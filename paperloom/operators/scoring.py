"""The deterministic 0-100 compatibility score with its evidence. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions.text import METRIC, WS, block_count, constants, half_even, has_bullet, lines, matched_terms, strip_bullet, word_count
from paperloom.operators import entities, sections


def _share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def contact(email: Column, phone: Column, linkedin: Column, github: Column) -> Column:
    there = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(there(email), 2).otherwise(0) + F.when(there(phone), 2).otherwise(0) + F.when(there(linkedin) | there(github), 1).otherwise(0)


def core_sections(*present: Column) -> Column:
    """Points for the sections that are there, of three."""
    count = sum((F.when(p, 1).otherwise(0) for p in present[1:]), F.when(present[0], 1).otherwise(0))
    return half_even(5 * (count / F.lit(3.0)), 0, 5)


def parsing(is_scanned: Column, words: Column, pages: Column) -> Column:
    """Points for what could be read: no scan, enough words, enough words a page."""
    words, pages = F.coalesce(words, F.lit(0)), F.coalesce(pages, F.lit(0))
    dense = (pages > 0) & (_share(words, pages) >= L.WORDS_A_PAGE)
    return F.when(F.coalesce(is_scanned, F.lit(False)), 0).otherwise(2) + F.when(words >= L.FULL_WORDS, 2).when(words >= L.SOME_WORDS, 1).otherwise(0) + F.when(dense, 1).otherwise(0)


def structure_shares(blocks: Column, bullets: Column, count: Column) -> dict[str, Column]:
    return {"block_ratio": F.least(F.lit(1.0), blocks / F.lit(float(L.FULL_BLOCKS))), "bullet_ratio": F.least(F.lit(1.0), _share(bullets, count) / L.FULL_BULLETS)}


def structure_evidence(text: Column, own: Column | None = None) -> dict[str, Column]:
    """Counts and shares of blocks and bullets. ``own`` are the text's lines, where they are at hand."""
    own = lines(text) if own is None else own
    blocks, bullets, count = block_count(text), F.size(F.filter(own, has_bullet)), F.size(own)
    return {"block_count": blocks, "bullet_count": bullets, "total_content_lines": count, **structure_shares(blocks, bullets, count)}


def structure(e: dict[str, Column]) -> Column:
    return half_even(L.BLOCK_POINTS * e["block_ratio"] + L.BULLET_POINTS * e["bullet_ratio"], 0, 20)


def formatting_shares(length: Column, long_lines: Column, count: Column) -> dict[str, Column]:
    average, share = _share(length, count), _share(long_lines, count)
    band = F.when(average < L.LEAST_LENGTH, float(L.LEAST_LENGTH)).otherwise(float(L.MOST_LENGTH))
    return {
        "avg_line_length": average, "long_line_ratio": share,
        "length_ratio": F.when(count == 0, 0.0).when(average.between(L.LEAST_LENGTH, L.MOST_LENGTH), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(average - band) / band)),
        "long_line_score_ratio": F.when(count == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - share / L.MOST_LONG)),
    }


def total_length(own: Column) -> Column:
    return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))


def formatting_evidence(text: Column, own: Column | None = None) -> dict[str, Column]:
    own = lines(text) if own is None else own
    long_lines = F.size(F.filter(own, lambda x: F.length(x) > L.LONG_LINE))
    return {"long_line_count": long_lines, **formatting_shares(total_length(own), long_lines, F.size(own))}


def formatting(e: dict[str, Column]) -> Column:
    return half_even(L.LENGTH_POINTS * e["length_ratio"] + L.LONG_POINTS * e["long_line_score_ratio"], 0, 15)


def keywords_evidence(text: Column, terms: list[str]) -> dict[str, Column]:
    """Matched and missing keywords of a provider's list, sorted."""
    terms = sorted({t.lower() for t in terms if t})
    every = constants(terms)
    empty = F.array().cast("array<string>")
    blank = F.coalesce(text == "", F.lit(True))
    found = F.when(blank, empty).otherwise(matched_terms(text, terms)) if terms else empty
    return {
        "matched_keywords": found, "missing_keywords": F.when(blank, empty).otherwise(F.array_sort(F.array_except(every, found))), "total_keywords": F.when(blank, 0).otherwise(len(terms)),
        "match_count": F.size(found), "coverage_ratio": F.size(found) / F.lit(float(max(1, len(terms)))),
    }


def keywords(e: dict[str, Column]) -> Column:
    return half_even(25 * F.least(F.lit(1.0), e["match_count"] / F.lit(float(L.FULL_KEYWORDS))), 0, 25)


def opens_with_verb(line: Column) -> Column:
    """Whether a line's first word is a verb of achievement."""
    first = F.lower(F.btrim(F.split(strip_bullet(line), f"{WS}+")[0], F.lit(".,;:!()")))
    return F.array_contains(constants(L.ACTION_VERBS), first)


def achievement_shares(metrics: Column, verbs: Column, count: Column) -> dict[str, Column]:
    return {"metric_ratio": F.least(F.lit(1.0), _share(metrics, count) / L.FULL_METRICS), "verb_ratio": F.least(F.lit(1.0), _share(verbs, count) / L.FULL_VERBS)}


def achievements_evidence(text: Column, own: Column | None = None) -> dict[str, Column]:
    own = lines(text) if own is None else own
    metrics, verbs, count = F.size(F.filter(own, lambda x: x.rlike(METRIC))), F.size(F.filter(own, opens_with_verb)), F.size(own)
    return {"metric_hits": metrics, "verb_hits": verbs, "achievement_total_lines": count, **achievement_shares(metrics, verbs, count)}


def achievements(e: dict[str, Column]) -> Column:
    return half_even(L.METRIC_POINTS * e["metric_ratio"] + L.VERB_POINTS * e["verb_ratio"], 0, 25)


def weakest(points: dict[str, Column]) -> Column:
    """The category with the lowest share of its points; of equal ones the first."""
    ranked = [F.struct((points[k] / F.lit(float(m))).alias("share"), F.lit(i).alias("place"), F.lit(k).alias("category")) for i, (k, m) in enumerate(L.MAXIMA.items())]
    return F.array_min(F.array(*ranked))["category"]


def reason(points: dict[str, Column]) -> Column:
    """A sentence that names the weakest category."""
    low = weakest(points)
    earned = F.element_at(F.create_map(*[x for k in L.MAXIMA for x in (F.lit(k), points[k])]), low)
    most = F.element_at(F.create_map(*[x for k, m in L.MAXIMA.items() for x in (F.lit(k), F.lit(m))]), low)
    return F.format_string("Weakest category: %s, %d of %d points.", F.replace(low, F.lit("_"), F.lit(" ")), earned, most)


def score(df: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", pages_col: str | None = None, scanned_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score, its five parts, the reason and all evidence of each text, one row for each row.

    Null texts score as empty ones. Entities are looked for in the text and its sections.
    Columns named in ``keep`` come along. Nothing is joined or shuffled.
    """
    own = df.select(
        F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(pages_col) if pages_col else F.lit(1)).alias("pages"),
        (F.col(scanned_col) if scanned_col else F.lit(False)).alias("scanned"), *[F.col(k).alias(f"_kept_{k}") for k in keep],
    )
    own = own.withColumn("_found", sections.appended(F.col("text")))
    text, lines_ = F.col("text"), F.col("own")
    # evidence is laid down step by step, so that nothing is worked out twice: the lines of a
    # text, what is counted in them, and the shares of the counts
    own = own.withColumn("own", lines(text))
    found = {
        "email_present": entities.email(text).isNotNull(), "phone_present": entities.phone(text).isNotNull(), "linkedin_present": entities.link(text, entities.LINKEDIN).isNotNull(),
        "github_present": entities.link(text, entities.GITHUB).isNotNull(), "work_experience_present": entities.has_experience(F.col("_found")["experience"]), "education_present": entities.has_education(F.col("_found")["education"]),
        "skills_present": F.size(entities.skills(text)) > 0, "word_count": word_count(text), "matched_keywords": keywords_evidence(text, terms)["matched_keywords"],
    }
    counted = structure_evidence(text, lines_) | formatting_evidence(text, lines_) | achievements_evidence(text, lines_)
    counts = ("block_count", "bullet_count", "total_content_lines", "long_line_count", "metric_hits", "verb_hits")
    rows = own.select(id_col, *[f"_kept_{k}" for k in keep], "pages", "scanned", (text == "").alias("_blank"), total_length(lines_).alias("_length"), *[c.alias(k) for k, c in found.items()], *[counted[k].alias(k) for k in counts])
    c = {k: F.col(k) for k in counts}
    n, every = c["total_content_lines"], sorted({t.lower() for t in terms if t})
    listed = constants(every)
    shares = structure_shares(c["block_count"], c["bullet_count"], n) | formatting_shares(F.col("_length"), c["long_line_count"], n) | achievement_shares(c["metric_hits"], c["verb_hits"], n)
    shares |= {
        "achievement_total_lines": n, "missing_keywords": F.when(F.col("_blank"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(listed, "matched_keywords"))),
        "total_keywords": F.when(F.col("_blank"), 0).otherwise(len(every)), "match_count": F.size("matched_keywords"), "coverage_ratio": F.size("matched_keywords") / F.lit(float(max(1, len(every)))),
    }
    rows = rows.select("*", *[v.alias(k) for k, v in shares.items()])
    evidence = [*found, *counts, *shares]
    e = {k: F.col(k) for k in evidence}
    flag = lambda k: F.when(e[k], "x").otherwise("")
    parts = {
        "contact": contact(flag("email_present"), flag("phone_present"), flag("linkedin_present"), flag("github_present")),
        "sections": core_sections(e["work_experience_present"], e["education_present"], e["skills_present"]),
        "parsing": parsing(F.col("scanned"), e["word_count"], F.col("pages")),
        "formatting": formatting(e), "keywords": keywords(e), "structure": structure(e), "achievements": achievements(e),
    }
    rows = rows.select("*", *[c.alias(k) for k, c in parts.items()])
    rows = rows.withColumn("ats_compatibility", F.least(F.lit(15), F.col("contact") + F.col("sections") + F.col("parsing")))
    points = {k: F.col(k) for k in L.MAXIMA}
    total = sum(points.values(), F.lit(0))
    return rows.select(id_col, *[F.col(f"_kept_{k}").alias(k) for k in keep], F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("score"), *[F.col(k) for k in (*parts, "ats_compatibility")], weakest(points).alias("weakest"), reason(points).alias("reason"), *evidence)


def serialized(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, evidence): all that was measured, as JSON text without loss."""
    return scored.select(id_col, F.to_json(F.struct(*[c for c in scored.columns if c != id_col]), {"ignoreNullFields": "false"}).alias("evidence"))

"""All queries of the core over whole tables. ``oracles`` holds the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions import text as X
from paperloom.operators import entities, layout, nesting, providers, report, scoring, sections, validate
from paperloom.plans import pipeline
from paperloom.session import table
from paperloom.sources import cache, files
from paperloom.streaming import uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "parsed_resumes")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): the resumes' texts as they are analysed."""
    return resumes(spark, sf).select("doc_id", X.clean(F.col("raw_text")).alias("text"))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): the resumes' texts as they are parsed."""
    return resumes(spark, sf).select("doc_id", X.clean_extracted(F.col("raw_text")).alias("text"))


def _keywords(spark: SparkSession, sf: str) -> list[str]:
    return providers.TableKeywords(table(spark, sf, "keywords")).keywords()


def _longs(**columns: Column) -> list[Column]:
    return [c.cast("bigint").alias(k) for k, c in columns.items()]


# ---- nested records ----


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nesting.find_children(resumes(spark, sf), table(spark, sf, "audits"))


@query
def p6_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return nesting.bridge(resumes(spark, sf), table(spark, sf, "audits"))


@query
def p6_objects(spark: SparkSession, sf: str) -> DataFrame:
    return nesting.objects(p6_bridge(spark, sf))


# ---- text ----


@query
def content_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = F.coalesce("raw_text", F.lit(""))
    return resumes(spark, sf).select("doc_id", *_longs(line_count=F.size(X.lines(c)), word_count=X.word_count(c), block_count=X.block_count(c)))


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf)


@query
def dehyphenate_clean(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf)


@query
def corrupted_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.is_corrupted(F.col("text")).alias("corrupted"))


@query
def strip_bullets(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaned(spark, sf).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), X.strip_bullet(F.col("line")).alias("line"), scoring.opens_with_verb(F.col("line")).alias("verb"))


# ---- gates ----


@query
def file_validation(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "uploads").dropDuplicates(["upload_id"])
    status = validate.file_status(F.col("path"), F.col("n_bytes"), F.col("head_bytes"))
    strict = validate.size_mb(F.col("n_bytes"), rounded=False) > L.MOST_MB
    return u.select("upload_id", validate.extension(F.col("path")).alias("ext"), validate.size_mb(F.col("n_bytes")).alias("size_mb"), status.alias("error_code"), strict.alias("over_strict_limit"))


@query
def content_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = validate.validated_contents(resumes(spark, sf))
    return out.select("doc_id", "error_code", F.col("word_count").cast("bigint").alias("word_count"), "audit_ready")


# ---- entities ----


@query
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return cleaned(spark, sf).select("doc_id", entities.email(t).alias("email"), entities.phone(t).alias("phone"), entities.link(t, entities.LINKEDIN).alias("linkedin"), entities.link(t, entities.GITHUB).alias("github"))


@query
def names(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf).select("doc_id", entities.name(F.col("text")).alias("name"))


@query
def skills(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf).select("doc_id", F.explode(entities.skills(F.col("text"))).alias("skill"))


@query
def links(spark: SparkSession, sf: str) -> DataFrame:
    """Web addresses in a resume's text and in those of its publications."""
    told = F.array_join(F.transform(F.coalesce("publications", F.array()), lambda p: p["url"]), " ")
    text = F.concat_ws(" ", F.coalesce("raw_text", F.lit("")), told)
    rows = resumes(spark, sf).select("doc_id", files.links(text).alias("links"))
    return rows.select("doc_id", F.posexplode("links").alias("pos", "url")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "url")


@query
def sections_append(spark: SparkSession, sf: str) -> DataFrame:
    return sections.split_appending(cleaned(spark, sf))


@query
def sections_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return sections.split_overwriting(extracted(spark, sf))


@query
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return sections.summaries(cleaned(spark, sf))


@query
def completeness_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = sections.completeness(F.col("text"))
    return extracted(spark, sf).select("doc_id", *[c.alias(k) for k, c in flags.items()])


@query
def structured_items(spark: SparkSession, sf: str) -> DataFrame:
    out = sections.structured_items(extracted(spark, sf))
    return out.select("doc_id", "list_name", F.col("pos").cast("bigint").alias("pos"), "item", "proficiency")


@query
def resume_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    h = sections.resume_heuristic(F.col("text"))
    whole = ("word_count", "char_count", "section_words")
    return extracted(spark, sf).select("doc_id", *[(c.cast("bigint") if k in whole else c).alias(k) for k, c in h.items()])


@query
def work_experience(spark: SparkSession, sf: str) -> DataFrame:
    rows = sections.split_appending(cleaned(spark, sf)).where("section = 'experience'")
    return rows.select("doc_id", F.posexplode(entities.work_experience("section_text")).alias("pos", "e")).select("doc_id", "pos", "e.title", "e.company", "e.dates", "e.bullets")


@query
def education(spark: SparkSession, sf: str) -> DataFrame:
    rows = sections.split_appending(cleaned(spark, sf)).where("section = 'education'")
    return rows.select("doc_id", F.posexplode(entities.education("section_text")).alias("pos", "e")).select("doc_id", "pos", "e.degree", "e.institution", "e.cgpa", "e.dates")


@query
def projects(spark: SparkSession, sf: str) -> DataFrame:
    out = entities.projects(cleaned(spark, sf))
    return out.select("doc_id", F.col("project_no").cast("bigint").alias("project_no"), "project_name", "description")


@query
def certification_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = sections.split_appending(cleaned(spark, sf)).where("section = 'certifications'")
    return rows.select("doc_id", F.posexplode(entities.certifications(F.col("section_text"))).alias("pos", "line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query
def parse_all(spark: SparkSession, sf: str) -> DataFrame:
    return entities.parse_all(cleaned(spark, sf))


@query
def parse_resumes(spark: SparkSession, sf: str) -> DataFrame:
    rows = resumes(spark, sf).select("doc_id", "raw_text", F.col("validation_info.is_scanned").alias("is_scanned"))
    return pipeline.parse_resumes(rows).drop("raw_text", "cleaned_text")


@query
def analyze(spark: SparkSession, sf: str) -> DataFrame:
    rows = resumes(spark, sf).select("doc_id", F.col("raw_text").alias("text"), F.col("validation_info.is_scanned").alias("is_scanned"), X.word_count(F.col("raw_text")).alias("word_count"), F.lit(1).alias("page_count"))
    return pipeline.analyze(rows, None, providers.TableKeywords(table(spark, sf, "keywords")))


# ---- scores ----


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = resumes(spark, sf).select("doc_id", X.clean(F.col("raw_text")).alias("text"), F.col("validation_info.is_scanned").alias("is_scanned"))
    return scoring.score(rows, _keywords(spark, sf), scanned_col="is_scanned")


_PARTS = ("score", "formatting", "keywords", "structure", "achievements", "ats_compatibility", "contact", "sections", "parsing")


@query
def ats_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("doc_id", *[F.col(k).cast("bigint").alias(k) for k in _PARTS], "weakest")


@query
def ats_evidence(spark: SparkSession, sf: str) -> DataFrame:
    counts = ("block_count", "bullet_count", "total_content_lines", "long_line_count", "match_count", "total_keywords", "metric_hits", "verb_hits", "word_count")
    ratios = ("avg_line_length", "long_line_ratio", "length_ratio", "long_line_score_ratio", "block_ratio", "bullet_ratio", "metric_ratio", "verb_ratio", "coverage_ratio")
    flags = ("email_present", "phone_present", "linkedin_present", "github_present", "work_experience_present", "education_present", "skills_present")
    return _scored(spark, sf).select("doc_id", *[F.col(k).cast("bigint").alias(k) for k in counts], *ratios, *flags)


@query
def evidence_json(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence as JSON text, and what is read from it again."""
    rows = scoring.serialized(_scored(spark, sf))
    read = lambda k: F.get_json_object("evidence", f"$.{k}")
    return rows.select("doc_id", *_longs(score=read("score"), match_count=read("match_count"), word_count=read("word_count")), read("bullet_ratio").cast("double").alias("bullet_ratio"), read("email_present").cast("boolean").alias("email_present"))


@query
def ats_reason(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("doc_id", "reason")


@query
def skill_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matched keywords of the provider's table."""
    return cleaned(spark, sf).select("doc_id", F.explode(scoring.keywords_evidence(F.col("text"), _keywords(spark, sf))["matched_keywords"]).alias("keyword"))


@query
def score_check(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores whose parts are out of bounds or do not add up."""
    s = table(spark, sf, "scores").dropDuplicates(["score_id"])
    total = sum((F.coalesce(k, F.lit(0)) for k in L.MAXIMA), F.lit(0))
    out_of = F.lit(False)
    for k, m in L.MAXIMA.items():
        out_of = out_of | ~F.coalesce(F.col(k).between(0, m), F.lit(False))
    rows = s.select("score_id", total.cast("bigint").alias("total"), out_of.alias("out_of_bounds"), F.coalesce(F.col("score") != total, F.lit(True)).alias("differs"))
    return rows.where("out_of_bounds or differs")


# ---- layout ----


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with blocks, laid out by the numbers of order lines."""
    li = table(spark, sf, "lineitem")
    x = (F.pmod("l_partkey", F.lit(7)) * 20).cast("double")
    y = (F.pmod("l_suppkey", F.lit(11)) * 30).cast("double")
    block = F.struct(x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 24).alias("y1"), F.when(F.col("l_quantity") < 4, " ").otherwise(F.col("l_returnflag")).alias("text"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.pmod("l_linenumber", F.lit(2)).alias("page_no"), block.alias("block"), "l_linestatus")
    return rows.groupBy("doc_id", "page_no").agg(F.lit(400.0).alias("page_height"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linestatus")), lambda s: F.when(s == "O", "· x").otherwise("x")), "\n").alias("text"), (F.max("block.x0") >= 120).alias("has_ruled_table"), F.collect_list("block").alias("blocks"))


@query
def layout_columns(spark: SparkSession, sf: str) -> DataFrame:
    filled = F.filter("blocks", lambda b: X.trim(b["text"]) != "")
    return _pages(spark, sf).select("doc_id", F.col("page_no").cast("bigint").alias("page_no"), F.size(layout.columns(filled)).cast("bigint").alias("clusters"))


@query
def layout_issues(spark: SparkSession, sf: str) -> DataFrame:
    out = layout.document_issues(_pages(spark, sf))
    return out.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "issue_type", "severity", "confidence", F.array_join("affected_pages", ",").alias("affected_pages"))


# ---- reports ----


def _audits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "audits").dropDuplicates(["audit_id"])


def _payloads(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return _audits(spark, sf).select("audit_id", *more, "resume_text", report.parsed(F.col("payload")).alias("v")).where("v is not null")


_BREAKDOWN = "$.explainable_scorecard.ats_score.breakdown"


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, matrix): evidence rows made of a resume's stored scores, read from JSON text as a payload is."""
    s = table(spark, sf, "scores").dropDuplicates(["score_id"]).where("doc_id is not null")
    status = F.when(F.col("score").isNull(), " Not Found").when(F.col("score") < 40, "LIMITED").when(F.col("score") < 55, "Partial").when(F.col("score") < 70, "Mentioned Once").otherwise("Verified")
    row = F.struct("score_id", F.coalesce("target_role", F.lit("any")).alias("requirement"), status.alias("status"), F.coalesce("reason", F.lit("")).alias("evidence_note"))
    own = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("recruiter_evidence_matrix"))
    return own.select("doc_id", report.matrix_of(F.try_parse_json(F.to_json(F.struct("recruiter_evidence_matrix")))).alias("matrix"))


@query
def red_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _matrix(spark, sf)
    return rows.select("doc_id", report.red_flag_rows(F.transform("matrix", lambda x: x["status"])).cast("bigint").alias("red_flags"))


@query
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence rows with their mark, and notes that repetitions carry their requirement in."""
    rows = _matrix(spark, sf).select("doc_id", report.unique_matrix(F.col("matrix")).alias("m"), report.unique_matrix(F.col("matrix"), "", ": ", keep_blank=True).alias("shown"))
    flat = rows.select("doc_id", "shown", F.posexplode("m").alias("pos", "row"))
    return flat.select("doc_id", F.col("pos").cast("bigint").alias("pos"), report.status_mark(F.col("row.status")).alias("mark"), F.col("row.evidence_note").alias("note"), F.get("shown", "pos")["evidence_note"].alias("shown_note"))


def _capped(payloads: DataFrame, matrix: Column) -> DataFrame:
    part = lambda k: F.coalesce(F.try_variant_get("v", f"{_BREAKDOWN}.{k}", "int"), F.lit(0))
    total = F.greatest(F.lit(0), F.least(F.lit(100), sum((part(k) for k in L.MAXIMA), F.lit(0))))
    get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    cap, chance = report.caps(get("eligibility_check.status"), report.red_flag_rows(F.transform(matrix, lambda x: x["status"])))
    score = report.capped_score(get("explainable_scorecard.overall_hiring_score.score"), cap)
    probability = report.capped_probability(get("explainable_scorecard.overall_hiring_score.interview_probability"), chance)
    return payloads.select("audit_id", *_longs(ats_score=total, overall_score=score), probability.alias("interview_probability"))


@query
def score_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned and capped scores. Red flags are those of the payload's matrix."""
    return _capped(_payloads(spark, sf), report.matrix_of(F.col("v")))


@query
def score_caps_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same where the resume's stored scores make up an evidence matrix beside the payload's."""
    rows = _payloads(spark, sf, "doc_id").join(_matrix(spark, sf), "doc_id", "left")
    return _capped(rows, F.concat(report.matrix_of(F.col("v")), F.coalesce("matrix", F.array().cast(report.MATRIX))))


@query
def aligned_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score as the sum of whatever parts a breakdown has."""
    parts = F.try_variant_get("v", _BREAKDOWN, "map<string,variant>")
    return _payloads(spark, sf).select("audit_id", report.aligned_score(parts).cast("bigint").alias("score"))


@query
def score_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether scores and the explanation of a payload keep to their bounds."""
    categories = report.categories_of(F.col("v"))
    return _payloads(spark, sf).select("audit_id", report.valid_report(F.col("v")).alias("valid"), F.coalesce(F.size(F.map_keys(categories)), F.lit(0)).cast("bigint").alias("categories"), report.within_bounds(categories).alias("explanation_within_bounds"))


@query
def merged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Audits with their resume's deterministic score in place of the payload's."""
    told = _payloads(spark, sf, "doc_id").select("audit_id", "doc_id", F.try_variant_get("v", "$.explainable_scorecard.ats_score.score", "int").alias("score"))
    return report.merged_score(told, _scored(spark, sf)).select("audit_id", *_longs(score=F.col("score"), keywords=F.col("keywords")))


@query
def section_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve flags that a resume's record says, false where it says nothing."""
    flags = report.section_flags(F.col("section_completeness"))
    return resumes(spark, sf).select("doc_id", flags.alias("f")).select("doc_id", *[F.col("f")[k].alias(k) for k in L.FLAGS])


@query
def plan_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """All items of an action plan in order, without repetitions; blanks stay."""
    parts = [F.coalesce(F.try_variant_get("v", f"$.priority_action_plan.{k}", "array<string>"), F.array().cast("array<string>")) for k in ("immediate_fixes_today", "short_term_this_week", "long_term_this_month", "immediate_fixes_today")]
    rows = _payloads(spark, sf).select("audit_id", F.posexplode(report.distinct_items(F.concat(*parts))).alias("pos", "item"))
    return rows.select("audit_id", F.col("pos").cast("bigint").alias("pos"), "item")


@query
def finished_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Whole reports made of stored payloads, repaired, grounded, capped and filled."""
    rows = report.finished(_audits(spark, sf).select("audit_id", "payload", F.col("resume_text").alias("text")))
    return rows.where("report is not null").select("audit_id", "report.*")


# ---- lints ----


@query
def lint_keywords(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "keywords").where("target_role is not null").withColumn("report", F.lit(1).cast("bigint"))
    return report.keyword_in_several_classes(rows, "report", "keyword", "target_role")


@query
def lint_ranks(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scores").dropDuplicates(["score_id"]).where("doc_id is not null")
    rows = s.groupBy("doc_id").agg(F.collect_list((F.pmod("score_id", F.lit(3)) + 1).cast("int")).alias("ranks"))
    return rows.select("doc_id", report.ranks_complete(F.col("ranks"), 3).alias("complete"))


@query
def lint_notes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scores").dropDuplicates(["score_id"]).where("doc_id is not null and reason is not null")
    return report.repeated_notes(s, "doc_id", "reason")


@query
def lint_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Resumes with another number of awards than of certifications, as reviews are held against projects."""
    rows = resumes(spark, sf)
    return report.reviews_match(rows.select("doc_id", F.explode("awards")), rows.select("doc_id", F.explode("certifications")), "doc_id")


@query
def safe_defaults(spark: SparkSession, sf: str) -> DataFrame:
    d = report.safe_defaults(F.col("v"))
    return _payloads(spark, sf).select("audit_id", *[d[k].alias(k) for k in ("eligibility_status", "eligibility_title", "is_resume", "confidence_score", "detected_doc_type")], *[F.size(d[k]).cast("bigint").alias(k) for k in ("verified_strengths", "recruiter_evidence_matrix")])


@query
def plan_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _payloads(spark, sf).select("audit_id", report.plan_items(F.try_variant_get("v", "$.priority_action_plan.immediate_fixes_today", "array<string>")).alias("items"))
    return rows.select("audit_id", F.posexplode("items").alias("pos", "item")).select("audit_id", F.col("pos").cast("bigint").alias("pos"), "item")


@query
def coercions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.try_variant_get("v", "$.explainable_scorecard.ats_score.score", "string")
    p = F.try_variant_get("v", "$.explainable_scorecard.overall_hiring_score.interview_probability", "string")
    e = F.try_variant_get("v", "$.eligibility_check.status", "string")
    return _payloads(spark, sf).select("audit_id", report.safe_number(s).alias("number"), report.fraction(report.safe_number(s)).alias("fraction"), report.safe_string(p).alias("text"), report.level(e).alias("level"))


@query
def keyword_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords of an audit's role and of no role, after those that its text holds moved to the strong ones.

    All keywords for an audit without a role. Those of ten letters and more are strong from the start.
    """
    own = providers.TableKeywords(table(spark, sf, "keywords"))  # checked to be few
    roles = [r for r in own.by_role if r is not None]
    lists = F.expr("map(" + ", ".join(f"{X.quoted(r)}, array({', '.join(map(X.quoted, own.keywords(r)))})" for r in roles) + ")")
    role = F.lower(X.trim(F.col("target_role")))
    rows = _audits(spark, sf).where("resume_text is not null").select("audit_id", "resume_text", F.when(role.isNull(), X.constants(own.keywords())).otherwise(F.coalesce(F.element_at(lists, role), X.constants(sorted(own.by_role.get(None, set()))))).alias("missing"))
    given = F.filter("missing", lambda k: F.length(k) >= 10)
    missing, strong = report.keyword_grounding(F.col("missing"), given, F.col("resume_text"))
    return rows.select("audit_id", F.array_join(missing, "|").alias("missing"), F.array_join(strong, "|").alias("strong"))


@query
def metric_grounding(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.try_variant_get("v", "$.explainable_scorecard.technical_depth.reason", "string")
    return _payloads(spark, sf).select("audit_id", report.grounded_metrics(depth, F.coalesce("resume_text", F.lit(""))).alias("rewrite"))


@query
def unique_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "scores").dropDuplicates(["score_id"]).where("reason is not null and doc_id is not null")
    tagged = rows.select("doc_id", F.col("score_id").alias("pos"), F.col("reason").alias("note"), F.coalesce("target_role", F.lit("any")).alias("requirement"))
    return report.unique_notes(tagged, "doc_id").select("doc_id", "pos", "note")


@query
def json_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _audits(spark, sf).where("payload is not null").select("audit_id", report.clean_json(F.col("payload")).alias("payload"))


@query
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    fixed = report.repaired_json("payload")
    return _audits(spark, sf).where("payload is not null").select("audit_id", fixed.alias("payload")).select("audit_id", "payload", F.try_parse_json("payload").isNotNull().alias("valid"))


# ---- corpus ----


@query
def dedup_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    return keyed.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Audits of resumes that no earlier audit of the same text and role covers."""
    keyed = _audits(spark, sf).where("resume_text is not null").select("audit_id", "payload", cache.cache_key(F.col("resume_text"), F.col("target_role")).alias("cache_key"))
    cached = keyed.where(F.try_parse_json("payload").isNotNull()).select("cache_key", F.col("payload").alias("report"))
    return cache.lookup(keyed, cached)[1].select("audit_id")


@query
def uploads_per_account(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming rollup, run over the whole table."""
    u = table(spark, sf, "uploads").dropDuplicates(["upload_id"]).where("received_at is not null")
    return uploads.per_account(u)


@query
def uploads_checked(spark: SparkSession, sf: str) -> DataFrame:
    u = uploads.checked(table(spark, sf, "uploads")).dropDuplicates(["upload_id"])
    return u.groupBy("error_code").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))


@query
def ext_corpus_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: resumes and words by kind of file and account, with totals."""
    rows = resumes(spark, sf).select(F.lower("file_type").alias("file_type"), "account", F.coalesce("quality_info.word_count", F.lit(0)).cast("bigint").alias("words"))
    out = rows.rollup("file_type", "account").agg(F.count("*").alias("resumes"), F.sum("words").alias("words"), F.grouping_id().cast("bigint").alias("level"))
    return out.select("file_type", "account", "resumes", "words", "level")


@query
def ext_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: the three best scores of each role; of equal ones the earlier."""
    s = table(spark, sf, "scores").dropDuplicates(["score_id"]).where("score is not null and target_role is not null")
    # the rank is held against a number, so each task keeps three rows of a role before the shuffle
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("target_role").orderBy(F.desc("score"), "score_id"))).where("rank <= 3")
    return ranked.select("target_role", (F.col("rank") - 1).cast("bigint").alias("place"), "score_id", F.col("score").cast("bigint").alias("score"))


from paperloom.plans.oracles import ORACLES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]

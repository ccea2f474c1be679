"""Deterministic treatment of audit reports kept as JSON: repair, grounding, caps, defaults, deduplication."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import lexicon as L
from paperloom.functions.text import WS, trim

# ---- JSON text ----


def clean_json(text: Column) -> Column:
    """JSON text without fences, what stands around the outermost braces, and commas before closing ones."""
    text = F.regexp_replace(F.regexp_replace(text, rf"(?i)```json{WS}*", ""), rf"```{WS}*\z", "")
    inner = F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))
    text = F.regexp_replace(F.coalesce(inner, text), r"[\r\n\t]+", " ")
    return trim(F.regexp_replace(text, rf",{WS}*([\]}}])", "$1"))


#: What tells the shape of JSON text: strings, of which the last may lack its end, and signs outside them.
_JSON_MARK = re.compile(r'"(?:[^"\\]|\\.)*+(?P<end>"?)|[{}\[\],]', re.S)
_ENDS = {"{": "}", "[": "]"}


def repair(text: str | None) -> str | None:
    """A cut JSON object, closed: back to the last comma where a string was left open, then all brackets shut.

    Text without an object gives None; a complete object comes out as it is.
    """
    _, brace, rest = (text or "").partition("{")
    if not brace:
        return None
    own = (brace + rest).rstrip()
    waiting: list[str] = []
    safe, then = 0, ""  # where the last comma outside strings stands, and what closes the text before it
    for m in _JSON_MARK.finditer(own):
        sign = m.group()
        if sign[0] == '"' and not m["end"]:
            own, waiting = own[:safe], [then]
            break
        if sign in _ENDS:
            waiting.insert(0, _ENDS[sign])
        elif sign == ",":
            safe, then = m.start(), "".join(waiting)
        elif sign in "}]" and waiting:
            del waiting[0]
    return own.rstrip().rstrip(",") + "".join(waiting)


@F.pandas_udf(T.StringType())
def repaired_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(repair)


def parsed(text: Column) -> Column:
    """The payload as a variant, cleaned, and taken out of an "analysis" key; null where it is no object."""
    whole = F.try_parse_json(clean_json(text))
    inner = F.try_variant_get(whole, "$.analysis", "variant")
    return F.coalesce(F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner), F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole))


# ---- grounding in the resume ----


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def grounded(term: Column, text: Column) -> Column:
    """Whether a term stands literally in a text, not beside a word character or one of . + #"""
    edge = r"[\p{L}\p{N}_.+#]"
    return F.rlike(F.lower(text), F.concat(F.lit(f"(?<!{edge})"), _quoted(F.lower(trim(term))), F.lit(f"(?!{edge})")))


def keyword_grounding(missing: Column, strong: Column, text: Column) -> tuple[Column, Column]:
    """Missing and strong keywords after those that the text holds moved from the former to the latter.

    Blank keywords go. Without a text nothing moves. What was repeated in ``strong`` stays so.
    """
    named = F.filter(F.coalesce(missing, F.array().cast("array<string>")), lambda k: trim(k) != "")
    strong = F.coalesce(strong, F.array().cast("array<string>"))
    found = F.filter(named, lambda k: grounded(k, text))
    blank = F.coalesce(text == "", F.lit(True))
    return F.when(blank, missing).otherwise(F.filter(named, lambda k: ~grounded(k, text))), F.when(blank, strong).otherwise(F.concat(strong, F.array_except(F.array_distinct(found), strong)))


# Forms of metrics.
_METRIC = re.compile(
    r"\$\s?\d[\d,]*(?:\.\d+)?\s?[kmb]?\b|\b\d[\d,]*(?:\.\d+)?\s?%|\b\d[\d,]*(?:\.\d+)?\s?(?:ms|milliseconds)\b|\b\d[\d,]*(?:\.\d+)?\s?x\b|\b\d[\d,]*(?:\.\d+)?\s?(?:seconds|secs|sec)\b", re.I
)
_LABELLED = re.compile(r"\b(BLEU|ROUGE|F1[- ]?score|F1|mAP|IoU|AUC|ROC[- ]?AUC|RMSE|MAE|R2|R\^2|precision|recall|accuracy)\s*(?:score|of|[:=])?\s*\d+(?:\.\d+)?%?", re.I)


# Units of metrics and the names of their placeholders.
def metric_placeholder(token: str) -> str:
    """Placeholder of a number by its unit."""
    low = token.strip().lower()
    rules = ((low.startswith("$"), "$ Value"), (low.endswith("%"), "%"), ("ms" in low or "millisecond" in low, "Latency"), (low.endswith("x"), "Multiplier"), ("sec" in low, "Duration"))
    return f"[Insert {next((name for fits, name in rules if fits), 'Metric')}]"


def label_placeholder(label: str) -> str:
    """Placeholder of a labelled metric by its name."""
    key = label.strip().lower().replace(" ", "").replace("-", "")
    return f"[Insert {L.METRIC_NAMES.get(key, label.strip().title())}]"


def ground_metrics(rewrite: str | None, text: str | None) -> str | None:
    """A rewrite in which numbers that the resume lacks are placeholders. Any literal occurrence counts."""
    if not rewrite or not text:
        return rewrite
    low = text.lower()
    held = lambda m: m.group().strip().lower() in low
    out = _METRIC.sub(lambda m: m.group() if held(m) else metric_placeholder(m.group()), rewrite)
    return _LABELLED.sub(lambda m: m.group() if held(m) else label_placeholder(m.group(1)), out)


@F.pandas_udf(T.StringType())
def grounded_metrics(rewrites: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([ground_metrics(a, b) for a, b in zip(rewrites, texts)], dtype=object)


# ---- scores and caps ----


def aligned_score(breakdown: Column) -> Column:
    """The score as the sum of its parts, of a map of variants; parts that are no numbers count 0. Null without a breakdown."""
    parts = F.transform(F.map_values(breakdown), lambda x: F.coalesce(F.try_variant_get(x, "$", "int"), F.lit(0)))
    return F.when(breakdown.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(parts, F.lit(0), lambda total, x: total + x))))


def red_flag_rows(statuses: Column) -> Column:
    """How many statuses of the evidence rows are red flags."""
    return F.size(F.filter(F.coalesce(statuses, F.array().cast("array<string>")), lambda s: F.lower(trim(s)).isin(L.RED_FLAGS)))


def caps(eligibility: Column, flags: Column) -> tuple[Column, Column]:
    """Caps of the overall score and of the probability, or null. A failed eligibility comes first."""
    failed = F.coalesce(F.upper(trim(eligibility)) == "FAILED", F.lit(False))
    many = flags >= L.RED_FLAG_ROWS
    return tuple(F.when(failed, L.FAILED_CAP[i]).when(many, L.RED_CAP[i]) for i in (0, 1))  # type: ignore[return-value]


def capped_score(score: Column, cap: Column) -> Column:
    """A score under its cap; one that is no number is the cap."""
    number = score.try_cast("int")
    return F.when(cap.isNull(), number).otherwise(F.coalesce(F.least(number, cap), cap))


def capped_probability(probability: Column, cap: Column) -> Column:
    """A probability as text, or "<= cap%" where it is blank, has no number, or one above the cap."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(probability, F.lit("")), F.lit(r"(\p{Nd}+(?:\.\p{Nd}+)?)"), 1), lambda x: x.cast("double"))
    over = (F.size(numbers) == 0) | (F.array_max(numbers) > cap)
    return F.when(cap.isNull(), probability).when(F.coalesce(over, F.lit(True)), F.concat(F.lit("<= "), cap.cast("string"), F.lit("%"))).otherwise(probability)


# ---- defaults, coercions, deduplication ----


def section_flags(given: Column) -> Column:
    """The twelve flags of a map, false where it says nothing."""
    return F.create_map(*[x for k in L.FLAGS for x in (F.lit(k), F.coalesce(F.element_at(given, F.lit(k)), F.lit(False)))])


def safe_defaults(payload: Column) -> dict[str, Column]:
    """Fields of a variant payload with what stands where they are missing."""
    text = lambda path: F.try_variant_get(payload, path, "string")
    status = F.nullif(text("$.eligibility_check.status"), F.lit(""))
    return {
        "eligibility_status": F.coalesce(status, F.lit("PASSED")),
        "eligibility_title": F.when(status.isNull(), "Hard Eligibility Check").otherwise(text("$.eligibility_check.title")),
        "is_resume": F.coalesce(F.try_variant_get(payload, "$.document_validation.is_resume", "boolean"), F.lit(True)),
        "confidence_score": F.coalesce(F.try_variant_get(payload, "$.document_validation.confidence_score", "double"), F.lit(0.95)),
        "detected_doc_type": F.coalesce(F.nullif(text("$.document_validation.detected_doc_type"), F.lit("")), F.lit("Resume")),
        **{k: F.coalesce(F.try_variant_get(payload, f"$.{k}", "array<variant>"), F.expr("array()").cast("array<variant>")) for k in ("verified_strengths", "critical_weaknesses", "recruiter_evidence_matrix", "individual_project_reviews", "top_10_highest_roi_improvements")},
    }


def safe_number(value: Column, default: float = 0.0) -> Column:
    """A number from text that may end in a percent sign."""
    return F.coalesce(F.rtrim(trim(value), F.lit("%")).try_cast("double"), F.lit(default))


def safe_string(value: Column, default: str = "N/A") -> Column:
    """Text; the default for null, and for a list or object kept as JSON text."""
    return F.when(value.isNull() | value.rlike(r"(?s)^\s*[\[{].*[\]}]\s*\z"), default).otherwise(value)


def fraction(value: Column) -> Column:
    """A score of 0-100 as 0-1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / 100.0))


def plan_items(items: Column) -> Column:
    """Items of an action plan in order, without blanks and repetitions."""
    return F.array_distinct(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False))))


def distinct_items(items: Column) -> Column:
    """Items in order, without repetitions; blanks stay."""
    return F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))


def unique_notes(rows: DataFrame, id_col: str, pos_col: str = "pos", note_col: str = "note", tag_col: str = "requirement", form: str = "[%s Audit]: %s", keep_blank: bool = False) -> DataFrame:
    """Notes of which each repetition within a report carries its requirement in front.

    Notes count as equal without blanks at their ends. ``keep_blank`` leaves blank ones alone.
    """
    same = Window.partitionBy(id_col, trim(F.col(note_col))).orderBy(pos_col)
    again = F.row_number().over(same) > 1
    if keep_blank:
        again = again & (trim(F.col(note_col)) != "")
    return rows.withColumn(note_col, F.when(again, F.format_string(form, F.col(tag_col), F.col(note_col))).otherwise(F.col(note_col)))


#: Rows of an evidence matrix.
MATRIX = "array<struct<requirement:string,status:string,evidence_note:string>>"


def matrix_of(payload: Column) -> Column:
    """Rows of a variant payload's evidence matrix; rows that are no objects go, and so does a matrix that is no list."""
    rows = F.coalesce(F.try_variant_get(payload, "$.recruiter_evidence_matrix", "array<variant>"), F.expr("array()").cast("array<variant>"))
    text = lambda row, k: F.try_variant_get(row, f"$.{k}", "string")
    objects = F.filter(rows, lambda row: F.schema_of_variant(row).startswith("OBJECT"))
    return F.transform(objects, lambda row: F.struct(*[text(row, k).alias(k) for k in ("requirement", "status", "evidence_note")])).cast(MATRIX)


def unique_matrix(matrix: Column, before: str = "[", after: str = " Audit]: ", keep_blank: bool = False) -> Column:
    """``unique_notes`` for the rows of one report, in their own array."""
    note = lambda row: trim(F.coalesce(row["evidence_note"], F.lit("")))

    def named(row: Column, place: Column) -> Column:
        again = (place > 0) & F.exists(F.slice(matrix, 1, place), lambda x: note(x) == note(row))
        if keep_blank:
            again = again & (note(row) != "")
        tagged = F.concat(F.lit(before), F.coalesce(row["requirement"], F.lit("")), F.lit(after), F.coalesce(row["evidence_note"], F.lit("")))
        return F.struct(row["requirement"].alias("requirement"), row["status"].alias("status"), F.when(again, tagged).otherwise(row["evidence_note"]).alias("evidence_note"))

    return F.transform(matrix, named)


def status_mark(status: Column) -> Column:
    """ok, warn or missing, by words in a status. Case counts."""
    holds = lambda *ws: sum((F.contains(status, F.lit(w)).cast("int") for w in ws[1:]), F.contains(status, F.lit(ws[0])).cast("int")) > 0
    return F.when(status.isNull(), "missing").when(holds("Verified", "explicit"), "ok").when(holds("Partial", "Limited", "implied", "Once"), "warn").otherwise("missing")


def level(value: Column) -> Column:
    """high, medium or low; anything else is medium."""
    low = F.lower(trim(value))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


def categories_of(payload: Column) -> Column:
    """Map of the categories that a variant payload's explanation has, or null."""
    return F.try_variant_get(payload, "$.explainable_scorecard.ats_score.explanation.categories", "map<string,variant>")


def within_bounds(categories: Column) -> Column:
    """Whether an explanation has at most seven categories with keys of at most 60 characters; none is within bounds."""
    return F.coalesce((F.size(F.map_keys(categories)) <= L.MOST_CATEGORIES) & ~F.exists(F.map_keys(categories), lambda k: F.length(k) > L.LONGEST_CATEGORY), F.lit(True))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def merged_score(report: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reports whose score, parts and reason are the deterministic ones where there are any."""
    fields = ["score", *L.MAXIMA, "reason"]
    own = scores.select(id_col, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = report.join(own, id_col, "left")
    return joined.select(*[c for c in report.columns if c not in fields], *[(F.coalesce(f"_{f}", f) if f in report.columns else F.col(f"_{f}")).alias(f) for f in fields])


# ---- lints ----


def keyword_in_several_classes(rows: DataFrame, id_col: str, keyword: str = "keyword", kind: str = "kind") -> DataFrame:
    """Keywords that stand in more than one class of a report."""
    return rows.groupBy(id_col, F.lower(trim(F.col(keyword))).alias("keyword")).agg(F.count_distinct(kind).alias("classes")).where("classes > 1")


def ranks_complete(ranks: Column, wanted: int = 10) -> Column:
    """Whether ranks are 1 to ``wanted``, each once."""
    return F.array_sort(ranks) == F.sequence(F.lit(1), F.lit(wanted))


def repeated_notes(rows: DataFrame, id_col: str, note_col: str = "note") -> DataFrame:
    return rows.groupBy(id_col, trim(F.col(note_col)).alias("note")).agg(F.count("*").alias("n")).where("n > 1")


def reviews_match(reviews: DataFrame, projects: DataFrame, id_col: str) -> DataFrame:
    """Documents whose number of project reviews is not that of their projects."""
    a = reviews.groupBy(id_col).agg(F.count("*").alias("reviews"))
    b = projects.groupBy(id_col).agg(F.count("*").alias("projects"))
    return a.join(b, id_col, "full").fillna(0, ["reviews", "projects"]).where("reviews <> projects")


# ---- what goes to and comes from a model ----


def without_extra_properties(schema: object) -> object:
    """A JSON schema without its additionalProperties, at any depth."""
    if isinstance(schema, dict):
        return {k: without_extra_properties(v) for k, v in schema.items() if k != "additionalProperties"}
    return [without_extra_properties(x) for x in schema] if isinstance(schema, list) else schema


def explained_evidence(evidence: DataFrame, role_data: bool = False) -> DataFrame:
    """Evidence as JSON text for an explanation. Without data on the role no keyword counts as missing."""
    rows = evidence if role_data or "missing_keywords" not in evidence.columns else evidence.withColumn("missing_keywords", F.array().cast("array<string>"))
    return rows.withColumn("evidence_json", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))


def _within(payload: Column, bounds: dict[str, int]) -> Column:
    return F.forall(F.array(*[F.coalesce(F.try_variant_get(payload, f"$.explainable_scorecard.{path}", "int").between(0, most), F.lit(False)) for path, most in bounds.items()]), lambda x: x)


def valid_score(payload: Column) -> Column:
    """Whether the parts of a report's score are all there and within their bounds."""
    return _within(payload, {f"ats_score.breakdown.{part}": most for part, most in L.MAXIMA.items()})


def valid_report(payload: Column) -> Column:
    """``valid_score``, and whether the four scores of a report are there and of 0 to 100."""
    return valid_score(payload) & _within(payload, {f"{k}.score": 100 for k in ("ats_score", "technical_depth", "recruiter_signal", "overall_hiring_score")})


# ---- a whole report ----


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grounded_rewrites(rewrites: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else [ground_metrics(x, b) for x in a] for a, b in zip(rewrites, texts)], dtype=object)


def finished(df: DataFrame, payload_col: str = "payload", text_col: str = "text") -> DataFrame:
    """``df`` with ``report``: what a reviewer's payload holds, treated as far as rules can.

    The payload is cleaned and unwrapped, and repaired where it was cut short. Keywords and
    metrics are grounded in the text, the score is the sum of its parts, the overall score
    and the probability are capped, missing fields get their defaults, and repetitions go.
    ``valid`` tells whether the scores are within their bounds. Null where there is no
    payload, or it holds no object.
    """
    whole = parsed(F.col(payload_col))
    rows = df.withColumn("_v", F.coalesce(whole, parsed(repaired_json(F.col(payload_col)))))
    v, text = F.col("_v"), F.coalesce(F.col(text_col), F.lit(""))
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    reviews = F.coalesce(get("individual_project_reviews", "array<variant>"), F.expr("array()").cast("array<variant>"))
    rows = rows.withColumn("_rewrites", _grounded_rewrites(F.transform(reviews, lambda x: F.try_variant_get(x, "$.star_rewrite.optimized", "string")), text))
    matrix, defaults = matrix_of(v), safe_defaults(v)
    missing, strong = keyword_grounding(get("ats_keyword_analysis.missing_keywords", "array<string>"), get("ats_keyword_analysis.strong_keywords", "array<string>"), text)
    cap, chance = caps(defaults["eligibility_status"], red_flag_rows(F.transform(matrix, lambda x: x["status"])))
    overall = "explainable_scorecard.overall_hiring_score"
    plan = {k: plan_items(get(f"priority_action_plan.{k}", "array<string>")).alias(k) for k in ("immediate_fixes_today", "short_term_this_week", "long_term_this_month")}
    report = F.struct(
        F.greatest(F.lit(0), F.least(F.lit(100), sum((F.coalesce(get(f"explainable_scorecard.ats_score.breakdown.{k}", "int"), F.lit(0)) for k in L.MAXIMA), F.lit(0)))).alias("ats_score"),
        capped_score(get(f"{overall}.score"), cap).alias("overall_score"), capped_probability(get(f"{overall}.interview_probability"), chance).alias("interview_probability"),
        F.array_compact(missing).alias("missing_keywords"), F.array_compact(strong).alias("strong_keywords"), F.col("_rewrites").alias("rewrites"), unique_matrix(matrix).alias("evidence_matrix"),
        section_flags(get("dashboard_metrics.section_completeness", "map<string,boolean>")).alias("section_completeness"),
        *[defaults[k].alias(k) for k in ("eligibility_status", "eligibility_title", "is_resume", "confidence_score", "detected_doc_type")], *plan.values(),
        within_bounds(categories_of(v)).alias("explanation_within_bounds"), valid_report(v).alias("valid"),
    )
    return rows.withColumn("report", F.when(v.isNotNull(), report)).drop("_v", "_rewrites")


def with_own_score(df: DataFrame) -> DataFrame:
    """Reports whose score, with its parts, the reason and the issues of the layout, is the deterministic one of the row."""
    own = F.struct("score", F.struct(*L.MAXIMA).alias("breakdown"), F.col("reason").alias("reason_not_higher"), "parsing_issues")
    return df.withColumn("report", F.when(F.col("report").isNotNull() & F.col("score").isNotNull(), F.col("report").withField("ats_score", own)))

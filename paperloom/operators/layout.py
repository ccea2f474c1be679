"""Layouts that automated readers misread: tables, columns, odd bullets, text in margins and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions.text import DIGIT, WS_IN, trim

BLOCK = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
_CLUSTER = "struct<anchor:double,n:int,top:double,bottom:double>"
_STATE = f"array<{_CLUSTER}>"
#: Kinds of issues in the order in which a page's checks run: severity, confidence.
ISSUES = {"TABLE": ("high", "high"), "HEADER_FOOTER_TEXT": ("high", "high"), "TEXT_BOX": ("high", "high"), "MULTI_COLUMN": ("medium", "medium"), "NONSTANDARD_BULLETS": ("low", "medium")}


def has_contact(text: Column) -> Column:
    """Whether a text holds a mail address or a run of seven digits and more."""
    mail = text.rlike(r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_]+")
    runs = F.regexp_extract_all(text, F.lit(rf"(\+?[{DIGIT}{WS_IN}\-()]{{8,}})"), 1)
    return F.coalesce(mail | F.exists(runs, lambda x: F.length(F.regexp_replace(x, f"[^{DIGIT}]", "")) >= 7), F.lit(False))


def columns(blocks: Column) -> Column:
    """Clusters of blocks by their left edges, as (anchor, n, top, bottom).

    A block joins the last cluster if it starts within the tolerance of the cluster's first
    edge, not of the block before it.
    """
    ordered = F.array_sort(F.transform(blocks, lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["y1"].alias("y1"))))

    def step(state: Column, b: Column) -> Column:
        last = state["open"]
        joins = F.coalesce(b["x0"] - last["anchor"] <= L.SAME_COLUMN, F.lit(False))
        joined = F.struct(last["anchor"].alias("anchor"), (last["n"] + 1).alias("n"), F.least(last["top"], b["y0"]).alias("top"), F.greatest(last["bottom"], b["y1"]).alias("bottom"))
        fresh = F.struct(b["x0"].alias("anchor"), F.lit(1).alias("n"), b["y0"].alias("top"), b["y1"].alias("bottom"))
        # the clusters that are done are copied only when one more is
        done = F.when(joins | last.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(last)))
        return F.struct(F.when(joins, joined).otherwise(fresh).cast(_CLUSTER).alias("open"), done.cast(_STATE).alias("done"))

    begin = F.struct(F.lit(None).cast(_CLUSTER).alias("open"), F.array().cast(_STATE).alias("done"))
    return F.aggregate(ordered, begin, step, lambda state: F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))))


def real_columns(blocks: Column, page_height: Column) -> Column:
    """How many clusters have enough blocks and height; none on a page without height."""
    tall = lambda c: (c["n"] >= L.LEAST_BLOCKS) & ((c["bottom"] - c["top"]) / page_height >= L.LEAST_HEIGHT)
    return F.when(page_height > 0, F.size(F.filter(columns(blocks), tall))).otherwise(0)


def odd_bullets(text: Column) -> Column:
    """Whether a page has bullets of a private font, or lines that begin with a middle dot."""
    dots = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[ \t]*\x{b7}")))
    return F.coalesce(text.rlike(r"[\x{e000}-\x{f8ff}]") | (dots >= L.LEAST_MIDDOTS), F.lit(False))


def page_issues(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, page_no, issue_type) of pages(id, page_no, page_height, text, has_ruled_table, blocks)."""
    filled = F.filter("blocks", lambda b: trim(F.coalesce(b["text"], F.lit(""))) != "")
    found = F.array(
        F.when(F.coalesce(F.col("has_ruled_table"), F.lit(False)), "TABLE"),
        F.when(real_columns(filled, F.col("page_height")) >= 2, "MULTI_COLUMN"),
        F.when(odd_bullets(F.col("text")), "NONSTANDARD_BULLETS"),
    )
    return pages.select(id_col, "page_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue_type"))


def document_issues(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ordinal, issue_type, severity, confidence, affected_pages): one row for each kind in a document.

    Pages are sorted; kinds come in the order in which they are first seen.
    """
    order = list(ISSUES)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("issue_type"))
    grouped = page_issues(pages, id_col).groupBy(id_col, "issue_type").agg(F.sort_array(F.collect_set("page_no")).alias("affected_pages"))
    levels = F.create_map(*[x for k, v in ISSUES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("severity"), F.lit(v[1]).alias("confidence")))])
    ranked = grouped.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("affected_pages")[0].alias("first_page"), rank.alias("rank"), "issue_type", "affected_pages"))).alias("issues"))
    rows = ranked.select(id_col, F.posexplode("issues").alias("ordinal", "issue")).select(id_col, "ordinal", "issue.issue_type", "issue.affected_pages")
    return rows.select(id_col, "ordinal", "issue_type", levels[F.col("issue_type")]["severity"].alias("severity"), levels[F.col("issue_type")]["confidence"].alias("confidence"), "affected_pages")

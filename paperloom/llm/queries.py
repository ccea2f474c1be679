"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import encoding, leaks, lookalike, names, neardup, pii, residue, scan, tokens
from paperloom.functions.text import WS
from paperloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.find_noise(table(spark, sf_dir, "parsed_resumes"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.clean(table(spark, sf_dir, "parsed_resumes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(table(spark, sf_dir, "parsed_resumes"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair(table(spark, sf_dir, "parsed_resumes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.find_lookalikes(table(spark, sf_dir, "parsed_resumes"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.unify(table(spark, sf_dir, "parsed_resumes"), ("raw_text", "cleaned_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.find_organisations(table(spark, sf_dir, "parsed_resumes"), table(spark, sf_dir, "organisations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.all_pairs(table(spark, sf_dir, "parsed_resumes"), 0.6, 3, "doc_id", "cleaned_text")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups_of_all(table(spark, sf_dir, "parsed_resumes"), 0.6, 3, "doc_id", "cleaned_text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "parsed_resumes"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.examine(table(spark, sf_dir, "parsed_resumes")).select("doc_id", "field_name", "place", "redacted_text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents"))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(table(spark, sf_dir, "documents")).select("doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_repaired, p3_found, p3_unified, p4_found, p5_found, p5_groups, p7_found, p7_redacted, p8_ids, p9_found, p9_removed, p10_found, p10_clean)}

_WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))"

ORACLES: dict[str, str] = {
    "p5_found": f"""
        with w as (select doc_id, list_filter(regexp_split_to_array(lower(cleaned_text), '{WS}+'), lambda x: x <> '') as ws from parsed_resumes where cleaned_text is not null),
        g as (select distinct doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], chr(10)))) as s from w where len(ws) >= 3),
        n as (select doc_id, count(*) as n from g group by 1),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2)
        select x as doc_id_a, y as doc_id_b from c join n p on p.doc_id = x join n q on q.doc_id = y where k >= 0.6::double * (p.n + q.n - k)
    """,
    "p9_found": f"""
        with d as (select doc_id, {_WORDS} as w from documents where text is not null),
        i as (select item_id, {_WORDS} as w from eval_items where text is not null),
        dg as (select distinct doc_id, array_to_string(w[k:k + 9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as k from d where len(w) >= 10)),
        ig as (select distinct item_id, array_to_string(w[k:k + 9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as k from i where len(w) >= 10))
        select distinct doc_id, item_id from dg join ig using (g)
    """,
}

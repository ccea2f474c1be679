import json

import pytest

from paperloom.operators import nesting


@pytest.mark.parametrize("text,expected", [('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, ], }\n```', {"a": [1]}), ('Here: {"a": ",}"} end', {"a": ",}"}), ('{"a": {"b": 1}', None), ("[1]", None), ("null", None), (None, None), ("", None), ('{"a": 1},}', {"a": 1}), ('{, "a": 1,, "b": 2}', {"a": 1, "b": 2})])
def test_payloads_are_freed_of_what_stands_around(text, expected):
    assert nesting.parse_object(text) == expected


def payload(score):
    return json.dumps({"data": {"report": {"explainable_scorecard": {"ats_score": score}}}})


def test_children(spark):
    score = {
        "parsing_issues": [None, {"affected_pages": 3}, json.dumps({"affected_pages": [1, None, 2]})],
        "explanation": {"categories": json.dumps({"b": {"details": "one"}, "a": {"details": [None, "x", "x"]}, "c": None})},
    }
    audits = spark.createDataFrame([(1, payload(score), 0), (1, payload(score), 0), (2, payload(score)[:-3], 0), (3, None, 0), (4, payload({"parsing_issues": {"affected_pages": None}}), 0)], "audit_id bigint, payload string, ordinal int")
    resumes = spark.createDataFrame(
        [(7, [("t",), None, ("t",)], [(["A", " ", None, "B"],), None]), (8, None, None), (9, [], [(None,)])],
        "doc_id bigint, certifications array<struct<title:string>>, publications array<struct<authors:array<string>>>",
    )
    got = {tuple(r) for r in nesting.find_children(resumes, audits).collect()}
    assert got == {
        ("certification", 7, "0"), ("certification", 7, "2"), ("publication_author", 7, "0/0"), ("publication_author", 7, "0/3"), ("parsing_issue", 1, "1"), ("parsing_issue", 1, "2"),
        ("affected_page", 1, "1/0"), ("affected_page", 1, "2/0"), ("affected_page", 1, "2/2"), ("category", 1, "a"), ("category", 1, "b"), ("category_detail", 1, "b/0"), ("category_detail", 1, "a/1"),
        ("category_detail", 1, "a/2"), ("parsing_issue", 4, "0"),
    }
    stored = nesting.objects(nesting.bridge(resumes, audits)).where("rel = 'certification'").collect()
    assert len(stored) == 1 and stored[0].occurrences == 2


def test_identities_do_not_depend_on_order():
    same = nesting.Identities()
    assert same.of({"a": 1, "b": [1, {"c": None}]}) == same.of({"b": [1, {}], "a": 1}) != same.of({"a": 1, "b": [{}, 1]})


def test_empty_tables(spark):
    resumes = spark.createDataFrame([], "doc_id bigint, certifications array<struct<title:string>>, publications array<struct<authors:array<string>>>")
    audits = spark.createDataFrame([], "audit_id bigint, payload string")
    assert nesting.find_children(resumes, audits).count() == 0

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import layout, report, scoring, validate

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab,{}[]\"\\ ", max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("kx", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("kx", min_size=1, max_size=3), VALUES, max_size=4))
def test_whole_objects_come_out_as_they_are(value):
    text = json.dumps(value)
    assert json.loads(report.repair(text)) == value


@pytest.mark.parametrize("text,expected", [('{"a": "x, y", "b": "cut', {"a": "x, y"}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": 1,', {"a": 1}), ('noise {"a": {"b": [1, {"c": "d', {"a": {"b": [1]}})])
def test_cut_objects_are_closed(text, expected):
    assert json.loads(report.repair(text)) == expected


def test_no_object_is_none():
    assert report.repair("none") is None and report.repair(None) is None and report.repair("") is None


def test_grounding_of_metrics():
    text = "We saved 95% and got accuracy 0.9"
    assert report.ground_metrics("5% less, 40% more, $3k, 12 ms, 3x, 9 sec", text) == "5% less, [Insert %] more, [Insert $ Value], [Insert Latency], [Insert Multiplier], [Insert Duration]"
    assert report.ground_metrics("accuracy 0.9 and F1-score 0.7, R^2: 0.5", text) == "accuracy 0.9 and [Insert F1 Score], [Insert R^2]"
    assert report.ground_metrics("5%", "") == "5%" and report.ground_metrics(None, text) is None


def test_grounding_of_keywords(spark):
    df = spark.createDataFrame([(["Git", "C++", "sql", "", "ml", "Git"], ["sql"], "uses C++, git-flow and digital html"), (["a"], ["b"], ""), (None, None, "x")], "m array<string>, s array<string>, t string")
    m, s = report.keyword_grounding(F.col("m"), F.col("s"), F.col("t"))
    rows = [tuple(r) for r in df.select(m, s).collect()]
    assert rows == [(["sql", "ml"], ["sql", "Git", "C++"]), (["a"], ["b"]), ([], [])]


@pytest.mark.parametrize("given_,cap,expected", [("50-60%", 50, "<= 50%"), ("45%", 50, "45%"), ("", 50, "<= 50%"), (None, 5, "<= 5%"), ("n/a", 50, "<= 50%"), ("90%", None, "90%")])
def test_probability_caps(spark, given_, cap, expected):
    got = spark.range(1).select(report.capped_probability(F.lit(given_).cast("string"), F.lit(cap).cast("int"))).first()[0]
    assert got == expected


def test_caps(spark):
    df = spark.createDataFrame([("FAILED", 3, "80"), (" failed ", 0, "x"), ("PASSED", 3, "80"), ("PASSED", 2, "80"), (None, 2, None)], "e string, n int, s string")
    cap, chance = report.caps(F.col("e"), F.col("n"))
    rows = [tuple(r) for r in df.select(report.capped_score(F.col("s"), cap), chance).collect()]
    assert rows == [(30, 5), (30, 5), (75, 50), (80, None), (None, None)]


def test_red_flags(spark):
    assert spark.range(1).select(report.red_flag_rows(F.array(F.lit(" Not Found "), F.lit("LIMITED"), F.lit("Partial")))).first()[0] == 2


def test_red_flags_cap_the_query(spark, tmp_path):
    from paperloom.plans import catalogue

    def payload(matrix, status="PASSED"):
        return json.dumps({"eligibility_check": {"status": status}, "explainable_scorecard": {"overall_hiring_score": {"score": 90, "interview_probability": "80%"}}, "recruiter_evidence_matrix": matrix})

    flags = [{"status": s} for s in (" Not Found", "limited", "LIMITED", "Verified")]
    cases = [(payload(flags), 75, "<= 50%"), (payload(flags[1:]), 90, "80%"), (payload(flags, "FAILED"), 30, "<= 5%"), (payload("x"), 90, "80%"), (payload([*flags[:2], "limited", None, {"status": None}]), 90, "80%"), (payload(None), 90, "80%")]
    rows = [(i, None, "text", p) for i, (p, _, _) in enumerate(cases)]
    spark.createDataFrame(rows, "audit_id bigint, target_role string, resume_text string, payload string").write.parquet(f"{tmp_path}/audits.parquet")
    got = {r.audit_id: (r.overall_score, r.interview_probability) for r in catalogue.QUERIES["score_caps"](spark, str(tmp_path)).collect()}
    assert got == {i: (s, c) for i, (_, s, c) in enumerate(cases)}


def test_notes_are_told_apart(spark):
    df = spark.createDataFrame([(1, 0, "same", "A"), (1, 1, " same", "B"), (1, 2, "same", "C"), (2, 0, "same", "D"), (1, 3, " ", "E"), (1, 4, " ", "F")], "id int, pos int, note string, requirement string")
    got = [r.note for r in report.unique_notes(df, "id", keep_blank=True).orderBy("id", "pos").collect()]
    assert got == ["same", "[B Audit]:  same", "[C Audit]: same", " ", " ", "same"]


def test_small_coercions(spark):
    row = spark.range(1).select(
        report.safe_number(F.lit(" 45% ")), report.safe_number(F.lit("x"), 7.0), report.safe_string(F.lit('{"a": 1}')), report.safe_string(F.lit(None).cast("string")), report.fraction(F.lit(150.0)), report.status_mark(F.lit("Mentioned Once")),
        report.level(F.lit("?")), report.plan_items(F.array(F.lit("a"), F.lit(""), F.lit("a"), F.lit(None))), report.distinct_items(F.array(F.lit("a"), F.lit(""), F.lit("a"))),
    ).first()
    assert tuple(row) == (45.0, 7.0, "N/A", "N/A", 1.0, "warn", "medium", ["a"], ["a", ""])


def test_unwrapping(spark):
    df = spark.createDataFrame([('```json\n{"analysis": {"a": 1,}}\n```',), ('x {"a": 1} y',), ("[1]",), (None,), ("{cut",)], "p string")
    got = [r[0] for r in df.select(F.try_variant_get(report.parsed(F.col("p")), "$.a", "int")).collect()]
    assert got == [1, 1, None, None, None]


def test_columns_are_clustered_by_their_first_edge(spark):
    def block(x, y):
        return (float(x), float(y), x + 10.0, y + 20.0, "t")

    rows = [([block(x, 0) for x in (0, 25, 50, 51, 100)], 100.0), ([block(x, y) for x in (0, 200) for y in (0, 10, 20)], 100.0), ([block(x, y) for x in (0, 200) for y in (0, 10, 20)], 161.0), ([], 0.0)]
    df = spark.createDataFrame(rows, f"blocks array<{layout.BLOCK}>, h double")
    got = [tuple(r) for r in df.select(F.size(layout.columns(F.col("blocks"))), layout.real_columns(F.col("blocks"), F.col("h"))).collect()]
    assert got == [(3, 0), (2, 2), (2, 0), (0, 0)]


def test_issues_are_grouped_by_kind(spark):
    pages = spark.createDataFrame([(1, 2, 100.0, "· a\n· b", True, []), (1, 1, 100.0, "", False, []), (2, 1, 100.0, "plain", False, None)], f"doc_id int, page_no int, page_height double, text string, has_ruled_table boolean, blocks array<{layout.BLOCK}>")
    got = [(r.doc_id, r.ordinal, r.issue_type, r.severity, r.affected_pages) for r in layout.document_issues(pages).orderBy("ordinal").collect()]
    assert got == [(1, 0, "NONSTANDARD_BULLETS", "low", [1, 2]), (1, 1, "TABLE", "high", [2])]


def test_file_gates(spark):
    ole = bytearray(validate.OLE2)
    rows = [("a.PDF", 5, bytearray(b"%PDF-1")), ("a.docx", 5, ole), ("a.docx", 5, bytearray(b"PK..")), ("a.exe", 5, None), ("noext", 5, None), ("a.txt", 0, None), ("a.txt", 10486000, bytearray(b"x")), ("a.txt", 10500000 + 50000, bytearray(b"x")), ("a.txt", 3, bytearray(b"a\x00b")), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, n bigint, h binary")
    got = [r[0] for r in df.select(validate.file_status(F.col("p"), F.col("n"), F.col("h"))).collect()]
    assert got == ["OK", "ENCRYPTED", "OK", "UNSUPPORTED_FORMAT", "UNSUPPORTED_FORMAT", "EMPTY_FILE", "OK", "FILE_TOO_LARGE", "CORRUPTED", "UNSUPPORTED_FORMAT"]


@pytest.mark.parametrize("raw,scanned,words,expected", [("x", True, 50, "SCANNED_DOCUMENT_DETECTED"), (" \n", False, 50, "EMPTY_DOCUMENT"), ("x", None, 0, "EMPTY_DOCUMENT"), ("x", False, 14, "INSUFFICIENT_CONTENT"), ("x", False, 15, "OK"), (None, None, None, "EMPTY_DOCUMENT")])
def test_content_gates(spark, raw, scanned, words, expected):
    got = spark.range(1).select(validate.content_status(F.lit(raw).cast("string"), F.lit(scanned).cast("boolean"), F.lit(words).cast("int"))).first()[0]
    assert got == expected


def test_weakest_category_is_the_first_of_equal_ones(spark):
    points = {"formatting": F.lit(0), "keywords": F.lit(0), "structure": F.lit(20), "achievements": F.lit(0), "ats_compatibility": F.lit(15)}
    assert spark.range(1).select(scoring.weakest(points)).first()[0] == "formatting"


def test_what_goes_to_a_model(spark):
    assert report.without_extra_properties({"a": {"additionalProperties": False, "b": [{"additionalProperties": 1}]}}) == {"a": {"b": [{}]}}
    df = spark.createDataFrame([(1, ["x"])], "score int, missing_keywords array<string>")
    assert json.loads(report.explained_evidence(df).first().evidence_json) == {"score": 1, "missing_keywords": []}
    assert json.loads(report.explained_evidence(df, True).first().evidence_json)["missing_keywords"] == ["x"]
    whole = {k: m for k, m in (("formatting", 15), ("keywords", 25), ("structure", 20), ("achievements", 25), ("ats_compatibility", 15))}
    rows = spark.createDataFrame([(json.dumps({"explainable_scorecard": {"ats_score": {"breakdown": b}}}),) for b in (whole, whole | {"keywords": 26}, {})], "p string")
    assert [r[0] for r in rows.select(report.valid_score(F.try_parse_json("p"))).collect()] == [True, False, False]


def test_lints(spark):
    words = spark.createDataFrame([(1, "SQL", "a"), (1, "sql ", "b"), (1, "x", "a"), (2, "x", "a")], "id int, keyword string, kind string")
    assert [tuple(r) for r in report.keyword_in_several_classes(words, "id").collect()] == [(1, "sql", 2)]
    notes = spark.createDataFrame([(1, "n"), (1, " n"), (2, "n")], "id int, note string")
    assert [tuple(r) for r in report.repeated_notes(notes, "id").collect()] == [(1, "n", 2)]
    assert sorted(tuple(r) for r in report.reviews_match(notes, words.where("id = 1"), "id").collect()) == [(1, 2, 3), (2, 1, 0)]
    assert spark.range(1).select(report.ranks_complete(F.array(*[F.lit(i) for i in range(10, 0, -1)])), report.ranks_complete(F.array(F.lit(1)))).first() == (True, False)


def test_scores_are_merged(spark):
    reports = spark.createDataFrame([(1, 90, "model"), (2, 80, "model")], "doc_id int, score int, reason string")
    own = spark.createDataFrame([(1, 50, 1, 2, 3, 4, 5, "own")], "doc_id int, score int, formatting int, keywords int, structure int, achievements int, ats_compatibility int, reason string")
    got = {r.doc_id: (r.score, r.reason, r.formatting) for r in report.merged_score(reports, own).collect()}
    assert got == {1: (50, "own", 1), 2: (80, "model", None)}


def test_timings():
    from paperloom.plans.timing import Timings

    t = Timings()
    assert t.report().count("N/A") == 8
    with t.stage("score"):
        pass
    assert t.report().count("N/A") == 6


def test_unique_matrix(spark):
    rows = [("a", "x", " same"), ("b", "x", "same "), ("c", "x", ""), ("d", "x", None), ("e", None, "other"), (None, None, "same")]
    df = spark.createDataFrame([(1, rows), (2, []), (3, None)], f"id int, m {report.MATRIX}")
    got = {r.id: r.m and [x.evidence_note for x in r.m] for r in df.select("id", report.unique_matrix(F.col("m")).alias("m")).collect()}
    assert got == {1: [" same", "[b Audit]: same ", "", "[d Audit]: ", "other", "[ Audit]: same"], 2: [], 3: None}
    shown = df.where("id = 1").select(report.unique_matrix(F.col("m"), "", ": ", keep_blank=True).alias("m")).first().m
    assert [x.evidence_note for x in shown] == [" same", "b: same ", "", None, "other", ": same"]


def test_aligned_score_of_variants(spark):
    df = spark.createDataFrame([('{"a": 10, "b": "7", "c": "x", "d": null}',), ('{"a": 90, "b": 40}',), ("[1]",), ("{}",)], "j string")
    got = [r[0] for r in df.select(report.aligned_score(F.try_variant_get(F.try_parse_json("j"), "$", "map<string,variant>"))).collect()]
    assert got == [17, 100, None, 0]


def test_a_review_is_finished_and_gets_the_own_score(spark):
    import json

    from paperloom.plans import pipeline

    text = "Jane Doe\nSUMMARY\nBuilt things with Python, raised sales by 12% at work.\n" + "word " * 40
    payload = {
        "explainable_scorecard": {"ats_score": {"score": 1, "breakdown": {"formatting": 10, "keywords": "5", "structure": "x"}}, "overall_hiring_score": {"score": 90, "interview_probability": "80%"}},
        "recruiter_evidence_matrix": [{"requirement": r, "status": "Not Found", "evidence_note": "none"} for r in "abc"] + ["odd"],
        "ats_keyword_analysis": {"missing_keywords": ["Python", "Rust"], "strong_keywords": ["SQL"]},
        "individual_project_reviews": [{"star_rewrite": {"optimized": "Raised sales by 12% and profit by 40%"}}, {}],
        "priority_action_plan": {"immediate_fixes_today": ["a", "", "a", "b"]},
    }
    rows = spark.createDataFrame([(1, text, False, 60, 1), (2, "short", False, 1, 1), (3, text + " cut", False, 60, 1)], "doc_id int, text string, is_scanned boolean, word_count int, page_count int")
    whole = json.dumps(payload)
    asked = lambda t, role: (_ for _ in ()).throw(ValueError) if len(t) < 30 else whole[: whole.index('"b"') + 4] if t.endswith("cut") else f"Here: ```json\n{whole}\n```"
    got = {r.doc_id: r for r in pipeline.analyze(rows, reviewer=asked).collect()}
    r = got[1].report
    assert (r.overall_score, r.interview_probability, r.missing_keywords, r.strong_keywords) == (75, "<= 50%", ["Rust"], ["SQL", "Python"])
    assert r.rewrites == ["Raised sales by 12% and profit by [Insert %]", None] and r.immediate_fixes_today == ["a", "b"] and r.eligibility_status == "PASSED" and not r.valid
    assert [x.evidence_note for x in r.evidence_matrix] == ["none", "[b Audit]: none", "[c Audit]: none"] and not any(r.section_completeness.values()) and len(r.section_completeness) == 12
    assert r.ats_score.score == got[1].score and r.ats_score.breakdown.keywords == got[1].keywords and got[1].review_status == "OK"
    assert got[2].report is None and got[2].review_status == "NOT_ASKED" and got[2].score is None and got[2].error_code == "INSUFFICIENT_CONTENT"
    assert got[3].report is not None and got[3].report.overall_score == 90  # cut short and repaired


def test_answers_of_a_classifier(spark):
    from paperloom.operators import providers

    df = spark.createDataFrame([(1, "long enough " * 9), (2, "long enough " * 3000)], "doc_id int, text string")
    answer = '{"is_resume": true, "confidence_score": 80, "experience_level": "Senior"}'
    got = providers.classify(df, provider=lambda text, role: answer).orderBy("doc_id").collect()
    assert [(r.is_resume, r.confidence, r.experience_level, r.classifier_status) for r in got] == [(True, 0.8, "Senior", "OK"), (True, 0.8, "Senior", "TRUNCATED")]
    # a bare label says nothing of confidence
    assert providers.classify(df, provider=lambda text, role: "resume").first().confidence is None


def test_a_provider_is_asked_again():
    from paperloom.operators import providers

    calls = []

    def fails_twice(text, role):
        calls.append(text)
        if len(calls) < 3:
            raise TimeoutError
        return "x"

    assert providers._asked(fails_twice, 3, 0.0)("t", None) == ("x", None)
    calls.clear()
    assert providers._asked(fails_twice, 2, 0.0)("t", None) == (None, "TimeoutError")

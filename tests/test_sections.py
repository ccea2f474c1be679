from pyspark.sql import functions as F

from paperloom.operators import entities, sections


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, section string, line string")


def test_repeated_sections_are_appended(spark):
    df = frame(spark, "Jane\nSUMMARY\none\nSKILLS\nsql\nSummary\ntwo", None, "", "Prose that shows experience\nafter it")
    got = {(r.doc_id, r.section): r.section_text for r in sections.split_appending(df).collect()}
    # prose that ends in a heading is one; a null or empty text has no sections
    assert got == {(0, "HEADER"): "Jane", (0, "summary"): "one\ntwo", (0, "skills"): "sql", (3, "experience"): "after it"}


def test_the_last_run_of_a_section_stands(spark):
    df = frame(spark, "Languages known\nEnglish - Fluent\nAwards\nPrize\nLanguages\nGerman\nExperience\nnot this", "Awards\nA\nAwards\nEducation\nx")
    got = {(r.doc_id, r.section): r.section_text for r in sections.split_overwriting(df).collect()}
    assert got == {(0, "languages"): "German", (0, "awards"): "Prize", (1, "awards"): ""}


def test_summary(spark):
    df = frame(spark, "SUMMARY\nblock", "Objective: be good\nmore\nSKILLS\nsql", "Profiler x", "nothing", None)
    got = {r.doc_id: r.summary for r in sections.summaries(df).collect()}
    assert got == {0: "block", 1: "be good more", 2: "r x", 3: None, 4: None}


def test_completeness(spark):
    df = frame(spark, "  John, john@example.com\n  SUMMARY\n x\n  SKILLS\n y\n  EXPERIENCE\n  EDUCATION\n  PROJECTS\n  CERTIFICATIONS\n z")
    row = df.select(*[c.alias(k) for k, c in sections.completeness(F.col("text")).items()]).first().asDict()
    there = {k for k, v in row.items() if v}
    assert there == {"contact_info", "summary", "skills", "experience", "education", "projects", "certifications"}


def test_items_of_languages_are_cut_at_dashes(spark):
    df = frame(spark, "Languages\nEnglish - Fluent\n- Polish - Basic\nLatin\nAwards\n- Prize -")
    got = [(r.list_name, r.pos, r.item, r.proficiency) for r in sections.structured_items(df).orderBy("list_name", "pos").collect()]
    assert got == [("awards", 0, "Prize", None), ("languages", 0, "English", "Fluent"), ("languages", 1, "", "Polish"), ("languages", 2, "Latin", None)]


def test_experience_rules():
    text = "Engineer\nAcme\nJan 2020 - Present\n• Built x\ngoes on\n- Led y.\nAnalyst\n2018 - 2019\n• Did z"
    got = entities.parse_experience(text)
    assert [(e["title"], e["company"], e["dates"]) for e in got] == [("Engineer", "Acme", "Jan 2020 - Present"), ("goes on", "", ""), ("Analyst", "", "2018 - 2019")]
    assert entities.parse_experience(None) == [] and entities.parse_experience("• only bullets") == []
    assert entities.parse_experience("2019")[0]["title"] == entities.PLACEHOLDER
    first = entities.parse_experience("A\nB\n• long bullet without end\n" + "w " * 45 + "end")
    assert len(first[0]["bullets"]) == 1 and first[0]["bullets"][0].endswith("end")


def test_education_rules():
    got = entities.parse_education("Bachelor of Arts\nSome University, 2015, GPA: 3.5/4.0\n2016\nRelevant coursework\nMathematics\nMaster in Law, State College GPA 3.9")
    assert [e["degree"][:8] for e in got] == ["Bachelor", "Master i"]
    assert got[0]["institution"].startswith("Some University") and got[0]["cgpa"] == "3.5/4.0" and got[0]["dates"] == "2016"
    assert got[1]["institution"] == "Master in Law, State College" and got[1]["cgpa"] == "3.9"
    assert entities.parse_education("Masters of the sea") == []


def test_sql_tells_what_the_parsers_open(spark, data):
    from paperloom.plans import catalogue

    split = sections.split_appending(catalogue.cleaned(spark, data))
    for name, sql, parse in (("experience", entities.has_experience, entities.parse_experience), ("education", entities.has_education, entities.parse_education)):
        for r in split.where(f"section = '{name}'").select("section_text", sql(F.col("section_text")).alias("has")).collect():
            assert r.has == bool(parse(r.section_text))


def test_projects(spark):
    df = frame(spark, "PROJECTS\n- Alpha - does a\nand b\nBeta — does c\nlast", "PROJECTS\nNo dash\nmore")
    got = [(r.doc_id, r.project_no, r.project_name, r.description) for r in entities.projects(df).orderBy("doc_id", "project_no").collect()]
    assert got == [(0, 1, "Alpha", "does a and b"), (0, 2, "Beta", "does c last"), (1, 1, "No dash", "more")]


def test_contacts(spark):
    df = frame(spark, "Jane Doe\nj.d@x.co\n+44 7700 900 802\nLinkedIn.com/in/jd https://github.com/jd", "12 34", None)
    t = F.col("text")
    rows = df.select(entities.email(t), entities.phone(t), entities.link(t, entities.LINKEDIN), entities.link(t, entities.GITHUB), entities.name(t)).collect()
    assert tuple(rows[0]) == ("j.d@x.co", "+44 7700 900 802", "LinkedIn.com/in/jd", "https://github.com/jd", "Jane Doe")
    assert rows[1][0] is None and rows[1][1] is None and tuple(rows[2]) == (None,) * 5


def test_parse_all_on_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert entities.parse_all(empty).count() == 0
    row = entities.parse_all(frame(spark, None)).first()
    assert row.skills == [] and row.work_experience == [] and row.candidate_info.email is None


def test_a_text_is_split_and_parsed_in_its_own_row(spark, data):
    """One scan, and no exchange, window or join in any plan that splits texts."""
    from paperloom.operators import scoring
    from paperloom.plans import pipeline

    raw = spark.read.parquet(f"{data}/parsed_resumes.parquet").selectExpr("doc_id", "raw_text", "raw_text as text", "validation_info.is_scanned as is_scanned", "quality_info.word_count as word_count", "1 as page_count")
    plans = [
        sections.split_appending(raw), sections.split_overwriting(raw), sections.summaries(raw), sections.structured_items(raw), entities.projects(raw), entities.parse_all(raw),
        scoring.score(raw, ["sql"]), pipeline.process(raw), pipeline.parse_resumes(raw), pipeline.analyze(raw),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and not any(x in plan for x in ("Exchange", "Window", "Join")), plan


def test_headings_of_several_words_and_their_neighbours(spark):
    lines = ["Skills & Interests", "LICENSES & CERTIFICATIONS held", "my work history", "workhistory", "EDUCATION AND TRAINING", "About me", "about  me", "CORE COMPETENCIES", "core", "", " SKILLS "]
    df = frame(spark, *[f"{x}\nbody" for x in lines])
    got = {r.doc_id: r.section for r in sections.split_appending(df).where("section <> 'HEADER'").collect()}
    assert got == {0: "skills", 1: "certifications", 2: "experience", 4: "education", 5: "summary", 7: "skills", 10: "skills"}


def test_runs_of_sections_that_follow_each_other(spark):
    df = frame(spark, "Awards\nAwards\nA\nInterests\nSkills\nx", "Awards\n\nLanguages\n", "Awards")
    got = {(r.doc_id, r.section): r.section_text for r in sections.split_overwriting(df).collect()}
    # a run without a line stands only where a heading closes it that opens none
    assert got == {(0, "awards"): "A", (0, "interests"): "", (1, "awards"): "", (1, "languages"): ""}

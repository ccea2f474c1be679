import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions import text as X
from paperloom.operators import scoring
from tests import spec

ODD = ["", " ", "\n", "\t\n \n", "a", "• b\n\n- c", "12.5% up\n$ 1,000\n3x\n5K\n7", "Led: x\n1) Built y\n(shipped) z", "é" * 30, "x" * 210 + "\n" + "y" * 19, " a ", "a\r\n\r\nb", "2. go c++x c++ git digital", "node.js and ci/cd, rest api\nq-learning"]


def random_text(rng):
    words = ["led", "Built", "50%", "•", "-", "3x", "git", "python", "word", "2019", "é", "x" * 60, "c++", "1)", " ", "sql,", "$5"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n", " \n"]) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ODD + [random_text(rng) for _ in range(150)]


def test_scores_follow_the_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    t = F.col("text")
    rows = df.select(
        "id", scoring.structure(scoring.structure_evidence(t)).alias("structure"), scoring.formatting(scoring.formatting_evidence(t)).alias("formatting"),
        scoring.achievements(scoring.achievements_evidence(t)).alias("achievements"), scoring.keywords(scoring.keywords_evidence(t, L.SKILLS)).alias("keywords"), X.word_count(t).alias("words"),
    ).collect()
    for r in rows:
        text = texts[r.id]
        # an empty text scores nothing; a blank one has no lines
        expected = (spec.structure(text), spec.formatting(text), spec.achievements(text), spec.keywords(text, L.SKILLS), len(text.split()))
        assert (r.structure, r.formatting, r.achievements, r.keywords, r.words) == expected, repr(text)


@pytest.mark.parametrize("value,expected", [(0.5, 0), (1.5, 2), (2.5, 2), (12.5, 12), (13.5, 14), (99.0, 25), (-3.0, 0)])
def test_halves_go_to_even(spark, value, expected):
    assert spark.range(1).select(X.half_even(F.lit(value), 0, 25)).first()[0] == expected


def test_clean(spark):
    raw = "­A–b\t\tc\n\n\n\nd  \r\n e\x0bf g\n \n \n"
    assert spark.range(1).select(X.clean(F.lit(raw))).first()[0] == "A-b c\n\nd\ne\nf\ng"
    assert spark.range(1).select(X.clean(F.lit(None).cast("string"))).first()[0] == ""


def test_clean_keeps_longer_runs_of_other_line_ends(spark):
    assert spark.range(1).select(X.clean(F.lit("a\n \n \n \nb"))).first()[0] == "a\n\n\n\nb"


def test_clean_extracted(spark):
    raw = "exam-\n  ple • x\r\ny\x07z\n\n\n\nq"
    assert spark.range(1).select(X.clean_extracted(F.lit(raw))).first()[0] == "example - x\nyz\n\nq"


@pytest.mark.parametrize("text,expected", [("", False), (None, False), ("a\x00b", True), ("\x01" + "a" * 19, False), ("\x01" + "a" * 18, True), ("a\tb\n", False)])
def test_corrupted(spark, text, expected):
    assert spark.range(1).select(X.is_corrupted(F.lit(text).cast("string"))).first()[0] is expected


def test_terms_with_signs_need_a_word_character_beside_them(spark):
    df = spark.createDataFrame([("c++ here",), ("c++x",), ("digital git",), ("Node.js!",), (None,)], "t string")
    found = [r[0] for r in df.select(X.matched_terms(F.col("t"), ["c++", "git", "node.js"])).collect()]
    assert found == [[], ["c++"], ["git"], ["node.js"], []]


def test_no_python_in_text_expressions(spark):
    df = spark.createDataFrame([("a", 1)], "text string, doc_id int")
    plan = scoring.score(df, ["a b", "sql"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

import unicodedata

import pytest

from paperloom.llm import lookalike as K

MODEL = K.Model()


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Ｆｕｌｌ ｗｉｄｔｈ", "Full width"), ("café", "café"), ("re​port­", "report"), ("a b c", "a b c"), ("oﬃce ﬁeld", "office field"), ("𝐛𝐨𝐥𝐝 𝓼𝓬𝓻", "bold scr"),
        ("pаymеnt", "payment"), ("Ανailable", "Available"), ("użytkοwnikόw", "użytkowników"), ("﻿start", "start"), ("Ⓐⓑ", "Ab"),
    ],
)
def test_odd_forms(text, expected):
    assert K.normalise(text, MODEL) == expected


@pytest.mark.parametrize("text", ["", "plain", "Опыт работы", "Γλώσσα", "π and Ω", "½ day 2² ™ ª º", "👨‍🔬 👩‍💻 ✈️", "品質管理で27件", "naïve Łódź", "tab\tand\r\nend\x0b", "О себе: опыт", "cafÃ© ΓÇó"])
def test_proper_forms_stay(text):
    from paperloom.llm.encoding import Detector

    assert K.normalise(text, MODEL, Detector().garbled(text)) == text


def test_normalising_twice_changes_nothing():
    text = "Ｆｕｌｌ pаymеnt café ​👨‍🔬"
    once = K.normalise(text, MODEL)
    assert K.normalise(once, MODEL) == once and unicodedata.is_normalized("NFC", once)


def test_pairs_are_counted_over_all_fields(spark):
    """What only the second field holds decides the reading of a mixed word there."""
    df = spark.createDataFrame([(1, None, "сор"), (2, None, "сор"), (3, None, "сop")], "doc_id bigint, raw_text string, cleaned_text string")
    pairs = K.pair_counts(df, "raw_text", "cleaned_text")
    assert pairs["^с"] == pairs["со"] == pairs["ор"] == 2 and not K.pair_counts(df, "raw_text")
    got = {(r.doc_id, r.field_name): r.unified_text for r in K.unify(df, ("raw_text", "cleaned_text")).collect()}
    assert got[3, "cleaned_text"] == "сор" and got[3, "raw_text"] is None


def test_frame(spark):
    df = spark.createDataFrame([(1, "pаy", "pay", "x"), (2, "pay", None, "x"), (3, None, "a b", "x"), (1, "pаy", "pay", "x"), (4, "", "", "x")], "doc_id bigint, raw_text string, cleaned_text string, field_name string")
    assert sorted(map(tuple, K.find_lookalikes(df).collect())) == [(1, "raw_text"), (3, "cleaned_text")]
    rows = K.unify(df, ("raw_text", "cleaned_text")).collect()
    assert len(rows) == 10 and {r.unified_text for r in rows if r.doc_id == 1} == {"pay"}
    assert K.find_lookalikes(df.where("false")).count() == 0


def test_words_of_look_alikes_only(spark):
    """сору between Latin words is copy where copy is common; in its own script's company it stays."""
    rows = [(i, "please copy the CEO and ape too") for i in range(90)] + [(100, "please сору the file"), (101, "this сору, и опыт"), (102, "СЕО of it"), (103, "сору"), (104, "Москва is сор")]
    df = spark.createDataFrame(rows, "doc_id bigint, raw_text string")
    got = {r.doc_id: r.unified_text for r in K.unify(df, ("raw_text",)).where("doc_id >= 100").collect()}
    assert got == {100: "please copy the file", 101: "this сору, и опыт", 102: "CEO of it", 103: "сору", 104: "Москва is сор"}
    counts = K.word_counts(df, "raw_text")
    assert K.twin_words(counts, 95) == {"СЕО": "CEO", "сору": "copy"} and K.twin_words(counts, 10**6) == {}

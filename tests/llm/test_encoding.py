import pytest

from paperloom.llm import encoding

PROPER = ["", "plain", "Søren Ångström, Łódź", "Íñigo’s café – naïve", "EDUCAÇÃO E AÇÕES", "l’équipe d’été", "Опыт работы в компании", "Тёплый приём", "品質管理", "👩‍💻 ½ 2² ™ €5", "«Übergröße» – Žižka", "• ▪ “x”", "Γλώσσα Ω π"]


@pytest.mark.parametrize("text", PROPER)
def test_proper_text_is_no_case(text):
    assert encoding.Detector().examine(text) == (text, [])


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp850"])
@pytest.mark.parametrize("text", ["Zoë Ångström naïve café", "Größe für Übungen", "• item – “quoted” costs €5", "Łucja żółć", "Разработал систему", "品質管理"])
def test_wrong_decodings_are_undone(codec, text):
    table = {byte: char for char, byte in dict(encoding._TABLES)[codec].items()}
    garbled = "".join(chr(b) if b < 128 else table.get(b, chr(b)) for b in text.encode())
    fixed, found = encoding.Detector().examine(f"before {garbled} after")
    assert found
    if codec not in ("cp437", "cp850"):  # where every byte has a sign of its own or none at all
        assert fixed == f"before {text} after"


def test_twice_garbled():
    once = "naïve café".encode().decode("latin-1")
    twice = once.encode().decode("latin-1")
    assert encoding.Detector().examine(twice)[0] == "naïve café"


def test_lost_characters_are_told_and_stay():
    fixed, found = encoding.Detector().examine("gr��er")
    assert found and fixed == "gr��er"


def test_words_of_one_byte_a_letter():
    garbled = "Разработал систему учёта".encode("cp1251").decode("cp1252")
    fixed, found = encoding.Detector().examine(f"x {garbled} y")
    assert found and fixed == "x Разработал систему учёта y"


def test_maximal_segments():
    assert encoding.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]
    assert encoding.segments([]) == [] and encoding.segments([-1, -2]) == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "cafÃ©", True), (1, "cafÃ©", True), (2, "café", True), (3, None, True), (4, "", True), (5, "Ã©" * 20000, True)], "doc_id bigint, raw_text string, garbled boolean")
    assert sorted(r.doc_id for r in encoding.find_garbled(df).collect()) == [1, 5]
    got = {r.doc_id: r for r in encoding.repair(df).collect()}
    assert got[1].repaired_text == "café" and got[3].repaired_text is None and got[5].repaired_text == "é" * 20000
    assert encoding.find_garbled(df.where("false")).count() == 0


def test_the_mutual_information_decides(spark):
    """A pair that meets by chance only is left alone, though it could be undone; without the table it is tested."""
    text = "".join(a + b for a in "Ã©xyzuvw" for b in "Ã©xyzuvw")  # any two follow each other
    rows = [(i, text * 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, raw_text string")
    table = encoding.pair_table(df, "raw_text")
    assert table["Ã©"] < encoding.CUTOFF
    assert encoding.Detector(table).examine(text) == (text, []) and encoding.Detector({}).examine(text)[1]
    assert encoding.find_garbled(df).count() == 0


def test_pair_table_is_the_brute_force(spark):
    import math
    from collections import Counter

    texts = ["naïve cafÃ© – é", "x", "", None, "ÃÃ©é©", "日本語 and 日本", "👩‍💻é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    chars = Counter(c for t in texts if t for c in t)
    pairs = Counter(a + b for t in texts if t for a, b in zip(t, t[1:]) if not (a + b).isascii())
    size = sum(chars.values())
    expected = {p: math.log2(n * size / (chars[p[0]] * chars[p[1]])) for p, n in pairs.items()}
    got = encoding.pair_table(df, "t")
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    assert encoding.pair_table(df.where("false"), "t") == {}

import random

import pytest

from paperloom.llm import names

ENTRIES = [
    (1, "Quillmoor Systems Corporation", "organisation"), (2, "Brackenridge Centre for Analytics and Logistics", "organisation"), (3, "Society for Applied Optics", "organisation"), (4, "Calder University", "organisation"),
    (5, "Galdor University", "organisation"), (6, "Journal of Forestry and Horology", "organisation"), (7, "National Council of Metallurgy Examiners", "organisation"), (8, "Dr. Margaret Oldenock", "person"), (9, "Sir Frederick Corsten", "person"), (10, None, "person"),
]
FOUND = {
    "Quillmoor Systems Corporation": 1, "QUILLMOOR SYSTEMS CORP.": 1, "Systems Corporation, Quillmoor": 1, "Quilmoor Sytsems Corporation Ltd": 1, "  The  Quillmoor Systems Corporation, Inc. ": 1,
    "Brackenridge Ctr for Analytics & Logistics": 2, "Centre for Analytics and Logistics (Brackenridge)": 2, "BCAL": 2, "B.C.A.L.": 2, "Brackenridge Centre for Analytics and Logistics (BCAL)": 2,
    "for Applied Optics, Society": 3, "Soc. for Appl. Optics": 3, "Society fro Applied Optcis": 3, "Univ. - Calder": 4, "Caldr Universiyt": 4, "J. of Forestry & Horology": 6, "Journal-Forestry Horology": 6, "Nat. Cncl of Metallurgy Exam.": 7,
    "Peggy Oldenock": 8, "Oldenock, Dr. M.": 8, "OLDENOCK Margaret": 8, "Professor Maggie Oldnock": 8, "Margaret B. Oldenock": 8, "F. Corsten": 9, "Doctor Freddie Corsten": 9,
}
NONE = ["Society for Applied Dance", "Dr. Björn Corsten", "unknown", "-", "n/a", "", "  ", "University", "Josephine Oldenock"]


@pytest.fixture(scope="module")
def linked(spark):
    entries = spark.createDataFrame(ENTRIES, "org_id bigint, org_name string, kind string")
    typed = [(n, "x") for n in (*FOUND, *NONE, "Calder University")] + [(None, "x")]
    df = spark.createDataFrame(typed, "name string, entry string")
    return {r.name: r.entry for r in names.link(df, entries).collect()}


@pytest.mark.parametrize("name,entry", FOUND.items())
def test_variants(linked, name, entry):
    assert linked.get(name) == entry


@pytest.mark.parametrize("name", NONE)
def test_others_mean_none(linked, name):
    assert name not in linked


def test_radius_join_is_the_brute_force(spark):
    rng = random.Random(5)
    forms = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))).strip() or "a" for _ in range(160)]
    left = [(f"n{i}", f, "words") for i, f in enumerate(forms[:80])]
    right = [(i, f, "words") for i, f in enumerate(forms[80:])]
    got = {(r.name, r.entry, r.distance) for r in names.radius_join(spark.createDataFrame(left, "name string, form string, sort string"), spark.createDataFrame(right, "entry bigint, form string, sort string"), 2).collect()}
    assert got == {(n, e, names.levenshtein(a, b)) for n, a, _ in left for e, b, _ in right if names.levenshtein(a, b) <= 2}


def test_bit_parallel_distances():
    rng = random.Random(2)
    strings = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 64))) for _ in range(60)] + ["x" * 80, "é"]
    others = ["", "abc d", "a" * 64, "dcba" * 20, "é b"]
    assert names.distances(strings, others).tolist() == [[names.levenshtein(s, o) for o in others] for s in strings]
    assert names.distances([], others).shape == (0, 5) and names.distances([""], [""]).tolist() == [[0]]


def test_slips():
    assert names.slips("silvane", "silvea") == 2 and names.slips("ab", "ba") == 1 and names.slips("abc", "abc") == 0 and names.slips("", "ab") == 2


def test_items_and_empty_tables(spark):
    schema = "doc_id bigint, certifications array<struct<title:string,issuer:string>>, awards array<struct<issuer:string>>, publications array<struct<publisher:string>>"
    resumes = spark.createDataFrame([(1, [None, ("t", "Calder University")], [("x",), ("F. Corsten",)], None), (2, [("t", None)], None, [("galdor university",)])], schema)
    entries = spark.createDataFrame(ENTRIES, "org_id bigint, org_name string, kind string")
    assert {tuple(r) for r in names.find_organisations(resumes, entries).collect()} == {(1, "certifications", 1, 4), (1, "awards", 1, 9), (2, "publications", 0, 5)}
    assert names.find_organisations(resumes.where("false"), entries).count() == 0 and names.find_organisations(resumes, entries.where("false")).count() == 0

import pytest

from paperloom.llm import scan
from paperloom.llm.vocabulary import Trie

WORDS = {w: 400 for w in "modern telemetry field planner archive workflow registers turnaround product holding stakeholder throughput dashboard chess her harbour billing Varnholm SKILLS curriculum vitae".split()}


@pytest.fixture(scope="module")
def reader():
    return scan.Reader(WORDS, 4000)


@pytest.mark.parametrize("token,word", [("rnodern", "modern"), ("te1emetry", "telemetry"), ("ficld", "field"), ("p|anner", "planner"), ("arcliive", "archive"), ("workflovv", "workflow"), ("regi$ters", "registers"), ("tiirnaround", "turnaround"), ("procluct", "product"), ("ho1din9", "holding"), ("5KILLS", "SKILLS")])
def test_misread_words(reader, token, word):
    kinds, text = reader.examine(f"the {token} of {token} here")
    assert kinds == ["misread"] and word in text


def test_frequent_misreadings_are_no_words():
    """A misread form that many texts have is looked up all the same, and is no word of the vocabulary."""
    words = {"known": 3846, "related": 3564, "MATLAB": 1591, "modern": 400, "modem": 30, "knovvn": 14, "relatecl": 11, "kn0wn": 12, "MATLA8": 10, "Modem": 3}
    reader = scan.Reader(words, 4000)
    assert reader.examine("well knovvn! Knovvn, kn0wn and relatecl to MATLA8") == (["misread"], "well known! Known, known and related to MATLAB")
    assert reader.examine("a modem, Modem and rclated work")[1] == "a modem, Modem and rclated work"  # one witness alone, and that is not sure
    assert reader.examine("a modem is rclated to re1ated ones")[1] == "a modem is related to related ones"
    assert reader.wrong == {"knovvn", "relatecl", "kn0wn", "MATLA8"}
    given = scan.Reader(words, 4000, reader.wrong)
    assert given.words == reader.words and given.lower == reader.lower


@pytest.mark.parametrize("text", ["H2O k8s L10n S3", "the planenr slipped", "2019 10018-1820-18", "mail a.b@c.example", "Maintained the @retry decorator", "see Page 2 of the annex\nFrom 2018 -\n2020\n2019\n2021", "", None, " \n", "well-known\nreal-time", "A - b\nc"])
def test_no_noise(reader, text):
    assert reader.examine(text)[0] == []


def test_broken_words(reader):
    kinds, text = reader.examine("the through-\nput of the dash-\nboard was fine")
    assert kinds == ["hyphen_break"] and "throughput" in text and "dashboard" in text
    assert reader.examine("holding stakeholder-\nplanner work")[0] == []  # a compound of two known words


@pytest.mark.parametrize("form", ["Page {}", "Page {} of 3", "Seite {} von 3", "[{}]", "- {} -", "p. {}/3", "{}", "P@ge {}"])
def test_page_numbers(reader, form):
    body = "\n".join(f"some line {c}" for c in "abcdefgh")
    text = "\n".join(f"{body}\n{form.format(n)}\nNext of it" for n in (1, 2, 3))
    kinds, clean = reader.examine(text)
    assert kinds == ["page_furniture"] and form.format(2) not in clean.split("\n")


def test_headings_with_and_without_numbers():
    one, two, three = ([f"line {c}{i} of the text" for i in range(14)] for c in "abc")
    lines = one + ["CURRICULUM VITAE"] + two + ["CURRlCULUM VlTAE"] + three
    assert scan.furniture(lines) == {14, 29}
    assert scan.furniture(["CURRICULUM VITAE", *one]) == set()
    feed = one + ["Page 1", "\f", "Jane Doe  -  Resume"] + two + ["Page 2", "\f", "Jane Doe  -  Resume"] + three
    assert {14, 16, 31, 33} <= scan.furniture(feed)


def test_broken_word_over_a_page(reader):
    body = [f"some line {c}" for c in "abcdefgh"]
    kinds, text = reader.examine("\n".join(body + ["the dash-", "Page 1 of 2", "\f", "board goes on"] + body + ["Page 2 of 2"]))
    assert kinds == ["page_furniture", "hyphen_break"] and "dashboard" in text


def test_trie_retrieval_is_complete():
    words = ["abc", "abd", "xbc", "ab", "rn", "m"]
    trie = Trie({w: 1 for w in words})

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    for token in ("abc", "ac", "bbd", "q", "abcd"):
        assert {(w, c) for w, c, _ in trie.within(token, 2)} == {(w, distance(token, w)) for w in words if distance(token, w) <= 2}
    assert ("m", 1, 1) in trie.within("rn", 1, {"r": [("rn", "m")]}, edits=False)


def test_frame(spark):
    good = ["the planner of the archive was holding the field of telemetry"] * 40
    rows = [(i, t, "x") for i, t in enumerate([*good, "the p|anner and the arch!ve", None, ""])]
    df = spark.createDataFrame(rows, "doc_id bigint, raw_text string, kind string")
    assert [tuple(r) for r in scan.find_noise(df).collect()] == [(40, "misread")]
    assert scan.clean(df).count() == 43 and scan.find_noise(df.where("false")).count() == 0


def test_letters_of_like_shape_need_witnesses():
    reader = scan.Reader({w: 400 for w in "engineering workflow planner product holding modern management".split()}, 4000)
    kinds, text = reader.examine("engineeiing of a wcrkflow, a plauner, the producl and holdlng")
    assert kinds == ["misread"] and text == "engineering of a workflow, a planner, the product and holding"
    assert reader.examine("one plauner and a wcrkflow")[0] == []  # two may be slips
    assert reader.examine("the plauner of a rnodern work")[1] == "the planner of a modern work"
    # an edit beside a confusion; an edit alone is a slip
    assert reader.examine("the rnanagemet was rnodern")[1] == "the management was modern" and reader.examine("the managemet was modern")[0] == []


def test_weighted_automaton_is_the_brute_force():
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("mnrcd") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    trie = Trie({w: 1 for w in words})
    swaps = {"r": [("rn", "m", 20)], "c": [("cl", "d", 20), ("c", "d", 30)]}

    def cost(a, b, store):
        key = (len(a), len(b))
        if key not in store:
            ways = [cost(a[1:], b[1:], store)] if a and b and a[0] == b[0] else []
            ways += [c + cost(a[len(x) :], b[len(y) :], store) for s in swaps.values() for x, y, c in s if a.startswith(x) and b.startswith(y)]
            ways += [41 + cost(a[1:], b, store)] if a else []
            ways += [41 + cost(a, b[1:], store)] if b else []
            ways += [41 + cost(a[1:], b[1:], store)] if a and b else []
            store[key] = min(ways, default=0)
        return store[key]

    for _ in range(80):
        token = "".join(rng.choice("mnrcl") for _ in range(rng.randrange(1, 6)))
        expected = {(w, d) for w in words for d in [cost(token, w, {})] if d <= 61}
        assert {(w, c) for w, c, _ in trie.within(token, 61, swaps, 41)} == expected


def test_neighbours_decide_between_rivals(spark):
    """corner and comer: "cor" and "com" of one misread form, told by what stands beside them."""
    texts = ["turn round the street corner now and a late comer came in"] * 30
    misread = ["round the street c0mer now bi1ling", "and a late c0mer came bi1ling", "billing billing"]
    rows = [(i, t) for i, t in enumerate(texts + misread + ["billing"] * 30)]
    words = {"corner": 30, "comer": 30, "billing": 60, "street": 30, "late": 30}
    reader = scan.Reader(words, 4000)
    assert {"corner", "comer"} <= scan.rivals(reader)
    got = {r.doc_id: r.clean_text for r in scan.clean(spark.createDataFrame(rows, "doc_id bigint, raw_text string")).collect()}
    assert got[30] == "round the street corner now billing" and got[31] == "and a late comer came billing"


def test_page_numbers_with_a_bar():
    assert scan.furniture(["text", "1 | 3", "\f", "more", "2 | 3"]) == {1, 4} and scan.furniture(["text", "2 | 5", "\f", "more"]) == {1}
    assert scan.furniture(["text", "2 | 5", "more"]) == set()

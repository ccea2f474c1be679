import base64
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from paperloom.llm import tokens  # noqa: E402


@pytest.fixture(scope="module")
def both():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as fh:
        raw = fh.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tokens.ByteBpe(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n\t ", "aaaa" * 500, "日本語" * 200, "a\x1cb\x85c", "it's I'LL ’s", "<|endoftext|>", "x" * 5000, "ab" * 3000, "👨‍🔬 é́", "   x", "　y", "0123456789" * 60]


def test_ids_are_those_of_the_library(both):
    bpe, known = both
    rng = random.Random(3)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF)])) for _ in range(rng.randrange(400))) for _ in range(60)]
    ids, ends = bpe.encode_texts(texts)
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == known.encode_ordinary(text), repr(text[:40])


def test_the_faster_form_splits_alike(both):
    bpe, known = both
    assert bpe.split_ascii is not bpe.split
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("ab 01'smdtrevl\n\t\r\x0b\x1c\x1f.,-_ ") for _ in range(rng.randrange(60)))
        assert bpe.split_ascii(text) == bpe.split(text)


def test_long_words_are_merged_alike(both, monkeypatch):
    bpe, known = both
    word = "".join(random.Random(1).choice("abcdefgh<>/=") for _ in range(3000))
    assert bpe._long(word.encode()).tolist() == bpe.encode_words([word.encode()])[0].tolist()
    monkeypatch.setattr(tokens, "LONG_WORD", 10**9)
    assert bpe.encode_words([word.encode()])[0].tolist() == bpe._long(word.encode()).tolist()


def test_round_trip(both):
    bpe, known = both
    for text in ODD:
        ids, _ = bpe.encode_texts([text])
        assert known.decode(ids.tolist()) == text


def test_store_starts_anew(both, monkeypatch):
    bpe, known = both
    monkeypatch.setattr(tokens, "WORD_STORE", 3)
    for _ in range(3):
        ids, ends = bpe.encode_texts(["one two three four five six", "seven"])
        assert ids.tolist() == known.encode_ordinary("one two three four five six") + known.encode_ordinary("seven")


def test_frame(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x"), (None, "z", "x")], "doc_id bigint, text string, ids string")
    got = sorted((str(r.doc_id), r.ids) for r in tokens.encode(df).collect())
    assert [x[1] for x in got[:2]] == [got[0][1]] * 2 and dict(got)["2"] == [] and dict(got)["3"] == [] and len(got) == 5
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0

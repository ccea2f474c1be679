import numpy as np
import pytest

from paperloom.llm import pii, pii_train


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.load())


def kinds(finder, text, **more):
    return {(line, kind) for _, _, kind, line in finder.find([text], **more)[0]}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Jonathan Farsten\njonathan810@post.example\nTel. +49 30 23125-496\nAddress: 25 Wharf Avenue, Pellbridge XZ2 3BH", {(0, "name"), (1, "email"), (2, "phone"), (3, "address")}),
        ("• Reported to Hélène Ravham on the approval queue", {(0, "name")}), ("• Cleared for site access (NI number 960 25 3737)", {(0, "identity_number")}), ("bramgate.663 (at) mail (dot) example (dot) net / 07700 900681", {(0, "email"), (0, "phone")}),
        ("• Ticket #180818181, room B2/18", set()), ("• Order 4471-220-918 closed on 2021-03-14", set()), ("• ISBN 978-0-00-131399-0", set()), ("codehub.example/u74973", set()), ("• Office move to Harbour Street Partners headquarters", set()),
        ("• Maintained the @retry decorator and @nightly jobs", set()), ("", set()), ("SKILLS\nTableau, Kubernetes, OAuth2", set()), ("Advanced Optics Diploma, Calder University, 05/2018", set()),
    ],
)
def test_items(finder, text, expected):
    assert kinds(finder, text) == expected


def test_redaction_keeps_the_rest(finder):
    text = "• Reported to Hélène Ravham on the approval queue"
    assert pii.redacted(text, finder.find([text])[0]) == "• Reported to [NAME] on the approval queue"
    assert pii.redacted(None, []) is None and pii.redacted("x", []) == "x"


def test_stretches_longer_than_a_window(finder):
    text = " and ".join(["William Ravard wrote to ravard_william@example.org"] * 60)
    found = finder.find([text])[0]
    assert sum(k == "email" for _, _, k, _ in found) == 60 and sum(k == "name" for _, _, k, _ in found) >= 55


def test_fields(finder):
    assert kinds(finder, "+44 7700 900 643", single=True) == {(0, "phone")} and kinds(finder, "n/a", single=True) == set()


def test_viterbi_is_the_brute_force():
    from itertools import product

    tagger, rng = pii.Tagger(pii.load()), np.random.default_rng(1)
    for n in (1, 2, 3):
        scores = (rng.standard_normal((n, pii.LABELS)) * 3).astype(np.float32)
        best = max(product(range(pii.LABELS), repeat=n), key=lambda y: tagger.start[y[0]] + sum(scores[i, y[i]] for i in range(n)) + sum(tagger.trans[y[i - 1], y[i]] if y[i] in tagger.free or y[i - 1] in (y[i], y[i] - 1) else -1e9 for i in range(1, n)))
        assert tuple(tagger.decode([scores])[0]) == best


def test_gradients():
    net = pii_train.Network(1)
    data = [(np.array([7, 8, 9, 10, 11]), np.array([0, 1, 2, 2, 0])), (np.array([12, 13]), np.array([9, 10]))]
    before = net.train(data, 0.0)
    for _ in range(40):
        net.train(data, 0.02)
    assert net.train(data, 0.0) < before / 4


def test_held_out_accuracy(spark, data):
    """The tagger against labelled spans of rows that it was not trained on."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{data}/parsed_resumes.parquet").to_pylist()
    own = [pii_train.own_names(r["reference_items"], r["publications"], r["awards"]) for r in rows]
    labeller = pii_train.Labeller(pii_train.given_names(own) | {"Margaret", "William", "Josephine", "Robert"}, pii_train.surnames_of(own))
    found = pii.Finder(pii.load()).find([r["raw_text"] for r in rows])
    hits = wanted = 0
    for r, names, got in zip(rows, own, found):
        if r["raw_text"]:
            want = {(r["raw_text"].count("\n", 0, a), k) for a, _, k in labeller.spans(r["raw_text"], names)}
            hits += len(want & {(line, k) for _, _, k, line in got})
            wanted += len(want)
    assert wanted > 100 and hits / wanted > 0.95


def test_frame(spark):
    schema = "doc_id bigint, raw_text string, cleaned_text string, reference_items array<struct<email:string,phone:string>>, kind string"
    df = spark.createDataFrame([(1, "Jonathan Farsten\nx", None, [None, ("a.b@c.example", "a.b@c.example")], "k"), (1, "Jonathan Farsten\nx", None, [None, ("a.b@c.example", "a.b@c.example")], "k"), (2, None, "", None, "k")], schema)
    got = sorted(map(tuple, pii.find_personal(df).collect()))
    assert got == [(1, "raw_text", 0, "name"), (1, "reference_items.email", 1, "email"), (1, "reference_items.phone", 1, "email")]
    assert pii.find_personal(df.where("false")).count() == 0


def test_what_stands_before_a_number_tells_its_kind(finder):
    assert kinds(finder, "SSN: 078-05-1120 and Passport C01X00T47") == {(0, "identity_number")} and kinds(finder, "Passport No. 512345678") == {(0, "identity_number")}
    assert pii.settled("phone", "078-05-1120", before="National ID no: ") == "identity_number" and pii.settled("phone", "078-05-1120", before="Mobile: ") == "phone"


def test_every_line_is_read(finder):
    text = "\n \nSKILLS\nlower case only\n\n• one\n  wrapped\r\n- two\n\n\n"
    parts = pii.stretches(text)
    assert "".join("".join(text[a:b] for a, b, _ in parts).split()) == "".join(text.split())
    assert parts == [(text.index("SKILLS"), text.index("\n\n• one"), 2), (text.index("• one"), text.index("\n- two"), 5), (text.index("- two"), text.index("\n\n\n"), 7)]
    assert pii.stretches("") == [] and pii.stretches(" \n\r\n") == []
    # both parts of these names are common words of the corpus
    assert kinds(finder, "Summary\n\n• Reported to Ana Morgan on the queue\n\nLinden Finch") == {(2, "name"), (4, "name")}


def test_a_long_stretch_does_not_widen_the_others(finder):
    texts = ["so it goes " * 60_000 + "jonathan810@post.example"] + [f"Reported to Hélène Ravham on queue {k}" for k in range(300)]
    found = finder.find(texts)
    assert [x[2] for x in found[0]] == ["email"] and all([x[2] for x in own] == ["name"] for own in found[1:])


def plain_scores(weights, text):
    """The network character by character."""
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    ids = pii.char_ids(text)

    def side(name, ids):
        n = w[f"{name}_h"].shape[0]
        h, c, out = np.zeros(n), np.zeros(n), []
        for x in w["emb"][ids]:
            g = x @ w[f"{name}_x"] + h @ w[f"{name}_h"] + w[f"{name}_b"]
            i, f, o = (1 / (1 + np.exp(-g[k * n : (k + 1) * n])) for k in range(3))
            c = f * c + i * np.tanh(g[3 * n :])
            h = o * np.tanh(c)
            out.append(h)
        return np.array(out)

    return np.concatenate([side("fw", ids), side("bw", ids[::-1])[::-1]], axis=1) @ w["out"] + w["out_b"]


def test_windows_share_the_states_of_common_ends(monkeypatch):
    """Each beginning and each end of the windows is run once, and the scores are those of the plain network."""
    weights, seen, got = pii.load(), [], []
    tagger = pii.Tagger(weights)
    run, decode = tagger._run, tagger._decode
    monkeypatch.setattr(tagger, "_run", lambda side, levels: seen.append(sum(len(ids) for ids, _ in levels)) or run(side, levels))
    monkeypatch.setattr(tagger, "_decode", lambda scores, *rest: got.append(scores) or decode(scores, *rest))
    texts = [f"Reported to Hélène Ravham on queue {k % 50}" for k in range(100)] + ["Reported", "x", "", "Tel. +49 30 23125-496\nAddress: 25 Wharf Avenue, Pellbridge XZ2 3BH"]
    list(tagger.label(texts))
    beginnings = {t[:k] for t in texts for k in range(1, len(t) + 1)}
    ends = {t[-k:] for t in texts for k in range(1, len(t) + 1)}
    assert seen == [len(beginnings), len(ends)] and sum(seen) < sum(map(len, texts))
    want = np.concatenate([plain_scores(weights, t) for t in texts if t])
    assert np.abs(got[0].T - want).max() < 0.02


def test_stretches_without_an_item_are_told_from_the_scores():
    """Stretches that are not decoded have no item in the best way; random scores around the cutoff."""
    tagger, rng = pii.Tagger(pii.load()), np.random.default_rng(3)
    lengths = rng.integers(1, 9, 4000)
    scores = [(rng.standard_normal((n, pii.LABELS)) * 1.5 + np.array([3.0] + [0.0] * (pii.LABELS - 1))).astype(np.float32) for n in lengths]
    flat, begins = np.ascontiguousarray(np.concatenate(scores).T), np.cumsum(lengths) - lengths
    held = tagger.held(flat, begins, lengths)
    tagger.held = lambda scores, begins, lengths: np.ones(len(lengths), dtype=bool)
    some = np.array([labels.any() for labels in tagger.decode(scores)])
    assert not (some & ~held).any() and some.sum() > 500 and (~held).sum() > 500


def test_places_are_found_without_the_redacted_texts(spark):
    df = spark.createDataFrame([(1, "Jonathan Farsten\nx", None, None)], "doc_id bigint, raw_text string, cleaned_text string, reference_items array<struct<email:string,phone:string>>")
    assert "redacted_text" not in pii.find_personal(df)._jdf.queryExecution().analyzed().toString() and pii.examine(df).first()["redacted_text"] == "[NAME]\nx"

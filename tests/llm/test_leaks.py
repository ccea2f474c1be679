import random

from paperloom.llm import leaks


def brute(docs, items, least):
    grams = {}
    for key, text in items:
        w = leaks.words_of(text)
        for i in range(len(w) - least + 1):
            grams.setdefault(tuple(w[i : i + least]), set()).add(key)
    return {(d, k) for d, t in docs for w in [leaks.words_of(t)] for i in range(len(w) - least + 1) for k in grams.get(tuple(w[i : i + least]), ())}


def corpus(seed, count, size, vocabulary=6):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcdefgh"[:vocabulary]) for _ in range(rng.randrange(size)))) for i in range(count)]


def test_automaton_is_the_brute_force(spark):
    for seed in range(12):
        items, docs = corpus(seed, 12, 40, 4), corpus(seed + 99, 40, 60, 4)
        a = leaks.SuffixAutomaton([(k, leaks.words_of(t)) for k, t in items], 5)
        assert {(d, a.keys[n]) for d, t in docs for n in a.leaked(leaks.words_of(t))} == brute(docs, items, 5)


def test_words():
    assert leaks.words_of("A-b, C_d 1é2 KelvinK") == ["a", "b", "c", "d", "1", "2", "kelvin"]
    assert leaks.words_of(None) == [] and leaks.words_of("é—") == []


def test_frames(spark, monkeypatch):
    docs = [(i, t, "x") for i, t in corpus(5, 60, 80, 4)] + [(100, None, "x"), (101, "", "x"), (0, corpus(5, 60, 80, 4)[0][1], "x")]
    items = [(i, t) for i, t in corpus(6, 20, 50, 4)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute([(k, t or "") for k, t, _ in docs], items, 6)
    assert {tuple(r) for r in leaks.find_leaks(d, e, 6).collect()} == expected
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)  # several automata
    rows = leaks.find_leaks(d, e, 6).collect()
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    assert leaks.find_leaks(d, e.where("false"), 6).count() == 0 and leaks.find_leaks(d.where("false"), e, 6).count() == 0


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"Start of it. {item.upper()}! And the end of a text that goes on well beyond what was found in it, so it stays."), (2, item), (3, "clean"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    got = {r.doc_id: r for r in leaks.remove_leaks(docs, items).collect()}
    assert got[1].clean_text.startswith("Start of it. ! And") and got[1].removed_words == 12
    assert got[2].clean_text is None and got[2].coverage == 1.0 and got[3].clean_text == "clean" and got[4].clean_text is None


def brute_removed(text, items, least):
    """The words that stay: those in no run of ``least`` words that some item holds."""
    words, gone = leaks.words_of(text), set()
    held = {tuple(w[i : i + least]) for w in map(leaks.words_of, items) for i in range(len(w) - least + 1)}
    for i in range(len(words) - least + 1):
        if tuple(words[i : i + least]) in held:
            gone.update(range(i, i + least))
    return [w for i, w in enumerate(words) if i not in gone], len(gone)


def test_removal_does_not_depend_on_the_blocks(spark, monkeypatch):
    line = [f"w{i}" for i in range(40)]
    overlapping = [" ".join(line[a:b]) for a, b in ((3, 15), (9, 22), (20, 34))]
    text = "; ".join(["before", *line, "after"])
    noise, more = corpus(3, 30, 50, 3), corpus(4, 12, 40, 3)
    docs = spark.createDataFrame([(-1, text), *noise], "doc_id bigint, text string")
    items = [*enumerate(overlapping), *((i + 10, t) for i, t in more)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = []
    for size in (5, 60, 400_000):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", size)
        found.append(sorted(map(tuple, leaks.remove_leaks(docs, frame, 10, 1.1).collect())))
    assert found[0] == found[1] == found[2]
    for key, clean, removed, share in found[0]:
        given = dict([(-1, text), *noise])[key]
        kept, gone = brute_removed(given, [t for _, t in items], 10)
        assert (leaks.words_of(clean), removed) == (kept, gone)
        assert share == (gone / len(leaks.words_of(given)) if gone else 0)
    assert next(removed for key, _, removed, _ in found[0] if key == -1) == 31
    # the share of all items together decides
    assert leaks.remove_leaks(docs, frame, 10, 0.7).where("doc_id = -1").first().clean_text is None

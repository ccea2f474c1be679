import random

from paperloom.llm import neardup


def texts(seed=3, families=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def brute(rows, least, size):
    sets = {k: set(zip(*(t.lower().split()[i:] for i in range(size)))) for k, t in rows if t}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, class string, a int")


def test_pairs_are_the_brute_force(spark):
    own = texts()
    rows = list(enumerate(own + own[:3] + [None, "", "two words", own[0].upper() + "  "]))
    got = [tuple(r) for r in neardup.all_pairs(frame(spark, rows), 0.6, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 3)


def test_chunks_keep_the_pigeonhole_promise():
    """Signatures that differ in fewer places than the promise share a key."""
    signer, rng = neardup.Signer(), random.Random(1)
    limit = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for _ in range(300):
        places = set(rng.sample(range(signer.width), limit))
        assert any(not places & set(subset) for subset in signer.subsets.tolist())


def test_groups(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    chain = [" ".join(base[:k] + [f"n{j}" for j in range(k)] + base[k:]) if False else " ".join(base[:-k] + [f"n{j}" for j in range(k)]) if k else " ".join(base) for k in range(4)]
    rows = list(enumerate(chain + [chain[0], "quite another text of some more words", None]))
    got = {r.doc_id: r for r in neardup.groups(frame(spark, rows), 0.75, 3).collect()}
    assert {got[k].group for k in range(5)} == {0} and got[4]["class"] == 0 and got[5].group == 5 and got[5].links == 0 and 6 not in got


def test_groups_have_a_row_for_each_text(spark, tmp_path):
    """The query too: texts without a word sequence are classes of their own."""
    from paperloom.llm import queries

    rows = [(1, "a b c d"), (2, "A b c  d"), (3, None), (4, " "), (5, "two words"), (6, "two words")]
    expected = [(1, 1, 0, 1), (2, 1, 0, 1), (3, 3, 0, 3), (4, 4, 0, 4), (5, 5, 0, 5), (6, 6, 0, 6)]
    spark.createDataFrame(rows, "doc_id bigint, cleaned_text string").write.parquet(f"{tmp_path}/parsed_resumes.parquet")
    assert sorted(map(tuple, queries.p5_groups(spark, str(tmp_path)).collect())) == expected


def test_hot_group_of_copies(spark):
    """A third of the rows are one text; they are one class, joined once."""
    own = texts(9, 10)
    rows = list(enumerate(own + [own[0]] * (len(own) // 2)))
    links, members = neardup.similar(frame(spark, rows), 0.6, 3)
    copies = members.where("class = 0").count()
    assert copies >= len(own) // 2 + 1 and links.where("a = b").count() == 0


def test_empty(spark):
    assert neardup.all_pairs(frame(spark, [(1, None)]), 0.6, 3).count() == 0
    assert neardup.groups(frame(spark, [(1, "a b")]), 0.6, 3).count() == 0


def test_a_hot_key_is_dealt_out(spark, monkeypatch):
    """20,000 texts under one key: no cell holds many of them, and each two meet in a cell."""
    from pyspark.sql import functions as F

    n = 20_000
    base = spark.range(n).select(F.col("id"), F.when(F.col("id") < n - 2, F.array(F.lit(7), F.col("id") + 1000)).otherwise(F.array(F.lit(8))).cast("array<bigint>").alias("keys"))
    cells = neardup._cells(base)
    sizes = cells.groupBy("cell").count()
    blocks = -(-(n - 2) // neardup.GROUP)
    assert sizes.count() == blocks * (blocks + 1) // 2 + 1  # and the pair of the other key
    assert sizes.agg(F.max("count")).first()[0] < 2.4 * neardup.GROUP
    monkeypatch.setattr(neardup, "GROUP", 8)
    small = neardup._cells(base.where("id < 50")).collect()
    met = {}
    for r in small:
        met.setdefault(r.cell, ([], []))[int(r.side)].append(r.id)
    found = {frozenset((a, b)) for left, right in met.values() for a in left for b in (right or left) if a != b}
    assert len(found) == 50 * 49 // 2


def test_pairs_of_hot_keys_are_the_brute_force(spark, monkeypatch):
    """Edited copies of one text, more than a block holds."""
    monkeypatch.setattr(neardup, "GROUP", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = [tuple(r) for r in neardup.all_pairs(frame(spark, rows), 0.6, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 3)

"""Problem 5: pairs and groups of texts with nearly the same words.

Each text gets a signature of min-hashes of its word sequences, cut into chunks. Two texts
whose signatures differ in fewer than ``chunks * (errors + 1)`` places have, by the
pigeonhole principle, some chunk with at most ``errors`` differences; enumerating the
allowed errors of every chunk as keys therefore meets all of them. Keys that one text alone
has are left out, and the group of a key that many share is dealt out as pairs of blocks.
Signatures are compared inside a block or between two, and the pairs under the distance
threshold are checked against the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.leaks import pa_type
from paperloom.session import checkpoint

#: Chunks of the signature, symbols in a chunk, and errors allowed in a chunk.
CHUNKS, SYMBOLS, ERRORS = 12, 4, 1
#: Texts of a key that are compared in one place, on an average. The group of a key with more
#: is cut into blocks of this size, and each two blocks meet in a place of their own.
GROUP = 2048
#: Signatures compared at a time.
BLOCK = 512
_STORE = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class Signer:
    """Signatures, keys and fingerprints of texts."""

    def __init__(self, size: int = 3, chunks: int = CHUNKS, symbols: int = SYMBOLS, errors: int = ERRORS, seed: int = 11):
        self.size, self.width = size, chunks * symbols
        rng = np.random.default_rng(seed)
        self.times = rng.integers(1, 2**63, self.width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 2**63, self.width, dtype=np.uint64)
        kept = list(combinations(range(symbols), symbols - errors))
        #: places of the signature that make up each key
        self.subsets = np.array([[c * symbols + i for i in places] for c in range(chunks) for places in kept])
        self.salt = _finish(np.arange(1, len(self.subsets) + 1, dtype=np.uint64) * _MIX2)
        self.store: dict[str, int] = {}

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word sequences of all texts in one array, and the texts' ends."""
        if len(self.store) > _STORE:
            self.store.clear()
        store, hashed, counts = self.store, [], []
        for text in texts:
            words = text.lower().split()
            counts.append(len(words))
            for word in words:
                h = store.get(word)
                if h is None:
                    h = store[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
                hashed.append(h)
        counts = np.array(counts, dtype=np.int64)
        h = np.array(hashed, dtype=np.uint64)
        n = len(h) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        out = h[:n].copy()
        for k in range(1, self.size):
            out = _finish(out) + h[k : n + k] * _MIX2
        out = _finish(out)
        ends = np.cumsum(counts)
        inside = np.ones(n, dtype=bool)
        for k in range(1, self.size):  # sequences that would reach into the next text
            late = ends - k
            inside[late[(late >= 0) & (late < n) & (late >= ends - counts)]] = False
        return out[inside], np.cumsum(np.maximum(counts - self.size + 1, 0))

    def sign(self, texts: list[str]) -> list[tuple[bytes, list[int], bytes] | None]:
        """(fingerprint of the set, keys, signature of a byte a symbol), or None if there is no sequence."""
        found, ends = self.shingles(texts)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        full = np.flatnonzero(ends > begins)
        out: list[tuple[bytes, list[int], bytes] | None] = [None] * len(texts)
        if not len(full):
            return out
        at = begins[full]
        mins = np.empty((len(full), self.width), dtype=np.uint64)
        for k in range(self.width):
            mins[:, k] = np.minimum.reduceat(found * self.times[k] + self.plus[k], at)
        mins = _finish(mins)
        keys = np.zeros((len(full), len(self.subsets)), dtype=np.uint64)
        for k in range(self.subsets.shape[1]):
            keys = _finish(keys + mins[:, self.subsets[:, k]]) * _MIX2
        keys = (keys + self.salt).view(np.int64)
        small = (mins & np.uint64(255)).astype(np.uint8)
        for row, i in enumerate(full.tolist()):
            unique = np.unique(found[begins[i] : ends[i]])
            out[i] = (xxhash.xxh3_128_digest(unique.tobytes()), keys[row].tolist(), small[row].tobytes())
        return out


def jaccard(a: str, b: str, size: int = 3) -> float:
    """Similarity of the sets of word sequences of two texts."""
    left, right = a.lower().split(), b.lower().split()
    x = set(zip(*(left[i:] for i in range(size))))
    y = set(zip(*(right[i:] for i in range(size))))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def signed(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, fp, keys, sig) of each text with at least one word sequence."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(i, x) for i, x in enumerate(signer.sign(part.column(1).to_pylist())) if x]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([i for i, _ in rows], pa.int32())), pa.array([x[0] for _, x in rows], pa.binary()), pa.array([x[1] for _, x in rows], pa.list_(pa.int64())), pa.array([x[2] for _, x in rows], pa.binary())],
                    names=schema.names,
                )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return source.mapInArrow(run, schema)


def _cells(base: DataFrame) -> DataFrame:
    """(cell, side, id): the places at which the ids of ``base`` (id, keys) are to be compared.

    A cell holds the ids of one key, or of one block of a key that many ids have (side 0),
    or of two blocks that meet (sides 0 and 1), so that no cell grows with the data. Counts
    are summed before they are shuffled, and only keys that are shared go on.
    """
    rows = base.select(F.explode("keys").alias("key"), "id")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(shared, "key")
    blocks = F.ceil(F.col("n") / F.lit(GROUP)).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key", "id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    apart = met.where("blocks > 1").select("key", "id", "own", other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    apart = apart.select(F.xxhash64("key", low, high).alias("cell"), (F.col("own") > F.col("other")).alias("side"), "id")
    return met.where("blocks = 1").select(F.col("key").alias("cell"), F.lit(False).alias("side"), "id").unionByName(apart)


def _near(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Which rows of two tables of signatures differ in at most `most` places."""
    if len(left) * len(right) <= 4096:
        return (left[:, None, :] != right[None, :, :]).sum(axis=2) <= most
    differ = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(left.shape[1]):
        differ += left[:, k, None] != right[None, :, k]
    return differ <= most


def _close(batches: Iterator[pa.RecordBatch], most: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, id, signature) sorted by cell: the pairs of each cell whose signatures differ in at most `most` places."""

    def pairs(sides: list[bool], ids: list, sigs: list[bytes]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(ids), -1)
        second = np.array(sides, dtype=bool)
        rows = np.flatnonzero(~second)
        others = np.flatnonzero(second) if second.any() else rows
        for i in range(0, len(rows), BLOCK):
            for j in range(0 if others is not rows else i, len(others), BLOCK):
                a, b = rows[i : i + BLOCK], others[j : j + BLOCK]
                near = _near(table[a], table[b], most)
                if others is rows and i == j:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                both = [(min(p, q), max(p, q)) for p, q in zip((ids[k] for k in a[x].tolist()), (ids[k] for k in b[y].tolist())) if p != q]
                if both:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in both], id_type), pa.array([q for _, q in both], id_type)], names=["a", "b"])

    cell, sides, ids, sigs = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(cells)) + 1
        columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            if cell is not None and cells[lo] != cell:
                if len(ids) > 1:
                    yield from pairs(sides, ids, sigs)
                sides, ids, sigs = [], [], []
            cell = cells[lo]
            sides += columns[0][lo:hi]
            ids += columns[1][lo:hi]
            sigs += columns[2][lo:hi]
    if len(ids) > 1:
        yield from pairs(sides, ids, sigs)


def _verified(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """Candidates (a, b) whose texts have at least the similarity asked for."""
    id_type = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [jaccard(x, y, size) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = [i for i, x in enumerate(found) if x >= least]
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([found[i] for i in keep], pa.float64())], names=schema.names)

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    own = texts.join(wanted, "id", "left_semi")
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def similar(df: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts, and the members of the classes.

    Returns ``links(a, b, similarity)`` between class representatives, a < b, and
    ``members(id, class)``, where the representative is the least id of those with the same
    set of word sequences. The id must be unique. Null texts and texts of fewer words than
    ``size`` are in no class. The distance threshold lies four deviations above what two
    texts at the limit of the similarity are expected to differ by. Pairs are guaranteed a
    common key up to ``CHUNKS * (ERRORS + 1) - 1`` different symbols; those between that
    and the threshold have one with a probability that the README states with the recall
    measured.
    """
    width = CHUNKS * SYMBOLS
    most = int(width * (1 - least) + 4 * (width * least * (1 - least)) ** 0.5)
    base = checkpoint(signed(df, id_col, text_col, size))
    classes = base.groupBy("fp").agg(F.min("id").alias("class"))
    members = base.select("id", "fp").join(classes, "fp").select("id", "class")
    # the representative's own row carries the keys, so nothing large is aggregated
    firsts = base.join(classes.select(F.col("class").alias("id")), "id", "left_semi")
    rows = _cells(firsts.select("keys", "id")).join(firsts.select("id", "sig"), "id").select("cell", "side", "id", "sig")
    rows = rows.repartition("cell").sortWithinPartitions("cell")
    id_type = pa_type(base.schema["id"].dataType)
    schema = T.StructType([T.StructField("a", base.schema["id"].dataType), T.StructField("b", base.schema["id"].dataType)])
    near = rows.mapInArrow(lambda batches: _close(batches, most, id_type), schema).distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _verified(checkpoint(near), texts, least, size), members


def all_pairs(df: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b) of all texts at or above the similarity, copies included."""
    links, members = similar(df, least, size, id_col, text_col)
    left = members.select(F.col("class").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    between = links.join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return between.union(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def groups(df: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class, links, group): each text's class, its links to other classes, and its group.

    Groups are the connected components of the links; the group's name is its least id.
    Labels run along the links, and each round also jumps to the label of the label, so
    the rounds grow with the logarithm of the longest chain.
    """
    links, members = similar(df, least, size, id_col, text_col)
    links = checkpoint(links.select("a", "b"))
    both = links.union(links.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    label = both.select(F.col("a").alias("id")).distinct().withColumn("group", F.col("id"))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        step = label.join(near, "id").select("id", F.col("group").alias("old"), F.least("group", "near").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        after = checkpoint(step.join(jump, "new").select("id", "old", F.least("new", "far").alias("group")))
        label = after.select("id", "group")
        if after.where("old <> group").isEmpty():
            break
    out = members.join(degree.withColumnRenamed("a", "class"), "class", "left").join(label.withColumnRenamed("id", "class"), "class", "left")
    return out.select(F.col("id").alias(id_col), "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))


def groups_of_all(df: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``groups`` with a row for each id: one whose text is null or has no word sequence is a class of its own, without links."""
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    out = ids.join(groups(df, least, size, id_col, text_col), id_col, "left")
    return out.select(id_col, F.coalesce("class", id_col).alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", id_col).alias("group"))

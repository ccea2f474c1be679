"""Problem 4: link typed names to the organisation or person they mean.

Names are brought to comparable forms (case, accents, legal suffixes, reordered parts,
abbreviations, nicknames) and joined by edit distance in a partitioned metric space: each
entry belongs to the cell of its nearest pivot, each name is replicated to all cells that
the triangle inequality cannot exclude, and inside a cell an exact radius join runs with a
true metric (Levenshtein, bit-parallel over many names at a time).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.leaks import pa_type
from paperloom.session import checkpoint

#: Radius of the metric join, wide enough for two swapped pairs of letters, and the slips accepted.
RADIUS, SLIPS = 4, 2
PIVOTS = 24
#: Entries on which pivots are chosen at most; all entries are joined.
PIVOT_SAMPLE = 4000
#: Entries in one block of a cell, and typed forms in one chunk of it; a block meets a chunk in one task.
BLOCK, CHUNK = 500, 1000
#: A word that stands in one of so many names is a word of its own, not a slip.
TOKEN_SHARE = 10_000
OWN_WORD = 0.15

STOP = frozenset(("of", "for", "and", "the", "on", "in", "at", "de", "la", "und", "y", "et"))
LEGAL = frozenset(("ltd", "inc", "gmbh", "ev", "llc", "plc", "ag", "sa", "bv", "limited", "incorporated", "online", "co", "kg"))
TITLES = frozenset(("dr", "prof", "professor", "doctor", "sir", "dame", "mr", "mrs", "ms", "miss", "rev", "hon", "lady", "lord"))
#: Usual abbreviations.
SHORT = {
    "association": "assoc", "international": "intl", "professionals": "prof", "european": "eur", "federation": "fed", "engineers": "engrs", "society": "soc",
    "applied": "appl", "institute": "inst", "university": "univ", "corporation": "corp", "proceedings": "proc", "conference": "conf", "certification": "cert",
    "foundation": "fdn", "research": "res", "department": "dept", "centre": "ctr", "national": "nat", "council": "cncl", "examiners": "exam", "technical": "tech",
    "publishing": "publ", "group": "grp", "academic": "acad", "journal": "j", "committee": "cttee", "laboratory": "lab", "management": "mgmt", "engineering": "eng",
}
LONG = {v: k for k, v in SHORT.items()} | {"center": "centre", "assn": "association", "engr": "engineers", "jour": "journal", "jnl": "journal", "dep": "department", "found": "foundation", "coll": "college", "natl": "national", "exams": "examiners", "syst": "systems"}
#: Usual short forms of given names.
NICK = {
    "alexander": "alex sasha sandy xander al", "benjamin": "ben benny benji", "christina": "chris tina chrissy", "dorothea": "dora dot thea dolly dottie", "edward": "ed ted ned eddie teddy",
    "elizabeth": "liz beth lizzie betty eliza libby bess", "frederick": "fred freddy freddie", "gabriella": "gabby ella gabi", "jonathan": "jon jonny johnny nathan", "josephine": "jo josie joey",
    "katherine": "kate kathy katie kat kitty", "margaret": "maggie peggy meg marge greta", "matthias": "mats matt matti", "nicholas": "nick nicky nico", "patricia": "pat trish patty tricia",
    "robert": "bob rob bobby robbie", "susannah": "sue susie suzie", "theodore": "theo ted teddy", "veronica": "vera ronnie nica", "william": "will bill billy willy liam", "richard": "dick rick richie",
    "james": "jim jimmy jamie", "john": "jack johnny", "michael": "mike mick", "thomas": "tom tommy", "anthony": "tony", "charles": "charlie chuck", "samuel": "sam sammy", "daniel": "dan danny", "joseph": "joe joey",
}
_FULL: dict[str, list[str]] = {}
for _name, _nicks in NICK.items():
    for _nick in _nicks.split():
        _FULL.setdefault(_nick, []).append(_name)

_ACRONYM = re.compile(r"[A-Za-z](?:\.?[A-Za-z]){2,7}\.?")
_FOLD = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "đ": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_FOLD)) if not unicodedata.combining(c)).lower()


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"['’.]", "", fold(text).replace("e. v.", "ev")) if "." in text or "'" in text or "’" in text else fold(text))


@lru_cache(maxsize=100_000)
def _near_stop(word: str) -> bool:
    """A small word, or one slip away from one."""
    if word in STOP:
        return True
    return 2 <= len(word) <= 4 and any(slips(word, s, 1) <= 1 for s in (("for", "and", "the") if len(word) == 2 else ("of", "for", "and", "the", "on")))


@lru_cache(maxsize=100_000)
def _near_short(word: str) -> bool:
    """One slip away from an abbreviation."""
    return len(word) <= 4 and any(slips(word, s, 1) <= 1 for s in LONG if len(s) > 1)


def slips(a: str, b: str, most: int = 99) -> int:
    """Damerau-Levenshtein distance: insertions, deletions, changes and swaps of neighbours.

    The unrestricted form, in which letters may stand between two swapped ones; it is a metric.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    begin, end = 0, 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    far = len(a) + len(b)
    last_row: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_match = 0
        for j, y in enumerate(b, 1):
            row, column = last_row.get(y, 0), last_match
            if x == y:
                last_match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][column] + (i - row - 1) + 1 + (j - column - 1))
        last_row[x] = i
    return d[-1][-1]


def acronym(words: list[str]) -> str:
    return "".join(w[0] for w in words if w not in STOP)


def entry_forms(name: str, kind: str | None) -> list[tuple[str, str]]:
    """(form, sort) of an entry of the reference; sorts are words, short, initial and acronym."""
    words = [w for w in words_of(name)]
    if kind == "person":
        words = [w for w in words if w not in TITLES]
        if len(words) < 2:
            return [(" ".join(words), "person")] if words else []
        return [(f"{words[0]} {words[-1]}", "person"), (f"{words[0][0]} {words[-1]}", "initial")]
    main = [w for w in words if w not in STOP]
    forms = [(" ".join(main), "words")]
    short = " ".join(SHORT.get(w, w) for w in main)
    if short != forms[0][0]:
        forms.append((short, "short"))
    if len(main) >= 3:
        forms.append((acronym(main), "acronym"))
    return forms


def typed_forms(name: str | None) -> list[tuple[str, str]]:
    """Forms under which a typed name may be an entry."""
    if not name or not name.strip():
        return []
    text = re.sub(r"\s+", " ", name.strip())
    forms: dict[tuple[str, str], None] = {}
    bare = text.replace(".", "")
    if _ACRONYM.fullmatch(text) and 3 <= len(bare) <= 8 and (bare.isupper() or bare.islower()):
        forms[(bare.lower(), "acronym")] = None
    m = re.fullmatch(r"(.*\S)\s*\(([A-Za-z.\-]{2,10})\)\W*", text)
    if m and m.group(2).replace(".", "").isupper():
        text = m.group(1)
    text = re.sub(r"[\s,]+(?:ltd|inc|gmbh|e\.\s?v|llc|plc|limited|online)\.?$", "", text, flags=re.I)
    parts = [p for p in re.split(r"\s*[,(]\s*|\)\s*|\s+[-–/|]\s+", text) if p.strip()]
    orders = [text] if len(parts) < 2 else [text, " ".join(parts[1:] + parts[:1])]
    for order in orders:
        words = words_of(order)
        while words and words[-1] in LEGAL:
            words.pop()
        for main in ([w for w in words if not _near_stop(w)], [w for w in words if w not in STOP and (not _near_stop(w) or _near_short(w))]):
            if not main:
                continue
            raw, full = " ".join(main), " ".join(LONG.get(w, w) for w in main)
            forms[(raw, "words")] = None
            if any(w in LONG for w in main):
                # "acad" and "prof" mean two things each
                forms[(full, "words")] = None
            forms[(raw, "short")] = None
        people = [w for w in words if w not in TITLES]
        if 2 <= len(people) <= 4 and all(w.isalpha() for w in people):
            for given, surname in ((people[0], people[-1]), (people[-1], people[0])):
                if len(surname) > 2:
                    if len(given) == 1:
                        forms[(f"{given} {surname}", "initial")] = None
                    else:
                        for own in [given, *_FULL.get(given, [])]:
                            forms[(f"{own} {surname}", "person")] = None
    return list(forms)


_ALPHABET = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}
_CODES = np.full(128, 255, dtype=np.uint8)
for _char, _code in _ALPHABET.items():
    _CODES[ord(_char)] = _code


def _plain(strings: list[str]) -> bool:
    """Whether bit-parallel distances serve the strings."""
    return all(len(s) <= 64 and s.isascii() and not _OTHER.search(s) for s in strings)


_OTHER = re.compile(r"[^ a-z0-9]")


class Bits:
    """Bit-parallel Levenshtein distances of many strings to one, 64 characters at most."""

    def __init__(self, strings: list[str]):
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.masks = np.zeros((len(_ALPHABET), len(strings)), dtype=np.uint64)
        # one place of all strings at a time; those that are shorter have a code of their own there
        width = int(self.sizes.max(initial=0))
        codes = np.frombuffer("".join(s.ljust(width, "\x7f") for s in strings).encode("ascii"), dtype=np.uint8).reshape(len(strings), width)
        codes, rows = _CODES[codes], np.arange(len(strings))
        for i in range(width):
            here = codes[:, i] < len(_ALPHABET)
            self.masks[codes[here, i], rows[here]] |= np.uint64(1 << i)

    def to(self, other: str, rows: np.ndarray | None = None) -> np.ndarray:
        """Distances to ``other`` of all strings, or of those of the rows."""
        sizes = self.sizes if rows is None else self.sizes[rows]
        one = np.uint64(1)
        plus = np.full(len(sizes), ~np.uint64(0))
        minus = np.zeros(len(sizes), dtype=np.uint64)
        score = sizes.copy()
        top = np.left_shift(one, np.maximum(sizes - 1, 0).astype(np.uint64))
        for c in other:
            match = self.masks[_ALPHABET[c]] if rows is None else self.masks[_ALPHABET[c]][rows]
            x = match | minus
            d0 = (((x & plus) + plus) ^ plus) | x
            up = minus | ~(d0 | plus)
            down = d0 & plus
            score += (up & top) != 0
            score -= (down & top) != 0
            shifted = (up << one) | one
            minus = shifted & d0
            plus = (down << one) | ~(shifted | d0)
        return np.where(sizes == 0, len(other), score)


def levenshtein(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def distances(strings: list[str], others: list[str]) -> np.ndarray:
    """Levenshtein distances of all strings to all others, of any length and characters."""
    out = np.zeros((len(strings), len(others)), dtype=np.int64)
    fast = [k for k, s in enumerate(strings) if _plain([s])]
    bits, slow = Bits([strings[k] for k in fast]) if fast else None, sorted(set(range(len(strings))) - set(fast))
    for j, other in enumerate(others):
        plain = bits is not None and not _OTHER.search(other)
        if plain:
            out[fast, j] = bits.to(other)
        for k in slow if plain else range(len(strings)):
            out[k, j] = levenshtein(strings[k], other)
    return out


def choose_pivots(forms: list[str], count: int = PIVOTS) -> list[str]:
    """Forms far from each other, farthest first."""
    if not forms:
        return []
    forms = sorted(set(forms))
    pivots = [forms[0]]
    nearest = distances(forms, pivots)[:, 0]
    while len(pivots) < min(count, len(forms)):
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        pivots.append(forms[far])
        nearest = np.minimum(nearest, distances(forms, [forms[far]])[:, 0])
    return pivots


def radius_join(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``left`` with the forms of ``right`` within the radius: see ``near_forms``."""
    return left.join(near_forms(left, right, radius), ["form", "sort"])


def near_forms(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(form, sort, entry, entry_form, distance): all pairs of different forms of one sort within the radius.

    ``left(form, sort)`` and ``right(entry, form, sort)``. Each right form lies in the
    cell of its nearest pivot p; a left form q can have partners there only if
    d(q, p) - d(q, nearest pivot) <= 2 * radius, so it is sent to just those cells. Cells
    are cut into blocks, so none is held by one task, and forms whose distances to the
    pivot differ by more than the radius are not compared. Left forms are read in chunks,
    so a hot cell makes many rows of bounded size, which are dealt out evenly.
    """
    spark = left.sparkSession
    sample = [r[0] for r in right.select("form").distinct().orderBy(F.xxhash64("form")).limit(PIVOT_SAMPLE).collect()]
    pivots = choose_pivots(sample)
    entry_type = right.schema["entry"].dataType
    schema = T.StructType([T.StructField("form", T.StringType()), T.StructField("sort", T.StringType()), T.StructField("entry", entry_type), T.StructField("entry_form", T.StringType()), T.StructField("distance", T.IntegerType())])
    if not pivots:
        return spark.createDataFrame([], schema)

    def own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(batch.column(1).to_pylist(), pivots)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell], pa.int32())], names=["entry", "form", "sort", "cell", "far"])

    def all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(batch.column(0).to_pylist(), pivots)
                row, cell = np.nonzero(far - far.min(axis=1, keepdims=True) <= 2 * radius)
                part = batch.take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(far[row, cell], pa.int32())], names=["form", "sort", "cell", "far"])

    entries = right.select("entry", "form", "sort").mapInArrow(own_cell, T.StructType([T.StructField("entry", entry_type), *(T.StructField(n, t) for n, t in (("form", T.StringType()), ("sort", T.StringType()), ("cell", T.IntegerType()), ("far", T.IntegerType())))]))
    def grouped(rows: DataFrame, size: int, columns: list[str], name: str) -> DataFrame:
        """Rows of a cell in lists of about ``size``; a row goes to one of them by its form's hash."""
        counts = rows.groupBy("cell", "sort").agg(F.ceil(F.count("*") / size).alias("parts"))
        placed = rows.join(counts, ["cell", "sort"]).withColumn("part", F.pmod(F.xxhash64("form"), "parts"))
        return placed.groupBy("cell", "sort", "part").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("part")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    different = left.select("form", "sort").repartition(tasks, "form", "sort").distinct()
    typed = checkpoint(different.mapInArrow(all_cells, "form string, sort string, cell int, far int"))
    blocks = grouped(entries, BLOCK, ["entry", "form", "far"], "entries")
    chunks = grouped(typed, CHUNK, ["form", "far"], "forms")
    met = chunks.join(blocks, ["cell", "sort"]).select("sort", "forms", "entries").repartition(tasks)
    entry_arrow = pa_type(entry_type)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sort, forms, block = (batch.column(i)[row].as_py() for i in range(3))
                here = [x["form"] for x in forms]
                far, size = np.array([x["far"] for x in forms]), np.array([len(f) for f in here])
                bits = Bits(here) if _plain(here) else None
                found: list[tuple] = []
                for item in block:
                    own = item["form"]
                    near = np.flatnonzero((np.abs(far - item["far"]) <= radius) & (np.abs(size - len(own)) <= radius))
                    if not len(near):
                        continue
                    d = bits.to(own, near) if bits is not None and not _OTHER.search(own) else distances([here[k] for k in near.tolist()], [own])[:, 0]
                    for k in np.flatnonzero(d <= radius).tolist():
                        found.append((here[near[k]], sort, item["entry"], own, int(d[k])))
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], entry_arrow), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int32())], names=schema.names)

    return met.mapInArrow(compare, schema)


def _token_counts(names: DataFrame) -> dict[str, int]:
    """In how many rows each word stands, of words that are no rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in set(words_of(name)):
                    total[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    most = names.agg(F.sum("n")).first()[0] or 0
    counts = names.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.where(F.col("n") >= most / TOKEN_SHARE).collect()}


def _slips_of(form: str, own: str, sort: str, counts: dict[str, int]) -> int | None:
    """Slips that lead from the entry's form to the typed one, or None if they mean different things."""
    if sort == "acronym":
        return 0 if form == own else None
    if form == own:
        return 0
    if sort == "initial" and form[0] != own[0]:
        return None
    n = slips(form, own, SLIPS)
    if n > SLIPS:
        return None
    typed, meant = form.split(), own.split()
    # people send their texts again, so a slip in a surname may come often without being a name of its own
    if len(typed) == len(meant) and sort not in ("person", "initial"):
        for a, b in zip(typed, meant):
            # a word that is common as it stands is no slip of another
            if a != b and counts.get(a, 0) >= max(3, OWN_WORD * counts.get(b, 0)) and LONG.get(a) != b:
                return None
    return n


def link(names: DataFrame, entries: DataFrame, name_col: str = "name", entry_id: str = "org_id", entry_name: str = "org_name", kind_col: str | None = "kind") -> DataFrame:
    """(name, entry, slips): the entry that each different name means; names that mean none are left out.

    Null and blank names mean none, as do names that two entries are equally near to.
    """
    typed = names.select(F.col(name_col).cast("string").alias("name")).where("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))
    counts = names.sparkSession.sparkContext.broadcast(_token_counts(typed))

    def left_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(name, *form) for name in batch.column(0).to_pylist() for form in typed_forms(name)]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["name", "form", "sort"])

    entry_type = entries.schema[entry_id].dataType
    entry_arrow = pa_type(entry_type)

    def right_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, *form) for key, name, kind in zip(*(batch.column(i).to_pylist() for i in range(3))) if name for form in entry_forms(name, kind)]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], entry_arrow), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["entry", "form", "sort"])

    kind = F.col(kind_col).cast("string") if kind_col else F.lit(None).cast("string")
    right = entries.select(F.col(entry_id).alias("entry"), F.col(entry_name).cast("string"), kind.alias("kind")).mapInArrow(right_forms, T.StructType([T.StructField("entry", entry_type), T.StructField("form", T.StringType()), T.StructField("sort", T.StringType())]))
    left = typed.select("name").mapInArrow(left_forms, "name string, form string, sort string")
    left = checkpoint(left)
    near = near_forms(left, right)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_slips_of(f, o, s, counts.value) for f, o, s in zip(*(batch.column(i).to_pylist() for i in (0, 3, 1)))]
            keep = [i for i, x in enumerate(found) if x is not None]
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in (0, 1, 2)), pa.array([found[i] for i in keep], pa.int32())], names=["form", "sort", "entry", "slips"])

    # forms are judged in the tasks that found them, before the names that share them are joined
    judged = near.select("form", "sort", "entry", "entry_form").mapInArrow(judge, T.StructType([T.StructField("form", T.StringType()), T.StructField("sort", T.StringType()), T.StructField("entry", entry_type), T.StructField("slips", T.IntegerType())]))
    each = left.join(judged, ["form", "sort"]).groupBy("name", "entry").agg(F.min("slips").alias("slips"))
    # entries within the radius of one name are few, so its list is short
    best = each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("slips", "entry"))).alias("best"))
    clear = (F.size("best") == 1) | (F.element_at("best", 1)["slips"] < F.try_element_at("best", F.lit(2))["slips"])
    return best.where(clear).select("name", F.element_at("best", 1)["entry"].alias("entry"), F.element_at("best", 1)["slips"].alias("slips"))


def items(resumes: DataFrame) -> DataFrame:
    """(doc_id, list_name, pos, name) of all issuers and publishers, null elements counted."""
    parts = []
    for column, field in (("certifications", "issuer"), ("awards", "issuer"), ("publications", "publisher")):
        part = resumes.select("doc_id", F.lit(column).alias("list_name"), F.posexplode(column).alias("pos", "item"))
        parts.append(part.select("doc_id", "list_name", "pos", F.col(f"item.{field}").alias("name")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name is not null")


def find_organisations(resumes: DataFrame, organisations: DataFrame) -> DataFrame:
    """(doc_id, list_name, pos, org_id) of all elements that mean an entry of ``organisations``."""
    all_items = items(resumes)
    linked = link(all_items, organisations)
    return all_items.join(linked.select("name", F.col("entry").alias("org_id")), "name").select("doc_id", "list_name", "pos", "org_id").distinct()

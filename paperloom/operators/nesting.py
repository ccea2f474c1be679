"""Problem 6: deeply nested records as related flat tables.

Every subtree gets a Merkle identity: objects are canonicalised and hashed bottom-up, so
that equal objects have one identity wherever they stand. ``objects`` stores each of them
once, and the bridge rows keep every occurrence with its parent's key, path and ordinal.

Columns with a schema are hashed by Catalyst expressions; JSON text, whose depth and types
vary, is parsed and hashed in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row for each occurrence of a child record.
BRIDGE = "rel string, parent_id bigint, item_path string, ordinal int, label string, parent_node string, node string, content string"


def merkle(column: Column, kind: T.DataType) -> Column:
    """Identity of a value of a known type: a hash of its parts' identities.

    Fields count by name and not by place; a null field is the same as a missing one.
    """
    if isinstance(kind, T.StructType):
        parts = [F.when(column[f.name].isNotNull(), F.concat(F.lit(f.name + "="), merkle(column[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.sha2(F.concat(F.lit("object:"), F.concat_ws(",", *parts)), 256)
    elif isinstance(kind, T.ArrayType):
        # null elements keep their place
        out = F.sha2(F.concat(F.lit("list:"), F.concat_ws(",", F.transform(column, lambda x: F.coalesce(merkle(x, kind.elementType), F.lit("null"))))), 256)
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        out = F.sha2(F.concat(F.lit("object:"), F.concat_ws(",", F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(merkle(e["value"], kind.valueType), F.lit("null")))))), 256)
    else:
        out = F.sha2(F.concat(F.lit("value:"), column.cast("string")), 256)
    return F.when(column.isNotNull(), out)


def _shape(rel: str, parent: str, path: Column, ordinal: str, parent_node: Column, node: Column, content: Column) -> list[Column]:
    return [
        F.lit(rel).alias("rel"), F.col(parent).cast("bigint").alias("parent_id"), path.alias("item_path"), F.col(ordinal).alias("ordinal"), F.lit(None).cast("string").alias("label"),
        parent_node.alias("parent_node"), node.alias("node"), content.alias("content"),
    ]


def list_children(df: DataFrame, key: str, column: str, rel: str) -> DataFrame:
    """Bridge rows of the elements of a list of records. Null elements count for the place only."""
    kind = df.schema[column].dataType
    rows = df.select(F.col(key).alias("_key"), F.col(column).alias("_list"), F.posexplode(column).alias("_place", "_item")).where("_item is not null")
    return rows.select(_shape(rel, "_key", F.col("_place").cast("string"), "_place", merkle(F.col("_list"), kind), merkle(F.col("_item"), kind.elementType), F.to_json(F.struct(F.col("_item").alias("item")))))


def nested_values(df: DataFrame, key: str, column: str, field: str, rel: str) -> DataFrame:
    """Bridge rows of the values of a list inside a list of records; null and blank ones count for the place only."""
    kind = df.schema[column].dataType.elementType
    outer = df.select(F.col(key).alias("_key"), F.posexplode(column).alias("_outer", "_item")).where("_item is not null")
    rows = outer.select("_key", "_outer", "_item", F.posexplode(f"_item.{field}").alias("_place", "_value")).where("_value is not null and trim(_value) <> ''")
    path = F.concat_ws("/", F.col("_outer").cast("string"), F.col("_place").cast("string"))
    return rows.select(_shape(rel, "_key", path, "_place", merkle(F.col("_item"), kind), merkle(F.col("_value"), T.StringType()), F.to_json(F.struct(F.col("_value").alias("item")))))


def parse_object(text: str | None) -> dict | None:
    """The one complete JSON object in a text, free of what stands around it and of stray commas.

    A text that was cut short, or holds no object, gives None.
    """
    if not text:
        return None
    try:
        found = json.loads(text)
        return found if isinstance(found, dict) else None
    except ValueError:
        pass
    begin = text.find("{")
    while begin >= 0:
        out, depth, at, quoted = [], 0, begin, False
        size, end = len(text), -1
        while at < size:
            char = text[at]
            if quoted:
                if char == "\\":
                    out.append(text[at : at + 2])
                    at += 2
                    continue
                if char == '"':
                    quoted = False
                out.append(char)
            elif char == '"':
                quoted = True
                out.append(char)
            elif char in "{[":
                depth += 1
                out.append(char)
            elif char in "}]":
                while out and out[-1].isspace():
                    out.pop()
                if out and out[-1] == ",":
                    out.pop()
                depth -= 1
                out.append(char)
                if depth == 0:
                    end = at
                    break
            elif char == "," and _stray(out):
                pass
            else:
                out.append(char)
            at += 1
        if end < 0:
            return None
        try:
            found = json.loads("".join(out), strict=False)
            return found if isinstance(found, dict) else None
        except ValueError:
            begin = text.find("{", begin + 1)
    return None


def _stray(out: list[str]) -> bool:
    """Whether a comma after what was read has nothing before it that it could part."""
    for piece in reversed(out):
        if not piece.isspace():
            return piece in "{[,"
    return True


def find_key(value: object, key: str) -> object | None:
    """The value of a key at any depth, outer ones first."""
    level = [value]
    while level:
        below = []
        for item in level:
            if isinstance(item, dict):
                if key in item and item[key] is not None:
                    return item[key]
                below += item.values()
            elif isinstance(item, list):
                below += item
        level = below
    return None


def unwrap(value: object) -> object:
    """What a list or object kept as JSON text holds; any other value as it is."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            found = json.loads(value)
        except ValueError:
            return value
        if isinstance(found, (list, dict)):
            return found
    return value


def as_list(value: object) -> list:
    """A list as it is, a single value as a list of one, null as an empty one."""
    value = unwrap(value)
    return value if isinstance(value, list) else [] if value is None else [value]


class Identities:
    """Merkle identities of parsed JSON values; an object shared by several rows is hashed once."""

    def __init__(self) -> None:
        self.store: dict[int, tuple[object, str]] = {}

    def of(self, value: object) -> str:
        kept = self.store.get(id(value)) if isinstance(value, (dict, list)) else None
        if kept is not None and kept[0] is value:
            return kept[1]
        if isinstance(value, dict):
            text = "object:" + ",".join(f"{k}={self.of(v)}" for k, v in sorted(value.items()) if v is not None)
        elif isinstance(value, list):
            text = "list:" + ",".join(self.of(v) if v is not None else "null" for v in value)
        elif isinstance(value, bool):
            text = f"value:{str(value).lower()}"
        else:
            text = f"value:{value}"
        found = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        if isinstance(value, (dict, list)):
            self.store[id(value)] = (value, found)  # the value is kept, so its id stays its own
        return found


def _score_rows(payload: str | None) -> Iterator[tuple]:
    """(rel, item_path, ordinal, label, parent value, value) of the child records of ``ats_score``."""
    found = parse_object(payload)
    card = unwrap(find_key(found, "explainable_scorecard")) if found else None
    score = unwrap(card.get("ats_score")) if isinstance(card, dict) else None
    if not isinstance(score, dict):
        return
    for place, issue in enumerate(as_list(score.get("parsing_issues"))):
        issue = unwrap(issue)
        if issue is None:
            continue
        yield "parsing_issue", str(place), place, None, score, issue
        if isinstance(issue, dict):
            for spot, page in enumerate(as_list(issue.get("affected_pages"))):
                if page is not None:
                    yield "affected_page", f"{place}/{spot}", spot, None, issue, page
    told = unwrap(score.get("explanation"))
    categories = unwrap(told.get("categories")) if isinstance(told, dict) else None
    for place, (key, category) in enumerate(categories.items() if isinstance(categories, dict) else ()):
        category = unwrap(category)
        if category is None:
            continue
        yield "category", key, place, key, told, category
        if isinstance(category, dict):
            for spot, detail in enumerate(as_list(category.get("details"))):
                if detail is not None:
                    yield "category_detail", f"{key}/{spot}", spot, key, category, detail


def score_children(df: DataFrame, key: str = "audit_id", column: str = "payload") -> DataFrame:
    """Bridge rows of the child records of the ``ats_score`` in JSON payloads.

    Payloads that hold no complete object with a scorecard give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rel", pa.string()), ("parent_id", pa.int64()), ("item_path", pa.string()), ("ordinal", pa.int32()), ("label", pa.string()), ("parent_node", pa.string()), ("node", pa.string()), ("content", pa.string())])
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                out: list[list] = [[] for _ in schema]
                known = Identities()
                for parent, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for rel, path, ordinal, label, above, value in _score_rows(payload):
                        row = (rel, parent, path, ordinal, label, known.of(above), known.of(value), json.dumps({"item": value}, sort_keys=True, ensure_ascii=False))
                        for column, cell in zip(out, row):
                            column.append(cell)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    # exact copies of a row are parsed once
    source = df.select(F.col(key).cast("bigint").alias("parent_id"), F.col(column).cast("string").alias("payload")).where("payload is not null")
    return source.mapInArrow(run, BRIDGE).dropDuplicates(["rel", "parent_id", "item_path"])


def bridge(resumes: DataFrame, audits: DataFrame) -> DataFrame:
    """All occurrences of child records of resumes and audits."""
    own = resumes.select("doc_id", "certifications", "publications")
    parts = [list_children(own, "doc_id", "certifications", "certification"), nested_values(own, "doc_id", "publications", "authors", "publication_author"), score_children(audits)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def objects(rows: DataFrame) -> DataFrame:
    """Each identical object once: (rel, node, content, occurrences)."""
    return rows.groupBy("rel", "node").agg(F.min("content").alias("content"), F.count("*").alias("occurrences"))


def find_children(resumes: DataFrame, audits: DataFrame) -> DataFrame:
    """(rel, parent_id, item_path), one row for each child record."""
    return bridge(resumes, audits).where("node is not null").select("rel", "parent_id", "item_path")

"""File scans: text, office and PDF files to one row of text, links and counts each.

Cheap gates run first, on name, size and head, as nothing is pushed below a Python stage.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import is_corrupted, trim, word_count
from paperloom.operators import validate
from paperloom.operators.layout import has_contact

#: What every scan gives.
COLUMNS = ["path", "text", "raw_text", "is_scanned", "word_count", "image_count", "page_count", "extracted_links", "parsing_issues", "metadata", "status"]
# What stands before appended links, and the form of a link.
LINKS_HEADER = "\n\n--- EXTRACTED HYPERLINKS ---\n"
URL = r'(https?://[^\s<>"]+|www\.[^\s<>"]+)'
_ISSUES = "array<string>"


def _metadata(*names: str) -> Column:
    """What a file says about itself, by name; what it does not say is left out."""
    found = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]) if names else F.create_map()
    return F.map_filter(found.cast("map<string,string>"), lambda _, v: v.isNotNull()).alias("metadata")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def stream_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same for files that keep arriving."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)


def file_kind(path: Column) -> Column:
    return validate.extension(path)


def links(text: Column) -> Column:
    """Web addresses in the order in which they are first seen."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), 1))


def with_links(text: Column, found: Column) -> Column:
    """The text with its links appended under a header of their own."""
    return F.when(F.size(found) > 0, F.concat(text, F.lit(LINKS_HEADER), F.array_join(found, "\n"))).otherwise(text)


def scan_text(files: DataFrame, simple: bool = False) -> DataFrame:
    """Plain text files. ``simple`` neither tests for corruption nor looks for links."""
    raw = validate.decoded(F.col("content"))
    rows = files.select("path", raw.alias("_raw")).withColumn("raw_text", F.col("_raw") if simple else trim(F.col("_raw")))
    found = F.array().cast("array<string>") if simple else links(F.col("raw_text"))
    status = F.lit("OK") if simple else F.when(is_corrupted(F.col("_raw")), "CORRUPTED").when(F.col("raw_text") == "", "EMPTY_DOCUMENT").otherwise("OK")
    rows = rows.withColumn("extracted_links", found)
    return rows.select(
        "path", with_links(F.col("raw_text"), F.col("extracted_links")).alias("text"), "raw_text", F.lit(False).alias("is_scanned"), word_count(F.col("raw_text")).alias("word_count"),
        F.lit(0).alias("image_count"), F.lit(1).alias("page_count"), "extracted_links", F.array().cast(_ISSUES).alias("parsing_issues"), _metadata(), status.alias("status"),
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _paragraph(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def read_office(content: bytes) -> dict:
    """Paragraphs, tables, links, margins and metadata of an office file.

    Paragraphs are those of the body; text in tables is kept apart.
    """
    if content[:8] == bytes(validate.OLE2):
        return {"status": "ENCRYPTED"}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            xml = z.read("word/document.xml").decode("utf-8", "replace")
            body = ElementTree.fromstring(xml).find(f"{_W}body")
            rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
            margins = "\n".join(_paragraph(p) for n in names if re.match(r"word/(?:header|footer)\d*\.xml", n) for p in ElementTree.fromstring(z.read(n)).iter(f"{_W}p"))
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in names else []
            images = sum(n.startswith("word/media/") for n in names)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
        return {"status": "CORRUPTED"}
    paragraphs, rows = [], []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            paragraphs.append((_paragraph(node), style is not None and style.get(f"{_W}val", "").lower().startswith("heading")))
        elif node.tag == f"{_W}tbl":
            rows += [[" ".join(_paragraph(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in node.iter(f"{_W}tr")]
    targets = [r.get("Target", "") for r in rels if r.tag == f"{_R}Relationship" and r.get("Type", "").endswith("/hyperlink")]
    found = list(dict.fromkeys(t for t in targets if t.startswith(("http://", "https://", "mailto:"))))
    meta = {x.tag.rpartition("}")[2]: x.text for x in core if x.text}
    return {"status": "OK", "paragraphs": paragraphs, "rows": rows, "links": found, "margins": margins, "boxes": "<w:txbxContent" in xml, "images": images, "author": meta.get("creator"), "title": meta.get("title")}


def office_text(found: dict, with_tables: bool = False) -> str:
    """The text of an office file. ``with_tables`` sets headings apart and adds the rows of tables."""
    if not with_tables:
        return "\n".join(p.strip() for p, _ in found["paragraphs"] if p.strip())
    parts = [f"\n{p.strip()}\n" if heading else p for p, heading in found["paragraphs"] if p.strip()]
    return "\n".join(parts + [" | ".join(cells) for cells in found["rows"]])


_OFFICE = "path string, raw_text string, links array<string>, images int, author string, title string, has_table boolean, margins string, boxes boolean, status string"


def scan_office(files: DataFrame, with_tables: bool = False) -> DataFrame:
    """Office files, with the issues of their layout."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                f = read_office(bytes(content))
                ok = f["status"] == "OK"
                out.append((path, office_text(f, with_tables) if ok else None, f.get("links", []), f.get("images", 0), f.get("author"), f.get("title"), bool(f.get("rows")), f.get("margins", ""), f.get("boxes", False), f["status"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OFFICE.split(", ")])

    rows = files.select("path", "content").mapInPandas(run, _OFFICE)
    issues = F.filter(F.array(F.when(F.col("has_table"), "TABLE"), F.when(has_contact(F.col("margins")), "HEADER_FOOTER_TEXT"), F.when(F.col("boxes"), "TEXT_BOX")), lambda x: x.isNotNull())
    status = F.when((F.col("status") == "OK") & (trim(F.coalesce("raw_text", F.lit(""))) == ""), "EMPTY_DOCUMENT").otherwise(F.col("status"))
    return rows.select(
        "path", with_links(F.col("raw_text"), F.col("links")).alias("text"), "raw_text", F.lit(False).alias("is_scanned"), word_count(F.col("raw_text")).alias("word_count"),
        F.col("images").alias("image_count"), F.lit(1).alias("page_count"), F.col("links").alias("extracted_links"), issues.alias("parsing_issues"), _metadata("author", "title"), status.alias("status"),
    )


class PlainPdf:
    """A small reader of PDF files: text operators of plain and deflated streams, links, images.

    Text in fonts with their own encodings, and scanned pages, come out empty; plug in
    another ``PageExtractor`` for them.
    """

    _STREAM = re.compile(rb"(<<.*?>>)\s*stream\r?\n(.*?)\r?\nendstream", re.S)
    _SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|[-\d.]+\s+[-\d.]+\s+T[dD]|ET", re.S)
    _STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)

    @classmethod
    def _plain(cls, raw: bytes) -> str:
        named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else named.get(m[1], m[1]), raw, flags=re.S)
        return raw.decode("latin-1")

    def pages(self, content: bytes) -> Iterator[dict]:
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        if b"/Encrypt" in content:
            raise PermissionError("encrypted")
        texts, images = [], 0
        for head, body in self._STREAM.findall(content):
            if b"/Subtype/Image" in head.replace(b" ", b""):
                images += 1
                continue
            if b"/FlateDecode" in head:
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    continue
            if b"BT" not in body:
                continue
            out = []
            for m in self._SHOWN.finditer(body):
                piece = m.group()
                if piece.endswith((b"Tj", b"'", b'"', b"TJ")):
                    out.append("".join(self._plain(s) for s in self._STRING.findall(piece)))
                elif out and out[-1] != "\n":
                    out.append("\n")
            texts.append("".join(out).strip())
        found = [self._plain(u) for u in re.findall(rb"/URI\s*\(((?:[^()\\]|\\.)*)\)", content)]
        count = max(len(re.findall(rb"/Type\s*/Page\b(?!s)", content)), len(texts), 1)
        for i in range(count):
            yield {"page_no": i, "text": texts[i] if i < len(texts) else "", "images": images if i == 0 else 0, "links": found if i == 0 else []}


_PDF = "path string, raw_text string, links array<string>, images int, pages int, status string"


def scan_pdf(files: DataFrame, extractor: object | None = None, page_gap: str = "\n", least_chars: int | None = None) -> DataFrame:
    """PDF files through a page extractor.

    A file counts as scanned if it has under 30 words and either images or no word at all;
    with ``least_chars``, if it has fewer characters than that.
    """
    reader = extractor or PlainPdf()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pages = list(reader.pages(bytes(content)))
                    found = list(dict.fromkeys(u for p in pages for u in p["links"] if u.startswith(("http://", "https://", "mailto:"))))
                    out.append((path, page_gap.join(p["text"] for p in pages), found, sum(p["images"] for p in pages), len(pages), "OK"))
                except PermissionError:
                    out.append((path, None, [], 0, 0, "ENCRYPTED"))
                except Exception:  # noqa: BLE001
                    out.append((path, None, [], 0, 0, "CORRUPTED"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PDF.split(", ")])

    rows = files.select("path", "content").mapInPandas(run, _PDF).withColumn("word_count", word_count(F.col("raw_text")))
    scanned = F.length(trim(F.coalesce("raw_text", F.lit("")))) < least_chars if least_chars else (F.col("word_count") < 30) & ((F.col("images") > 0) | (F.col("word_count") == 0))
    return rows.select(
        "path", with_links(F.col("raw_text"), F.col("links")).alias("text"), "raw_text", (scanned & (F.col("status") == "OK")).alias("is_scanned"), "word_count", F.col("images").alias("image_count"),
        F.col("pages").alias("page_count"), F.col("links").alias("extracted_links"), F.array().cast(_ISSUES).alias("parsing_issues"), _metadata(), "status",
    )


def scan(files: DataFrame, extractor: object | None = None) -> DataFrame:
    """All files by their kind, one row each; kinds that are not read get a status of their own."""
    kind = file_kind(F.col("path"))
    rest = files.where(~kind.isin("txt", "docx", "pdf")).select(
        "path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("raw_text"), F.lit(False).alias("is_scanned"), F.lit(0).alias("word_count"), F.lit(0).alias("image_count"),
        F.lit(0).alias("page_count"), F.array().cast("array<string>").alias("extracted_links"), F.array().cast(_ISSUES).alias("parsing_issues"), _metadata(), F.lit("UNSUPPORTED_FORMAT").alias("status"),
    )
    return scan_text(files.where(kind == "txt")).unionByName(scan_office(files.where(kind == "docx"))).unionByName(scan_pdf(files.where(kind == "pdf"), extractor)).unionByName(rest)

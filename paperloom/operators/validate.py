"""Gates for files and contents. Rows are never dropped silently: each gets a status and an error code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import lexicon as L
from paperloom.functions.text import is_corrupted, trim, word_count

#: First bytes of an office file that is locked by a password.
OLE2 = bytearray.fromhex("d0cf11e0a1b11ae1")


def extension(file_name: Column) -> Column:
    """What follows the last dot, in lower case; empty where there is no dot."""
    return F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"(?s)\.([^.]*)\z", 1))


def size_mb(size: Column, rounded: bool = True) -> Column:
    mb = F.coalesce(size, F.lit(0)).cast("double") / 1048576.0
    return F.round(mb, 2) if rounded else mb


def file_status(file_name: Column, size: Column, head: Column, rounded: bool = True) -> Column:
    """Error code of a file, or ok: form, then size, then emptiness, then integrity.

    ``rounded`` sizes are cut to two decimals before they are held against the limit, so a
    file just above it passes; the stricter gate compares them as they are. Without a PDF
    reader a mark of encryption in the first bytes is the only sign of a locked PDF.
    """
    ext = extension(file_name)
    return (
        F.when(~ext.isin(L.EXTENSIONS), "UNSUPPORTED_FORMAT")
        .when(size_mb(size, rounded) > L.MOST_MB, "FILE_TOO_LARGE")
        .when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE")
        .when((ext == "docx") & F.coalesce(F.startswith(head, F.lit(OLE2)), F.lit(False)), "ENCRYPTED")
        .when((ext == "docx") & ~F.coalesce(F.startswith(head, F.lit(bytearray(b"PK"))), F.lit(False)), "CORRUPTED")
        .when((ext == "pdf") & ~F.coalesce(F.startswith(head, F.lit(bytearray(b"%PDF"))), F.lit(False)), "CORRUPTED")
        .when((ext == "pdf") & F.coalesce(F.contains(head, F.lit(bytearray(b"/Encrypt"))), F.lit(False)), "ENCRYPTED")
        .when((ext == "txt") & F.coalesce(is_corrupted(decoded(head)), F.lit(False)), "CORRUPTED")
        .otherwise("OK")
    )


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else one character a byte."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def content_status(raw_text: Column, is_scanned: Column, words: Column) -> Column:
    """Error code of extracted content, or ok: scanned, then empty, then too short."""
    words = F.coalesce(words, F.lit(0))
    return (
        F.when(F.coalesce(is_scanned, F.lit(False)), "SCANNED_DOCUMENT_DETECTED")
        .when((trim(F.coalesce(raw_text, F.lit(""))) == "") | (words == 0), "EMPTY_DOCUMENT")
        .when(words < L.LEAST_WORDS, "INSUFFICIENT_CONTENT")
        .otherwise("OK")
    )


def audit_ready(words: Column) -> Column:
    """Whether a text is long enough for an audit."""
    return F.coalesce(words, F.lit(0)) >= L.LEAST_AUDIT_WORDS


def split(df: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their error code."""
    marked = df.withColumn("error_code", status)
    return marked.where("error_code = 'OK'").drop("error_code"), marked.where("error_code <> 'OK'")


def validated_contents(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, error_code, word_count, audit_ready) of extracted documents."""
    counted = F.coalesce(F.col("quality_info.word_count"), word_count(F.col("raw_text")))
    rows = df.select(F.col(id_col), "raw_text", F.col("validation_info.is_scanned").alias("is_scanned"), counted.alias("word_count"))
    return rows.select(id_col, content_status(F.col("raw_text"), F.col("is_scanned"), F.col("word_count")).alias("error_code"), "word_count", audit_ready(F.col("word_count")).alias("audit_ready"))

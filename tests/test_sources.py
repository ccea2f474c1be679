import io
import zipfile
import zlib

from pyspark.sql import functions as F

from paperloom.sources import cache, files
from paperloom.streaming import uploads


def docx(text="Jane Doe", header="", table=False):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
    if table:
        body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://x/hyperlink" Target="https://e.example/a"/></Relationships>')
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def pdf(text="Hello world", pages=2):
    stream = zlib.compress(f"BT ({text}) Tj ET".encode())
    body = b"".join(b"<< /Type /Page >>\n<< /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\n" for _ in range(pages))
    return b"%PDF-1.4\n" + body + b"/URI (https://e.example/b)\n%%EOF"


def test_scan_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Café www.x.example/1 http://y.example".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.docx").write_bytes(docx(header="me@x.example", table=True))
    (tmp_path / "d.docx").write_bytes(b"PK broken")
    (tmp_path / "e.pdf").write_bytes(pdf())
    (tmp_path / "f.exe").write_bytes(b"x")
    (tmp_path / "g.txt").write_bytes(b"  ")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.scan(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"].extracted_links == ["www.x.example/1", "http://y.example"] and got["a.txt"].text.endswith("www.x.example/1\nhttp://y.example")
    assert got["b.txt"].raw_text == "café" and got["g.txt"].status == "EMPTY_DOCUMENT"
    assert got["c.docx"].raw_text == "Jane Doe" and got["c.docx"].parsing_issues == ["TABLE", "HEADER_FOOTER_TEXT"] and got["c.docx"].extracted_links == ["https://e.example/a"]
    assert got["d.docx"].status == "CORRUPTED" and got["f.exe"].status == "UNSUPPORTED_FORMAT"
    assert got["e.pdf"].raw_text == "Hello world\nHello world" and got["e.pdf"].page_count == 2 and got["e.pdf"].extracted_links == ["https://e.example/b"]


def test_office_text_with_tables():
    found = files.read_office(docx("A\nB", table=True))
    assert files.office_text(found) == "A\nB" and files.office_text(found, True).endswith("in table")


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"some words here")
    q = uploads.parsed_files(spark, str(tmp_path)).writeStream.format("memory").queryName("scanned").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.word_count for r in spark.table("scanned").collect()] == [3]


def test_streamed_rollup_is_the_batch_one(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/uploads.parquet").where("received_at is not null").dropDuplicates(["upload_id"]).coalesce(1)
    src.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in uploads.per_account(src).collect()}
    stream = uploads.per_account(uploads.read_uploads(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("rolled").collect()} == batch


def test_cache(spark, tmp_path):
    reports = spark.createDataFrame([("k1", '{"a": 1}'), ("k2", "cut {")], "cache_key string, report string")
    cache.write(reports, str(tmp_path / "c"))
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cache_key string")
    there, todo = cache.lookup(wanted, cache.read(spark, str(tmp_path / "c")))
    assert [r.cache_key for r in there.collect()] == ["k1"] and sorted(r.cache_key for r in todo.collect()) == ["k2", "k3"]
    cache.clear(spark, str(tmp_path / "c"))
    assert cache.read(spark, str(tmp_path / "c")).count() == 0
    keys = spark.createDataFrame([("t", "Role "), ("t", "role"), ("t", None)], "c string, r string").select(cache.cache_key(F.col("c"), F.col("r"))).collect()
    assert keys[0] == keys[1] != keys[2]


def test_providers(spark):
    from paperloom.operators import providers

    table = spark.createDataFrame([("Analyst", " SQL "), ("analyst", "sql"), (None, "Git"), ("Clerk", "typing"), (None, " "), (None, None)], "target_role string, keyword string")
    own = providers.TableKeywords(table)
    assert own.keywords("ANALYST ") == ["git", "sql"] and own.keywords() == ["git", "sql", "typing"] and own.keywords("x") == ["git"]
    assert providers.StaticKeywords(["B", "a", ""]).keywords() == ["a", "b"]
    df = spark.createDataFrame([(1, "short"), (2, "long enough " * 9), (3, None)], "doc_id int, text string")
    assert [r.classifier_status for r in providers.classify(df).orderBy("doc_id").collect()] == ["INSUFFICIENT_TEXT", "NOT_CONFIGURED", "INSUFFICIENT_TEXT"]
    told = providers.classify(df, provider=lambda text, role: "resume").orderBy("doc_id").collect()
    assert [r.is_resume for r in told] == [False, True, False]

    def fails(text, role):
        raise TimeoutError

    failed = providers.classify(df, provider=fails).where("doc_id = 2").first()
    assert failed.classifier_status == "FAILED: TimeoutError" and not failed.is_resume
    assert {r.review_status for r in providers.review(df).collect()} == {"NOT_CONFIGURED"}
    assert providers.review(df, provider=lambda t, r: "{}").first().payload == "{}"


def test_pipeline_on_odd_rows(spark):
    from paperloom.plans import pipeline

    rows = spark.createDataFrame([(1, None, None), (2, "", False), (3, "word " * 20, True), (4, "Jane Doe\nSUMMARY\n" + "word " * 40, False)], "doc_id int, raw_text string, is_scanned boolean")
    got = {r.doc_id: r for r in pipeline.parse_resumes(rows).collect()}
    assert [got[i].error_code for i in (1, 2, 3, 4)] == ["EMPTY_DOCUMENT", "EMPTY_DOCUMENT", "SCANNED_DOCUMENT_DETECTED", "OK"]
    assert got[4].summary.startswith("word") and got[1].entities is None and got[4].entities.candidate_info.name == "Jane Doe"
    ready = rows.selectExpr("doc_id", "raw_text as text", "is_scanned", "size(split(coalesce(raw_text, ''), ' ')) as word_count", "1 as page_count")
    scored = {r.doc_id: r for r in pipeline.analyze(ready).collect()}
    assert scored[4].score is not None and scored[1].score is None and len(scored) == 4
    refused = {r.doc_id: r.error_code for r in pipeline.analyze(ready, classifier=lambda text, role: "letter").collect()}
    assert refused[4] == "NOT_A_RESUME" and refused[1] == "EMPTY_DOCUMENT"

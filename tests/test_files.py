"""Extractors, writers, routing, streams, dictionaries, classification and training."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.operators import audit, classify, metrics, synth, templates
from veilspark.sources import docx, files, html, sinks
from veilspark.streaming import live


def test_html_native_and_parsed(spark):
    page = '<html><head><style>p{}</style><script>var a="</p>";</script></head><body><!-- x --><p>A &amp; B  &copy;</p>\n\n<a href="http://x.org">link</a> 1 &lt; 2</body></html>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    a = [r.t for r in df.select(html.native_text(F.col("html"), links=True).alias("t")).collect()]
    b = [r.text for r in html.parsed(df, "html", links=True).collect()]
    assert a == b == ["A & B ©\nlink (http://x.org) 1 < 2", None, ""]


def test_html_reference_without_semicolon():
    cut = "<title>a&amp</title><p>b&amp&amp;c &copyright &#39 &#39; &#x41; 1&2 \ue000&lt</p>"
    assert html.parse(cut, bare=False) == "a&ampb&amp&c &copyright &#39 ' A 1&2 \ue000&lt"
    assert html.parse('<a href="u?a=1&copy=2">x</a>&amp', bare=False, links=True) == "x (u?a=1&copy=2)&amp"
    assert html.parse("b&amp") == "b&" and html.parse(None, bare=False) is None


def test_docx_round_trip(spark, tmp_path):
    data = docx.write("one <b>\n\ntwo & three")
    assert docx.read(data) == "Scrubbed Document\none <b>\ntwo & three"
    assert docx.read(data, preserve_formatting=True).startswith("# Scrubbed Document")


def test_docx_parts():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('T', 'Title')}{p('H', 'Heading2')}{p('Q', 'Quote')}<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {ns}>{p('top')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {ns}>{p('end')}</w:ftr>")
        z.writestr("docProps/core.xml", "<c:x xmlns:c='c' xmlns:d='d'><d:title>My</d:title><d:creator>Me</d:creator></c:x>")
    text = docx.read(out.getvalue(), preserve_formatting=True, metadata=True)
    assert text.split("\n") == ["[METADATA]", "Title: My", "Author: Me", "[/METADATA]", "[HEADER] top", "[FOOTER] end", "# T", "## H", "> Q", "[TABLE]", "a b | c", "[/TABLE]"]


def test_extract_mixed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" text é ")
    (tmp_path / "b.html").write_text("<p>page</p>")
    (tmp_path / "c.docx").write_bytes(docx.write("doc"))
    (tmp_path / "d.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(b"broken")
    bin_files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5:]: r.text for r in files.extract(bin_files).collect()}
    assert got == {"a.txt": "text é", ".html": "page", ".docx": got[".docx"], "d.csv": "a b\n 1 é", "e.pdf": ""}
    pdf = files.extract(bin_files, {"pdf": lambda b: "pages"})
    assert pdf.where("kind = 'pdf'").first().text == "pages"
    assert tuple(files.batch_report(pdf).first()) == (6, 5)


def test_csv_cells_with_line_ends(spark, tmp_path):
    (tmp_path / "lines.csv").write_text('id,note\n1,"first\nsecond, third"\n2,plain\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "lines.csv")).orderBy("id").collect()] == [("1", "first\nsecond, third"), ("2", "plain")]


def test_csv_with_separator_and_metrics(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Year;Document Type\n2023;Report\n")
    assert files.read_csv(spark, str(tmp_path / "x.csv"), ";").first()["Document Type"] == "Report"
    (tmp_path / "m.json").write_text(json.dumps({"report": "C1 0.5 0.5 0.5 3\naccuracy 0.9 3", "confusion_matrix": [[1, 2], [3, 4]]}))
    m = files.read_metrics(spark, str(tmp_path / "m.json"))
    assert m.first().confusion_matrix == [[1, 2], [3, 4]]
    lines = m.select(F.explode(F.split("report", "\n")).alias("line"))
    assert {r.label: r.precision for r in metrics.parse_report(lines).collect()} == {"C1": 0.5, "accuracy": 0.9}
    assert files.read_text(spark, str(tmp_path / "x.csv")).first().text.startswith("Year;")


def test_rendered(spark):
    df = spark.createDataFrame([("a.html", "x < y\n\nz"), ("b.docx", "doc"), ("c.pdf", "p"), ("d.png", None)], "filename string, text string")
    got = {r.filename: r.content for r in sinks.rendered(df, pdf=lambda t: b"%PDF" + t.encode()).collect()}
    assert b"<h1>\n    Scrubbed Document\n   </h1>\n   <p>\n    x &lt; y\n   </p>\n   <p>\n    z\n   </p>\n" in got["a.html"] and docx.read(bytes(got["b.docx"])).endswith("doc") and bytes(got["c.pdf"]) == b"%PDFp" and got["d.png"] is None


def test_stream_redaction_and_windows(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:00:00", "text_redacted" if h % 2 else "login", "C4", f"a{h}@b.co") for h in range(6)]
    spark.createDataFrame(rows, "timestamp string, action string, level string, text string").withColumn("timestamp", F.to_timestamp("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    live.redact_to(stream, str(tmp_path / "out"), str(tmp_path / "ck"), level="level").awaitTermination()
    assert {r.redacted_text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"[EMAIL]"}
    q = live.action_counts(stream, "2 hours").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(operations) FROM counts").first()[0] == 6


def test_train_and_predict(spark):
    rows = [(f"the account {i} has a balance", "C4") for i in range(40)] + [(f"weather report number {i}", "C1") for i in range(40)]
    _, predicted = classify.train(spark.createDataFrame(rows, "text string, label string"))
    assert metrics.accuracy(predicted).first().accuracy > 0.9
    _, forest = classify.train(spark.createDataFrame(rows, "text string, label string"), "rf")
    assert metrics.accuracy(forest).first().accuracy > 0.9


def test_generate_and_small_functions(spark):
    rows = synth.generate(spark, 50)
    assert rows.count() == 50 and rows.where("redacted_text LIKE '%<IBAN_2>%'").count() == 2
    df = spark.createDataFrame([("ab", " 1.2.3.4 , 5", None), ("é" * 40, None, "9.9.9.9"), (None, None, None)], "p string, f string, peer string")
    assert [r.x for r in df.select(T.password_ok(F.col("p")).alias("x")).collect()] == [False, False, False]
    assert [r.x for r in df.select(T.client_ip(F.col("f"), F.col("peer")).alias("x")).collect()] == ["1.2.3.4", "9.9.9.9", "unknown"]


def test_every_entity_is_exported(spark):
    table = spark.createDataFrame([(0, "c", " ".join(["{IBAN}"] * 12)), (1, "c", "nothing"), (2, "c", "{NOPE} {YEAR}")], "template_id long, category string, template string")
    rows = synth.generate(spark, 6, source=table)
    wide = {r.id: r for r in sinks.wide(rows.select("id", "entity_mappings"), "entity_mappings").collect()}
    assert wide[0].num_entities == 12 and wide[0].entity_11_placeholder == "<IBAN_12>" and 0.85 <= wide[0].entity_11_confidence <= 0.99
    assert wide[1].num_entities == 0 and wide[1].entity_0_type is None and wide[2].num_entities == 0 and len(wide[0]) == 2 + 4 * 12
    assert sinks.width_of(rows.limit(0), "entity_mappings") == 0


def test_value_formats(spark):
    import re

    kinds = [*templates.FORMATS, *templates.DATES, *templates.MONTHS, "OTHER"]
    df = spark.createDataFrame([(k, i) for k in kinds for i in range(40)], "kind string, row long")
    left = [(r.kind, r.v) for r in df.select("kind", synth.value_of(F.col("kind"), F.col("row"), F.lit(1)).alias("v")).collect()]
    assert all(not set(v) & set(templates.DIGITS + templates.LETTERS) for _, v in left)
    assert all(re.fullmatch(r"[A-Z]{2}\d{2}( [A-Z0-9]{2,4}){3,4}", v) for k, v in left if k == "IBAN") and all(re.fullmatch(r"other-\d{6}", v) for k, v in left if k == "OTHER")
    assert len(templates.rows(templates.FIRST)) == 25 and len(templates.rows(templates.SECOND)) == 68
    assert {t for types in synth.SEVERITY.values() for t in types} | set(synth.FIRST_TYPES) == {*templates.FORMATS, *templates.DATES, *templates.MONTHS}


def test_csv_text_is_typed():
    from veilspark.sources.files import csv_text

    assert csv_text(b"a,name\n1,x\n22,\n") == " a name\n 1    x\n22  NaN" and "é" in csv_text("a\né\n".encode("latin-1"))
    assert csv_text(b'a,b\n"x\ny",2\n').count("2") == 1


def test_users(spark):
    users = spark.createDataFrame([("u1", "a@x.co", True, False, None)], "user_id string, email string, is_active boolean, is_admin boolean, last_login timestamp")
    asked = spark.createDataFrame([("a@x.co",), ("b@x.co",)], "email string")
    assert {r.email: r.status for r in audit.access_status(asked, users).collect()} == {"a@x.co": 403, "b@x.co": 404}
    assert {r.status for r in audit.access_status(asked, audit.deactivated(users, "a@x.co"), admin=False).collect()} == {403, 404}
    assert audit.with_login(users, "a@x.co", F.current_timestamp()).first().last_login is not None


def test_saved_model_and_generator(spark, tmp_path):
    rows = [(f"the account {i} has a balance", "C4") for i in range(30)] + [(f"weather report number {i}", "C1") for i in range(30)]
    df = spark.createDataFrame(rows, "text string, label string")
    model, _ = classify.train(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = classify.classified(df, classify.load(str(tmp_path / "m")))
    assert out.where("prediction <> label").count() == 0 and out.first().explanation
    assert {r.response for r in sinks.generated(df.limit(2), "text", lambda texts: [" ok " for _ in texts]).collect()} == {"ok"}
    sinks.write_dataset(synth.generate(spark, 6), str(tmp_path / "d"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d/csv")).count() == spark.read.json(str(tmp_path / "d/json")).count() == 6


def test_files_are_extracted_in_slices(spark):
    """A batch out for a slice of files, not for each file, and a large file alone."""
    import pyarrow as pa

    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    content = [b"a%d " % i for i in range(100)] + [b"b" * (5 << 20), b"\xff", None, b" "]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.txt" for i in range(104)]), pa.array(["txt"] * 104), pa.array(content, pa.binary())], names=["path", "kind", "content"])
    out = list(files.extract(Caught())(iter([batch])))
    rows = [r for b in out for r in b.to_pylist()]
    assert [b.num_rows for b in out] == [100, 1, 3] and [r["text"] for r in rows[:100]] == [f"a{i}" for i in range(100)]
    assert [r["reason"] for r in rows[100:]] == [None, "UnicodeDecodeError", "no content", "no text"] and [r["ok"] for r in rows[99:102]] == [True, True, False]

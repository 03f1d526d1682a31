import io
import zipfile

from pyspark.sql import functions as F

from factloom.sources import files, store, versions
from factloom.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def frame(spark, items):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in items.items()], "path string, content binary")


def test_text(spark):
    got = {r.path: (r.text, r.error) for r in files.read_text(frame(spark, {
        "a": b"\xef\xbb\xbfone  \r\n\r\n\r\n\r\ntwo\x00", "b": b"\xff\xfe", "c": b" \n "})).collect()}
    assert got == {"a": ("one\n\ntwo", None), "b": (None, "invalid_encoding"), "c": (None, "no_text")}


def test_csv(spark):
    df = files.parse_csv_tables(frame(spark, {"ok": b"A,B\n1, x  y\n\n2\n3,z", "bad": b'A,B\n"1,2', "one": b"A\n1", "enc": b"\xff,\xfe"}))
    rows = df.collect()
    assert [(r.row_ord, r.line_no, r.header, r.raw, r.malformed) for r in rows if r.path == "ok"] == [
        (1, 2, "A", "1", 1), (1, 2, "B", "x y", 1), (2, 4, "A", "3", 1), (2, 4, "B", "z", 1)]
    assert {r.path: r.error for r in rows if r.error} == {"bad": "invalid_csv", "one": "invalid_csv", "enc": "invalid_encoding"}


def test_docx(spark):
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    doc = f'<w:document {W}><w:body>{p("Costs", "Heading1")}{p("Table of fees")}<w:tbl>{row("Item", "Fee")}{row("A", "$5")}{row("odd")}</w:tbl></w:body></w:document>'
    evil = f'<!DOCTYPE x [<!ENTITY e "x">]><w:document {W}/>'
    df = files.parse_docx_tables(frame(spark, {"d": archive({"word/document.xml": doc}), "e": archive({"word/document.xml": evil}), "z": b"no zip"}))
    rows = df.collect()
    assert [(r.title, r.section, r.header, r.raw, r.malformed) for r in rows if r.path == "d"] == [
        ("Table of fees", "Costs", "Item", "A", 1), ("Table of fees", "Costs", "Fee", "$5", 1)]
    assert {r.path: r.error for r in rows if r.error} == {"e": "invalid_docx", "z": "invalid_docx"}


def test_xlsx(spark):
    book = f'<workbook {S}><sheets><sheet name="Main" sheetId="1" r:id="rId1"/></sheets></workbook>'
    rels = '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
    styles = (f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="&quot;$&quot;#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
              '<xf numFmtId="170"/><xf numFmtId="9"/></cellXfs></styleSheet>')
    shared = f'<sst {S}><si><t>Title here</t></si><si><t>Day</t></si></sst>'
    c = lambda r, v, t="n", s=0: f'<c r="{r}" t="{t}" s="{s}"><v>{v}</v></c>'
    text = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = (f'<worksheet {S}><sheetData><row>{c("A1", 0, "s")}</row><row>{c("A2", 1, "s")}{text("B2", "Cost")}{text("C2", "Share")}</row>'
             f'<row>{c("A3", 45000, s=1)}{c("B3", 12.5, s=2)}{c("C3", 0.25, s=3)}</row><row>{c("A4", 45001, s=1)}</row></sheetData></worksheet>')
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet}
    rows = files.parse_xlsx_tables(frame(spark, {"x": archive(parts)})).collect()
    assert [(r.title, r.section, r.header, r.raw, r.malformed) for r in rows] == [
        ("Title here", "Main", "Day", "2023-03-15", 1), ("Title here", "Main", "Cost", "$12.5", 1), ("Title here", "Main", "Share", "25%", 1)]


def test_answers_are_written_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    batch = spark.createDataFrame([(1, "a", "q1"), (1, "b", "q2"), (2, "a", "q3")], "workspace_id long, key string, question string")
    store.write_answers(batch, path)
    store.write_answers(batch, path)
    store.write_answers(spark.createDataFrame([(1, "a", "other"), (1, "c", "q4")], batch.schema), path)
    got = sorted((r.workspace_id, r.key, r.question, r.ordinal) for r in store.read_answers(spark, path).collect())
    assert got == [(1, "a", "q1", 1), (1, "b", "q2", 2), (1, "c", "q4", 3), (2, "a", "q3", 1)]


def test_blocks_are_replaced_by_bucket(spark, tmp_path):
    path = str(tmp_path / "blocks")
    df = spark.createDataFrame([("r", 0, "f", "old"), ("r", 0, "f", "gone"), ("r", 0, "g", "beside"), ("r", 1, "h", "kept")], "run_id string, bucket int, file_id string, text string")
    store.write_blocks(df, path)
    store.write_blocks(df.where("text = 'old'").withColumn("text", F.lit("new")), path)
    assert sorted(r.text for r in versions.read(spark, path).collect()) == ["beside", "kept", "new"]


def test_answers_stream_keeps_the_first_for_good(spark, tmp_path):
    folder, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "k string, said string, sent timestamp"

    def send(name, rows):
        spark.createDataFrame(rows, "k string, said string, sent string").selectExpr("k", "said", "CAST(sent AS timestamp) AS sent").coalesce(1).write.parquet(str(folder / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        jobs.stream_answers(stream, ["k"], "sent", out, ckpt, buckets=2).awaitTermination()

    folder.mkdir()
    send("one", [("a", "late twin", "2024-01-01 10:00:05"), ("a", "first", "2024-01-01 10:00:00"), ("b", "only", "2024-01-05 00:00:00")])
    send("two", [("a", "hours later", "2024-01-01 18:00:00"), ("c", "behind all others", "2020-01-01 00:00:00")])
    send("three", [("c", "again", "2019-01-01 00:00:00"), ("b", "again", "2024-01-05 00:00:00")])
    assert {(r.k, r.said) for r in jobs.read_merged(spark, out).collect()} == {("a", "first"), ("b", "only"), ("c", "behind all others")}
    assert jobs.read_merged(spark, out).count() == 3


def test_new_files_become_blocks_once(spark, tmp_path):
    folder, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\n")
    (folder / "b.txt").write_bytes(b"\xff")
    jobs.stream_blocks(spark, str(folder), out, ckpt).awaitTermination()
    (folder / "c.txt").write_text("three")
    jobs.stream_blocks(spark, str(folder), out, ckpt).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one\ntwo", "three"]

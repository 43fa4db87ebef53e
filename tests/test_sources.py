"""Readers and writers on small files, hostile ones included; queues and streams."""

import io
import zipfile
from datetime import datetime
from email.message import EmailMessage

from pyspark.sql import functions as F

from tallyspark.plans.staging import put
from tallyspark.sources import documents, tabular
from tallyspark.streaming import jobs


def test_tables_by_content(spark, tmp_path):
    base = f"file://{tmp_path}/in"
    put(spark, f"{base}/a.csv", "név;összeg\nÁrvíz;1,5\n".encode("cp1250"))
    put(spark, f"{base}/b.csv", "﻿name,total\n\"x,y\",2\n".encode())
    put(spark, f"{base}/c.xlsx", tabular.xlsx_bytes(["name", "total"], [["=danger", 3], ["ű", None]]))
    put(spark, f"{base}/d.xml", b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="S"><Table><Row><Cell><Data>name</Data></Cell><Cell ss:Index="3"><Data>total</Data></Cell></Row></Table></Worksheet></Workbook>')
    put(spark, f"{base}/e.xlsx", b"PK broken")
    put(spark, f"{base}/f.xml", b'<!DOCTYPE x [<!ENTITY a "b">]><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet"/>')
    got = {(r["path"][-5:], r["row_no"]): r for r in tabular.read_tables(spark, base).collect()}
    assert got["a.csv", 1]["cells"] == ["Árvíz", "1,5"] and got["b.csv", 1]["cells"] == ["x,y", "2"]
    assert got[".xlsx", 1]["cells"] == ["=danger", "3"]
    assert got["d.xml", 0]["cells"] == ["name", "", "total"]
    problems = [r for r in tabular.read_tables(spark, base).where("problem is not null").collect()]
    assert len(problems) == 2


def test_workbook_days(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    styles = f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\.mm\\.dd"/><numFmt numFmtId="171" formatCode="0.00 &quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    sheet = f'<worksheet {ns}><sheetData><row><c s="1"><v>45300</v></c><c s="2"><v>45301</v></c><c s="3"><v>45300</v></c><c s="4"><v>45300.5</v></c><c><v>45300</v></c><c t="d"><v>2024-01-09T00:00:00</v></c><c s="1" t="str"><v>text</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    put(spark, f"file://{tmp_path}/in/a.xlsx", out.getvalue())
    put(spark, f"file://{tmp_path}/in/b.csv", b"a;b,c;d,e\n")
    put(spark, f"file://{tmp_path}/in/c.csv", b"\x81\x83;x\n")
    put(spark, f"file://{tmp_path}/in/d.xml", b'<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet><Table><Row><Cell><Data ss:Type="DateTime">2024-01-09T00:00:00.000</Data></Cell></Row></Table></Worksheet></Workbook>')
    got = {r["path"][-5:]: r for r in tabular.read_tables(spark, f"file://{tmp_path}/in").collect()}
    assert got[".xlsx"[:5]]["cells"] == ["2024-01-09", "2024-01-10", "45300", "2024-01-09 12:00:00", "45300", "2024-01-09", "text"]
    assert got["b.csv"]["cells"] == ["a;b", "c;d", "e"] and "UnicodeDecodeError" in got["c.csv"]["problem"] and got["d.xml"]["cells"] == ["2024-01-09"]


def test_word_paragraphs(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Árvíz </w:t></w:r><w:r><w:t>tűrő</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    put(spark, f"file://{tmp_path}/in/a.docx", out.getvalue())
    put(spark, f"file://{tmp_path}/in/b.docx", b"PK broken")
    rows = documents.read_word(spark, f"file://{tmp_path}/in").collect()
    assert sorted((r["paragraph"], r["text"]) for r in rows if r["problem"] is None) == [(0, "Árvíz tűrő"), (1, "a\tb")] and sum(r["problem"] is not None for r in rows) == 1


def test_worker_counts_each_key_once(spark, tmp_path):
    run = jobs.worker({"a": lambda j: j.select("job_id", F.lit("ok").alias("result"))}, f"file://{tmp_path}/out")
    first = spark.createDataFrame([(1, "a", "k1"), (2, "a", "k1"), (3, "b", "k2")], "job_id long, kind string, dedup_key string")
    later = spark.createDataFrame([(4, "a", "k1"), (5, "a", "k3")], "job_id long, kind string, dedup_key string")
    for number, batch in ((0, first), (1, later), (1, later)):
        run(batch, number)
    assert sorted((r["job_id"], r["state"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(1, "done"), (3, "refused"), (5, "done")]


def test_intermediates_are_deleted(spark):
    from tallyspark.plans import staging

    with staging.intermediates():
        df = staging.written(spark.range(5), "x")
        assert df.count() == 5
        path = df.inputFiles()[0]
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_rejoined_and_unmangled(spark):
    rows = spark.createDataFrame([(["a;b;c", ""],), (["a", "b"],)], "cells array<string>")
    assert [r[0] for r in tabular.rejoined(rows).select("cells").collect()] == [["a", "b", "c"], ["a", "b"]]
    pairs = [("é€–ű plain".encode().decode("cp1252"), "é€–ű plain"), ("plain", "plain"), ("ÁRVÍZ", "ÁRVÍZ"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in pairs], "t string").select(tabular.unmangled(F.col("t"))).collect()] == [b for _, b in pairs]


def test_mails(spark, tmp_path):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "a@b.hu", "c@d.hu, E <e@f.hu>", "Szia ű", "Thu, 01 Jan 2026 10:00:00 +0100", "<1@x>"
    m.set_content("body")
    m.add_attachment(b"data", maintype="application", subtype="pdf", filename="x.pdf")
    put(spark, f"file://{tmp_path}/in/m.eml", bytes(m))
    put(spark, f"file://{tmp_path}/in/n.eml", b"\xff\x00")
    got = {r["path"][-5:]: r for r in documents.read_mails(spark, f"file://{tmp_path}/in").collect()}
    r = got["m.eml"]
    assert (r["sender"], r["recipients"], r["subject"], r["body"].strip(), r["sent"]) == ("a@b.hu", ["c@d.hu", "e@f.hu"], "Szia ű", "body", datetime(2026, 1, 1, 9))
    assert [(a["name"], a["bytes"]) for a in r["attachments"]] == [("x.pdf", 4)] and len(got) == 2


def test_camt_balances(spark, tmp_path):
    xml = b'<Document xmlns="urn:iso"><BkToCstmrStmt><Stmt><Id>1</Id><Acct><Id><IBAN>HU1</IBAN></Id><Ccy>HUF</Ccy></Acct><FrToDt><FrDtTm>2026-01-01T00:00:00</FrDtTm><ToDtTm>2026-01-31T00:00:00</ToDtTm></FrToDt><Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="HUF">10</Amt><CdtDbtInd>DBIT</CdtDbtInd></Bal><Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="HUF">5</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal><Ntry><Amt Ccy="HUF">15</Amt><CdtDbtInd>CRDT</CdtDbtInd><BookgDt><Dt>2026-01-05</Dt></BookgDt></Ntry></Stmt></BkToCstmrStmt></Document>'
    put(spark, f"file://{tmp_path}/c.xml", xml)
    s, lines = documents.read_camt(spark, f"file://{tmp_path}/c.xml")
    assert (float(s.first()["opening"]), float(s.first()["closing"]), s.first()["account"]) == (-10.0, 5.0, "HU1")
    assert lines.first()["direction"] == "credit" and lines.count() == 1


def test_chunks_keep_rows_and_context(spark):
    rows = spark.createDataFrame([("d", n, f"row {n} " + "x" * 20) for n in range(20)], "doc string, n int, line string")
    got = [r["text"] for r in documents.chunks(rows, "doc", "n", "line", 150).orderBy("chunk").collect()]
    assert all(len(t.encode()) <= 150 for t in got) and all(t.startswith("row 0 ") for t in got)
    assert [x for t in got for x in t.split("\n") if not x.startswith(("row 0 ", "row 1 "))] == [f"row {n} " + "x" * 20 for n in range(2, 20)]


def test_queue_back_off_and_dead_letters(spark):
    at = datetime(2026, 1, 1)
    log = [(1, 1, "enqueued"), (2, 1, "claimed"), (3, 1, "failed"), (4, 2, "enqueued"), (5, 3, "claimed"), (6, 3, "failed"), (7, 3, "claimed"), (8, 3, "failed"), (9, 3, "claimed"), (10, 3, "failed"), (11, 4, "cancelled"), (12, 5, "completed")]
    s = {r["job_id"]: r for r in jobs.queue_state(spark.createDataFrame([(*x, at) for x in log], "seq long, job_id long, event string, at timestamp")).collect()}
    assert {k: r["status"] for k, r in s.items()} == {1: "queued", 2: "queued", 3: "dead", 4: "cancelled", 5: "done"}
    assert s[1]["available_at"] == datetime(2026, 1, 1, 0, 1) and s[2]["available_at"] == at


def test_outbox_is_idempotent(spark, tmp_path):
    run = jobs.outbox(lambda b: b.groupBy().count(), f"file://{tmp_path}/out")
    for _ in range(2):
        run(spark.range(5), 0)
    run(spark.range(3), 1)
    assert sorted(r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [3, 5]


def test_watched_folder_sees_each_file_once(spark, tmp_path):
    base, seen = f"file://{tmp_path}", []
    for n in range(2):
        put(spark, f"{base}/in/{n}.txt", b"x")
        jobs.run_batches(jobs.watched_folder(spark, f"{base}/in", "*.txt"), f"{base}/check", lambda b, _: seen.extend(r["path"][-5:] for r in b.collect())).awaitTermination()
    assert sorted(seen) == ["0.txt", "1.txt"]

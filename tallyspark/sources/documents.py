"""Statements, rates, mails, recognised text and recorded answers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_AMOUNT = "struct<_VALUE: string, _Ccy: string>"
_ENTRY = f"struct<Amt: {_AMOUNT}, CdtDbtInd: string, BookgDt: struct<Dt: string>, ValDt: struct<Dt: string>, NtryDtls: struct<TxDtls: struct<RmtInf: struct<Ustrd: string>, RltdPties: struct<Cdtr: struct<Nm: string>, Dbtr: struct<Nm: string>>>>, AddtlNtryInf: string>"
#: What is read of a camt.053 statement (fixed names of the format).
CAMT = f"Id string, Acct struct<Id: struct<IBAN: string, Othr: struct<Id: string>>, Ccy: string>, FrToDt struct<FrDtTm: string, ToDtTm: string>, Bal array<struct<Tp: struct<CdOrPrtry: struct<Cd: string>>, Amt: {_AMOUNT}, CdtDbtInd: string, Dt: struct<Dt: string>>>, Ntry array<{_ENTRY}>"


def _signed(amount, side):
    return F.when(side == "DBIT", -amount).otherwise(amount)


def read_camt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(statements, lines) of camt.053 files: split by the Stmt tag, so that large files are read in parts."""
    raw = spark.read.format("xml").option("rowTag", "Stmt").option("ignoreNamespace", "true").schema(CAMT).load(path)
    balance = lambda code: F.get(F.filter("Bal", lambda b: b["Tp"]["CdOrPrtry"]["Cd"] == code), F.lit(0))
    money = lambda b: _signed(b["Amt"]["_VALUE"].try_cast("decimal(18,2)"), b["CdtDbtInd"])
    statements = raw.select(
        F.col("Id").alias("statement"), F.coalesce("Acct.Id.IBAN", "Acct.Id.Othr.Id").alias("account"), F.col("Acct.Ccy").alias("currency"),
        F.try_to_date(F.left("FrToDt.FrDtTm", F.lit(10))).alias("period_start"), F.try_to_date(F.left("FrToDt.ToDtTm", F.lit(10))).alias("period_end"), money(balance("OPBD")).alias("opening"), money(balance("CLBD")).alias("closing"),
    )
    e = raw.select(F.col("Id").alias("statement"), F.posexplode("Ntry").alias("line_no", "e"))
    tx = F.col("e.NtryDtls.TxDtls")
    lines = e.select(
        "statement", "line_no", F.try_to_date(F.coalesce("e.BookgDt.Dt", "e.ValDt.Dt")).alias("booking_date"), F.col("e.Amt._VALUE").try_cast("decimal(18,2)").alias("amount"), F.col("e.Amt._Ccy").alias("currency"),
        F.when(F.col("e.CdtDbtInd") == "DBIT", "debit").otherwise("credit").alias("direction"), F.when(F.col("e.CdtDbtInd") == "DBIT", tx["RltdPties"]["Cdtr"]["Nm"]).otherwise(tx["RltdPties"]["Dbtr"]["Nm"]).alias("counterparty"), F.coalesce(tx["RmtInf"]["Ustrd"], F.col("e.AddtlNtryInf")).alias("memo"),
    )
    return statements, lines


def printed_lines(lines: DataFrame, doc: str, line_no: str, line: str, pattern: str) -> DataFrame:
    """Printed statements: a line that fits the pattern (date, text, amount) begins an entry, others go on with the one before."""
    starts = F.col(line).rlike(pattern)
    order = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("entry", F.sum(starts.cast("int")).over(order)).where("entry > 0").withColumn("starts", starts)
    first = F.max_by(line, F.when(F.col("starts"), 1))
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct(line_no, line)))), lambda x: F.trim(x[line])), " ")
    got = rows.groupBy(doc, "entry").agg(first.alias("head"), tail.alias("more"))
    return got.select(doc, "entry", F.regexp_extract("head", pattern, 1).alias("booking_date"), F.trim(F.concat_ws(" ", F.regexp_extract("head", pattern, 2), F.nullif("more", F.lit("")))).alias("memo"), F.regexp_extract("head", pattern, 3).alias("amount"))


def word_lines(words: DataFrame, y_tolerance: float = 0.003, x_gap: float = 0.02) -> DataFrame:
    """(doc, page, line_no, cells) from words(doc, page, text, x0, x1, top): lines are runs of near tops, cells runs without a gap."""
    down = Window.partitionBy("doc", "page").orderBy("top", "x0", "text")
    step = F.coalesce(F.col("top") - F.lag("top").over(down) > y_tolerance, F.lit(True))
    rows = words.withColumn("s", step.cast("int")).withColumn("line_no", F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("doc", "page", "line_no").orderBy("x0", "text")
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(along) > x_gap, F.lit(True))
    rows = rows.withColumn("g", gap.cast("int")).withColumn("cell", F.sum("g").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), " ")
    cells = rows.groupBy("doc", "page", "line_no", "cell").agg(joined("x0", "text").alias("text"))
    return cells.groupBy("doc", "page", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]).alias("cells"))


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words with their confidences (0 to 1) from tab-separated files."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    raw = spark.read.schema(schema).option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    return raw.where("level = 5 and conf >= 0 and trim(text) <> ''").select(F.col("_metadata.file_name").alias("doc"), F.col("page_num").alias("page"), F.concat_ws(".", "block_num", "par_num", "line_num").alias("line"), "word_num", "text", (F.col("conf") / 100).alias("conf"))


def ocr_signals(words: DataFrame, low: float = 0.6, mean_at_least: float = 0.8, low_at_most: float = 0.2) -> DataFrame:
    """(doc, mean_conf, low_ratio, escalate): whether a document is worth the costlier recognition."""
    s = words.groupBy("doc").agg(F.round(F.avg("conf"), 4).alias("mean_conf"), F.round(F.avg((F.col("conf") < low).cast("int")), 4).alias("low_ratio"))
    return s.withColumn("escalate", (F.col("mean_conf") < mean_at_least) | (F.col("low_ratio") > low_at_most))


MAIL = "path string, message_id string, sender string, recipients array<string>, subject string, sent timestamp, body string, attachments array<struct<name: string, kind: string, bytes: long, digest: string>>, problem string"


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    """Message files (.eml) with their attachments' names, sizes and digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(pdfs):
        import hashlib
        from email import message_from_bytes, policy
        from email.utils import getaddresses, parsedate_to_datetime

        import pandas as pd

        for pdf in pdfs:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    m = message_from_bytes(data, policy=policy.default)
                    part = m.get_body(("plain", "html"))
                    files = [(a.get_filename() or "", a.get_content_type(), a.get_payload(decode=True) or b"") for a in m.iter_attachments()]
                    sent = pd.Timestamp(parsedate_to_datetime(m["date"])).tz_convert("UTC").tz_localize(None) if m["date"] else None
                    out.append((name, m["message-id"], str(m["from"] or ""), [a for _, a in getaddresses([str(m["to"] or "")])], str(m["subject"] or ""), sent, part.get_content() if part else "", [(n, t, len(b), hashlib.sha256(b).hexdigest()) for n, t, b in files], None))
                except Exception as problem:  # noqa: BLE001 - a message's own fault is data
                    out.append((name, None, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}"[:200]))
            yield pd.DataFrame(out, columns=["path", "message_id", "sender", "recipients", "subject", "sent", "body", "attachments", "problem"])

    return files.mapInPandas(run, MAIL)


def soap_result(answer, tag: str):
    """The XML that an envelope's element holds as text, unescaped; an answer without the element gives null."""
    x = F.nullif(F.regexp_extract(answer, rf"(?s)<(?:[A-Za-z0-9]+:)?{tag}\b[^>]*>(.*?)</(?:[A-Za-z0-9]+:)?{tag}>", 1), F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph, text, problem) of .docx files: their paragraphs in order, those of tables too."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(pdfs):
        import io
        import zipfile

        import pandas as pd

        from .tabular import MAX_BYTES, TooLarge, _safe_xml

        tag = lambda e: e.tag.rpartition("}")[2]
        shown = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n"}
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        if sum(i.file_size for i in z.infolist()) > MAX_BYTES:
                            raise TooLarge("the document unpacks to too many bytes")
                        body = _safe_xml(z.read("word/document.xml"))
                    texts = ["".join(shown[tag(e)](e) for e in p.iter() if tag(e) in shown) for p in body.iter() if tag(p) == "p"]
                    out = [(name, n, t, None) for n, t in enumerate(texts)]
                except Exception as problem:  # noqa: BLE001 - a file's own fault is data
                    out = [(name, None, None, f"{type(problem).__name__}: {problem}"[:200])]
                yield pd.DataFrame(out, columns=["path", "paragraph", "text", "problem"])

    return files.mapInPandas(run, "path string, paragraph int, text string, problem string")


def rates_from_xml(answers: DataFrame, column: str) -> DataFrame:
    """(currency, day, rate) from rate services' answers: days with rates, each for a number of units, decimal commas."""
    schema = "Day array<struct<_date: string, Rate: array<struct<_curr: string, _unit: int, _VALUE: string>>>>"
    days = answers.select(F.explode(F.from_xml(column, schema)["Day"]).alias("d")).select(F.try_to_date("d._date").alias("day"), F.explode("d.Rate").alias("r"))
    value = F.replace("r._VALUE", F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
    return days.select(F.col("r._curr").alias("currency"), "day", (value / F.col("r._unit")).cast("decimal(18,8)").alias("rate")).where("rate is not null")


def covered_days(fetches: DataFrame) -> DataFrame:
    """(currency, day) that a successful fetch vouches for: from its start to the day before it ran, or its end."""
    last = F.least(F.col("end_day"), F.date_sub(F.to_date("fetched_at"), 1))
    ok = fetches.where("status = 'ok'").where(F.col("start_day") <= last)
    return ok.select(F.explode(F.split("currencies", ",")).alias("currency"), "start_day", last.alias("last")).select("currency", F.explode(F.sequence("start_day", "last")).alias("day")).distinct()


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers, one a line, one row for each pick: its confidence, its two best probabilities and whether it was flagged."""
    schema = "case_id string, arm string, run_no int, route string, review_reasons array<string>, picks map<string, struct<label: string, confidence: double, n_options: int, top3: map<string, double>>>"
    rows = spark.read.schema(schema).json(path).select("case_id", "arm", "run_no", "route", "review_reasons", F.explode("picks").alias("question", "pick"))
    top = F.sort_array(F.map_values("pick.top3"), False)
    flagged = F.exists(F.coalesce("review_reasons", F.array().cast("array<string>")), lambda r: F.contains(r, F.col("question")))
    return rows.select("case_id", F.col("arm").alias("flow"), "run_no", "question", F.col("pick.label").alias("label"), F.col("pick.confidence").alias("confidence"), F.get(top, F.lit(0)).alias("p"), F.get(top, F.lit(1)).alias("second"), flagged.alias("flagged"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Recorded verdicts, one a line, one row for each question: its likeliest label (the later of equals in the alphabet), the
    probability, whether the question's claim is unsupported, and how many flags the document has."""
    schema = "case_id string, arm string, run_no int, model string, verdicts struct<flags: map<string, map<string, double>>>, doc_flags array<string>, unsupported array<string>"
    rows = spark.read.schema(schema).json(path)
    rows = rows.select("case_id", "arm", "run_no", "model", "doc_flags", "unsupported", F.explode("verdicts.flags").alias("question", "odds"))
    best = F.array_max(F.transform(F.map_entries("odds"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    none = F.array().cast("array<string>")
    return rows.select("case_id", F.col("arm").alias("flow"), "run_no", "model", "question", best["label"].alias("label"), best["p"].alias("p"), F.array_contains(F.coalesce("unsupported", none), F.col("question")).alias("unsupported"), F.size(F.coalesce("doc_flags", none)).alias("doc_flags"))


def first_profile(*attempts: DataFrame, key: str) -> DataFrame:
    """Of several readings of one file the first profile's that read it."""
    out, done = None, None
    for n, rows in enumerate(attempts):
        mine = rows.withColumn("profile", F.lit(n))
        mine = mine if done is None else mine.join(done, key, "left_anti")
        out = mine if out is None else out.unionByName(mine, allowMissingColumns=True)
        done = rows.select(key).distinct() if done is None else done.unionByName(rows.select(key)).distinct()
    return out


def chunks(rows: DataFrame, doc: str, order: str, text: str, most: int, context: int = 2) -> DataFrame:
    """(doc, chunk, text): rows kept whole, packed in order up to `most` bytes, the first rows repeated before each later chunk.

    Greedy by nature, so it is a fold over one document's rows.
    """

    def fold(pdf):
        import pandas as pd

        lines = pdf.sort_values(order)[text].fillna("").tolist()
        head = lines[:context]
        out, held, size = [], [], 0
        for n, line in enumerate(lines):
            add = len(line.encode()) + 1
            if held and size + add > most:
                out.append("\n".join(held))
                held = list(head) if n >= context else []
                size = sum(len(x.encode()) + 1 for x in held)
            held.append(line)
            size += add
        if held:
            out.append("\n".join(held))
        return pd.DataFrame({doc: [pdf[doc].iloc[0]] * len(out), "chunk": range(len(out)), "text": out})

    return rows.select(doc, order, text).groupBy(doc).applyInPandas(fold, f"{doc} {dict(rows.dtypes)[doc]}, chunk long, text string")

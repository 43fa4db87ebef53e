"""Queries of sources, sinks and streams: tables go out to files and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import documents, tabular, workbooks
from ..streaming import jobs, timers
from .staging import fresh_path, table


def csv_round_trip(spark, sf):
    """Orders written as a spreadsheet's CSV (guarded text, decimal commas) and read back by content."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.concat(F.lit("="), F.col("o_orderpriority")).alias("priority"))
    path = fresh_path(spark, "csv")
    tabular.write_csv(o, path)
    fields = tabular.records(tabular.blocks(tabular.accepted(tabular.read_tables(spark, path)), ["o_orderkey", "total"])).select("fields")
    return fields.select(F.col("fields")["o_orderkey"].cast("long").alias("o_orderkey"), F.replace(F.col("fields")["total"], F.lit(","), F.lit(".")).cast("decimal(18,2)").alias("total"), F.col("fields")["priority"].alias("priority"))


def xlsx_round_trip(spark, sf):
    """Nations as workbooks of the tasks, read back by content as any table file."""
    path = fresh_path(spark, "xlsx")
    workbooks.write(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    fields = tabular.records(tabular.blocks(tabular.read_tables(spark, path), ["n_nationkey"]))
    return fields.select(*[F.col("fields")[c].cast(t).alias(c) for c, t in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))])


def workbook_round_trip(spark, sf):
    """All line items out to workbooks and back by the data source: exact amounts, days, flags that look like formulas, missing cells."""
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 > 0, price).alias("price"), F.to_date("l_shipdate").alias("shipped"), F.concat(F.lit("="), F.col("l_returnflag")).alias("flag"))
    path = fresh_path(spark, "workbooks")
    workbooks.write(rows, path, rows_per_file=100_000)
    back = workbooks.read(spark, path, "l_orderkey long, l_linenumber int, price decimal(18,2), shipped date, flag string")
    return back.groupBy("flag", F.trunc("shipped", "MM").alias("month")).agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.sum("price").cast("decimal(18,2)").alias("price"), F.sum(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("keys"))


def camt_round_trip(spark, sf):
    """A statement for each customer with its orders as entries, written as XML files and read back."""
    o = table(spark, sf, "orders")
    e = o.select(F.col("o_custkey").alias("c"), F.concat(F.lit('<Ntry><Amt Ccy="EUR">'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("</Amt><CdtDbtInd>"), F.when(F.col("o_orderkey") % 2 == 0, "DBIT").otherwise("CRDT"), F.lit("</CdtDbtInd><BookgDt><Dt>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</Dt></BookgDt><NtryDtls><TxDtls><RmtInf><Ustrd>order "), F.col("o_orderkey").cast("string"), F.lit("</Ustrd></RmtInf></TxDtls></NtryDtls></Ntry>")).alias("x"))
    s = e.groupBy("c").agg(F.concat(F.lit("<Stmt><Id>S"), F.first("c").cast("string"), F.lit("</Id><Acct><Id><Othr><Id>A"), F.first("c").cast("string"), F.lit("</Id></Othr></Id><Ccy>EUR</Ccy></Acct>"), F.array_join(F.collect_list("x"), ""), F.lit("</Stmt>")).alias("value"))
    path = fresh_path(spark, "camt")
    parts = 8 + o.count() // 50_000  # files of bounded size, however many statements there are
    files = s.groupBy(F.pmod("c", F.lit(parts)).alias("f")).agg(F.concat(F.lit("<Document><BkToCstmrStmt>"), F.array_join(F.collect_list("value"), ""), F.lit("</BkToCstmrStmt></Document>")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    _, lines = documents.read_camt(spark, path)
    return lines.groupBy("statement", "direction").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount"), F.min("booking_date").alias("first"), F.max("memo").alias("memo"))


def ocr_round_trip(spark, sf):
    """Events as recognised words in tab-separated files, each with its header, written by as many tasks as read the table."""
    e = table(spark, sf, "events")
    fixed = {"level": "5", "page_num": "1", "block_num": "1", "par_num": "1", "line_num": "1", "word_num": None, "left": "0", "top": "0", "width": "9", "height": "9"}
    words = e.select(*[F.col("event_id").cast("string").alias(n) if v is None else F.lit(v).alias(n) for n, v in fixed.items()], F.format_string("%.2f", "value").alias("conf"), F.col("event_type").alias("text"))
    path = fresh_path(spark, "ocr")
    words.write.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    return documents.read_ocr_tsv(spark, path).groupBy("text").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 4).alias("conf"))


def judgements_round_trip(spark, sf):
    e = table(spark, sf, "events")
    p = (F.col("event_id") * 37 % 1001) / 1000
    pick = F.struct(F.concat(F.lit("L"), (F.col("event_id") % 4).cast("string")).alias("label"), p.alias("confidence"), F.lit(3).alias("n_options"), F.create_map(F.lit("a"), p, F.lit("b"), F.round(1 - p, 3)).alias("top3"))
    rows = e.select(F.col("event_id").cast("string").alias("case_id"), F.lit("S").alias("arm"), F.lit(1).alias("run_no"), F.lit("auto").alias("route"), F.when(F.col("event_id") % 5 == 0, F.array(F.concat(F.lit("check:"), F.col("event_type")))).otherwise(F.array().cast("array<string>")).alias("review_reasons"), F.create_map(F.col("event_type"), pick).alias("picks"))
    path = fresh_path(spark, "judgements")
    rows.write.json(path)
    j = documents.read_judgements(spark, path)
    return j.groupBy("question", "label").agg(F.count("*").alias("n"), F.round(F.sum("p"), 3).alias("p"), F.round(F.sum("second"), 3).alias("second"), F.count_if("flagged").alias("flagged"))


def verdicts_round_trip(spark, sf):
    """Verdict files: flags with probabilities by question, flags of the whole document, claims that nothing supports."""
    e = table(spark, sf, "events")
    p = (F.col("event_id") * 37 % 1001) / 1000
    flags = F.create_map(F.col("event_type"), F.create_map(F.lit("wrong"), p, F.lit("right"), F.round(1 - p, 3)))
    verdicts = F.struct(flags.alias("flags"))
    rows = e.select(F.col("event_id").cast("string").alias("case_id"), F.lit("G").alias("arm"), F.lit(1).alias("run_no"), F.lit("m1").alias("model"), verdicts.alias("verdicts"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("scan"))).otherwise(F.array().cast("array<string>")).alias("doc_flags"), F.when(F.col("event_id") % 7 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("unsupported"))
    path = fresh_path(spark, "verdicts")
    rows.write.json(path)
    j = documents.read_verdicts(spark, path)
    return j.groupBy("question", "label").agg(F.count("*").alias("n"), F.round(F.sum("p"), 3).alias("p"), F.count_if("unsupported").alias("unsupported"), F.sum("doc_flags").alias("doc_flags"))


def rates_from_xml(spark, sf):
    """An answer for each order's day with rates of two currencies, one of them for a hundred units."""
    k = F.col("o_orderkey")
    days = table(spark, sf, "orders").select(F.concat(F.lit('<R><Day date="'), F.to_date("o_orderdate").cast("string"), F.lit('"><Rate curr="EUR" unit="1">'), F.concat_ws(",", (F.lit(380) + k % 20).cast("string"), F.lit("25")), F.lit('</Rate><Rate curr="JPY" unit="100">'), (F.lit(250) + k % 7).cast("string"), F.lit("</Rate></Day></R>")).alias("x"))
    return documents.rates_from_xml(days, "x").groupBy("currency").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rate").cast("double")), 6).alias("rate"), F.max("day").alias("last"))


def fetch_coverage(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    f = o.select(F.when(F.col("o_orderkey") % 2 == 1, "EUR,USD").otherwise("EUR").alias("currencies"), day.alias("start_day"), F.date_add(day, 5).alias("end_day"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("ok").alias("status"), F.date_add(day, 3).cast("string").alias("fetched_at"))
    return documents.covered_days(f).groupBy("currency").agg(F.count("*").alias("days"), F.min("day").alias("first"))


def statement_blocks(spark, sf):
    """Line items as rows of sheets in which a header comes again for each order: blocks are counted from the headers."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("path"), F.lit("s").alias("sheet"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("int").alias("row_no"), F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag")).alias("cells"))
    heads = table(spark, sf, "lineitem").select("l_orderkey").distinct().select((F.col("l_orderkey") % 50).cast("string").alias("path"), F.lit("s").alias("sheet"), (F.col("l_orderkey") * 100).cast("int").alias("row_no"), F.array(F.lit("Line"), F.lit("Flag")).alias("cells"))
    b = tabular.blocks(li.unionByName(heads), ["line", "flag"])
    return tabular.records(b).groupBy("path").agg(F.countDistinct("block").alias("blocks"), F.count("*").alias("rows"), F.count_if(F.col("fields")["flag"] == "R").alias("r"))


def ledger_export(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_returnflag").alias("statement"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("decimal(18,2)").alias("amount"))
    got = tabular.ledgers(li, ["account", "statement"], "pos")
    return got.select("account", "statement", F.size("lines").cast("long").alias("n"), F.get("lines", F.lit(0))["pos"].alias("first"))


def companion_merge(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.floor("value").cast("long").alias("amount"))
    got = tabular.merge_companion(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select(F.col("event_id").alias("printed"), "day", "amount"), ["day", "amount"], "event_id", "printed")
    return got.select("event_id", "printed")


def mojibake(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[^\n -~à-ÿ]", "").alias("t"))
    return d.select("doc_id", tabular.unmangled(F.decode(F.encode("t", "utf-8"), "iso-8859-1")).alias("text"))


def printed_statement(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("doc"), "o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("a"), "o_orderpriority")
    lines = o.select("doc", F.posexplode(F.array(F.concat_ws(" ", "d", F.lit("order"), F.col("a")), F.col("o_orderpriority"), F.lit("  more"))).alias("k", "line"), "o_orderkey").select("doc", (F.col("o_orderkey") * 3 + F.col("k")).alias("line_no"), "line")
    got = documents.printed_lines(lines, "doc", "line_no", "line", r"^([0-9]{4}\.[0-9]{2}\.[0-9]{2}) (.*?) ([0-9.]+)$")
    return got.select("doc", F.col("entry").alias("entry"), "booking_date", "memo", "amount")


def word_layout(spark, sf):
    """Words of documents set on lines of a page, found again as lines and cells."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.split("text", r"\s+").alias("w"))
    words = d.select("doc", F.lit(1).alias("page"), F.posexplode("w").alias("i", "text"))
    row, col = F.floor(F.col("i") / 6), F.col("i") % 6
    placed = words.select("doc", "page", "text", (col * 0.1 + F.when(col >= 3, 0.1).otherwise(0.0)).alias("x0"), (col * 0.1 + F.when(col >= 3, 0.1).otherwise(0.0) + 0.09).alias("x1"), (row * 0.02 + (F.col("i") % 2) * 0.0001).alias("top"))
    got = documents.word_lines(placed)
    return got.select("doc", F.col("line_no").alias("line_no"), F.size("cells").cast("long").alias("cells"), F.get("cells", F.lit(0)).alias("first"))


def text_chunks(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return documents.chunks(lines, "doc_id", "n", "line", 1500).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.octet_length("text")).cast("long").alias("longest"))


def profile_order(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return documents.first_profile(o.where("o_orderkey % 6 = 0"), o.where("o_orderkey % 2 = 0"), o, key="o_orderkey")


def _log(spark, sf):
    e = table(spark, sf, "events")
    event = F.element_at(F.array(*[F.lit(x) for x in ("enqueued", "claimed", "failed", "claimed", "completed", "cancelled")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 13).cast("long").alias("job_id"), event.alias("event"), F.col("ts").alias("at"))


def queue_fold(spark, sf):
    return jobs.queue_state(_log(spark, sf)).select("job_id", "status", "attempts")


def queue_claims(spark, sf):
    return jobs.claim_order(jobs.queue_state(_log(spark, sf)), F.lit("2030-01-01").cast("timestamp"), 20).select("job_id", "attempts")


def stream_calls_per_minute(spark, sf):
    """Events read as a stream, counted by ten minutes and type in append mode into files."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parq*").withColumn("at", F.col("ts").cast("timestamp"))
    out = fresh_path(spark, "calls")
    counted = jobs.calls_per_window(stream, "at", "event_type", "10 minutes")
    counted.writeStream.option("checkpointLocation", fresh_path(spark, "calls-checkpoint")).trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_outbox(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parq*")
    out = fresh_path(spark, "outbox")
    jobs.run_batches(stream, fresh_path(spark, "outbox-checkpoint"), jobs.outbox(lambda b: b.groupBy("user_id").agg(F.count("*").alias("n")), out)).awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.sum("n").alias("n"))


def stream_worker(spark, sf):
    """Events as jobs of a queue, worked off in batches by their kind; repeated keys count once."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parq*")
    queue = stream.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), F.concat_ws(":", "event_type", (F.col("event_id") % 300).cast("string")).alias("dedup_key"), "value")
    stages = {"click": lambda j: j.select("job_id", (F.col("job_id") % 7).alias("result")), "purchase": lambda j: j.where("job_id % 5 > 0").select("job_id", F.lit("paid").alias("result")), "view": lambda j: j.select("job_id", F.lit("seen").alias("result"))}
    out = fresh_path(spark, "worker")
    jobs.run_batches(queue, fresh_path(spark, "worker-checkpoint"), jobs.worker(stages, out)).awaitTermination()
    return spark.read.parquet(out).groupBy("kind", "state", "result").agg(F.count("*").alias("n"))


def _case_events(df):
    """A view or a click arms its user's timer (or moves it), a purchase cancels it."""
    what = F.when(F.col("event_type").isin("view", "click"), "arm").when(F.col("event_type") == "purchase", "cancel").otherwise("none")
    return df.select(F.col("user_id").alias("case"), F.col("ts").cast("timestamp").alias("at"), what.alias("what"), (F.lit(3600) * (1 + F.col("event_id") % 12)).alias("delay_s"), F.col("event_id").alias("n"))


def stream_timers(spark, sf):
    """The timers that fire in a stream of the events, up to its last watermark; the state lives in the RocksDB store."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parq*")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.rocks(spark)
    try:
        fired = timers.fired_timers(_case_events(stream))
        out = fresh_path(spark, "timers")
        fired.writeStream.option("checkpointLocation", fresh_path(spark, "timers-checkpoint")).trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(fired.schema).parquet(out).select("case", F.unix_micros("armed_at").alias("armed_us"), F.unix_micros("due_at").alias("due_us"))


def stream_dedup(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parq*").withColumn("at", F.col("ts").cast("timestamp")).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    out = fresh_path(spark, "dedup")
    jobs.deduplicated(stream, "key", "at", "3650 days").select("key").writeStream.option("checkpointLocation", fresh_path(spark, "dedup-checkpoint")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema("key string").parquet(out)


def decisions_carried(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(F.col("o_orderkey").alias("decision_id"), (F.col("o_orderkey") * 10).alias("line_id"))
    line_map = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 10).alias("line_id"), (F.col("o_orderkey") * 10 + 5).alias("new_line_id"))
    replaced = o.where("o_orderkey % 3 = 0 or o_orderkey % 7 = 0").select((F.col("o_orderkey") * 10).alias("line_id"))
    return jobs.carried(d, line_map, replaced)


def event_sessions(spark, sf):
    return jobs.sessions(table(spark, sf, "events"), "user_id", "ts", 86400).groupBy("user_id").agg(F.max("session").cast("long").alias("sessions"))


def artifact_conflicts(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 7).alias("kind"), F.floor(F.col("value") / 20).alias("payload"))
    return e.groupBy("kind", "user_id").agg(F.countDistinct("payload").alias("payloads")).where("payloads > 1")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_LOGSQL = "l AS (SELECT event_id AS seq, event_id // 13 AS job_id, ['enqueued', 'claimed', 'failed', 'claimed', 'completed', 'cancelled'][event_id % 6 + 1] AS event FROM events), s AS (SELECT job_id, arg_max(event, seq) AS event, count(*) FILTER (WHERE event = 'claimed') AS attempts FROM l GROUP BY 1), q AS (SELECT CAST(job_id AS BIGINT) AS job_id, CASE event WHEN 'enqueued' THEN 'queued' WHEN 'failed' THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'queued' END WHEN 'completed' THEN 'done' ELSE event END AS status, attempts FROM s)"
ORACLES = {
    "stream_timers": "WITH u AS (SELECT epoch_ms(max(ts)) * 1000 - 600000000 AS w FROM events), o AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events, u WHERE event_type IN ('view', 'click', 'purchase') AND epoch_us(ts) <= w), d AS (SELECT *, t + 3600000000 * (1 + event_id % 12) AS due FROM o WHERE event_type <> 'purchase') SELECT CAST(user_id AS VARCHAR) AS \"case\", t AS armed_us, due AS due_us FROM d, u WHERE due <= w AND (nxt IS NULL OR nxt >= due)",
    "csv_round_trip": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, '''=' || o_orderpriority AS priority FROM orders",
    "workbook_round_trip": "SELECT '=' || l_returnflag AS flag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 5 > 0) AS priced, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linenumber % 5 > 0) AS DECIMAL(18,2)) AS price, CAST(sum(l_orderkey * 7 + l_linenumber) AS BIGINT) AS keys FROM lineitem GROUP BY 1, 2",
    "xlsx_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "camt_round_trip": "SELECT 'S' || o_custkey AS statement, CASE WHEN o_orderkey % 2 = 0 THEN 'debit' ELSE 'credit' END AS direction, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, min(CAST(o_orderdate AS DATE)) AS first, max('order ' || o_orderkey) AS memo FROM orders GROUP BY 1, 2",
    "ocr_round_trip": "SELECT event_type AS text, count(*) AS n, round(avg(round(value, 2)) / 100, 4) AS conf FROM events GROUP BY 1",
    "judgements_round_trip": "WITH e AS (SELECT *, (event_id * 37 % 1001) / 1000 AS p FROM events) SELECT event_type AS question, 'L' || event_id % 4 AS label, count(*) AS n, round(sum(greatest(p, round(1 - p, 3))), 3) AS p, round(sum(least(p, round(1 - p, 3))), 3) AS second, count(*) FILTER (WHERE event_id % 5 = 0) AS flagged FROM e GROUP BY 1, 2",
    "verdicts_round_trip": "WITH e AS (SELECT *, (event_id * 37 % 1001) / 1000 AS p FROM events) SELECT event_type AS question, CASE WHEN p >= round(1 - p, 3) THEN 'wrong' ELSE 'right' END AS label, count(*) AS n, round(sum(greatest(p, round(1 - p, 3))), 3) AS p, count(*) FILTER (WHERE event_id % 7 = 0) AS unsupported, count(*) FILTER (WHERE event_id % 5 = 0) AS doc_flags FROM e GROUP BY 1, 2",
    "rates_from_xml": "SELECT 'EUR' AS currency, count(*) AS n, round(avg(380 + o_orderkey % 20 + 0.25), 6) AS rate, CAST(max(o_orderdate) AS DATE) AS last FROM orders UNION ALL SELECT 'JPY', count(*), round(avg((250 + o_orderkey % 7) / 100), 6), CAST(max(o_orderdate) AS DATE) FROM orders",
    "fetch_coverage": "WITH f AS (SELECT CASE WHEN o_orderkey % 2 = 1 THEN ['EUR', 'USD'] ELSE ['EUR'] END AS c, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 <> 0), x AS (SELECT DISTINCT currency, CAST(d + CAST(i AS INT) AS DATE) AS day FROM (SELECT unnest(c) AS currency, d FROM f), range(3) t(i)) SELECT currency, count(*) AS days, min(day) AS first FROM x GROUP BY 1",
    "statement_blocks": "SELECT CAST(l_orderkey % 50 AS VARCHAR) AS path, count(DISTINCT l_orderkey) AS blocks, count(*) AS rows, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
    "ledger_export": "SELECT l_suppkey AS account, l_returnflag AS statement, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2",
    "companion_merge": "WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS amount FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY day, amount ORDER BY event_id) AS n FROM e WHERE event_id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY day, amount ORDER BY event_id) AS n FROM e WHERE event_id % 2 = 1) SELECT a.event_id, b.event_id AS printed FROM a LEFT JOIN b USING (day, amount, n)",
    "mojibake": "SELECT doc_id, regexp_replace(text, '[^\\n -~à-ÿ]', '', 'g') AS text FROM documents",
    "printed_statement": "SELECT o_custkey % 200 AS doc, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS entry, strftime(o_orderdate, '%Y.%m.%d') AS booking_date, 'order ' || o_orderpriority || ' more' AS memo, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders",
    "word_layout": "WITH d AS (SELECT doc_id AS doc, regexp_split_to_array(text, '\\s+') AS w FROM documents), r AS (SELECT doc, unnest(range((len(w) + 5) // 6)) AS i, len(w) AS n, w FROM d) SELECT doc, CAST(i + 1 AS BIGINT) AS line_no, CAST(CASE WHEN n - i * 6 > 3 THEN 2 ELSE 1 END AS BIGINT) AS cells, array_to_string(w[i * 6 + 1 : least(n, i * 6 + 3)], ' ') AS first FROM r",
    "profile_order": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS profile FROM orders",
    "queue_fold": f"WITH {_LOGSQL} SELECT * FROM q",
    "queue_claims": f"WITH {_LOGSQL} SELECT job_id, attempts FROM q WHERE status = 'queued' ORDER BY attempts, job_id LIMIT 20",
    "stream_calls_per_minute": "WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, n FROM w WHERE s + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_outbox": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "stream_worker": "WITH j AS (SELECT event_type AS kind, min(event_id) AS id FROM events GROUP BY event_type, event_id % 300), r AS (SELECT kind, CASE kind WHEN 'click' THEN CAST(id % 7 AS VARCHAR) WHEN 'purchase' THEN CASE WHEN id % 5 > 0 THEN 'paid' END WHEN 'view' THEN 'seen' END AS result FROM j) SELECT kind, CASE WHEN kind NOT IN ('click', 'purchase', 'view') THEN 'refused' WHEN result IS NULL THEN 'failed' ELSE 'done' END AS state, result, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "stream_dedup": "SELECT DISTINCT user_id || ':' || event_type AS key FROM events",
    "decisions_carried": "SELECT o_orderkey AS decision_id, o_orderkey * 10 AS line_id, o_orderkey * 10 + CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END AS now_on, CASE WHEN o_orderkey % 3 = 0 THEN 'moved' WHEN o_orderkey % 7 = 0 THEN 'left_over' ELSE 'stays' END AS state FROM orders",
    "event_sessions": "WITH e AS (SELECT user_id, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) <= 86400 THEN 0 ELSE 1 END AS f FROM events) SELECT user_id, CAST(sum(f) AS BIGINT) AS sessions FROM e GROUP BY 1",
    "artifact_conflicts": "SELECT event_id % 7 AS kind, user_id, count(DISTINCT floor(value / 20)) AS payloads FROM events GROUP BY 1, 2 HAVING count(DISTINCT floor(value / 20)) > 1",
}

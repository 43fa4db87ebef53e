"""Queries of scalar functions, finders and scanners over documents, conversations, pages and benchmark items."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import dates, ids, numbers, text
from ..operators import candidates, finders, relations
from .staging import table, written

NUMBERS = ["1 234,56", "1.234,56", "1,234.56", "28.000", "28,000", "0,500", "12.5", "1234", "-5", "5-", "1.2.3", "1.234.567", "12,34,56", "HUF 1 000", "abc", "", "3,3900", "1234.567", "$42.50", "1.5"]
_VALUES = ", ".join(f"({n}, '{x}')" for n, x in enumerate(NUMBERS))
#: What money and quantity readings of NUMBERS are (worked out by hand): value, ambiguous.
_MONEY = [("1234.56", 0), ("1234.56", 0), ("1234.56", 0), ("28000", 0), ("28000", 0), (None, 0), ("12.5", 1), ("1234", 0), ("-5", 0), ("5", 0), (None, 0), ("1234567", 0), (None, 0), ("1000", 0), (None, 0), (None, 0), ("3.39", 1), ("1234.567", 1), ("42.5", 1), ("1.5", 1)]
_MONEY[5] = ("500", 0)
_QUANTITY = [("1234.56", 0), ("1234.56", 0), ("1234.56", 0), ("28000", 1), ("28", 1), ("0.5", 1), ("12.5", 1), ("1234", 0), ("-5", 0), ("5", 0), (None, 0), ("1234567", 0), (None, 0), ("1000", 0), (None, 0), (None, 0), ("3.39", 0), ("1234.567", 0), ("42.5", 1), ("1.5", 1)]
_TYPED = ["1234.56", "1234.56", "1234.56", "28000", None, None, None, "1234", "-5", None, None, "1234567", None, None, None, None, "3.39", None, None, None]
DATES = ["2024.01.09.", "2024-1-9", "09.01.2024", "13/02/2024", "02/13/2024", "5 March 2024", "31. Dezember 2023", "2024-02-30", "no day", "12/12/2024"]
_DATES = [("2024-01-09", 0), ("2024-01-09", 0), ("2024-01-09", 1), ("2024-02-13", 0), ("2024-02-13", 0), ("2024-03-05", 0), ("2023-12-31", 0), (None, 0), (None, 0), ("2024-12-12", 0)]


def _printed(spark, sf, values):
    """Every order with one of these notations."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int")).alias("raw"))


def number_reader(spark, sf):
    r = _printed(spark, sf, NUMBERS).select("o_orderkey", numbers.read_number(F.col("raw")).alias("m"), numbers.read_number(F.col("raw"), "number").alias("q"), numbers.read_input(F.col("raw")).alias("t"))
    return r.select("o_orderkey", F.col("m.value").cast("double").alias("money"), F.col("m.ambiguous").alias("money_ambiguous"), F.col("q.value").cast("double").alias("quantity"), F.col("q.ambiguous").alias("quantity_ambiguous"), F.col("t").cast("double").alias("typed"))


def printed_numbers(spark, sf):
    """Orders' totals printed in four notations, read back."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    english = F.format_number("t", 2)
    printed = F.element_at(F.array(F.translate(english, ",.", " ,"), F.translate(english, ",.", ".,"), english, F.concat(F.translate(english, ",", ""), F.lit(" EUR"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", numbers.read_number(printed)["value"].cast("double").alias("value"))


def date_reader(spark, sf):
    r = _printed(spark, sf, DATES).select("o_orderkey", dates.read_date(F.col("raw")).alias("d"))
    return r.select("o_orderkey", F.col("d.value").alias("day"), F.col("d.ambiguous").alias("ambiguous"))


def canonical_numbers(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numbers.canonical(F.col("o_totalprice").cast("decimal(18,2)")).alias("text"), numbers.minor_units(F.col("o_totalprice").cast("decimal(18,2)")).alias("minor"))


def rounding_modes(spark, sf):
    x = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf, "orders").select("o_orderkey", numbers.round_to(x, "5").alias("up"), numbers.round_to(x - 100000, "0.5", "half_even").alias("even"), numbers.round_to(x - 100000, "10", "down").alias("down"))


def notation_votes(spark, sf):
    o = table(spark, sf, "orders")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("total "), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("total "), F.format_string("%.2f", "o_totalprice"))).otherwise("on 12.10.2024 at 10:30")
    comma, dot = numbers.convention_votes(written)
    votes = o.groupBy("o_custkey").agg(F.sum(comma).alias("c"), F.sum(dot).alias("d"))
    return votes.select("o_custkey", F.when(F.col("c") > F.col("d"), "comma").when(F.col("d") > F.col("c"), "dot").alias("notation"))


def tax_id_check(spark, sf):
    """Domestic numbers made from customer keys, every third with a right check digit."""
    c = table(spark, sf, "customer").select("c_custkey", F.lpad(((F.col("c_custkey") * 7919) % 10000000).cast("string"), 7, "0").alias("stem"))
    w = ids._weighted(ids._digits(F.col("stem")), ids.TAX_WEIGHTS)
    digit = F.when(F.col("c_custkey") % 3 == 0, F.pmod(10 - w % 10, F.lit(10))).otherwise(F.col("c_custkey") % 10).cast("string")
    tax = F.concat("stem", digit, F.lit("-"), (F.col("c_custkey") % 7).cast("string"), F.lit("-"), F.lpad((F.col("c_custkey") % 55).cast("string"), 2, "0"))
    return c.select("c_custkey", ids.hu_tax_code(tax).alias("code"))


def iban_mod97(spark, sf):
    """German-shaped accounts made from customer keys with their right check digits, every fourth off by one."""
    c = table(spark, sf, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 104729).cast("string"), 18, "0").alias("bban"))
    rest = ids.mod97(F.concat(F.lit("DE00"), F.col("bban")))
    check = F.lpad((98 - rest + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)).cast("string"), 2, "0")
    iban = F.concat(F.lit("DE"), check, F.col("bban"))
    return c.select("c_custkey", ids.account_code(iban).alias("code"), (ids.account_key(iban) == iban).alias("own_key"))


def account_keys(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 104729).cast("string"), 16, "0").alias("a"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws("-", F.substring("a", 1, 8), F.substring("a", 9, 8))).when(F.col("c_custkey") % 3 == 1, F.concat("a", F.lit("00000000"))).otherwise(F.concat(F.lit("xxxx"), F.substring("a", 5, 12)))
    return c.select("c_custkey", ids.account_key(raw).alias("key"))


def luhn(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 15485863).cast("string"), 15, "0")).alias("n"))
    return c.select("c_custkey", ids.is_card(F.col("n")).alias("is_card"))


def card_mask(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 15485863).cast("string"), 15, "0")).alias("n"))
    return c.select("c_custkey", text.mask_cards(F.concat(F.lit("card "), F.col("n"), F.lit(" end"))).alias("masked"))


def content_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def text_keys(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    return d.select("doc_id", text.normalize(F.col("t")).alias("normalized")).select("doc_id", "normalized", text.squeezed(F.col("normalized")).alias("compacted"))


def name_and_number_keys(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.name_key(F.concat_ws(" ", "p_name", F.lit("x"), "p_brand")).alias("name_key"), text.number_key(F.concat(F.lit("no/"), F.col("p_partkey").cast("string"), F.lit("-a"))).alias("number_key"), text.number_key(F.lit("N/A")).alias("no_number"))


def value_shapes(spark, sf):
    return table(spark, sf, "part").groupBy(text.shape(F.concat_ws(" ", "p_brand", "p_type")).alias("shape")).agg(F.count("*").alias("n"))


def name_shares(spark, sf):
    p = table(spark, sf, "part")
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", F.lower("p_type"), F.lit("red small widget")), " ")
    return p.select("p_partkey", F.round(text.name_share(a, b), 4).alias("share"))


def fuzzy_words(spark, sf):
    """Words of the benchmark's items against all words of the documents."""
    words = lambda df, c: df.select(F.explode(F.array_distinct(F.split(text.normalize(F.col(c)), " "))).alias("w")).where("w <> ''").distinct()
    return relations.fuzzy_pairs(words(table(spark, sf, "benchmark"), "text"), words(table(spark, sf, "documents"), "text"), "w")


def benchmark_words_in_documents(spark, sf):
    """Benchmark items whose words stand as a whole in a document: candidates by the item's first words (five, or all it has), then exactly.

    A document gives out numbers of its runs of words only, one for each place; its text meets an item's once they have a run in common.
    """
    d = table(spark, sf, "documents")
    b = table(spark, sf, "benchmark").select("item_id", text.normalize(F.col("text")).alias("n")).where("n <> ''").withColumn("size", F.least(F.lit(5), F.size(F.split("n", " "))))
    hashed = lambda words, at, n: F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])
    items = written(b.withColumn("w", F.split("n", " ")).withColumn("k", F.coalesce(*[F.when(F.col("size") == n, hashed(F.col("w"), F.lit(0), n)) for n in range(1, 6)])).drop("w"), "items")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # five at most
    words = d.select("doc_id", F.split(text.normalize(F.col("text")), " ").alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: hashed(F.col("w"), i, n)))
    none = F.array().cast("array<bigint>")
    keys = words.select("doc_id", F.explode(F.concat(none, *[F.coalesce(runs(n), none) for n in sizes])).alias("k"))
    met = written(keys.join(items.select("item_id", "k"), "k").select("doc_id", "item_id").distinct(), "met")
    texts = d.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return met.join(items.select("item_id", "n"), "item_id").join(texts, "doc_id").where(text.has_words(F.col("t"), F.col("n"))).select("item_id", "doc_id").distinct()


def email_clean_body(spark, sf):
    c = table(spark, sf, "conversations")
    body = F.concat("text", F.when(F.col("turn") % 2 == 1, F.lit("\n-----Original Message-----\nquoted")).otherwise(F.lit("\nhttps://example.org/a\nend")))
    return c.select("conv_id", "turn", text.clean_body(body, r"\n-----Original Message-----", 500).alias("body"))


def dashes_and_doubles(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.repaired(F.concat(F.lit("a–b— k\\'ar \\H{o}r f\u00fbt\u00f5 "), "n_name")).alias("dashed"), text.undoubled(F.regexp_replace("n_name", "(.)", "$1$1")).alias("single"))


def safe_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.safe_part(F.concat(F.lit(" ."), F.col("p_name"), F.lit('/..\\a:  "b"|c?. ')), 30).alias("name"))


def usable_text(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(text.text_usable(F.col("text"))).alias("usable"), F.count("*").alias("n"))


def html_strip_blocks(spark, sf):
    return table(spark, sf, "pages").select("page_id", finders.html_text(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("length"), F.md5("text").alias("digest"))


def pii_findings(spark, sf):
    return finders.scan(table(spark, sf, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def candidate_finders(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return finders.candidates(lines, "doc_id", "line_no", "line").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


_FORMS = ("{d} {en} {y}", "{y}-{m}-{d}", "{d}.{m}.{y}", "{en} {d}, {y}", "{y}. {hu} {d}.", "{d} de {es} de {y}", "{d}. {de} {y}", "{d} {fr} {y}", "{d} {it} {y}")
#: Names of the months in six languages (fixed values).
_MONTH_NAMES = {
    "en": "January February March April May June July August September October November December", "hu": "január február március április május június július augusztus szeptember október november december",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
}


def dates_in_text(spark, sf):
    """The order's day as written in six languages and three numeric ways, in a sentence; each order is a document."""
    o = table(spark, sf, "orders")
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    parts = {"y": F.date_format(day, "yyyy"), "m": F.date_format(day, "MM"), "d": F.date_format(day, "dd")}
    parts |= {lang: F.element_at(F.array(*[F.lit(x) for x in names.split()]), F.month(day)) for lang, names in _MONTH_NAMES.items()}
    fields = [re.findall(r"{(\w+)}", form) for form in _FORMS]
    shapes = [F.format_string(re.sub(r"{\w+}", "%s", form), *[parts[name] for name in names]) for form, names in zip(_FORMS, fields, strict=True)]
    shape = F.coalesce(*[F.when(k % 9 == n, one) for n, one in enumerate(shapes)])
    said = F.concat(F.lit("Ref 123456, due "), shape, F.lit(" at 10 percent"))
    return finders.date_candidates(o.select("o_orderkey", F.lit(0).alias("line_no"), said.alias("line")), "o_orderkey", "line_no", "line").select("o_orderkey", "value", "ambiguous")


def parties_in_text(spark, sf):
    """Names with a legal form, addresses, currencies, payment lines, labelled fields and titles planted on lines of a page for each customer."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    town = F.element_at(F.array(F.lit("Budapest"), F.lit("Wien"), F.lit("Lyon")), (k % 3 + 1).cast("int"))
    page = F.array(
        F.lit("INVOICE"), F.concat(F.lit("Supplier: Alma "), F.initcap("c_mktsegment"), F.lit(" Kft. "), (k + 1000).cast("string"), F.lit(" "), town, F.lit(", Fo utca "), (k % 90).cast("string")),
        F.when(k % 2 == 0, "Payment method: bank transfer").otherwise("nothing here"), F.lit("Tariff"), F.concat(F.lit("  day "), (k % 5).cast("string")), F.when(k % 4 == 0, "in EUR").when(k % 4 == 1, "12 Ft").otherwise("none"),
    )
    lines = c.select("c_custkey", F.posexplode(page).alias("line_no", "line"))
    of = lambda df: df.select("c_custkey", "kind", "label")
    out = of(finders.names_and_addresses(lines, "c_custkey", "line_no", "line")).unionByName(of(finders.labelled_text(lines, "c_custkey", "line_no", "line", {"tariff": r"tariff", "payment": r"payment method"})))
    out = out.unionByName(of(finders.line_text(lines, "c_custkey", "line_no", "line", {"title": r"^\s*(?:invoice|receipt)\s*$"})))
    out = out.unionByName(finders.currencies(lines, "c_custkey", "line").select("c_custkey", F.lit("currency").alias("kind"), F.col("currency").alias("label")))
    return out.unionByName(finders.payment_lines(lines, "c_custkey", "line_no", "line").select("c_custkey", F.lit("payment_line").alias("kind"), F.col("line_no").cast("string").alias("label")))


def document_candidates(spark, sf):
    """An invoice's page for each customer, with candidates of all kinds: numbers beside, below and under their label or title, one of them
    printed again as if it were an amount, days that only another day of the page can tell, amounts with and without a currency."""
    k = F.col("c_custkey")
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text_ = lambda c: c.cast("string")
    total = text_(F.abs("c_acctbal").cast("decimal(18,2)"))
    page = F.array(
        F.lit("INVOICE"), F.when(k % 3 == 0, s("Invoice number: 2024/", text_(k))).when(k % 3 == 1, "Invoice number").otherwise(s("AB-", text_(k))), F.when(k % 3 == 1, text_(k + 100000)).otherwise("see below"),
        s("Supplier: Alma Kft. ", text_(k % 9000 + 1000), " Budapest, Fo utca ", text_(k % 90)), s("Account HU42 1177 3016 1111 1018 ", F.lpad(text_(k % 10000), 4, "0"), " 0000"), s("Tax number 1234", F.lpad(text_(k % 10000), 4, "0"), "-2-41"),
        s("Issued 1996-01-", F.lpad(text_(k % 28 + 1), 2, "0"), ", due 03/04/1996", F.when(k % 2 == 0, ", ordered 25/03/1996").otherwise("")), s("Transfer ", text_(k + 100000), " EUR, of it 27 % tax"),
        F.when(k % 4 == 0, s("Total ", total)).otherwise(s("Total ", total, " EUR")), s("Used ", text_(k % 500 + 1), " kWh"), F.lit("Payment method: card"), F.lit("Tariff"), s("  day ", text_(k % 5)),
    )
    lines = table(spark, sf, "customer").select("c_custkey", F.posexplode(page).alias("line_no", "line"))
    got = candidates.document_candidates(lines, "c_custkey", "line_no", "line", labels={"tariff": "tariff"}, titles={"title": r"^\s*invoice\s*$"})
    return got.select("c_custkey", "kind", "label", "line_no", "occurrences", "ambiguous")


def field_proposals(spark, sf):
    """Names that recur in many documents, most common spelling first."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n]+"))).alias("w")).where("length(w) between 4 and 12")
    spelled = d.groupBy(F.lower("w").alias("name"), "w").agg(F.count("*").alias("n"))
    got = spelled.groupBy("name").agg(F.sum("n").alias("documents"), F.max_by("w", F.struct("n", "w")).alias("spelling"))
    return got.where("documents >= 40")


def datapoints_eav(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("p")).select("event_id", F.col("p.key").alias("field"), F.col("p.value").alias("value"))


def json_extract(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("v"))


def documents_wide(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count("event_id"))


def snapshot_diff(spark, sf):
    """Orders that went, changed and came. The ones that come have numbers that no order has, whatever those are: a copy's, beside the order's."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("copy"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), "o_orderpriority")
    k = F.col("o_orderkey")
    after = o.where(k % 17 != 0).select("o_orderkey", "copy", F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "total", F.when(k % 15 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    after = after.unionByName(o.where(k % 100 == 1).withColumn("copy", F.lit(1)))
    got = relations.differences(o, after, ["o_orderkey", "copy"], ["o_orderstatus", "total", "o_orderpriority"])
    return got.groupBy("change", "fields").agg(F.count("*").alias("n"))


def latest_correction_overlay(spark, sf):
    e = table(spark, sf, "events")
    fixes = relations.latest(e.where("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("c_custkey"), F.col("value").cast("decimal(18,2)").alias("c_acctbal"))
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    return relations.overlay(base, fixes, "c_custkey", ["c_acctbal"])


def counted_result(spark, sf):
    """The result that counts: approved, then live, then trial; the latest of these."""
    e = table(spark, sf, "events")
    tier = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return relations.latest(e.withColumn("tier", tier), ["user_id"], [F.desc("tier"), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.col("tier").cast("int").alias("tier"))


def doc_counted_fallback(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    counted = d.join(lab, "doc_id").select("doc_id", F.lit("labelled").alias("source"), "quality")
    rest = relations.anti(d, lab, "doc_id").select("doc_id", F.lit("measured").alias("source"), F.lit(None).cast("int").alias("quality"))
    return counted.unionByName(rest)


def upsert_keep_known(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("name"))
    new = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("segment"), F.lit(None).cast("string").alias("name"))
    return relations.upsert(c, new, "c_custkey")


def semi_pending(spark, sf):
    return relations.semi(table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


def anti_undecided(spark, sf):
    return relations.anti(table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


def left_join_counts(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def computed_key_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("flow_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), "c_name")
    return e.withColumn("run_id", F.substring_index("flow_id", ":", 1)).join(c, "run_id").select("event_id", "c_name")


def union_streams(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("what"), F.to_date("o_orderdate").alias("day"))
    b = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("what"), F.to_date("ts").alias("day"), F.col("user_id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("what", F.date_format("day", "yyyy").alias("year")).agg(F.count("*").alias("n"), F.count("user_id").alias("users"))


def seen_set(spark, sf):
    e = table(spark, sf, "events")
    early, late = e.where("event_id < 500").select("user_id", "event_type"), e.where("event_id >= 500").select("user_id", "event_type")
    return late.distinct().join(early.distinct(), ["user_id", "event_type"], "left_anti")


def ordinal_score(spark, sf):
    e = table(spark, sf, "events").select("event_id", *[((F.col("event_id") * k) % 11 + 1).alias(f"w{k}") for k in (3, 5, 7)])
    total = F.col("w3") + F.col("w5") + F.col("w7")
    expected = F.round((1 * F.col("w3") + 2 * F.col("w5") + 3 * F.col("w7")) / total, 4)
    level = F.element_at(F.array_sort(F.array(F.struct((-F.col("w3")).alias("w"), F.lit(1).alias("l")), F.struct((-F.col("w5")).alias("w"), F.lit(2).alias("l")), F.struct((-F.col("w7")).alias("w"), F.lit(3).alias("l")))), 1)["l"]
    return e.select("event_id", level.alias("level"), expected.alias("expected"))


def ocr_confidence(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("value").alias("conf"))
    return e.groupBy("user_id").agg(F.round(F.avg("conf") / 100, 4).alias("mean_conf"), F.round(F.avg((F.col("conf") < 10).cast("int")), 4).alias("low_ratio")).withColumn("escalate", (F.col("mean_conf") < 0.2) | (F.col("low_ratio") > 0.45))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_ACC = "replace(strip_accents(lower({})), 'ß', 'ss')"
_NORM = "trim(regexp_replace(" + _ACC + ", '[^a-z0-9]+', ' ', 'g'))"
_DATE_OF = "CASE WHEN o_orderkey % 9 = 2 THEN extract(day FROM o_orderdate) <= 12 AND extract(day FROM o_orderdate) <> extract(month FROM o_orderdate) ELSE false END"
_chain = ", ".join(f"w{n} AS (SELECT *, regexp_replace(v{n}, '{p}', ' ', 'g') AS v{n + 1}, regexp_extract_all(v{n}, '{p}') AS h{n} FROM w{n - 1})" for n, p in enumerate(finders.PATTERNS.values())).replace("FROM w-1", "FROM l")
_kinds = " UNION ALL ".join(f"SELECT doc_id, line_no, {n} * 100000 + generate_subscripts(h{n}, 1) AS pos, '{k}' AS kind, unnest(h{n}) AS raw FROM w{len(finders.PATTERNS) - 1}" for n, k in enumerate(finders.PATTERNS))
_sql = lambda x: "NULL" if x is None else x
_truth_rows = ", ".join(f"({n}, CAST({_sql(m[0])} AS DOUBLE), {bool(m[1])}, CAST({_sql(q[0])} AS DOUBLE), {bool(q[1])}, CAST({_sql(t)} AS DOUBLE))" for n, (m, q, t) in enumerate(zip(_MONEY, _QUANTITY, _TYPED, strict=True)))
_date_rows = ", ".join(f"({n}, {'NULL' if d is None else repr(d)}, {bool(a)})" for n, (d, a) in enumerate(_DATES))
_W7 = " + ".join(f"CAST(substr(stem, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(ids.TAX_WEIGHTS))
ORACLES = {
    "number_reader": f"SELECT o_orderkey, money, money_ambiguous, quantity, quantity_ambiguous, typed FROM orders JOIN (VALUES {_truth_rows}) AS t(n, money, money_ambiguous, quantity, quantity_ambiguous, typed) ON o_orderkey % {len(NUMBERS)} = n",
    "printed_numbers": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value FROM orders",
    "date_reader": f"SELECT o_orderkey, CAST(day AS DATE) AS day, ambiguous FROM orders JOIN (VALUES {_date_rows}) AS t(n, day, ambiguous) ON o_orderkey % {len(DATES)} = n",
    "canonical_numbers": "WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders) SELECT o_orderkey, regexp_replace(CAST(t AS VARCHAR), '\\.?0+$', '') AS text, CAST(t * 100 AS BIGINT) AS minor FROM o",
    "rounding_modes": "WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders) SELECT o_orderkey, CAST(round(t / 5) * 5 AS DECIMAL(18,2)) AS up, CAST(round_even(CAST((t - 100000) * 2 AS DOUBLE), 0) / 2 AS DECIMAL(18,2)) AS even, CAST(trunc((t - 100000) / 10) * 10 AS DECIMAL(18,2)) AS down FROM o",
    "notation_votes": "WITH v AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS c, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS d FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN c > d THEN 'comma' WHEN d > c THEN 'dot' END AS notation FROM v",
    "tax_id_check": f"WITH c AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919) % 10000000 AS VARCHAR), 7, '0') AS stem FROM customer), k AS (SELECT *, (10 - ({_W7}) % 10) % 10 AS want FROM c), d AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN want ELSE c_custkey % 10 END AS has FROM k) SELECT c_custkey, CASE WHEN has <> want THEN 'taxid.checkdigit' WHEN c_custkey % 7 NOT BETWEEN 1 AND 5 THEN 'taxid.vatcode' WHEN NOT (c_custkey % 55 BETWEEN 2 AND 20 OR c_custkey % 55 BETWEEN 22 AND 44 OR c_custkey % 55 = 51) THEN 'taxid.county' ELSE 'taxid.ok' END AS code FROM d",
    "iban_mod97": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'iban.checksum' ELSE 'iban.ok' END AS code, true AS own_key FROM customer",
    "account_keys": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lpad(CAST(c_custkey * 104729 AS VARCHAR), 16, '0') || '00000000' ELSE '' END AS key FROM customer",
    "luhn": "WITH c AS (SELECT c_custkey, '4' || lpad(CAST(c_custkey * 15485863 AS VARCHAR), 15, '0') AS n FROM customer), d AS (SELECT c_custkey, i, CAST(substr(n, 17 - i, 1) AS INT) AS d FROM c, range(1, 17) t(i)), s AS (SELECT c_custkey, sum(CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) AS s FROM d GROUP BY 1) SELECT c_custkey, s % 10 = 0 AS is_card FROM s",
    "card_mask": "WITH c AS (SELECT c_custkey, '4' || lpad(CAST(c_custkey * 15485863 AS VARCHAR), 15, '0') AS n FROM customer), d AS (SELECT c_custkey, n, i, CAST(substr(n, 17 - i, 1) AS INT) AS d FROM c, range(1, 17) t(i)), s AS (SELECT c_custkey, n, sum(CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) AS s FROM d GROUP BY 1, 2) SELECT c_custkey, 'card ' || CASE WHEN s % 10 = 0 THEN left(n, 6) || 'xxxxxx' || right(n, 4) ELSE n END || ' end' AS masked FROM s",
    "content_digest": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "text_keys": f"WITH d AS (SELECT doc_id, {_NORM.format('text')} AS n FROM documents) SELECT doc_id, n AS normalized, replace(n, ' ', '') AS compacted FROM d",
    "name_and_number_keys": "SELECT p_partkey, concat_ws(' ', lower(p_name), 'brand') AS name_key, 'NO' || p_partkey || 'A' AS number_key, CAST(NULL AS VARCHAR) AS no_number FROM part",
    "value_shapes": "SELECT regexp_replace(regexp_replace(p_brand || ' ' || p_type, '\\pL', 'a', 'g'), '[0-9]', 'd', 'g') AS shape, count(*) AS n FROM part GROUP BY 1",
    "name_shares": "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, string_split(lower(p_type) || ' red small widget', ' ') AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(a), 4) AS share FROM p",
    "benchmark_words_in_documents": f"WITH d AS (SELECT doc_id, ' ' || {_NORM.format('text')} || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || {_NORM.format('text')} || ' ' AS n FROM benchmark) SELECT item_id, doc_id FROM b JOIN d ON contains(t, n)",
    "email_clean_body": "WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text ELSE text || chr(10) || chr(10) || 'end' END AS t FROM conversations) SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' '), 500) AS body FROM b",
    "dashes_and_doubles": "SELECT n_nationkey, 'a-b- kár őr fűtő ' || n_name AS dashed, n_name AS single FROM nation",
    "safe_names": "SELECT p_partkey, left(p_name || ' .. a b c', 30) AS name FROM part",
    "usable_text": "SELECT lang, count(*) FILTER (WHERE length(text) >= 40 AND length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) >= 0.5 * length(regexp_replace(text, '\\s', '', 'g'))) AS usable, count(*) AS n FROM documents GROUP BY 1",
    "datapoints_eav": "SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events",
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events",
    "documents_wide": "SELECT user_id, " + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "html_strip_blocks": "WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<!--.*?-->', ' ', 'g') AS x FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<(?:br|/p|/h[1-6]|/li|/div|/tr)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM a), c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS x FROM b), d AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ') AS x FROM c) SELECT page_id, length(x) AS length, md5(x) AS digest FROM d",
    "dates_in_text": f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS value, {_DATE_OF} AS ambiguous FROM orders",
    "parties_in_text": "WITH c AS (SELECT c_custkey AS k, upper(c_mktsegment[1]) || lower(substr(c_mktsegment, 2)) AS seg, ['Budapest', 'Wien', 'Lyon'][c_custkey % 3 + 1] AS town FROM customer) SELECT k AS c_custkey, 'name' AS kind, 'Alma ' || seg || ' Kft.' AS label FROM c UNION ALL SELECT k, 'address', (k + 1000) || ' ' || town || ', Fo utca ' || k % 90 FROM c UNION ALL SELECT k, 'tariff', 'day ' || k % 5 FROM c UNION ALL SELECT k, 'payment', 'bank transfer' FROM c WHERE k % 2 = 0 UNION ALL SELECT k, 'title', 'INVOICE' FROM c UNION ALL SELECT k, 'currency', CASE k % 4 WHEN 0 THEN 'EUR' ELSE 'HUF' END FROM c WHERE k % 4 < 2 UNION ALL SELECT k, 'payment_line', '2' FROM c WHERE k % 2 = 0",
    "document_candidates": """
        WITH o AS (SELECT c_custkey AS k, CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) AS total FROM customer),
        c AS (SELECT k, 'iban' AS kind, 'HU42117730161111' || '1018' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '0000' AS label, 4 AS line_no, false AS ambiguous FROM o
        UNION ALL SELECT k, 'tax_id', '1234' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '-2-41', 5, false FROM o
        UNION ALL SELECT k, 'date', '1996-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0'), 6, false FROM o
        UNION ALL SELECT k, 'date', '1996-04-03', 6, k % 2 = 1 FROM o
        UNION ALL SELECT k, 'date', '1996-03-25', 6, false FROM o WHERE k % 2 = 0
        UNION ALL SELECT k, 'invoice_number', CASE k % 3 WHEN 0 THEN '2024/' || k WHEN 1 THEN CAST(k + 100000 AS VARCHAR) ELSE 'AB-' || k END, CASE k % 3 WHEN 1 THEN 2 ELSE 1 END, false FROM o
        UNION ALL SELECT k, 'money', CAST(k + 100000 AS VARCHAR), 7, false FROM o WHERE k % 3 <> 1
        UNION ALL SELECT k, 'money', regexp_replace(total, '\\.?0+$', ''), 8, k % 4 = 0 FROM o
        UNION ALL SELECT k, 'quantity', CAST(k % 500 + 1 AS VARCHAR), 9, false FROM o
        UNION ALL SELECT k, 'currency', 'EUR', 7, false FROM o UNION ALL SELECT k, 'currency', 'EUR', 8, false FROM o WHERE k % 4 > 0
        UNION ALL SELECT k, 'name', 'Alma Kft.', 3, false FROM o
        UNION ALL SELECT k, 'address', (k % 9000 + 1000) || ' Budapest, Fo utca ' || k % 90, 3, false FROM o
        UNION ALL SELECT k, 'payment_line', '10', 10, false FROM o
        UNION ALL SELECT k, 'text:title', 'INVOICE', 0, false FROM o
        UNION ALL SELECT k, 'text:tariff', 'day ' || k % 5, 11, false FROM o)
        SELECT k AS c_custkey, kind, label, CAST(min(line_no) AS BIGINT) AS line_no, count(*) AS occurrences, arg_min(ambiguous, line_no) AS ambiguous FROM c GROUP BY 1, 2, 3""",
    "candidate_finders": f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS v0 FROM d), {_chain}, a AS ({_kinds}), b AS (SELECT *, lower(regexp_replace(raw, '\\s+', '', 'g')) AS label FROM a), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, kind, label ORDER BY line_no, pos) = 1), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no, pos) <= {finders.CAP}) SELECT kind, count(*) AS n, count(DISTINCT label) AS labels FROM c GROUP BY 1",
    "field_proposals": "WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents), s AS (SELECT lower(w) AS name, w, count(*) AS n FROM d WHERE length(w) BETWEEN 4 AND 12 GROUP BY 1, 2), g AS (SELECT name, CAST(sum(n) AS BIGINT) AS documents, arg_max(w, (n, w)) AS spelling FROM s GROUP BY 1) SELECT * FROM g WHERE documents >= 40",
    "snapshot_diff": "WITH o AS (SELECT o_orderkey AS k FROM orders), x AS (SELECT CASE WHEN k % 17 = 0 THEN 'removed' WHEN k % 5 = 0 THEN 'changed' END AS change, CASE WHEN k % 17 = 0 THEN '' WHEN k % 15 = 0 THEN 'o_orderstatus,o_orderpriority' ELSE 'o_orderstatus' END AS fields FROM o UNION ALL SELECT 'added', '' FROM o WHERE k % 100 = 1) SELECT change, fields, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY 1, 2",
    "latest_correction_overlay": "WITH e AS (SELECT user_id, CAST(value AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') SELECT c_custkey, coalesce(v, CAST(c_acctbal AS DECIMAL(18,2))) AS c_acctbal FROM customer LEFT JOIN e ON user_id = c_custkey AND n = 1",
    "counted_result": "WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS tier FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier DESC, ts DESC, event_id DESC) AS n FROM e) SELECT user_id, event_id, tier FROM r WHERE n = 1",
    "doc_counted_fallback": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'measured' ELSE 'labelled' END AS source, quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "upsert_keep_known": "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS s, c_name AS n FROM customer), w AS (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END AS s FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(c.k, w.k) AS c_custkey, coalesce(w.s, c.s) AS segment, n AS name FROM c FULL JOIN w ON c.k = w.k",
    "semi_pending": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "anti_undecided": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "left_join_counts": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "computed_key_join": "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey",
    "union_streams": "SELECT 'order' AS what, strftime(o_orderdate, '%Y') AS year, count(*) AS n, 0 AS users FROM orders GROUP BY 2 UNION ALL SELECT 'event', strftime(ts, '%Y'), count(*), count(user_id) FROM events GROUP BY 2".replace("0 AS users", "CAST(0 AS BIGINT) AS users"),
    "seen_set": "SELECT DISTINCT user_id, event_type FROM events WHERE event_id >= 500 EXCEPT SELECT user_id, event_type FROM events WHERE event_id < 500",
    "ordinal_score": "WITH e AS (SELECT event_id, (event_id * 3) % 11 + 1 AS a, (event_id * 5) % 11 + 1 AS b, (event_id * 7) % 11 + 1 AS c FROM events) SELECT event_id, CAST(CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS INT) AS level, round((a + 2 * b + 3 * c) / (a + b + c), 4) AS expected FROM e",
    "ocr_confidence": "WITH e AS (SELECT user_id, round(avg(value) / 100, 4) AS mean_conf, round(avg(CASE WHEN value < 10 THEN 1 ELSE 0 END), 4) AS low_ratio FROM events GROUP BY 1) SELECT *, mean_conf < 0.2 OR low_ratio > 0.45 AS escalate FROM e",
}

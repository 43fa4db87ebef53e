"""Operators on literal rows: known answers and invariants."""

import random
import unicodedata
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal as D
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import ids, numbers, text
from tallyspark.functions import dates
from tallyspark.operators import datasets, dedupe, evals, evidence, finders, graph, intervals, listquery, pairing, parties, reconcile, relations, rules, worklists
from tallyspark.operators.listquery import Column, Filter, ListQuery, Query, RequestError, Sort

ROWS = [("a", "Öz Kft", "1000.50", "open", "2026-01-02"), ("b", "oz bt", None, "closed", None), ("c", "Zebra", "-5", "open", "2026-01-01"), ("d", "", "1 153", "", "2026-02-01"), ("e", "Óbuda", "abc", "open", "2026-01-03")]
LIST = ListQuery([Column("name"), Column("amount", "Amount", "money"), Column("status", "Status", "enum", {"open": "Nyitott", "closed": "Lezárt"}), Column("day", "Day", "date")], "_key")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "_key string, name string, amount string, status string, day string")


def keys(df):
    return "".join(r["_key"] for r in df.collect())


@pytest.mark.parametrize(
    ("q", "want"),
    [
        (Query(sort=[Sort("amount")]), "cadeb"),
        (Query(sort=[Sort("amount", True)]), "daceb"),
        (Query(sort=[Sort("name")]), "ebacd"),
        (Query(q="OZ"), "ab"),
        (Query(q="nyitott"), "ace"),
        (Query(filters=[Filter("amount", "gte", "1.000")]), "ad"),
        (Query(filters=[Filter("status", "neq", "open")]), "b"),
        (Query(filters=[Filter("day", "empty")]), "b"),
        (Query(filters=[Filter("day", "lte", "2026-01-02")]), "ac"),
        (Query(keys=["e", "a", "x"]), "ae"),
        (Query(group="status", sort=[Sort("day")]), "bcaed"),
        (Query(sort=[Sort("day")], offset=1, limit=2), "ae"),
    ],
)
def test_list_query(rows, q, want):
    assert keys(LIST.page(rows, q)) == want


def test_list_query_refuses(rows):
    for q in (Query(filters=[Filter("nope", "eq", 1)]), Query(limit=0), Query(filters=[Filter("amount", "eq", "28.5")]), Query(filters=[Filter("amount", "like", "1")]), Query(sort=[Sort("day")] * 6)):
        with pytest.raises(RequestError):
            LIST.page(rows, q)


def test_groups_and_facets(rows):
    assert {(r["value"], r["count"]) for r in LIST.groups(rows, Query(group="status")).collect()} == {("open", 3), ("closed", 1), (None, 1)}
    assert {r["value"] for r in LIST.facets(rows).collect()} == {"open", "closed"}
    assert {r["name"] for r in LIST.export(rows, Query(fields=["name"])).collect()} == {r[1] for r in ROWS}


def test_merged_periods_and_spans(spark):
    day = lambda n: date(2026, 1, n)
    p = spark.createDataFrame([(1, day(1), day(5)), (1, day(6), day(8)), (1, day(10), day(12)), (1, day(2), day(3)), (2, day(1), day(1))], "k int, start date, end date")
    got = {tuple(r) for r in intervals.merged(p, ["k"]).collect()}
    assert got == {(1, day(1), day(8)), (1, day(10), day(12)), (2, day(1), day(1))}
    days = spark.createDataFrame([(1, day(n)) for n in (1, 2, 3, 4, 7)], "k int, day date")
    assert {(r["start"], r["days"]) for r in intervals.spans(days, ["k"], "day", 3).collect()} == {(day(1), 3), (day(4), 1), (day(7), 1)}


def test_overlap_truth_table(spark):
    d = lambda m, n: date(2026, m, n)
    cases = [((d(1, 1), d(1, 31)), (d(2, 1), d(2, 28)), False), ((d(1, 1), d(1, 31)), (d(1, 31), d(2, 28)), False), ((d(1, 1), d(1, 31)), (d(1, 30), d(2, 28)), True), ((d(1, 1), d(1, 31)), (d(1, 1), d(1, 31)), True), ((d(1, 5), d(1, 5)), (d(1, 5), d(1, 5)), True)]
    rows = [(n, k, a, b) for n, (x, y, _) in enumerate(cases) for k, (a, b) in ((10, x), (11, y))]
    got = {r["g"] for r in intervals.overlapping(spark.createDataFrame(rows, "g int, id int, start date, end date"), ["g"], "id").collect()}
    assert got == {n for n, c in enumerate(cases) if c[2]}


def test_monthly_shares_known_answer(spark):
    df = spark.createDataFrame([(1, date(2026, 2, 5), date(2026, 3, 4), D("28000.00"))], "id int, start date, end date, amount decimal(18,2)")
    assert [(r["month"], r["share"]) for r in intervals.by_month(df, "start", "end", "amount").collect()] == [("2026-02", D("24000.00")), ("2026-03", D("4000.00"))]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 200), st.integers(-10**6, 10**6)), min_size=1, max_size=8))
def test_monthly_shares_add_up(spark, bills):
    start = date(2024, 1, 1).toordinal()
    rows = [(n, date.fromordinal(start + a), date.fromordinal(start + a + b), D(c) / 100) for n, (a, b, c) in enumerate(bills)]
    df = spark.createDataFrame(rows, "id int, start date, end date, amount decimal(18,2)")
    got = {r["id"]: r["s"] for r in intervals.by_month(df, "start", "end", "amount").groupBy("id").agg(F.sum("share").alias("s")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_as_of_stops_at_an_unfetched_day(spark):
    d = lambda n: date(2026, 1, n)
    rates = spark.createDataFrame([("E", d(1), 1.0), ("E", d(5), 5.0)], "c string, day date, rate double")
    known = spark.createDataFrame([("E", d(n)) for n in (1, 2, 4, 5, 6)], "c string, day date")
    asked = spark.createDataFrame([("E", d(n)) for n in (1, 2, 3, 4, 6, 20)], "c string, day date")
    got = {r["day"].day: r["rate"] for r in intervals.as_of(asked, rates, known, ["c"], "day", "rate", 3).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 6: 5.0, 20: None}


def test_chain_ends_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (6, 5)], "node long, next long")
    assert {tuple(r) for r in intervals.chain_ends(e).collect()} == {(1, 9), (2, 9), (3, 9)}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_like_union_find(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_long_path_and_star(spark):
    n = 300
    path = graph.components(spark.range(n).selectExpr("id a", "id + 1 b"))
    assert path.count() == n + 1 and path.select("root").distinct().count() == 1
    star = graph.components(spark.range(1, n).selectExpr("id a", "0L b").unionByName(spark.createDataFrame([(None, 5), (7, 7)], "a long, b long")))
    assert {r["root"] for r in star.collect()} == {0}


def test_settled_in_order(spark):
    inv = spark.createDataFrame([(1, D(100)), (2, D(50))], "invoice_id long, amount decimal(18,2)")
    lines = spark.createDataFrame([(7, D(120)), (8, D(60))], "line_id long, amount decimal(18,2)")
    a = spark.createDataFrame([(1, 1, 7, D(80)), (2, 1, 7, D(30)), (3, 1, 7, D(20)), (4, 2, 8, D(50))], "seq long, invoice_id long, line_id long, part decimal(18,2)")
    assert {r["seq"]: r["counts"] for r in reconcile.settled(a, inv, lines).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_credit_note_needs_one_invoice(spark):
    d = date(2026, 1, 1)
    inv = spark.createDataFrame([(1, 9, "HUF", D(5), d), (2, 9, "HUF", D(5), d), (3, 8, "HUF", D(5), d), (4, 7, "HUF", D(5), d)], "invoice_id long, partner long, currency string, amount decimal(18,2), issue_date date")
    notes = spark.createDataFrame([(100, 9, "HUF", D(5), d), (101, 8, "HUF", D(5), d), (102, 8, "HUF", D(5), d), (103, 7, "HUF", D(5), d)], "note_id long, partner long, currency string, amount decimal(18,2), issue_date date")
    paid = spark.createDataFrame([(4,)], "invoice_id long")
    assert {tuple(r) for r in reconcile.credited(inv, notes, paid).collect()} == {(3, 101)}


def test_duplicate_kinds(spark):
    rows = [(1, "INV-1", "t", "100", "huf"), (2, "inv 1", "t", "100.00", "HUF"), (3, "INV1", "t", "101", "HUF"), (4, "INV-1", "t", "100", None), (5, "INV-1", "u", "100", "HUF"), (6, "N/A", "t", "1", "HUF")]
    df = spark.createDataFrame(rows, "id long, number string, tax string, total string, currency string")
    got = {(r["a"], r["b"]): (r["kind"], r["differing"], r["missing"]) for r in dedupe.pairs(df, "id", "number", ["tax"], ["total", "currency"]).collect()}
    assert got[1, 2] == ("copy", "", "") and got[1, 3] == ("variant", "total", "") and got[1, 4] == ("undecidable", "", "currency") and got[3, 4] == ("variant", "total", "currency")
    assert not any(5 in k or 6 in k for k in got)
    assert {tuple(r) for r in dedupe.clusters(df, "id", "number", ["tax"]).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_price_known_answer(spark):
    rows = spark.createDataFrame([(1, D(12), D("379000"), D(5)), (1, D(3), D("12500.50"), D(0))], "q int, quantity decimal(10,2), unit_price decimal(18,2), percent decimal(5,2)")
    r = rules.price(rows, "q", "27", "1").first()
    assert (r["net"], r["vat"], r["gross"]) == (D("4358102.00"), D("1176688.00"), D("5534790.00"))


def test_tiers_keep_repeated_lines(spark):
    lines = spark.createDataFrame([("a", D(12)), ("a", D(12)), ("b", D(1))], "c string, quantity decimal(10,2)")
    tiers = spark.createDataFrame([("a", 10, D(5)), ("a", 12, D(7))], "c string, min_quantity int, percent decimal(5,2)")
    assert sorted(r["percent"] for r in rules.tier_percent(lines, tiers, "c", "quantity").collect()) == [D(0), D(7), D(7)]


def test_identifiers(spark):
    cases = ["HU42117730161111101800000000", "HU42117730161111101800000001", "DE89370400440532013000", "11773016-11111018-00000000", "117730161111101800000000", "x", None]
    got = [r[0] for r in spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, v string").orderBy("n").select(ids.account_code(F.col("v"))).collect()]
    assert got == ["iban.ok", "iban.checksum", "iban.ok", "account.hu_domestic", "account.hu_domestic", "account.format", "account.missing"]
    key = [r[0] for r in spark.createDataFrame([("HU42117730161111101800000000",), ("11773016-11111018",), ("xxxx5678",)], "v string").select(ids.account_key(F.col("v"))).collect()]
    assert key == ["117730161111101800000000", "117730161111101800000000", ""]


def test_masks_and_guards(spark):
    rows = [("card 4111 1111 1111 1111.", "card 411111xxxxxx1111."), ("no 4111111111111112", "no 4111111111111112"), ("f" * 8 + "4111111111111111" + "a" * 8, "f" * 8 + "4111111111111111" + "a" * 8), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(text.mask_cards("t")).collect()] == [b for _, b in rows]
    guard = [r[0] for r in spark.createDataFrame([("=1+1",), ("-5",), (" +x",), ("a",)], "t string").select(text.guarded(F.col("t"))).collect()]
    assert guard == ["'=1+1", "-5", "' +x", "a"]


def test_fold_and_fuzzy(spark):
    words = ["ÁRVÍZTŰRŐ", "Čapek", "ΆΛΦΑ", "ﬁn", "Straße", "İstanbul", "ŀlull", "A\u0301b", "Ǆ", "①½", "ШЙ", "plain ASCII", "", "𝐀b", None]
    plain = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
    got = [r[0] for r in spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, w string").orderBy("n").select(text.fold(F.col("w"))).collect()]
    assert got == [plain(w) for w in words] and got[1:5] == ["capek", "αλφα", "fin", "strasse"]
    pairs = [("example", "exampletel", True), ("example", "exampel", True), ("example", "examined", False), ("exampletel", "examp", False), ("abc", "abd", False)]
    got = [r[0] for r in spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(pairs)], "n int, a string, b string").orderBy("n").select(text.fuzzy_word(F.col("a"), F.col("b"))).collect()]
    assert got == [c for *_, c in pairs]


def test_differences_and_upsert(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5), (3, "z", None)], "k int, s string, n int")
    assert {tuple(r) for r in relations.differences(a, b, ["k"], ["s", "n"]).collect()} == {(1, "changed", "n"), (2, "removed", ""), (3, "added", "")}
    assert {tuple(r) for r in relations.upsert(a, b, "k").collect()} == {(1, "x", 5), (2, "y", 2), (3, "z", None)}


def test_budget_refuses_without_using_up(spark):
    calls = spark.createDataFrame([(1, n, D(m), D(c)) for n, (m, c) in enumerate([(6, 6), (5, 5), (4, 1), (3, 3)])], "s int, n int, max_cost decimal(9,2), cost decimal(9,2)")
    got = {r["n"]: r["granted"] for r in evals.replay_budget(calls, "s", ["n"], "10").collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_calibration_is_bounded_and_closes_the_last_bin(spark):
    js = spark.createDataFrame([("f", 1, p, p > 0.5) for p in (0.0, 0.2, 0.95, 1.0)], "flow string, run_no int, p double, correct boolean")
    got = evals.calibration(js, [0.0, 0.5, 0.9, 1.0]).collect()
    assert {r["bin"]: r["n"] for r in got} == {0: 2, 2: 2} and 0 <= sum(r["weighted_gap"] for r in got) <= 1


def test_finders_hide_taken_spans(spark):
    lines = spark.createDataFrame([("d", 0, "Invoice no. 2024/7 of 2024-01-09, 12 kg, 1.200 EUR"), ("d", 1, "again 2024-01-09 from a@b.hu")], "doc string, n int, line string")
    got = {(r["kind"], r["label"]) for r in finders.candidates(lines, "doc", "n", "line").collect()}
    assert {("date", "2024-01-09"), ("email", "a@b.hu"), ("money", "1.200eur"), ("quantity", "12kg")} <= got


def test_unique_prefix(spark):
    rows = spark.createDataFrame([("abc1",), ("abd2",), ("x9",)], "k string")
    got = {r["p"]: r["key"] for r in listquery.unique_prefix(rows, "k", spark.createDataFrame([("ab",), ("abd",), ("q",)], "p string"), "p").collect()}
    assert got == {"ab": None, "abd": "abd2", "q": None}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("0123456789., -HUFűÁ\x00 –", max_size=14), min_size=1, max_size=20))
def test_number_reader_never_raises(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert df.select(numbers.read_number(F.col("r")), numbers.read_input(F.col("r"))).count() == len(raws)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_fold_like_unicode_data(spark, raws):
    raws = [r.encode("utf-8", "ignore").decode() for r in raws]
    hangul = lambda s: any(0xAC00 <= ord(c) <= 0xD7A3 or ord(c) >= 0x20000 or ord(c) < 0x20 for c in s)  # noqa: E731 - stay whole
    raws = [r for r in raws if not hangul(r)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(raws)), "n int, w string").orderBy("n").select(text.fold(F.col("w"))).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKD", r.casefold()) if not unicodedata.combining(c)) for r in raws]


def fuzzy(word, other):
    if other.startswith(word) or (len(other) >= max(5, 0.6 * len(word)) and word.startswith(other)):
        return True
    return min(len(word), len(other)) >= 5 and abs(len(word) - len(other)) <= 2 and SequenceMatcher(None, word, other).ratio() >= 0.85


def test_fuzzy_pairs_lose_nothing(spark):
    rng, words = random.Random(5), ["abcdef", "abxcdyef", "abxcdef", "abcdyef"]
    for _ in range(60):
        w = "".join(rng.choice("abcdefg") for _ in range(rng.randint(4, 16)))
        words.append(w)
        for _ in range(5):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], [rng.choice("abcdefg")], [x[k], rng.choice("abcdefg")]]) if len(x) > 3 else [x[k]]
            words += ["".join(x), w[: rng.randint(3, len(w))] if len(w) > 3 else w]
    words = sorted(set(words))
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    got = {tuple(r) for r in relations.fuzzy_pairs(df, df, "w").collect()}
    assert got == {(a, b) for a in words for b in words if a != b and fuzzy(a, b)}


def test_signals_like_brute_force(spark):
    from tallyspark.plans import pairing as plan

    sf = "/root/testdata/sf0.001"
    rates, common = plan._rates(spark), reconcile.common_words(spark.read.parquet(f"{sf}/part.parquet"), "p_type", 3)
    rows = pairing.relations(plan.signal_rows(spark, sf), rates)
    learned = reconcile.learned_names(rows.where("invoice_id % 6 = 2").select(F.col("counterparty_name").alias("name"), "partner"), 1)
    rules = pairing.Signals(prefix_share=0.6)
    ties = pairing.name_ties(rows, rows.select(pairing.line_name().alias("line_name")), ["the", "and"], common, rules)
    got = {r["line_id"]: (set(r["signals"]), r["strength"]) for r in pairing.signals(rows, ties, learned, rules).collect()}
    stop, known = {r["word"] for r in common.collect()}, {(r["name_key"], r["partner"]) for r in learned.collect()}
    norm = lambda x: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").lower()).split())
    key = lambda x: " ".join(w for w in norm(x).split() if len(w) > 1 and not any(c.isdigit() for c in w))
    stands = lambda n, t: len(norm(n).replace(" ", "")) >= 4 and (f" {norm(n)} " in f" {norm(t)} " or (len(norm(n).replace(" ", "")) >= 6 and norm(n).replace(" ", "") in norm(t).replace(" ", "")))
    weights = dict(pairing.Signals().weights)
    seen = set()
    for r in rows.collect():
        told, want = f"{r['memo']} {r['description']}", set()
        words = [w for w in dict.fromkeys(norm(r["supplier_name"]).split()) if w not in ("the", "and")]
        theirs = norm(r["counterparty_name"] if r["counterparty_name"] is not None else r["description"]).split()
        long = lambda x, least=5: [w for w in x if len(w) >= least and not any(c.isdigit() for c in w)]
        if stands(r["number"], told):
            want.add("invoice_number")
        if any(stands(x, told) for x in r["references"] or []):
            want.add("reference")
        if words and len(set(words) & set(theirs)) / len(words) >= 0.75:
            want.add("supplier_name")
        elif any((x != y and fuzzy(x, y)) or (x == y and x == (long(words) or [None])[0]) for x in long(words) if x not in stop for y in long(theirs, 4) if y not in stop):
            want.add("supplier_name_fuzzy")
        if "card" in norm(r["payment_method"]) and "applepay" in norm(f"{r['counterparty_name']} {r['description']} {r['memo']}"):
            want.add("payment_channel")
        if (key(r["counterparty_name"]), r["partner"]) in known:
            want.add("learned_name")
        in_time = r["issue_date"] <= r["booking_date"] <= max(r["due_date"], r["issue_date"]) + timedelta(7)
        strength = min(100, sum(weights[s] for s in want) + {"equal": 35, "fx_within": 25, "different": 0}.get(r["relation"], 5) + (15 if in_time else 5))
        assert got[r["line_id"]] == (want, strength), r
        seen |= want
    assert seen == {"invoice_number", "reference", "supplier_name", "supplier_name_fuzzy", "payment_channel", "learned_name"}


def test_components_of_stars_and_paths(spark):
    rng, edges = random.Random(3), []
    edges += [(n, 1000) for n in range(50)]  # a star whose middle is the greatest
    path = rng.sample(range(300), 300)
    edges += [(2000 + a, 2000 + b) for a, b in zip(path, path[1:], strict=False)]
    edges += [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(70)] + [(7, 7), (9001, 9000)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {k: root(k) for k in parent}


def test_covered_nearest_and_preselect_like_brute_force(spark):
    rng, d0 = random.Random(4), date(2024, 1, 1)
    day = lambda n: d0 + timedelta(n)
    periods, wanted = [], []
    for k in range(4):
        at = 0
        for _ in range(6):
            at += rng.randint(2, 9)
            periods.append((k, day(at), day(at := at + rng.randint(0, 9))))
        wanted += [(k, k * 100 + n, day(s := rng.randint(-5, 80)), day(s + rng.randint(0, 12))) for n in range(40)]
    wanted.append((9, 900, day(1), day(2)))
    got = {r["i"]: r["covered"] for r in intervals.covered(spark.createDataFrame(wanted, "k int, i int, start date, end date"), spark.createDataFrame(periods, "k int, start date, end date"), ["k"], "i").collect()}
    for k, i, s, e in wanted:
        mine = [(a, b) for kk, a, b in periods if kk == k]
        assert got[i] == ("full" if any(a <= s and e <= b for a, b in mine) else "partial" if any(a <= e and s <= b for a, b in mine) else "none")
    lines = [(n, rng.randrange(5), day(rng.randrange(60)), D(rng.randrange(0, 400))) for n in range(80)]
    inv = [(n, rng.randrange(4), day(rng.randrange(60)), day(rng.randrange(60)) if n % 3 else None, D(rng.randrange(0, 400))) for n in range(80)]
    a = spark.createDataFrame(lines, "line_id long, p int, booking_date date, amount decimal(18,2)")
    b = spark.createDataFrame(inv, "invoice_id long, p int, issue_date date, due_date date, amount decimal(18,2)")
    got = {r["line_id"]: r["invoice_id"] for r in reconcile.nearest_anchor(a, b, ["p"]).collect()}
    want = {n: min(((abs((d - (due or iss)).days), i) for i, q, iss, due, _ in inv if q == p), default=(0, None))[1] for n, p, d, _ in lines}
    assert got == {n: i for n, i in want.items() if i is not None}
    got = {(r["line_id"], r["rank"]): r["invoice_id"] for r in reconcile.preselect(b.withColumnRenamed("p", "partner"), a.withColumnRenamed("p", "account")).collect()}
    want = {}
    for n, p, _, x in lines:
        near = sorted((round(abs(x - w) / w, 6), iss, i) for i, q, iss, _, w in inv if q == p and w > 0 and x > 0 and abs(x - w) <= w * D("0.10"))
        want |= {(n, k + 1): i for k, (*_, i) in enumerate(near[:3])}
    assert got == want


def test_inheritance_of_any_depth(spark):
    units = spark.createDataFrame([(n, n - 1 if n else None) for n in range(9)], "unit_id int, parent_id int")
    facts = spark.createDataFrame([(0, "a", "top"), (5, "a", "own"), (2, "b", "x")], "unit_id int, name string, value string")
    got = {(r["unit_id"], r["name"]): r["value"] for r in rules.inherited(units, facts).collect()}
    assert got == {(n, "a"): "own" if n >= 5 else "top" for n in range(9)} | {(n, "b"): "x" for n in range(2, 9)}
    with pytest.raises(ValueError, match="cycle"):
        rules.inherited(spark.createDataFrame([(1, 2), (2, 1)], "unit_id int, parent_id int"), facts)


def test_registry_refuses_incomplete_scopes(spark):
    found = datasets.Registry()
    found.add(datasets.Dataset("t", lambda spark, _: spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), required=("a",), optional=("b",)))
    found.add(datasets.Dataset("u", lambda spark, _: spark.range(3), one_of=("id", "other")))
    assert found.rows(spark, "", "t", a=1).count() == 1 and found.rows(spark, "", "t", a=[1, 2], b="y").count() == 1 and found.rows(spark, "", "u", id=2).count() == 1
    for name, scope in (("v", {}), ("t", {}), ("t", {"a": 1, "c": 2}), ("u", {}), ("u", {"id": 1, "other": 2})):
        with pytest.raises(ValueError):
            found.rows(spark, "", name, **scope)
    with pytest.raises(ValueError, match="already"):
        found.add(found.datasets["t"])


def test_dates_in_text_by_order_and_language(spark):
    lines = [("a", 0, "from 13/02/2024 to 03/04/2024"), ("b", 0, "02/25/2024 and 03/04/2024"), ("c", 0, "03/04/2024"), ("d", 0, "13/02/2024, 02/25/2024, 03/04/2024"), ("e", 0, "26.06.24 and 2024. május 3. and 5 de marzo de 2024, March 7th, 2024; 1er août 2023 and 99.99.2024")]
    df = spark.createDataFrame(lines, "doc string, n int, line string")
    got = defaultdict(list)
    for r in finders.date_candidates(df, "doc", "n", "line").orderBy("doc", "at").collect():
        got[r["doc"]].append((r["value"].isoformat(), r["ambiguous"]))
    assert got["a"] == [("2024-02-13", False), ("2024-04-03", False)] and got["b"] == [("2024-02-25", False), ("2024-03-04", False)]
    assert got["c"] == [("2024-04-03", True)] and got["d"][2] == ("2024-04-03", True)
    assert [v for v, _ in got["e"]] == ["2024-06-26", "2024-05-03", "2024-03-05", "2024-03-07", "2023-08-01"]


def test_quotations(spark):
    page = "The quick brown fox jumps over the lazy dog, and then it sleeps under a large oak tree."
    quotes = {"quick brown": "printed", "quick bro- wn fox": "joined", "quick brown ... lazy dog": "omitted", "lazy dog ... quick brown": "absent", "The qu1ck brovvn fox jumps ovcr the lazv dog": "rough", "nothing of this kind is there": "absent"}
    df = spark.createDataFrame([("p", q) for q in quotes], "k string, quote string")
    got = {r["quote"]: r["found"] for r in finders.rough_quotes(df, spark.createDataFrame([("p", page)], "k string, page string"), ["k"]).collect()}
    assert got == quotes


def test_marks_and_versions(spark):
    lines = spark.createDataFrame([(1, "p", "rent"), (2, "p", "rent"), (3, "p", "tax"), (4, "p", None), (5, "q", "tax")], "line_id long, key string, category string")
    assert dict(map(tuple, parties.marks(lines).collect())) == {1: "rent:1,tax:1", 2: "rent:1,tax:1", 3: "rent:2", 4: "rent:2,tax:1", 5: ""}
    files = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x")], "path string, at int, content string")
    assert [(r["version"], r["since"]) for r in worklists.versions(files).orderBy("version").collect()] == [(1, 1), (2, 3), (3, 4)]


def test_tasks_merge_like_brute_force(spark):
    rng = random.Random(9)
    rows = [(m, m * 100 + n, rng.choice("xy"), "d", rng.choice("pq"), f" T{rng.randrange(4)}", f"q{rng.randrange(6)}") for m in range(12) for n in range(15)]
    got = {(r["mail_id"], r["task_id"]): (r["merged"], r["quotes"]) for r in evidence.merged_tasks(spark.createDataFrame(rows, "mail_id int, task_id int, action string, deadline string, assignee string, title string, quote string")).collect()}
    want = {}
    for m in range(12):
        kept = []
        for _, i, a, d, p, t, q in sorted(r for r in rows if r[0] == m):
            for k in kept:
                if k["key"] == (a, d, p) and (t.strip().casefold() in k["t"] or q in k["q"]):
                    k["t"].add(t.strip().casefold())
                    k["q"].add(q)
                    k["n"] += 1
                    break
            else:
                kept.append({"id": i, "key": (a, d, p), "t": {t.strip().casefold()}, "q": {q}, "n": 1})
        want |= {(m, k["id"]): (k["n"], len(k["q"])) for k in kept}
    assert got == want


def test_short_dates_and_dates_by_name(spark):
    got = spark.sql("select '5. März 2024' as a, 'juin 3, 2024' as b, '12/12/24' as c, '5 foo 2024' as d").select(*[dates.read_date(F.col(c))["value"].alias(c) for c in "abcd"]).first()
    assert tuple(got) == (date(2024, 3, 5), date(2024, 6, 3), date(2024, 12, 12), None)


def test_sample_is_of_the_right_sizes_and_the_same_each_time(spark):
    from tallyspark.plans import records as plan

    sf = "/root/testdata/sf0.01"
    a, b = ({(r["doc_id"], r["lang"]) for r in plan.stratified_sample(spark, sf).collect()} for _ in range(2))
    docs = spark.read.parquet(f"{sf}/documents.parquet").groupBy("lang").count().collect()
    total = sum(r["count"] for r in docs)
    assert a == b and {r["lang"]: sum(x[1] == r["lang"] for x in a) for r in docs} == {r["lang"]: min(r["count"], max(2, round(100 * r["count"] / total))) for r in docs}


def test_proposals_leave_out_what_is_rejected_or_paid_in_part(spark):
    day = date(2024, 5, 1)
    invoice = "invoice_id long, number string, references array<string>, partner long, supplier_name string, side string, invoice_currency string, invoice_amount decimal(18,2), issue_date date, due_date date, fulfillment_date date, payment_method string, touched boolean"
    line = "line_id long, memo string, description string, counterparty_name string, account long, direction string, currency string, amount decimal(18,2), statement_type string, original_currency string, original_amount decimal(18,2), booking_date date, touched boolean"
    inv = lambda n, cur, amount, touched=False, name="Alma Kft": (n, f"N/{n:06}", None, n, name, "incoming", cur, D(amount), day, day, None, None, touched)
    pay = lambda n, memo, amount, kind="card", name=None, at=2: (n, memo, "bank", name, None, "debit", "HUF", D(amount), kind, None, None, day + timedelta(at), False)
    invoices = spark.createDataFrame([inv(1, "HUF", 100), inv(2, "EUR", 10), inv(3, "EUR", 10, True), inv(4, "HUF", 55, name=None)], invoice)
    lines = spark.createDataFrame([pay(11, "n000001", 70), pay(12, "N 000002 and N/000003", 4000), pay(13, "x", 55), pay(14, "x", 100, name="alma"), pay(15, "N/000001", 100, at=-25), pay(16, "x", 100, at=-5), pay(17, "N/000001", 100)], line)
    rates, learned = spark.createDataFrame([("EUR", day, 400.0)], "currency string, day date, rate double"), spark.createDataFrame([], "name_key string, partner long")
    rejected = spark.createDataFrame([(17, 1)], "line_id long, invoice_id long")
    got = {(r["line_id"], r["invoice_id"]): (r["relation"], ",".join(r["signals"]), r["proposed"], r["amount_only"]) for r in pairing.proposed(invoices, lines, learned, rates, ["kft"], rejected, rule=reconcile.Rules(days_before_issue=31)).collect()}
    assert got == {
        (11, 1): ("different", "invoice_number", False, False), (12, 2): ("fx_within", "invoice_number", True, False), (13, 4): ("equal", "", False, True), (14, 1): ("equal", "supplier_name", True, False),
        (15, 1): ("equal", "invoice_number", True, False), (16, 1): ("equal", "", False, True), (14, 2): ("fx_outside", "supplier_name", False, False),
    }

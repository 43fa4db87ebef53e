"""Samples, nested masking, free names, replaced statements and values on lines: the rules one row at a time."""

import os
import random
import re
from collections import Counter, defaultdict
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import evidence, records, relations


def test_sample_never_exceeds_its_size(spark):
    groups = spark.createDataFrame([(k, f"g{k % 7}") for k in range(70)], "k long, g string")
    assert relations.stratified_sample(groups, "g", "k", 3).count() == 3
    halves = spark.createDataFrame([(k, "a" if k < 25 else "b") for k in range(40)], "k long, g string")  # 2.5 and 1.5 of 4
    assert Counter(r["g"] for r in relations.stratified_sample(halves, "g", "k", 4).collect()) == {"a": 2, "b": 2}
    assert relations.stratified_sample(groups.limit(0), "g", "k", 3).count() == 0


CARD = "4111111111111111"


def test_nested_masking_touches_texts_only(spark):
    rows = [(1, int(CARD), [f"card {CARD}, again 4111-1111-1111-1111!", None], {CARD: {"v": CARD, "n": int(CARD)}}), (2, None, None, None)]
    df = spark.createDataFrame([(r[0], tuple(r[1:])) for r in rows], "id int, x struct<n: bigint, t: array<string>, m: map<string, struct<v: string, n: bigint>>>")
    a, b = records.mask_nested(df, "x").orderBy("id").collect()
    assert a["x"]["n"] == int(CARD) and a["x"]["t"] == ["card 411111xxxxxx1111, again 411111xxxxxx1111!", None]
    assert a["x"]["m"][CARD].asDict() == {"v": "411111xxxxxx1111", "n": int(CARD)}
    assert tuple(b["x"]) == (None, None, None)


def test_masking_in_functions_is_the_other_s(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice([CARD, CARD[:-1], "3782 822463 10005", "5555555555554444", "a", " ", "-", "12", "f" * 33, "x4", ".", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.mask_cards(F.col("t")).alias("a"), text.masked(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in got] == [r["a"] for r in got] and any(r["a"] != r["t"] for r in got)


def named(rows):
    """Each row in the order of its key takes the first free name."""
    used, out = set(), {}
    for folder, name, key in sorted(rows, key=lambda r: r[2]):
        stem, ext = os.path.splitext(name)
        free, n = name, 2
        while (folder, free.casefold()) in used:
            free, n = f"{stem}__{n}{ext}", n + 1
        used.add((folder, free.casefold()))
        out[key] = free
    return out


def test_names_are_those_of_one_pass(spark):
    rng = random.Random(5)
    rows = [("f", n, k) for k, n in enumerate(["a.pdf", "A.pdf", "a__2.pdf"])] + [("g", n, 10 + k) for k, n in enumerate(["a__2.pdf", "a.pdf", "a.pdf", "a__2__2.pdf", "a__2.pdf", ".pdf", ".PDF", "x", "x", "straße.txt", "STRASSE.txt", "..", ".."])]
    rows += [("h", n, 100 + k) for k, n in enumerate([f"b__{n}.pdf" for n in range(2, 40)] + ["b.pdf"] * 6)]
    key = 1000
    for folder in range(25):
        for _ in range(rng.randint(1, 30)):
            rows.append((f"r{folder}", rng.choice(["c", "C", "d"]) + rng.choice(["", "", "", "__2", "__3", "__4", "__2__2", "__02", "__1"]) + rng.choice([".txt", ".txt", ""]), key))
            key += 1
    rng.shuffle(rows)
    got = relations.unique_names(spark.createDataFrame(rows, "folder string, name string, key long"), "folder", "name", "key").collect()
    assert {r["key"]: r["unique_name"] for r in got} == named(rows) and len(got) == len(rows)


def statements(spark, rows):
    return spark.createDataFrame(rows, "statement string, account string, currency string, start date, end date, rank int, seq int, suspicious boolean, trusted boolean")


def solved(rows, choices, lines):
    """The rule, pair by pair, and a walk through the winners with a stack."""
    of = {r[0]: r for r in rows}
    per = defaultdict(Counter)
    for st, _, _, day, amount in lines:
        per[st][day, amount] += 1
    beaten, undecided = defaultdict(list), []
    for a in sorted(of):
        for b in sorted(of):
            x, y = of[a], of[b]
            if a >= b or x[1:3] != y[1:3]:
                continue
            (s1, e1), (s2, e2) = sorted(((x[3], x[4]), (y[3], y[4])))
            if s2 > e1 or (s2 == e1 and s1 < s2 and e2 > e1):
                continue
            kept = {(min(p), max(p)): k for *p, k, _ in sorted(choices, key=lambda c: c[3]) if k in p}.get((a, b))
            if kept:
                beaten[b if kept == a else a].append((kept, "person"))
                continue
            if x[5] == y[5] and x[3:5] == y[3:5] and per[a] == per[b]:
                late, early = (x, y) if (x[6], x[0]) > (y[6], y[0]) else (y, x)
                if late[7]:
                    late, early = early, late
                if not late[7]:
                    beaten[early[0]].append((late[0], "reread"))
                    continue
            good, bad = (x, y) if x[5] < y[5] else (y, x)
            if x[5] != y[5] and good[3] <= bad[3] and good[4] >= bad[4] and not good[7] and (not per[bad[0]] - per[good[0]] or good[8]):
                beaten[bad[0]].append((good[0], "rule"))
            else:
                undecided.append((a, b))

    def end(node, path):
        for winner, how in sorted(beaten[node], key=lambda w: (w[1] != "person", of[w[0]][5], w[0])):
            if winner in path:
                continue
            if winner not in beaten:
                return winner, how
            if (found := end(winner, [*path, winner])) is not None:
                return found[0], how
        return None

    stands = {s: found for s in list(beaten) if (found := end(s, [s]))}
    return stands, {p for p in undecided if p[0] not in stands and p[1] not in stands}


def test_a_part_of_a_statement_is_not_replaced(spark):
    rows = [("a", "x", "HUF", date(2024, 1, 1), date(2024, 1, 31), 1, 1, False, False), ("b", "x", "HUF", date(2024, 1, 20), date(2024, 2, 10), 0, 1, False, False)]
    got = records.resolved(statements(spark, rows), spark.createDataFrame([], "a string, b string, kept string, seq int"), spark.createDataFrame([], "statement string, id string, text string, day date, amount int"), ["day", "amount"])
    assert got.replaced.count() == 0 and [tuple(r) for r in got.conflicts.collect()] == [("a", "b")] and got.orphans.count() == 0


def test_replaced_statements_are_those_of_the_rule(spark):
    rng = random.Random(8)
    rows, lines, choices = [], [], []
    for account in range(12):
        names = [f"s{account}_{n}" for n in range(7)]
        for name in names:
            start = date(2024, 1, 1) + timedelta(rng.choice([0, 0, 0, 5, 10, 20]))
            rows.append((name, f"acc{account}", "HUF", start, start + timedelta(rng.choice([5, 10, 10, 30])), rng.randrange(3), rng.randrange(3), rng.random() < 0.15, rng.random() < 0.3))
            lines += [(name, f"{name}/{day}", "t", day, day % 4) for day in range(30) if rng.random() < 0.9 and rows[-1][3] <= date(2024, 1, 1) + timedelta(day) <= rows[-1][4]]
        for _ in range(6):
            a, b = rng.sample(names, 2)
            choices.append((a, b, rng.choice([a, b, "other"]), len(choices)))
    got = records.resolved(statements(spark, rows), spark.createDataFrame(choices, "a string, b string, kept string, seq int"), spark.createDataFrame(lines, "statement string, id string, text string, day int, amount int"), ["day", "amount"])
    stands, conflicts = solved(rows, choices, lines)
    assert {r["statement"]: (r["stands"], r["how"]) for r in got.replaced.collect()} == stands and len(stands) > 20
    assert {tuple(r) for r in got.conflicts.collect()} == conflicts and conflicts
    on = {(st, day): i for st, i, _, day, _ in lines}
    want = {(i, on.get((stands[st][0], day))) for st, i, _, day, _ in lines if st in stands}
    assert {(r["old_id"], r["new_id"]) for r in got.line_map.collect()} == {w for w in want if w[1]}
    assert {r["line_id"] for r in got.orphans.collect()} == {a for a, b in want if b is None}


def test_a_circle_has_its_way_out(spark):
    day = (date(2024, 1, 1), date(2024, 1, 31))
    rows = [(s, "x", "HUF", *day, 1, 1, False, False) for s in "abcd"]
    choices = [("a", "b", "b", 1), ("b", "c", "c", 1), ("c", "a", "a", 1), ("c", "d", "d", 1), ("a", "d", "d", 0), ("b", "d", "d", 0)]
    lines = spark.createDataFrame([("a", "1", "t", 1)], "statement string, id string, text string, day int")
    got = records.resolved(statements(spark, rows), spark.createDataFrame(choices[:4], "a string, b string, kept string, seq int"), lines, ["day"])
    assert {r["statement"]: r["stands"] for r in got.replaced.collect()} == {"a": "d", "b": "d", "c": "d"}
    alone = records.resolved(statements(spark, rows[:3]), spark.createDataFrame(choices[:3], "a string, b string, kept string, seq int"), lines, ["day"])
    assert alone.replaced.count() == 0  # a circle without a way out


def test_values_of_any_length_are_found(spark):
    value = "one two, three - four five six seven"
    lines = [(1, 0, f"so {value.upper()}! and on"), (1, 1, "one twothree fourfive six seven eight"), (1, 2, "and one two three"), (1, 3, "four five six seven"), (2, 0, "--"), (3, 0, "")]
    df = spark.createDataFrame(lines, "doc int, line_no int, line string")
    values = spark.createDataFrame([(1, value), (1, "--"), (2, "x"), (3, None)], "doc int, value string")
    got = {tuple(r) for r in evidence.value_locations(df, values, "doc", "line_no", "line").collect()}
    assert got == {(1, value, 0, 1, 8), (1, value, 1, 0, 5)}
    assert {tuple(r) for r in records.wrapped_locations(df, values, "doc", "line_no", "line").collect()} == {(1, value, 2, 3, 4)}


def test_values_on_lines_by_plain_search(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "ab", "-", "B.", "a,b", "é"])
    lines = [(d, n, " ".join(word() for _ in range(rng.randint(0, 9)))) for d in range(12) for n in range(5)]
    values = [(d, " ".join(word() for _ in range(rng.randint(1, 4)))) for d in range(12) for _ in range(4)]
    bare = lambda x: re.sub(r"[^\w]", "", x).lower()
    want = set()
    for d, value in values:
        for e, n, line in lines:
            w = [bare(x) for x in line.split()]
            want |= {(d, value, n, i, j - i) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if d == e and bare(value) and w[i] and w[j - 1] and "".join(w[i:j]) == bare(value)}
    got = evidence.value_locations(spark.createDataFrame(lines, "doc int, line_no int, line string"), spark.createDataFrame(values, "doc int, value string"), "doc", "line_no", "line")
    assert {tuple(r) for r in got.collect()} == want


def walked(a, b, path="$"):
    if isinstance(a, dict) and isinstance(b, dict):
        for k in a.keys() | b.keys():
            yield from walked(a.get(k), b.get(k), f"{path}.{k}")
    elif isinstance(a, list) and isinstance(b, list):
        for k in range(max(len(a), len(b))):
            yield from walked(a[k] if k < len(a) else None, b[k] if k < len(b) else None, f"{path}[{k}]")
    elif a != b or type(a) is not type(b):
        yield path


def test_paths_at_which_values_differ(spark):
    import json

    rng = random.Random(4)

    def value(depth=3):
        kinds = [lambda: rng.randrange(3), lambda: rng.choice("ab"), lambda: rng.choice([True, None, 1.5, 2.0, "1", 1])]
        if depth:
            kinds += [lambda: {k: value(depth - 1) for k in rng.sample("xyz", rng.randint(0, 3))}, lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))]]
        return rng.choice(kinds)()

    pairs = [(a, b if rng.random() < 0.3 else json.loads(json.dumps(a).replace("1", rng.choice(["2", "1"])))) for a, b in ((value(), value()) for _ in range(250))] + [(None, {"a": 1}), ({}, []), ({}, {}), ([], [None])]
    df = spark.createDataFrame([(n, json.dumps(a), json.dumps(b)) for n, (a, b) in enumerate(pairs)] + [(9000, None, None), (9001, None, '{"a": 1}')], "id int, old string, new string")
    got = {(r["id"], r["path"]) for r in records.deep_diff(df, ["id"], "old", "new").collect()}
    want = {(n, p) for n, (a, b) in enumerate(pairs) for p in walked(a, b)} | {(9001, "$")}
    assert got == want
    assert max(Counter(r["id"] for r in records.deep_diff(df, ["id"], "old", "new", 2).collect()).values()) == 2


def test_timers_fire_once_also_after_a_restart(spark, tmp_path):
    from tallyspark.streaming import timers

    rng = random.Random(6)
    rows = [(rng.randrange(9), 1_700_000_000 + rng.randrange(40_000), rng.choice(["arm", "arm", "cancel", "none"]), rng.randrange(60, 6000), n) for n in range(600)]
    schema = "case int, at timestamp, what string, delay_s int, n long"
    df = spark.createDataFrame(rows, "case int, at_s long, what string, delay_s int, n long").select("case", F.timestamp_seconds("at_s").alias("at"), "what", "delay_s", "n")
    src, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "seen")
    edges = [1_700_000_000, 1_700_013_000, 1_700_027_000, 1_700_050_000]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.rocks(spark)
    try:
        for lo, hi in zip(edges, edges[1:], strict=False):  # each part comes later, and meets the state of a query that has ended
            df.where(F.unix_seconds("at").between(lo, hi - 1)).repartition(2).write.mode("append").parquet(src)
            fired = timers.fired_timers(spark.readStream.schema(schema).parquet(src), "1 minute")
            fired.writeStream.option("checkpointLocation", seen).trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = Counter(tuple(r) for r in spark.read.parquet(out).collect())
    last = df.agg(F.max("at") - F.expr("interval 1 minute")).first()[0]
    want = Counter(tuple(r) for r in timers.fired_of_table(df, F.lit(last)).collect())
    assert (got - want, want - got) == (Counter(), Counter()) and len(got) > 30


def test_values_are_found_by_what_words_read_as(spark):
    rows = [(1, 0, "sum 1 234,56 EUR (1.234,56); 1,234.56 and 1234.560"), (1, 1, "12 1 234,56"), (1, 2, "no 11 234,56 nor 1 234,567"), (2, 0, "on 5 March 2024, or 2024.03.05. or 05/03/2024"), (3, 0, "1.234"), (4, 0, ""), (4, 1, "-5 5-")]
    lines = spark.createDataFrame(rows, "doc int, line_no int, line string")
    values = spark.createDataFrame([(1, "1234.56", "money"), (2, "2024-03-05", "day"), (3, "1234", "money"), (3, "1.234", "money"), (4, "-5", "money"), (4, None, "money"), (4, "x", "day")], "doc int, value string, kind string")
    got = {tuple(r) for r in evidence.read_locations(lines, values, "doc", "line_no", "line").collect()}
    assert got == {
        (1, "1234.56", 0, 1, 2), (1, "1234.56", 0, 4, 1), (1, "1234.56", 0, 5, 1), (1, "1234.56", 0, 7, 1), (1, "1234.56", 1, 1, 2),
        (2, "2024-03-05", 0, 1, 3), (2, "2024-03-05", 0, 5, 1), (2, "2024-03-05", 0, 7, 1), (3, "1234", 0, 0, 1), (3, "1.234", 0, 0, 1), (4, "-5", 1, 0, 1), (4, "-5", 1, 1, 1),
    }


def edits_by_rows(quote, page):
    """The fewest edits of a quotation within a page, row by row."""
    before = list(range(len(quote) + 1))
    best = before[-1]
    for c in page:
        row = [0]
        for k, x in enumerate(quote):
            row.append(min(before[k] + (x != c), before[k + 1] + 1, row[k] + 1))
        before, best = row, min(best, row[-1])
    return best


def test_rough_quotations_are_all_found(spark):
    from tallyspark.operators import quotations

    rng = random.Random(7)
    assert all(quotations.fewest_edits(q, p, 99) == edits_by_rows(q, p) for q, p in (("".join(rng.choice("abc") for _ in range(rng.randint(1, 10))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))) for _ in range(300)))
    letters = "etaoinshrdlu"
    pages = [(n, f"g{n % 3}", "".join(rng.choice(letters + " .") for _ in range(rng.randint(30, 200)))) for n in range(45)] + [(100, "g0", None), (101, "g1", ""), (102, "g2", "a" * 80), (103, None, "x" * 50)]
    quotes = []
    for n in range(90):
        _, group, page = pages[rng.randrange(45)]
        at, size = rng.randrange(len(page)), rng.randint(10, 60)
        part = list(page[at : at + size])
        for _ in range(rng.randint(0, max(1, len(part) // 5))):  # some within the share, some beyond
            k = rng.randrange(len(part) + 1)
            part[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
        quotes.append((n, group if rng.random() < 0.8 else "g1", "".join(part)))
    quotes += [(200, "g2", "a" * 20 + "b" + "a" * 20), (201, "g0", None), (202, "g0", "short")]
    bare = lambda x: re.sub(r"[\W_]", "", x or "").lower()
    for share in (0.85, 0.8):
        want = {}
        for n, group, quote in quotes:
            q = bare(quote)
            for page, other, body in pages:
                if len(q) >= quotations.SHORTEST and other == group and (e := edits_by_rows(q, bare(body))) <= int((1 - share + 1e-9) * len(q)):
                    want[n, page] = e
        df, over = spark.createDataFrame(quotes, "quote_id int, source string, quote string"), spark.createDataFrame(pages, "page_id int, source string, page string")
        got = {(r["quote_id"], r["page_id"]): r["edits"] for r in quotations.rough_quotes(df, over, "source", share).collect()}
        assert got == want and len([e for e in want.values() if e]) > 15

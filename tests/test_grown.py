"""What larger tables showed: each test holds a rule that small ones did not touch."""

import itertools
import random
from datetime import date, timedelta
from decimal import Decimal as D
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evidence, finders, reconcile, records, relations
from tallyspark.plans import texts
from tallyspark.sources import tabular
from tests.compare import connect, same


def test_settled_contracts_only_what_meets_others(spark, monkeypatch):
    rng, rows, room, want = random.Random(4), [], {}, {}
    ends = [(k, k + 1000) for k in range(60)] + [(100 + rng.randrange(6), 2000 + rng.randrange(6)) for _ in range(30)]
    for seq in range(300):
        i, j = rng.choice(ends)
        rows.append((seq, i, j, D(rng.randrange(1, 60))))
    for seq, i, j, part in rows:
        a, b = room.get(i, D(100)), room.get(j, D(90))
        want[seq] = part <= a and part <= b
        if want[seq]:
            room[i], room[j] = a - part, b - part
    contracted, components = [], reconcile.components
    monkeypatch.setattr(reconcile, "components", lambda edges: contracted.extend(edges.collect()) or components(edges))
    got = reconcile.settled(
        spark.createDataFrame(rng.sample(rows, len(rows)), "seq long, invoice_id long, line_id long, part decimal(18,2)"),
        spark.createDataFrame([(i, D(100)) for i in {r[1] for r in rows}], "invoice_id long, amount decimal(18,2)"),
        spark.createDataFrame([(j, D(90)) for j in {r[2] for r in rows}], "line_id long, amount decimal(18,2)"),
    )
    assert {r["seq"]: r["counts"] for r in got.collect()} == want and len(set(want.values())) == 2
    assert contracted and all(int(r["a"][1:]) >= 100 for r in contracted)


def test_orders_that_come_have_keys_of_their_own(spark, tmp_path):
    keys = [1, 101, 1_000_001, 1_000_101, 5, 34]
    spark.createDataFrame([(k, "O", 1.5, "1-URGENT") for k in keys], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["change"], r["fields"]): r["n"] for r in texts.snapshot_diff(spark, str(tmp_path)).collect()}
    assert got == {("added", ""): 4, ("changed", "o_orderstatus"): 1, ("removed", ""): 1}


def test_csv_of_a_large_task_is_several_files(spark, tmp_path):
    rows = spark.range(250_000).coalesce(1).selectExpr("id", "concat('=', id) AS t")
    tabular.write_csv(rows, f"file://{tmp_path}/a")
    got = tabular.records(tabular.blocks(tabular.accepted(tabular.read_tables(spark, f"file://{tmp_path}/a")), ["id", "t"])).selectExpr("CAST(fields['id'] AS BIGINT) AS id", "fields['t'] AS t")
    assert got.selectExpr("count(*)", "count(DISTINCT id)", "max(id)", "count_if(t = concat(\"'=\", id))").first()[:] == (250_000, 250_000, 249_999, 250_000)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.xlsx").write_bytes(b"PK broken")
    with pytest.raises(Exception, match="x.xlsx"):
        tabular.accepted(tabular.read_tables(spark, f"file://{tmp_path}/b")).collect()


def test_addresses_with_postcodes_of_any_length(spark):
    lines = spark.createDataFrame([(n, 0, f"Supplier: Alma Kft. {n} Wien, Fo utca {n % 90}") for n in (1234, 12345, 100_000, 901_000, 5_401_000)], "doc long, line_no int, line string")
    got = {r["doc"]: r["label"] for r in finders.names_and_addresses(lines, "doc", "line_no", "line").where("kind = 'address'").collect()}
    assert got == {n: f"{n} Wien, Fo utca {n % 90}" for n in (1234, 12345, 100_000, 901_000, 5_401_000)}


def test_benchmark_items_of_few_words(spark, tmp_path):
    docs = [(1, "Ein Haus, am See und kein Wald weit und breit"), (2, "am see"), (3, ""), (4, "haus am seeufer"), (5, "x " * 3000 + "haus am see")]
    items = [(10, "am See"), (11, "haus am see und kein wald"), (12, "Haus"), (13, ""), (14, "kein wald weit und breit")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in texts.benchmark_words_in_documents(spark, str(tmp_path)).select("item_id", "doc_id").collect()}
    assert got == {(10, 1), (10, 2), (10, 5), (11, 1), (12, 1), (12, 4), (12, 5), (14, 1)}


def test_words_without_one_and_two_letters(spark):
    words = ["a", "ab", "abcd", "aabbc"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", relations._without_one(F.col("w")).alias("one"), relations._without_two(F.col("w")).alias("two")).collect()
    less = lambda w, n: sorted("".join(c) for c in itertools.combinations(w, len(w) - n)) if len(w) >= n else []
    assert {r["w"]: (sorted(r["one"]), sorted(r["two"])) for r in rows} == {w: (less(w, 1), less(w, 2)) for w in words}


def test_credit_notes_like_one_by_one(spark):
    rng, day = random.Random(8), lambda n: date(2026, 1, 1) + timedelta(days=n)
    inv = [(k, rng.randrange(4), "EUR", D(rng.randrange(1, 4)), rng.choice([None, day(rng.randrange(90)), day(rng.randrange(90)), day(rng.randrange(90))])) for k in range(160)]
    notes = [(1000 + k, rng.randrange(4), "EUR", D(rng.randrange(1, 4)), rng.choice([None, day(rng.randrange(30)), day(rng.randrange(30)), day(rng.randrange(60))])) for k in range(120)]
    paid = {k for k in range(160) if k % 9 == 0}
    want, taken = set(), set()
    for n in sorted(notes):
        fits = [i for i in inv if i[1:4] == n[1:4] and i[4] and n[4] and i[4] <= n[4] and i[0] not in taken]
        if len(fits) == 1 and fits[0][0] not in paid:
            taken.add(fits[0][0])
            want.add((fits[0][0], n[0]))
    kind = "partner long, currency string, amount decimal(18,2), issue_date date"
    got = reconcile.credited(spark.createDataFrame(inv, f"invoice_id long, {kind}"), spark.createDataFrame(notes, f"note_id long, {kind}"), spark.createDataFrame([(k,) for k in paid], "invoice_id long"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_lines_of_many_groups_match_like_one_by_one(spark):
    rng, words = random.Random(3), ["part 12 O", "part 13 O", "part 13 F", "rent", "", None, "rent May"]
    old = [(rng.randrange(20), k, rng.choice("AB"), rng.choice(words)) for k in range(150)]
    new = [(rng.randrange(20), 1000 + k, rng.choice("AB"), rng.choice(words)) for k in range(150)]
    want = set()
    for group in {(s, f) for s, _, f, _ in old}:
        a, b = ([(i, t or "") for s, i, f, t in sorted(rows, key=lambda r: r[1]) if (s, f) == group] for rows in (old, new))
        score = {(i, j): 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for i, (_, x) in enumerate(a) for j, (_, y) in enumerate(b)}
        free_a, free_b = set(range(len(a))), set(range(len(b)))
        for i, j in sorted(score, key=lambda p: (-score[p], p)):
            if i in free_a and j in free_b:
                free_a.remove(i)
                free_b.remove(j)
                if (len(a), len(b)) == (1, 1) or not any(b[k][1] != b[j][1] and score[i, k] >= score[i, j] - 0.1 for k in range(len(b)) if k != j):
                    want.add((group[0], a[i][0], b[j][0]))
    kind = "statement long, id long, flag string, text string"
    got = evidence.match_lines(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["flag"])
    assert {tuple(r) for r in got.select("statement", "old_id", "new_id").collect()} == want and want
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()


def test_long_walks_end_in_tasks(spark, sf, monkeypatch):
    from tallyspark.plans import records as plan

    monkeypatch.setattr(records, "ROUNDS", 1)
    same(plan.replacement_resolve(spark, sf), plan.ORACLES["replacement_resolve"], connect(sf))
    rows = [(n, n + 1 if n < 400 else 0, n < 400) for n in range(1, 401)]  # one chain that ends alive
    lists = spark.createDataFrame(rows, "node long, w long, beaten boolean").selectExpr("node", "array(struct(0 AS k, w AS winner, 'rule' AS how, beaten)) AS winners")
    got = records._walked(lists, lists.selectExpr("node", "'g' AS _g")).collect()
    assert len(got) == 400 and {r["stands"] for r in got} == {0}

"""The utility grid on literal bills."""

from datetime import date
from decimal import Decimal as D

from tallyspark.operators import utility

BILL = "item_id long, address string, utility string, start date, end date, amount decimal(18,2), consumption decimal(18,2), supplier string, summary_only boolean, copy_key string, confirmed boolean"


def bill(n, start, end, amount, address="1111 Budapest, XV. ker. Fa u. 1.", utility="gas", key=None, confirmed=False, summary=False):
    return (n, address, utility, start, end, None if amount is None else D(amount), None, f"S{n % 2}", summary, key, confirmed)


def test_grid_of_bills(spark):
    rows = [
        bill(1, date(2026, 2, 5), date(2026, 3, 4), 28000), bill(2, date(2026, 1, 1), date(2026, 12, 31), 100), bill(3, date(2026, 5, 1), date(2026, 5, 31), 31, address="1111 BUDAPEST fa u. 1"),
        bill(4, date(2026, 5, 31), date(2026, 6, 1), 2, key="a"), bill(5, date(2026, 5, 31), date(2026, 6, 1), 2, key="a"), bill(6, date(2026, 5, 31), date(2026, 6, 1), 2, key="a"), bill(7, None, date(2026, 6, 1), 2),
        bill(8, date(2026, 6, 2), date(2026, 6, 1), 2), bill(9, date(2026, 6, 1), date(2026, 6, 1), None), bill(10, date(2026, 6, 1), date(2026, 6, 2), 7, address=None, utility="sum", summary=True),
    ]
    got = utility.grid(spark.createDataFrame(rows, BILL), spark.createDataFrame([(6, 4)], "a long, b long"))
    place = "1111 budapest fa u 1"
    cells = {(r["place"], r["month"]): (r["status"], None if r["amount"] is None else str(r["amount"]), r["settlement"], r["bills"]) for r in got.cells.collect()}
    assert cells == {
        (place, "2026-02"): ("ok", "24000.00", False, 1), (place, "2026-03"): ("partial", "4000.00", False, 1), (place, "2026-04"): ("missing", None, False, 0), (place, "2026-05"): ("overlap", "33.00", False, 3),
        (place, "2026-06"): ("overlap", "2.00", False, 2), (place, "2026-12"): ("ok", "100.00", True, 1), (utility.UNKNOWN, "2026-06"): ("ok", "7.00", False, 1),
    }
    assert {(r["item_id"], r["status"]) for r in got.sources.where("place is null").collect()} == {(5, "duplicate"), (7, "no_period"), (8, "no_period"), (9, "no_amount")}
    assert got.grand_total.first()[0] == D("28135.00")
    assert {(r["utility"], r["bills"], r["suppliers"]) for r in got.series.collect()} == {("gas", 5, "S0, S1"), ("sum", 1, "S0")}
    none = utility.grid(spark.createDataFrame([], BILL), spark.createDataFrame([], "a long, b long"))
    assert none.cells.count() == 0 and none.grand_total.first()[0] == 0

import datetime
import random

import pytest

from pennywright.operators.asof import asof_join
from pennywright.plans import portfolio

DAY = datetime.datetime(2024, 1, 1)


def plain(left, right):
    out = []
    for k, t, n in left:
        known = [r for r in right if r[0] == k and r[1] is not None and t is not None and r[1] <= t]
        best = max(known, key=lambda r: (r[1], r[2])) if known else None
        out.append((k, t, n, (best[1], best[2]) if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [60, 3600, 10 ** 9])
def test_newest_at_or_before(spark, width):
    rng = random.Random(width)

    def moment():
        return None if rng.random() < 0.05 else DAY + datetime.timedelta(seconds=rng.randrange(-4000, 9000) * 7)

    left = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), moment(), i) for i in range(400)]
    right = [(rng.choice(["a", None, "hot", "c"]), moment(), i) for i in range(60)]
    right += [(k, t, 1000 + n) for k, t, n in right[:10]]  # several at one time
    got = asof_join(spark.createDataFrame(left, "k string, t timestamp, n int"),
                    spark.createDataFrame(right, "k string, t timestamp, v int"), ["k"], "t", width=width)
    rows = sorted(((r.k, r.t, r.n, (r.found.t, r.found.v) if r.found else None) for r in got.collect()), key=repr)
    assert rows == plain(left, right)


def test_without_keys_and_with_empty_sides(spark):
    left = spark.createDataFrame([(1, datetime.date(2024, 1, 5)), (2, datetime.date(2023, 1, 1))], "id int, date date")
    right = spark.createDataFrame([(datetime.date(2024, 1, 1), 7), (datetime.date(2024, 1, 6), 8)], "date date, v int")
    got = {r.id: r.found and r.found.v for r in asof_join(left, right, [], "date").collect()}
    assert got == {1: 7, 2: None}
    assert asof_join(left.limit(0), right, [], "date").count() == 0
    assert [r.found for r in asof_join(left, right.limit(0), [], "date").collect()] == [None, None]


def test_context_takes_the_newest_indicators(spark):
    d = datetime.date
    asked = spark.createDataFrame([("x ",), ("Y",)], "ticker string")
    held = spark.createDataFrame([], "ticker string, quantity double, avg_cost double, current_price double, equity double, pct_change double")
    macro = spark.createDataFrame([(d(2024, 3, 1), 3.0), (d(2024, 1, 1), 1.0), (d(2024, 2, 1), 2.0)], "date date, rate double")
    prices = spark.createDataFrame([("X", d(2024, 1, 2), 10.0), ("x", d(2024, 2, 2), 11.0)], "ticker string, date date, price double")
    got = {r.ticker: (r.rate, r.macro_date, r.price) for r in portfolio.context(asked, held, macro=macro, prices=prices).collect()}
    assert got == {"X": (3.0, d(2024, 3, 1), 11.0), "Y": (3.0, d(2024, 3, 1), None)}
    then = portfolio.context(asked, held, macro=macro, prices=prices, as_of="2024-01-31").collect()
    assert {(r.ticker, r.rate, r.price) for r in then} == {("X", 1.0, 10.0), ("Y", 1.0, None)}
    none = portfolio.context(asked, held, macro=macro, as_of="2000-01-01").collect()
    assert {(r.ticker, r.rate) for r in none} == {("X", None), ("Y", None)}

"""Months and plan rates as Spark makes them: without a row for each calendar day, once for a query, and equal to halvings."""

import datetime as dt

import pytest

from navloom.operators import ALL
from navloom.plans.text import Operator

NAVS = [1.0, 4.0, 2.0, 2.5, 0.3, 0.31, 0.29, 0.5, 7.0, 8.0, 8.0, 9.0, 30.0, 2.0, 0.001, 0.001]


@pytest.fixture(scope="module")
def tables(spark):
    days = [dt.date(2019, 1, 15), dt.date(2019, 2, 1), dt.date(2019, 2, 3), dt.date(2019, 5, 30), *(dt.date(2019 + i // 12, i % 12 + 1, 1 + i % 3) for i in range(5, 17))]
    rows = [("a", d, v) for d, v in zip(days, NAVS, strict=True)] + [("b", dt.date(2018 + i // 12, i % 12 + 1, 1), 10.0) for i in range(30)]
    nav = spark.createDataFrame(rows, "fund_id string, ts date, nav double")
    return {"nav": nav}, rows


def months(rows, fund):
    own = sorted((d, v) for f, d, v in rows if f == fund)
    first, found = own[0][0].replace(day=1), {}
    while first <= own[-1][0]:
        found[first] = next((v for d, v in reversed(own) if d <= first), own[0][1])
        first = (first + dt.timedelta(days=31)).replace(day=1)
    return found


def test_months_carry_values_over_gaps(tables):
    for fund in "ab":
        got = {r["m"]: r["nav"] for r in Operator("x", "", f"select m, nav from mon where fund_id = '{fund}'")(tables[0]).collect()}
        assert got == months(tables[1], fund)


@pytest.mark.parametrize(("step", "after", "year", "lo", "hi"), [("sipx", 12, 365.25, -0.99, 5), ("o_held_rates", 24, 365.0, -0.95, 20)])
def test_rates_as_by_halvings(tables, step, after, year, lo, hi):
    got = {(r["fund_id"], r["start"]): r["xirr"] for r in Operator("x", "", f"select fund_id, start, xirr from {step}")(tables[0]).collect()}
    want = {}
    for fund in "ab":
        ms = list(months(tables[1], fund).items())
        for i in range(len(ms) - after):
            flows = [(-1.0, m) for m, _ in ms[i : i + 12]] + [(sum(1 / v for _, v in ms[i : i + 12]) * ms[i + after][1], ms[i + after][0])]
            value = lambda r: sum(a / (1 + r) ** ((m - ms[i][0]).days / year) for a, m in flows)  # noqa: B023, E731
            x, y = lo, hi
            for _ in range(60):
                x, y = ((x + y) / 2, y) if value((x + y) / 2) > 0 else (x, (x + y) / 2)
            want[fund, ms[i][0]] = (x + y) / 2 if value(lo) * value(hi) < 0 else None
    assert got.keys() == want.keys() and (step != "sipx" or None in want.values())
    for key, v in want.items():
        assert got[key] == (None if v is None else pytest.approx(v, abs=1e-10)), key


@pytest.mark.parametrize("name", ["lb03_within_date_spearman", "lb04_resolved_weights", "lb06_ic_weights", "lb07_hold_ic"])
def test_no_row_for_each_day(name):
    text = ALL[name].text("spark", {"nav": "", "index_nav": "", "fund": ""})
    assert "sequence(d0" not in text and "mon b" not in text
    assert "mon b" in ALL[name].text("duckdb", {"nav": "", "index_nav": "", "fund": ""})


@pytest.mark.parametrize("name", ["lb06_ic_weights", "lb07_hold_ic"])
def test_plans_are_written_once(name):
    assert {"panelr", "o_held_rates"} & set(ALL[name].shared({"nav": None, "index_nav": None, "fund": None}))

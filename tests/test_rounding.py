"""Rounding, quantiles and ties in Spark as in DuckDB: what lies halfway between two decimals, what becomes 0, equal troughs."""

import datetime as dt
import random

import duckdb
import pytest

from navloom.operators import ALL
from navloom.plans.text import written


def both(spark, text, rows, names):
    types = ", ".join(f"{n} double" for n in names)
    spark.createDataFrame(rows, types).createOrReplaceTempView("given")
    con = duckdb.connect()
    con.execute(f"create table given ({types})")
    con.executemany(f"insert into given values ({', '.join('?' * len(names))})", rows)
    return [tuple(r) for r in spark.sql(written(text, "spark")).collect()], con.sql(written(text, "duckdb")).fetchall()


def test_quantiles_of_short_decimals(spark):
    rng = random.Random(5)
    rows = [(float(g), round(rng.uniform(-0.1, 0.3), 6)) for g in range(400) for _ in range(20 + g % 4)]
    got, want = both(spark, "select g, [[round|[[quantile|x|0.25]]|6]] as p25, [[round|median(x)|6]] as p50 from given group by g order by g", rows, ["g", "x"])
    assert got == want
    plain, _ = both(spark, "select g, round([[q|x|0.25]], 6) as p25, round(median(x), 6) as p50 from given group by g order by g", rows, ["g", "x"])
    assert plain != want  # what the marks are for


def test_presentation_keeps_the_sign_of_zero(spark):
    rows = [(v, v, v, v) for v in (-0.00001, 0.00001, -0.0004, 0.0004, -0.0, 0.0, 0.12345, -0.12345)] + [(None, None, None, None)]
    text = ALL["prj08_presentation"].sql.replace("fund_id, ", "", 1).replace("from feat", "from given")
    got, want = both(spark, text, rows, ["cagr", "mdd", "ir", "beta"])
    got, want = set(map(repr, got)), set(map(repr, want))
    assert (got - want, want - got) == (set(), set())
    assert any("-0.000" in r for r in got)


@pytest.mark.parametrize("parts", [1, 3])
def test_first_of_equal_troughs(spark, parts):
    days = [dt.date(2020, 1, 3) + dt.timedelta(days=7 * i) for i in range(6)]
    rows = [(f"f{k}", d, v) for k in range(20) for d, v in zip(days, [100.0, 50.0, 60.0, 50.0, 70.0, 100.0], strict=True)]
    nav = spark.createDataFrame(rows, "fund_id string, ts date, nav double").repartition(parts)
    assert {r["weeks"] for r in ALL["rk22_recovery_to_peak"]({"nav": nav}).collect()} == {4.0}

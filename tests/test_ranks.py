"""Ranks, order statistics and rank correlations over many tasks against pandas."""

import numpy as np
import pandas as pd
import pytest

from navloom.functions.ranks import average_ranks, quantiles, spearman


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 3000
    x = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({"g": rng.choice(["a", "b", "hot"], n, p=[0.02, 0.08, 0.9]), "x": x, "y": np.round(0.3 * x + rng.normal(size=n), 1)})


@pytest.mark.parametrize("parts", [2, 17])
def test_against_pandas(spark, frame, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", None, 1.0), ("none", None, None)], "g string, x double, y double"))
        ranks = {(r["g"], r["x"]): r["rk"] for r in average_ranks(df, ["g"], "x", "rk").collect()}
        found = {r["g"]: r for r in quantiles(df, ["g"], "x", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
        rho = {r["g"]: r for r in spearman(df, ["g"], "x", "y").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.keys() == rho.keys() == {"a", "b", "hot"}
    for g, own in frame.groupby("g"):
        want = dict(zip(own.x, own.x.rank(), strict=True))
        assert {x: v for (h, x), v in ranks.items() if h == g} == want
        for name, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)):
            assert found[g][name] == pytest.approx(own.x.quantile(p), abs=1e-12)
        assert rho[g]["n"] == len(own) and rho[g]["rho"] == pytest.approx(own.x.rank().corr(own.y.rank()), abs=1e-9)


def test_no_group_and_nothing_to_rank(spark, frame):
    df = spark.createDataFrame(frame)
    whole = quantiles(df.selectExpr("1 as one", "x"), ["one"], "x", {"p25": 0.25}).first()
    assert whole["p25"] == pytest.approx(frame.x.quantile(0.25))
    flat = spearman(df.selectExpr("g", "1.0D as x", "y"), ["g"], "x", "y").collect()
    assert all(r["rho"] is None for r in flat)
    assert spearman(df.limit(0), ["g"], "x", "y").count() == 0


def test_no_task_has_a_group(spark, frame):
    """No window is by group alone: the plan of the ranks has the task's number in every partitioning by values."""
    plan = average_ranks(spark.createDataFrame(frame), ["g"], "x", "rk")._jdf.queryExecution().toString()
    assert "windowspecdefinition(g#" in plan  # over the small table of tasks
    over_values = [line for line in plan.splitlines() if "Window" in line and "sum(n#" in line]
    assert over_values and all("_part#" in line for line in over_values)

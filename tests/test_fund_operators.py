"""Known answers, pandas references and invariants of the fund operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from navloom.functions.style import simplex_weights, style_weights
from navloom.operators import ALL
from navloom.sources import landing

FRIDAY = dt.date(2015, 1, 2)


def tables(spark, navs, index=None, **more):
    """navs: fund id to a pandas series by date; the benchmark of all is one index."""
    nav = pd.concat([pd.DataFrame({"fund_id": k, "ts": s.index, "nav": s.to_numpy(float)}) for k, s in navs.items()])
    index = index if index is not None else next(iter(navs.values()))
    idx = pd.DataFrame({"index_id": "ALL", "ts": index.index, "nav": index.to_numpy(float)})
    fund = pd.DataFrame({"fund_id": list(navs), "name": list(navs), "sector": "ALL", "subsector": "S", "aum": 100.0})
    made = {"nav": spark.createDataFrame(nav, "fund_id string, ts date, nav double"), "index_nav": spark.createDataFrame(idx, "index_id string, ts date, nav double"), "fund": spark.createDataFrame(fund)}
    return made | more


def weekly(values, start=FRIDAY):
    return pd.Series(list(values), index=[start + dt.timedelta(days=7 * i) for i in range(len(values))])


def walk(seed, n=300, drift=0.002, vol=0.02):
    rng = np.random.default_rng(seed)
    return weekly(100 * np.exp(np.cumsum(rng.normal(drift, vol, n))))


def one(spark, name, made, **params):
    rows = ALL[name](made, **params).toPandas()
    return rows.set_index("fund_id").to_dict("index")


def test_returns_and_risk_as_pandas(spark):
    navs = {"a": walk(1), "b": walk(2, 200)}
    made = tables(spark, navs)
    period, dd, vol = one(spark, "rt01_period_return", made), one(spark, "rk03_max_drawdown", made), one(spark, "rk01_volatility", made)
    cvar, skew = one(spark, "rk08_cvar", made), one(spark, "rk17_skew", made)
    for k, s in navs.items():
        r = s.pct_change().dropna()
        assert period[k]["r13"] == pytest.approx(s.iloc[-1] / s.iloc[-14] - 1, abs=1e-7)
        assert dd[k]["weekly"] == pytest.approx((s / s.cummax() - 1).min(), abs=1e-7) and dd[k]["weekly"] <= 0
        assert vol[k]["vol"] == pytest.approx(r.std() * np.sqrt(52), abs=1e-7) and vol[k]["vol_pop"] == pytest.approx(r.std(ddof=0) * np.sqrt(52), abs=1e-7)
        assert cvar[k]["cvar_5"] == pytest.approx(r[r <= r.quantile(0.05)].mean(), abs=1e-7)
        assert skew[k]["skew"] == pytest.approx(r.skew(), abs=1e-5)


def test_benchmark_against_itself(spark):
    made = tables(spark, {"a": walk(3)})
    ab = one(spark, "bm01_alpha_beta", made)["a"]
    assert ab["beta"] == pytest.approx(1) and ab["alpha"] == pytest.approx(0, abs=1e-7)
    captures = one(spark, "bm05_capture_sums", made)["a"]
    assert captures["up_capture"] == pytest.approx(1) and captures["down_capture"] == pytest.approx(1)


def test_flat_monotone_and_short_series(spark):
    made = tables(spark, {"flat": weekly([100.0] * 80), "up": weekly([100 + i for i in range(80)]), "short": weekly([100.0])}, index=walk(4, 80))
    dd = one(spark, "rk03_max_drawdown", made)
    assert dd["flat"]["weekly"] == 0 and dd["up"]["weekly"] == 0 and dd["short"]["weekly"] == 0
    assert pd.isna(one(spark, "rt01_period_return", made)["short"]["r4"])
    assert set(one(spark, "rk09_sharpe", made)) <= {"flat", "up", "short"}
    episodes = one(spark, "rk23_drawdown_episodes", tables(spark, {"x": weekly([10, 9, 9.5, 10, 11, 10, 11.5, 11])}))["x"]
    assert episodes["n_runs"] == 3 and episodes["longest_weeks"] == 2


def test_plans_on_constant_growth(spark):
    days = pd.date_range("2015-01-01", "2018-12-31").date
    t = np.array([(d - days[0]).days for d in days])
    made = tables(spark, {"a": pd.Series(100 * 1.12 ** (t / 365.25), index=days)})
    assert all(abs(r["xirr"] - 0.12) < 1e-5 for r in ALL["cf03_rolling_sip_xirr"](made).collect())
    hold = ALL["cf05_sip_then_hold"](made).collect()
    assert hold and all(abs(r["xirr"] - (1.12 ** (365 / 365.25) - 1)) < 1e-5 for r in hold)
    assert one(spark, "cf01_xirr", made)["a"]["xirr"] == pytest.approx(0.12, abs=1e-5)


def test_week_anchors_as_pandas(spark):
    rng = np.random.default_rng(6)
    days = sorted(rng.choice(pd.date_range("2016-01-01", "2016-12-31").date, 120, replace=False))
    s = pd.Series(rng.uniform(90, 110, 120), index=pd.to_datetime(days))
    made = tables(spark, {"a": pd.Series(s.to_numpy(), index=days)})
    for name, rule in (("friday", "W-FRI"), ("monday", "W-MON"), ("sunday", "W-SUN")):
        want = s.resample(rule).last().dropna()
        got = {r["week"]: r["nav"] for r in ALL[f"ts02_weekly_{name}"](made).collect()}
        assert got == {k.date(): v for k, v in want.items()}


def test_cleaning_keeps_last_or_first(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0, 1), ("a", dt.date(2020, 1, 1), 2.0, 2), ("a", dt.date(2020, 1, 2), -1.0, 1), ("a", None, 5.0, 1), ("a", dt.date(2020, 1, 3), None, 1)]
    raw = spark.createDataFrame(rows, "fund_id string, ts date, nav double, seq int")
    assert [r["nav"] for r in ALL["prj01_clean_nav_last"]({"nav_raw": raw}).collect()] == [2.0]
    assert [r["nav"] for r in ALL["prj01_clean_nav_first"]({"nav_raw": raw}).collect()] == [1.0]


def test_no_look_ahead(spark):
    s = walk(8)
    full, cut = tables(spark, {"a": s}), tables(spark, {"a": s[:-40]})
    late = {r["as_of"]: r for r in ALL["prj04_point_in_time"](full).collect()}
    for r in ALL["prj04_point_in_time"](cut).collect():
        assert late[r["as_of"]] == r
    panel = {r["as_of_month"]: r for r in ALL["lb01_training_panel"](full).collect()}
    early = ALL["lb01_training_panel"](cut).collect()
    assert early and all(panel[r["as_of_month"]] == r for r in early)


def test_percentile_rank_as_pandas(spark):
    navs = {f"f{i}": walk(20 + i, 200) for i in range(8)} | {"twin": walk(20, 200), "short": walk(3, 60)}
    made = tables(spark, navs)
    got = ALL["scr01_percentile_rank"](made).toPandas()
    cagr = {k: (s.iloc[-1] / s.iloc[-157]) ** (1 / 3) - 1 if len(s) > 156 else np.nan for k, s in navs.items()}
    want = pd.Series(cagr).rank(pct=True) * 100
    mine = got[got.metric == "cagr"].set_index("fund_id").p
    assert all(mine[k] == pytest.approx(want[k], abs=1e-4) for k in navs if k != "short") and pd.isna(mine["short"])
    assert ((got.p.dropna() > 0) & (got.p.dropna() <= 100)).all()


def test_whole_matrices_in_long_form(spark):
    from navloom.operators.base import wide

    navs = {f"f{i}": walk(60 + i, 40 + 20 * i) for i in range(5)} | {"late": walk(70, 60)[53:]}
    made = tables(spark, navs)
    both = pd.DataFrame(navs).sort_index()
    long = ALL["ts08_period_changes"](made, short=13, long=26)
    for column, n in (("r_short", 13), ("r_long", 26)):
        got = wide(long, "ts", "fund_id", column).toPandas().set_index("ts").sort_index()
        assert sorted(got.columns) == sorted(navs)
        pd.testing.assert_frame_equal(got[both.columns], both.pct_change(n, fill_method=None), check_names=False, check_index_type=False, atol=1e-9)
    ranks = ALL["en04_run_ranks"](made)
    years = {k: s.groupby(lambda d: d.year).agg(lambda x: round(x.iloc[-1] / x.iloc[0] - 1, 9)) for k, s in navs.items()}
    want = pd.DataFrame(years).rank(axis=1, ascending=False).stack()
    assert {(r["run_year"], r["fund_id"]): r["run_rank"] for r in ranks.collect()} == want.to_dict()
    assert {r["fund_id"] for r in ranks.where("in_first = 0").collect()} == {k for k, s in navs.items() if s.index[0].year > 2015}
    assert set(wide(ranks, "fund_id", "run_year", "run_rank").columns) == {"fund_id", *map(str, pd.DataFrame(years).index)}


def test_fallback_over_all_indices(spark):
    from navloom.sources.queries import candidates_by_asset

    rows = [(k, FRIDAY + dt.timedelta(days=i), float(i)) for k, n in (("AFRICA", 5), ("AMERICA", 40), ("EUROPE", 50)) for i in range(n)]
    index = spark.createDataFrame(rows, "index_id string, ts date, nav double")
    got = landing.first_source(candidates_by_asset(index), 30).groupBy("asset", "source").count().collect()
    assert {tuple(r) for r in got} == {("equity", "AMERICA", 40), ("gold", "AMERICA", 40), ("silver", "AMERICA", 40)}
    got = landing.first_source(candidates_by_asset(index), 45).groupBy("asset", "source").count().collect()
    assert {tuple(r) for r in got} == {(a, "EUROPE", 50) for a in ("equity", "gold", "silver")}


def test_compiled_scores_by_hand(spark):
    rows = [("A", "x", 1.0), ("A", "y", 2.0), ("A", "z", 3.0), ("B", "x", 5.0), ("B", "y", 5.0), ("C", "z", 7.0)]
    scores = spark.createDataFrame([(m, f, s, "10", "5%") for m, f, s in rows], "model string, fund_id string, score double, data_days string, cagr_3y string")
    fund = spark.createDataFrame([(f, "S") for f in "xyz"] + [("q", "T")], "fund_id string, sector string")
    more = scores.union(spark.createDataFrame([("A", "q", 9.0, "10", "5%")], scores.schema))
    got = one(spark, "en02_total_rank", {"model_score": more, "fund": fund})
    assert {k: v["final_score"] for k, v in got.items()} == {"x": 0.167, "y": 0.333, "z": 0.5, "q": 0.5}
    assert {k: v["total_rank"] for k, v in got.items()} == {"z": 1, "y": 2, "x": 3, "q": 1}


def test_learned_weights_sum_to_one(spark):
    made = tables(spark, {f"f{i}": walk(40 + i, 330) for i in range(8)})
    weights = ALL["lb04_resolved_weights"](made).toPandas()
    assert weights.weight.sum() == pytest.approx(1, abs=1e-5) and (weights.weight >= 0).all()
    assert ALL["lb05_blended_weights"](made).toPandas().weight.max() <= 0.4 + 1e-6


def test_style_weights_are_the_best_on_the_simplex(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 0.02, (60, 4))
    for mix in ([0.6, 0.3, 0.1, 0.0], [0, 1, 0, 0], [1.4, -0.4, 0, 0]):
        y = x @ np.array(mix) + rng.normal(0, 1e-3, 60)
        gram, cross = (x.T @ x / 60)[None], (x.T @ y / 60)[None]
        w = simplex_weights(gram, cross)[0]
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        loss = lambda v: np.mean((y - x @ v) ** 2)
        for v in rng.dirichlet(np.ones(4), 2000):
            assert loss(w) <= loss(v) + 1e-12
    rows = spark.createDataFrame([("a", float(0.5 * p + 0.5 * q), float(p), float(q), float(r)) for p, q, r, _ in x], "fund_id string, f double, x1 double, x2 double, x3 double")
    got = style_weights(rows, ["fund_id"]).first()
    assert got["w_x1"] == pytest.approx(0.5, abs=1e-6) and got["w_x2"] == pytest.approx(0.5, abs=1e-6)


def test_rolling_weights_reach_the_whole_series(spark):
    from navloom.functions.style import CASH, attribution
    from navloom.sources.queries import _rolled

    rng, n_of, rows = np.random.default_rng(12), {"long": 315, "one": 55, "short": 51}, []
    for fund, n in n_of.items():
        x = rng.normal(0, 0.02, (n, 3))
        y = np.where(np.arange(n) < n // 2, x[:, 0], 0.5 * x[:, 1] + 0.5 * x[:, 2]) + rng.normal(0, 1e-3, n)
        rows += [(fund, n - i, i + 1, n, float(y[i]), *map(float, x[i])) for i in range(n)]
    aligned = spark.createDataFrame(rows, "fund_id string, rd int, ra int, n int, f double, x1 double, x2 double, x3 double")
    weights = _rolled(aligned)
    got, split = weights.toPandas(), {r["fund_id"]: r for r in attribution(aligned, weights).collect()}
    data = pd.DataFrame(rows, columns=aligned.columns).assign(cash=CASH)
    names = ["x1", "x2", "x3", "cash"]
    assert set(got.fund_id) == {"long", "one"} and set(split) == {"long"}
    for fund, own in got.groupby("fund_id"):
        d = data[data.fund_id == fund].set_index("ra")
        want = {}
        for end in range(52, n_of[fund] + 1, 4):
            x, y = d.loc[end - 51 : end, names].to_numpy(), d.loc[end - 51 : end, "f"].to_numpy()
            want[end] = simplex_weights((x.T @ x / 52)[None], (x.T @ y / 52)[None])[0]
        mine = {n_of[fund] + 1 - r.e0: [r.w_x1, r.w_x2, r.w_x3, r.w_cash] for r in own.itertuples()}
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        if fund == "long":
            w = pd.DataFrame.from_dict(want, orient="index", columns=names).reindex(d.index).ffill().dropna()
            d, mean = d.loc[w.index], w.mean()
            equal = (mean > 0.01) / (mean > 0.01).sum()
            held = (w * d[names]).sum(axis=1)
            assert split[fund]["strategic"] == pytest.approx(52 * (d[names] @ (mean - equal)).mean(), abs=2e-6)
            assert split[fund]["tactical"] == pytest.approx(52 * (held - d[names] @ mean).mean(), abs=2e-6)
            assert split[fund]["selection"] == pytest.approx(52 * (d.f - held).mean(), abs=2e-6)


def test_landing(spark, tmp_path):
    raw = spark.createDataFrame([('{"success":true,"data":{"result":[{"mfId":"1","name":"n","sector":"s","values":[{"filter":"aum","doubleVal":3.5}]},{"mfId":"2","name":"m","sector":null,"values":[]}]}}',), ("broken",), (None,)], "raw string")
    assert {tuple(r) for r in landing.screener_funds(raw).collect()} == {("1", "n", "s", 3.5, None), ("2", "m", None, None, None)}
    charts = spark.createDataFrame([("1", '{"data":[{"points":[{"ts":"2020-01-01T00:00:00Z","lp":1.5},{"ts":"bad","lp":2}]}]}'), ("2", '{"data":[]}')], "fund_id string, raw string")
    assert [(r["fund_id"], r["nav"], r["ts"] is None) for r in landing.chart_points(charts).collect()] == [("1", 1.5, False), ("1", 2.0, True)]
    files = spark.createDataFrame([("out/North East_M1.csv",), ("out/A_B_C.csv",), ("out/North East.csv",)], "file string")
    assert {tuple(r) for r in landing.discover_scores(files).collect()} == {("North East", "M1"), ("A_B", "C")}
    wanted, landed = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",)], "k string")
    assert [r["k"] for r in landing.need_list(wanted, landed, "k").collect()] == ["a"]
    assert {r["missing"] for r in landing.missing_columns(wanted, "t").collect()} == set(landing.CONTRACT)
    path = str(tmp_path / "snap")
    for day, v in (("2020-01-01", 1), ("2020-01-02", 2), ("2020-01-02", 3)):
        landing.write_snapshot(spark.createDataFrame([(v, day)], "v int, snapshot_date string"), path)
    assert [r["v"] for r in landing.read_snapshot(spark, path).collect()] == [3]
    assert [r["v"] for r in landing.read_snapshot(spark, path, "2020-01-01").collect()] == [1]


def test_stream_lands_new_files_once(spark, tmp_path):
    from navloom.streaming.landing import land_new_files

    (tmp_path / "in").mkdir()
    where = [str(tmp_path / x) for x in ("in", "out", "progress")]
    (tmp_path / "in/1.csv").write_text("fund_id,ts,nav\na,2020-01-01,1.0\na,2020-01-01,1.0\na,bad,2\na,2020-01-02,-1\n")
    land_new_files(spark, *where)
    (tmp_path / "in/2.csv").write_text("fund_id,ts,nav\na,2020-01-03,3.0\n")
    land_new_files(spark, *where)
    land_new_files(spark, *where)
    assert sorted(r["nav"] for r in spark.read.parquet(where[1]).collect()) == [1.0, 3.0]


def test_stream_lands_old_rows_of_later_files(spark, tmp_path):
    from navloom.streaming.landing import land_new_files

    (tmp_path / "in").mkdir()
    where = [str(tmp_path / x) for x in ("in", "out", "progress")]
    (tmp_path / "in/1.csv").write_text("fund_id,ts,nav\na,2020-06-01,1.0\n,2020-06-01,4.0\n")
    land_new_files(spark, *where)
    (tmp_path / "in/2.csv").write_text("fund_id,ts,nav\nb,2015-01-01,2.0\nb,2015-01-01,2.0\na,2019-01-01,3.0\na,2020-06-01,9.0\n,2020-06-01,9.0\n")
    land_new_files(spark, *where)
    land_new_files(spark, *where[:2], str(tmp_path / "again"))
    rows = spark.read.parquet(where[1]).collect()
    assert sorted((r["fund_id"] or "", str(r["ts"].date()), r["nav"]) for r in rows) == [("", "2020-06-01", 4.0), ("a", "2019-01-01", 3.0), ("a", "2020-06-01", 1.0), ("b", "2015-01-01", 2.0)]


def test_entry_without_text_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert len(entry.queries()) >= 140 and set(entry.oracle_sql()) <= set(entry.queries())


def test_mix_with_a_sleeve_of_short_history(spark):
    """Windows with 13 weeks of the third sleeve are solved with it over those weeks, others without it; against a fine grid of weights."""
    from navloom.functions.style import CASH, varying_style_weights

    rng = np.random.default_rng(8)
    x = rng.normal(0.002, 0.02, (52, 3))
    rows, series = [], {}
    for g, known in (("none", 0), ("short", 12), ("enough", 13), ("all", 52)):
        y = x @ [0.3, 0.1, 0.4] + 0.2 * CASH + rng.normal(0, 0.002, 52)
        later = [None] * (52 - known) + x[52 - known :, 2].tolist()
        rows += [(g, float(y[i]), float(x[i, 0]), float(x[i, 1]), later[i]) for i in range(52)]
        series[g] = (y, known)
    rows += [("few", 0.01, 0.01, 0.01, 0.01)] * 11
    found = {r["g"]: r for r in varying_style_weights(spark.createDataFrame(rows, "g string, f double, x1 double, x2 double, x3 double"), ["g"]).collect()}
    assert found.keys() == series.keys()
    steps = np.linspace(0, 1, 41)
    for g, (y, known) in series.items():
        r = found[g]
        use = known >= 13
        assert r["has_x3"] == use and r["n"] == (known if use else 52)
        part = slice(52 - known, 52) if use else slice(0, 52)
        sleeves = np.column_stack([x[part], np.full(len(x[part]), CASH)])
        loss = lambda w: float(np.mean((y[part] - sleeves @ w) ** 2))  # noqa: B023, E731
        own = np.array([r["w_x1"], r["w_x2"], r["w_x3"], r["w_cash"]])
        assert own.min() >= 0 and own.sum() == pytest.approx(1) and (use or own[2] == 0)
        grid = [np.array([a, b, c, 1 - a - b - c]) for a in steps for b in steps for c in (steps if use else [0]) if a + b + c <= 1 + 1e-9]
        assert loss(own) <= min(map(loss, grid)) + 1e-12


def test_allocation_skill_joins_the_score(spark, sf_dir):
    """A quarter of the score is the mean of three percentiles of fx05 within the sector; funds without them keep the score of e2e03."""
    from navloom.sources.queries import QUERIES as own

    parts = own["fx05_attribution"](spark, sf_dir).toPandas().set_index("fund_id")
    from navloom.plans.registry import QUERIES

    base = QUERIES["e2e03_style_allocation"](spark, sf_dir).toPandas().set_index("fund_id")
    rows = own["e2e03_allocation_skill"](spark, sf_dir).collect()
    assert len(rows) == len(base)
    for r in rows:
        f = r["fund_id"]
        if f not in parts.index:
            assert r["skill"] is None and r["score"] == pytest.approx(base.score[f], abs=1e-5)
            continue
        peers = parts[parts.index.isin(base.index[base.sector == base.sector[f]])]
        share = lambda c: 0.0 if len(peers) < 2 else (peers[c] < peers[c][f]).sum() / (len(peers) - 1)  # noqa: B023, E731
        skill = 100 * (0.35 * share("strategic") + 0.35 * share("tactical") + 0.3 * share("selection"))
        assert r["skill"] == pytest.approx(skill, abs=1e-4)
        assert r["score"] == pytest.approx(0.75 * base.score[f] + 0.25 * skill, abs=1e-4)

"""Models replayed at past snapshots, the self-tuning model and daily momentum: against pandas, and without a look ahead."""

import dataclasses
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from navloom.operators import ALL
from navloom.operators.learning import _TUNED, _TUNED_DAYS
from navloom.plans.text import Model

FUNDS = [f"f{i}" for i in range(13)]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    days = [d.date() for d in pd.bdate_range("2014-01-01", "2019-12-31")]
    market = rng.normal(0.0004, 0.009, len(days))
    index = pd.Series(100 * np.exp(np.cumsum(market)), index=days).drop(days[100:103])
    navs = {}
    for i, f in enumerate(FUNDS):
        s = pd.Series(100 * np.exp(np.cumsum(0.9 * market + rng.normal(0.00002 * i, 0.004, len(days)))), index=days)
        navs[f] = s[rng.random(len(days)) < 0.9]
    navs["f12"] = navs["f12"].iloc[-200:]
    return navs, index


def made(spark, navs, index):
    nav = pd.concat([pd.DataFrame({"fund_id": k, "ts": s.index, "nav": s.to_numpy()}) for k, s in navs.items()])
    idx = pd.DataFrame({"index_id": "S", "ts": index.index, "nav": index.to_numpy()})
    fund = [(f, "n", "S", "s", 500.0 * 3**i if i < 5 else None) for i, f in enumerate(navs)]
    holding = spark.createDataFrame([], "fund_id string, type string, title string, sid string, sector string, latest double, change3m double")
    return {
        "nav": spark.createDataFrame(nav, "fund_id string, ts date, nav double"),
        "index_nav": spark.createDataFrame(idx, "index_id string, ts date, nav double"),
        "fund": spark.createDataFrame(fund, "fund_id string, name string, sector string, subsector string, aum double"),
        "holding": holding,
    }


def momentum(nav, bench, days):
    f = nav[nav.index >= nav.index[-1] - dt.timedelta(days=days)]
    b = bench.reindex(f.index).ffill()
    if len(f) < 20:
        return 0.0
    both = pd.concat([f.pct_change().dropna(), b.pct_change().dropna()], axis=1).dropna()
    excess = both.iloc[:, 0] - both.iloc[:, 1]
    return 0.0 if excess.empty or excess.std() == 0 else excess.mean() / excess.std() * np.sqrt(252)


def plan(nav, start, end):
    """Rate of return of monthly purchases from start on, valued at the last value up to end."""
    own = nav[(nav.index >= start) & (nav.index <= end)]
    flows, units = [], 0.0
    for m in pd.date_range(start, end, freq="MS").date:
        later = own[own.index >= m]
        if len(later):
            flows.append((later.index[0], -1.0))
            units += 1 / later.iloc[0]
    if len(flows) < 6:
        return None
    flows.append((own.index[-1], units * own.iloc[-1]))
    value = lambda r: sum(a / (1 + r) ** ((d - flows[0][0]).days / 365) for d, a in flows)
    lo, hi = -0.99, 10.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if value((lo + hi) / 2) > 0 else (lo, (lo + hi) / 2)
    return (lo + hi) / 2


def measures(nav, bench, e):
    nav, bench = nav[nav.index <= e], bench[bench.index <= e]
    if len(nav) < 250:
        return None
    year = dt.timedelta(days=365)
    wins = []
    for d in pd.date_range(e - 2 * year, e - year, freq="ME").date:
        f, b = plan(nav, d, d + year), plan(bench, d, d + year)
        if f is not None and b is not None:
            wins.append(round(f, 9) > round(b, 9))
    stamp = lambda s: pd.Series(s.to_numpy(), index=pd.to_datetime(s.index))
    f3, b3 = (stamp(s[s.index >= e - 3 * year]).resample("W").last().dropna() for s in (nav, bench))
    r = pd.concat([f3.pct_change(), b3.reindex(f3.index).ffill().pct_change()], axis=1).dropna()
    up, down = r[r.iloc[:, 1] > 0].mean(), r[r.iloc[:, 1] < 0].mean()
    x = stamp(nav).resample("W").last().dropna().pct_change().dropna() - 0.065 / 52
    return {
        "win_rate": np.mean(wins),
        "down_capture": down.iloc[0] / down.iloc[1],
        "swing_elasticity": up.iloc[0] / up.iloc[1] - down.iloc[0] / down.iloc[1],
        "ir_3m": momentum(nav, bench, 90),
        "ir_6m": momentum(nav, bench, 180),
        "sortino": x.mean() / x[x < 0].std() * np.sqrt(52),
    }


def test_daily_momentum_as_pandas(spark, series):
    navs, index = series
    found = {r["fund_id"]: r for r in ALL["rt09_information_momentum"](made(spark, navs, index)).collect()}
    for f, nav in navs.items():
        assert found[f]["m90"] == pytest.approx(momentum(nav, index, 90), abs=1e-5)
        assert found[f]["m180"] == pytest.approx(momentum(nav, index, 180), abs=1e-5)


def test_tuned_model_as_pandas(spark, series):
    navs, index = series
    tables = made(spark, navs, index)
    long = Model("long", "", "select fund_id, sector, metric, x from tuned_long", steps={**_TUNED, **_TUNED_DAYS})(tables).collect()
    found = {(r["fund_id"], r["metric"]): r["x"] for r in long}
    last = index.index[-1]
    asof = {"": last, "@0": last - dt.timedelta(days=365), "@1": last - dt.timedelta(days=730)}
    want = {}
    for k, e in asof.items():
        cut = index[index.index <= e].index[-1]
        for f, nav in navs.items():
            for m, v in (measures(nav[nav.index <= e], index, cut) or {}).items():
                want[f + k, m] = v
    assert found.keys() == want.keys() and ("f12", "sortino") not in found
    for key, v in want.items():
        assert found[key] == pytest.approx(v, abs=2e-6), key
    weights = {r["metric"]: r for r in ALL["lb06_tuned_weights"](tables).collect()}
    mean = {}
    for m in weights:
        ics = []
        for k in ("@0", "@1"):
            y = {f: plan(navs[f], asof[k], asof[k] + dt.timedelta(days=365)) for f in FUNDS if (f + k, m) in want}
            pair = pd.DataFrame({"x": [round(want[f + k, m], 9) for f in y], "y": list(y.values())}).dropna()
            ics.append(pair.x.rank().corr(pair.y.rank()))
        mean[m] = np.mean(ics)
        assert weights[m]["mean_ic"] == pytest.approx(mean[m], abs=1e-5), m
    raw = {m: max(0.01, -v if m == "down_capture" else v) for m, v in mean.items()}
    for m, v in raw.items():
        assert weights[m]["weight"] == pytest.approx(v / sum(raw.values()), abs=1e-5)
    ranks = {m: pd.Series({f: found[f, m] for f in FUNDS if (f, m) in found}).rank(ascending=m != "down_capture", pct=True) * 100 for m in raw}
    aum = {f: 500.0 * 3**i if i < 5 else 0 for i, f in enumerate(FUNDS)}
    for r in ALL["e2e07_mid_cap"](tables).collect():
        f = r["fund_id"]
        score = sum(ranks[m][f] * v / sum(raw.values()) for m, v in raw.items())
        a = aum[f]
        score *= 0.85 if a > 40000 else 0.9 if a > 25000 else 0.95 if a > 15000 else 1
        assert r["score"] == pytest.approx(score, abs=0.02)


def test_replay_does_not_look_ahead(spark, series):
    """Scores at snapshots stay when all values after the newest snapshot change; today's scores do not."""
    navs, index = series
    day = max(r["snapshot"] for r in ALL["lb08_score_report"](made(spark, navs, index)).select("snapshot").collect())
    cut = dt.date.fromisoformat(day)
    rng = np.random.default_rng(9)
    bent = {f: s.where(np.array(s.index) <= cut, s * rng.uniform(0.7, 1.4, len(s))) for f, s in navs.items()}
    other = index.where(np.array(index.index) <= cut, index * rng.uniform(0.8, 1.3, len(index)))
    scores = dataclasses.replace(ALL["lb08_score_report"], sql="select fund_id, score from model_scores")
    before, after = ({r["fund_id"]: r["score"] for r in scores(made(spark, *x)).collect()} for x in ((navs, index), (bent, other)))
    assert sum("@" in f for f in before) > 40 and before.keys() == after.keys()
    assert all(after[f] == pytest.approx(v, abs=1e-9) for f, v in before.items() if "@" in f)
    assert any(abs(after[f] - v) > 1 for f, v in before.items() if "@" not in f)


def test_score_report_counts_the_best(spark, series):
    navs, index = series
    model = ALL["lb08_score_report"]
    tables = made(spark, navs, index)
    report = {r["snapshot"]: r for r in model(tables).collect()}
    part = dataclasses.replace(model, sql="select s.fund_id, s.score, o.y, cast(o.day as int) as day from replay_scores s join replay_outcomes o on o.fund_id = s.fund_id and o.k = s.k")
    rows = part(tables).toPandas()
    for day, own in rows.groupby("day"):
        if len(own) >= 12:
            r = report[str(dt.date(1970, 1, 1) + dt.timedelta(days=int(day)))]
            best = own.sort_values(["score", "fund_id"], ascending=[False, True]).head(7)
            assert r["n_funds"] == len(own)
            assert r["ic"] == pytest.approx(own.score.rank().corr(own.y.rank()), abs=1e-5)
            assert r["top_less_median"] == pytest.approx(best.y.mean() - own.y.median(), abs=1e-5)
            assert r["peer_hits"] == pytest.approx((best.y > own.y.median()).mean(), abs=1e-5)
    assert len(report) >= 3


def test_weight_keys_as_reported(spark):
    keys = ("nav", "allocation", "allocationPct", "weight", "holdingPct", "percent", "pct", "holding", "portfolioShare")
    rows = [(str(i), "s", None, *("0.25" if j == i else None for j in range(9))) for i in range(9)] + [("x", "s", 120.0, *["5"] * 9), ("y", "s", -1.0, "n/a", "0", "101", *["7"] * 6)]
    raw = spark.createDataFrame(rows, "fund_id string, sid string, latest double, " + ", ".join(f"{k} string" for k in keys))
    found = {r["fund_id"]: r["weight_pct"] for r in ALL["prj07_holding_weight"]({"holding_raw": raw}).collect()}
    assert found == {**{str(i): 25.0 for i in range(9)}, "x": 100.0, "y": 7.0}


def test_fixed_range_measures_as_pandas(spark, series):
    navs, index = series
    tables = made(spark, navs, index)
    model = ALL["e2e08_total_market"]
    part = dataclasses.replace(model, sql="select r.fund_id, r.days, m.ir, m.down from fixed_recovery r left join fixed_months m on m.fund_id = r.fund_id")
    found = {r["fund_id"]: r for r in part(tables).collect()}
    for f, nav in navs.items():
        fall = nav / nav.cummax() - 1
        longest, began = 0, None
        for d, v in fall.items():
            if v < -0.001 and began is None:
                began = d
            elif v >= -0.001 and began is not None:
                longest, began = max(longest, (d - began).days), None
        if began is not None:
            longest = max(longest, (nav.index[-1] - began).days)
        assert found[f]["days"] == longest
        both = pd.concat([nav, index], axis=1, join="inner")
        both.index = pd.to_datetime(both.index)
        r = both.resample("ME").last().pct_change().dropna()
        excess, b = r.iloc[:, 0] - r.iloc[:, 1], r.iloc[:, 1]
        assert found[f]["ir"] == pytest.approx(excess.mean() / excess.std() * np.sqrt(12), abs=1e-8)
        fell = r[b < 0]
        if len(fell) >= 3 and (b > 0).sum() >= 3:
            grown = ((1 + fell).prod() ** (12 / len(fell)) - 1).to_numpy()
            assert found[f]["down"] == pytest.approx(grown[0] / grown[1], abs=1e-8)
    scores = model(tables).collect()
    assert {r["fund_id"] for r in scores} == set(FUNDS) and all(0 <= r["score"] <= 100 for r in scores)


def test_plans_bought_before_month_starts(spark, series):
    """The rate of each plan that ends on the last day, bought at the last value up to each month start."""
    navs, index = series
    found = {r["fund_id"]: r for r in ALL["cf04_trailing_plans"](made(spark, navs, index)).collect()}
    for f in ("f0", "f5", "f12"):
        nav = navs[f]
        end, rates = nav.index[-1], []
        for k in range(8):
            start = (pd.Timestamp(end) - pd.DateOffset(months=12 + 3 * k)).date()
            if start < nav.index[0]:
                continue
            buys = [(d, nav[nav.index <= d].iloc[-1]) for d in pd.date_range(start, end, freq="MS").date]
            flows = [(d, -1.0) for d, _ in buys] + [(end, sum(1 / v for _, v in buys) * nav.iloc[-1])]
            lo, hi = -0.99, 10.0
            for _ in range(120):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(a / (1 + mid) ** ((d - start).days / 365.25) for d, a in flows) > 0 else (lo, mid)
            rates.append((lo + hi) / 2)
        want = (np.mean(rates), 1 / (1 + np.std(rates))) if len(rates) >= 3 else (0, 0)
        assert (found[f]["mean_x"], found[f]["steadiness"]) == pytest.approx(want, abs=2e-6)


def test_a_pillar_that_nobody_has_takes_no_part(spark, series):
    """Without holdings the weights of the other pillars make up the whole; with them, large assets cut the holdings pillar."""
    navs, index = series
    tables = made(spark, navs, index)
    model = ALL["e2e02_regime_pillars"]
    part = dataclasses.replace(model, sql="select fund_id, pillar, pw, s from pillar_scores")
    raw = dataclasses.replace(model, sql="select s.fund_id, s.score, c.by_days from model_scores s join (" + ALL["scr10_confidence_tables"].sql + ") c on c.fund_id = s.fund_id")
    pillars = part(tables).toPandas()
    assert pillars[pillars.pillar == "holdings"].s.isna().all()
    for r in raw(tables).collect():
        own = pillars[(pillars.fund_id == r["fund_id"]) & pillars.s.notna()]
        assert r["score"] == pytest.approx((own.pw * own.s).sum() / own.pw.sum() * r["by_days"], abs=1e-5)
    held = [(f, "Equity", "t", str(j), "s", 5.0 + j + i, 0.1 * i) for i, f in enumerate(FUNDS) for j in range(6)]
    with_them = tables | {"holding": spark.createDataFrame(held, tables["holding"].schema)}
    large = with_them | {"fund": tables["fund"].withColumn("aum", tables["fund"].aum * 0 + 70000.0)}
    small, cut = ({r["fund_id"]: r["s"] for r in part(x).collect() if r["pillar"] == "holdings"} for x in (with_them, large))
    assert cut["f0"] == pytest.approx(0.65 * small["f0"]) and cut["f12"] == small["f12"]

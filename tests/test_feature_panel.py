"""The sixteen features, learned weights and score of the adaptive model against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from navloom.operators import ALL
from navloom.plans.panel import FALLBACK, FEATURES

RF = 1.065 ** (1 / 52) - 1
FUNDS = ("a", "b", "c", "d", "e", "f")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    fridays = [dt.date(2014, 1, 3) + dt.timedelta(days=7 * i) for i in range(300)]
    market = rng.normal(0.001, 0.02, 300)
    index = pd.Series(100 * np.exp(np.cumsum(market)), index=fridays)
    navs = {k: pd.Series(100 * np.exp(np.cumsum(0.8 * market + rng.normal(0.0005 * i, 0.01, 300))), index=fridays) for i, k in enumerate(FUNDS)}
    navs["b"] = navs["b"].iloc[100:]
    navs["c"] = navs["c"].drop(fridays[40:43])
    nav = pd.concat([pd.DataFrame({"fund_id": k, "ts": s.index, "nav": s.to_numpy()}) for k, s in navs.items()])
    idx = pd.DataFrame({"index_id": "S", "ts": index.index, "nav": index.to_numpy()})
    fund = pd.DataFrame({"fund_id": list(navs), "name": "n", "sector": "S", "subsector": "s", "aum": 1.0})
    made = {"nav": spark.createDataFrame(nav, "fund_id string, ts date, nav double"), "index_nav": spark.createDataFrame(idx, "index_id string, ts date, nav double"), "fund": spark.createDataFrame(fund)}
    stamp = lambda s: pd.Series(s.to_numpy(), index=pd.to_datetime(s.index))
    return made, {k: stamp(s) for k, s in navs.items()}, stamp(index)


def rate(flows, times):
    lo, hi = -0.99, 5.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(a / (1 + mid) ** t for a, t in zip(flows, times, strict=True)) > 0 else (lo, mid)
    return (lo + hi) / 2


def plans(nav):
    monthly = nav.resample("D").ffill().resample("MS").first()
    out = {}
    for i in range(len(monthly) - 12):
        days = [(d - monthly.index[i]).days / 365.25 for d in monthly.index[i : i + 13]]
        out[monthly.index[i]] = rate([-1.0] * 12 + [(1 / monthly.iloc[i : i + 12]).sum() * monthly.iloc[i + 12]], days)
    return pd.Series(out)


def since(s, days):
    return s[s.index >= s.index[-1] - pd.Timedelta(days=days)]


def features(nav, bench, own, other):
    f = dict.fromkeys(FEATURES, np.nan)
    if len(own):
        f["sip_1y_median"], f["sip_1y_p20"] = own.median(), own.quantile(0.2)
    lead = (own - other).dropna()
    if len(lead) >= 6:
        f["sip_alpha_median"], f["sip_consistency"] = lead.median(), (lead > 1e-9).mean()
    for name, s in (("dd_depth", nav), ("bench_dd_depth", bench)):
        f[name] = s.iloc[-1] / since(s, 1095).max() - 1
    w = since(nav, 90)
    if len(w) >= 5 and (w.index[-1] - w.index[0]).days >= 45:
        f["recovery_slope"] = np.polyfit((w.index - w.index[0]).days, np.log(w), 1)[0] * 365.25
    w = since(nav, 180)
    f["late_mom_6m"] = w.iloc[-1] / w.iloc[0] - 1 if len(w) >= 5 else np.nan
    both = pd.concat([since(nav, 730).pct_change(), bench.pct_change()], axis=1, join="inner").dropna()
    x, y = both.iloc[:, 0], both.iloc[:, 1]
    if len(x) >= 20:
        f["up_capture_2y"] = x[y > 0].mean() / y[y > 0].mean() if (y > 0).sum() >= 5 else np.nan
        f["down_capture_2y"] = x[y < 0].mean() / y[y < 0].mean() if (y < 0).sum() >= 5 else np.nan
        f["info_ratio_2y"] = (x - y).mean() * 52 / ((x - y).std() * np.sqrt(52))
    for name, s in (("nav_trend_residual", nav), ("bench_trend_residual", bench)):
        w = since(s, 1826)
        if len(w) >= 30:
            t = (w.index - w.index[0]).days.to_numpy(float)
            e = np.log(w.to_numpy()) - np.polyval(np.polyfit(t, np.log(w.to_numpy()), 1), t)
            f[name] = e[-1] / e.std()
    w = since(nav, 1095)
    if len(w) >= 30:
        e = w.pct_change().dropna() - RF
        f["sortino_3y"] = e.mean() * 52 / (np.sqrt((e[e < 0] ** 2).mean()) * np.sqrt(52))
    for name, years in (("cagr_3y", 3), ("cagr_5y", 5)):
        w = since(nav, int(years * 365.25))
        span = (w.index[-1] - w.index[0]).days / 365.25
        f[name] = (w.iloc[-1] / w.iloc[0]) ** (1 / span) - 1 if span >= 0.85 * years else np.nan
    return f


@pytest.fixture(scope="module")
def reference(data):
    _, navs, index = data
    theirs, rows = plans(index), []
    for k, nav in navs.items():
        own = plans(nav)
        for t, y in own.items():
            if (nav.index <= t).sum() >= 30 and (index.index <= t).sum() >= 30:
                ended = t - pd.DateOffset(months=12)
                rows.append({"fund_id": k, "m": t, "y": y, **features(nav[nav.index <= t], index[index.index <= t], own[own.index <= ended], theirs[theirs.index <= ended])})
    now = {k: features(nav, index, plans(nav), theirs) for k, nav in navs.items()}
    return pd.DataFrame(rows), pd.DataFrame(now).T


def test_panel_as_pandas(data, reference):
    got = ALL["lb01_feature_panel"](data[0]).toPandas()
    got["m"] = pd.to_datetime(got.as_of_month)
    both = reference[0].merge(got, on=["fund_id", "m"], suffixes=("", "_got"), how="outer", indicator=True)
    assert (both._merge == "both").all() and len(both) > 200
    for c in ("y", *FEATURES):
        assert np.allclose(both[c], both[f"{c}_got"], atol=2e-6, equal_nan=True), c


def test_learned_weights_and_score_as_pandas(data, reference):
    panel, now = reference
    weights, signs = {}, {}
    for c, prior in FEATURES.items():
        sub = panel[["m", c, "y"]].dropna()
        sub = sub[sub.groupby("m")[c].transform("size") >= 5]
        if len(sub) < 50:
            continue
        rho = sub.groupby("m")[c].rank(pct=True).corr(sub.groupby("m").y.rank(pct=True))
        if pd.isna(rho):
            continue
        if prior and (rho * prior >= 0 or abs(rho) < 0.05):
            weights[c], signs[c] = max(abs(rho), 0.05), prior
        elif not prior and abs(rho) >= 0.05:
            weights[c], signs[c] = abs(rho), 1 if rho >= 0 else -1
    assert weights
    total = sum(weights.values())
    got = {r["metric"]: r for r in ALL["lb04_feature_weights"](data[0]).collect()}
    assert {c for c, r in got.items() if r["weight"] > 0} == set(weights)
    assert all(got[c]["weight"] == pytest.approx(w / total, abs=2e-6) and got[c]["sign"] == signs[c] for c, w in weights.items())
    z = (now[list(weights)].astype(float) - now[list(weights)].astype(float).mean()) / now[list(weights)].astype(float).std()
    w = pd.Series({c: v / total for c, v in weights.items()})
    raw = (z * w * pd.Series(signs)).sum(axis=1) / (z.notna() * w).sum(axis=1)
    score = raw.rank(pct=True) * 100
    days = {k: (s.index[-1] - s.index[0]).days + 1 for k, s in data[1].items()}
    want = {k: round(v * (0.85 if days[k] < 1095 else 1), 2) for k, v in score.items()}
    mine = {r["fund_id"]: r["score"] for r in ALL["e2e01_adaptive_plan"](data[0]).collect()}
    assert mine == pytest.approx(want, abs=0.011)


def test_nothing_learned_falls_back(spark, data):
    one = {k: df.where("fund_id = 'a'") if "fund_id" in df.columns else df for k, df in data[0].items()}
    rows = {r["metric"]: r for r in ALL["lb04_feature_weights"](one).collect()}
    assert {m for m, r in rows.items() if r["weight"] > 0} == set(FALLBACK) and all(rows[m]["weight"] == 0.2 and rows[m]["status"] == "fallback" for m in FALLBACK)

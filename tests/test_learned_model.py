"""The learned small-cap model against pandas: features as of months and today, weights, capped blends."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from navloom.operators import ALL
from navloom.plans.learned import PRIORS
from navloom.plans.text import written

FUNDS = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    fridays = [dt.date(2013, 1, 4) + dt.timedelta(days=7 * i) for i in range(330)]
    market = rng.normal(0.001, 0.025, 330)
    index = pd.Series(100 * np.exp(np.cumsum(market)), index=pd.to_datetime(fridays))
    navs = {f: pd.Series(100 * np.exp(np.cumsum(0.9 * market + rng.normal(0.0004 * i, 0.008, 330))), index=index.index) for i, f in enumerate(FUNDS)}
    navs["f1"] = navs["f1"].drop(index.index[50:53])
    navs["f2"] = navs["f2"].iloc[60:]
    aum = {f: 100.0 * 4**i for i, f in enumerate(FUNDS)} | {"f5": None}
    nav = pd.concat([pd.DataFrame({"fund_id": k, "ts": s.index.date, "nav": s.to_numpy()}) for k, s in navs.items()])
    made = {
        "nav": spark.createDataFrame(nav, "fund_id string, ts date, nav double"),
        "index_nav": spark.createDataFrame(pd.DataFrame({"index_id": "S", "ts": index.index.date, "nav": index.to_numpy()}), "index_id string, ts date, nav double"),
        "fund": spark.createDataFrame([(f, "n", "S", "s", aum[f]) for f in navs], "fund_id string, name string, sector string, subsector string, aum double"),
    }
    return made, navs, index, aum


def months(s):
    return s.resample("D").ffill().resample("MS").first().dropna()


def rate(m, i):
    """Rate of return of twelve monthly purchases from the i-th month on."""
    w = m.iloc[i : i + 13]
    if len(w) < 13:
        return np.nan
    t = (w.index - w.index[0]).days.to_numpy() / 365.25
    a = np.append(-np.ones(12), (1 / w.iloc[:12]).sum() * w.iloc[12])
    lo, hi = -0.99, 5.0
    for _ in range(90):
        lo, hi = ((lo + hi) / 2, hi) if (a / (1 + (lo + hi) / 2) ** t).sum() > 0 else (lo, (lo + hi) / 2)
    return (lo + hi) / 2


def known_mean(*values):
    values = [v for v in values if not np.isnan(v)]
    return np.mean(values) if values else np.nan


def features(nav, bench, room):
    """The eleven features from series that end at the as-of day; None under 52 shared weeks."""
    both = pd.concat([s.resample("W-FRI").last() for s in (nav, bench)], axis=1, join="inner").dropna()
    if len(both) < 52:
        return None
    f, b = both.iloc[:, 0], both.iloc[:, 1]
    r, q = f.pct_change().dropna(), b.pct_change().dropna()
    change = lambda s, k: s.iloc[-1] / s.iloc[-k - 1] - 1 if len(s) > k else np.nan
    vol = lambda k: r.tail(k).std(ddof=0) * np.sqrt(52)
    r2, q2 = r.tail(104), q.tail(104)
    side = lambda m: r2[m].mean() / q2[m].mean() if m.sum() >= 4 else np.nan
    up, down = side(q2 > 0), side(q2 < 0)
    rolling = (r2 - q2).rolling(13).sum().dropna()
    fall = lambda s: (s / s.cummax() - 1).min()
    t = b.tail(78).idxmin()
    after_f, after_b = f[f.index >= t], b[b.index >= t]
    r3, q3, b3 = r.tail(156), q.tail(156), b.iloc[1:].tail(156)
    hit = ((b3 / b3.cummax() - 1).shift(1) < -0.08) & (q3 > 0.015)
    growth = lambda k: (f.iloc[-1] / f.iloc[-k - 1]) ** (52 / k) - 1
    g3, g5 = growth(min(156, len(f) - 1)), growth(min(260, len(f) - 1))
    fm, bm = months(nav), months(bench)
    pairs = [(rate(fm, i), rate(bm, bm.index.get_loc(m))) for i, m in enumerate(fm.index) if m in bm.index]
    pairs = [(x, y) for x, y in pairs if not np.isnan(x + y)]
    losses = r2[r2 < 0]
    return {
        "sip_hit_rate": np.mean([round(x, 9) > round(y, 9) for x, y in pairs]) if pairs else np.nan,
        "alpha_consistency": (rolling > 0).mean() if len(r2) >= 26 else np.nan,
        "momentum_quality": known_mean(change(f, 13), change(f, 26), change(f, 52), change(f, 26) - change(b, 26)) / vol(52),
        "recovery_strength": after_f.iloc[-1] / after_f.iloc[0] - after_b.iloc[-1] / after_b.iloc[0] if len(after_f) >= 8 else np.nan,
        "swing_participation": np.nan if len(r) < 52 else r3[hit].mean() / q3[hit].mean() if hit.sum() >= 4 else up,
        "drawdown_control": known_mean(fall(f.tail(52)), fall(f.tail(156)), f.iloc[-1] / f.tail(156).max() - 1),
        "downside_resilience": known_mean(-np.sqrt((losses**2).mean()) * np.sqrt(52), -down),
        "vol_normalization": -vol(13) / vol(52),
        "upside_capture": up,
        "cagr_stability": g3 - abs(g3 - g5),
        "aum_liquidity_score": room,
    }


def room_of(aum):
    logs = pd.Series({f: np.log1p(a) for f, a in aum.items() if a is not None})
    q05, q25, q75, q95 = logs.quantile([0.05, 0.25, 0.75, 0.95])
    out = {f: min(max(1 - 0.15 * min(max((q25 - x) / (q25 - q05), 0), 1) - 0.25 * min(max((x - q75) / (q95 - q75), 0), 1), 0.55), 1) for f, x in logs.items()}
    return {f: out.get(f, 0.7) for f in aum}


def test_panel_and_weights_as_pandas(spark, data):
    made, navs, index, aum = data
    room, bm = room_of(aum), months(index)
    rows = []
    for f, nav in navs.items():
        fm = months(nav)
        shared = [m for m in fm.index if m in bm.index]
        for i in range(24, len(shared) - 12, 2):
            m = shared[i]
            own = features(nav[nav.index <= m], index[index.index <= m], room[f])
            if own:
                y = rate(fm, fm.index.get_loc(m))
                rows.append({"fund": f, "k": 12 * m.year + m.month, **own, "y": y, "lead_y": y - rate(bm, bm.index.get_loc(m))})
    want = pd.DataFrame(rows).set_index(["fund", "k"])
    found = ALL["lb01_small_cap_panel"](made).toPandas()
    found["k"] = found.fund_id.str.split("@").str[1].astype(int)
    found = found.set_index(["fund", "k"]).loc[want.index]
    assert len(found) == len(want) == ALL["lb01_small_cap_panel"](made).count()
    for c in [*PRIORS, "y", "lead_y"]:
        np.testing.assert_allclose(found[c].astype(float), want[c], atol=3e-6, err_msg=c)
    learned = {}
    for c in PRIORS:
        pair = pd.DataFrame({"x": want[c].round(9), "y": want.lead_y.round(9)}).dropna()
        rho = pair.x.rank().corr(pair.y.rank())
        if len(pair) >= 60 and rho > 0.03:
            learned[c] = rho
    prior = {c: w / sum(PRIORS.values()) for c, w in PRIORS.items()}
    weights = prior
    if len(learned) >= 4:
        blend = pd.Series({c: 0.6 * learned.get(c, 0) / sum(learned.values()) + 0.4 * w for c, w in prior.items()})
        capped = (blend / blend.sum()).clip(upper=0.22)
        room_left = 0.22 - capped
        capped = capped + max(1 - capped.sum(), 0) * room_left / room_left.sum()
        weights = (capped / capped.sum()).to_dict()
    got = {r["metric"]: r["weight"] for r in ALL["lb05_small_cap_weights"](made).collect()}
    assert got.keys() == weights.keys()
    for c, w in weights.items():
        assert got[c] == pytest.approx(w, abs=2e-6), c


def test_scores_rank_and_stay_in_range(spark, data):
    made = data[0]
    rows = sorted(ALL["e2e05_small_cap"](made).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, 7)) and {r["fund_id"] for r in rows} == set(FUNDS)
    assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:], strict=False)) and all(0 <= r["score"] <= 100 for r in rows)


@pytest.mark.parametrize(("cap", "passes"), [(0.22, 1), (0.14, 10), (0.4, 10)])
def test_capped_blends_in_both_dialects(spark, cap, passes):
    """Ten passes fill up to the cap as in a loop over numpy arrays; Spark and DuckDB agree."""
    rng = np.random.default_rng(3)
    for n in (11, 20, 2):
        w = rng.dirichlet(np.full(n, 0.4))
        want = np.clip(w, 0, cap)
        for _ in range(passes):
            gap, left = 1 - want.sum(), np.clip(cap - want, 0, None)
            if abs(gap) < 1e-9 or left.sum() <= 1e-12:
                break
            want = np.clip(want + gap * left / left.sum(), 0, cap)
        values = ", ".join(f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x)) for x in w)
        text = f"select [[capped|w|{cap}|{passes}]] as c from "
        got = spark.sql(written(text, "spark") + f"(select array({values.replace('e0', 'D')}) as w)").first()["c"]
        duck = duckdb.sql(written(text, "duckdb") + f"(select [{values}]::double[] as w)").fetchall()[0][0]
        np.testing.assert_allclose(got, want, atol=1e-12)
        np.testing.assert_allclose(duck, want, atol=1e-12)

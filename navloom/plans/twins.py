"""DuckDB SQL of fund queries written apart from the operators: series are lists, and measures are computed on these lists.

Only the tables of the data model are shared with the operators. Each text follows the definition of the measure: no window
functions over rows, no shared steps. A week runs from Saturday to Friday and is labelled by its Friday.
"""

from __future__ import annotations

from navloom.plans.fixtures import INPUTS
from navloom.plans.text import written

_TABLES = {k: f"({written(v, 'duckdb')})" for k, v in INPUTS.items()}
_FRIDAY = "(date_trunc('week', ts + interval 2 day) + interval 4 day)::date"
#: Series as lists: weekly values and days of funds (v, k) and indices, daily ones (x, t), aligned weekly returns (f, b, k).
_SERIES = {
    "fund": "select * from {fund}",
    "weeks": f"select fund_id, list(v order by k) as v, list(k order by k) as k from (select fund_id, {_FRIDAY} as k, arg_max(nav, ts) as v from {{nav}} where nav > 0 group by 1, 2) group by 1",
    "iweeks": f"select index_id, list(v order by k) as v, list(k order by k) as k from (select index_id, {_FRIDAY} as k, arg_max(nav, ts) as v from {{index_nav}} where nav > 0 group by 1, 2) group by 1",
    "days": "select fund_id, list(nav order by ts) as x, list(ts order by ts) as t from {nav} where nav > 0 group by 1",
    "rets": "select fund_id, v, k, [v[i] / v[i - 1] - 1 for i in range(2, len(v) + 1)] as r from weeks",
    "falls": "select fund_id, v, k, [v[i] / list_max(v[1:i]) - 1 for i in range(1, len(v) + 1)] as d from weeks",
    "fpairs": "select fund_id, unnest(k[2:]) as k, unnest(r) as r from rets",
    "ipairs": "select index_id, unnest(k[2:]) as k, unnest([v[i] / v[i - 1] - 1 for i in range(2, len(v) + 1)]) as r from iweeks",
    "joint": "select p.fund_id, list(p.r order by p.k) as f, list(q.r order by p.k) as b, list(p.k order by p.k) as k from fpairs p join fund on fund.fund_id = p.fund_id join ipairs q on q.index_id = fund.sector and q.k = p.k group by 1",
    "filled": "select fund_id, [x[len(list_filter(t, lambda e: e <= o))] for o in generate_series(t[1], t[-1], interval 1 day)] as x from days",
}
_NEEDS = {"rets": ["weeks"], "falls": ["weeks"], "fpairs": ["weeks", "rets"], "ipairs": ["iweeks"], "joint": ["fund", "weeks", "iweeks", "rets", "fpairs", "ipairs"]}
RF = "(pow(1.065, 1.0::double / 52) - 1)"


def _query(*series: str):
    """A function that puts series before a text."""
    names = list(dict.fromkeys(x for s in series for x in [*_NEEDS.get(s, []), s]))

    def made(text: str) -> str:
        series = ", ".join(f"{n} as ({_SERIES[n].format(**_TABLES)})" for n in names)
        return f"with {series}{'' if text.startswith(',') else ' '}{text.format(**_TABLES)}"

    return made


def agg(name: str, values: str) -> str:
    return f"list_aggregate({values}, '{name}')"


def mean(values: str) -> str:
    return agg("avg", values)


def std(values: str) -> str:
    return agg("stddev_samp", values)


def where(values: str, test: str, value: str = "e") -> str:
    """Values e of a list that pass a test."""
    return f"[{value} for e in {values} if {test}]"


def pairs(test: str, value: str, f: str = "f", b: str = "b") -> str:
    """Values over aligned returns: f[i] and b[i] stand for the two."""
    return f"[{value} for i in range(1, len({f}) + 1) if {test}]"


def product_sum(a: str, b: str) -> str:
    """Sum of products of the distances of two lists from their means."""
    return f"list_sum([({a}[i] - {mean(a)}) * ({b}[i] - {mean(b)}) for i in range(1, len({a}) + 1)])"


def slope(y: str, x: str) -> str:
    return f"({product_sum(y, x)} / {product_sum(x, x)})"


def alpha(f: str, b: str) -> str:
    return f"(52 * ({mean(f)} - {RF} - {slope(f, b)} * ({mean(b)} - {RF})))"


def above(x: str) -> str:
    """x, null where its size is next to nothing."""
    return f"case when abs({x}) > 1e-12 then {x} end"


def quantile(ordered: str, q: float) -> str:
    """Linear quantile of an ordered list."""
    place = f"({q} * (len({ordered}) - 1))"
    low, high = f"{ordered}[1 + floor({place})::int]", f"{ordered}[1 + ceil({place})::int]"
    return f"({low} + ({place} - floor({place})) * ({high} - {low}))"


def _plan_rates(text: str) -> str:
    """A text over rates (fund_id, m, x): rates of return of all 12-month plans, by halving the bracket eighty times."""
    value = "list_sum([case when j < 13 then -1.0 else z end / pow(1 + (lo + hi) / 2, (ms[j] - ms[1]) / 365.25) for j in range(1, 14)])"
    return _query("days", "filled")(
        f"""
        , months as (select f.fund_id, list(f.x[1 + greatest(0, m - d.t[1])] order by m) as mv, list(greatest(m, date_trunc('month', m)::date) order by m) as mm
                     from filled f join days d on d.fund_id = f.fund_id, lateral (select unnest(generate_series(date_trunc('month', d.t[1]), d.t[-1], interval 1 month))::date as m) g group by f.fund_id),
        begun as (select fund_id, mm[i] as m, mm[i:i + 12] as ms, list_sum([1 / e for e in mv[i:i + 11]]) * mv[i + 12] as z from months, lateral (select unnest(range(1, len(mv) - 11)) as i) h),
        halved as (select 0 as step, fund_id, m, ms, z, -0.99::double as lo, 5.0::double as hi from begun
                   union all select step + 1, fund_id, m, ms, z, case when {value} > 0 then (lo + hi) / 2 else lo end, case when {value} > 0 then hi else (lo + hi) / 2 end from halved where step < 60),
        rates as (select fund_id, m, (lo + hi) / 2 as x from halved where step = 60)
        """.strip()
        + " "
        + text
    ).replace("with ", "with recursive ", 1)


def _measures(text: str) -> str:
    """A text over measured (fund_id, sector, metric, w, x): five measures of each fund, more is better."""
    return _query("joint", "falls")(
        f"""
        , measured as (
          select fund.fund_id, fund.sector, m.metric, m.w, case m.metric when 'cagr' then {_CAGR3} when 'vol' then -({std('r.r')} * sqrt(52)) when 'mdd' then list_min(d)
                   when 'alpha' then case when len(f) >= 20 then {alpha('f', 'b')} end else case when len(f) >= 12 then {mean('[f[i] - b[i] for i in range(1, len(f) + 1)]')} / {above(std('[f[i] - b[i] for i in range(1, len(f) + 1)]'))} * sqrt(52) end end as x
          from fund join falls l on l.fund_id = fund.fund_id join rets r on r.fund_id = fund.fund_id left join joint j on j.fund_id = fund.fund_id,
               (values ('cagr', 0.3), ('vol', 0.15), ('mdd', 0.15), ('alpha', 0.25), ('ir', 0.15)) m(metric, w))
        """.strip().replace("v[-", "l.v[-")
        + " "
        + text
    )


#: Compounded aligned returns, the benchmark's fall from its peak, and the active returns.
_GROWN = (
    ", grown as (select *, [(cb[i] - list_max(cb[1:i])) / (list_max(cb[1:i]) + 1e-9) for i in range(1, len(cb) + 1)] as g from "
    "(select fund_id, [f[i] - b[i] for i in range(1, len(f) + 1)] as a, [list_product([1 + e for e in f[1:i]]) - 1 for i in range(1, len(f) + 1)] as cf, "
    "[list_product([1 + e for e in b[1:i]]) - 1 for i in range(1, len(b) + 1)] as cb from joint))"
)
_W, _R, _D, _B, _T = _query("weeks"), _query("rets"), _query("falls"), _query("joint"), _query("days")
_CAGR3 = "pow(v[-1] / v[-157], 1.0::double / 3) - 1"
_DOWN = f"sqrt({mean(where('r', f'e < {RF}', f'(e - {RF}) * (e - {RF})'))}) * sqrt(52)"
_AT = "x[len(list_filter(t, lambda e: e <= t[-1] - {0}))]"
_BLOCKS = "select fund_id, j, f[len(f) - 26 * j - 25 : len(f) - 26 * j] as f, b[len(b) - 26 * j - 25 : len(b) - 26 * j] as b from joint, range(0, 10) g(j) where len(f) >= 26 * j + 26"


def _capture(kind: str, n: str = "len(f)") -> str:
    test = f"b[i] {'>' if kind == 'up' else '<'} 0 and i > len(f) - {n}"
    return f"{mean(pairs(test, 'f[i]'))} / {above(mean(pairs(test, 'b[i]')))}"


SQL = {
    "rt01_period_return": _W("select fund_id, " + ", ".join(f"round(v[-1] / v[-1 - {n}] - 1, 8) as r{n}" for n in (4, 13, 26, 52)) + " from weeks"),
    "rt02_cagr_periods": _W(f"select fund_id, round(v[-1] / v[-53] - 1, 8) as cagr_1y, round({_CAGR3}, 8) as cagr_3y, round(pow(v[-1] / v[-261], 0.2::double) - 1, 8) as cagr_5y from weeks"),
    "rt03_cagr_calendar": _T("select fund_id, round(case when t[-1] - s >= 0.85 * 3 * 365.25 then pow(x[-1] / list_extract(x, list_position(t, s)), 365.25 / (t[-1] - s)) - 1 end, 8) as cagr from (select *, list_min(list_filter(t, lambda e: e >= t[-1] - 1095)) as s from days)"),
    "rt04_cagr_whole": _T("select fund_id, t[-1] - t[1] as days, round(case when t[-1] - t[1] >= 365 then pow(x[-1] / x[1], 365.25 / (t[-1] - t[1])) - 1 end, 8) as cagr from days"),
    "rt05_trailing_return": _T("select fund_id, " + ", ".join(f"round(100 * (x[-1] / {_AT.format(d)} - 1), 2) as ret_{y}y" for y, d in ((1, 365), (3, 1095), (5, 1826))) + " from days"),
    "rt06_first_date": _T("select fund_id, strftime(t[1], '%Y-%m-%d') as first_date from days"),
    "rt07_momentum_180d": _T("select fund_id, round(case when len(w) >= 5 then x[-1] / x[-len(w)] - 1 end, 8) as momentum from (select *, list_filter(t, lambda e: e >= t[-1] - 180) as w from days)"),
    "rt08_momentum_less_overextension": _W(f"select fund_id, round(case when len(v) < 60 then 0 else 0.3 * (v[-1] / v[-14] - 1) + 0.4 * (v[-1] / v[-27] - 1) + 0.3 * (v[-1] / v[-53] - 1) - 2 * greatest(0, v[-1] / {mean('v[-40:]')} - 1.08) end, 6) as quality from weeks"),
    "rt10_acceleration": _R(f"select fund_id, round(case when len(r) >= 26 then {mean('r[-8:]')} - {mean('r[-26:]')} end, 10) as acceleration from rets"),
    "rt11_overheat": _D("select fund_id, round(v[-1] / v[-14] - 1, 8) as r13, round(v[-1] / v[-27] - 1, 8) as r26, round(greatest(0, d[-1] + 0.015), 8) as overheat from falls"),
    "rt12_cagr_stability": _W("select fund_id, round(a - abs(a - b), 8) as stability from (select fund_id, pow(v[-1] / v[-1 - h3], 52.0::double / nullif(h3, 0)) - 1 as a, pow(v[-1] / v[-1 - h5], 52.0::double / nullif(h5, 0)) - 1 as b from (select *, least(156, len(v) - 1) as h3, least(260, len(v) - 1) as h5 from weeks))"),
    "rt13_vol_drag": _R(f"select fund_id, round(52 * {mean('r')} - 26 * {agg('var_samp', 'r')}, 8) as adjusted from rets"),
    "rk01_volatility": _R(f"select fund_id, round({std('r')} * sqrt(52), 8) as vol, round({agg('stddev_pop', 'r')} * sqrt(52), 8) as vol_pop, round({std('r[-13:]')} * sqrt(52), 8) as vol_13, round({std('r[-52:]')} * sqrt(52), 8) as vol_52 from rets"),
    "rk02_downside_deviation": _R(f"select fund_id, round(coalesce(sqrt({mean(where('r', 'e < 0', 'e * e'))}), 0) * sqrt(52), 8) as down_zero, round(coalesce({_DOWN}, 0), 8) as down_rf from rets"),
    "rk03_max_drawdown": _query("falls", "days", "filled")("select w.fund_id, round(list_min(d), 8) as weekly, round(list_min([f.x[i] / list_max(f.x[1:i]) - 1 for i in range(1, len(f.x) + 1)]), 8) as daily_dd, round(list_min([l[i] / list_max(l[1:i]) - 1 for i in range(1, len(l) + 1)]), 8) as last_156 from (select *, v[-156:] as l from falls) w join filled f on f.fund_id = w.fund_id"),
    "rk04_current_drawdown": _T("select fund_id, round(x[-1] / list_max(x) - 1, 8) as current_dd, round(x[-1] / list_max(x[-len(list_filter(t, lambda e: e >= t[-1] - 1095)):]) - 1, 8) as current_dd_3y from days"),
    "rk05_ulcer": _query("days", "filled")(f"select fund_id, round(sqrt({mean('[10000 * pow(x[i] / list_max(x[1:i]) - 1, 2) for i in range(1, len(x) + 1)]')}), 6) as ulcer from filled"),
    "rk06_pain": _D(f"select fund_id, round({mean('d')}, 8) as pain, round(least(coalesce(-{mean('[e for e in [(v[i] - list_max(v[1:i])) / v[1] for i in range(1, len(v) + 1)] if e < 0]')}, 0), 0.5), 8) as pain_fall from falls"),
    "rk07_cdar": _D(f"select fund_id, round({mean('s[1:greatest(2, ceil(0.05 * len(s)))::int]')}, 8) as cdar_two, round({mean('s[1:greatest(1, ceil(0.05 * len(s)))::int]')}, 8) as cdar_one, round({mean(where('s', 'e <= q'))}, 8) as cdar_q from (select *, list_sort(d) as s, list_sort(d)[1 + floor(0.05 * (len(d) - 1))::int] + (0.05 * (len(d) - 1) - floor(0.05 * (len(d) - 1))) * (list_sort(d)[2 + floor(0.05 * (len(d) - 1))::int] - list_sort(d)[1 + floor(0.05 * (len(d) - 1))::int]) + 1e-15 as q from falls)"),
    "rk08_cvar": _R(f"select fund_id, round(q, 8) as var_5, round({mean(where('r', 'e <= q'))}, 8) as cvar_5 from (select *, list_sort(r)[1 + floor(0.05 * (len(r) - 1))::int] + (0.05 * (len(r) - 1) - floor(0.05 * (len(r) - 1))) * (list_sort(r)[2 + floor(0.05 * (len(r) - 1))::int] - list_sort(r)[1 + floor(0.05 * (len(r) - 1))::int]) as q from rets)"),
    "rk09_sharpe": _R(f"select fund_id, round(({_CAGR3} - 0.065) / {above(f'({std("r")} * sqrt(52))')}, 6) as sharpe from rets"),
    "rk10_sortino": _R(f"select fund_id, round(52 * ({mean('r')} - {RF}) / {above(f'({_DOWN})')}, 6) as arithmetic, round((pow(1 + {mean('r')}, 52) - 1.065) / {above(f'({_DOWN})')}, 6) as geometric, round(({_CAGR3} - 0.065) / {above(f'({_DOWN})')}, 6) as growth from rets"),
    "rk11_omega": _R(f"select fund_id, round(list_sum({where('r', f'e > {RF}', f'e - {RF}')}) / {above(f'list_sum({where("r", f"e < {RF}", f"{RF} - e")})')}, 6) as omega, round(case when len(r) >= 20 then coalesce(list_sum({where('r', 'e > 0')}) / list_sum({where('r', 'e < 0', '-e')}), 10) end, 6) as omega_zero from rets"),
    "rk12_upside_potential": _R(f"select fund_id, round(case when len(r) >= 20 then case when len({where('r', 'e < 0')}) = 0 then 5 else sqrt({mean(where('r', 'e > 0', 'e * e'))}) / sqrt({mean(where('r', 'e < 0', 'e * e'))}) end end, 6) as upside from rets"),
    "rk13_calmar": _D(f"select fund_id, round(({_CAGR3}) / {above('(-list_min(d))')}, 6) as calmar from falls"),
    "rk14_ulcer_performance": _D(f"select fund_id, round(({_CAGR3} - 0.065) * 100 / {above(f'(100 * sqrt({mean("[e * e for e in d]")}))')}, 6) as upi from falls"),
    "rk15_gain_to_pain": _R(f"select fund_id, round(case when list_sum({where('r', 'e < 0')}) < -1e-12 then least(10, list_sum(r) / -list_sum({where('r', 'e < 0')})) end, 6) as gain_to_pain from rets"),
    "rk17_skew": _R(f"select fund_id, round(case when len(r) >= 30 then sqrt(len(r) * (len(r) - 1.0)) / (len(r) - 2) * {mean(f'[pow(e - {mean("r")}, 3) for e in r]')} / pow({mean(f'[pow(e - {mean("r")}, 2) for e in r]')}, 1.5) end, 6) as skew, round({std(where('r', 'e < 0'))} / {std(where('r', 'e > 0'))}, 6) as down_up from rets"),
    "rk18_vol_contraction": _R(f"select fund_id, round(case when len(r) >= 52 then {std('r[-13:]')} / {std('r[-52:]')} end, 6) as contraction from rets"),
    "rk19_hurst": _W(f"select fund_id, round({slope('[ln(e.s) for e in p]', '[ln(e.l) for e in p]')}, 6) as hurst from (select fund_id, list({{{{'l': l, 's': s}}}} order by l) as p from (select fund_id, l, {agg('stddev_pop', '[ln(v[i + l]) - ln(v[i]) for i in range(1, len(v) - l + 1)]')} as s from weeks, range(2, 20) g(l)) where s > 1e-12 group by 1)"),
    "rk20_autocorrelation": _R(f"select fund_id, round({product_sum('a', 'p')} / sqrt({product_sum('a', 'a')} * {product_sum('p', 'p')}), 6) as lag1 from (select fund_id, r[2:] as a, r[1:len(r) - 1] as p from rets) where len(a) >= 10"),
    "rk21_recovery_half_life": _D("select fund_id, round(case when list_min(d) >= -0.05 then null else coalesce((k[h[1]] - k[low]) / 7.0, len(d) - low + 1) end, 4) as half_life from (select *, [i for i in range(low, len(d) + 1) if d[i] >= d[low] / 2] as h from (select *, list_position(d, list_min(d)) as low from falls where len(v) >= 30))"),
    "rk21_recovery_rows": _D("select fund_id, round(case when low = len(d) then null when d[low] >= -0.005 then 1 else coalesce(greatest(1, h[1] - low), len(d) - low) end, 4)::double as half_life from (select *, [i for i in range(low + 1, len(d) + 1) if d[i] >= d[low] / 2] as h from (select *, list_position(d, list_min(d)) as low from falls where len(v) >= 20))"),
    "rk22_recovery_to_peak": _D("select fund_id, round(coalesce((k[h[1]] - k[low]) / 7.0, len(d) - low + 1), 4)::double as weeks from (select *, [i for i in range(low, len(d) + 1) if v[i] >= 0.995 * list_max(v[1:low])] as h from (select *, list_position(d, list_min(d)) as low from falls where len(v) >= 2))"),
    "rk24_trend_slope_90d": _T(f"select fund_id, round(case when s[-1] - s[1] >= 45 then {slope('y', 's')} * 365.25 end, 4) as slope from (select fund_id, [ln(e) for e in x[-len(w):]] as y, [(e - date '1995-01-01')::double for e in w] as s from (select *, list_filter(t, lambda e: e >= t[-1] - 90) as w from days))"),
    "rk25_trend_residual": _T(f"select fund_id, round((y[-1] - ({mean('y')} + g * (s[-1] - {mean('s')}))) / {above(agg('stddev_pop', '[y[i] - g * s[i] for i in range(1, len(y) + 1)]'))}, 5) as residual from (select *, {slope('y', 's')} as g from (select fund_id, [ln(e) for e in x[-len(w):]] as y, [(e - t[1])::double for e in w] as s from (select *, list_filter(t, lambda e: e >= t[-1] - 1826) as w from days))) where len(y) >= 20"),
    "rk26_tactical_noise": _R(f"select fund_id, round(least(greatest({agg('stddev_pop', f'[r[i] - {mean("r[greatest(1, i - 3):i]")} for i in range(1, len(r) + 1)]')}, 0), 0.05), 8) as noise from rets"),
    "bm01_alpha_beta": _B(f"select fund_id, round(case when len(f) >= 20 then {alpha('f', 'b')} end, 8) as alpha, round(case when len(f) >= 20 then {slope('f', 'b')} end, 8) as beta from joint"),
    "bm02_information_ratio": _B(f"select fund_id, round(case when len(a) >= 12 then {mean('a')} / {above(std('a'))} * sqrt(52) end, 8) as ir from (select fund_id, [f[i] - b[i] for i in range(1, len(f) + 1)] as a from joint)"),
    "bm03_active_skill": _B(f"select fund_id, round(te, 8) as te, round(least(greatest(al, -0.2), 0.3) * least(te, 0.4), 8) as skill from (select fund_id, {std('[f[i] - b[i] for i in range(1, len(f) + 1)]')} * sqrt(52) as te, {alpha('f', 'b')} as al from joint)"),
    "bm04_capture_means": _B(f"select fund_id, round({_capture('up')}, 8) as up_all, round({_capture('down')}, 8) as down_all, round({_capture('up', '52')}, 8) as up_52, round({_capture('down', '52')}, 8) as down_52 from joint where len(f) >= 12"),
    "bm05_capture_sums": _B("select fund_id, " + ", ".join(f"round(case when len({pairs(t, 'b[i]')}) >= 4 then list_sum({pairs(t, 'f[i]')}) / list_sum({pairs(t, 'b[i]')}) end, 8) as {n}_capture" for t, n in (("b[i] > 0", "up"), ("b[i] < 0", "down"))) + " from joint where len(f) >= 12"),
    "bm08_swing": _B(f"select fund_id, round({_capture('up')} - {_capture('down')}, 8) as elasticity, round({mean(pairs('b[i] > 0', 'f[i] - b[i]'))} - {mean(pairs('b[i] < 0', 'f[i] - b[i]'))}, 10) as swing from joint"),
    "bm09_alpha_consistency": _B(f"select fund_id, round({mean('[case when list_sum(a[i - 25:i]) > 0 then 1.0 else 0.0 end for i in range(26, len(a) + 1)]')}, 8) as consistency from (select fund_id, [f[i] - b[i] for i in range(1, len(f) + 1)] as a from joint) where len(a) >= 30"),
    "bm15_rebound_resilience": _B(f"select fund_id, round({mean(pairs('b[i] > 0 and i > len(f) - 26', 'f[i] - b[i]'))}, 10) as rebound, round(1 - {_capture('down')}, 8) as resilience from joint"),
    "bm17_vol_adjusted_alpha": _B(f"select fund_id, round({mean('a')} / ({agg('stddev_pop', 'a')} + 1e-6), 6) as ratio from (select fund_id, [f[i] - b[i] for i in range(1, len(f) + 1)] as a from joint)"),
    "bm19_block_alphas": _B(f"select fund_id, j::int as block, round({alpha('f', 'b')}, 6) as alpha from ({_BLOCKS}) x"),
    "bm20_block_stability": _B(f"select fund_id, round({mean('a')} / (1.02 + {std('a')}), 6) as stability, len(a) as n_blocks from (select fund_id, list({alpha('f', 'b')}) as a from ({_BLOCKS}) x group by 1) where len(a) >= 3"),
    "bm21_rolling_alphas": _B(f"select fund_id, len(a) as n_windows, round({mean('a')}, 6) as mean_alpha, round({mean('[case when e > 0 then 1.0 else 0.0 end for e in a]')}, 6) as share_positive from (select fund_id, list(al) as a from (select fund_id, {alpha('f', 'b')} as al from (select fund_id, f[len(f) - 4 * j - 51 : len(f) - 4 * j] as f, b[len(b) - 4 * j - 51 : len(b) - 4 * j] as b from joint, range(0, 30) g(j) where len(f) >= 4 * j + 52) x) y where abs(al) < 1 group by 1) z where len(a) >= 3"),
    "hd01_concentration": "select fund_id, " + ", ".join(f"round(list_sum(l[1:{n}]), 2) as top_{n}" for n in (5, 10, 20)) + f" from (select fund_id, list_reverse_sort(list(latest)) as l from {_TABLES['holding']} h where latest > 0 group by 1)",
    "hd03_conviction": f"select f.fund_id, coalesce(len(l), 0) as n_holdings, round(case when l is null or len(l) < 5 or list_sum(l) <= 0 then 0.5 else least(greatest((1 - len(l) / 200.0) * 0.6 + (list_sum(list_reverse_sort(l)[1:10]) / list_sum(l) - 0.4) * 0.8, 0), 1) end, 4) as conviction from {_TABLES['fund']} f left join (select fund_id, list(coalesce(latest, 0)) as l from {_TABLES['holding']} h group by 1) a on a.fund_id = f.fund_id",
    "hd04_theme_tilt": f"select f.fund_id, round(case when n is null or n < 5 then 0 else least(greatest((themed / total - 0.45) * 2, -0.3), 0.4) end, 4) as tilt from {_TABLES['fund']} f left join (select fund_id, count(*) as n, sum(latest) as total, sum(case when regexp_matches(sector, 'financial|bank|nbfc|insurance|capital markets', 'i') then latest else 0 end) + sum(case when regexp_matches(sector, 'auto|cement|construction|infrastructure|real estate|utilities', 'i') then latest else 0 end) + sum(case when regexp_matches(sector, 'fmcg|consumer|retail|two wheeler|tractor|durables', 'i') then latest else 0 end) + sum(case when regexp_matches(sector, 'manufacturing|capital goods|renewable|power|telecom|it', 'i') then latest else 0 end) as themed from {_TABLES['holding']} h group by 1) a on a.fund_id = f.fund_id",
    "prj07_holding_weight": f"select fund_id, sid, round(case when latest > 0 then least(latest, 100) else list_filter([case when e > 0 and e <= 1.0001 then e * 100 when e > 1 and e <= 100 then e end for e in [try_cast(nav as double), try_cast(allocation as double), try_cast(allocationPct as double), try_cast(weight as double), try_cast(holdingPct as double), try_cast(percent as double), try_cast(pct as double), try_cast(holding as double), try_cast(portfolioShare as double)]], lambda e: e is not null)[1] end, 8) as weight_pct from {_TABLES['holding_raw']} h",
    "en01_compiled_score": f"select fund_id, sector, round(list_avg([coalesce(list_filter(own, lambda o: o.model = m.model)[1].z, 0) for m in models]), 3) as final_score from (select s.fund_id, f.sector, list({{'model': s.model, 'z': case when coalesce(sd, 0) < 1e-12 then 0.5 else (s.score - lo) / (hi - lo) end}}) as own from {_TABLES['model_score']} s join {_TABLES['fund']} f on f.fund_id = s.fund_id join (select sector, model, stddev_samp(score) as sd, min(score) as lo, max(score) as hi from {_TABLES['model_score']} a join {_TABLES['fund']} b on a.fund_id = b.fund_id group by 1, 2) g on g.sector = f.sector and g.model = s.model group by 1, 2) x join (select sector, list(distinct {{'model': model}}) as models from {_TABLES['model_score']} a join {_TABLES['fund']} b on a.fund_id = b.fund_id group by 1) y using (sector)",
    "rt08_momentum_over_volatility": _query("weeks", "iweeks", "rets", "fund")(f"select fund_id, round({mean('[e for e in a if e is not null]')} / case when vol > 0 then vol else 1 end, 6) as quality from (select r.fund_id, [r.v[-1] / r.v[-14] - 1, r.v[-1] / r.v[-27] - 1, r.v[-1] / r.v[-53] - 1, r.v[-1] / r.v[-27] - i.v[-1] / i.v[-27]] as a, {std('r.r[-52:]')} * sqrt(52) as vol from rets r join fund on fund.fund_id = r.fund_id join iweeks i on i.index_id = fund.sector) x"),
    "rt09_information_momentum": _query("days", "fund")(
        """, idays as (select index_id, map(list(ts), list(nav)) as at from {index_nav} where nav > 0 group by 1),
        cuts as (select d.fund_id, h, x[len(x) - n + 1:] as x, [i.at[e] for e in t[len(t) - n + 1:]] as b0
                 from (select *, len([e for e in t if e >= t[-1] - to_days(h::int)]) as n from days, (values (90), (180)) v(h)) d
                 join fund on fund.fund_id = d.fund_id join idays i on i.index_id = fund.sector),
        carried as (select fund_id, h, x, [[e for e in b0[1:i] if e is not null][-1] for i in range(1, len(b0) + 1)] as b from cuts),
        excess as (select fund_id, h, len(x) as n, [e for e in [(x[i] / x[i - 1] - 1) - (b[i] / b[i - 1] - 1) for i in range(2, len(x) + 1)] if e is not null] as a from carried),
        done as (select fund_id, h, case when n < 20 or len(a) = 0 or list_aggregate(a, 'stddev_samp') < 1e-15 then 0 else list_aggregate(a, 'avg') / list_aggregate(a, 'stddev_samp') * sqrt(252) end as v from excess)
        select fund_id, round(max(v) filter (h = 90), 6) as m90, round(max(v) filter (h = 180), 6) as m180 from done group by 1"""
    ),
    "rk16_tail_ratio": _R(f"select fund_id, round(least(5, {quantile('s', 0.95)} / abs({quantile('s', 0.05)})), 6) as tail_ratio from (select fund_id, list_sort(r) as s from rets)"),
    "rk23_drawdown_episodes": _D(f"select fund_id, len(c) as n_runs, round({mean('c')}, 6) as mean_weeks, list_max(c) as longest_weeks, list_max([(k[e[2] - 1] - k[e[1]])::bigint for e in p]) as longest_days from (select fund_id, k, [[i, coalesce([j for j in range(i, len(d) + 1) if d[j] >= -1e-9][1], len(d) + 1)] for i in range(1, len(d) + 1) if d[i] < -1e-9 and (i = 1 or d[i - 1] >= -1e-9)] as p, [e[2] - e[1] for e in p] as c from falls) x where len(c) > 0"),
    "bm07_side_betas": _B(f"select fund_id, round(case when len(bd) >= 8 then {slope('fd', 'bd')} end, 8) as beta_down, round(case when len(bu) >= 8 then {slope('fu', 'bu')} end, 8) as beta_up, round({slope('fu', 'bu')} - {slope('fd', 'bd')}, 8) as agility from (select fund_id, {pairs('b[i] < 0', 'f[i]')} as fd, {pairs('b[i] < 0', 'b[i]')} as bd, {pairs('b[i] > 0', 'f[i]')} as fu, {pairs('b[i] > 0', 'b[i]')} as bu from joint)"),
    "bm11_rebound_elasticity": _B(f"{_GROWN} select fund_id, round(coalesce({agg('median', '[list_sum(a[i + 1:i + 6]) / (1e-9 - g[i]) for i in range(1, len(a) - 5) if round(g[i], 9) <= -0.1]')}, 0), 5) as elasticity from grown where len(a) >= 16"),
    "bm12_recovery_ratio": _B(f"{_GROWN} select fund_id, round(coalesce({agg('median', '[list_sum(a[i + 1:i + 12]) for i in range(1, len(a) - 11) if round(g[i], 9) <= -0.08]')}, 0), 8) as ratio from grown where len(a) >= 30"),
    "bm13_recovery_since_trough": _query("weeks", "iweeks", "fund")("select fund_id, round(v[-1] / v[z] - u[-1] / u[z], 8) as strength from (select *, len(u) - len(u[-78:]) + list_position(u[-78:], list_min(u[-78:])) as z from (select p.fund_id, list(p.v order by p.k) as v, list(q.v order by p.k) as u from (select fund_id, unnest(v) as v, unnest(k) as k from weeks) p join fund on fund.fund_id = p.fund_id join (select index_id, unnest(v) as v, unnest(k) as k from iweeks) q on q.index_id = fund.sector and q.k = p.k group by 1) x) y"),
    "bm16_drawdown_avoidance": _B(f"{_GROWN} select fund_id, round(case when -bn < 1e-6 then 1 else least(greatest(1 / (fn / bn + 1e-6), 0.4), 2.5) end, 6) as avoidance from (select fund_id, list_min([cf[i] - list_max(cf[1:i]) for i in range(1, len(cf) + 1)]) as fn, list_min([cb[i] - list_max(cb[1:i]) for i in range(1, len(cb) + 1)]) as bn from grown)"),
    "bm18_timing_convexity": _B(f"select fund_id, round(least(greatest((({product_sum('f', 's')}) * ({product_sum('b', 'b')}) - ({product_sum('f', 'b')}) * ({product_sum('b', 's')})) / (({product_sum('b', 'b')}) * ({product_sum('s', 's')}) - pow({product_sum('b', 's')}, 2)), -0.01), 0.01), 6) as convexity from (select *, [e * e for e in b] as s from joint) where len(f) >= 40"),
    "cf07_sip_summary": _plan_rates(f"select fund_id, len(x) as n_windows, round({agg('median', 'x')}, 6) as median_x, round({quantile('s', 0.25)}, 6) as p25, round({quantile('s', 0.05)}, 6) as p5, round(s[1], 6) as worst, round({mean('x')}, 6) as mean_x, round({std('x')}, 6) as std_x, round(x[-1], 6) as latest, round({mean('x[-3:]')}, 6) as newest_3, round({mean('[case when e > 0.08 then 1.0 else 0.0 end for e in x]')}, 6) as share_8 from (select fund_id, list(x order by m) as x, list(x order by x) as s from rates group by 1)"),
    "cf03_rolling_sip_xirr": _plan_rates("select fund_id, m::varchar as start, round(x, 6) as xirr from rates"),
    "scr01_percentile_rank": _measures("select fund_id, metric, round(p, 6) as p, round(100 - p, 6) as reversed, round(coalesce(p, 50), 6) as filled from (select a.fund_id, a.metric, case when a.x is not null then 100 * (count(*) filter (b.x < a.x) + (count(*) filter (b.x = a.x) + 1) / 2) / count(b.x) end as p from measured a join measured b on a.sector = b.sector and a.metric = b.metric group by a.fund_id, a.metric, a.x) y"),
    "scr03_zscore": _measures(f"select fund_id, metric, round(case when x is not null then case when coalesce({std('l')}, 0) < 1e-12 then 0 else (x - {mean('l')}) / {std('l')} end end, 5) as z from measured join (select sector, metric, list(x) filter (x is not null) as l from measured group by 1, 2) g using (sector, metric)"),
    "scr07_composite": _measures("select fund_id, sector, round(case when cover < 0.35 then least(45, mean_p) else mean_p end, 5) as composite, round(cover, 6) as coverage from (select fund_id, sector, sum(w * p) / sum(w) filter (p is not null) as mean_p, coalesce(sum(w) filter (p is not null), 0) as cover from (select a.fund_id, a.sector, a.metric, any_value(a.w) as w, case when a.x is not null then 100 * (count(*) filter (b.x < a.x) + (count(*) filter (b.x = a.x) + 1) / 2) / count(b.x) end as p from measured a join measured b on a.sector = b.sector and a.metric = b.metric group by a.fund_id, a.sector, a.metric, a.x) y group by 1, 2) z"),
}

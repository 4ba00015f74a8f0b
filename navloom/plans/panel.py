"""Steps of the adaptive plan model: sixteen features of each fund as of each month and as of its last day, from values up to then only.

Windows are calendar ranges of day numbers over weekly values. `w_t` is the last week that has ended by a month's first day.
"""

#: Features with the sign that is known to be better: 1 higher, -1 lower, 0 to be learned. Fixed values.
FEATURES = {
    "sip_1y_median": 1,
    "sip_1y_p20": 1,
    "sip_alpha_median": 1,
    "sip_consistency": 1,
    "dd_depth": 0,
    "bench_dd_depth": 0,
    "recovery_slope": 1,
    "late_mom_6m": 0,
    "up_capture_2y": 1,
    "down_capture_2y": -1,
    "info_ratio_2y": 1,
    "nav_trend_residual": 0,
    "bench_trend_residual": 0,
    "sortino_3y": 1,
    "cagr_3y": 0,
    "cagr_5y": 0,
}
#: Features that share the weight where nothing can be learned. Fixed values.
FALLBACK = ("sip_alpha_median", "sip_1y_median", "info_ratio_2y", "sortino_3y", "sip_consistency")

_RF = "(pow(1.065e0, 1 / 52e0) - 1)"
_CASES = " ".join(f"when '{f}' then {f}" for f in FEATURES)
#: Windows of so many days of one series.
_DAYS = {"d90": 90, "d180": 180, "d730": 730, "d1095": 1095, "d1826": 1826}


def _windows(key: str, *names: str) -> str:
    return "window " + ", ".join(f"{n} as (partition by {key} order by w range between {_DAYS[n]} preceding and current row)" for n in names)


def _residual(window: str) -> str:
    """How many deviations the last log value is from its linear trend."""
    slope = f"(regr_slope(v, t) over {window})"
    gap = f"(v - (avg(v) over {window})) - ({slope}) * (t - (avg(t) over {window}))"
    return f"case when (count(v) over {window}) >= 30 then ({gap}) / sqrt(nullif(greatest((var_pop(v) over {window}) - ({slope}) * (covar_pop(v, t) over {window}), 0e0), 0e0)) end"


def _net(value: str) -> str:
    """Sum over two years of aligned returns, without the first where the value before it lies outside."""
    return f"(sum({value}) over d730) - case when (first_value(before) over d730) < w - 730 then (first_value({value}) over d730) else 0e0 end"


PANEL = {
    # The index's months and plans, as those of funds: daily filled, first value of the month.
    "bspan": "select index_id, min(day) as d0, max(day) as d1 from idxd group by index_id",
    "bdays": "select index_id, [[seq|d0|d1]] as day from bspan",
    "bdaily": """
        select bdays.index_id, bdays.day,
               [[last|idxd.nav]] over (partition by bdays.index_id order by bdays.day rows between unbounded preceding and current row) as nav
        from bdays left join idxd on idxd.index_id = bdays.index_id and idxd.day = bdays.day""",
    "bmon": """
        select index_id, m, nav, row_number() over (partition by index_id order by m) as ra
        from (select index_id, cast(date_trunc('month', [[date|day]]) as date) as m, min_by(nav, day) as nav from bdaily group by 1, 2) x""",
    "bunits": """
        select index_id, ra, sum(1 / nav) over (partition by index_id order by ra rows between current row and 11 following) as units,
               lead(nav, 12) over (partition by index_id order by ra) as later
        from bmon""",
    "bsip": """
        select a.index_id, a.m as start,
               [[flows|case when b.ra - a.ra < 12 then -1e0 else u.units * b.nav end|[[day|b.m]] * 1e0 / 365.25e0 - [[day|a.m]] / 365.25e0|b.ra]] as flows
        from bmon a join bmon b on a.index_id = b.index_id and b.ra between a.ra and a.ra + 12
        join bunits u on u.index_id = a.index_id and u.ra = a.ra where u.later is not null group by a.index_id, a.m""",
    "bsipx": "select index_id, start, [[xirr|flows]] as xirr from bsip",
    # Features from the fund's own weekly values.
    "pfund": f"""
        select fund_id, w, count(*) over (partition by fund_id order by w rows between unbounded preceding and current row) as n_rows,
               case when (count(*) over d1095) >= 5 then nav / (max(nav) over d1095) - 1 end as dd_depth,
               case when (count(*) over d90) >= 5 and w - (min(w) over d90) >= 45 then 365.25e0 * (regr_slope(v, t) over d90) end as recovery_slope,
               case when (count(*) over d180) >= 5 then nav / (first_value(nav) over d180) - 1 end as late_mom_6m,
               {_residual("d1826")} as nav_trend_residual,
               case when (count(*) over d1095) >= 30 then
                 52 * ((sum(e) over d1095) - (first_value(e) over d1095)) / ((count(*) over d1095) - 1) / (sqrt(52) * sqrt(nullif(
                   ((sum(q) over d1095) - (first_value(q) over d1095)) / nullif((sum(k) over d1095) - (first_value(k) over d1095), 0), 0e0))) end as sortino_3y,
               case when (count(*) over d1095) >= 5 and (w - (min(w) over d1095)) / 365.25e0 >= 2.55e0
                 then pow(nav / (first_value(nav) over d1095), 365.25e0 / nullif(w - (min(w) over d1095), 0)) - 1 end as cagr_3y,
               case when (count(*) over d1826) >= 5 and (w - (min(w) over d1826)) / 365.25e0 >= 4.25e0
                 then pow(nav / (first_value(nav) over d1826), 365.25e0 / nullif(w - (min(w) over d1826), 0)) - 1 end as cagr_5y
        from (select *, coalesce(r - {_RF}, 0e0) as e, case when r < {_RF} then (r - {_RF}) * (r - {_RF}) else 0e0 end as q, case when r < {_RF} then 1 else 0 end as k
              from (select fund_id, w, nav, ln(nav) as v, cast(w as double) as t, nav / lag(nav) over (partition by fund_id order by w) - 1 as r from wk) a) b
        {_windows("fund_id", "d90", "d180", "d1095", "d1826")}""",
    "pindex": f"""
        select index_id, w, count(*) over (partition by index_id order by w rows between unbounded preceding and current row) as n_rows,
               case when (count(*) over d1095) >= 5 then nav / (max(nav) over d1095) - 1 end as bench_dd_depth,
               {_residual("d1826")} as bench_trend_residual
        from (select index_id, w, nav, ln(nav) as v, cast(w as double) as t from bwk) a
        {_windows("index_id", "d1095", "d1826")}""",
    # Captures and information ratio of aligned returns.
    "paligned": f"""
        select fund_id, w,
               case when n >= 20 and n_up >= 5 and abs(b_up) > 1e-12 then f_up / b_up end as up_capture_2y,
               case when n >= 20 and n_down >= 5 and abs(b_down) > 1e-12 then f_down / b_down end as down_capture_2y,
               case when n >= 20 and n * a2 - a1 * a1 > 1e-12 then a1 / n * 52 / (sqrt((a2 - a1 * a1 / n) / (n - 1)) * sqrt(52)) end as info_ratio_2y
        from (select fund_id, w, {_net("1e0")} as n, {_net("up")} as n_up, {_net("down")} as n_down, {_net("up * f")} as f_up, {_net("up * b")} as b_up,
                     {_net("down * f")} as f_down, {_net("down * b")} as b_down, {_net("f - b")} as a1, {_net("(f - b) * (f - b)")} as a2
              from (select r.fund_id, r.w, r.before, r.r as f, bwr.r as b, case when bwr.r > 0 then 1e0 else 0e0 end as up, case when bwr.r < 0 then 1e0 else 0e0 end as down
                    from (select fund_id, w, lag(w) over (partition by fund_id order by w) as before, nav / lag(nav) over (partition by fund_id order by w) - 1 as r from wk) r
                    join fund on fund.fund_id = r.fund_id join bwr on bwr.index_id = fund.sector and bwr.w = r.w where r.r is not null) x
              {_windows("fund_id", "d730")}) y""",
    # Plans of the fund that had ended by the start of each plan: their level and their lead over the index's.
    "pplans": """
        select x.fund_id, x.start, x.ra, x.xirr as y, x.xirr - b.xirr as lead_x
        from sipx x join fund on fund.fund_id = x.fund_id left join bsipx b on b.index_id = fund.sector and b.start = x.start where x.xirr is not null""",
    "pended": """
        select fund_id, start, y, [[q|y|0.5]] over done as sip_1y_median, [[q|y|0.2]] over done as sip_1y_p20,
               case when count(lead_x) over done >= 6 then [[q|lead_x|0.5]] over done end as sip_alpha_median,
               case when count(lead_x) over done >= 6 then avg(case when lead_x > 1e-9 then 1e0 when lead_x is not null then 0e0 end) over done end as sip_consistency
        from pplans window done as (partition by fund_id order by ra range between unbounded preceding and 12 preceding)""",
    # The last week that has ended by each month start, of funds and of indices.
    "pmonth": """
        select distinct mon.fund_id, mon.m, max(x.w) over (partition by mon.fund_id order by mon.m range between unbounded preceding and current row) as w_t
        from mon left join (select fund_id, w, case when [[date|w]] = cast(date_trunc('month', [[date|w]]) as date) then [[date|w]]
                                   else [[months|cast(date_trunc('month', [[date|w]]) as date)|1]] end as m from wk) x
          on x.fund_id = mon.fund_id and x.m = mon.m""",
    "pimonth": """
        select distinct bmon.index_id, bmon.m, max(x.w) over (partition by bmon.index_id order by bmon.m range between unbounded preceding and current row) as w_t
        from bmon left join (select index_id, w, case when [[date|w]] = cast(date_trunc('month', [[date|w]]) as date) then [[date|w]]
                                    else [[months|cast(date_trunc('month', [[date|w]]) as date)|1]] end as m from bwk) x
          on x.index_id = bmon.index_id and x.m = bmon.m""",
    # The panel: features as of the start of each plan, and the plan's outcome.
    "p16": """
        select e.fund_id, fund.sector, e.start as m, e.y, sip_1y_median, sip_1y_p20, sip_alpha_median, sip_consistency, dd_depth, bench_dd_depth,
               recovery_slope, late_mom_6m, up_capture_2y, down_capture_2y, info_ratio_2y, nav_trend_residual, bench_trend_residual, sortino_3y, cagr_3y, cagr_5y
        from pended e join fund on fund.fund_id = e.fund_id
        join pmonth on pmonth.fund_id = e.fund_id and pmonth.m = e.start join pfund on pfund.fund_id = e.fund_id and pfund.w = pmonth.w_t
        join pimonth on pimonth.index_id = fund.sector and pimonth.m = e.start join pindex on pindex.index_id = fund.sector and pindex.w = pimonth.w_t
        left join paligned on paligned.fund_id = e.fund_id and paligned.w = pmonth.w_t
        where pfund.n_rows >= 30 and pindex.n_rows >= 30""",
    "pnow": """
        select f.fund_id, fund.sector, s.sip_1y_median, s.sip_1y_p20, s.sip_alpha_median, s.sip_consistency, dd_depth, bench_dd_depth,
               recovery_slope, late_mom_6m, up_capture_2y, down_capture_2y, info_ratio_2y, nav_trend_residual, bench_trend_residual, sortino_3y, cagr_3y, cagr_5y
        from (select fund_id, max(w) as w from wk group by 1) l join fund on fund.fund_id = l.fund_id join pfund f on f.fund_id = l.fund_id and f.w = l.w
        join (select index_id, max(w) as w from bwk group by 1) k on k.index_id = fund.sector join pindex on pindex.index_id = k.index_id and pindex.w = k.w
        left join paligned on paligned.fund_id = l.fund_id and paligned.w = l.w
        left join (select fund_id, [[q|y|0.5]] as sip_1y_median, [[q|y|0.2]] as sip_1y_p20, case when count(lead_x) >= 6 then [[q|lead_x|0.5]] end as sip_alpha_median,
                          case when count(lead_x) >= 6 then avg(case when lead_x > 1e-9 then 1e0 when lead_x is not null then 0e0 end) end as sip_consistency
                   from pplans group by 1) s on s.fund_id = l.fund_id""",
    "pnames": " union all ".join(f"select '{f}' as metric, {sign} as sign, {int(f in FALLBACK)} as falls_back" for f, sign in FEATURES.items()),
    "p16l": f"select fund_id, sector, m, round(y, 9) as y, metric, round(case metric {_CASES} end, 12) as x from p16 cross join pnames",
    "pnowl": f"select fund_id, sector, metric, case metric {_CASES} end as x from pnow cross join pnames",
    # Percentile ranks within sector and month, five funds at least; their correlation by sector from 50 pairs on.
    "p16r": """
        select sector, metric, m, count(*) over g as peers, (rank() over (partition by sector, metric, m order by x) + (count(*) over (partition by sector, metric, m, x) - 1) / 2e0) / count(*) over g as rx,
               (rank() over (partition by sector, metric, m order by y) + (count(*) over (partition by sector, metric, m, y) - 1) / 2e0) / count(*) over g as ry
        from p16l where x is not null window g as (partition by sector, metric, m)""",
    "p16rho": """
        select sector, metric, count(*) as n, case when stddev_pop(rx) > 1e-9 and stddev_pop(ry) > 1e-9 then covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) end as rho
        from p16r where peers >= 5 group by 1, 2 having count(*) >= 50""",
    # Weights: a known sign is kept unless the data contradict it; an unknown one is learned where it is strong enough.
    "p16raw": """
        select s.sector, n.metric, n.falls_back, r.rho, case when n.sign <> 0 then n.sign when r.rho >= 0 then 1 else -1 end as sign,
               case when r.rho is null then 'drop_no_data' when n.sign <> 0 and (n.sign * r.rho >= 0 or abs(r.rho) < 0.05e0) then 'locked'
                    when n.sign <> 0 then 'drop_disagree' when abs(r.rho) >= 0.05e0 then 'data' else 'drop_noise' end as status
        from (select distinct sector from fund) s cross join pnames n left join p16rho r on r.sector = s.sector and r.metric = n.metric""",
    "p16kept": """
        select *, case status when 'locked' then greatest(abs(rho), 0.05e0) when 'data' then abs(rho) else 0e0 end as raw,
               sum(case status when 'locked' then greatest(abs(rho), 0.05e0) when 'data' then abs(rho) else 0e0 end) over (partition by sector) as total from p16raw""",
    "p16w": """
        select sector, metric, rho, case when total = 0 and falls_back = 1 then 1 else sign end as sign,
               case when total > 0 then raw / total when falls_back = 1 then 0.2e0 else 0e0 end as weight,
               case when total = 0 and falls_back = 1 then 'fallback' else status end as status from p16kept""",
    # Weighted mean of signed z-scores over the features that a fund has.
    "pscore": """
        select z.fund_id, z.sector, coalesce(sum(w.weight * w.sign * z.z) / nullif(sum(case when z.z is not null then w.weight end), 0), 0e0) as raw
        from (select fund_id, sector, metric, case when x is null then null when coalesce(stddev_samp(x) over g, 0e0) < 1e-12 then 0e0
                     else (x - avg(x) over g) / nullif(stddev_samp(x) over g, 0) end as z
              from pnowl window g as (partition by sector, metric)) z
        join p16w w on w.sector = z.sector and w.metric = z.metric and w.weight > 0 group by 1, 2""",
}

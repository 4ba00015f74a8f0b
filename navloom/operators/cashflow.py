"""Dated cash flows: internal rates of return by a fixed number of halvings, rolling monthly purchase plans, their summaries."""

from navloom.plans.text import IN_SPARK, Operator

_HOLD = "select a.fund_id, a.m as start, [[flows|case when b.ra - a.ra < 12 then -1e0 else u.units * b.nav end|([[day|b.m]] - [[day|a.m]]) / 365e0|b.ra]] as flows from mon a join mon b on a.fund_id = b.fund_id and (b.ra between a.ra and a.ra + 11 or b.ra = a.ra + 24) join (select fund_id, ra, units, n, lead(ra, 24) over (partition by fund_id order by ra) as last_ra from sipu) u on u.fund_id = a.fund_id and u.ra = a.ra where u.n = 12 and u.last_ra = a.ra + 24 group by a.fund_id, a.m"
_HOLDX = f"select fund_id, start, [[xirr|flows|-0.95|20.0]] as xirr from ({_HOLD}) h"
#: In Spark months are numbered from windows instead of a join with themselves, and models write these rates once.
IN_SPARK[_HOLDX] = "select fund_id, start, xirr from o_held_rates"
#: The same plan on the sector's index.
_BMON = "select index_id, m, nav, row_number() over (partition by index_id order by m) as ra from (select index_id, cast(date_trunc('month', ts) as date) as m, min_by(nav, ts) as nav from index_nav where nav > 0 group by 1, 2) x"
_BX = f"select index_id, start, [[xirr|flows]] as xirr from (select a.index_id, a.m as start, [[flows|case when b.ra - a.ra < 12 then -1e0 else u.units * b.nav end|[[day|b.m]] * 1e0 / 365.25e0 - [[day|a.m]] / 365.25e0|b.ra]] as flows from ({_BMON}) a join ({_BMON}) b on a.index_id = b.index_id and b.ra between a.ra and a.ra + 12 join (select index_id, ra, sum(1 / nav) over (partition by index_id order by ra rows between current row and 11 following) as units, lead(nav, 12) over (partition by index_id order by ra) as later from ({_BMON}) m) u on u.index_id = a.index_id and u.ra = a.ra where u.later is not null group by a.index_id, a.m) s"

OPERATORS = [
    Operator("cf01_xirr", "Rate of return of dated flows: a purchase at each year's first value, sold at the last; null without a change of sign.", "with y as (select fund_id, cast(date_trunc('year', ts) as date) as y, min_by(nav, ts) as nav, min(ts) as ts from nav where nav > 0 group by 1, 2), e as (select fund_id, max_by(nav, ts) as nav, max(ts) as ts from nav where nav > 0 group by 1), t as (select y.fund_id, y.ts, -1e0 as a, 0 as k, e.ts as t1 from y join e on e.fund_id = y.fund_id union all select e.fund_id, e.ts, e.nav * u.units, 1, e.ts from e join (select fund_id, sum(1 / nav) as units from y group by 1) u on u.fund_id = e.fund_id), g as (select fund_id, [[flows|a|([[day|ts]] - [[day|t1]]) / 365.25e0|k * 1000000 + [[day|ts]]]] as flows from t group by fund_id) select fund_id, round([[xirr|flows]], 6) as xirr from g"),
    Operator(
        "cf01_xirr_brackets",
        "The same flows by the other brackets and day counts: 365 days a year; a wider second bracket where the first has no change of sign; very wide ones.",
        """
        with y as (select fund_id, cast(date_trunc('year', ts) as date) as y, min_by(nav, ts) as nav, min(ts) as ts from nav where nav > 0 group by 1, 2),
        e as (select fund_id, max_by(nav, ts) as nav, max(ts) as ts from nav where nav > 0 group by 1),
        t as (select y.fund_id, y.ts, -1e0 as a, 0 as k, e.ts as t1 from y join e on e.fund_id = y.fund_id
              union all select e.fund_id, e.ts, e.nav * u.units, 1, e.ts from e join (select fund_id, sum(1 / nav) as units from y group by 1) u on u.fund_id = e.fund_id),
        g as (select fund_id, [[flows|a|([[day|ts]] - [[day|t1]]) / 365.25e0|k * 1000000 + [[day|ts]]]] as flows, [[flows|a|([[day|ts]] - [[day|t1]]) / 365e0|k * 1000000 + [[day|ts]]]] as flows365 from t group by fund_id)
        select fund_id, round(coalesce([[xirr|flows|-0.95|5.0]], [[xirr|flows|-0.95|20.0]]), 6) as two_brackets, round([[xirr|flows365|-0.95|5.0]], 6) as brent_5,
               round([[xirr|flows365|-0.999|20.0]], 6) as brent_20, round([[xirr|flows|-0.9999|20.0]], 6) as wide_20,
               round(coalesce([[xirr|flows|-0.9999|100.0]], [[xirr|flows|-0.9999|1000.0]]), 6) as wide_100 from g""",
    ),
    Operator("cf02_monthly_irr", "Rate of equally spaced monthly flows of the newest plan, annualised; without a change of sign from the totals.", "with s as (select fund_id, max(ra) as ra from sip group by 1), f as (select a.fund_id, [[flows|case when b.ra - a.ra < 12 then -1e0 else u.units * b.nav end|(b.ra - a.ra) * 1e0|b.ra]] as flows, max(u.units * b.nav) as value from mon a join s on s.fund_id = a.fund_id and s.ra = a.ra join mon b on b.fund_id = a.fund_id and b.ra between a.ra and a.ra + 12 join sipu u on u.fund_id = a.fund_id and u.ra = a.ra group by a.fund_id) select fund_id, round(coalesce(pow(1 + [[xirr|flows|-0.9|1.0]], 12) - 1, pow(value / 12, 12 / 12e0) - 1), 6) as irr from f"),
    Operator("cf03_rolling_sip_xirr", "Rate of return of every 12-month plan.", "select fund_id, start, round(xirr, 6) as xirr from sipx"),
    Operator("cf04_dated_sip_xirr", "Plans that start every third month, bought at the first observed value of a month and valued at the last of the year.", "with m as (select fund_id, cast(date_trunc('month', ts) as date) as m, min_by(nav, ts) as nav, min([[day|ts]]) as d, max_by(nav, ts) as last_nav, max([[day|ts]]) as last_d from nav where nav > 0 group by 1, 2), n as (select *, row_number() over (partition by fund_id order by m) as ra, count(*) over (partition by fund_id) as n from m), t as (select a.fund_id, a.m as start, b.d - a.d as t, -1e0 as a, 1 / b.nav as units, b.ra from n a join n b on b.fund_id = a.fund_id and b.ra between a.ra and a.ra + 11 where a.ra % 3 = 1 and a.ra + 11 <= a.n), e as (select a.fund_id, a.m as start, b.last_d - a.d as t, b.last_nav from n a join n b on b.fund_id = a.fund_id and b.ra = a.ra + 11 where a.ra % 3 = 1), u as (select fund_id, start, t, a, ra from t union all select e.fund_id, e.start, e.t, e.last_nav * x.units, 1000000 from e join (select fund_id, start, sum(units) as units from t group by 1, 2) x on x.fund_id = e.fund_id and x.start = e.start), g as (select fund_id, start, [[flows|a|t / 365.25e0|ra]] as flows from u group by 1, 2) select fund_id, start, round([[xirr|flows]], 6) as xirr from g"),
    Operator(
        "cf04_rolling_windows",
        "Plans of 52-week windows that end every four weeks: bought at the first weekly value on or after each month start in the window, six at least, valued at the window's last.",
        """
        with x as (select fund_id, w, nav, rd, n, [[day|cast(date_trunc('month', [[date|w]]) as date)]] as md, lag(w) over (partition by fund_id order by w) as pw from wkn),
        e as (select *, [[seq|cast(greatest(ceil((rd - 53) / 4e0), 0) as int)|cast(floor((rd - 1) / 4e0) as int)]] as j from x),
        y as (select fund_id, j, w, nav, n, md, case when pw is null or pw < md then 1 else 0 end as buy, max(w) over (partition by fund_id, j) as w1,
                     max(case when rd = 4 * j + 1 then nav end) over (partition by fund_id, j) as nav1 from e where n >= 4 * j + 53),
        b as (select * from y where buy = 1 and md >= w1 - 364),
        u as (select fund_id, j, w1, max(nav1) as nav1, sum(1 / nav) as units from b group by 1, 2, 3 having count(*) >= 6),
        t as (select b.fund_id, b.j, b.w as d, -1e0 as a, 0 as k, b.w1 from b join u on u.fund_id = b.fund_id and u.j = b.j union all select fund_id, j, w1, units * nav1, 1, w1 from u),
        g as (select fund_id, w1, [[flows|a|(d - w1) / 365.25e0|d * 2 + k]] as flows from t group by 1, 2)
        select fund_id, [[date|w1]] as week, round([[xirr|flows]], 6) as xirr from g""",
    ),
    Operator(
        "cf04_trailing_plans",
        "Plans that end on a fund's last day and began 12, 15, ... 33 months before: bought on each month start at the last value up to it; mean rate and steadiness from three plans on, else 0.",
        """
        with k as (select fund_id, d0, d1, [[seq|0|7]] as k from span),
        p as (select fund_id, d0, d1, k, [[day|[[months|[[date|d1]]|-12 - 3 * k]]]] as s from k),
        m as (select p.fund_id, p.k, p.s, p.d1, [[monthseq|cast(date_trunc('month', [[date|s]]) as date)|[[date|d1]]]] as m from p where p.s >= p.d0),
        b as (select fund_id, k, s, d1, [[day|m]] as d from m where [[day|m]] >= s),
        u as (select fund_id, d as day, cast(null as double) as nav, k, s, d1 from b union all select fund_id, day, nav, null, null, null from navd),
        v as (select fund_id, k, s, d1, day, [[last|nav]] over (partition by fund_id order by day, case when k is null then 0 else 1 end rows between unbounded preceding and current row) as nav from u),
        e as (select fund_id, max_by(nav, day) as nav from navd group by 1),
        f as (select fund_id, k, s, d1, day, -1e0 as a, day * 2 as o from v where k is not null and nav is not null
              union all select v.fund_id, v.k, v.s, v.d1, v.d1, sum(1 / v.nav) * max(e.nav), v.d1 * 2 + 1 from v join e on e.fund_id = v.fund_id where v.k is not null and v.nav is not null group by v.fund_id, v.k, v.s, v.d1),
        g as (select fund_id, k, [[flows|a|(day - s) / 365.25e0|o]] as flows from f group by 1, 2),
        x as (select fund_id, [[xirr|flows|-0.99|10.0]] as xirr from g)
        select span.fund_id, count(xirr) as n_plans, round(case when count(xirr) >= 3 then avg(xirr) else 0e0 end, 6) as mean_x, round(case when count(xirr) >= 3 then 1 / (1 + stddev_pop(xirr)) else 0e0 end, 6) as steadiness from span left join x on x.fund_id = span.fund_id group by 1""",
    ),
    Operator("cf05_sip_then_hold", "Twelve monthly purchases, held for twelve months more and sold: rate of return for every start.", f"select fund_id, start, round(xirr, 6) as xirr from ({_HOLDX}) x"),
    Operator("cf06_rolling_sip_return", "Simple return of every 12-month plan at the first values of months, less that of the index's plan; level, stability from 12 plans on, trend of the last 12.", "with fm as (select fund_id, cast(date_trunc('month', ts) as date) as m, min_by(nav, ts) as f from nav where nav > 0 group by 1, 2), im as (select index_id, cast(date_trunc('month', ts) as date) as m, min_by(nav, ts) as b from index_nav where nav > 0 group by 1, 2), j as (select fm.fund_id, fm.m, f, b from fm join fund on fund.fund_id = fm.fund_id join im on im.index_id = fund.sector and im.m = fm.m), p as (select fund_id, m, sum(1 / f) over w12 * lead(f, 12) over (partition by fund_id order by m) / 12 - 1 as fr, sum(1 / b) over w12 * lead(b, 12) over (partition by fund_id order by m) / 12 - 1 as br from j window w12 as (partition by fund_id order by m rows between current row and 11 following)), r as (select fund_id, fr, fr - br as alpha, row_number() over (partition by fund_id order by m desc) as k, row_number() over (partition by fund_id order by m) as i from p where fr is not null) select fund_id, count(*) as n_windows, round(avg(fr), 6) as mean_ret, round(avg(alpha), 6) as mean_alpha, round(case when count(*) >= 12 then avg(fr) / case when stddev_samp(fr) > 1e-12 then stddev_samp(fr) end end, 5) as stability, round(case when count(*) >= 3 then regr_slope(case when k <= 12 then alpha end, case when k <= 12 then cast(i as double) end) end, 6) as trend from r group by fund_id"),
    Operator("cf07_sip_summary", "Summary of a fund's rolling rates of return.", "with r as (select fund_id, xirr, row_number() over (partition by fund_id order by ra desc) as k from sipx where xirr is not null) select fund_id, count(*) as n_windows, round(median(xirr), 6) as median_x, round([[q|xirr|0.25]], 6) as p25, round([[q|xirr|0.05]], 6) as p5, round(min(xirr), 6) as worst, round(avg(xirr), 6) as mean_x, round(stddev_samp(xirr), 6) as std_x, round(max(case when k = 1 then xirr end), 6) as latest, round(avg(case when k <= 3 then xirr end), 6) as newest_3, round(avg(case when xirr > 0.08e0 then 1e0 else 0e0 end), 6) as share_8 from r group by fund_id"),
    Operator("cf08_hit_rate", "Share of shared starts at which the fund's plan beats the index's.", f"select sipx.fund_id, count(*) as n_shared, round(avg(case when round(sipx.xirr, 9) > round(b.xirr, 9) then 1e0 else 0e0 end), 6) as hit_rate from sipx join fund on fund.fund_id = sipx.fund_id join ({_BX}) b on b.index_id = fund.sector and b.start = sipx.start where sipx.xirr is not null and b.xirr is not null group by sipx.fund_id"),
    Operator(
        "cf09_alpha_hit_rate",
        "Share of a fund's windows of 52 weeks (every four weeks, 30 at most) whose alpha is above the median of its peers' in the same weeks, five peers at least.",
        """
        with e as (select fund_id, w, f, b, 4 * j + 1 as e0 from (select fund_id, w, f, b, [[seq|cast(greatest(floor((rd - 49) / 4e0), 0) as int)|cast(least(floor((rd - 1) / 4e0), 29) as int)]] as j from al where rd <= 168) e1),
        a as (select fund_id, max(w) as w, round(52 * (avg(f) - (pow(1.065e0, 1 / 52e0) - 1) - regr_slope(f, b) * (avg(b) - (pow(1.065e0, 1 / 52e0) - 1))), 9) as a from e group by fund_id, e0 having count(*) = 52 and var_samp(b) > 1e-12),
        x as (select a.fund_id, fund.sector, a.w, a.a from a join fund on fund.fund_id = a.fund_id where abs(a.a) < 1),
        m as (select sector, w, median(a) as peer from x group by 1, 2 having count(*) >= 5)
        select x.fund_id, count(*) as n_windows, round(avg(case when x.a > m.peer then 1e0 else 0e0 end), 6) as hit_rate from x join m on m.sector = x.sector and m.w = x.w group by x.fund_id""",
    ),
    Operator("cf09_peer_hit_rate", "Share of a fund's starts above the median of its peers at the start, five peers at least.", "with x as (select sipx.fund_id, fund.sector, start, xirr from sipx join fund on fund.fund_id = sipx.fund_id where xirr is not null), m as (select sector, start, median(xirr) as peer from x group by 1, 2 having count(*) >= 5) select x.fund_id, count(*) as n_windows, round(avg(case when round(xirr, 9) > round(peer, 9) then 1e0 else 0e0 end), 6) as hit_rate from x join m on m.sector = x.sector and m.start = x.start group by x.fund_id"),
]

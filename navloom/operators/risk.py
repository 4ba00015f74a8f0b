"""Risk and drawdown measures: one row for each fund."""

from navloom.plans.text import IN_SPARK, Operator

RF = "((pow(1.065e0, 1 / 52e0) - 1))"
#: Of equal troughs the first, which DuckDB keeps; Spark's min_by keeps any.
IN_SPARK["min_by(w, dd) as w0, min_by(nav / (1 + dd), dd) as peak from wdd"] = "min_by(w, struct(dd, w)) as w0, min_by(nav / (1 + dd), struct(dd, w)) as peak from wdd"

OPERATORS = [
    Operator("rk01_volatility", "Annual volatility: sample and population, whole and last 13 and 52 weeks.", "select fund_id, round(stddev_samp(r) * sqrt(52), 8) as vol, round(stddev_pop(r) * sqrt(52), 8) as vol_pop, round(stddev_samp(case when rd <= 13 then r end) * sqrt(52), 8) as vol_13, round(stddev_samp(case when rd <= 52 then r end) * sqrt(52), 8) as vol_52 from wr group by fund_id"),
    Operator("rk02_downside_deviation", "Root mean square of returns under 0 and under the risk-free rate, annual; 0 without any.", f"select fund_id, round(coalesce(sqrt(avg(case when r < 0 then r * r end)), 0e0) * sqrt(52), 8) as down_zero, round(coalesce(sqrt(avg(case when r < {RF} then (r - {RF}) * (r - {RF}) end)), 0e0) * sqrt(52), 8) as down_rf from wr group by fund_id"),
    Operator("rk03_max_drawdown", "Deepest drawdown: weekly, daily filled, and of the last 156 weeks.", "with t as (select fund_id, nav / max(nav) over (partition by fund_id order by w rows between unbounded preceding and current row) - 1 as dd from wkn where rd <= 156), a as (select fund_id, min(dd) as weekly from wdd group by 1), b as (select fund_id, min(dd) as daily from ddd group by 1), c as (select fund_id, min(dd) as last_156 from t group by 1) select a.fund_id, round(weekly, 8) as weekly, round(b.daily, 8) as daily_dd, round(last_156, 8) as last_156 from a join b on a.fund_id = b.fund_id join c on a.fund_id = c.fund_id"),
    Operator("rk04_current_drawdown", "Last value against the peak, and against the peak of the last three years.", "select navd.fund_id, round(max_by(nav, day) / max(nav) - 1, 8) as current_dd, round(max_by(nav, day) / max(case when day >= d1 - 1095 then nav end) - 1, 8) as current_dd_3y from navd join span on span.fund_id = navd.fund_id group by navd.fund_id"),
    Operator("rk05_ulcer", "Root mean square of the percent drawdown of the daily filled series.", "select fund_id, round(sqrt(avg(1e4 * dd * dd)), 6) as ulcer from ddd group by fund_id"),
    Operator("rk06_pain", "Mean drawdown, and mean fall of the growth since the start from its peak over weeks under it, clipped to 0 .. 0.5.", "with c as (select fund_id, w, nav / first_value(nav) over (partition by fund_id order by w rows between unbounded preceding and current row) as g from wk), d as (select fund_id, g - max(g) over (partition by fund_id order by w rows between unbounded preceding and current row) as fall from c), p as (select fund_id, least(greatest(coalesce(-avg(case when fall < 0 then fall end), 0e0), 0e0), 0.5e0) as pain_fall from d group by 1) select mdd.fund_id, round(pain, 8) as pain, round(pain_fall, 8) as pain_fall from mdd join p on p.fund_id = mdd.fund_id"),
    Operator("rk07_cdar", "Conditional drawdown at risk by three rules of the worst 5 %.", "with r as (select fund_id, dd, row_number() over (partition by fund_id order by dd) as k, count(*) over (partition by fund_id) as n from wdd), q as (select fund_id, [[q|dd|0.05]] as q5 from wdd group by 1) select r.fund_id, round(avg(case when k <= greatest(2, ceil(0.05e0 * n)) then dd end), 8) as cdar_two, round(avg(case when k <= greatest(1, ceil(0.05e0 * n)) then dd end), 8) as cdar_one, round(avg(case when dd <= q5 then dd end), 8) as cdar_q from r join q on q.fund_id = r.fund_id group by r.fund_id"),
    Operator("rk08_cvar", "5 % quantile of weekly returns and the mean of those not above it.", "with q as (select fund_id, [[q|r|0.05]] as q5 from wr group by 1) select wr.fund_id, round(max(q5), 8) as var_5, round(avg(case when r <= q5 then r end), 8) as cvar_5 from wr join q on q.fund_id = wr.fund_id group by wr.fund_id"),
    Operator("rk09_sharpe", "Three-year growth less 6.5 % over volatility.", "select cagr3.fund_id, round((cagr - 0.065e0) / case when vol.vol > 1e-12 then vol.vol end, 6) as sharpe from cagr3 join vol on vol.fund_id = cagr3.fund_id"),
    Operator("rk10_sortino", "Sortino ratio: arithmetic, geometric and growth numerators.", f"with d as (select fund_id, sqrt(avg(case when r < {RF} then (r - {RF}) * (r - {RF}) end)) * sqrt(52) as dev, avg(r) as m from wr group by 1) select d.fund_id, round(52 * (m - {RF}) / case when dev > 1e-12 then dev end, 6) as arithmetic, round((pow(1 + m, 52) - 1 - 0.065e0) / case when dev > 1e-12 then dev end, 6) as geometric, round((cagr - 0.065e0) / case when dev > 1e-12 then dev end, 6) as growth from d join cagr3 on cagr3.fund_id = d.fund_id"),
    Operator("rk11_omega", "Gains over losses: against the risk-free rate, null without losses; against 0 from 20 rows on, 10 without losses.", f"select fund_id, round(sum(case when r > {RF} then r - {RF} else 0e0 end) / case when sum(case when r < {RF} then {RF} - r else 0e0 end) > 1e-12 then sum(case when r < {RF} then {RF} - r end) end, 6) as omega, round(case when count(*) >= 20 then coalesce(sum(case when r > 0 then r else 0e0 end) / nullif(-sum(case when r < 0 then r else 0e0 end), 0), 10e0) end, 6) as omega_zero from wr group by fund_id"),
    Operator("rk12_upside_potential", "Root mean square of gains over that of losses from 20 rows on; 5 without losses.", "select fund_id, round(case when count(*) >= 20 then coalesce(sqrt(avg(case when r > 0 then r * r end)) / nullif(sqrt(avg(case when r < 0 then r * r end)), 0), case when count(case when r < 0 then 1 end) = 0 then 5e0 end) end, 6) as upside from wr group by fund_id"),
    Operator("rk13_calmar", "Three-year growth over the depth of the deepest drawdown.", "select cagr3.fund_id, round(cagr / case when abs(mdd.mdd) > 1e-12 then abs(mdd.mdd) end, 6) as calmar from cagr3 join mdd on mdd.fund_id = cagr3.fund_id"),
    Operator("rk14_ulcer_performance", "Growth less 6.5 % in percent over the ulcer index.", "select cagr3.fund_id, round((cagr - 0.065e0) * 100 / case when ulcer > 1e-12 then ulcer end, 6) as upi from cagr3 join mdd on mdd.fund_id = cagr3.fund_id"),
    Operator("rk15_gain_to_pain", "Sum of returns over the sum of losses, at most 10.", "select fund_id, round(case when sum(case when r < 0 then r else 0e0 end) < -1e-12 then least(10e0, sum(r) / -sum(case when r < 0 then r else 0e0 end)) end, 6) as gain_to_pain from wr group by fund_id"),
    Operator("rk16_tail_ratio", "95 % quantile over the size of the 5 % quantile, at most 5.", "select fund_id, round(least(5e0, [[q|r|0.95]] / nullif(abs([[q|r|0.05]]), 0)), 6) as tail_ratio from wr group by fund_id"),
    Operator("rk17_skew", "Bias-corrected skewness from 30 rows on; deviation of losses over that of gains.", "select fund_id, round(case when count(r) >= 30 then [[skew|r]] end, 6) as skew, round(stddev_samp(case when r < 0 then r end) / nullif(stddev_samp(case when r > 0 then r end), 0), 6) as down_up from wr group by fund_id"),
    Operator("rk18_vol_contraction", "Volatility of 13 weeks over that of 52.", "select fund_id, round(case when max(n) >= 52 then stddev_samp(case when rd <= 13 then r end) / nullif(stddev_samp(case when rd <= 52 then r end), 0) end, 6) as contraction from wr group by fund_id"),
    Operator("rk19_hurst", "Slope of the log deviation of lagged differences on the log lag, lags 2 to 19.", "with l as (select fund_id, ra, ln(nav) as v from wkn), e as (select fund_id, ra, v, [[seq|2|19]] as lag from l), d as (select a.fund_id, a.lag, stddev_pop(b.v - a.v) as s from e a join l b on b.fund_id = a.fund_id and b.ra = a.ra + a.lag group by 1, 2) select fund_id, round(regr_slope(ln(s), ln(cast(lag as double))), 6) as hurst from d where s > 1e-12 group by fund_id"),
    Operator("rk20_autocorrelation", "Correlation of a week's return with the week's before.", "select fund_id, round(corr(r, p), 6) as lag1 from (select fund_id, r, lag(r) over (partition by fund_id order by w) as p from wr) x where p is not null group by fund_id having count(*) >= 10"),
    Operator("rk21_recovery_half_life", "Weeks from the deepest trough until half of the drawdown is made good; null if no deeper than 5 % or under 30 rows, the rows left if never.", "with t as (select fund_id, min(dd) as dd0, min_by(w, dd * 1e6 + ra * 1e-9) as w0 from wdd where n >= 30 group by 1) select t.fund_id, round(case when max(dd0) >= -0.05e0 then null else coalesce((min(case when d.dd >= dd0 / 2 then d.w end) - max(w0)) / 7e0, cast(count(*) as double)) end, 4) as half_life from t join wdd d on d.fund_id = t.fund_id and d.w >= t.w0 group by t.fund_id"),
    Operator(
        "rk21_recovery_rows",
        "The same in rows, one at least: null under 20 rows or where the trough is the last row, 1 for a drawdown of 0.5 % at most, the rows after the trough if never.",
        """
        with lowest as (select fund_id, max(n) as n, min(dd) as low from wdd where n >= 20 group by 1),
        t as (select l.fund_id, l.n, l.low, min(d.ra) as at from lowest l join wdd d on d.fund_id = l.fund_id and d.dd = l.low group by 1, 2, 3)
        select t.fund_id, round(case when max(t.at) = max(t.n) then null when max(t.low) >= -0.005e0 then 1e0
                 else coalesce(greatest(1, min(case when d.dd >= t.low / 2 then d.ra - t.at end)), max(t.n) - max(t.at)) * 1e0 end, 4) as half_life
        from t left join wdd d on d.fund_id = t.fund_id and d.ra > t.at group by t.fund_id""",
    ),
    Operator(
        "rk21_recovery_growth",
        "Rows from the deepest fall of the compounded returns to half of the peak before: 40 under 30 rows, 20 for a fall of less than 5 %, 60 if never.",
        """
        with g as (select fund_id, ra, n, cf, pf, (cf - pf) / (pf + 1e-9) as dd from cum), l as (select fund_id, max(n) as n, min(dd) as low from g group by 1),
        t as (select l.fund_id, l.n, l.low, min(g.ra) as at, min_by(g.pf, g.ra) as peak from l join g on g.fund_id = l.fund_id and g.dd = l.low group by 1, 2, 3)
        select t.fund_id, case when max(t.n) < 30 then 40e0 when max(t.low) > -0.05e0 then 20e0
                 else coalesce(min(case when g.cf >= t.peak * 0.5e0 then g.ra - t.at end) * 1e0, 60e0) end as half_life
        from t join g on g.fund_id = t.fund_id and g.ra >= t.at group by t.fund_id""",
    ),
    Operator("rk22_recovery_to_peak", "Weeks from the deepest trough to 99.5 % of the peak before; the rows left if never.", "with t as (select fund_id, min_by(w, dd) as w0, min_by(nav / (1 + dd), dd) as peak from wdd where n >= 2 group by 1) select t.fund_id, round(coalesce((min(case when d.nav >= 0.995e0 * peak then d.w end) - max(w0)) / 7e0, cast(count(*) as double)), 4) as weeks from t join wdd d on d.fund_id = t.fund_id and d.w >= t.w0 group by t.fund_id"),
    Operator("rk23_drawdown_episodes", "Runs of weeks under the peak: how many, mean and longest length; an open run counts.", "with f as (select fund_id, w, case when dd < -1e-9 then 1 else 0 end as down from wdd), g as (select fund_id, w, down, case when down = 1 and coalesce(lag(down) over (partition by fund_id order by w), 0) = 0 then 1 else 0 end as start from f), i as (select fund_id, w, down, sum(start) over (partition by fund_id order by w rows between unbounded preceding and current row) as run from g), e as (select fund_id, run, count(*) as weeks, max(w) - min(w) as days from i where down = 1 group by 1, 2) select fund_id, count(*) as n_runs, round(avg(weeks), 6) as mean_weeks, max(weeks) as longest_weeks, max(days) as longest_days from e group by fund_id"),
    Operator("rk24_trend_slope_90d", "Annual slope of the log value over the last 90 days where they are half covered.", "select navd.fund_id, round(case when max(day) - min(day) >= 45 then regr_slope(ln(nav), cast(day as double)) * 365.25 end, 4) as slope from navd join span on span.fund_id = navd.fund_id where day >= d1 - 90 group by navd.fund_id"),
    Operator("rk25_trend_residual", "How many deviations the last log value is from its linear trend of five years.", "with x as (select navd.fund_id, day - d0 as t, ln(nav) as v, d1 - d0 as t1 from navd join span on span.fund_id = navd.fund_id where day >= d1 - 1826), s as (select fund_id, regr_slope(v, cast(t as double)) as a, regr_intercept(v, cast(t as double)) as c from x group by 1), r as (select x.fund_id, t, v - (a * t + c) as e from x join s on s.fund_id = x.fund_id) select fund_id, round(max_by(e, t) / case when stddev_pop(e) > 1e-12 then stddev_pop(e) end, 5) as residual from r group by fund_id having count(*) >= 20"),
    Operator("rk26_tactical_noise", "Deviation of returns from their mean of four weeks, clipped to 0 .. 0.05.", "with m as (select fund_id, r - avg(r) over (partition by fund_id order by w rows between 3 preceding and current row) as e from wr) select fund_id, round(least(greatest(stddev_pop(e), 0e0), 0.05e0), 8) as noise from m group by fund_id"),
]

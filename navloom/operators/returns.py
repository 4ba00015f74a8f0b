"""Return measures of a fund: one row for each fund, null where the history is too short."""

from navloom.plans.text import Operator


def at(n: int, table: str = "wkn") -> str:
    return f"max(case when rd = {n} then nav end)"


def change(n: int) -> str:
    """Change over the last n weeks, null when the series is shorter."""
    return f"({at(1)} / {at(n + 1)} - 1)"


OPERATORS = [
    Operator("rt01_period_return", "Changes over the last 4, 13, 26 and 52 weeks.", f"select fund_id, round({change(4)}, 8) as r4, round({change(13)}, 8) as r13, round({change(26)}, 8) as r26, round({change(52)}, 8) as r52 from wkn group by fund_id"),
    Operator("rt02_cagr_periods", "Annual growth over 52, 156 and 260 weeks.", f"select fund_id, round(pow({at(1)} / {at(53)}, 1e0) - 1, 8) as cagr_1y, round(pow({at(1)} / {at(157)}, 1 / 3e0) - 1, 8) as cagr_3y, round(pow({at(1)} / {at(261)}, 1 / 5e0) - 1, 8) as cagr_5y from wkn group by fund_id"),
    Operator("rt03_cagr_calendar", "Annual growth over the last {years} years by the calendar, where the window covers {share} of it.", "with e as (select navd.fund_id, day, nav, d1 from navd join span on span.fund_id = navd.fund_id where day >= d1 - cast(floor({years} * 365.25) as int)) select fund_id, round(case when max(day) - min(day) >= {share} * {years} * 365.25 then pow(max_by(nav, day) / min_by(nav, day), 365.25e0 / nullif(max(day) - min(day), 0)) - 1 end, 8) as cagr from e group by fund_id", {"years": 3, "share": "0.85"}),
    Operator("rt04_cagr_whole", "Annual growth of the whole series, from a year on.", "select fund_id, round(case when max(day) - min(day) >= 365 then pow(max_by(nav, day) / min_by(nav, day), 365.25e0 / nullif(max(day) - min(day), 0)) - 1 end, 8) as cagr, max(day) - min(day) as days from navd group by fund_id"),
    Operator("rt05_trailing_return", "Absolute change in percent over 1, 3 and 5 years to the last day, start value at or before.", "with t as (select fund_id, d1, y, d1 - cast(floor(y * 365.25) as int) as t0 from span cross join (select 1 as y union all select 3 union all select 5) k), s as (select t.fund_id, t.y, max_by(navd.nav, navd.day) as v0 from t join navd on navd.fund_id = t.fund_id and navd.day <= t.t0 group by 1, 2), e as (select fund_id, max_by(nav, day) as v1 from navd group by 1) select e.fund_id, round(100 * (max(case when y = 1 then v1 / v0 end) - 1), 2) as ret_1y, round(100 * (max(case when y = 3 then v1 / v0 end) - 1), 2) as ret_3y, round(100 * (max(case when y = 5 then v1 / v0 end) - 1), 2) as ret_5y from e left join s on s.fund_id = e.fund_id group by e.fund_id"),
    Operator("rt06_first_date", "First day of each fund.", "select fund_id, [[ymd|min(ts)]] as first_date from nav group by fund_id"),
    Operator("rt07_momentum_180d", "Change over the last 180 days, from five rows on.", "select navd.fund_id, round(case when count(*) >= 5 then max_by(nav, day) / min_by(nav, day) - 1 end, 8) as momentum from navd join span on span.fund_id = navd.fund_id where day >= d1 - 180 group by navd.fund_id"),
    Operator("rt08_momentum_quality", "Weighted relative changes over 13, 26 and 52 weeks against volatility, less overextension and short reversal.", f"with j as (select wk.fund_id, wk.w, wk.nav, bwk.nav as bn from wk join fund on fund.fund_id = wk.fund_id join bwk on bwk.index_id = fund.sector and bwk.w = wk.w), r as (select *, row_number() over (partition by fund_id order by w desc) as rd, nav / lag(nav) over (partition by fund_id order by w) - 1 as r, avg(nav) over (partition by fund_id order by w rows between 39 preceding and current row) as ma, count(*) over (partition by fund_id) as n from j), a as (select fund_id, max(n) as n, {change(4)} - (max(case when rd = 1 then bn end) / max(case when rd = 5 then bn end) - 1) as e4, {change(13)} - (max(case when rd = 1 then bn end) / max(case when rd = 14 then bn end) - 1) as e13, {change(26)} - (max(case when rd = 1 then bn end) / max(case when rd = 27 then bn end) - 1) as e26, {change(52)} - (max(case when rd = 1 then bn end) / max(case when rd = 53 then bn end) - 1) as e52, stddev_samp(case when rd <= 26 then r end) * sqrt(52) as vol26, max(case when rd = 1 then nav / ma end) as ext from r group by fund_id) select fund_id, round(case when n >= 53 then (0.25e0 * e13 + 0.45e0 * e26 + 0.3e0 * e52) / greatest(0.08e0, vol26) - 0.65e0 * greatest(0e0, ext - 1.12) - 0.2e0 * greatest(0e0, e4) end, 6) as quality from a"),
    Operator(
        "rt08_momentum_over_volatility",
        "Mean of what there is of the 13-, 26- and 52-week changes and the 26-week lead on the benchmark, over the volatility of 52 weeks.",
        f"""
        with b as (select index_id, w, nav / lag(nav, 26) over (partition by index_id order by w) - 1 as b26, row_number() over (partition by index_id order by w desc) as rb from bwk),
        f as (select fund_id, {change(13)} as r13, {change(26)} as r26, {change(52)} as r52 from wkn group by fund_id),
        v as (select fund_id, stddev_samp(r) * sqrt(52) as v52 from wr where rd <= 52 group by 1),
        m as (select f.fund_id, r13, r26, r52, r26 - b26 as lead26, v52 from f join fund on fund.fund_id = f.fund_id
              left join b on b.index_id = fund.sector and b.rb = 1 left join v on v.fund_id = f.fund_id)
        select fund_id, round((coalesce(r13, 0e0) + coalesce(r26, 0e0) + coalesce(r52, 0e0) + coalesce(lead26, 0e0))
                 / nullif(case when r13 is null then 0 else 1 end + case when r26 is null then 0 else 1 end + case when r52 is null then 0 else 1 end + case when lead26 is null then 0 else 1 end, 0)
                 / case when v52 > 0 then v52 else 1e0 end, 6) as quality from m""",
    ),
    Operator(
        "rt08_momentum_less_overextension",
        "0.3, 0.4 and 0.3 of the 13-, 26- and 52-week changes less twice what the value is over its 40-week mean beyond 8 %; 0 under 60 weeks.",
        f"""
        with m as (select *, avg(nav) over (partition by fund_id order by w rows between 39 preceding and current row) as ma from wkn)
        select fund_id, round(case when max(n) < 60 then 0e0 else 0.3e0 * {change(13)} + 0.4e0 * {change(26)} + 0.3e0 * {change(52)}
                 - 2 * greatest(0e0, max(case when rd = 1 then nav / ma end) - 1 - 0.08e0) end, 6) as quality from m group by fund_id""",
    ),
    Operator(
        "rt09_information_momentum",
        "Mean over deviation of the daily excess of the last 90 and 180 days, annualised; the index carried forward onto the fund's days; 0 under 20 values or without deviation.",
        """
        with s as (select navd.fund_id, navd.day, navd.nav, h.days, idxd.nav as b0
                   from navd join span on span.fund_id = navd.fund_id join fund on fund.fund_id = navd.fund_id cross join (select 90 as days union all select 180) h
                   left join idxd on idxd.index_id = fund.sector and idxd.day = navd.day where navd.day >= span.d1 - h.days),
        f as (select fund_id, days, day, nav, [[last|b0]] over (partition by fund_id, days order by day rows between unbounded preceding and current row) as b from s),
        x as (select fund_id, days, nav / lag(nav) over (partition by fund_id, days order by day) - b / lag(b) over (partition by fund_id, days order by day) as excess from f),
        g as (select fund_id, days, case when count(*) < 20 or count(excess) = 0 or stddev_samp(excess) < 1e-15 then 0e0 else avg(excess) / stddev_samp(excess) * sqrt(252) end as v from x group by 1, 2)
        select fund_id, round(max(case when days = 90 then v end), 6) as m90, round(max(case when days = 180 then v end), 6) as m180 from g group by fund_id""",
    ),
    Operator("rt10_acceleration", "Mean of the last 8 returns less that of the last 26.", "select fund_id, round(case when max(n) >= 26 then avg(case when rd <= 8 then r end) - avg(case when rd <= 26 then r end) end, 10) as acceleration from wr group by fund_id"),
    Operator("rt11_overheat", "Changes over 13 and 26 weeks, and how near to its peak the fund is.", f"select fund_id, round({change(13)}, 8) as r13, round({change(26)}, 8) as r26, round(greatest(0e0, max(case when rd = 1 then dd end) + 0.015e0), 8) as overheat from wdd group by fund_id"),
    Operator("rt12_cagr_stability", "Three-year growth less its distance from five-year growth, horizons cut to the history.", "with h as (select *, least(156, n - 1) as h3, least(260, n - 1) as h5 from wkn), c as (select fund_id, pow(max(case when rd = 1 then nav end) / max(case when rd = h3 + 1 then nav end), 52e0 / nullif(max(h3), 0)) - 1 as c3, pow(max(case when rd = 1 then nav end) / max(case when rd = h5 + 1 then nav end), 52e0 / nullif(max(h5), 0)) - 1 as c5 from h group by fund_id) select fund_id, round(c3 - abs(c3 - c5), 8) as stability from c"),
    Operator("rt13_vol_drag", "Annual mean return less half the annual variance.", "select fund_id, round(52 * avg(r) - 0.5e0 * 52 * var_samp(r), 8) as adjusted from wr group by fund_id"),
]

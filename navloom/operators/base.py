"""Cleaning, predicates, resampling, alignment and joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.plans.steps import WEEK
from navloom.plans.text import Operator

_KEEP = "select fund_id, ts, nav from (select fund_id, ts, nav, row_number() over (partition by fund_id, ts order by seq {order}) as k from nav_raw where ts is not null and nav > 0) x where k = 1"


def _week(anchor: int) -> str:
    return f"day + (({anchor} - day) % 7 + 7) % 7"


def wide(rows: DataFrame, index: str, key: str, value: str) -> DataFrame:
    """A row for each value of index, a column for each value that key has; Spark's limit is spark.sql.pivotMaxValues columns."""
    return rows.groupBy(index).pivot(key).agg(F.first(value, ignorenulls=True))


#: Keys of a holding's weight, in the order in which they are tried. Fixed values.
WEIGHT_KEYS = ("nav", "allocation", "allocationPct", "weight", "holdingPct", "percent", "pct", "holding", "portfolioShare")


def _usable(key: str) -> str:
    x = f"try_cast({key} as double)"
    return f"case when {x} > 0 and {x} <= 1.0001e0 then {x} * 100 when {x} > 1 and {x} <= 100 then {x} end"


OPERATORS = [
    Operator("prj01_clean_nav_last", "One positive value for each fund and timestamp, the last landed.", _KEEP.replace("{order}", "desc")),
    Operator("prj01_clean_nav_first", "The same, the first landed.", _KEEP.replace("{order}", "asc")),
    Operator(
        "prj02_universe",
        "Funds of a sector and of some subsectors, or with two words in the subsector.",
        "select fund_id, name, sector, subsector from fund where (sector = '{sector}' and subsector in ({subsectors})) or (contains(subsector, '{word}') and contains(subsector, '{other}'))",
        {"sector": "ASIA", "subsectors": "'NATION_2', 'NATION_12'", "word": "NATION", "other": "_1"},
    ),
    Operator("prj03_name_pattern", "Funds whose name has one of two patterns, by name.", "select fund_id, name from fund where contains(name, '{a}') or contains(name, '{b}') order by name", {"a": "01", "b": "7"}),
    Operator("prj04_point_in_time", "Rows of each series up to each as-of date: count, last day and value; later rows never count.", """
        with grid as (select distinct cast(date_trunc('year', ts) as date) as as_of from nav),
        y as (select fund_id, count(*) as k, max(ts) as last_ts, max_by(nav, ts) as last_nav,
                     case when ts = cast(date_trunc('year', ts) as date) then ts else cast(date_trunc('year', [[months|ts|12]]) as date) end as as_of from nav group by fund_id, 5),
        g as (select s.fund_id, grid.as_of from (select distinct fund_id from nav) s cross join grid),
        r as (select g.fund_id, g.as_of, sum(y.k) over w as n, [[last|y.last_ts]] over w as last_ts, [[last|y.last_nav]] over w as last_nav
              from g left join y on y.fund_id = g.fund_id and y.as_of = g.as_of window w as (partition by g.fund_id order by g.as_of rows between unbounded preceding and current row))
        select fund_id, as_of, cast(n as bigint) as n, last_ts, last_nav from r where n is not null"""),
    Operator("prj05_eligibility", "Enough rows, enough days, and no end long before the benchmark's; the rest are named with the reason.", "with s as (select fund.fund_id, fund.sector, coalesce(count(day), 0) as n, max(day) - min(day) as d, max(day) as d1 from fund left join navd on navd.fund_id = fund.fund_id group by 1, 2), b as (select index_id, max(day) as b1 from idxd group by 1) select fund_id, n, d, case when n < {rows} then 'rows' when d < {days} then 'days' when b1 - d1 > {late} then 'stale' else 'ok' end as status from s left join b on b.index_id = s.sector", {"rows": 60, "days": 1095, "late": 45}),
    Operator(
        "prj07_holding_weight",
        "A holding's weight in percent: the reported one, 100 at most, else the first usable of nine other keys, where up to 1.0001 is a share.",
        f"select fund_id, sid, round(coalesce(case when latest > 0 then least(latest, 100e0) end, {', '.join(_usable(k) for k in WEIGHT_KEYS)}), 8) as weight_pct from holding_raw",
    ),
    Operator(
        "prj08_presentation",
        "Percents and ratios rounded and as text, nulls as words or empty.",
        """
        select fund_id, [[round|100 * cagr|2]] as cagr_pct, case when cagr is null then 'N/A (insufficient history)' else concat([[fixed|[[round|100 * cagr|2]]|2]], '%') end as cagr_text,
               coalesce([[fixed|[[round|100 * mdd|2]]|2]], '') as mdd_text, [[round|ir|3]] as ir_ratio, [[round|beta|4]] as beta_ratio,
               case when ir is null then 'N/A (not ranked)' else [[fixed|[[round|ir|3]]|3]] end as ir_text
        from feat""",
    ),
    Operator("ts01_daily_fill", "Every calendar day from a fund's first to its last, the last known value carried.", "select fund_id, [[date|day]] as ts, nav from daily"),
    Operator("ts02_weekly_friday", "Last value of each week that ends on Friday.", "select fund_id, [[date|w]] as week, nav from wk"),
    Operator("ts02_weekly_monday", "Last value of each week that ends on Monday.", f"select fund_id, [[date|{_week(4)}]] as week, max_by(nav, day) as nav from navd group by 1, 2"),
    Operator("ts02_weekly_sunday", "Last value of each week that ends on Sunday.", f"select fund_id, [[date|{_week(3)}]] as week, max_by(nav, day) as nav from navd group by 1, 2"),
    Operator("ts03_weekly_bounded_fill", "Weekly values with empty weeks filled from at most two weeks before.", "with e as (select fund_id, min(w) as w0, max(w) as w1 from wk group by 1), g as (select fund_id, w0 + 7 * i as w from (select fund_id, w0, [[seq|0|cast((w1 - w0) / 7 as int)]] as i from e) y) select fund_id, [[date|w]] as week, nav from (select g.fund_id, g.w, [[last|wk.nav]] over (partition by g.fund_id order by g.w rows between 2 preceding and current row) as nav from g left join wk on wk.fund_id = g.fund_id and wk.w = g.w) x where nav is not null"),
    Operator("ts04_month_start_filled", "Value at the first of each month of the daily filled series; the first, partial month has the first value.", "select fund_id, m as month, nav from mon"),
    Operator("ts04_month_start_observed", "First observed value of each month.", "select fund_id, cast(date_trunc('month', ts) as date) as month, min_by(nav, ts) as nav from nav where nav > 0 group by 1, 2"),
    Operator("ts05_month_end", "Last value of fund and benchmark in each month, over days that both have.", "select nav.fund_id, last_day(nav.ts) as month_end, max_by(nav.nav, nav.ts) as nav, max_by(index_nav.nav, nav.ts) as bench from nav join fund on nav.fund_id = fund.fund_id join index_nav on index_nav.index_id = fund.sector and index_nav.ts = nav.ts group by 1, 2"),
    Operator("ts06_align_limit_one", "A fund's values on the benchmark's calendar: the last at or before, for one unmatched date after a match at most.", "with c as (select fund.fund_id, idxd.day from fund join idxd on idxd.index_id = fund.sector join span on span.fund_id = fund.fund_id and idxd.day >= d0), m as (select c.fund_id, c.day, navd.nav as exact from c left join navd on navd.fund_id = c.fund_id and navd.day = c.day), g as (select fund_id, day, exact, [[last|exact]] over (partition by fund_id order by day rows between 1 preceding and current row) as nav from m) select fund_id, [[date|day]] as ts, nav from g where nav is not null"),
    Operator("ts06_align_unlimited", "The same without a limit.", "with c as (select fund.fund_id, idxd.day from fund join idxd on idxd.index_id = fund.sector) select fund_id, [[date|day]] as ts, nav from (select c.fund_id, c.day, [[last|navd.nav]] over (partition by c.fund_id order by c.day rows between unbounded preceding and current row) as nav from c left join navd on navd.fund_id = c.fund_id and navd.day = c.day) x where nav is not null"),
    Operator("ts07_period_change", "Change over {n} rows; the first rows have none and are left out.", "select fund_id, ts, round(r, 10) as r from (select fund_id, ts, nav / lag(nav, {n}) over (partition by fund_id order by ts) - 1 as r from nav where nav > 0) x where r is not null", {"n": 1}),
    Operator(
        "ts08_period_changes",
        "Each fund on each day that it has a value: change over {short} and {long} days of the calendar of all funds; a gap gives a null. `wide` makes the matrix.",
        """
        with cal as (select day, row_number() over (order by day) as i from (select distinct day from navd) d),
        x as (select navd.fund_id, cal.i, navd.day, nav from navd join cal on cal.day = navd.day)
        select x.fund_id, [[date|x.day]] as ts, round(x.nav / p.nav - 1, 10) as r_short, round(x.nav / q.nav - 1, 10) as r_long
        from x left join x p on p.fund_id = x.fund_id and p.i = x.i - {short} left join x q on q.fund_id = x.fund_id and q.i = x.i - {long}""",
        {"short": 63, "long": 126},
    ),
    Operator("ts09_blended_baseline", "Index of three proxies on weeks that all have, weights .58/.17/.10 and 15 % cash at the risk-free rate, from 100.", "select [[date|w]] as week, round(100 * exp(sum(ln(1 + r)) over (order by w rows between unbounded preceding and current row)), 6) as level from (select w, 0.58e0 * x1 + 0.17e0 * x2 + 0.1e0 * x3 + 0.15e0 * ((pow(1.065e0, 1 / 52e0) - 1)) as r from fac) x"),
    Operator(
        "ts09_baseline_without_silver",
        "The same of two proxies, weights .60/.25 and 15 % cash, on weeks that both have.",
        """
        with two as (select w, max(case when index_id = 'AFRICA' then r end) as x1, max(case when index_id = 'AMERICA' then r end) as x2 from bwr
                     where index_id in ('AFRICA', 'AMERICA') group by w having count(*) = 2)
        select [[date|w]] as week, round(100 * exp(sum(ln(1 + 0.6e0 * x1 + 0.25e0 * x2 + 0.15e0 * (pow(1.065e0, 1 / 52e0) - 1)))
                                            over (order by w rows between unbounded preceding and current row)), 6) as level from two""",
    ),
    Operator("jn01_aligned_returns", "Weekly returns of fund and benchmark on weeks that both have.", "select fund_id, [[date|w]] as week, round(f, 10) as fund_r, round(b, 10) as bench_r from al"),
    Operator("jn02_factor_join", "Fund returns with three factor returns on common weeks.", "select fund_id, [[date|w]] as week, round(f, 10) as r, round(x1, 10) as x1, round(x2, 10) as x2, round(x3, 10) as x3 from alf"),
    Operator(
        "jn03_score_outer_join",
        "All funds of any model with the score of each; the name from the first model that has one.",
        """
        with n as (select fund_id, min_by(name, model) as name from model_name where name is not null group by 1)
        select s.fund_id, max(n.name) as name, max(case when model = 'M1' then score end) as score_m1, max(case when model = 'M2' then score end) as score_m2,
               max(case when model = 'M3' then score end) as score_m3, max(case when model = 'M4' then score end) as score_m4
        from model_score s left join n on n.fund_id = s.fund_id group by s.fund_id""",
    ),
    Operator("jn04_base_date_join", "Funds that have a value in the first year, with their value at each later year end.", "with y as (select fund_id, year(ts) as y, max_by(nav, ts) as nav from nav group by 1, 2), b as (select min(y) as y0 from y), f as (select fund_id from y join b on y = y0) select f.fund_id, y.y as run_year, y.nav from f left join y on y.fund_id = f.fund_id"),
    Operator("jn05_asof_forward", "First value on or after each quarter start, at most {days} days later.", "with t as (select distinct [[day|cast(date_trunc('quarter', ts) as date)]] as t from nav), u as (select fund_id, day, nav, 1 as k, cast(null as int) as t from navd union all select span.fund_id, t.t, null, 0, t.t from span cross join t), w as (select fund_id, t, day, [[first|nav]] over (partition by fund_id order by day, k rows between current row and unbounded following) as nav, [[first|case when k = 1 then day end]] over (partition by fund_id order by day, k rows between current row and unbounded following) as hit from u) select fund_id, [[date|t]] as target, nav, [[date|hit]] as at_ts from w where t is not null and hit - t <= {days}", {"days": 10}),
    Operator("jn06_asof_backward", "Last value on or before each quarter start, at most {days} days earlier.", "with t as (select distinct [[day|cast(date_trunc('quarter', ts) as date)]] as t from nav), u as (select fund_id, day, nav, 0 as k, cast(null as int) as t from navd union all select span.fund_id, t.t, null, 1, t.t from span cross join t), w as (select fund_id, t, [[last|nav]] over (partition by fund_id order by day, k rows between unbounded preceding and current row) as nav, [[last|case when k = 0 then day end]] over (partition by fund_id order by day, k rows between unbounded preceding and current row) as hit from u) select fund_id, [[date|t]] as target, nav, [[date|hit]] as at_ts from w where t is not null and t - hit <= {days}", {"days": 10}),
    Operator("jn07_nearest", "For each fund and month start the nearest benchmark day within 21 days; of two as near the later.", "with t as (select distinct fund.fund_id, fund.sector, [[day|m]] as t from mon join fund on fund.fund_id = mon.fund_id), c as (select t.fund_id, t.t, idxd.day, row_number() over (partition by t.fund_id, t.t order by abs(idxd.day - t.t), idxd.day desc) as k from t join idxd on idxd.index_id = t.sector and idxd.day between t.t - 21 and t.t + 21) select fund_id, [[date|t]] as start, [[date|day]] as nearest from c where k = 1"),
    Operator("jn08_key_intersection", "Weeks with at least five funds that have both a value and a value a year later.", "with p as (select a.fund_id, a.w from wk a join wk b on a.fund_id = b.fund_id and b.w = a.w + 364) select [[date|w]] as week, count(*) as n_funds from p group by w having count(*) >= 5"),
    Operator("jn09_calendar_union", "All weeks of three indices, with the constant weekly cash return.", "select [[date|w]] as week, round((pow(1.065e0, 1 / 52e0) - 1), 10) as cash_r, count(*) as n_indices from (select distinct index_id, w from bwr where index_id in ('AFRICA', 'AMERICA', 'ASIA')) x group by w"),
]

"""Cross-sectional scores, ranks, ensembles, rank histories, holdings and reports."""

from navloom.plans.text import Model, Operator

#: Model scores scaled within each sector and model: z-score, then 0 .. 1; a fund that a model does not rank has 0.
_COMPILED = """
    select f.fund_id, f.sector, m.model, case when s.score is null then 0e0 when sd is null or sd < 1e-12 then 0.5e0 else ((s.score - mu) / sd - (least_s - mu) / sd) / ((most_s - mu) / sd - (least_s - mu) / sd) end as scaled
    from (select distinct fund.fund_id, fund.sector from model_score join fund on fund.fund_id = model_score.fund_id) f
    join (select fund.sector, model, avg(score) as mu, stddev_samp(score) as sd, min(score) as least_s, max(score) as most_s from model_score join fund on fund.fund_id = model_score.fund_id group by 1, 2) m
      on m.sector = f.sector left join model_score s on s.fund_id = f.fund_id and s.model = m.model"""
_FINAL = f"select fund_id, sector, round(avg(scaled), 3) as final_score from ({_COMPILED}) c group by 1, 2"
#: Normal distribution function by a rational approximation. Fixed values.
_T = "(1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0)))"
_ERF = f"(1 - {_T} * (0.254829592e0 + {_T} * (-0.284496736e0 + {_T} * (1.421413741e0 + {_T} * (-1.453152027e0 + {_T} * 1.061405429e0)))) * exp(-({{z}}) * ({{z}}) / 2))"
_PHI = f"(0.5e0 * (1 + case when {{z}} < 0 then -{_ERF} else {_ERF} end))"
#: Themes and the words that name a holding's sector as part of them. Fixed values.
THEMES = {
    "financials": ("Financial", "Bank", "NBFC", "Insurance", "Capital Markets"),
    "infra_auto": ("Auto", "Cement", "Construction", "Infrastructure", "Real Estate", "Utilities"),
    "consumption_rural": ("FMCG", "Consumer", "Retail", "Two Wheeler", "Tractor", "Durables"),
    "manufacturing_green": ("Manufacturing", "Capital Goods", "Renewable", "Power", "Telecom", "IT"),
}
_IN_THEMES = " + ".join("case when " + " or ".join(f"contains(lower(sector), '{w.lower()}')" for w in words) + " then 1 else 0 end" for words in THEMES.values())
_HISTORY = "select y.fund_id, y.y, row_number() over (partition by y.y order by y.ret desc, y.fund_id) as k from (select fund_id, y, round(max_by(nav, day) / min_by(nav, day) - 1, 9) as ret from (select fund_id, year([[date|day]]) as y, day, nav from navd) d group by 1, 2) y where y.y between 1997 and 2000"
#: The same for all years.
_RUNS = _HISTORY.replace(" where y.y between 1997 and 2000", "")
_HR = "select fund_id, sid, title, type, sector, latest, change3m, row_number() over (partition by fund_id order by latest desc, sid) as k, sum(case when latest > 0 then latest end) over (partition by fund_id) as total from holding"

OPERATORS = [
    Operator("scr01_percentile_rank", "Average-rank percentile of each measure within its sector; nulls stay.", "select fund_id, metric, round(p, 6) as p, round(100 - p, 6) as reversed, round(coalesce(p, 50e0), 6) as filled from pct"),
    Model("scr02_winsorised_percentile", "Percentile rank after clipping to the 5 % and 95 % quantiles.", "with c as (select featl.fund_id, fund.sector, featl.metric, case when x is not null then least(greatest(x, lo), hi) end as x from featl join fund on fund.fund_id = featl.fund_id left join measure_quantiles q on q.sector = fund.sector and q.metric = featl.metric) select fund_id, metric, round(case when x is not null then 100 * (rank() over (partition by sector, metric, x is null order by x) + (count(*) over (partition by sector, metric, x) - 1) / 2e0) / count(x) over (partition by sector, metric) end, 6) as p from c"),
    Operator("scr03_zscore", "z-score within the sector, 0 where all are equal.", "select featl.fund_id, metric, round(case when x is null then null when coalesce(stddev_samp(x) over (partition by fund.sector, metric), 0e0) < 1e-12 then 0e0 else (x - avg(x) over (partition by fund.sector, metric)) / nullif(stddev_samp(x) over (partition by fund.sector, metric), 0) end, 5) as z from featl join fund on fund.fund_id = featl.fund_id"),
    Operator(
        "scr04_robust_zscore",
        "(x - median) over 1.4826 times the median distance within the sector (1 where that is 0), clipped to 3 and to 3.5; null gives 0.",
        """
        with l as (select featl.fund_id, fund.sector, metric, x from featl join fund on fund.fund_id = featl.fund_id),
        m as (select sector, metric, median(x) as med from l group by 1, 2),
        d as (select l.sector, l.metric, median(abs(x - med)) as mad from l join m on m.sector = l.sector and m.metric = l.metric group by 1, 2),
        z as (select l.fund_id, l.metric, (x - med) / (1.4826e0 * case when mad > 1e-12 then mad else 1e0 end) as z
              from l join m on m.sector = l.sector and m.metric = l.metric join d on d.sector = l.sector and d.metric = l.metric)
        select fund_id, metric, round(coalesce(least(greatest(z, -3e0), 3e0), 0e0), 6) as z, round(coalesce(least(greatest(z, -3.5e0), 3.5e0), 0e0), 6) as z_wide from z""",
    ),
    Operator(
        "scr04_clipped_zscore",
        "The same after clipping to the 5 % and 95 % quantiles; by mean and population deviation where the median distance is 0; 0 under two values.",
        """
        with l as (select featl.fund_id, fund.sector, metric, x from featl join fund on fund.fund_id = featl.fund_id),
        q as (select sector, metric, [[q|x|0.05]] as lo, [[q|x|0.95]] as hi from l group by 1, 2 having count(x) >= 2),
        c as (select l.fund_id, l.sector, l.metric, case when x is not null then least(greatest(x, lo), hi) end as x from l left join q on q.sector = l.sector and q.metric = l.metric),
        m as (select sector, metric, median(x) as med, avg(x) as mu, stddev_pop(x) as sd from c group by 1, 2),
        d as (select c.sector, c.metric, median(abs(x - med)) as mad from c join m on m.sector = c.sector and m.metric = c.metric group by 1, 2)
        select c.fund_id, c.metric, round(coalesce(least(greatest(case when lo is null then 0e0 when mad >= 1e-9 then (x - med) / (1.4826e0 * mad) when sd >= 1e-9 then (x - mu) / sd else 0e0 end, -3e0), 3e0), 0e0), 6) as z
        from c join m on m.sector = c.sector and m.metric = c.metric join d on d.sector = c.sector and d.metric = c.metric left join q on q.sector = c.sector and q.metric = c.metric""",
    ),
    Operator("scr05_winsorise", "Returns clipped to the fund's 1 % and 99 % quantiles: mean and deviation.", "with q as (select fund_id, [[q|r|0.01]] as lo, [[q|r|0.99]] as hi from wr group by 1) select wr.fund_id, round(avg(least(greatest(r, lo), hi)), 10) as mean_r, round(stddev_samp(least(greatest(r, lo), hi)), 10) as std_r from wr join q on q.fund_id = wr.fund_id group by wr.fund_id"),
    Operator("scr06_range_score", "Clip to a fixed range, scale to 0 .. 1, null gives 0.5; volatility the other way round.", "select fund_id, round(coalesce((least(greatest(cagr, -0.1e0), 0.4e0) + 0.1e0) / 0.5e0, 0.5e0), 8) as cagr_score, round(coalesce(1 - (least(greatest(vol, 0.05e0), 0.4e0) - 0.05e0) / 0.35e0, 0.5e0), 8) as vol_score from feat"),
    Operator("scr07_composite", "Weighted mean of the percentiles that a fund has; coverage below 35 % caps it at 45.", "select fund_id, sector, round(case when sum(case when p is not null then weight end) < 0.35e0 then least(45e0, sum(weight * p) / nullif(sum(case when p is not null then weight end), 0)) else sum(weight * p) / nullif(sum(case when p is not null then weight end), 0) end, 5) as composite, round(sum(case when p is not null then weight else 0e0 end), 6) as coverage from pct group by fund_id, sector"),
    Operator("scr08_pillars", "Two pillars of the percentiles and their weighted sum; a pillar without any measure is 0.", "with p as (select fund_id, case when metric in ('cagr', 'alpha', 'ir') then 'return' else 'risk' end as pillar, sum(weight * p) / nullif(sum(case when p is not null then weight end), 0) as s from pct group by 1, 2) select fund_id, round(coalesce(max(case when pillar = 'return' then s end), 0e0), 5) as return_pillar, round(coalesce(max(case when pillar = 'risk' then s end), 0e0), 5) as risk_pillar, round(0.65e0 * coalesce(max(case when pillar = 'return' then s end), 0e0) + 0.35e0 * coalesce(max(case when pillar = 'risk' then s end), 0e0), 4) as score from p group by fund_id"),
    Operator(
        "scr09_normal_map",
        "Normal distribution function of the weighted robust z-scores within the sector over 1.2 or 1.15, times 100, confidence and capacity, clipped by three scales (rational approximation, error under 1.5e-7).",
        f"""
        with l as (select featl.fund_id, fund.sector, fund.aum, metric, weight, x from featl join fund on fund.fund_id = featl.fund_id),
        m as (select sector, metric, median(x) as med from l group by 1, 2),
        d as (select l.sector, l.metric, median(abs(x - med)) as mad from l join m on m.sector = l.sector and m.metric = l.metric group by 1, 2),
        z as (select l.fund_id, max(l.aum) as aum, sum(weight * coalesce(least(greatest((x - med) / (1.4826e0 * case when mad > 1e-12 then mad else 1e0 end), -3e0), 3e0), 0e0)) as raw
              from l join m on m.sector = l.sector and m.metric = l.metric join d on d.sector = l.sector and d.metric = l.metric group by l.fund_id),
        p as (select z.fund_id, {_PHI.format(z="raw / 1.2e0")} as wide, {_PHI.format(z="raw / 1.15e0")} as narrow, s.d1 - s.d0 as days,
                     case when aum is null or aum <= 15000 then 1e0 when aum <= 25000 then 0.95e0 when aum <= 40000 then 0.85e0 when aum <= 60000 then 0.75e0 else 0.65e0 end as room
              from z join span s on s.fund_id = z.fund_id)
        select fund_id, round(least(greatest(wide * 100 * case when days >= 365 then 0.95e0 else 0.7e0 end * room, 22e0), 92e0), 4) as score_22_92,
               round(least(greatest(narrow * 100 * case when days >= 900 then 0.96e0 else 0.68e0 end * room, 18e0), 94e0), 4) as score_18_94,
               round(least(greatest(narrow * 100 * case when days >= 365 then 0.95e0 else 0.7e0 end * room, 20e0), 90e0), 4) as score_20_90 from p""",
    ),
    Operator("scr10_history_confidence", "Confidence by years of history: a step table, and linear up to three years.", "select fund_id, case when (d1 - d0) / 365.25e0 < 1 then 0.55e0 when (d1 - d0) / 365.25e0 < 2 then 0.72e0 when (d1 - d0) / 365.25e0 < 3 then 0.88e0 when (d1 - d0) / 365.25e0 < 5 then 0.96e0 else 1e0 end as step, round(least(greatest((d1 - d0) / 365.25e0 / 3, 0e0), 1e0), 8) as linear from span"),
    Model(
        "scr10_confidence_tables",
        "Confidence by other tables of days, weeks and rows, and blended with plan windows and capacity.",
        """
        with a as (select fund_id, case when aum >= 0 then least(greatest(1 - 0.15e0 * least(greatest((q25 - ln(1 + aum)) / greatest(q25 - q05, 1e-6), 0e0), 1e0)
                       - 0.25e0 * least(greatest((ln(1 + aum) - q75) / greatest(q95 - q75, 1e-6), 0e0), 1e0), 0.55e0), 1e0) else 0.7e0 end as room from fund left join aum_quantiles q on q.one = 1),
        k as (select fund_id, count(xirr) as n from sipx group by 1), v as (select fund_id, count(*) as weeks from wk group by 1),
        s as (select span.fund_id, d1 - d0 as days, (d1 - d0 + 1) / 365.25e0 as years, n_days, v.weeks, coalesce(k.n, 0) as plans, a.room
              from span join v on v.fund_id = span.fund_id join a on a.fund_id = span.fund_id left join k on k.fund_id = span.fund_id)
        select fund_id, case when days < 365 then 0.55e0 when days < 730 then 0.75e0 when days < 1095 then 0.88e0 when days < 1825 then 0.95e0 else 1e0 end as by_days,
               case when weeks < 52 then 0.55e0 when weeks < 104 then 0.75e0 when weeks < 156 then 0.88e0 when weeks < 260 then 0.97e0 else 1e0 end as by_weeks,
               case when days < 1095 then 0.7e0 when days < 1460 then 0.85e0 else 1e0 end as by_long_days, round(least(greatest(n_days / 756e0 * 0.3e0 + 0.7e0, 0.5e0), 1e0), 8) as by_rows,
               round(least(greatest(0.58e0 * least(greatest(years / 4, 0.5e0), 1e0) + 0.24e0 * least(greatest(plans / 48e0, 0.45e0), 1e0) + 0.18e0 * room, 0.45e0), 1e0), 8) as with_plans,
               round(least(greatest(0.72e0 * least(1e0, greatest(0.55e0, years / 3)) + 0.28e0 * room, 0.5e0), 1e0), 8) as with_room from s""",
    ),
    Model("scr11_capacity", "Capacity by assets: a step table, piecewise with a logarithmic tail, a smooth form with a sweet spot, and penalties by quantiles of log assets.", "select fund_id, case when aum is null or aum <= 15000 then 1e0 when aum <= 25000 then 0.95e0 when aum <= 40000 then 0.85e0 when aum <= 60000 then 0.75e0 else 0.65e0 end as step, round(case when aum is null or aum <= 0 then 0.94e0 when aum < 500 then 0.93e0 when aum <= 25000 then 1e0 when aum <= 75000 then 0.98e0 - 0.05e0 * ((aum - 25000) / 50000) else greatest(0.86e0, 0.93e0 - 0.04e0 * ln(aum / 75000 + 1) / ln(10e0)) end, 8) as piecewise, round(case when aum is null or aum <= 0 then 0.55e0 else least(greatest(0.55e0 + 0.35e0 / (1 + exp(-(ln(aum) - ln(700e0)) * 2)) + 0.2e0 * exp(-0.5e0 * pow((ln(aum) - ln(12000e0)) / 1.45e0, 2)) - 0.18e0 / (1 + exp(-(ln(aum) - ln(65000e0)) * 3)), 0.35e0), 1e0) end, 6) as smooth, round(case when aum >= 0 then least(greatest(1 - 0.15e0 * least(greatest((q25 - ln(1 + aum)) / greatest(q25 - q05, 1e-6), 0e0), 1e0) - 0.25e0 * least(greatest((ln(1 + aum) - q75) / greatest(q95 - q75, 1e-6), 0e0), 1e0), 0.55e0), 1e0) else 0.7e0 end, 6) as penalised from fund left join aum_quantiles q on q.one = 1"),
    Operator("scr12_adjusted", "100 (0.88 base + 0.12 confidence) (0.78 + 0.22 confidence) times the evidence of plan windows, clipped to 0 .. 100.", "with c as (select fund_id, sum(weight * coalesce(p / 100, 0.45e0)) / nullif(sum(weight), 0) as base from pct group by 1), k as (select fund_id, count(xirr) as n from sipx group by 1) select c.fund_id, round(least(greatest(100 * (0.88e0 * base + 0.12e0 * conf) * (0.78e0 + 0.22e0 * conf) * (0.55e0 + 0.45e0 * least(coalesce(k.n, 0) / 24e0, 1e0)), 0e0), 100e0), 5) as adjusted from c join (select fund_id, least(greatest((d1 - d0) / 365.25e0 / 3, 0.45e0), 1e0) as conf from span) s on s.fund_id = c.fund_id left join k on k.fund_id = c.fund_id"),
    Operator("scr13_ranks", "Rank, dense rank and ordinal rank of the composite in its sector, ties by id.", "with c as (select fund_id, sector, round(sum(weight * p) / nullif(sum(case when p is not null then weight end), 0), 5) as s from pct group by 1, 2) select fund_id, sector, rank() over (partition by sector order by s desc) as rank_min, dense_rank() over (partition by sector order by s desc) as rank_dense, row_number() over (partition by sector order by s desc, fund_id) as rank_ordinal from c where s is not null"),
    Operator("scr14_top_k", "The {k} best funds of all by the composite.", "with c as (select fund_id, sector, round(sum(weight * p) / nullif(sum(case when p is not null then weight end), 0), 5) as score from pct group by 1, 2) select fund_id, sector, score from c where score is not null order by score desc, fund_id limit {k}", {"k": 10}),
    Operator(
        "scr14_top_assets",
        "The {k} subsectors and the {k} funds with the most assets.",
        """
        select kind, name, total_aum, place from (
          select kind, name, total_aum, row_number() over (partition by kind order by total_aum desc, name) as place from (
            select 'subsector' as kind, subsector as name, round(sum(aum), 2) as total_aum from fund where aum is not null group by subsector
            union all select 'fund', fund_id, aum from fund where aum is not null) a) b where place <= {k}""",
        {"k": 10},
    ),
    Operator("en01_compiled_score", "Mean over all models of the scores scaled within sector and model.", f"select fund_id, sector, final_score from ({_FINAL}) f"),
    Operator("en02_total_rank", "Ordinal rank of the compiled score in its sector.", f"select fund_id, sector, final_score, row_number() over (partition by sector order by final_score desc, fund_id) as total_rank from ({_FINAL}) f"),
    Operator("en03_row_averages", "Mean of what is a number over the models; text is left out.", "select fund_id, round(avg(try_cast(data_days as double)), 0) as avg_data_days, round(avg(try_cast(cagr_3y as double)), 2) as avg_cagr_3y from model_score group by fund_id"),
    Operator("en04_run_ranks", "Rank of each fund in each year that it has values in; in_first is 1 for the funds of the first year. `base.wide` makes the matrix of it.", f"with h as ({_RUNS}), b as (select min(y) as y0 from h) select fund_id, y as run_year, k as run_rank, max(case when y = y0 then 1 else 0 end) over (partition by fund_id) as in_first from h cross join b"),
    Operator("hd01_concentration", "Weight of the 5, 10 and 20 largest holdings.", f"select fund_id, round(sum(case when k <= 5 then latest end), 2) as top_5, round(sum(case when k <= 10 then latest end), 2) as top_10, round(sum(case when k <= 20 then latest end), 2) as top_20 from ({_HR}) h where latest > 0 group by fund_id"),
    Operator("hd02_equity_profile", "Equity holdings: weight of the 10 largest, number, mean size of the change.", "with e as (select *, row_number() over (partition by fund_id order by latest desc, sid) as k from holding where lower(type) = 'equity') select fund_id, round(sum(case when k <= 10 then latest end), 4) as top_10, count(case when latest > 0 then 1 end) as n_holdings, round(avg(abs(change3m)), 6) as mean_change from e group by fund_id"),
    Operator(
        "hd03_conviction",
        "0.6 (1 - n/200) + 0.8 (top 10 - 0.4), clipped to 0 .. 1, n all holdings; 0.5 under five holdings, without any, or without weights.",
        """
        with h as (select fund_id, coalesce(latest, 0e0) as v, row_number() over (partition by fund_id order by coalesce(latest, 0e0) desc, sid) as k from holding),
        a as (select fund_id, count(*) as n, sum(v) as total, sum(case when k <= 10 then v end) as top from h group by 1)
        select fund.fund_id, coalesce(a.n, 0) as n_holdings, round(case when coalesce(a.n, 0) < 5 or total <= 0 then 0.5e0
                 else least(greatest(0.6e0 * (1 - n / 200e0) + 0.8e0 * (top / nullif(total, 0) - 0.4e0), 0e0), 1e0) end, 4) as conviction
        from fund left join a on a.fund_id = fund.fund_id""",
    ),
    Operator(
        "hd04_theme_tilt",
        "Weight in sectors of four themes, overlaps counted twice, less 0.45, doubled and clipped to -0.3 .. 0.4; 0 under five holdings, without any, or without weights.",
        f"""
        with a as (select fund_id, count(*) as n, sum(coalesce(latest, 0e0)) as total, sum(coalesce(latest, 0e0) * ({_IN_THEMES})) as themed from holding group by 1)
        select fund.fund_id, round(case when coalesce(n, 0) < 5 or total <= 0 then 0e0 else least(greatest((themed / nullif(total, 0) - 0.45e0) * 2, -0.3e0), 0.4e0) end, 4) as tilt
        from fund left join a on a.fund_id = fund.fund_id""",
    ),
    Operator(
        "hd05_focused_snapshot",
        "Fund facts with trailing returns of 1, 3 and 5 years, first day and concentration.",
        f"""
        with t as (select fund_id, d0, d1, y, d1 - cast(floor(y * 365.25) as int) as t0 from span cross join (select 1 as y union all select 3 union all select 5) k),
        s as (select t.fund_id, t.y, max_by(navd.nav, navd.day) as v0 from t join navd on navd.fund_id = t.fund_id and navd.day <= t.t0 group by 1, 2),
        e as (select fund_id, min(day) as d0, max_by(nav, day) as v1 from navd group by 1),
        r as (select e.fund_id, max(d0) as d0, max(case when y = 1 then v1 / v0 - 1 end) as r1, max(case when y = 3 then v1 / v0 - 1 end) as r3, max(case when y = 5 then v1 / v0 - 1 end) as r5
              from e left join s on s.fund_id = e.fund_id group by 1),
        c as (select fund_id, sum(case when k <= 5 then latest end) as top_5, sum(case when k <= 10 then latest end) as top_10, sum(case when k <= 20 then latest end) as top_20 from ({_HR}) h where latest > 0 group by 1)
        select fund.fund_id, name, aum, round(100 * r1, 2) as ret_1y, round(100 * r3, 2) as ret_3y, round(100 * r5, 2) as ret_5y, [[ymd|[[date|r.d0]]]] as first_date,
               round(top_5, 2) as top_5, round(top_10, 2) as top_10, round(top_20, 2) as top_20
        from fund left join r on r.fund_id = fund.fund_id left join c on c.fund_id = fund.fund_id""",
    ),
    Operator("st01_subsector_statistics", "Funds, assets and funds with one and five years of history, by subsector.", "select sector, subsector, count(*) as n_funds, round(sum(aum), 2) as total_aum, count(case when d1 - d0 >= 365 then 1 end) as one_year, count(case when d1 - d0 >= 1826 then 1 end) as five_years from fund left join span on span.fund_id = fund.fund_id group by sector, subsector"),
    Operator("st02_index_statistics", "Points, span, five-year growth and latest value of each index.", "with s as (select index_id, max(day) as d1 from idxd group by 1) select idxd.index_id, count(*) as n_points, round((max(day) - min(day)) / 365.25e0, 2) as years, round(pow(max_by(nav, day) / min_by(case when day >= d1 - 1826 then nav end, case when day >= d1 - 1826 then day end), 365.25e0 / nullif(max(day) - min(case when day >= d1 - 1826 then day end), 0)) - 1, 6) as cagr_5y, max_by(nav, day) as latest, [[ymd|[[date|max(day)]]]] as latest_date from idxd join s on s.index_id = idxd.index_id group by idxd.index_id"),
    Operator("st03_universe_summary", "Totals over all funds.", "select count(*) as n_funds, count(distinct sector) as n_sectors, count(distinct subsector) as n_subsectors, round(sum(aum), 2) as total_aum, round(100e0 * count(case when d1 - d0 >= 365 then 1 end) / nullif(count(*), 0), 4) as pct_one_year, round(100e0 * count(case when d1 - d0 >= 1826 then 1 end) / nullif(count(*), 0), 4) as pct_five_years from fund left join span on span.fund_id = fund.fund_id"),
]

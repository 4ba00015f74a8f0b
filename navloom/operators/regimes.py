"""Market regimes and a fund's behaviour in them."""

from navloom.plans.text import Operator

_RF = "(pow(1.065e0, 1 / 52e0) - 1)"
_ALPHA = f"52 * (avg(f) - {_RF} - regr_slope(f, b) * (avg(b) - {_RF}))"
_ORDERS = "select 'StrongBull' as regime union all select 'MildBull' union all select 'Correction' union all select 'Bear'"
#: Alpha of each fund and regime, shrunk by the number of weeks and clipped.
_PER = f"select fund_id, regime, count(*) as n, least(greatest({_ALPHA} / (1 + 4 / sqrt(count(*))), -0.5e0), 0.5e0) as alpha, regr_slope(f, b) as beta from alreg group by 1, 2 having count(*) >= 8 and var_samp(b) > 1e-12"
_MIX = f"select s.index_id, s.regime as from_regime, o.regime as to_regime, avg(s.share) as p from (select t.index_id, t.w, t.regime, o.regime as target, avg(case when u.regime = o.regime then 1e0 else 0e0 end) as share, count(*) as k from (select *, row_number() over (partition by index_id order by w) as i from reg where regime is not null) t cross join ({_ORDERS}) o join (select *, row_number() over (partition by index_id order by w) as i from reg where regime is not null) u on u.index_id = t.index_id and u.i between t.i + 1 and t.i + 52 group by 1, 2, 3, 4 having count(*) = 52) s join ({_ORDERS}) o on o.regime = s.target group by 1, 2, 3"
#: The same for every regime: the overall shares where a start is never seen, mostly the same regime where the history is short.
_ALL_MIX = f"""
    select c.index_id, a.regime as from_regime, o.regime as to_regime, case when c.k < 56 then 0.3e0 / 4 + case when a.regime = o.regime then 0.7e0 else 0e0 end
           when seen.index_id is null then coalesce(un.k, 0) * 1e0 / c.k else coalesce(mx.p, 0e0) end as p
    from (select index_id, count(*) as k from reg where regime is not null group by 1) c cross join ({_ORDERS}) a cross join ({_ORDERS}) o
    left join (select distinct index_id, from_regime from ({_MIX}) m1) seen on seen.index_id = c.index_id and seen.from_regime = a.regime
    left join ({_MIX}) mx on mx.index_id = c.index_id and mx.from_regime = a.regime and mx.to_regime = o.regime
    left join (select index_id, regime, count(*) as k from reg group by 1, 2) un on un.index_id = c.index_id and un.regime = o.regime"""
_SOFT = f"select n.index_id, o.regime, avg(case when n.regime = o.regime then 1e0 else 0e0 end) as share from (select *, row_number() over (partition by index_id order by w desc) as k from reg where regime is not null) n cross join ({_ORDERS}) o where n.k <= 8 group by 1, 2"

OPERATORS = [
    Operator("rg01_regime_labels", "Regime of each index and week by the change over 26 weeks and the drawdown from the peak of 52.", "select index_id, [[date|w]] as week, regime from reg"),
    Operator("rg01_regime_counts_momentum", "Weeks of each regime by 13- and 26-week changes and the drawdown: bear before correction, then bull and recovery override.", "with x as (select index_id, w, nav / lag(nav, 13) over (partition by index_id order by w) - 1 as r13, nav / lag(nav, 26) over (partition by index_id order by w) - 1 as r26, dd from bdd), y as (select *, lag(r26, 13) over (partition by index_id order by w) as before from x), l as (select index_id, case when r13 >= 0.04e0 and before < 0 and dd > -0.16e0 then 'recovery' when r13 >= 0.08e0 and dd > -0.08e0 then 'bull' when dd <= -0.18e0 or r26 <= -0.14e0 then 'bear' when dd <= -0.08e0 or r13 <= -0.06e0 then 'correction' else 'sideways' end as regime from y) select index_id, regime, count(*) as weeks from l group by 1, 2"),
    Operator(
        "rg01_regime_momentum_labels",
        "Regime of each index and week by the change over 12 weeks and the drawdown from the peak of 26, eight weeks of it at least.",
        """
        with x as (select index_id, w, nav / lag(nav, 12) over (partition by index_id order by w) - 1 as mom, count(*) over (partition by index_id order by w rows between 25 preceding and current row) as k,
                          nav / max(nav) over (partition by index_id order by w rows between 25 preceding and current row) - 1 as dd from bwk)
        select index_id, [[date|w]] as week, case when dd <= -0.2e0 or mom <= -0.1e0 then 'Bear' when dd <= -0.1e0 then 'Correction' when mom > 0.05e0 and dd > -0.05e0 then 'Bull' else 'Sideways' end as regime
        from x where mom is not null and k >= 8""",
    ),
    Operator(
        "rg01_asset_flags",
        "Flags of each week by the 13-week changes of equity and metals and the 13-week volatility against its 75 % quantile of 104 weeks.",
        """
        with c as (select w, x1, (x2 + x3) / 2 as metal, count(*) over (order by w rows between 12 preceding and current row) as k,
                          exp(sum(ln(1 + x1)) over (order by w rows between 12 preceding and current row)) - 1 as e,
                          exp(sum(ln(1 + (x2 + x3) / 2)) over (order by w rows between 12 preceding and current row)) - 1 as m,
                          stddev_samp(x1) over (order by w rows between 12 preceding and current row) as v from fac),
        d as (select w, x1, case when k = 13 then e end as e, case when k = 13 then m end as m, case when k = 13 then v end as v from c),
        t as (select *, case when count(v) over (order by w rows between 103 preceding and current row) >= 20 then [[q|v|0.75]] over (order by w rows between 103 preceding and current row) end as bound from d),
        f as (select w, coalesce(e > 0.04e0 and (m is null or e >= m), false) as risk_on, coalesce(m > 0.04e0 and (e is null or m > e), false) as metal_bid,
                     coalesce(e < -0.05e0, false) or coalesce(x1 < -0.025e0 and v > bound, false) as stress from t)
        select [[date|w]] as week, risk_on, metal_bid, stress, not (risk_on or metal_bid or stress) as mixed from f""",
    ),
    Operator("rg02_forward_mix", "Mean share of the next 52 weeks in each regime, by the regime at the start.", f"select index_id, from_regime, to_regime, round(p, 8) as p from ({_MIX}) m"),
    Operator("rg02_whole_mix", "The same with a row for every pair: overall shares for starts never seen; 0.7 for the same regime and 0.3 spread where there are under 56 weeks.", f"select index_id, from_regime, to_regime, round(p, 8) as p from ({_ALL_MIX}) m"),
    Operator("rg03_current_mix", "Share of each regime in the last eight weeks.", f"select index_id, regime, round(share, 8) as share from ({_SOFT}) s"),
    Operator("rg04_regime_alphas", "Regression alpha of each fund in each regime, shrunk and clipped.", f"select fund_id, regime, n, round(alpha, 6) as alpha from ({_PER}) p"),
    Operator("rg05_expected_alpha", "Regime alphas, gaps filled by the sector's mean, weighted by the current mix times the forward mix; a start never seen has the overall mix.", f"with p as ({_PER}), s as ({_SOFT}), mx as ({_MIX}), un as (select index_id, regime, count(*) * 1e0 / sum(count(*)) over (partition by index_id) as share from reg group by 1, 2), o as ({_ORDERS}), fwd as (select s.index_id, o.regime, sum(s.share * coalesce(mx.p, case when known.k is null then coalesce(un.share, 0e0) else 0e0 end)) as share from s cross join o left join mx on mx.index_id = s.index_id and mx.from_regime = s.regime and mx.to_regime = o.regime left join (select distinct index_id, from_regime, 1 as k from mx) known on known.index_id = s.index_id and known.from_regime = s.regime left join un on un.index_id = s.index_id and un.regime = o.regime group by 1, 2), f as (select fund_id, sector from fund where fund_id in (select fund_id from p group by fund_id having count(*) >= 2)), m as (select fund.sector, p.regime, avg(p.alpha) as mean_alpha from p join fund on fund.fund_id = p.fund_id group by 1, 2) select f.fund_id, round(sum(fwd.share * coalesce(p.alpha, m.mean_alpha, 0e0)), 6) as expected from f join fwd on fwd.index_id = f.sector left join p on p.fund_id = f.fund_id and p.regime = fwd.regime left join m on m.sector = f.sector and m.regime = fwd.regime group by f.fund_id"),
    Operator("rg06_capture_spread", "Capture in bull regimes less capture in falling ones, eight weeks of each.", "select fund_id, round(case when count(case when regime like '%Bull' then 1 end) >= 8 and count(case when regime not like '%Bull' then 1 end) >= 8 then avg(case when regime like '%Bull' then f end) / nullif(avg(case when regime like '%Bull' then b end), 0) - avg(case when regime not like '%Bull' then f end) / nullif(avg(case when regime not like '%Bull' then b end), 0) end, 4) as spread from alreg group by fund_id"),
    Operator("rg07_masked_excess", "Annual mean excess in correction and bear weeks, six at least.", "select fund_id, round(case when count(*) >= 6 then 52 * avg(f - b) end, 8) as excess from alreg where regime in ('Correction', 'Bear') group by fund_id"),
    Operator("rg08_beta_stability", "1 over 1 + the deviation of the betas of the regimes, two at least.", f"select fund_id, round(1 / (1 + stddev_samp(beta)), 6) as stability from ({_PER}) p group by fund_id having count(*) >= 2"),
]

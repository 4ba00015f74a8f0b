"""Steps of the learned small-cap model: eleven features of a fund as of every second month and as of today, and what the next plan gave.

A fund as of month k is a fund of its own (<fund>@<k>, see replay), so one set of steps gives the features of all months and of today.
"""

from __future__ import annotations

from navloom.plans.replay import copied

#: Features with their prior weights. Fixed values.
PRIORS = {
    "sip_hit_rate": 0.14,
    "alpha_consistency": 0.13,
    "momentum_quality": 0.11,
    "recovery_strength": 0.12,
    "swing_participation": 0.11,
    "drawdown_control": 0.11,
    "downside_resilience": 0.10,
    "vol_normalization": 0.07,
    "upside_capture": 0.07,
    "cagr_stability": 0.07,
    "aum_liquidity_score": 0.07,
}
_TOTAL = sum(PRIORS.values())
_CASES = " ".join(f"when '{f}' then {f}" for f in PRIORS)


def _mean(*columns: str) -> str:
    """Mean of the known ones."""
    known = " + ".join(f"case when {c} is null then 0 else 1 end" for c in columns)
    return f"({' + '.join(f'coalesce({c}, 0e0)' for c in columns)}) / nullif({known}, 0)"


_MONTH = "cast(date_trunc('month', {}) as date)"
LEARNED = {
    # Months that fund and index share; from the 25th on every second one that a whole year follows.
    "learn_months": f"""
        select x.fund_id, x.m0, x.m1, [[monthseq|x.m0|x.m1]] as m
        from (select f.fund_id, greatest(f.a, i.a) as m0, least(f.b, i.b) as m1
              from (select n.fund_id, {_MONTH.format('min(ts)')} as a, {_MONTH.format('max(ts)')} as b from nav_all n where nav > 0 group by 1) f
              join fund_all u on u.fund_id = f.fund_id
              join (select index_id, {_MONTH.format('min(ts)')} as a, {_MONTH.format('max(ts)')} as b from index_nav_all where nav > 0 group by 1) i on i.index_id = u.sector) x
        where x.m0 <= x.m1""",
    "learn_places": """
        select fund_id, cast(m as date) as m, row_number() over (partition by fund_id order by m) - 1 as i, count(*) over (partition by fund_id) as n from learn_months""",
    "replay_days": "select fund_id, cast(12 * year(m) + month(m) as int) as k, [[day|m]] as day from learn_places where i >= 24 and i % 2 = 0 and i < n - 12",
    "replay_grid": "select distinct k, day from replay_days",
    **copied("replay_days n2 on n2.fund_id = {id}", "replay_grid n2 on 1 = 1", "n2"),
    # Weekly values and returns of fund and index in the weeks that both have.
    "learn_weeks": """
        select fund_id, w, f, b, n, row_number() over (partition by fund_id order by w desc) as rd, f / lag(f) over (partition by fund_id order by w) - 1 as fr, b / lag(b) over (partition by fund_id order by w) - 1 as br
        from (select wk.fund_id, wk.w, wk.nav as f, bwk.nav as b, count(*) over (partition by wk.fund_id) as n from wk join fund on fund.fund_id = wk.fund_id join bwk on bwk.index_id = fund.sector and bwk.w = wk.w) x
        where n >= 52""",
    "learn_sums": """
        select fund_id,
               case when count(case when rd <= 104 and br > 0 then 1 end) >= 4 then avg(case when rd <= 104 and br > 0 then fr end) / nullif(avg(case when rd <= 104 and br > 0 then br end), 0) end as up,
               case when count(case when rd <= 104 and br < 0 then 1 end) >= 4 then avg(case when rd <= 104 and br < 0 then fr end) / nullif(avg(case when rd <= 104 and br < 0 then br end), 0) end as down,
               stddev_pop(case when rd <= 13 then fr end) * sqrt(52) as vol13, stddev_pop(case when rd <= 52 then fr end) * sqrt(52) as vol52,
               coalesce(sqrt(avg(case when rd <= 104 and fr < 0 then fr * fr end)) * sqrt(52), 0e0) as downside,
               max(case when rd = 1 then f end) / max(case when rd = 14 then f end) - 1 as r13, max(case when rd = 1 then f end) / max(case when rd = 27 then f end) - 1 as r26,
               max(case when rd = 1 then f end) / max(case when rd = 53 then f end) - 1 as r52, max(case when rd = 1 then b end) / max(case when rd = 27 then b end) - 1 as b26,
               pow(max(case when rd = 1 then f end) / max(case when rd = least(156, n - 1) + 1 then f end), 52e0 / max(least(156, n - 1))) - 1 as c3,
               pow(max(case when rd = 1 then f end) / max(case when rd = least(260, n - 1) + 1 then f end), 52e0 / max(least(260, n - 1))) - 1 as c5,
               min(case when rd <= 78 then b end) as trough
        from learn_weeks group by 1""",
    "learn_rolling": """
        select fund_id, avg(case when s > 1e-12 then 1e0 else 0e0 end) as consistency
        from (select fund_id, rd, sum(fr - br) over (partition by fund_id order by w rows between 12 preceding and current row) as s, count(fr) over (partition by fund_id order by w rows between 12 preceding and current row) as k,
                     count(fr) over (partition by fund_id) as all_n, max(rd) over (partition by fund_id) as last_rd from learn_weeks where fr is not null and rd <= 104) x
        where k = 13 and all_n >= 26 group by 1""",
    "learn_falls": """
        select fund_id, min(case when rd <= 52 then f / p52 - 1 end) as dd52, min(case when rd <= 156 then f / p156 - 1 end) as dd156, max(case when rd = 1 then f / p156 - 1 end) as now_dd
        from (select fund_id, rd, f, max(case when rd <= 52 then f end) over up as p52, max(case when rd <= 156 then f end) over up as p156
              from learn_weeks window up as (partition by fund_id order by w rows between unbounded preceding and current row)) x group by 1""",
    "learn_recovery": """
        select a.fund_id, case when count(*) >= 8 and max(a.n) >= 30 then max(case when a.rd = 1 then a.f end) / min_by(a.f, a.w) - max(case when a.rd = 1 then a.b end) / min_by(a.b, a.w) end as strength
        from learn_weeks a join (select w.fund_id, min(w.w) as w from learn_weeks w join learn_sums s on s.fund_id = w.fund_id and w.rd <= 78 and w.b = s.trough group by 1) t on t.fund_id = a.fund_id and a.w >= t.w group by 1""",
    "learn_swings": """
        select fund_id, case when max(k) >= 52 and count(case when hit then 1 end) >= 4 then avg(case when hit then fr end) / nullif(avg(case when hit then br end), 0) end as swing, max(k) as k
        from (select fund_id, fr, br, k, lag(fall) over (partition by fund_id order by w) < -0.08e0 and br > 0.015e0 as hit
              from (select fund_id, w, fr, br, count(*) over (partition by fund_id) as k, row_number() over (partition by fund_id order by w desc) as rr, b / max(case when rd <= 156 then b end) over (partition by fund_id order by w rows between unbounded preceding and current row) - 1 as fall
                    from learn_weeks where fr is not null) x where rr <= 156) y group by 1""",
    "learn_features": f"""
        select s.fund_id, fund.sector, h.hit_rate as sip_hit_rate, c.consistency as alpha_consistency,
               ({_mean("r13", "r26", "r52", "r26 - b26")}) / case when vol52 > 0 then vol52 else 1e0 end as momentum_quality, r.strength as recovery_strength,
               case when g.k >= 52 then coalesce(g.swing, up) end as swing_participation, {_mean("dd52", "dd156", "now_dd")} as drawdown_control,
               {_mean("-downside", "-down")} as downside_resilience, -vol13 / case when vol52 > 1e-12 then vol52 end as vol_normalization, up as upside_capture,
               c3 - abs(c3 - c5) as cagr_stability, room.penalised as aum_liquidity_score
        from learn_sums s join fund on fund.fund_id = s.fund_id left join learn_hits h on h.fund_id = s.fund_id left join learn_rolling c on c.fund_id = s.fund_id left join learn_recovery r on r.fund_id = s.fund_id
        left join learn_swings g on g.fund_id = s.fund_id left join learn_falls d on d.fund_id = s.fund_id left join learn_room room on room.fund_id = split_part(s.fund_id, '@', 1)""",
    "learn_names": " union all ".join(f"select '{f}' as metric, {w / _TOTAL!r}e0 as prior, {i} as place" for i, (f, w) in enumerate(PRIORS.items())),
    "learn_long": f"select fund_id, sector, metric, round(case metric {_CASES} end, 9) as x from learn_features cross join learn_names",
    # The panel: features as of a month, the lead of the plan that starts then over the index's.
    "learn_panel": """
        select l.fund_id, split_part(l.fund_id, '@', 1) as fund, split_part(l.sector, '@', 1) as sector, l.metric, l.x, round(p.xirr, 9) as y, round(p.xirr - b.xirr, 9) as lead_y
        from learn_long l join learn_places m on m.fund_id = split_part(l.fund_id, '@', 1) and l.fund_id = concat(m.fund_id, '@', cast(cast(12 * year(m.m) + month(m.m) as int) as varchar(9)))
        join sipx p on p.fund_id = m.fund_id and p.start = m.m left join bsipx b on b.index_id = split_part(l.sector, '@', 1) and b.start = m.m where p.xirr is not null""",
    "learn_targets": """
        select p.sector, p.metric, p.x, case when t.n_lead >= 60 then lead_y else y end as y
        from learn_panel p join (select sector, count(case when metric = 'sip_hit_rate' then lead_y end) as n_lead from learn_panel group by 1) t on t.sector = p.sector where p.x is not null""",
    "learn_rho": """
        select sector, metric, count(*) as n, case when stddev_pop(rx) > 1e-9 and stddev_pop(ry) > 1e-9 then covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) end as rho
        from (select sector, metric, rank() over (partition by sector, metric order by x) + (count(*) over (partition by sector, metric, x) - 1) / 2e0 as rx,
                     rank() over (partition by sector, metric order by y) + (count(*) over (partition by sector, metric, y) - 1) / 2e0 as ry from learn_targets where y is not null) z group by 1, 2""",
    # Learned shares and priors blended; at most `cap`, what is over spread by room; priors alone where too few can be learned.
    "learn_blend": """
        select sector, metric, place, prior, rho, n, learned, n_learned, case when n_learned >= 4 then 0.6e0 * coalesce(learned / nullif(sum(learned) over (partition by sector), 0), 0e0) + 0.4e0 * prior else prior end as blend
        from (select s.sector, m.metric, m.place, m.prior, r.rho, r.n, case when r.n >= 60 and r.rho > 0.03e0 then r.rho else 0e0 end as learned,
                     sum(case when r.n >= 60 and r.rho > 0.03e0 then 1 else 0 end) over (partition by s.sector) as n_learned
              from (select distinct sector from fund_all) s cross join learn_names m left join learn_rho r on r.sector = s.sector and r.metric = m.metric) x""",
    "learn_capped": """
        select sector, n_learned, [[capped|blends|0.22|1]] as capped, blends
        from (select sector, max(n_learned) as n_learned, [[strlist|blend|place]] as blends from learn_blend group by 1) x""",
    "learn_weights": """
        select b.sector, b.metric, b.prior, b.rho, b.n, case when c.n_learned >= 4 then c.capped[{first} + b.place] / [[total|c.capped]] else b.prior end as weight
        from learn_blend b join learn_capped c on c.sector = b.sector""",
    # Robust z-scores of today's features: clipped to 5 % and 95 %, by median and median deviation, or by mean and deviation where that is 0.
    "learn_now": "select fund_id, sector, metric, x from learn_long where sector not like '%@%'",
    "learn_bounds": "select sector, metric, [[q|x|0.05]] as lo, [[q|x|0.95]] as hi from learn_now where x is not null group by 1, 2",
    "learn_clipped": "select l.fund_id, l.sector, l.metric, least(greatest(l.x, q.lo), q.hi) as x from learn_now l join learn_bounds q on q.sector = l.sector and q.metric = l.metric where l.x is not null",
    "learn_medians": "select sector, metric, [[q|x|0.5]] as med, avg(x) as mean_x, stddev_pop(x) as sd, count(*) as n from learn_clipped group by 1, 2",
    "learn_spread": "select c.sector, c.metric, [[q|abs(c.x - m.med)|0.5]] as mad from learn_clipped c join learn_medians m on m.sector = c.sector and m.metric = c.metric group by 1, 2",
    "learn_z": """
        select c.fund_id, c.sector, c.metric, least(greatest(case when m.n < 2 then 0e0 when s.mad >= 1e-9 then (c.x - m.med) / (1.4826e0 * s.mad) when m.sd >= 1e-9 then (c.x - m.mean_x) / m.sd else 0e0 end, -3e0), 3e0) as z
        from learn_clipped c join learn_medians m on m.sector = c.sector and m.metric = c.metric join learn_spread s on s.sector = c.sector and s.metric = c.metric""",
    "learn_raw": "select l.fund_id, l.sector, round(sum(coalesce(z.z, 0e0) * w.weight), 9) as raw from learn_now l join learn_weights w on w.sector = l.sector and w.metric = l.metric left join learn_z z on z.fund_id = l.fund_id and z.metric = l.metric group by 1, 2",
}
LEARNED["learn_weights"] = LEARNED["learn_weights"].replace("c.capped[{first} + b.place]", "[[item|c.capped|b.place]]")

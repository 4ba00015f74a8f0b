"""Training panels, rank correlations, learned weights, walk-forward checks, shrinkage, and whole scoring models."""

from navloom.operators import benchmark, cashflow, factors, regimes, returns, risk, scoring
from navloom.plans.panel import FEATURES
from navloom.plans.replay import replayed, snapshot_steps
from navloom.plans.text import Model, Operator

def _corr(a: str, b: str) -> str:
    """Correlation, null where a side doesn't vary."""
    return f"case when stddev_pop({a}) > 1e-9 and stddev_pop({b}) > 1e-9 then covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) end"


_WITHIN = f"select metric, {_corr('rx / peers', 'ry / peers')} as rho from panelr where peers >= 5 group by metric having count(*) >= 50"
_POOLED = "select metric, rho, n from pooled_rho where n >= 60"
_PRIOR = "select 'mom' as metric, 1 as sign, 0.5e0 as prior union all select 'dd', 1, 0.3e0 union all select 'steady', 0, 0.2e0"
_RESOLVED = f"select p.metric, p.sign, w.rho, case when p.sign <> 0 and (p.sign * w.rho > 0 or abs(w.rho) < 0.05e0) then greatest(abs(w.rho), 0.05e0) when p.sign = 0 and abs(w.rho) >= 0.05e0 then abs(w.rho) else 0e0 end as raw from ({_PRIOR}) p left join ({_WITHIN}) w on w.metric = p.metric"
_BLOCKS = next(o.sql for o in benchmark.OPERATORS if o.name == "bm19_block_alphas")
_MODULES = (returns, risk, benchmark, regimes, factors, cashflow, scoring)
_BY_NAME = {o.name: o for m in _MODULES for o in m.OPERATORS}


def _sql(name: str) -> str:
    text = _BY_NAME[name].sql
    for key, value in _BY_NAME[name].params.items():
        text = text.replace("{" + key + "}", str(value))
    return text


#: Texts that only the models use: shrunk block alphas, dated plans by fund, plans with a year of holding by fund.
_LB09 = f"""
    with g as (select fund_id, avg(alpha) as a, coalesce(var_samp(alpha), 0.0016e0) as within, count(*) as n from ({_BLOCKS}) b group by 1),
    t as (select *, avg(a) over () as mu, coalesce(var_samp(a) over (), 0e0) as between_var from g)
    select fund_id, round(mu + case when between_var + within / n < 1e-12 then 0.5e0 else between_var / (between_var + within / n) end * (a - mu), 5) as shrunk from t"""
_MORE = {
    "lb09": _LB09,
    "dated_plans": f"""
        select fund_id, [[round|case when count(xirr) >= 6 then median(xirr) end|6]] as p50, [[round|case when count(xirr) >= 6 then [[quantile|xirr|0.25]] end|6]] as p25
        from ({_sql("cf04_dated_sip_xirr")}) c group by 1""",
    "held_plans": f"""
        with x as (select h.fund_id, fund.sector, start, xirr from ({_sql("cf05_sip_then_hold")}) h join fund on fund.fund_id = h.fund_id where xirr is not null),
        m as (select sector, start, median(xirr) as peer from x group by 1, 2 having count(*) >= 5),
        k as (select x.*, m.peer, row_number() over (partition by x.fund_id order by x.start desc) as k from x left join m on m.sector = x.sector and m.start = x.start)
        select fund_id, count(*) as n_windows, [[round|avg(xirr)|6]] as mean_x, [[round|min(xirr)|6]] as least_x, [[round|median(xirr)|6]] as p50, [[round|[[quantile|xirr|0.25]]|6]] as p25,
               [[round|avg(case when k <= 3 then xirr end)|6]] as newest, round(avg(case when peer is not null then case when round(xirr, 9) > round(peer, 9) then 1e0 else 0e0 end end), 6) as peer_hits
        from k group by 1""",
}


def measured(parts: list[tuple]) -> dict[str, str]:
    """Steps up to measures_long (fund_id, sector, pillar, pillar_weight, metric, weight, x) of (pillar, its weight, source, column, weight) parts.

    A source is an operator or a text of _MORE, each computed once; a negative weight means that less is better.
    """
    steps, rows = {}, []
    for source in dict.fromkeys(p[2] for p in parts):
        name = f"o_{source}"
        steps[name] = _MORE.get(source) or _sql(source)
        own = [p for p in parts if p[2] == source]
        names = " union all ".join(f"select '{pillar}' as pillar, {pw}e0 as pillar_weight, '{c}' as metric, {abs(w)}e0 as weight" for pillar, pw, _, c, w in own)
        values = " ".join(f"when m.pillar = '{pillar}' and m.metric = '{c}' then {'-' if w < 0 else ''}cast(o.{c} as double)" for pillar, _, _, c, w in own)
        rows.append(f"select o.fund_id, m.pillar, m.pillar_weight, concat('{source}.', m.metric) as metric, m.weight, case {values} end as x from {name} o cross join ({names}) m")
    return {**steps, "measures_long": f"select u.*, fund.sector from ({' union all '.join(rows)}) u join fund on fund.fund_id = u.fund_id"}


_PERCENTILE = "100 * (rank() over (partition by sector, pillar, metric, x is null order by x) + (count(*) over (partition by sector, pillar, metric, x) - 1) / 2e0) / nullif(count(x) over (partition by sector, pillar, metric), 0)"


def pillared(name: str, doc: str, parts: list[tuple], confidence: str = "1e0", haircuts: dict[str, str] | None = None) -> Model:
    """Percentiles within the sector, weighted means by pillar (pillar_scores) and over the pillars that a fund has (model_scores), times a confidence (of conf, steps, room).

    haircuts: factors of a pillar by the fund's aum. A pillar that no fund has takes no part, as its weight goes to those that a fund has.
    """
    cut = " ".join(f"when '{pillar}' then {factor}" for pillar, factor in (haircuts or {}).items())
    cut = f" * case pillar {cut} else 1e0 end" if cut else ""
    steps = measured(parts) | {
        "pillar_scores": f"""
            select s.fund_id, s.sector, s.pillar, s.pw, s.s{cut} as s
            from (select fund_id, sector, pillar, max(pillar_weight) as pw, sum(weight * p) / nullif(sum(case when p is not null then weight end), 0) as s
                  from (select *, case when x is not null then {_PERCENTILE} end as p from measures_long) p group by 1, 2, 3) s join fund on fund.fund_id = s.fund_id""",
        "model_scores": f"""
            select r.fund_id, r.sector, round(least(greatest(raw * {confidence}, 0e0), 100e0), 6) as score
            from (select fund_id, sector, sum(pw * s) / nullif(sum(case when s is not null then pw end), 0) as raw, max(case when pillar = 'plans' then s end) as plans from pillar_scores group by 1, 2) r
            join ({_sql("scr10_confidence_tables")}) conf on conf.fund_id = r.fund_id join ({_sql("scr10_history_confidence")}) steps on steps.fund_id = r.fund_id
            join ({_sql("scr11_capacity")}) room on room.fund_id = r.fund_id""",
    }
    return Model(name, doc, "select fund_id, sector, score, row_number() over (partition by sector order by score desc, fund_id) as place from model_scores where score is not null", steps=steps)


def robust(name: str, doc: str, parts: list[tuple[str, str, float]], clip: float, divisor: float, days: int, high: float, low: float, room: str, least: float, most: float) -> Model:
    """Robust z-scores within the sector, clipped; the normal distribution function of their weighted sum; times confidence and capacity, clipped.

    Weights keep their sign: a negative one counts the measure itself the other way round.
    """
    z = f"coalesce(least(greatest((x - med) / (1.4826e0 * case when mad > 1e-12 then mad else 1e0 end), -{clip}e0), {clip}e0), 0e0)"
    text = f"""
        with med as (select sector, metric, median(x) as med from measures_long group by 1, 2),
        mad as (select l.sector, l.metric, median(abs(x - med)) as mad from measures_long l join med on med.sector = l.sector and med.metric = l.metric group by 1, 2),
        r as (select l.fund_id, l.sector, sum(weight * {z}) as raw from measures_long l join med on med.sector = l.sector and med.metric = l.metric
              join mad on mad.sector = l.sector and mad.metric = l.metric group by 1, 2),
        f as (select r.fund_id, r.sector, round(least(greatest({scoring._PHI.format(z=f"raw / {divisor}e0")} * 100 * case when s.d1 - s.d0 >= {days} then {high}e0 else {low}e0 end
                     * {room}, {least}e0), {most}e0), 2) as score from r join span s on s.fund_id = r.fund_id join fund on fund.fund_id = r.fund_id)
        select fund_id, sector, score, dense_rank() over (partition by sector order by score desc) as place from f"""
    return Model(name, doc, text, steps=measured([("all", 1, *p) for p in parts]))


_SMALL_ROOM = "case when coalesce(aum, 500e0) < 400 then 1.07e0 when coalesce(aum, 500e0) < 1500 then 1.05e0 when coalesce(aum, 500e0) < 4000 then 1.02e0 when coalesce(aum, 500e0) < 12000 then 0.99e0 else 0.95e0 end"
_LARGE_ROOM = "case when aum is null or aum <= 15000 then 1e0 when aum <= 25000 then 0.95e0 when aum <= 40000 then 0.85e0 when aum <= 60000 then 0.75e0 else 0.65e0 end"

OPERATORS = [
    Operator("lb01_training_panel", "Features of each fund and month from data up to it, and the outcome of the plan that starts then.", "select fund_id, cast(m as varchar(20)) as as_of_month, round(mom, 8) as mom, round(dd, 8) as dd, round(steady, 8) as steady, round(y, 6) as y from panel"),
    Model("lb02_pooled_spearman", "Rank correlation of each feature with the outcome over the whole panel.", f"select metric, n, round(rho, 6) as rho from ({_POOLED}) p"),
    Operator("lb03_within_date_spearman", "Correlation of percentile ranks within each month, five funds at least, pooled.", f"select metric, round(rho, 6) as rho from ({_WITHIN}) w"),
    Operator("lb04_resolved_weights", "Weights by agreement with a prior sign: kept, dropped or kept if strong; normalised, with the reason.", f"select metric, sign, round(rho, 6) as rho, round(raw / nullif(sum(raw) over (), 0), 6) as weight, case when raw = 0 then 'dropped' when abs(rho) < 0.05e0 then 'prior' else 'learned' end as status from ({_RESOLVED}) r"),
    Model("lb05_blended_weights", "Learned shares of the positive rank correlations blended with priors (the priors alone if nothing is learned), capped, what is left spread by room, normalised.", f"with l as (select p.metric, prior, least(greatest(coalesce(w.rho, 0e0), 0e0), {{cap}}) as r from ({_PRIOR}) p left join ({_POOLED}) w on w.metric = p.metric), b as (select metric, case when sum(r) over () > 1e-9 then 0.42e0 * r / nullif(sum(r) over (), 0) + 0.58e0 * prior else prior end as b from l), c as (select metric, least(b, {{cap}}) as c, {{cap}} - least(b, {{cap}}) as room from b), d as (select metric, c + room * least(greatest(1 - sum(c) over (), 0e0) / nullif(sum(room) over (), 0), 1e0) as d from c) select metric, round(d / nullif(sum(d) over (), 0), 6) as weight from d".replace("{{cap}}", "{cap}"), {"cap": "0.4e0"}),
    Model("lb06_ic_weights", "Mean rank correlation at the last two months with a panel, floor 0.01, normalised.", f"with d as (select m, row_number() over (order by m desc) as k from (select m from panelr group by m having count(*) >= 15) x), i as (select metric, panelr.m, {_corr('rx', 'ry')} as ic from panelr join d on d.m = panelr.m where d.k in (1, 2) group by 1, 2), a as (select metric, greatest(avg(ic), 0.01e0) as w from i group by 1) select metric, round(w / sum(w) over (), 6) as weight from a"),
    Operator("lb07_walk_forward_ic", "Rank correlation of each feature with the outcome by month, and its mean.", f"with i as (select metric, m, {_corr('rx', 'ry')} as ic from panelr where peers >= 5 group by 1, 2) select metric, cast(m as varchar(20)) as as_of_month, round(ic, 6) + 0e0 as ic, round(avg(ic) over (partition by metric), 6) as mean_ic from i"),
    Operator(
        "lb08_walk_forward_top",
        "By month: rank correlation of momentum, mean outcome of the best seven less the median, shares of them above it and above their index's plan; 12 funds at least.",
        f"""
        with r as (select panelr.*, row_number() over (partition by panelr.m order by x desc, panelr.fund_id) as place, b.xirr as bench from panelr
                   join fund on fund.fund_id = panelr.fund_id left join bsipx b on b.index_id = fund.sector and b.start = panelr.m where metric = 'mom' and peers >= 12),
        md as (select m, median(y) as med from r group by 1)
        select cast(r.m as varchar(20)) as as_of_month, round({_corr('rx', 'ry')}, 6) + 0e0 as ic, round(avg(case when place <= 7 then y end) - max(med), 6) as top_less_median,
               round(avg(case when place <= 7 then case when y > med then 1e0 else 0e0 end end), 6) as hit_rate,
               round(avg(case when place <= 7 and bench is not null then case when y > round(bench, 9) then 1e0 else 0e0 end end), 6) as bench_hit_rate
        from r join md on md.m = r.m group by r.m""",
    ),
    Operator(
        "lb07_feature_ic",
        "Rank correlation of each of the sixteen features with the outcome by sector and month, five funds at least, and its mean.",
        """
        with i as (select sector, metric, m, """
        + _corr("rx", "ry") + """ as ic from p16r where peers >= 5 group by 1, 2, 3)
        select sector, metric, cast(m as varchar(20)) as as_of_month, round(ic, 6) + 0e0 as ic, round(avg(ic) over (partition by sector, metric), 6) as mean_ic from i""",
    ),
    Operator("lb09_james_stein", "Block alphas shrunk towards the peers' mean by between over between plus within variance.", _LB09),
    Operator(
        "lb01_feature_panel",
        "Sixteen features of each fund as of the start of each plan, from values up to then, and the plan's outcome.",
        f"select fund_id, cast(m as varchar(20)) as as_of_month, round(y, 6) as y, {', '.join(f'round({f}, 6) as {f}' for f in FEATURES)} from p16",
    ),
    Model("lb03_feature_spearman", "Correlation of percentile ranks of feature and outcome within sector and month, pooled by sector.", "select sector, metric, n, round(rho, 6) as rho from p16rho"),
    Model("lb04_feature_weights", "Learned weights of the sixteen features by sector: sign, weight, status; five equal ones where nothing can be learned.", "select sector, metric, round(rho, 6) as rho, sign, round(weight, 6) as weight, status from p16w"),
    Model(
        "e2e01_adaptive_plan",
        "Small-cap model: sixteen features, learned weights (lb04_feature_weights), weighted mean of z-scores, percentile within the sector, 0.85 under three years.",
        """
        select p.fund_id, p.sector, round(p * case when s.d1 - s.d0 + 1 < 1095 then 0.85e0 else 1e0 end, 2) as score,
               rank() over (partition by p.sector order by round(p * case when s.d1 - s.d0 + 1 < 1095 then 0.85e0 else 1e0 end, 2) desc) as place
        from (select fund_id, sector, 100 * (rank() over (partition by sector order by round(raw, 9)) + (count(*) over (partition by sector, round(raw, 9)) - 1) / 2e0)
                     / count(*) over (partition by sector) as p from pscore) p
        join span s on s.fund_id = p.fund_id""",
    ),
    pillared(
        "e2e02_regime_pillars",
        "Mid-cap model: five pillars (regime alpha, shrunk skill, dated plans, tails and recovery, holdings) of percentiles, times confidence by days. Large assets cut the holdings pillar.",
        [
            ("regime", 0.35, "rg05_expected_alpha", "expected", 0.75), ("regime", 0.35, "rg06_capture_spread", "spread", 0.25),
            ("skill", 0.2, "lb09", "shrunk", 0.7), ("skill", 0.2, "bm20_block_stability", "stability", 0.3),
            ("plans", 0.2, "dated_plans", "p50", 0.45), ("plans", 0.2, "dated_plans", "p25", 0.35), ("plans", 0.2, "cf08_hit_rate", "hit_rate", 0.2),
            ("tails", 0.15, "rk07_cdar", "cdar_two", 0.4), ("tails", 0.15, "rk21_recovery_half_life", "half_life", -0.25), ("tails", 0.15, "rk17_skew", "down_up", -0.2), ("tails", 0.15, "rk17_skew", "skew", 0.15),
            ("holdings", 0.1, "hd02_equity_profile", "top_10", -0.45), ("holdings", 0.1, "hd02_equity_profile", "n_holdings", 0.3), ("holdings", 0.1, "hd02_equity_profile", "mean_change", 0.25),
        ], "conf.by_days", {"holdings": _LARGE_ROOM},
    ),
    pillared(
        "e2e03_style_allocation",
        "Multi-asset model: four pillars (allocation profile, outlook fit, downside, plan history) of percentiles. The pillar of allocation skill (FX05) is in e2e03_allocation_skill.",
        [
            ("profile", 0.25, "fx09_diversification", "diversification", 0.6), ("profile", 0.25, "fx09_diversification", "balance", 0.4), ("outlook", 0.15, "fx10_outlook_fit", "distance", -1),
            ("downside", 0.25, "rk10_sortino", "growth", 0.4), ("downside", 0.25, "rk13_calmar", "calmar", 0.35), ("downside", 0.25, "rk07_cdar", "cdar_q", 0.25),
            ("plans", 0.1, "cf07_sip_summary", "median_x", 0.6), ("plans", 0.1, "cf07_sip_summary", "p25", 0.4),
        ],
    ),
    pillared(
        "e2e04_hold_composite",
        "Total-market model: five pillars (held plans, alpha consistency, resilience, conviction and capacity, path) of percentiles, times confidence by weeks.",
        [
            ("plans", 0.3, "held_plans", "p50", 0.3), ("plans", 0.3, "held_plans", "p25", 0.2), ("plans", 0.3, "held_plans", "newest", 0.15), ("plans", 0.3, "cf08_hit_rate", "hit_rate", 0.2), ("plans", 0.3, "held_plans", "peer_hits", 0.15),
            ("skill", 0.22, "bm21_rolling_alphas", "share_positive", 0.3), ("skill", 0.22, "cf09_alpha_hit_rate", "hit_rate", 0.3), ("skill", 0.22, "lb09", "shrunk", 0.25), ("skill", 0.22, "bm02_information_ratio", "ir", 0.15),
            ("hold", 0.23, "rg05_expected_alpha", "expected", 0.3), ("hold", 0.23, "rg06_capture_spread", "spread", 0.2), ("hold", 0.23, "rg07_masked_excess", "excess", 0.15),
            ("hold", 0.23, "rk21_recovery_rows", "half_life", -0.25), ("hold", 0.23, "rk04_current_drawdown", "current_dd", 0.1),
            ("conviction", 0.1, "bm03_active_skill", "skill", 0.45), ("conviction", 0.1, "rg08_beta_stability", "stability", 0.35), ("conviction", 0.1, "scr11_capacity", "piecewise", 0.2),
            ("path", 0.15, "rk15_gain_to_pain", "gain_to_pain", 0.2), ("path", 0.15, "rk16_tail_ratio", "tail_ratio", 0.15), ("path", 0.15, "rk14_ulcer_performance", "upi", 0.2),
            ("path", 0.15, "rt13_vol_drag", "adjusted", 0.3), ("path", 0.15, "rk04_current_drawdown", "current_dd", 0.15),
        ], "conf.by_weeks",
    ),
    Model("e2e05_learned_weights", "Learned model: last features of each fund weighted by the blended weights, percentile within the sector.", f"with w as (select p.metric, 0.42e0 * abs(c.rho) / nullif(sum(abs(c.rho)) over (), 0) + 0.58e0 * prior as weight from ({_PRIOR}) p join ({_POOLED}) c on c.metric = p.metric), x as (select fund_id, max_by(mom, m) as mom, max_by(dd, m) as dd, max_by(steady, m) as steady from (select fund_id, m, mom, dd, -stddev_samp(r) over (partition by fund_id order by m rows between 11 preceding and current row) as steady from monr) z group by 1), l as (select fund_id, 'mom' as metric, round(mom, 12) as x from x union all select fund_id, 'dd', round(dd, 12) from x union all select fund_id, 'steady', round(steady, 12) from x), p as (select l.fund_id, fund.sector, w.weight, 100 * (rank() over (partition by fund.sector, l.metric order by l.x) + (count(*) over (partition by fund.sector, l.metric, l.x) - 1) / 2e0) / count(*) over (partition by fund.sector, l.metric) as p from l join fund on fund.fund_id = l.fund_id join w on w.metric = l.metric where l.x is not null), s as (select fund_id, sector, round(sum(weight * p) / sum(weight), 3) as score from p group by 1, 2) select fund_id, sector, score, row_number() over (partition by sector order by score desc, fund_id) as place from s"),
    pillared(
        "e2e06_scenario",
        "Scenario model: five pillars (held plans, recovery, resilience, factor skill, confidence) of percentiles, times confidence, capacity and coverage. Confidence and capacity count as percentiles in their pillar.",
        [
            ("plans", 0.34, "held_plans", "p50", 0.28), ("plans", 0.34, "held_plans", "p25", 0.24), ("plans", 0.34, "held_plans", "newest", 0.16), ("plans", 0.34, "cf08_hit_rate", "hit_rate", 0.16),
            ("plans", 0.34, "held_plans", "peer_hits", 0.12), ("plans", 0.34, "held_plans", "n_windows", 0.04),
            ("recovery", 0.18, "bm14_swing_participation", "participation", 0.3), ("recovery", 0.18, "bm10_defense_recovery", "recovery", 0.24), ("recovery", 0.18, "rt11_overheat", "r26", 0.2),
            ("recovery", 0.18, "rt11_overheat", "r13", 0.14), ("recovery", 0.18, "rt11_overheat", "overheat", -0.12),
            ("resilience", 0.22, "rk03_max_drawdown", "last_156", 0.22), ("resilience", 0.22, "rk05_ulcer", "ulcer", -0.18), ("resilience", 0.22, "bm05_capture_sums", "down_capture", -0.18),
            ("resilience", 0.22, "rg07_masked_excess", "excess", 0.18), ("resilience", 0.22, "rk22_recovery_to_peak", "weeks", -0.12), ("resilience", 0.22, "rk08_cvar", "var_5", 0.12),
            ("skill", 0.18, "fx01_factor_alpha", "alpha", 0.34), ("skill", 0.18, "fx01_factor_alpha", "factor_ir", 0.22), ("skill", 0.18, "fx02_alpha_stability", "stability", 0.18),
            ("skill", 0.18, "bm01_alpha_beta", "beta", -0.14), ("skill", 0.18, "rt03_cagr_calendar", "cagr", 0.12),
            ("confidence", 0.08, "scr10_history_confidence", "step", 0.6), ("confidence", 0.08, "scr11_capacity", "piecewise", 0.4),
        ], "steps.step * room.piecewise",
    ),
    pillared(
        "e2e07_small_cap",
        "Six percentiles: information ratio, plan alpha trend, captures, omega, volatility contraction.",
        [("all", 1, "bm02_information_ratio", "ir", 0.25), ("all", 1, "cf06_rolling_sip_return", "trend", 0.2), ("all", 1, "bm04_capture_windows", "up_26", 0.15),
                  ("all", 1, "bm04_capture_means", "down_52", -0.15), ("all", 1, "rk11_omega", "omega_zero", 0.15), ("all", 1, "rk18_vol_contraction", "contraction", -0.1)],
    ),
    pillared(
        "e2e07_multi_asset",
        "Four percentiles: agility, gains over gold, Sortino, plan stability; times the share of three years of rows.",
        [("all", 1, "bm07_side_betas", "agility", 0.3), ("all", 1, "bm22_sleeve_excess", "gold_up", 0.3), ("all", 1, "rk10_sortino", "arithmetic", 0.2), ("all", 1, "cf06_rolling_sip_return", "stability", 0.2)], "conf.by_rows",
    ),
    pillared(
        "e2e07_total_market",
        "Five percentiles: mean and least rate of held plans, factor alpha, longest drawdown, geometric down capture; times confidence by days.",
        [("all", 1, "held_plans", "mean_x", 0.25), ("all", 1, "fx01_factor_alpha", "alpha", 0.15), ("all", 1, "held_plans", "least_x", 0.2), ("all", 1, "rk23_drawdown_episodes", "longest_days", -0.2),
                  ("all", 1, "bm06_capture_geometric", "down_capture", -0.2)], "conf.by_long_days",
    ),
    robust(
        "e2e08_small_cap",
        "Robust model of eight measures: rebound, plan stability, recovery, excess over its deviation, resilience, persistence, avoidance, acceleration.",
        [("bm15_rebound_resilience", "rebound", 0.18), ("cf06_rolling_sip_return", "stability", 0.15), ("bm12_recovery_ratio", "ratio", 0.14), ("bm17_vol_adjusted_alpha", "ratio", 0.13),
                ("bm15_rebound_resilience", "resilience", 0.12), ("rk20_autocorrelation", "lag1", 0.1), ("bm16_drawdown_avoidance", "avoidance", 0.1), ("rt10_acceleration", "acceleration", 0.08)],
               3.5, 1.15, 900, 0.96, 0.68, _SMALL_ROOM, 18, 94,
    ),
    robust(
        "e2e08_mid_cap",
        "Robust model of nine measures: swing, down capture, rebound, block stability, convexity, style purity and drift, recovery, momentum.",
        [("bm08_swing", "elasticity", 0.18), ("bm04_capture_windows", "down_or_one", -0.15), ("bm11_rebound_elasticity", "elasticity", 0.15), ("bm20_block_stability", "stability", 0.12),
                ("bm18_timing_convexity", "convexity", 0.1), ("fx03_style_purity", "purity", 0.1), ("fx03_style_purity", "drift", -0.08), ("rk21_recovery_growth", "half_life", -0.07),
                ("rt08_momentum_less_overextension", "quality", 0.07)], 3, 1.2, 365, 0.95, 0.7, _LARGE_ROOM, 22, 92,
    ),
    robust(
        "e2e08_multi_asset",
        "Robust model of nine measures: gains over gold and equity, silver beta, down capture, rebound, pain, beta dispersion, noise, persistence.",
        [("bm22_sleeve_excess", "gold_up", 0.18), ("bm22_sleeve_excess", "equity_up", 0.15), ("bm22_sleeve_excess", "silver_beta", 0.1), ("bm04_capture_windows", "down_clipped", -0.14),
                ("bm11_rebound_elasticity", "elasticity", 0.13), ("rk06_pain", "pain_fall", -0.1), ("fx11_beta_dispersion", "dispersion", -0.09), ("rk26_tactical_noise", "noise", -0.08),
                ("bm23_quadrant_persistence", "persistence", 0.12)], 3, 1.15, 365, 0.95, 0.7, _LARGE_ROOM, 20, 90,
    ),
]
_MODELS = {o.name: o for o in OPERATORS}
_HOLD = _sql("cf05_sip_then_hold")
#: What is to be ranked, and what came of it: snapshots as k, day; scores of a fund as of then; the fund's first plan from that day on.
_OUTCOMES = {
    "replay_plans": _HOLD,
    "replay_first": """
        select p.fund_id, r.k, r.day, min(p.start) as start from replay_plans p join replay_days r on [[day|p.start]] >= r.day group by 1, 2, 3""",
    "replay_outcomes": """
        select f.fund_id, f.k, f.day, p.xirr as y from replay_first f join replay_plans p on p.fund_id = f.fund_id and p.start = f.start where p.xirr is not null""",
    "replay_scores": """
        select split_part(s.fund_id, '@', 1) as fund_id, split_part(s.sector, '@', 1) as sector, cast(split_part(s.fund_id, '@', 2) as int) as k, s.score
        from model_scores s where s.sector like '%@%' and s.score is not null""",
}


def _ranked(by: str, x: str, y: str) -> str:
    """Average ranks of two columns within groups."""
    one = lambda c: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2e0"
    return f"{one(x)} as rx, {one(y)} as ry"


def _score_report(least: int, top: int) -> str:
    return f"""
        with j as (select s.sector, s.fund_id, s.k, o.day, s.score, o.y, b.y as bench, count(*) over (partition by s.sector, s.k) as n,
                          row_number() over (partition by s.sector, s.k order by s.score desc, s.fund_id) as place, {_ranked("s.sector, s.k", "s.score", "o.y")}
                   from replay_scores s join replay_outcomes o on o.fund_id = s.fund_id and o.k = s.k
                   left join replay_outcomes b on b.fund_id = concat('index:', s.sector) and b.k = s.k),
        m as (select sector, k, median(y) as med from j group by 1, 2)
        select j.sector, cast([[date|max(j.day)]] as varchar(10)) as snapshot, max(n) as n_funds, round({_corr("rx", "ry")}, 6) + 0e0 as ic,
               round(avg(case when place <= {top} then y end) - max(med), 6) as top_less_median, round(avg(case when place <= {top} then case when y > med then 1e0 else 0e0 end end), 6) as peer_hits,
               round(avg(case when place <= {top} and bench is not null then case when y > bench then 1e0 else 0e0 end end), 6) as bench_hits,
               round(max(med), 6) as peer_median, round(avg(case when place <= {top} then y end), 6) as top_mean
        from j join m on m.sector = j.sector and m.k = j.k where n >= {least} group by j.sector, j.k"""


_PILLAR_IC = f"""
    with x as (select split_part(s.fund_id, '@', 1) as fund_id, split_part(s.sector, '@', 1) as sector, cast(split_part(s.fund_id, '@', 2) as int) as k, s.pillar, round(s.s, 9) as s
               from pillar_scores s where s.sector like '%@%' and s.s is not null),
    r as (select x.sector, x.pillar, x.k, o.day, count(*) over (partition by x.sector, x.pillar, x.k) as n, {_ranked("x.sector, x.pillar, x.k", "x.s", "o.y")}
          from x join replay_outcomes o on o.fund_id = x.fund_id and o.k = x.k),
    i as (select sector, pillar, k, max(day) as day, max(n) as n_funds, {_corr("rx", "ry")} as ic from r where n >= 6 group by 1, 2, 3)
    select sector, pillar, cast([[date|day]] as varchar(10)) as snapshot, n_funds, round(ic, 6) + 0e0 as ic, round(avg(ic) over (partition by sector, pillar), 6) + 0e0 as mean_ic from i"""

#: Alpha of the year before and of the year after each of eight dates, thirteen weeks apart; a date counts from eight funds on.
_ALPHA_IC = f"""
    with e as (select [[seq|0|7]] as k, w1 from (select max(w) as w1 from bwr) x), d as (select k, w1 - 7 * (53 + 13 * k) as day from e),
    a as (select al.fund_id, d.k, d.day, case when al.w <= d.day then 0 else 1 end as side, regr_slope(f, b) as beta, avg(f) as mf, avg(b) as mb, count(*) as n, var_samp(b) as v
          from al join d on al.w > d.day - 364 and al.w <= d.day + 364 group by 1, 2, 3, 4),
    s as (select fund_id, k, day, side, round(52 * (mf - {{rf}} - beta * (mb - {{rf}})), 12) as alpha from a where n >= {{least}} and v > 1e-12),
    p as (select fund.sector, x.k, x.day, x.fund_id, x.alpha as past, y.alpha as later, count(*) over (partition by fund.sector, x.k) as n, {_ranked("fund.sector, x.k", "x.alpha", "y.alpha")}
          from s x join s y on y.fund_id = x.fund_id and y.k = x.k and y.side = 1 join fund on fund.fund_id = x.fund_id where x.side = 0),
    i as (select sector, k, max(day) as day, max(n) as n_funds, {_corr("rx", "ry")} as ic from p where n >= 8 group by 1, 2)
    select sector, cast([[date|day]] as varchar(10)) as as_of_day, n_funds, round(ic, 6) + 0e0 as ic, round(avg(ic) over (partition by sector), 6) + 0e0 as mean_ic from i""".replace("{rf}", "(pow(1.065e0, 1 / 52e0) - 1)")

#: The plan that ended when another starts (24 months before) against that one, at six months that are three apart.
_HOLD_IC = f"""
    with h as ({_HOLD}), z as (select max(start) as last_start from h),
    d as (select [[seq|0|5]] as k, last_start from z),
    e as (select k, [[months|cast(last_start as date)|-3 * k]] as start, [[months|cast(last_start as date)|-3 * k - 24]] as before from d),
    p as (select fund.sector, e.k, e.start, n.fund_id, o.xirr as past, n.xirr as later, count(*) over (partition by fund.sector, e.k) as n, {_ranked("fund.sector, e.k", "o.xirr", "n.xirr")}
          from e join h n on n.start = e.start join h o on o.fund_id = n.fund_id and o.start = e.before join fund on fund.fund_id = n.fund_id where n.xirr is not null and o.xirr is not null),
    i as (select sector, k, max(start) as start, max(n) as n_funds, {_corr("rx", "ry")} as ic from p where n >= 8 group by 1, 2)
    select sector, cast(start as varchar(10)) as start_month, n_funds, round(ic, 6) + 0e0 as ic, round(avg(ic) over (partition by sector), 6) + 0e0 as mean_ic from i"""

#: Six measures of a fund up to the last day e of its index, and one-year plans from dates on, of funds and (as bench:<index>) indices.
_TUNED = {
    "tuned_end": "select fund.fund_id, fund.sector, max(idxd.day) as e from fund join idxd on idxd.index_id = fund.sector group by 1, 2",
    "tuned_nav": """
        select n.fund_id, n.day, n.nav, z.sector, z.e from navd n join tuned_end z on z.fund_id = n.fund_id and n.day <= z.e
        join (select fund_id from navd group by 1 having count(*) >= 250) k on k.fund_id = n.fund_id""",
    "tuned_series": "select fund_id as id, day, nav from tuned_nav union all select concat('bench:', index_id), day, nav from idxd",
    "tuned_first": "select id, cast(date_trunc('month', [[date|day]]) as date) as m, min(day) as day, min_by(nav, day) as nav from tuned_series group by 1, 2",
    "tuned_months": "select id, [[monthseq|m0|m1]] as m from (select id, min(m) as m0, max(m) as m1 from tuned_first group by 1) x",
    "tuned_next": """
        select a.id, [[day|a.m]] as md, [[first|b.day]] over later as day, [[first|b.nav]] over later as nav
        from (select id, cast(m as date) as m from tuned_months) a left join tuned_first b on b.id = a.id and b.m = a.m
        window later as (partition by a.id order by a.m rows between current row and unbounded following)""",
    # Plans of a year from each month end of the year that began two years before e, and from each past date on in full series.
    "tuned_starts": """
        select id, e, [[monthseq|cast(date_trunc('month', [[date|e - 730]]) as date)|cast(date_trunc('month', [[date|e - 364]]) as date)]] as m
        from (select fund_id as id, e from tuned_end union all select distinct concat('bench:', sector), e from tuned_end) x""",
    "tuned_plans": """
        select id, 'past' as kind, [[day|m]] - 1 as d from tuned_starts where [[day|m]] - 1 between e - 730 and e - 365
        union all select fund_id, 'later', r.day from fund cross join replay_days r where sector not like '%@%'""",
    "tuned_buys": """
        select p.id, p.kind, p.d, n.day, n.nav from tuned_plans p join tuned_next n on n.id = p.id and n.md between p.d and p.d + 365 and n.day <= p.d + 365""",
    "tuned_last": """
        select p.id, p.kind, p.d, max(s.day) as day, max_by(s.nav, s.day) as nav from tuned_plans p join tuned_series s on s.id = p.id and s.day between p.d and p.d + 365 group by 1, 2, 3""",
    "tuned_flows": """
        select b.id, b.kind, b.d, b.day, b.day * 2 as o, -1e0 as a from tuned_buys b
        union all select l.id, l.kind, l.d, l.day, l.day * 2 + 1, u.units * l.nav from tuned_last l
        join (select id, kind, d, sum(1 / nav) as units from tuned_buys group by 1, 2, 3 having count(*) >= 6) u on u.id = l.id and u.kind = l.kind and u.d = l.d""",
    "tuned_rates": """
        select id, kind, d, [[xirr|flows|-0.99|10.0]] as x
        from (select f.id, f.kind, f.d, [[flows|f.a|(f.day - f.d) / 365e0|f.o]] as flows from tuned_flows f group by 1, 2, 3 having count(*) >= 7) y""",
    "tuned_wins": """
        select z.fund_id, avg(case when round(f.x, 9) > round(b.x, 9) then 1e0 else 0e0 end) as v from tuned_end z join tuned_rates f on f.id = z.fund_id and f.kind = 'past'
        join tuned_rates b on b.id = concat('bench:', z.sector) and b.kind = 'past' and b.d = f.d where f.x is not null and b.x is not null group by 1""",
    # Weeks that end on Sundays.
    "tuned_weeks": "select fund_id, sector, e, day + (3 - day % 7 + 7) % 7 as w, max_by(nav, day) as nav from tuned_nav group by 1, 2, 3, 4",
    "tuned_cut": "select fund_id, sector, e, day + (3 - day % 7 + 7) % 7 as w, max_by(nav, day) as nav from tuned_nav where day >= e - 1095 group by 1, 2, 3, 4",
    "tuned_bench": "select z.sector, day + (3 - day % 7 + 7) % 7 as w, max_by(i.nav, i.day) as nav from (select distinct sector, e from tuned_end) z join idxd i on i.index_id = z.sector and i.day >= z.e - 1095 group by 1, 2",
    "tuned_pairs": """
        select fund_id, nav / lag(nav) over (partition by fund_id order by w) - 1 as f, b / lag(b) over (partition by fund_id order by w) - 1 as b
        from (select c.fund_id, c.w, c.nav, [[last|t.nav]] over (partition by c.fund_id order by c.w rows between unbounded preceding and current row) as b
              from tuned_cut c left join tuned_bench t on t.sector = c.sector and t.w = c.w) x""",
    "tuned_swing": """
        select p.fund_id, case when count(*) < 50 or max(k.n) < 250 then 0e0 when avg(case when b < 0 then b end) < 0 then avg(case when b < 0 then f end) / avg(case when b < 0 then b end) else 1e0 end as down,
               case when count(*) < 50 or max(k.n) < 250 then 0e0 when avg(case when b > 0 then b end) > 0 then avg(case when b > 0 then f end) / avg(case when b > 0 then b end) else 1e0 end as up
        from tuned_pairs p join tuned_end z on z.fund_id = p.fund_id
        join (select z.sector, count(*) as n from (select distinct sector, e from tuned_end) z join idxd i on i.index_id = z.sector and i.day >= z.e - 1095 group by 1) k on k.sector = z.sector
        where p.f is not null and p.b is not null group by 1""",
    "tuned_sortino": """
        select fund_id, coalesce(case when stddev_samp(case when x < 0 then x end) > 0 then avg(x) / stddev_samp(case when x < 0 then x end) * sqrt(52) else 0e0 end, 0e0) as v
        from (select fund_id, nav / lag(nav) over (partition by fund_id order by w) - 1 - 0.065e0 / 52 as x from tuned_weeks) y group by 1""",
    "tuned_momentum": _sql("rt09_information_momentum"),
    "tuned_long": """
        select k.fund_id, k.sector, m.metric, round(case m.metric when 'win_rate' then coalesce(w.v, 0.5e0) when 'swing_elasticity' then coalesce(s.up - s.down, 0e0) when 'down_capture' then coalesce(s.down, 0e0)
               when 'ir_3m' then t.m90 when 'ir_6m' then t.m180 else o.v end, 9) as x
        from (select distinct fund_id, sector from tuned_nav) k cross join (select 'win_rate' as metric union all select 'swing_elasticity' union all select 'down_capture' union all select 'ir_3m' union all select 'ir_6m' union all select 'sortino') m
        left join tuned_wins w on w.fund_id = k.fund_id left join tuned_swing s on s.fund_id = k.fund_id left join tuned_momentum t on t.fund_id = k.fund_id left join tuned_sortino o on o.fund_id = k.fund_id""",
    # Rank correlation with the next year's plan at each past date, ten funds at least; mean, sign of down_capture turned, 0.01 at least.
    "tuned_ranked": f"""
        select sector, metric, k, rx, ry, n from (
          select split_part(l.sector, '@', 1) as sector, l.metric, r.k, count(*) over (partition by l.sector, l.metric) as n, {_ranked("l.sector, l.metric", "l.x", "round(p.x, 9)")}
          from tuned_long l join replay_days r on l.sector = concat(split_part(l.sector, '@', 1), '@', cast(r.k as varchar(9)))
          join tuned_rates p on p.id = split_part(l.fund_id, '@', 1) and p.kind = 'later' and p.d = r.day where l.x is not null and p.x is not null) x where n >= 10""",
    "tuned_ic": f"select sector, metric, k, {_corr('rx', 'ry')} as ic from tuned_ranked group by 1, 2, 3",
    "tuned_weights": """
        select s.sector, s.metric, mean_ic, greatest(case when s.metric = 'down_capture' then -coalesce(mean_ic, 0e0) else coalesce(mean_ic, 0e0) end, 0.01e0) as w
        from (select distinct sector, metric from tuned_long where sector not like '%@%') s
        left join (select sector, metric, avg(ic) as mean_ic from tuned_ic group by 1, 2) i on i.sector = s.sector and i.metric = s.metric""",
    "tuned_ranks": """
        select fund_id, sector, metric, case when metric = 'down_capture' then 100 * (n + 1 - rk) / n else 100 * rk / n end as p
        from (select fund_id, sector, metric, rank() over (partition by sector, metric order by x) + (count(*) over (partition by sector, metric, x) - 1) / 2e0 as rk, count(*) over (partition by sector, metric) as n
              from tuned_long where sector not like '%@%' and x is not null) y""",
}
_TUNED_DAYS = snapshot_steps(2, 365, 365, "max(day)")

OPERATORS += [
    replayed(
        "lb08_score_report",
        "Scenario model replayed at six snapshots 26 weeks apart: rank correlation of score and the first later plan, the best seven against the peers' median and their index; 12 funds at least.",
        _MODELS["e2e06_scenario"], _score_report(12, 7), 6, 182, 756, _OUTCOMES,
    ),
    replayed(
        "lb07_pillar_ic",
        "Mid-cap model replayed at eight snapshots 26 weeks apart: rank correlation of each pillar with the first later plan, six funds at least, and its mean.",
        _MODELS["e2e02_regime_pillars"], _PILLAR_IC, 8, 182, 756, _OUTCOMES,
    ),
    Operator("lb07_alpha_ic", "Rank correlation of the alpha of the year before with that of the year after, at eight dates 13 weeks apart, eight funds with {least} weeks on both sides at least, and its mean.", _ALPHA_IC, {"least": 40}),
    Model("lb07_hold_ic", "Rank correlation of held plans that have just ended with those that start, at six months three apart, eight funds at least, and its mean.", _HOLD_IC),
    Model(
        "lb06_tuned_weights",
        "Rank correlations of six measures with the next year's plan at one and two years ago, ten funds at least; their mean, the sign of down_capture turned, 0.01 at least; normalised by sector.",
        "select sector, metric, round(mean_ic, 6) + 0e0 as mean_ic, round(w / sum(w) over (partition by sector), 6) as weight from tuned_weights",
        steps={**_TUNED, **_TUNED_DAYS},
    ),
    Model(
        "e2e07_mid_cap",
        "Self-tuning model: percentiles of six measures weighted by lb06_tuned_weights, less for large assets and for under three years.",
        """
        with w as (select sector, metric, w / sum(w) over (partition by sector) as weight from tuned_weights),
        r as (select p.fund_id, p.sector, sum(p.p * w.weight) as raw from tuned_ranks p join w on w.sector = p.sector and w.metric = p.metric group by 1, 2),
        f as (select r.fund_id, r.sector, round(raw * case when f.aum > 40000 then 0.85e0 when f.aum > 25000 then 0.9e0 when f.aum > 15000 then 0.95e0 else 1e0 end
                     * case when s.d1 - s.d0 < 1095 then 0.8e0 else 1e0 end, 2) as score
              from r join fund f on f.fund_id = r.fund_id join span s on s.fund_id = r.fund_id)
        select fund_id, sector, score, rank() over (partition by sector order by score desc) as place from f""",
        steps={**_TUNED, **_TUNED_DAYS},
    ),
    Model(
        "e2e08_total_market",
        "Fixed-range model: nine measures (held plans, recovery, down capture, monthly information ratio, factor alpha, themes, conviction) scaled between fixed bounds, weighted, less for large assets; 130 values at least.",
        """
        with n as (select fund_id from navd group by 1 having count(*) >= 130),
        s as (select n.fund_id, fund.sector, fund.aum,
                     0.22e0 * coalesce((least(greatest(p.mean_x, -0.05e0), 0.35e0) + 0.05e0) / 0.4e0, 0.5e0) + 0.13e0 * coalesce((least(greatest(p.p5, -0.25e0), 0.2e0) + 0.25e0) / 0.45e0, 0.5e0)
                     + 0.08e0 * (least(greatest(1 / (coalesce(nullif(p.sd, 0), 0.15e0) + 0.01e0), 3e0), 20e0) - 3) / 17
                     + 0.12e0 * (1 - (least(greatest(coalesce(nullif(r.days, 0), 400), 100), 700) - 100) / 600e0) + 0.1e0 * (1 - (least(greatest(coalesce(nullif(m.down, 0), 0.9e0), 0.4e0), 1.4e0) - 0.4e0))
                     + 0.15e0 * (least(greatest(coalesce(m.ir, 0e0), -0.5e0), 1.5e0) + 0.5e0) / 2 + 0.08e0 * (least(greatest(coalesce(pow(1 + a.alpha / 52, 52) - 1, 0e0), -0.05e0), 0.15e0) + 0.05e0) / 0.2e0
                     + 0.07e0 * least(greatest(t.tilt + 0.15e0, 0e0), 0.5e0) / 0.5e0 + 0.05e0 * c.conviction as score
              from n join fund on fund.fund_id = n.fund_id left join fixed_plans p on p.fund_id = n.fund_id left join fixed_recovery r on r.fund_id = n.fund_id left join fixed_months m on m.fund_id = n.fund_id
              left join o_alpha a on a.fund_id = n.fund_id left join o_tilt t on t.fund_id = n.fund_id left join o_conviction c on c.fund_id = n.fund_id),
        f as (select fund_id, sector, round(100 * score * case when aum > 25000 then 0.92e0 when aum > 15000 then 0.97e0 else 1e0 end, 2) as score from s)
        select fund_id, sector, score, row_number() over (partition by sector order by score desc, fund_id) as place from f""",
        steps={
            "fixed_plans": f"select fund_id, avg(xirr) as mean_x, [[q|xirr|0.05]] as p5, stddev_pop(xirr) as sd from ({_HOLD}) h where xirr is not null group by 1",
            # The longest time from a fall of over 0.1 % below the peak to the end of it, or to the last day.
            "fixed_recovery": """
                select fund_id, max(case when began is not null then coalesce(next_start, last_day) - began else 0 end) as days
                from (select fund_id, last_day, min(case when under then day end) as began, lead(min(day)) over (partition by fund_id order by run) as next_start
                      from (select fund_id, day, under, last_day, sum(case when under then 0 else 1 end) over (partition by fund_id order by day rows between unbounded preceding and current row) as run
                            from (select fund_id, day, nav / max(nav) over (partition by fund_id order by day rows between unbounded preceding and current row) - 1 < -0.001e0 as under, max(day) over (partition by fund_id) as last_day from navd) x) y
                      group by fund_id, last_day, run) z group by 1""",
            "fixed_pairs": """
                select a.fund_id, 12 * year([[date|a.day]]) + month([[date|a.day]]) as m, max_by(a.nav, a.day) as f, max_by(b.nav, a.day) as b, count(*) as k
                from navd a join fund on fund.fund_id = a.fund_id join idxd b on b.index_id = fund.sector and b.day = a.day group by 1, 2""",
            "fixed_months": """
                select fund_id, case when max(n) >= 36 and stddev_samp(f - b) > 1e-12 then avg(f - b) / stddev_samp(f - b) * sqrt(12) end as ir,
                       case when max(n) >= 40 and count(case when b < 0 then 1 end) >= 3 and count(case when b > 0 then 1 end) >= 3
                            then (exp(avg(case when b < 0 then ln(1 + f) end) * 12) - 1) / (exp(avg(case when b < 0 then ln(1 + b) end) * 12) - 1) end as down
                from (select fund_id, k, sum(k) over (partition by fund_id) as n, f / case when lag(m) over (partition by fund_id order by m) = m - 1 then lag(f) over (partition by fund_id order by m) end - 1 as f,
                             b / case when lag(m) over (partition by fund_id order by m) = m - 1 then lag(b) over (partition by fund_id order by m) end - 1 as b from fixed_pairs) x
                where f is not null group by 1""",
            "o_alpha": _sql("fx01_factor_alpha"),
            "o_tilt": _sql("hd04_theme_tilt"),
            "o_conviction": _sql("hd03_conviction"),
        },
    ),
]

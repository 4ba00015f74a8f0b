"""Measures of a fund against its benchmark, from aligned weekly returns: one row for each fund."""

from navloom.plans.text import Operator

UP, DOWN = "case when b > 0 then {} end", "case when b < 0 then {} end"


def up(x: str) -> str:
    return UP.format(x)


def down(x: str) -> str:
    return DOWN.format(x)


def ratio(top: str, bottom: str) -> str:
    return f"{top} / case when abs({bottom}) > 1e-12 then {bottom} end"


OPERATORS = [
    Operator("bm01_alpha_beta", "Regression alpha (annual) and beta from 20 pairs on.", "select fund_id, round(alpha, 8) as alpha, round(beta, 8) as beta from ab"),
    Operator("bm02_information_ratio", "Annual mean over deviation of the active return.", "select fund_id, round(ir, 8) as ir from ab"),
    Operator("bm03_active_skill", "Tracking error and clipped alpha times clipped tracking error.", "select fund_id, round(te, 8) as te, round(least(greatest(alpha, -0.2e0), 0.3e0) * least(greatest(te, 0e0), 0.4e0), 8) as skill from ab"),
    Operator("bm04_capture_means", "Up and down capture as ratios of means: whole and last 52 weeks.", f"select fund_id, round({ratio(f'avg({up("f")})', f'avg({up("b")})')}, 8) as up_all, round({ratio(f'avg({down("f")})', f'avg({down("b")})')}, 8) as down_all, round({ratio('avg(case when b > 0 and rd <= 52 then f end)', 'avg(case when b > 0 and rd <= 52 then b end)')}, 8) as up_52, round({ratio('avg(case when b < 0 and rd <= 52 then f end)', 'avg(case when b < 0 and rd <= 52 then b end)')}, 8) as down_52 from al group by fund_id having count(*) >= 12"),
    Operator(
        "bm04_capture_windows",
        "Captures of the last 26 and 104 weeks (four of each kind at least) and of two years (20 weeks, five of each); down capture with 1 where there is none, and clipped to 0.2 .. 2.",
        """
        with y as (select fund_id, max(w) - 730 as from_w from al group by 1),
        x as (select al.fund_id, f, b, rd, case when al.w - 7 >= y.from_w then 1 else 0 end as recent from al join y on y.fund_id = al.fund_id),
        a as (select fund_id, count(case when recent = 1 then 1 end) as n2y, """
        + ", ".join(f"count(case when b {s} 0 and {c} then 1 end) as {k}n_{t}, avg(case when b {s} 0 and {c} then f end) as {k}f_{t}, avg(case when b {s} 0 and {c} then b end) as {k}b_{t}"
                    for k, s in (("u", ">"), ("d", "<")) for t, c in (("26", "rd <= 26"), ("104", "rd <= 104"), ("2y", "recent = 1"), ("all", "1 = 1")))
        + """ from x group by fund_id)
        select fund_id, """
        + ", ".join(f"round(case when {k}n_{t} >= 4 then {k}f_{t} / case when abs({k}b_{t}) > 1e-12 then {k}b_{t} end end, 8) as {name}_{t}" for k, name in (("u", "up"), ("d", "down")) for t in ("26", "104"))
        + """, round(case when n2y >= 20 and un_2y >= 5 and abs(ub_2y) > 1e-12 then uf_2y / ub_2y end, 8) as up_2y,
               round(case when n2y >= 20 and dn_2y >= 5 and abs(db_2y) > 1e-12 then df_2y / db_2y end, 8) as down_2y,
               round(case when dn_all = 0 or db_all = 0 then 1e0 else df_all / nullif(db_all, 0) end, 8) as down_or_one,
               round(case when dn_all = 0 or db_all = 0 then 1e0 else least(greatest(df_all / nullif(db_all, 0), 0.2e0), 2e0) end, 8) as down_clipped
        from a""",
    ),
    Operator("bm05_capture_sums", "Up and down capture as ratios of sums, four weeks of each at least.", f"select fund_id, round(case when count({up('f')}) >= 4 then {ratio(f'sum({up("f")})', f'sum({up("b")})')} end, 8) as up_capture, round(case when count({down('f')}) >= 4 then {ratio(f'sum({down("f")})', f'sum({down("b")})')} end, 8) as down_capture from al group by fund_id having count(*) >= 12"),
    Operator("bm06_capture_geometric", "Up and down capture of monthly returns, compounded to a year.", "with e as (select nav.fund_id, last_day(nav.ts) as m, max_by(nav.nav, nav.ts) as f, max_by(index_nav.nav, nav.ts) as b from nav join fund on nav.fund_id = fund.fund_id join index_nav on index_nav.index_id = fund.sector and index_nav.ts = nav.ts group by 1, 2), r as (select fund_id, f / lag(f) over (partition by fund_id order by m) - 1 as f, b / lag(b) over (partition by fund_id order by m) - 1 as b from e), c as (select fund_id, exp(sum(case when b > 0 then ln(1 + f) end) * 12 / nullif(count(case when b > 0 then f end), 0)) - 1 as fu, exp(sum(case when b > 0 then ln(1 + b) end) * 12 / nullif(count(case when b > 0 then f end), 0)) - 1 as bu, exp(sum(case when b < 0 then ln(1 + f) end) * 12 / nullif(count(case when b < 0 then f end), 0)) - 1 as fd, exp(sum(case when b < 0 then ln(1 + b) end) * 12 / nullif(count(case when b < 0 then f end), 0)) - 1 as bd from r group by 1) select fund_id, round(fu / nullif(bu, 0), 6) as up_capture, round(fd / nullif(bd, 0), 6) as down_capture from c"),
    Operator("bm07_side_betas", "Beta in falling and in rising weeks, eight of each at least, and their difference.", "select fund_id, round(case when count(case when b < 0 then 1 end) >= 8 then regr_slope(case when b < 0 then f end, case when b < 0 then b end) end, 8) as beta_down, round(case when count(case when b > 0 then 1 end) >= 8 then regr_slope(case when b > 0 then f end, case when b > 0 then b end) end, 8) as beta_up, round(regr_slope(case when b > 0 then f end, case when b > 0 then b end) - regr_slope(case when b < 0 then f end, case when b < 0 then b end), 8) as agility from al group by fund_id"),
    Operator("bm08_swing", "Up less down capture, and mean excess in rising less that in falling weeks.", f"select fund_id, round({ratio(f'avg({up("f")})', f'avg({up("b")})')} - {ratio(f'avg({down("f")})', f'avg({down("b")})')}, 8) as elasticity, round(avg({up('f - b')}) - avg({down('f - b')}), 10) as swing from al group by fund_id"),
    Operator("bm09_alpha_consistency", "Share of rolling {n}-week active sums above 0.", "with s as (select fund_id, n, ra, sum(f - b) over (partition by fund_id order by w rows between {k} preceding and current row) as s from al) select fund_id, round(avg(case when s > 0 then 1e0 else 0e0 end), 8) as consistency from s where ra >= {n} and n >= {n} + 4 group by fund_id", {"n": 26, "k": 25}),
    Operator("bm10_defense_recovery", "Annual mean excess in stress weeks and in rebound weeks, four of each at least.", "with j as (select al.fund_id, al.w, f, b, bdd.dd, lag(bdd.dd) over (partition by al.fund_id order by al.w) as pd, sum(b) over (partition by al.fund_id order by al.w rows between 4 preceding and 1 preceding) as p4, ra, n from al join fund on fund.fund_id = al.fund_id join bdd on bdd.index_id = fund.sector and bdd.w = al.w), m as (select fund_id, f, b, case when b < -0.015e0 or (dd < -0.06e0 and b < 0) then 1 else 0 end as stress, case when ((ra > 4 and p4 < -0.035e0) or pd < -0.07e0) and b > 0.006e0 then 1 else 0 end as rebound from j where n >= 30) select fund_id, round(case when sum(stress) >= 4 then pow(1 + avg(case when stress = 1 then f - b end), 52) - 1 end, 6) as defense, round(case when sum(rebound) >= 4 then pow(1 + avg(case when rebound = 1 then f - b end), 52) - 1 end, 6) as recovery from m group by fund_id"),
    Operator("bm11_rebound_elasticity", "Median over weeks with a benchmark drawdown of {depth} (on compounded returns, relative to their peak) of the next six weeks' excess over the depth; 0 without any.", "with d as (select fund_id, ra, n, (cb - pb) / (pb + 1e-9) as g, sum(f - b) over (partition by fund_id order by w rows between 1 following and 6 following) as x from cum) select fund_id, round(coalesce(median(case when round(g, 9) <= -{depth} and ra + 6 <= n then x / (-g + 1e-9) end), 0e0), 5) as elasticity from d where n >= 16 group by fund_id", {"depth": "0.1e0"}),
    Operator("bm12_recovery_ratio", "Median excess of the next 12 weeks after weeks with such a benchmark drawdown of 8 %; 0 without any.", "with d as (select fund_id, ra, n, (cb - pb) / (pb + 1e-9) as g, sum(f - b) over (partition by fund_id order by w rows between 1 following and 12 following) as x from cum) select fund_id, round(coalesce(median(case when round(g, 9) <= -0.08e0 and ra + 12 <= n then x end), 0e0), 8) as ratio from d where n >= 30 group by fund_id"),
    Operator("bm13_recovery_since_trough", "Fund less benchmark change since the benchmark's low of the last 78 weeks.", "with j as (select wk.fund_id, wk.w, wk.nav, bwk.nav as bn, row_number() over (partition by wk.fund_id order by wk.w desc) as rd from wk join fund on fund.fund_id = wk.fund_id join bwk on bwk.index_id = fund.sector and bwk.w = wk.w), t as (select fund_id, min_by(w, bn) as w0 from j where rd <= 78 group by 1) select j.fund_id, round((max_by(nav, w) / min_by(nav, w)) - (max_by(bn, w) / min_by(bn, w)), 8) as strength from j join t on t.fund_id = j.fund_id and j.w >= t.w0 group by j.fund_id"),
    Operator("bm14_swing_participation", "Fund over benchmark mean return in the rebound weeks of the last 156 (drawdown of the week before under -8 % of the window's peak, benchmark over 1.5 %), four at least, else up capture.", "with j as (select al.fund_id, al.w, f, b, bwk.nav / max(bwk.nav) over (partition by al.fund_id order by al.w rows between unbounded preceding and current row) - 1 as dd from al join fund on fund.fund_id = al.fund_id join bwk on bwk.index_id = fund.sector and bwk.w = al.w where rd <= 156 and n >= 52), k as (select *, lag(dd) over (partition by fund_id order by w) as pd from j), u as (select fund_id, avg(case when b > 0 then f end) / nullif(avg(case when b > 0 then b end), 0) as up_all from al group by 1) select k.fund_id, round(case when count(case when pd < -0.08e0 and b > 0.015e0 then 1 end) >= 4 then avg(case when pd < -0.08e0 and b > 0.015e0 then f end) / nullif(avg(case when pd < -0.08e0 and b > 0.015e0 then b end), 0) else max(up_all) end, 8) as participation from k join u on u.fund_id = k.fund_id group by k.fund_id"),
    Operator("bm15_rebound_resilience", "Mean excess in rising weeks of the last 26; 1 less the ratio of means in falling weeks.", f"select fund_id, round(avg(case when rd <= 26 and b > 0 then f - b end), 10) as rebound, round(1 - {ratio(f'avg({down("f")})', f'avg({down("b")})')}, 8) as resilience from al group by fund_id"),
    Operator("bm16_drawdown_avoidance", "Benchmark's over fund's deepest fall of compounded returns from their peak, clipped to 0.4 .. 2.5; 1 where the benchmark never falls.", "select fund_id, round(case when abs(min(cb - pb)) < 1e-6 then 1e0 else least(greatest(1 / (abs(min(cf - pf)) / nullif(abs(min(cb - pb)), 0) + 1e-6), 0.4e0), 2.5e0) end, 6) as avoidance from cum group by fund_id"),
    Operator("bm17_vol_adjusted_alpha", "Mean excess over its population deviation.", "select fund_id, round(avg(f - b) / (stddev_pop(f - b) + 1e-6), 6) as ratio from al group by fund_id"),
    Operator("bm18_timing_convexity", "Coefficient of the squared benchmark return in a fit of fund returns on it, clipped to 0.01 (two-regressor least squares from sums).", "with s as (select fund_id, covar_pop(f, b) as cy1, covar_pop(f, b * b) as cy2, var_pop(b) as c11, var_pop(b * b) as c22, covar_pop(b, b * b) as c12 from al group by 1 having count(*) >= 40) select fund_id, round(least(greatest((cy2 * c11 - cy1 * c12) / nullif(c11 * c22 - c12 * c12, 0), -0.01e0), 0.01e0), 6) as convexity from s"),
    Operator("bm19_block_alphas", "Regression alpha of each of the last ten blocks of 26 weeks, full blocks only.", "select fund_id, cast(floor((rd - 1) / 26) as int) as block, round(52 * (avg(f) - (pow(1.065e0, 1 / 52e0) - 1) - regr_slope(f, b) * (avg(b) - (pow(1.065e0, 1 / 52e0) - 1))), 6) as alpha from al where rd <= 260 group by fund_id, cast(floor((rd - 1) / 26) as int) having count(*) = 26 and var_samp(b) > 1e-12"),
    Operator("bm20_block_stability", "Mean over 1 + deviation + 0.02 of the block alphas, three blocks at least.", "with b as (select fund_id, cast(floor((rd - 1) / 26) as int) as k, 52 * (avg(f) - (pow(1.065e0, 1 / 52e0) - 1) - regr_slope(f, b) * (avg(b) - (pow(1.065e0, 1 / 52e0) - 1))) as a from al where rd <= 260 group by 1, 2 having count(*) = 26 and var_samp(b) > 1e-12) select fund_id, round(avg(a) / (1 + stddev_samp(a) + 0.02e0), 6) as stability, count(*) as n_blocks from b group by fund_id having count(*) >= 3"),
    Operator("bm21_rolling_alphas", "Alphas of 52-week windows that end every four weeks, 30 at most; mean and share above 0 from three on.", "with e as (select fund_id, f, b, 4 * j + 1 as e0 from (select fund_id, f, b, [[seq|cast(greatest(floor((rd - 49) / 4e0), 0) as int)|cast(least(floor((rd - 1) / 4e0), 29) as int)]] as j from al where rd <= 168) e1), a as (select fund_id, e0, 52 * (avg(f) - (pow(1.065e0, 1 / 52e0) - 1) - regr_slope(f, b) * (avg(b) - (pow(1.065e0, 1 / 52e0) - 1))) as a from e group by 1, 2 having count(*) = 52 and var_samp(b) > 1e-12) select fund_id, count(*) as n_windows, round(avg(a), 6) as mean_alpha, round(avg(case when a > 0 then 1e0 else 0e0 end), 6) as share_positive from a where abs(a) < 1 group by fund_id having count(*) >= 3"),
    Operator("bm22_sleeve_excess", "Mean excess over each sleeve in its rising weeks, and the last 26 weeks' beta to the third.", "select fund_id, round(avg(case when x1 > 0 then f - x1 end), 10) as equity_up, round(avg(case when x2 > 0 then f - x2 end), 10) as gold_up, round(covar_samp(case when rd <= 26 then f end, case when rd <= 26 then x3 end) / nullif(var_pop(case when rd <= 26 then x3 end), 0), 6) as silver_beta from alf group by fund_id"),
    Operator("bm23_quadrant_persistence", "Mean over the four sign quadrants with over 8 weeks of mean(f - 0.5 e - 0.3 g).", "with q as (select fund_id, case when x1 > 0 then 1 else 0 end as e, case when x2 > 0 then 1 else 0 end as g, avg(f - 0.5e0 * x1 - 0.3e0 * x2) as m from alf group by 1, 2, 3 having count(*) > 8) select fund_id, round(avg(m), 10) as persistence, count(*) as n_quadrants from q group by fund_id"),
]

"""Multi-factor regression by normal equations on grouped sums, and style measures."""

from navloom.plans.text import Operator


def _centred(where: str = "") -> str:
    """Sums of centred products of three factors and the fund's return, by fund."""
    pairs = {f"s{i}{j}": f"covar_pop(x{i}, x{j})" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j} | {f"t{i}": f"covar_pop(f, x{i})" for i in (1, 2, 3)}
    return ", ".join(f"{sql} as {name}" for name, sql in pairs.items()) + ", avg(f) as mf, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, var_pop(f) as vf, count(*) as k"


#: Cramer's rule on the 3 x 3 system.
_DET = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13))"
_B1 = f"(t1 * (s22 * s33 - s23 * s23) - s12 * (t2 * s33 - s23 * t3) + s13 * (t2 * s23 - s22 * t3)) / nullif({_DET}, 0)"
_B2 = f"(s11 * (t2 * s33 - s23 * t3) - t1 * (s12 * s33 - s23 * s13) + s13 * (s12 * t3 - t2 * s13)) / nullif({_DET}, 0)"
_B3 = f"(s11 * (s22 * t3 - t2 * s23) - s12 * (s12 * t3 - t2 * s13) + t1 * (s12 * s23 - s22 * s13)) / nullif({_DET}, 0)"
_FIT = f"select fund_id, k, b1, b2, b3, mf - (b1 * m1 + b2 * m2 + b3 * m3) as a, greatest(vf - (b1 * t1 + b2 * t2 + b3 * t3), 0e0) as ve from (select fund_id, k, mf, m1, m2, m3, vf, t1, t2, t3, {_B1} as b1, {_B2} as b2, {_B3} as b3 from (select fund_id, {_centred()} from alf where rd <= 156 group by fund_id having count(*) >= 52) g) h"
_WINDOWS = f"select fund_id, e0, {_B1} as b1, {_B2} as b2, {_B3} as b3, mf - (({_B1}) * m1 + ({_B2}) * m2 + ({_B3}) * m3) as a from (select fund_id, e0, {_centred()} from (select fund_id, f, x1, x2, x3, 13 * j + 1 as e0 from (select *, [[seq|cast(greatest(floor((rd - 40) / 13e0), 0) as int)|cast(least(floor((rd - 1) / 13e0), 24) as int)]] as j from alf where rd <= 364) e1) e group by 1, 2 having count(*) = 52) g"
#: Exposures without an intercept, of returns less the risk-free rate: raw second moments, clipped to 0 .. 1.2 and scaled down to a sum of 1 at most.
_RF = "((pow(1.065e0, 1 / 52e0) - 1))"
_RAW = ", ".join([f"avg((x{i} - {_RF}) * (x{j} - {_RF})) as s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j] + [f"avg((f - {_RF}) * (x{i} - {_RF})) as t{i}" for i in (1, 2, 3)])
_EXPOSED = f"select {{key}}, c1 / greatest(c1 + c2 + c3, 1e0) as w1, c2 / greatest(c1 + c2 + c3, 1e0) as w2, c3 / greatest(c1 + c2 + c3, 1e0) as w3, 1 - (c1 + c2 + c3) / greatest(c1 + c2 + c3, 1e0) as w4 from (select {{key}}, least(greatest({_B1}, 0e0), 1.2e0) as c1, least(greatest({_B2}, 0e0), 1.2e0) as c2, least(greatest({_B3}, 0e0), 1.2e0) as c3 from (select {{key}}, {_RAW} from {{source}}) g) h"
_NOW = _EXPOSED.replace("{key}", "fund_id").replace("{source}", "alf where rd <= 52 group by fund_id having count(*) = 52")
#: Windows of min(52, max(20, half of the rows)) rows, the first at the start, one every four rows; e0 is a window's last row.
_SIZE = "cast(least(52, greatest(20, floor(n / 2e0))) as int)"
_ROLLED = _EXPOSED.replace("{key}", "fund_id, e0, last_w").replace("{source}", f"(select a.fund_id, e.e0, max(case when a.ra = e.e0 then a.w end) over (partition by a.fund_id, e.e0) as last_w, f, x1, x2, x3 from alf a join (select fund_id, size, size + 4 * i as e0 from (select fund_id, {_SIZE} as size, n, [[seq|0|cast(floor((n - {_SIZE}) / 4e0) as int)]] as i from alf where rd = 1 and n >= 30) y) e on e.fund_id = a.fund_id and a.ra between e.e0 - e.size + 1 and e.e0) z group by fund_id, e0, last_w")
_IDEAL = "select g1 * 0.85e0 / nullif(g1 + g2 + g3, 0) as i1, g2 * 0.85e0 / nullif(g1 + g2 + g3, 0) as i2, g3 * 0.85e0 / nullif(g1 + g2 + g3, 0) as i3, w from (select w, greatest(exp(sum(ln(1 + x1)) over (order by w rows between 12 preceding and current row)) - 1, 0e0) as g1, greatest(exp(sum(ln(1 + x2)) over (order by w rows between 12 preceding and current row)) - 1, 0e0) as g2, greatest(exp(sum(ln(1 + x3)) over (order by w rows between 12 preceding and current row)) - 1, 0e0) as g3, row_number() over (order by w) as i from fac) m where i >= 13"

OPERATORS = [
    Operator("fx01_factor_alpha", "Least squares on three factors over the last 156 weeks: alpha, betas, residual volatility, tilt.", f"select fund_id, round(52 * (a - (pow(1.065e0, 1 / 52e0) - 1) * (1 - b1 - b2 - b3)), 6) as alpha, round(b1, 6) as beta_large, round(b2, 6) as beta_mid, round(b3, 6) as beta_small, round(sqrt(ve) * sqrt(52), 6) as resid_vol, round(52 * a / case when ve > 1e-14 then sqrt(ve * 52) end, 5) as factor_ir, round(b2 + b3, 6) as tilt from ({_FIT}) f"),
    Operator("fx02_alpha_stability", "Mean over deviation of the intercepts of 52-week windows every 13 weeks, three at least.", f"select fund_id, count(*) as n_windows, round(avg(a) / case when stddev_samp(a) > 1e-12 then stddev_samp(a) end, 5) as stability from ({_WINDOWS}) w group by fund_id having count(*) >= 3"),
    Operator("fx03_style_purity", "Share of the mid beta in absolute betas less leaks; drift of the rolling mid betas.", f"with d as (select fund_id, stddev_samp(b2) as drift from ({_WINDOWS}) w group by fund_id having count(*) >= 3) select f.fund_id, round(b2 / nullif(abs(b1) + abs(b2) + abs(b3), 0) - 0.55e0 * greatest(0e0, b3 - 0.35e0) - 0.25e0 * greatest(0e0, abs(b1) + abs(b2) + abs(b3) - 1.35), 5) as purity, round(drift, 5) as drift from ({_FIT}) f left join d on d.fund_id = f.fund_id"),
    Operator("fx06_clipped_exposures", "Fit without intercept over 52 weeks, clipped to 0 .. 1.2, scaled to a sum of 1 at most; the rest is defensive.", f"select fund_id, round(w1, 5) as equity, round(w2, 5) as gold, round(w3, 5) as silver, round(w4, 5) as defensive from ({_NOW}) e"),
    Operator("fx07_ideal_alignment", "Shares of positive 13-week momentum as ideal weights, and how near a fund's exposures are to the last ones.", f"with i as ({_IDEAL}), l as (select max_by(coalesce(i1, 0.25e0), w) as i1, max_by(coalesce(i2, 0.2e0), w) as i2, max_by(coalesce(i3, 0.05e0), w) as i3 from i) select fund_id, round(i1, 6) as ideal_equity, round(i2, 6) as ideal_gold, round(i3, 6) as ideal_silver, round(greatest(0e0, 1 - 0.5e0 * (abs(w1 - i1) + abs(w2 - i2) + abs(w3 - i3) + abs(w4 - (1 - i1 - i2 - i3)))), 5) as alignment from ({_NOW}) e cross join l"),
    Operator("fx08_rolling_exposures", "Exposures of rolling windows: the current mix, mean alignment of the last 13 with the momentum mix of their weeks, and 1 less the mean turnover.", f"with r as ({_ROLLED}), i as ({_IDEAL}), a as (select r.*, greatest(0e0, 1 - 0.5e0 * (abs(w1 - coalesce(i1, 0.25e0)) + abs(w2 - coalesce(i2, 0.2e0)) + abs(w3 - coalesce(i3, 0.05e0)) + abs(w4 - (1 - coalesce(i1, 0.25e0) - coalesce(i2, 0.2e0) - coalesce(i3, 0.05e0))))) as fit from r left join i on i.w = r.last_w), t as (select *, row_number() over (partition by fund_id order by e0 desc) as k, abs(w1 - lag(w1) over (partition by fund_id order by e0)) + abs(w2 - lag(w2) over (partition by fund_id order by e0)) + abs(w3 - lag(w3) over (partition by fund_id order by e0)) + abs(w4 - lag(w4) over (partition by fund_id order by e0)) as turn from a) select fund_id, count(*) as n_windows, round(max(case when k = 1 then w1 end), 5) as equity, round(max(case when k = 1 then w2 end), 5) as gold, round(max(case when k = 1 then w3 end), 5) as silver, round(avg(case when k <= 13 then fit end), 5) as alignment, round(least(greatest(1 - avg(turn), 0e0), 1e0), 5) as stability from t group by fund_id"),
    Operator("fx09_diversification", "1 less the sum of squared weights, sleeves of 5 % and more, and balance.", f"select fund_id, round(1 - (w1 * w1 + w2 * w2 + w3 * w3 + w4 * w4), 5) as diversification, round(least(greatest((1 - (w1 * w1 + w2 * w2 + w3 * w3 + w4 * w4)) / 0.75e0, 0e0), 1e0), 5) as balance from ({_NOW}) e"),
    Operator("fx10_outlook_fit", "Squared distance to a target mix, too much metal weighing half as much again.", f"select fund_id, round(pow(w1 - 0.55e0, 2) + case when w2 > 0.15e0 then 1.5e0 else 1e0 end * pow(w2 - 0.15e0, 2) + case when w3 > 0.05e0 then 1.5e0 else 1e0 end * pow(w3 - 0.05e0, 2) + pow(w4 - 0.25e0, 2), 5) as distance from ({_NOW}) e"),
    Operator("fx11_beta_dispersion", "Population deviation of the 26-week betas (sample covariance over population variance) to the first factor, the newest week left out; 1 when short.", "with r as (select fund_id, ra, n, (avg(f * x1) over w26 - avg(f) over w26 * avg(x1) over w26) / nullif(avg(x1 * x1) over w26 - avg(x1) over w26 * avg(x1) over w26, 0) * 26 / 25e0 as beta from alf window w26 as (partition by fund_id order by w rows between 25 preceding and current row)) select fund_id, round(case when max(n) >= 52 and count(case when ra >= 26 and ra < n then beta end) >= 3 then stddev_pop(case when ra >= 26 and ra < n then beta end) else 1e0 end, 5) as dispersion from r group by fund_id"),
]

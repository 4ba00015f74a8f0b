"""The fund data model derived from the star-schema tables: suppliers as funds, nations and regions as sectors, parts as holdings.

Daily returns are whole millionths, so running sums are exact whatever their order. Each text is valid in Spark and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FUND = """
select cast(s_suppkey as varchar(20)) as fund_id, s_name as name, r_name as sector, n_name as subsector,
       case when s_suppkey % 11 = 0 then null else round(s_acctbal * 1e1, 2) end as aum
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


def _series(key: str, name: str, source: str, drift: int) -> str:
    return f"""
select {name}, d as ts, round(100 * exp(cum / 1e6), 4) as nav from (
  select {name}, d, sum(u) over (partition by {name} order by d rows between unbounded preceding and current row) as cum from (
    select {name}, d, cast(floor(cents * 2e4 / (n * 525e4)) as bigint) - 20000 + {drift} as u from (
      select {key} as {name}, cast(l_shipdate as date) as d, sum(cast(round(l_extendedprice * 100) as bigint)) as cents, count(*) as n
      from {source} group by 1, 2) px) rr) cc"""


NAV = _series("cast(l_suppkey as varchar(20))", "fund_id", "lineitem", 500)
INDEX_NAV = _series("r_name", "index_id", "lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey", 200)
HOLDING = """
select cast(l_suppkey as varchar(20)) as fund_id, case when p_type = 'PROMO' then 'Debt' else 'Equity' end as type, p_name as title,
       cast(l_partkey as varchar(20)) as sid,
       case p_type when 'MEDIUM' then 'Private Banks' when 'STANDARD' then 'Capital Goods' when 'PROMO' then 'FMCG' when 'LARGE' then 'Automobile' when 'SMALL' then 'Pharma' else 'Consumer IT' end as sector, round(v * 1e2 / sum(v) over (partition by l_suppkey), 6) as latest,
       round(dsum * 1e0 / n - 5e0, 4) as change3m
from (select l_suppkey, l_partkey, sum(cast(round(l_extendedprice * 100) as bigint)) as v, sum(cast(round(l_discount * 100) as bigint)) as dsum,
             count(*) as n from lineitem group by 1, 2) h join part on l_partkey = p_partkey where l_suppkey % 13 <> 0"""
MODEL_SCORE = """
select model, cast(k as varchar(20)) as fund_id, score, case when k % 9 = 0 then null else cast(q as varchar(20)) end as data_days,
       case when k % 8 = 0 then 'N/A (insufficient history)' when k % 3 = 0 then concat(cast(round(q * 1e0 / n, 2) as varchar(20)), '%') else cast(round(dc * 1e0 / n, 4) as varchar(20)) end as cagr_3y
from (select k, q, dc, n, 'M1' as model, round(q * 1e0 / n, 4) as score from {b} where k % 7 <> 0
      union all select k, q, dc, n, 'M2', round(dc * 1e1 / n, 4) from {b} where k % 5 <> 0
      union all select k, q, dc, n, 'M3', round(tx * 1e1 / n, 4) from {b}
      union all select k, q, dc, n, 'M4', 5e1 from {b} where k % 2 = 0) m""".replace(
    "{b}",
    "(select l_suppkey as k, sum(cast(l_quantity as bigint)) as q, sum(cast(round(l_discount * 100) as bigint)) as dc, sum(cast(round(l_tax * 100) as bigint)) as tx, count(*) as n from lineitem group by 1) b",
)
#: nav with repeated timestamps, non-positive and missing values, as it may be landed.
NAV_RAW = f"""
select fund_id, ts, nav, 1 as seq from ({NAV}) a
union all select fund_id, ts, round(nav * 1.01, 4), 2 from ({NAV}) b where [[day|ts]] % 50 = 0
union all select fund_id, ts, -1e0, 3 from ({NAV}) c where [[day|ts]] % 70 = 0
union all select fund_id, ts, null, 4 from ({NAV}) d where [[day|ts]] % 90 = 0"""

#: holding as other providers report it: the weight under one of several keys, as text, as a share or in percent.
HOLDING_RAW = f"""
select fund_id, sid, case when k = 0 then latest when k = 5 then -1e0 end as latest,
       case when k = 1 then 'n/a' end as nav, case when k = 1 then cast(latest / 100 as varchar(30)) end as allocation,
       case when k = 2 then '120' end as allocationPct, case when k = 2 then cast(latest as varchar(30)) end as weight,
       case when k = 3 then cast(latest as varchar(30)) end as holdingPct, case when k = 3 then '50' end as percent,
       case when k = 4 then '0' end as pct, case when k = 4 then cast(latest / 100 as varchar(30)) end as holding,
       case when k = 5 then cast(latest as varchar(30)) end as portfolioShare
from (select *, cast(sid as int) % 7 as k from ({HOLDING}) h) h2"""
#: Names of funds in the models' score tables; the first model has none for some.
MODEL_NAME = f"""
select model, fund_id, case when model = 'M1' and cast(fund_id as int) % 6 = 0 then null else concat('Fund ', fund_id, ' ', model) end as name
from ({MODEL_SCORE}) m"""

INPUTS = {"holding_raw": HOLDING_RAW, "model_name": MODEL_NAME, "fund": FUND, "nav": NAV, "index_nav": INDEX_NAV, "holding": HOLDING, "model_score": MODEL_SCORE, "nav_raw": NAV_RAW}
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def source_tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """The driver tables that a text names."""
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if re.search(rf"\b{t}\b", text)}


def fund_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables of the fund data model as lazy DataFrames over the files of sf_dir."""
    from navloom.plans.text import written

    out = {}
    for name, text in INPUTS.items():
        sources = source_tables(spark, sf_dir, text)
        for source in sources:
            text = re.sub(rf"\b(from|join) {source}\b", rf"\1 {{{source}}}", text)
        out[name] = spark.sql(written(text, "spark"), **sources)
    return out

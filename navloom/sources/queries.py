"""Registered queries of sources, sinks and style weights, over the fund data model, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.functions.style import attribution, style_weights, varying_style_weights
from navloom.operators import ALL
from navloom.plans.fixtures import FUND, HOLDING, INDEX_NAV, MODEL_SCORE, NAV, fund_tables
from navloom.plans.text import Operator, written
from navloom.sources import landing
from navloom.sources.shared import new_folder

#: The index that stands for each asset.
PROXIES = {"equity": "AFRICA", "gold": "AMERICA", "silver": "ASIA"}


def src01_screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    fund = fund_tables(spark, sf_dir)["fund"]
    none = F.lit(None)
    values = F.array(
        F.struct(F.lit("aum").alias("filter"), F.col("aum").alias("doubleVal"), none.cast("string").alias("strVal")),
        F.struct(F.lit("subsector").alias("filter"), none.cast("double").alias("doubleVal"), F.col("subsector").alias("strVal")),
    )
    one = fund.select("sector", F.struct(F.col("fund_id").alias("mfId"), "name", "sector", values.alias("values")).alias("r"))
    raw = one.groupBy("sector").agg(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.collect_list("r").alias("result")).alias("data"))).alias("raw"))
    return landing.screener_funds(raw.select("raw"))


def src02_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = fund_tables(spark, sf_dir)["nav"]
    points = nav.groupBy("fund_id").agg(F.collect_list(F.struct(F.col("ts").cast("string").alias("ts"), F.col("nav").alias("lp"))).alias("points"))
    raw = points.select("fund_id", F.to_json(F.struct(F.lit(True).alias("success"), F.array(F.struct("points")).alias("data"))).alias("raw"))
    return landing.chart_points(raw).select("fund_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "nav")


def src03_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fund_tables(spark, sf_dir)["holding"].withColumn("ticker", F.lit(None).cast("string"))
    listed = rows.groupBy("fund_id").agg(F.collect_list(F.struct("type", "title", "latest", "sid", "ticker", "change3m")).alias("h"))
    current = F.when(F.col("fund_id").cast("int") % 2 == 0, F.col("h"))  # the others have it under the older key
    raw = listed.select("fund_id", F.to_json(F.struct(F.struct(current.alias("currentAllocation"), F.col("h").alias("holdings")).alias("data"))).alias("raw"))
    return landing.holding_rows(raw).select("fund_id", "type", "title", "sid", "latest", "change3m")


def src04_entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index series landed as index/{id}.csv and read back as one table."""
    path = f"{new_folder(spark, 'entity-files')}/index"
    landing.write_entity_files(fund_tables(spark, sf_dir)["index_nav"].select(F.concat(F.lit(".IDX."), "index_id").alias("index_id"), "ts", "nav"), "index_id", path)
    return landing.read_entity_files(spark, path).select(F.col("entity").alias("index_id"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), "nav")


def src05_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "snapshots")
    nav = fund_tables(spark, sf_dir)["nav"]
    landing.write_snapshot(nav.withColumn("snapshot_date", F.concat(F.year("ts").cast("string"), F.lit("-12-31"))), path)
    return landing.read_snapshot(spark, path).select("fund_id", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "nav", F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"))


def src06_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fund_tables(spark, sf_dir)
    files = tables["model_score"].join(tables["fund"], "fund_id").select(F.concat(F.lit("out/"), "sector", F.lit("_"), "model", F.lit(".csv")).alias("file")).distinct()
    return landing.discover_scores(files.union(tables["fund"].select(F.concat("sector", F.lit(".csv"))).distinct()))


def src07_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fund_tables(spark, sf_dir)["model_score"].withColumnRenamed("fund_id", "mfId")
    return landing.missing_columns(scores, "model_score")


def src08_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fund_tables(spark, sf_dir)
    landed = tables["holding"].select("fund_id")
    failed = tables["fund"].where("aum is null").select("fund_id")
    return landing.load_report(tables["fund"], landed.where("fund_id % 2 = 0"), failed, "fund_id")


def src09_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fund's index by its display name, or by an id as it is; an unknown name stays."""
    fund = fund_tables(spark, sf_dir)["fund"]
    asked = {"AFRICA": "Large Cap", "AMERICA": "Mid Cap", "ASIA": ".NISM250", "EUROPE": "Gold"}
    name = F.coalesce(*(F.when(F.col("sector") == k, v) for k, v in asked.items()), F.lit("Unknown"))
    return landing.resolve_index(fund.select("fund_id", name.alias("name")), landing.index_catalogue(spark))


def prj06_sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{subsector: [ids]} of each sector, null keys left out; as JSON, so that every engine writes it alike."""
    fund = fund_tables(spark, sf_dir)["fund"].where("sector is not null and subsector is not null and fund_id is not null")
    ids = fund.groupBy("sector", "subsector").agg(F.sort_array(F.collect_list("fund_id")).alias("ids"))
    nested = ids.groupBy("sector").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subsector", "ids")))).alias("funds"))
    return nested.select("sector", F.to_json("funds").alias("funds"))


def candidates_by_asset(index: DataFrame) -> DataFrame:
    """(asset, priority, source, ts, nav): every index as a candidate of each asset, its own proxy first, the others by name."""
    proxies = index.sparkSession.createDataFrame(list(PROXIES.items()), "asset string, proxy string")
    order = Window.partitionBy("asset").orderBy(F.col("index_id") != F.col("proxy"), "index_id")
    ranked = index.select("index_id").distinct().crossJoin(F.broadcast(proxies)).select("asset", F.row_number().over(order).alias("priority"), F.col("index_id").alias("source"))
    return index.withColumnRenamed("index_id", "source").join(F.broadcast(ranked), "source").select("asset", "priority", "source", "ts", "nav")


def src10_fallback_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each asset all rows of its first candidate with enough points; all indices are candidates."""
    found = landing.first_source(candidates_by_asset(fund_tables(spark, sf_dir)["index_nav"]), 30)
    return found.select("asset", "source", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "nav")


def src11_ranked_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ranked")
    tables = fund_tables(spark, sf_dir)
    landing.write_ranked(tables["model_score"].join(tables["fund"].select("fund_id", "sector"), "fund_id").select("sector", "model", "fund_id", "score"), path)
    back = spark.read.option("header", True).schema("fund_id string, score double, sector string, model string").csv(path)
    return back.select("sector", "model", "fund_id", "score")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Operator("aligned", "", "select fund_id, rd, ra, n, f, x1, x2, x3 from alf")(fund_tables(spark, sf_dir))


def _rolled(aligned: DataFrame) -> DataFrame:
    """(fund_id, e0, n, w_*): style weights of each fund's windows of 52 weeks that end with its 52nd week and every four weeks after it; e0: rd of the newest week."""
    k0, k1 = F.greatest(F.ceil((F.col("ra") - 52) / 4), F.lit(0)), F.least(F.floor((F.col("ra") - 1) / 4), F.floor((F.col("n") - 52) / 4))
    held = aligned.select("*", k0.cast("int").alias("_k0"), k1.cast("int").alias("_k1")).where("n >= 52 and _k0 <= _k1")
    rolled = held.select("*", F.explode(F.sequence("_k0", "_k1")).alias("_k")).withColumn("e0", (F.col("n") - 51 - 4 * F.col("_k")).cast("int"))
    return style_weights(rolled, ["fund_id", "e0"], least=52)


def fx04_style_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style weights of all rolling windows of each fund, from its 52nd common week to its last."""
    weights = _rolled(_aligned(spark, sf_dir))
    return weights.select("fund_id", "e0", *(F.round(f"w_{s}", 6).alias(f"w_{s}") for s in ("x1", "x2", "x3", "cash")))


def _mix(tables: dict[str, DataFrame], weeks: int = 52) -> DataFrame:
    """Style weights of each fund's last weeks by the calendar; the third index counts where it has 13 of them."""
    rows = Operator(
        "recent",
        "",
        """
        with s as (select w, max(case when index_id = 'AFRICA' then r end) as x1, max(case when index_id = 'AMERICA' then r end) as x2, max(case when index_id = 'ASIA' then r end) as x3 from bwr group by w)
        select wr.fund_id, wr.r as f, x1, x2, x3 from wr join (select fund_id, max(w) as last_w from wr group by 1) l on l.fund_id = wr.fund_id join s on s.w = wr.w where wr.w >= l.last_w - 7 * {weeks}""",
        {"weeks": weeks},
    )(tables)
    return varying_style_weights(rows, ["fund_id"])


def fx04_current_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style weights of each fund's last 52 weeks, and from them diversification, balance and the distance to the target mix."""
    mix = _mix(fund_tables(spark, sf_dir))
    squares = sum((F.col(f"w_{s}") ** 2 for s in ("x1", "x2", "x3", "cash")), F.lit(0.0))
    metal = lambda w, t: F.when(F.col(w) > t, 1.5).otherwise(1.0) * (F.col(w) - t) ** 2
    fit = (F.col("w_x1") - 0.55) ** 2 + metal("w_x2", 0.15) + metal("w_x3", 0.05) + (F.col("w_cash") - 0.25) ** 2
    return mix.select(
        "fund_id", F.col("n").alias("n_weeks"), *(F.round(f"w_{s}", 6).alias(f"w_{s}") for s in ("x1", "x2", "x3", "cash")),
        F.round(1 - squares, 5).alias("diversification"), F.round(F.least(F.greatest((1 - squares) / 0.75, F.lit(0.0)), F.lit(1.0)), 5).alias("balance"), F.round(fit, 5).alias("distance"),
    )


def fx05_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution of each fund over all weeks from the end of its first window on."""
    aligned = _aligned(spark, sf_dir)
    return attribution(aligned, _rolled(aligned))


def e2e03_allocation_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-asset model with its pillar of allocation skill: strategic, tactical and selection return of fx05 as percentiles beside e2e03."""
    tables = fund_tables(spark, sf_dir)
    ranked = Operator(
        "skill",
        "",
        """
        select a.fund_id, fund.sector, 0.35e0 * percent_rank() over (partition by fund.sector order by strategic) + 0.35e0 * percent_rank() over (partition by fund.sector order by tactical)
               + 0.3e0 * percent_rank() over (partition by fund.sector order by selection) as skill
        from attribution a join fund on fund.fund_id = a.fund_id""",
    )({**tables, "attribution": fx05_attribution(spark, sf_dir)})
    base = ALL["e2e03_style_allocation"](tables).select("fund_id", "sector", F.col("score").alias("_base"))
    joined = base.join(ranked.select("fund_id", F.round(100 * F.col("skill"), 6).alias("skill")), "fund_id", "left")
    score = F.when(F.col("skill").isNull(), F.col("_base")).otherwise(0.75 * F.col("_base") + 0.25 * F.col("skill"))
    scored = joined.withColumn("score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("score"), "fund_id"))
    return scored.select("fund_id", "sector", "skill", "score", place.alias("place"))


QUERIES = {f.__name__: f for f in (e2e03_allocation_skill, src01_screener, src02_chart, src03_holdings, src04_entity_files, src05_snapshot, prj06_sector_map, src06_discover, src07_contract, src08_load_report, src09_index_lookup, src10_fallback_all, src11_ranked_sink, fx04_style_weights, fx04_current_mix, fx05_attribution)}

_F, _N, _I, _H = (f"({written(x, 'duckdb')})" for x in (FUND, NAV, INDEX_NAV, HOLDING))

ORACLE_SQL = {
    "src01_screener": f"select fund_id, name, sector, aum, subsector from {_F} f",
    "src02_chart": f"select fund_id, strftime(ts, '%Y-%m-%d') as ts, nav from {_N} n",
    "src03_holdings": f"select fund_id, type, title, sid, latest, change3m from {_H} h",
    "src04_entity_files": f"select 'IDX_' || index_id as index_id, strftime(ts, '%Y-%m-%d') as ts, nav from {_I} i",
    "src05_snapshot": f"select fund_id, strftime(ts, '%Y-%m-%d') as ts, nav, '2001-12-31' as snapshot_date from {_N} n where year(ts) = 2001",
    "src06_discover": f"select distinct f.sector, m.model from ({written(MODEL_SCORE, 'duckdb')}) m join {_F} f on f.fund_id = m.fund_id",
    "src07_contract": f"select 'model_score' as table_name, x as missing, count(*) as n_rows from ({written(MODEL_SCORE, 'duckdb')}) m, (select unnest(['name']) as x) u group by x",
    "src08_load_report": f"select case when l.fund_id is not null then 'skipped' when f.aum is null then 'failed' else 'success' end as status, count(*) as n from {_F} f left join (select distinct fund_id from {_H} h where cast(fund_id as int) % 2 = 0) l on l.fund_id = f.fund_id group by 1",
    "src09_index_lookup": f"select fund_id, case sector when 'AFRICA' then 'Large Cap' when 'AMERICA' then 'Mid Cap' when 'ASIA' then '.NISM250' when 'EUROPE' then 'Gold' else 'Unknown' end as name, case sector when 'AFRICA' then '.NSEI' when 'AMERICA' then '.NIMI150' when 'ASIA' then '.NISM250' when 'EUROPE' then 'GBES' else 'Unknown' end as index_id from {_F} f",
    "prj06_sector_map": f"select sector, '{{' || string_agg('\"' || subsector || '\":' || ids, ',' order by subsector) || '}}' as funds from (select sector, subsector, '[' || string_agg('\"' || fund_id || '\"', ',' order by fund_id) || ']' as ids from {_F} f group by 1, 2) x group by 1",
    "src10_fallback_all": f"with p as (select * from (values ('equity', 'AFRICA'), ('gold', 'AMERICA'), ('silver', 'ASIA')) v(asset, proxy)), n as (select index_id, count(*) as n from {_I} i group by 1), k as (select asset, index_id as source from p cross join n where n >= 30 qualify row_number() over (partition by asset order by index_id <> proxy, index_id) = 1) select asset, source, strftime(ts, '%Y-%m-%d') as ts, nav from k join {_I} j on j.index_id = k.source",
    "src11_ranked_sink": f"select f.sector, m.model, m.fund_id, m.score from ({written(MODEL_SCORE, 'duckdb')}) m join {_F} f on f.fund_id = m.fund_id",
}

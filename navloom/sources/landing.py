"""Sources and sinks of the fund data model: landed JSON and CSV, dated snapshots, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCREENER = "struct<success: boolean, data: struct<result: array<struct<mfId: string, name: string, sector: string, values: array<struct<filter: string, doubleVal: double, strVal: string>>>>>>"
CHART = "struct<success: boolean, data: array<struct<points: array<struct<ts: string, lp: double>>>>>"
HOLDINGS = "array<struct<type: string, title: string, latest: double, sid: string, ticker: string, change3m: double>>"
#: Columns that every score table must have. Fixed values.
CONTRACT = ("mfId", "name", "score", "data_days", "cagr_3y")
#: Index ids and their display names. Fixed values.
INDICES = ((".NSEI", "Large Cap"), (".NIMI150", "Mid Cap"), (".NISM250", "Small Cap"), (".NIFTY500", "Total Market"), ("GBES", "Gold"))


def screener_funds(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(fund_id, name, sector, aum, subsector) from screener responses; a value that is not there is null, bad JSON gives no row."""
    one = raw.select(F.explode(F.from_json(column, SCREENER)["data"]["result"]).alias("r"))

    def value(key: str, kind: str):
        return F.get(F.filter("r.values", lambda v: v["filter"] == key), 0)[kind]

    return one.select(F.col("r.mfId").alias("fund_id"), "r.name", "r.sector", value("aum", "doubleVal").alias("aum"), value("subsector", "strVal").alias("subsector"))


def chart_points(raw: DataFrame, id_col: str = "fund_id", column: str = "raw") -> DataFrame:
    """(id, ts, nav) from chart responses; an empty response gives no row, a bad timestamp null."""
    series = raw.select(id_col, F.explode(F.from_json(column, CHART)["data"]).alias("d"))
    points = series.select(id_col, F.explode("d.points").alias("p"))
    return points.select(id_col, F.col("p.ts").try_cast("timestamp").alias("ts"), F.col("p.lp").alias("nav"))


def holding_rows(raw: DataFrame, id_col: str = "fund_id", column: str = "raw") -> DataFrame:
    """(id, type, title, latest, sid, ticker, change3m): the current allocation, else the holdings, else nothing; NaN is null."""
    either = F.from_json(column, f"struct<data: struct<currentAllocation: {HOLDINGS}, holdings: {HOLDINGS}>>")["data"]
    rows = raw.select(id_col, F.explode(F.coalesce(either["currentAllocation"], either["holdings"])).alias("h")).select(id_col, "h.*")
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("latest", "change3m")})


def read_entity_files(spark: SparkSession, folder: str, schema: str = "ts date, nav double") -> DataFrame:
    """One long table of a folder of CSV files, one for each entity: entity is the file's name without .csv. No file, no row."""
    table = spark.read.schema(schema).option("header", True).csv(folder)
    return table.withColumn("entity", F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)))


def write_entity_files(table: DataFrame, id_col: str, folder: str) -> None:
    """One CSV file for each entity, named by its id with dots as underscores, as read_entity_files takes them; other columns are its rows.

    A leading dot is left out, because Spark does not read files whose names begin with an underscore or a dot.
    Spark writes a folder for each entity in one file; only their names are then changed, one rename an entity.
    """
    spark = table.sparkSession
    work = f"{folder}/_parts"
    named = table.withColumn("_file", F.regexp_replace(F.regexp_replace(F.col(id_col), r"^[._]+", ""), r"\.", "_")).drop(id_col)
    named.repartition("_file").write.mode("overwrite").partitionBy("_file").option("header", True).csv(work)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(work).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(path(f"{work}/_file=*/part-*.csv")) or []:
        entity = found.getPath().getParent().getName().removeprefix("_file=")
        files.rename(found.getPath(), path(path(folder), f"{entity}.csv"))
    files.delete(path(work), True)


def write_snapshot(table: DataFrame, path: str, date_col: str = "snapshot_date") -> None:
    """One partition for each date; dates that are written again are replaced, others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def read_snapshot(spark: SparkSession, path: str, date: str | None = None, date_col: str = "snapshot_date") -> DataFrame:
    """Rows of one snapshot date, the latest by default; only its partition is read."""
    table = spark.read.parquet(path)
    if date is None:
        date = table.agg(F.max(date_col)).first()[0]
    return table.where(F.col(date_col) == F.lit(date))


def discover_scores(files: DataFrame, column: str = "file") -> DataFrame:
    """(sector, model) of score tables by file name: the sector up to the last underscore, the model after it; others are left out."""
    stem = F.regexp_extract(column, r"([^/]+)\.csv$", 1)
    return files.select(F.regexp_extract(stem, r"^(.*)_([^_]+)$", 1).alias("sector"), F.regexp_extract(stem, r"^(.*)_([^_]+)$", 2).alias("model")).where("sector <> ''")


def missing_columns(table: DataFrame, name: str, required: tuple[str, ...] = CONTRACT) -> DataFrame:
    """(table_name, missing, n_rows): for each required column that the table lacks, how many rows would go without it."""
    missing = [c for c in required if c not in table.columns]
    rows = table.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.lit(name).alias("table_name"), F.explode(F.array(*map(F.lit, missing)).cast("array<string>")).alias("missing"), "n_rows")


def need_list(wanted: DataFrame, landed: DataFrame, key: str, refresh: bool = False) -> DataFrame:
    """Keys to load: those wanted that have not landed, or all of them on a refresh."""
    return wanted.select(key).distinct() if refresh else wanted.select(key).distinct().join(landed.select(key), key, "left_anti")


def load_report(wanted: DataFrame, landed: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """(status, n) of wanted keys: skipped (landed before), failed, success."""
    marked = wanted.select(key).distinct().join(landed.select(key, F.lit(1).alias("_l")).distinct(), key, "left").join(failed.select(key, F.lit(1).alias("_f")).distinct(), key, "left")
    return marked.select(F.when(F.col("_l") == 1, "skipped").when(F.col("_f") == 1, "failed").otherwise("success").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def index_catalogue(spark: SparkSession) -> DataFrame:
    """(index_id, display) of the known indices."""
    return spark.createDataFrame(list(INDICES), "index_id string, display string")


def resolve_index(names: DataFrame, catalogue: DataFrame, column: str = "name", most_broadcast: int = 100_000) -> DataFrame:
    """Adds index_id: the catalogue's (index_id, display) id of a display name, or the input itself. A catalogue of counted size is broadcast."""
    known = catalogue.select("index_id", F.col("display").alias("_display"))
    if known.limit(most_broadcast + 1).count() <= most_broadcast:
        known = F.broadcast(known)
    return names.join(known, F.col(column) == F.col("_display"), "left").select(*names.columns, F.coalesce("index_id", F.col(column)).alias("index_id"))


def first_source(candidates: DataFrame, least: int, key: str = "asset", priority: str = "priority", source: str = "source") -> DataFrame:
    """For each key the rows of the first source by priority that has `least` rows."""
    enough = candidates.groupBy(key, priority, source).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    first = enough.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(priority, source))).where("_k = 1").select(key, source)
    return candidates.join(first, [key, source])


def write_ranked(ranked: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder for each sector and model, overwritten; CSV has a header."""
    writer = ranked.write.mode("overwrite").partitionBy("sector", "model")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)

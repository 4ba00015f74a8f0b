"""New NAV files as a stream: each run takes what has arrived since the last and appends it, once for each fund and timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def land_new_files(spark: SparkSession, incoming: str, table: str, progress: str) -> None:
    """Reads CSV files (fund_id, ts, nav) that are new in `incoming` and appends their valid rows to the Parquet table, however old they are.

    Rows with a bad timestamp or a value that is not above 0 are dropped. Of repeated (fund, timestamp) rows the first landed stays,
    of those that arrive together any. A batch that is run again finds its keys in the table and adds only what is missing, so
    each key lands once. One writer at a time. A table that Spark's file sink wrote (with _spark_metadata) is refused, since its
    readers would not see the appended files.
    """
    if _exists(spark, f"{table}/_spark_metadata"):
        raise ValueError(f"{table} was written by a file sink; copy it to a new table and take a new progress folder")
    rows = spark.readStream.schema("fund_id string, ts string, nav string").option("header", True).csv(incoming)
    valid = rows.select("fund_id", F.col("ts").try_cast("timestamp").alias("ts"), F.col("nav").try_cast("double").alias("nav")).where("ts is not null and nav > 0")

    def land(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["fund_id", "ts"])
        if _exists(batch.sparkSession, table):
            there = batch.sparkSession.read.schema(batch.schema).parquet(table).select(F.col("fund_id").alias("_f"), F.col("ts").alias("_t"))
            once = once.join(there, F.col("fund_id").eqNullSafe(F.col("_f")) & (F.col("ts") == F.col("_t")), "left_anti")
        once.write.mode("append").parquet(table)

    query = valid.writeStream.foreachBatch(land).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()

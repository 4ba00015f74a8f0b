"""Exact ranks, order statistics and rank correlations of groups of any size.

A window over a group puts the group into one task. Here the distinct values of all groups are sorted by range over many tasks; a
task's values are counted up within the task, and a small table of counts by group and task says how many values lie before it. So no
group, however large, and no value, however common, has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.sources.shared import stored


def placed(df: DataFrame, by: Sequence[str], value: str, rows: str | None = None) -> DataFrame:
    """(by, value, n, before, total): each distinct value of a group with its count, the count of smaller values, and of all; nulls are left out.

    A row of df counts as many times as its column rows says, if one is named.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))
    dealt = stored(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranks")
    parts = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("_sum"))  # a row for each group and task
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).withColumn("total", F.sum("_sum").over(Window.partitionBy(*by)))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
    joined = dealt.alias("d").join(parts.alias("p"), same & (F.col("d._part") == F.col("p._part")))
    joined = joined.select(*(F.col(f"d.{c}") for c in [*by, value, "n", "_part"]), "_offset", "total")
    return joined.select(*by, value, "n", (F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "total")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str, rows: str | None = None) -> DataFrame:
    """(by, value, name): ranks from 1 of each group's distinct values, the mean where values are equal."""
    return placed(df, by, value, rows).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): order statistics of each group, linear between neighbours."""
    found = placed(df, by, value).withColumn("_end", F.col("before") + F.col("n") - 1)
    columns = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        low = F.max(F.when((F.col("before") <= F.floor(at)) & (F.floor(at) <= F.col("_end")), F.col(value)))
        high = F.max(F.when((F.col("before") <= F.ceil(at)) & (F.ceil(at) <= F.col("_end")), F.col(value)))
        columns.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return found.groupBy(*by).agg(*columns)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): rank correlation of x and y over the rows of a group where both are known; null where one does not vary."""
    by = list(by)
    pairs = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    rx, ry = (average_ranks(pairs, by, c, f"_r{i}", "_n") for i, c in enumerate((x, y)))
    joined = pairs.join(rx, [*by, x]).join(ry, [*by, y])
    n, a, b = F.sum("_n"), F.col("_r0"), F.col("_r1")
    sums = joined.groupBy(*by).agg(
        n.alias("n"), F.sum(a * F.col("_n")).alias("_a"), F.sum(b * F.col("_n")).alias("_b"), F.sum(a * a * F.col("_n")).alias("_aa"), F.sum(b * b * F.col("_n")).alias("_bb"), F.sum(a * b * F.col("_n")).alias("_ab")
    )
    va, vb = (F.col(f"_{c}{c}") / F.col("n") - F.pow(F.col(f"_{c}") / F.col("n"), 2) for c in "ab")
    cov = F.col("_ab") / F.col("n") - F.col("_a") / F.col("n") * F.col("_b") / F.col("n")
    return sums.select(*by, "n", F.when((va > 1e-9) & (vb > 1e-9), cov / F.sqrt(va * vb)).alias("rho"))


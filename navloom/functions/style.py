"""Returns-based style weights: least squares on the simplex, exact by trying every set of active sleeves.

Spark sums the products of returns by fund and window; only those few sums of each group reach Python, in Arrow batches, where all
groups of a batch are solved together.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASH = 1.065 ** (1 / 52) - 1


def simplex_weights(gram: np.ndarray, cross: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """For each group the weights w >= 0 with sum 1 that minimise w'Gw - 2 w'c; the first of equally good sets of sleeves.

    there: which sleeves a group has; a set with another one is no choice for it.
    """
    n, k = cross.shape
    best, out = np.full(n, np.inf), np.zeros((n, k))
    for size in range(1, k + 1):
        for own in combinations(range(k), size):
            own = list(own)
            system = np.zeros((n, size + 1, size + 1))
            system[:, :size, :size] = gram[:, own][:, :, own] + 1e-14 * np.eye(size)
            system[:, :size, size] = system[:, size, :size] = 1
            right = np.concatenate([cross[:, own], np.ones((n, 1))], 1)
            w = (np.linalg.pinv(system) @ right[:, :, None])[:, :size, 0]
            full = np.zeros((n, k))
            full[:, own] = np.maximum(w, 0)
            total = full.sum(1)
            fits = (w >= -1e-9).all(1) & (np.abs(total - 1) < 1e-6)
            value = np.einsum("ni,nij,nj->n", full, gram, full) - 2 * np.einsum("ni,ni->n", full, cross)
            if there is not None:
                fits &= there[:, own].all(1)
            take = fits & (value < best - 1e-15)
            best[take], out[take] = value[take], full[take]
    return out


def style_weights(rows: DataFrame, by: list[str], y: str = "f", sleeves: tuple[str, ...] = ("x1", "x2", "x3"), least: int = 13) -> DataFrame:
    """(by..., n, w_<sleeve>..., w_cash): style weights of each group of returns with cash at the risk-free rate as a last sleeve.

    Rows with a null return are left out; groups of fewer than `least` rows give no row.
    """
    columns = [F.col(s).cast("double") for s in sleeves] + [F.lit(CASH)]
    k = len(columns)
    sums = [F.avg(columns[i] * columns[j]).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.avg(F.col(y) * c).alias(f"_c{i}") for i, c in enumerate(columns)]
    whole = rows.dropna(subset=[y, *sleeves])
    summed = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def solve(*parts: pa.Array) -> pa.Array:
        values = [p.to_numpy(zero_copy_only=False) for p in parts]
        m = len(values[0])
        gram, at = np.zeros((m, k, k)), 0
        for i in range(k):
            for j in range(i, k):
                gram[:, i, j] = gram[:, j, i] = values[at]
                at += 1
        cross = np.column_stack(values[at:]) if m else np.zeros((0, k))
        return pa.array(list(simplex_weights(gram, cross)), pa.list_(pa.float64()))

    inputs = [f"_g{i}_{j}" for i in range(k) for j in range(i, k)] + [f"_c{i}" for i in range(k)]
    solved = summed.select(*by, "n", solve(*inputs).alias("_w"))
    return solved.select(*by, "n", *(F.col("_w")[i].alias(f"w_{s}") for i, s in enumerate([*sleeves, "cash"])))


def varying_style_weights(rows: DataFrame, by: list[str], y: str = "f", sleeves: tuple[str, ...] = ("x1", "x2"), later: str = "x3", least: int = 12, least_later: int = 13) -> DataFrame:
    """(by..., n, has_<later>, w_<sleeve>..., w_<later>, w_cash): style weights of groups where one sleeve has a shorter history than the others.

    A group with least_later weeks or more of that sleeve is solved with it, over the weeks that have it; the others are solved
    without it, over all their weeks, and give it the weight 0. Groups of fewer than `least` such weeks give no row.
    """
    columns = [*(F.col(s).cast("double") for s in sleeves), F.coalesce(F.col(later).cast("double"), F.lit(0.0)), F.lit(CASH)]
    k, names = len(columns), [*sleeves, later, "cash"]
    known = rows.dropna(subset=[y, *sleeves]).withColumn("_there", F.col(later).isNotNull())
    with_it = lambda c: F.avg(F.when(F.col("_there"), c))
    sums = [f(columns[i] * columns[j]).alias(f"_{t}g{i}_{j}") for t, f in (("a", F.avg), ("b", with_it)) for i in range(k) for j in range(i, k)]
    sums += [f(F.col(y) * c).alias(f"_{t}c{i}") for t, f in (("a", F.avg), ("b", with_it)) for i, c in enumerate(columns)]
    summed = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("_there"), 1)).alias("_with"), *sums)
    has = F.col("_with") >= least_later
    summed = summed.withColumn("_has", has).withColumn("n", F.when(has, F.col("_with")).otherwise(F.col("_all"))).where(F.col("n") >= least)
    own = lambda name: F.when(F.col("_has"), F.col(f"_b{name}")).otherwise(F.col(f"_a{name}"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def solve(has: pa.Array, *parts: pa.Array) -> pa.Array:
        values = [p.to_numpy(zero_copy_only=False) for p in parts]
        m = len(has)
        gram, at = np.zeros((m, k, k)), 0
        for i in range(k):
            for j in range(i, k):
                gram[:, i, j] = gram[:, j, i] = values[at]
                at += 1
        there = np.ones((m, k), bool)
        there[:, k - 2] = has.to_numpy(zero_copy_only=False).astype(bool)
        cross = np.column_stack(values[at:]) if m else np.zeros((0, k))
        return pa.array(list(simplex_weights(gram, cross, there)), pa.list_(pa.float64()))

    inputs = [own(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [own(f"c{i}") for i in range(k)]
    solved = summed.select(*by, "n", F.col("_has").alias(f"has_{later}"), solve("_has", *inputs).alias("_w"))
    return solved.select(*by, "n", f"has_{later}", *(F.col("_w")[i].alias(f"w_{s}") for i, s in enumerate(names)))


def attribution(aligned: DataFrame, weights: DataFrame, id_col: str = "fund_id") -> DataFrame:
    """(id, strategic, tactical, selection), annual, from 26 weeks on.

    aligned: id, rd (weeks from the newest, 1 first), f, x1..x3. weights: id, e0 (rd of the window's newest week), w_*.
    A week has the weights of the newest window that ended by then, so weeks before the end of the first window don't count.
    strategic: mean weights of these weeks against equal weights of the sleeves with over 1 %; tactical: weights against mean
    weights; selection: the fund against its weights.
    """
    names = ["x1", "x2", "x3", "cash"]
    ended = weights.select(id_col, F.col("e0").cast("int").alias("rd"), *(F.col(f"w_{s}").alias(f"_{s}") for s in names))
    rows = aligned.withColumn("rd", F.col("rd").cast("int")).withColumn("cash", F.lit(CASH)).join(ended, [id_col, "rd"], "left")
    so_far = Window.partitionBy(id_col).orderBy(F.desc("rd")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(id_col, "f", *names, *(F.last(f"_{s}", ignorenulls=True).over(so_far).alias(f"w_{s}") for s in names)).where("w_cash is not null")
    held = sum((F.col(f"w_{s}") * F.col(s) for s in names), F.lit(0.0))
    means = [F.avg(c).alias(a) for s in names for c, a in ((f"w_{s}", f"m_{s}"), (s, f"r_{s}"))]
    by = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), *means, F.avg(held).alias("_held"), F.avg("f").alias("_f")).where("n >= 26")
    active = sum((F.when(F.col(f"m_{s}") > 0.01, 1).otherwise(0) for s in names), F.lit(0))
    equal = sum((F.when(F.col(f"m_{s}") > 0.01, F.col(f"r_{s}")).otherwise(0.0) for s in names), F.lit(0.0)) / F.when(active > 0, active)
    mean = sum((F.col(f"m_{s}") * F.col(f"r_{s}") for s in names), F.lit(0.0))
    return by.select(id_col, *(F.round(52 * e, 6).alias(a) for a, e in (("strategic", mean - equal), ("tactical", F.col("_held") - mean), ("selection", F.col("_f") - F.col("_held")))))

"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose measure is above a cutoff. Cutoffs are not chosen by hand. The labelled documents are split in two
by a hash. On the fit half each stratum (by length; strata with few labels are merged) gets a path of ever stricter sets of cutoffs:
each step tightens the rule that catches most bad texts for the good ones it loses. On the holdout the path is walked while an
exact binomial test still proves that all rules together falsely reject less than the allowed rate; it stops at the first
step that fails (fixed-sequence testing), and the level is divided by the number of strata, so all bounds hold together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import bounded_batches, materialize

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = " \t\n\v\f\r"
_NOT_UPPER = re.compile(r"[^A-Z]+")
#: Measures of a text, in order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Upper ends of the strata by number of words; the last has none.
STRATA = (200, 1000)
#: Rules: name and SQL of the measure that must not be above the cutoff.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "long_words": "1 - 5 / greatest(word_chars / greatest(n_words, 1), 5)",
}
#: Cutoffs that are tried, from strict to lenient.
GRID = tuple(i / 40 for i in range(1, 40))


@dataclass(frozen=True)
class Risk:
    """False rejections allowed in each stratum, by all rules together; the chance that any bound fails; weight of a good text lost on the fit half."""

    rate: float = 0.02
    chance: float = 0.05
    good_weight: float = 5.0


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text; words are runs of anything but ASCII white space. A null text has none."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum([text.count(c) for c in _SPACES])
    seen, dups, lines = set(), 0, 0
    for line in text.split("\n"):
        if line and line.encode("utf-8", "surrogatepass").split(None, 1):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        often = {w for w, c in Counter(windows).items() if c > 1}
        end = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if w in often:
                repeats += i + 3 - max(i, end)
                end = i + 3
    upper = len(_NOT_UPPER.sub("", text))
    return n, chars, len(_SYMBOLS.findall(text)), dups, repeats, lines, upper


_KIND = pa.struct([(name, pa.int64()) for name in MEASURES])


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(MEASURES))], fields=list(_KIND))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i, end in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < end, F.lit(i)).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed downwards from k until terms no longer count."""
    if k >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log_term)
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17 and i < n * p:
            break
    return min(1.0, total)


@dataclass(frozen=True)
class Cutoffs:
    """For each stratum (the words from which it begins) its cutoffs by rule; a rule without one rejects nothing."""

    strata: tuple[tuple[int, tuple[tuple[str, float], ...]], ...] = ()


def least_good(level: float, rate: float) -> int:
    """Good holdout texts from which a cutoff that loses none of them can be proven."""
    return math.ceil(math.log(level) / math.log1p(-rate))


def merged_strata(good: list[int], risk: Risk) -> list[list[int]]:
    """Neighbouring strata, merged until each has enough good holdout texts for a proof (or only one is left)."""
    groups = [[s] for s in range(len(good))]
    while len(groups) > 1:
        held = [sum(good[s] for s in g) for g in groups]
        i = min(range(len(groups)), key=held.__getitem__)
        if held[i] >= least_good(risk.chance / len(groups), risk.rate):
            break
        j = min((j for j in (i - 1, i + 1) if 0 <= j < len(groups)), key=held.__getitem__)
        groups[min(i, j) : max(i, j) + 1] = [groups[min(i, j)] + groups[max(i, j)]]
    return groups


def cutoff_path(good: np.ndarray, bad: np.ndarray, weight: float) -> list[tuple[int, int]]:
    """Steps (rule, bins that it rejects from) of ever stricter cutoffs, by counts (rules x bins) of the fit half's texts.

    Each step is the tightening of one rule with the most gain: the share of bad texts newly caught less weight times that of good
    texts newly lost; ties go to the first rule and the more lenient cutoff. The path ends when no tightening gains.
    """
    share = bad / max(1, bad[0].sum()) - weight * good / max(1, good[0].sum())
    at, path = [share.shape[1]] * len(share), []
    while True:
        steps = [(float(share[r, b : at[r]].sum()), -r, b) for r in range(len(share)) for b in range(1, at[r])]
        gain, r, b = max(steps, default=(0.0, 0, 0))
        if gain <= 1e-12:
            return path
        at[-r] = b
        path.append((-r, b))


def proven_steps(lost: list[int], n_good: int, level: float, rate: float) -> int:
    """Steps of a path that hold: lost[k] good holdout texts are rejected by step k but by none before."""
    total, k = 0, 0
    for more in lost:
        total += more
        if not n_good or binomial_tail(total, n_good, rate) > level:
            break
        k += 1
    return k


def _bins() -> list[Column]:
    """For each rule how many cutoffs of the grid a text exceeds."""
    return [F.least(F.greatest(F.ceil(F.expr(f"({sql}) * {len(GRID) + 1}")) - 1, F.lit(0)), F.lit(len(GRID))).cast("int") for sql in RULES.values()]


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk, id_col: str) -> Cutoffs:
    """Cutoffs from all labelled texts that pass the base rule; strata x rules x grid rows at most reach the driver."""
    known = labels.select(F.col(id_col), F.col("quality").alias("_quality")).where("_quality in (0, 1)").groupBy(id_col).agg(F.max("_quality").alias("_quality"))
    holdout = F.pmod(F.xxhash64(id_col, F.lit("holdout")), F.lit(2)).cast("int")
    rows = measured.where(~base_failed()).join(known, id_col)
    rows = materialize(rows.select("_quality", stratum().alias("_s"), holdout.alias("_held"), F.array(*_bins()).alias("_bins")), "quality-labelled")
    fit = rows.where("_held = 0").select("_quality", "_s", F.posexplode("_bins").alias("_r", "_b")).groupBy("_s", "_r", "_b")
    counts = np.zeros((2, len(STRATA) + 1, len(RULES), len(GRID) + 1), np.int64)
    for r in fit.agg(F.sum("_quality").alias("good"), F.sum(1 - F.col("_quality")).alias("bad")).collect():
        counts[:, r["_s"], r["_r"], r["_b"]] = r["good"], r["bad"]
    held = rows.where("_held = 1 and _quality = 1")
    n_good = {r["_s"]: r["count"] for r in held.groupBy("_s").count().collect()}
    groups = merged_strata([n_good.get(s, 0) for s in range(len(STRATA) + 1)], risk)
    paths = [cutoff_path(*(counts[k, g].sum(0) for k in (0, 1)), risk.good_weight) for g in groups]
    step = F.lit(None).cast("int")  # the first step of the stratum's path that rejects the text
    for g, path in zip(groups, paths, strict=True):
        rejects = [F.when(F.element_at("_bins", r + 1) >= b, F.lit(k)) for k, (r, b) in enumerate(path)]
        step = F.when(F.col("_s").isin(g), F.coalesce(*rejects, F.lit(None).cast("int"))).otherwise(step)
    first = F.lit(-1)
    for i, g in enumerate(groups):
        first = F.when(F.col("_s").isin(g), F.lit(i)).otherwise(first)
    lost = {(r["_g"], r["_k"]): r["count"] for r in held.select(first.alias("_g"), step.alias("_k")).where("_k is not null").groupBy("_g", "_k").count().collect()}
    out = []
    for i, (g, path) in enumerate(zip(groups, paths, strict=True)):
        n = sum(n_good.get(s, 0) for s in g)
        k = proven_steps([lost.get((i, j), 0) for j in range(len(path))], n, risk.chance / len(groups), risk.rate)
        cuts = {list(RULES)[r]: GRID[b - 1] for r, b in path[:k]}  # later steps of a rule are stricter
        out.append(((0, *STRATA)[g[0]], tuple(cuts.items())))
    return Cutoffs(tuple(out))


def passes(cutoffs: Cutoffs) -> Column:
    """No measure is above a cutoff of the text's stratum."""
    out = F.lit(True)
    exceeded = dict(zip(RULES, _bins(), strict=True))  # counted as they were when the cutoffs were proven
    for begins, cuts in cutoffs.strata:  # from the shortest texts on: the last that begins before the text's length holds
        own = F.lit(True)
        for rule, cut in cuts:
            own = own & (exceeded[rule] <= GRID.index(cut))
        out = F.when(F.col("n_words") >= begins, own).otherwise(out)
    return out


def measured_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bounded_batches(docs).select(F.col(id_col), measures(F.col(text_col)).alias("_m")).select(id_col, "_m.*")


def judge_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES, base_failed, kept) for every row of docs.

    labels (id, quality 0/1) calibrate the cutoffs; ids labelled twice count as good if either says so; null labels and ids are left
    out. Null and empty texts have no words and fail the base rule. Without enough labelled texts no cutoff is proven and only
    the base rule rejects. Repeated rows are each judged; an empty table gives an empty result; other columns are not read.
    """
    measured = materialize(measured_documents(docs, id_col, text_col), "quality-measures")
    cutoffs = fit_cutoffs(measured, labels, risk, id_col)
    judged = measured.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & passes(cutoffs))


def keep_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the base rule and the proven cutoffs keep, all columns; texts are measured in place, not shuffled.

    Null and empty texts go (base rule); repeated rows stay or go together; null ids and labels calibrate nothing; without enough
    labels only the base rule rejects; an empty table stays empty.
    """
    cutoffs = fit_cutoffs(measured_documents(docs, id_col, text_col), labels, risk, id_col)
    names = docs.columns
    whole = bounded_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), measures(F.col(text_col)).alias("_m")).select("_row", "_m.*")
    return whole.where(~base_failed() & passes(cutoffs)).select("_row.*")

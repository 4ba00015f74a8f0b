"""Quality scores by Bradley-Terry pairwise ranking.

All labelled documents that are not held out are dealt to buckets, and in each pairs (better, worse) are drawn; the score is linear in a text's features (its surface, and its words hashed
into slots), and its weights maximise the likelihood that the better of each pair wins: a logistic loss on differences of
features, by Newton steps on sums over all buckets. A document's score is then set against a quantile of all their scores: the
share of bad documents among the labelled ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.functions.ranks import quantiles
from navloom.llm.common import WordHashes, bounded_batches, discard, id_remainder, materialize, word_list
from navloom.llm.near_join import in_groups
from navloom.llm.quality_rules import MEASURES, measure

#: Pairs that each row is in, on average (each row of the rarer label is in more); rows of a bucket that have the more common label; rows
#: with the rarer one that a bucket has at least, on average (all, if there are fewer).
PAIRS_OF_ROW, BUCKET, RARER = 10, 2048, 64
#: The score at the threshold.
AT_CUTOFF = 0.3
SURFACE, WORD_SLOTS = 16, 128
N_FEATURES = SURFACE + WORD_SLOTS
#: Shrinkage of the weights of surface features and of word slots.
PENALTY = np.r_[np.full(SURFACE, 1e-3), np.full(WORD_SLOTS, 1e-2)]


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Numbers of a whole text: its surface, and the root of the share of its words in each slot; an empty text has zeros."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    m = dict(zip(MEASURES, measure(text), strict=True))
    words, chars, lines = max(m["n_words"], 1), max(m["word_chars"], 1), max(m["n_lines"], 1)
    tokens = text.split()
    distinct = len(set(tokens))
    ends = sum([text.count(c) for c in ".!?"])
    slots = hashes.array(word_list(text)) % np.uint64(WORD_SLOTS)
    out[SURFACE:] = np.sqrt(np.bincount(slots.astype(np.int64), minlength=WORD_SLOTS) / max(1, len(slots)))
    out[:SURFACE] = (
        math.log1p(m["n_words"]),
        min(math.log1p(m["n_words"]), math.log(50)),
        m["word_chars"] / words / 10,
        m["n_symbols"] / chars,
        min(m["n_symbols"] / words, 1),
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        m["n_upper"] / chars,
        distinct / words,
        math.log1p(m["n_words"] / lines),
        ends / words,
        text.count("!") / words,
        text.count(",") / words,
        text.count("|") / words,
        sum([text.count(c) for c in "0123456789"]) / chars,
        float(m["n_words"] == 0),
    )
    return out


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cutoff: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, AT_CUTOFF where the linear score is at the cutoff."""
        z = ((rows - self.mean) / self.scale) @ self.weights - self.cutoff + math.log(AT_CUTOFF / (1 - AT_CUTOFF))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_gradient(diff: np.ndarray, w: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, chance that the worse one wins) of the mean log likelihood of pairs less half the penalty on squares."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
    return diff.T @ p / len(diff) - penalty * w, p


def pair_differences(rows: np.ndarray, good: np.ndarray, seed: int) -> np.ndarray:
    """Better less worse: every row is in a pair, and the rarer label's rows in as many as the other's together."""
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return np.zeros((0, rows.shape[1]))
    rng = np.random.default_rng(seed)
    n = PAIRS_OF_ROW // 2 * max(len(up), len(down))
    return rows[np.resize(rng.permutation(up), n)] - rows[rng.permutation(np.resize(down, n))]


def pair_sums(diff: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of pairs, gradient, Hessian) of the summed log likelihood, without penalty."""
    gradient, p = pair_gradient(diff, w, np.zeros(len(w)))
    return len(diff), gradient * len(diff), (diff * (p * (1 - p))[:, None]).T @ diff


def newton(sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], d: int, penalty: np.ndarray | float) -> np.ndarray:
    """Weights with the smallest logistic loss of feature differences, from sums over all pairs for given weights."""
    w, penalty = np.zeros(d), np.broadcast_to(penalty, d)
    for _ in range(20):
        n, gradient, hessian = sums(w)
        step = np.linalg.solve(hessian / n + np.diag(penalty), gradient / n - penalty * w)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def usable_scale(deviation: np.ndarray) -> np.ndarray:
    return np.where(deviation > 1e-12, deviation, 1.0)


def fit_pairs(rows: np.ndarray, good: np.ndarray, penalty: np.ndarray | float = 1e-3, seed: int = 5) -> Ranker:
    """The fit on one bucket, in memory; without both labels every score is above the cutoff."""
    d = rows.shape[1]
    mean, scale = (rows.mean(0), usable_scale(rows.std(0))) if len(rows) else (np.zeros(d), np.ones(d))
    z = (rows - mean) / scale
    diff = pair_differences(z, good, seed)
    if not len(diff):
        return Ranker(mean, scale, np.zeros(d), -1.0)
    w = newton(lambda at: pair_sums(diff, at), d, penalty)
    return Ranker(mean, scale, w, float(np.quantile(z @ w, (good == 0).sum() / len(rows))))


def feature_bytes():
    kept: list[WordHashes] = []

    @F.arrow_udf("binary")
    def rows(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(WordHashes())
        return pa.array([features(t.as_py(), kept[0]).astype(np.float32).tobytes() for t in texts], pa.binary())

    return rows


def known_labels(labels: DataFrame, label: str, id_col: str, fold: int) -> DataFrame:
    """(_id, label) of the labelled ids that are not held out (crc32 of the id mod fold is not 0)."""
    return labels.where((id_remainder(fold, id_col) != 0) & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias(label))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str, fold: int = 5) -> DataFrame:
    """(_id, _text, label) of about `most` labelled rows at most, none of them held out (crc32 of the id mod fold is 0).

    The rows are those with the smallest hashes of their ids; as their number is bounded they are broadcast to the documents. Of
    several texts with one id the first by content stays, so that repeated rows don't add up.
    """
    known = known_labels(labels, label, id_col, fold)
    n = known.count()
    cutoff = min((1 << 63) - 1, (most << 64) // max(n, 1) - (1 << 63))
    taken = known.where(F.xxhash64("_id", F.lit("sample")) <= cutoff).limit(2 * most)
    texts = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(taken), "_id")
    return texts.groupBy("_id", label).agg(F.min("_text").alias("_text"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its features one after the other, labels, and which rows are the first of their copies."""
    for group in in_groups(batches, "bucket"):
        parts = [group.column("bucket")[0].as_py(), b"".join(group.column("f").to_pylist()), *(group.column(c).to_numpy().astype(np.int8).tobytes() for c in ("good", "first"))]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(parts, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "f", "good", "first"])


def pair_buckets(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fold: int = 5) -> DataFrame | None:
    """(bucket, f, good, first): all labelled rows that are not held out, a packed row for each bucket; None without both labels.

    A row with the more common label is in one bucket, one with the rarer label in as many as it takes for RARER rows in each. Of several
    texts with one id the one with the smallest hash stays, so that repeated rows don't add up.
    """
    known = known_labels(labels, "quality", id_col, fold)
    there = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").groupBy("quality").count()
    n = {r["quality"]: r["count"] for r in there.collect()}
    if len(n) < 2:
        return None
    rarer = min(n, key=n.get)
    buckets = math.ceil(max(n.values()) / BUCKET)
    copies = min(buckets, math.ceil(RARER * buckets / n[rarer]))
    texts = bounded_batches(docs).where(id_remainder(fold, id_col) != 0).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), feature_bytes()(F.col(text_col)).alias("f"))
    rows = texts.groupBy("_id").agg(F.min(F.struct("_h", "f")).alias("_one")).join(known, "_id").select("_id", F.col("quality").alias("good"), F.col("_one.f").alias("f"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("good") == rarer, F.lit(copies - 1)).otherwise(F.lit(0)))))
    bucket = F.pmod(F.xxhash64("_id", F.lit("pairs")) + F.col("_copy"), F.lit(buckets))
    rows = rows.select(bucket.alias("bucket"), "_id", "f", "good", (F.col("_copy") == 0).cast("int").alias("first"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "_id").drop("_id")
    return materialize(rows.mapInArrow(_packed, "bucket bigint, f binary, good binary, first binary"), "quality-pairs")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for bucket, f, *flags in zip(*batch.columns, strict=True):
            good, first = (np.frombuffer(x.as_py(), np.int8) for x in flags)
            yield bucket.as_py(), np.frombuffer(f.as_py(), np.float32).reshape(-1, N_FEATURES).astype(float), good, first == 1


def merged_moments(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, summed squares around them) of all parts together."""
    n, mean, squares = parts[0]
    for k, other, more in parts[1:]:
        squares = squares + more + (other - mean) ** 2 * (n * k / (n + k))
        mean, n = mean + (other - mean) * (k / (n + k)), n + k
    return n, mean, squares


def fit_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """The fit on all labelled rows that are not held out. The driver gets a row of sums from each task, no rows."""
    table = pair_buckets(docs, labels, id_col, text_col)
    if table is None:
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -1.0)

    def summed(of_bucket: Callable, merge: Callable) -> tuple:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [x for x in (of_bucket(*bucket) for bucket in _unpacked(batches)) if x[0]]
            if parts:
                n, *sums = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=["n", "a", "b"])

        found = [(r.n, np.frombuffer(r.a), np.frombuffer(r.b)) for r in table.mapInArrow(run, "n bigint, a binary, b binary").collect()]
        return merge(found)

    def moments(_, rows, good, first):
        own = rows[first]
        return len(own), own.mean(0) if len(own) else None, ((own - own.mean(0)) ** 2).sum(0) if len(own) else None

    n, mean, squares = summed(moments, merged_moments)
    scale = usable_scale(np.sqrt(squares / n))

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def of_bucket(bucket, rows, good, first):
            diff = pair_differences((rows - mean) / scale, good, bucket)
            return pair_sums(diff, w) if len(diff) else (0,)

        n, gradient, hessian = summed(of_bucket, lambda parts: tuple(sum(x) for x in zip(*parts, strict=True)))
        return n, gradient, hessian.reshape(len(w), len(w))

    w = newton(sums, N_FEATURES, PENALTY)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, good, first in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(((rows[first] - mean) / scale) @ w), pa.array(good[first] == 0)], names=["score", "worse"])

    scored = materialize(table.mapInArrow(scores, "score double, worse boolean"), "quality-scores")
    share = scored.agg(F.count_if("worse") / F.count(F.lit(1))).first()[0]
    cutoff = quantiles(scored.withColumn("all", F.lit(0)), ["all"], "score", {"cutoff": share}).first()["cutoff"]
    discard(table, scored)
    return Ranker(mean, scale, w, float(cutoff))


def rank_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs; predicted is 1 from the cutoff quantile on.

    Only labels of ids with crc32(id as text) mod 5 other than 0 are learned from. Null and empty texts have the features of a
    text without words. Without labels of both kinds everything is predicted good. Repeated rows are each scored; an empty
    table gives an empty result; other columns are not read.
    """
    ranker = fit_ranker(docs, labels, id_col, text_col)
    kept: list[WordHashes] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(WordHashes())
        rows = np.array([features(t.as_py(), kept[0]) for t in texts]).reshape(-1, N_FEATURES)
        return pa.array(ranker.score(rows))

    scored = bounded_batches(docs).select(F.col(id_col), (id_remainder(5, id_col) == 0).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= AT_CUTOFF).cast("int"))

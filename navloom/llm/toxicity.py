"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Terms are words, as 64-bit hashes; a term weighs (1 + ln count) * idf. The examples are a bounded sample of labelled rows with all
their terms; document frequencies are counted over all documents. The NEIGHBOURS nearest examples by plain cosine vote. A neighbour's
vote is the part of its cosine that comes from telling words: each product of weights counts with the square of the word's relevance,
log2(2 + labelled 1 / max(1, labelled 0)) - 1 over the examples with it. No term is left out: a text with any word of any example has
neighbours. One example with the same text is left out, so no score rests on a document's own label; its copies vote.

The index is a block-max inverted index: a posting list of examples for each term. Lists of terms that more than a quarter of the
examples hold are kept by example, with the largest weight in each block of examples. A search reads the short lists and adds to
each example what the long lists can give in its block at most; only examples that may still be among the nearest are then
counted in full. The result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import WordHashes, bounded_batches, id_remainder, materialize, word_list
from navloom.llm.ranking import labelled_sample

#: Labelled rows that are the examples, at most about so many (by a hash of the id). The index takes about 10 bytes a word of theirs.
MOST_LABELLED = 3_000
#: Examples under which votes prove nothing.
LEAST_LABELLED = 20
#: Examples that vote; examples of a block; share of the examples from which a term's list is long; examples that set the first bar.
NEIGHBOURS, BLOCK, LONG_SHARE, FIRST = 60, 32, 0.25, 96


def term_counts(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the words of a whole text."""
    return np.unique(hashes.array(word_list(text)), return_counts=True)


def text_hash(text: str | None) -> int:
    """A signed 64-bit hash of a whole text; null counts as empty."""
    return int(np.uint64(xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))).view(np.int64))


def places_in(vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places ascending, counts) of the terms that an ascending vocabulary has."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), counts[:0]
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    there = vocabulary[at] == terms
    return at[there], counts[there]


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    lengths = ends - starts
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def relevance(with_1: np.ndarray, with_0: np.ndarray) -> np.ndarray:
    """Square of how telling terms are that so many examples of label 1 and 0 hold; 0 for terms that only the latter have."""
    return (np.log2(2 + with_1 / np.maximum(1, with_0)) - 1) ** 2


@dataclass
class ExampleIndex:
    """Unit vectors of labelled examples as posting lists; examples without words are near to nothing."""

    vocabulary: np.ndarray  # hashes, ascending
    factor: np.ndarray  # idf of each term
    telling: np.ndarray  # relevance of each term, for votes only
    ids: np.ndarray
    texts: np.ndarray  # hashes of the examples' texts
    labels: np.ndarray
    first: np.ndarray  # of each term, its first posting in a short list; one more at the end
    example: np.ndarray  # of each posting
    weight: np.ndarray  # of each posting
    column: np.ndarray  # of each term, its column below, -1 for short lists
    rows: np.ndarray  # examples x terms with long lists: four times the size of these lists at most
    largest: np.ndarray  # blocks x terms with long lists

    @staticmethod
    def weights(factor: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * factor[terms]
        norm = math.sqrt(float(w @ w))
        return w / norm if norm else w

    @classmethod
    def build(cls, vocabulary: np.ndarray, factor: np.ndarray, telling: np.ndarray, ids, texts, labels, terms: list[np.ndarray], counts: list[np.ndarray]) -> ExampleIndex:
        """From the places and counts of every example's terms."""
        own = [cls.weights(factor, t, c) for t, c in zip(terms, counts, strict=True)]
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in zip(terms, own, strict=True)]
        order = sorted(range(len(own)), key=lambda i: (heaviest[i], ids[i]))  # examples with the same heaviest term share blocks
        n = len(order)
        term = np.concatenate([np.zeros(0, np.int64), *(terms[i] for i in order)])
        weight = np.concatenate([np.zeros(0), *(own[i] for i in order)]).astype(np.float32)
        example = np.repeat(np.arange(n), [len(terms[i]) for i in order])
        long = np.bincount(term, minlength=len(vocabulary)) > LONG_SHARE * n
        column = np.where(long, np.cumsum(long) - 1, -1).astype(np.int32)
        apart = long[term]
        rows = np.zeros((n, int(long.sum())), np.float32)
        rows[example[apart], column[term[apart]]] = weight[apart]
        largest = np.maximum.reduceat(rows, np.arange(0, n, BLOCK)) if n else rows
        term, weight, example = term[~apart], weight[~apart], example[~apart]
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1)).astype(np.int64)
        every_id, every_text, every_label = (np.array([x[i] for i in order], np.int64) for x in (ids, texts, labels))
        return cls(vocabulary, factor, telling, every_id, every_text, every_label, first, example[by_term].astype(np.int32), weight[by_term], column, rows, largest)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, cosines, votes) of the k nearest examples with a positive cosine, nearest first, ties by place; exact. without: hash of a text; one example with it is left out."""
        n = len(self.ids)
        if not len(terms) or not n:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        own = self.weights(self.factor, terms, counts)
        told = own * self.telling[terms]
        first, last = self.first[terms], self.first[terms + 1]
        postings, times = spread(first, last), last - first
        who, weight = self.example[postings], self.weight[postings]
        known = np.bincount(who, np.repeat(own, times) * weight, n)
        column = self.column[terms]
        long = column >= 0
        w, v = np.zeros((2, self.rows.shape[1]), np.float32)
        w[column[long]], v[column[long]] = own[long], told[long]
        bounds = known + np.repeat((self.largest @ w) * (1 + 1e-4) + 1e-6, BLOCK)[:n]  # single precision: a little above what it may reach
        if without is not None:
            bounds[np.flatnonzero(self.texts == without)[:1]] = 0
        bar = 0.0
        if n > FIRST and k <= FIRST:
            some = np.argpartition(bounds, n - FIRST)[n - FIRST :]
            reached = np.where(bounds[some] > 0, known[some] + self.rows[some] @ w, 0)
            bar = float(np.partition(reached, FIRST - k)[FIRST - k])
        here = np.flatnonzero((bounds >= bar - 1e-5) & (bounds > 0))
        cosines = known[here] + self.rows[here].astype(np.float64) @ w
        here, cosines = here[cosines > 0], cosines[cosines > 0]
        best = np.lexsort((here, -np.round(cosines, 12)))[:k]
        here, cosines = here[best], cosines[best]
        votes = self.rows[here].astype(np.float64) @ v + np.bincount(who, np.repeat(told, times) * weight, n)[here]
        return here, cosines, votes

    def votes(self, terms: np.ndarray, counts: np.ndarray, without: int | None = None) -> tuple[float, float, np.ndarray, np.ndarray]:
        """(share of the votes for label 1, largest cosine, places, cosines); terms and counts by places in the vocabulary."""
        places, cosines, votes = self.nearest(terms, counts, without=without)
        total = float(votes.sum())
        return (float(votes @ self.labels[places]) / total if total > 0 else 0.0), (float(cosines[0]) if len(cosines) else 0.0), places, cosines


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic model with a constant (first, not shrunk), by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(z.shape[1]), penalty * np.r_[1e-3, np.ones(x.shape[1])]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(shrink), z.T @ (y - p) - shrink * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    index: ExampleIndex
    calibration: np.ndarray

    def score(self, text: str | None, hashes: WordHashes) -> tuple[float, np.ndarray, np.ndarray]:
        """(calibrated chance of label 1, ids of the nearest examples, their cosines) of a text."""
        vote, top, places, cosines = self.index.votes(*places_in(self.index.vocabulary, *term_counts(text, hashes)), without=text_hash(text))
        z = self.calibration @ np.array([1.0, vote, vote * top])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), self.index.ids[places], cosines


_VECTOR = T.StructType([T.StructField("text", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def _vectors():
    @F.arrow_udf(_VECTOR)
    def vectors(texts: pa.Array) -> pa.Array:
        hashes = WordHashes()
        rows = [term_counts(t.as_py(), hashes) for t in texts]
        lists = pa.list_(pa.int64())
        own = pa.array([text_hash(t.as_py()) for t in texts], pa.int64())
        return pa.StructArray.from_arrays([own, pa.array([r[0].view(np.int64) for r in rows], lists), pa.array([r[1] for r in rows], lists)], names=["text", "terms", "counts"])

    return vectors


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> tuple[int, np.ndarray]:
    """(rows of docs, rows that hold each term of the vocabulary); tasks add up their own rows before the shuffle."""

    def tally(batches):
        hashes, total, n = WordHashes(), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                terms, counts = term_counts(text.as_py(), hashes)
                total[places_in(vocabulary, terms, counts)[0]] += 1
        there = np.flatnonzero(total)
        for start in range(0, len(there), 100_000):
            part = there[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["term", "n"])

    summed = bounded_batches(docs).select(text_col).mapInArrow(tally, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    of_terms = summed[summed["term"] >= 0]
    out[of_terms["term"].to_numpy()] = of_terms["n"].to_numpy()
    return int(summed["n"][summed["term"] < 0].sum()), out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> ToxicityModel:
    """Examples from a bounded labelled sample without held-out rows; document frequencies from all of docs.

    The examples are written once; their number is bounded by most_labelled, so that their terms and votes fit into the driver.
    """
    sample = labelled_sample(docs, labels, "toxic", most_labelled, id_col, text_col)
    examples = materialize(sample.select("_id", "toxic", _vectors()("_text").alias("v")).select("_id", "toxic", "v.*"), "toxic-examples")
    got = examples.toPandas().sort_values("_id", kind="stable")
    ids, y = got["_id"].tolist(), got["toxic"].to_numpy(int)
    hashed = [np.asarray(x, np.int64).view(np.uint64) for x in got["terms"]]
    counts = [np.asarray(x, np.int64) for x in got["counts"]]
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    n, frequency = document_frequencies(docs, vocabulary, text_col)
    placed = [np.searchsorted(vocabulary, h) for h in hashed]
    with_1, with_0 = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(p for p, label in zip(placed, y, strict=True) if label == k)]), minlength=len(vocabulary)) for k in (1, 0))
    idf = np.log((1 + n) / (1 + frequency)) + 1e-3
    index = ExampleIndex.build(vocabulary, idf, relevance(with_1, with_0), ids, got["text"].tolist(), y.tolist(), placed, counts)

    def vote(batches):
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)
            voted = [index.votes(np.searchsorted(vocabulary, t.values.to_numpy().view(np.uint64)), c.values.to_numpy(), without=i)[:2] for i, t, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([v[j] for v in voted], pa.float64()) for j in (0, 1))], names=["toxic", "vote", "top"])

    if len(np.unique(y)) < 2 or len(y) < LEAST_LABELLED:
        return ToxicityModel(index, np.array([-3.0, 0.0, 0.0]))
    voted = examples.repartition("_id").mapInArrow(vote, "toxic int, vote double, top double").toPandas().sort_values(["toxic", "vote", "top"])
    return ToxicityModel(index, fit_logistic(np.column_stack([voted["vote"], voted["vote"] * voted["top"]]), voted["toxic"].to_numpy(float)))


_NEAR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())])
_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(_NEAR))])
_ARROW_SCORED = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))])


def scores(model: ToxicityModel):
    kept: list[WordHashes] = []

    @F.arrow_udf(_SCORED)
    def score(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(WordHashes())
        found = [model.score(t.as_py(), kept[0]) for t in texts]
        ends = np.cumsum([0, *(len(f[1]) for f in found)]).astype(np.int32)
        near = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([f[i] for f in found]) if found else [], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()))], names=["doc_id", "cosine"]
        )
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), near)], fields=list(_ARROW_SCORED))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, evidence array<struct<doc_id, cosine>>) for every row of docs.

    score is the calibrated chance of label 1, predicted is 1 from 0.5 on, evidence are the nearest labelled examples, without one of the same text. Only labels
    of ids with crc32(id as text) mod 5 other than 0 are learned from. Words that no example has don't count, in the norm
    either. Null and empty texts and texts without a word of any example have no neighbours and get the score of no votes; so
    does every text where there are no labels of both kinds, or under LEAST_LABELLED in all. Ids must be integers; of several texts with one labelled id the
    first by content is the example. Repeated rows are each scored; an empty table gives an empty result; other columns are not read.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)
    scored = bounded_batches(docs).select(F.col(id_col), (id_remainder(5, id_col) == 0).alias("held_out"), scores(model)(F.col(text_col)).alias("_s"))
    return scored.select(id_col, "held_out", "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), "_s.evidence")


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns; texts are scored in place, not shuffled.

    Null and empty texts and texts without a word of any example stay; repeated rows stay or go together; an empty table stays
    empty; without labels of both kinds, or under LEAST_LABELLED, all rows stay.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)
    return bounded_batches(docs).where(scores(model)(F.col(text_col))["score"] < 0.5)

"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents may be long, so the MinHash of a whole document says little about an item inside it. Items
are therefore partitioned by the number c of bits of their size, and for each partition a document counts as its windows of four
times the partition's least size, one starting every such size: an item then fills at least about a fifth of some window, and one
of BANDS single-value MinHash bands finds it with a chance of over 0.9999. Window minima are made from minima of small blocks,
which all partitions share. Every candidate is verified on the words of the whole document.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import NEAR, SHINGLE_WORDS, WordHashes, bounded_batches, mixed, shingle_hashes, word_list

BANDS = 48
#: Items that one pass over the documents carries; more are searched in several passes. About 0.6 KB an item besides its text.
MOST_ITEMS = 100_000
#: Sets of shingles of items that a task keeps.
MOST_SETS = 20_000
#: Shingles that are hashed at a time.
AT_ONCE = 1 << 18
_ODD = mixed(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_TOP = np.iinfo(np.uint64).max


def shingle_set(words: list[bytes]) -> set[bytes]:
    """Distinct runs of SHINGLE_WORDS words; a shorter text with words is one run."""
    k = min(SHINGLE_WORDS, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def _id_order(item_id: int | None) -> tuple[bool, int]:
    """Sort key of ids, null first."""
    return item_id is not None, item_id or 0


@dataclass
class ItemIndex:
    """Items by partition: for each band the minima in order, with the items that have them."""

    ids: list[int | None]
    texts: list[str]
    partitions: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # bits: per band (table, minima, items)
    sets: dict[int, set[bytes]]

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]]) -> ItemIndex:
        hashes, ids, texts, parts = WordHashes(), [], [], defaultdict(list)
        for item_id, text in items:
            words = word_list(text)
            if not words:
                continue
            own = shingle_hashes(hashes.array(words))
            parts[len(shingle_set(words)).bit_length() - 1].append((len(ids), np.array([(own * odd).min() for odd in _ODD])))
            ids.append(item_id)
            texts.append(text)
        found = {}
        for bits, rows in parts.items():
            number, low = np.array([i for i, _ in rows], np.int32), np.array([m for _, m in rows])
            found[bits] = []
            for b in range(BANDS):
                order = np.argsort(low[:, b], kind="stable")
                table = np.zeros(1 << 16, bool)  # by the low bits: minima have few high ones
                table[(low[:, b] & np.uint64(0xFFFF)).astype(np.int64)] = True
                found[bits].append((table, low[order, b], number[order]))
        return cls(ids, texts, found, {})

    def shingles(self, i: int) -> set[bytes]:
        """The shingles of an item, kept for MOST_SETS items."""
        if i not in self.sets:
            if len(self.sets) >= MOST_SETS:
                self.sets.clear()
            self.sets[i] = shingle_set(word_list(self.texts[i]))
        return self.sets[i]

    def candidates(self, shingles: np.ndarray, owner: np.ndarray, block: int) -> set[tuple[int, int]]:
        """(document, item) pairs from the block-aligned shingles of many documents; owner: the document of each block."""
        out: set[tuple[int, int]] = set()
        n_blocks = len(owner)
        for b in range(BANDS):
            low = (shingles * _ODD[b]).reshape(n_blocks, block).min(1)
            size = block
            lows = {size: low}  # minima of aligned runs of `size`, one for each block start
            while size < max(4 << bits for bits in self.partitions):
                step, low = size // block, lows[size]
                shifted = np.full(n_blocks, _TOP, np.uint64)
                shifted[: max(0, n_blocks - step)] = low[step:]
                size *= 2
                lows[size] = np.minimum(low, shifted)
            for bits, bands in self.partitions.items():
                window = lows[max(block, 4 << bits)][:: max(1, (1 << bits) // block)]
                table, minima, items = bands[b]
                maybe = np.flatnonzero(table[(window & np.uint64(0xFFFF)).astype(np.int64)])
                if len(maybe):
                    first, last = (np.searchsorted(minima, window[maybe], side) for side in ("left", "right"))
                    hit = first < last
                    for w, lo, hi in zip(maybe[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                        start = w * max(1, (1 << bits) // block)
                        for d in set(owner[start : start + max(1, (4 << bits) // block)].tolist()):
                            out.update((d, i) for i in items[lo:hi].tolist())
        return out

    def search(self, texts: list[str | None], hashes: WordHashes, threshold: float) -> list[list[tuple[int | None, int, float]]]:
        """For each text the (item id, shared shingles, containment) of items with at least the threshold, by item id."""
        out: list[list[tuple[int | None, int, float]]] = [[] for _ in texts]
        if not self.partitions:
            return out
        block = 1 << max(0, min(self.partitions))
        parts, owners, waiting, first = [], [], 0, 0
        words_of: dict[int, list[bytes]] = {}
        for d, text in enumerate(texts):
            words = words_of[d] = word_list(text)
            own = shingle_hashes(hashes.array(words))
            if len(own):
                fill = -len(own) % block
                parts.append(np.concatenate([own, np.repeat(own[-1:], fill)]))
                owners.append(np.full(len(parts[-1]) // block, d))
                waiting += len(parts[-1])
            if parts and (waiting >= AT_ONCE or d == len(texts) - 1):
                pairs = self.candidates(np.concatenate(parts), np.concatenate(owners), block)
                by_text = defaultdict(list)
                for k, i in pairs:
                    by_text[k].append(i)
                for k, found in by_text.items():
                    there = shingle_set(words_of[k])
                    for i in found:
                        item = self.shingles(i)
                        shared = len(item & there)
                        if shared >= threshold * len(item) - 1e-9:
                            out[k].append((self.ids[i], shared, shared / len(item)))
                    out[k].sort(key=lambda hit: (*_id_order(hit[0]), *hit[1:]))
                parts, owners, waiting = [], [], 0
                words_of.clear()
        return out


_HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("containment", T.DoubleType())])
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())]))


def _hits(spark: SparkSession, index: ItemIndex, threshold: float):
    kept: list[WordHashes] = []
    shared = spark.sparkContext.broadcast(index)  # MOST_ITEMS items at most; a worker loads it once

    @F.arrow_udf(T.ArrayType(_HIT))
    def hits(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(WordHashes())
        found = shared.value.search([t.as_py() for t in texts], kept[0], threshold)
        return pa.array([[{"item_id": i, "n_shared": n, "containment": c} for i, n, c in own] for own in found], _ARROW_HITS)

    return hits


def item_blocks(benchmark: DataFrame, id_col: str | None, text_col: str, most: int = MOST_ITEMS):
    """Indexes of the items with a text, each of about `most` items; an id with several texts is several items. Without id_col all ids are null."""
    item_id = F.lit(None) if id_col is None else F.col(id_col)
    items = benchmark.select(item_id.cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    n_blocks = max(1, -(-items.count() // most))
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect()
        yield ItemIndex.build(sorted(((r["i"], r["t"]) for r in rows), key=lambda x: (*_id_order(x[0]), x[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = NEAR, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, n_shared, containment): a row for each row of docs and item whose share of shingles in the text is at least threshold.

    Shingles are distinct runs of five lower-cased words; texts of fewer words are one shingle, so short items are found only as
    whole texts. Null and empty texts and items hold nothing. Repeated rows of docs give repeated results; items with the same id
    and different texts are each reported, those without an id with a null item_id. Empty tables give an empty result; other columns are not read.
    """
    out = None
    for index in item_blocks(benchmark, item_id_col, item_text_col):
        found = bounded_batches(docs).select(F.col(id_col), F.explode(_hits(docs.sparkSession, index, threshold)(F.col(text_col))).alias("_h")).select(id_col, "_h.*")
        out = found if out is None else out.unionByName(found)
    return out


def keep_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = NEAR, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, all columns; texts are searched in place, not shuffled. Ids of items are not read.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; an empty table of either kind is no error.
    """
    for index in item_blocks(benchmark, None, item_text_col):
        docs = bounded_batches(docs).where(F.size(_hits(docs.sparkSession, index, threshold)(F.col(text_col))) == 0)
    return docs


def oracle_sql(threshold: float = NEAR) -> str:
    """The same search in DuckDB SQL, by an equi-join on all shingles."""

    def shingles(table: str, key: str) -> str:
        return rf"""
    select distinct r, {key}, array_to_string(w[s : s + {SHINGLE_WORDS - 1}], ' ') as sh
    from (select r, {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 2}, 2))) as s
          from (select row_number() over () as r, {key}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
                from {table}) where len(w) > 0)"""

    return f"""
with d as ({shingles("documents", "doc_id")}), b as ({shingles("benchmark", "item_id")}),
n as (select r, count(*) as size from b group by r)
select d.doc_id, b.item_id, count(*)::bigint as n_shared, count(*) / any_value(n.size) as containment
from d join b on d.sh = b.sh join n on n.r = b.r
group by d.r, d.doc_id, b.r, b.item_id having count(*) >= {threshold} * any_value(n.size) - 1e-9
"""

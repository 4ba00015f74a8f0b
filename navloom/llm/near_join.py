"""N-gram Jaccard self-join by chosen paths: all documents with 0.8 of their five-word shingles in common.

Documents with equal sets of shingles are one node. A node's set is embedded as COORDINATES MinHash values: a coordinate of two sets
is equal where the shingle that a random order puts first is one they share, so a draw of coordinates samples shared tokens. In
each run the nodes walk down a tree: a tree node draws one or two coordinates (1 / threshold on average) and sends every set to
the child of its value there, so that sets as near as the threshold go on meeting while others part. A bucket of up to LEAF sets
is compared by brute force on the embedding; a larger one is split again, up to DEPTH times, and what is then left of it is
compared in pairs of blocks. Runs are repeated until a pair at the threshold is found with TARGET_RECALL. Pairs of the embedding
only link a bucket's members to one of them; the connected components of these links are then compared exactly on their
shingles, in pairs of blocks, so that no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import NEAR, WordHashes, bounded_batches, discard, materialize, mixed, shingle_hashes, small_or_shuffled, unused, word_list

COORDINATES, DEPTH, LEAF, TARGET_RECALL = 128, 4, 512, 0.998
#: Share of equal coordinates from which two sets go to the exact comparison: four standard deviations below 0.8.
CANDIDATE = 0.66
#: Sets of a block; what is larger is compared in pairs of blocks. Buckets from LARGEST sets on, which DEPTH splits have not parted,
#: are linked unseen: the exact comparison then sees all their pairs.
BLOCK, LARGEST = 512, 16_384
#: A key with more rows than this, and than the 100,000th part of all rows, is joined by a broadcast (of 100,000 keys at most).
HOT_ROWS, MOST_HOT = 256, 100_000
MOST_BROADCAST = 300_000
_ODD = mixed(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def missed(depth: int, similarity: float = NEAR) -> float:
    """Chance that a pair is in no common bucket after so many splits of one run: one child, or for a quarter of the nodes two."""
    gone = 0.0
    for _ in range(depth):
        parted = 1 - similarity * (1 - gone)
        gone = 0.75 * parted + 0.25 * parted**2
    return gone


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is found with this chance, even if its buckets are split `depth` times."""
    return math.ceil(math.log(1 - recall) / math.log(missed(depth)))


def joined_by(many: DataFrame, one: DataFrame, key: str, rows: str, most_rows: int | None = None) -> DataFrame:
    """many join one on key, where one has each key once, and in column `rows` how many rows of many have it; that column goes.

    Keys with many rows are joined by a broadcast, so that none fills a task: of keys with over the 100,000th part of all rows
    there are 100,000 at most.
    """
    least = HOT_ROWS if most_rows is None else most_rows
    total = one.agg(F.sum(rows)).first()[0] or 0
    hot = one.where(F.col(rows) > max(least, total // MOST_HOT))
    if hot.isEmpty():
        return many.join(one.drop(rows), key)
    hot = F.broadcast(hot.drop(rows))
    rest = many.join(hot.select(key), key, "left_anti").join(one.where(F.col(rows) <= max(least, total // MOST_HOT)).drop(rows), key)
    return many.join(hot, key).unionByName(rest)


def shingles_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(shingle_hashes(hashes.array(word_list(text))))


def embedding(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash under each of COORDINATES permutations, upper halves."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[start : start + 2048, None] * _ODD).min(0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SKETCH = T.StructType([T.StructField("key", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("mins", T.ArrayType(T.IntegerType()))])


def _sketches():
    kept: list[WordHashes] = []

    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(WordHashes())
        keys, sizes, mins = [], [], []
        for t in texts:
            own = shingles_of(t.as_py(), kept[0])
            keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
            sizes.append(len(own))
            mins.append(embedding(own))
        values = pa.array(np.concatenate(mins) if mins else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * COORDINATES), values)
        return pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), lists], names=["key", "size", "mins"])

    return sketch


def _child(path: Column, draw: int) -> Column:
    """The path of the child that a set goes to by the draw-th coordinate of a tree node."""
    at = F.pmod(F.xxhash64(path, F.lit(draw)), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(path, at, F.element_at("mins", at + 1))


def _children(path: Column) -> Column:
    """One child, or for a quarter of the tree nodes two: 1.25 = 1 / 0.8 on average."""
    second = F.when(F.pmod(F.xxhash64(path, F.lit(-1)), F.lit(4)) == 0, _child(path, 1))
    return F.array_compact(F.array(_child(path, 0), second))


def buckets(sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(path, key, n): the leaves of all runs with two sets or more, n the number of sets in the leaf; and the tables they are in."""
    runs = runs_for(TARGET_RECALL, DEPTH)
    roots = sets.select("key", "mins", F.explode(F.array(*(F.xxhash64(F.lit("run"), F.lit(r)) for r in range(runs)))).alias("path"))
    leaves, tables = [], []
    for depth in range(1, DEPTH + 1):
        rows = materialize(roots.select("key", F.explode(_children(F.col("path"))).alias("path")), f"children-{depth}")
        counts = materialize(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_rows", F.col("n")), f"counts-{depth}")
        level = materialize(joined_by(rows, counts, "path", "_rows").select("path", "key", "n"), f"paths-{depth}")
        discard(rows, counts)
        tables.append(level)
        large = level.where(F.col("n") > LEAF)
        if depth == DEPTH or large.isEmpty():
            leaves.append(level)
            break
        leaves.append(level.where(F.col("n") <= LEAF))
        roots = large.select("path", "key").join(sets.select("key", "mins"), "key")
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out, tables


def in_blocks(rows: DataFrame, group: str, n: str) -> DataFrame:
    """rows, each once for each comparison it is in, with task, block, lo and hi.

    A group (of n rows with a key each) of up to BLOCK rows is one comparison; a larger one is cut into blocks by a hash of the key,
    and each pair of blocks is a comparison.
    """
    blocks = F.when(F.col(n) <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col(n) * 4 / (3 * BLOCK)).cast("int"))  # blocks vary in size
    out = rows.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
    return out.withColumn("task", F.xxhash64(group, "lo", "hi")).drop("_blocks", "_other")


def by_task(rows: DataFrame) -> DataFrame:
    """rows (with task) dealt to tasks by their comparison, not by bytes: comparing takes time that grows with the square of a group."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, "task").sortWithinPartitions("task", "key")


def in_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Runs of equal values of a column of sorted batches, each as one table."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = table.column(by).to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if waiting and waiting[-1].column(by)[-1].as_py() != values[0]:
            yield pa.concat_tables(waiting)
            waiting = []
        start = 0
        for cut in cuts.tolist():
            part = table.slice(start, cut - start)
            yield pa.concat_tables([*waiting, part]) if waiting else part
            waiting, start = [], cut
        waiting.append(table.slice(start))
    if waiting:
        yield pa.concat_tables(waiting)


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected component, from a symmetric matrix of links."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (root < 0))
                root[front] = i
    return root


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each set of a bucket with the first of its component under CANDIDATE equal coordinates."""
    a, b = [], []
    for group in in_groups(batches, "task"):
        n = group.num_rows
        mins = group.column("mins").combine_chunks().flatten().to_numpy().reshape(n, COORDINATES)
        linked = np.zeros((n, n), bool)
        for i in range(n - 1):
            linked[i, i + 1 :] = (mins[i + 1 :] == mins[i]).sum(1) >= CANDIDATE * COORDINATES
        linked |= linked.T
        root = roots_of(linked)
        keys = group.column("key").to_pylist()
        for i in np.flatnonzero(root != np.arange(n)).tolist():
            a.append(keys[i])
            b.append(keys[root[i]])
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def candidate_links(sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) links whose components hold every pair that can reach the threshold, a row for each set and comparison at most; and the tables they are made of."""
    leaves, tables = buckets(sets)
    seen = in_blocks(leaves.where(F.col("n") < LARGEST).select("path", "key", "n"), "path", "n").select("task", "key")
    near = by_task(seen.join(sets.select("key", "mins"), "key")).mapInArrow(_link_buckets, "a string, b string")
    large = leaves.where(F.col("n") >= LARGEST).select("path", "key")
    first = large.groupBy("path").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("_rows"))
    unseen = joined_by(large, first, "path", "_rows").where("key <> b").select(F.col("key").alias("a"), "b")
    return near.unionByName(unseen).distinct(), tables


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads to the centre b of its component: no ray a has two centres, and no centre is a ray."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("as_ray"), F.lit(0).alias("as_centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg((F.sum("as_ray") + F.max("as_centre")).alias("n"))
    return (ends.agg(F.max("n")).first()[0] or 0) <= 1


def components(links: DataFrame, tag: str) -> DataFrame:
    """(key, root): the smallest key of every linked key's component, once for each key, by alternating large and small stars.

    Every round writes its links to the shared folder; rounds end when all links lead to the centre of a star (their number grows
    with the logarithm of the longest chain). A star's centre is found by a minimum and joined back; its rays are never collected,
    and the centres with many rays are joined by a broadcast.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-links")
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        centre = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        centre = materialize(centre, f"{tag}-centres")
        large = joined_by(both, centre, "a", "_rows").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")  # one row at most for each link
        large = materialize(large, f"{tag}-large")
        discard(centre)
        centre = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_rows")), f"{tag}-centres")
        small = joined_by(large, centre, "a", "_rows").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        changed = materialize(small.union(centre.select("a", F.col("m").alias("b"))).distinct(), f"{tag}-small")
        discard(edges, large, centre)
        edges = changed
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices in columns of shingles."""
    n, m = len(left), len(right)
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(x) for x in [*left, *right]])
    values, place, often = np.unique(every, return_inverse=True, return_counts=True)
    keep = often[place] > 1
    owner, place = owner[keep], place[keep]
    if not len(place):
        return np.zeros((n, m), np.int64)
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, m), np.float64)
    width = max(256, (1 << 23) // (n + m))
    for start in range(0, int(place[-1]) + 1, width):
        a, b = np.searchsorted(place, [start, start + width])
        ones = np.zeros((n + m, width), np.float32)
        ones[owner[a:b], place[a:b] - start] = 1
        out += ones[:n] @ ones[n:].T
    return out.astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, links, root) for the sets of each comparison; links counts documents linked to in this comparison."""
    hashes = WordHashes()
    for group in in_groups(batches, "task"):
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        own = group.column("block").to_numpy()
        keys = group.column("key").to_pylist()
        copies = group.column("copies").to_numpy()
        sets = [shingles_of(t.as_py(), hashes) for t in group.column("text")]
        sizes = np.array([len(x) for x in sets])
        n = len(sets)
        linked = np.zeros((n, n), bool)
        a = np.flatnonzero(own == lo)
        b = a if lo == hi else np.flatnonzero(own == hi)
        if len(a) and len(b):
            shared = shared_counts([sets[i] for i in a], [sets[i] for i in b])
            near = 9 * shared >= 4 * (sizes[a][:, None] + sizes[b][None, :])  # shared / union >= 0.8
            linked[np.ix_(a, b)] = near
            linked |= linked.T
        np.fill_diagonal(linked, False)
        links = linked @ copies.astype(np.int64)
        root = roots_of(linked)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(links), pa.array([keys[r] for r in root], pa.string())], names=["key", "links", "root"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, classes): (_id, _hash, key) for every row, and (key, class_id, class_hash, n_links, n_copies) for every set."""
    keyed = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    sketched = keyed.select("_id", "_hash", _sketches()(F.col("_text")).alias("_s")).select("_id", "_hash", "_s.*")
    sketched = materialize(sketched, "near-sketches")
    sets = sketched.where("key is not null").groupBy("key").agg(F.min(F.struct("_id", "_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("mins").alias("mins"))
    sets = materialize(sets, "near-sets")
    rows = materialize(sketched.select("_id", "_hash", "key"), "near-rows")  # without the embedding, which is most of the table
    discard(sketched)
    links, tables = candidate_links(sets)
    parts = components(links, "near-candidates")
    discard(*tables)
    sizes = materialize(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("_rows", F.col("n")), "near-sizes")
    members = joined_by(parts, sizes, "root", "_rows").join(sets.select("key", "rep", "copies"), "key")
    members = materialize(members.select("key", "root", "n", "copies", F.col("rep._id").alias("_i"), F.col("rep._hash").alias("_h")), "near-members")
    discard(sizes)
    texts = keyed.join(small_or_shuffled(members, MOST_BROADCAST), (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i")))
    texts = texts.groupBy("key", "root", "n", "copies").agg(F.min("_text").alias("text"))  # rows with equal ids and texts are one
    tasks = in_blocks(texts, "root", "n").select("task", "key", "copies", "block", "lo", "hi", "text")
    compared = by_task(tasks).mapInArrow(_compare, "key string, links bigint, root string")
    compared = materialize(compared, "near-compared")
    links = compared.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("one"), F.max("root").alias("other"))
    if members.where(F.col("n") > BLOCK).isEmpty():
        classes = links.select("key", "links", F.col("one").alias("root"))
    else:
        joined = components(compared.select(F.col("key").alias("a"), F.col("root").alias("b")), "near-classes").distinct()
        classes = links.select("key", "links").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    info = sets.select("key", "rep", "copies").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    info = materialize(info.select("key", "rep", "copies", "root", F.coalesce("links", F.lit(0)).alias("links")), "near-info")
    discard(sets, members, compared)
    first = materialize(info.groupBy("root").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("_rows")), "near-first")
    result = joined_by(info, first, "root", "_rows").select(
        "key", F.col("first._id").alias("class_id"), F.col("first._hash").alias("class_hash"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")
    )
    result = materialize(result, "near-classes-of-sets")
    discard(info, first)
    return rows, result


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_copies) for every row of docs.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; texts of one to four words
    have one shingle. n_links counts the other rows a row is linked to, n_copies the rows with its set of shingles. class_id is
    the smallest id of the row's connected component. Texts without words (null, empty) are linked to nothing and their own class.
    Ties go to the smallest id, null ids first. An empty table gives an empty result; other columns are not read.
    """
    rows, info = near_classes(docs, id_col, text_col)
    found = joined_by(rows.where("key is not null"), info.withColumn("_rows", F.col("n_copies")), "key", "_rows")
    found = found.select("_id", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"))
    alone = rows.where("key is null").select("_id", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(alone).withColumnRenamed("_id", id_col)


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that come first (by id, then hash of the text) in their class, all columns; texts without words all stay.

    Rows with equal ids and texts are one document and stay or go together. An empty table stays empty; columns may have any names.
    """
    rows, info = near_classes(docs, id_col, text_col)
    first = F.col("_id").eqNullSafe(F.col("class_id")) & (F.col("_hash") == F.col("class_hash"))
    found = joined_by(rows.where("key is not null"), info.withColumn("_rows", F.col("n_copies")), "key", "_rows")
    gone_id, gone_hash = unused("_gone_id", docs), unused("_gone_hash", docs)
    gone = materialize(found.where(~first).select(F.col("_id").alias(gone_id), F.col("_hash").alias(gone_hash)).distinct(), "near-gone")
    gone = small_or_shuffled(gone, 1_000_000)
    return docs.join(gone, (F.xxhash64(docs[text_col]) == F.col(gone_hash)) & docs[id_col].eqNullSafe(F.col(gone_id)), "left_anti")


def oracle_sql() -> str:
    """The same join in DuckDB SQL: an equi-join on all shingles of distinct sets, and a recursive query for the classes."""
    return r"""
with recursive w as (
    select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from documents),
s as (select r, doc_id, case when len(w) = 0 then null else list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(len(w) - 3, 2))])) end as sh from w),
k as (select sh, min(doc_id) as rep, count(*) as copies, len(sh) as n, row_number() over (order by min(doc_id)) as k from s where sh is not null group by sh),
e as (select k, n, copies, unnest(sh) as x from k),
p as (select a.k as a, b.k as b, any_value(b.copies) as copies from e a join e b on a.x = b.x and a.k <> b.k
      group by a.k, b.k having 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
c(a, b) as (select k, k from k union select c.a, p.b from c join p on c.b = p.a),
m as (select c.a as k, min(k.rep) as class_id from c join k on k.k = c.b group by c.a),
l as (select a as k, sum(copies) as links from p group by a)
select s.doc_id, coalesce(m.class_id, s.doc_id) as class_id, (case when k.k is null then 0 else coalesce(l.links, 0) + k.copies - 1 end)::bigint as n_links, coalesce(k.copies, 1)::bigint as n_copies
from s left join k on k.sh = s.sh left join m on m.k = k.k left join l on l.k = k.k
"""

"""Near copies by an LSH forest over MinHash signatures of two-word shingles.

Documents with equal sets of shingles are one set. A set's signature is COORDINATES MinHash values; every order of the forest reads
DEPTHS[-1] of them one after the other, so sets that are near stand near each other in some sorted order, and the longest common
prefix with a neighbour is a sign of similarity. A region is a run of an order with a common prefix. How long the prefix must be
depends on the region: DEPTHS[0] values do where few sets share them, and a region of over REGION sets is cut by more of them; its
sets then go through EXTRA more orders, because long prefixes part more pairs.

Copies of a family are first tied to one set: those that share the whole prefix of one of three orders are compared with the region's first
set, exactly and as a stream. Regions whose sets are all tied together need no more. In the others, sets that are not tied yet
are compared on their signatures, and what is near enough there is compared exactly on the shingles, in pairs of blocks, only
between sets that are not tied yet; no pair is ever a row. In both comparisons the sets of the largest family go to the blocks of all
others, but not to each other's.
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

from navloom.llm.common import WordHashes, bounded_batches, discard, materialize, shingle_hashes, small_or_shuffled
from navloom.llm.near_join import CANDIDATE, COORDINATES, MOST_BROADCAST, components, embedding, in_groups, joined_by, roots_of, shared_counts

SHINGLE_WORDS = 2
#: Prefixes of a region; orders that all sets go through (the coordinates in turn) and more for the sets of large regions.
DEPTHS, ORDERS, EXTRA, TIES = (4, 6, 8), 16, 32, 3
#: Largest region that is compared at once; larger ones are cut by a longer prefix, at last in pairs of blocks.
REGION = 1024
#: Rows and shingles of a block on average; sets that are compared with one other in a stream.
BLOCK, BLOCK_SHINGLES, STREAM = 384, 400_000, 256
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def order(i: int) -> list[int]:
    """Coordinates of the i-th order: the first ORDERS take them in turn, the others are drawn."""
    if i < ORDERS:
        return [(i * DEPTHS[-1] + k) % COORDINATES for k in range(DEPTHS[-1])]
    return np.random.default_rng(i).permutation(COORDINATES)[: DEPTHS[-1]].tolist()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingles_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the two-word shingles (a single word is one)."""
    return np.unique(shingle_hashes(hashes.array(words_of(text)), SHINGLE_WORDS))


_SKETCH = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("mins", T.ArrayType(T.IntegerType()))])


def _sketches():
    kept: list[WordHashes] = []

    @F.arrow_udf(_SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(WordHashes())
        keys, sizes, mins = [], [], []
        for t in texts:
            own = shingles_of(t.as_py(), kept[0])
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sizes.append(len(own))
            mins.append(embedding(own))
        values = pa.array(np.concatenate(mins) if mins else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1, dtype=np.int32) * COORDINATES), values)
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["key", "size", "mins"])

    return sketch


def _prefix(i: int, depth: int) -> Column:
    """A hash of the first values of the i-th order; different orders have different ones."""
    return F.xxhash64(F.lit(i), *(F.element_at("mins", c + 1) for c in order(i)[:depth]))


def _prefixes(sets: DataFrame, orders: range, depth: int, *columns: str) -> DataFrame:
    return sets.select(*columns, F.explode(F.array(*(_prefix(i, depth) for i in orders))).alias("path"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): sets of a stream that are near to its first, b. The rows of a task are sorted, the set to compare with is the first."""
    hashes, task, hub, key = WordHashes(), None, None, None
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            own = shingles_of(row["text"], hashes)
            if row["task"] != task:
                task, hub, key = row["task"], own, row["key"]
                continue
            both = len(np.intersect1d(hub, own, assume_unique=True))
            if 100 * both >= 80 * (len(hub) + len(own) - both):
                a.append(row["key"])
                b.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _link_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): labels of a region that hold sets with CANDIDATE equal coordinates, each with the first of its component."""
    found: set[tuple[bytes, bytes]] = set()
    for group in in_groups(batches, "task"):
        n = group.num_rows
        mins = group.column("mins").combine_chunks().flatten().to_numpy().reshape(n, COORDINATES)
        labels = group.column("label").to_pylist()
        names, own = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
        if len(names) < 2:
            continue
        linked = np.zeros((len(names), len(names)), bool)
        for i in range(n - 1):
            rest = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
            near = rest[(mins[rest] == mins[i]).sum(1) >= CANDIDATE * COORDINATES]
            linked[own[i], own[near]] = linked[own[near], own[i]] = True
        root = roots_of(linked)
        found.update((bytes.fromhex(names[i]), bytes.fromhex(names[root[i]])) for i in np.flatnonzero(root != np.arange(len(names))).tolist())
        if len(found) > 50_000:
            yield _pairs(found)
            found = set()
    yield _pairs(found)


def _pairs(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    rows = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): labels with a near pair between two blocks (or within one), each with the first of its component."""
    hashes = WordHashes()
    for group in in_groups(batches, "task"):
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        block = group.column("block").to_numpy()
        names, own = np.unique(np.array([x.hex() for x in group.column("label").to_pylist()]), return_inverse=True)
        a = np.flatnonzero(block == lo)
        b = a if lo == hi else np.flatnonzero(block == hi)
        if len(names) < 2 or not len(a) or not len(b):
            continue
        sets = [shingles_of(t.as_py(), hashes) for t in group.column("text")]
        sizes = np.array([len(x) for x in sets])
        shared = shared_counts([sets[i] for i in a], [sets[i] for i in b])
        i, j = np.nonzero(100 * shared >= 80 * (sizes[a][:, None] + sizes[b][None, :] - shared))
        linked = np.zeros((len(names), len(names)), bool)
        linked[own[a[i]], own[b[j]]] = linked[own[b[j]], own[a[i]]] = True
        np.fill_diagonal(linked, False)
        root = roots_of(linked)
        yield _pairs({(bytes.fromhex(names[k]), bytes.fromhex(names[root[k]])) for k in np.flatnonzero(root != np.arange(len(names))).tolist()})


def _by_task(rows: DataFrame, *then: str) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return bounded_batches(rows).repartition(n, "task").sortWithinPartitions("task", *then)


def _with_texts(rows: DataFrame, sets: DataFrame, keyed: DataFrame, *columns: str) -> DataFrame:
    """rows (a key each, which may repeat) with the text of a document that has the set."""
    wanted = materialize(rows.select("key").distinct().join(sets.select("key", F.col("rep._id").alias("_i"), F.col("rep._hash").alias("_h")), "key"), "forest-wanted")
    texts = keyed.join(small_or_shuffled(wanted, MOST_BROADCAST), (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i")))
    texts = texts.groupBy("key").agg(F.min("_text").alias("text"))  # rows with equal ids and texts are one
    return rows.join(texts, "key").select("key", *columns, "text")


def tied(sets: DataFrame, keyed: DataFrame) -> DataFrame:
    """(key, root): families of sets, tied by exact comparison with the first set of a region with the longest prefix."""
    rows = materialize(_prefixes(sets, range(TIES), DEPTHS[-1], "key"), "forest-ties")
    first = rows.groupBy("path").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    first = materialize(first, "forest-hubs")
    links = joined_by(rows, first, "path", "_rows").where("key <> hub").select("key", "hub").distinct()
    links = materialize(links, "forest-tie-links")
    many = materialize(links.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("_rows", F.col("n")), "forest-hub-sizes")
    streams = F.ceil(F.col("n") / STREAM).cast("int")
    members = joined_by(links, many, "hub", "_rows").select("key", F.xxhash64("hub", F.pmod(F.xxhash64("key"), streams)).alias("task"), F.lit(1).alias("place"))
    hubs = many.select(F.col("hub").alias("key"), F.explode(F.sequence(F.lit(0), streams - 1)).alias("_s")).select("key", F.xxhash64("key", F.col("_s").cast("long")).alias("task"), F.lit(0).alias("place"))
    members = materialize(members.unionByName(hubs), "forest-streams")
    compared = _by_task(_with_texts(members, sets, keyed, "task", "place"), "place", "key").mapInArrow(_verify, "a binary, b binary")
    found = components(compared, "forest-families")
    discard(rows, first, links, many, members)
    return found


def regions(sets: DataFrame) -> DataFrame:
    """(path, key, label, n, main): regions of the forest that hold sets with different labels, and the label of theirs that most sets have.

    sets has key, label, family (the number of sets with the label) and mins.
    """

    def level(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_least"), F.max("label").alias("_most"), F.max(F.struct("family", "label")).alias("_main")).where("_least <> _most")
        counts = materialize(counts.select("path", "n", F.col("_main.label").alias("main"), F.col("n").alias("_rows")), f"forest-{name}-counts")
        return materialize(joined_by(rows, counts, "path", "_rows").select("path", "key", "label", "n", "main"), f"forest-{name}")

    found, inner, dense = [], sets, None
    for depth in DEPTHS:
        paths = materialize(_prefixes(inner, range(ORDERS), depth, "key", "label", "family"), f"forest-paths-{depth}")
        here = level(paths, f"depth-{depth}")
        discard(paths)
        large = here.where(F.col("n") > REGION)
        if depth == DEPTHS[-1] or large.isEmpty():
            found.append(here)
            break
        found.append(here.where(F.col("n") <= REGION))
        inner = materialize(large.select("key").distinct().join(sets, "key"), f"forest-inner-{depth}")
        dense = inner if dense is None else dense
    if dense is not None:
        paths = materialize(_prefixes(dense, range(ORDERS, ORDERS + EXTRA), DEPTHS[-1], "key", "label", "family"), "forest-paths-extra")
        found.append(level(paths, "extra"))
        discard(paths)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def in_blocks(rows: DataFrame, group: str, blocks: Column, main: Column, main_blocks: Column) -> DataFrame:
    """rows, each once for each comparison it is in, with task, block, lo and hi.

    Rows where main holds are tied together already: their blocks are compared with all others but not with each other.
    """
    own = F.when(main, F.col("_b") + F.pmod(F.xxhash64("key"), F.col("_m"))).otherwise(F.pmod(F.xxhash64("key"), F.col("_b"))).cast("int")
    out = rows.withColumn("_b", blocks).withColumn("_m", main_blocks).withColumn("block", own)
    last = F.when(main, F.col("_b")).otherwise(F.col("_b") + F.col("_m")) - 1
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    out = out.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
    return out.withColumn("task", F.xxhash64(group, "lo", "hi")).drop("_b", "_m", "_other")


def region_tasks(found: DataFrame) -> DataFrame:
    """(task, key, label): a region of up to REGION sets is one comparison.

    A larger one is cut into blocks by the keys: those of its main label are compared with the blocks of all others, which
    are few where a family is tied, and not with each other. So a row of the main label occurs once for each block of others.
    """
    whole = found.where(F.col("n") <= REGION).select(F.xxhash64("path").alias("task"), "key", "label")
    large = found.where(F.col("n") > REGION)
    if large.isEmpty():
        return whole
    sizes = large.groupBy("path").agg(F.count_if(F.col("label") == F.col("main")).alias("n_main"), F.count(F.lit(1)).alias("_rows"))
    large = joined_by(large, materialize(sizes, "forest-region-sizes"), "path", "_rows")
    count = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    cut = in_blocks(large, "path", count(F.col("n") - F.col("n_main")), F.col("label") == F.col("main"), count(F.col("n_main")))
    return whole.unionByName(cut.select("task", "key", "label"))


def linked_labels(sets: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """(a, b): labels with near sets, from the regions of the forest; None if there is no candidate."""
    seen = region_tasks(regions(sets))
    near = _by_task(seen.join(sets.select("key", "mins"), "key"), "key").mapInArrow(_link_regions, "a binary, b binary")
    groups = components(near, "forest-candidates")  # label and root
    if groups.isEmpty():
        return None
    groups = groups.select(F.col("key").alias("label"), F.col("root").alias("group"))
    sizes = sets.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_s"))
    known = materialize(groups.join(sizes, "label"), "forest-groups")
    main = known.groupBy("group").agg(F.max(F.struct("_rows", "label", "_s")).alias("_main"), F.sum("_rows").alias("_n"), F.sum("_s").alias("_all"), F.count(F.lit(1)).alias("_rows_in"))
    main = main.select("group", F.col("_main.label").alias("main"), F.col("_main._rows").alias("n_main"), F.col("_main._s").alias("s_main"), "_n", "_all", "_rows_in")
    known = materialize(joined_by(known, materialize(main, "forest-mains"), "group", "_rows_in"), "forest-known")
    members = joined_by(sets.select("key", "label", "size"), known, "label", "_rows")
    count = lambda n, s: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_SHINGLES))).cast("int")
    others = F.greatest(count(F.col("_n") - F.col("n_main"), F.col("_all") - F.col("s_main")), F.lit(1))
    tasks = in_blocks(members, "group", others, F.col("label") == F.col("main"), F.greatest(count(F.col("n_main"), F.col("s_main")), F.lit(1)))
    tasks = materialize(tasks.select("key", "label", "task", "block", "lo", "hi"), "forest-tasks")
    compared = _by_task(_with_texts(tasks, sets, keyed, "label", "task", "block", "lo", "hi"), "key").mapInArrow(_compare, "a binary, b binary")
    return compared


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if the Jaccard similarity of their sets of two-word shingles is 0.8 or more (a text of one word has that
    one shingle); component_id is the smallest id that links reach (null ids only where there is no other), kept holds where it is
    the row's own. Texts without words (null, empty) have no shingle, are linked to nothing and kept. Repeated rows are linked
    and, as they share an id, kept together. An empty table gives an empty result; other columns are not read.
    """
    keyed = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    sketched = materialize(keyed.select("_id", "_hash", _sketches()(F.col("_text")).alias("_s")).select("_id", "_hash", "_s.*"), "forest-sketches")
    found = sketched.where("key is not null").groupBy("key").agg(
        F.min(F.struct("_id", "_hash")).alias("rep"), F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("mins").alias("mins")
    )
    sets = materialize(found, "forest-sets")
    rows = materialize(sketched.select("_id", "key", "size"), "forest-rows")
    discard(sketched)
    families = materialize(tied(sets, keyed), "forest-labels")
    sizes = materialize(families.groupBy(F.col("root").alias("label")).agg(F.count(F.lit(1)).alias("family")).withColumn("_rows", F.col("family")), "forest-family-sizes")
    families = joined_by(families.withColumnRenamed("root", "label"), sizes, "label", "_rows")
    labelled = sets.join(families, "key", "left").withColumn("label", F.coalesce("label", "key")).withColumn("family", F.coalesce("family", F.lit(1)))
    labelled = materialize(labelled, "forest-labelled")
    discard(sets)
    links = linked_labels(labelled, keyed)
    info = labelled.select("key", "label", "least", "copies")
    if links is not None:
        joined = components(links, "forest-joined")
        info = info.join(joined.select(F.col("key").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    info = materialize(info, "forest-info")
    first = materialize(info.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_rows")), "forest-first")
    result = materialize(joined_by(info, first, "label", "_rows").select("key", "component_id", F.col("copies").alias("_rows")), "forest-result")
    found = joined_by(rows.where("key is not null"), result, "key", "_rows").select("_id", "size", "component_id")
    alone = rows.where("key is null").select("_id", "size", F.col("_id").alias("component_id"))
    out = found.unionByName(alone).withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", "kept")


def missed(similarity: float = 0.8, dense: bool = False) -> float:
    """Chance that no order brings a pair of this similarity into a common region; dense: if its regions are all cut to the end."""
    depth, orders = (DEPTHS[-1], ORDERS + EXTRA) if dense else (DEPTHS[0], ORDERS)
    return math.pow(1 - similarity**depth, orders)


def oracle_sql() -> str:
    """The same components in DuckDB SQL: a join on the rarest shingles of distinct sets (prefix filter), and a recursive query."""
    return r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents),
s as materialized (select *, md5(array_to_string(sh, chr(10))) as h from (select doc_id, case when len(w) = 0 then null else list_sort(list_distinct([array_to_string(w[i : i + 1], ' ') for i in range(1, greatest(len(w), 2))])) end as sh from w)),
k as materialized (select h, any_value(sh) as sh, min(doc_id) as least, len(any_value(sh)) as n, row_number() over (order by min(doc_id), h) as k from s where sh is not null group by h),
e as (select k, n, unnest(sh) as x from k),
f as (select x, count(*) as f from e group by x having count(*) > 1),
g as (select e.k, e.n, e.x, e.n - count(*) over (partition by e.k) + row_number() over (partition by e.k order by f.f, e.x) as i from e join f on e.x = f.x),
q as (select k, n, x from g where i <= n - (80 * n + 99) // 100 + 1),
t as (select distinct a.k as a, b.k as b from q a join q b on a.x = b.x and a.k < b.k and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
o as (select a, b from (select t.a, t.b, len(list_intersect(x.sh, y.sh)) as i, x.n + y.n as n from t join k x on x.k = t.a join k y on y.k = t.b) where 180 * i >= 80 * n),
p as (select a, b from o union all select b, a from o),
c(a, b) as (select k, k from k union select c.a, p.b from c join p on c.b = p.a),
m as (select c.a as k, min(k.least) as component_id from c join k on k.k = c.b group by c.a)
select s.doc_id, coalesce(len(s.sh), 0)::bigint as n_shingles, coalesce(m.component_id, s.doc_id) as component_id, s.doc_id = coalesce(m.component_id, s.doc_id) as kept
from s left join k on k.h = s.h left join m on m.k = k.k
"""

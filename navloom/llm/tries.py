"""Prefix trie of conversations: padded matrices of turn ids, sorted by numpy, reduced depth by depth.

Spark sorts all turn sequences by range (sequence, then conversation id), so that a task holds a range of neighbouring paths,
however common a path is. In a task, blocks of neighbouring rows become one padded matrix of turn ids. lexsort orders it; comparing
each row with the one before gives a mask of changed columns, which OR-accumulated along the row marks the columns at which a
new node starts; reduceat then adds up every depth. Nodes that lie on the edge of a block are partial there: they go on as sums by
node and are recombined by Spark. Two shards that part in the middle of a path count its nodes as started twice; what that is too
much is known from the last row of one and the first row of the next, and is taken off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.llm.common import bounded_batches, materialize

#: Cells of a padded matrix, but for a single row that is longer.
MOST_CELLS = 1 << 19
_PAD = np.iinfo(np.int64).min
_NOBODY = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<a, b, n>>): the turns of each conversation in order; a and b are a 128-bit hash of role and text, n the text's UTF-8 bytes.

    Turns are ordered by turn_col, null first; ties by their hash, so the order of rows does not matter. A null role or text is empty.
    Repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. Other columns are not
    read. Texts stay where they are: only 24 bytes a turn are shuffled. A conversation is one array, which must fit into a task.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).isNotNull().alias("known"),
            F.col(turn_col).alias("at"),
            F.xxhash64(F.lit(1), F.octet_length(role), role, text).alias("a"),
            F.xxhash64(F.lit(2), text, F.octet_length(role), role).alias("b"),
            F.octet_length(text).cast("long").alias("n"),
        ).alias("t"),
    )
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def with_common_heads(sequences: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """sequences, rebuilt: the first h turns come from conversation c - c % family, the rest from c after its own first h; h = crc32(c in decimals) % heads."""
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(heads)).cast("int")
    own = sequences.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family)
    base = sequences.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    joined = own.join(base, "_base", "left").withColumn("_h", h)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


_FIELDS = [
    ("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("depth", pa.int64()), ("key", pa.string()), ("parent", pa.string()), ("a", pa.int64()), ("b", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("ends", pa.binary()), ("first_ids", pa.list_(pa.int64())), ("last_ids", pa.list_(pa.int64())), ("last_bytes", pa.list_(pa.int64())),
]
_SCHEMA = pa.schema(_FIELDS)
_SQL = (
    "kind string, shard int, block long, depth long, key string, parent string, a long, b long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ends binary, first_ids array<bigint>, last_ids array<bigint>, last_bytes array<bigint>"
)


class _Rows:
    """Rows to be yielded as record batches; columns that are not given are null."""

    def __init__(self):
        self.columns: dict[str, list] = {name: [] for name, _ in _FIELDS}
        self.n = 0

    def add(self, n: int, **given) -> None:
        for name, column in self.columns.items():
            value = given.get(name)
            column.extend(value if isinstance(value, list) and not name.endswith(("_ids", "_bytes")) else [value] * n)
        self.n += n

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.columns[name], kind) for name, kind in _FIELDS], schema=_SCHEMA)
        self.__init__()
        return out


def prefix_keys(ids: np.ndarray, depth: int) -> list[str]:
    """Keys of the nodes on a path, from the root to a depth."""
    h = xxhash.xxh3_128()
    keys, data = [h.hexdigest()], ids.astype("<i8").tobytes()
    for d in range(depth):
        h.update(data[16 * d : 16 * d + 16])
        keys.append(h.hexdigest())
    return keys


def common_turns(x: np.ndarray, y: np.ndarray) -> int:
    """Turns that two paths (two ids for each turn) share from the start."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0] if len(other) else n) // 2


def _reduce(out: _Rows, shard: int, block: int, conv, length, ids, size, before, after) -> tuple[np.ndarray, np.ndarray]:
    """Adds the nodes of a block to out. before: the row above (ids) or None; after: the row below or None. Returns the last row."""
    n, deep = len(conv), int(length.max(initial=0))
    mask = np.arange(deep) < length[:, None]
    path = np.full((n, deep, 2), _PAD)
    path[mask] = ids.reshape(-1, 2)
    weight = np.zeros((n, deep), np.int64)
    weight[mask] = size
    order = np.lexsort((conv, *(path[:, j, k] for j in range(deep - 1, -1, -1) for k in (1, 0))))
    conv, length, path, weight, mask = conv[order], length[order], path[order], weight[order], mask[order]
    changed = np.ones((n, deep), bool)
    changed[1:] = (path[1:] != path[:-1]).any(2) | ~mask[1:] | ~mask[:-1]
    if before is not None:
        same = common_turns(before, path[0, : length[0]].ravel())
        changed[0, :same] = False
    changed = np.logical_or.accumulate(changed, axis=1)
    starts = changed & mask
    shared = (~changed).sum(1)  # turns shared with the row above
    first_row, last_row = path[0, : length[0]].ravel(), path[-1, : length[-1]].ravel()
    below = np.append(shared[1:], -1 if after is None else common_turns(last_row, after))
    leaf = (below < length).astype(np.int64)
    saved = np.cumsum((weight * ~starts)[:, ::-1], axis=1)[:, ::-1]
    left = int(length[0]) if before is None else int(shared[0])
    right = int(length[-1]) if after is None else int(below[-1])
    first_keys, last_keys = prefix_keys(first_row, left), prefix_keys(last_row, right)
    written = [b"%d" % c for c in conv.tolist()]
    # the root
    total = int(saved[:, 0].sum()) if deep else 0
    ended = int((length == 0).sum())
    out.add(1, kind="part", shard=shard, block=block, depth=0, key=first_keys[0], conv_id=int(conv.min()), n_convs=n, n_children=int(starts[:, 0].sum()) if deep else 0, n_leaves=int(leaf.sum()), saved_tokens=total)
    if ended:
        out.add(1, kind="ends", shard=shard, block=block, key=first_keys[0], ends=b",".join(written[:ended]))
    up_at, up_conv = np.zeros(1, np.int64), np.array([conv.min()])
    up_keys = {0: first_keys[0]}  # of the nodes above that are partial
    for j in range(deep):
        here, d = mask[:, j], j + 1
        at = np.flatnonzero(starts[:, j])
        if here[0] and not starts[0, j]:
            at = np.append(0, at)
        if not len(at):
            break
        add = lambda x: np.add.reduceat(np.where(here, x, 0), at)
        members, least = add(1), np.minimum.reduceat(np.where(here, conv, np.iinfo(np.int64).max), at)
        children = add(starts[:, j + 1]) if d < deep else np.zeros(len(at), np.int64)
        leaves, kept, ended = add(leaf), add(saved[:, j]), add(length == d)
        part = np.zeros(len(at), bool)
        part[0] |= bool(here[0]) and d <= left
        on_last = bool(here[-1]) and d <= right
        part[-1] |= on_last
        up = np.searchsorted(up_at, at, "right") - 1
        whole = np.flatnonzero(~part)
        if len(whole):
            hashes = [hashlib.sha256(b",".join(written[s : s + e])).hexdigest() if e else _NOBODY for s, e in zip(at[whole].tolist(), ended[whole].tolist(), strict=True)]
            keys_up = [up_keys.get(i) for i in up[whole].tolist()]
            out.add(
                len(whole), kind="node", shard=shard, block=block, depth=d, parent=keys_up, a=path[at[whole], j, 0].tolist(), b=path[at[whole], j, 1].tolist(), conv_id=least[whole].tolist(),
                parent_conv_id=up_conv[up[whole]].tolist(), n_convs=members[whole].tolist(), n_children=children[whole].tolist(), n_leaves=leaves[whole].tolist(), saved_tokens=kept[whole].tolist(), ends_sha256=hashes,
            )
        up_keys = {}
        for i in np.flatnonzero(part).tolist():
            keys = first_keys if i == 0 and here[0] and d <= left else last_keys
            out.add(
                1, kind="part", shard=shard, block=block, depth=d, key=keys[d], parent=keys[j], a=int(path[at[i], j, 0]), b=int(path[at[i], j, 1]), conv_id=int(least[i]),
                n_convs=int(members[i]), n_children=int(children[i]), n_leaves=int(leaves[i]), saved_tokens=int(kept[i]),
            )
            if ended[i]:
                out.add(1, kind="ends", shard=shard, block=block, key=keys[d], ends=b",".join(written[at[i] : at[i] + int(ended[i])]))
            up_keys[i] = keys[d]
        up_at, up_conv = at, least
    return last_row, weight[-1, : length[-1]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, length, ids, bytes) of neighbouring rows, MOST_CELLS cells at most."""
    held, deep, rows = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        size, ids = batch.column("bytes"), batch.column("ids")
        length = np.diff(size.offsets.to_numpy())
        at = np.append(0, np.cumsum(length))
        flat, words = size.flatten().to_numpy(), ids.flatten().to_numpy()
        start = 0
        for i, own in enumerate(length.tolist()):
            if rows and (rows + 1) * max(deep, own) > MOST_CELLS:
                held.append((conv[start:i], length[start:i], words[2 * at[start] : 2 * at[i]], flat[at[start] : at[i]]))
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, deep, rows, start = [], 0, 0, i
            deep, rows = max(deep, own), rows + 1
        held.append((conv[start:], length[start:], words[2 * at[start] :], flat[at[start] :]))
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, out = TaskContext.get().partitionId(), _Rows()
    first = last = waiting = None
    sizes, number = np.zeros(0, np.int64), 0
    for block in _blocks(batches):
        if waiting is not None:
            last, sizes = _reduce(out, shard, number, *waiting, last, block[2][: 2 * block[1][0]])
            number += 1
            yield out.batch()
        else:
            first = block[2][: 2 * block[1][0]]
        waiting = block
    if waiting is not None:
        last, sizes = _reduce(out, shard, number, *waiting, last, None)
        out.add(1, kind="edge", shard=shard, first_ids=first.tolist(), last_ids=last.tolist(), last_bytes=sizes.tolist())
        yield out.batch()


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring shards count too much: the nodes that the last row of one shares with the first row of the next."""
    out = _Rows()
    for batch in batches:
        for row in batch.to_pylist():
            last, after, size = np.array(row["last_ids"], np.int64), np.array(row["first_ids"], np.int64), row["last_bytes"]
            same = common_turns(last, after)
            keys = prefix_keys(last, same)
            twice = np.append(np.cumsum(np.array(size[:same], np.int64)[::-1])[::-1], 0).tolist()  # bytes of the nodes from each depth on, less 1
            for d in range(same + 1):
                out.add(
                    1, kind="part", shard=row["shard"], block=-1, depth=d, key=keys[d], parent=keys[d - 1] if d else None, a=int(last[2 * d - 2]) if d else None, b=int(last[2 * d - 1]) if d else None,
                    n_convs=0, n_children=-int(d < same), n_leaves=-int(len(size) == same), saved_tokens=twice[max(d - 1, 0)],
                )
            if out.n > 10_000:
                yield out.batch()
    yield out.batch()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from the chunks of ids of each node, in order; a node's ids are a stream, never held together."""
    now, h = None, None
    keys, found = [], []
    for batch in batches:
        for key, chunk in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key == now:
                h.update(b",")
            else:
                if now is not None:
                    keys.append(now)
                    found.append(h.hexdigest())
                now, h = key, hashlib.sha256()
            h.update(chunk)
    if now is not None:
        keys.append(now)
        found.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each node of the trie of sequences (conv_id, turns as of turn_sequences; each conv_id once).

    A node is a distinct sequence of the first depth turns of a conversation; its members start with it. conv_id is the smallest
    member, parent_conv_id that of the parent (root: null), n_convs counts the members, n_children the children, n_leaves the childless
    nodes of the subtree, saved_tokens adds up (n_convs - 1) times the bytes of the last text over the subtree, ends_sha256 is the
    digest of the ids of the members that end here (ascending, comma-joined), a and b hash the last turn (see turn_texts). The root
    has depth 0 and holds turnless conversations too. An empty table has no node. Equal conversations are told apart by their ids
    in the sort, so any number of them is dealt over many tasks. A digest is a sequential function: the ids that end in one node
    are hashed by one task, as a stream of chunks.
    """
    flat = sequences.select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("ids"), F.transform("turns", lambda t: t["n"]).alias("bytes")
    )
    flat = bounded_batches(materialize(flat, "trie-rows"))
    found = materialize(flat.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(_shard, _SQL), "trie-parts")
    edges = found.where("kind = 'edge'")
    following = edges.select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("_next"))  # a row for each task
    pairs = edges.select("shard", "last_ids", "last_bytes").join(following, "shard").join(edges.select(F.col("shard").alias("_next"), "first_ids"), "_next")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    names = ["shard", "depth", "key", "parent", "a", "b", "conv_id", *sums]
    parts = found.where("kind = 'part'").select(names).unionByName(pairs.mapInArrow(_seams, _SQL).select(names))
    own = [F.min(c).alias(c) for c in ("shard", "depth", "parent", "a", "b", "conv_id")]
    nodes = materialize(parts.groupBy("key").agg(*own, *(F.sum(c).alias(c) for c in sums)), "trie-recombined")
    # the least member of a partial node, for each shard in which the node has children: no key is as common as the root
    above = found.where("kind = 'part'").select("shard", "key").distinct().join(nodes.select("key", F.col("conv_id").alias("_up")), "key")
    above = above.select("shard", F.col("key").alias("parent"), "_up")
    ends = found.where("kind = 'ends'").select("key", "shard", "block", "ends").repartition("key").sortWithinPartitions("key", "shard", "block")
    ends = ends.mapInArrow(_hash_ends, "key string, ends_sha256 string")
    result = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256", "a", "b"]
    edge_nodes = nodes.join(above, ["shard", "parent"], "left").withColumn("parent_conv_id", F.col("_up")).join(ends, "key", "left")
    edge_nodes = edge_nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY))).select(result)
    inner = found.where("kind = 'node'")
    known = inner.where("parent is null").select(result)
    rest = inner.where("parent is not null").join(above, ["shard", "parent"]).withColumn("parent_conv_id", F.col("_up")).select(result)
    return known.unionByName(rest).unionByName(edge_nodes)


def turn_texts(nodes: DataFrame, conversations: DataFrame, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """nodes of prefix_trie with role and text of their last turn (the root has neither)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    texts = conversations.where(F.col(id_col).isNotNull()).select(
        F.xxhash64(F.lit(1), F.octet_length(role), role, text).alias("a"), F.xxhash64(F.lit(2), text, F.octet_length(role), role).alias("b"), role.alias("role"), text.alias("text")
    )
    return nodes.join(texts.dropDuplicates(["a", "b"]), ["a", "b"], "left")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: see turn_sequences, with_common_heads and prefix_trie."""
    return prefix_trie(with_common_heads(turn_sequences(conversations))).drop("a", "b")


def oracle_sql() -> str:
    """The same nodes in DuckDB SQL, from all prefixes as lists of texts (ties of turn are ordered by role and text there)."""
    return r"""
with recursive t as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null),
ids as (
    select c, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 1, 2, 3, 4, 5, 6, 7]::bigint[]), lambda z, k: case when z % 2 = 1 then xor(z // 2, 3988292384) else z // 2 end)) as crc
    from (select distinct c from t)),
h as (select c, c - c % 5 as base, xor(crc, 4294967295) % 9 as h from ids),
r as (select h.c, i, role, text from h join t on t.c = h.base and i <= h union all select h.c, i, role, text from h join t on t.c = h.c and i > h),
q as (select c, list({'r': role, 'x': text} order by i) as s from r group by c),
s as (select h.c, coalesce(q.s, []) as s from h left join q on h.c = q.c),
p as (select c, len(s) as own, d, s[1:d] as pre, s[1:d - 1] as up, s from (select c, s, unnest(range(0, len(s) + 1)) as d from s)),
n as (select d, pre, any_value(up) as up, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (own = d), '')) as ends_sha256,
             case when d > 0 then octet_length(encode(any_value(s[d].x))) else 0 end as bytes from p group by d, pre),
k as (select a.d, a.pre, count(b.pre) as n_children from n a left join n b on b.d = a.d + 1 and b.up = a.pre group by 1, 2),
m as (select n.*, k.n_children from n join k on n.d = k.d and n.pre = k.pre),
u as (select m.d, m.pre, unnest(range(0, m.d + 1)) as top, (m.n_children = 0)::int as leaf, (m.n_convs - 1) * m.bytes as saved from m),
v as (select top as d, pre[1:top] as pre, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from u group by 1, 2)
select m.conv_id, m.d as depth, w.conv_id as parent_conv_id, m.n_convs, m.n_children, v.n_leaves, v.saved_tokens, m.ends_sha256
from m join v on v.d = m.d and v.pre = m.pre left join m w on w.d = m.d - 1 and w.pre = m.up and m.d > 0
"""

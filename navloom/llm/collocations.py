"""Phrase collocations by multikey quicksort of suffix pointers.

A pointer stands at each word and reads the words from there on, at most three and not past the end of its piece. One pass counts
the single words and finds the few pairs of words that are very common. A second pass routes every pointer by its first two words
(behind a very common pair by all three) to one of many parts; pointers of a batch that read the same words travel as one with a
count. Each part is sorted by multikey three-way quicksort: a partition is split by one word into less, equal and greater, and the
size of an equal partition is the count of the words read so far, which goes on with the next word. Partitions of fewer pointers than
the least count are abandoned.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import bounded_batches, discard, materialize, mixed

LEAST_COUNT, TOP, COVERED = 10, 2000, 50
#: Words held by a task before it sends their pointers; different words of them; pointers of a part on average.
HELD_WORDS, HELD_DISTINCT, PART_POINTERS = 1 << 21, 400_000, 1 << 21
#: A pair of words with over the HOT-th part of all words is routed by the third word too; there are HOT such pairs at most.
HOT = 2000
#: The best of a language are first found in so many parts.
SALTS = 4
#: Partitions up to this size are sorted at once.
SMALL = 4096
#: A-Z to lower case, separators of pieces to 0xFF (no byte of UTF-8), tab to space.
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"\xff"


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order, with _END at the end of every piece."""
    return _END.join([*texts, b""]).translate(_FOLD).replace(_END, b" \xff ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts = batch.column("text").cast(pa.binary())
    langs = batch.column("lang").dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, tokens(texts.filter(pc.equal(langs.indices, i)).to_pylist())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, second, n): counts of words (second is null), and of pairs of words that are common in this task."""
    words: dict[str, Counter] = defaultdict(Counter)
    pairs: Counter = Counter()
    seen = 0

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
        words.clear()
        langs, found, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return _counts(langs, found, [None] * len(rows), counts)

    for batch in batches:
        for lang, found in _by_lang(batch):
            own = Counter(found)
            n = len(found) - own.pop(_END, 0)
            seen += n
            often = {w for w, k in own.items() if k * HOT >= n}
            if often:
                pairs.update((lang, a, b) for a, b in zip(found, found[1:], strict=False) if a in often and b in often)
                if len(pairs) > HELD_DISTINCT:
                    pairs = Counter({k: v for k, v in pairs.items() if v * 4 * HOT >= seen})
            words[lang].update(own)
        if sum(map(len, words.values())) > HELD_DISTINCT:
            yield flush()
    yield flush()
    common = [(*k, v) for k, v in pairs.items() if v * 2 * HOT >= seen]
    if common:
        yield _counts(*zip(*common, strict=True))


def _counts(langs, words, seconds, counts) -> pa.RecordBatch:
    text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), text(words), text(seconds), pa.array(counts, pa.int64())], names=["lang", "word", "second", "n"])


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash, never 0 (0 stands for no word)."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(word) or 1)))


def _hash_words(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else word_hash(w) for w in words.cast(pa.binary()).to_pylist()], pa.int64())


class _Ids(dict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _packed(words: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Pointers (three ids each) with counts as bytes: their different words as hashes, then small numbers."""
    used, places = np.unique(words, return_inverse=True)
    kind = "<u2" if len(used) <= 1 << 16 else "<u4"
    many = np.flatnonzero(counts > 1)
    head = np.array([len(words), len(used), len(many)], "<i8")
    return b"".join(x.tobytes() for x in (head, hashes[used].astype("<i8"), places.reshape(-1, 3).T.astype(kind), many.astype("<u4"), counts[many].astype("<i8")))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(3 x n words as hashes, n counts)."""
    n, used, many = np.frombuffer(data, "<i8", 3).tolist()
    hashes = np.frombuffer(data, "<i8", used, 24)
    at = 24 + 8 * used
    kind = np.dtype("<u2" if used <= 1 << 16 else "<u4")
    places = np.frombuffer(data, kind, 3 * n, at)
    at += 3 * n * kind.itemsize
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(data, "<u4", many, at)] = np.frombuffer(data, "<i8", many, at + 4 * many)
    return hashes[places].reshape(3, n), counts


_ROUTED = "lang string, part int, first long, second long, n long, pointers binary"


def _route(hot: dict[str, list[tuple[int, int]]], parts: int):
    """Pointers to parts; pairs of words in hot (by language) are counted here and their pointers routed by all three words."""

    def pairs_of(lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array(hot.get(lang, []), np.int64).reshape(-1, 2)
        keys = mixed(mixed(own[:, 0].view(np.uint64)) + own[:, 1].view(np.uint64))
        order = np.argsort(keys)
        return keys[order], own[order, 0], own[order, 1]

    def send(lang: str, ids: _Ids, held: list[np.ndarray]) -> list[tuple]:
        words = np.concatenate([*held, np.zeros(2, np.int32)])
        hashes = np.fromiter((0 if w == _END else word_hash(w) for w in ids), np.int64, len(ids))
        at = np.flatnonzero((words[:-2] > 0) & (words[1:-1] > 0))
        read = np.stack([words[at], words[at + 1], words[at + 2]], axis=1)
        full = hashes.view(np.uint64)
        pair = mixed(mixed(full[read[:, 0]]) + full[read[:, 1]])
        triple = mixed(pair + full[read[:, 2]])
        rows = []
        route = pair
        keys, first, second = pairs_of(lang)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            common = keys[place] == pair
            route = np.where(common, triple, pair)
            counted = np.bincount(place[common], minlength=len(keys))
            rows += [(lang, int(keys[i] % np.uint64(parts)), int(first[i]), int(second[i]), int(counted[i]), None) for i in np.flatnonzero(counted).tolist()]
        salt = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        part = (mixed(route ^ salt) % np.uint64(parts)).astype(np.int64)
        # neighbours after this sort read the same words, but for rare collisions, which leave two rows in place of one
        order = np.argsort((part.astype(np.uint64) << np.uint64(32)) | (triple >> np.uint64(32)))
        read, part = read[order], part[order]
        new = np.ones(len(read), bool)
        new[1:] = (read[1:] != read[:-1]).any(1) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        read, part, counts = read[start], part[start], np.diff(np.append(start, len(new)))
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else [], len(part)).astype(int).tolist()
        rows += [(lang, int(part[a]), None, None, None, _packed(read[a:b], hashes, counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        return rows

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(state):
                rows = send(lang, *state.pop(lang))
                for start in range(0, len(rows), 256):
                    columns = list(zip(*rows[start : start + 256], strict=True))
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "part", "first", "second", "n", "pointers"])

        for batch in batches:
            for lang, found in _by_lang(batch):
                if lang not in state:
                    state[lang] = (_Ids(), [])
                ids, arrays = state[lang]
                arrays.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                held += len(found)
            if held > HELD_WORDS or sum(len(ids) for ids, _ in state.values()) > HELD_DISTINCT:
                yield from flush()
                held = 0
        yield from flush()

    return route


def multikey_counts(words: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, tuple[int, ...], int]]:
    """(depth, words, count) of every run of words that pointers (columns of words, with counts) read at least so often, but for depth 1.

    Three-way quicksort on one word at a time; a run of equal words goes on with the next word. 0 is no word.
    """
    found = []
    stack = [(np.arange(words.shape[1]), 0)]

    def equal(pointers: np.ndarray, depth: int, count: int) -> None:
        if words[depth, pointers[0]] == 0:
            return
        if depth:
            found.append((depth + 1, tuple(words[: depth + 1, pointers[0]].tolist()), count))
        if depth + 1 < len(words):
            stack.append((pointers, depth + 1))

    while stack:
        pointers, depth = stack.pop()
        if counts[pointers].sum() < least:
            continue  # abandoned
        keys = words[depth, pointers]
        if len(pointers) <= SMALL:
            order = np.argsort(keys, kind="stable")
            pointers, keys = pointers[order], keys[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.add.reduceat(counts[pointers], start)
            ends = np.append(start[1:], len(keys))
            for i in np.flatnonzero(size >= least).tolist():
                equal(pointers[start[i] : ends[i]], depth, int(size[i]))
            continue
        pivot = np.sort(keys[[0, len(keys) // 4, len(keys) // 2, 3 * len(keys) // 4, -1]])[2]
        less, same = keys < pivot, keys == pivot
        for mask in (less, ~(less | same)):
            if mask.any():
                stack.append((pointers[mask], depth))
        middle = pointers[same]
        count = int(counts[middle].sum())
        if count >= least:
            equal(middle, depth, count)
    return found


def _sort_parts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, depth, first, second, third, n): depth 0 for the counts of a hot pair, which are parts of a sum."""
        now, blobs = None, []

        def done() -> Iterator[pa.RecordBatch]:
            read = [_unpacked(b) for b in blobs]
            words, counts = np.concatenate([r[0] for r in read], axis=1), np.concatenate([r[1] for r in read])
            found = multikey_counts(words, counts, least)
            yield rows([(now[0], d, w[0], w[1], w[2] if d > 2 else 0, n) for d, w, n in found])

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "depth", "first", "second", "third", "n"])

        for batch in batches:
            hot = []
            for row in batch.to_pylist():
                if row["pointers"] is None:
                    hot.append((row["lang"], 0, row["first"], row["second"], 0, row["n"]))
                    continue
                key = (row["lang"], row["part"])
                if key != now and blobs:
                    yield from done()
                    blobs = []
                now = key
                blobs.append(row["pointers"])
            yield rows(hot)
        if blobs:
            yield from done()

    return run


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top collocations of two and three words of each language.

    A-Z are lower-cased, texts split at . , ; : ! ? and line ends into pieces and those at spaces and tabs into words; everything is
    counted over all occurrences within pieces, by language (null: und). A phrase is a candidate from `least` occurrences a on. Cut
    after its first words, with l and r occurrences of the two sides, it scores floor(1,000,000 a a / (l r)); its lowest cut counts,
    ties go to the shorter first side. A pair inside a candidate of three words that has `covered` percent of its occurrences goes.
    Ranks are by score, a (both falling) and phrase (by its bytes); n is the number of words of the language. Null and empty texts have
    no words; an empty table gives an empty result; other columns are not read. Words are told apart by 64-bit hashes. Products are
    decimals of 38 digits, exact up to 10^15 occurrences.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, second string, n long")
    counted = materialize(counted.groupBy("lang", "word", "second").agg(F.sum("n").alias("n")), "phrase-words")
    singles = counted.where("second is null")
    totals = singles.groupBy("lang").agg(F.sum("n").alias("total"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    hot: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for row in counted.where(F.col("second").isNotNull() & (F.col("n") * HOT >= total)).collect():  # HOT rows at most
        hot[row["lang"]].append((word_hash(row["word"].encode()), word_hash(row["second"].encode())))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-total // PART_POINTERS))
    routed = texts.mapInArrow(_route(dict(hot), parts), _ROUTED)
    routed = bounded_batches(routed).repartition(parts, "part").sortWithinPartitions("part", "lang")
    runs = materialize(routed.mapInArrow(_sort_parts(least), "lang string, depth int, first long, second long, third long, n long"), "phrase-runs")

    words = materialize(singles.where(F.col("n") >= least).select("lang", "word", F.col("n").alias("f"), F.arrow_udf(_hash_words, T.LongType())("word").alias("h")), "phrase-frequent")
    word = lambda i, h: words.select("lang", F.col("h").alias(h), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    pairs = runs.where("depth = 2").select("lang", "first", "second", "n")
    common = runs.where("depth = 0").groupBy("lang", "first", "second").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    hot_keys = runs.where("depth = 0").select("lang", "first", "second").distinct()
    pairs = materialize(pairs.join(hot_keys, ["lang", "first", "second"], "left_anti").unionByName(common), "phrase-pairs")
    triples = runs.where("depth = 3").select("lang", "first", "second", "third", F.col("n").alias("a"))
    left, right = pairs.withColumnRenamed("n", "f12"), pairs.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("n").alias("f23"))
    triples = triples.join(left, ["lang", "first", "second"]).join(right, ["lang", "second", "third"])
    triples = materialize(triples, "phrase-triples")
    score = lambda l, r: f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({l} as decimal(19,0)) * cast({r} as decimal(18,0)))"
    longer = triples.selectExpr("lang", "first", "second", "a").unionByName(triples.selectExpr("lang", "second as first", "third as second", "a"))
    longer = longer.groupBy("lang", "first", "second").agg(F.max("a").alias("most"))
    two = pairs.withColumnRenamed("n", "a").join(longer, ["lang", "first", "second"], "left").where(f"most is null or 100 * most < {covered} * a")
    two = two.join(word(1, "first"), ["lang", "first"]).join(word(2, "second"), ["lang", "second"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(score("f1", "f2")).alias("score"))
    three = triples.join(word(1, "first"), ["lang", "first"]).join(word(2, "second"), ["lang", "second"]).join(word(3, "third"), ["lang", "third"])
    three = three.withColumn("_one", F.expr(score("f1", "f23"))).withColumn("_two", F.expr(score("f12", "f3")))
    pick = lambda one, other: F.when(F.col("_one") <= F.col("_two"), F.col(one)).otherwise(F.col(other))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), F.least("_one", "_two").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # of SALTS * top rows of a language
    out = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    out = materialize(out, "phrase-top")
    discard(counted, runs, words, pairs, triples)
    return out


def oracle_sql() -> str:
    """The same in DuckDB SQL, from lists of words."""
    return r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') as w from d),
o as (select lang, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) as x from p cross join (values (1), (2), (3)) v(k)),
f as (select lang, x, count(*) as f from o group by 1, 2),
n as (select lang, sum(f)::bigint as n from f where len(x) = 1 group by 1),
c as (select lang, x, f as a from f where len(x) > 1 and f >= 10),
k as (select c.lang, c.x, c.a, k, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
      from (select *, unnest(range(1, len(x))) as k from c) c join f l on l.lang = c.lang and l.x = c.x[1:k] join f r on r.lang = c.lang and r.x = c.x[k + 1:]),
s as (select * from k qualify row_number() over (partition by lang, x order by score, k) = 1),
b as (select lang, x, max(a) as most from (select lang, x[1:2] as x, a from c where len(x) = 3 union all select lang, x[2:3], a from c where len(x) = 3) u group by 1, 2),
q as (select s.* from s left join b on b.lang = s.lang and b.x = s.x where most is null or 100 * most < 50 * s.a),
t as (select lang, array_to_string(x, ' ') as phrase, a, l, r, score from q)
select lang, rank, phrase, a, l, r, n, score
from (select t.*, n.n, row_number() over (partition by t.lang order by score desc, a desc, phrase) as rank from t join n on n.lang = t.lang) where rank <= 2000
"""

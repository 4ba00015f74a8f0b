"""LSH forest, phrase mining and conversation trie: brute force on small tables, odd and empty tables, seams between blocks and shards."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from navloom.llm import collocations, forest, near_join, tries
from navloom.llm.common import WordHashes

TURNS = "conv_id bigint, turn int, role string, text string"


def trie_by_hand(rows):
    """Every node as the contract says, over plain dicts; ties of turn must not occur."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = [c for c in sorted(convs) if built[c] == node]
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(len(x) == len(node) + 1 for x in below),
                sum(not any(len(y) > len(x) and y[: len(x)] == x for y in below) for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_at_random(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c * rng.choice([1, 1, 3]), None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "a", None]), rng.choice(["hi", "ho", "Ñ漢", "", None])))
    seen = {}
    for r in rows:
        seen[r[:2]] = r  # one row for each conversation and turn
    return [*seen.values(), (None, 1, "user", "x")]


@pytest.mark.parametrize(("seed", "cells", "parts"), [(1, 1 << 19, 2), (2, 40, 2), (3, 1, 7), (4, 12, 23)])
def test_trie_by_brute_force(spark, monkeypatch, seed, cells, parts):
    rows = turns_at_random(seed, 60)
    monkeypatch.setattr(tries, "MOST_CELLS", cells)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = tries.conversation_trie(spark.createDataFrame(rows, TURNS)).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=str) == trie_by_hand(rows)


def test_blocks_of_any_size_add_up():
    """The parts of small blocks, summed up by node, equal those of one block."""
    rng = np.random.default_rng(5)
    length = rng.integers(0, 6, 80)
    rows = sorted((rng.integers(0, 2, 2 * n).tolist(), c) for c, n in enumerate(length.tolist()))
    pack = lambda part: (np.array([c for _, c in part]), np.array([len(x) // 2 for x, _ in part]), np.array([v for x, _ in part for v in x], np.int64), np.array([1 for x, _ in part for _ in x[::2]], np.int64))
    whole, cut = tries._Rows(), tries._Rows()
    tries._reduce(whole, 0, 0, *pack(rows), None, None)
    before = None
    for i in range(0, 80, 7):
        part, after = rows[i : i + 7], rows[i + 7] if i + 7 < 80 else None
        before, _ = tries._reduce(cut, 0, i, *pack(part), before, None if after is None else np.array(after[0], np.int64))
    for name in ("n_leaves", "saved_tokens", "n_convs", "n_children"):
        roots = lambda out: sum(v for v, d in zip(out.columns[name], out.columns["depth"], strict=True) if d == 0)  # noqa: B023, E731
        assert roots(whole) == roots(cut), name


def test_trie_of_long_repeated_empty_and_clashing(spark):
    rows = [(c, t, "user", f"t{t}") for c in (5, 6, 11) for t in range(300)] * 2 + [(8, None, None, None)]
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as key", "'y' as ids", "'z' as turns")
    found = tries.conversation_trie(table).collect()
    root = next(r for r in found if r.depth == 0)
    assert root.n_convs == 4 and root.parent_conv_id is None and max(r.depth for r in found) >= 591
    assert tries.conversation_trie(table.limit(0)).count() == 0
    nodes = tries.prefix_trie(tries.turn_sequences(table))
    assert {(r.text, r.role) for r in tries.turn_texts(nodes, table).where("depth = 1").collect()} == {("t0", "user"), ("", "")}


def phrases_by_hand(rows, least=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for long, b in cands.items() if len(long) == 3 for p in (long[:2], long[1:]) if 100 * b >= 50 * cands.get(p, 1 << 60)}
        scored = []
        for p, a in cands.items():
            if p not in gone:
                score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("hot", [2000, 8])
def test_phrases_by_brute_force(spark, docs_of, monkeypatch, hot):
    rng = random.Random(hot)
    words = ["The", "of", "the", "Ñu", "漢", "a b", "x", "y", "\x01", "rare" + str(hot)]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", " ", ". ", "\n", " ;"]) for _ in range(rng.choice([0, 3, 200])))) for _ in range(40)]
    rows += [("en", None), (None, ""), ("en", "new york city " * 3000), ("de", "x")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "c", "d") for i, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, source string, n_chars int, word string, n string")
    monkeypatch.setattr(collocations, "HOT", hot)
    found = collocations.mine_phrases(docs).select(PHRASES).collect()
    assert sorted(map(tuple, found)) == phrases_by_hand(rows)
    assert sorted(map(tuple, collocations.mine_phrases(docs, least=2, top=5).select(PHRASES).collect())) == phrases_by_hand(rows, 2, 5)


def test_phrases_of_an_empty_table(spark, docs_of):
    assert collocations.mine_phrases(docs_of([]).limit(0)).count() == 0
    assert collocations.mine_phrases(docs_of([None, ""])).count() == 0


def test_multikey_counts_against_counter():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 40, (3, 30_000)).astype(np.int64)
    words[0] += 1
    words[2, words[1] == 0] = 0
    counts = rng.integers(1, 4, 30_000)
    want = Counter()
    for a, b, c, n in zip(*words.tolist(), counts.tolist(), strict=True):
        if b:
            want[a, b] += n
        if b and c:
            want[a, b, c] += n
    assert {w: n for _, w, n in collocations.multikey_counts(words, counts, 10)} == {k: n for k, n in want.items() if n >= 10}


def components_by_hand(texts, ids):
    sets = []
    for t in texts:
        w = forest.words_of(t)
        sets.append({tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        least[find(i)] = min(ids[i], least.get(find(i), 1 << 60))
    return sorted((ids[i], len(sets[i]), least[find(i)], ids[i] == least[find(i)]) for i in range(len(sets)))


def families(seed, n):
    rng = random.Random(seed)
    texts = []
    for f in range(4):
        base = [f"w{f}_{i}" for i in range(120)]
        for _ in range(n):
            own = base.copy()
            for _ in range(rng.choice([0, 1, 3, 6, 12])):
                own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("region", "block"), [(1024, 384), (8, 5)])
def test_forest_by_brute_force(spark, docs_of, odd_texts, clashes, monkeypatch, region, block):
    """Small regions and blocks send families through longer prefixes, more orders and pairs of blocks."""
    monkeypatch.setattr(forest, "REGION", region)
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "STREAM", block)
    chain = [" ".join(f"c{j}" for j in range(i, i + 60)) for i in range(0, 60, 6)]
    texts = [*odd_texts, *families(1, 25), *chain, "One", "one", "two words", "TWO words"]
    found = forest.near_components(docs_of(texts, extra=clashes)).collect()
    assert sorted(map(tuple, found)) == components_by_hand(texts, list(range(len(texts))))


def test_a_large_family_is_not_compared_with_itself(spark):
    """In a region of 6,000 sets, all but 40 of one family, every pair of two labels meets in a task, and a set is in few of them."""
    n, others = 6000, 40
    found = spark.range(n).selectExpr("7L as path", "cast(cast(id as string) as binary) as key", f"cast(if(id < {others}, 100 + id % 20, 1) as string) as label", f"{n}L as n", "'1' as main")
    rows = forest.region_tasks(found).collect()
    assert len(rows) <= 2 * n  # 96,000 when every pair of blocks met
    tasks = defaultdict(lambda: (set(), set()))
    for r in rows:
        tasks[r.task][r.label == "1"].add(bytes(r.key))
    met = defaultdict(set)
    for few, many in tasks.values():
        for k in few:
            met[k] |= few | many
    assert len(met) == others and all(len(x) == n for x in met.values())


def test_components_by_brute_force(spark, monkeypatch):
    """Each key once, with the smallest of its component; links that already are stars need no round."""
    rng = random.Random(4)
    stars = [(100 + i, 10 + i % 3) for i in range(50)]
    chain = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    written = []
    keep = near_join.materialize
    monkeypatch.setattr(near_join, "materialize", lambda df, tag: written.append(tag) or keep(df, tag))
    for links, most in ((stars, 1), (stars + chain, 1000)):
        written.clear()
        graph = roots_by_hand(links)
        found = near_join.components(spark.createDataFrame(links, "a int, b int"), "test").collect()
        assert sorted((r.key, r.root) for r in found) == sorted(graph.items()) and len(written) <= most
    assert near_join.components(spark.createDataFrame([], "a int, b int"), "test").count() == 0


def roots_by_hand(links):
    root = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_forest_of_repeated_null_and_no_ids(spark, docs_of):
    found = forest.near_components(docs_of(["a b c d", "a b c d", "", None, "a b c d"], ids=[7, 7, None, 3, None])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == sorted([(7, 3, 7, True), (7, 3, 7, True), (None, 0, None, True), (3, 0, 3, True), (None, 3, 7, False)], key=str)
    assert forest.near_components(docs_of([]).limit(0)).count() == 0


def test_forest_finds_pairs_at_the_threshold():
    assert forest.missed() < 1e-3 and forest.missed(dense=True) < 1e-3
    sets = forest.shingles_of("A b\tA b", WordHashes())
    assert len(sets) == 2

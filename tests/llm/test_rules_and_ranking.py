import math
import re
import zlib
from collections import Counter

import numpy as np

from navloom.llm import quality_rules as qr
from navloom.llm import ranking


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, c in Counter(windows).items() if c > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_measures(odd_texts):
    for t in [*odd_texts, "a b c a b c x", "a a a a", "l\nl\nl\n \nm", "a|b # c d"]:
        assert qr.measure(t)[:5] == brute(t)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (7, 50, 0.05), (20, 20, 0.3)):
        assert abs(qr.binomial_tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_cutoffs_keep_their_risk():
    rng = np.random.default_rng(0)
    true = np.linspace(0.004, 0.06, 15)  # share of good texts that the steps up to each one reject
    broken = 0
    for _ in range(400):
        first = np.searchsorted(true, rng.random(600))
        k = qr.proven_steps(np.bincount(first, minlength=16)[:15].tolist(), 600, 0.05, 0.02)
        broken += k > 0 and true[k - 1] > 0.02
    assert broken <= 30  # 5 % of 400, and chance
    assert qr.proven_steps([0, 0], 148, 0.05, 0.02) == 0 and qr.proven_steps([0, 0], 149, 0.05, 0.02) == 2 and qr.proven_steps([0], 0, 0.05, 0.02) == 0


def test_small_strata_are_merged():
    risk = qr.Risk()
    assert qr.merged_strata([500, 500, 500], risk) == [[0], [1], [2]]
    assert qr.merged_strata([500, 10, 500], risk) == [[0, 1], [2]] or qr.merged_strata([500, 10, 500], risk) == [[0], [1, 2]]
    assert qr.merged_strata([60, 90, 10], risk) == [[0, 1, 2]] and qr.merged_strata([0, 0, 0], risk) == [[0, 1, 2]]


def test_cutoffs_as_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        good = int(rng.random() < 0.8)
        words = int(rng.integers(40, 1500))
        dirt = rng.beta(1, 30) if good else rng.beta(2, 6)
        rows.append((i, words, words * 5, int(dirt * words * 5), int(rng.integers(0, 3)), int(words * (rng.beta(1, 40) if good else rng.beta(1, 5))), 20, int(rng.integers(0, 9)), good))
    frame = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in qr.MEASURES) + ", quality int")
    held = {r["doc_id"] for r in frame.where("pmod(xxhash64(doc_id, 'holdout'), 2) = 1").collect()}
    risk = qr.Risk()
    got = qr.fit_cutoffs(frame.drop("quality"), frame.select("doc_id", "quality"), risk, "doc_id")

    def values(r):
        _, n, chars, symbols, dups, repeats, lines, upper, _ = r
        return {"symbols": symbols / chars, "dup_lines": dups / lines, "repeats": repeats / n, "upper": upper / chars, "long_words": 1 - 5 / max(chars / n, 5)}

    usable = [(r, values(r)) for r in rows if r[1] >= 50 and 100 * r[5] <= 50 * r[1]]
    strata = [[x for x in usable if lo <= x[0][1] < hi] for lo, hi in ((0, 200), (200, 1000), (1000, 1 << 60))]
    n_held = [sum(r[0] in held and r[-1] for r, _ in s) for s in strata]
    groups = qr.merged_strata(n_held, risk)
    assert len(groups) > 1
    want = []
    for g in groups:
        own = [x for s in g for x in strata[s]]
        fit, proof = [x for x in own if x[0][0] not in held], [x for x in own if x[0][0] in held and x[0][-1]]
        n1, n0 = sum(r[-1] for r, _ in fit), sum(1 - r[-1] for r, _ in fit)
        cuts, kept = {}, {}
        while True:
            best, choice = 1e-12, None
            for rule in qr.RULES:
                for c in reversed(qr.GRID):
                    if c < cuts.get(rule, 2):
                        new = [r[-1] for r, v in fit if c + 1e-12 < v[rule] and v[rule] <= cuts.get(rule, 2) + 1e-12]
                        gain = new.count(0) / n0 - risk.good_weight * new.count(1) / n1
                        if gain > best + 1e-12:
                            best, choice = gain, (rule, c)
            if choice is None:
                break
            cuts[choice[0]] = choice[1]
            lost = sum(any(v[rule] > c + 1e-12 for rule, c in cuts.items()) for _, v in proof)
            tail = sum(math.comb(len(proof), i) * 0.02**i * 0.98 ** (len(proof) - i) for i in range(lost + 1))
            if tail > risk.chance / len(groups):
                break
            kept = dict(cuts)
        want.append(((0, 200, 1000)[g[0]], kept))
    assert [(s, dict(c)) for s, c in got.strata] == want and any(c for _, c in want)


def test_query_and_edge_cases(spark, docs_of, odd_texts, clashes):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(odd_texts, extra=clashes)
    rows = {r["doc_id"]: r for r in qr.judge_documents(docs, labels).collect()}
    for i, t in enumerate(odd_texts):
        n, *_, repeats = brute(t)
        failed = n < 50 or 100 * repeats > 50 * n
        assert rows[i]["base_failed"] == failed and rows[i]["kept"] == (not failed)
    kept = qr.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i]["kept"]}
    assert qr.judge_documents(docs_of([]), labels.limit(0)).count() == 0


def test_rules_reject_bad_texts(spark, docs_of):
    good = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(60)) for i in range(3000)]
    bad = [" ".join(f"#$%w{(i * 3 + j * j) % 997}&&" for j in range(60)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(3300)], "doc_id bigint, quality int, toxic int")
    rows = qr.judge_documents(docs_of(good + bad), labels).collect()
    passed = [r for r in rows if not r["base_failed"]]
    assert all(r["kept"] for r in passed if r["doc_id"] < 3000) and not any(r["kept"] for r in passed if r["doc_id"] >= 3000)
    assert sum(not r["base_failed"] for r in rows) > 3000


def test_ranking(spark, docs_of, odd_texts, clashes):
    good = [f"Plain sentence number {i} with some words. And another one follows, as ever." for i in range(120)]
    bad = [f"$$$ {i} ### !!! *** BUY NOW {i} ||| %%%" for i in range(60)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id bigint, quality int, toxic int")
    rows = ranking.rank_documents(docs_of(texts, extra=clashes), labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] < 120) for r in held)
    odd = ranking.rank_documents(docs_of(odd_texts), labels.limit(0)).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in odd)
    assert ranking.rank_documents(docs_of([]), labels).count() == 0


def test_pairwise_fit_finds_the_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    good = (x[:, 0] - 0.5 * x[:, 1] + 0.2 * rng.normal(size=400) > 0).astype(int)
    r = ranking.fit_pairs(x, good)
    assert r.weights[0] > 0 > r.weights[1] and abs(r.weights[2]) < 0.3 * r.weights[0]


def test_gradient_as_brute_force():
    rng = np.random.default_rng(3)
    diff, w, penalty = rng.normal(size=(50, 4)), rng.normal(size=4), np.array([0.1, 0.2, 0.3, 0.4])

    def value(v):
        return sum(-math.log(1 + math.exp(-float(sum(a * b for a, b in zip(d, v, strict=True))))) for d in diff) / 50 - sum(0.5 * p * x * x for p, x in zip(penalty, v, strict=True))

    gradient, _ = ranking.pair_gradient(diff, w, penalty)
    for j in range(4):
        h = np.eye(4)[j] * 1e-5
        assert abs((value(w + h) - value(w - h)) / 2e-5 - gradient[j]) < 1e-7


def test_ranking_fit_is_the_best_one(spark, docs_of):
    good = [f"Plain sentence number {i} with some words. And another one follows, as ever." for i in range(40)]
    bad = [f"$$ {i} # !! BUY NOW words {i}" for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    ranker = ranking.fit_ranker(docs_of(good + bad), labels)
    hashes = ranking.WordHashes()
    known = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = np.array([ranking.features((good + bad)[i], hashes) for i in known])
    y = np.array([i < 40 for i in known])
    z = (rows - rows.mean(0)) / np.where(rows.std(0) > 1e-12, rows.std(0), 1)
    assert np.allclose(ranker.mean, rows.mean(0))
    pairs = [(a, b) for a in np.flatnonzero(y) for b in np.flatnonzero(~y)]
    wins = np.mean([(z[a] - z[b]) @ ranker.weights > 0 for a, b in pairs])
    assert wins == 1 and np.isclose(ranker.cutoff, np.quantile(z @ ranker.weights, (~y).mean()))


def test_ranking_learns_from_every_labelled_row(spark, docs_of):
    """Means and cutoff are those of all 12,800 labelled rows that are not held out, not of a sample."""
    texts = [f"Plain sentence number {i} with words." if i % 4 else f"$$ {i % 1000} # BUY" for i in range(16_000)]
    labels = spark.range(len(texts)).selectExpr("id as doc_id", "cast(id % 4 > 0 as int) as quality", "0 as toxic")
    docs = docs_of(texts)
    ranker = ranking.fit_ranker(docs.union(docs.limit(50)), labels)
    hashes = ranking.WordHashes()
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    rows = np.array([ranking.features(texts[i], hashes) for i in known])
    assert len(known) > 12_000 and np.allclose(ranker.mean, rows.mean(0), rtol=1e-6, atol=1e-9)
    z = (rows - ranker.mean) / ranker.scale
    assert np.isclose(ranker.cutoff, np.quantile(z @ ranker.weights, np.mean([i % 4 == 0 for i in known])), atol=1e-4)


def test_every_row_is_in_a_pair(spark, docs_of, monkeypatch):
    """Buckets of few rows: rows of the rarer label are copied to them, and count once."""
    monkeypatch.setattr(ranking, "BUCKET", 20)
    monkeypatch.setattr(ranking, "RARER", 3)
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 50 > 0 as int) as quality", "0 as toxic")
    docs = docs_of([f"text {i} of some words" for i in range(400)])
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    seen, pairs = [], 0
    for r in ranking.pair_buckets(docs, labels, "doc_id", "text").collect():
        rows = np.frombuffer(r.f, np.float32).reshape(-1, ranking.N_FEATURES)
        good, first = (np.frombuffer(x, np.int8) for x in (r.good, r.first))
        assert 0 < good.sum() < len(good) == len(rows)
        seen += good[first == 1].tolist()
        pairs += len(ranking.pair_differences(rows, good, 1))
    assert sorted(seen) == sorted(int(i % 50 > 0) for i in known) and pairs == 5 * sum(i % 50 > 0 for i in known)

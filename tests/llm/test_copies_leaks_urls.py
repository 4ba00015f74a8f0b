import random
import re

import duckdb
import numpy as np
import pytest

from navloom.llm import contamination, licenses, near_join, urls
from navloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    return out


def brute_classes(texts):
    sets = sets_of(texts)
    n = len(texts)
    near = np.array([[bool(a) and bool(b) and i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    cls = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([cls[i], *(cls[j] for j in range(n) if near[i, j])])
            if low != cls[i]:
                cls[i], changed = low, True
    return cls, near.sum(1).tolist()


def copies(seed=1, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(n // 8):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    return texts


def test_near_join_as_brute_force(docs_of, odd_texts, clashes):
    texts = copies() + odd_texts + ["A same TEXT of six: plain words"]
    rows = sorted(near_join.near_join(docs_of(texts, extra=clashes)).collect(), key=lambda r: r["doc_id"])
    cls, links = brute_classes(texts)
    assert [r["class_id"] for r in rows] == cls
    assert [r["n_links"] for r in rows] == links


@pytest.mark.parametrize("largest", [8, 10_000])
def test_near_join_in_blocks(docs_of, monkeypatch, largest):
    monkeypatch.setattr(near_join, "LARGEST", largest)
    monkeypatch.setattr(near_join, "BLOCK", 4)
    monkeypatch.setattr(near_join, "LEAF", 4)
    monkeypatch.setattr(near_join, "HOT_ROWS", 3)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 100, 3)] + copies(7, 40)
    rows = sorted(near_join.near_join(docs_of(texts)).collect(), key=lambda r: r["doc_id"])
    cls, links = brute_classes(texts)
    assert [r["class_id"] for r in rows] == cls and [r["n_links"] for r in rows] == links


def test_runs_reach_the_target():
    rng = random.Random(2)
    for depth in (1, 2, 4):
        lost = 0
        for _ in range(4000):
            alive = 1
            for _ in range(depth):
                alive = sum(sum(rng.random() < 0.8 for _ in range(2 if rng.random() < 0.25 else 1)) for _ in range(alive))
            lost += alive == 0
        assert abs(lost / 4000 - near_join.missed(depth)) < 0.03
        assert near_join.missed(depth) ** near_join.runs_for(0.998, depth) <= 0.002


def test_rows_with_equal_ids_and_texts_are_one(docs_of):
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base)] * 200 + [" ".join([*base[:30], "new", *base[31:]])] * 3
    rows = near_join.near_join(docs_of(texts, ids=[1] * 200 + [2, 2, 3])).collect()
    assert len(rows) == 203 and {(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in rows} == {(1, 1, 202, 200), (2, 1, 202, 3), (3, 1, 202, 3)}


def test_keep_one_of_each(docs_of, clashes):
    texts = [*copies(3, 48), None, None, ""]
    docs = docs_of(texts, extra=clashes)
    kept = near_join.keep_documents(docs)
    cls, _ = brute_classes(texts)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(cls))
    assert near_join.near_join(docs_of([])).count() == 0 and near_join.keep_documents(docs_of([])).count() == 0


def test_null_and_repeated_ids(docs_of):
    text = " ".join(f"q{i}" for i in range(30))
    rows = near_join.near_join(docs_of([text, text, "other words are in this one", text], ids=[None, 5, 5, 5])).collect()
    assert sorted(r["n_links"] for r in rows) == [0, 2, 2, 2] and sorted(r["n_copies"] for r in rows) == [1, 3, 3, 3]


def test_shared_counts():
    rng = np.random.default_rng(0)
    left = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(9)]
    right = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(7)]
    assert (near_join.shared_counts(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_decontamination_as_brute_force(spark, docs_of, odd_texts, clashes):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 5, 6, 9, 15, 30, 60, 130]))) for _ in range(60)] + [None, "", "tiny item"]
    texts = list(odd_texts) + ["tiny item"]
    for i in range(80):
        filler = [rng.choice(words) for _ in range(rng.choice([0, 10, 300, 3000]))]
        item = (items[rng.randrange(60)] or "").split()
        if i % 3 == 0:
            item[len(item) // 2 : len(item) // 2 + 1] = ["changed"]
        at = rng.randint(0, len(filler))
        texts.append(" ".join(filler[:at] + item + filler[at:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], round(r["containment"], 9)) for r in contamination.contaminated(docs_of(texts, extra=clashes), bench).collect()}
    docs, its = sets_of(texts), sets_of(items)
    want = {(d, i): (len(a & b), round(len(a & b) / len(b), 9)) for d, a in enumerate(docs) for i, b in enumerate(its) if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    assert got == want
    docs = docs_of(texts, extra=clashes)
    kept = contamination.keep_documents(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert contamination.contaminated(docs_of([]), bench).count() == 0 and contamination.contaminated(docs, bench.limit(0)).count() == 0


def duck(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(f"_{name}", df.toArrow())
        con.sql(f"create table {name} as select * from _{name}")
    return con.sql(sql).fetchall()


def rows_of(df, columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def test_licenses_as_sql(docs_of, odd_texts, clashes):
    texts = [*odd_texts, "Released under the MIT License.", "under the mit license under the MIT-License!", "x " * 100 + "Licensed under CC BY-NC 4.0. " + "y " * 90, "cc by nc cc by nc",
             "permission is hereby granted, free of charge, to any person obtaining a copy of this software and the associated documentation files", "Apache License, Version 2.0", "license the under nothing"]
    docs = docs_of(texts, extra=clashes)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = rows_of(licenses.scan_licenses(docs), columns)
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in duck(ORACLE_SQL["op2_license_scan"], documents=docs)), key=str)
    assert got == want
    by = {r[0]: r for r in got}
    n = len(odd_texts)
    assert by[n + 1][2:7] == (2, 0, 4, "mit", "mit") and by[n + 4][6] == "mit" and by[n + 4][5] == "" and by[n + 6][6] == ""
    assert licenses.scan_licenses(docs_of([])).count() == 0


def test_items_without_an_id(spark, docs_of, monkeypatch):
    one, two = ("a passage of the benchmark with more than five words", "another one that also has quite enough words")
    docs = docs_of([f"start {one} end", f"start {two} end", "something else altogether with words"])
    bench = spark.createDataFrame([(None, one), (None, two), (4, two), (5, None)], "item_id bigint, text string")
    for most in (20_000, 1):
        monkeypatch.setattr(contamination.item_blocks, "__defaults__", (most,))
        got = sorted((r["doc_id"], r["item_id"] or 0) for r in contamination.contaminated(docs, bench).collect())
        assert got == [(0, 0), (1, 0), (1, 4)]
        assert [r["doc_id"] for r in contamination.keep_documents(docs, bench).collect()] == [2]


def brute_licenses(text, notices, step):
    """(n_words, n_base, first_word, last_word, base labels, labels, score) in plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {label for _, label in hits}, 0.0
    for label, notice in notices:
        own = set(notice.split())
        for start in range(0, len(words), step):
            share = len(own & set(words[start : start + 2 * step])) / len(own)
            if share >= licenses.THRESHOLD - 1e-9:
                labels, best = labels | {label}, max(best, share)
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), 1.0 if hits else round(best, 9)


def test_licenses_as_brute_force(docs_of, odd_texts):
    rng = random.Random(4)
    long = ("long", " ".join(f"clause{i}" for i in range(70)))
    texts = [*odd_texts, "is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]
    for label, notice in (*licenses.NOTICES, long):
        for changed in (0, 1, 3):
            words = notice.split()
            for _ in range(changed):
                words[rng.randrange(len(words))] = "other"
            filler = [rng.choice(["the", "of", "license", "software", "zeta"]) for _ in range(rng.randrange(200))]
            at = rng.randint(0, len(filler))
            texts.append(" ".join([*filler[:at], *words, *filler[at:]]))
    for notices in (licenses.NOTICES, (*licenses.NOTICES, long), ()):
        step = licenses.block_step(notices)
        assert step == (70 if long in notices else 32)
        got = {r["doc_id"]: tuple(round(v, 9) if isinstance(v, float) else v for v in r[1:]) for r in licenses.scan_licenses(docs_of(texts), notices=notices).collect()}
        assert got == {i: brute_licenses(t, notices, step) for i, t in enumerate(texts)}


def test_license_rows_with_equal_or_null_ids(docs_of):
    got = licenses.scan_licenses(docs_of(["under the mit license"] * 3 + ["released under the mit license"], ids=[None, 1, 1, None])).collect()
    assert len(got) == 4 and all(r["labels"] == "mit" for r in got)


@pytest.mark.parametrize("most_listed", [100_000, 0])
@pytest.mark.parametrize("most_blocks", [100_000, 0])
def test_url_filter(spark, clashes, monkeypatch, most_listed, most_blocks):
    monkeypatch.setattr(urls, "MOST_LISTED", most_listed)
    monkeypatch.setattr(urls, "MOST_BLOCKS", most_blocks)
    hosts = ["me:pw@spam.org:80", "spam.org.:8080", "www.spam.org.", "a.example.com", "www.example.com", "example.com", "x.net", "net", "Spam.Example.org", "badexample.com", "spam.org"]
    paths = ["", "/", "/en/1", "/es/", "/fr/2?utm_source=a&q=1", "/en/#top", "/x?q=2&utm_medium=b"]
    listed = [None, "no scheme", "://", "http://", *(f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*listed, *listed[:9]])], "page_id bigint, url string, html string")
    got = urls.url_verdicts(df.withColumn("host", df.html).withColumn("_key", df.html), df.where(urls.host_of(df.url).rlike(r"(^|\.)spam")), URL_RULES)
    want = duck(ORACLE_SQL["op10_url_filter"], pages=df)
    assert rows_of(got, ["page_id", "host", "path", "rule", "verdict"]) == sorted(want, key=str)
    assert {r["verdict"] for r in got.where("rule is null and host like '%spam%' and path <> ''").collect()} == {"block"}
    assert urls.url_verdicts(df.limit(0), df, URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.url_verdicts(df, df.limit(0), URL_RULES).where("rule is null").collect()} == {"allow"}


def test_registered_queries_run(spark, sf_dir):
    for name in ("op3_shuffle_shards", "op4_decontamination", "op10_url_filter"):
        assert QUERIES[name](spark, sf_dir).count() > 0

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from navloom.llm import languages, toxicity

EN = "the and of with this that have from which there where about other than then these those would could should".split()
DE = "der und das nicht mit auch werden haben einer durch über schon immer wieder zwischen gegen müssen können".split()
RU = "это как что для был они его при уже или если время может быть после между".split()


def text(words, i, n=40):
    return " ".join(words[(i * 5 + j * (1 + i % 3)) % len(words)] for j in range(n))


def model(spark, docs_of):
    rows = [(i * 3 + k, text(w, i), lang) for k, (w, lang) in enumerate(((EN, "en"), (DE, "de"), (RU, "ru"))) for i in range(60)]
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_spans_and_scripts(spark, docs_of, clashes, odd_texts):
    docs = model(spark, docs_of)
    fitted = languages.fit_languages(docs)
    assert fitted.names == ["de", "en", "ru"]
    mixed = docs_of([text(EN, 1, 30) + " " + text(DE, 2, 50), text(RU, 3), None, "", "123 !!!", *odd_texts], extra=clashes)
    rows = {r["doc_id"]: r for r in languages.label_documents(mixed, fitted).collect()}
    assert rows[0]["lang_pred"] == "de" and [s["lang"] for s in rows[0]["spans"]] == ["en", "de"]
    assert abs(rows[0]["spans"][1]["first_word"] - 30) <= 2
    assert rows[1]["lang_pred"] == "ru" and rows[1]["score"] == 1
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (2, 3, 4))
    assert languages.label_documents(docs_of([]), fitted).count() == 0
    nothing = languages.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in languages.label_documents(mixed, nothing).collect()} == {"und"}


def test_letters_are_of_category_l():
    assert languages.words_of("½ ² ① Ⅳ 12 _ \u0301") == []
    assert languages.words_of("नमस्ते दुनिया ภาษาไทย a\u0301b") == ["नमस्ते", "दुनिया", "ภาษาไทย", "a\u0301b"]


def test_numbers_are_undetermined(spark, docs_of):
    fitted = languages.fit_languages(model(spark, docs_of))
    rows = languages.label_documents(docs_of(["½ ² ①", "Ⅳ 3", "the and ½"]), fitted).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "en"] and rows[0]["score"] == 0


def test_words_are_held_in_groups(monkeypatch):
    monkeypatch.setattr(languages, "MOST_CHARS", 10)
    groups = list(languages.word_groups(pa.array(["ab cd", None, "efg hi", "j", "x" * 30, "", "y"])))
    assert [len(g) for g in groups] == [3, 2, 2] and groups[0] == [["ab", "cd"], [], ["efg", "hi"]]


def test_fitted_shares_equal_counts(spark):
    texts = [("en", "this that there"), ("en", "those"), ("de", "über durch")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    fitted = languages.fit_languages(docs, held_out=-1)
    want = []
    for name in ("de", "en"):
        runs = Counter(w[i : i + k] for lang, t in texts if lang == name for w in (f"<{x}>" for x in t.split()) for k in (2, 3, 4) for i in range(len(w) - k + 1))
        assert sum(runs.values()) == sum(int(languages.letter_runs(t.split())[1].sum()) for lang, t in texts if lang == name)
        shares = np.full(languages.SLOTS, 0.1)
        for w in {x for lang, t in texts if lang == name for x in t.split()}:
            np.add.at(shares, languages.letter_runs([w])[0], 1)
        want.append(np.log(shares / shares.sum()))
    want = np.array(want).T
    assert np.allclose(fitted.logs, want - want.mean(1, keepdims=True), atol=1e-4)


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, 12))) for _ in range(270 * 3)]
    rows = [(f"l{k:03d}", " ".join(words[3 * k : 3 * k + 3])) for k in range(270)]
    docs = spark.createDataFrame([(2 * k + i, t, lang) for k, (lang, t) in enumerate(rows) for i in range(2)] + [(None, "...", "l000"), (None, "1 2", "no words")], "doc_id bigint, text string, lang string")
    fitted = languages.fit_languages(docs, held_out=-1)
    assert fitted.names == [lang for lang, _ in rows]
    got = languages.label_documents(docs.where("lang <> 'no words' and text <> '...'").select("doc_id", "text"), fitted).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {2 * k + i: lang for k, (lang, _) in enumerate(rows) for i in range(2)}


def test_large_labels_keep_a_sample(spark):
    docs = model(spark, None)
    assert languages.fit_languages(docs, most_labelled=0).names == ["de", "en", "ru"]
    assert languages.fit_languages(docs, most_labelled=6).names == ["de", "en", "ru"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)

    class Fixed(languages.Labeller):
        def scores(self, words):
            return np.array([table[w] for w in words], np.float32)

    names = ["a", "b", "c"]
    table = {str(i): rng.normal(0, 6, 3).astype(np.float32) for i in range(40)}
    labeller = Fixed(languages.LanguageModel(names, np.zeros((1, 3), np.float32), np.zeros((1, 3), np.float32)), 10)
    texts = [[str(x) for x in rng.integers(0, 40, n)] for n in (1, 2, 5, 6, 7, 0)]
    for words, path in zip(texts, labeller.paths(texts), strict=True):
        def value(p, words=words):
            return sum(table[w][s] for w, s in zip(words, p, strict=True)) - languages.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))

        best = max((value(p) for p in itertools.product(range(3), repeat=len(words))), default=0)
        assert abs(value(path.tolist()) - best) < 1e-3


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    v, n = 60, 300
    often = np.r_[np.full(6, 0.8), np.full(v - 6, 0.06)]  # some long lists
    terms = [np.flatnonzero(rng.random(v) < often * (i % 9 > 0)) for i in range(n)]
    counts = [rng.integers(1, 5, len(t)) for t in terms]
    index = toxicity.ExampleIndex.build(np.arange(v, dtype=np.uint64), rng.uniform(0.5, 4, v), rng.uniform(0, 2, v), list(range(n)), list(range(n)), rng.integers(0, 2, n).tolist(), terms, counts)
    assert 0 < index.rows.shape[1] < v and len(index.example)

    def dense(t, c):
        x = np.zeros(v)
        x[t] = index.weights(index.factor, t, c)
        return x

    rows = np.array([dense(terms[i], counts[i]) for i in index.ids])
    for q in range(n):
        want = rows @ dense(terms[q], counts[q])
        want[index.ids == q] = 0
        want = np.sort(want)[::-1][: toxicity.NEIGHBOURS]
        places, cosines, votes = index.nearest(terms[q], counts[q], without=q)
        assert np.allclose(votes, rows[places] @ (dense(terms[q], counts[q]) * index.telling), atol=1e-6)
        assert np.allclose(cosines, want[want > 0], atol=1e-6)
        assert len(set(places.tolist())) == len(places)


def brute_scores(texts, labels):
    """Scores of all texts by dictionaries, a full comparison with every example, and plain gradient steps for the calibration."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    examples = [i for i in labels if i not in held]
    known = {w for i in examples for w in words[i]}
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in set(x) for x in words))) + 1e-3 for w in known}
    with_label = {w: [sum(w in words[i] for i in examples if labels[i] == k) for k in (0, 1)] for w in known}
    telling = {w: (math.log2(2 + with_label[w][1] / max(1, with_label[w][0])) - 1) ** 2 for w in known}

    def vector(i):
        x = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(words[i]).items() if w in known}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    vectors = [vector(i) for i in range(len(texts))]

    def votes(i):
        near = sorted(((sum(v * vectors[e].get(w, 0) for w, v in vectors[i].items()), e) for e in examples if texts[e] != texts[i]), key=lambda x: -round(x[0], 9))
        near = [x for x in near if x[0] > 0][: toxicity.NEIGHBOURS]
        told = [(sum(v * vectors[e].get(w, 0) * telling[w] for w, v in vectors[i].items()), labels[e]) for _, e in near]
        total = sum(t for t, _ in told)
        return (sum(t * k for t, k in told) / total if total else 0.0, near[0][0] if near else 0.0)

    x = np.array([(1.0, v, v * t) for v, t in map(votes, examples)])
    y, w = np.array([labels[e] for e in examples]), np.zeros(3)
    for _ in range(200_000):
        step = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.array([1e-3, 1, 1]) * w
        w += 0.02 * step
        if np.abs(step).max() < 1e-9:
            break
    return [1 / (1 + math.exp(-float(w @ np.array([1.0, v, v * t])))) for v, t in (votes(i) for i in range(len(texts)))]


def test_toxicity_equals_brute_force(spark, docs_of):
    rng = np.random.default_rng(7)
    rude = ["idiotword", "trashword"]
    texts = [" ".join([*(f"w{x}" for x in rng.zipf(1.4, rng.integers(3, 30)) % 200), *(rude[: 1 + i % 2] if i % 5 < 2 else [])]) for i in range(230)] + ["", "unseen", None]
    labels = {i: int(i % 5 < 2) ^ int(i % 29 == 0) for i in range(200)}
    frame = spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(texts), frame).collect()}
    want = brute_scores(texts, labels)
    assert max(abs(got[i]["score"] - want[i]) for i in range(len(texts))) < 1e-4
    assert all(got[i]["evidence"] for i in range(230)) and not any(got[i]["evidence"] for i in range(230, 233))


def test_toxic_documents(spark, docs_of, odd_texts, clashes):
    rude = ["idiotword", "trashword", "stupidword"]
    texts = [text(EN, i, 60) + (" " + rude[i % 3] if i % 4 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 0, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(texts + odd_texts, extra=clashes)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(rows[i]["predicted"] == int(i % 4 == 0) for i in range(600))
    assert all(rows[i]["predicted"] == 0 and rows[i]["evidence"] == [] for i in range(600, 605))
    assert all(r["evidence"] for i, r in rows.items() if i < 600)
    assert sum(e["doc_id"] % 4 == 0 for e in rows[0]["evidence"]) > 40
    kept = toxicity.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in rows if not rows[i]["predicted"]}
    assert toxicity.score_documents(docs_of([]), labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(rows)

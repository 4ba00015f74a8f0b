"""The stages of corpus_pipeline.py: each against what its operator finds, and on odd, clashing and empty tables."""

import re

import pytest

from navloom.llm import contamination, near_join, quality_rules, toxicity

pipeline = pytest.importorskip("corpus_pipeline")

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def folder(spark, tmp_path, docs_of, odd_texts, clashes):
    """Driver tables with nulls, ties, repeated rows and clashing columns."""

    def make(empty=False, labelled=True):
        base = " ".join(f"word{i}" for i in range(80))
        texts = [*odd_texts, base, base, base.replace("word3 ", "other "), base + " passage of the benchmark which has some ten words in it", None]
        docs = docs_of(texts, ids=[*range(len(texts) - 2), None, None], extra=clashes)
        labels = spark.createDataFrame([(i, i % 2, None if i % 3 else i % 2) for i in range(8)] + [(None, 1, 1)], LABELS)
        bench = spark.createDataFrame([(1, "passage of the benchmark which has some ten words"), (None, "never there at all"), (2, None), (3, "")], "item_id bigint, text string")
        where = str(tmp_path / f"t{empty}{labelled}")
        for name, df in {"documents": docs.limit(0) if empty else docs, "labels": labels if labelled else labels.limit(0), "benchmark": bench}.items():
            df.write.parquet(f"{where}/{name}.parquet")
        return where

    return make


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_odd_tables(spark, folder, labelled):
    where = folder(labelled=labelled)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= n, name
    last = pipeline.STAGES[-1][1](spark, docs, where)
    assert last.count() == n and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = {r["text"] for r in pipeline.decontaminated(spark, docs, where).collect()}
    assert not any("passage of the benchmark" in (t or "") for t in kept)


def test_stages_on_empty_tables(spark, folder):
    where = folder(empty=True)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, where).count() == 0
    assert pipeline.run(spark, where).count() == 0


def test_run_as_the_operators_say(spark, sf_dir):
    """run() keeps what the judging forms of its operators say, one after the other, over plain lists of ids."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    kept = {r["doc_id"] for r in quality_rules.judge_documents(docs, labels).where("kept").collect()}
    docs = docs.where(docs.doc_id.isin(sorted(kept)))
    kept = {r["doc_id"] for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()}
    docs = docs.where(docs.doc_id.isin(sorted(kept)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))]}
    firsts = {r["doc_id"] for r in near_join.near_join(docs).where("doc_id = class_id").collect()}
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert not any(near(sets[a], sets[b]) for a in firsts for b in firsts if a < b)
    assert all(any(near(sets[a], sets[b]) for b in sets if b != a) for a in set(sets) - firsts)
    docs = docs.where(docs.doc_id.isin(sorted(firsts)))
    found = {r["doc_id"] for r in contamination.contaminated(docs, read("benchmark")).collect()}
    assert {r["doc_id"] for r in pipeline.run(spark, sf_dir).collect()} == firsts - found

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from texts; ids from 0. Extra columns may clash with the operators' own names."""

    def make(texts, ids=None, extra=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        for name in extra or ():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


CLASHES = ["score", "key", "_id_", "task", "path", "n_words", "shard", "words", "_gone_id", "_gone_hash", "_hash", "_text", "_row", "_m", "_s", "_c", "_r", "_block", "_salt", "_bucket"]


@pytest.fixture
def clashes():
    return CLASHES


@pytest.fixture
def odd_texts():
    """Null, empty, blank, tiny, repeated, very long without and with spaces, other scripts."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Ñandú", "漢字", "x"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    return [None, "", "   \n\t ", "a", "a", "same text of six plain words", "same text of six plain words", "x" * 20000, long, "漢字" * 300, "\x00\x01 ퟿€😀", "!!! ??? ---"]

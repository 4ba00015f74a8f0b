import zlib

import numpy as np
from pyspark.sql import functions as F

from navloom.llm import shards
from navloom.llm.common import text_crc32


def test_laws(docs_of, odd_texts, clashes):
    texts = odd_texts * 5
    got = shards.shuffle_shards(docs_of(texts, extra=clashes), 8, bucket_bytes=50_000).withColumn("crc", text_crc32()).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    assert all(r["text"] == texts[r["doc_id"]] and r["crc"] == zlib.crc32((r["text"] or "").encode()) for r in got)
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_same_whatever_the_partitioning(docs_of):
    docs = docs_of([f"text {i}" for i in range(300)])
    one = shards.shuffle_shards(docs.repartition(1), 8, bucket_bytes=400).select("doc_id", "shard", "slot").collect()
    other = shards.shuffle_shards(docs.repartition(7), 8, bucket_bytes=400).select("doc_id", "shard", "slot").collect()
    assert set(one) == set(other)
    assert [r["doc_id"] for r in sorted(one, key=lambda r: (r["slot"], r["shard"]))] != list(range(300))


def test_null_ids_repeated_rows_and_empty(docs_of):
    got = shards.shuffle_shards(docs_of(["a"] * 50, ids=[None] * 50), 8).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 50
    assert shards.shuffle_shards(docs_of([]), 8).count() == 0


def test_no_bucket_is_filled_by_one_id(docs_of, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 100)
    for texts, ids in ((["same"] * 1501, [7] * 1501), ([f"own {i}" for i in range(1501)], [7] * 1501), (["same"] * 1501, [None] * 1501)):
        docs = docs_of(texts + [f"text {i}" for i in range(1500)], ids=ids + list(range(10, 1510)))
        got = shards.shuffle_shards(docs.repartition(3), 8, bucket_bytes=1000).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
        assert sorted(r["position"] for r in got) == list(range(3001))
        sizes = {}
        for r in got:
            sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
        assert max(sizes.values()) < 3 * 3001 / len(sizes)
        assert set(got) == set(shards.shuffle_shards(docs.repartition(5), 8, bucket_bytes=1000).collect())


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(1)
    seen = {}
    for _ in range(6000):
        k = tuple(shards.fisher_yates(3, rng).tolist())
        seen[k] = seen.get(k, 0) + 1
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_written_shards(spark, docs_of, tmp_path):
    dealt = shards.shuffle_shards(docs_of([f"t{i}" for i in range(100)]), 4)
    shards.write_shards(dealt, str(tmp_path / "out"))
    rows = list(shards.read_shard(spark, str(tmp_path / "out"), 2))
    want = dealt.where(F.col("shard") == 2).orderBy("slot").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in want]


def test_order_as_brute_force(docs_of):
    texts, ids = [f"text {i} " * (1 + i % 5) for i in range(400)], [i % 90 or None for i in range(400)]
    docs = docs_of(texts, ids=ids)
    got = shards.shuffle_shards(docs.repartition(3), 8, seed=3, bucket_bytes=2000)
    n_buckets = len({r["bucket"] for r in got.collect()})
    size = sum(len(t.encode()) + 1 for t in texts)
    assert n_buckets <= max(-(-size // 2000), 1)
    n = max(1, -(-size // 2000), min(shards.MOST_SMALL, -(-size // shards.SMALL_BYTES)))
    hashed = docs.select("doc_id", "text", F.xxhash64(F.lit(3), F.col("doc_id").cast("string"), F.col("text")).alias("h")).collect()
    buckets = {}
    for r in hashed:
        buckets.setdefault(r["h"] % n, []).append((r["h"], r["doc_id"], r["text"]))
    want, place = {}, 0
    for b in sorted(buckets):
        rows = sorted(buckets[b], key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2]))
        draws = np.random.default_rng([3, b]).integers(0, np.arange(len(rows), 1, -1)) if len(rows) > 1 else []
        for i, j in zip(range(len(rows) - 1, 0, -1), draws, strict=True):
            rows[i], rows[j] = rows[j], rows[i]
        for _, i, t in rows:
            want[place] = (i, t, b)
            place += 1
    assert {r["position"]: (r["doc_id"], r["text"], r["bucket"]) for r in got.collect()} == want
    assert all((r["shard"], r["slot"]) == (r["position"] % 8, r["position"] // 8) for r in got.collect())


def test_law_in_sql(spark, sf_dir):
    """What SQL can say of the query: sizes and checksums of the whole table, counts at most one apart, gapless slots."""
    import os

    import duckdb

    from navloom.llm.queries import op3_shuffle_shards

    con = duckdb.connect()
    con.register("arrow", op3_shuffle_shards(spark, sf_dir).toArrow())
    con.sql("create table dealt as select * from arrow")
    con.sql(f"create view documents as select * from read_parquet('{os.path.join(sf_dir, 'documents.parquet')}')")
    assert con.sql("select count(*) from (select doc_id, size from dealt except select doc_id, strlen(coalesce(text, '')) + 1 from documents)").fetchall() == [(0,)]
    assert con.sql("select (select count(*) from dealt) = (select count(*) from documents)").fetchall() == [(True,)]
    assert con.sql("select max(n) - min(n) <= 1, bool_and(n = d and lo = 0 and hi = n - 1), count(*) from (select count(*) as n, count(distinct slot) as d, min(slot) as lo, max(slot) as hi from dealt group by shard)").fetchall() == [(True, True, 8)]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_crc32().alias("crc")).collect()
    assert dict(con.sql("select doc_id, text_crc32 from dealt").fetchall()) == {r["doc_id"]: r["crc"] for r in rows} and {zlib.crc32(b"")} <= {0}

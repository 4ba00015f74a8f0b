"""Helpers shared by the text operators: tokens, stable hashes, tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: ASCII but for digits and letters. Bytes from 0x80 on belong to words; A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words as a regular expression for Spark and DuckDB (after lower-casing A-Z).
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shingle, and the similarity from which texts count as near copies.
SHINGLE_WORDS, NEAR = 5, 0.8


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WordHashes(dict):
    """Word to a 64-bit hash that is the same in every process. Starts anew when it is full, so its memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of k words, in order. A text of fewer words than k, but one at least, has one shorter shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = words[:n].copy()
    for i in range(1, k):
        out = mixed(out * _MIX + words[i : n + i])
    return mixed(out)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local mode gets a new one; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="navloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def tables_dir(spark: SparkSession) -> str:
    """Where this application's tables are written."""
    return f"{checkpoint_dir(spark)}/navloom/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Deletes all tables that this application has written. DataFrames that read them can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors. remove_tables deletes it."""
    path = f"{tables_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for these DataFrames, once nothing that is still to run reads them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.__dict__["_written_at"])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch between Spark and Python: whole texts are long, and two tasks share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows and BATCH_BYTES bytes at most (one row at least).

    Spark reads these settings when a plan runs, so they stay set; stricter ones of the session are left as they are.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def unused(name: str, df: DataFrame) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def small_or_shuffled(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has most_rows rows at most (counted first), else as it is: then the join shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_crc32(column="text"):
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8"))


def id_remainder(n: int, column="doc_id"):
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")), F.lit(n))

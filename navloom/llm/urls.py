"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with a list of URLs.

All on DataFrame functions. The filter is a table of blocks of eight 64-bit words; a key sets one bit in each word of the block
that its hash names. A URL can be listed only if its block has all eight bits. Few URLs pass, and only they go to the exact join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import LOWER, UPPER, materialize, small_or_shuffled

WORDS, KEYS_PER_BLOCK, SALTS = 8, 16, 16
#: Rows up to which the filter's blocks and the list are broadcast: 72 bytes a block, at most about 150 a URL.
MOST_BLOCKS, MOST_LISTED = 500_000, 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives the empty text."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no :// gives the empty text."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_of(url: Column) -> Column:
    """Host without user, usual port, dots at its end and a leading "www.", path without slashes at its end, query without utm_ parameters.

    Scheme and fragment don't count. A URL without a host gives the empty text, which no list holds.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r"(:80|:443)?$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    whole = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host == "", F.lit("")).otherwise(whole)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule (verdict, host, path) that fits; nulls if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """For each word of a block, the bit that a key sets."""
    h = F.xxhash64(F.lit(0xB10C), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter of distinct keys: (_block, _w0 .. _w7). Bits are or-ed before the shuffle, so hot blocks don't matter."""
    bits = keys.select(F.pmod(F.xxhash64(F.col(key)), F.lit(n_blocks)).alias("_block"), *(b.alias(f"_b{i}") for i, b in enumerate(_bits(F.col(key)))))
    return bits.groupBy("_block").agg(*(F.bit_or(f"_b{i}").alias(f"_w{i}") for i in range(WORDS)))


def salt() -> Column:
    """A number below SALTS for each row by its place in its input, whatever its values."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, canonical, listed boolean) for every row of pages.

    verdict is that of the longest rule that fits; without one it is block if the canonical URL is on the list, else allow. Null
    URLs and URLs without :// have an empty host and path and are allowed. Repeated rows are each judged; an empty list blocks
    nothing; other columns are not read.
    """
    keys = listed.select(canonical_of(F.col(listed_col)).alias("_key")).where("_key <> ''").distinct()
    keys = materialize(keys, "listed-urls")
    n_blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    url = F.col("_url")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .select("_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_of(url).alias("canonical"))
        .select("*", rule.alias("rule"), verdict.alias("_verdict"))
    )
    blocks = bloom_blocks(keys, "_key", n_blocks)
    key, block = F.col("canonical"), F.pmod(F.xxhash64("canonical"), F.lit(n_blocks))
    few, small = small_or_shuffled(blocks, MOST_BLOCKS), small_or_shuffled(keys, MOST_LISTED)
    if few is blocks:  # the shuffled join: every block goes to all salts, so that a URL of many pages, or of none, is spread
        judged = judged.withColumn("_salt", salt())
        probed = judged.withColumn("_block", block).join(salted(blocks), ["_block", "_salt"], "left")
    else:
        probed = judged.withColumn("_block", block).join(few, "_block", "left")
    hit = reduce(lambda a, b: a & b, (F.col(f"_w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(key))))
    names = ["_id", "host", "path", "canonical", "rule", "_verdict"]
    probed = probed.select(*names, F.coalesce(hit, F.lit(False)).alias("_maybe"))
    if small is keys:  # only what the filter passes is shuffled; all is written before, so that pages are read and judged once
        probed = materialize(probed, "probed-urls")
        passed = probed.where("_maybe").withColumn("_salt", salt()).withColumn("_key", key).join(salted(keys.withColumn("_on", F.lit(True))), ["_key", "_salt"], "left")
        found = passed.select(*names, F.coalesce("_on", F.lit(False)).alias("listed")).unionByName(probed.where("not _maybe").select(*names, F.lit(False).alias("listed")))
    else:
        found = probed.join(small, F.when(F.col("_maybe"), key) == F.col("_key"), "left").select(*names, F.col("_key").isNotNull().alias("listed"))
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", by_list).alias("verdict"), "canonical", "listed")

"""The registered queries of the text operators: (spark, sf_dir) to a DataFrame over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm import collocations, contamination, forest, languages, licenses, near_join, pieces, quality_rules, ranking, shards, toxicity, tries, urls
from navloom.llm.common import id_remainder, read, text_crc32

#: Rules (verdict, host, path) of the URL filter. Fixed values.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Pages on hosts with a label that starts so make up the list of URLs.
LISTED_HOSTS = r"(^|\.)spam"
N_SHARDS = 8


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """A vocabulary file of the box; NAVLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("NAVLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(pieces.encode_documents(read(spark, sf_dir, "documents"), model_path()))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shuffle_shards(read(spark, sf_dir, "documents"), N_SHARDS)
    return dealt.select(
        "doc_id",
        shards.record_bytes("text").alias("size"),
        text_crc32().alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("evidence", F.transform("evidence", lambda e: e["doc_id"]))


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.drop("n_lines", "n_upper")


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labelled = languages.label_documents(docs, languages.fit_languages(docs))
    return labelled.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urls.host_of(F.col("url")).rlike(LISTED_HOSTS))
    return urls.url_verdicts(pages, listed, URL_RULES).drop("canonical", "listed")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language; null texts have no words, a null language is und, an empty table gives no row."""
    return collocations.mine_phrases(read(spark, sf_dir, "documents"))


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by two-word shingles; texts without words stand alone, an empty table gives no row."""
    return forest.near_components(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; rows without a conv_id belong to no conversation, an empty table has no node."""
    return tries.conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_license_scan": op2_license_scan,
    "op3_shuffle_shards": op3_shuffle_shards,
    "op4_decontamination": op4_decontamination,
    "op5_toxic_neighbours": op5_toxic_neighbours,
    "op6_pairwise_quality": op6_pairwise_quality,
    "op7_quality_rules": op7_quality_rules,
    "op9_language_spans": op9_language_spans,
    "op10_url_filter": op10_url_filter,
    "op8_piece_codec": op8_piece_codec,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_minhash_forest": op13_minhash_forest,
}

_CANONICAL = r"""
    select page_id, url, host, path,
           case when host = '' then '' else regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:80|:443)?$', ''), '\.+$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
                || case when query <> '' then '?' || query else '' end end as canonical
    from (select page_id, url,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
                 regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') as query
          from pages)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": near_join.oracle_sql(),
    "op2_license_scan": licenses.oracle_sql(),
    "op4_decontamination": contamination.oracle_sql(),
    "op11_phrase_mining": collocations.oracle_sql(),
    "op12_prefix_trie": tries.oracle_sql(),
    "op13_minhash_forest": forest.oracle_sql(),
    "op10_url_filter": rf"""
with c as ({_CANONICAL}),
rules(what, rule_host, rule_path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                             ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best as (select page_id, url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(what, length(rule_host || rule_path)) as what
         from (select distinct page_id, url, host, path from c) p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
         group by page_id, url),
listed as (select distinct canonical from c where regexp_matches(host, '(^|\.)spam') and canonical <> '')
select c.page_id, c.host, c.path, best.rule,
       coalesce(best.what, case when listed.canonical is not null then 'block' else 'allow' end) as verdict
from c left join best on c.page_id is not distinct from best.page_id and c.url is not distinct from best.url
left join listed on c.canonical = listed.canonical
""",
}

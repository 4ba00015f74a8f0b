"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license notices.

All on DataFrame functions. A text is cut into overlapping blocks of words; a block matches a notice if it holds at least the
threshold's share of the notice's distinct words. The join orders words from rare to frequent over all documents. A match must
share a word among the first |notice| - need + 1 of the notice and the first |block| - need + 1 of the block (prefix filter),
the block must have `need` words of the vocabulary (length filter), and what can still follow the shared word must suffice
(positional filter). Candidates are then counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import LOWER, UPPER, materialize, small_or_shuffled

#: Phrases and their labels. Fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as (label, words). Fixed values.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.9
#: Words from one block's start to the next, at least; a block has twice as many.
BLOCK_STEP = 32
MOST_BROADCAST = 500_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_line(text: Column) -> Column:
    """The lower-cased words of a text, each between single spaces; " " for a null text or one without words."""
    line = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _SEPARATORS, " ")
    return F.regexp_replace(F.concat(F.lit(" "), line, F.lit(" ")), " +", " ")


def spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def phrase_columns(line: Column, n_words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and the array of base labels, from the line of words."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        there, whole = F.contains(line, F.lit(f" {phrase} ")), f" {phrase} "
        counts.append(F.when(there, F.regexp_count(line, F.lit(f"(?={whole})"))).otherwise(F.lit(0)))
        firsts.append(F.when(there, spaces(F.substring_index(line, whole, 1))))
        lasts.append(F.when(there, n_words - spaces(F.substring_index(line, whole, -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "_base": F.array_compact(F.array(*labels)),
    }


def _notices(notices, threshold: float) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, words needed)."""
    out = []
    for i, (label, text) in enumerate(notices):
        words = sorted(set(text.split()))
        out.append((i, label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def block_step(notices) -> int:
    """Words from one block's start to the next: as many as the longest notice has, so that each notice lies whole in some block."""
    return max([BLOCK_STEP, *(len(words.split()) for _, words in notices)])


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    score is 1 with a base phrase, else the largest containment of a matched notice, else 0. Null and empty texts have no words,
    null positions and empty label lists. A notice matches a block of twice block_step words, so it is found wherever its words lie
    within block_step words, whatever its length; spread over more it is found or missed by its place, over twice as many it is
    missed. Without notices only phrases count. Rows with equal id and text get equal results; null ids are rows of their own. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    known, step = _notices(notices, threshold), block_step(notices)
    vocabulary = sorted({w for _, _, words, _ in known for w in words})
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    line = F.col("_line")
    scanned = keyed.select("_id", "_hash", words_line(F.col("_text")).alias("_line")).withColumn("n_words", (spaces(line) - 1).cast("long"))
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)).cast("array<string>"), F.split(line, " "))
    base = materialize(scanned.select("_id", "_hash", "n_words", *(c.alias(n) for n, c in phrase_columns(line, F.col("n_words"), phrases).items()), found.alias("_found")), "license-base")

    # The global order: words of the vocabulary by the number of documents that hold them; a row for each word at most.
    counted = {r["w"]: r["count"] for r in base.select(F.explode("_found").alias("w")).groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = [
        (w, i, label, need, len(words), at, sorted(words, key=place.__getitem__))
        for i, label, words, need in known
        for at, w in enumerate(sorted(words, key=place.__getitem__)[: len(words) - need + 1], 1)
    ]
    index = F.broadcast(spark.createDataFrame(prefixes, "_w string, _notice int, _label string, _need int, _size int, _at int, _words array<string>"))  # the notices

    # Length and prefix filters on whole texts: enough words of the vocabulary, one of them in some notice's prefix.
    least = min((need for *_, need in known), default=1)
    first = F.array(*map(F.lit, sorted({w for w, *_ in prefixes}))).cast("array<string>")
    hopeful = base.where((F.size("_found") >= least) & F.arrays_overlap("_found", first)).select("_id", "_hash").distinct()
    hopeful = materialize(hopeful, "license-hopeful")
    few = small_or_shuffled(hopeful.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")), MOST_BROADCAST)
    texts = keyed.join(few, (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi").dropDuplicates(["_id", "_hash"])
    words = texts.select("_id", "_hash", F.split(F.trim(words_line(F.col("_text"))), " ").alias("_all"))
    starts = words.select("_id", "_hash", "_all", F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(step))).alias("_start"))
    blocks = starts.select("_id", "_hash", F.array_intersect(F.array(*map(F.lit, order)).cast("array<string>"), F.slice("_all", F.col("_start"), F.lit(2 * step))).alias("_block"))
    tokens = blocks.where(F.size("_block") >= least).distinct()  # length filter; equal blocks of a text count once
    tokens = tokens.select("_id", "_hash", "_block", F.posexplode(F.slice("_block", F.lit(1), F.size("_block") - least + 1)).alias("_pos", "_w"))
    n, at = F.size("_block"), F.col("_pos") + 1
    paired = tokens.join(index, "_w").where((n >= F.col("_need")) & (at <= n - F.col("_need") + 1))
    paired = paired.where(1 + F.least(F.col("_size") - F.col("_at"), n - at) >= F.col("_need"))
    shared = F.size(F.array_intersect("_words", "_block"))
    matched = paired.where(shared >= F.col("_need")).groupBy("_id", "_hash").agg(F.collect_set("_label").alias("_labels"), F.max(shared / F.col("_size")).alias("_share"))
    matched = small_or_shuffled(materialize(matched.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_labels", "_share"), "license-matches"), MOST_BROADCAST)

    none = F.array().cast("array<string>")
    joined = base.join(matched, (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i")), "left")
    labels = F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_labels", none))), ",")
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        labels.alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The same scan in DuckDB SQL: every block against every notice."""
    phrases = list(PHRASES.items())
    doubled = "replace(line, ' ', '  ')"  # so that neighbouring places don't share a space
    n_base = " + ".join(f"len(regexp_extract_all({doubled}, ' {p.replace(' ', '  ')} '))" for p, _ in phrases)
    before = [f"case when contains(line, ' {p} ') then len(regexp_replace(line[1:strpos(line, ' {p} ') - 1], '[^ ]', '', 'g')) end" for p, _ in phrases]
    after = [f"case when contains(line, ' {p} ') then n_words - len(regexp_replace(reverse(reverse(line)[1:strpos(reverse(line), reverse(' {p} ')) - 1]), '[^ ]', '', 'g')) - {len(p.split())} end" for p, _ in phrases]
    base = ", ".join(f"case when contains(line, ' {p} ') then '{label}' end" for p, label in phrases)
    rows = ", ".join(f"('{label}', {sorted(set(text.split()))!r})" for label, text in NOTICES)
    return f"""
with lines as (select doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') || ' ' as l from documents),
d as (select row_number() over () as k, doc_id, case when l = '  ' then ' ' else l end as line from lines),
w as (select *, len(regexp_replace(line, '[^ ]', '', 'g')) - 1 as n_words from d),
b as (select k, doc_id, line, n_words, {n_base} as n_base, least({', '.join(before)}) as first_word, greatest({', '.join(after)}) as last_word,
             list_filter([{base}], lambda x: x is not null) as base from w),
blocks as (select k, string_split(trim(line, ' '), ' ')[s : s + {2 * block_step(NOTICES) - 1}] as block
           from (select k, line, unnest(range(1, greatest(n_words, 1) + 1, {block_step(NOTICES)})) as s from w)),
notices(label, words) as (values {rows}),
m as (select k, label, len(list_intersect(words, block)) / len(words) as share from blocks, notices where len(list_intersect(words, block)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
g as (select k, list(distinct label) as labels, max(share) as share from m group by k)
select doc_id, n_words::bigint as n_words, n_base::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       array_to_string(list_sort(list_distinct(base)), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') as labels,
       case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from b left join g using (k)
"""

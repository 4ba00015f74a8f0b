"""Language identification of mixed texts: script ranges narrow the candidates, then Viterbi labels spans.

Every word gets a score for each language from its letter runs (hashed, so the model's size is fixed); languages that are not
written in the word's script are ruled out. The best path through the words pays a penalty for each switch of language, so
that single odd words don't break a span. The text's language is that of most of its labelled letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import bounded_batches, id_remainder

#: Scripts as ranges of code points: (first, last, script). Fixed values; other letters count as script 0.
SCRIPT_RANGES = (
    (0x41, 0x24F, 1),  # Latin
    (0x370, 0x3FF, 2),  # Greek
    (0x400, 0x52F, 3),  # Cyrillic
    (0x530, 0x58F, 4),  # Armenian
    (0x590, 0x5FF, 5),  # Hebrew
    (0x600, 0x6FF, 6),  # Arabic
    (0x900, 0x97F, 7),  # Devanagari
    (0xE00, 0xE7F, 8),  # Thai
    (0x1E00, 0x1EFF, 1),  # Latin, additional
    (0x3040, 0x30FF, 9),  # Kana
    (0x3400, 0x9FFF, 10),  # Han
    (0xAC00, 0xD7AF, 11),  # Hangul
)
N_SCRIPTS = 12
#: Labelled rows that the model is fitted on, at most about so many (by a hash of the id); slots for hashed letter runs.
MOST_LABELLED, SLOTS = 6_000, 1 << 16
#: Texts that advance together, and characters of texts whose words are held at a time (one text's at least).
GROUP, MOST_CHARS = 1024, 1 << 21
#: Cost of a change of language, share of a language's words from which it is written in a script.
SWITCH, SCRIPT_SHARE = 12.0, 0.01
#: Cells of score tables that a task holds: fewer words are kept where there are many languages, and fewer texts advance together.
MOST_CELLS = 50_000_000
UNKNOWN = "und"
#: Letters (Unicode category L) with their marks; the parts of a word longer than this are scored as words of their own.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]{0,39}")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def script_of(word: str) -> int:
    c = ord(word[0])
    for first, last, script in SCRIPT_RANGES:
        if first <= c <= last:
            return script
    return 0


_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)


def letter_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all runs of two, three and four letters of the words, ends marked, and the number of runs of each word."""
    text = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(text))  # characters of the word from each place on
    slots = np.full((len(text), 3), -1, np.int64)
    run = text * _PRIMES[0]
    for k in (1, 2, 3):
        n = len(text) - k
        run = run[:n] + text[k:] * _PRIMES[k]
        mix = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slots[:n, k - 1] = np.where(left[:n] > k, ((mix >> np.uint64(32)) % np.uint64(SLOTS)).astype(np.int64), -1)
    counts = np.add.reduceat((slots >= 0).sum(1), starts) if len(words) else np.zeros(0, np.int64)
    return slots[slots >= 0], counts


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # slots x languages, log share
    scripts: np.ndarray  # scripts x languages, 0 or a large penalty

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        slots, counts = letter_runs(words)
        return np.add.reduceat(self.logs[slots], np.cumsum(counts) - counts) + self.scripts[list(map(script_of, words))]


def model_of(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """From the (slots, counts) of every label; slots from SLOTS on are scripts of words."""
    names = sorted(name for name, (slots, _) in counted.items() if (slots < SLOTS).any())
    logs, used = np.zeros((SLOTS, len(names)), np.float32), np.zeros((N_SCRIPTS, len(names)))
    for i, name in enumerate(names):
        n = np.zeros(SLOTS + N_SCRIPTS)
        n[counted[name][0]] = counted[name][1]
        logs[:, i] = np.log((n[:SLOTS] + 0.1) / (n[:SLOTS] + 0.1).sum())
        used[:, i] = n[SLOTS:]
    if not names:
        return LanguageModel([], logs, used.astype(np.float32))
    written = used >= SCRIPT_SHARE * np.maximum(used.sum(0), 1)
    written[~written.any(1)] = True  # a script that no language uses rules none out
    logs -= logs.mean(1, keepdims=True)
    return LanguageModel(names, logs, np.where(written, 0.0, -50.0).astype(np.float32))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_labelled: int = MOST_LABELLED, fold: int = 3, held_out: int = 1) -> LanguageModel:
    """Counts of letter runs by language over a bounded sample of labelled rows that are not held out.

    The counts are summed in Spark and reach the driver as one row of (slots, counts) for a label; the model takes 256 KB a label. Every label
    that has a row with letters is learned: of its rows those with a 64-bit hash in the label's share stay, the least one always.
    """
    known = bounded_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("_text").rlike(r"\p{L}") & (id_remainder(fold, "_id") != held_out))
    known = known.withColumn("_h", F.xxhash64("_id", "_text", F.lit("sample")))
    by_lang = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("least")).collect()
    cutoffs = [(r["lang"], max(r["least"], min((1 << 63) - 1, (most_labelled << 64) // (r["n"] * len(by_lang)) - (1 << 63)))) for r in by_lang]
    ends = F.broadcast(docs.sparkSession.createDataFrame(cutoffs, "_lang string, _to long"))  # a row for each label
    sample = known.join(ends, (F.col("lang") == F.col("_lang")) & (F.col("_h") <= F.col("_to")))

    def count(batches):
        slots: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                own = slots.setdefault(lang.as_py(), np.zeros(SLOTS + N_SCRIPTS, np.int64))
                words = words_of(text.as_py())
                if words:
                    runs = [letter_runs(words[i : i + 50_000])[0] for i in range(0, len(words), 50_000)]
                    own[:SLOTS] += np.bincount(np.concatenate(runs), minlength=SLOTS)
                    own[SLOTS:] += np.bincount(list(map(script_of, words)), minlength=N_SCRIPTS)
        for lang, n in slots.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(n[used])], names=["lang", "slot", "n"])

    summed = sample.select("_text", "lang").mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c")).select("lang", "c.slot", "c.n")  # SLOTS + N_SCRIPTS entries at most
    return model_of({r["lang"]: (np.array(r["slot"]), np.array(r["n"])) for r in packed.toLocalIterator()})


class Labeller:
    """Viterbi over the words of many texts at a time; scores of words are kept in a bounded table."""

    def __init__(self, model: LanguageModel, most_words: int = 200_000):
        self.model, self.most = model, max(1, min(most_words, MOST_CELLS // max(1, len(model.names))))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((self.most, len(model.names)), np.float32)

    def _ids(self, words: list[str]) -> list[int]:
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            n = len(rows)
            self.table[n : n + len(new)] = self.model.word_scores(new)
            rows.update(zip(new, range(n, n + len(new)), strict=True))
        return list(map(rows.__getitem__, words))

    def scores(self, words: list[str]) -> np.ndarray:
        parts = []
        step = min(50_000, self.most)
        for start in range(0, len(words), step):
            part = words[start : start + step]
            if len(self.rows) + len(part) > self.most:
                self.rows.clear()
            parts.append(self.table[self._ids(part)])
        return np.concatenate(parts) if parts else self.table[:0]

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Best language of every word of each text. Texts advance together, the longest first."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        order = [i for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])) if texts[i]]
        most = max(1, MOST_CELLS // max(1, len(self.model.names)))
        start = 0
        while start < len(order):  # the first is the longest: its length times the texts bounds the words
            group = order[start : start + max(1, min(GROUP, most // len(texts[order[start]])))]
            start += len(group)
            lengths = np.array([len(texts[i]) for i in group])
            every = list(chain.from_iterable([texts[i] for i in group]))
            steps, n_lang = int(lengths[0]), len(self.model.names)
            alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts with a word at each step
            flat = self.scores(every)
            first = np.cumsum([0, *lengths[:-1]])
            back = np.zeros((int(lengths.sum()), n_lang), bool)  # whether the path comes from the best language before
            top = np.zeros(int(lengths.sum()), np.int32)
            best = flat[first].copy()
            for t in range(1, steps):
                k = alive[t]
                at = first[:k] + t
                now = best[:k]
                lead = now.argmax(1)
                jump = now[np.arange(k), lead][:, None] - np.float32(SWITCH)
                back[at], top[at] = jump > now, lead
                best[:k] = np.maximum(now, jump) + flat[at]
            last = best.argmax(1)
            for g, i in enumerate(group):
                a, n = int(first[g]), int(lengths[g])
                out[i] = trace(int(last[g]), back[a : a + n], top[a : a + n])
        return out


def trace(state: int, back: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The path that ends in a language: back to the last word where it was entered by a switch, again and again."""
    path, end = np.zeros(len(top), np.int32), len(top)
    while end > 0:
        entered = np.flatnonzero(back[:end, state])
        start = int(entered[-1]) if len(entered) else 0
        path[start:end] = state
        end, state = start, int(top[start])
    return path


def word_groups(texts: pa.Array):
    """Words of some texts at a time: GROUP texts and about MOST_CHARS characters at most."""
    words, chars = [], 0
    for t in texts:
        text = t.as_py()
        words.append(words_of(text))
        chars += len(text or "")
        if len(words) == GROUP or chars >= MOST_CHARS:
            yield words
            words, chars = [], 0
    if words:
        yield words


_SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
_RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN))])


def label_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans array<struct<lang, first_word, n_words>>) for every row of docs.

    lang_pred is the language of most letters, score its share of them; `und` and 0 for a null text, a text without letters, or
    a model without languages. Words are runs of letters and their marks, counted from 0; numeric signs and lone marks are no letters. Ties go to the first language by name. Repeated rows
    are each labelled; an empty table gives an empty result; other columns are not read.
    """
    kept: list[Labeller] = []

    @F.arrow_udf(_RESULT)
    def label(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Labeller(model))
        out = []
        for words in word_groups(texts):
            for own, path in zip(words, kept[0].paths(words) if model.names else [None] * len(words), strict=True):
                if path is None or not own:
                    out.append({"lang": UNKNOWN, "score": 0.0, "spans": []})
                    continue
                letters = np.bincount(path, np.fromiter(map(len, own), float, len(own)), len(model.names))
                cuts = np.flatnonzero(np.diff(path, prepend=path[:1] + 1))
                ends = [*cuts[1:].tolist(), len(path)]
                spans = [{"lang": model.names[path[a]], "first_word": a, "n_words": b - a} for a, b in zip(cuts.tolist(), ends, strict=True)]
                top = int(letters.argmax())
                out.append({"lang": model.names[top], "score": float(letters[top] / letters.sum()), "spans": spans})
        return pa.array(out, _ARROW_RESULT)

    return bounded_batches(docs).select(F.col(id_col), label(F.col(text_col)).alias("_r")).select(id_col, F.col("_r.lang").alias("lang_pred"), "_r.score", "_r.spans")


_ARROW_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])))])

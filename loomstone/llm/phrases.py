"""Phrase collocations: one count of the longest lead windows, summed to shorter phrases by ROLLUP.

Each word leads one window of up to `longest` words of its piece, padded at the end. Only these windows are counted; a ROLLUP over
the columns (lang, w1, w2, ...) sums them to every shorter phrase. A window ends before a pair of words that is rarer than the least count
asked for, since no phrase that holds such a pair can be a candidate: pairs are counted first, by hash, and the frequent ones form a
filter of bounded size, which may let a window grow too long but never cuts one too short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, arrow_map, bloom, discard, each_word, fmix, slices, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ;;;;;;;;;")
BITS = 31  # of a word's number
KNOWN = 1 << 17  # words that a task remembers from slice to slice
NONE = 0  # the number of the mark between pieces, and of padding


def _numbered(batch: pa.RecordBatch, ids: WordIds, most: int):
    """(word numbers, (language, words) of each text) of slices of a batch (lang, text); pieces and texts are parted by NONE."""
    for part in slices(batch, 1, 4096, most):
        if len(ids.words) > KNOWN:
            ids.restart()
        runs, langs = [], []
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            runs.append(np.append(each_word(text.encode("utf-8", "replace").translate(LOWER).replace(b";", b" ; "), ids.__getitem__, np.int64), NONE))
            langs.append((lang, len(runs[-1])))
        if runs:
            yield np.concatenate(runs), langs


def _pairs(word: np.ndarray, langs: list[tuple[str, int]], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the pair that each word begins, whether there is one)."""
    h = np.array(ids.hashes, np.uint64)[word]
    of = np.repeat(np.array([xxhash.xxh64_intdigest(lang.encode()) for lang, _ in langs], np.uint64), [n for _, n in langs])
    with np.errstate(over="ignore"):
        pair = fmix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + of[:-1])
    return np.append(pair, np.uint64(0)), np.append((word[:-1] != NONE) & (word[1:] != NONE), False)


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)


SLICE = 4 << 20  # bytes of text whose windows are counted together before they leave a task


def pair_counts(source: DataFrame) -> DataFrame:
    """(h, f): how often each pair of neighbouring words occurs, by a hash of language and words."""

    def run(batches):
        ids = WordIds(b";")
        for batch in batches:
            for word, langs in _numbered(batch, ids, SLICE):
                pair, real = _pairs(word, langs, ids)
                h, n = np.unique(pair[real], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return arrow_map(source, run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("f"))


def lead_windows(source: DataFrame, longest: int, frequent) -> DataFrame:
    """(lang, w1 .. w<longest>, n): counts of the window that each word leads; "" pads."""
    names = [f"w{k + 1}" for k in range(longest)]

    def run(batches):
        ids = WordIds(b";")
        for batch in batches:
            for word, langs in _numbered(batch, ids, SLICE):
                pair, real = _pairs(word, langs, ids)
                known = {lang: k for k, lang in enumerate(dict(langs))}
                code = np.repeat(np.array([known[lang] for lang, _ in langs], np.int64), [n for _, n in langs])
                goes_on = real.copy()
                goes_on[real] = frequent.holds(pair[real])
                lead, runs = [word], np.ones(len(word), bool)
                for k in range(1, longest):
                    runs[: len(word) - k + 1] &= goes_on[k - 1 :]
                    runs[len(word) - k + 1 :] = False
                    lead.append(np.where(runs, np.append(word[k:], np.zeros(min(k, len(word)), np.int64)), NONE))
                used = word != NONE
                key = [code[used]]
                for k in range(0, longest, 2):  # two words in a sort key
                    pack = lead[k][used] << BITS
                    key.append(pack | lead[k + 1][used] if k + 1 < longest else pack)
                order = np.lexsort(key)
                fresh = np.zeros(len(order), bool)
                fresh[:1] = True
                for x in key:
                    fresh[1:] |= x[order][1:] != x[order][:-1]
                first = np.nonzero(fresh)[0]
                n = np.diff(np.append(first, len(order)))
                at = np.nonzero(used)[0][order[first]]
                cells = [lead[k][at] for k in range(longest)]
                needed, place = np.unique(np.concatenate(cells), return_inverse=True)
                words = pa.array([ids.words[i] if i != NONE else b"" for i in needed.tolist()], pa.binary()).cast(pa.string())
                text = [words.take(pa.array(x)) for x in place.reshape(longest, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(code[at])), *text, pa.array(n.astype(np.int64))], names=["lang", *names, "n"])

    return arrow_map(source, run, ", ".join(["lang string", *(f"{w} string" for w in names), "n bigint"])).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables (lang, phrase, words, f) of the phrases of 1 to `longest` words that occur `least` times or more, and (lang, n)."""
    source = _source(docs, lang_col, text_col)
    often = written(pair_counts(source).where(F.col("f") >= least).select("h"))
    frequent = bloom(often, "h")
    discard(often)
    names = [f"w{k + 1}" for k in range(longest)]
    windows = lead_windows(source, longest, frequent)
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f")).where(F.col("lang").isNotNull())
    held = F.array_compact(F.array(*names))
    kept = written(sums.where(F.col("w1").isNull() | ((F.col("f") >= least) & ~F.array_contains(held, ""))).select("lang", F.array_join(held, " ").alias("phrase"), F.size(held).alias("words"), "f"))
    return kept.where("words > 0"), kept.where("words = 0").select("lang", F.col("f").alias("n"))


def _exact(column: str):
    return F.col(column).cast("decimal(20,0)")


SALTS = 16  # parts of a language that are ranked on their own first


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, share: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to `longest` words.

    Null text: no words; null lang is und; repeated rows each count; a table without candidates gives an empty result; other columns do not
    matter. The score is that of the lowest cut, ties to the shortest first part. A phrase goes when a longer candidate holds it and
    occurs at least share / 100 times as often. Products are decimals of 38 digits. Each language is ranked in SALTS parts first, of
    which only `top` rows each meet.
    """
    phrases, totals = phrase_counts(docs, longest, least, lang_col, text_col)
    cand = phrases.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    whole = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = whole.withColumns({"num": F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("n")), "den": _exact("l") * _exact("r")}).withColumn("score", F.expr("num div den"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    length = F.explode(F.sequence(F.lit(2), F.size("w") - 1))
    inner = cand.where(F.size("w") > 2).select("lang", "a", "w", length.alias("m")).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    longer = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.lit(100) * F.col("over") < F.lit(share) * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

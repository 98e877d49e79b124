"""Language identification by rank-order profiles: n-grams of a text, most frequent first, against each language's profile by
out-of-place distance."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT, arrow_map, crc_mod, map_text

TOP, PROFILE = 300, 400  # n-grams of a text that are ranked; n-grams of a language's profile (also the distance of an absent one)
PER_LANG = 600  # expected training documents of a language


BLANK = 1  # stands for the end of a word; no letter has this code point


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else BLANK."""
    points = np.arange(0x110000, dtype=np.uint64)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, np.uint64(BLANK))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the 1-, 2- and 3-grams of the lower-cased words, a blank on both sides of each word, in order of codes. A code
    holds the code points of its letters, 21 bits each, so different n-grams of any script have different codes."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if not len(c) or c.max() == BLANK:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.concatenate([[np.uint64(BLANK)], c, [np.uint64(BLANK)]])
    c = c[(c != BLANK) | np.concatenate([[True], c[:-1] != BLANK])]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = ((two[:-1] << np.uint64(21)) | c[2:])[c[1:-1] != BLANK]
    every = np.concatenate([c[c != BLANK], two, three])
    every.sort()
    edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[edge], np.diff(np.append(edge, len(every)))


class RankProfiles:
    """Profiles of the languages; identify() gives (language or und, score, distance)."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        codes = np.unique(np.concatenate([np.asarray(profiles[x], np.uint64) for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.codes = codes
        self.ranks = np.full((len(codes), len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(codes, np.asarray(profiles[lang], np.uint64)), k] = np.arange(len(profiles[lang]))

    def identify(self, text: str) -> tuple[str, float]:
        code, count = ngrams(text)
        if not len(code) or not self.langs:
            return "und", 0.0
        order = np.argsort(-count, kind="stable")[:TOP]  # ties by code
        top = code[order]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = np.where((self.codes[at] == top)[:, None], self.ranks[at], -1)
        gap = np.where(rank >= 0, np.minimum(np.abs(rank - np.arange(len(top))[:, None]), PROFILE), PROFILE)
        mean = gap.mean(0) / PROFILE
        best = int(np.argmin(mean))
        odds = np.exp(-30 * (mean - mean[best]))
        return self.langs[best], float((1 - mean[best]) ** 0.25 / odds.sum())


def fit_profiles(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> RankProfiles:
    """Learns from text and non-null language of documents outside the held-out fold (crc32 of the id mod 4 = 2).

    About per_lang documents of each language, taken by a hash of the id. Counting is distributed; the driver gets PROFILE n-grams of
    each language. Repeated rows count each time; without training rows there are no profiles and every text is und.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(TEXT), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (crc_mod("id", 4) != 2))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return RankProfiles({})
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))]), F.col("lang"))
    part = rows.where((F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)) < share).select("lang", TEXT)

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = total.setdefault(lang, {})
                code, n = ngrams(text or "")
                for c, k in zip(code.tolist(), n.tolist()):
                    mine[c] = mine.get(c, 0) + k
        for lang, mine in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(mine.keys(), pa.int64()), pa.array(mine.values(), pa.int64())], names=["lang", "code", "n"])

    summed = arrow_map(part, count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in best:
        profiles.setdefault(r["lang"], []).append(r["code"])
    return RankProfiles(profiles)


def identify_language(docs: DataFrame, profiles: RankProfiles, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """keep columns, predicted language and score (0 to 1). Null text or no letter: und, 0. A tie goes to the first language
    by name. Repeated rows each give a row. One Arrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def fn(texts):
        got = [shared.value.identify(t) for t in texts]
        return [[a for a, _ in got], [b for _, b in got]]

    return map_text(docs, text_col, fn, [(lang, "string"), (score, "double")], list(keep))

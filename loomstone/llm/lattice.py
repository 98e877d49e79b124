"""LM scoring by subword lattice likelihood.

The pieces of an existing unigram vocabulary span a lattice over each word; its scores, normalised once, weight all segmentations, and a
forward recursion in log space returns the word's marginal probability (the product over its words and one end is `lattice_score`). That
marginal is the base measure of the corpus' model: of a training word's count a discount is given up, estimated from how many words
occur once, twice, three and four times, so that rare words give up a larger part; what all words give up is shared out by the lattice, so every text has a probability, known words by their counts and any word by its segmentations. The document's
marginal probability under this model is `score`. Counts of all training words are kept, so the model grows with the corpus; nothing
in it depends on how words travel.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, arrow_map, crc_mod, slices, written

SPACE = "▁"
FREQUENT = 65_536  # at most so many of the most frequent words are broadcast; no other word has more than one in so many tokens
DISCOUNT = 0.75  # of a training word's count, where the counts of counts tell nothing
FLUSH = 400_000  # distinct words that a task counts before it hands them on
LN10 = math.log(10)
BYTES = 1e-4  # share of the byte pieces beside all others


def words_of(text: str) -> list[str]:
    """ASCII capitals lowered, split at ASCII white space only."""
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").lower().split()]


class Lattice:
    """Log probabilities of pieces in a trie; the byte pieces stand for each byte of a character that no piece covers."""

    def __init__(self, logp: dict[str, float]):
        floor = min(logp.values(), default=-20.0) - 5
        self.bytes = [logp.get(f"<0x{b:02X}>", floor) for b in range(256)]
        self.trie: dict = {}
        for piece, p in logp.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = p

    def word(self, w: str) -> float:
        """Natural log of the probability of a word, over all its segmentations: sums of what leads to each place, in log space. Time
        grows with the length of the word times that of the longest piece, memory with the length."""
        s = SPACE + w
        n, exp, log1p, nothing = len(s), math.exp, math.log1p, -math.inf
        a = [nothing] * (n + 1)
        a[0] = 0.0
        for i in range(n):
            here, node, single = a[i], self.trie, False
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                p = node.get("")
                if p is not None:
                    single = single or j == i
                    x, y = here + p, a[j + 1]
                    a[j + 1] = x if y == nothing else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
            if not single:
                x, y = here + sum(self.bytes[b] for b in s[i].encode("utf-8", "replace")), a[i + 1]
                a[i + 1] = x if y == nothing else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return a[n]


def vocabulary(path: str) -> dict[str, float]:
    """Log probability of each piece by the sentencepiece model's own scores, normalised once. A model of unigram kind gives log
    probabilities; in one of merges a score falls by one with each rank, so the rank's Zipf weight is taken; bytes get a small share."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    score = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
    merges = min(score.values(), default=0.0) < -100
    weight = {t: 1 / (2.7 - x) if merges else math.exp(x) for t, x in score.items()}
    total = sum(weight.values()) * (1 + BYTES)
    bytes_ = {sp.id_to_piece(i): BYTES / 256 / (1 + BYTES) for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    return {t: math.log(v / total) for t, v in weight.items()} | {t: math.log(v) for t, v in bytes_.items()}


def word_counts(docs: DataFrame, train: str) -> DataFrame:
    """(word, c): every word of the texts with its count in the training texts (0 if it is only in others)."""

    def run(batches):
        total: Counter = Counter()
        put = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                w = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                if learn:
                    total.update(w)
                else:
                    for x in set(w):
                        total[x] += 0
                if len(total) > FLUSH:
                    yield put()
                    total = Counter()
        yield put()

    return arrow_map(docs.select(TEXT, train), run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_above(counts: DataFrame, most: int = FREQUENT) -> int:
    """A count that at most `most` words exceed, from a histogram of about a thousand rows: those words may be broadcast."""
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted((r["b"], r["n"], r["hi"]) for r in counts.where("c > 0").groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("hi")).collect())
    total = 0
    for _, n, hi in reversed(bins):
        total += n
        if total > most:
            return hi
    return 0


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What a word that occurs once, twice, or more often gives up of its count, from the numbers of words that occur once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    out = [k - (k + 1) * y * b / a if y and a and b else DISCOUNT for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), 0.95 * k) for k, d in zip((1, 2, 3), out))


def lattice_scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score (log10).

    Learns from rows whose crc32(id as text) mod fold is not held (null ids: not learned from, not held out). Null text: only the end.
    Repeated rows each count and give a row. base_score is the add-one unigram score of the contract; lattice_score the marginal over
    all segmentations by the vocabulary's scores alone, the end counted as one more piece; score that of the corpus' model with the lattice
    as its base measure. The most frequent words, at most FREQUENT, go to all tasks; all others meet their values in one join by word, in
    which no word has more than about one in FREQUENT of the rows; that changes no score. Without training rows every base term is
    log10(1) = 0 and score is lattice_score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias(TEXT), (F.col(id_col).isNotNull() & (crc_mod(id_col, fold) != held)).alias("train"), (crc_mod(id_col, fold) == held).alias("held_out"))
    counts = written(word_counts(rows, "train"))
    ends = rows.where("train").count()
    stats = counts.where("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n_all, distinct = (stats["n"] or 0) + ends, stats["v"] + (1 if ends else 0)
    limit = frequent_above(counts)
    logp = vocabulary(model_path)
    end = math.log(1 / (1 + len(logp)))  # the lattice's end: as likely as a piece is on the mean
    model = spark.sparkContext.broadcast((logp, math.log1p(-math.exp(end))))
    rare = discounts(*(stats[f"n{k}"] for k in range(1, 5)))
    off = lambda c: rare[min(c, 3) - 1] if c else 0.0
    given_up = rare[0] * stats["n1"] + rare[1] * stats["n2"] + rare[2] * (stats["v"] - stats["n1"] - stats["n2"]) + off(ends)
    log_shared = math.log(given_up / n_all) if n_all else 0.0

    def mixed(c, lp):
        """Natural log of a word's probability: its discounted share of all tokens and the lattice's part of what was given up."""
        given, own = lp + log_shared, max(c - off(c), 0.0) / max(n_all, 1)
        if own == 0:
            return given
        kept = math.log(own)
        return max(kept, given) + math.log1p(math.exp(-abs(kept - given)))

    def score_words(batches):
        logp, going_on = model.value
        lattice = Lattice(logp)
        for batch in batches:
            for part in slices(batch, 0, 4096):
                w, c = part.columns
                lp = [lattice.word(x) + going_on for x in w.to_pylist()]
                yield pa.RecordBatch.from_arrays([w, pa.array(np.log10(c.to_numpy() + 1.0)), pa.array(c.to_numpy() > 0), pa.array(lp, pa.float64()), pa.array(map(mixed, c.to_pylist(), lp), pa.float64())], names=["word", "lc", "known", "lp", "mp"])

    schema = "word string, lc double, known boolean, lp double, mp double"
    often = {r["word"]: (r["lc"], r["lp"], r["mp"]) for r in arrow_map(counts.where(F.col("c") > limit).select("word", "c"), score_words, schema).collect()}
    frequent = spark.sparkContext.broadcast(often)
    seldom = arrow_map(counts.where(F.col("c") <= limit).select("word", "c"), score_words, schema)

    def spread(batches):
        """Per text one row with what its frequent words give, under a key that is no word; per other word a row."""
        from pyspark import TaskContext

        table, serial, part = frequent.value, 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, 1, 512):
                key, word, tf, ids, held_out, sums, known, total = [], [], [], [], [], [], [], []
                for at, (text, h) in enumerate(zip(piece.column(1).to_pylist(), piece.column(3).to_pylist())):
                    row = part << 36 | serial
                    serial += 1
                    s_lc = s_lp = s_mp = 0.0
                    s_known = n = 0
                    rest = []
                    for w, k in Counter(text.encode("utf-8", "replace").lower().split()).items():
                        w = w.decode("utf-8", "replace")
                        hit = table.get(w)
                        n += k
                        if hit:
                            s_lc += k * hit[0]
                            s_lp += k * hit[1]
                            s_mp += k * hit[2]
                            s_known += k
                        else:
                            rest.append((w, k))
                    m = len(rest)
                    key += [row] * (m + 1)
                    word += [f" {row}", *(w for w, _ in rest)]
                    tf += [0, *(k for _, k in rest)]
                    ids += [at] + [None] * m
                    held_out += [h] + [None] * m
                    sums += [(s_lc, s_lp, s_mp)] + [(None,) * 3] * m
                    known += [s_known] + [None] * m
                    total += [n + 1] + [None] * m
                own = piece.column(0).take(pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(tf, pa.int64()), own, pa.array(held_out, pa.bool_()), *(pa.array([x[k] for x in sums], pa.float64()) for k in range(3)), pa.array(known, pa.int64()), pa.array(total, pa.int64())], names=["row", "word", "tf", "id", "held_out", "s_lc", "s_lp", "s_mp", "s_known", "n_tokens"])

    id_kind = rows.schema["__id"].dataType.simpleString()
    tokens = arrow_map(rows, spread, f"row bigint, word string, tf bigint, id {id_kind}, held_out boolean, s_lc double, s_lp double, s_mp double, s_known bigint, n_tokens bigint")
    part = lambda x: F.sum(F.coalesce(f"s_{x}", F.col("tf") * F.col(x), F.lit(0.0))).alias(x)
    each = tokens.join(seldom, "word", "left").groupBy("row").agg(
        F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("s_known", F.when(F.col("known"), F.col("tf")), F.lit(0)))).cast("long").alias("n_known"), part("lc"), part("lp"), part("mp"))
    per_token, last = math.log10(n_all + distinct + 1), mixed(ends, end)
    return each.select(id_col, "held_out", "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                       (F.col("lc") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), ((F.col("mp") + F.lit(last)) / LN10).alias("score"), ((F.col("lp") + F.lit(end)) / LN10).alias("lattice_score"))

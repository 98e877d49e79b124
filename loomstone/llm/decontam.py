"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents. Its words are numbered, its suffixes sorted, and its Burrows-Wheeler transform kept in a
wavelet matrix. Test phrases are searched backwards through ranks, all phrases of a step together; occurrences are located by walking
to sampled suffix positions; overlapping ones merge to spans. Only words of the test phrases get a number of their own: any other word
ends a run, so that suffixes are told apart after a few words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, arrow_map, discard, slices, written

WINDOW = 10
SHARD_WORDS = 1_000_000  # words of a shard (a longer document is one shard)
BLOCK_WORDS = 500_000  # words of benchmark items that are searched together; more items make more blocks
BLOCK_BYTES = 128 << 20  # of a block's phrases, which go to all tasks
STEP = 8  # one in so many suffix positions is kept
# Bytes of words: ASCII letters (lowered) and digits, and all beyond ASCII; every other byte parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


class WaveletMatrix:
    """rank(symbols, ends): how often each symbol is among the first `end` of the sequence."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        begin = np.zeros(len(symbols), np.int64)
        ends = list(ends)
        for level, (ones, zeros) in enumerate(self.levels):
            one = (symbols >> (self.bits - 1 - level)) & 1 == 1
            go = lambda x: np.where(one, zeros + ones[x], x - ones[x])  # noqa: B023,E731
            begin, ends = go(begin), [go(e) for e in ends]
        return [e - begin for e in ends]


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes by prefix doubling; each 0 is a symbol of its own, ordered by place, so comparisons end there."""
    n = len(symbols)
    pack = max(1, min(8, 62 // bits))
    key, alive = symbols.astype(np.int64), symbols != 0
    for k in range(1, pack):
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = symbols[k:] if k < n else 0
        key = key << bits | np.where(alive, nxt, 0)
        alive &= nxt != 0
    order = np.argsort(key, kind="stable")  # ties that hold a 0 are in order by place already
    open_ = alive
    h = pack
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    firm = new | ~open_[order]  # a suffix that holds a 0 within reach stands alone
    group = np.maximum.accumulate(np.where(firm, np.arange(n), 0))
    rank[order] = group
    while True:
        last = np.concatenate([firm[1:], [True]])
        tied = np.flatnonzero(~(firm & last))
        if not len(tied):
            return order
        who = order[tied]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)], -1)
        sub = np.lexsort((after, rank[who]))
        who, after = who[sub], after[sub]
        order[tied] = who
        g = rank[who]
        firm[tied] = np.concatenate([[True], (g[1:] != g[:-1]) | (after[1:] != after[:-1])])
        group = np.maximum.accumulate(np.where(firm, np.arange(n), 0))
        rank[order[tied]] = group[tied]
        h *= 2


class FMIndex:
    """Over symbols 1 .. 2**bits - 1; 0 parts runs and is never searched."""

    def __init__(self, symbols: np.ndarray, bits: int):
        n = len(symbols)
        order = suffix_array(symbols, bits)
        before = symbols[order - 1]  # the first suffix's is the last symbol, a 0
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        self.bwt, self.tree, self.n = before, WaveletMatrix(before, bits), n
        kept = (order % STEP == 0) | (before == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the phrases (rows, right-aligned)."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(low[live] < high[live]) & (lengths[live] > step)]
            if not len(live):
                break
            c = phrases[live, width - 1 - step]
            a, b = self.tree.rank(c, low[live], high[live])
            low[live], high[live] = self.below[c] + a, self.below[c] + b
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = at[live]
            done = self.kept[r]
            end = live[done]
            out[end] = self.samples[self.kept_before[at[end]]] + walked[end]
            live = live[~done]
            if len(live):
                r = at[live]
                c = self.bwt[r]
                at[live] = self.below[c] + self.tree.rank(c, r)[0]
                walked[live] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items: numbered words, distinct windows (rows, right-aligned) and, by window, the items that
    have it. Arrays only, beside the words themselves: size() bounds what a broadcast of it takes."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items if item is not None})
        place = {item: k for k, item in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], []
        for item, text in items:
            ids = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)), np.int32)
            if len(ids):
                mine = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (window - len(ids), 0))[None]
                rows.append(np.ascontiguousarray(mine))
                owners.append(np.full(len(mine), place.get(item, -1), np.int64))
        self.bits = max(1, len(self.number).bit_length())
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.rows != 0).sum(1)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate([np.zeros(0, np.int64), *owners])]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        self.first = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1)).astype(np.int32)
        self.owner = pairs[1].astype(np.int32)

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.first[window] : self.first[window + 1]]]

    def size(self) -> int:
        """Bytes, about: a word or name takes some 120 beside its letters."""
        return self.rows.nbytes + self.lengths.nbytes + self.first.nbytes + self.owner.nbytes + sum(map(len, self.number)) + 120 * (len(self.number) + len(self.names))


def hits(texts: list[str], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set]]:
    """(words, merged spans [begin, end) in words, items) of each text, from one FM-index over all of them."""
    get, counts, parts = phrases.number.get, [], []
    for t in texts:
        ids = [get(w, 0) for w in words_of(t)]
        counts.append(len(ids))
        parts.append(np.array([0, *ids], np.int64))
    whole = np.concatenate([*parts, [0]])
    out = [(n, [], set()) for n in counts]
    if not len(phrases.rows) or not whole.any():
        return out
    keep = (whole != 0) | (np.concatenate([[1], whole[:-1]]) != 0)  # runs of unnumbered words shrink to one 0
    keep[-1] = True
    place = np.flatnonzero(keep)
    index = FMIndex(whole[keep], phrases.bits)
    low, high = index.search(phrases.rows, phrases.lengths)
    some = np.flatnonzero(high > low)
    if not len(some):
        return out
    size = (high - low)[some]
    which = np.repeat(some, size)
    rows = np.repeat(low[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    begin = place[index.locate(rows)]
    starts = np.cumsum([0, *(len(p) for p in parts)])
    doc = np.searchsorted(starts, begin, side="right") - 1
    first = begin - starts[doc] - 1
    for k in np.lexsort((first, doc)).tolist():
        _, spans, items = out[doc[k]]
        a, b = int(first[k]), int(first[k] + phrases.lengths[which[k]])
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
        items.update(phrases.items(which[k]))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, words: int, window: int):
    """Phrases of the benchmark's items, block by block: each of about `words` words at most, halved while it takes more than BLOCK_BYTES.
    One block is on the driver at a time; an item is never cut."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // (words * 4)) or 1  # a word has four characters or more with what parts it; shorter ones make blocks larger
    todo = [(n, k) for k in reversed(range(n))]
    while todo:
        n, k = todo.pop()
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = [(r["item"], r["text"]) for r in part.collect()]
        phrases = Phrases(rows, window)
        if phrases.size() > BLOCK_BYTES and len(set(rows)) > 1:
            todo += [(2 * n, k + n), (2 * n, k)]
        else:
            yield phrases


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, bench_text: str, window: int, block_words: int) -> DataFrame:
    """row (a struct of all other columns of docs, whatever their names), text, n_words, spans, items. A single block's pass stays lazy; with
    more, each pass is written before the next block is built, and what it read is discarded."""
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema, shared, last = rows.schema, None, None
    for phrases in _blocks(benchmark, item_col, bench_text, block_words, window):
        if shared is not None:
            rows = written(rows)
            shared.unpersist()
            discard(last)
            last = rows
        shared = spark.sparkContext.broadcast(phrases)

        def run(batches, shared=shared):
            phrases = shared.value
            for batch in batches:
                for part in slices(batch, 1, batch.num_rows, 4 * SHARD_WORDS):  # shards of no more than about SHARD_WORDS words
                    spans, items, words = [], [], []
                    found = hits(part.column(1).to_pylist(), phrases)
                    for (n, s, i), old_spans, old_items in zip(found, part.column(3).to_pylist(), part.column(4).to_pylist()):
                        words.append(n)
                        spans.append(merge(s, old_spans))
                        items.append(sorted(i | set(old_items or ())))
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=schema.names)

        rows = arrow_map(rows, run, schema)
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """keep columns plus n_words, spans (word positions begin, end, begin, end, ..., merged) and items (ids as text, sorted).

    Null or empty texts have no words; an item without words is never found; one shorter than the window is one window. Null item ids
    hit words but are not listed. Repeated rows each give a row. The documents are never shuffled: each block of items goes to all
    tasks, whose shards hold SHARD_WORDS words at most (or one document). Other columns of docs may have any name; one of the names
    above among `keep` is an error.
    """
    if clash := {"n_words", "spans", "items"} & set(keep):
        raise ValueError(f"keep has names of the result: {sorted(clash)}")
    found = _found(docs.select(*keep, F.col(text_col).alias(TEXT)), benchmark, TEXT, item_col, bench_text, window, block_words)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "n_words", "spans", "items")


def merge(spans: list[tuple[int, int]], flat: list[int] | None) -> list[int]:
    """Both lists of spans, merged and flat."""
    if not flat:
        return [x for s in spans for x in s]
    out: list[int] = []
    for a, b in sorted([*spans, *zip(flat[::2], flat[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def leak_digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """find_leaks' rows as keep, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.expr("aggregate(spans, 0L, (acc, x) -> x - acc)")  # ends minus begins: the sign alternates from the last one back
    return found.select(*keep, "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut(text: str, spans: list[int]) -> str:
    """The text without the words of the spans (word positions), and without what parts words inside a span."""
    raw = text.encode("utf-8", "replace")
    inside = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at : begins[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the spans cut out of the text column; all columns and rows stay, whatever the columns' names. Null texts stay null,
    repeated rows are each cut, a text that is all leak becomes what parts its words."""
    found = _found(docs, benchmark, text_col, item_col, bench_text, window, block_words)

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cut(t, s) if t and s else t for t, s in zip(texts, spans)], pa.string())], names=["row", "text"])

    clean = arrow_map(found.select("row", "text", "spans"), run, found.select("row", "text").schema)
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

"""Jaccard join of word-shingle sets by several global orders.

Sets that link share a shingle among the first n - ceil(t * n) + 1 of either, under any order of all shingles; the smaller one has it among
its first n - ceil(2 * t / (1 + t) * n) + 1, and what follows it in both is enough for their overlap (position filter). Each of ORDERS orders puts
rare shingles first (by the class of a counting sketch over all texts) and deals those of a class by a hash of its own. Candidates share a
shingle of the first order's prefix; they must share one in every other order's prefix too before their whole sets are compared.

Any order gives whole results, so the sketch, of 2^SKETCH bytes at most, only decides speed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .common import WordHashes, arrow_map, bloom, discard, each_word, fmix, map_text, sifted, slices, written

SHINGLE, ORDERS, SKETCH = 4, 3, 24
BLOCK = 1 << 16  # counters of the sketch that travel together
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
KNOWN = 1 << 17  # words that a task remembers
SALTS = 32
SEEDS = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(1, 9)]


def shingles(text: str, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words one of the whole sequence; without any, none."""
    if len(known) > KNOWN:
        known.clear()
    h = each_word(text.encode("utf-8", "replace").translate(LOWER), known.__getitem__, np.uint64)
    n = min(width, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : len(h) - n + 1 + k]
    return np.unique(fmix(out))


def least_overlap(n: int, share: int) -> int:
    return -(-share * n // 100)


def shingle_classes(docs: DataFrame, text_col: str, width: int, sketch: int = SKETCH) -> np.ndarray:
    """The class (about twice the binary logarithm of the count) of every bucket of shingles: 2^sketch bytes, whatever the input.

    Each task counts up to 255 a bucket and sends blocks of counters, compressed; they are added up where they meet, one block at a time.
    """
    size = 1 << sketch
    block = min(BLOCK, size)

    def count(batches):
        ids, total, waiting, held = WordHashes(), np.zeros(size, np.uint8), [], 0

        def add():
            at, n = np.unique(np.concatenate(waiting) & np.uint64(size - 1), return_counts=True)
            at = at.astype(np.int64)
            total[at] = np.minimum(total[at] + n, 255)
            waiting.clear()

        for batch in batches:
            for part in slices(batch, 0, 512):
                for text in part.column(0).to_pylist():
                    waiting.append(shingles(text, ids, width))
                    held += len(waiting[-1])
                    if held > 1 << 20:
                        add()
                        held = 0
        if waiting:
            add()
        rows = [(k, c) for k in range(size // block) if (c := total[k * block : (k + 1) * block]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([pa.compress(c.tobytes(), "lz4", asbytes=True) for _, c in rows], pa.binary())], names=["block", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(pa.decompress(c, block, "lz4", asbytes=True), np.uint8)
                sums[k] = sums[k] + c if k in sums else c.astype(np.uint32)
        classes = [np.round(2 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pa.compress(c, "lz4", asbytes=True) for c in classes], pa.binary())], names=["block", "classes"])

    source = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    found = arrow_map(arrow_map(source, count, "block int, counts binary").repartition(F.col("block")), merge, "block int, classes binary").toArrow()
    out = np.zeros(size, np.uint8)
    for k, c in zip(found["block"].to_pylist(), found["classes"].to_pylist()):
        out[k * block : (k + 1) * block] = np.frombuffer(pa.decompress(c, block, "lz4", asbytes=True), np.uint8)
    return out


def prefixes(tokens: np.ndarray, classes: np.ndarray, share: int, orders: int = ORDERS) -> list[np.ndarray]:
    """The first n - ceil(share * n / 100) + 1 tokens of each order; those of the first one in its order."""
    n = len(tokens) - least_overlap(len(tokens), share) + 1
    rank = classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    out = []
    for k in range(orders):
        key = rank | fmix(tokens ^ SEEDS[k]) >> np.uint64(8)
        first = np.argpartition(key, n - 1)[:n] if n < len(key) else np.arange(n)
        out.append(tokens[first[np.argsort(key[first])] if k == 0 else first])
    return out


def signatures(docs: DataFrame, classes: np.ndarray, share: int, width: int, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """keep columns, n (distinct shingles), key (128 bits that name the set) and the prefixes p0 (64 bits a shingle), p1 ... (32 bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def compute(texts, ids):
        sets = [shingles(t, ids, width) for t in texts]
        firsts = [prefixes(s, shared.value, share) if len(s) else [s] * ORDERS for s in sets]
        lists = [pa.array([f[0].view(np.int64) for f in firsts], pa.list_(pa.int64())), *(pa.array([(f[k] >> np.uint64(32)).astype(np.uint32).view(np.int32) for f in firsts], pa.list_(pa.int32())) for k in range(1, ORDERS))]
        return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], *lists]

    fields = [("n", "bigint"), ("key", "binary"), ("p0", "array<bigint>"), *((f"p{k}", "array<int>") for k in range(1, ORDERS))]
    return map_text(docs, text_col, compute, fields, list(keep), WordHashes)


def _similar(n: str, m: str, share: int, after_n=None, after_m=None):
    """Whether sets of these sizes can link; with after_n, after_m: when their first common token has so many tokens from it on."""
    sizes = (F.lit(100) * F.least(n, m)) >= F.lit(share) * F.greatest(n, m)
    return sizes if after_n is None else sizes & (F.lit(100 + share) * F.least(after_n, after_m) >= F.lit(share) * (F.col(n) + F.col(m)))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, share: int, width: int) -> DataFrame:
    """The pairs (a, b) of set numbers whose whole shingle sets link. docs: (mark, text).

    First the prefixes of the other orders must meet. Then the texts of those sets only are brought together (they are smaller than their
    shingles' hashes): a filter of bounded size lets texts of their marks through, a join keeps them.
    """
    mark = F.xxhash64("number")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct().select(mark.alias("h")))
    firsts = sifted(sets.select("number", *[f"p{k}" for k in range(1, ORDERS)], mark.alias("h")), "h", bloom(wanted, "h")).drop("h")
    both = pairs
    for side in ("a", "b"):
        both = both.join(firsts.withColumnsRenamed({"number": side} | {f"p{k}": f"{side}{k}" for k in range(1, ORDERS)}), side)
    meet = F.lit(True)
    for k in range(1, ORDERS):
        meet = meet & F.arrays_overlap(f"a{k}", f"b{k}")
    left = written(both.where(meet).select("a", "b"))
    discard(wanted)
    needed = written(left.select(F.explode(F.array("a", "b")).alias("number")).distinct().join(sets.select("number", "mark"), "number"))
    known_mark = F.xxhash64("mark")
    some = sifted(docs.select("mark", "text", known_mark.alias("h")).where(F.length("text") > 0), "h", bloom(needed.select(known_mark.alias("h")), "h"))
    whole = written(some.groupBy("mark").agg(F.first("text").alias("text")).join(needed, "mark").select("number", "text"))
    found = left.join(whole.toDF("b", "tb"), "b").join(whole.toDF("a", "ta"), "a")

    def compare(batches):
        known, last, own = WordHashes(), None, None
        for batch in batches:
            for part in slices(batch, 2, 256):
                linked = []
                for ta, tb in zip(part.column(3).to_pylist(), part.column(2).to_pylist()):
                    if ta != last:  # pairs of one centre follow each other
                        last, own = ta, shingles(ta, known, width)
                    other = shingles(tb, known, width)
                    common = len(own) + len(other) - len(np.union1d(own, other))
                    linked.append((100 + share) * common >= share * (len(own) + len(other)))
                ok = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    links = written(arrow_map(found.select("a", "b", "tb", "ta"), compare, "a bigint, b bigint"))
    discard(left, needed, whole)
    return links


def distinct_sets(rows: DataFrame) -> DataFrame:
    """A written table of one row (the smallest number) for each set, with the smallest id of its rows.

    Only rows whose set may have copies are joined; the others, nearly all, stay where they are.
    """
    full, mark = rows.where("n > 0"), F.xxhash64("key")
    again = written(full.groupBy("key").agg(F.min("number").alias("number"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).where("copies > 1"))
    held, marked = bloom(again.select(mark.alias("h")), "h"), full.withColumn("h", mark)
    columns = ["number", "key", "mark", "n", "least", *[f"p{k}" for k in range(ORDERS)]]
    lone = sifted(marked, "h", held, keep=False).withColumn("least", F.col("id")).select(columns)
    maybe = sifted(marked, "h", held).drop("h").join(again.select("key", F.col("number").alias("one"), "least"), "key", "left")
    maybe = maybe.where("one IS NULL OR one = number").withColumn("least", F.when(F.col("one").isNull(), F.col("id")).otherwise(F.col("least")))
    sets = written(lone.unionByName(maybe.select(columns)))
    discard(again)
    return sets


def prefix_rows(sets: DataFrame, share: int) -> DataFrame:
    """(t, number, n, pos, short) of the first order's prefix tokens that more than one set has (and a few others that the filter lets
    pass): the token's place, and whether it is in the shorter prefix that the smaller set of a pair needs."""
    often = written(sets.select(F.explode("p0").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("t"))
    held = sets.sparkSession.sparkContext.broadcast(bloom(often, "t"))
    discard(often)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, len(batch), 1024)):
                lists = part.column(2)
                t, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(len(part)), length)
                pos = np.arange(len(t)) - np.repeat(np.cumsum(length) - length, length)
                ok = np.nonzero(held.value.holds(t.view(np.uint64)))[0]
                number, n = (part.column(k).to_numpy()[row[ok]] for k in range(2))
                short = pos[ok] <= n + (-2 * share * n) // (100 + share)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[ok], number, n.astype(np.int32), pos[ok].astype(np.int32), short)], names=["t", "number", "n", "pos", "short"])

    return arrow_map(sets.select("number", "n", "p0"), run, "t bigint, number bigint, n int, pos int, short boolean")


def link_components(sets: DataFrame, docs: DataFrame, share: int, width: int) -> DataFrame:
    """(node, component) of every set with a link, by numbers.

    The sets that share a prefix shingle are first compared with one of them only, that with the fewest rarer shingles (of near copies the one
    that was changed least): this joins a group of near copies without pairs. Then sets of different components that share a prefix shingle are
    compared, those outside the largest component of a shingle with all of it. No pair within a component is made.
    """
    rows = written(prefix_rows(sets, share))
    centre = F.min(F.struct("pos", "number", "n"))
    least = F.min(F.when(F.col("short"), F.col("n")))
    shared = rows.groupBy("t").agg(centre.alias("c"), F.count(F.lit(1)).alias("rows"), least.alias("least")).where("rows > 1 AND least IS NOT NULL")
    joined = rows.join(shared.select("t", "least", F.col("c.number").alias("a"), F.col("c.n").alias("an"), (F.col("c.n") - F.col("c.pos")).alias("after_a")), "t")
    smallest = F.greatest("least", F.ceil(F.lit(share) * F.col("n") / 100))  # that a partner can be
    after = F.col("n") - F.col("pos")
    near = written(joined.where(F.col("short") | (F.lit(100 + share) * after >= F.lit(share) * (smallest + F.col("n")))).select("t", "number", "n", after.alias("after"), "short", "a", "an", "after_a"))
    discard(rows)
    stars = near.where((F.col("a") != F.col("number")) & _similar("n", "an", share, "after", "after_a")).select("a", F.col("number").alias("b")).distinct()
    stars = written(stars)
    links = verified(stars, sets, docs, share, width)
    first = written(graph.components(links.toDF("src", "dst")))
    held = near.join(first.toDF("number", "comp"), "number", "left").select("t", "number", "n", "after", "short", F.coalesce("comp", "number").alias("comp"))
    counted = held.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = counted.groupBy("t").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    open_ = written(held.join(mixed.select("t", "main"), "t"))
    side = lambda df, x: df.select("t", *[F.col(c).alias(f"{x}{d}") for c, d in (("number", ""), ("n", "n"), ("after", "a"), ("short", "s"), ("comp", "c"))])
    smaller = ((F.col("xn") <= F.col("yn")) & F.col("xs")) | ((F.col("yn") <= F.col("xn")) & F.col("ys"))
    meet = (F.col("xc") != F.col("yc")) & smaller & _similar("xn", "yn", share, "xa", "ya")
    pairs = side(open_.where("comp <> main"), "x").join(side(open_, "y"), "t").where(meet).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"))
    more = verified(pairs, sets, docs, share, width)
    found = written(graph.components(links.unionByName(more).toDF("src", "dst")))
    discard(near, stars, open_, first, links, more, pairs)
    return found


def similar_documents(docs: DataFrame, share: int = 85, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """Per row: id, n_shingles, component_id: the smallest id reachable over links of sets with 100 * intersection >= share * union.

    Null and empty texts, and those of white space only: 0 shingles, linked with nothing, their own id. Equal sets are one node, so copies never meet
    as pairs. Null ids give a row and take part, but name no component that has another id; rows that share an id are told apart by their
    sets. Very long texts are taken whole. An empty table gives an empty result; other columns do not matter. Shingles are told apart by 64-bit
    hashes, sets by 128 bits.
    """
    if not 1 <= share <= 100:
        raise ValueError("share is a percentage of the union")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("mark", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit("")))))
    classes = shingle_classes(source, "text", width, sketch)
    rows = written(signatures(source.withColumn("number", F.monotonically_increasing_id()), classes, share, width, ("id", "mark", "number"), "text"))
    sets = distinct_sets(rows)
    slim = written(rows.select("id", "n", "key"))
    discard(rows)
    linked = link_components(sets, source, share, width)
    of = sets.select("number", "key", "least").join(linked.toDF("number", "component"), "number").withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(SALTS)))
    named = of.groupBy("component").agg(F.min("least").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = of.join(named, ["component", "salt"]).select("number", "first")
    ids = sets.join(joined, "number", "left").select("key", F.coalesce("first", "least").alias("component"))
    out = slim.join(ids, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))

"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of the binary Golay code's length (23, 23 and 18 bits, the last filled with zeros).
The code is perfect: every 23-bit word is within 3 bits of one codeword, and its keys are the codewords to which the words within one
bit of it decode (1 or 6 of them). Two segments within 2 bits share a key; if they are within 1 bit, the decoded word of either is a key of the other.
At 4 or fewer differing bits, pigeonhole leaves one of these cases, each a join on exact keys that is verified afterwards:
one segment equal and another within 2 bits (a whole segment with any key of the other), or two segments within 1 bit each (the keys
of the first with the decoded second, against the decoded first with the keys of the second).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .common import arrow_map, map_text, written

SEED, SHINGLE, BITS = 42, 4, 4
LOW23 = (1 << 23) - 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles (repeats included), ASCII capitals lowered; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate([[0], ends[:-shingle]]).tolist()
        parts = [line[a:b] for a, b in zip(first, (ends[shingle - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(parts)
    for at in range(0, n, 4096):
        h = np.array([digest(p, SEED) for p in parts[at : at + 4096]], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", column: str = "fp") -> DataFrame:
    """keep columns and the fingerprint as a signed long."""
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return map_text(docs, text_col, lambda texts: [[sign(fingerprint(t)) for t in texts]], [(column, "bigint")], list(keep))


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(the index of the codeword of each 23-bit word, the error pattern of each syndrome) of the code with generator x^11+x^10+x^6+x^5+x^4+x^2+1."""
    generator = 0b110001110101

    def rest(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= (words >> bit & 1) * np.int32(generator << (bit - 11))
        return words

    error = np.zeros(1 << 11, np.int32)
    single = [1 << i for i in range(23)]
    near = [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[i:]) for c in single[i + j :]]  # up to 3 bits
    error[rest(np.array(near, np.int32))] = near
    index = np.empty(1 << 23, np.int16)
    for at in range(0, len(index), 1 << 17):  # in parts: a worker holds little beside the table
        words = np.arange(at, at + (1 << 17), dtype=np.int32)
        index[at : at + (1 << 17)] = (words ^ error[rest(words)]) >> 11
    return index, error


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decoded index, all keys filled up with -1 to 6 columns) of 23-bit words."""
    index, _ = golay()
    own = index[words]
    near = index[words[:, None] ^ (1 << np.arange(23))[None, :]]
    near.sort(axis=1)
    first = np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    keys = np.full((len(words), 6), -1, np.int64)
    place = first.cumsum(axis=1) - 1
    rows, cols = np.nonzero(first)
    keys[rows, place[rows, cols]] = near[rows, cols]
    return own.astype(np.int64), keys


WHOLE = [(a, b) for a in range(3) for b in range(3) if a != b]
PAIRS = [(0, 1), (0, 2), (1, 2)]


def _probes(fps: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(fp, key, side). whole: a segment and a Golay key of another (side 0). left: the keys of a pair's first segment with the
    decoded second one (side 1); right: the decoded first one with the keys of the second (side 2)."""

    def run(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 2048):
                fp = every[at : at + 2048]
                u = fp.view(np.uint64)
                segment = [(u & np.uint64(LOW23)).astype(np.int64), (u >> np.uint64(23) & np.uint64(LOW23)).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)]
                own, keys = zip(*map(golay_keys, segment))
                found = []
                if "whole" in kinds:
                    found += [((segment[a][:, None] << 12 | keys[b]) << 4 | case, keys[b], 0) for case, (a, b) in enumerate(WHOLE)]
                for case, (a, b) in enumerate(PAIRS):
                    if "left" in kinds:
                        found.append(((keys[a] << 12 | own[b][:, None]) << 4 | (8 + case), keys[a], 1))
                    if "right" in kinds:
                        found.append(((own[a][:, None] << 12 | keys[b]) << 4 | (8 + case), keys[b], 2))
                out = [(np.repeat(fp, (valid >= 0).sum(1)), key[valid >= 0], side) for key, valid, side in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in out]))], names=["fp", "key", "side"])

    return arrow_map(fps.select("fp"), run, "fp bigint, key bigint, side int")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): the smallest node of its component."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "root")


def _within(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


BIG = 64  # fingerprints of a component from which its rows are compared component by component


def link_components(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root) of every distinct fingerprint that a chain of links of `bits` or fewer differing bits joins to another one.

    First each row of a shared whole-segment key is compared with the key's smallest and largest fingerprint only: that joins nearly
    all of a large group without pairs. Then rows of different components are compared: within whole-segment keys, the rows outside
    the key's largest component against all; for pair keys, left rows against right rows, those of BIG components only where two
    different components meet in a key. No pair within a component is made, so the work does not grow with the square of a group.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the keys find every link of at most 4 bits")
    fps = fps.select("fp").distinct()
    whole = written(_probes(fps, ("whole",)))
    shared = whole.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    near = written(whole.join(shared, "key").select("key", "fp", "lo", "hi"))
    stars = near.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("fp").alias("b")).where((F.col("a") != F.col("b")) & _within("a", "b", bits))
    first = written(components(stars))
    comps = first.select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    held = near.join(comps, "fp", "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"))
    counted = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rows = written(held.join(mixed.select("key", "main"), "key"))
    a = rows.where("comp <> main").select("key", F.col("fp").alias("a"), F.col("comp").alias("ca"))
    b = rows.select("key", F.col("fp").alias("b"), F.col("comp").alias("cb"))
    apart = (F.col("ca") != F.col("cb")) & _within("a", "b", bits)
    found = [a.join(b, "key").where(apart).select("a", "b")]
    sized = first.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BIG).select(F.col("root").alias("comp"), F.lit(True).alias("big"))
    marked = written(fps.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")).join(sized, "comp", "left").withColumn("big", F.coalesce("big", F.lit(False))))
    small, big = marked.where("not big").select("fp"), marked.where("big").select("fp", "comp")
    left = lambda x: _probes(x, ("left",)).select("key", F.col("fp").alias("a"))
    right = lambda x: _probes(x, ("right",)).select("key", F.col("fp").alias("b"))
    found.append(left(small).join(right(fps), "key").where((F.col("a") != F.col("b")) & _within("a", "b", bits)).select("a", "b"))
    if big.take(1):
        found.append(left(big).join(right(small), "key").where(_within("a", "b", bits)).select("a", "b"))
        sides = [written(side(big).join(big.toDF(c, f"c{c}"), c)) for side, c in ((left, "a"), (right, "b"))]
        meet = sides[0].select("key", "ca").distinct().join(sides[1].select("key", "cb").distinct(), "key").where("ca <> cb")
        found.append(sides[0].join(meet, ["key", "ca"]).join(sides[1], ["key", "cb"]).where(_within("a", "b", bits)).select("a", "b"))
    links = first.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a <> b")
    for x in found:
        links = links.unionByName(x)
    return components(links).withColumnRenamed("node", "fp")


SALTS = 32  # parts in which the fingerprints of one component are dealt


def component_roots(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root) of every distinct fingerprint of fps: a fingerprint that names its component."""
    mine = fps.select("fp").distinct()
    return mine.join(link_components(mine, bits), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def least_of_component(rows: DataFrame, value: str, bits: int = BITS) -> DataFrame:
    """(fp, root, least): the smallest `value` of rows (fp, value) over each fingerprint's component.

    The smallest is found from that of each fingerprint, with partial aggregates. On the way back a component's fingerprints are dealt
    over SALTS parts, so that a large one does not meet in a task; a fingerprint alone in its component joins nothing.
    """
    mine = written(rows.groupBy("fp").agg(F.min(value).alias("least")))
    linked = written(link_components(mine.select("fp"), bits).select("fp", "root"))
    of = mine.join(linked, "fp").select("fp", "root", "least", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    named = of.groupBy("root").agg(F.min("least").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    alone = mine.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), "least")
    return of.drop("least").join(named, ["root", "salt"]).select("fp", "root", "least").unionByName(alone)


def near_duplicates(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most `bits` bits).

    Null text: as empty, fingerprint 0, linked like any other. Null ids give a row and take part, but are no component's name unless
    it has no other. Rows that share an id are told apart by fingerprint. Equal texts share a fingerprint, so copies never meet as pairs.
    """
    rows = written(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), ("__id",), "__t"))
    of = least_of_component(rows, "__id", bits)
    return rows.join(of, "fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns; one row of each component stays: that of the smallest id (null ids last), then by the text's hash.

    Rows are told apart by a number of their own, given in a written table, so rows that share an id all stay unless their fingerprints
    link, and of equal rows one stays. Null texts are one component with empty ones.
    """
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = written(numbered)
    rank = F.struct(F.col(f"row.`{id_col}`").isNull().alias("a"), F.col(f"row.`{id_col}`").alias("b"), F.xxhash64(f"row.`{text_col}`").alias("c"), F.col("number").alias("d"))
    marked = written(fingerprints(rows.select(rank.alias("rank"), F.col(f"row.`{text_col}`").alias("text")), ("rank",)))  # rows stay in the JVM
    kept = least_of_component(marked, "rank", bits).select(F.col("least.d").alias("number")).distinct()
    one = rows.join(kept.hint("merge"), "number", "left_semi")  # what stays grows with the documents: never broadcast
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

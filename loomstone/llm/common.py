"""Helpers shared by the training-data operators: Arrow-batched maps, shared tables, training samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import discard, written  # noqa: F401

TEXT = "__loom_text"
SLICE_BYTES = 4 << 20  # of texts that a task works on at a time
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
         "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null id counts as remainder -1, so it is in no held-out fold and never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """mapInArrow whose Python workers find this package where the driver does (elsewhere ship it with --py-files)."""
    env, here = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, column: int, rows: int, most: int = SLICE_BYTES):
    """Parts of the batch of at most `rows` rows and, by the text or binary column, about `most` bytes; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    at = total = 0
    for k, n in enumerate(size):
        if k > at and (k - at >= rows or total + n > most):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < len(size):
        yield batch.slice(at)


def map_text(df: DataFrame, text: str, fn: Callable, fields: Sequence[tuple[str, str]], keep: Sequence[str], make: Callable | None = None, rows: int = 512) -> DataFrame:
    """keep columns of df plus fields that fn computes from lists of texts (null: "").

    A text that is kept travels once. Names that clash are refused. fn(texts[, state]) returns one list or array per field. make() builds the state once per task. Work is done in slices of at most
    `rows` rows and SLICE_BYTES bytes, so that a task holds little beside the Arrow batch that Spark hands over.
    """
    own = text in keep
    source = df.select(*keep) if own else df.select(*keep, F.col(text).alias(TEXT))
    schema = T.StructType([source.schema[c] for c in keep])
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    types = [ARROW[kind] for _, kind in fields]
    names = [*keep, *(n for n, _ in fields)]
    if len(set(names)) < len(names):
        raise ValueError(f"columns that are kept clash with those that are made: {sorted(n for n in set(names) if names.count(n) > 1)}")

    def run(batches):
        state = make() if make else None
        for batch in batches:
            place = list(keep).index(text) if own else batch.num_columns - 1
            for part in slices(batch, place, rows):
                texts = [t or "" for t in part.column(place).to_pylist()]
                out = fn(texts, state) if make else fn(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types))], names=names)

    return arrow_map(source, run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Up to per_class (text, label) rows of each class, chosen by a hash of the id, out of the fold, each text of at most max_chars.

    Bounds what reaches the driver: 2 * per_class * max_chars characters. Only ids of chosen labels travel to the documents.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    named = named.where(fold).withColumn("h", F.xxhash64("id"))
    chosen = named.where("y = 0").orderBy("h", "id").limit(2 * per_class).unionAll(named.where("y = 1").orderBy("h", "id").limit(2 * per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, max_chars))
    found = texts.join(F.broadcast(chosen), "id")
    rows = []
    for y in (0, 1):
        rows += found.where(F.col("y") == y).orderBy("h", "id", "text").limit(per_class).select("text", "y").collect()
    return [(r["text"], r["y"]) for r in rows]


def fmix(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers so that every bit depends on all."""
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


def each_word(raw: bytes, number: Callable, kind, piece: int = 1 << 20) -> np.ndarray:
    """number(word) of every word of raw (split at ASCII white space), which is cut into parts of about `piece` bytes on the way."""
    out, at = [np.zeros(0, kind)], 0
    while at < len(raw):
        end = at + piece
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        out.append(np.fromiter(map(number, words), kind, len(words)))
        at = end
    return np.concatenate(out)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class WordIds(dict):
    """Numbers words (bytes) as they come, with a 64-bit hash of each. Number 0 is `first`."""

    def __init__(self, first: bytes = b""):
        self.first = first
        self.restart()

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def restart(self) -> None:
        self.clear()
        self.words, self.hashes = [], []
        self[self.first]


class Bloom:
    """Which 64-bit hashes may be in a set: two bits each, bounded in size by whoever builds it."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for p in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bloom(df: DataFrame, column: str, most: int = 27) -> Bloom:
    """A filter of df's hashes (bigint): 16 bits for each, but at most 2^most bits (16 MB), which is what reaches the driver and the tasks.
    With more hashes it lets more through; it never loses one."""
    n = df.count()
    size = 1 << min(most, max(16, (16 * n).bit_length()))
    h = F.col(column)
    at = F.explode(F.array(h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1)))
    bits = df.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    found, words = bits.toArrow(), np.zeros(size // 64, np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return Bloom(words)


def sifted(df: DataFrame, column: str, held: Bloom, keep: bool = True) -> DataFrame:
    """Rows whose `column` (64-bit hashes) may be in the filter, or with keep=False those that are certainly not. Nothing is shuffled."""
    at, shared = df.columns.index(column), df.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            found = shared.value.holds(batch.column(at).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(found if keep else ~found))

    return arrow_map(df, run, df.schema)

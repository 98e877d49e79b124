"""Exact integer k-means whose candidates are filtered in PCA-rotated coordinates.

Every vector is stored with its integers, the leading coordinates of a rotation by principal components, and the norm of what those
leave (the residual). The squared distance to a centroid is at least that of the leading coordinates plus the squared difference of the
residual norms; only centroids whose bound is not above the best exact distance found are verified, in integers.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

SCALE, SMALL = 1024, 1 << 26  # components below SMALL are worked on as 64-bit numbers, others as Python's
LEADING = 16  # rotated coordinates that are stored
SAMPLE = 20_000  # vectors that the rotation is fitted on; it decides speed only
LIMB = 32  # sums travel in digits of 2^32


def integers(vector) -> list[int]:
    """floor(1024 * x) of each component, exact at any size."""
    return [floor(y) if isfinite(y := SCALE * x) else floor(Fraction(x) * SCALE) for x in vector]


def limbs(value: int) -> list[int]:
    """Digits of 2^32, the last one with the sign."""
    out = []
    while not -(1 << 31) <= value < 1 << 31:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class Rotation:
    """Leading principal axes (rows, orthonormal) around a mean."""

    def __init__(self, sample: np.ndarray, dims: int, leading: int):
        self.mean = sample.mean(0) if len(sample) else np.zeros(dims)
        spread = sample - self.mean
        _, axes = np.linalg.eigh(spread.T @ spread / max(1, len(sample)))
        self.axes = axes[:, ::-1][:, :leading].T.copy()

    def apply(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, residual norms) of integer vectors."""
        x = ints.astype(np.float64) - self.mean
        lead = x @ self.axes.T
        rest = x - lead @ self.axes
        return lead, np.sqrt((rest * rest).sum(1))


def nearest(ints: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: list[list[int]], rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of small integer vectors; ties go to the smaller number."""
    c = np.array(centres, np.int64)
    c_lead, c_rest = rotation.apply(c)
    gap = (lead * lead).sum(1)[:, None] + (c_lead * c_lead).sum(1)[None, :] - 2 * lead @ c_lead.T + (rest[:, None] - c_rest[None, :]) ** 2
    size = (lead * lead).sum(1)[:, None] + rest[:, None] ** 2 + ((c_lead * c_lead).sum(1) + c_rest**2)[None, :]
    gap -= 1e-9 * (size + (rotation.mean**2).sum()) + 1e-6  # what rounding may have added
    rows = np.arange(len(ints))
    best = gap.argmin(1)
    off = ints - c[best]
    far, verified = (off * off).sum(1), len(ints)
    for j in range(len(c)):
        left = rows[(gap[:, j] <= far) & (best != j)]
        if len(left):
            off = ints[left] - c[j]
            d = (off * off).sum(1)
            verified += len(left)
            won = (d < far[left]) | ((d == far[left]) & (j < best[left]))
            best[left[won]], far[left[won]] = j, d[won]
    return best, far, verified


def nearest_large(ints: list[int], centres: list[list[int]]) -> tuple[int, int]:
    far = [sum((a - b) ** 2 for a, b in zip(ints, c)) for c in centres]
    return far.index(min(far)), min(far)


def rotated(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, leading: int = LEADING, sample: int = SAMPLE) -> tuple[DataFrame, Rotation]:
    """A written table (id, ints, large, lead, rest) of the vectors of `dims` finite components, and its rotation.

    ints: int32 bytes; large: decimal texts where a component does not fit (then the filter is passed over). The rotation is fitted on
    at most `sample` vectors of smallest hash.
    """
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.where((F.size("v") == dims) & fine)
    some = kept.where(F.forall("v", lambda x: F.abs(x) < SMALL / SCALE)).orderBy(F.xxhash64("v")).limit(sample).select("v").toArrow()["v"]
    rotation = Rotation(np.floor(np.array(some.to_pylist(), np.float64).reshape(-1, dims) * SCALE), dims, leading)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                large = (np.abs(v) >= SMALL / SCALE).any(1)
                ints = np.floor(np.where(large[:, None], 0, v) * SCALE).astype(np.int32)
                lead, rest = rotation.apply(ints)
                texts = [",".join(map(str, integers(x.tolist()))) if big else None for x, big in zip(v, large)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in ints], pa.binary()), pa.array(texts, pa.string()), pa.array([x.tobytes() for x in lead], pa.binary()), pa.array(rest)], names=["id", "ints", "large", "lead", "rest"])

    kind = kept.schema["id"].dataType.simpleString()
    return written(arrow_map(kept, run, f"id {kind}, ints binary, large string, lead binary, rest double")), rotation


def assigned(batch: pa.RecordBatch, centres: list[list[int]], rotation: Rotation, dims: int):
    """(ids, ints, large, cluster, distance as Python's integers where large) of parts of a batch of rotated()."""
    small_centres = all(abs(x) < SMALL for c in centres for x in c)
    for at in range(0, len(batch), 8192):
        part = batch.slice(at, 8192)
        ints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
        large = {k: list(map(int, t.split(","))) for k, t in enumerate(part.column(2).to_pylist()) if t is not None}
        if small_centres:
            lead = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(len(ints), -1)
            cluster, far, _ = nearest(ints, lead, part.column(4).to_numpy(), centres, rotation)
            far = far.tolist()
        else:
            large = {k: large.get(k) or x for k, x in enumerate(ints.tolist())}
            cluster, far = np.zeros(len(ints), np.int64), [0] * len(ints)
        for k, x in large.items():
            cluster[k], far[k] = nearest_large(x, centres)
        yield part.column(0), ints, large, cluster, far


def _totals(table: DataFrame, centres, rotation: Rotation, dims: int) -> dict[tuple[int, int], int]:
    """Sums by (cluster, component), exact; component `dims` is the count, the next the distances. Reaches the driver: clusters * (dims + 2) sums."""

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, ints, large, cluster, far in assigned(batch, centres, rotation, dims):
                for j in np.unique(cluster).tolist():
                    mine = np.nonzero(cluster == j)[0].tolist()
                    plain = [k for k in mine if k not in large]
                    sums = ints[plain].sum(0).tolist()
                    for k in mine:
                        if k in large:
                            sums = [a + b for a, b in zip(sums, large[k])]
                    for i, x in enumerate([*sums, len(mine), sum(far[k] for k in mine)]):
                        total[j, i] = total.get((j, i), 0) + x
        rows = [(j, i, at, x) for (j, i), value in total.items() for at, x in enumerate(limbs(value))]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["j", "i", "at", "x"])

    out: dict[tuple[int, int], int] = {}
    for r in arrow_map(table, run, "j int, i int, at int, x bigint").groupBy("j", "i", "at").agg(F.sum("x").alias("x")).collect():
        out[r["j"], r["i"]] = out.get((r["j"], r["i"]), 0) + (r["x"] << (LIMB * r["at"]))
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, leading: int = LEADING) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dims` components, none null or not finite; others have no row. Repeated rows each count and each give
    one; rows that share an id start in the order of their vectors; null ids start last. Fewer than k vectors give fewer clusters; none, an
    empty table. Sums are exact at any size; a distance or inertia that does not fit in 64 bits is null. Other columns do not matter.
    A round that changes no centroid ends the rounds, since all later ones would repeat it.
    """
    table, rotation = rotated(vectors, id_col, vector_col, dims, leading)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = table.orderBy(order.asc_nulls_last(), "large", "ints").limit(k).select("ints", "large").collect()
    centres = [list(map(int, r["large"].split(","))) if r["large"] else np.frombuffer(r["ints"], np.int32).tolist() for r in starts]
    for _ in range(rounds if centres else 0):
        sums = _totals(table, centres, rotation, dims)
        moved = [[sums[j, i] // sums[j, dims] for i in range(dims)] if (j, dims) in sums else c for j, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    sums = _totals(table, centres, rotation, dims) if centres else {}
    fits = lambda x: x if x < 1 << 63 else None
    inside = [sums.get((j, dims + 1), 0) for j in range(len(centres))]
    whole, inside = fits(sum(inside)), [fits(x) for x in inside]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]

    def run(batches):
        for batch in batches:
            for ids, _, _, cluster, far in assigned(batch, centres, rotation, dims):
                of = cluster.tolist()
                columns = [pa.array(of, pa.int32()), pa.array([fits(int(x)) for x in far], pa.int64()), pa.array([inside[j] for j in of], pa.int64()), pa.array([whole] * len(of), pa.int64()), pa.array([names[j] for j in of], pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    kind = table.schema["id"].dataType.simpleString()
    return arrow_map(table, run, f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string").withColumnRenamed("id", id_col)

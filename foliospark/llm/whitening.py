"""Whitening of embeddings by blockwise TSQR and one-sided Jacobi SVD.

Tasks compress their centred rows to a triangular factor R, R's are compressed again in a tree of groups, and plane rotations make the
columns of the last R orthogonal: the rotations together are the components, the columns' lengths the standard deviations (times the root
of n), both without a product of rows that would square the condition number. What the driver holds (sums, R, components) is bounded by the
dimensions and does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Rows that one QR takes, and R's that one group of the tree takes.
BLOCK_ROWS = 8192
FAN_IN = 32
MAX_SWEEPS = 60
_LONG = 2**63 - 1

RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


@dataclass(frozen=True)
class Fit:
    """n, the sums of x by dimension, and by falling eigenvalue the components (columns) with their standard deviations and shares of the variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray


def integer_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, with x = floor(1024 * c) + 100000, of the rows whose vector is not null, empty or with an entry null, NaN or infinite."""
    good = F.col(vector).isNotNull() & (F.size(vector) > 0)
    good &= ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Count and sums of the vectors of the usual length: the most frequent one, of equally frequent ones the greatest."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return 0, np.zeros(0, np.int64)
    d, n = lengths[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _matrix(batch, d).sum(0)
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["at", "total"])

    by_task = vectors.filter(F.size("x") == d).select("x").mapInArrow(run, "at int, total bigint")
    total = dict(by_task.groupBy("at").agg(F.sum("total")).collect())
    return n, np.array([total[k] for k in range(d)], np.int64)


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact integers n * x - S."""
    return (x * n - total) / n


def _qr(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular_factor(vectors: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """R of the centred rows. Each round of the tree is written, so lost executors cost no more than a round."""
    d = len(total)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch, d)
            for k in range(0, len(x), BLOCK_ROWS):
                r = _qr(np.vstack([r, _centred(x[k : k + BLOCK_ROWS], n, total)]))
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["at", "r"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        r = _qr(np.vstack([np.frombuffer(r).reshape(-1, d) for r in group.sort_values("at")["r"]]))
        return pd.DataFrame({"at": [group["at"].iloc[0] // FAN_IN], "r": [r.tobytes()]})

    with scratch(vectors.sparkSession):
        factors = stored(vectors.filter(F.size("x") == d).select("x").mapInArrow(leaves, "at bigint, r binary"), "tsqr")
        most = factors.agg(F.max("at")).first()[0]
        while most > 0:
            factors = stored(factors.groupBy(F.floor(F.col("at") / FAN_IN).alias("group")).applyInPandas(merged, "at bigint, r binary"), "tsqr")
            most //= FAN_IN
        return np.frombuffer(factors.first()["r"]).reshape(-1, d)


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Round-robin: d - 1 rounds (d even) of disjoint pairs in which every pair meets once."""
    ring = np.arange(d)
    for _ in range(d - 1):
        yield ring[: d // 2], ring[: d // 2 - 1 : -1]
        ring[1:] = np.roll(ring[1:], 1)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (columns) of r, by falling value: rotations of pairs of columns until all are orthogonal."""
    d = r.shape[1]
    even = d + d % 2
    u = np.zeros((r.shape[0], even))
    u[:, :d] = r
    v = np.eye(even)
    for _ in range(MAX_SWEEPS):
        turned = False
        for p, q in _rounds(even):
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > np.finfo(float).eps * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            p, q, aa, bb, ab = p[turn], q[turn], aa[turn], bb[turn], ab[turn]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    lengths = np.sqrt((u * u).sum(0))[:d]
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:d, :d][:, order]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """Components of all vectors, at most ``components``.

    Directions without variance (to working precision) cannot be whitened and are none. Each component's largest entry is positive.
    """
    n, total = sums(vectors)
    d = len(total)
    if not n:
        return Fit(0, total, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    lengths, v = jacobi(triangular_factor(vectors, n, total))
    variance = lengths**2
    rank = int((lengths > lengths[0] * np.finfo(float).eps * max(d, 10)).sum()) if lengths[0] > 0 else 0
    k = min(components, rank)
    v = v[:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    return Fit(n, total, v, lengths[:k] / np.sqrt(n), variance[:k] / variance.sum() if k else np.zeros(0))


def _whitened(x: np.ndarray, by: Fit) -> np.ndarray:
    return _centred(x, by.n, by.sums) @ by.components / by.deviations


def identity_error(vectors: DataFrame, by: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity.

    Tasks sum products about their own means; the small table of their sums is put together about the common mean.
    """
    d, k = by.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if w := batch.num_rows:
                z = _whitened(_matrix(batch, d), by)
                mean = z.mean(0)
                products = (z - mean).T @ (z - mean)
                yield pa.record_batch([pa.array([w]), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], ["w", "mean", "products"])

    with scratch(vectors.sparkSession):
        parts = stored(vectors.filter(F.size("x") == d).select("x").mapInArrow(run, "w bigint, mean array<double>, products array<double>"), "whitened-sums")
        n = F.sum("w")
        mean = parts.select(*(F.sum(F.col("w") * F.col("mean")[i]) / n for i in range(k))).first()
        away = [F.col("mean")[i] - F.lit(mean[i]) for i in range(k)]
        spread = parts.select(
            *(F.sum(F.col("products")[i * k + j] + F.col("w") * away[i] * away[j]) / n for i in range(k) for j in range(k))
        ).first()
    return float(np.abs(np.array(spread).reshape(k, k) - np.eye(k)).max())


def _squares(z: np.ndarray) -> np.ndarray:
    """Sums of the squares of each row's integers, exact; beyond 64 bits an error."""
    if float(np.abs(z.astype(float)).max(initial=0)) ** 2 * z.shape[1] < _LONG / 2:
        return (z * z).sum(1)
    exact = [sum(int(v) ** 2 for v in row) for row in z]
    if max(exact) > _LONG:
        raise OverflowError("a deviation does not fit into 64 bits")
    return np.array(exact, np.int64)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null, NaN or infinite entries are left out, as are those whose length is not the most frequent one
    (of equally frequent lengths the greatest). Repeated rows and null ids stay, each row on its own. Equal eigenvalues take either order. No vectors, or vectors
    without any variance, give no rows; fewer dimensions than ``components`` fewer of them. Further columns are ignored.
    """
    vectors = integer_vectors(rows, vector)
    by = fit(vectors, components)
    d, k = by.components.shape
    if not k:
        return rows.sparkSession.createDataFrame([], RESULT)
    error = identity_error(vectors, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch, d), batch.num_rows
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, by.n, np.int64)),
                    pa.array(np.repeat(_squares(x * by.n - by.sums), k)),
                    pa.array(_whitened(x, by).ravel()),
                    pa.array(np.tile(by.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.filter(F.size("x") == d).mapInArrow(run, RESULT)

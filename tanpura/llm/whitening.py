"""Whitening of embeddings (13) by shifted CholeskyQR.

Entries become integers, x = floor(64 c) + 1000000. A first pass takes their number and exact sums. Then Gram passes: each
task sums Q'Q over its rows, where Q are the centred rows after triangular solves with the factors found so far; the
Cholesky factor of that sum is the next R. The first factor is of a shifted Gram matrix, so that it exists however badly
conditioned the rows are; the next ones repair what the shift and rounding left, until Q is orthonormal. The product of
the factors is the R of the centred rows; its singular values and right vectors give the variances and components.
The driver holds a few matrices of dimension x dimension; rows stay where they are and are never shuffled.

Rows of linearly dependent columns: a Gram matrix that has no Cholesky factor is shifted again, and its symmetric root is
composed at the end, so that directions without variance come out as 0; they are no components.

Defined cases: vectors that are null or hold null or non-finite entries are left out, and so are vectors of another length
than the most frequent one (of two, the shorter). Entries beyond 2^62 count as 2^62. Repeated rows and ids count each.
Without rows or without variance there are no components and the whitened arrays are empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanpura.llm.common import in_arrow, quoted, small_batches, stored

SCALE, OFFSET = 64, 1_000_000
#: Gram passes at most, and how far from orthonormal the last may find the rows.
PASSES, ORTHONORMAL = 6, 1e-12
#: Singular values below this share of the largest one are no components.
NO_VARIANCE = 1e-11
#: Tasks' sums are added in so many groups first.
SALTS = 64
#: Sums are exact as so many limbs of LIMB_BITS bits (the last has the rest).
LIMBS, LIMB_BITS = 3, 21


def integers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x array<long> of the vectors that count, written."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("c").cast(pa.list_(pa.float64()))
            at = np.asarray(column.offsets)
            c = column.values.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
            good = (bad[at[1:]] == bad[at[:-1]]) & np.asarray(column.is_valid())
            x = np.clip(np.floor(np.where(np.isfinite(c), c, 0) * SCALE), -(2.0**62), 2.0**62).astype(np.int64) + OFFSET
            yield pa.record_batch([batch.column("key"), pa.ListArray.from_arrays(column.offsets, pa.array(x))], names=["key", "x"]).filter(pa.array(good))

    rows = vectors.select(F.col(quoted(key)).alias("key"), F.col(quoted(vector)).alias("c")).where("c is not null")
    kind = rows.schema["key"].dataType.simpleString()
    made = stored(in_arrow(rows, run, f"key {kind}, x array<bigint>"), "whitening-rows")
    usual = made.groupBy(F.size("x").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return made.where(F.size("x") == (usual["size"] if usual else 0))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """A batch's rows as integers without OFFSET."""
    return np.asarray(batch.column("x").flatten()).reshape(-1, width) - OFFSET


def summed(rows: DataFrame, made: Callable[[pa.RecordBatch], np.ndarray], kind: type) -> np.ndarray | None:
    """The sum of made over all batches: by task, by SALTS groups of tasks, and at last. None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                new = made(batch)
                total = new if total is None else total + new
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([total.astype(kind).tobytes()])], names=["salt", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in table.column("sums").to_pylist())
        return pa.table({"salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(part, "salt int, sums binary")
    found = parts.groupBy("salt").applyInArrow(add, "salt int, sums binary").groupBy(F.col("salt") * 0).applyInArrow(add, "salt int, sums binary").first()
    return None if found is None else np.frombuffer(found["sums"], kind)


def limbs(x: np.ndarray) -> np.ndarray:
    """Counts of rows and column sums, exact for 2^40 rows: the number, then LIMBS parts of each column's sum."""
    parts = [(x >> (LIMB_BITS * i)) & ((1 << LIMB_BITS) - 1) for i in range(LIMBS - 1)] + [x >> (LIMB_BITS * (LIMBS - 1))]
    return np.concatenate([[len(x)], *(p.sum(axis=0) for p in parts)])


def solved(z: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """z after division by each upper triangular factor from the right."""
    for r in factors:
        q = np.empty_like(z)
        for j in range(len(r)):
            q[:, j] = (z[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        z = q
    return z


class Whitening:
    """What transform() needs: number of rows, exact sums (without OFFSET), components as columns, variances, and the total variance."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.width = n, sums, len(sums)
        self.mean = np.array([float(Fraction(s, max(n, 1))) for s in sums])
        self.components, self.variances, self.total = np.empty((self.width, 0)), np.empty(0), 0.0
        self.identity_error: float | None = None

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch, self.width) - self.mean

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return z @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over columns of (n x - S)^2, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if self.width * largest**2 < 1 << 62:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        made = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1) if self.width else [0] * len(x)
        return pa.array([v if v < 10**38 else None for v in made], pa.decimal128(38, 0))


def composed(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, width: int) -> np.ndarray:
    """The R factor of rows whose Gram matrix after division by some factors gram gives."""
    factors: list[np.ndarray] = []
    unit = np.finfo(np.float64).eps / 2
    for number in range(PASSES):
        g = gram(factors)
        shift = 11 * (n * width + width * (width + 1)) * unit * np.trace(g)
        off = np.abs(g - np.eye(width)).max()
        last = number + 1 == PASSES or number > 1 and off <= ORTHONORMAL
        try:
            if not number or last and off > 0.5:
                raise np.linalg.LinAlgError  # the first is always shifted
            r = np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            if last:
                high, v = np.linalg.eigh(g)
                r = np.sqrt(np.maximum(high, 0))[:, None] * v.T
            else:
                r = np.linalg.cholesky(g + max(shift if not number else unit * n * np.trace(g), np.finfo(np.float64).tiny) * np.eye(width)).T
        factors.append(r)
        if last:
            break
    whole = factors[0]
    for r in factors[1:]:
        whole = r @ whole
    return whole


def fit(rows: DataFrame, components: int) -> Whitening:
    """The whitening of rows as integers() gives them, with so many components at most."""
    first = rows.select(F.size("x").alias("size")).first()
    width = first["size"] if first else 0
    found = summed(rows, lambda batch: limbs(matrix(batch, width)), np.int64) if width else None
    if found is None:
        return Whitening(rows.count(), [0] * width)
    parts = found[1:].reshape(LIMBS, width).tolist()
    model = Whitening(int(found[0]), [sum(p[j] << (LIMB_BITS * i) for i, p in enumerate(parts)) for j in range(width)])

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def made(batch: pa.RecordBatch) -> np.ndarray:
            q = solved(model.centred(batch), factors)
            return q.T @ q

        return summed(rows, made, np.float64).reshape(width, width)

    _, values, vectors = np.linalg.svd(composed(gram, model.n, width))
    many = min(components, int((values > max(values[0] * NO_VARIANCE, 0)).sum()))
    chosen = vectors[:many].T
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), range(many)] < 0, -1, 1)
    model.components, model.variances, model.total = chosen, values[:many] ** 2 / model.n, float((values**2).sum() / model.n)

    def square(batch: pa.RecordBatch) -> np.ndarray:
        w = np.hstack([model.whitened(model.centred(batch)), np.ones((batch.num_rows, 1))])
        return w.T @ w

    if many:
        sums = summed(rows, square, np.float64).reshape(many + 1, many + 1) / model.n
        covariance = sums[:many, :many] - np.outer(sums[many, :many], sums[many, :many])
        model.identity_error = float(np.abs(covariance - np.eye(many)).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation decimal(38,0) (null beyond that) and whitened array<double>, a number for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.whitened(model.centred(batch))
            at = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.int32())
            yield pa.record_batch([batch.column("key"), model.deviations(matrix(batch, model.width)), pa.ListArray.from_arrays(at, pa.array(made.ravel()))], names=["key", "deviation", "whitened"])

    return in_arrow(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def whitened_rows(vectors: DataFrame, components: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: key, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    deviation is a long; where it is too large for one it is null (transform() has it as a decimal).
    """
    rows = integers(vectors, vector, key)
    model = fit(rows, components)
    shares = F.array(*(F.lit(float(v / model.total)) for v in model.variances)) if len(model.variances) else F.array().cast("array<double>")
    made = transform(rows, model).select(F.col("key").alias(key), F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("component", "whitened"))
    return made.select(
        F.col(quoted(key)), (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )

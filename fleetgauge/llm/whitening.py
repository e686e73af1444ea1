"""Whitening of embeddings by their leading principal components.

Vectors become whole numbers, and each different one counts once. The covariance matrix is never made: a
solver asks for its products with narrow blocks, and each product is one pass of Spark over the vectors,
centred before they are multiplied. A task's sums leave it as one row, and a few tasks add those up.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import pinned
from fleetgauge.llm.jacobi_davidson import largest_pairs

#: Steps in which a unit of an embedding is counted, and components.
STEPS_PER_UNIT, COMPONENTS = 256, 4
#: Numbers that fit in two bytes are kept in two.
NARROW, WIDE = "<i2", "<i8"
LONG = 1 << 63
#: Tasks that add up what the others have summed.
ADDERS = 8


@dataclass(frozen=True)
class Centre:
    """The mean of the different vectors, as whole numbers `low` and the rest `over` in n-ths, so that it is exact."""

    n: int
    low: list[int]
    over: list[int]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, [s // n for s in sums], [s % n for s in sums])

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """Rows less `low`, exact: Python's integers where 64 bits might not do."""
        if x.dtype.str == NARROW and max(map(abs, self.low)) < 1 << 40:
            return x.astype(np.int64) - np.array(self.low, np.int64)
        return x.astype(object) - np.array(self.low, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(float) - np.array([o / self.n for o in self.over])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum)^2 of each row, exact; null beyond a long."""
        off, over = self.offsets(x), np.array(self.over, object)
        if off.dtype != object and max(self.over) < 1 << 40:
            # |off| < 2^41 would need a bound on its square too: narrow rows near their mean are below 2^17.
            close = np.abs(off).max(initial=0) < 1 << 20
            off, over = (off, over.astype(np.int64)) if close else (off.astype(object), over)
        else:
            off = off.astype(object)
        squares, mixed = (off * off).sum(axis=1).astype(object), (off * over).sum(axis=1).astype(object)
        total = squares * self.n**2 - mixed * (2 * self.n) + sum(o * o for o in self.over)
        return [int(t) if t < LONG else None for t in total]


def _matrix(rows: pa.BinaryArray, kind: str, dims: int) -> np.ndarray:
    """The vectors of a column of equally long byte strings."""
    if not len(rows):
        return np.empty((0, dims), kind)
    begin = rows.offset
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[begin : begin + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, dims)


def _matrices(batch: pa.RecordBatch, dims: int):
    """(places in the batch, vectors) of the narrow rows and of the wide ones."""
    wide = batch.column("wide")
    for kind, own in ((NARROW, pc.invert(wide)), (WIDE, wide)):
        x = _matrix(batch.column("x").cast(pa.binary()).filter(own), kind, dims)
        if len(x):
            yield np.flatnonzero(own.to_numpy(zero_copy_only=False)), x


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(vec_id, dims, wide, x) of rows of vec_id and embedding (array of doubles) without nulls or non-finite entries.

    x holds floor(256 * c) of each entry c as little-endian integers of two bytes, or of eight if `wide`.
    """
    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            vectors = batch.column(1)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = vectors.flatten()
            empty = entries.is_null().to_numpy(zero_copy_only=False)
            entries = entries.fill_null(0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            bad = np.append(0, np.cumsum(empty | ~np.isfinite(entries)))
            good = (bad[ends] == bad[ends - lengths]) & (lengths > 0)
            for dims in np.unique(lengths[good]):
                own = np.flatnonzero(good & (lengths == dims))
                with np.errstate(over="ignore"):
                    steps = np.floor(entries[(ends[own] - dims)[:, None] + np.arange(dims)] * STEPS_PER_UNIT)
                far = np.abs(steps) >= 1 << 15
                wide = far.any(axis=1)
                # Beyond a long, the nearest long, as in Spark's floor.
                top = steps >= float(LONG)
                x = np.where(top, 0, np.clip(steps, -float(LONG), None)).astype(np.int64)
                x[top] = LONG - 1
                packed = [(r.astype(WIDE) if w else r.astype(NARROW)).tobytes() for r, w in zip(x, wide)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.array(np.full(len(own), dims, np.int32)), pa.array(wide), pa.array(packed, pa.binary())],
                    ["vec_id", "dims", "wide", "x"],
                )

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {id_type}, dims int, wide boolean, x binary")


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each entry over all vectors."""
    def out(total):
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(int(t)) for t in total]], pa.list_(pa.decimal128(38, 0)))], ["total"])

    def run(batches):
        total = np.zeros(dims, object)
        for batch in batches:
            for _, x in _matrices(batch, dims):
                total += x.astype(np.int64).sum(axis=0).astype(object) if x.dtype.str == NARROW else x.astype(object).sum(axis=0)
        yield from out(total)

    def add(batches):
        total = np.zeros(dims, object)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.array([int(t) for t in part], object)
        yield from out(total)

    parts = fit.select("wide", "x").mapInArrow(run, "total array<decimal(38,0)>")
    rows = parts.repartition(ADDERS).mapInArrow(add, "total array<decimal(38,0)>").collect()
    return [sum(int(r["total"][i]) for r in rows) for i in range(dims)]


def _added(fit: DataFrame, dims: int, centre: Centre, of, length: int) -> np.ndarray:
    """The sum of of(centred vectors), a flat array of `length` numbers, over all vectors."""
    def run(batches):
        total = np.zeros(length)
        for batch in batches:
            for _, x in _matrices(batch, dims):
                total += of(centre.centred(x))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(batches):
        total = np.zeros(length)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = fit.select("wide", "x").mapInArrow(run, "total binary")
    # ADDERS rows, however many tasks there were.
    rows = parts.repartition(ADDERS).mapInArrow(add, "total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in rows), np.zeros(length))


def fit_list(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(the different vectors of the most frequent length, that length, their number); of equally frequent ones the greatest."""
    fit = pinned(rows.select("dims", "wide", "x").distinct(), "vectors")
    most = fit.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims, n = (most["dims"], most["n"]) if most else (0, 0)
    return fit.where(F.col("dims") == dims), dims, n


def whitened(vectors: DataFrame, id_col="vec_id", vector_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row of `vectors` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Left out are rows whose vector is null, empty, holds a null or non-finite entry, or has another length than
    most different vectors (of equally frequent lengths the greatest stays). Entries become floor(256 * c), at
    most what a long holds. Mean and covariance are over the different vectors, n of them; repeated rows and
    null ids are rows of their own. Components have falling variances; there are as many as vectors have
    entries at most, and those without variance, to double precision, are left out: no rows if all vectors are
    equal, or for an empty table. `deviation` is exact, and null where a long can't hold it.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")))
    out_type = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit, dims, n = fit_list(rows)
    if not n:
        return spark.createDataFrame([], out_type)
    centre = Centre.of(n, _sums(fit, dims))
    trace = float(_added(fit, dims, centre, lambda c: np.array([np.einsum("ij,ij->", c, c)]), 1)[0]) / n

    def product(block):
        return _added(fit, dims, centre, lambda c: (c.T @ (c @ block)).ravel(), block.size).reshape(block.shape) / n

    values, directions = largest_pairs(product, dims, components)
    real = values > dims * np.finfo(float).eps * trace
    values, directions = values[real], directions[:, real]
    k = len(values)
    if not k:
        return spark.createDataFrame([], out_type)
    weights = directions / np.sqrt(values)

    def moments(c):
        z = c @ weights
        return np.append(z.sum(axis=0), z.T @ z)

    sums = _added(fit, dims, centre, moments, k + k * k) / n
    identity_error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for places, x in _matrices(batch, dims):
                z = centre.centred(x) @ weights
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(places, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(z.ravel()),
                    pa.array(np.tile(values / trace, len(x))),
                    pa.array(np.full(len(x) * k, identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.col("dims") == dims).select("vec_id", "wide", "x").mapInArrow(run, out_type)

"""Whitening of embeddings: moments merged pairwise, eigenvectors on the driver, the identity verified by a second pass.

1. Each partition computes count, exact sums, local mean and the scatter about
   that mean; two parts merge by Chan's formula in treeReduce, so nothing large
   minus something large is ever taken.  A part is d x d numbers, and about
   FAN of them meet in one place, whatever the number of partitions.
2. The driver takes the eigenvectors of the d x d covariance.
3. A second pass merges the moments of the whitened vectors in the same way:
   how far their covariance lies from the identity.

Edge cases: a null vector, or one with a null, NaN or infinite entry, is
dropped; so are vectors of another length than most have (ties: the longer
one), and empty ones.  With ``grid``, entries become floor(scale * c) + shift, held within
2**52 on either side.  A component without variance (one row, equal rows,
linearly dependent entries) has a null ``whitened`` and does not count in
identity_error, which is null where no component has variance; ``explained``
is null where nothing varies; a deviation past 64 bits is null.  Repeated rows
and ids count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: Entries become floor(1024 * c) + 100000.
GRID = (1024, 100_000)
FAN = 8
ROWS = 4096
#: A component varies if its variance is more than this part of the total.
NOTHING = 1e-12
LARGEST = float(1 << 52)


@dataclass
class Moments:
    """Of vectors of one length: how many, exact sums (on a grid; else None), mean, scatter about the mean."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        sums = None if self.sums is None or other.sums is None else [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, sums, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n)))


def moments(x: np.ndarray) -> Moments:
    """Of the rows of ``x`` (float, or int where they lie on a grid)."""
    mean = x.mean(axis=0)
    apart = x - mean
    off = apart.mean(axis=0)  # what rounding left of the mean
    apart -= off
    return Moments(len(x), None if x.dtype.kind == "f" else [int(v) for v in x.sum(axis=0, dtype=object)], mean + off, apart.T @ apart)


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Moments by length of vector."""
    return a | {d: a[d].merge(m) if d in a else m for d, m in b.items()}


def vectors(column: pa.Array, grid: tuple[int, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which rows of an array<double> column are usable, and their entries, for each length and about ROWS rows."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        size = np.diff(part.offsets.to_numpy())
        flat = part.flatten() if part.null_count else part.values.slice(part.offsets[0].as_py(), int(size.sum()))
        if part.null_count:
            size = np.where(part.is_null().to_numpy(zero_copy_only=False), 0, size)
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
        begin = np.cumsum(size) - size
        for d in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == d)
            x = values[begin[rows][:, None] + np.arange(d)]
            fine = np.isfinite(x).all(axis=1)
            rows, x = rows[fine], x[fine]
            if len(rows):
                yield at + rows, x if grid is None else np.clip(np.floor(x * grid[0]) + grid[1], -LARGEST, LARGEST).astype(np.int64)


def _column(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("vector"))


def gather(df: DataFrame, vector: str, grid: tuple[int, int] | None, turned: np.ndarray | None = None, centre: np.ndarray | None = None) -> dict[int, Moments]:
    """Moments of all usable vectors by length, or of (x - centre) @ turned for those of the centre's length."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for _, x in vectors(batch.column(0), grid):
                if turned is not None:
                    if x.shape[1] != len(centre):
                        continue
                    x = (x - centre) @ turned
                held = merged(held, {x.shape[1]: moments(x)})
        sums = [None if m.sums is None else [str(v) for v in m.sums] for m in held.values()]
        arrays = [np.concatenate([m.mean[None], m.scatter]).tobytes() for m in held.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([m.n for m in held.values()], pa.int64()), pa.array(sums, pa.list_(pa.string())), pa.array(arrays, pa.binary())], ["d", "n", "sums", "numbers"]
        )

    def read(row) -> dict[int, Moments]:
        numbers = np.frombuffer(bytes(row.numbers), np.float64).reshape(row.d + 1, row.d)
        return {row.d: Moments(row.n, None if row.sums is None else [int(v) for v in row.sums], numbers[0], numbers[1:])}

    parts = _column(df, vector).mapInArrow(part, "d long, n long, sums array<string>, numbers binary").rdd
    tasks, depth = parts.getNumPartitions(), 2
    if not tasks:
        return {}
    while FAN**depth < tasks:
        depth += 1
    # one value for each partition, an empty one included, so that the tree is never empty
    return parts.mapPartitions(lambda rows: iter([reduce(merged, map(read, rows), {})])).treeReduce(merged, depth)


@dataclass
class Whitening:
    """What whitens vectors of length d: n, exact sums, mean, components (d x k, unit columns), their variances, and the total variance."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total: float

    @property
    def varies(self) -> np.ndarray:
        return self.variance > NOTHING * self.total

    @property
    def turned(self) -> np.ndarray:
        """The components over their standard deviations; NaN where nothing varies."""
        return self.components / np.sqrt(np.where(self.varies, self.variance, np.nan))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, grid: tuple[int, int] | None = None) -> Whitening | None:
    """The whitening of all usable vectors; None where there are none."""
    found = gather(df, vector, grid)
    if not found:
        return None
    m = found[max(found, key=lambda d: (found[d].n, d))]
    values, columns = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:components]
    mean = m.mean if m.sums is None else np.array([s / m.n for s in m.sums])
    return Whitening(m.n, m.sums, mean, columns[:, order], np.maximum(values[order], 0.0), float(np.trace(m.scatter) / m.n))


def verify(df: DataFrame, model: Whitening, vector: str = "embedding", grid: tuple[int, int] | None = None) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; None where nothing varies."""
    turned = model.turned[:, model.varies]
    if not turned.shape[1]:
        return None
    m = gather(df, vector, grid, turned, model.mean)[turned.shape[1]]
    return float(np.abs(m.scatter / m.n - np.eye(turned.shape[1])).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, grid: tuple[int, int] | None = None) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over entries of (n * x - S)**2, exact on a grid and null without one.
    """
    model = fit(df, vector, components, grid)
    error = None if model is None else verify(df, model, vector, grid)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, k = model.turned, len(model.variance)
        explained = pa.array(model.variance / model.total if model.total > 0 else np.full(k, np.nan), pa.float64(), from_pandas=True)
        for batch in batches:
            for rows, x in vectors(batch.column(1), grid):
                if x.shape[1] != len(model.mean):
                    continue
                each = np.repeat(np.arange(len(rows)), k)
                turn = np.tile(np.arange(k), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)).take(pa.array(each)),
                        pa.array((turn + 1).astype(np.int32)),
                        pa.array(np.full(len(each), model.n)),
                        deviations(x, model).take(pa.array(each)),
                        pa.array(((x - model.mean) @ turned).reshape(-1), from_pandas=True),
                        explained.take(pa.array(turn)),
                        pa.array([error] * len(each), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, schema)


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """For each row the sum over entries of (n * x - S)**2, exact; null past 64 bits, or without a grid."""
    if model.sums is None:
        return pa.nulls(len(x), pa.int64())
    rough = ((x - model.mean) * float(model.n)) ** 2
    small = (rough.sum(axis=1) < 9.2e18) & (np.abs(x).max(axis=1) * float(model.n) < 9e18) if max(map(abs, model.sums)) < 9e18 else np.zeros(len(x), bool)
    out = np.zeros(len(x), dtype=object)
    if small.any():
        apart = x[small] * np.int64(model.n) - np.array(model.sums, dtype=np.int64)
        out[small] = (apart * apart).sum(axis=1)
    for i in np.flatnonzero(~small).tolist():
        exact = sum((model.n * v - s) ** 2 for v, s in zip(x[i].tolist(), model.sums, strict=True))
        out[i] = exact if exact < 1 << 63 else None
    return pa.array(out.tolist(), pa.int64())

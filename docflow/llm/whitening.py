"""Whitening embeddings on their leading components, found by FEAST contour integration.

The covariance comes from two passes of Spark over the vectors.  Its eigenvalues in an interval are found by integrating
the resolvent along a circle around it: the sum over the nodes of a Gauss-Legendre rule of solves with complex shifts
projects a block of vectors onto the wanted eigenvectors, Rayleigh-Ritz extracts them, and the block goes round again until
the residuals are at rounding level.  Inertia counts (signs of the blocks of L D L^T) choose the interval and verify that
none was missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docflow.llm.common import written

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this cannot become whole numbers exactly and count as not finite.
LARGEST = float(1 << 42)
NODES, ROUNDS = 16, 60


# Eigenvalues in an interval ---------------------------------------------------------------------------------------


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above `shift`: positive ones of D in L D L^T, with the largest
    entry of what is left as the pivot (two rows where it stands off the diagonal)."""
    left = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(left):
        size = len(left)
        largest = np.abs(left)
        i, j = divmod(int(largest.argmax()), size)
        on = int(largest.diagonal().argmax())
        if largest[i, j] == 0:
            break
        own = [on] if largest[on, on] >= 0.64 * largest[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(size), own)
        block = left[np.ix_(own, own)]
        # A pivot of two rows has a negative determinant: one eigenvalue on either side.
        above += 1 if len(own) == 2 else int(block[0, 0] > 0)
        side = left[np.ix_(rest, own)]
        left = left[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        left = (left + left.T) / 2
    return above


def interval(matrix: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, how many): the narrowest interval from above all eigenvalues down to a gap below the wanted ones.

    Where the last wanted eigenvalue and the next cannot be told apart, the whole cluster is inside.
    """
    reach = np.abs(matrix).sum(axis=1).max()
    high, low = reach * 1.01, -reach * 1.01
    inside, outside = low, high  # counts of at least, and below, `wanted`
    while outside - inside > 1e-12 * reach:
        middle = (inside + outside) / 2
        if inertia(matrix, middle) >= wanted:
            inside = middle
        else:
            outside = middle
    # `inside` is the last wanted eigenvalue from below; go down to the middle of the gap below its cluster.
    last, held = inside, inertia(matrix, inside)
    top, bottom = last, low
    while top - bottom > 1e-12 * reach and held < len(matrix):
        middle = (top + bottom) / 2
        if inertia(matrix, middle) == held:
            top = middle
        else:
            bottom = middle
    below = (last + top) / 2 if held < len(matrix) else last - 0.05 * (high - last) - 1e-6 * reach
    # The upper end close above the largest eigenvalue keeps the circle small.
    top, bottom = high, last
    while top - bottom > 1e-3 * (top - below):
        middle = (top + bottom) / 2
        top, bottom = (middle, bottom) if inertia(matrix, middle) == 0 else (top, middle)
    return below, top + 0.02 * (top - below), held


def feast(matrix: np.ndarray, low: float, high: float, expected: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `expected` eigenvalues of a symmetric matrix in (low, high), falling, and their unit eigenvectors.

    Raises ArithmeticError where the interval does not give as many as its inertia counts say.
    """
    size = len(matrix)
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (1 + x) / 2)
    middle, radius = (low + high) / 2, (high - low) / 2
    scale = np.abs(matrix).sum(axis=1).max()
    block = np.random.default_rng(seed).normal(size=(size, min(size, 2 * expected + 8)))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    since = 0
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for z, w in zip(turn, weights, strict=True):
            shifted = (middle + radius * z) * np.eye(size) - matrix
            projected += 0.5 * w * np.real(radius * z * np.linalg.solve(shifted, block))
        basis, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ inner
        within = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(within) == expected:
            residual = np.linalg.norm(matrix @ block[:, within] - block[:, within] * values[within], axis=0).max()
            if best is None or residual < best[0]:
                best, since = (residual, values[within], block[:, within]), 0
            else:
                since += 1
            # At rounding level the residual stops falling.
            if since >= 2 and best[0] < 1e-12 * scale:
                break
    if best is None or best[0] > 1e-9 * scale:
        raise ArithmeticError("the contour did not give all eigenvalues of its interval")
    return best[1], best[2]


def leading(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above rounding level, `components` at most, and their unit eigenvectors as columns."""
    scale = np.abs(covariance).sum(axis=1).max() if len(covariance) else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    present = inertia(covariance, scale * len(covariance) * 1e-14)
    wanted = min(components, present)
    low, high, held = interval(covariance, wanted)
    values, vectors = feast(covariance, low, high, held)
    return values[:wanted], vectors[:, :wanted]


# Moments by Spark ---------------------------------------------------------------------------------------------------


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """A column of lists of equal size as a matrix."""
    flat = np.asarray(column.flatten(), dtype=kind)
    return flat.reshape(len(column), -1)


def _wholes(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * _rows(column, np.float64)).astype(np.int64) + SHIFT


def _sums(value):
    """One row (at, total) for every entry of the task's sum of `value` over batches, and one (-1, rows)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                own = value(batch.column(0)).ravel()
                total = own if total is None else total + own
                n += batch.num_rows
        if n:
            places = pa.array(np.arange(-1, len(total)), pa.int64())
            numbers = np.concatenate([[n], total]).astype(total.dtype)
            yield pa.RecordBatch.from_arrays([places, pa.array(numbers)], ["at", "total"])

    return sums


def _collect(df: DataFrame, value, kind: str) -> tuple[int, np.ndarray]:
    """Number of rows, and the sum of `value` over all of them: as many numbers as one row's value has reach the driver."""
    spec = f"at long, total {kind}"
    parts = df.mapInArrow(_sums(value), spec).groupBy("at").agg(F.sum("total").alias("total"))
    found = dict(map(tuple, parts.collect()))
    n = int(found.pop(-1, 0))
    return n, np.array([found[i] for i in range(len(found))], dtype=np.int64 if kind == "long" else np.float64)


def covariance(df: DataFrame, as_rows, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of the rows that `as_rows` makes of the only column, centred before multiplying."""

    def products(column: pa.Array) -> np.ndarray:
        centred = as_rows(column) - mean
        return centred.T @ centred

    size = len(mean)
    found = _collect(df, products, "double")[1].reshape(size, size) / n
    return (found + found.T) / 2


def _whiten(sums: np.ndarray, n: int, vectors: np.ndarray, schema: pa.Schema):
    exact = schema.field("deviation").type

    def squares(apart: np.ndarray) -> pa.Array:
        if apart.shape[1] * float(np.abs(apart).max(initial=0)) ** 2 < 2.0**62:
            return pa.array((apart**2).sum(axis=1)).cast(exact)
        return pa.array([Decimal(sum(v * v for v in row)) for row in apart.tolist()], exact)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _wholes(batch.column(1))
            projected = (x - sums / n) @ vectors
            deviation = squares(n * x - sums)
            offsets = pa.array(np.arange(len(x) + 1) * vectors.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(projected.ravel())).cast(schema.field("whitened").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], schema=schema)

    return whiten


def usable(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, embedding (array of doubles) of rows with a vector whose entries are all there, finite and within LARGEST.

    Where lengths differ, those of the commonest length (of two as common, the longer one) take part.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    rows = rows.where((F.size("embedding") > 0) & whole)
    length = F.size("embedding").alias("length")
    found = rows.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("embedding") == (found["length"] if found else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", components: int = 8) -> DataFrame:
    """id, component (from 1), n, deviation (exact), whitened, explained, identity_error per usable row and component.

    Entries c stand for floor(1024 * c) + 100000.  Rows whose vector is null, empty or not usable (see `usable`) are
    dropped; repeated rows and null ids count and keep their rows.  Directions in which all vectors agree to rounding
    level are no components, so equal vectors, one vector or none give no rows.  Of equal eigenvalues any orthonormal
    eigenvectors are taken, the same for all rows.  The covariance of d entries, d * d numbers, is solved on the driver.
    """
    rows = usable(vectors, id_col, embedding)
    only = rows.select("embedding")
    n, sums = _collect(only, lambda column: _wholes(column).sum(axis=0), "long")
    matrix = covariance(only, _wholes, sums / n, n) if n else np.zeros((0, 0))
    values, directions = leading(matrix, components)
    kind = rows.schema["id"].dataType.simpleString()
    spec = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    if not len(values):
        none = rows.select("id").limit(0)
        empty = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return none.select("id", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    scaled = directions / np.sqrt(values)
    schema = to_arrow_schema(StructType.fromDDL(spec))
    white = written(rows.mapInArrow(_whiten(sums, n, scaled, schema), spec), "whitened")

    own = white.select("whitened")
    as_rows = lambda column: _rows(column, np.float64)
    middle = _collect(own, lambda column: as_rows(column).sum(axis=0), "double")[1] / n
    error = float(np.abs(covariance(own, as_rows, middle, n) - np.eye(len(values))).max())
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(matrix)])
    return white.select("id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "id",
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("_at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )

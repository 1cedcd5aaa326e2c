"""Whitening of embeddings by LOBPCG on distributed covariance products.

An entry c of a vector becomes the integer floor(scale * c) + shift; the fit list
is each distinct integer vector once. Its covariance is never made as a matrix
of its own accord: each round multiplies it with a block of columns by one pass
over the rows, y' (y q) / n for rows y centred before multiplying. The block is an
orthonormal basis of the iterate, its residuals and the previous directions
(locally optimal block preconditioned conjugate gradients, without a
preconditioner); Rayleigh and Ritz give the next iterate. Rounds end when the
residuals of the wanted components, relative to the largest eigenvalue, are
below ``TOLERANCE``, or when the basis spans the whole space. A last pass
certifies: it takes products with the components themselves, and the covariance
of the whitened rows.

Scale: a task sums its rows into one block of dimensions x columns, summed by an
ordinary aggregation; only such blocks reach the driver, their size set by the
dimensions alone. The fit list is a written table with one row for any number of
copies. Integer sums are exact, so centring doesn't depend on the partitions.

Defined results: vectors that are null, empty or hold null or non-finite
entries, or entries whose scaled value doesn't fit into a long, take no part,
nor do those whose length isn't that of most distinct vectors (ties: the longer).
Every other row has a result, rows of one id and a null id too. Components whose
eigenvalue is below ``RANK`` of the largest carry no variance and are left out, so
a table with one distinct vector gives no rows, like an empty one. A deviation
beyond a long is null. Equal eigenvalues have any basis of their space, the same
for all rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch, tidy

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns beside the wanted ones, which speed up the last of these.
GUARD = 8
#: Residuals at which rounds end, and those that are accepted where rounding lets them fall no further, both relative to the largest eigenvalue.
TOLERANCE, ACCEPTED = 1e-13, 1e-11
MAX_ROUNDS = 500
#: Least eigenvalue of a component, relative to the largest.
RANK = 1e-11


@dataclass
class Whitening:
    """Mean (sums / n, exact), unit components as columns, eigenvalues, and what certifies them."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    rounds: int


def integer_vectors(df: DataFrame, vec_col: str, scale: int = SCALE, shift: int = SHIFT):
    """(valid rows of ``df``, their integer vector as an expression)."""
    v = F.col(vec_col).cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < 2.0**62))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fits), F.transform(v, lambda c: F.floor(c * float(scale)) + F.lit(shift).cast("long"))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The vectors of a batch, all of one length, as rows of int64."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.empty((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (-1) and exact sums by dimension of a task."""
    n, total = 0, None
    for batch in batches:
        x = _matrix(batch)
        if not len(x):
            continue
        small = float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62
        part = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
        n, total = n + len(x), part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["dim", "total"])


class _Centre:
    """Rows less their mean. The whole part is subtracted as an integer, so nothing cancels in floating point."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 of each row, exact; None beyond a long."""
        apart = x - self.whole
        most = float(np.abs(apart.astype(float)).max(initial=0)) + 1
        if most * most * self.n * self.n * x.shape[1] < 2.0**62:
            d = self.n * apart - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * apart.astype(object) - np.array(self.rest, object)
        return [v if v < 2**63 else None for v in (d * d).sum(axis=1)]


def _cells(*blocks: np.ndarray) -> pa.RecordBatch:
    """Blocks as rows (block, i, j, v)."""
    at = [np.indices(b.shape).reshape(2, -1) for b in blocks]
    names = np.repeat(np.arange(len(blocks)), [b.size for b in blocks])
    i, j = np.concatenate(at, axis=1)
    columns = [names.astype(np.int32), i.astype(np.int32), j.astype(np.int32), np.concatenate([b.ravel() for b in blocks])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "i", "j", "v"])


def _summed(rows: DataFrame, blocks: Callable[[np.ndarray], list[np.ndarray]], shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The blocks that ``blocks`` makes of the integer rows of a batch, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = blocks(_matrix(batch))
                total = part if total is None else [t + p for t, p in zip(total, part)]
        if total is not None:
            yield _cells(*total)

    cells = rows.mapInArrow(tidy(run), "block int, i int, j int, v double").groupBy("block", "i", "j").agg(F.sum("v").alias("v"))
    found = cells.toPandas()
    out = [np.zeros(s) for s in shapes]
    for k, block in enumerate(out):
        own = found[found["block"] == k]
        block[own["i"], own["j"]] = own["v"]
    return out


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks, those of the first block first; dependent directions of later ones are left out."""
    q = np.linalg.qr(blocks[0])[0]
    for block in blocks[1:]:
        size = np.linalg.norm(block, axis=0)
        b = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            b = b - q @ (q.T @ b)
        if not b.size:
            continue
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        u = u[:, s > 1e-7][:, : len(q) - q.shape[1]]
        if u.size:
            q = np.hstack([q, np.linalg.qr(u - q @ (q.T @ u))[0]])
    return q


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, falling; unit eigenvectors as columns; rounds) of a symmetric positive matrix that is
    known by its products with blocks. Raises where residuals above ``ACCEPTED`` fall no further."""
    size = min(dims, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(dims, size)))[0]
    best, stalled = np.inf, 0
    for rounds in range(1, MAX_ROUNDS + 1):
        vq = product(q)
        h = q.T @ vq
        e, c = np.linalg.eigh((h + h.T) / 2)
        e, c = e[::-1][:size], c[:, ::-1][:, :size]
        x, residual = q @ c, vq @ c - (q @ c) * e
        apart = np.linalg.norm(residual[:, :wanted], axis=0).max() / max(e[0], np.finfo(float).tiny)
        best, stalled = (apart, 0) if apart < best / 2 else (best, stalled + 1)
        if apart <= tolerance or q.shape[1] == dims or e[0] <= 0 or (stalled > 20 and apart <= ACCEPTED):
            return e[:wanted], x[:, :wanted], rounds
        q = _basis(x, residual, q[:, size:] @ c[size:])
    raise RuntimeError(f"residuals stay at {best:.1e} of the largest eigenvalue")


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of a table of vectors; None where no vector is valid."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows, x = integer_vectors(vectors, vec_col, scale, shift)
    fitted = scratch.write(rows.select(x.alias("x")).distinct(), "distinct")
    length = fitted.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    d = length["d"]
    fitted = fitted.where(F.size("x") == d)
    totals = fitted.mapInArrow(tidy(_sums), "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r["dim"]: int(r["total"]) for r in totals.collect()}
    n, sums = totals[-1], [totals[i] for i in range(d)]
    centre = _Centre(n, sums)

    def product(q: np.ndarray) -> np.ndarray:
        def blocks(x: np.ndarray) -> list[np.ndarray]:
            y = centre(x)
            return [y.T @ (y @ q)]

        return _summed(fitted, blocks, [q.shape])[0] / n

    e, u, rounds = lobpcg(product, d, min(components, d))
    kept = e > RANK * max(e[0], np.finfo(float).tiny)
    e, u = e[kept], u[:, kept]
    to_white = u / np.sqrt(e)

    def certify(x: np.ndarray) -> list[np.ndarray]:
        y = centre(x)
        z = y @ to_white
        return [y.T @ (y @ u), z.T @ z, z.sum(axis=0)[None, :], np.array([[(y * y).sum()]])]

    k = len(e)
    vu, zz, zs, total = _summed(fitted, certify, [(d, k), (k, k), (1, k), (1, 1)])
    scratch.keep_only()
    white = zz / n - (zs.T / n) @ (zs / n)
    error = float(np.abs(white - np.eye(k)).max(initial=0.0))
    return Whitening(n, sums, u, e, float(total[0, 0]) / n, np.linalg.norm(vu / n - u * e, axis=0), error, rounds)


def transform(vectors: DataFrame, found: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, deviation, whitened (array, one entry a component) for every valid row."""
    centre, to_white, k = _Centre(found.n, found.sums), found.components / np.sqrt(found.eigenvalues), len(found.eigenvalues)
    rows, x = integer_vectors(vectors, vec_col, scale, shift)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == len(found.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            z = centre(x) @ to_white
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(centre.deviation(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(tidy(run), "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each valid row and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual.

    ``residual`` is the certified norm of V u - e u relative to the largest eigenvalue."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    found = fit(vectors, vec_col, components, scale, shift)
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    facts = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("component"))
    out = transform(vectors, found, id_col, vec_col, scale, shift)
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return out.select(
        "vec_id",
        "component",
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        facts(found.eigenvalues / found.trace).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
        facts(found.residuals / found.eigenvalues[0]).alias("residual"),
    )

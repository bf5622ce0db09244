"""Embedding whitening by matrix-free block Lanczos.

Entries become integers ``floor(64 * c)``, so that counts, sums and deviations
are exact. The covariance of the distinct vectors is never formed: each step
sends a block of at most ``BLOCK`` directions to all tasks, which centre their
rows and return their part of X'Xv, a table of dimensions times directions. The
basis is reorthogonalised in full, twice; directions that break down are
started anew at random, and a basis that gets too large is restarted from its
Ritz vectors. The steps end when the residuals of all wanted pairs are at
rounding level, or when the basis spans the whole space.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import shared_dir
from sparkloom.shipping import ship

SCALE = 64
COMPONENTS = 16
BLOCK = 16
#: Residual against the largest eigenvalue at which a pair has converged.
TOLERANCE = 1e-14
#: Columns of the basis before it is restarted from its Ritz vectors.
BASIS = 512
STEPS = 400
#: Eigenvalues under this share of the largest are zero up to rounding, and have no component.
RANK = 1e-12
#: Scaled entries are held within this bound, so that differences of integers cannot overflow.
MOST = 1 << 60

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """A fitted transform: exact centre (``total / n``), components in columns, eigenvalues and their shares of the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _split(self.total, self.n)


def _split(total: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole part of the mean, and the rest of the sum: ``total = n * whole + rest``."""
    return np.array([t // n for t in total], np.int64), np.array([t % n for t in total], np.int64)


def scaled(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, y): the integer vectors of the rows whose entries are all there and finite."""
    c = F.col(vector)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    bound = lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v.cast("double") * F.lit(float(SCALE))))
    return df.where(whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(bound(v)).cast("long")).alias("y"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _table(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(values.size, dtype=np.int64)), pa.array(values.ravel())], ["at", "value"])


def _sums(width: int):
    """Sums of each dimension in two halves, so that no partial sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            y = _matrix(batch.column("y"), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int64)), pa.array((y >> 32).sum(axis=0)), pa.array((y & 0xFFFFFFFF).sum(axis=0))], ["at", "high", "low"]
            )

    return run


def _products(whole: np.ndarray, rest: np.ndarray, n: int, directions: np.ndarray):
    """Each task's part of X'Xv for all directions, and of the sum of squares behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(directions.shape), 0.0
        for batch in _chunks(batches):
            x = (_matrix(batch.column("y"), len(whole)) - whole) - rest / n
            total += x.T @ (x @ directions)
            squares += float((x * x).sum())
        yield _table(np.append(total.ravel(), squares))

    return run


def _moments(whole: np.ndarray, rest: np.ndarray, n: int, project: np.ndarray):
    """Each task's sums of whitened rows and of their products."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in _chunks(batches):
            w = ((_matrix(batch.column("y"), len(whole)) - whole) - rest / n) @ project
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield _table(total)

    return run


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The tasks' tables added up in Spark; only one table of ``size`` numbers comes back."""
    out = np.zeros(size)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


def _independent(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block that is orthogonal to the basis; directions that break down are replaced by random ones while there is room."""
    room = len(basis) - basis.shape[1]
    found: list[np.ndarray] = []
    for column in block.T:
        if len(found) == room:
            break
        for attempt in range(3):
            size = np.linalg.norm(column)
            rest = column / size if size else column
            for _ in range(2):
                rest = rest - basis @ (basis.T @ rest)
                for other in found:
                    rest = rest - other * (other @ rest)
            left = np.linalg.norm(rest)
            if left > (1e-10 if attempt == 0 else 1e-6):
                rest = rest / left
                rest -= basis @ (basis.T @ rest)
                for other in found:
                    rest -= other * (other @ rest)
                found.append(rest / np.linalg.norm(rest))
                break
            column = rng.standard_normal(len(basis))
    return np.stack(found, axis=1) if found else np.zeros((len(basis), 0))


def block_lanczos(
    apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, most: int = BASIS, steps: int = STEPS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors of the symmetric positive operator ``apply``.

    A block has at least as many directions as eigenvectors are wanted, so that
    none is missed where eigenvalues are equal.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, width)
    block = max(block, wanted)
    keep = max(2 * wanted, wanted + block)
    most = max(most, keep + 2 * block)
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    fresh = _independent(rng.standard_normal((width, min(block, width))), basis, rng)
    best, stuck = np.inf, 0
    for _ in range(steps):
        product = apply(fresh)
        basis, image = np.hstack([basis, fresh]), np.hstack([image, product])
        inner = basis.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        pairs = basis @ turns[:, :wanted]
        size = max(abs(values[0]), np.finfo(float).tiny)
        residual = np.linalg.norm(image @ turns[:, :wanted] - pairs * values[:wanted], axis=0).max() / size
        stuck = 0 if residual < best / 2 else stuck + 1
        best = min(best, residual)
        full = basis.shape[1] >= width
        # Rounding alone keeps a residual up: it has not halved in many steps and is tiny.
        if full or (basis.shape[1] >= wanted and (residual <= tolerance or (stuck >= 8 and best < 1e-12))):
            return values[:wanted], pairs / np.linalg.norm(pairs, axis=0)
        fresh = _independent(product, basis, rng)
        if basis.shape[1] + fresh.shape[1] > most:
            basis, image = basis @ turns[:, :keep], image @ turns[:, :keep]
    raise RuntimeError("the residuals did not settle")


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of (…, y); None where no two differ.

    The distinct vectors are written to the shared folder once and read in each
    step. Vectors of another length than the most frequent one (of several, the
    longest) take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/whitening-{uuid.uuid4().hex}"
    vectors.select("y").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    sizes = fit.groupBy(F.size("y").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if sizes is None:
        return None
    width, n = sizes["width"], sizes["n"]
    fit = fit.where(F.size("y") == width)
    sums = fit.mapInArrow(_sums(width), "at long, high long, low long").groupBy("at")
    rows = sums.agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()
    total = [0] * width
    for row in rows:
        total[row["at"]] = (int(row["high"]) << 32) + int(row["low"])
    whole, rest = _split(total, n)
    trace = [0.0]

    def apply(directions: np.ndarray) -> np.ndarray:
        out = _added(fit.mapInArrow(_products(whole, rest, n, directions), "at long, value double"), directions.size + 1) / n
        trace[0] = out[-1]
        return out[:-1].reshape(directions.shape)

    values, vectors_ = block_lanczos(apply, width, components)
    good = values > RANK * max(values[0], 0.0)
    if not good.any():
        return None
    values, vectors_ = values[good], vectors_[:, good]
    k = len(values)
    sums = _added(fit.mapInArrow(_moments(whole, rest, n, vectors_ / np.sqrt(values)), "at long, value double"), (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k)).max())
    return Whitening(n, total, vectors_, values, values / trace[0], error)


def _deviations(y: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Sum over dimensions of ``(n * y - total) ** 2``, exact; null beyond 64 bits."""
    apart = y - whole
    largest = (int(np.abs(apart).max(initial=0)) + 1) * n
    if largest * largest * len(whole) < 1 << 63:
        return pa.array(((n * apart - rest) ** 2).sum(axis=1))
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in apart.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _whiten(model: Whitening):
    whole, rest = model.centre()
    project, k = model.components / np.sqrt(model.eigenvalues), len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            m = batch.num_rows
            y = _matrix(batch.column("y"), len(whole))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    _deviations(y, whole, rest, model.n).take(each),
                    pa.array((((y - whole) - rest / model.n) @ project).ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out, and so are vectors of another length than the most frequent one
    among the distinct vectors. Each vector counts once in the fit; repeated
    rows and ids are rows of the result each, a null id stays null. There are
    as many components as the data's numerical rank, at most ``components``;
    a table without two different vectors has none, and gives no rows. A
    deviation beyond 64 bits is null. Other columns are ignored.
    """
    rows = scaled(df, vector, vec_id)
    model = fit_whitening(rows, components)
    if model is None:
        return rows.where(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (field.split() for field in WHITENED.split(", "))])
    return rows.where(F.size("y") == len(model.total)).mapInArrow(_whiten(model), WHITENED)

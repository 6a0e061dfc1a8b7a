"""Embedding whitening: leading eigenvectors of a covariance by Jacobi-Davidson, never forming it.

The fit list (each distinct integer vector once) is written in packed blocks. A product of the
covariance with a few vectors at once is one Spark job over these blocks: every task centres its
rows, multiplies by the vectors and back, and the sums of tasks are added by groups of tasks
before the driver gets them. The driver holds dimensions x basis numbers only:

1. Rayleigh-Ritz on the basis, which stays orthogonal to the vectors already locked.
2. A Ritz pair whose residual is at the rounding level of doubles is locked, from the first on.
3. The others' correction equations, projected on the complement of all locked and current Ritz
   vectors, are solved by some MINRES steps. They advance together and share each product.
4. The corrections widen the basis; a basis that has become wide starts again from its Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.session import materialize

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 4 << 20  # of the packed rows
INNER_STEPS = 6
ADDERS = 16  # tasks that add up what the others' rows have given
_EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


# --- Jacobi-Davidson ------------------------------------------------------------------------


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthogonal to ``bases`` and to each other; dependent ones go."""
    kept = np.empty((len(new), 0))
    for column in new.T:
        length = np.linalg.norm(column)
        if not length:
            continue
        column = column / length
        for _ in range(3):
            for basis in (*bases, kept):
                column = column - basis @ (basis.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10:
            kept = np.column_stack([kept, column / left])
    return kept


def _corrections(
    product: Product, shifts: np.ndarray, residuals: np.ndarray, fixed: np.ndarray, steps: int
) -> np.ndarray:
    """Approximate solutions t of (I - FF')(A - shift)(I - FF') t = -residual, one per column.

    MINRES for all columns in step; ``fixed`` are the vectors F that solutions are orthogonal to.
    A column that has ended is left as it is.
    """

    def project(x: np.ndarray) -> np.ndarray:
        return x - fixed @ (fixed.T @ x)

    n_columns = residuals.shape[1]
    t = np.zeros_like(residuals)
    v = project(project(-residuals))
    beta = np.linalg.norm(v, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(v), v / first
    eta, open_ = beta.copy(), beta > 0
    c_old = c = np.ones(n_columns)
    s_old = s = np.zeros(n_columns)
    w_old = w = np.zeros_like(v)
    beta = np.zeros(n_columns)
    for _ in range(steps):
        if not open_.any():
            break
        z = project(product(v) - v * shifts)
        alpha = (v * z).sum(axis=0)
        z = project(z - v * alpha - v_old * beta)
        beta_new = np.linalg.norm(z, axis=0)
        # the new column of the tridiagonal matrix under the two last rotations, and a new one
        r3 = s_old * beta
        r2 = s * alpha + c_old * c * beta
        r1_before = c * alpha - c_old * s * beta
        r1 = np.hypot(r1_before, beta_new)
        open_ &= r1 > 0
        safe = np.where(r1 > 0, r1, 1.0)
        c_old, s_old = c, s
        c, s = r1_before / safe, beta_new / safe
        w_old, w = w, (v - w_old * r3 - w * r2) / safe
        t = np.where(open_, t + w * (c * eta), t)
        eta = -s * eta
        open_ &= (np.abs(eta) > 1e-4 * first) & (beta_new > 0)
        v_old, v = v, z / np.where(beta_new > 0, beta_new, 1.0)
        beta = beta_new
    return t


def leading_pairs(
    product: Product, dim: int, wanted: int, trace: float, steps: int = INNER_STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix.

    ``product`` multiplies a block of columns by the matrix, ``trace`` is that of the matrix (not
    negative). Ends when all residuals are at the rounding level of doubles.
    """
    wanted = min(wanted, dim)
    locked, values = np.empty((dim, 0)), np.empty(0)
    if not trace > 0:
        return np.zeros(wanted), np.eye(dim)[:, :wanted]
    basis = _orthonormal(np.random.default_rng(11).standard_normal((dim, min(dim, 2 * wanted))))
    image = product(basis)
    best, waits = np.inf, 0
    while locked.shape[1] < wanted:
        left = wanted - locked.shape[1]
        small = basis.T @ image
        theta, mix = np.linalg.eigh((small + small.T) / 2)
        theta, mix = theta[::-1], mix[:, ::-1]
        ritz, ritz_image = basis @ mix, image @ mix
        gap = ritz_image[:, :left] - ritz[:, :left] * theta[:left]
        gap -= locked @ (locked.T @ gap)
        norms = np.linalg.norm(gap, axis=0)
        level = 8 * _EPS * np.sqrt(dim) * max(theta[0], *values, trace / dim)
        good = norms <= level
        n_good = left if good.all() else int(np.argmin(good))
        if not n_good:
            # rounding in the sums of very many rows can stay above the level: the first residual
            # no longer falls, though it is that of a double
            waits = waits + 1 if norms[0] >= best / 2 else 0
            best = min(best, norms[0])
            n_good = int(waits >= 4 and norms[0] <= 64 * level)
        if n_good or basis.shape[1] == dim - locked.shape[1]:
            n_good = n_good or left  # the basis spans all that is left
            locked = np.column_stack([locked, ritz[:, :n_good]])
            values = np.append(values, theta[:n_good])
            best, waits = np.inf, 0
            basis, image = ritz[:, n_good:], ritz_image[:, n_good:]
            image = image - locked @ (locked.T @ image)
            if not basis.shape[1] and locked.shape[1] < wanted:
                rng = np.random.default_rng(12 + locked.shape[1])
                basis = _orthonormal(rng.standard_normal((dim, 2 * left)), locked)
                image = product(basis)
            continue
        fixed = _orthonormal(ritz[:, :left], locked)
        fixed = np.column_stack([locked, fixed])
        t = _corrections(product, theta[:left], gap, fixed, steps)
        if basis.shape[1] + left > max(8 * wanted, 24):
            basis, image = ritz[:, : 3 * wanted], ritz_image[:, : 3 * wanted]
        more = _orthonormal(t, locked, basis)
        if not more.shape[1]:
            rng = np.random.default_rng(99 + basis.shape[1])
            more = _orthonormal(rng.standard_normal((dim, left)), locked, basis)
        basis = np.column_stack([basis, more])
        image = np.column_stack([image, product(more)])
    # one more Rayleigh-Ritz on the locked vectors, with a product of its own
    vectors = _orthonormal(locked)
    small = vectors.T @ product(vectors)
    values, mix = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], vectors @ mix[:, ::-1]


# --- the fit list on Spark ------------------------------------------------------------------


@dataclass(frozen=True)
class FitList:
    """Packed distinct vectors with their number, sums (exact) and sum of squares (exact)."""

    blocks: DataFrame
    dim: int
    n: int
    sums: np.ndarray
    squares: int

    @property
    def trace(self) -> float:
        """Of the covariance; the numerator is exact."""
        total = sum(int(s) ** 2 for s in self.sums.tolist())
        return (self.n * self.squares - total) / self.n**2

    def product(self, v: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``v``."""
        mean = self.sums / self.n

        def multiplied(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ v)

        return self._summed(multiplied, v.shape) / self.n

    def _summed(self, of_block: Callable[[np.ndarray], np.ndarray], shape) -> np.ndarray:
        """Sum of a function of all blocks of rows, added within tasks and by groups of tasks."""
        dim = self.dim

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for width, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows = np.frombuffer(raw.as_buffer(), f"<i{width}").reshape(-1, dim)
                    for at in range(0, len(rows), 4096):
                        own = of_block(rows[at : at + 4096].astype(float))
                        total = own if total is None else total + own
            if total is not None:
                yield _sum_row(TaskContext.get().partitionId(), total)

        def add(table: pa.Table) -> pa.Table:
            parts = sorted(zip(table["part"].to_pylist(), table["total"].to_pylist()))
            total = sum(np.frombuffer(x) for _, x in parts)
            return pa.Table.from_batches([_sum_row(parts[0][0], total)])

        parts = self.blocks.select("width", "rows").mapInArrow(partial, "part int, total binary")
        grouped = parts.groupBy(F.col("part") % ADDERS).applyInArrow(add, "part int, total binary")
        found = sorted((r["part"], bytes(r["total"])) for r in grouped.collect())
        return sum((np.frombuffer(x) for _, x in found), np.zeros(int(np.prod(shape)))).reshape(shape)

    def white_covariance(self, vectors: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Covariance of the whitened fit list, centred on the mean of what was whitened."""
        mean = self.sums / self.n
        k = len(scale)
        totals = self._summed(lambda x: ((x - mean) @ vectors / scale).sum(axis=0), (k,))
        centre = totals / self.n

        def second(x: np.ndarray) -> np.ndarray:
            white = (x - mean) @ vectors / scale - centre
            return white.T @ white

        return self._summed(second, (k, k)) / self.n


def _sum_row(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
        names=["part", "total"],
    )


def usable(vector: Column) -> Column:
    """Whether a vector is there, has a component and holds no null and no non-finite one."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each component, as a double times ``scale``, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of longs as blocks of the narrowest integers that hold them, with their exact sums."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        rows = column.flatten().to_numpy().reshape(batch.num_rows, -1)
        step = max(1, BLOCK_BYTES // (8 * rows.shape[1]))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            most = max(-int(own.min()), int(own.max()) + 1)
            width = next(w for w in (2, 4, 8) if most <= 1 << (8 * w - 1))
            wide = own.astype(object) if most * len(own) >= 1 << 62 else own
            sums = [str(s) for s in wide.sum(axis=0).tolist()]
            big = own.astype(object) if most * most * own.size >= 1 << 62 else own
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([width], pa.int32()),
                    pa.array([np.ascontiguousarray(own.astype(f"<i{width}")).tobytes()], pa.binary()),
                    pa.array([len(own)], pa.int64()),
                    pa.array([sums], pa.list_(pa.string())),
                    pa.array([str((big * big).sum())]),
                ],
                names=["width", "rows", "n", "sums", "squares"],
            )


def fit_list(vectors: DataFrame) -> FitList | None:
    """``vectors``: one column x (array<long>) of one length. None if there is no row."""
    distinct = vectors.select("x").distinct()
    blocks = materialize(
        distinct.mapInArrow(
            _pack, "width int, rows binary, n long, sums array<string>, squares string"
        ),
        "fit-blocks",
    )
    total = blocks.agg(
        F.sum("n").alias("n"), F.sum(F.col("squares").cast("decimal(38,0)")).alias("squares")
    ).first()
    if not total["n"]:
        return None
    each = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i")
    sums = each.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    exact = np.array([int(r["s"]) for r in sums], object)
    small = all(abs(s) < 1 << 62 for s in exact)
    return FitList(
        blocks, len(exact), int(total["n"]), exact.astype(np.int64) if small else exact, int(total["squares"])
    )


# --- the operator ---------------------------------------------------------------------------


def whiten(
    embeddings: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row left.

    Rows whose vector is null, empty or holds a null or non-finite component take no part, nor do
    those of another length than most rows have (the shorter, if tied). A component c becomes
    floor(``scale`` * c). Covariances are over the distinct vectors, with divisor n. ``deviation``
    is the exact sum of (n * x - S)^2, null where a long can't hold it. Components are numbered
    from 1 by falling eigenvalue; those whose eigenvalue is zero to rounding are left out, as no
    scale makes their variance one. Repeated rows, and rows with null keys, are rows of their own;
    other columns are ignored. No row left, or one distinct vector alone, gives an empty result.
    """
    kept = embeddings.select(
        F.col(key).alias("vec_id"), F.col(vector).alias("_vector"), F.size(vector).alias("_size")
    ).filter(usable(F.col("_vector")))
    sizes = kept.groupBy("_size").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_size").first()
    dim = sizes["_size"] if sizes else 0
    rows = kept.filter(F.col("_size") == dim).select(
        "vec_id", quantized(F.col("_vector"), scale).alias("x")
    )
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    fit = fit_list(rows) if dim else None
    if fit is None or not fit.trace > 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    values, vectors = leading_pairs(fit.product, fit.dim, components, fit.trace)
    some = values > 1e-12 * fit.trace
    values, vectors = values[some], vectors[:, some]
    root = np.sqrt(values)
    error = float(np.abs(fit.white_covariance(vectors, root) - np.eye(len(root))).max())
    n, sums, explained = fit.n, fit.sums, values / fit.trace
    mean = (sums / n).astype(float)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                values = (x - mean) @ vectors / root
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n)),
                        deviations(x, n, sums).take(each),
                        pa.array(values.reshape(-1)),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=[f.split()[0] for f in schema.split(", ")],
                )

    return rows.mapInArrow(white, schema)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of (n * x - S)^2 as longs; null where they don't fit."""
    most = n * max(-int(x.min()), int(x.max()), 1) + max(abs(int(s)) for s in sums)
    if most < 1 << 31 and most**2 * x.shape[1] < 1 << 63:
        away = n * x - sums
        return pa.array((away * away).sum(axis=1).astype(np.int64))
    away = n * x.astype(object) - sums.astype(object)
    exact = (away * away).sum(axis=1).tolist()
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

"""Embedding whitening by shifted CholeskyQR.

Vectors are centred on their mean and orthogonalised in place of being stored: a pass over
the rows solves with the triangular factors found so far, sums the Gram matrix of the result
in every task, and its Cholesky factor is the next one. The first Gram matrix is shifted by
a little so that it can be factored even if ill-conditioned; the passes after it restore what
the shift took, until the Gram matrix is the identity. The product R of all factors has the
singular values and right vectors of the centred rows (R'R = A'A), which give the components.

What leaves the tasks is a d x d matrix each, added up in Spark; the driver holds d x d
numbers, whatever the number of rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PASSES = 8
ROWS_AT_ONCE = 4096
#: Components of less than this share of the greatest variance count as none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Model:
    """``components``: rows are unit eigenvectors by falling ``eigenvalues``; ``variance``: the
    covariance's trace; ``passes``: Gram passes that were made."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float
    passes: int = 0

    @property
    def dim(self) -> int:
        return len(self.sums)


def usable(vector: str, least: float = -2.0 ** 52, most: float = 2.0 ** 52) -> Column:
    """Whether a vector is neither null nor empty and all its entries are numbers within
    the bounds (null, NaN and infinite entries are not)."""
    v = F.col(vector)
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(
        F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & c.cast("double").between(least, most)), F.lit(False))


def same_size(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has the most frequent length (the longer one in a tie)."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return rows.filter(F.size(vector) == (most["d"] if most else 0))


def _blocks(batches, dim: int):
    """The vectors of Arrow batches as matrices of doubles."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        for at in range(0, len(flat), ROWS_AT_ONCE):
            yield flat[at:at + ROWS_AT_ONCE]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean; for whole numbers the difference is exact before the division."""
    return (x * n - sums) / n


def _solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A R1^-1 R2^-1 ...: a triangular solve for each factor (upper triangular)."""
    for r in factors:
        a = np.linalg.solve(r.T, a.T).T
    return a


def gram(rows: DataFrame, vector: str, n: int, sums: np.ndarray, factors: list[np.ndarray],
         scale: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows after the triangular solves, or after projection
    on the columns of ``scale``: a matrix a task, added up by entry."""
    width = len(sums) if scale is None else scale.shape[1]

    def partial(batches):
        total = np.zeros((width, width))
        for x in _blocks(batches, len(sums)):
            a = _centred(x, n, sums)
            q = _solved(a, factors) if scale is None else a @ scale
            total += q.T @ q
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                         names=["i", "j", "g"])

    out = np.zeros((width, width))
    for r in (rows.select(vector).mapInArrow(partial, "i int, j int, g double")
              .groupBy("i", "j").agg(F.sum("g").alias("g")).collect()):          # d (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def sums_of(rows: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray]:
    """Rows and the sums of every dimension; exact for whole numbers while sums stay below 2**53."""
    def partial(batches):
        total, n = np.zeros(dim), 0
        for x in _blocks(batches, dim):
            total += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total)],
                                         names=["i", "n", "s"])

    found = (rows.select(vector).mapInArrow(partial, "i int, n long, s double")
             .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())         # d rows
    out = np.zeros(dim)
    for r in found:
        out[r["i"]] = r["s"]
    return (found[0]["n"] if found else 0), out


def fit(rows: DataFrame, vector: str) -> Model:
    """The whitening of all ``rows`` (vectors of one length, see ``usable``, ``same_size``).

    No rows, or rows without any variance, have no components. Repeated rows count each."""
    first = rows.select(F.size(vector).alias("d")).first()
    dim = first["d"] if first else 0
    n, sums = sums_of(rows, vector, dim) if dim else (0, np.zeros(0))
    none = Model(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0)
    if not n:
        return none
    unit, whole, factors = np.finfo(float).eps / 2, np.eye(dim), []
    for _ in range(MAX_PASSES):
        g = gram(rows, vector, n, sums, factors)
        if not factors:
            if not np.trace(g) > 0:
                return none
            shift = 11 * dim * (ROWS_AT_ONCE + dim + 1) * unit * np.trace(g)
        elif np.abs(g - np.eye(dim)).max() <= 1e-13 * dim:
            break
        else:
            shift = 0.0
        r = _upper_factor(g, shift, 11 * dim * (dim + 1) * unit)
        factors.append(r)
        whole = r @ whole
    _, s, components = np.linalg.svd(whole)
    eigenvalues = s ** 2 / n
    sign = np.sign(components[np.arange(dim), np.abs(components).argmax(axis=1)])
    real = eigenvalues > NO_VARIANCE * eigenvalues[0]
    return Model(n, sums, (components * sign[:, None])[real], eigenvalues[real], float(eigenvalues.sum()), len(factors))


def _upper_factor(g: np.ndarray, shift: float, least: float) -> np.ndarray:
    """R, upper triangular, with R'R = g + shift; a Gram matrix that is singular after the
    first pass (dimensions without variance of their own) is shifted by ``least`` of its trace."""
    try:
        return np.linalg.cholesky(g + shift * np.eye(len(g))).T
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(g + max(shift, least * np.trace(g)) * np.eye(len(g))).T


def projection(model: Model, k: int) -> np.ndarray:
    """d x k: centred rows times this are whitened."""
    return (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T


def identity_error(rows: DataFrame, vector: str, model: Model, k: int) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    p = projection(model, k)
    return float(np.abs(gram(rows, vector, model.n, model.sums, [], p) / model.n - np.eye(p.shape[1])).max(initial=0.0))


def whiten(rows: DataFrame, keep: list[str], vector: str, model: Model, k: int) -> DataFrame:
    """The columns ``keep`` of ``rows`` and ``whitened``, the first ``k`` whitened coordinates
    (as many as have variance) of every row."""
    p, n, sums, dim = projection(model, k), model.n, model.sums, model.dim
    schema = rows.select(*keep, F.array(F.lit(0.0)).alias("whitened")).schema

    def project(batches):
        for batch in batches:
            parts = [_centred(x, n, sums) @ p for x in _blocks([batch], dim)]
            flat = np.concatenate(parts) if parts else np.zeros((0, p.shape[1]))
            offsets = pa.array(np.arange(len(flat) + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))],
                                             names=schema.names)

    return rows.select(*keep, vector).mapInArrow(project, schema)

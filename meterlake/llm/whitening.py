"""Embedding whitening: eigenvectors of a distributed covariance, found in float32 and corrected to full precision.

Vectors become whole numbers, ``floor(256 * c)``; the fit list holds each distinct one once.  Two passes over it count and
sum: the first takes the sums per dimension, the second the products of what is left after the rounded means are taken
away.  Both are sums of whole numbers, so the covariance is exact, and the same however rows are dealt over tasks.
What reaches the driver is one number for each pair of dimensions.

The eigenvectors of the covariance, rounded to float32, are a first guess.  Each step of the refinement by matrix
products alone (Ogita and Aishima) squares their error: with ``R = I - X'X`` and ``S = X'AX`` the correction of vector j along
vector i is ``(s_ij + l_j r_ij) / (l_j - l_i)``.  Where two eigenvalues are nearer than what the step can tell apart, that
quotient says nothing: such vectors are only made orthogonal, and a sub-solve turns them within the space that they span,
after the mean of their eigenvalues is taken away, so that their small differences count in full.  Products are taken in
``numpy.longdouble`` (64 bits of mantissa on x86, else a double's).

Defined results: rows whose vector is null, empty or holds a null or non-finite entry go; equal vectors count once in the
fit and are all returned, as are rows with equal or null ids; a component without variance is left out, so that equal
vectors or an empty table give no rows; eigenvectors have their entry of largest size positive; vectors of several
lengths, entries of 2^44 or more, and deviations beyond a long are errors; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize

#: Components returned; what one unit of a vector's entry becomes.
K, UNITS = 4, 256
#: Steps of the refinement at most: from float32's seven digits two or three suffice where eigenvalues are apart.
STEPS = 12
WIDE = np.longdouble


def whole(vector: Column) -> Column:
    """A vector's entries as whole numbers; null where the vector takes no part."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~odd, F.transform(vector, lambda c: F.floor(c.cast("double") * UNITS)))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if not (sizes == sizes[0]).all():
        raise ValueError("vectors of several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, total, largest): sums by dimension, at -1 the number of vectors, at -2 their length and largest entry."""
    total, n, largest = None, 0, 0
    for b in batches:
        x = matrix(b.column(0))
        if not len(x):
            continue
        if total is not None and len(total) != x.shape[1]:
            raise ValueError("vectors of several lengths")
        largest = max(largest, -int(x.min()), int(x.max()))
        if largest >= 1 << 52:
            raise ValueError("vector entries of 2^44 or more")
        total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        n += len(x)
    if n:
        places = np.append(np.arange(len(total)), [-1, -2])
        yield pa.record_batch([pa.array(places), pa.array(np.append(total, [n, 0])), pa.array(np.append(np.full(len(total) + 1, len(total)), largest))],
            ["place", "total", "largest"])


def _products(middle: np.ndarray, largest: int):
    """(place, total): sums of products of two dimensions, each less its rounded mean; exact in doubles, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(middle)
        total, rows, block = np.zeros((d, d), np.int64), 0, max(1, (1 << 53) // (largest * largest))
        for b in batches:
            y = (matrix(b.column(0)) - middle).astype(float)
            for at in range(0, len(y), block):
                part = y[at : at + block]
                total += (part.T @ part).astype(np.int64)
            rows += len(y)
            if rows * largest * largest >= 1 << 62:
                raise ValueError("products of vector entries exceed a long")
        if rows:
            i, j = np.triu_indices(d)
            yield pa.record_batch([pa.array(i * d + j), pa.array(total[i, j])], ["place", "total"])

    return run


def _moments(model: Whitening):
    """(place, total): sums of whitened components, at 0 to k-1, and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.whitened(matrix(b.column(0)))
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.record_batch([pa.array(np.arange(k + k * k)), pa.array(np.append(first, second))], ["place", "total"])

    return run


# -- eigenvectors


def groups(values: np.ndarray, near: float) -> Iterator[slice]:
    """Runs of two or more sorted eigenvalues, each within ``near`` of the one before."""
    first = 0
    for at in range(1, len(values) + 1):
        if at == len(values) or abs(values[at] - values[at - 1]) > near:
            if at - first > 1:
                yield slice(first, at)
            first = at


def refined(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to the precision of ``WIDE``."""
    n = len(a)
    scale = np.abs(a).max()
    if not scale > 0:
        return np.zeros(n, WIDE), np.eye(n, dtype=WIDE)
    a, eye = a.astype(WIDE) / scale, np.eye(n, dtype=WIDE)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(WIDE)
    size, tiny, last = np.linalg.norm(a.astype(float), 2), float(np.finfo(WIDE).eps) * n, np.inf
    for _ in range(steps):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        near = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + size * np.linalg.norm(r.astype(float)))
        apart = values[None, :] - values[:, None]
        close = np.abs(apart) <= near
        change = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, apart))
        x = x + x @ change
        turned = 0.0
        for own in groups(values, near):
            part, middle = x[:, own], values[own].mean()
            inner = part.T @ (a @ part) - middle * (part.T @ part)
            inner = (inner + inner.T) / 2
            spread = np.abs(inner).max()
            if spread > tiny * size:  # else they are equal, and any basis will do
                w = np.linalg.eigh((inner / spread).astype(float))[1][:, ::-1].astype(WIDE)
                x[:, own] = part @ w
                turned = max(turned, float(np.abs(inner - np.diag(np.diag(inner))).max() / size))
        moved = max(float(np.abs(change).max()), turned)
        if moved <= tiny or (moved >= last and moved < 1e-12):
            break
        last = moved
    for _ in range(2):  # rotations within near eigenvalues leave their squares behind
        x = x + x @ (eye - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    return values, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(n)])


@dataclass
class Whitening:
    """How many vectors were fitted, their sums, and by component the eigenvalue, its share of all variance and the vector."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if len(x) and self.n * int(np.abs(x).max()) + int(np.abs(self.sums).max(initial=0)) >= 1 << 62:
            raise OverflowError("a deviation exceeds a long")
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(self.values)))
        return (self.deviations(x) / self.n) @ (self.vectors / np.sqrt(self.values))


def covariance(n: int, sums: list[int], middle: list[int], products: list[list[int]]) -> np.ndarray:
    """From exact sums; only its rounding to ``WIDE`` is not exact."""
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((len(sums), len(sums)), WIDE)
    for i, a in enumerate(rest):
        for j in range(i, len(sums)):
            q, left = divmod(n * products[i][j] - a * rest[j], n * n)
            out[i, j] = out[j, i] = WIDE(q) + WIDE(left / (n * n))
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = K) -> Whitening:
    """The ``k`` components of largest variance of the distinct whole-number vectors."""
    listed = materialize(vectors.select(whole(F.col(vector_col)).alias("x")).filter("x is not null").distinct(), "whitening-fit")
    sums = map_arrow(listed, _sums, "place long, total long, largest long").groupBy("place").agg(F.sum("total").alias("total"),
        F.max("largest").alias("largest"), F.min("largest").alias("least"))
    found = {r["place"]: r for r in sums.collect()}  # a row a dimension
    if not found:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    n, d = found[-1]["total"], found[-1]["largest"]
    if found[-1]["least"] != d:
        raise ValueError("vectors of several lengths")
    total = [found[i]["total"] for i in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in total]
    largest = found[-2]["largest"] + max(map(abs, middle))
    if largest * largest >= 1 << 53:
        raise ValueError("vector entries differ by 2^18 or more")
    rows = map_arrow(listed, _products(np.array(middle), max(1, largest)), "place long, total long").groupBy("place").agg(
        F.sum("total").alias("total")).toArrow()  # a row a pair of dimensions
    products = [[0] * d for _ in range(d)]
    for place, value in zip(rows["place"].to_pylist(), rows["total"].to_pylist(), strict=True):
        products[place // d][place % d] = value
    v = covariance(n, total, middle, products)
    values, x = refined(v)
    trace = np.trace(v)
    some = int((values[:k] > 16 * d * np.finfo(WIDE).eps * trace).sum())
    model = Whitening(n, np.array(total), values[:some].astype(float), (values[:some] / trace if some else values[:0]).astype(float),
        x[:, :some].astype(float))
    if some:
        got = map_arrow(listed, _moments(model), "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
        moment = np.zeros(some + some * some)
        moment[got["place"].to_numpy()] = got["total"].to_numpy()
        mean = moment[:some] / n
        model.identity_error = float(np.abs(moment[some:].reshape(some, some) / n - np.outer(mean, mean) - np.eye(some)).max())
    discard(listed)
    return model


def _whiten(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for b in batches:
            x = matrix(b.column(1))
            off = model.deviations(x) if len(x) else x
            if len(x) and float((off.astype(float) ** 2).sum(axis=1).max()) >= 9.2e18:
                raise OverflowError("a deviation exceeds a long")
            of, times = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.record_batch(
                [b.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)),
                    pa.array((off * off).sum(axis=1)[of] if len(x) else np.zeros(0, np.int64)), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.shares, times))],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    return run


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col)).alias("x")).filter("x is not null")
    kind = vectors.schema[id_col].dataType.simpleString()
    found = map_arrow(rows, _whiten(model), f"vec_id {kind}, component int, deviation long, whitened double, explained double")
    return found.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error).alias("identity_error"))

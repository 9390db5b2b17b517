"""Whitening of vectors by the leading eigenvectors of their covariance, found without forming it.

Vectors become whole numbers x = floor(256 c). The fit list is each distinct x once. Sums of it are whole numbers too, so that
means and deviations are exact: n x - S has no rounding, and the trace of the covariance is the sum of the deviations over n^3.

The eigenvectors come from a block Lanczos iteration whose only use of the data is V Q for a few columns Q: one distributed pass
over the fit list, in which each task sums (x - S/n) ((x - S/n)' Q) over its rows. Every block is orthogonalised twice
against the whole basis; V times the basis is kept, so that residuals are true ones. A block that has broken down (the
basis spans an invariant space) is filled up with random directions orthogonal to the basis; a basis of the largest size is replaced by
its leading Ritz vectors. It ends when the residuals of the wanted vectors are at the rounding of the passes, or when the basis spans
everything. What the driver holds: a few arrays of width x basis size; of each pass 32 partial sums at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import staged, table

#: partial sums that a pass sends to the driver at most
GATHERED = 32


class Whitening(NamedTuple):
    """n and sums of the fit list, components (width x k, unit columns by falling eigenvalue), their eigenvalues, the shares of the trace
    that they explain, and the largest absolute entry of (the whitened fit list's covariance - identity)."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole(c: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(c, np.float64) * 256).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector isn't null and holds no null or non-finite entry."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", "embedding").where(F.coalesce(~F.exists("embedding", bad), F.lit(False)))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers; shorter ones are filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = whole(column.flatten().to_numpy(zero_copy_only=False))
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_list(vectors: DataFrame, width: int) -> DataFrame:
    """Each distinct x of vectors once: x as 64-bit numbers in a binary column, equal ones combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(_rows(batch.column("embedding"), width), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return vectors.select("embedding").mapInArrow(run, "x binary").distinct()


def _summed(fit: DataFrame, width: int, terms: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of terms(rows) over the fit list: by tasks, then by 32 tasks over these, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                data = batch.column("x").slice(at, 4096)
                own = terms(np.frombuffer(b"".join(data.to_pylist()), "<i8").reshape(-1, width))
                total = own if total is None else total + own
        if total is not None:
            yield row(TaskContext.get().partitionId(), total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = None, None
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, kind)
                total, least = own if total is None else total + own, part if least is None else min(least, part)
        if total is not None:
            yield row(least, total)

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(total, kind).tobytes()], pa.binary())], ["part", "total"])

    schema = "part int, total binary"
    parts = fit.mapInArrow(run, schema).repartition(GATHERED, F.col("part") % GATHERED).sortWithinPartitions("part").mapInArrow(again, schema).collect()
    parts = [np.frombuffer(r["total"], kind) for r in sorted(parts, key=lambda r: r["part"])]
    return sum(p.astype(object) if kind == "<i8" else p for p in parts)


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """Orthonormal columns that span block outside basis. Columns that vanish there (against scale) are replaced by random
    directions, as long as any are left; whether there was such a one (a breakdown)."""
    width, columns, broke = len(block), [], False
    for column in block.T:
        size = scale
        while basis.shape[1] + len(columns) < width:
            held = np.column_stack([basis, *columns])
            for _ in range(2):
                column = column - held @ (held.T @ column)
            norm = np.sqrt(column @ column)
            if norm > 1e-10 * size:
                column = column / norm
                column = column - held @ (held.T @ column)
                columns.append(column / np.sqrt(column @ column))
                break
            broke, column, size = True, rng.normal(size=width), 1.0
    return np.array(columns).reshape(len(columns), width).T, broke


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = 8, largest: int = 256, tolerance: float = 1e-14, passes: int = 500, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and unit eigenvectors of a symmetric matrix of which only multiply(Q) is known.

    tolerance: of the residuals, against the largest eigenvalue; where rounding doesn't allow it, the iteration ends when residuals under 10^-11
    of it have not been halved in ten passes. A block is at least as wide as the number wanted, so that equal eigenvalues are found as often as there are."""
    rng = np.random.default_rng(seed)
    wanted, block = min(wanted, width), min(max(block, wanted), width)
    largest = min(max(largest, 4 * block), width)
    basis = images = np.zeros((width, 0))
    q, _ = _orthonormal(rng.normal(size=(width, block)), basis, 1.0, rng)
    residuals: list[float] = []
    for _ in range(passes):
        image = multiply(q)
        basis, images = np.column_stack([basis, q]), np.column_stack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        top = vectors[:, :wanted]
        left = images @ top - (basis @ top) * values[:wanted]
        worst, size = np.sqrt((left * left).sum(axis=0)).max(), max(abs(values[0]), abs(values[-1]))
        residuals.append(worst)
        stuck = len(residuals) > 10 and min(residuals[-10:]) > 0.5 * min(residuals[:-10])
        if worst <= tolerance * size or basis.shape[1] == width or (stuck and worst <= 1e-11 * size):
            ritz, _ = np.linalg.qr(basis @ top)
            return values[:wanted], ritz * np.sign((ritz * (basis @ top)).sum(axis=0))
        if basis.shape[1] + block > largest:
            keep = max(wanted + block, largest // 3)
            next_block = image - basis @ (basis.T @ image)
            kept, _ = np.linalg.qr(basis @ vectors[:, :keep])
            turned = kept.T @ basis
            basis, images = kept, images @ turned.T
        else:
            next_block = image
        q, _ = _orthonormal(next_block, basis, size or 1.0, rng)
    raise RuntimeError(f"no convergence in {passes} passes: residual {residuals[-1]} of {size}")


def fit(vectors: DataFrame, components: int = 4, block: int = 8) -> Whitening | None:
    """The whitening of vectors (embedding: array of float or double); None where there is no usable vector.

    Shorter vectors count as filled up with zeros to the longest. Components whose eigenvalue is zero (to rounding) can't be scaled
    to unit variance and are left out, so there are fewer than asked for where the fit list spans fewer dimensions."""
    good = usable(vectors)
    width = good.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return None
    rows = staged(fit_list(good, width), "fit-list")
    first = _summed(rows, width, lambda x: np.append(x.sum(axis=0), len(x)), "<i8")
    n, sums = int(first[-1]), first[:-1]
    trace = _deviation_total(rows, width, n, sums) / n**3
    shift = np.array([int(s) for s in sums], np.int64)

    def multiply(q: np.ndarray) -> np.ndarray:
        def terms(x: np.ndarray) -> np.ndarray:
            centred = (n * x - shift) / n
            return centred.T @ (centred @ q)

        return _summed(rows, width, terms, "<f8").reshape(width, -1) / n

    values, vectors_ = block_lanczos(multiply, width, components, block)
    there = values > 1e-13 * width * max(values[0], 0)
    values, vectors_ = values[there], vectors_[:, there]
    at = np.abs(vectors_).argmax(axis=0)
    vectors_ = vectors_ * np.sign(vectors_[at, np.arange(len(at))])  # either sign is right: the largest entry is positive
    scaled = vectors_ / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = ((n * x - shift) / n) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

    k = len(values)
    error = 0.0
    if k:
        sums_of = _summed(rows, width, moments, "<f8")
        mean = sums_of[:k] / n
        error = float(np.abs(sums_of[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, sums, vectors_, values, values / trace if k else values, error)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Of each row the sum of (n x - S)^2 over the dimensions, exactly: n^2 x'x - 2 n x'S + S'S."""
    most, total = int(np.abs(x).max(initial=0)), int(np.abs(sums).max(initial=0))
    if most * most * x.shape[1] < 2**63 and most * total * x.shape[1] < 2**63:
        squares, products = (x * x).sum(axis=1).tolist(), (x @ sums.astype(np.int64)).tolist()
    else:
        own = x.astype(object)
        squares, products = (own * own).sum(axis=1).tolist(), (own * sums).sum(axis=1).tolist()
    own = sum(int(s) ** 2 for s in sums)
    return [n * n * a - 2 * n * b + own for a, b in zip(squares, products, strict=True)]


def _deviation_total(fit: DataFrame, width: int, n: int, sums: np.ndarray) -> int:
    """The sum of deviations over the fit list, as limbs of 32 bits whose sums fit in 64."""

    def limbs(x: np.ndarray) -> np.ndarray:
        total = sum(deviations(x, n, sums))
        return np.array([total >> (32 * i) & 0xFFFFFFFF for i in range(6)], np.int64)

    return sum(int(v) << (32 * i) for i, v in enumerate(_summed(fit, width, limbs, "<i8")))


def whitened(vectors: DataFrame, how: Whitening | None) -> DataFrame:
    """vec_id, component (from 1), deviation (decimal), whitened and explained, a row for each usable row of vectors and component.

    deviation is the exact sum of (n x - S)^2 over the dimensions, whitened the row's centred x projected on the component, over the root of its
    eigenvalue. Rows with null vectors, or null or non-finite entries, are left out; null or repeated vec_ids stay; other
    columns are ignored; an empty table gives an empty one."""
    good = usable(vectors)
    schema = "vec_id bigint, component int, deviation decimal(38,0), whitened double, explained double"
    if how is None or not len(how.eigenvalues):
        return good.sparkSession.createDataFrame([], schema)
    n, width, k = how.n, len(how.sums), len(how.eigenvalues)
    shift = np.array([int(s) for s in how.sums], np.int64)
    scaled = how.components / np.sqrt(how.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("embedding"), width)
            own = pa.array(deviations(x, n, how.sums), pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            w = ((n * x - shift) / n) @ scaled
            columns = [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), own.take(each), pa.array(w.reshape(-1)), pa.array(np.tile(how.explained, len(x)))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])

    return good.withColumn("vec_id", F.col("vec_id").cast("bigint")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's result with n, deviation as a long (an error where it doesn't fit in one), and identity_error."""
    vectors = table(spark, sf_dir, "embeddings")
    how = fit(vectors)
    n, error = (how.n, how.identity_error) if how else (0, 0.0)
    out = whitened(vectors, how)
    return out.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))

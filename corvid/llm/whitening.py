"""Whitening of vectors: exact integer sums, a second pass for the covariance, and a projection on its leading eigenvectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows that NumPy multiplies at a time, and levels of the tree that merges the tasks' matrices.
BLOCK, DEPTH = 4096, 3
#: Eigenvalues up to this share of the largest, times the width, are rounding, not variance: they make no component.
NOISE = np.finfo(np.float64).eps


def integers(vectors: DataFrame, vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, into: str = "x") -> DataFrame:
    """vectors without vector_col, and into: floor(scale * c) + shift of each entry c as double; rows whose vector is null or holds null or non-finite entries go."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c).cast("long") + F.lit(shift).cast("long"))
    return vectors.where(fine).select(*(F.col(f"`{c}`") for c in vectors.columns if c != vector_col), x.alias(into))


def _rows(column: pa.Array, width: int, size: int = BLOCK):
    """Integer matrices of size rows at most."""
    for at in range(0, len(column), size):
        part = column.slice(at, size)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def column_sums(x: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, S): the number of rows and the exact sum of each dimension. NumPy adds where 64 bits hold the sum, Python's integers elsewhere."""

    def add(batches):
        n, sums = 0, [0] * width
        for b in batches:
            for m in _rows(b.column(0), width):
                small = int(max(m.max(), -int(m.min()))) < (1 << 62) // BLOCK
                sums = [s + int(v) for s, v in zip(sums, (m if small else m.astype(object)).sum(0), strict=True)]
                n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array(map(str, sums))], names=["n", "k", "s"])

    parts = x.select("x").mapInArrow(add, "n long, k int, s string")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one for each dimension
    sums = {r["k"]: int(r["s"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums[k] for k in range(width)] if rows else [0] * width


def deviations(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where they suffice, else Python's."""
    top = max(int(m.max()), -int(m.min()), 1) if m.size else 1
    if n * top + max(map(abs, sums)) < 1 << 62:
        return n * m - np.array(sums, np.int64)
    return n * m.astype(object) - np.array(sums, object)


def covariance(x: DataFrame, n: int, sums: list[int], projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the rows of x, or of their projection: centred rows times centred rows, a matrix for each task, merged as a tree."""
    width = len(sums)
    sent = x.sparkSession.sparkContext.broadcast(projection)  # width x components doubles
    size = width if projection is None else projection.shape[1]

    def multiply(batches):
        total, any_rows = np.zeros((size, size)), False
        for b in batches:
            for m in _rows(b.column(0), width):
                c = deviations(m, n, sums).astype(np.float64) / n
                c = c if sent.value is None else c @ sent.value
                total, any_rows = total + c.T @ c, True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = x.select("x").mapInArrow(multiply, "m binary").rdd.map(lambda r: np.frombuffer(r[0]))
    return parts.treeAggregate(np.zeros(size * size), lambda a, v: a + v, lambda a, v: a + v, DEPTH).reshape(size, size) / n


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the most largest by LAPACK's symmetric solver; an eigenvector's largest entry is positive."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > len(values) * NOISE * max(values[0], 0.0)).sum()))
    values, vectors = values[:kept], vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(kept)])
    return values, vectors * signs


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """For each row and component up to most: id_col, component, n, deviation, whitened, explained, identity_error.

    Entries become integers x (integers()). The fit list holds each distinct x once: n vectors with sums S, which are exact whatever the order of
    adding. The second pass sums products of centred rows; its matrices, one a task, are merged as a tree. The driver holds one matrix of width
    x width and broadcasts width x most doubles. A third pass over the fit list measures identity_error: the largest entry of the whitened vectors'
    covariance minus the identity. deviation is the exact sum of (n * x - S)^2 over the dimensions, null where a long can't hold it.

    Nulls: rows whose vector is null or holds null or non-finite entries go; a null id is kept. Widths: that of most rows counts (of equally
    many, the larger); other rows and empty vectors go. Repeated rows: fitted once, returned each. Ties of eigenvalues: any basis of their
    space. Directions without variance make no component, so fewer than two distinct vectors, or an empty table, give an empty result. Entries
    beyond a long saturate. Other columns aren't read.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors.select(id_col, vector_col), vector_col, scale, shift).select(F.col(f"`{id_col}`").alias("id"), "x")
    fit = materialise(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x", F.size("x").alias("width")), "distinct-vectors")
    # every row has its say on the width, copies too
    common = rows.groupBy(F.size("x").alias("width")).count().where("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["width"]
    fit = fit.where(F.col("width") == width)
    n, sums = column_sums(fit, width)
    cov = covariance(fit, n, sums)
    values, basis = components(cov, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    projection = basis / np.sqrt(values)
    error = float(np.abs(covariance(fit, n, sums, projection) - np.eye(len(values))).max())
    explained = values / np.trace(cov)
    sent = spark.sparkContext.broadcast((n, sums, projection, explained, error))  # width x most doubles

    def project(batches):
        n, sums, projection, explained, error = sent.value
        k = projection.shape[1]
        for b in batches:
            at = 0
            for m in _rows(b.column(1), width, BLOCK // 4):
                d = deviations(m, n, sums)
                exact = d if d.dtype == object or float((d.astype(np.float64) ** 2).sum(1).max()) > 2**62 else None
                square = (d**2).sum(1) if exact is None else [v if (v := sum(int(e) ** 2 for e in r)) < 1 << 63 else None for r in exact]
                white = d.astype(np.float64) / n @ projection
                ids = b.column(0).slice(at, len(m)).take(pa.array(np.repeat(np.arange(len(m)), k)))
                each = [pa.array(np.tile(np.arange(1, k + 1), len(m)), pa.int32()), pa.array(np.full(len(m) * k, n), pa.int64()), pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(len(m)), k))), pa.array(white.ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(m) * k, error))]
                yield pa.RecordBatch.from_arrays([ids, *each], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += len(m)

    return rows.where(F.size("x") == width).mapInArrow(project, schema)

"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become fixed-point numbers, and the distinct ones, centred, are the rows of a matrix X that lies in a stored
table. Each step multiplies it by the newest right vector v and what comes out by the transpose of X, in one pass of
the table. A left vector has an entry for each row; it is kept as the short vector p with Xp = u, so that it can be
made orthogonal to all earlier ones by their products with what the passes bring back, and only sums over rows of as
many numbers as there are dimensions ever leave the tasks. Right vectors are kept as they are and are made orthogonal
to all earlier ones twice. The singular vectors of the small bidiagonal matrix turn the right vectors into components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.scratch import stored

#: Fixed-point steps of one.
STEPS = 256
COMPONENTS = 4
#: A singular value, or a residual of one, that is smaller against the largest one counts as nothing.
TINY = 1e-13
_LOW, _HIGH = float(-(1 << 63)), float((1 << 63) - 1024)


def _fixed(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are whole, and their fixed-point numbers, with zeros up to ``d`` of them."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    entries = vectors.flatten()
    sizes = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(entries.to_numpy(zero_copy_only=False), float)  # a null entry becomes no number
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = ~np.asarray(vectors.is_null())
    whole[row[~np.isfinite(values)]] = False
    column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), d), np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        numbers = np.clip(np.nan_to_num(np.floor(values * STEPS), nan=0.0, posinf=_HIGH, neginf=_LOW), _LOW, _HIGH)
    out[row, column] = numbers.astype(np.int64)
    return np.flatnonzero(whole), out[whole]


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """Binary values of ``d`` longs each as a matrix."""
    _, offsets, data = column.buffers()
    if len(column) == 0 or d == 0:
        return np.zeros((len(column), d), np.int64)
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.int64, count=len(column) * d, offset=int(first)).reshape(-1, d)


def _packed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, numbers = _fixed(batch.column(0), d)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in numbers], pa.binary())], names=["x"])


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension, written out, as they may pass a long."""
    total = np.zeros(d, object)
    for batch in batches:
        total += _rows(batch.column(0), d).astype(object).sum(axis=0) if len(batch) else 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(d), pa.int32()), pa.array([str(int(t)) for t in total], pa.string())], names=["place", "total"]
    )


def _products(batches: Iterator[pa.RecordBatch], make: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """``make`` of all centred rows of a task, added up."""
    total = np.zeros(width)
    for batch in batches:
        total += make(_rows(batch.column(0), len(mean)) - mean)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["place", "total"])


def _over_rows(fit: DataFrame, make: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, width: int) -> np.ndarray:
    """``make`` takes centred rows to ``width`` numbers that add up; a job brings back those numbers alone."""
    parts = fit.mapInArrow(partial(_products, make=make, mean=mean, width=width), "place int, total double")
    out = np.zeros(width)
    for row in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[row["place"]] = row["total"]
    return out


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], d: int, trace: float, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values, falling, of the matrix behind ``product`` (v -> XᵀXv).

    Steps end when the residuals of the ``wanted`` largest are nothing and what is left of the trace couldn't hold
    another one as large, so that equal singular values aren't missed; after ``d`` steps at the latest.
    """
    random = np.random.default_rng(seed)
    right, short, back = (np.zeros((0, d)) for _ in range(3))  # v, p with u = Xp, and Xᵀu
    diagonal, above, seen = [], [], 0.0

    def fresh() -> np.ndarray:
        v = random.standard_normal(d)
        for _ in range(3):
            v -= right.T @ (right @ v)
            v /= np.linalg.norm(v)
        return v

    v = fresh()
    while True:
        right = np.vstack([right, v])
        z = product(v)
        seen += v @ z
        p = v.copy()
        for _ in range(2):
            along = short @ z
            p -= short.T @ along
            z = z - back.T @ along
        alpha = float(np.sqrt(max(p @ z, 0.0)))
        scale = max([alpha, *diagonal])
        alive = alpha > TINY * scale and alpha > 0
        diagonal.append(alpha if alive else 0.0)
        short = np.vstack([short, p / alpha if alive else np.zeros(d)])
        back = np.vstack([back, z / alpha if alive else np.zeros(d)])
        k = len(diagonal)
        w = back[-1].copy()
        for _ in range(2):
            w -= right.T @ (right @ w)
        beta = float(np.linalg.norm(w))
        small = np.diag(diagonal) + np.diag(above, 1)
        left, values, turned = np.linalg.svd(small)
        residuals = beta * np.abs(left[-1, :wanted])
        rest = trace - seen
        done = k >= wanted and (residuals <= TINY * values[0]).all() and rest <= values[wanted - 1] ** 2
        if k == d or done or values[0] == 0:
            return (turned @ right).T, values
        if beta > TINY * scale:
            v = w / beta
            above.append(beta)
        else:
            v = fresh()
            above.append(0.0)


def principal_components(fit: DataFrame, d: int, count: int = COMPONENTS) -> dict:
    """Of distinct fixed-point vectors (x binary): n, sums, trace, unit components (columns), their variances, and the
    largest absolute difference of the whitened vectors' covariance from the identity.

    Components without variance to double precision are left out.
    """
    n = fit.count()
    sums = [0] * d
    parts = fit.mapInArrow(partial(_sums, d=d), "place int, total string")
    for row in parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        sums[row["place"]] = int(row["total"])
    out = {"n": n, "sums": sums, "trace": 0.0, "components": np.zeros((d, 0)), "variances": np.zeros(0), "identity_error": 0.0}
    if n == 0 or d == 0:
        return out
    mean = np.array([s / n for s in sums])
    squares = float(_over_rows(fit, lambda y: np.array([(y * y).sum()]), mean, 1)[0])
    if squares == 0:
        return out
    vectors, values = bidiagonalise(lambda v: _over_rows(fit, lambda y: (y @ v) @ y, mean, d), d, squares, min(count, d))
    keep = min(count, int((values > 1e-7 * values[0]).sum()))
    variances, components = values[:keep] ** 2 / n, vectors[:, :keep]
    into = components / np.sqrt(variances)
    middle = _over_rows(fit, lambda y: (y @ into).sum(axis=0), mean, keep) / n

    def spread(y: np.ndarray) -> np.ndarray:
        white = y @ into - middle
        return (white.T @ white).ravel()

    covariance = (_over_rows(fit, spread, mean, keep * keep) / n).reshape(keep, keep)
    return out | {
        "trace": squares / n, "components": components, "variances": variances,
        "identity_error": float(np.abs(covariance - np.eye(keep)).max()),
    }


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null where it passes a long."""
    if len(x) == 0 or x.shape[1] == 0:
        return [0] * len(x)
    # bounds in whole numbers: no product below is made in longs that it could pass
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = x.astype(object) * n - np.array(sums, object)
    return [t if t < 1 << 63 else None for t in map(int, (off * off).sum(axis=1))]


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(batches: Iterator[pa.RecordBatch], found: dict) -> Iterator[pa.RecordBatch]:
    n, sums, keep = found["n"], found["sums"], len(found["variances"])
    mean = np.array([s / n for s in sums])
    into = found["components"] / np.sqrt(found["variances"])
    explained = found["variances"] / found["trace"]
    for batch in batches:
        places, x = _fixed(batch.column("embedding"), len(sums))
        ids = batch.column("vec_id").take(pa.array(places))
        rows = len(places)
        again = pa.array(np.repeat(np.arange(rows), keep))
        columns = [
            ids.take(again), pa.array(np.tile(np.arange(1, keep + 1), rows), pa.int32()), pa.array(np.full(rows * keep, n)),
            pa.array(_deviations(x, n, sums), pa.int64()).take(again), pa.array(((x - mean) @ into).ravel()),
            pa.array(np.tile(explained, rows)), pa.array(np.full(rows * keep, found["identity_error"])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])


def whiten(vectors: DataFrame, count: int = COMPONENTS, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every whole vector and component.

    Vectors that are null or hold a null, infinite or undefined entry are left out. Entries become
    floor(``STEPS`` * c); the components are those of the distinct vectors. A shorter vector counts as filled up with
    zeros, numbers beyond the longs as the nearest long, and a ``deviation`` beyond them is null. Components without
    variance are absent, so equal vectors only, or none, give no rows. Null ids are kept; repeated rows each have
    their rows; of equal variances any directions are chosen. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    d = rows.filter("embedding IS NOT NULL").filter(whole).agg(F.max(F.size("embedding"))).first()[0] or 0
    fit = rows.filter("embedding IS NOT NULL").filter(whole).select("embedding")
    fit = stored(fit.mapInArrow(partial(_packed, d=d), "x binary").distinct(), "fit")
    found = principal_components(fit, d, count)
    if len(found["variances"]) == 0:
        return spark.createDataFrame([], _SCHEMA)
    good = rows.filter("embedding IS NOT NULL").filter(whole)
    return good.mapInArrow(partial(_whitened, found=found), _SCHEMA)

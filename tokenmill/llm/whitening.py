"""Embedding whitening: principal components of a distributed covariance, projected to unit variance.

Entries become whole numbers on a grid, and the components are fitted on the distinct grid
vectors. Tasks add up exact integer products of vectors centred at the rounded mean, so the
covariance is rounded once, whatever the order of the sums. The driver makes it tridiagonal
by Householder reflections, bisects the leading eigenvalues by Sturm counts, and finds their
vectors by inverse iteration, orthogonalised again inside clusters of close eigenvalues. The
components, a few numbers for each dimension, go to the tasks that project the rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.sources import scratch

#: components of a row at most
COMPONENTS = 16

#: steps of the grid to one unit, and the whole number that stands for zero
STEPS, ORIGIN = 64, 1_000_000

#: entries beyond this many grid steps from zero are taken as that many
FARTHEST = 1 << 46

#: integers up to this size are exact in a double
_EXACT = 1 << 53

#: eigenvalues closer than this share of the matrix's norm are one cluster
_CLUSTER = 1e-3

_EPS = np.finfo(float).eps

_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


# eigenvectors of a symmetric matrix

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of Householder's reduction: the k-th reflection's
    unit vector, or an empty one where nothing is reflected, acts on the rows from k + 1 on."""
    a, size = np.array(matrix, float), len(matrix)
    reflections = []
    for k in range(size - 2):
        x = a[k + 1:, k].copy()
        rest = np.abs(x[1:]).max(initial=0.0)
        if rest == 0:
            reflections.append(np.zeros(0))
            continue
        scale = np.abs(x).max()
        x /= scale
        norm = np.copysign(np.sqrt(x @ x), x[0])
        x[0] += norm
        v = x / np.sqrt(x @ x)
        part = a[k + 1:, k + 1:]
        p = part @ v
        q = p - (v @ p) * v
        part -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -norm * scale
        reflections.append(v)
    return a.diagonal().copy(), a.diagonal(1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each value."""
    squares = np.concatenate([[0.0], off * off])
    smallest = max(np.finfo(float).tiny, _EPS * _EPS * squares.max(initial=0.0))
    below, pivot = np.zeros(len(values), np.int64), np.ones(len(values))
    for d, square in zip(diagonal, squares, strict=True):
        pivot = d - values - square / pivot
        pivot = np.where(np.abs(pivot) < smallest, -smallest, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected to neighbouring doubles."""
    size = len(diagonal)
    radius = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    reach = np.abs(diagonal).max() + radius.max()
    slack = 4 * size * _EPS * reach + np.finfo(float).tiny
    low = np.full(count, (diagonal - radius).min() - slack)
    high = np.full(count, (diagonal + radius).max() + slack)
    wanted = size - np.arange(count)  # the i-th largest has size - i - 1 eigenvalues below it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= _EPS * _EPS * reach)).all():
            return high
        above = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _factors(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """LU factors, with row exchanges, of the tridiagonal matrix less ``value`` times one."""
    size = len(diagonal)
    main, upper, second = diagonal - value, np.append(off, 0.0), np.zeros(size)
    steps = []
    for i in range(size - 1):
        swap = abs(off[i]) > abs(main[i])
        if swap:
            factor = main[i] / off[i]
            main[i], upper[i], below = off[i], main[i + 1], upper[i]
            second[i] = upper[i + 1]
            main[i + 1] = below - factor * main[i + 1]
            upper[i + 1] = -factor * second[i]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor = off[i] / main[i]
            main[i + 1] -= factor * upper[i]
        steps.append((swap, factor))
    if abs(main[-1]) < least:
        main[-1] = least
    return main.tolist(), upper.tolist(), second.tolist(), steps


def _solved(factors, right: np.ndarray) -> np.ndarray:
    main, upper, second, steps = factors
    x, size = right.tolist(), len(main)
    for i, (swap, factor) in enumerate(steps):
        if swap:
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            x[i + 1] -= factor * x[i]
    for i in range(size - 1, -1, -1):
        value = x[i]
        if i + 1 < size:
            value -= upper[i] * x[i + 1]
        if i + 2 < size:
            value -= second[i] * x[i + 2]
        x[i] = value / main[i]
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (as columns) of falling eigenvalues by inverse iteration. Those of a
    cluster are made orthogonal to the ones before them in each step."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    vectors, first = np.zeros((size, len(values))), 0
    rng = np.random.default_rng(0)
    used = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > _CLUSTER * norm:
            first = j
        used = min(value, used - 4 * _EPS * norm) if j > first else value  # equal ones are set apart
        factors = _factors(diagonal, off, used, _EPS * norm)
        cluster, x = vectors[:, first:j], rng.standard_normal(size)
        for _ in range(5):
            for _ in range(2):
                x = x - cluster @ (cluster.T @ x)
            x = _solved(factors, x / np.sqrt(x @ x))
            x = x / np.abs(x).max()
        for _ in range(2):
            x = x - cluster @ (cluster.T @ x)
        vectors[:, j] = x / np.sqrt(x @ x)
    return vectors


def leading_eigenvectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    scale = np.abs(matrix).max(initial=0.0) or 1.0
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(count, len(diagonal)))
    vectors = tridiagonal_vectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        if len(v):
            vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * scale, vectors


# the distributed fit

def gridded(batch: pa.RecordBatch, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, entries as whole numbers, one after the other) of the vectors of a batch
    that have entries, all of them finite; of one length only if ``dims`` is given."""
    lists = batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    entries = pc.fill_null(values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(owner, ~np.isfinite(entries), len(sizes)) > 0
    kept = ~bad & (sizes > 0 if dims is None else sizes == dims)
    steps = np.clip(entries[kept[owner]] * STEPS, -FARTHEST, FARTHEST)
    return np.flatnonzero(kept), sizes[kept], np.floor(steps).astype(np.int64) + ORIGIN


def usable(embeddings: DataFrame) -> DataFrame:
    """(dims, x) of the rows whose vector has entries that are all finite, x the whole numbers
    as little-endian 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            _, sizes, x = gridded(batch)
            content, ends = x.astype("<i8").tobytes(), 8 * np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array(sizes, pa.int32()),
                "x": pa.array([content[e - 8 * n:e] for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    return embeddings.select("embedding").mapInArrow(run, "dims int, x binary")


@dataclass(frozen=True)
class Whitening:
    """What the tasks need to project vectors of one length.

    ``n`` vectors with sums ``n * centre + rest`` by dimension; a column of ``directions`` for
    each component, ``variances`` their eigenvalues, ``trace`` the sum of all.
    """

    n: int
    centre: np.ndarray
    rest: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S)^2) of each row, exact; None where a 64-bit integer can't hold it."""
        apart, rest = x - self.centre, np.array(self.rest, object)
        largest, dims = int(np.abs(apart).max(initial=0)), x.shape[1]
        if dims * largest * max(largest, *map(abs, self.rest)) >= 1 << 63:
            apart = apart.astype(object)
        else:
            rest = rest.astype(np.int64)
        squares, crossed = (apart * apart).sum(axis=1).tolist(), (apart @ rest).tolist()
        own = sum(r * r for r in self.rest)
        totals = (self.n * self.n * s - 2 * self.n * c + own for s, c in zip(squares, crossed, strict=True))
        return [total if total < 1 << 63 else None for total in totals]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        means = np.array([r / self.n for r in self.rest])
        return ((x - self.centre) - means) @ self.directions / np.sqrt(self.variances)


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(batch.num_rows, dims)


def products(apart: np.ndarray) -> np.ndarray:
    """Exact sums of products of every two columns, as Python integers."""
    largest = int(np.abs(apart).max(initial=0))
    total = np.zeros((apart.shape[1], apart.shape[1]), object)
    if largest * largest >= _EXACT:
        return total + apart.T.astype(object) @ apart.astype(object)
    step = max(1, _EXACT // max(1, largest * largest))
    for start in range(0, len(apart), step):
        part = apart[start:start + step].astype(float)
        total = total + (part.T @ part).astype(np.int64)  # every partial sum is a whole double
    return total


_SUMS = "i int, j int, total decimal(38,0)"


def _table(i, j, totals) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(totals, pa.decimal128(38, 0))], ["i", "j", "total"])


def _summed(dims: int):
    """Count, as place -1, and sums by dimension of a task's vectors."""
    def run(batches: Iterator[pa.RecordBatch]):
        total, n = np.zeros(dims, object), 0
        for batch in batches:
            n += batch.num_rows
            total = total + (_rows(batch, dims) - ORIGIN).sum(axis=0)
        if n:
            places = [-1, *range(dims)]
            yield _table(places, places, [n, *map(int, total)])
    return run


def _multiplied(dims: int, centre: np.ndarray):
    """Products of a task's vectors, centred, for each two dimensions."""
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            part = products(_rows(batch, dims) - centre)
            total = part if total is None else total + part
        if total is not None:
            yield _table(i, j, [int(t) for t in total[i, j]])
    return run


def _added(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over all tasks; a number for each two dimensions reaches the driver."""
    return {(r.i, r.j): int(r.total) for r in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def fit(fit_list: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Learn from distinct vectors (x) of one length. Only components of a variance that can
    be told from rounding are kept, so there may be fewer than ``components``, or none."""
    sums = _added(fit_list.select("x").mapInArrow(_summed(dims), _SUMS))
    n = sums.pop((-1, -1))
    nearest = [(2 * sums[d, d] + n) // (2 * n) for d in range(dims)]
    rest = [sums[d, d] - n * nearest[d] for d in range(dims)]
    centre = np.array(nearest, np.int64) + ORIGIN
    crossed = _added(fit_list.select("x").mapInArrow(_multiplied(dims, centre), _SUMS))
    covariance = np.zeros((dims, dims))
    for (i, j), total in crossed.items():  # exact up to the one division
        covariance[i, j] = covariance[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    values, vectors = leading_eigenvectors(covariance, components)
    kept = values > max(4 * dims * _EPS * np.abs(covariance).sum(axis=1).max(), 1e-300)
    return Whitening(n, centre, rest, np.ascontiguousarray(vectors[:, kept]), values[kept], float(covariance.trace()))


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened ``fit_list`` less the
    identity; its vectors are centred before they are projected."""
    count, dims = len(model.variances), len(model.centre)
    if not count:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]):
        products, sums = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            whitened = model.whitened(_rows(batch, dims))
            products += whitened.T @ whitened
            sums += whitened.sum(axis=0)
        i, j = np.indices((count, count)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.append(i, np.full(count, -1)), pa.int32()),
            "j": pa.array(np.append(j, np.arange(count)), pa.int32()),
            "total": np.append(products.reshape(-1), sums)})

    totals = fit_list.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()
    found, means = np.zeros((count, count)), np.zeros(count)
    for r in totals:
        if r.i < 0:
            means[r.j] = r.total / model.n
        else:
            found[r.i, r.j] = r.total / model.n
    return float(np.abs(found - np.outer(means, means) - np.eye(count)).max())


def project(embeddings: DataFrame, model: Whitening, error: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the usable
    rows of the model's length, one for each component."""
    count, dims = len(model.variances), len(model.centre)
    shares = model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, _, x = gridded(batch, dims)
            x = x.reshape(len(rows), dims)
            each = np.repeat(np.arange(len(rows)), count)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(rows[each])),
                "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                "n": pa.array(np.full(len(each), model.n)),
                "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(model.whitened(x).reshape(-1)),
                "explained": pa.array(np.tile(shares, len(rows))),
                "identity_error": pa.array(np.full(len(each), error))})

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, _RESULT)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the rows of
    ``embeddings`` (vec_id, embedding), one row for each component.

    Vectors that are NULL, empty, or hold a NULL or an entry that is not finite have no rows.
    Vectors of each length are a space of their own, with its own fit. Repeated rows and NULL
    vec_ids are projected each; equal vectors are fitted once. A space without variance, such
    as one of a single distinct vector, has no component and so no rows; one of less rank than
    ``components`` has as many as its rank. A deviation beyond 64 bits is NULL; entries
    farther than ``FARTHEST`` grid steps from zero are taken as that far.
    """
    spark = embeddings.sparkSession
    fit_list, path = scratch.placed(usable(embeddings).distinct(), "distinct-vectors", "zstd")
    result = spark.createDataFrame([], _RESULT)
    lengths = sorted(r.dims for r in fit_list.select("dims").distinct().collect())  # one for each vector length
    for dims in lengths:
        space = fit_list.where(F.col("dims") == dims)
        model = fit(space, dims, components)
        if len(model.variances):
            result = result.union(project(embeddings, model, identity_error(space, model)))
    scratch.remove(spark, path)
    return result

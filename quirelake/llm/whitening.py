"""Embedding whitening: leading components of a distributed covariance, and projections to unit variance.

Each entry c of a vector becomes the whole number x = floor(64 * c) + 1000000.
The model is fitted to each distinct x vector once: their number n, their sums
S (exact), and the covariance of x - S / n, which tasks add up for their rows
and Spark adds up by rows of the matrix. The driver gets these d rows of d
numbers, whatever the size of the table. It brings the matrix to tridiagonal
form by Householder reflections, finds the leading eigenvalues by bisection
with Sturm counts, their vectors by inverse iteration, made orthogonal within
clusters of close eigenvalues, and turns them back. The d x k matrix goes to
all tasks, which project their rows.

Rows whose vector is null or holds null or non-finite entries are left out, and
so are rows with an entry whose x does not fit 64 bits. A shorter vector counts
as filled up with zeros (x = 1000000). Rows that share a vec_id, null ones too,
are rows of their own. A component without variance (its eigenvalue below
1e-13 of the largest) can't be scaled to one: whitened is null, and it is not
part of the error. A deviation beyond 64 bits is null, and its digits are in
deviation_digits, which is null otherwise. An empty table gives no rows. Columns
other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Share of the largest eigenvalue below which a component counts as without variance.
FLAT = 1e-13
#: Sums of a matrix row are added up by this many tasks before one adds them.
SLOTS = 64
EPS = float(np.finfo(float).eps)


# Eigenvectors of a symmetric matrix ----------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal, and the unit Householder vectors (with the column they begin at) that bring a to this form."""
    a = np.array(a, float)
    n, turns = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        # H A H with H = I - 2 v v': a rank-two change of what is left.
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        turns.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are less than each x."""
    least = EPS * max(float(np.abs(d).max(initial=0)), float(np.abs(e).max(initial=0)), np.finfo(float).tiny / EPS)
    q, count = d[0] - x, np.zeros(len(x), int)
    for i in range(len(d)):
        if i:
            q = d[i] - x - e[i - 1] ** 2 / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all at once."""
    n = len(d)
    reach = np.abs(np.concatenate([e, [0]])) + np.abs(np.concatenate([[0], e]))
    slack = 2 * EPS * max(abs((d - reach).min()), abs((d + reach).max())) * n + np.finfo(float).tiny
    low, high = np.full(k, (d - reach).min() - slack), np.full(k, (d + reach).max() + slack)
    wanted = n - 1 - np.arange(k)  # the number of eigenvalues below
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        more = below(d, e, middle) > wanted
        low, high = np.where(more, low, middle), np.where(more, middle, high)


def solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = b, by elimination with row exchanges; a pivot of zero counts as least."""
    n = len(d)
    main, up, up2, b = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        own, nxt, after = e[i], main[i + 1], up[i + 1]
        if abs(own) > abs(main[i]):
            rate = main[i] / own
            main[i], main[i + 1], up[i + 1] = own, up[i] - rate * nxt, -rate * after
            up[i], up2[i] = nxt, after
            b[i], b[i + 1] = b[i + 1], b[i] - rate * b[i + 1]
        else:
            if main[i] == 0:
                main[i] = least
            rate = own / main[i]
            main[i + 1] = nxt - rate * up[i]
            b[i + 1] -= rate * b[i]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > least else np.copysign(least, main[i] or 1.0)
        x[i] = (b[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (up2[i] * x[i + 2] if i + 2 < n else 0)) / pivot
    return x


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    k = min(k, n)
    unit = float(np.abs(a).max(initial=0))
    if unit == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, turns = tridiagonal(a / unit)
    size = max(float(np.abs(d).max(initial=0)), float(np.abs(e).max(initial=0)))
    # Off-diagonals that are nothing beside their diagonals cut the matrix into blocks of their own.
    e = np.where(np.abs(e) <= EPS * np.sqrt(np.abs(d[:-1] * d[1:])) * 0.01, 0.0, e)
    values = leading_values(d, e, k)
    random, least = np.random.default_rng(0), EPS * size
    vectors = np.zeros((n, k))
    start = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > 1e-3 * size:
            start = j
        # Equal eigenvalues are told apart by a nudge, and their vectors by the ones before.
        shift = values[j] - (j - start) * 2 * least if j > start and values[j - 1] - values[j] < 2 * least else values[j]
        x = random.standard_normal(n)
        for _ in range(6):
            x /= np.linalg.norm(x)
            x = solved(d, e, shift, x, least)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[:, start:j] @ (vectors[:, start:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    for at, v in reversed(turns):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    return values * unit, vectors / np.linalg.norm(vectors, axis=0)


# The model, and what tasks do -----------------------------------------------------------------------


@dataclass
class Whitening:
    """n, the exact sums S, eigenvalues and components (columns) of the covariance with its trace; error is max |cov(whitened) - I|."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; NaN where there is no variance."""
        flat = self.values <= FLAT * max(float(self.values.max(initial=0)), np.finfo(float).tiny)
        return self.vectors / np.sqrt(np.where(flat, np.nan, self.values))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The x vectors of a batch, filled up to size."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(column), size), SHIFT, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    ends = np.cumsum(lengths)
    for i, (b, m) in enumerate(zip(ends, lengths, strict=True)):
        out[i, :m] = flat[b - m : b]
    return out


def _times(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole numbers of 64 bits where they suffice, Python's beyond."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, each rounded once."""
    off = _times(x, n, sums)
    if off.dtype == object:
        return np.array([[v / n for v in row] for row in off], float).reshape(off.shape)
    return off.astype(float) / n if np.abs(off).max(initial=0) < 1 << 53 else (off // n).astype(float) + (off % n).astype(float) / n


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows of vectors (vec_id, embedding) that take part."""
    value = lambda c: F.floor(c.cast("double") * SCALE)
    # A long floor saturates at its ends, where x would not fit.
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float(1 << 62) * 1.9, F.lit(False))
    some = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: fits(c) & ~F.isnan(c)))
    return some.select("vec_id", F.transform("embedding", lambda c: value(c) + F.lit(SHIFT).cast("long")).alias("x"))


def _trimmed(x: str) -> F.Column:
    """x without what filling up would add, so that vectors that are equal when filled up are equal."""
    last = F.aggregate(F.transform(x, lambda v, i: F.when(v != SHIFT, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(x, F.lit(1), last)


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The rows of a matrix by number: sums over what tasks have made of them (i, slot, part, row), in a fixed order."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        whole = np.sum([np.array(r.as_py()) for r in rows.column("row")], axis=0)
        return pa.table({"i": rows.column("i")[:1], "slot": pa.array([0], pa.int32()), "part": rows.column("slot")[:1], "row": pa.array([whole.tolist()], pa.list_(pa.float64()))})

    schema = "i int, slot int, part int, row array<double>"
    whole = parts.groupBy("i", "slot").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)
    return {r.i: np.array(r.row) for r in whole.collect()}


def _products(fit: DataFrame, size: int, made) -> DataFrame:
    """(i, slot, part, row) of the sums over rows of made(x)' made(x), one set for each task, and the sums of made(x) as the last row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, sums = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = made(_matrix(batch.column("x"), size))
            total = y.T @ y if total is None else total + y.T @ y
            sums = y.sum(axis=0) if sums is None else sums + y.sum(axis=0)
        if total is not None:
            rows = [*total.tolist(), sums.tolist()]
            fixed = [pa.array(c, pa.int32()) for c in (range(len(rows)), [part % SLOTS] * len(rows), [part] * len(rows))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(rows, pa.list_(pa.float64()))], ["i", "slot", "part", "row"])

    return fit.mapInArrow(each, "i int, slot int, part int, row array<double>")


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of rows (x); None if there is no row, or none with an entry."""
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not size:
        return None
    # Copies of a vector are brought together where they lie before anything is sent.
    fit = written(rows.select(_trimmed("x").alias("x")).distinct(), "fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)] if len(x) else total
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total], pa.string()), pa.array([n] * size, pa.int64())], ["i", "total", "n"])

    found = fit.mapInArrow(sums, "i int, total string, n bigint").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    by = {r.i: r for r in found}
    n, whole = by[0].n, [int(by[i].total) for i in range(size)]
    added = _added(_products(fit, size, lambda x: centred(x, n, whole)))
    mean = added[size] / n
    covariance = np.array([added[i] for i in range(size)]) / n - np.outer(mean, mean)  # the means of centred rows: nothing but rounding
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_components(covariance, components)
    model = Whitening(n, whole, values, vectors, float(np.trace(covariance)))
    scaled = model.scaled
    live = np.isfinite(scaled).all(axis=0)
    if live.any():
        kept = scaled[:, live]
        white = _added(_products(fit, size, lambda x: centred(x, n, whole) @ kept))
        k = kept.shape[1]
        mean = white[k] / n
        model.error = float(np.abs(np.array([white[i] for i in range(k)]) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """For each row (vec_id, x) and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    size, k = len(model.sums), len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    explained = (model.values / model.trace if model.trace > 0 else np.zeros(k)).tolist()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            off, count = _times(x, model.n, model.sums), len(x)
            if off.dtype == object or int(np.abs(off).max(initial=0)) ** 2 * size >= 1 << 63:
                far = [sum(int(v) ** 2 for v in row) for row in off]
            else:
                far = (off**2).sum(axis=1).tolist()
            value = (centred(x, model.n, model.sums) @ model.scaled).ravel()
            short = [v if v < 1 << 63 else None for v in far]
            digits = [None if v < 1 << 63 else str(v) for v in far]
            again = lambda c, t: pa.array(np.repeat(np.array(c, object), k), t)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), k)))
            fixed = lambda c: pa.array(np.tile(np.array(c), count))
            yield pa.RecordBatch.from_arrays(
                [ids, fixed(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(count * k, model.n, np.int64)), again(short, pa.int64()), pa.array(value, mask=np.isnan(value)), fixed(np.array(explained, float)), pa.array(np.full(count * k, model.error)), again(digits, pa.string())], names
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = fitted(rows)
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
        rows = rows.limit(0)
    return whitened(rows, model)

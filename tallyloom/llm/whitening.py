"""Whitening of embeddings by an incremental eigendecomposition that partitions hold and combine.

With M the scatter (n times the covariance) of the vectors seen so far and m their mean, one more vector x of weight w
changes M by a centred rank-one term, n w / (n + w) (x - m)(x - m)^T. A spectrum M = Q diag(e) Q^T is kept up to date:

1. Each partition starts from nothing and applies one rank-one update per distinct vector of a batch, weighted by its
   copies. In the basis Q the update is diag(e) + r z z^T. Entries with a negligible z, and all but one of each set of
   equal eigenvalues (after a rotation), are deflated; the other eigenvalues are the roots of the secular equation
   1 + r sum z_i^2 / (e_i - t) = 0, one between each two neighbours, and give the eigenvectors.
2. Spectra are combined in rounds of FAN_IN: the eigenvectors of one enter the other as rank-one updates weighted by
   their eigenvalues, and the difference of the means as one more.
3. The last basis is orthonormalised, all rows are projected on it once more, and the eigenvectors of that small
   covariance turn it into the final one (Rayleigh-Ritz in the whole space, so the result is exact to rounding). It is
   repeated until the off-diagonal part is as small as rounding, or MOST_PASSES is reached.

What goes through the driver: one spectrum (d x d) for each length of vector, whatever the number of rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do empty ones. Vectors
of different lengths are whitened apart, each length with its own n. Repeated rows and equal or null ids count each.
A component without variance (eigenvalue below NOTHING of the trace) has `whitened` null and `explained` 0; where no
row varies, `explained` is null. `deviation` is null where it exceeds 64 bits. Components beyond 2^50 after scaling are
held at 2^50. An empty table gives an empty result. Extra columns are not read; the result has its own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow import ranges
from tallyloom.session import shared_path

FAN_IN = 8
MOST_PASSES = 4
NOTHING = 1e-13
EPS = float(np.finfo(float).eps)
LARGEST = float(2**50)
STATE = "dim int, n bigint, sums binary, mean binary, values binary, vectors binary"
PART = "dim int, part binary"


@dataclass
class Spectrum:
    """n vectors with exact integer sums, their mean, and scatter = vectors diag(values) vectors^T."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray  # ascending
    vectors: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, np.zeros(dim, np.int64), np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray, weight: int) -> None:
        """`weight` copies of the integer vector x."""
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(
                self.values, self.vectors, away, self.n * weight / (self.n + weight)
            )
        self.mean = self.mean + away * (weight / (self.n + weight))
        self.sums = self.sums + weight * x
        self.n += weight

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1], strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        away = other.mean - self.mean
        if self.n:
            rate = self.n * other.n / (self.n + other.n)
            self.values, self.vectors = rank_one(self.values, self.vectors, away, rate)
        self.mean = self.mean + away * (other.n / (self.n + other.n))
        self.sums = self.sums + other.sums
        self.n += other.n


def secular_roots(d: np.ndarray, z2: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rate * sum(z2 / (d - t)), as (t - d[near], near): `near` is the closer pole, for full accuracy.

    d ascends strictly and z2 > 0. Root i lies between d[i] and d[i + 1], the last one below d[-1] + rate * sum(z2).
    """
    size = len(d)
    end = np.append(d[1:], d[-1] + rate * z2.sum())
    half = (end - d) / 2
    weight = rate * z2
    right = 1 + (weight / (d[None, :] - d[:, None] - half[:, None])).sum(axis=1) < 0
    right[-1] = False  # no pole on that side
    near = np.arange(size) + right
    poles = d[None, :] - d[near][:, None]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, np.where(np.arange(size) == size - 1, 2, 1) * half)
    below = np.tri(size, dtype=bool)  # poles on the left of root i
    own, other = d - d[near], end - d[near]
    t = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(1100):  # a bound: halvings of a bracket of doubles; steps as below take about 6
            away = poles - t[:, None]
            term = weight / away
            f = 1 + term.sum(axis=1)
            noise = 2 * EPS * size * (1 + np.abs(term).sum(axis=1))
            up = f > 0
            low, high = np.where(up, low, t), np.where(up, t, high)
            if ((np.abs(f) <= noise) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))).all():
                break
            # Both sides are replaced by one pole each with the same value and slope, and that is solved.
            slope = term / away
            left = np.where(below, slope, 0.0).sum(axis=1)
            one, two = own - t, other - t
            rest = slope.sum(axis=1) - left
            a = (one + two) * f - one * two * (left + rest)
            b = one * two * f
            c = f - one * left - two * rest
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = t + step
            t = np.where(np.abs(f) <= noise, t, np.where((new > low) & (new < high), new, (low + high) / 2))
    return t, near


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of vectors diag(values) vectors^T + rate * x x^T; `values` ascend, rate > 0."""
    z = vectors.T @ x
    length = float(np.sqrt(z @ z))
    if length == 0 or rate == 0:
        return values, vectors
    z, rate = z / length, rate * length * length
    tiny = 8 * EPS * max(abs(values[0]), abs(values[-1]), rate)
    alive = np.flatnonzero(rate * abs(z) > tiny)
    # Equal eigenvalues: a rotation in their space leaves one of each two with all of z.
    if len(alive) > 1 and (np.diff(values[alive]) <= tiny / np.maximum(abs(z[alive[1:]]), EPS)).any():
        vectors = vectors.copy()
        kept, i = [], alive[0]
        for j in alive[1:]:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if (values[j] - values[i]) * abs(c * s) <= tiny:
                one, two = vectors[:, i].copy(), vectors[:, j].copy()
                vectors[:, i], vectors[:, j] = c * one - s * two, s * one + c * two
                values = values.copy()
                a, b = values[i], values[j]
                values[i], values[j] = c * c * a + s * s * b, s * s * a + c * c * b
                z[i], z[j] = 0.0, r
            else:
                kept.append(i)
            i = j
        alive = np.array([*kept, i])
        alive = alive[np.argsort(values[alive], kind="stable")]
    if not len(alive):
        return values, vectors
    d = values[alive]
    offset, near = secular_roots(d, z[alive] ** 2, rate)
    gap = (d[None, :] - d[near][:, None]) - offset[:, None]  # d_j - t_i
    # The z for which these roots are exact keeps the eigenvectors orthogonal (product of the roots' distances).
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    ratio = -gap / apart.T
    np.fill_diagonal(ratio, -np.diagonal(gap))
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0)))
    inner = np.copysign(exact, z[alive])[None, :] / gap
    inner /= np.sqrt((inner * inner).sum(axis=1))[:, None]
    fresh, basis = values.copy(), vectors.copy()
    fresh[alive] = d[near] + offset
    basis[:, alive] = vectors[:, alive] @ inner.T
    order = np.argsort(fresh, kind="stable")
    return np.maximum(fresh[order], 0.0), basis[:, order]


def _packed(states: dict[int, Spectrum]) -> pa.RecordBatch:
    s = list(states.items())
    blob = lambda get: pa.array([np.ascontiguousarray(get(x)).tobytes() for _, x in s], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in s], pa.int32()),
            pa.array([x.n for _, x in s], pa.int64()),
            blob(lambda x: x.sums),
            blob(lambda x: x.mean),
            blob(lambda x: x.values),
            blob(lambda x: x.vectors),
        ],
        names=["dim", "n", "sums", "mean", "values", "vectors"],
    )


def _unpacked(row: dict) -> Spectrum:
    floats = lambda name: np.frombuffer(row[name], float)
    dim = row["dim"]
    sums = np.frombuffer(row["sums"], np.int64)
    return Spectrum(row["n"], sums, floats("mean"), floats("values"), floats("vectors").reshape(dim, dim))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer matrix) of the vectors of a batch."""
    column = batch.column(batch.schema.get_field_index("x"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[ranges(start[rows], size[rows])].reshape(len(rows), -1)


def integer_vectors(table: DataFrame, ident: str, vector: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(id, x array<bigint>) with x = floor(scale * component) + shift, for the vectors that take part."""
    v = F.col(f"`{vector}`")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    return table.filter(v.isNotNull() & (F.size(v) > 0) & sound).select(
        F.col(f"`{ident}`").alias("id"), F.transform(v, lambda c: F.floor(held(c)) + F.lit(shift).cast("bigint")).alias("x")
    )


def partial_spectra(vectors: DataFrame) -> DataFrame:
    """One state for each partition and length of vector."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Spectrum] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                state = own.setdefault(dim, Spectrum.empty(dim))
                for row, copies in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
                    state.add(row, int(copies))
        if own:
            yield _packed(own)

    return vectors.select("x").mapInArrow(states, STATE)


def combined(vectors: DataFrame) -> list[Spectrum]:
    """The spectrum of all vectors, one for each length, combined by FAN_IN in rounds."""
    spark = vectors.sparkSession

    def merged(group: pa.Table) -> pa.Table:
        # Sorted, so that a repeated task adds up in the same order.
        rows = sorted(group.select(["dim", "n", "sums", "mean", "values", "vectors"]).to_pylist(), key=lambda r: (r["n"], r["mean"]))
        state = _unpacked(rows[-1])
        for row in rows[-2::-1]:
            state.merge(_unpacked(row))
        return pa.Table.from_batches([_packed({rows[0]["dim"]: state})])

    path = shared_path(spark, "spectra")
    partial_spectra(vectors).withColumn("part", F.spark_partition_id()).write.parquet(path)
    states = spark.read.parquet(path)
    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        states = states.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = -(-parts // FAN_IN)
        keyed = f"{STATE}, part int"

        def with_part(key: tuple, group: pa.Table) -> pa.Table:
            return merged(group).append_column("part", pa.array([key[1].as_py()], pa.int32()))

        path = shared_path(spark, "spectra")
        states.groupBy("dim", "part").applyInArrow(with_part, keyed).write.parquet(path)
        states = spark.read.parquet(path)
        if parts == 1:
            return [_unpacked(r.asDict()) for r in states.orderBy("dim").collect()]


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Entry-wise sums of the arrays `part` per length; partial sums of FAN_IN^2 buckets come first."""

    def total(group: pa.Table) -> pa.Table:
        rows = sorted(group["part"].to_pylist())
        part = np.sum([np.frombuffer(r, float) for r in rows], axis=0)
        return pa.table({"dim": group["dim"].slice(0, 1), "part": pa.array([part.tobytes()], pa.binary())})

    bucket = F.pmod(F.xxhash64("part"), F.lit(FAN_IN * FAN_IN))
    once = parts.groupBy("dim", bucket.alias("bucket")).applyInArrow(total, PART)
    return {r["dim"]: np.frombuffer(r["part"], float) for r in once.groupBy("dim").applyInArrow(total, PART).collect()}


@dataclass
class Whitening:
    """Per length of vector: n, exact sums, components (columns, falling eigenvalues) and the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, by n * x - sums in whole numbers where they fit."""
        near = self.sums // self.n
        return (x - near) - (self.sums - near * self.n) / self.n

    def projected(self, x: np.ndarray, count: int) -> np.ndarray:
        """Whitened coordinates; not finite for components without variance."""
        count = min(count, len(self.values))
        e = np.where(self.values[:count] > NOTHING * self.trace, self.values[:count], np.nan)
        return self.centred(x) @ self.components[:, :count] / np.sqrt(e)


def fit(vectors: DataFrame) -> dict[int, Whitening]:
    """The whitening of each length of vector, from all rows."""
    fitted = {}
    for s in combined(vectors):
        basis = np.linalg.qr(s.vectors[:, ::-1])[0]
        fitted[len(s.mean)] = Whitening(s.n, s.sums, basis, s.values[::-1] / s.n, float(s.values.sum() / s.n))
    for _ in range(MOST_PASSES if fitted else 0):
        settled = True
        for dim, total in _summed(_moments(vectors, fitted)).items():
            model = fitted[dim]
            small = total.reshape(dim, dim) / model.n
            size = np.abs(small).max()
            off = np.abs(small - np.diag(np.diagonal(small))).max()
            values, turn = np.linalg.eigh((small + small.T) / 2)
            components = np.linalg.qr(model.components @ turn[:, ::-1])[0]
            fitted[dim] = Whitening(model.n, model.sums, components, np.maximum(values[::-1], 0.0), float(np.trace(small)))
            settled &= bool(off <= 64 * EPS * size)
        if settled:
            break
    return fitted


def _moments(vectors: DataFrame, fitted: dict[int, Whitening]) -> DataFrame:
    """Per partition and length: sum of b b^T over the rows' coordinates b in the current basis."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                b = fitted[dim].centred(x) @ fitted[dim].components
                own[dim] = own.get(dim, 0) + b.T @ b
        if own:
            yield _parts(own)

    return vectors.select("x").mapInArrow(moments, PART)


def _parts(own: dict[int, np.ndarray]) -> pa.RecordBatch:
    blobs = [np.ascontiguousarray(x, float).tobytes() for x in own.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(blobs, pa.binary())], names=["dim", "part"])


def identity_errors(vectors: DataFrame, fitted: dict[int, Whitening], count: int) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                w = np.nan_to_num(fitted[dim].projected(x, count), nan=0.0)
                own[dim] = own.get(dim, 0) + np.vstack([w.T @ w, w.sum(axis=0)])
        if own:
            yield _parts(own)

    errors = {}
    for dim, total in _summed(vectors.select("x").mapInArrow(measured, PART)).items():
        model, size = fitted[dim], min(count, dim)
        total = total.reshape(size + 1, size) / model.n
        kept = model.values[:size] > NOTHING * model.trace
        error = total[:size] - np.outer(total[size], total[size]) - np.eye(size)
        errors[dim] = float(np.abs(error[np.ix_(kept, kept)]).max(initial=0.0))
    return errors


def whiten(vectors: DataFrame, count: int = 8, fitted: dict[int, Whitening] | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for a table of (id, x array<bigint>).

    One row for each vector and component up to `count`. `fitted` may come from fit() over other rows.
    """
    models = fit(vectors) if fitted is None else fitted
    errors = identity_errors(vectors, models, count) if models else {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for dim, at, x in _by_length(batch):
                model, size = models[dim], min(count, dim)
                w = model.projected(x, size)
                # n * x - sums = n * (x - near) - rest, in whole numbers below 2^63
                near = model.sums // model.n
                rest = model.sums - near * model.n
                away = np.abs(x - near).max(axis=1, initial=0).astype(float) * model.n + float(np.abs(rest).max())
                fits = away * away * dim < 2.0**63
                deviation = ((model.n * (x - near) - rest) ** 2).sum(axis=1)
                e = model.values[:size]
                explained = np.where(e > NOTHING * model.trace, e, 0.0) / (model.trace or np.nan)
                repeat = lambda a: np.repeat(a, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(repeat(at))).cast(pa.int64()),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * size, model.n)),
                        pa.array(repeat(deviation), mask=repeat(~fits)),
                        pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                        pa.array(np.tile(explained, len(at)), mask=np.tile(np.isnan(explained), len(at))),
                        pa.array(np.full(len(at) * size, errors[dim])),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return vectors.select("id", "x").mapInArrow(rows, schema)

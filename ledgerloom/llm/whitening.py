"""Whitening of embeddings from exact variances.

Method: polarisation. Vectors become integers x = floor(64 * entry) + OFFSET, and each distinct one counts
once (the fit list). A first pass sums every dimension. A second sums the exact squared centred values of
every dimension and of every sum of two dimensions; half of what the variance of a sum has beyond the
variances of its parts is their covariance. From these the covariance matrix is assembled for ``eigh``.

All sums are whole numbers: values are centred at the whole part of the mean, which keeps them small, and
the rest, the same for all rows, goes into the sums of squares on assembly, as
sum (n * p - r)^2 = n^2 * sum p^2 - n * r^2 where r = sum p. Tasks hand on one row for each dimension or
pair; the driver sees these sums, whose number depends on the vectors' width alone.

Distinct vectors are grouped in packed form, in the fewest bytes of 1, 2, 4 or 8 an entry, after partial
aggregation, so that a frequent vector is no hot key; the packed fit list is a checkpoint.

Defined results: a row whose vector is null or holds null, NaN or an infinity is dropped; one of no
entries has no component. Vectors of several widths are fitted by width, each with its own n. floor(64 *
entry) beyond 2^40 to either side counts as 2^40. Null and repeated vec_id pass through, a row each. A
direction without variance (EXPLAINED_FLOOR of the largest) is no component, so that one distinct vector
alone gives no rows, as does an empty table. deviation is null where it does not fit in a long. Other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

SCALE, OFFSET, BOUND = 64, 1_000_000, 1 << 40
#: Components that are returned.
COMPONENTS = 16
#: Least eigenvalue of a component, as a part of the largest.
EXPLAINED_FLOOR = 1e-11
#: Rows whose pair sums a task holds at a time.
ROWS = 2048


@dataclass(frozen=True)
class Whitening:
    """A fit: rows of the fit list, whole parts and remainders of the means (x less OFFSET: mean = whole + rest / n), unit components as columns with their eigenvalues, the share that each explains, and the largest error of the whitened covariance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, q: np.ndarray) -> np.ndarray:
        return q - self.whole - self.rest / self.n

    def whiten(self, q: np.ndarray) -> np.ndarray:
        return self.centred(q) @ self.components / np.sqrt(self.eigenvalues)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x less OFFSET) of the good vectors, by width; vectors without entries are left out."""
    held = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    widths = pc.list_value_length(column).drop_null().to_numpy().astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(widths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = bad[ends] == bad[ends - widths]
    with np.errstate(invalid="ignore", over="ignore"):
        q = np.clip(np.nan_to_num(np.floor(values * SCALE)), -BOUND, BOUND).astype(np.int64)
    for width in np.unique(widths[good & (widths > 0)]):
        own = np.flatnonzero(good & (widths == width))
        yield held[own], q[(ends - widths)[own][:, None] + np.arange(width)]


def _packed(q: np.ndarray) -> list[bytes]:
    """Rows as bytes: the size of an entry, then the entries, in the least size that holds them all."""
    out: list[bytes] = [b""] * len(q)
    low, high = q.min(axis=1), q.max(axis=1)
    left = np.ones(len(q), bool)
    for size in (1, 2, 4, 8):
        fits = left & (low >= -(1 << (8 * size - 1))) & (high < 1 << (8 * size - 1))
        raw, step = q[fits].astype(f"<i{size}").tobytes(), size * q.shape[1]
        for k, row in enumerate(np.flatnonzero(fits)):
            out[row] = bytes([size]) + raw[k * step : (k + 1) * step]
        left &= ~fits
    return out


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The packed vectors of a batch, a matrix for each width and size."""
    by: dict[tuple[int, int], list[bytes]] = {}
    for p in batch.column("packed").to_pylist():
        by.setdefault((len(p), p[0]), []).append(p[1:])
    for (_, size), rows in by.items():
        yield np.frombuffer(b"".join(rows), f"<i{size}").reshape(len(rows), -1).astype(np.int64)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct vector of whole numbers once, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            for _, q in _matrices(batch.column("embedding")):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(q), pa.binary())], ["packed"])

    return vectors.select("embedding").mapInArrow(run, "packed binary").distinct()


def _sums(fits: DataFrame, name: str, add) -> dict[int, dict[tuple[int, int], int]]:  # noqa: ANN001
    """By width, the exact sums (called name) by (i, j) that ``add(q)`` gives for matrices of whole numbers: arrays i, j and values. A task hands on one row a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in slices(batches, ROWS):
            for q in _unpacked(batch):
                i, j, values = add(q)
                held = totals.setdefault(q.shape[1], [i, j, 0])
                held[2] = held[2] + values.astype(object)
        for width, (i, j, values) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["width", "i", "j", name])

    rows = fits.mapInArrow(run, f"width int, i int, j int, {name} decimal(38,0)").groupBy("width", "i", "j").agg(F.sum(name).cast("decimal(38,0)").alias("value")).collect()
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows:
        out.setdefault(r.width, {})[r.i, r.j] = int(r.value)
    return out


def _count_and_sums(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = q.shape[1]
    return np.concatenate([[-1], np.arange(d)]), np.full(d + 1, -1), np.concatenate([[len(q)], q.sum(axis=0)])


def _squares(q: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of squares of every dimension (i, i) and of every sum of two (i, j)."""
    p = q - whole
    if len(p) * (2 * int(np.abs(p).max())) ** 2 >= 1 << 62:
        p = p.astype(object)
    i, j = np.triu_indices(q.shape[1])
    out = np.empty(len(i), p.dtype)
    at = 0
    for k in range(p.shape[1]):
        pair = p[:, k:] + p[:, k : k + 1]
        pair[:, 0] = p[:, k]
        out[at : at + pair.shape[1]] = (pair * pair).sum(axis=0)
        at += pair.shape[1]
    return i, j, out


def _covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Polarisation of exact sums; one rounding an entry."""
    d = len(rest)
    of = lambda i, j: n * n * squares[i, j] - n * ((rest[i] + rest[j]) if i != j else rest[i]) ** 2
    own = [of(i, i) for i in range(d)]
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = own[i] / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (of(i, j) - own[i] - own[j]) / (2 * n**3)
    return v


def _identity_errors(fits: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By width, the largest entry of the whitened fit list's covariance less the identity, measured over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in slices(batches, ROWS):
            for q in _unpacked(batch):
                if (width := q.shape[1]) in models:
                    z = models[width].whiten(q)
                    totals[width] = totals.get(width, 0) + z.T @ z
        for width, total in totals.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["width", "i", "j", "products"])

    rows = fits.mapInArrow(run, "width int, i int, j int, products double").groupBy("width", "i", "j").agg(F.sum("products").alias("value")).collect()
    out: dict[int, float] = {}
    for r in rows:
        out[r.width] = max(out.get(r.width, 0.0), abs(r.value / models[r.width].n - (r.i == r.j)))
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Fits by width over all vectors (embedding)."""
    fits = cut(fit_list(vectors))
    models, means = {}, {}
    for width, sums in _sums(fits, "entries", _count_and_sums).items():
        n = sums[-1, -1]
        whole = [sums[i, -1] // n for i in range(width)]
        means[width] = (n, np.array(whole, np.int64), [sums[i, -1] - n * whole[i] for i in range(width)])
    for width, squares in _sums(fits, "squares", lambda q: _squares(q, means[q.shape[1]][1])).items():
        n, whole, rest = means[width]
        v = _covariance(n, rest, squares)
        values, columns = np.linalg.eigh(v)
        order = [k for k in np.argsort(-values)[:components] if values[k] > EXPLAINED_FLOOR * values[-1] and values[k] > 0]
        if order:
            models[width] = Whitening(n, whole, np.array(rest, np.int64), columns[:, order], values[order], values[order] / np.trace(v))
    errors = _identity_errors(fits, models) if models else {}
    return {w: Whitening(**(vars(m) | {"identity_error": errors[w]})) for w, m in models.items()}


def _deviations(q: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; None beyond a long."""
    p = q - model.whole
    most = model.n * (int(np.abs(p).max()) + 1)
    if most * most * q.shape[1] >= 1 << 63:
        p = p.astype(object)
    d = p * model.n - model.rest
    return [int(x) if x < 1 << 63 else None for x in (d * d).sum(axis=1)]


def transform(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component. No shuffle."""
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            for rows, q in _matrices(batch.column("embedding")):
                if (m := models.get(q.shape[1])) is None:
                    continue
                k, size = len(m.eigenvalues), len(rows)
                ids = batch.column("vec_id").take(pa.array(np.repeat(rows, k)))
                deviation = pa.array(_deviations(q, m), pa.int64()).take(pa.array(np.repeat(np.arange(size), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n, np.int64)), deviation, pa.array(m.whiten(q).ravel()), pa.array(np.tile(m.explained, size)), pa.array(np.full(size * k, m.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def whiten(vectors: DataFrame) -> DataFrame:
    """Fit over all vectors and transform them all."""
    return transform(vectors, fit(vectors))

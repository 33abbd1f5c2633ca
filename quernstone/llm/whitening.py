"""Whitening of vectors by a compensated covariance.

Sums and centred outer products are kept as double-doubles, a high and a low part
that do not overlap.  A block of centred vectors is cut into slices of so few bits
that the product of two slices is exact in doubles (an error-free transformation),
and these products are added with two-sums.  Each task hands on one pair of parts,
which are merged as pairs, so the covariance has about 100 bits before it is rounded
once.  Only sums and the covariance, whose size the dimension bounds, reach the
driver.  Its eigenvectors come from LAPACK's ``syevd``, which reduces the matrix to
tridiagonal form and solves that by divide and conquer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, staged

#: Components that rows are projected on.
COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this stay there: so far doubles are exact integers, and so are their differences.
MOST_ENTRY = 1 << 52
#: Bits of a slice, slices of a double-double, and the rows of a block: a sum of 2**12 products of 40 bits fits in 53.
SLICE_BITS, SLICES, BLOCK_ROWS = 20, 5, 4_096
#: Entries of a block.
BLOCK_ENTRIES = 1 << 20
#: Tasks' parts are merged in so many groups, then these.
MERGE_WAYS = 256

_PARTS = "i int, part bigint, n bigint, hi array<double>, lo array<double>"
_LONG = (1 << 63) - 1

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """Sum of double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def column_sums(rows: np.ndarray) -> Pair:
    """Double-double sum of the rows, by halves."""
    hi, lo = rows, np.zeros_like(rows)
    if not len(rows):
        return np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    while len(hi) > 1:
        half = len(hi) // 2
        odd = (hi[2 * half :], lo[2 * half :])
        hi, lo = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = np.concatenate([hi, odd[0]]), np.concatenate([lo, odd[1]])
    return hi[0], lo[0]


def slices_of(centred: Pair) -> list[np.ndarray]:
    """Matrices whose sum is the pair but for its last bits; each has SLICE_BITS bits below the one before."""
    hi, lo = centred
    most = np.abs(hi).max(0, initial=0.0)
    exponent = np.where(most > 0, np.frexp(most)[1], 0)
    out = []
    for k in range(1, SLICES + 1):
        # adding and taking away 1.5 * 2**52 units rounds to whole units
        big = np.ldexp(1.5, exponent - SLICE_BITS * k + 52)
        part = (hi + big) - big
        out.append(part)
        hi, lo = two_sum(hi - part, lo)
    return out


def outer_products(centred: Pair) -> Pair:
    """Double-double sum of the outer products of at most BLOCK_ROWS rows."""
    parts = slices_of(centred)
    width = centred[0].shape[1]
    total = (np.zeros((width, width)), np.zeros((width, width)))
    for k in range(SLICES):
        for m in range(k, SLICES - k):
            product = parts[k].T @ parts[m]  # exact
            total = add(total, (product, np.zeros_like(product)))
            if m > k:
                total = add(total, (product.T, np.zeros_like(product)))
    return total


def centre(rows: np.ndarray, mean: Pair) -> Pair:
    hi, lo = two_sum(rows, -mean[0])
    return two_sum(hi, lo - mean[1])


Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors without null or non-finite entries, and these, short ones filled with zeros."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
    values = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())) if len(column) else column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    of = np.repeat(np.arange(len(sizes)), sizes)
    there = there & (np.bincount(of[~np.isfinite(flat)], minlength=len(sizes)) == 0)
    if len(sizes) and (sizes == width).all():
        rows = flat.reshape(len(sizes), width)
    else:
        rows = np.zeros((len(sizes), width))
        rows[of, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.flatnonzero(there), rows[there]


def scaled_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``finite_rows`` with entries as integers floor(SCALE * c) + OFFSET."""
    at, rows = finite_rows(column)
    with np.errstate(over="ignore"):
        return at, np.clip(np.floor(rows * SCALE) + OFFSET, -MOST_ENTRY, MOST_ENTRY)


def _padded(rows: np.ndarray, width: int, fill: float) -> np.ndarray:
    more = width - rows.shape[1]
    return np.pad(rows, ((0, 0), (0, more)), constant_values=fill) if more > 0 else rows


def _blocks(batches: Iterator[pa.RecordBatch], read: Reader) -> Iterator[np.ndarray]:
    for batch in batches:
        _, rows = read(batch.column(0))
        step = max(64, min(BLOCK_ROWS, BLOCK_ENTRIES // max(1, rows.shape[1])))
        for k in range(0, len(rows), step):
            yield rows[k : k + step]


def _widened(n: int, pair: Pair, width: int, fill: float) -> Pair:
    """Sums of ``n`` rows, with those of ``fill`` at places that none of these rows has."""
    more = width - len(pair[0])
    if more <= 0:
        return pair
    exact = Fraction(fill) * n
    high = float(exact)
    return np.append(pair[0], np.full(more, high)), np.append(pair[1], np.full(more, float(exact - Fraction(high))))


def merged(parts: DataFrame, fill: float = 0.0) -> DataFrame:
    """One row for each ``i``: the high and low parts of all tasks added as pairs, in the order of ``part``."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        width = max(map(len, pdf.hi))
        n, pair = 0, (np.zeros(width), np.zeros(width))
        for m, hi, lo in zip(pdf.n, pdf.hi, pdf.lo):
            n, pair = n + int(m), add(pair, _widened(int(m), (np.asarray(hi), np.asarray(lo)), width, fill))
        return pd.DataFrame({"i": pdf.i.iloc[:1], "part": pdf.part.iloc[:1], "n": [n], "hi": [pair[0]], "lo": [pair[1]]})

    some = parts.groupBy("i", F.col("part") % MERGE_WAYS).applyInPandas(lambda pdf: total(pdf), _PARTS)
    return some.groupBy("i").applyInPandas(lambda pdf: total(pdf), _PARTS)


def _part(i: int, n: int, pair: Pair) -> pa.RecordBatch:
    columns = [[i], [TaskContext.get().partitionId()], [n], [pair[0].tolist()], [pair[1].tolist()]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["i", "part", "n", "hi", "lo"])


@dataclass(frozen=True)
class Moments:
    """Number of vectors, exact sums of their entries, and their covariance, divisor n, rounded once."""

    n: int
    sums: list[Fraction]
    covariance: np.ndarray

    @property
    def mean(self) -> Pair:
        exact = [s / self.n for s in self.sums]
        high = np.array([float(m) for m in exact])
        return high, np.array([float(m - Fraction(h)) for m, h in zip(exact, high)])


def sums(vectors: DataFrame, read: Reader, fill: float) -> tuple[int, list[Fraction]]:
    """Number of vectors and sums of their entries; ``vectors`` has one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pair = 0, (np.zeros(0), np.zeros(0))
        for rows in _blocks(batches, read):
            width = max(rows.shape[1], len(pair[0]))
            pair = add(_widened(n, pair, width, fill), _widened(len(rows), column_sums(rows), width, fill))
            n += len(rows)
        if n:
            yield _part(0, n, pair)

    rows = merged(vectors.mapInArrow(run, _PARTS), fill).collect()  # one row
    if not rows:
        return 0, []
    return rows[0].n, [Fraction(a) + Fraction(b) for a, b in zip(rows[0].hi, rows[0].lo)]


def moments(vectors: DataFrame, read: Reader, fill: float = 0.0) -> Moments:
    """Of the vectors in the only column of ``vectors``; places that a short vector lacks hold ``fill``."""
    n, total = sums(vectors, read, fill)
    width = len(total)
    if not n or not width:
        return Moments(n, total, np.zeros((width, width)))
    mean = Moments(n, total, np.empty(0)).mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pair = 0, (np.zeros((width, width)), np.zeros((width, width)))
        for rows in _blocks(batches, read):
            m, pair = m + len(rows), add(pair, outer_products(centre(_padded(rows, width, fill), mean)))
        if m:
            for i in range(width):
                yield _part(i, m, (pair[0][i], pair[1][i]))

    rows = merged(vectors.mapInArrow(run, _PARTS)).collect()  # as many as there are dimensions
    covariance = np.zeros((width, width))
    for r in rows:
        covariance[r.i] = [float((Fraction(a) + Fraction(b)) / n) for a, b in zip(r.hi, r.lo)]
    return Moments(n, total, covariance)


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    if not len(covariance):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(covariance)  # syevd: tridiagonal, divide and conquer
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1.0, signs)


def deviations(rows: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Exact sum over dimensions of (n * x - S) ** 2; what passes a long is its largest value."""
    off = rows * float(n) - np.array([float(s) for s in total])
    near = (off * off).sum(1)
    # the arithmetic of 64 bits wraps, so a result that fits is exact
    with np.errstate(over="ignore"):
        wrapped = np.array([s % (1 << 64) for s in total], dtype=np.uint64)
        whole = rows.astype(np.int64).astype(np.uint64) * np.uint64(n % (1 << 64)) - wrapped
        out = (whole * whole).sum(1).astype(np.int64)
    out[near > 1.01 * 2.0**63] = _LONG
    for i in np.flatnonzero((near > 0.99 * 2.0**63) & (near <= 1.01 * 2.0**63)):
        out[i] = min(_LONG, sum((n * int(x) - s) ** 2 for x, s in zip(rows[i], total)))
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Rows of whitened coordinates: ``id_col``, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out.  An
    entry c counts as the integer x = floor(SCALE * c) + OFFSET, kept within
    MOST_ENTRY; a vector shorter than the longest has zeros for c in the places
    that it lacks.  A row comes once for each component up to ``most`` or the
    dimension.  ``deviation`` beyond a long is the largest long.  Along a component
    without variance (one vector, or fewer vectors than components) ``whitened`` is
    null, as is ``explained`` where nothing varies; ``identity_error`` is over the
    other components.  Repeated and null ids are rows like others; no vectors, or
    none with entries, give no rows.  Other columns are ignored.
    """
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    rows = bounded_batches(vectors).select(F.col(id_col).alias("id"), vec.alias("vec"))
    found = moments(rows.select("vec"), scaled_rows, OFFSET)
    id_kind = rows.schema["id"].dataType.simpleString()
    n, mean, total = found.n, found.mean if found.n else (np.zeros(0), np.zeros(0)), [int(s) for s in found.sums]
    values, axes = components(found.covariance, most)
    trace = float(np.trace(found.covariance))
    flat = values <= len(mean) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    scale = np.where(flat, np.nan, 1.0 / np.sqrt(np.where(flat, 1.0, values)))
    count, width = len(values), len(mean)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = scaled_rows(batch.column(1))
            if not len(at) or not count:
                continue
            x = _padded(x, width, OFFSET)
            hi, lo = centre(x, mean)
            z = (hi @ axes + lo @ axes) * scale
            ends = pa.array(np.arange(0, z.size + 1, count), pa.int32())
            coordinates = pa.ListArray.from_arrays(ends, pa.array(z.ravel(), from_pandas=True))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at)), pa.array(deviations(x, n, total)), coordinates], names=["id", "deviation", "z"]
            )

    made = rows.mapInArrow(project, f"id {id_kind}, deviation bigint, z array<double>")
    if n and count:
        made = staged(made, "whitened")
    varying = int((~flat).sum())
    error = None
    if n and varying:
        # flat components come last
        check = moments(made.select(F.slice("z", 1, varying)), finite_rows)
        error = float(np.abs(check.covariance - np.eye(varying)).max())
    shares = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values)) if count else F.array(F.lit(None).cast("double"))
    return made.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

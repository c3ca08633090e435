"""Whitening of embeddings from an exact scatter matrix, taken from bit planes.

Entries become integers. A block of rows is shifted so that each dimension starts at 0; bit p of a
dimension, over all rows of the block, is one row of words (a plane). A cross-product of two dimensions is
the sum over their planes of 2^(p+q) times the ones of both planes together, so AND and popcount give it
exactly. Sums over blocks and centring are integer work too; only the centred matrix is rounded, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.llm.vectors import matrix, usable

#: Components given back, rows of a block (a multiple of 64, at most 2^14).
COMPONENTS, BLOCK_ROWS = 32, 8_192
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this, in units of 1/64, count as this; it keeps every integer in a long.
_FARTHEST = 2.0**62
#: Planes of one chunk: 2 * 24 bits and the 2^14 ones of a block fit into a long.
_CHUNK = 24
#: Exact sums travel as signed digits to this base, so that plain sums of longs add them up.
_DIGIT_BITS, _DIGITS = 32, 6
_PARTS = "place INT, " + ", ".join(f"d{k} BIGINT" for k in range(_DIGITS))


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * SCALE), -_FARTHEST, _FARTHEST).astype(np.int64) + OFFSET


def _planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed planes of the columns of ``y``, with the column and bit of each."""
    rows, columns = y.shape
    bits = [int(top).bit_length() for top in y.max(axis=0)]
    words = np.zeros((sum(bits), -(-rows // 64) * 8), np.uint8)
    at = 0
    for j, n in enumerate(bits):
        for p in range(n):
            packed = np.packbits((y[:, j] >> np.uint64(p) & np.uint64(1)).astype(bool))
            words[at, : len(packed)] = packed
            at += 1
    return words.view(np.uint64), np.repeat(np.arange(columns), bits), np.concatenate([np.arange(n) for n in bits] or [[]]).astype(np.int64)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (Python integers) of the columns of a block of longs."""
    rows, columns = x.shape
    least = x.min(axis=0)
    y = x.astype(np.uint64) - least.astype(np.uint64)  # modulo 2^64, so right over the whole range of longs
    words, column, bit = _planes(y)
    shifted = np.zeros((columns, columns), object)
    if len(words):
        ones = np.zeros((len(words), len(words)), np.int64)
        for a in range(len(words)):
            ones[a, a:] = np.bitwise_count(words[a] & words[a:]).sum(axis=1, dtype=np.int64)
        ones = ones + np.triu(ones, 1).T
        weight = np.int64(1) << bit % _CHUNK
        starts = np.flatnonzero(np.r_[True, (np.diff(column) != 0) | (np.diff(bit // _CHUNK) != 0)])
        chunks = np.add.reduceat(np.add.reduceat(ones * weight[:, None] * weight, starts, 0), starts, 1).astype(object)
        place, chunk = column[starts], (bit // _CHUNK)[starts].astype(object)
        power = chunk[:, None] + chunk
        np.add.at(shifted, (place[:, None], place), chunks * np.array([1 << int(k) * _CHUNK for k in power.ravel()], object).reshape(power.shape))
    sums = np.array([int(hi) << 32 for hi in (y >> np.uint64(32)).sum(axis=0)], object) + (y & np.uint64(0xFFFFFFFF)).sum(axis=0).astype(object)
    least = least.astype(object)
    products = shifted + np.outer(least, sums) + np.outer(sums, least) + rows * np.outer(least, least)
    return sums + rows * least, products


def _digits(values: list[int]) -> list[np.ndarray]:
    """Signed digits of integers, lowest first; the highest takes the sign."""
    out, rest, mask = [], values, (1 << _DIGIT_BITS) - 1
    for _ in range(_DIGITS - 1):
        out.append(np.array([v & mask for v in rest], np.int64))
        rest = [v >> _DIGIT_BITS for v in rest]
    return [*out, np.array(rest, np.int64)]


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and upper cross-products of a task's rows, one row for each."""
    n, sums, products = 0, 0, 0
    for batch in batches:
        x = integers(matrix(batch.column("vector")))
        for first in range(0, len(x), BLOCK_ROWS):
            block = cross_products(x[first : first + BLOCK_ROWS])
            sums, products = sums + block[0], products + block[1]
        n += len(x)
    if n:
        values = [n, *sums, *products[np.triu_indices(len(sums))]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), *map(pa.array, _digits(values))], ["place", *[f"d{k}" for k in range(_DIGITS)]])


@dataclass(frozen=True)
class Whitening:
    """Exact count and sums, and the leading components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.eigenvalues]

    @property
    def solid(self) -> np.ndarray:
        """Which eigenvalues stand out from the rounding of the largest."""
        top = self.eigenvalues[0] if len(self.eigenvalues) else 0.0
        return self.eigenvalues > max(top, 0.0) * len(self.sums) * np.finfo(float).eps


def fit(rows: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening:
    """Scatter of all ``rows`` (column vector, all of one length) and its eigenvectors.

    Only the added up scatter, whose size follows from the number of dimensions, reaches the driver.
    """
    parts = rows.select("vector").mapInArrow(_scatter, _PARTS)
    total = {r["place"]: sum(int(r[f"d{k}"]) << k * _DIGIT_BITS for k in range(_DIGITS)) for r in parts.groupBy("place").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(_DIGITS)]).collect()}
    n, sums = total[0], [total[1 + j] for j in range(dimensions)]
    covariance = np.zeros((dimensions, dimensions))
    for place, (i, j) in enumerate(zip(*np.triu_indices(dimensions), strict=True), 1 + dimensions):
        covariance[i, j] = covariance[j, i] = (n * total[place] - sums[i] * sums[j]) / (n * n)  # integers until here, rounded once
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, vectors[:, order], np.maximum(values[order], 0), float(np.trace(covariance)))


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows less the mean, on the components, over the roots of the eigenvalues; 0 on components that do not vary."""
    floor = [s // model.n for s in model.sums]
    rest = np.array([(s - f * model.n) / model.n for s, f in zip(model.sums, floor, strict=True)])
    centred = (x - np.array(floor, np.int64)).astype(np.float64) - rest
    scale = np.where(model.solid, 1 / np.sqrt(np.where(model.solid, model.eigenvalues, 1)), 0)
    return centred @ model.components * scale


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n*x - S)^2; null where it does not fit into a long."""
    n, sums = model.n, model.sums
    floor = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    off = x - floor
    farthest = max((int(abs(v)) for v in (off.min(initial=0), off.max(initial=0))), default=0)
    if ((farthest + 1) * n) ** 2 * max(len(sums), 1) < 2**63:
        return pa.array(((off * n - rest.astype(np.int64)) ** 2).sum(axis=1))
    exact = ((off.astype(object) * n - rest) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors: id, component, n, deviation, whitened, explained, identity_error.

    A row without vector, or with a null, infinite or undefined entry, gives nothing. Where lengths
    differ, vectors of other than the commonest length (the longest of equally common ones) give nothing.
    Repeated rows count and come back as often as they occur, a null id stays null. Where a component does
    not vary, as with fewer vectors than components, whitened is null and the component is left out of
    identity_error. An empty table gives no rows. Other columns are not read. Runs jobs.
    """
    rows = usable(df, id_col, vector_col)
    schema = f"{id_col} BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not common:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == common[0]["length"])
    model = fit(rows, common[0]["length"], components)
    kept, solid = len(model.eigenvalues), model.solid
    grid = np.triu_indices(kept)

    def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(kept + len(grid[0]))
        for batch in batches:
            z = whitened(integers(matrix(batch.column("vector"))), model) if batch.num_rows else np.empty((0, kept))
            sums += np.r_[z.sum(axis=0), (z.T @ z)[grid]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["place", "value"])

    added = dict(rows.select("vector").mapInArrow(second_moments, "place INT, value DOUBLE").groupBy("place").agg(F.sum("value")).collect())
    mean = np.array([added[j] for j in range(kept)]) / model.n
    moments = np.zeros((kept, kept))
    moments[grid] = [added[kept + k] / model.n for k in range(len(grid[0]))]
    gap = np.abs(np.triu(moments - np.outer(mean, mean)) - np.eye(kept))[np.ix_(solid, solid)]
    error = float(gap.max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix(batch.column("vector")))
                flat = pa.array(whitened(x, model).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * kept, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id"), deviations(x, model), lists], ["id", "deviation", "z"])

    out = rows.mapInArrow(project, "id BIGINT, deviation BIGINT, z ARRAY<DOUBLE>").select("id", "deviation", F.posexplode("z").alias("place", "value"))
    varies, shares = F.array(*[F.lit(bool(s)) for s in solid]), F.array(*[F.lit(e) for e in model.explained])
    return out.select(
        F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        F.when(F.get(varies, F.col("place")), F.col("value")).alias("whitened"), F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )

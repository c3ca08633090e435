"""Nearest neighbours by low-dimensional stable projections.

Unit vectors are projected on a few seeded Gaussian directions. Over its direction draws, the squared
projected distance of two points is their squared distance times a chi-square variable, so a point that
lies farther off in the projection than the k-th best distance so far, times the root of a high chi-square
quantile, is very likely no better. Each task keeps the projections of its rows in kd-trees, takes the
leaves of a query in the order of their distance, verifies the points of the projected ball on the
original vectors, and stops when the test holds for all that is left.

Rows are dealt into rings by a hash of their id, each ring ``RING_GROWTH`` times the one before; what a ring
finds is the bound of the next, so few rows of the large last ring are handed on. Every row lies in
exactly one ring and one tree. Queries are read in blocks of arrays in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddslake.llm.shared_files import mapped_array, new_folder, write_array
from oddslake.llm.vectors import matrix, usable
from oddslake.session import stored

#: Directions (an even number), quantile of the stopping test, rows of the first ring, growth of rings.
DIRECTIONS, CERTAINTY, FIRST_RING, RING_GROWTH = 12, 0.98, 65_536, 64
#: Bytes of vectors in one tree, rows of a leaf, queries of a block.
TREE_BYTES, LEAF_ROWS, QUERY_ROWS = 32 << 20, 128, 512
#: Entries of pairs that are verified at once.
_PAIR_ENTRIES = 1 << 21
#: Room for the rounding of matrix products; scores themselves are computed pair by pair.
_SLACK = 1e-9
_FOUND = "query_no BIGINT, query_id BIGINT, id BIGINT, score DOUBLE"


def chi_square_quantile(share: float, freedom: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with this chance."""
    if freedom % 2 or freedom < 2:
        raise ValueError("degrees of freedom must be even")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def directions(length: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(12)).standard_normal((length, count))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings the largest entry near 1; leaves cosines as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


@dataclass
class Points:
    """Scaled vectors, their norms, unit vectors and projections, with ids."""

    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    unit: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, count: int) -> Points:
        scaled = _scaled(vectors)
        norms = _norms(scaled)
        unit = scaled / norms[:, None]
        return cls(ids, scaled, norms, unit, unit @ directions(vectors.shape[1], count))

    def take(self, rows: np.ndarray) -> Points:
        return Points(*(part[rows] for part in (self.ids, self.vectors, self.norms, self.unit, self.low)))


def scores(a: Points, i: np.ndarray, b: Points, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, each computed alone so that equal vectors have equal scores."""
    out, step = np.empty(len(i)), max(1, _PAIR_ENTRIES // a.vectors.shape[1])
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        out[at : at + step] = (a.vectors[p] * b.vectors[q]).sum(axis=1) / (a.norms[p] * b.norms[q])
    return out


class Tree:
    """A kd-tree over projections: rows in leaf order and the box of each leaf."""

    def __init__(self, points: Points, leaf_rows: int = LEAF_ROWS):
        low, n = points.low, len(points.ids)
        order, open_, leaves = np.arange(n), [(0, n)], []
        while open_:
            first, last = open_.pop()
            rows = order[first:last]
            if last - first <= leaf_rows:
                leaves.append((first, last))
                continue
            widest = int(np.argmax(np.ptp(low[rows], axis=0)))
            half = (last - first) // 2
            order[first:last] = rows[np.argpartition(low[rows, widest], half)]
            open_ += [(first, first + half), (first + half, last)]
        self.leaves = sorted(leaves)
        self.points = points.take(order)
        self.squares = (self.points.low**2).sum(axis=1)
        self.least = np.stack([self.points.low[a:b].min(axis=0) for a, b in self.leaves])
        self.most = np.stack([self.points.low[a:b].max(axis=0) for a, b in self.leaves])

    def box_distances(self, low: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(low), len(self.leaves)))
        for d in range(low.shape[1]):
            at = low[:, d, None]
            out += np.maximum(np.maximum(self.least[:, d] - at, at - self.most[:, d]), 0) ** 2
        return out

    def search(self, queries: Points, k: int, bound: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row of ``self.points`` and score of up to ``k`` neighbours not below ``bound``."""
        n, kth = len(queries.ids), bound.copy()
        radius = quantile * (2 - 2 * kth + _SLACK)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        boxes, squares = self.box_distances(queries.low), (queries.low**2).sum(axis=1)
        order = np.argsort(boxes, axis=1, kind="stable")
        taken, step = 0, 1
        while taken < len(self.leaves):
            upto = min(len(self.leaves), taken + step)
            asked = order[:, taken:upto]
            # The test on the nearest point a leaf can hold; later leaves are no nearer.
            q, at = np.nonzero(np.take_along_axis(boxes, asked, 1) <= radius[:, None])
            if not len(q):
                break
            leaf = asked[q, at]
            by_leaf = np.argsort(leaf, kind="stable")
            q, leaf = q[by_leaf], leaf[by_leaf]
            found = [best]
            for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(leaf)) + 1):
                (a, b), those = self.leaves[leaf[part[0]]], q[part]
                off = squares[those, None] + self.squares[a:b] - 2 * queries.low[those] @ self.points.low[a:b].T
                near = queries.unit[those] @ self.points.unit[a:b].T
                hit = (off <= radius[those, None]) & (near >= kth[those, None] - _SLACK) & (queries.ids[those, None] != self.points.ids[a:b])
                x, y = np.nonzero(hit)
                if len(x):
                    found.append((those[x], a + y, scores(queries, those[x], self.points, a + y)))
            best = self._best(*map(np.concatenate, zip(*found, strict=True)), k, bound)
            counts = np.bincount(best[0], minlength=n)
            full = np.flatnonzero(counts >= k)
            kth[full] = np.maximum(bound[full], best[2][np.cumsum(counts)[full] - 1])
            radius = quantile * (2 - 2 * kth + _SLACK)
            taken, step = upto, step * 2
        return best

    def _best(self, q: np.ndarray, row: np.ndarray, score: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.points.ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = (place < k) & (score >= bound[q])
        return q[keep], row[keep], score[keep]


def _few_copies(ids: np.ndarray, vectors: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Rows that some query may list: of equal vectors the 2k smallest ids, each at most k times.

    A query leaves out the rows of one id, its own, so k of those kept remain.
    """
    order = np.lexsort((ids, hashes))
    of, by_id = hashes[order], ids[order]
    first = np.searchsorted(of, of)
    equal = (vectors[order] == vectors[order[first]]).all(axis=1)
    run = np.maximum.accumulate(np.where(np.r_[True, (np.diff(of) != 0) | (np.diff(by_id) != 0)], np.arange(len(of)), 0))
    listed = equal & (np.arange(len(of)) - run < k)
    before = np.cumsum(listed) - listed
    return np.sort(order[~equal | (listed & (before - before[first] < 2 * k))])


@dataclass(frozen=True)
class QuerySet:
    """Blocks of query arrays below ``folder``; each ring adds arrays of bounds."""

    folder: str
    blocks: list[int]

    def block(self, b: int, length: int, count: int) -> tuple[np.ndarray, Points]:
        numbers = mapped_array(self.folder, f"numbers-{b}", "int64")
        vectors = mapped_array(self.folder, f"vectors-{b}", "float64").reshape(len(numbers), length)
        return numbers, Points.of(np.asarray(mapped_array(self.folder, f"ids-{b}", "int64")), np.asarray(vectors), count)


def _write_queries(queries: DataFrame, folder: str, rows: int) -> QuerySet:
    """Write the queries (query_no, id, vector) in blocks of about ``rows``."""

    def write(table: pa.Table) -> pa.Table:
        b = table.column("block")[0].as_py()
        table = table.sort_by("query_no").combine_chunks()
        write_array(folder, f"numbers-{b}", np.asarray(table.column("query_no"), np.int64))
        write_array(folder, f"ids-{b}", np.asarray(table.column("id"), np.int64))
        write_array(folder, f"vectors-{b}", matrix(table.column("vector").combine_chunks()))
        return pa.table({"block": pa.array([b], pa.int64())})

    blocks = max(1, -(-queries.count() // rows))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_no"), F.lit(blocks)))
    written = dealt.groupBy("block").applyInArrow(write, "block BIGINT").collect()  # a number for each block
    return QuerySet(folder, sorted(r["block"] for r in written))


def _write_bounds(found: DataFrame, queries: DataFrame, folder: str, ring: int, blocks: int, k: int) -> None:
    """The k-th best score of each query so far, lowest where there are fewer, in the order of its block."""

    def write(table: pa.Table) -> pa.Table:
        b = table.column("block")[0].as_py()
        write_array(folder, f"bound-{ring}-{b}", np.asarray(table.sort_by("query_no").column("bound"), np.float64))
        return pa.table({"block": pa.array([b], pa.int64())})

    bounds = found.groupBy("query_no").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("bound"))
    rows = queries.select("query_no").join(bounds, "query_no", "left").select("query_no", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    rows.withColumn("block", F.pmod(F.xxhash64("query_no"), F.lit(blocks))).groupBy("block").applyInArrow(write, "block BIGINT").count()


def nearest(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", count: int = DIRECTIONS, certainty: float = CERTAINTY,
    first_ring: int = FIRST_RING, growth: int = RING_GROWTH, query_rows: int = QUERY_ROWS, tree_bytes: int = TREE_BYTES,
) -> DataFrame:
    """The ``k`` rows nearest by cosine to each row where ``is_query`` holds: query_id, rank, vec_id, score.

    Scores are exact; a neighbour is missed with a chance of at most ``1 - certainty`` over the seeded
    directions. Vectors that are null, zero or hold a null, infinite or undefined entry take no part,
    nor do rows without id. Where lengths differ, only vectors of the commonest length (the longest of
    equally common ones) take part. Rows with a query's id are its own and none of its neighbours;
    repeated rows are rows of their own, as queries too. Equal scores go by the smaller id. An empty table
    gives no rows; other columns are not read but by ``is_query``. Runs jobs and leaves arrays behind.
    """
    spark = df.sparkSession
    flagged = df.where(F.col(id_col).isNotNull()).withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = usable(flagged, id_col, vector_col).where(F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], f"query_id BIGINT, rank INT, {id_col} BIGINT, score DOUBLE")
    length, total = common[0]["length"], common[0]["n"]
    rows = rows.where(F.size("vector") == length)
    asked = usable(flagged.where("__query"), id_col, vector_col).where(F.exists("vector", lambda c: c != 0) & (F.size("vector") == length))
    # Numbered once in a written table: every later plan reads the same numbers.
    queries = stored(asked.withColumn("query_no", F.monotonically_increasing_id()))
    folder = new_folder(spark, "queries")
    query_set, quantile = _write_queries(queries, folder, query_rows), chi_square_quantile(certainty, count)
    blocks = max(1, -(-queries.count() // query_rows))
    tree_rows = max(1, tree_bytes // (8 * length))

    def search_ring(ring: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush() -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held).combine_chunks()
                ids, hashes = (np.asarray(table.column(c), np.int64) for c in ("id", "hash"))
                vectors = matrix(table.column("vector").combine_chunks())
                keep = _few_copies(ids, vectors, hashes, k)
                tree = Tree(Points.of(ids[keep], vectors[keep], count))
                for b in query_set.blocks:
                    numbers, asked = query_set.block(b, length, count)
                    bound = np.array(mapped_array(folder, f"bound-{ring}-{b}", "float64")) if ring else np.full(len(numbers), -2.0)
                    q, row, score = tree.search(asked, k, bound, quantile)
                    columns = (numbers[q], asked.ids[q], tree.points.ids[row], score)
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c)) for c in columns], ["query_no", "query_id", "id", "score"])

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    room = tree_rows - sum(b.num_rows for b in held)
                    held.append(batch.slice(at, room))
                    at += room
                    if sum(b.num_rows for b in held) >= tree_rows:
                        yield from flush()
                        held.clear()
            if held:
                yield from flush()

        return run

    place = F.row_number().over(W.partitionBy("query_no").orderBy(F.desc("score"), "id"))
    rings = max(0, math.ceil(math.log(max(total, 1) / first_ring, growth)))
    spread, found = 1 << 40, None
    hashed = rows.withColumn("hash", F.xxhash64("vector")).withColumn("__at", F.pmod(F.xxhash64("id"), F.lit(spread)))
    for ring in range(rings + 1):
        least, most = (spread // growth ** (rings - r) if r >= 0 else 0 for r in (ring - 1, ring))
        part = hashed.where((F.col("__at") >= least) & (F.col("__at") < most)).select("id", "hash", "vector")
        new = part.mapInArrow(search_ring(ring), _FOUND)
        best = (new if found is None else found.unionByName(new)).withColumn("rank", place).where(F.col("rank") <= k)
        if ring == rings:
            return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
        found = stored(best.drop("rank"))
        _write_bounds(found, queries, folder, ring + 1, blocks, k)

"""Ranked lexical search with hashed max-sketches.

The impact of a term in a document, less the term's weight, is a whole number that grows with its
occurrences. A document's impacts fold into a sketch of a power of two of coordinates, some times its number of
terms: each term raises two coordinates, named by its hash, to its impact. The smaller of a term's two
coordinates is no less than its impact, so looking up the terms of a batch of queries bounds their scores on
every document. Documents are then scored exactly, in the order of falling bounds, until the bound lies
below a query's threshold: its k-th best score so far.

Texts are read twice: once to count, once to fold and score. Nothing about a document but its place among
a task's k best leaves the task. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddslake.llm.common import whole_text
from oddslake.llm.shared_files import mapped_array, new_folder, write_array
from oddslake.llm.text_arrays import mixed, slices
from oddslake.session import stored

#: Queries of one batch, and the coordinates of a sketch for each distinct term (at least; at most twice as many).
BATCH_QUERIES, COORDINATES = 1_000, 8
#: Lookups (documents times terms), and bounds (documents times queries), that are held at once.
_LOOKUPS, _BOUNDS = 1 << 20, 1 << 20
# What a term consists of, weights and shape of the impact.
IMPACT_TOP, IMPACT_TF, IMPACT_LENGTH = 1_000_000_000, 1_000, 8
LENGTH_BASE, LENGTH_SHARE = 100 - 75, 75

#: Every byte but 0-9, A-Z, a-z and those of characters beyond ASCII parts terms.
PARTING = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    PARTING[_first : _last + 1] = False


def term_counts(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and occurrences of each distinct term of each text, by row and hash, and terms of each text."""
    lengths = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ends)), lengths)
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    fresh = np.r_[True, (np.diff(row) != 0) | (hashes[1:] != hashes[:-1])] if len(row) else np.empty(0, bool)
    at = np.flatnonzero(fresh)
    return row[at], hashes[at], np.diff(at, append=len(row)), lengths


@dataclass(frozen=True)
class Batch:
    """Arrays of some queries: their terms, and for each query its terms and how often each occurs in it."""

    numbers: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def read(cls, folder: str, b: int) -> Batch:
        arrays = (mapped_array(folder, f"{name}-{b}", kind) for name, kind in (("numbers", "int64"), ("terms", "uint64"), ("starts", "int64"), ("term", "int64"), ("times", "int64")))
        return cls(*map(np.asarray, arrays))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash among the terms, -1 where it is none."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _write_queries(queries: DataFrame, folder: str, size: int) -> list[int]:
    """Write the queries (query_no, text) in batches of about ``size``; returns the numbers of the batches."""

    def write(table: pa.Table) -> pa.Table:
        b = table.column("batch")[0].as_py()
        number, hashes, times = [], [], []
        for part in table.sort_by("query_no").to_batches():
            for first, rows, found, ends in slices(part, parting=PARTING):
                row, term, count, _ = term_counts(found, ends)
                number.append(np.asarray(part.column("query_no"), np.int64)[first : first + rows][row])
                hashes.append(term)
                times.append(count)
        number, hashes, times = map(np.concatenate, (number, hashes, times))
        numbers, query = np.unique(number, return_inverse=True)
        terms, term = np.unique(hashes, return_inverse=True)
        for name, values in (("numbers", numbers), ("terms", terms), ("starts", np.searchsorted(query, np.arange(len(numbers) + 1))), ("term", term), ("times", times)):
            write_array(folder, f"{name}-{b}", values.astype(np.uint64 if name == "terms" else np.int64))
        return pa.table({"batch": pa.array([b] if len(terms) else [], pa.int64())})

    batches = max(1, -(-queries.count() // size))
    dealt = queries.withColumn("batch", F.pmod(F.xxhash64("query_no"), F.lit(batches)))
    return sorted(r["batch"] for r in dealt.groupBy("batch").applyInArrow(write, "batch BIGINT").collect())  # a number for each batch


def _count(texts: DataFrame, folder: str, batches: list[int]) -> DataFrame:
    """Documents that hold each query term (batch, term, n); batch -1 has the documents with a term and all their terms."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {b: Batch.read(folder, b) for b in batches}
        holding = {b: np.zeros(len(batch.terms), np.int64) for b, batch in read.items()}
        totals = np.zeros(2, np.int64)
        for part in parts:
            for _, _, hashes, ends in slices(part, parting=PARTING):
                _, terms, _, lengths = term_counts(hashes, ends)
                totals += (np.count_nonzero(lengths), lengths.sum())
                for b, batch in read.items():
                    place = batch.places(terms)
                    holding[b] += np.bincount(place[place >= 0], minlength=len(batch.terms))
        for b, n in {-1: totals, **holding}.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b, np.int64)), pa.array(some), pa.array(n[some])], ["batch", "term", "n"])

    counted = texts.select("text").mapInArrow(run, "batch BIGINT, term BIGINT, n BIGINT")
    return counted.groupBy("batch", "term").agg(F.sum("n").alias("n"))


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))).astype(np.int64)


def _write_weights(counts: DataFrame, folder: str, documents: int) -> None:
    """The weight of each term of each batch; a term that no document holds is never looked up with success."""

    def write(table: pa.Table) -> pa.Table:
        b = table.column("batch")[0].as_py()
        holding = np.zeros(len(mapped_array(folder, f"terms-{b}", "uint64")), np.int64)
        holding[np.asarray(table.column("term"))] = np.asarray(table.column("n"))
        write_array(folder, f"weights-{b}", weights(documents, holding))
        return pa.table({"batch": pa.array([b], pa.int64())})

    counts.where("batch >= 0").groupBy("batch").applyInArrow(write, "batch BIGINT").count()


class Sketches:
    """Sketches of the documents of a slice, end to end."""

    def __init__(self, row: np.ndarray, terms: np.ndarray, impacts: np.ndarray, rows: int, coordinates: int):
        distinct = np.bincount(row, minlength=rows)
        self.widths = np.int64(1) << np.ceil(np.log2(np.maximum(distinct * coordinates, 2))).astype(np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.values = np.zeros(int(self.widths.sum()), np.int32)
        for place in self._places(row, terms):
            np.maximum.at(self.values, place, impacts.astype(np.int32))

    def _places(self, row: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = self.widths[row] - 1
        return tuple(self.starts[row] + (h.astype(np.int64) & mask) for h in (terms, mixed(terms)))

    def bounds(self, row: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """No less than the impact of each term in each row: a matrix rows x terms."""
        first, second = self._places(row[:, None], terms[None, :])
        return np.minimum(self.values[first], self.values[second])


class Ranking:
    """The k best documents of the queries of one batch so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.query = k, np.empty(0, np.int64)
        self.score, self.nameless, self.doc = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
        self.threshold = np.ones(queries, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, nameless: np.ndarray, doc: np.ndarray) -> None:
        some = score > 0
        new = (query[some], score[some], nameless[some], doc[some])
        query, score, nameless, doc = (np.concatenate(pair) for pair in zip((self.query, self.score, self.nameless, self.doc), new, strict=True))
        order = np.lexsort((doc, nameless, -score, query))
        query, score, nameless, doc = query[order], score[order], nameless[order], doc[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.score, self.nameless, self.doc = query[keep], score[keep], nameless[keep], doc[keep]
        counts = np.bincount(self.query, minlength=len(self.threshold))
        full = np.flatnonzero(counts >= self.k)
        self.threshold[full] = self.score[np.cumsum(counts)[full] - 1]


class Searcher:
    """Bounds and exact scores of a batch of queries on one slice of documents after another."""

    def __init__(self, batch: Batch, weight: np.ndarray, k: int):
        self.batch, self.weight, self.ranking = batch, weight, Ranking(len(batch.numbers), k)
        self.rising = np.flatnonzero(weight > 0)  # other terms add nothing to a score
        query = np.repeat(np.arange(len(batch.numbers)), np.diff(batch.starts))
        order = np.argsort(batch.term, kind="stable")
        self.query_of, self.times_of = query[order], batch.times[order]
        self.term_starts = np.searchsorted(batch.term[order], np.arange(len(batch.terms) + 1))

    def bounds(self, sketches: Sketches, rows: np.ndarray) -> np.ndarray:
        """Bounds on the scores: a matrix rows x queries."""
        batch, queries = self.batch, len(self.batch.numbers)
        out = np.zeros(len(rows) * queries)
        step = max(1, _LOOKUPS // max(1, len(rows)))
        for first in range(0, len(self.rising), step):
            terms = self.rising[first : first + step]
            found = sketches.bounds(rows, batch.terms[terms])
            r, t = np.nonzero(found)
            term = terms[t]
            starts, many = self.term_starts[term], self.term_starts[term + 1] - self.term_starts[term]
            pair = np.repeat(np.arange(len(r)), many)
            entry = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + starts[pair]
            value = found[r, t].astype(np.float64) * self.weight[term]  # whole numbers below 2^53
            out += np.bincount(r[pair] * queries + self.query_of[entry], value[pair] * self.times_of[entry], minlength=len(out))
        return out.reshape(len(rows), queries)

    def exact(self, rows: np.ndarray, queries: np.ndarray, keys: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Scores of pairs; ``keys`` are row times terms plus term of every query term of every document, sorted."""
        batch = self.batch
        starts, many = batch.starts[queries], batch.starts[queries + 1] - batch.starts[queries]
        pair = np.repeat(np.arange(len(rows)), many)
        entry = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + starts[pair]
        wanted = rows[pair] * len(batch.terms) + batch.term[entry]
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        impact = np.where(keys[at] == wanted, impacts[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
        added = impact * self.weight[batch.term[entry]] * batch.times[entry]
        return np.add.reduceat(added, np.cumsum(many) - many) if len(rows) else np.empty(0, np.int64)

    def look(self, sketches: Sketches, row: np.ndarray, terms: np.ndarray, impacts: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        place = self.batch.places(terms)
        known = place >= 0
        keys, impacts = row[known] * len(self.batch.terms) + place[known], impacts[known]
        order = np.argsort(keys, kind="stable")
        keys, impacts = keys[order], impacts[order]
        queries, threshold = len(self.batch.numbers), self.ranking.threshold
        step = max(1, _BOUNDS // queries)
        for first in range(0, len(docs), step):
            rows = np.arange(first, min(first + step, len(docs)))
            bound = self.bounds(sketches, rows)
            r, q = np.nonzero(bound >= threshold)
            order = np.lexsort((-bound[r, q], q))
            r, q = r[order], q[order]
            place, upto = np.arange(len(q)) - np.searchsorted(q, q), self.ranking.k
            taken = 0
            # Each query's documents by falling bound, ever more at once; what is left behind its threshold stays out.
            while True:
                now = (place >= taken) & (place < upto) & (bound[r, q] >= threshold[q])
                if not now.any():
                    break
                a, b = rows[r[now]], q[now]
                self.ranking.add(b, self.exact(a, b, keys, impacts), nameless[a], docs[a])
                taken, upto = upto, upto * 2


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    batch_queries: int = BATCH_QUERIES, coordinates: int = COORDINATES,
) -> DataFrame:
    """The ``k`` documents of highest score for each row of ``items``: item, rank, doc, score.

    Only scores above 0 count; equal scores go by the smaller id, null ids last. Null or empty texts have
    no terms, as documents and as items. Repeated rows are rows of their own on both sides. An empty table
    on either side gives no rows. Other columns are not read. The result is exact but for equal 64-bit hashes
    of different terms. Workers hold the query set's arrays, mapped; runs jobs and leaves those arrays behind.
    """
    spark = docs.sparkSession
    # Numbered once in a written table: every later plan reads the same numbers.
    queries = stored(items.select(F.col(item_col).alias("item"), whole_text(item_text).alias("text")).withColumn("query_no", F.monotonically_increasing_id()))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    folder = new_folder(spark, "queries")
    batches = _write_queries(queries.select("query_no", "text"), folder, batch_queries)
    counts = stored(_count(texts, folder, batches))
    totals = dict(counts.where("batch = -1").select("term", "n").collect())  # two rows
    documents, all_terms = totals.get(0, 0), totals.get(1, 0)
    _write_weights(counts, folder, documents)
    # A batch none of whose terms is in any document has no weights and finds nothing.
    usable = sorted(r["batch"] for r in counts.where("batch >= 0").select("batch").distinct().collect())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [Searcher(Batch.read(folder, b), np.asarray(mapped_array(folder, f"weights-{b}", "int64")), k) for b in usable]
        for part in parts:
            ids = part.column("id")
            nameless, numbers = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0), np.int64)
            for first, rows, hashes, ends in slices(part, parting=PARTING):
                row, terms, occurrences, lengths = term_counts(hashes, ends)
                length = LENGTH_BASE + LENGTH_SHARE * lengths * documents // max(all_terms, 1)
                impacts = IMPACT_TOP * occurrences // (IMPACT_TF * occurrences + IMPACT_LENGTH * length[row])
                sketches = Sketches(row, terms, impacts, rows, coordinates)
                for s in searchers:
                    s.look(sketches, row, terms, impacts, numbers[first : first + rows], nameless[first : first + rows])
        for s in searchers:
            best = s.ranking
            docs_ = pa.array(best.doc, mask=best.nameless)
            yield pa.RecordBatch.from_arrays([pa.array(s.batch.numbers[best.query]), docs_, pa.array(best.score)], ["query_no", "id", "score"])

    found = texts.mapInArrow(run, "query_no BIGINT, id BIGINT, score BIGINT")
    place = F.row_number().over(W.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(queries.select("query_no", "item"), "query_no").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")

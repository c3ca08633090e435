"""Exact Jaccard self-join on word shingles, by a partition of the universe of shingles.

Sets are put into size bands. In a band the shingles' hashes are dealt to segments, so a set becomes
one subset per segment. Two sets that are similar enough differ in at most so many shingles, and each
difference spoils one segment; so among the segments that a set holds something in, all but that many
are equal in both sets. Of all subsets in one fixed order, two such sets therefore share one of the
first, one more than the bound, and only those are indexed. The order puts subsets without frequent
shingles first: that is the allocation by cost. Where it pays, some segments are coarser and
are indexed with every subset and its one-deletion neighbourhood; a difference of one is then found
there, and each such segment takes two from the bound. Sets that share an index entry are candidates;
a parity bitmap drops those that must differ too much, and the others are verified on their whole sets.

Candidates are not paired within a group. Groups with the same smallest document are one cluster, whose
bitmaps meet in a task; the pairs that bitmaps let pass are a graph there, and only a spanning forest of
it, closest pairs first, leaves the task to be verified on whole sets. Where all of a cluster's forest
holds, all its other pairs lie within a component already. Only clusters with a pair that failed go on to
their remaining pairs across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.llm.common import batches_of, whole_text
from oddslake.llm.components import components
from oddslake.llm.shared_files import mapped_array, new_folder, write_array
from oddslake.llm.text_arrays import mixed, slices
from oddslake.session import stored

#: Words of a shingle; similarity as a fraction; index entries per shard; sets that a piece of a
#: candidate group holds; sets compared with one centre in one task.
WORDS, SIMILARITY, SHARD_ENTRIES, PIECE, STAR = 5, (75, 100), 1_000_000, 2_000, 1_000
#: Bytes of bitmaps that a piece of a cluster holds.
PIECE_BYTES = 32 << 20
#: Bytes of an Arrow batch here. Slices of a batch are worked on one by one, so larger ones only take memory:
#: buffers outside the heap that an executor does not give back, and copies in its Python workers.
BATCH_BYTES = "4m"
#: Documents that a shingle must be seen in to steer the order of index entries, and to count as frequent;
#: how many such are kept, most frequent first; and shingles that a task counts at once, since only those
#: that it sees twice are told. All only steer the order; any order gives the same result.
KNOWN_DOCUMENTS, HOT_DOCUMENTS, HOT_SHINGLES, WINDOW = 2, 64, 1_000_000, 2_000_000
#: Index entries of a frequent subset are dealt over one shard for so many documents.
SALT_DOCUMENTS = 100_000
#: Least bits of a bitmap for each value of its set. With b bits a value, equal sizes and the default
#: similarity, pairs above 0.732 (4), 0.741 (8) or 0.746 (16) pass, and are verified.
BITMAP = 8
#: Segments per shingle of the smallest set of a band (sizes from a power of four to the next), tried
#: in turn until every set has enough segments; 0 gives each shingle a segment of its own.
FACTORS = (8, 32, 128, 0)
_P = np.uint64(0x9E3779B97F4A7C15)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))


#: Bits of a shingle's hash; the others of 64 hold its row in a slice, so one sort orders all sets.
HASH_BITS = 52
_HASH = np.uint64((1 << HASH_BITS) - 1)


def shingle_sets(words: np.ndarray, ends: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the rows of a slice: hashes in order, row by row; the row of each; and set sizes.

    Rows of fewer than ``n`` words are one shingle, rows without words are empty.
    """
    starts = np.r_[0, ends[:-1]]
    length = ends - starts
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(rolled) else 0):
        rolled = rolled * _P + words[k : len(words) - n + 1 + k]
    row_of = np.repeat(np.arange(len(ends), dtype=np.uint64), length)
    whole = np.arange(len(words)) + n <= np.repeat(ends, length)  # a shingle that starts here ends in its row
    hashes = mixed(rolled[whole[: len(rolled)]]) & _HASH
    rows = row_of[whole]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        own = length[short].astype(np.uint64)
        for k in range(n - 1):
            more = length[short] > k
            own[more] = own[more] * _P + words[starts[short[more]] + k]
        hashes, rows = np.r_[hashes, mixed(own + np.uint64(1)) & _HASH], np.r_[rows, short.astype(np.uint64)]
    keys = np.sort(rows << np.uint64(HASH_BITS) | hashes)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    rows = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    return keys & _HASH, rows, np.bincount(rows, minlength=len(ends))


def band_of(size: int) -> int:
    return (int(size).bit_length() - 1) // 2


def most_different(size: int, other: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    """Largest symmetric difference of two similar sets of these sizes."""
    a, b = similarity
    return (size + other) * (b - a) // (a + b)


def roles(size: int, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """(band, bound) for each band that a set is indexed in: its own and, if a smaller similar set can
    be in the band below, that one. Similar pairs meet in the band of the smaller set."""
    a, b = similarity
    own, out = band_of(size), []
    out.append((own, most_different(size, size * b // a, similarity)))
    floor = 4**own
    if own and -(-size * a // b) < floor:
        out.append((own - 1, most_different(size, floor - 1, similarity)))
    return out


def dealt(values: np.ndarray, band: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Segment of each shingle in its band; a factor of 0 makes one for each shingle."""
    spread = mixed(values ^ (band.astype(np.uint64) + np.uint64(1)) * _P)
    size = factor.astype(np.uint64) << (np.uint64(2) * band.astype(np.uint64))
    return np.where(size == 0, values, spread % np.maximum(size, np.uint64(1)))


def in_order(rows: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Order by row, then segment."""
    place = max(1, int(len(rows) - 1).bit_length())
    width = int(segments.max()).bit_length() if len(segments) else 1
    if place + width + int(len(rows) and rows.max()).bit_length() > 64:
        return np.lexsort((segments, rows))
    keys = (rows.astype(np.uint64) << np.uint64(width) | segments) << np.uint64(place) | np.arange(len(rows), dtype=np.uint64)
    return (np.sort(keys) & np.uint64((1 << place) - 1)).astype(np.int64)


def least_factors(values: np.ndarray, rows: np.ndarray, n_rows: int, band: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Place in ``FACTORS`` of the first that gives each row more segments than its bound.

    ``band`` and ``bound`` are by row; rows without a set need the first.
    """
    out = np.zeros(n_rows, np.int64)
    open_ = np.ones(n_rows, bool)
    for i, factor in enumerate(FACTORS):
        here = open_[rows]
        v, r = values[here], rows[here]
        if not len(v):
            break
        segments = dealt(v, band[r], np.full(len(r), factor))
        order = in_order(r, segments)
        segments, r = segments[order], r[order]
        fresh = np.r_[True, (segments[1:] != segments[:-1]) | (r[1:] != r[:-1])]
        enough = np.bincount(r[fresh], minlength=n_rows) > bound
        out[open_ & ~enough] = min(i + 1, len(FACTORS) - 1)
        open_ &= ~enough
    return out


def parity_bits(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Bitmap per row of which hash values occur an odd number of times: a power of two of bits, at least
    ``BITMAP`` for each of the set's values."""
    bits = np.array([max(64, 1 << int(BITMAP * n - 1).bit_length()) if n else 64 for n in sizes], np.int64)
    base = np.cumsum(bits) - bits
    at = np.repeat(base, sizes) + (values & (np.repeat(bits, sizes) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [odd[a : a + n].tobytes() for a, n in zip(base // 8, bits // 8, strict=True)]


def folded(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    while len(bits) > n_bytes:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def fingerprints(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes per row; equal sets have equal ones."""
    sums = lambda x: np.diff(np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)][np.r_[0, np.cumsum(sizes)]])
    return sums(mixed(values)).view(np.int64), sums(mixed(values ^ _P)).view(np.int64)


def first_of_each(fp1: np.ndarray, fp2: np.ndarray, sizes: np.ndarray, ids: list) -> np.ndarray:
    """Which rows stand for their slice's rows with the same set: of each the smallest id."""
    best: dict[tuple, int] = {}
    for row, key in enumerate(zip(fp1.tolist(), fp2.tolist(), sizes.tolist(), strict=True)):
        if key[2] and ids[row] is not None and (key not in best or ids[row] < ids[best[key]]):
            best[key] = row
    out = np.zeros(len(ids), bool)
    out[list(best.values())] = True
    return out


def _roles_of(sizes: np.ndarray, similarity: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per role: which rows have it, their bands and bounds."""
    found = {int(n): roles(int(n), similarity) for n in np.unique(sizes) if n}
    out = []
    for k in range(2):
        those = np.array([bool(n) and len(found[n]) > k for n in sizes.tolist()], bool)
        of = [found[n][k] if t else (0, 0) for n, t in zip(sizes.tolist(), those, strict=True)]
        out.append((those, np.array([x[0] for x in of], np.int64), np.array([x[1] for x in of], np.int64)))
    return out


_SEEN = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bits", pa.binary()), ("entries", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_SEEN_DDL = "kind INT, doc_id BIGINT, n BIGINT, fp1 BIGINT, fp2 BIGINT, bits BINARY, entries BIGINT, keys BINARY, counts BINARY"


def _look(similarity: tuple[int, int], n: int, tables: int):
    """Row per document with its set's size, fingerprint and bitmap (kind 0), shingles that a window of
    slices holds in several sets (kind 1), and the factors that the bands need (kind 2)."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SEEN, strict=True)], schema=_SEEN)

    def several(held: list[np.ndarray]) -> list[tuple]:
        keys = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(keys)])
        keys, counts = keys[starts[counts > 1]], counts[counts > 1]
        part = (mixed(keys) % np.uint64(tables)).astype(np.int64)
        return [(1, p, 0, 0, 0, None, 0, keys[part == p].tobytes(), counts[part == p].astype(np.int64).tobytes()) for p in np.unique(part).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, int] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for first, _, words, ends in slices(batch):
                values, rows, sizes = shingle_sets(words, ends, n)
                ids = batch.column("doc_id").slice(first, len(ends)).to_pylist()
                fp1, fp2 = fingerprints(values, sizes)
                lead = first_of_each(fp1, fp2, sizes, ids)
                entries, own = np.zeros(len(ends), np.int64), lead[rows]
                for those, band, bound in _roles_of(np.where(lead, sizes, 0), similarity):
                    here = those[rows]
                    need = least_factors(values[here], rows[here], len(ends), band, np.where(those, bound, -1))
                    for b in np.unique(band[those]).tolist():
                        factors[b] = max(factors.get(b, 0), int(need[those & (band == b)].max()))
                    entries += np.where(those, bound + 1, 0)
                out = list(zip([0] * len(ends), ids, sizes.tolist(), fp1.tolist(), fp2.tolist(), parity_bits(values, sizes), entries.tolist(), [None] * len(ends), [None] * len(ends), strict=True))
                held.append(values[own])
                if sum(map(len, held)) >= WINDOW:
                    out += several(held)
                    held = []
                yield batch_of(out)
        if out := several(held) + [(2, band, factor, 0, 0, None, 0, None, None) for band, factor in factors.items()]:
            yield batch_of(out)

    return run


def _hot_shingles(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles known in several documents, and in how many, at most ``HOT_SHINGLES``."""

    def add(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        hot = counts >= KNOWN_DOCUMENTS
        return pa.table({"key": pa.array(keys[hot].view(np.int64)), "n": pa.array(counts[hot])})

    hot = seen.where("kind = 1").groupBy("doc_id").applyInArrow(add, "key BIGINT, n BIGINT")
    found = hot.orderBy(F.desc("n"), "key").limit(HOT_SHINGLES).toArrow()  # bounded
    keys, counts = found.column("key").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def coarse_segments(band: int, hot_share: float) -> int:
    """Segments of a band to be indexed with one-deletion neighbourhoods.

    A credit from an exact subset costs one entry while sets have infrequent segments enough, which a
    set of n has if more than a third of it is infrequent. A coarse segment of t shingles costs 1 + t
    entries for two credits, so it pays only where exact subsets would have to be frequent ones, and
    only if its own subsets are then less frequent: with half of a set frequent and t of eight, few are.
    """
    exact_runs_out = 0.5 < hot_share < 0.9
    return max(1, 4**band // 24) if exact_runs_out and 4**band >= 24 else 0


def _coarse_part(values: np.ndarray, band: int) -> np.ndarray:
    """The twelfth of the universe that a band's coarse segments share."""
    return mixed(values * _P + np.uint64(band + 1)) % np.uint64(12) == 0


def deletion_entries(values: np.ndarray, hot: np.ndarray, band: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one set's coarse segments: each subset and what is left of it without one shingle."""
    there = _coarse_part(values, band)
    values, hot = values[there], hot[there]
    inside = (mixed(values + np.uint64((band + 1) * int(_P) & (1 << 64) - 1)) % np.uint64(coarse)).astype(np.int64)
    entries, known = [], []
    for s in range(coarse):
        own = mixed(values[inside == s])
        whole = own.sum(dtype=np.uint64)
        name = mixed(np.array([(s + 1) << 16 | (band + 1)], np.uint64))
        entries.append(mixed(np.r_[whole, whole - own] ^ name))
        known.append(np.full(len(own) + 1, hot[inside == s].min() if len(own) else 0))
    return np.concatenate(entries), np.concatenate(known)


def cost_class(known: np.ndarray) -> np.ndarray:
    """Class of a number of documents, a quarter of a power of two each; 0 for infrequent."""
    return np.where(known > 0, np.minimum(np.log2(np.maximum(known, 1)) * 4 + 1, 255), 0).astype(np.uint64)


def index_entries(values: np.ndarray, rows: np.ndarray, hot: np.ndarray, band: np.ndarray, bound: np.ndarray, factor: np.ndarray, coarse: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets, the row of each, and the documents its rarest shingle is known in.

    ``hot`` has that number for each shingle, 0 for infrequent ones; band, bound and factor are by row.
    Of each row's subsets the cheapest, one more than the bound, are taken: those with the lowest class
    of cost, then by hash. The order depends on the subset alone, so it is the same in all sets.
    """
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if any(coarse.get(b) for b in np.unique(band[rows]).tolist()):
        bound, fine = bound.copy(), np.ones(len(values), bool)
        for row in np.unique(rows):
            b, here = int(band[row]), rows == row
            if k := coarse.get(b, 0):
                entries, known = deletion_entries(values[here], hot[here], b, k)
                more.append((entries, np.full(len(entries), row), known))
                fine[np.flatnonzero(here)[_coarse_part(values[here], b)]] = False
                bound[row] -= 2 * k
        values, rows, hot = values[fine], rows[fine], hot[fine]
    if len(values):
        segments = dealt(values, band[rows], factor[rows])
        order = in_order(rows, segments)
        segments, rows, values, hot = segments[order], rows[order], values[order], hot[order]
        starts = np.flatnonzero(np.r_[True, (segments[1:] != segments[:-1]) | (rows[1:] != rows[:-1])])
        row, known = rows[starts], np.minimum.reduceat(hot, starts)
        name = (segments[starts] + np.uint64(1)) * _P ^ band[row].astype(np.uint64)
        subset = mixed(np.add.reduceat(mixed(values), starts) ^ mixed(name)) >> np.uint64(20)
        keys = np.sort(row.astype(np.uint64) << np.uint64(HASH_BITS) | cost_class(known) << np.uint64(44) | subset)
        row = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keys, row = keys[rank <= bound[row]], row[rank <= bound[row]]
        # What stands for the number of documents from here on is the lower end of its class.
        known = np.floor(2.0 ** ((((keys >> np.uint64(44)) & np.uint64(255)).astype(float) - 1) / 4)).astype(np.int64)
        more.append((mixed((keys & _HASH) ^ mixed(band[row].astype(np.uint64) + np.uint64(77))), row, known))
    if not more:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*more, strict=True))


#: Marks an entry that is dealt over several shards.
_SALTED = np.uint64(1 << 63)
_INDEX = pa.schema([("shard", pa.int64()), ("entries", pa.binary()), ("docs", pa.binary())])


def _among(values: np.ndarray, part: np.ndarray, folder: str, name: str, there: frozenset[int]) -> np.ndarray:
    """Which values are in the sorted array of their part."""
    out = np.zeros(len(values), bool)
    for p in set(part.tolist()) & there:
        known, here = mapped_array(folder, f"{name}-{p}", str(values.dtype)), part == p
        at = np.minimum(np.searchsorted(known, values[here]), len(known) - 1)
        out[here] = known[at] == values[here]
    return out


def _copy_keys(ids: np.ndarray, fp1: np.ndarray, fp2: np.ndarray) -> np.ndarray:
    """A hash of a document's id and its set's fingerprint."""
    return mixed(ids.view(np.uint64) ^ mixed(fp1.view(np.uint64) + _P * mixed(fp2.view(np.uint64))))


#: Files that the keys of copies are dealt over.
_PARTS = 64


def _index(similarity: tuple[int, int], n: int, hot, factors: dict[int, int], coarse: dict[int, int], shards: int, folder: str, copies: frozenset[int]):
    """Index entries by shard. Of equal sets only that of the smallest id is indexed: ``copies`` names
    the files with the keys of the others."""
    by_band = np.array([FACTORS[factors.get(b, 0)] for b in range(40)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_counts = hot.value
        for batch in batches:
            for first, _, words, ends in slices(batch):
                values, rows, sizes = shingle_sets(words, ends, n)
                ids = batch.column("doc_id").slice(first, len(ends)).to_pylist()
                prints = fingerprints(values, sizes)
                idents = np.array([0 if i is None else i for i in ids], np.int64)
                keys = _copy_keys(idents, *prints)
                lead = first_of_each(*prints, sizes, ids) & ~_among(keys, (keys % np.uint64(_PARTS)).astype(np.int64), folder, "copies", copies)
                seen = np.zeros(len(values), np.int64)
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, values), len(hot_keys) - 1)
                    seen = np.where(hot_keys[at] == values, hot_counts[at], 0)
                parts = []
                for those, band, bound in _roles_of(np.where(lead, sizes, 0), similarity):
                    here = those[rows]
                    parts.append(index_entries(values[here], rows[here], seen[here], band, bound, by_band[band], coarse))
                entries, row, known = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(entries):
                    continue
                docs = idents[row]
                salts = (known // SALT_DOCUMENTS + 1).astype(np.uint64)
                entries = entries & ~_SALTED | np.where(salts > 1, _SALTED, np.uint64(0))
                salt = mixed(docs.view(np.uint64)) % salts
                shard = (mixed(entries + salt * _P) % np.uint64(shards)).astype(np.int64)
                order = in_order(shard, np.arange(len(shard), dtype=np.uint64))
                shard, entries, docs = shard[order], entries[order], docs[order]
                cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts[:-1]]), pa.array([entries[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([docs[a:b].tobytes() for a, b in spans], pa.binary())],
                    schema=_INDEX,
                )

    return run


_GROUPS = pa.schema([("entry", pa.int64()), ("piece", pa.int64()), ("docs", pa.list_(pa.int64()))])


def _groups(table: pa.Table) -> pa.Table:
    """Documents that share an index entry, once for each set of documents; long groups in pieces.

    A group that all lies here is named by its documents. One that has more pieces, here or, as it is
    salted, in other shards, is named by its entry.
    """
    shard = table.column("shard")[0].as_py()
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.uint64)
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
    order = np.lexsort((docs, entries))
    entries, docs = entries[order], docs[order]
    fresh = np.r_[True, (entries[1:] != entries[:-1]) | (docs[1:] != docs[:-1])]
    entries, docs = entries[fresh], docs[fresh]
    starts = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]])
    stops = np.r_[starts[1:], len(entries)]
    sums = np.add.reduceat(mixed(docs.view(np.uint64)), starts)
    salted = entries[starts] & _SALTED > 0
    several = np.flatnonzero((stops - starts > 1) | salted)
    out, done = [], set()
    for a, b, name, apart in zip(starts[several], stops[several], sums[several], salted[several], strict=True):
        in_pieces = apart or b - a > PIECE
        if in_pieces:
            name = entries[a]
        elif name in done:
            continue
        done.add(name)
        name = int(name.astype(np.int64))
        out += [(name, shard << 32 | k if in_pieces else -1, docs[a + k * PIECE : min(b, a + (k + 1) * PIECE)]) for k in range(-(-(b - a) // PIECE))]
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _GROUPS, strict=True)], schema=_GROUPS)


def _similar(shared: int, a: int, b: int, similarity: tuple[int, int]) -> bool:
    return similarity[1] * shared >= similarity[0] * (a + b - shared)


def _star(similarity: tuple[int, int]):
    """Compare each set of a block with the block's centre."""

    def run(table: pa.Table) -> pa.Table:
        sets = dict(zip(table.column("doc_id").to_pylist(), table.column("values").to_pylist(), strict=True))
        centre = table.column("centre")[0].as_py()
        middle = np.frombuffer(sets[centre], np.uint64)
        out = []
        for ident, values in sets.items():
            if ident != centre:
                values = np.frombuffer(values, np.uint64)
                shared = len(np.intersect1d(middle, values, assume_unique=True))
                if _similar(shared, len(middle), len(values), similarity):
                    out.append((centre, ident))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


class _Cluster:
    """Sets of a cluster, or of two pieces of one, in a task: id, component, size and bitmap of each."""

    def __init__(self, table: pa.Table, similarity: tuple[int, int]) -> None:
        order = table.sort_by([("side", "ascending"), ("n", "ascending"), ("doc_id", "ascending")])
        self.side, self.ids, self.components, self.n = (order.column(c).to_numpy() for c in ("side", "doc_id", "component", "n"))
        self.bits = [np.frombuffer(b, np.uint8) for b in order.column("bits").to_pylist()]
        self.folds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.similarity, self.two = similarity, bool(len(self.side)) and self.side[0] != self.side[-1]

    def _folds(self, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of ``width`` bytes or twice as many, which similar sets may have, folded to ``to`` bytes."""
        if (width, to) not in self.folds:
            those = [k for k, x in enumerate(self.bits) if len(x) in (width, 2 * width)]
            at = np.zeros(len(self.bits), np.int64)
            at[those] = np.arange(len(those))
            self.folds[width, to] = np.stack([folded(self.bits[k], to) for k in those]).view(np.uint64), at
        return self.folds[width, to]

    def passing(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Row, the later rows (or those of the other piece) of other components that sizes and bitmaps
        let be similar to it, and the share of the largest difference that the bitmaps show."""
        a, b = self.similarity
        first = int(np.searchsorted(self.side, 1)) if self.two else len(self.ids)
        for i in range(first):
            # Sizes ascend within a side: similar ones are a range.
            low, high = (first, len(self.ids)) if self.two else (i + 1, first)
            low = low + int(np.searchsorted(self.n[low:high], -(-self.n[i] * a // b)))
            high = low + int(np.searchsorted(self.n[low:high], self.n[i] * b // a, "right"))
            others = low + np.flatnonzero(self.components[low:high] != self.components[i])
            bound = (self.n[others] + self.n[i]) * (b - a) // (a + b)
            # Bitmaps folded to an eighth first; those as wide as the narrowest here on what these let pass.
            for part in (8, 1):
                if not len(others):
                    break
                width = min(len(self.bits[i]), len(self.bits[others[0]]))
                fold, at = self._folds(width, max(8, width // part))
                shown = np.bitwise_count(fold[at[others]] ^ fold[at[i]]).sum(1, dtype=np.int64)
                keep = shown <= bound
                others, bound, shown = others[keep], bound[keep], shown[keep]
            if len(others):
                yield i, others, shown / np.maximum(bound, 1)


def spanning_forest(u: np.ndarray, v: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Places of the edges (u, v), of earlier ones first, that join what ``labels`` holds apart, without a cycle."""
    labels, taken = np.unique(labels, return_inverse=True)[1], []
    open_ = np.flatnonzero(labels[u] != labels[v])
    while len(open_):
        best = np.full(labels.max() + 1, len(u))
        np.minimum.at(best, labels[u[open_]], open_)
        np.minimum.at(best, labels[v[open_]], open_)
        chosen = np.unique(best[best < len(u)])
        taken.append(chosen)
        parent = np.arange(len(best))

        def root(x: int, parent: np.ndarray = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(labels[u[chosen]].tolist(), labels[v[chosen]].tolist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        labels = np.array([root(x) for x in range(len(best))])[labels]
        open_ = open_[labels[u[open_]] != labels[v[open_]]]
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _pairs(cluster: _Cluster, u: np.ndarray, v: np.ndarray) -> dict[str, pa.Array]:
    u, v = cluster.ids[u], cluster.ids[v]
    return {"a": pa.array(np.minimum(u, v).astype(np.int64)), "b": pa.array(np.maximum(u, v).astype(np.int64))}


def _passing(cluster: _Cluster) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = list(cluster.passing())
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8)
    u = np.concatenate([np.full(len(o), i, np.int32) for i, o, _ in found])
    return u, np.concatenate([o.astype(np.int32) for _, o, _ in found]), np.concatenate([(255 * d).astype(np.uint8) for _, _, d in found])


def _forest(similarity: tuple[int, int]):
    """A spanning forest of the pairs that bitmaps let pass, closest first: fewer pairs than sets."""

    def run(table: pa.Table) -> pa.Table:
        cluster = _Cluster(table, similarity)
        u, v, shown = _passing(cluster)
        order = np.argsort(shown, kind="stable")
        u, v = u[order], v[order]
        keep = spanning_forest(u, v, cluster.ids)
        pairs = _pairs(cluster, u[keep], v[keep])
        return pa.table({"entry": pa.array([table.column("entry")[0].as_py()] * len(keep), pa.int64()), **pairs})

    return run


def _across(similarity: tuple[int, int]):
    """All pairs of a cluster that lie in different components and that bitmaps let pass."""

    def run(table: pa.Table) -> pa.Table:
        cluster = _Cluster(table, similarity)
        u, v, _ = _passing(cluster)
        return pa.table(_pairs(cluster, u, v))

    return run


class _Join:
    """The steps of one join; tables that several steps read are stored."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, similarity: tuple[int, int], n: int, coarse: dict[int, int] | None) -> None:
        self.docs, self.similarity, self.n, self.coarse = docs, similarity, n, coarse
        self.texts = texts_of(docs, id_col, text_col)
        self.id_col, self.text_col = id_col, text_col
        self.spark: SparkSession = docs.sparkSession

    def look(self) -> None:
        tables = max(4, self.docs.count() // 50_000)
        self.seen = stored(self.texts.mapInArrow(_look(self.similarity, self.n, tables), _SEEN_DDL))
        self.sets = self.seen.where("kind = 0").select("doc_id", "n", "fp1", "fp2", "bits", "entries")
        # Of equal sets the smallest id stands for all; empty sets stand for themselves.
        leads = self.sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("lead"))
        self.leads = stored(leads)

    def copies(self, folder: str) -> frozenset[int]:
        """Write the keys of the documents whose set has a smaller id, and name the files."""
        later = self.sets.where("n > 0").join(self.leads, ["fp1", "fp2", "n"]).where("doc_id > lead").select("doc_id", "fp1", "fp2")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = _copy_keys(*(batch.column(c).to_numpy() for c in ("doc_id", "fp1", "fp2")))
                yield pa.RecordBatch.from_arrays([pa.array((keys % np.uint64(_PARTS)).astype(np.int64)), pa.array(keys.view(np.int64))], names=["part", "key"])

        def keep(table: pa.Table) -> pa.Table:
            write_array(folder, f"copies-{table.column('part')[0].as_py()}", np.sort(table.column("key").to_numpy().view(np.uint64)))
            return table.select(["part"]).slice(0, 1)

        parts = later.mapInArrow(keyed, "part BIGINT, key BIGINT").groupBy("part").applyInArrow(keep, "part BIGINT")
        return frozenset(r["part"] for r in parts.collect())  # at most ``_PARTS`` rows

    def groups(self) -> DataFrame:
        hot = _hot_shingles(self.seen)
        factors = {r["doc_id"]: r["f"] for r in self.seen.where("kind = 2").groupBy("doc_id").agg(F.max("n").alias("f")).collect()}  # a row a band
        total = self.sets.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("e"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        shards = max(8, -(-total["e"] // SHARD_ENTRIES))
        coarse = self.coarse
        if coarse is None:
            share = min(1.0, float(hot[1][hot[1] >= HOT_DOCUMENTS].sum()) / max(1, total["n"]))
            coarse = {band: coarse_segments(band, share) for band in factors}
        folder = new_folder(self.spark, "copies")
        run = _index(self.similarity, self.n, self.spark.sparkContext.broadcast(hot), factors, coarse, shards, folder, self.copies(folder))
        index = self.texts.mapInArrow(run, "shard BIGINT, entries BINARY, docs BINARY")
        found = index.groupBy("shard").applyInArrow(_groups, "entry BIGINT, piece BIGINT, docs ARRAY<BIGINT>")
        # Shards name a group of the same documents alike, so it is kept once.
        return stored(found.groupBy("entry", F.when(F.col("piece") < 0, -1).otherwise(F.col("piece")).alias("piece")).agg(F.first("docs").alias("docs")))

    def fetch(self, pairs: DataFrame) -> DataFrame:
        """Sets (doc_id, values) of the documents that are in any pair."""
        folder, parts = new_folder(self.spark, "candidates"), 64
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))

        def keep(table: pa.Table) -> pa.Table:
            write_array(folder, f"ids-{table.column('part')[0].as_py()}", np.sort(table.column("doc_id").to_numpy()))
            return table.select(["part"]).slice(0, 1)

        there = frozenset(r["part"] for r in ids.groupBy("part").applyInArrow(keep, "part BIGINT").collect())  # at most ``parts`` rows
        n = self.n

        # Chosen and cut in one step: a second Python step in the task would be a second worker beside it.
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(_among(batch.column("doc_id").to_numpy(), batch.column("part").to_numpy(), folder, "ids", there)))
                for first, _, words, ends in slices(batch):
                    values, _, sizes = shingle_sets(words, ends, n)
                    stops = np.cumsum(sizes)
                    own = [values[b - k : b].tobytes() for b, k in zip(stops, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(own)), pa.array(own, pa.binary())], names=["doc_id", "values"])

        rows = self.texts.where("doc_id IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
        return rows.mapInArrow(sets, "doc_id BIGINT, values BINARY")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of a stored table that are similar, compared on their whole sets."""
        blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("blocks"))
        dealt = pairs.join(blocks, "a").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.col("b").alias("doc_id"))
        middles = blocks.select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc_id"))
        rows = dealt.unionByName(middles).join(self.fetch(pairs), "doc_id")
        return stored(rows.groupBy("centre", "block").applyInArrow(_star(self.similarity), "a BIGINT, b BIGINT"))

    def clusters(self, groups: DataFrame) -> DataFrame:
        """Members (entry, doc_id, n) of the clusters, each set by the smallest id that has it.

        Groups that lie whole in one row make one cluster with those of the same smallest document;
        one in pieces is a cluster of its own, named by its entry.
        """
        lead = self.sets.join(self.leads, ["fp1", "fp2", "n"]).groupBy(F.col("doc_id").alias("member")).agg(F.min("lead").alias("doc_id"), F.max("n").alias("n"))
        members = groups.select(F.col("entry").alias("own"), "piece", F.array_min("docs").alias("least"), F.explode("docs").alias("member"))
        members = members.select(F.when(F.col("piece") < 0, F.xxhash64("least")).otherwise(F.col("own")).alias("entry"), "member").distinct()
        return stored(members.join(lead, "member").select("entry", "doc_id", "n").distinct())

    def met(self, members: DataFrame, placed: DataFrame) -> DataFrame:
        """Members with component, size and bitmap, once for each piece of their cluster that they meet."""
        held = F.greatest(F.count(F.lit(1)) / PIECE, F.sum("n") * (2 * BITMAP / 8) / PIECE_BYTES)
        pieces = members.groupBy("entry").agg(F.ceil(held).alias("pieces"), F.count(F.lit(1)).alias("k")).where("k > 1")
        own = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
        rows = members.join(pieces, "entry").select("entry", "doc_id", own.alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("q"))
        rows = rows.select("entry", F.least("p", "q").alias("piece"), F.greatest("p", "q").alias("other"), F.when(F.col("p") <= F.col("q"), 0).otherwise(1).alias("side"), "doc_id")
        return rows.join(placed, "doc_id")

    def run(self) -> DataFrame:
        self.look()
        members = self.clusters(self.groups())
        bitmaps = self.sets.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", F.col("doc_id").alias("component"), "n", "bits")
        forest = self.met(members, bitmaps).groupBy("entry", "piece", "other").applyInArrow(_forest(self.similarity), "entry BIGINT, a BIGINT, b BIGINT")
        forest = stored(forest)
        links = self.verified(stored(forest.select("a", "b").distinct()))
        found = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        # A cluster has pairs left only if one of its forest's pairs does not lie within a component.
        side = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"in_{s}"))
        apart = forest.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b"))
        open_ = members.join(apart.select("entry").distinct(), "entry", "left_semi")
        known = bitmaps.drop("component").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        known = known.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "n", "bits")
        pairs = self.met(stored(open_), known).groupBy("entry", "piece", "other").applyInArrow(_across(self.similarity), "a BIGINT, b BIGINT")
        pairs = stored(pairs.distinct().join(forest.select("a", "b").distinct(), ["a", "b"], "left_anti"))
        links = links.union(self.verified(pairs))
        found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        lead = self.sets.join(self.leads, ["fp1", "fp2", "n"], "left")
        return lead.join(found.withColumnRenamed("node", "lead"), "lead", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "lead", "doc_id").alias("component_id")
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, n: int = WORDS, coarse: dict[int, int] | None = None) -> DataFrame:
    """Link documents by the Jaccard similarity of their shingle sets: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id reachable over links, the own one included. Null text counts as
    empty; documents without words have an empty set and link with none. A text of fewer than ``n``
    words is one shingle. Repeated rows each get a row. A row without id takes part only with the
    component of a text whose shingles are the same, else it has none. An empty table gives no rows; other columns are not read. Shingles are
    compared by hashes of 52 bits. Runs jobs.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return _Join(docs, id_col, text_col, similarity, n, coarse).run()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component, with all their columns; those without id stay."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("ident")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("ident"))
    return rows.join(gone, "ident", "left_anti").select("row.*")

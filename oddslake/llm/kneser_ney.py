"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read through memory maps.

The model is a set of sorted arrays in the shared folder. Words are 64-bit hashes; the vocabulary is
the sorted hashes, cut into ranges, with their counts, and a word's place in it is its number. A
bigram is the pair of numbers packed into 64 bits, so bigrams are exact; their sorted keys and counts
are cut into shards by context, and by both words where the context is very frequent. Beside the
vocabulary lie, per word, the number of distinct words before it and the numbers of distinct words
after it that were seen once, twice, and more often.

Counting: tasks that read documents sort their n-grams and send one block per shard; a shard adds up
its blocks. Block and shard sizes are bounded, and the number of shards follows the corpus.
Scoring: workers map the arrays, look up sorted keys and add up log probabilities per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import lower_ascii, whole_text, words
from oddslake.llm.shared_files import mapped_array, new_folder, write_array

#: Tokens a task counts at once and scores at once; bigram tokens per shard; documents per vocabulary range; how
#: often a context occurs before its bigrams are spread over all shards; numbers per range of word statistics.
#: Working arrays take some 100 bytes for each token scored at once and 70 for each bigram of a shard.
CHUNK_TOKENS, SCORED_TOKENS, SHARD_TOKENS, RANGE_ROWS, HOT_CONTEXT, RANGE_WORDS = 1_000_000, 250_000, 1_500_000, 20_000, 200_000, 1_000_000
#: The token that ends a text. It is no word's hash but for a 64-bit accident.
END = np.uint64(0x5DEECE66D5DEECE6)
_BLOCK = "shard BIGINT, kind INT, keys BINARY, counts BINARY"
_BLOCKS = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUMS = pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("total", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("n4", pa.int64())])
_SUM = "shard BIGINT, size BIGINT, total BIGINT, n1 BIGINT, n2 BIGINT, n3 BIGINT, n4 BIGINT"


def word_hashes(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id and ``tokens``, the hash of each word of the text in ASCII lower case."""
    tokens = F.transform(words(lower_ascii(whole_text(text_col))), lambda w: F.xxhash64(w))
    return docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"), *more)


def chunks(batch: pa.RecordBatch, most: int = CHUNK_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, rows, their tokens end to end, and where each row ends.

    A slice holds ``most`` tokens, or one row if that has more.
    """
    lists = batch.column("tokens")
    ends = lists.offsets.to_numpy().astype(np.int64)[: len(lists) + 1]
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row = 0
    while row < len(lists):
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, upto - row, values[ends[row] : ends[upto]], ends[row + 1 : upto + 1] - ends[row]
        row = upto


def with_ends(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with ``END`` after each row, and where each row then ends."""
    return np.insert(tokens, ends, END), ends + np.arange(1, len(ends) + 1)


def _block_rows(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One row per shard; ``keys`` must be in order within each shard."""
    order = np.argsort(shards, kind="stable")
    shards, keys, counts = shards[order], keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.empty(0, np.int64)
    stops = np.r_[starts[1:], len(shards)] if len(starts) else starts
    cut = lambda a: [a[i:j].tobytes() for i, j in zip(starts, stops, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shards[starts].astype(np.int64)), pa.array(np.full(len(starts), kind, np.int32)), pa.array(cut(keys), pa.binary()), pa.array(cut(counts), pa.binary())], schema=_BLOCKS)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], (np.add.reduceat(counts, starts) if len(starts) else counts)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _summary(shard: int, counts: np.ndarray, total: int) -> pa.Table:
    n = [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]
    return pa.Table.from_arrays([pa.array([v], pa.int64()) for v in (shard, len(counts), total, *n)], schema=_SUMS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that numbers in order spread over shards."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Vocabulary:
    """Sorted word hashes in ``len(sizes)`` equal hash ranges; a word's number is its place."""

    folder: str
    sizes: tuple[int, ...]
    total: int

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, ``size`` for unknown ones."""
        out, n, base = np.full(len(hashes), self.size, np.int64), len(self.sizes), 0
        cuts = np.searchsorted(_range_of(hashes, n), np.arange(n + 1))
        for r, size in enumerate(self.sizes):
            if size and cuts[r] < cuts[r + 1]:
                known, asked = mapped_array(self.folder, f"words-{r}", "uint64"), hashes[cuts[r] : cuts[r + 1]]
                at = np.minimum(np.searchsorted(known, asked), size - 1)
                out[cuts[r] : cuts[r + 1]] = np.where(known[at] == asked, base + at, self.size)
            base += size
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often each numbered word occurs; 0 for the number of unknown words."""
        out, bases = np.zeros(len(numbers), np.int64), np.cumsum([0, *self.sizes])
        part = np.searchsorted(bases, numbers, "right") - 1
        for r in np.unique(part):
            if r < len(self.sizes) and self.sizes[r]:
                here = part == r
                out[here] = mapped_array(self.folder, f"counts-{r}", "int64")[numbers[here] - bases[r]]
        return out


def _range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def count_words(tokens: DataFrame, ranges: int, folder: str) -> Vocabulary:
    """Count all tokens; ``tokens`` has rows of doc_id and token hashes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, ends in chunks(batch):
                keys, counts = np.unique(with_ends(values, ends)[0], return_counts=True)
                yield _block_rows(_range_of(keys, ranges), keys, counts.astype(np.int64))

    def add(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _added(_joined(table, "keys", np.uint64), _joined(table, "counts", np.int64))
        write_array(folder, f"words-{shard}", keys)
        write_array(folder, f"counts-{shard}", counts)
        return _summary(shard, counts, int(counts.sum()))

    sums = tokens.mapInArrow(blocks, _BLOCK).groupBy("shard").applyInArrow(add, _SUM).collect()  # a row a range
    sizes = {r["shard"]: r["size"] for r in sums}
    return Vocabulary(folder, tuple(sizes.get(r, 0) for r in range(ranges)), sum(r["total"] for r in sums))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and more; where the counts of counts give none, a half."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    found = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else 0.5
        found.append(d if 0 < d < k else 0.5)
    return tuple(found)


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.asarray([0.0, *d])[np.minimum(counts, 3)]


@dataclass(frozen=True)
class Model:
    """What scoring needs to know; the arrays stay in the folder."""

    vocabulary: Vocabulary
    documents: int
    shards: int
    hot: int
    sizes: dict[int, int] = field(repr=False)
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    lower_discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    pairs: int = 0
    lower_counts: tuple[int, int, int] = (0, 0, 0)
    range_words: int = RANGE_WORDS

    def shard_of(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Shard of a bigram: by its first word, by both where the first is frequent."""
        return _shard_of(self.vocabulary, self.documents, self.shards, self.hot, before, after)

    def statistics(self, name: str, numbers: np.ndarray) -> np.ndarray:
        out, part = np.zeros(len(numbers), np.int64), numbers // self.range_words
        for r in np.unique(part):
            here = part == r
            out[here] = mapped_array(self.vocabulary.folder, f"{name}-{r}", "uint32")[numbers[here] - r * self.range_words]
        return out


def _context_counts(vocabulary: Vocabulary, documents: int, before: np.ndarray) -> np.ndarray:
    """How often a word stands before another token; the number after the last word is a text's start."""
    return np.where(before == vocabulary.size, documents, vocabulary.counts(before))


def _shard_of(vocabulary: Vocabulary, documents: int, shards: int, hot: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    spread = _context_counts(vocabulary, documents, before) > hot
    key = before.astype(np.uint64)
    key = np.where(spread, key << np.uint64(32) | after.astype(np.uint64), key)
    return (_mixed(key) % np.uint64(shards)).astype(np.int64)


def _numbered(vocabulary: Vocabulary, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token (``size``: unknown), of the one before (``size``: start), and ends."""
    tokens, ends = with_ends(tokens, ends)
    distinct, place = np.unique(tokens, return_inverse=True)
    after = vocabulary.numbers(distinct)[place]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[np.r_[0, ends[:-1]]] = vocabulary.size
    return before, after, ends


def _add_pairs(table: pa.Table, folder: str, range_words: int) -> pa.Table:
    """Write a shard; give its summary and, by range of words, what it knows of each word."""
    shard = table.column("shard")[0].as_py()
    keys, counts = _added(_joined(table, "keys", np.uint64), _joined(table, "counts", np.uint32))
    write_array(folder, f"pairs-{shard}", keys)
    write_array(folder, f"pair_counts-{shard}", counts.astype(np.uint32))
    n = [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]
    out = [pa.Table.from_batches([_block_rows(np.full(1, -1), np.array([shard], np.uint64), np.array([[len(keys), *n]], np.int64), -1)])]

    def known(kind: int, numbers: np.ndarray) -> None:
        words, n = np.unique(numbers, return_counts=True)
        out.append(pa.Table.from_batches([_block_rows((words // np.uint32(range_words)).astype(np.int64), words, n.astype(np.uint32), kind)]))

    known(0, keys.astype(np.uint32))  # the second word is the lower half
    first = (keys >> np.uint64(32)).astype(np.uint32)
    for kind, those in ((1, counts == 1), (2, counts == 2), (3, counts >= 3)):
        known(kind, first[those])
    return pa.concat_tables(out)


def train(tokens: DataFrame, documents: int, folder: str, shard_tokens: int = SHARD_TOKENS, hot: int = HOT_CONTEXT, range_words: int = RANGE_WORDS) -> Model:
    """Count rows of token hashes and leave the model in ``folder``."""
    vocabulary = count_words(tokens, max(4, documents // RANGE_ROWS), folder)
    if vocabulary.size >= 1 << 32:
        raise ValueError("a vocabulary above 2**32 words needs wider numbers")
    shards = max(4, -(-vocabulary.total // shard_tokens))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, ends in chunks(batch):
                before, after, _ = _numbered(vocabulary, values, ends)
                keys, counts = np.unique(before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64), return_counts=True)
                first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                yield _block_rows(_shard_of(vocabulary, documents, shards, hot, first, second), keys, counts.astype(np.uint32))

    def add(table: pa.Table) -> pa.Table:
        return _add_pairs(table, folder, range_words)

    from oddslake.session import stored

    counted = stored(tokens.mapInArrow(blocks, _BLOCK).groupBy("shard").applyInArrow(add, _BLOCK))
    sizes, n = {}, np.zeros(4, np.int64)
    for row in counted.where("kind = -1").collect():  # a row a shard
        numbers = np.frombuffer(row["counts"], np.int64)
        sizes[int(np.frombuffer(row["keys"], np.uint64)[0])] = int(numbers[0])
        n += numbers[1:]

    def gather(table: pa.Table) -> pa.Table:
        """Dense statistics of one range of words; counts of counts of the words before."""
        r, kinds = table.column("shard")[0].as_py(), np.asarray(table.column("kind"))
        dense = np.zeros((4, range_words), np.int64)
        for kind, keys, counts in zip(kinds, table.column("keys"), table.column("counts"), strict=True):
            dense[kind, np.frombuffer(keys.as_py(), np.uint32) - r * range_words] += np.frombuffer(counts.as_py(), np.uint32)
        for kind, name in enumerate(("before", "once", "twice", "more")):
            write_array(folder, f"{name}-{r}", dense[kind].astype(np.uint32))
        seen = dense[0][dense[0] > 0]
        return _summary(r, seen, int(seen.sum()))

    sums = counted.where("kind >= 0").groupBy("shard").applyInArrow(gather, _SUM).collect()  # a row a range
    lower = [sum(r[f"n{k}"] for r in sums) for k in (1, 2, 3, 4)]
    distinct = sum(r["size"] for r in sums)
    return Model(
        vocabulary, documents, shards, hot, sizes, _discounts(*map(int, n)), _discounts(*lower), sum(r["total"] for r in sums),
        (lower[0], lower[1], distinct - lower[0] - lower[1]), range_words,
    )


def log_probabilities(model: Model, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """log10 of each token's probability after the token before it."""
    vocabulary, size = model.vocabulary, model.vocabulary.size
    if not size:
        return np.zeros(len(after))
    keys, place = np.unique(before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64), return_inverse=True)
    before, after = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A token never seen has the share that the lower discounts leave, spread over one word more than there are.
    known, start = after < size, model.vocabulary.size
    lower_left = sum(d * n for d, n in zip(model.lower_discounts, model.lower_counts, strict=True)) / model.pairs
    lower = np.full(len(keys), lower_left / (size + 1))
    seen = model.statistics("before", after[known])
    lower[known] += np.maximum(_discounted(seen, model.lower_discounts), 0) / model.pairs
    # ``before`` equal to ``size`` is a text's start if the token stands first; an unknown word before
    # has the number ``size + 1`` and no counts.
    usable = before <= start
    out = lower.copy()
    b, a = before[usable], after[usable]
    total = _context_counts(vocabulary, model.documents, b)
    left = sum(d * model.statistics(name, b) for d, name in zip(model.discounts, ("once", "twice", "more"), strict=True))
    counts = np.zeros(len(b), np.int64)
    shard, asked = model.shard_of(b, a), keys[usable]
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
    for s, n in model.sizes.items():
        those = order[cuts[s] : cuts[s + 1]]
        if n and len(those):
            pairs = mapped_array(vocabulary.folder, f"pairs-{s}", "uint64")
            at = np.minimum(np.searchsorted(pairs, asked[those]), n - 1)
            counts[those] = np.where(pairs[at] == asked[those], mapped_array(vocabulary.folder, f"pair_counts-{s}", "uint32")[at], 0)
    counts[a >= size] = 0
    some = total > 0
    out[np.flatnonzero(usable)[some]] = (np.maximum(_discounted(counts[some], model.discounts), 0) + left[some] * lower[usable][some]) / total[some]
    return np.log10(out)[place]


def _scores(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    vocabulary, n, v = model.vocabulary, model.vocabulary.total, model.vocabulary.size
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, values, ends in chunks(batch, SCORED_TOKENS):
                before, after, ends = _numbered(vocabulary, values, ends)
                starts = np.r_[0, ends[:-1]]
                counts = vocabulary.counts(after)
                base = np.log10((counts + 1) / (n + v + 1))
                unknown = before == v
                unknown[starts] = False
                p = log_probabilities(model, np.where(unknown, v + 1, before), after)
                added = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                columns = [batch.column("doc_id").slice(first, rows).cast(pa.int64()), ends - starts, added((counts > 0).astype(np.int64)), added(base), added(p)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return run


def score(tokens: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of rows of token hashes."""
    return tokens.mapInArrow(_scores(model), "doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE")


def learn_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Learn from the rows where ``learn`` holds and score all: adds train_tokens.

    Null text counts as empty: one token, the end. Repeated rows are learned and scored as often as
    they occur. With nothing to learn from, every token has probability one and base_score is 0. An
    empty table gives no rows; other columns are not read. Runs jobs that leave the model's arrays.
    """
    part = docs.where(learn)
    folder = new_folder(docs.sparkSession, "bigrams")
    model = train(word_hashes(part, id_col, text_col), part.count(), folder, **sizes)
    scored = score(word_hashes(docs, id_col, text_col), model)
    return scored.withColumn("train_tokens", F.lit(model.vocabulary.total).cast("bigint"))

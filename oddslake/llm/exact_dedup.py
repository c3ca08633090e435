"""Exact duplicates by Patricia tries that own a share of the texts.

Every task that reads documents inserts its texts into a compressed radix trie, so copies meet before
anything is shuffled. The distinct texts go, whole, to the partition that owns their length and
content hash; the trie there compares them byte by byte with all others of that partition and its
terminal nodes hold the smallest identifier, which is the one that stays, and the number of copies.
A trie over its memory budget moves its heaviest subtree to a local file without a name, later texts
of that subtree are appended, and the file is worked off as a trie of its own at the end.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import whole_text

#: Bytes of labels and nodes that a trie holds in memory before it spills.
TRIE_BYTES = 96 << 20
_NODE = 400  # of Python objects per node, about
_BATCH_BYTES = 8 << 20
#: Stands for a missing identifier: larger than any, so it stays only where there is no other.
_NO_ID = 1 << 64


class _Node:
    __slots__ = ("label", "children", "value", "spill")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.value, self.spill = label, {}, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with a value each; equal strings merge their values (identifier, count, tag)."""

    def __init__(self, budget: int = TRIE_BYTES, prefix: bytes = b"") -> None:
        self.budget, self.prefix, self.root, self.held, self.spilled = budget, prefix, _Node(b""), 0, 0

    def insert(self, text: bytes, ident: int, count: int, tag: bytes) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((text[at:], ident, count, tag), node.spill)
                return
            if at == len(text):
                break
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                self.held += _NODE + len(child.label)
                node, at = child, len(text)
                break
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = _common(child.label, text, at)
            middle = _Node(child.label[:k])
            child.label = child.label[k:]
            middle.children[child.label[0]] = child
            node.children[text[at]] = middle
            self.held += _NODE
            node, at = middle, at + k
        old = node.value
        node.value = (ident, count, tag) if old is None else (min(old[0], ident), old[1] + count, tag)
        if self.held > self.budget:
            self._spill()

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
        stack = [(prefix, node)]
        while stack:
            prefix, node = stack.pop()
            yield prefix, node
            stack += [(prefix + c.label, c) for c in node.children.values()]

    def _spill(self) -> None:
        """Write the heaviest subtree out. A subtree with nearly all bytes is entered, not written."""
        weigh = lambda n: sum(_NODE + len(x.label) for _, x in self._walk(n, b""))
        node, total = self.root, self.held
        while True:
            weight, heaviest = max(((weigh(c), b) for b, c in node.children.items() if c.spill is None), default=(0, None))
            if heaviest is None:
                self.budget *= 2  # one text alone fills the budget
                return
            child = node.children[heaviest]
            if weight < 0.75 * total or not any(c.spill is None for c in child.children.values()):
                break
            node, total = child, weight
        file = tempfile.TemporaryFile()
        for suffix, x in self._walk(child, b""):
            if x.spill is not None:
                x.spill.seek(0)
                for rest, *value in _records(x.spill):
                    pickle.dump((suffix + rest, *value), file)
                x.spill.close()
            elif x.value is not None:
                pickle.dump((suffix, *x.value), file)
        self.held -= weight
        self.spilled += 1
        child.children, child.value, child.spill = {}, None, file

    def items(self) -> Iterator[tuple[bytes, tuple[int, int, bytes]]]:
        """Every distinct string with its value; a spilled subtree becomes a trie of its own."""
        for prefix, node in self._walk(self.root, self.prefix):
            if node.value is not None:
                yield prefix, node.value
            if node.spill is not None:
                node.spill.seek(0)
                below = PatriciaTrie(self.budget, prefix)
                for record in _records(node.spill):
                    below.insert(*record)
                node.spill.close()
                yield from below.items()


def _records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_TEXTS = pa.schema([("text", pa.binary()), ("ident", pa.int64()), ("copies", pa.int64()), ("sha", pa.binary())])
_OWNERS = pa.schema([("ident", pa.int64()), ("copies", pa.int64()), ("sha", pa.binary())])


def _collapse(budget: int, sign: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Insert (text, ident, copies, sha) rows into one trie and give a row per distinct text.

    With ``sign`` -1 the order of identifiers is turned round, so the smallest is the largest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("text", "ident", "copies", "sha")]
            for text, ident, copies, sha in zip(*columns, strict=True):
                trie.insert(text, _NO_ID if ident is None else sign * ident, copies, sha)

        def rows() -> Iterator[tuple]:
            for text, (ident, copies, sha) in trie.items():
                value = (None if ident == _NO_ID else sign * ident, copies, sha)
                yield (text, *value) if with_text else value

        if with_text:
            yield from _batches(rows(), _TEXTS, lambda r: 100 + len(r[0]))
        else:
            yield from _batches(rows(), _OWNERS, lambda r: 150)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``sha`` (SHA-256), ``ident`` of the row that stays, ``copies``."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    sign = -1 if keep == "largest" else 1
    text = whole_text(text_col)
    rows = docs.select(text.cast("binary").alias("text"), F.col(id_col).cast("bigint").alias("ident"), F.lit(1).cast("bigint").alias("copies"), F.unhex(F.sha2(text, 256)).alias("sha"))
    kinds = "text BINARY, ident BIGINT, copies BIGINT, sha BINARY"
    local = rows.mapInArrow(_collapse(trie_bytes, sign, True), kinds)
    dealt = local.repartition(F.octet_length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(_collapse(trie_bytes, sign, False), "ident BIGINT, copies BIGINT, sha BINARY")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Decide for every row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest (or smallest) id stays. Null text counts as empty. A null
    id never stays unless the group has no other. Of rows repeated with the same id and text exactly
    one is kept. An empty table gives no rows; other columns are not read. The owners were found by
    whole texts; the rows of a text find theirs by the text's SHA-256, in a join that adaptive
    execution splits where one text has a large share of the rows.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    rows = rows.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    found = owners(docs, id_col, text_col, keep, trie_bytes)
    return rows.join(found, "sha").select(
        "doc_id",
        F.col("ident").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows that stay, with all their columns; see :func:`exact_duplicates`."""
    kept = exact_duplicates(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias("keep"), F.unhex("text_sha256").alias("keep_sha"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("ident"), F.unhex(F.sha2(whole_text(text_col), 256)).alias("sha"))
    rows = rows.join(kept, F.col("ident").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    return rows.dropDuplicates(["ident", "sha"]).select("row.*")

"""Packing of examples into sequences under several limits, by the dot-product heuristic.

A sequence holds at most so many tokens, segments and loss-bearing tokens. An open sequence takes the
example whose demand has the largest weighted dot product with what is left of the limits, among those
that fit; when none fits the next sequence is opened. Documents become examples by tokenising them and
cutting whole sequences off their start, so only the last piece of each is left to pack. Examples are
dealt at random to groups of a bounded size that are packed independently.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import whole_text
from oddslake.session import stored

#: Examples packed together, about.
GROUP_ROWS = 8_000
#: Limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (2048, 64, 2048)
END_ID = 1
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: The vocabulary of the ranks file as a tokenizer, with the strings that are tokens of their own.
TOKENIZER_FILE = "byte_bpe_50k.json"


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Strings that a tokenizer takes for one token wherever they stand in a text."""
    with open(tokenizer_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take blanks or stand only as words are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def encoder(ranks_path: str, tokenizer_path: str | None = None) -> tiktoken.Encoding:
    """The byte-level BPE of a ranks file, with the added tokens of a tokenizer."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added = added_tokens(tokenizer_path) if tokenizer_path else {}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, ranks_path: str, tokenizer_path: str | None = None) -> np.ndarray:
    """Ids of a text and the end id, as little-endian unsigned 32-bit numbers.

    Without a tokenizer all strings are ordinary text: a ranks file has no added tokens.
    """
    ids = encoder(ranks_path, tokenizer_path).encode(text or "", allowed_special="all", disallowed_special=())
    return np.array([*ids, END_ID], dtype="<u4")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, most: int = LIMITS[0], ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents and cut them at multiples of ``most``: one row a piece, without its ids.

    The ids are those of the tokenizer at its defaults, added tokens included; other ranks have none.
    """
    tokenizer_path = None if ranks_path else public_tokenizers.path(TOKENIZER_FILE)
    ranks_path = ranks_path or public_tokenizers.path(RANKS_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), ranks_path, tokenizer_path)
                rows += [(ident, at, min(most, len(ids) - at), zlib.crc32(ids[at : at + most].tobytes()), len(ids)) for at in range(0, len(ids), most)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PIECES)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT")


def fill(demands: np.ndarray, limits: Sequence[int]) -> list[list[int]]:
    """Sequences of row numbers of ``demands`` (rows by dimensions), each within ``limits``.

    A row beyond a limit by itself gets a sequence of its own. Rows of equal demand are taken in the
    order in which they stand.
    """
    limits = np.asarray(limits, float)
    kinds, place = np.unique(demands, axis=0, return_inverse=True)
    waiting: list[list[int]] = [[] for _ in kinds]
    for row in range(len(demands) - 1, -1, -1):
        waiting[place[row]].append(row)
    left = np.array([len(w) for w in waiting])
    share = kinds / limits
    weight = np.maximum((share * left[:, None]).sum(0) / max(1, len(demands)), 1e-12)  # mean demand of each dimension
    weighted = share * weight
    bins = []
    open_, room = [], np.ones(len(limits))
    while left.any():
        fits = (left > 0) & (share <= room + 1e-12).all(1)
        if not fits.any():
            if open_:
                bins.append(open_)
                open_, room = [], np.ones(len(limits))
                continue
            fits = left > 0  # beyond a limit by itself
        k = int(np.argmax(np.where(fits, weighted @ room, -np.inf)))
        open_.append(waiting[k].pop())
        left[k] -= 1
        room = room - share[k]
    if open_:
        bins.append(open_)
    return bins


_PLACED = pa.schema([("row", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack_group(limits: Sequence[int]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        row, tokens, loss = (table.column(c).to_numpy() for c in ("row", "tokens", "loss_tokens"))
        out = []
        for bin_ in fill(np.stack([tokens, np.ones_like(tokens), loss], 1), limits):
            lengths = tokens[bin_]
            out += zip(row[bin_], np.full(len(bin_), row[bin_[0]]), np.cumsum(lengths) - lengths, strict=True)
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=_PLACED)

    return run


def pack(examples: DataFrame, limits: Sequence[int] = LIMITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place stored examples (row, tokens, loss_tokens), ``row`` unique: row, sequence_id, offset.

    A sequence is named by the row of its first example. Every row is dealt by a hash of ``row``, so
    no group grows with a frequent document. Reruns give the same sequences. No rows give no rows.
    """
    groups = max(1, examples.count() // group_rows)
    rows = examples.select("row", F.col("tokens").cast("bigint"), F.col("loss_tokens").cast("bigint"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    return rows.groupBy("group").applyInArrow(_pack_group(tuple(limits)), "row BIGINT, sequence_id BIGINT, offset BIGINT")


def pack_documents(docs: DataFrame, limits: Sequence[int] = LIMITS, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents, all of whose tokens bear loss.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row a piece. Null
    and empty texts are one token, the end. Repeated rows are packed each for itself; a null id stays
    null; an empty table gives no rows; other columns are not read.
    """
    most = min(limits[0], limits[2])
    cut = stored(pieces(docs, most, ranks_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    whole = cut.where(F.col("length") == most).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("bigint")})
    rest = cut.where(F.col("length") < most)
    placed = pack(rest.select("row", F.col("length").alias("tokens"), F.col("length").alias("loss_tokens")), limits)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*columns).unionByName(rest.join(placed, "row").select(*columns))

"""Shards of near equal size by a minimax contiguous partition.

Documents with equal texts form an atomic group. Groups are ordered by the SHA-256 of their text and
the ordered list is cut into contiguous shards whose largest is as small as it can be: the smallest
capacity for which greedy filling needs no more than the given number of shards is found by search,
then the list is cut. Because the order is that of the key itself, a document's shard follows from
comparing its key with the cut keys; no join brings the groups back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddslake.llm.common import numbered, whole_text
from oddslake.session import stored

#: Capacities that one search round tries in the same jobs; the range shrinks by one more than this.
TRIED = 64
#: Rows that are numbered in one window, about.
ROWS_A_PART = 20_000


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, the bytes of its text plus one, checksum and group key; no text."""
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )


def running_groups(rows: DataFrame) -> DataFrame:
    """Groups (``key``, ``size``) with ``upto``: the sizes of all groups up to this one, by key.

    The total is added up on three levels, the first byte of the key, the first two, and the key,
    so each window holds a bounded share of the groups.
    """
    byte = lambda n: F.conv(F.hex(F.substring("key", n, 1)), 16, 10).cast("int")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("b1", byte(1)).withColumn("b2", byte(2))
    low = groups.groupBy("b1", "b2").agg(F.sum("size").alias("s"))
    high = low.groupBy("b1").agg(F.sum("s").alias("s"))
    before = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    high = high.select("b1", before(W.orderBy("b1")).alias("h"))  # at most 256 rows
    low = low.withColumn("l", before(W.partitionBy("b1").orderBy("b2"))).drop("s")
    offsets = low.join(F.broadcast(high), "b1").select("b1", "b2", (F.col("h") + F.col("l")).alias("base"))
    inside = W.partitionBy("b1", "b2").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        groups.withColumn("inside", F.sum("size").over(inside))
        .join(F.broadcast(offsets), ["b1", "b2"])  # at most 65,536 rows
        .select("key", "size", (F.col("base") + F.col("inside")).alias("upto"))
    )


def smallest_capacity(last_upto: Callable[[list[int]], list[int]], total: int, largest: int, shards: int) -> int:
    """Smallest capacity with which greedy filling ends within ``shards`` shards.

    ``last_upto`` gives for each limit the largest running total that does not exceed it. Each round
    tries ``TRIED`` capacities at once, so a round costs ``shards - 1`` look-ups.
    """
    low = max(largest, -(-total // shards))  # below this it can't fit
    high = min(total, -(-total // shards) + largest)  # this always fits
    while low < high:
        step = max(1, (high - low) // (TRIED + 1))
        tried = sorted({min(high - 1, low + step * i) for i in range(TRIED)})
        reached = [0] * len(tried)
        for _ in range(shards - 1):
            reached = last_upto([r + c for r, c in zip(reached, tried, strict=True)])
        fits = [total - r <= c for r, c in zip(reached, tried, strict=True)]
        first = fits.index(True) if any(fits) else len(tried)
        high = tried[first] if first < len(tried) else high
        low = tried[first - 1] + 1 if first else low
    return low


def cuts(groups: DataFrame, shards: int) -> list[tuple[int, bytes | None]]:
    """Where the shards but the last end: running total and key, None before the first group.

    Within the smallest capacity each cut is placed next to an even share of what is left, so the
    shards beside a very large group stay even too.
    """
    total, largest = groups.agg(F.max("upto"), F.max("size")).first()
    if total is None:
        return [(0, None)] * (shards - 1)

    def last_upto(limits: list[int]) -> list[int]:
        limits = [min(x, total) for x in limits]
        # The limits are one array value, so every job runs the same generated code.
        near = groups.where(F.col("upto").between(min(limits) - largest, max(limits)))
        over = F.size(F.filter(F.lit(sorted(limits)).cast("array<bigint>"), lambda x: x < F.col("upto")))
        found = {r["over"]: r["upto"] for r in near.groupBy(over.alias("over")).agg(F.max("upto").alias("upto")).collect()}
        best = {x: max((u for n, u in found.items() if n <= i), default=0) for i, x in enumerate(sorted(limits))}
        return [best[x] for x in limits]

    capacity = smallest_capacity(last_upto, total, largest, shards)
    earliest, at = [0] * shards, total  # from which the rest still fits
    for k in range(shards - 1, 0, -1):
        if at > capacity:
            near = groups.where(F.col("upto").between(at - capacity, at - capacity + largest))
            at = near.agg(F.min("upto")).first()[0]
        else:
            at = 0
        earliest[k] = at
    ends, at = [], 0
    for k in range(1, shards):
        ideal = at + (total - at) / (shards - k + 1)
        near = groups.where(F.col("upto").between(int(ideal) - largest, int(ideal) + largest + 1))
        limit = last_upto([at + capacity])[0]
        below, above = near.agg(F.max(F.when(F.col("upto") <= ideal, F.col("upto"))), F.min(F.when(F.col("upto") > ideal, F.col("upto")))).first()
        below, above = at if below is None else below, total if above is None else above
        at = min(max(above if above - ideal < ideal - below else below, earliest[k], at), limit)
        ends.append(at)
    keys = {r["upto"]: bytes(r["key"]) for r in groups.where(F.col("upto").isin(ends)).collect()}
    return [(e, keys.get(e)) for e in ends]


def shard_by_size(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to a shard: columns doc_id, size, text_crc32, shard, slot.

    Equal texts share a shard, and no contiguous partition of the groups has a smaller largest shard.
    ``slot`` numbers the rows of a shard from 0 without gaps. Null text counts as empty; a null id is
    kept as it is; repeated rows get a slot each; an empty table gives no rows; other columns, whatever
    their names, are not read. This runs jobs: it stores one narrow row per document and per group.
    """
    rows = stored(sized_rows(docs, id_col, text_col))
    groups = running_groups(rows)
    groups = stored(groups.repartitionByRange("upto").sortWithinPartitions("upto"))
    shard = sum(
        ((F.col("key") > F.lit(bytearray(key))).cast("int") if key is not None else F.lit(1) for _, key in cuts(groups, shards)),
        F.lit(0),
    )
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"))
    parts = max(1, rows.count() // (ROWS_A_PART * shards))
    return numbered(placed, ["shard"], F.xxhash64("doc_id", "text_crc32"), ["doc_id", "text_crc32", "size"], "slot", parts)

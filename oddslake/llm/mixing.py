"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by the set of sources they belong
to; the flow sends each pattern's words to the quotas of its sources, where a second and a third use
of the same words cost more than the first (a convex cost). The flow has one node per pattern and per
source and none per document. Documents are then chosen in a seeded order up to each pattern's words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddslake.llm.common import BLANK_RUN, BLANKS, whole_text
from oddslake.session import stored

#: Rows of one selection window, about.
ROWS_A_PART = 2_000


def word_count(text: Column) -> Column:
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(body) == 0, 0).otherwise(F.size(F.split(body, BLANK_RUN))).cast("bigint")


def shared_targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share the sum of all sizes by weight; none above ``most`` times its own size.

    What a source at its limit can't take is shared again by weight among those below theirs.
    """
    targets, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = rest * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        rest -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return targets


def min_cost_flow(
    patterns: Mapping[tuple, int], quotas: Mapping[object, int], repeats: int = 3
) -> dict[tuple, int]:
    """Words each pattern gives in all, so that quotas are met as far as they can be at least cost.

    ``patterns`` maps a tuple of sources to its words. The t-th use of a word costs t, so words are
    used again only where fresh ones can't reach the quota. Successive shortest paths.
    """
    nodes = ["from", *(("p", p) for p in patterns), *(("s", s) for s in quotas), "to"]
    index = {n: i for i, n in enumerate(nodes)}
    to, room, cost, out = [], [], [], [[] for _ in nodes]

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, k in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(k)

    given = {}
    for p, size in patterns.items():
        given[p] = len(to)
        for t in range(1, repeats + 1):
            edge(0, index["p", p], size, t)
        for s in p:
            if s in quotas:
                edge(index["p", p], index["s", s], repeats * size, 0)
    for s, quota in quotas.items():
        edge(index["s", s], len(nodes) - 1, quota, 0)
    while True:
        far, by = [float("inf")] * len(nodes), [-1] * len(nodes)
        far[0], queue, waits = 0, deque([0]), {0}
        while queue:
            a = queue.popleft()
            waits.discard(a)
            for e in out[a]:
                if room[e] > 0 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], by[to[e]] = far[a] + cost[e], e
                    if to[e] not in waits:
                        waits.add(to[e])
                        queue.append(to[e])
        if by[-1] < 0:
            break
        path, at = [], len(nodes) - 1
        while at:
            path.append(by[at])
            at = to[by[at] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {p: sum(room[(e + 2 * t) ^ 1] for t in range(repeats)) for p, e in given.items()}


def choose(rows: DataFrame, words_from: Mapping[tuple, tuple[int, int]], repeats: int, seed: int, n_rows: int) -> DataFrame:
    """Add ``copies``. ``words_from`` maps a pattern to its words and the words to take of it.

    Every document of a pattern is used as often as all can be; the rest comes from documents in the
    order of a seeded hash, up to the one whose middle passes the amount. Running totals are cut into
    hash ranges, so a pattern with most of the rows is not summed up in one task.
    """
    spark = rows.sparkSession
    plan = [(list(p), min(repeats, take // size) if size else 0, take - (take // size) * size if size else 0) for p, (size, take) in words_from.items()]
    plan = spark.createDataFrame(plan, "pattern ARRAY<STRING>, each BIGINT, rest BIGINT")  # one row a pattern
    parts = max(1, n_rows // ROWS_A_PART)
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = rows.withColumn("__order", order).withColumn("__part", F.floor((F.shiftrightunsigned("__order", 1)) / F.lit(2.0**63 / parts)).cast("int"))
    rows = rows.withColumn("__order", F.shiftrightunsigned("__order", 1))
    before = W.partitionBy("pattern").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = (
        rows.groupBy("pattern", "__part")
        .agg(F.sum("size").alias("__n"))
        .select("pattern", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    inside = W.partitionBy("pattern", "__part").orderBy("__order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    more = (F.col("__base") + F.col("__upto") - F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("each") < repeats)
    return (
        rows.withColumn("__upto", F.sum("size").over(inside))
        .join(base, ["pattern", "__part"])
        .join(F.broadcast(plan), "pattern")
        .withColumn("copies", F.col("each") + more.cast("bigint"))
        .drop("__order", "__part", "__upto", "__base", "each", "rest")
    )


def mix(rows: DataFrame, quotas: Mapping[str, int], repeats: int = 3, seed: int = 17) -> DataFrame:
    """Add ``copies`` to stored rows (doc_id, size, pattern, …), 0 to ``repeats`` of each document.

    ``pattern`` is the sorted array of the sources a document belongs to; ``quotas`` has the words
    wanted of each source. The driver holds one number per pattern.
    """
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {tuple(r["pattern"]): r["size"] for r in sums}
    flow = min_cost_flow(sizes, quotas, repeats)
    return choose(rows, {p: (sizes[p], flow[p]) for p in sizes}, repeats, seed, sum(r["n"] for r in sums))


#: Pattern entry that stands for a missing source; "=" is put before those that are there.
MISSING = "null"


def source_quotas(rows: DataFrame, weights: Sequence[int], most: float) -> list[tuple[str, int, float]]:
    """Sources in code point order, the missing one last, each with its words and target."""
    found = rows.groupBy(F.col("pattern")[0].alias("name")).agg(F.sum("size").alias("size")).collect()  # a row a source
    found = sorted(((r["name"], r["size"]) for r in found), key=lambda x: (x[0] == MISSING, x[0]))
    targets = shared_targets([s for _, s in found], [weights[i % len(weights)] for i in range(len(found))], most)
    return [(n, s, t) for (n, s), t in zip(found, targets, strict=True)]


def source_rows(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(MISSING))
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(whole_text()).alias("size"), F.array(name).alias("pattern"))


def mix_by_source(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: int = 17) -> DataFrame:
    """Mix documents of one source each: doc_id, source, size, source_size, target, taken, copies.

    Sources in code point order, the missing one last, get ``weights`` in turn. ``size`` counts words,
    0 for null text; such documents are never taken. Repeated rows are chosen one by one; an empty
    table gives no rows; other columns are not read. This runs jobs and stores one narrow row a
    document.
    """
    rows = stored(source_rows(docs))
    quotas = source_quotas(rows, weights, repeats)
    mixed = mix(rows, {n: round(t) for n, _, t in quotas}, repeats, seed)
    facts = rows.sparkSession.createDataFrame([([n], s, t) for n, s, t in quotas], "pattern ARRAY<STRING>, source_size BIGINT, target DOUBLE")
    return mixed.join(F.broadcast(facts), "pattern").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def take_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Of each pattern the documents used once more than the others are a prefix of the seeded order, so
    where that prefix ends is all that has to be known of it, and no row is looked up by its id.
    """
    rows = stored(source_rows(docs))
    mixed = mix(rows, {n: round(t) for n, _, t in source_quotas(rows, weights, repeats)}, repeats, seed)
    place = F.struct(F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 1).alias("order"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
    least = mixed.groupBy("pattern").agg(F.min("copies").alias("each"))
    ends = mixed.join(F.broadcast(least), "pattern").groupBy("pattern", "each").agg(F.max(F.when(F.col("copies") > F.col("each"), place)).alias("last"))
    ends = stored(ends)
    taken = _beside(docs)
    copies = F.col("each") + F.coalesce(place <= F.col("last"), F.lit(False)).cast("bigint")
    return taken.join(F.broadcast(ends), "pattern").select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


def _beside(docs: DataFrame) -> DataFrame:
    """What decides on a row, beside the whole row."""
    rows = docs.select(F.struct("*").alias("row"))
    name = F.coalesce(F.concat(F.lit("="), F.col("row.source").cast("string")), F.lit(MISSING))
    return rows.select("row", F.col("row.doc_id").alias("doc_id"), word_count(whole_text(F.col("row.text"))).alias("size"), F.array(name).alias("pattern"))

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import table

from oddslake.llm import mixing, sharding


def least_largest(sizes, shards):
    """Smallest possible largest shard of a contiguous partition, by trying capacities one by one."""
    capacity = max(sizes)
    while True:
        used, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        if used <= shards:
            return capacity
        capacity += 1


@pytest.mark.parametrize("seed", range(6))
def test_smallest_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, 400]) for _ in range(rng.randrange(1, 60))]
    upto = list(itertools.accumulate(sizes))
    look = lambda limits: [max((u for u in upto if u <= x), default=0) for x in limits]
    assert sharding.smallest_capacity(look, upto[-1], max(sizes), 5) == least_largest(sizes, 5)


def test_shards(docs, rows, none):
    found = sharding.shard_by_size(docs, 4).collect()
    assert len(found) == len(rows) and {r["shard"] for r in found} <= set(range(4))
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    crcs = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    assert all(r["size"] == sizes[r["doc_id"]] and r["text_crc32"] == crcs[r["doc_id"]] for r in found)
    where = defaultdict(set)
    for r in found:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    # No contiguous partition of the groups, in the order of their keys, has a smaller largest shard.
    keyed = sorted((bytes(r["key"]), r["size"]) for r in sharding.running_groups(sharding.sized_rows(docs)).collect())
    held = Counter()
    for r in found:
        held[r["shard"]] += r["size"]
    assert max(held.values()) == least_largest([s for _, s in keyed], 4)
    assert sharding.shard_by_size(none).count() == 0


def test_targets():
    assert mixing.shared_targets([10, 10, 10], [1, 1, 1]) == [10, 10, 10]
    targets = mixing.shared_targets([1, 100, 100], [5, 2, 1])
    assert targets[0] == 3 and abs(sum(targets) - 201) < 1e-9 and abs(targets[1] - 2 * targets[2]) < 1e-9
    assert mixing.shared_targets([0, 0], [1, 2]) == [0, 0] and mixing.shared_targets([], []) == []


def test_flow_meets_overlapping_quotas_at_least_cost():
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 5, ("b", "c"): 8}
    given = mixing.min_cost_flow(patterns, {"a": 18, "b": 14, "c": 9}, 3)
    cost = lambda g: sum(sum(t * min(patterns[p], max(0, g[p] - (t - 1) * patterns[p])) for t in (1, 2, 3)) for p in patterns)
    best = None
    for ab_a, bc_c, a, b in itertools.product(range(0, 31), range(0, 25), range(0, 31), range(0, 16)):
        if a + ab_a != 18 or bc_c != 9:
            continue
        for ab_b in range(0, 31 - ab_a):
            bc_b = 14 - b - ab_b
            if 0 <= bc_b <= 24 - bc_c:
                c = cost({("a",): a, ("a", "b"): ab_a + ab_b, ("b",): b, ("b", "c"): bc_b + bc_c})
                best = c if best is None else min(best, c)
    assert sum(given.values()) == 18 + 14 + 9 and cost(given) == best


def test_mix(docs, rows, none, spark):
    first, again = (sorted(map(tuple, mixing.mix_by_source(docs).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    taken, target, most = Counter(), {}, Counter()
    for doc_id, source, size, _, goal, words, copies in first:
        assert size == sizes[doc_id] and words == size * copies and 0 <= copies <= 3
        taken[source] += words
        most[source] = max(most[source], size)
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in target)
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for doc_id, _, _, _, _, _, copies in first:
        want[doc_id] += copies
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.mix_by_source(none).count() == 0 and mixing.take_mix(none).count() == 0
    blank = table(spark, [(1, None, "en", None), (2, "", "en", "x")])
    assert [r["taken"] for r in mixing.mix_by_source(blank).collect()] == [0, 0] and mixing.take_mix(blank).count() == 0

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import edited, prose, table

from oddslake.llm import ngram_join as J
from oddslake.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_force(rows):
    """Size and smallest id reachable over links of each id."""
    sets, parent = {i: shingles(t) for i, t, *_ in rows}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in at[s])
        for s in sets[i]:
            at[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("coarse", [None, {0: 0, 1: 0, 2: 1, 3: 3, 4: 5}])
def test_against_brute_force(spark, docs, rows, coarse):
    want = brute_force(rows)
    found = J.near_duplicates(docs, coarse=coarse).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_chains_and_borders(spark):
    """Links at the border of the similarity, small sets, and chains that only meet over several texts."""
    rng, rows = random.Random(3), []
    for k in range(40):
        n = rng.choice([1, 2, 5, 6, 7, 8, 9, 12, 20, 21, 40, 80])
        text = prose(k, n)
        for j in range(6):
            rows.append((1000 * k + j, text, "en", "s"))
            text = edited(text, 50 * k + j, rng.randrange(0, max(1, n // 25) + 1)) + (" more" if rng.random() < 0.4 else "")
    rng.shuffle(rows)
    found = J.near_duplicates(table(spark, rows).repartition(7)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_force(rows)


def test_rows_that_stay(docs, rows, none, spark):
    kept = J.drop_near_duplicates(docs)
    want = brute_force(rows)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert J.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id BIGINT, text STRING")
    assert sorted(map(tuple, J.near_duplicates(odd).collect()), key=str) == sorted([(1, 2, 1), (2, 0, 2), (None, 2, 1)], key=str)


def _entries(values, coarse, factor):
    own = set()
    for band, bound in J.roles(len(values)):
        k = coarse if 4**band >= 12 * coarse else 0
        by_row = [np.array([x]) for x in (band, bound, factor)]
        zeros = np.zeros(len(values), np.int64)
        own |= set(J.index_entries(values, zeros, zeros, *by_row, {band: k})[0].tolist())
    return own


@pytest.mark.parametrize("coarse", [0, 1, 2])
@pytest.mark.parametrize("factor", [8, 0])
def test_similar_sets_share_an_entry(coarse, factor):
    rng = np.random.default_rng(coarse)
    draw = lambda n: rng.integers(0, 1 << 52, n).astype(np.uint64)
    for _ in range(400):
        n = int(rng.integers(16, 300))
        a = np.unique(draw(n))
        gone, new = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 7 + 1))
        b = np.unique(np.r_[a[gone:], draw(new)])
        shared = len(a) - gone
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert _entries(a, coarse, factor) & _entries(b, coarse, factor)


def test_least_factors():
    """Sets that fall into too few segments are found, and a segment each is always enough."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 3000)
    values, rows = rng.integers(0, 1 << 52, sizes.sum()).astype(np.uint64), np.repeat(np.arange(3000), sizes)
    band = np.array([J.band_of(n) for n in sizes])
    bound = np.array([J.roles(int(n))[0][1] for n in sizes])
    need = J.least_factors(values, rows, 3000, band, bound)
    assert (need > 0).any()
    for row in range(3000):
        v = values[rows == row]
        enough = [len(set(J.dealt(v, np.full(len(v), band[row]), np.full(len(v), f)).tolist())) > bound[row] for f in J.FACTORS]
        assert enough.index(True) == need[row]


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 52, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.r_[a[: len(a) // 2], rng.integers(0, 1 << 52, int(rng.integers(0, 200))).astype(np.uint64)])
        x, y = (np.frombuffer(v, np.uint8) for v in J.parity_bits(np.r_[a, b], np.array([len(a), len(b)])))
        least = min(len(x), len(y))
        apart = int(np.bitwise_count(J.folded(x, least) ^ J.folded(y, least)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_groups_in_pieces_and_across():
    n = J.PIECE + 10
    salted = int(J._SALTED) | 9
    entries = np.full(n, 5, np.uint64).tobytes() + np.array([6, 6, 7, 8, 8, salted], np.uint64).tobytes()
    docs = np.arange(n, dtype=np.int64).tobytes() + np.array([1, 2, 3, 2, 1, 4], np.int64).tobytes()
    out, other = (J._groups(pa.table({"shard": [k], "entries": [entries], "docs": [docs]})).to_pylist() for k in (0, 1))
    assert [len(r["docs"]) for r in out] == [J.PIECE, 10, 2, 1] and out[0]["entry"] == out[1]["entry"] and out[0]["piece"] != out[1]["piece"]
    assert out[2]["piece"] == -1 and out[2]["entry"] == other[2]["entry"]  # the same documents, once
    assert out[3]["entry"] == other[3]["entry"] and out[3]["piece"] != other[3]["piece"]
    bits = J.parity_bits(np.arange(10, dtype=np.uint64), np.array([10]))[0]
    far = J.parity_bits(np.arange(100, 130, dtype=np.uint64), np.array([30]))[0]
    rows = {"side": [0, 0, 1, 1], "doc_id": [1, 2, 3, 4], "component": [1, 1, 3, 4], "n": [10, 10, 10, 30], "bits": [bits, bits, bits, far]}
    found = J._across((75, 100))(pa.table(rows)).to_pylist()
    assert {(r["a"], r["b"]) for r in found} == {(1, 3), (2, 3)}


def test_clusters_give_spanning_forests():
    """Pieces and one whole cluster let the same pairs pass; a forest joins what they join, in fewer pairs."""
    rng = np.random.default_rng(11)
    base = [np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64)) for n in (9, 60, 61, 900)]
    sets = [np.unique(np.r_[b[k // 2 :], rng.integers(0, 1 << 52, k).astype(np.uint64)]) for b in base for k in range(12)]
    sizes = np.array([len(x) for x in sets])
    bits = J.parity_bits(np.concatenate(sets), sizes)

    def cluster(rows, sides):
        return pa.table({"entry": [5] * len(rows), "side": sides, "doc_id": rows, "component": rows, "n": sizes[rows], "bits": [bits[r] for r in rows]})

    found = lambda t: {(r["a"], r["b"]) for r in t.to_pylist()}
    everything = list(range(len(sets)))
    whole = found(J._across((75, 100))(cluster(everything, [0] * len(sets))))
    similar = {(a, b) for a in everything for b in range(a + 1, len(sets)) if J._similar(len(np.intersect1d(sets[a], sets[b])), sizes[a], sizes[b], (75, 100))}
    assert similar and similar <= whole
    even, odd = everything[::2], everything[1::2]
    parts = [found(J._across((75, 100))(cluster(p, [0] * len(p)))) for p in (even, odd)]
    parts.append(found(J._across((75, 100))(cluster(even + odd, [0] * len(even) + [1] * len(odd)))))
    assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole)
    forest = J._forest((75, 100))(cluster(everything, [0] * len(sets)))
    assert found(forest) <= whole and set(forest.column("entry").to_pylist()) == {5}
    u, v = (np.array(x) for x in zip(*sorted(whole), strict=True))
    keep = J.spanning_forest(u, v, np.arange(len(sets)))
    assert len(keep) == forest.num_rows
    joined = lambda pairs: {frozenset(c) for c in _closed(pairs, len(sets))}
    assert joined(found(forest)) == joined(whole) == joined({(u[k], v[k]) for k in keep})


def _closed(pairs, n):
    label = list(range(n))
    for a, b in sorted(pairs):
        a, b = label[a], label[b]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return [[i for i in range(n) if label[i] == c] for c in set(label)]


def test_components(spark):
    rng, parent = random.Random(5), list(range(300))
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(200, 260)]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def test_copies_and_shared_passages_make_no_groups(spark):
    """Copies in other partitions are not indexed again; subsets with words of their own come first, however rare the others."""
    copies = [(i, prose(i % 20, 80), "en", "a") for i in range(60)]
    passage = prose(900, 120)
    shared = [(100 + i, prose(1000 + i, 110, 10**6) + " " + passage, "en", "a") for i in range(12)]
    for rows, wanted in ((copies, [i % 20 for i in range(60)]), (shared, [100 + i for i in range(12)])):
        docs = table(spark, rows).repartition(4, "doc_id") if rows is copies else table(spark, rows).coalesce(1)
        join = J._Join(docs, "doc_id", "text", (75, 100), 5, None)
        join.look()
        assert join.groups().count() == 0
        found = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(docs).collect()}
        assert found == dict(zip((i for i, *_ in rows), wanted, strict=True))


def test_one_worker_a_task(spark, docs):
    """A task that runs two Python steps holds two workers at once."""
    pairs = spark.createDataFrame([(2, 10), (2, 302)], "a BIGINT, b BIGINT")
    fetched = J._Join(docs, "doc_id", "text", J.SIMILARITY, J.WORDS, None).fetch(pairs)
    assert {r["doc_id"] for r in fetched.collect()} == {2, 10, 302}
    plan = fetched._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 1


def test_small_batches(spark, docs, monkeypatch):
    """All jobs of the join run with its own bound on batches, and the session's is back afterwards."""
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", set(), J.stored
    before = spark.conf.get(key)
    spark.conf.set(key, "16m")
    try:
        monkeypatch.setattr(J, "stored", lambda *a: (seen.add(spark.conf.get(key)), write(*a))[1])
        J.near_duplicates(docs)
        assert seen == {"4m"} and spark.conf.get(key) == "16m"
    finally:
        spark.conf.set(key, before)

import math
import re
from collections import Counter

import numpy as np
import pytest

from oddslake.llm.max_sketch import Sketches, search

ITEMS = "item_id BIGINT, text STRING, query_no STRING, rank STRING, score STRING, doc_id STRING"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    documents, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, count in counted:
            score = 0
            for t in terms(text):
                if t in count:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1)))
                    m = 25 + 75 * sum(count.values()) * documents // total
                    score += w * (1_000_000_000 * count[t] // (1000 * count[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **sizes):
    return sorted((tuple(r) for r in search(docs, spark.createDataFrame([(i, t, "q", "r", "s", "d") for i, t in items], ITEMS), **sizes).collect()), key=repr)


def test_a_sketch_is_never_below_an_impact():
    rng = np.random.default_rng(4)
    row = np.sort(rng.integers(0, 50, 4000))
    hashes, impacts = rng.integers(0, 2**63, 4000, dtype=np.uint64), rng.integers(1, 10**6, 4000)
    sketches = Sketches(row, hashes, impacts, 50, 8)
    assert all(sketches.bounds(np.array([r]), np.array([h]))[0, 0] >= i for r, h, i in zip(row, hashes, impacts, strict=True))
    others = sketches.bounds(np.arange(50), rng.integers(0, 2**63, 500, dtype=np.uint64))
    assert (others > 0).mean() < 0.1


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t, _, _ in rows if t]
    out = [(k, " ".join(texts[k * 3].split(" ")[5:25])) for k in range(10)]
    return [*out, (20, None), (21, ""), (22, "nowhereatall"), (23, "one TWO three three"), (24, "ünïcode 𝔘 a_b-c"), (25, "w1 " * 500 + texts[8]), (3, out[3][1])]


@pytest.mark.parametrize("sizes", [{}, {"batch_queries": 3, "coordinates": 2}, {"k": 2}])
def test_agrees_with_brute_force(spark, docs, rows, items, sizes):
    want = brute([(i, t) for i, t, _, _ in rows], items, sizes.get("k", 10))
    assert run(spark, docs, items, **sizes) == want and want


def test_null_ids_come_last_among_equals(spark, docs):
    rows = [(None, "alpha beta"), (5, "alpha beta"), (4, "alpha beta"), (1, "gamma"), (2, "gamma delta"), (3, "x"), (6, "y"), (7, "z")]
    got = run(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), [(1, "alpha")])
    assert [r[2] for r in got] == [4, 5, None] and got == brute(rows, [(1, "alpha")])


def test_empty_tables(spark, docs, none):
    assert run(spark, none, [(1, "a")]) == [] and run(spark, docs, []) == [] and run(spark, docs, [(1, None)]) == []

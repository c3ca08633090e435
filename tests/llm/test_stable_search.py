import numpy as np
import pytest
from pyspark.sql import functions as F

from oddslake.llm.stable_search import Points, Tree, chi_square_quantile, nearest

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING, vector STRING, hash STRING, score STRING, query_no STRING, rank INT"


def every():
    return F.col("vec_id") % 50 == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "i", "v", "h", "s", "q", 4) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, k=5):
    """Every neighbour by exact cosines; ties to the smaller id."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, vectors = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    norms = np.sqrt((vectors**2).sum(axis=1))
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = (vectors * vectors[q]).sum(axis=1) / (norms * norms[q])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r, int(ids[j]), float(score[j])) for r, j in enumerate(order, 1)]
    return out


def clustered(n, length=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, length)) * 2
    return [(k, [float(c) for c in np.float32(centres[k % 12] + rng.standard_normal(length))]) for k in range(n)]


def test_quantiles():
    assert abs(chi_square_quantile(0.95, 2) - 5.991464547) < 1e-6 and abs(chi_square_quantile(0.98, 12) - 24.0540) < 1e-3
    with pytest.raises(ValueError, match="even"):
        chi_square_quantile(0.9, 3)


def test_a_tree_holds_each_row_once_within_its_boxes():
    vectors = np.random.default_rng(1).standard_normal((1000, 8))
    tree = Tree(Points.of(np.arange(1000), vectors, 4), leaf_rows=16)
    assert sorted(tree.points.ids) == list(range(1000)) and max(b - a for a, b in tree.leaves) <= 16
    boxes = tree.box_distances(tree.points.low[:5])
    for leaf, (a, b) in enumerate(tree.leaves):
        off = ((tree.points.low[:5, None] - tree.points.low[None, a:b]) ** 2).sum(axis=2)
        assert (off.min(axis=1) >= boxes[:, leaf] - 1e-12).all()


@pytest.mark.parametrize("sizes", [{}, {"first_ring": 40, "growth": 4, "query_rows": 7, "tree_bytes": 24 * 8 * 150}])
def test_recall_and_scores(spark, sizes):
    rows = clustered(3000)
    got = [tuple(r) for r in nearest(frame(spark, rows), every(), **sizes).collect()]
    want = brute(rows)
    exact = {(q, j): s for q, _, j, s in want}
    found = {(q, j) for q, _, j, _ in got}
    assert len(got) == len(want) == 300 and len(found & set(exact)) >= 0.9 * len(exact)
    assert all(abs(s - exact[q, j]) < 1e-12 for q, _, j, s in got if (q, j) in exact)


@pytest.mark.parametrize("sizes", [{}, {"first_ring": 10, "growth": 3, "query_rows": 5, "tree_bytes": 3 * 8 * 40}])
def test_copies_ties_and_rows_without_vector(spark, sizes):
    """A stopping test that never fails makes the search exact, so every tie can be compared."""
    hot = [0.5, -0.25, 1.0]
    rows = [(k, hot) for k in range(200)] + [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(200, 320)]
    rows += [(250, hot)] * 30 + [(50, [1.0, 0.0, 0.0])] + [(400, [0.0, 0.0, 0.0]), (450, None), (500, [1.0, None, 2.0]), (550, [float("nan"), 1.0, 1.0])]
    rows += [(None, hot), (600, [1e-30, 2e-30, -1e-30]), (601, [1e30, 2e30, -1e30]), (650, [1.0, 2.0]), (700, [])]
    got = sorted(tuple(r) for r in nearest(frame(spark, rows), every(), certainty=1 - 1e-12, **sizes).collect())
    want = sorted(brute([r for r in rows if r[1] is None or len(r[1]) == 3]))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_few_and_no_candidates(spark):
    assert nearest(frame(spark, []), every()).count() == 0
    assert nearest(frame(spark, [(50, [1.0, 2.0])]), every()).count() == 0
    assert nearest(frame(spark, [(51, [1.0, 2.0])]), every()).columns == ["query_id", "rank", "vec_id", "score"]
    got = nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]), every()).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]

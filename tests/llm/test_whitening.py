import numpy as np
import pytest

from oddslake.llm.whitening import cross_products, integers, whiten

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, component STRING, n STRING, id STRING, vector STRING, place INT"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "n", "i", "v", 3) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("top", [1, 7, 2**20, 2**62])
@pytest.mark.parametrize("rows", [1, 63, 64, 1000])
def test_planes_give_exact_sums(top, rows):
    x = np.random.default_rng(top % 97 + rows).integers(-top, top, (rows, 5))
    x[:, 3] = 11  # a dimension without planes
    sums, products = cross_products(x)
    plain = x.astype(object)
    assert (sums == plain.sum(axis=0)).all() and (products == plain.T.dot(plain)).all()


def test_entries_beyond_a_long_are_held():
    assert integers(np.array([[1e300, -1e300, 0.0, -0.001]])).tolist() == [[2**62 + 10**6, -(2**62) + 10**6, 10**6, 10**6 - 1]]


def test_agrees_with_brute_force(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 40)) * np.linspace(0.2, 3, 40)).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(7, rows[7][1])] * 5 + [(None, rows[8][1])]
    broken = [(900, None), (901, [float("nan")] * 40), (902, [1.0] * 39 + [None]), (903, [float("inf")] + [1.0] * 39), (904, []), (905, [1.0, 2.0])]
    got = whiten(frame(spark, rows + broken)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == len(rows) * 32 and set(got["component"]) == set(range(1, 33))
    x = np.floor(np.array([v for _, v in rows], float) * 64).astype(np.int64) + 1_000_000
    n = len(x)
    covariance = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = (x - x.mean(axis=0)) @ vectors / np.sqrt(values)
    mine = got[got.vec_id == 3].sort_values("component")
    assert np.allclose(np.abs(mine["whitened"]), np.abs(want[3]), atol=1e-8)
    assert np.allclose(mine["explained"], values / np.trace(covariance), rtol=1e-9)
    assert set(got["n"]) == {n} and set(mine["deviation"]) == {int(((n * x[3] - x.sum(axis=0)) ** 2).sum())}
    one = got.groupby("component")["whitened"].agg(lambda z: (z**2).mean())
    assert np.allclose(one, 1, atol=1e-9) and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert (got["vec_id"] == 7).sum() == 6 * 32 and got["vec_id"].isna().sum() == 32


def test_components_that_do_not_vary(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(10)]
    got = whiten(frame(spark, rows)).toPandas()
    assert got[got.component == 1]["whitened"].notna().all() and got[got.component > 1]["whitened"].isna().all()
    assert got["identity_error"].max() < 1e-9 and abs(got[got.component == 1]["explained"].iloc[0] - 1) < 1e-9
    same = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).toPandas()
    assert len(same) == 4 and same["whitened"].isna().all() and set(same["deviation"]) == {0} and set(same["explained"]) == {0.0}


def test_far_apart_entries(spark):
    got = whiten(frame(spark, [(1, [1e15, 0.5]), (2, [-1e15, 0.25]), (3, [3.0, 1.0])])).toPandas()
    # Squares of the far rows exceed a long; the row between them does not.
    assert got[got.vec_id < 3]["deviation"].isna().all() and got[got.vec_id == 3]["deviation"].notna().all()
    assert got["identity_error"].max() < 1e-4


def test_tables_without_vectors(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [])])).columns[0] == "vec_id"

import random

import pytest

from oddslake.llm.common import with_package

COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, size INT, row STRING, key BINARY, tokens STRING, shard INT, copies INT, pattern STRING"


@pytest.fixture(autouse=True)
def workers(spark):
    with_package(spark)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with other columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, 7, "x", b"k", "t", 3, 9, "p") for i, t, lang, src in rows], COLUMNS)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and blank texts, copies, near copies, a repeated row, a very long text."""
    out = [(0, None, "en", "a"), (1, "", None, "b"), (2, " \t\n", "en", None), (3, "one", None, None), (4, "One  two\nthree", "de", "a")]
    base = [prose(k, 60 + 7 * k) for k in range(8)]
    for k, text in enumerate(base):
        out += [(10 + 10 * k + j, edited(text, 100 * k + j, j), "en" if k % 2 else "de", "abc"[k % 3]) for j in range(6)]
    out += [(200 + j, base[0], "en", "hot") for j in range(40)]
    out += [(300, prose(99, 30_000), "en", "a"), (301, "𝔘 ünïcode " + base[1], "en", "é"), (302, base[2], "en", "Z"), (302, base[2], "en", "Z")]
    out += [(400 + j, edited(base[3], 9000 + j, 3), "en", "hot") for j in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])

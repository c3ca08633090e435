from collections import Counter, defaultdict

import numpy as np
import pytest
import zlib
from conftest import prose, table
from test_ngram_join import brute_force

import corpus_pipeline as C
from oddslake.llm import mixing, quality_rules, vector_packing
from oddslake.session import stored


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    junk = [(700 + i, " ".join(w + "$$$" for w in prose(i, 120).split()), "en", "a") for i in range(20)]
    more = [(800 + i, prose(5000 + i, 90), "en", "abc"[i % 3]) for i in range(250)]
    out = str(tmp_path_factory.mktemp("sf"))
    table(spark, [*rows, *junk, *more]).write.parquet(f"{out}/documents.parquet")
    return out


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [[(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]]
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == columns, name
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    start, good, once, apart, mixed = seen
    verdicts = quality_rules.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").collect()
    assert Counter(i for i, *_ in good) == Counter(r["doc_id"] for r in verdicts)
    assert not any("$$$" in t for _, t, _ in good) and len(good) >= 250 and all(t for _, t, _ in good)
    largest = defaultdict(int)
    for i, t, _ in good:
        largest[t] = max(largest[t], i)
    assert sorted((i, t) for i, t, _ in once) == sorted((i, t) for t, i in largest.items())
    want = brute_force(once)
    assert sorted(i for i, *_ in apart) == sorted(i for i, (_, c) in want.items() if i == c)
    times = Counter(i for i, *_ in mixed)
    assert set(times) <= {i for i, *_ in apart} and max(times.values()) <= 3
    sizes, sources = {i: len(t.split()) for i, t, _ in apart}, sorted({s for *_, s in apart})
    of = lambda s, n: sum(sizes[i] * n(i) for i, _, x in apart if x == s)
    targets = mixing.shared_targets([of(s, lambda i: 1) for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))])
    assert all(abs(of(s, lambda i: times[i]) - t) <= max(sizes.values()) for s, t in zip(sources, targets, strict=True))
    placed = C.STAGES[-1][1](spark, docs, folder).collect()
    ids = {i: vector_packing.token_ids(t, vector_packing.public_tokenizers.path(vector_packing.RANKS_FILE)) for i, t, _ in apart}
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in placed)
    assert pieces == Counter((i, a, len(ids[i][a : a + 2048]), zlib.crc32(np.ascontiguousarray(ids[i][a : a + 2048]).tobytes())) for i, *_ in mixed for a in range(0, len(ids[i]), 2048))


def test_run(spark, folder, tmp_path):
    assert C.run(spark, folder).count() > 200
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0

import hashlib
import random
from collections import defaultdict

import pytest

from oddslake.llm.exact_dedup import PatriciaTrie, drop_exact_duplicates, exact_duplicates


@pytest.mark.parametrize("budget", [1 << 30, 3000, 1])
def test_trie_holds_every_string_once(budget):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(600)] + [b"", b"a" * 5000, b"a" * 5000 + b"b"]
    trie, want = PatriciaTrie(budget), {}
    for i, t in enumerate(texts):
        trie.insert(t, i, 1, t[:3])
        least, count = want.get(t, (i, 0))
        want[t] = (min(least, i), count + 1)
    found = list(trie.items())
    assert len(found) == len(want) and {t: v[:2] for t, v in found} == want and all(v[2] == t[:3] for t, v in found)
    assert (trie.spilled > 0) == (budget == 3000) or budget == 1


@pytest.mark.parametrize(("keep", "trie_bytes"), [("largest", 1 << 24), ("smallest", 20_000)])
def test_against_brute_force(docs, rows, keep, trie_bytes):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    found = exact_duplicates(docs, keep=keep, trie_bytes=trie_bytes).collect()
    assert len(found) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = by_text[r["text_sha256"]]
        assert r["doc_id"] in ids and r["keep_id"] == pick(ids) and r["group_size"] == len(ids)
    assert sum(r["kept"] for r in found) == len(groups)
    assert sorted(r["doc_id"] for r in found if r["kept"]) == sorted(map(pick, groups.values()))


def test_rows_that_stay(docs, rows, none, spark):
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})
    assert exact_duplicates(none).count() == 0 and drop_exact_duplicates(none).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, "x"), (5, "y"), (None, "y")], "doc_id BIGINT, text STRING")
    got = sorted(map(tuple, exact_duplicates(nulls).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, None, 2, True), (None, None, 2, False), (5, 5, 2, True), (None, 5, 2, False)], key=str)
    with pytest.raises(ValueError, match="keep"):
        exact_duplicates(docs, keep="any")

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddslake.llm import kneser_ney
from oddslake.llm.common import held_out
from oddslake.llm.kneser_ney import learn_and_score


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Reference:
    """The model by its textbook definition, on dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            self.pairs.update(zip(["<s>", *t], t))
            self.words.update(t)
        self.after, self.total, before = defaultdict(Counter), Counter(), Counter()
        for (a, b), c in self.pairs.items():
            self.after[a][min(c, 3)] += 1
            self.total[a] += c
            before[b] += 1
        self.before, self.d, self.d1 = before, self.discounts(self.pairs), self.discounts(before)
        kinds = Counter(min(c, 3) for c in before.values())
        self.left = sum(self.d1[k - 1] * kinds[k] for k in (1, 2, 3)) / sum(before.values())

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)]
        return [x if 0 < x < k else 0.5 for k, x in enumerate(d, 1)]

    def cut(self, c, d):
        return max(0, c - d[min(c, 3) - 1]) if c else 0

    def p(self, a, b):
        lower = self.cut(self.before[b], self.d1) / sum(self.before.values()) + self.left / (len(self.words) + 1)
        if not self.total[a]:
            return lower
        gamma = sum(self.d[k - 1] * self.after[a][k] for k in (1, 2, 3)) / self.total[a]
        return self.cut(self.pairs[a, b], self.d) / self.total[a] + gamma * lower


@pytest.mark.parametrize("sizes", [{}, {"hot": 5, "shard_tokens": 3000, "range_words": 50}])
def test_against_the_definition(docs, rows, sizes):
    learned = [tokens(t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model, n = Reference(learned), sum(map(len, learned))
    v = len(model.words)
    assert abs(sum(model.p("w1", w) for w in model.words) + model.p("w1", "unseen") - 1) < 1e-9
    want = {}
    for i, text, *_ in rows:
        t = tokens(text)
        score = sum(math.log10(model.p(a, b)) for a, b in zip(["<s>", *t], t))
        want[i] = (len(t), sum(model.words[w] > 0 for w in t), sum(math.log10((model.words[w] + 1) / (n + v + 1)) for w in t), score)
    found = learn_and_score(docs, ~held_out("doc_id", 7), **sizes).collect()
    assert len(found) == len(rows)
    for r in found:
        n_tokens, n_known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_nothing_to_learn_from(docs, none):
    found = learn_and_score(docs, F.lit(False)).collect()
    assert found and all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in found)
    assert learn_and_score(none, F.lit(True)).count() == 0


def test_a_task_holds_little(docs, tmp_path):
    """Peak bytes of a batch of a million tokens to score, and of a whole shard, far below a worker's share."""
    model = kneser_ney.train(kneser_ney.word_hashes(docs, "doc_id", "text"), docs.count(), str(tmp_path))
    rng = np.random.default_rng(1)
    batch = pa.record_batch({"doc_id": pa.array(range(100)), "tokens": pa.array(list(rng.integers(-(1 << 62), 1 << 62, (100, 10_000))))})
    shard = [np.unique(rng.integers(0, 1 << 50, kneser_ney.SHARD_TOKENS // 10, dtype=np.uint64)) for _ in range(10)]
    table = pa.Table.from_batches([kneser_ney._block_rows(np.full(len(b), 3), b, np.ones(len(b), np.uint32)) for b in shard])
    steps = [lambda: sum(b.num_rows for b in kneser_ney._scores(model)(iter([batch]))), lambda: kneser_ney._add_pairs(table, str(tmp_path), 1 << 30)]
    for step, most in zip(steps, (40e6, 128e6), strict=True):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most

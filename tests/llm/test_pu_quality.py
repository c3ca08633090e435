import random
import zlib

import numpy as np
from conftest import prose, table
from pyspark.sql import functions as F

from oddslake.llm import pu_quality as P
from oddslake.llm.common import held_out


def test_non_negative_risk_separates(seed=1):
    rng = np.random.default_rng(seed)
    positive, mixed = rng.normal(1.5, 1, (800, 4)), np.concatenate([rng.normal(1.5, 1, (1200, 4)), rng.normal(-1.5, 1, (800, 4))])
    net = P.fit(positive, mixed, 0.6)
    score = P._sigmoid(net.logits(mixed))
    assert (score[:1200] >= 0.5).mean() > 0.95 and (score[1200:] < 0.5).mean() > 0.95


def test_held_out_accuracy(spark, none):
    rng, rows, labels = random.Random(3), [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = prose(i, rng.randrange(60, 300))
        rows.append((i, text if good else " ".join(f"{w}%%" if rng.random() < 0.8 else w for w in text.split()), "en", "s"))
        if i % 2:
            labels.append((i, int(good)))
    truth = {r[0]: "%%" not in r[1] for r in rows}
    table_ = spark.createDataFrame([*labels, (10_000, None)], "doc_id BIGINT, quality INT")
    found = P.classify(table(spark, rows), table_, ~held_out("doc_id", 4)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    late = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((r["score"] >= 0.7) == truth[r["doc_id"]] for r in late) >= 0.97 * len(late)
    assert P.classify(none, table_, F.lit(True)).count() == 0


def test_without_positives_and_odd_texts(docs, rows, spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    found = P.classify(docs, empty, F.lit(True)).collect()
    assert len(found) == len(rows) and {r["score"] for r in found} == {0.5}
    labels = spark.createDataFrame([(10, 1), (11, 1), (20, 1), (1, 0)], "doc_id BIGINT, quality INT")
    found = P.classify(docs, labels, F.lit(True)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
